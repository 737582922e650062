"""Market rules pinned by rows computed by hand."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeworks.operators import enrich, journal, lookups, news, oi, scalp, signal
from tapeworks.params import Params
from tapeworks.plans import queries as Q
from tapeworks.sources.market import INDEX_NAMES
from tests.conftest import DATA
from tests.test_market import frame, walk



def today():
    return F.lit("2024-02-01").cast("date")


def contracts(spark):
    rows = [(f" {n.lower()} ", f"I{i}", 100 + i, "2024-02-05", i) for i, n in enumerate(INDEX_NAMES)]
    rows += [("ACME", "LATER", 1, "2024-02-20", 0), ("ACME", "SECOND", 2, "2024-02-10", 9), (" ACME ", "FIRST", 9, "2024-02-10", 3), ("ACME", "GONE", 3, "2024-01-31", 1), (" ", "NAMELESS", 4, "2024-02-05", 2), ("OLD", "OVER", 5, "2024-01-01", 4)]
    df = spark.createDataFrame(rows, "name string, tradingsymbol string, instrument_token long, expiry string, row_id long")
    return df.withColumns({"instrument_type": F.lit("FUT"), "segment": F.lit("NFO-FUT"), "exchange": F.lit("NFO"), "expiry": F.col("expiry").cast("date")})


def test_all_ten_indices_are_no_stocks_and_the_first_row_wins_ties(spark):
    c = contracts(spark)
    assert [r.name for r in lookups.futures_universe(c.where("trim(name) <> ''"), lookups.index_names(c)).collect()] == ["ACME", "OLD"]
    assert [(r.name, r.tradingsymbol) for r in lookups.near_month_contract(c, today()).collect()] == [("ACME", "FIRST")]
    assert {"NIFTY NEXT 50", "NIFTY IT"} < set(INDEX_NAMES) and len(INDEX_NAMES) == 10
    for i, n in enumerate(INDEX_NAMES):
        assert lookups.index_future_contract(c, today(), n).first().tradingsymbol == f"I{i}"
    quotes = spark.createDataFrame([("FIRST", 5.0, 6.0, 4.0), ("I0", 1.0, 1.0, 1.0)], "tradingsymbol string, oi double, oi_day_high double, oi_day_low double")
    watch = spark.createDataFrame([("ACME",), ("nifty",), ("NONE",)], "symbol string")
    assert [tuple(r) for r in lookups.oi_snapshot(watch, lookups.near_month_contract(c, today()), quotes).collect()] == [("ACME", 5.0, 6.0, 4.0)]


def test_screener_rounds_what_it_shows_and_names_its_spans(spark):
    b = frame(spark, walk(200, 3) / 3)
    raw = signal.latest_bar(Q.ind.indicator_series(b, Params())).first()
    row = signal.screener(b, spark.createDataFrame([(0, "A")], "pos int, symbol string"), Params()).first()
    assert (row.close, row.rsi, row.vwap, row.macd_params) == (round(raw.close, 2), round(raw.rsi, 1), round(raw.vwap, 2), "12,26,9")
    assert row.vs_vwap == ("Above" if raw.close > raw.vwap else "Below")
    assert row.stop == pytest.approx(raw.close - (1 if row.direction == "Bullish" else -1) * 1.5 * row.atr, abs=0.006)
    assert signal.screener(b, spark.createDataFrame([(0, "A")], "pos int, symbol string"), Params(timeframe="15minute")).first().macd_params == "3,8,9"


SIGNAL_ROW = (
    "select 1 pos, 'AB' symbol, null error, 101.5D close, 61.2D rsi, 'Bullish' rsi_state, '12,26,9' macd_params, 'Bearish' macd_state, 'Bullish' ema_bb_state, 3 aligned, 'Bearish' fresh_signal, "
    "'Bullish' direction, 1.75D vol_multiple, 'Bearish' htf_direction, 2000D oi, 2100D oi_day_high, 1900D oi_day_low"
)


def test_alert_texts(spark):
    row = spark.sql(SIGNAL_ROW)
    want = "\U0001f53b AB - Bearish confluence on 60minute (confirmed: Vol 1.75x, higher-timeframe trend agrees)\nClose: 101.5 | RSI 61.2 (Bullish) | MACD 12,26,9 (Bearish) | EMA/BB (Bullish) | Aligned 3/4"
    assert enrich.alert_text(row, "60minute").first().alert == want
    bare = row.withColumns({"vol_multiple": F.lit(None).cast("double"), "htf_direction": F.lit(None).cast("string"), "fresh_signal": F.lit("Bullish")})
    assert enrich.alert_text(bare, "day").first().alert.startswith("\U0001f53a AB - Bullish confluence on day (confirmed: Vol confirmed)\n")
    assert enrich.alert_text(row.withColumn("fresh_signal", F.lit(None).cast("string")), "day").first().alert is None
    event = spark.sql("select 'AB' symbol, 'Strong acceleration' accel_label, 'Break Up' break_signal, -0.04D oi_chg_today, 2.345D accel, 'Bullish' direction")
    assert enrich.oi_alert_text(event, "15minute").first().alert == "\U0001f4c8 AB OI just started Strong acceleration - Break Up, -0.0% today - accel +2.35pp (30m) (Bullish confluence) on 15minute"
    few = spark.sql("select 'AB' symbol, string(null) accel_label, string(null) break_signal, double(null) oi_chg_today, double(null) accel, string(null) direction")
    assert enrich.oi_alert_text(few, "day").first().alert == "\U0001f4c8 AB OI just started Accelerating on day"
    item = spark.sql("select 'AB' symbol, 'A title' title, string(null) source, 'https://x' url, -0.5D sentiment")
    assert enrich.news_alert_text(item).first().alert == "\U0001f4f0 AB: A title (sentiment -0.50)\nnews — https://x"
    assert enrich.news_alert_text(item.withColumn("sentiment", F.lit(None).cast("double"))).first().alert.startswith("\U0001f4f0 AB: A title\n")


def test_scan_digest(spark):
    row = spark.sql(SIGNAL_ROW)
    other = row.withColumns({"pos": F.lit(0), "symbol": F.lit("ZZ"), "fresh_signal": F.lit(None).cast("string"), "oi_day_low": F.lit(None).cast("double")})
    broken = row.withColumns({"symbol": F.lit("NO"), "error": F.lit("symbol not found")})
    lines = "- ZZ: close=101.5, RSI=61.2 (Bullish), MACD 12,26,9 (Bearish), EMA9-vs-BBmid (Bullish), aligned=3/4, fresh_signal=none, OI=2000\n- AB: close=101.5, RSI=61.2 (Bullish), MACD 12,26,9 (Bearish), EMA9-vs-BBmid (Bullish), aligned=3/4, fresh_signal=Bearish, OI=2000 (day range 1900-2100)"
    assert enrich.scan_digest(row.unionByName(other).unionByName(broken)).first().digest == lines
    assert enrich.scan_digest(broken).first().digest == "(no usable data in this scan yet)" == enrich.scan_digest(row.where("false")).first().digest


def test_table_sorts_by_each_columns_own_direction(spark):
    rows = spark.createDataFrame([("b", 1.0, None, "New"), ("A", None, "Short Buildup", "Stable"), ("c", -2.0, "Long Buildup", None)], "symbol string, oi_day_chg double, structure string, trend_label string")
    rows = rows.withColumn("close", F.col("oi_day_chg"))
    order = lambda *a: [r.symbol for r in enrich.screener_sort(rows, *a).collect()]
    assert order() == ["b", "c", "A"] and order("oi_day_chg", False) == ["A", "c", "b"]
    assert order("close") == ["A", "c", "b"] and order("symbol") == ["A", "b", "c"]
    assert order("structure") == ["c", "b", "A"]  # none counts as Neutral
    assert order("trend_label") == ["c", "b", "A"] and set(enrich.SORTED) >= {"oi", "param_tier", "vol_multiple"} and len(enrich.SORTED) == 14


def test_a_days_last_reading_needs_no_close_and_unknown_samples_no_change(spark):
    rows = [("2024-01-01 09:00", 90.0, None), ("2024-01-01 10:00", 100.0, 10.0), ("2024-01-01 15:00", 120.0, None), ("2024-01-02 09:00", 500.0, None), ("2024-01-02 09:30", None, 11.0), ("2024-01-02 10:00", 150.0, 11.0), ("2024-01-03 10:00", None, 12.0)]
    df = spark.createDataFrame(rows, "t string, oi double, close double").selectExpr("'A' symbol", "cast(t as timestamp_ntz) ts", "oi", "close")
    got = {str(r.day): (r.base_oi, r.base_close, r.prev_oi) for r in oi.day_baseline(df).collect()}
    assert got == {"2024-01-01": (100.0, 10.0, None), "2024-01-02": (150.0, 11.0, 120.0)}
    state = oi.oi_state(df).orderBy("ts").collect()
    assert [r.oi_day_chg for r in state] == [None, None, None, None, None, 25.0, None] and [r.price_chg_today for r in state] == [None, 0.0, None, None, None, 0.0, None]


@pytest.mark.parametrize("span", [150, 200, 1440])
def test_lookbacks_of_spans_equal_pandas(spark, span):
    rng = np.random.default_rng(span)
    minutes = np.sort(rng.choice(5000, 300, replace=False))
    values = [None if rng.random() < 0.1 else float(v) for v in rng.integers(1, 1000, 300)]
    ts = [dt.datetime(2024, 1, 1) + dt.timedelta(minutes=int(m)) for m in minutes]
    df = spark.createDataFrame(list(zip(["A"] * 300, ts, values)), "symbol string, ts timestamp, oi double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = oi.asof_lookback(df, span_minutes=span).orderBy("ts").collect()
    assert len(got) == 300
    for r in got:
        for n in (15, 30, 60, 120):
            known = [v for t, v in zip(ts, values) if v is not None and r.ts - dt.timedelta(minutes=150) <= t <= r.ts - dt.timedelta(minutes=n)]
            assert r[f"oi_{n}"] == (known[-1] if known else None)


def test_lookback_has_a_partition_for_each_span(spark):
    rows = spark.range(0, 30 * 24).selectExpr("concat('A', id % 2) symbol", "cast(timestamp_seconds(id * 3600) as timestamp_ntz) ts", "double(id) oi")
    plan = oi.asof_lookback(rows)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(symbol#" in plan and "__span#" in plan.split("hashpartitioning(")[1][:60]


def test_engine_says_why_it_waits(spark):
    up = frame(spark, 50 + 0.2 * np.arange(400) + 0.25 * (np.arange(400) % 2), "F", minutes=3).withColumn("timeframe", F.lit("3minute"))
    row = scalp.scalp_signal(up).first()
    assert (row.direction, row.confirmed_count, row.htf_direction, row.action, row.label, row.reason) == ("Bullish", 3, "Bullish", "BUY", "BUY NIFTY FUT", None)
    turned = np.r_[300 - 0.5 * np.arange(390), 105.5 + 3 * np.arange(4)]
    row = scalp.scalp_signal(frame(spark, turned, "F", minutes=3).withColumn("timeframe", F.lit("3minute"))).first()
    assert (row.htf_direction, row.action, row.label, row.reason) == ("Bearish", "WAIT", "NO TRADE - WAIT", "Against the 15-min trend (currently Bearish)")
    flat = np.r_[np.full(200, 50.0) + np.resize([0.0, 0.2], 200), 50.3, 50.0]
    row = scalp.scalp_signal(frame(spark, flat, "F", minutes=3).withColumn("timeframe", F.lit("3minute"))).first()
    if row.action == "WAIT" and row.htf_agrees:
        assert row.reason == f"Only {row.confirmed_count} of 4 aligned (need 3)"
    assert (row.close, row.vwap, row.rsi) == (round(row.close, 2), round(row.vwap, 2), round(row.rsi, 1))


def test_logging_clamps_and_keeps_a_snapshot(spark):
    row = spark.sql(SIGNAL_ROW + ", timestamp_ntz '2024-01-02 10:00:00' ts, 'Bearish' flow_direction, true flow_agrees, 'IT' sector, 0.5D weighted_score")
    got = journal.log_trades(row, "60minute", 1000, -1.0, None).first()
    assert (got.horizon_bars, got.cost_pct, got.slippage_pct, got.logged_close, got.status) == (100, 0.0, 0.0, 101.5, "open")
    assert journal.log_trades(row, "60minute").first().horizon_bars == 10 and journal.log_trades(row, "60minute", -5).first().horizon_bars == 1
    kept = got.snapshot.asDict()
    assert list(kept) == list(journal.SNAPSHOT) and len(kept) == 23
    assert (kept["rsi"], kept["vol_flow_direction"], kept["vol_flow_agrees"], kept["sector"], kept["cmf"]) == (61.2, "Bearish", True, "IT", None)
    assert journal.log_trades(row.withColumn("direction", F.lit(None).cast("string")), "60minute").count() == 0


def test_risk_budget(spark):
    rows = [("A", "open", "2024-01-02 10:00:00"), ("B", "resolved", "2024-01-02 11:00:00"), ("C", "open", "2024-01-02 12:00:00"), ("D", "open", "2024-01-01 12:00:00")]
    j = spark.createDataFrame(rows, "symbol string, status string, t string").withColumn("logged_at", F.col("t").cast("timestamp_ntz"))
    m = spark.createDataFrame([("A", "IT"), ("B", "IT"), ("C", "BANK"), ("D", "BANK")], "symbol string, sector string")
    r = journal.risk_budget(j, m, F.lit("2024-01-02").cast("date"), Params(risk_pct=1.015, max_daily_risk_pct=3.0, max_positions=3)).first()
    assert (r.trades_today, r.committed_risk_pct, r.risk_budget_exceeded) == (3, 3.05, True) or r.committed_risk_pct == 3.04
    assert (r.open_positions, r.max_concurrent_positions, r.position_limit_exceeded, r.concentrated_sectors, r.account_capital, r.risk_per_trade_pct) == (3, 3, False, ["IT"], 100000.0, 1.015)
    none = journal.risk_budget(j.where("false"), m, F.lit("2024-01-02").cast("date"), Params()).first()
    assert (none.trades_today, none.concentrated_sectors, none.committed_risk_pct) == (0, [], 0.0)


def test_export_is_written_and_read_back(spark, tmp_path):
    b = frame(spark, [10, 11, 12, 13, 14])
    t = spark.sql("select 'x' id, 'A' symbol, '60minute' timeframe, 'Bullish' direction, 2 horizon_bars, 0.1D cost_pct, 0.05D slippage_pct, timestamp_ntz '2024-01-01 00:30:00' signal_time, timestamp_ntz '2024-01-01 09:00:00' logged_at")
    t = t.unionByName(t.withColumns({"id": F.lit("y"), "horizon_bars": F.lit(9), "logged_at": F.col("logged_at") + F.make_dt_interval(hours=F.lit(1))}))
    journal.export_csv(journal.forward_resolve(t, b), str(tmp_path / "csv"))
    got = {r.id: r for r in journal.read_csv(spark, str(tmp_path / "csv")).collect()}
    assert list(got["x"].asDict()) == list(journal.EXPORTED) and got["x"].outcome == "win" and got["y"].outcome is None and got["y"].return_pct is None
    assert got["x"].exit_time == dt.datetime(2024, 1, 1, 3) and got["y"].logged_at == dt.datetime(2024, 1, 1, 10)
    text = (tmp_path / "csv").glob("*.csv")
    lines = [line for f in sorted(text) for line in f.read_text().splitlines()]
    assert lines[0] == ",".join(journal.EXPORTED) and lines[1].startswith("y,")


def test_charts_have_candles_and_the_lines_only_without_an_error(spark, monkeypatch):
    b = frame(spark, walk(60, 2)).unionByName(frame(spark, walk(20, 3), "SHORT"))
    monkeypatch.setattr(Q, "bars", lambda s, d, tf: b)
    got = Q.chart_lines(spark, DATA).toPandas()
    assert set(got[got.symbol == "SHORT"].line) == {"open", "high", "low", "close"}
    assert set(got[got.symbol == "A"].line) == {"open", "high", "low", "close", "ema", "bb_mid", "rsi", "rsi_smooth", "macd", "macd_signal", "macd_hist", "vwap", "avwap"}


FETCHES = [
    ("2024-01-29 10:00:00", [("u1", "first", [("S1.NS", 0.5), ("s2.bo", -0.5)]), ("u2", "second", [("S1.NS", None), ("S1", 1.0), ("S3.US", 1.0)])]),
    ("2024-01-29 11:00:00", [("u3", "third", [("S2.NS", 0.1)]), ("u1", "first again", [("S2.NS", 0.2)])]),
]


def fetches(spark, rows=None):
    made = [(dt.datetime.fromisoformat(t), [(u, title, f"https://{u}", "src", "2024", ents) for u, title, ents in arts], None) for t, arts in (rows or FETCHES)]
    return spark.createDataFrame(made, news.FETCH)


def test_news_keeps_the_order_of_the_feed_and_the_latest_list(spark):
    f, scope = fetches(spark), spark.createDataFrame([(1, "S1"), (2, "S2"), (3, "S3")], "pos int, symbol string")
    flat = news.news_flatten(news.article_scan(f), scope)
    assert sorted((r.symbol, r.uuid, r.url, r.sentiment) for r in flat.collect() if r.sentiment is not None) == [("S1", "u1", "https://u1", 0.5), ("S2", "u1", "https://u1", -0.5), ("S2", "u1", "https://u1", 0.2), ("S2", "u3", "https://u3", 0.1)]
    assert flat.count() == 5  # neither a bare symbol nor another exchange's
    top = news.news_top(news.news_cache(news.lists_by_symbol(f)), 2)
    assert sorted((r.symbol, r["rank"], r.uuid, r.title) for r in top.collect()) == [("S1", 1, "u1", "first"), ("S1", 2, "u2", "second"), ("S2", 1, "u3", "third"), ("S2", 2, "u1", "first again")]
    assert {r.uuid: r.symbol for r in news.news_dedupe(flat, scope).collect()} == {"u1": "S1", "u2": "S1", "u3": "S2"}
    rows = spark.sql("select 'S1' symbol, string(null) error, true signal_confirmed union all select 'S2', null, false union all select 'S3', 'no', true")
    assert [r.symbol for r in news.confirmed_scope(rows).collect()] == ["S1"]
    assert {r.symbol for r in news.news_flatten(news.article_scan(f), news.confirmed_scope(rows)).collect()} == {"S1"}
    assert {r.symbol: r.news for r in news.join_news(rows.select("symbol"), top).collect()} == {"S1": ["first", "second"], "S2": ["third", "first again"], "S3": None}


def test_json_lines_that_are_none_are_kept_apart(spark, tmp_path):
    fetches(spark).drop("bad").write.json(str(tmp_path / "in"))
    (tmp_path / "in" / "broken.json").write_text('{"data": [{"uuid"\nnot json at all\n{"fetched_at": "2024-01-29T12:00:00Z", "data": null}\n')
    got = news.read_fetches(spark, str(tmp_path / "in"))
    assert sorted(r.bad for r in news.bad_lines(got).collect()) == ["not json at all", '{"data": [{"uuid"']
    assert news.article_scan(got).count() == 4 and news.news_cache(news.lists_by_symbol(got)).count() == 2
