"""Operators against pandas, DuckDB and their own invariants."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeworks.functions.ewm import ewm
from tapeworks.functions.indicators import candle_pattern, indicator_series
from tapeworks.operators import bars as B
from tapeworks.operators import enrich, journal, oi, replay, signal
from tapeworks.params import Params
from tapeworks.plans.queries import oracles, registered
from tapeworks.streaming import jobs
from tests.conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLED = ("ticks_to_bars", "resample_week", "indicator_series", "screener", "trades", "asof_htf", "backtest_summary", "param_weights", "oi_stage", "forward_resolve", "near_month_contract", "scalp_signal", "stream_bars", "join_index_direction", "confidence_by_factor", "param_win_rates", "result_sink")


def frame(spark, closes, symbol="A", minutes=60, volume=100):
    ts = pd.date_range("2024-01-01", periods=len(closes), freq=f"{minutes}min")
    c = np.array(closes, dtype=float)
    pdf = pd.DataFrame({"symbol": symbol, "timeframe": f"{minutes}minute", "ts": ts, "open": c, "high": c + 1, "low": c - 1, "close": c, "volume": volume})
    return spark.createDataFrame(pdf, "symbol string, timeframe string, ts timestamp_ntz, open double, high double, low double, close double, volume long")


def walk(n, seed=0):
    return 100 + np.cumsum(np.random.default_rng(seed).normal(size=n))


def rows(df):
    out = df[sorted(df.columns)].copy()
    for c in out.columns:
        out[c] = ["~" if pd.isna(v) else f"{float(v):.4f}" if isinstance(v, (int, float, np.number)) and not isinstance(v, (bool, np.bool_)) else str(v) for v in out[c]]
    return sorted(map(tuple, out.values))


@pytest.mark.parametrize("name", ORACLED)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    assert rows(registered()[name](spark, DATA).toPandas()) == rows(con.execute(oracles()[name]).df())


def test_every_query_has_a_name_of_its_own():
    assert len(registered()) > 80 and set(oracles()) <= set(registered())


@pytest.mark.parametrize("a", [1 / 9, 1 / 14, 0.2, 0.5, 2 / 3, 1.0])
def test_ewm_equals_pandas(spark, a):
    x = walk(3000)
    got = ewm(frame(spark, x), {"y": ("close", a, 5)}).orderBy("ts").toPandas()["y"]
    want = pd.Series(x).ewm(alpha=a, adjust=False, min_periods=5).mean()
    assert got.isna().tolist() == want.isna().tolist() and np.nanmax(np.abs(got - want)) < 1e-9


def test_too_few_bars_and_flat_prices(spark):
    df = frame(spark, walk(36), "short").unionByName(frame(spark, walk(37), "enough")).unionByName(frame(spark, [5.0] * 60, "flat", volume=0))
    last = {r.symbol: r for r in signal.latest_bar(indicator_series(df)).collect()}
    assert last["short"].error and not last["enough"].error
    assert last["flat"].rsi is None and last["flat"].rel_volume is None and last["flat"].cmf is None and last["flat"].align is None
    assert not (last["flat"].rsi_up or last["flat"].ema_up)


def test_no_look_ahead_and_symbols_apart(spark):
    x = walk(300, 3)
    cols = ["rsi", "macd_signal", "adx", "cmf", "align", "candle_direction"]
    whole = indicator_series(frame(spark, x).unionByName(frame(spark, walk(300, 4), "B"))).where("symbol = 'A'").orderBy("ts").toPandas()[cols].iloc[199]
    part = indicator_series(frame(spark, x[:200])).orderBy("ts").toPandas()[cols].iloc[199]
    for c in cols:
        assert (pd.isna(whole[c]) and pd.isna(part[c])) or whole[c] == part[c] or abs(whole[c] - part[c]) < 1e-9


def test_candles(spark):
    base = [(10 - i, 10.1 - i, 8.9 - i, 9 - i) for i in range(7)]
    shapes = {"Hammer": (3.0, 3.12, 2.0, 3.1), "Bullish Engulfing": (2.5, 4.6, 2.4, 4.5)}
    for name, last in shapes.items():
        pdf = pd.DataFrame([*base, last], columns=["open", "high", "low", "close"])
        pdf["ts"] = pd.date_range("2024-01-01", periods=len(pdf), freq="h")
        pdf["symbol"] = "A"
        got = candle_pattern(spark.createDataFrame(pdf)).orderBy(F.col("ts").desc()).first()
        assert (got.candle_pattern, got.candle_direction) == (name, "Bullish")


def test_params_are_checked():
    for bad in ({"timeframe": "2hour"}, {"min_required": 5}, {"adx_length": 1}, {"breadth_pct": 100.0}, {"risk_pct": 0.0}):
        with pytest.raises(ValueError):
            Params(**bad)


def test_asof_keeps_null_values(spark):
    left = spark.sql("select 'A' symbol, timestamp_ntz '2024-01-01 10:00:00' ts union all select 'A', timestamp_ntz '2024-01-01 09:00:00'")
    right = spark.sql("select 'A' symbol, timestamp_ntz '2024-01-01 08:00:00' ts, 1 v union all select 'A', timestamp_ntz '2024-01-01 10:00:00', null")
    assert [r.v for r in replay.asof_join(left, right, "v").orderBy("ts").collect()] == [1, None]


def test_oi_lookback_at_its_borders(spark):
    rows = [("A", f"2024-01-01 {h:02d}:{m:02d}:00", float(v)) for h, m, v in ((9, 0, 1), (9, 30, 2), (11, 29, 3), (11, 30, 4))]
    df = spark.createDataFrame(rows, "symbol string, t string, oi double").selectExpr("symbol", "cast(t as timestamp_ntz) ts", "oi", "1D close")
    last = oi.asof_lookback(df).orderBy(F.col("ts").desc()).first()
    assert (last.oi_15, last.oi_120) == (2.0, 2.0)


def test_open_trades_and_costs(spark):
    bars = frame(spark, [10, 11, 12, 13, 14])
    t = spark.sql("select 'x' id, 'A' symbol, '60minute' timeframe, 'Bullish' direction, 2 horizon_bars, 0.1D cost_pct, 0.05D slippage_pct, timestamp_ntz '2024-01-01 00:30:00' signal_time")
    t = t.unionByName(t.withColumns({"id": F.lit("y"), "horizon_bars": F.lit(9)}))
    got = {r.id: r for r in journal.forward_resolve(t, bars).collect()}
    assert got["x"].return_pct == round((13 - 11) / 11 * 100 - 0.2, 3) and got["x"].status == "resolved" and got["y"].status == "open"


def test_gates_only_take_away(spark):
    p = Params(timeframe="15minute")
    b = frame(spark, walk(400, 7), minutes=15)
    free = replay.nofm_signal(indicator_series(b, p), ("rsi_cross", "macd_cross"), 1, p, "15minute")
    held = replay.nofm_signal(indicator_series(b, p), ("rsi_cross", "macd_cross"), 1, p, "15minute", gates=("opening", "flow", "candle"))
    on = lambda df: {r.ts for r in df.where("has_signal").select("ts").collect()}
    assert on(held) <= on(free)


def test_stream_in_batches_equals_batch(spark, tmp_path):
    e = spark.read.parquet(f"{DATA}/events.parquet").orderBy("ts").withColumn("part", F.ntile(3).over(__import__("pyspark").sql.Window.orderBy("ts")))
    for i in (1, 2, 3):
        e.where(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    jobs.write_batches(jobs.stream_bars(jobs.tick_stream(spark, str(tmp_path / "in"), late="60 days"), 60), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = jobs.latest(spark, str(tmp_path / "out"), "symbol", "timeframe", "ts")
    from tapeworks.sources.market import ticks

    want = B.ticks_to_bars(ticks(spark, DATA), "60minute")
    assert got.select(want.columns).exceptAll(want).count() == 0 and got.count() == want.count()


# rules by hand-computed rows


def test_index_and_sectors_lean_by_votes_not_by_the_last_change(spark):
    up = 50 + 0.02 * np.arange(80) ** 2 + 0.3 * (np.arange(80) % 2)
    up[-1] = up[-2] - 0.1  # rises ever faster, and falls in the last bar
    bars = frame(spark, up, "IDX").unionByName(frame(spark, 300 - up, "DOWN")).unionByName(frame(spark, walk(20), "SHORT"))
    p = Params()
    assert enrich.index_direction(bars.where("symbol = 'IDX'"), p).first().index_direction == "Bullish"
    assert enrich.index_direction(bars.where("symbol = 'SHORT'"), p).first().index_direction is None
    m = spark.createDataFrame([("A", "IDX"), ("B", "DOWN"), ("C", "SHORT"), ("D", "OTHER")], "symbol string, sector string")
    got = {r.sector: r.sector_direction for r in enrich.sector_directions(bars, m.where("symbol <> 'D'").select("symbol"), m, p).collect()}
    assert got == {"IDX": "Bullish", "DOWN": "Bearish", "SHORT": None}


def test_positional_needs_the_index_only_if_required(spark):
    rows = spark.sql("select 'Bullish' direction, 3 aligned, 'Long Buildup' structure, false in_opening_window, false index_agrees")
    assert enrich.positional_qualified(rows, Params()).first().positional_qualified
    assert not enrich.positional_qualified(rows, Params(require_index=True)).first().positional_qualified


def test_higher_timeframe_takes_its_own_spans(spark):
    assert Params(timeframe="15minute").macd_spans() == (3, 8, 9)
    b = frame(spark, walk(2600, 5), minutes=15)
    from dataclasses import replace as with_

    four = B.resample(b, "4hour")
    p = Params(timeframe="15minute")
    want = {r.ts: r.align for r in indicator_series(four, with_(p, timeframe="4hour")).select("ts", "align").collect()}
    times = sorted(want)
    got = {r.bucket: r.htf_direction for r in replay.htf_buckets(b, "15minute", p).collect()}
    for before, now in zip(times, times[1:]):
        assert got[now] == (None if want[before] is None else "Bullish" if want[before] >= 2 else "Bearish")


def test_win_rates_have_one_place_and_weights_read_ten_bars(spark):
    t = spark.createDataFrame([("Bullish", True, {5: 1.0}), ("Bullish", True, {5: -1.0}), ("Bullish", True, {5: 2.0})], "direction string, vol_confirmed boolean, returns map<int,double>")
    assert {r.win_rate for r in replay.horizon_stats(t).collect()} == {66.7}
    b = frame(spark, walk(300, 9))
    p = Params()
    series = indicator_series(b, p).where("error is null")
    trades = replay.trades(replay.nofm_signal(series, ("rsi_cross",), 1, p, "60minute"), p)
    r10 = [r.returns[10] for r in trades.collect() if 10 in r.returns]
    got = {r.param: r for r in replay.param_win_rates(b, "60minute", p).collect()}
    assert got["rsi_cross"].trades == len(r10) and got["rsi_cross"].win_rate == round(sum(x > 0 for x in r10) / len(r10) * 100, 1)


def test_first_and_turned_labels_are_events_and_stage_is_new_or_null(spark):
    def samples(values):
        times = pd.date_range("2024-01-02 10:00", periods=len(values), freq="30min")
        return spark.createDataFrame(pd.DataFrame({"symbol": "A", "ts": times, "oi": values, "close": np.linspace(100, 110, len(values))}), "symbol string, ts timestamp_ntz, oi double, close double")

    got = oi.oi_state(samples([100.0, 100.0, 103.0, 103.0, 103.0, 80.0])).orderBy("ts").collect()
    assert [r.accel_label for r in got] == [None, None, "Strong acceleration", "Possible exit/unwinding", "Stable", "Possible exit/unwinding"]
    assert [r.accel_event for r in got] == [False, False, True, False, False, False]
    assert [r.structure for r in got] == ["Neutral", "Neutral", "Long Buildup", "Long Buildup", "Long Buildup", "Short Covering"]
    assert [r.stage for r in got] == [None, None, "New", None, None, "New"]


def test_journal_returns_from_the_raw_close_and_averages_to_three_places(spark):
    b = frame(spark, [10.0, 30.0, 31.0, 31.12345, 33.0])
    t = spark.sql("select 'x' id, 'A' symbol, '60minute' timeframe, 'Bullish' direction, 2 horizon_bars, 0D cost_pct, 0D slippage_pct, timestamp_ntz '2024-01-01 00:00:00' signal_time")
    r = journal.forward_resolve(t, b).first()
    assert (r.entry_price, r.exit_price, r.return_pct, r.win) == (30.0, 31.12, round((31.12345 - 30) / 30 * 100, 3), True) and r.mae == round((29 - 30) / 30 * 100, 3)
    j = spark.createDataFrame([(1.0,), (2.0,), (2.0,)], "return_pct double").withColumns({"status": F.lit("resolved"), "direction": F.lit("Bullish"), "aligned": F.lit(3), **{f: F.lit(f == "htf_agrees") for f in journal.FACTORS}})
    assert journal.FACTORS == ("signal_confirmed", "sector_agrees", "breadth_agrees", "candle_agrees", "flow_agrees", "htf_agrees")
    assert {(r.factor, r.value, r.low_sample, r.avg_return) for r in journal.confidence_by_factor(j).collect()} == {(f, f == "htf_agrees", True, 1.667) for f in journal.FACTORS}
    assert journal.forward_resolve(t, b.where("false")).first().status == "open" and journal.forward_resolve(t.where("false"), b).count() == 0
    assert journal.export_rows(journal.forward_resolve(t.withColumn("logged_at", F.col("signal_time")), b)).columns == list(journal.EXPORTED)


def test_weights_are_stored_and_even_where_none_are(spark, tmp_path):
    assert replay.load_weights(spark, str(tmp_path / "none")).count() == 0
    for w in (0.1, 0.4):
        replay.store_weights(spark.createDataFrame([("rsi_cross", w)], "param string, weight double"), str(tmp_path / "w"))
    assert [tuple(r) for r in replay.load_weights(spark, str(tmp_path / "w")).collect()] == [("rsi_cross", 0.4)]
