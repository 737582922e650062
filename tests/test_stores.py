"""The store of bars, late ticks, published results, and streams after restarts and with late rows."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeworks.operators import bars as B
from tapeworks.operators import journal, news, oi
from tapeworks.params import Params
from tapeworks.plans import queries as market
from tapeworks.sources import results, store
from tapeworks.sources.market import oi_samples, ticks, watchlist
from tapeworks.streaming import jobs
from tests.conftest import DATA
from tests.test_market import frame, walk
from tests.test_rules import fetches

DAY = dt.datetime(2024, 1, 20, 12)


@pytest.fixture(scope="module")
def bar_store(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("bars"))
    for tf in ("15minute", "60minute"):
        store.write_bars(B.ticks_to_bars(ticks(spark, DATA), tf), folder)
    return folder


def test_a_scan_reads_the_dates_of_its_window(spark, bar_store):
    whole = B.ticks_to_bars(ticks(spark, DATA), "15minute")
    got = store.scan_store(spark, bar_store, watchlist(spark, DATA), DAY, "15minute")
    want = B.candle_scan(whole, watchlist(spark, DATA), F.lit(DAY).cast("timestamp_ntz"), "15minute")
    assert got.count() == want.count() > 100 and got.exceptAll(want.select(got.columns)).count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert "timeframe#" in filters and "date#" in filters
    for days in (2, 5, 10):
        df = store.read_bars(spark, bar_store, "15minute", DAY - dt.timedelta(days=days), DAY)
        folders = {f.split("timeframe=")[1].rpartition("/")[0] for f in _files_read(df)}
        assert len(folders) <= days + 1 and all(f.startswith("15minute/") for f in folders)


def _files_read(df):
    """The files that the plan's scans list once partitions are pruned."""
    scan = df._jdf.queryExecution().executedPlan()
    while scan.children().nonEmpty():
        scan = scan.children().head()
    found = scan.selectedPartitions().toString() if hasattr(scan, "selectedPartitions") else ""
    return [p.split("file:")[1] for p in found.replace(",", " ").split() if "file:" in p and ".parquet" in p]


def test_slices_are_one_history(spark, bar_store):
    start, end = dt.datetime(2024, 1, 3, 9), dt.datetime(2024, 1, 28, 18)
    slices = store.date_slices(spark, bar_store, "60minute", start, end, 4)
    assert len(slices) == 7
    want = store.read_bars(spark, bar_store, "60minute", start, end)
    for days in (1, 4, 60):
        got = store.history(spark, bar_store, "60minute", start, end, days)
        assert got.count() == want.count() and got.select(want.columns).exceptAll(want).count() == 0
    with pytest.raises(ValueError):
        store.date_slices(spark, bar_store, "60minute", start, end, 0)


def test_a_history_without_ends_is_the_whole_store(spark, bar_store, tmp_path):
    whole = store.read_bars(spark, bar_store, "60minute")
    for days in (1, 7, 60):
        got = store.history(spark, bar_store, "60minute", days=days)
        assert got.count() == whole.count() and got.select(whole.columns).exceptAll(whole).count() == 0
    for ends in ({"start": DAY}, {"end": DAY}):
        got, want = store.history(spark, bar_store, "60minute", **ends, days=4), store.read_bars(spark, bar_store, "60minute", **ends)
        assert got.count() == want.count() > 0 and got.select(want.columns).exceptAll(want).count() == 0
    store.write_bars(whole.where("false"), str(tmp_path / "none"))
    assert store.history(spark, str(tmp_path / "none"), "60minute").count() == 0
    queries = market.registered()
    got, want = queries["chunked_union"](spark, DATA), queries["ticks_to_bars"](spark, DATA)
    assert got.count() == want.count() and got.exceptAll(want.select(got.columns)).count() == 0


def test_late_ticks_change_their_bars_and_no_other_dates(spark, tmp_path):
    t = ticks(spark, DATA).drop("sgn")
    late = (F.col("event_id") % 20 == 3) & (F.to_date("ts") < F.lit("2024-01-05"))
    path = {k: str(tmp_path / k) for k in ("in", "ticks", "bars", "state")}
    stream = lambda: spark.readStream.schema(t.schema).parquet(path["in"])
    run = lambda: store.ingest(stream(), path["ticks"], path["bars"], ("60minute", "day"), path["state"]).awaitTermination()
    t.where(~late).write.parquet(path["in"])
    run()
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "bars").rglob("*.parquet")}
    same = lambda a, b: a.count() == b.count() and a.exceptAll(b.select(a.columns)).count() == 0
    assert same(store.read_bars(spark, path["bars"], "60minute"), B.ticks_to_bars(t.where(~late), "60minute"))
    t.where(late).write.mode("append").parquet(path["in"])
    run()  # a month behind the newest tick
    for tf in ("60minute", "day"):
        assert same(store.read_bars(spark, path["bars"], tf), B.ticks_to_bars(t, tf))
    untouched = {f for f in before if f.exists() and f.stat().st_mtime_ns == before[f]}
    assert untouched and all(f.parent.name >= "date=2024-01-05" for f in untouched)
    assert {f.parent.name for f in before} - {f.parent.name for f in untouched} <= {f"date=2024-01-0{i}" for i in range(1, 5)}
    bars = jobs.stream_bars(jobs.tick_stream(spark, f"{DATA}/events.parquet"), 60)
    assert bars.isStreaming  # whose watermark would have dropped them


def test_a_batch_that_runs_again_and_an_event_that_comes_again(spark, tmp_path):
    t = ticks(spark, DATA).drop("sgn").where("event_id < 200")
    path = [str(tmp_path / k) for k in ("ticks", "bars")]
    for number in (0, 0, 1):
        dates = store.upsert(t, number, *path, ("60minute",))
    assert dates == sorted(r.d for r in t.select(F.to_date("ts").alias("d")).distinct().collect())
    want = B.ticks_to_bars(t, "60minute")
    got = store.read_bars(spark, path[1], "60minute")
    assert got.count() == want.count() and got.exceptAll(want.select(got.columns)).count() == 0
    store.upsert(t.where("event_id = 7").withColumn("price", F.lit(1e6)), 2, *path, ("60minute",))
    assert store.read_bars(spark, path[1], "60minute").agg(F.max("high")).first()[0] == 1e6
    assert store.upsert(t.where("false"), 3, *path, ("60minute",)) == []
    with pytest.raises(ValueError):
        store.upsert(t, 4, *path, ("week",))


def test_no_reader_sees_half_a_scan(spark, tmp_path):
    folder, rows = str(tmp_path / "scans"), spark.range(5)
    with pytest.raises(LookupError):
        results.published(spark, folder)
    results.publish(rows, folder, "2024-01-29T1000")
    results.write_rows(spark.range(2), folder, "2024-01-29T1003")  # and the writer dies
    seen = results.published(spark, folder)
    assert seen.count() == 5 and seen.first().scan == "2024-01-29T1000"
    results.publish(spark.range(7), folder, "2024-01-30T0915")
    assert results.published(spark, folder).count() == 7 and results.versions(spark, folder) == ["2024-01-29T1000", "2024-01-30T0915"]
    assert results.compact(spark, folder, 1) == ["2024-01-29T1000", "2024-01-29T1003"]
    assert results.versions(spark, folder) == ["2024-01-30T0915"] and results.published(spark, folder).count() == 7
    results.publish(spark.range(3), folder, "2024-01-30T0915")  # again
    assert results.published(spark, folder).count() == 3


def test_oi_state_goes_on_after_a_restart_and_stays_small(spark, tmp_path):
    own = oi_samples(spark, DATA).cache()
    edge = own.agg(F.percentile_approx(F.unix_seconds(F.col("ts").cast("timestamp")), 0.5)).first()[0]
    late = F.unix_seconds(F.col("ts").cast("timestamp")) > edge
    path = {k: str(tmp_path / k) for k in ("in", "out", "state")}
    for part in (~late, late):
        own.where(part).write.mode("append").parquet(path["in"])
        jobs.stream_oi_state(spark.readStream.schema(own.schema).parquet(path["in"]), path["out"], path["state"]).awaitTermination()
    cols = ["symbol", "ts", "accel_label", "structure", "stage", "break_signal", "accel_event", "chg_15", "chg_30", "chg_60", "oi_day_chg"]
    got, want = spark.read.parquet(path["out"]), oi.oi_state(own).select(cols)
    rounded = lambda df: df.select(*(F.round(c, 9).alias(c) if c.startswith(("chg", "oi_")) else F.col(c) for c in cols))
    assert got.count() == want.count() and rounded(got).exceptAll(rounded(want)).count() == 0
    assert got.agg(F.max("kept")).first()[0] <= 51  # a reading each 3 minutes of 150
    first = got.orderBy("ts").first()
    spark.createDataFrame([(first.symbol, first.ts - dt.timedelta(days=1), 5.0, 5.0)], own.schema).write.mode("append").parquet(path["in"])
    jobs.stream_oi_state(spark.readStream.schema(own.schema).parquet(path["in"]), path["out"], path["state"]).awaitTermination()
    more = spark.read.parquet(path["out"])
    row = more.where(F.col("ts") == F.lit(first.ts - dt.timedelta(days=1))).first()
    assert more.count() == own.count() + 1 and row.structure is None and row.accel_label is None and not row.accel_event


def test_alerts_once_across_restarts_and_none_for_late_bars(spark, tmp_path):
    schema = "symbol string, timeframe string, ts timestamp, fresh_signal string, vol_confirmed boolean, htf_agrees boolean"
    path = {k: str(tmp_path / k) for k in ("in", "out", "state")}
    at = lambda h: dt.datetime(2024, 1, 2, h)
    row = lambda s, h, side="Bullish", ok=True: (s, "60minute", at(h), side, ok, True)
    parts = [
        [row("A", 10), row("A", 10), row("B", 10, None), row("C", 10, "Bullish", False)],
        [row("A", 10), row("A", 10, "Bearish"), row("A", 20)],
        [row("A", 20), row("D", 9), row("D", 21)],  # D's first comes when the watermark has passed it
    ]
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path["in"])
        stream = spark.readStream.schema(schema).parquet(path["in"])
        jobs.write_batches(jobs.alert_stream(stream, "2 hours"), path["out"], path["state"]).awaitTermination()
    got = sorted((r.symbol, r.ts.hour, r.fresh_signal) for r in spark.read.parquet(path["out"]).collect())
    assert got == [("A", 10, "Bearish"), ("A", 10, "Bullish"), ("A", 20, "Bullish"), ("D", 21, "Bullish")]


def test_news_streams(spark, tmp_path):
    """New articles once across restarts, none that are late; and each symbol's list replaced by that of its latest fetch."""
    parts = [
        [("2024-01-29 10:00:00", [("u1", "first", [("S1.NS", 0.5)]), (None, "no id", [("S1.NS", 0.5)])])],
        [("2024-01-29 11:00:00", [("u1", "first", [("S1.NS", 0.5)]), ("u2", "second", [("S2.BO", 0.5), ("S9.NS", 0.1)])])],
        [("2024-02-05 11:00:00", [("u3", "third", [("S1.NS", 0.5)])])],
        [("2024-01-20 09:00:00", [("u4", "late", [("S1.NS", 0.5)])])],
    ]
    scope = spark.createDataFrame([("S1",), ("S2",)], "symbol string")
    for rows in parts:
        fetches(spark, rows).drop("bad").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        for name, work in (("new", lambda f: jobs.news_stream(f, scope)), ("cache", jobs.news_cache_stream)):
            stream = news.read_fetches(spark, str(tmp_path / "in"), stream=True)
            jobs.write_batches(work(stream), str(tmp_path / name), str(tmp_path / f"{name}-state")).awaitTermination()
    assert sorted((r.uuid, r.symbol) for r in spark.read.parquet(str(tmp_path / "new")).collect()) == [("u1", "S1"), ("u2", "S2"), ("u3", "S1")]
    cache = jobs.latest(spark, str(tmp_path / "cache"), "symbol")
    assert {r.symbol: [a.uuid for a in r.articles] for r in cache.collect()} == {"S1": ["u3"], "S2": ["u2"], "S9": ["u2"]}


def test_resolving_costs_what_is_open(spark, tmp_path):
    """Trades come in batches; a batch reads the trades that are open and the bars since the oldest of them."""
    bars = frame(spark, walk(400, 5))
    store.write_bars(bars, str(tmp_path / "bars"))
    times = [r.ts for r in bars.orderBy("ts").select("ts").collect()]
    schema = "id string, symbol string, timeframe string, direction string, aligned int, horizon_bars int, cost_pct double, slippage_pct double, signal_time timestamp_ntz, status string"
    trades = [(f"t{i}", "A", "60minute", "Bullish", 3, 5, 0.0, 0.0, times[i], "open") for i in range(0, 399, 3)]
    until, due, reads = {}, [], []
    for batch, end in enumerate((150, 300, 400)):
        now = [t for t in trades if end - 150 < times.index(t[8]) + 1 <= end and (batch == 0 or times.index(t[8]) >= (150, 300)[batch - 1])]
        spark.createDataFrame(now, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

        def read(since, end=end):
            own = store.read_bars(spark, str(tmp_path / "bars"), "60minute", since, times[end - 1])
            reads.append((since, own.count()))
            return own

        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        jobs.journal_resolve_stream(stream, read, str(tmp_path / "journal"), str(tmp_path / "state")).awaitTermination()
        due.append(jobs.open_trades(spark, str(tmp_path / "journal")).count())
    got = {r.id: r for r in jobs.read_journal(spark, str(tmp_path / "journal")).collect()}
    want = {r.id: r for r in journal.forward_resolve(spark.createDataFrame(trades, schema), bars).collect()}
    assert len(got) == len(want) == len(trades) and all((got[i].return_pct, got[i].mae, got[i].status) == (want[i].return_pct, want[i].mae, want[i].status) for i in want)
    assert max(due) <= 3 and [n for _, n in reads] == sorted((n for _, n in reads), reverse=True) or max(n for _, n in reads[1:]) < 170
    assert len(list((tmp_path / "journal" / "open").iterdir())) <= 2
    assert until == {}


def test_three_timeframes_side_by_side(spark, tmp_path):
    """Each timeframe has a query of its own; one with an interval goes on while another has ended."""
    spark.range(1).write.parquet(str(tmp_path / "in"))
    trigger = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    watch = spark.createDataFrame([(0, "A"), (1, "NONE")], "pos int, symbol string")
    own = lambda tf: frame(spark, walk(60, 4), minutes={"15minute": 15, "60minute": 60, "4hour": 240}[tf]).withColumn("timeframe", F.lit(tf))
    running = jobs.stream_multi_timeframe(trigger, own, own, watch, str(tmp_path / "out"), str(tmp_path / "state"), {"15minute": None, "60minute": "1 second", "4hour": None})
    assert len({q.id for q in running}) == 3
    for q in (running[0], running[2]):
        q.awaitTermination()
    running[1].processAllAvailable()
    assert running[1].isActive
    running[1].stop()
    for tf in ("15minute", "60minute", "4hour"):
        rows = {r.symbol: r for r in jobs.latest(spark, str(tmp_path / "out" / tf), "symbol").collect()}
        assert rows["A"].error is None and rows["A"].direction and rows["NONE"].error == "symbol not found"


def test_scans_are_published_by_a_stream(spark, tmp_path):
    folder = str(tmp_path / "out")
    for i in range(3):
        spark.range(i, i + 1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
        jobs.stream_scan(stream, lambda i=i: (spark.range(i + 1), "2024-01-29T1000"), folder, str(tmp_path / "state")).awaitTermination()
        assert results.published(spark, folder).count() == i + 1
    assert len(results.versions(spark, folder)) == 2  # older ones are compacted


def test_json_fixture_is_one_line_a_fetch(spark, tmp_path):
    fetches(spark).drop("bad").coalesce(1).write.json(str(tmp_path / "in"))
    lines = [json.loads(x) for f in (tmp_path / "in").glob("*.json") for x in f.read_text().splitlines()]
    assert len(lines) == 2 and lines[0]["data"][0]["entities"][0]["symbol"] == "S1.NS"
    assert np.isclose(Params().rel_volume, 1.2)
