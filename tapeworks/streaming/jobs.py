"""The batch operators as Structured Streaming jobs.

Watermarks need zoned timestamps: sources cast the exchange-local times under a UTC session, sinks cast them back.
Sinks write each micro-batch to a folder of its own number, so a batch that runs again replaces what it wrote.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tapeworks.functions.tables import written
from tapeworks.operators import enrich, journal, news, scalp, signal
from tapeworks.params import Params
from tapeworks.sources import results
from tapeworks.streaming.oi_state import ROCKS, oi_state_stream

LATE = "10 minutes"


def tick_stream(spark: SparkSession, path: str, late: str = LATE, files_per_batch: int = 1) -> DataFrame:
    """Ticks from a folder (or file) of events, with a watermark on their time."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    folder, _, name = path.rstrip("/").rpartition("/")
    e = reader.option("pathGlobFilter", name).parquet(folder) if name.endswith(".parquet") else reader.parquet(path)
    return e.select(
        F.concat(F.lit("S"), (F.col("user_id") % 10).cast("string")).alias("symbol"),
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("value").alias("price"),
        (F.get_json_object("props", "$.k").cast("long") + 1).alias("qty"),
    ).withWatermark("ts", late)


def stream_bars(ticks: DataFrame, minutes: int) -> DataFrame:
    """Bars, the forming ones too (update mode); late ticks change a bar until the watermark passes it."""
    order = F.struct("ts", "event_id")
    out = ticks.groupBy("symbol", F.window("ts", f"{minutes} minutes")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("qty").alias("volume")
    )
    return out.select("symbol", F.lit(f"{minutes}minute").alias("timeframe"), F.col("window.start").cast("timestamp_ntz").alias("ts"), "open", "high", "low", "close", "volume")


def alert_stream(rows: DataFrame, late: str = LATE) -> DataFrame:
    """One alert for each symbol, timeframe, bar and fresh signal of a stream of signal rows (ts zoned).

    A key is remembered until the watermark has passed its bar by ``late``, so the state is bounded; rows that come later than that give no alert.
    """
    return news.deserving(rows).withWatermark("ts", late).dropDuplicatesWithinWatermark(["symbol", "timeframe", "ts", "fresh_signal"])


def news_stream(fetches: DataFrame, scope: DataFrame, late: str = "2 days") -> DataFrame:
    """New articles on the symbols in scope, each once: (symbol, fetched_at, uuid, title, ...) from a stream of fetches.

    An article's id is remembered for ``late`` after its fetch.  Of an article that names several symbols in scope, the first by the article's own order counts.
    """
    own = fetches.where("bad is null").withWatermark("fetched_at", late).select("fetched_at", F.explode("data").alias("a"))
    names = F.transform("a.entities", lambda e: F.struct(news.bare_symbol(e["symbol"]).alias("symbol"), e["sentiment_score"].alias("sentiment")))
    rows = own.select("fetched_at", *(f"a.{c}" for c in news.FIELDS), F.explode(names).alias("e")).select("fetched_at", *news.FIELDS, "e.symbol", "e.sentiment")
    return rows.where("uuid is not null").join(scope.select("symbol").distinct(), "symbol", "left_semi").dropDuplicatesWithinWatermark(["uuid"])


def news_cache_stream(fetches: DataFrame) -> DataFrame:
    """Each symbol's list of articles, replaced by that of its latest fetch (update mode); the state is one list for each symbol."""
    return news.news_cache(news.lists_by_symbol(fetches))


def write_batches(stream: DataFrame, folder: str, checkpoint: str, work: Callable[[DataFrame], DataFrame] = lambda df: df, interval: str | None = None) -> StreamingQuery:
    """Starts a query whose micro-batches, after work, go to numbered folders; without an interval it ends with its input."""

    def sink(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return _start(stream, sink, checkpoint, interval)


def latest(spark: SparkSession, folder: str, *keys: str) -> DataFrame:
    """The last version of each row that write_batches wrote."""
    rows = spark.read.parquet(folder)
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("__x")).select(*keys, "__x.*")


def stream_scan(trigger: DataFrame, scan: Callable[[], tuple[DataFrame, str]], folder: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Every micro-batch of the trigger scans anew and publishes the enriched rows as a version; scan gives the rows and the time of the scan.

    A batch that runs again publishes its version again; readers see the version before until its pointer is written.
    """

    def sink(_: DataFrame, number: int) -> None:
        rows, at = scan()
        results.publish(rows, folder, f"{at}-{number:06d}")
        results.compact(rows.sparkSession, folder)

    return _start(trigger, sink, checkpoint, interval)


def _start(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, interval: str | None, mode: str = "update") -> StreamingQuery:
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def frame_scan(bars: DataFrame, index_bars: DataFrame, watchlist: DataFrame, p: Params) -> DataFrame:
    """One timeframe's rows: the screener, then tier, index, volume flow and candle filters."""
    rows = enrich.index_filter(enrich.param_tier(signal.screener(bars, watchlist, p)), enrich.index_direction(index_bars, p), p)
    return enrich.candle_filter(enrich.volume_flow_filter(rows, p), p)


def stream_multi_timeframe(trigger: DataFrame, read_bars: Callable[[str], DataFrame], read_index: Callable[[str], DataFrame], watchlist: DataFrame, folder: str, checkpoint: str, intervals: dict[str, str | None]) -> list[StreamingQuery]:
    """A scan of its own for each timeframe, at an interval of its own; the queries run beside each other."""
    return [
        write_batches(trigger, f"{folder}/{tf}", f"{checkpoint}/{tf}", lambda _, tf=tf: frame_scan(read_bars(tf), read_index(tf), watchlist, Params(timeframe=tf)), every)
        for tf, every in intervals.items()
    ]


def stream_scalp(trigger: DataFrame, read_bars: Callable[[], DataFrame], folder: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Every micro-batch of the trigger reads the 3-minute bars anew and writes the engine's signal."""
    return write_batches(trigger, folder, checkpoint, lambda _: scalp.scalp_signal(read_bars()), interval)


def stream_oi_state(samples: DataFrame, folder: str, checkpoint: str, interval: str | None = None, pick: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """The state of each new sample, from the state that is kept for its symbol; what pick takes of it is written."""
    conf, name = samples.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name)
    conf.set(name, ROCKS)  # list state needs it; a query takes its settings when it starts
    try:
        return write_batches(oi_state_stream(samples), folder, checkpoint, pick, interval)
    finally:
        conf.set(name, before)


def oi_event_log(samples: DataFrame, folder: str, checkpoint: str, timeframe: str, interval: str | None = None) -> StreamingQuery:
    """An append-only log of the samples at which open interest has started to accelerate."""
    columns = ("close", "oi", "oi_chg_today", "accel", "accel_label", "break_signal")
    return stream_oi_state(samples, folder, checkpoint, interval, lambda state: state.where("accel_event").select("symbol", F.lit(timeframe).alias("timeframe"), "ts", *columns))


def open_trades(spark: SparkSession, folder: str, number: int | None = None) -> DataFrame | None:
    """The open trades as the batch before ``number`` (or the last one) left them; None before the first."""
    found = sorted(n for n in _batches_in(spark, f"{folder}/open") if number is None or n < number)
    return spark.read.parquet(f"{folder}/open/batch={found[-1]}") if found else None


def _batches_in(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the batches that a folder holds whole."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = [s.getPath() for s in fs.listStatus(path(folder))] if fs.exists(path(folder)) else []
    return [int(p.getName().removeprefix("batch=")) for p in there if fs.exists(path(p, "_SUCCESS"))]


def journal_resolve_stream(trades: DataFrame, read_bars: Callable[[dt.datetime], DataFrame], folder: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Every micro-batch adds the trades that it brings to the open ones and resolves those that have enough later bars.

    The journal is parted by status: a batch reads the open trades as the batch before left them and the bars from the oldest open signal on
    (read_bars takes that time), writes what it resolves to a folder of its own, and rewrites the open part alone.
    Resolved trades aren't read again, so a batch costs what is open, not what was ever logged.  Open versions older than the last two are dropped.
    """

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = open_trades(spark, folder, number)
        due = batch if before is None else before.select(*batch.columns).unionByName(batch)
        oldest = due.agg(F.min("signal_time").alias("t")).first().t
        if oldest is not None:
            done = written(journal.forward_resolve(due, read_bars(oldest)))
            done.where("status = 'resolved'").write.mode("overwrite").parquet(f"{folder}/resolved/batch={number}")
            due = done.where("status = 'open'")
        due.write.mode("overwrite").parquet(f"{folder}/open/batch={number}")
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for old in _batches_in(spark, f"{folder}/open"):
            if old < number - 1:
                at = path(f"{folder}/open/batch={old}")
                at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    return _start(trades, sink, checkpoint, interval)


def read_journal(spark: SparkSession, folder: str) -> DataFrame:
    """All trades: the resolved ones, and the open ones as the last batch left them."""
    now = open_trades(spark, folder)
    if not _batches_in(spark, f"{folder}/resolved"):
        return now
    done = spark.read.option("mergeSchema", True).parquet(f"{folder}/resolved").drop("batch")
    return done.unionByName(now, allowMissingColumns=True)
