"""Bars and ticks as tables by date, so that a scan reads the dates of its window and a late tick rewrites the dates it touches.

Bars lie in folders by timeframe and date, ticks by date and by the batch that brought them.  Both are written with dynamic partition
overwrite: what is written replaces the folders that it has rows for and no others, so a batch that runs again after a failure
leaves what it left before.  Stored timeframes are those whose bars lie within a day; longer ones are resampled from them.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tapeworks.operators.bars import BAR, chunked_union, ticks_to_bars
from tapeworks.params import LOOKBACK_DAYS

STORED = ("3minute", "15minute", "60minute", "day")
_BARS = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume long, timeframe string, date date"
_TICKS = "symbol string, event_id long, ts timestamp_ntz, price double, qty long, date date, batch long"


def _replace(df: DataFrame, path: str, parts: list[str], files: int) -> None:
    """Writes df over the partitions that it has rows for, each in ``files`` files."""
    spread = F.pmod(F.xxhash64("symbol"), F.lit(files))
    out = df.repartition(*parts, spread).sortWithinPartitions("symbol", "ts")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def write_bars(bars: DataFrame, path: str, files: int = 1) -> None:
    """Bars into the store; the dates of a timeframe that occur among them are replaced whole."""
    _replace(bars.select(*BAR).withColumn("date", F.to_date("ts")), path, ["timeframe", "date"], files)


def _between(bars: DataFrame, timeframe: str, start: dt.datetime | None, end: dt.datetime | None) -> DataFrame:
    df = bars.where(F.col("timeframe") == timeframe)
    if start:
        df = df.where((F.col("date") >= F.lit(start.date())) & (F.col("ts") >= F.lit(start).cast("timestamp_ntz")))
    if end:
        df = df.where((F.col("date") <= F.lit(end.date())) & (F.col("ts") <= F.lit(end).cast("timestamp_ntz")))
    return df.select(*BAR)


def read_bars(spark: SparkSession, path: str, timeframe: str, start: dt.datetime | None = None, end: dt.datetime | None = None) -> DataFrame:
    """Bars of a timeframe from start to end, both included; folders of other timeframes and dates aren't read."""
    return _between(spark.read.schema(_BARS).parquet(path), timeframe, start, end)


def scan_store(spark: SparkSession, path: str, watchlist: DataFrame, asof: dt.datetime, timeframe: str) -> DataFrame:
    """Bars of the watchlist within the timeframe's lookback before asof."""
    start = asof - dt.timedelta(days=LOOKBACK_DAYS.get(timeframe, 30))
    return read_bars(spark, path, timeframe, start, asof).join(watchlist.select("symbol").distinct(), "symbol", "left_semi")


def date_slices(spark: SparkSession, path: str, timeframe: str, start: dt.datetime, end: dt.datetime, days: int) -> list[DataFrame]:
    """Bars from start to end in slices of so many days, each sharing its last day with the next; a slice reads its own dates."""
    if days < 1:
        raise ValueError("days: at least 1")
    bars = spark.read.schema(_BARS).parquet(path)  # lists the store's files once for all slices
    out, at = [], start
    while True:
        to = min(end, at + dt.timedelta(days=days))
        out.append(_between(bars, timeframe, at, to))
        if to >= end:
            return out
        at = dt.datetime.combine(to.date(), dt.time())


def history(spark: SparkSession, path: str, timeframe: str, start: dt.datetime | None = None, end: dt.datetime | None = None, days: int = 60) -> DataFrame:
    """The slices as one history, each bar once; without a start or an end it goes from the first or to the last bar in the store."""
    if start is None or end is None:
        own = read_bars(spark, path, timeframe, start, end)
        ends = own.agg(F.min("ts").alias("first"), F.max("ts").alias("last")).first()
        if ends.first is None:
            return own
        start, end = start or ends.first, end or ends.last
    return chunked_union(date_slices(spark, path, timeframe, start, end, days))


def write_ticks(ticks: DataFrame, path: str, batch: int, files: int = 1) -> None:
    own = ticks.select("symbol", "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "price", "qty")
    _replace(own.withColumn("date", F.to_date("ts")).withColumn("batch", F.lit(batch).cast("long")), path, ["date", "batch"], files)


def read_ticks(spark: SparkSession, path: str, dates: Iterable[dt.date]) -> DataFrame:
    """The ticks of some dates; of an event that came more than once, the last to come."""
    df = spark.read.schema(_TICKS).parquet(path).where(F.col("date").isin(*dates))
    w = Window.partitionBy("date", "symbol", "event_id").orderBy(F.col("batch").desc(), F.col("ts").desc())
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "date", "batch")


def upsert(ticks: DataFrame, batch: int, tick_path: str, bar_path: str, timeframes: tuple[str, ...], files: int = 1) -> list[dt.date]:
    """Adds ticks, however late, and rebuilds the bars of the dates that they touch; returns these."""
    if not set(timeframes) <= set(STORED):
        raise ValueError(f"timeframes: of {STORED}")
    spark = ticks.sparkSession
    write_ticks(ticks, tick_path, batch, files)
    written = spark.read.schema(_TICKS).parquet(tick_path).where(F.col("batch") == batch)
    dates = sorted(r.date for r in written.select("date").distinct().collect())  # of one batch
    if dates:
        own = read_ticks(spark, tick_path, dates)
        bars = [ticks_to_bars(own, tf) for tf in timeframes]
        for more in bars[1:]:
            bars[0] = bars[0].unionByName(more)
        write_bars(bars[0], bar_path, files)
    return dates


def ingest(ticks: DataFrame, tick_path: str, bar_path: str, timeframes: tuple[str, ...], checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Streams ticks into the store.  There is no watermark: a tick that is later than any state would wait for still changes its bars."""

    def sink(batch: DataFrame, number: int) -> None:
        upsert(batch, number, tick_path, bar_path, timeframes)

    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return ticks.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(**trigger).start()
