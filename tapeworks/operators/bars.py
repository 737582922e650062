"""Bars: from ticks, resampled, cleaned, and looked up by window of time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.params import LOOKBACK_DAYS

BAR = ("symbol", "timeframe", "ts", "open", "high", "low", "close", "volume")
#: Bucket of each timeframe's higher timeframe.
HIGHER = {"15minute": "4hour", "60minute": "day", "4hour": "day"}


def bucket(ts: Column, timeframe: str) -> Column:
    """Label of a time's bucket: its start, or its Sunday for weeks.  Four-hour buckets are anchored at 09:15."""
    if timeframe == "4hour":
        return F.window(ts, "4 hours", "4 hours", "1 hour 15 minutes").start
    if timeframe == "day":
        return F.to_date(ts).cast("timestamp_ntz")
    if timeframe == "week":
        return F.date_add(F.trunc(F.to_date(ts), "week"), 6).cast("timestamp_ntz")
    return F.window(ts, timeframe.replace("minute", " minutes")).start


def ticks_to_bars(ticks: DataFrame, timeframe: str) -> DataFrame:
    """One bar for each symbol and bucket that has ticks; ties in time go by event_id."""
    order = F.struct("ts", "event_id")
    t = ticks.withColumn("bucket", bucket(F.col("ts"), timeframe))
    out = t.groupBy("symbol", "bucket").agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("qty").alias("volume")
    )
    return out.select("symbol", F.lit(timeframe).alias("timeframe"), F.col("bucket").alias("ts"), "open", "high", "low", "close", "volume")


def resample(bars: DataFrame, timeframe: str) -> DataFrame:
    """Bars of a longer timeframe; empty buckets give none, the forming one is kept."""
    t = bars.withColumn("bucket", bucket(F.col("ts"), timeframe))
    out = t.groupBy("symbol", "bucket").agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume")
    )
    return out.select("symbol", F.lit(timeframe).alias("timeframe"), F.col("bucket").alias("ts"), "open", "high", "low", "close", "volume")


def dedupe_bars(bars: DataFrame, arrival: str = "arrival") -> DataFrame:
    """The last to arrive of each symbol and time, without bars that lack a price."""
    w = Window.partitionBy("symbol", "timeframe", "ts").orderBy(F.col(arrival).desc())
    return bars.dropna(subset=["open", "high", "low", "close"]).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", arrival)


def chunked_union(chunks: list[DataFrame]) -> DataFrame:
    """History that comes in overlapping slices of time, later slices winning."""
    parts = [c.withColumn("arrival", F.lit(i)) for i, c in enumerate(chunks)]
    while len(parts) > 1:  # by twos, so that a long history's plan isn't deep
        parts = [parts[i].unionByName(parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return dedupe_bars(parts[0])


def candle_scan(bars: DataFrame, watchlist: DataFrame, asof: Column, timeframe: str) -> DataFrame:
    """Bars of the watchlist within the timeframe's lookback before asof."""
    start = asof - F.make_dt_interval(days=F.lit(LOOKBACK_DAYS.get(timeframe, 30)))
    own = bars.where((F.col("ts") >= start) & (F.col("ts") <= asof))
    return own.join(watchlist.select("symbol").distinct(), "symbol", "left_semi")


def index_bars(ticks: DataFrame, timeframe: str, name: Column) -> DataFrame:
    """Bars of an index over the ticks that it names (null: none)."""
    return ticks_to_bars(ticks.withColumn("symbol", name).where("symbol is not null"), timeframe)
