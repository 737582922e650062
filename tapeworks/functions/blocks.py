"""Indicators over histories that are longer than one task should hold: a symbol's rows are split into blocks.

``numbered`` gives each row its number in its symbol's history without sorting the history: rows are counted by buckets of whole
days, a running sum over the buckets (a small table) gives each its first number, and a task sorts no more than a bucket.
Blocks are ``rows`` numbers long, whatever gaps time has, and a block is a partition of its own in every window.  Where row
frames reach back, a block also gets the last rows of the one before, its halo.

``ewm_blocks`` is a prefix scan: each block is reduced to what it adds to a mean and its first value; a small table, one row
a block, is scanned into the mean with which each block starts; and what that has left at each row is added back.  It is
exact for means of any length and for runs of equal prices, however long.

``indicator_series_blocks`` computes every indicator this way.  Sums over a session are made in the buckets, which hold whole
days; those since an anchor are sums by block, scanned and added back.  Means of means need the first ones whole, so two tables are
written between the passes instead of computing the passes before again.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.functions.columns import by_time, yes
from tapeworks.functions.ewm import ewm
from tapeworks.functions.indicators import (
    CMF_LENGTH, TREND_LOOKBACK, VOLUME_LENGTH, align_count, bollinger, candle_pattern, cmf, crossings, full_mean, lag, least_bars, means, session_vwap, typical, volumes,
)
from tapeworks.functions.tables import written
from tapeworks.params import Params

#: Rows of a block.
ROWS = 4096
#: About as many bars as a day has.
BARS_A_DAY = {"3minute": 480, "15minute": 96, "30minute": 48, "60minute": 24, "4hour": 6}


def numbered(bars: DataFrame, days: int) -> DataFrame:
    """bars with ``n`` (from 0, by time), ``n_bars`` of the symbol and ``bucket`` (``days`` days each)."""
    own = bars.withColumn("bucket", F.floor(F.unix_date(F.to_date("ts")) / days))
    counts = own.groupBy("symbol", "bucket").agg(F.count(F.lit(1)).alias("__rows"))
    before = Window.partitionBy("symbol").orderBy("bucket")
    counts = counts.select("symbol", "bucket", (F.sum("__rows").over(before) - F.col("__rows")).alias("__start"), F.sum("__rows").over(Window.partitionBy("symbol")).alias("n_bars"))
    place = F.row_number().over(Window.partitionBy("symbol", "bucket").orderBy("ts")) - 1
    return own.withColumn("__place", place).join(counts, ["symbol", "bucket"]).withColumn("n", F.col("__start") + F.col("__place")).drop("__start", "__place")


def split(df: DataFrame, rows: int, halo: int = 0) -> DataFrame:
    """df (with n and n_bars) by blocks: symbol becomes (name, block), and each block starts with the halo rows before it (``own`` is false)."""
    if not 0 <= halo <= rows:
        raise ValueError("a halo is at most one block")
    block = F.floor(F.col("n") / rows)
    twice = (F.col("n") % rows >= rows - halo) & ((block + 1) * rows < F.col("n_bars"))
    out = df.withColumn("__block", F.explode(F.when(twice, F.array(block, block + 1)).otherwise(F.array(block))))
    return out.withColumn("own", F.col("n") >= F.col("__block") * rows).withColumn("symbol", F.struct(F.col("symbol").alias("name"), F.col("__block").alias("block"))).drop("__block")


def ewm_blocks(df: DataFrame, specs: dict[str, tuple], rows: int, halo: int = 0) -> DataFrame:
    """As ewm, for df that ``split`` has made with a halo of one row more: name -> (column, a, least).  Nulls may only lead.

    The halo's first row, which only lends its values to the row after, is left out of the result.
    """
    specs = {k: s[:3] for k, s in specs.items()}
    start, last = F.col("symbol.block") * rows - halo, (F.col("symbol.block") + 1) * rows - halo - 1  # a block adds up to where the next one starts
    df = df.where(F.col("n") >= start)
    local = ewm(df, {f"__y_{k}": (c, a, 1) for k, (c, a, _) in specs.items()})
    reduced = []
    for k, (c, a, _) in specs.items():
        reduced.append(F.min(F.when(F.col(c).isNotNull(), F.struct("n", F.col(c).alias("x")))).alias(f"__f_{k}"))
        if a < 1:
            reduced.append(F.sum(F.when(F.col("n") <= last, a * F.col(c) * F.exp((last - F.col("n")) * math.log1p(-a)))).alias(f"__c_{k}"))
    t = local.groupBy("symbol").agg(*reduced)
    t = t.select("symbol.name", "symbol.block", "symbol", *(c for c in t.columns if c != "symbol"))
    own = Window.partitionBy("name").orderBy("block")
    t = t.withColumns({f"__g_{k}": F.min(f"__f_{k}").over(own) for k in specs})  # the symbol's first value, if it has come
    scanned = [F.col(f"__g_{k}.n").alias(f"__g_{k}") for k in specs] + [F.col(f"__f_{k}.x").alias(f"__x_{k}") for k in specs]
    for k, (_, a, _) in specs.items():
        if a < 1:
            d = -math.log1p(-a)
            first, at = F.col(f"__g_{k}"), F.col(f"__g_{k}.n")
            begins = yes((at == F.col(f"__f_{k}.n")) & (at <= last))
            added = F.coalesce(f"__c_{k}", F.lit(0.0)) + F.when(begins, (1 - a) * first["x"] * F.exp(-(last - at) * d)).otherwise(0.0)
            t = t.withColumn(f"__c_{k}", added)
            reach, left = math.ceil(745 / (rows * d)), math.exp(-rows * d)  # further back, a double is 0
            total = F.aggregate(F.collect_list(f"__c_{k}").over(own.rowsBetween(-reach, 0)), F.lit(0.0), lambda acc, x: acc * left + x)  # noqa: B023
            t = t.withColumn(f"__s_{k}", F.when(yes(at <= last), total))
            scanned.append(F.lag(f"__s_{k}").over(own).alias(f"__s_{k}"))
    out = local.join(t.select(F.struct("name", "block").alias("symbol"), *scanned), "symbol")
    result = {}
    for k, (c, a, least) in specs.items():
        value = F.col(c)
        if a < 1:
            value = F.col(f"__y_{k}") + F.coalesce((F.col(f"__s_{k}") - F.col(f"__x_{k}")) * F.exp((F.col("n") - start + 1) * math.log1p(-a)), F.lit(0.0))
        result[k] = F.when(F.col(c).isNotNull() & (F.col("n") - F.col(f"__g_{k}") + 1 >= least), value)
    return out.withColumns(result).drop(*(f"__{x}_{k}" for k in specs for x in "ysgx"))


def mean_of_blocks(bars: DataFrame, specs: dict[str, tuple], timeframe: str, rows: int = ROWS) -> DataFrame:
    """As ewm over bars, by blocks of rows."""
    days = max(1, rows // BARS_A_DAY.get(timeframe, 1))
    out = ewm_blocks(split(numbered(bars, days), rows), specs, rows)
    return out.withColumn("symbol", F.col("symbol.name")).drop("bucket", "n", "n_bars", "own")


def indicator_series_blocks(bars: DataFrame, p: Params = Params(), rows: int = ROWS) -> DataFrame:
    """As indicator_series, with as many tasks as there are blocks."""
    halo = max(p.bb_length, VOLUME_LENGTH, CMF_LENGTH, TREND_LOOKBACK + 1) + p.rsi_smooth + 2
    if rows <= halo:
        raise ValueError(f"rows: over {halo}")
    df = numbered(bars, max(1, rows // BARS_A_DAY.get(p.timeframe, 1)))
    df = session_vwap(df.withColumn("symbol", F.struct(F.col("symbol").alias("name"), "bucket")))  # a bucket holds whole days
    df = split(df.withColumn("symbol", F.col("symbol.name")).drop("bucket"), rows, halo + 1)
    df = df.withColumn("error", F.when(F.col("n_bars") < least_bars(p), "not enough candles"))
    df = written(means(df, p, lambda d, specs: written(ewm_blocks(d, specs, rows, halo))))
    df = df.withColumn("rsi_smooth", full_mean("rsi", p.rsi_smooth))
    df = cmf(volumes(bollinger(df, p.bb_length)))
    df = crossings(df, {"rsi": ("rsi", "rsi_smooth"), "macd": ("macd", "macd_signal"), "ema": ("ema", "bb_mid")})
    df = align_count(candle_pattern(df))
    bull = yes(F.col("align") >= 2)
    df = written(df.withColumn("__flip", bull != lag(bull)).where("own"))
    return _anchored(df).withColumn("symbol", F.col("symbol.name")).drop("own", "n", "__flip")


def _anchored(df: DataFrame) -> DataFrame:
    """df (own rows, with align and __flip) with anchor and avwap: by symbol, then sums by block, scanned."""
    found = df.groupBy(F.col("symbol.name").alias("__name")).agg(F.min(F.when(F.col("align").isNotNull(), F.col("ts"))).alias("__first"), F.max(F.when(F.col("__flip"), F.col("ts"))).alias("__last"))
    anchors = found.select("__name", F.when(F.col("__last") > F.col("__first"), F.col("__last")).otherwise(F.col("__first")).alias("anchor"))
    df = df.withColumn("__name", F.col("symbol.name")).join(anchors, "__name").drop("__name")
    on = yes(F.col("ts") >= F.col("anchor"))
    parts = {"__pv": F.when(on, typical() * F.col("volume")), "__v": F.when(on, F.col("volume"))}
    df = df.withColumns(parts)
    sums = df.groupBy("symbol").agg(F.sum("__pv").alias("__pv"), F.sum("__v").alias("__v"))
    before = Window.partitionBy("symbol.name").orderBy("symbol.block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("symbol", *(F.sum(c).over(before).alias(f"{c}0") for c in parts))
    df = df.join(sums, "symbol")
    total = {c: F.coalesce(f"{c}0", F.lit(0)) + F.sum(c).over(by_time()) for c in parts}
    return df.withColumn("avwap", F.when(on, total["__pv"] / F.nullif(total["__v"].cast("double"), F.lit(0.0)))).drop("__pv", "__v", "__pv0", "__v0")
