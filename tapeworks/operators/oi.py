"""Open interest over time: lookbacks, acceleration, the day's baseline, structure and its changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.functions.columns import pct_change

KEPT_MINUTES, FLAT_PCT = 150, 0.05
#: Fixed values.
ACCELERATING = ("Strong acceleration", "Moderate acceleration")
LEAVING = "Possible exit/unwinding"


def asof_lookback(samples: DataFrame, minutes: tuple[int, ...] = (15, 30, 60, 120), span_minutes: int = 1440) -> DataFrame:
    """samples with oi_<n>: the last reading at or before n minutes ago, of the 150 minutes that are kept.

    A symbol's samples are parted into spans of time, so that a hot symbol has as many tasks as spans; a span also gets the samples of the
    150 minutes before it, which only lend their readings.
    """
    kept, span = KEPT_MINUTES * 60_000_000, max(span_minutes, KEPT_MINUTES) * 60_000_000
    us, own = F.col("__us"), F.floor(F.col("__us") / span)
    df = samples.withColumn("__us", F.unix_micros(F.col("ts").cast("timestamp")))
    spans = F.when(F.floor((us + kept) / span) > own, F.array(own, own + 1)).otherwise(F.array(own))
    df = df.withColumn("__span", F.explode(spans))
    w = Window.partitionBy("symbol", "__span").orderBy("__us")
    df = df.withColumns({f"oi_{n}": F.last("oi", ignorenulls=True).over(w.rangeBetween(-kept, -n * 60_000_000)) for n in minutes})
    return df.where(F.col("__span") == own).drop("__us", "__span")


def acceleration(samples: DataFrame) -> DataFrame:
    df = asof_lookback(samples)
    c = F.col
    df = df.withColumns({f"chg_{n}": pct_change(c("oi"), c(f"oi_{n}")) for n in (15, 30, 60)})
    df = df.withColumn("prior_30", pct_change(c("oi_30"), c("oi_60"))).withColumn("prior_60", pct_change(c("oi_60"), c("oi_120")))
    df = df.withColumn("accel", c("chg_30") - c("prior_30")).withColumn("accel_label", accel_label(c("accel")))
    return df.withColumn("trend_label", F.coalesce("accel_label", F.lit("New")))


def accel_label(a: Column) -> Column:
    return F.when(a > 2, ACCELERATING[0]).when(a >= 0.5, ACCELERATING[1]).when(a >= -0.3, "Stable").when(a >= -2, "Weakening").when(a.isNotNull(), LEAVING)


def structure(price_chg: Column, oi_chg: Column) -> Column:
    up, down = lambda x: x > FLAT_PCT, lambda x: x < -FLAT_PCT
    return (
        F.when(price_chg.isNull() | oi_chg.isNull(), None)
        .when(up(price_chg) & up(oi_chg), "Long Buildup")
        .when(down(price_chg) & up(oi_chg), "Short Buildup")
        .when(up(price_chg) & down(oi_chg), "Short Covering")
        .when(down(price_chg) & down(oi_chg), "Long Unwinding")
        .otherwise("Neutral")
    )


def day_baseline(samples: DataFrame) -> DataFrame:
    """(symbol, day, base_oi, base_close, prev_oi): the first complete sample of each day, and the last oi of the day before that has one.

    A day's last oi is any reading from its first complete sample on, with or without a close.
    """
    complete = F.col("oi").isNotNull() & F.col("close").isNotNull()
    first = F.min_by(F.struct("oi", "close"), F.when(complete, F.col("ts"))).alias("__first")
    last = F.max_by("oi", F.when(F.col("oi").isNotNull(), F.col("ts"))).alias("__last")
    d = samples.groupBy("symbol", F.to_date("ts").alias("day")).agg(first, last).where("__first is not null")
    d = d.select("symbol", "day", F.col("__first.oi").alias("base_oi"), F.col("__first.close").alias("base_close"), "__last")
    return d.withColumn("prev_oi", F.lag("__last").over(Window.partitionBy("symbol").orderBy("day"))).drop("__last")


def _carried(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """(symbol, day, ...): the last known value of some columns (new name: column) before each day; the window sees a row for each day."""
    ends = df.groupBy("symbol", "day").agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ts"))).alias(name) for name, c in columns.items()))
    w = Window.partitionBy("symbol").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    return ends.select("symbol", "day", *(F.last(name, ignorenulls=True).over(w).alias(name) for name in columns))


def oi_state(samples: DataFrame) -> DataFrame:
    """Each sample with its changes today, structure, stage, label, break signal and whether its label just turned.

    What a sample is compared to, the last structure and label before it, is looked for within its day; a day starts with what the days
    before it end with.  So a symbol has a task's work for each of its days, and what goes through one task is a row a day.
    """
    c = F.col
    df = acceleration(samples).withColumn("day", F.to_date("ts")).join(day_baseline(samples), ["symbol", "day"], "left")
    whole = c("oi").isNotNull() & c("close").isNotNull()  # else the sample has no changes today, and the day may have no baseline yet
    changes = {"price_chg_today": ("close", "base_close"), "oi_chg_today": ("oi", "base_oi"), "oi_day_chg": ("oi", "prev_oi")}
    df = df.withColumns({k: F.when(whole, pct_change(c(now), c(then))) for k, (now, then) in changes.items()})
    df = df.withColumn("structure", structure(c("price_chg_today"), c("oi_chg_today")))
    before = Window.partitionBy("symbol", "day").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda x, carried: F.coalesce(F.last(x, ignorenulls=True).over(before), carried)
    df = df.join(_carried(df, {"__s0": "structure", "__l0": "accel_label"}), ["symbol", "day"], "left")
    df = df.withColumns({"__s": last("structure", "__s0"), "__l": last("accel_label", "__l0")}).drop("__s0", "__l0")
    df = df.withColumn("stage", F.when(c("__s").isNotNull() & (c("__s") != c("structure")), "New"))
    fast = c("accel_label").isin(*ACCELERATING)
    df = df.withColumn("break_signal", F.when((c("structure") == "Long Buildup") & fast, "Break Up").when((c("structure") == "Short Buildup") & fast, "Break Down"))
    turned = F.coalesce(fast & F.coalesce(~c("__l").isin(*ACCELERATING), F.lit(True)), F.lit(False))  # a first label turns too
    return df.withColumn("accel_event", turned).drop("__s", "__l")
