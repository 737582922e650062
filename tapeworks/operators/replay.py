"""Replay of an N-of-M rule over history: entries, forward returns and what they add up to."""

from __future__ import annotations

from dataclasses import replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeworks.functions.columns import above, agrees, by_time, side, yes
from tapeworks.functions.indicators import indicator_series, regime
from tapeworks.operators.bars import HIGHER, bucket, resample
from tapeworks.operators.signal import OVERBOUGHT, OVERSOLD, four_hour_warmup, opening_window
from tapeworks.params import Params

PARAMETERS = ("rsi_cross", "macd_cross", "ema_bb_cross", "rsi_threshold", "rel_volume", "cmf_flow", "candle_pattern")
HORIZONS = (5, 10, 20)
SHOWN_TRADES, MAX_DAYS = 500, 90


def volume_hot(p: Params, by_regime: bool = False) -> Column:
    """Relative volume above the threshold, which a ranging market raises if by_regime."""
    limit = F.lit(p.rel_volume)
    if by_regime:
        limit = limit * F.when(yes(regime(F.col("adx")) == "Ranging"), p.ranging_multiplier).otherwise(1.0)
    return yes(F.col("rel_volume") > limit)


def votes(hot: Column) -> dict[str, tuple[Column, Column]]:
    """(bull, bear) of each parameter."""
    c = F.col
    out = {f"{n}_cross": (c(f"{k}_up"), c(f"{k}_dn")) for n, k in (("rsi", "rsi"), ("macd", "macd"), ("ema_bb", "ema"))}
    out["rsi_threshold"] = (yes(c("rsi") > OVERBOUGHT), yes(c("rsi") < OVERSOLD))
    out["rel_volume"] = (hot, hot)
    out["cmf_flow"] = (yes(c("cmf") > 0), yes(c("cmf") < 0))
    out["candle_pattern"] = (yes(c("candle_direction") == "Bullish"), yes(c("candle_direction") == "Bearish"))
    return out


def htf_buckets(bars: DataFrame, timeframe: str, p: Params) -> DataFrame:
    """(symbol, bucket, htf_direction): lean of the bucket before, which is closed, by the buckets' own spans; null until it is warm."""
    s = indicator_series(resample(bars, HIGHER[timeframe]), replace(p, timeframe=HIGHER[timeframe]))
    warm = F.col("align").isNotNull()
    s = s.withColumn("__lean", F.when(warm & F.col("error").isNull(), side(F.col("align") >= 2)))
    return s.select("symbol", F.col("ts").alias("bucket"), F.lag("__lean").over(by_time()).alias("htf_direction"))


def asof_htf(bars: DataFrame, timeframe: str, p: Params) -> DataFrame:
    """bars with htf_direction: a backward as-of join to bucket starts, which is an equi-join on each bar's bucket."""
    own = bars.withColumn("bucket", bucket(F.col("ts"), HIGHER[timeframe]))
    return own.join(htf_buckets(bars, timeframe, p), ["symbol", "bucket"], "left").drop("bucket")


def asof_join(left: DataFrame, right: DataFrame, value: str) -> DataFrame:
    """left with the value of right's last row at or before ts, null values included: the generic form, by union."""
    a = left.withColumn("__v", F.lit(None).cast(f"struct<{value}:{dict(right.dtypes)[value]}>")).withColumn("__side", F.lit(1))
    b = right.select("symbol", "ts", F.struct(value).alias("__v")).withColumn("__side", F.lit(0))
    both = b.unionByName(a, allowMissingColumns=True)
    w = Window.partitionBy("symbol").orderBy("ts", "__side").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("__last", F.last("__v", ignorenulls=True).over(w)).where("__side = 1")
    return out.select(*left.columns, F.col(f"__last.{value}").alias(value))


def nofm_signal(series: DataFrame, parameters: tuple[str, ...], required: int, p: Params, timeframe: str, gates: tuple[str, ...] = (), opening: str = "reference") -> DataFrame:
    """series with has_signal and direction; gates only take signals away.

    gates: of htf (needs htf_direction), regime_volume, opening, flow, candle.  opening: "reference" suppresses the
    4-hour bars labelled 09:15 and 13:15 too, "off_for_4h" doesn't.
    """
    unknown = set(parameters) - set(PARAMETERS)
    if unknown:
        raise ValueError(f"unknown parameters: {sorted(unknown)}")
    required = min(max(1, required), len(parameters))
    own = [votes(volume_hot(p, "regime_volume" in gates))[x] for x in parameters]
    bull, bear = (sum(v[i].cast("int") for v in own) for i in (0, 1))
    df = series.withColumn("bull", bull).withColumn("bear", bear)
    rise, fall = (F.col("bull") >= required) & (F.col("bear") < required), (F.col("bear") >= required) & (F.col("bull") < required)
    df = df.withColumn("direction", F.when(rise, "Bullish").otherwise("Bearish"))
    on = rise | fall
    if "htf" in gates:
        on = on & agrees(F.col("htf_direction"), F.col("direction"))
    if "opening" in gates:
        closed = opening_window(F.col("ts"), F.lit(timeframe))
        if opening == "reference":
            closed = closed | four_hour_warmup(F.col("ts"), F.lit(timeframe))
        on = on & ~closed
    if "flow" in gates:
        on = on & agrees(F.when(F.col("cmf") > 0, "Bullish").when(F.col("cmf") < 0, "Bearish"), F.col("direction"))
    if "candle" in gates:
        on = on & agrees(F.col("candle_direction"), F.col("direction"))
    return df.withColumn("has_signal", on)


def entries(df: DataFrame) -> DataFrame:
    """df with ``entry``: the signal's rising edge."""
    return df.withColumn("entry", F.col("has_signal") & ~yes(F.lag("has_signal").over(by_time())))


def forward_returns(df: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """df with entry_price (the next open), mae and returns (horizon -> %), for a trade from each bar."""
    w = by_time()
    sign = F.when(F.col("direction") == "Bullish", 1.0).otherwise(-1.0)
    df = df.withColumn("entry_price", F.nullif(F.lead("open").over(w), F.lit(0.0))).withColumn("entry_time", F.lead("ts").over(w))
    ahead = w.rowsBetween(1, 1 + max(horizons))
    worst = F.when(F.col("direction") == "Bullish", F.min("low").over(ahead)).otherwise(F.max("high").over(ahead))
    df = df.withColumn("mae", F.when(sign * (worst - F.col("entry_price")) < 0, F.round(sign * (worst - F.col("entry_price")) / F.col("entry_price") * 100, 3)).when(F.col("entry_price").isNotNull(), 0.0))
    pairs = F.array(*(F.struct(F.lit(h).alias("h"), F.round(sign * (F.lead("close", 1 + h).over(w) - F.col("entry_price")) / F.col("entry_price") * 100, 3).alias("r")) for h in horizons))
    return df.withColumn("__r", pairs).withColumn("returns", F.map_from_entries(F.filter("__r", lambda x: x["r"].isNotNull()))).drop("__r")


def trades(signals: DataFrame, p: Params, horizons: tuple[int, ...] = HORIZONS, start: Column | None = None) -> DataFrame:
    """One row for each entry with a price and a horizon that has passed; start trims the warm-up."""
    df = forward_returns(entries(signals), horizons)
    df = df.withColumn("vol_confirmed", volume_hot(p)).where("entry and entry_price is not null and size(returns) > 0")
    if start is not None:
        df = df.where(F.col("ts") >= start)
    return df.select("symbol", F.col("ts").alias("signal_time"), "entry_time", "direction", F.round("entry_price", 2).alias("entry_price"), "returns", "mae", "vol_confirmed")


def backtest(bars: DataFrame, timeframe: str, parameters: tuple[str, ...], required: int, p: Params, horizons=HORIZONS, gates: tuple[str, ...] = (), start: Column | None = None) -> DataFrame:
    horizons = tuple(sorted({h for h in horizons if h > 0})) or HORIZONS
    series = indicator_series(bars, p).where("error is null")
    if "htf" in gates:
        own = htf_buckets(bars, timeframe, p)
        series = series.withColumn("bucket", bucket(F.col("ts"), HIGHER[timeframe])).join(own, ["symbol", "bucket"], "left").drop("bucket")
    return trades(nofm_signal(series, parameters, required, p, timeframe, gates), p, horizons, start)


def recent_trades(t: DataFrame, n: int = SHOWN_TRADES) -> DataFrame:
    return t.orderBy(F.col("entry_time").desc(), "symbol").limit(n)


def horizon_stats(t: DataFrame) -> DataFrame:
    """Five groups (all, by direction, by volume) and each horizon: trades, win rate, mean, best, worst return."""
    long = t.select("direction", "vol_confirmed", F.explode("returns").alias("horizon", "r"))
    stats = [F.count("*").alias("trades"), F.round(F.avg((F.col("r") > 0).cast("double")) * 100, 1).alias("win_rate"), F.round(F.avg("r"), 3).alias("avg_return"), F.max("r").alias("best"), F.min("r").alias("worst")]
    out = long.groupingSets([["horizon"], ["horizon", "direction"], ["horizon", "vol_confirmed"]], "horizon", "direction", "vol_confirmed").agg(F.grouping_id().alias("gid"), *stats)
    return out.select(group_name(), "horizon", "trades", "win_rate", "avg_return", "best", "worst")


def group_name() -> Column:
    by_volume = F.when(F.col("vol_confirmed"), "vol_confirmed").when(~F.col("vol_confirmed"), "vol_not_confirmed")
    return F.coalesce(F.lower("direction"), by_volume, F.lit("all")).alias("grp")


def drawdown_stats(t: DataFrame) -> DataFrame:
    out = t.groupingSets([[], ["direction"], ["vol_confirmed"]], "direction", "vol_confirmed").agg(F.count("*").alias("total"), F.round(F.avg("mae"), 3).alias("avg_mae"), F.min("mae").alias("worst_mae"))
    return out.select(group_name(), "total", "avg_mae", "worst_mae")


def coverage(universe: DataFrame, bars: DataFrame, t: DataFrame, least: int = 37) -> DataFrame:
    """For each symbol asked for: its trades, or why it was skipped."""
    n = bars.groupBy("symbol").agg(F.count("*").alias("n_bars"))
    k = t.groupBy("symbol").agg(F.count("*").alias("n_trades"))
    reason = F.when(F.col("n_bars").isNull(), "no data").when(F.col("n_bars") < least, "not enough candles")
    return universe.select("symbol").distinct().join(n, "symbol", "left").join(k, "symbol", "left").select("symbol", F.coalesce("n_trades", F.lit(0)).cast("long").alias("n_trades"), reason.alias("skipped"))


def param_win_rates(bars: DataFrame, timeframe: str, p: Params, horizon: int = 10) -> DataFrame:
    """(param, trades, win_rate, without_volume, lift) for each crossover alone, and volume: that of confirmed 2-of-3 trades.

    without_volume is the win rate of the 2-of-3 trades that volume didn't confirm, lift what volume adds to it.  The
    series is computed once; each row of it is held against the four rules.
    """
    cross = ("rsi_cross", "macd_cross", "ema_bb_cross")
    rules = {c: ((c,), 1) for c in cross} | {"rel_volume": (cross, 2)}
    df = indicator_series(bars, p).where("error is null").withColumn("__hot", volume_hot(p))
    for name, (params, required) in rules.items():
        own = nofm_signal(df, params, required, p, timeframe)
        df = own.withColumn(f"__s_{name}", F.when(F.col("has_signal"), F.col("direction"))).drop("bull", "bear", "direction", "has_signal")
    w = by_time()
    price = F.nullif(F.lead("open").over(w), F.lit(0.0))
    df = df.withColumn("__entry", price).withColumn("__out", F.lead("close", 1 + horizon).over(w)).withColumns({f"__e_{n}": F.col(f"__s_{n}").isNotNull() & F.lag(f"__s_{n}").over(w).isNull() for n in rules})
    gain = lambda n: F.round(F.when(F.col(f"__s_{n}") == "Bullish", 1.0).otherwise(-1.0) * (F.col("__out") - F.col("__entry")) / F.col("__entry") * 100, 3)
    each = F.array(*(F.struct(F.lit(n).alias("param"), F.when(F.col(f"__e_{n}"), gain(n)).alias("r"), (F.col("__hot") if n == "rel_volume" else F.lit(True)).alias("counts")) for n in rules))
    long = df.select(F.explode(each).alias("x")).select("x.*").where("r is not null")
    rate = lambda on: F.round(F.avg(F.when(on, (F.col("r") > 0).cast("double"))) * 100, 1)
    out = long.groupBy("param").agg(F.count_if("counts").alias("trades"), rate(F.col("counts")).alias("win_rate"), rate(~F.col("counts")).alias("without_volume"))
    return out.withColumn("lift", F.round(F.col("win_rate") - F.col("without_volume"), 1)).where("trades > 0")


def param_weights(rates: DataFrame, params: DataFrame) -> DataFrame:
    """Weights of the parameters (a table with a column param): a fifth even, the rest by win rate."""
    all_rows = Window.partitionBy(F.lit(1))
    raw = params.join(rates, "param", "left").withColumn("raw", F.coalesce(F.col("win_rate") / 100, F.lit(0.25)))
    n, total = F.count("*").over(all_rows), F.nullif(F.sum("raw").over(all_rows), F.lit(0.0))
    return raw.select("param", F.round(0.2 / n + 0.8 * F.coalesce(F.col("raw") / total, F.lit(0.0)), 4).alias("weight"))


def backtest_universe(watchlist: DataFrame, universe: str = "watchlist") -> DataFrame:
    """(symbol): the watchlist, or one index alone; what isn't known is the watchlist."""
    alone = {"nifty50": "NIFTY 50", "sensex": "SENSEX"}.get(universe)
    return watchlist.select("symbol") if alone is None else watchlist.sparkSession.createDataFrame([(alone,)], "symbol string")


def store_weights(weights: DataFrame, folder: str) -> None:
    """Keeps the weights (param, weight) for later scans; a new set replaces the old one."""
    weights.coalesce(1).write.mode("overwrite").parquet(folder)  # one row for each parameter


def load_weights(spark: SparkSession, folder: str) -> DataFrame:
    """The stored weights; no rows, which count evenly, where none are stored yet."""
    try:
        return spark.read.parquet(folder)
    except AnalysisException:
        return spark.createDataFrame([], "param string, weight double")
