"""Indicator columns over all bars of all symbols.

Bars hold symbol, timeframe, ts, open, high, low, close and volume.  All windows share the partitioning by symbol, so
``indicator_series`` needs one exchange whatever it computes, and columns that a query doesn't read leave its plan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.functions.columns import above, by_time, pct_change, put, ratio, time_order, yes
from tapeworks.functions.ewm import ewm, ewm_shared, shared_rows, span_alpha
from tapeworks.params import Params

CMF_LENGTH, VOLUME_LENGTH, LEAST_VOLUMES, TREND_LOOKBACK = 20, 20, 5, 5
TRENDING_FROM, RANGING_TO = 25, 18
INTRADAY = ("3minute", "15minute", "60minute", "4hour")


def rolling(n: int):
    return by_time().rowsBetween(-(n - 1), 0)


def lag(c: str | Column, n: int = 1) -> Column:
    return F.lag(c, n).over(by_time())


def full_mean(c: str, n: int) -> Column:
    return F.when(F.count(c).over(rolling(n)) == n, F.avg(c).over(rolling(n)))


def rsi(df: DataFrame, length: int, name: str = "rsi") -> DataFrame:
    d = F.col("close") - lag("close")
    df = df.withColumns({"__up": F.greatest(d, F.when(d.isNotNull(), 0.0)), "__down": F.greatest(-d, F.when(d.isNotNull(), 0.0))})
    df = ewm(df, {"__gain": ("__up", 1 / length, length), "__loss": ("__down", 1 / length, length)})
    value = 100 - 100 / (1 + F.col("__gain") / F.nullif("__loss", F.lit(0.0)))
    return put(df, {name: value}, ("__up", "__down", "__gain", "__loss"))


def bollinger(df: DataFrame, n: int) -> DataFrame:
    std = F.when(F.count("close").over(rolling(n)) == n, F.stddev_samp("close").over(rolling(n)))
    df = df.withColumns({"bb_mid": full_mean("close", n), "__std": std})
    return put(df, {"bb_upper": F.col("bb_mid") + 2 * F.col("__std"), "bb_lower": F.col("bb_mid") - 2 * F.col("__std")}, ["__std"])


def volumes(df: DataFrame) -> DataFrame:
    n = F.count("volume").over(rolling(VOLUME_LENGTH))
    df = df.withColumn("vol_avg", F.when(n >= LEAST_VOLUMES, F.avg("volume").over(rolling(VOLUME_LENGTH))))
    return df.withColumn("rel_volume", ratio(F.col("volume"), F.col("vol_avg")))


def true_range() -> Column:
    before = lag("close")
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def atr(df: DataFrame, length: int) -> DataFrame:
    return ewm(df.withColumn("tr", true_range()), {"atr": ("tr", 1 / length, length)})


def regime(adx: Column) -> Column:
    return F.when(adx >= TRENDING_FROM, "Trending").when(adx <= RANGING_TO, "Ranging").when(adx.isNotNull(), "Transitional")


def cmf(df: DataFrame) -> DataFrame:
    rng = F.nullif(F.col("high") - F.col("low"), F.lit(0.0))
    flow = F.coalesce(((F.col("close") - F.col("low")) - (F.col("high") - F.col("close"))) / rng, F.lit(0.0)) * F.col("volume")
    df = df.withColumn("__flow", flow)
    w = rolling(CMF_LENGTH)
    value = F.sum("__flow").over(w) / F.nullif(F.sum("volume").over(w).cast("double"), F.lit(0.0))
    return put(df, {"cmf": F.when(F.count("__flow").over(w) >= 5, value)}, ["__flow"])


def crossings(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """df with <name>_up and <name>_dn for each pair of lines."""
    new = {}
    for name, (a, b) in pairs.items():
        now_up, now_dn = above(F.col(a), F.col(b)), above(F.col(b), F.col(a))
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        was = yes(lag(both))
        new |= {f"{name}_up": now_up & was & ~yes(lag(now_up)), f"{name}_dn": now_dn & was & ~yes(lag(now_dn))}
    return df.withColumns(new)


def typical() -> Column:
    return (F.col("high") + F.col("low") + F.col("close")) / 3


def session_vwap(df: DataFrame, name: str = "vwap") -> DataFrame:
    day = Window.partitionBy("symbol", F.to_date("ts")).orderBy("ts")
    value = F.sum(typical() * F.col("volume")).over(day) / F.nullif(F.sum("volume").over(day).cast("double"), F.lit(0.0))
    return df.withColumn(name, F.when(F.col("timeframe").isin(*INTRADAY), value))


def align_count(df: DataFrame) -> DataFrame:
    known = [F.col(c).isNotNull() for c in ("rsi", "rsi_smooth", "macd", "macd_signal", "ema", "bb_mid")]
    votes = sum(above(F.col(a), F.col(b)).cast("int") for a, b in (("rsi", "rsi_smooth"), ("macd", "macd_signal"), ("ema", "bb_mid")))
    ok = known[0]
    for k in known[1:]:
        ok = ok & k
    return df.withColumn("align", F.when(ok, votes))


def trend_anchor(df: DataFrame) -> DataFrame:
    """df with ``anchor``: when the current run of the symbol's direction began."""
    whole = Window.partitionBy("symbol")
    bull = yes(F.col("align") >= 2)
    df = df.withColumns({"__first": F.min(F.when(F.col("align").isNotNull(), F.col("ts"))).over(whole), "__flip": bull != lag(bull)})
    flip = F.max(F.when(F.col("__flip") & (F.col("ts") > F.col("__first")), F.col("ts"))).over(whole)
    return put(df, {"anchor": F.coalesce(flip, "__first")}, ("__first", "__flip"))


def anchored_vwap(df: DataFrame) -> DataFrame:
    on = F.col("ts") >= F.col("anchor")
    w = by_time()
    value = F.sum(F.when(on, typical() * F.col("volume"))).over(w) / F.nullif(F.sum(F.when(on, F.col("volume"))).over(w).cast("double"), F.lit(0.0))
    return df.withColumn("avwap", F.when(on, value))


def candle_pattern(df: DataFrame) -> DataFrame:
    o, h, lo, c = (F.col(x) for x in ("open", "high", "low", "close"))
    body = F.abs(c - o)
    rng = F.nullif(h - lo, F.lit(0.0))
    upper, lower = h - F.greatest(o, c), F.least(o, c) - lo
    o1, c1, o2, c2 = lag("open"), lag("close"), lag("open", 2), lag("close", 2)
    old = lag("close", 1 + TREND_LOOKBACK)
    rose, fell = c1 > old, c1 < old
    small = body <= 0.35 * rng
    hammer, inverted = small & (lower >= 2 * body) & (upper <= 0.25 * rng), small & (upper >= 2 * body) & (lower <= 0.25 * rng)
    star = F.abs(c1 - o1) <= 0.5 * F.nullif(F.abs(o2 - c2), F.lit(0.0))
    mid = (o2 + c2) / 2
    bull = {
        "Bullish Engulfing": (c1 < o1) & (c > o) & (o <= c1) & (c >= o1),
        "Morning Star": (c2 < o2) & star & (c > o) & (c > mid),
        "Inverted Hammer": inverted & fell,
        "Hammer": hammer & fell,
    }
    bear = {
        "Bearish Engulfing": (c1 > o1) & (c < o) & (o >= c1) & (c <= o1),
        "Evening Star": (c2 > o2) & star & (c < o) & (c < mid),
        "Shooting Star": inverted & rose,
        "Hanging Man": hammer & rose,
    }

    def label(found: dict[str, Column]) -> Column:
        return F.coalesce(*(F.when(yes(v), k) for k, v in found.items()))

    df = df.withColumns({"__bull": label(bull), "__bear": label(bear)})
    one = F.col("__bull").isNull() | F.col("__bear").isNull()
    direction = F.when(one & F.col("__bull").isNotNull(), "Bullish").when(one & F.col("__bear").isNotNull(), "Bearish")
    return put(df, {"candle_pattern": F.when(one, F.coalesce("__bull", "__bear")), "candle_direction": direction}, ("__bull", "__bear"))


def price_change(df: DataFrame) -> DataFrame:
    return df.withColumn("price_change", F.round(pct_change(F.col("close"), lag("close")), 2))


def least_bars(p: Params) -> int:
    return max(p.bb_length, 35) + 2


def means(df: DataFrame, p: Params, mean: Callable[[DataFrame, dict], DataFrame] = ewm) -> DataFrame:
    """df with rsi, macd, macd_signal, macd_hist, ema, tr, atr and adx: all first means in one pass, the means of means in a second."""
    fast, slow, signal = p.macd_spans()
    up, down = F.col("high") - lag("high"), lag("low") - F.col("low")
    d = F.col("close") - lag("close")
    df = df.withColumns({
        "tr": true_range(), "__up": F.greatest(d, F.when(d.isNotNull(), 0.0)), "__down": F.greatest(-d, F.when(d.isNotNull(), 0.0)),
        "__plus": F.when(yes((up > down) & (up > 0)), up).otherwise(0.0), "__minus": F.when(yes((down > up) & (down > 0)), down).otherwise(0.0),
    })
    r, t, x = 1 / p.rsi_length, 1 / p.atr_length, 1 / p.adx_length
    df = mean(df, {
        "__gain": ("__up", r, p.rsi_length), "__loss": ("__down", r, p.rsi_length, "__up"), "__fast": ("close", span_alpha(fast), 1), "__slow": ("close", span_alpha(slow), 1), "ema": ("close", span_alpha(p.ema_length), 1),
        "atr": ("tr", t, p.atr_length, "close"), "__str": ("tr", x, p.adx_length, "close"), "__sp": ("__plus", x, p.adx_length, "close"), "__sm": ("__minus", x, p.adx_length, "close"),
    })
    total = F.nullif("__str", F.lit(0.0))
    plus, minus = 100 * F.col("__sp") / total, 100 * F.col("__sm") / total
    df = df.withColumns({
        "rsi": 100 - 100 / (1 + F.col("__gain") / F.nullif("__loss", F.lit(0.0))), "macd": F.col("__fast") - F.col("__slow"),
        "__dx": 100 * F.abs(plus - minus) / F.nullif(plus + minus, F.lit(0.0)),
    })
    df = mean(df, {"macd_signal": ("macd", span_alpha(signal), 1, "close"), "adx": ("__dx", x, p.adx_length)})
    return put(df, {"macd_hist": F.col("macd") - F.col("macd_signal")}, ("__up", "__down", "__plus", "__minus", "__gain", "__loss", "__fast", "__slow", "__str", "__sp", "__sm", "__dx"))


def weights(p: Params) -> list[float]:
    """What a new value counts for in each of the means."""
    return [1 / p.rsi_length, 1 / p.atr_length, 1 / p.adx_length, *(span_alpha(s) for s in (*p.macd_spans(), p.ema_length))]


def indicator_series(bars: DataFrame, p: Params = Params()) -> DataFrame:
    """All indicator columns; ``error`` names what is missing where a symbol has too few bars.

    Where one length of block does for all means, every window but those of sessions and of the rows' numbers goes by symbol, block and time, and so by one sort.
    """
    rows = shared_rows(weights(p))
    df = session_vwap(bars)
    if rows is None:
        return _series(df, p, ewm).select(*bars.columns, *SERIES)
    df = df.withColumn("__row", F.row_number().over(by_time()) - 1).withColumn("__b", F.floor(F.col("__row") / rows))
    with time_order("__b", "ts"):
        df = _series(df, p, lambda d, specs: ewm_shared(d, specs, rows))
    return df.select(*bars.columns, *SERIES)


SERIES = (
    "n_bars error tr ema atr rsi macd macd_signal adx macd_hist rsi_smooth bb_mid bb_upper bb_lower vol_avg rel_volume cmf rsi_up rsi_dn macd_up macd_dn ema_up ema_dn vwap "
    "candle_pattern candle_direction align anchor avwap"
).split()


def _series(df: DataFrame, p: Params, mean: Callable[[DataFrame, dict], DataFrame]) -> DataFrame:
    df = df.withColumn("n_bars", F.count("*").over(Window.partitionBy("symbol")))
    df = df.withColumn("error", F.when(F.col("n_bars") < least_bars(p), "not enough candles"))
    df = means(df, p, mean)
    df = df.withColumn("rsi_smooth", full_mean("rsi", p.rsi_smooth))
    df = cmf(volumes(bollinger(df, p.bb_length)))
    df = crossings(df, {"rsi": ("rsi", "rsi_smooth"), "macd": ("macd", "macd_signal"), "ema": ("ema", "bb_mid")})
    return anchored_vwap(trend_anchor(align_count(candle_pattern(df))))
