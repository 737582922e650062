"""The 3-minute engine: its own averages and votes, and the trend of 15-minute buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tapeworks.functions.columns import above, agrees, cents, side, yes
from tapeworks.functions.ewm import ewm, span_alpha
from tapeworks.functions.indicators import atr, crossings, rsi, session_vwap, volumes
from tapeworks.operators.bars import resample
from tapeworks.operators.signal import latest_bar, opening_window

FAST, SLOW, RSI, ATR, REL_VOLUME, REQUIRED, STOP, TARGET = 5, 13, 7, 14, 1.5, 3, 0.75, 1.5
LEAST_BARS, LEAST_BUCKETS = 19, 18


def scalp_series(bars: DataFrame) -> DataFrame:
    df = bars.withColumn("n_bars", F.count("*").over(Window.partitionBy("symbol")))
    df = ewm(df, {"ema_fast": ("close", span_alpha(FAST), 1), "ema_slow": ("close", span_alpha(SLOW), 1)})
    df = atr(volumes(rsi(session_vwap(df), RSI)), ATR)
    df = df.withColumn("__55", F.lit(55.0)).withColumn("__45", F.lit(45.0))
    df = crossings(df, {"ema": ("ema_fast", "ema_slow"), "px": ("close", "vwap"), "rsi55": ("rsi", "__55"), "rsi45": ("rsi", "__45")})
    return df.drop("__55", "__45")


def scalp_htf(bars: DataFrame) -> DataFrame:
    own = resample(bars, "15minute").withColumn("n", F.count("*").over(Window.partitionBy("symbol")))
    own = latest_bar(ewm(own, {"f": ("close", span_alpha(FAST), 1), "s": ("close", span_alpha(SLOW), 1)}))
    return own.select("symbol", F.when(F.col("n") >= LEAST_BUCKETS, side(above(F.col("f"), F.col("s")))).alias("htf_direction"))


def scalp_signal(bars: DataFrame) -> DataFrame:
    c = F.col
    df = latest_bar(scalp_series(bars)).join(scalp_htf(bars), "symbol", "left")
    error = F.when(c("n_bars") < LEAST_BARS, "not enough candles").when(c("vwap").isNull(), "VWAP not available yet")
    bulls = above(c("ema_fast"), c("ema_slow")).cast("int") + above(c("close"), c("vwap")).cast("int") + yes(c("rsi") > 50).cast("int")
    df = df.withColumn("error", error).withColumn("votes", bulls).withColumn("direction", side(c("votes") >= 2))
    df = df.withColumn("vol_multiple", F.round("rel_volume", 2)).withColumn("vol_confirmed", yes(c("vol_multiple") >= REL_VOLUME))
    df = df.withColumn("confirmed_count", F.greatest(c("votes"), 3 - c("votes")) + c("vol_confirmed").cast("int"))
    df = df.withColumn("in_opening_window", opening_window(c("ts"), c("timeframe"))).withColumn("htf_agrees", agrees(c("htf_direction"), c("direction")))
    ok = (c("confirmed_count") >= REQUIRED) & ~c("in_opening_window") & c("htf_agrees")
    df = df.withColumn("signal_confirmed", ok)
    df = df.withColumn("action", F.when(~ok, "WAIT").when(c("direction") == "Bullish", "BUY").otherwise("SELL"))
    trend = F.format_string("Against the 15-min trend (currently %s)", "htf_direction")
    few = F.format_string("Only %d of 4 aligned (need %d)", "confirmed_count", F.lit(REQUIRED))
    why = F.when(c("in_opening_window"), "Opening-window warm-up (first 15 min of the session)").when(~c("htf_agrees"), trend).otherwise(few)
    df = df.withColumn("reason", F.when(~ok, why)).withColumn("label", F.when(ok, F.concat("action", F.lit(" NIFTY FUT"))).otherwise("NO TRADE - WAIT"))
    shown = {"close": F.round("close", 2), "vwap": F.round("vwap", 2), "rsi": F.round("rsi", 1), "atr": F.round("atr", 2)}
    states = {"ema_state": side(above(c("ema_fast"), c("ema_slow"))), "vwap_state": side(above(c("close"), c("vwap"))), "rsi_state": side(c("rsi") > 50)}
    return scalp_levels(df.withColumns(states)).withColumns(shown)


def scalp_levels(df: DataFrame) -> DataFrame:
    c, sign = F.col, F.when(F.col("direction") == "Bullish", 1.0).otherwise(-1.0)
    ok = c("atr") > 0
    df = df.withColumn("stop", F.when(ok, cents(c("close") - sign * STOP * c("atr")))).withColumn("target", F.when(ok, cents(c("close") + sign * TARGET * c("atr"))))
    return df.withColumn("risk_reward", F.when(ok, F.lit(TARGET / STOP)))
