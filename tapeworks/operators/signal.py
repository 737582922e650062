"""The signal of each symbol's latest bar."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.functions.columns import above, agrees, cents, side, yes
from tapeworks.functions.indicators import indicator_series, regime
from tapeworks.operators.bars import HIGHER, resample
from tapeworks.params import Params

OVERBOUGHT, OVERSOLD = 65, 35


def latest_bar(df: DataFrame) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy(F.col("ts").desc())
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def time_of_day(ts: Column) -> Column:
    """Minutes since midnight."""
    return F.hour(ts) * 60 + F.minute(ts)


def opening_window(ts: Column, timeframe: Column) -> Column:
    return timeframe.isin("3minute", "15minute") & time_of_day(ts).between(9 * 60 + 15, 9 * 60 + 29)


def four_hour_warmup(now: Column, timeframe: Column) -> Column:
    """now lies in the first half hour of a session's 4-hour block."""
    m = time_of_day(now)
    return yes((timeframe == "4hour") & (m.between(9 * 60 + 15, 9 * 60 + 44) | m.between(13 * 60 + 15, 13 * 60 + 44)))


def direction_of(bars: DataFrame, p: Params) -> DataFrame:
    """(symbol, direction): how each symbol's latest bar leans; symbols with too few bars have no row."""
    s = latest_bar(indicator_series(bars, p)).where("error is null")
    votes = sum(above(F.col(a), F.col(b)).cast("int") for a, b in (("rsi", "rsi_smooth"), ("macd", "macd_signal"), ("ema", "bb_mid")))
    return s.select("symbol", side(votes >= 2).alias("direction"))


def higher_direction(bars: DataFrame, timeframe: str, p: Params) -> DataFrame:
    """(symbol, htf_direction): lean of the last bucket of the higher timeframe, the forming one included, by that timeframe's spans."""
    if timeframe not in HIGHER:
        return bars.select("symbol").distinct().withColumn("htf_direction", F.lit(None).cast("string"))
    return direction_of(resample(bars, HIGHER[timeframe]), replace(p, timeframe=HIGHER[timeframe])).withColumnRenamed("direction", "htf_direction")


def signal_columns(latest: DataFrame, p: Params, now: Column | None = None) -> DataFrame:
    """The fields of the signal row, from the latest bar with its indicators and htf_direction."""
    c = F.col
    need = min(p.min_required, 3)
    ups, downs = (sum(c(f"{n}_{d}").cast("int") for n in ("rsi", "macd", "ema")) for d in ("up", "dn"))
    states = {"rsi_state": ("rsi", "rsi_smooth"), "macd_state": ("macd", "macd_signal"), "ema_bb_state": ("ema", "bb_mid")}
    window = opening_window(c("ts"), c("timeframe"))
    if now is not None:
        window = window | four_hour_warmup(now, c("timeframe"))
    df = latest.withColumns({k: side(above(c(a), c(b))) for k, (a, b) in states.items()} | {
        "fresh_signal": F.when(ups >= need, "Bullish").when(downs >= need, "Bearish"), "adx": F.round("adx", 1), "vol_multiple": F.round("rel_volume", 2), "cmf": F.round("cmf", 3), "avwap": F.round("avwap", 2),
        "vs_vwap": F.when(c("close") > c("vwap"), "Above").when(c("vwap").isNotNull(), "Below"),
        "breakout_state": F.when(c("close") > c("bb_upper"), "Breakout").when(c("close") < c("bb_lower"), "Breakdown"),
        "in_opening_window": window, "macd_params": F.lit(",".join(map(str, p.macd_spans()))),
    })
    df = df.withColumns({
        "votes": sum((c(k) == "Bullish").cast("int") for k in states), "regime": regime(c("adx")), "flow_direction": F.when(c("cmf") > 0, "Bullish").when(c("cmf") < 0, "Bearish"),
        "vs_avwap": F.when(c("close") > c("avwap"), "Above").when(c("avwap").isNotNull(), "Below"),
    })
    limit = F.round(F.lit(p.rel_volume) * F.when(yes(c("regime") == "Ranging"), p.ranging_multiplier).otherwise(1.0), 3)
    df = df.withColumns({"direction": side(c("votes") >= 2), "vol_threshold": limit})
    opinions = {"flow_agrees": "flow_direction", "candle_agrees": "candle_direction", "htf_agrees": "htf_direction"}
    df = df.withColumns({k: agrees(c(v), c("direction")) for k, v in opinions.items()} | {"vol_confirmed": yes(c("vol_multiple") >= c("vol_threshold"))})
    df = df.withColumn("aligned", F.greatest(c("votes"), 3 - c("votes")) + c("vol_confirmed").cast("int"))
    df = df.withColumn("signal_confirmed", (c("aligned") >= p.min_required) & c("htf_agrees") & ~c("in_opening_window"))
    shown = {"close": F.round("close", 2), "rsi": F.round("rsi", 1), "vwap": F.round(F.nullif("vwap", F.lit(0.0)), 2)}
    return levels(df, p).withColumns(shown)  # all comparisons are done


def levels(df: DataFrame, p: Params) -> DataFrame:
    """df with the stop, the target, their ratio and the position's size."""
    c, sign = F.col, F.when(F.col("direction") == "Bullish", 1.0).otherwise(-1.0)
    df = df.withColumn("atr", F.round("atr", 2))
    ok = c("atr") > 0
    df = df.withColumns({
        "stop": F.when(ok, cents(c("close") - sign * p.atr_stop * c("atr"))), "target": F.when(ok, cents(c("close") + sign * p.atr_target * c("atr"))),
        "risk_reward": F.when(ok, F.round(F.lit(p.atr_target / p.atr_stop), 2)),
    })
    risk = F.nullif(F.abs(c("close") - c("stop")), F.lit(0.0))
    qty = F.nullif(F.floor(p.capital * p.risk_pct / 100 / risk), F.lit(0).cast("long"))
    return df.withColumn("position_qty", qty).withColumn("position_risk", F.round(c("position_qty") * risk, 2))


SIGNAL = (
    "symbol ts close rsi rsi_state macd_params macd_state ema_bb_state aligned direction fresh_signal vwap vs_vwap avwap vs_avwap anchor breakout_state vol_multiple volume vol_confirmed cmf "
    "flow_direction flow_agrees candle_pattern candle_direction candle_agrees adx regime vol_threshold htf_direction htf_agrees in_opening_window signal_confirmed atr stop target "
    "risk_reward position_qty position_risk"
).split()


def screener(bars: DataFrame, watchlist: DataFrame, p: Params, now: Column | None = None) -> DataFrame:
    """One row for each symbol of the watchlist: its signal, or an error."""
    latest = signal_columns(latest_bar(indicator_series(bars, p)).join(higher_direction(bars, p.timeframe, p), "symbol", "left"), p, now)
    values = [F.when(F.col("error").isNull(), F.col(c)).alias(c) for c in SIGNAL if c != "symbol"]
    rows = watchlist.join(latest.select("symbol", F.coalesce("error", F.lit("")).alias("__error"), *values), "symbol", "left")
    error = F.when(F.col("__error").isNull(), "symbol not found").otherwise(F.nullif("__error", F.lit("")))
    return rows.select(*watchlist.columns, error.alias("error"), *(c for c in SIGNAL if c != "symbol"))
