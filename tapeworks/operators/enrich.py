"""What a scan's rows get from their context, in the order in which the scan applies it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeworks.functions.columns import agrees, yes
from tapeworks.operators.signal import direction_of, latest_bar, time_of_day
from tapeworks.params import Params

WEIGHTED = ("rsi_state", "macd_state", "ema_bb_state", "vol_confirmed")
WEIGHT_OF = {"rsi_cross": "rsi_state", "macd_cross": "macd_state", "ema_bb_cross": "ema_bb_state", "rel_volume": "vol_confirmed"}


def market_hours(ts: Column) -> Column:
    return (F.weekday(ts) < 5) & time_of_day(ts).between(9 * 60 + 15, 15 * 60 + 30) & ((time_of_day(ts) < 15 * 60 + 30) | (F.second(ts) == 0))


def param_tier(rows: DataFrame) -> DataFrame:
    return rows.withColumn("param_tier", F.when((F.col("aligned") >= 2) & ~F.col("in_opening_window"), F.col("aligned")))


def _revoke(rows: DataFrame, flag: str, required: bool) -> DataFrame:
    return rows.withColumn("signal_confirmed", F.col("signal_confirmed") & F.col(flag)) if required else rows


def index_direction(index_bars: DataFrame, p: Params) -> DataFrame:
    """One row: how the index's latest bar leans, by the same votes as any symbol's; null where it has too few bars."""
    return direction_of(index_bars, p).agg(F.max("direction").alias("index_direction"))


def index_filter(rows: DataFrame, index: DataFrame, p: Params) -> DataFrame:
    """index is one row, so that joining it to all rows is no cross product."""
    out = rows.crossJoin(F.broadcast(index.limit(1))).withColumn("index_agrees", agrees(F.col("index_direction"), F.col("direction")))
    return _revoke(out, "index_agrees", p.require_index)


def volume_flow_filter(rows: DataFrame, p: Params) -> DataFrame:
    return _revoke(rows, "flow_agrees", p.require_flow)


def candle_filter(rows: DataFrame, p: Params) -> DataFrame:
    return _revoke(rows, "candle_agrees", p.require_candle)


def sector_directions(sector_bars: DataFrame, rows: DataFrame, sector_map: DataFrame, p: Params) -> DataFrame:
    """(sector, sector_direction) of the sectors that occur in the rows, by the same votes as any symbol's."""
    present = sector_map.join(rows.select("symbol"), "symbol", "left_semi").select("sector").distinct()
    own = direction_of(sector_bars.join(present.withColumnRenamed("sector", "symbol"), "symbol", "left_semi"), p)
    return present.join(own.select(F.col("symbol").alias("sector"), F.col("direction").alias("sector_direction")), "sector", "left")


def sector_filter(rows: DataFrame, sector_map: DataFrame, directions: DataFrame, p: Params) -> DataFrame:
    out = rows.join(sector_map, "symbol", "left").join(directions, "sector", "left")
    out = out.withColumn("sector_agrees", agrees(F.col("sector_direction"), F.col("direction")))
    return _revoke(out, "sector_agrees", p.require_sector)


def breadth(rows: DataFrame) -> DataFrame:
    """One row: how many symbols lean each way."""
    out = rows.where("error is null").agg(F.count_if(F.col("direction") == "Bullish").alias("bullish"), F.count_if(F.col("direction") == "Bearish").alias("bearish"))
    total = F.nullif(F.col("bullish") + F.col("bearish"), F.lit(0).cast("long"))
    return out.select("bullish", "bearish", *(F.round(F.col(k) / total * 100, 1).alias(f"{k}_pct") for k in ("bullish", "bearish")))


def breadth_filter(rows: DataFrame, market: DataFrame, p: Params) -> DataFrame:
    out = rows.crossJoin(F.broadcast(market.select("bullish_pct", "bearish_pct")))  # one row
    own = F.when(F.col("direction") == "Bullish", F.col("bullish_pct")).otherwise(F.col("bearish_pct"))
    out = out.withColumn("breadth_agrees", F.coalesce(own >= p.breadth_pct, F.lit(True)))
    return _revoke(out, "breadth_agrees", p.require_breadth)


def weighted_score(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """weights (param, weight) has four rows; without them each counts a quarter."""
    wide = weights.agg(*(F.coalesce(F.max(F.when(F.col("param") == k, F.col("weight"))), F.when(F.count("*") == 0, 0.25), F.lit(0.0)).alias(f"__{v}") for k, v in WEIGHT_OF.items()))
    terms = [F.when(F.col(v) if v == "vol_confirmed" else F.col(v) == F.col("direction"), F.col(f"__{v}")).otherwise(0.0) for v in WEIGHTED]
    out = rows.crossJoin(F.broadcast(wide)).withColumn("weighted_score", F.round(sum(terms[1:], terms[0]) * 100, 1))
    return out.drop(*(f"__{v}" for v in WEIGHTED))


def join_setup_confidence(rows: DataFrame, setups: DataFrame) -> DataFrame:
    return rows.join(setups.select("direction", "aligned", F.col("win_rate").alias("journal_confidence")), ["direction", "aligned"], "left")


def join_oi_state(rows: DataFrame, state: DataFrame) -> DataFrame:
    own = latest_bar(state).select("symbol", "chg_15", "chg_30", "chg_60", "accel", "accel_label", "trend_label", "oi_chg_today", "oi_day_chg", "price_chg_today", "structure", "stage", "break_signal")
    return rows.join(own, "symbol", "left")


def positional_qualified(rows: DataFrame, p: Params) -> DataFrame:
    """Rows need index_agrees (which counts only if p requires it), structure and in_opening_window."""
    agree = yes(F.col("structure") == F.when(F.col("direction") == "Bullish", "Long Buildup").otherwise("Short Buildup"))
    return rows.withColumn("positional_qualified", yes((F.col("aligned") >= p.min_required) & agree & ~F.col("in_opening_window") & (F.col("index_agrees") if p.require_index else F.lit(True))))


def high_conviction(rows: DataFrame) -> DataFrame:
    bull = F.col("direction") == "Bullish"
    agree = F.col("break_signal") == F.when(bull, "Break Up").otherwise("Break Down")
    right = F.col("vs_vwap") == F.when(bull, "Above").otherwise("Below")
    return rows.withColumn("high_conviction", yes(F.col("positional_qualified") & (F.col("aligned") == 4) & agree & (F.col("vol_multiple") >= 1.5) & right))


def oi_screener(rows: DataFrame) -> DataFrame:
    return rows.where("error is null and param_tier is not null")


def oi_move_max(rows: DataFrame) -> DataFrame:
    return rows.withColumn("oi_move_max", F.greatest(*(F.abs(c) for c in ("chg_15", "chg_30", "chg_60", "oi_chg_today"))))


def oi_screener_filter(rows: DataFrame, symbol: str = "", structure: str | None = None, accel: str | None = None, tier: int | None = None, least_move: float | None = None, has_move: bool = False) -> DataFrame:
    out = oi_move_max(rows)
    if symbol:
        out = out.where(F.contains(F.upper("symbol"), F.lit(symbol.upper())))
    if structure:
        out = out.where(F.col("structure") == structure)
    if accel:
        out = out.where(F.col("trend_label") == accel)
    if tier is not None:
        out = out.where(F.col("param_tier") == tier)
    if has_move:
        out = out.where("oi_move_max is not null")
    return out if least_move is None else out.where(F.col("oi_move_max") >= least_move)


#: Columns of the screener's table, whether they are text, and whether they sort downwards at first.
SORTED = {
    "symbol": (True, False), "close": (False, False), "price_chg_today": (False, False), "oi": (False, True), "oi_day_chg": (False, True), "chg_15": (False, True), "chg_30": (False, True),
    "chg_60": (False, True), "accel": (False, True), "trend_label": (True, False), "structure": (True, False), "vol_multiple": (False, False), "direction": (True, False), "param_tier": (False, True),
}


def screener_sort(rows: DataFrame, column: str = "oi_day_chg", descending: bool | None = None) -> DataFrame:
    """The table by one of its columns, in the column's own direction unless told otherwise; what is missing counts as an empty text, so as the least."""
    text, down = SORTED[column]
    value = F.coalesce(column, F.lit("Neutral")) if column == "structure" else F.col(column)
    keys = [F.lower(value), value] if text else [value]
    down = down if descending is None else descending
    return rows.orderBy(*(k.desc_nulls_last() if down else k.asc_nulls_first() for k in keys), *([] if column == "symbol" else ["symbol"]))


def screener_tiles(rows: DataFrame) -> DataFrame:
    count = lambda c, n: F.count_if(c).alias(n)
    kinds = {"Long Buildup": "long_buildup", "Short Buildup": "short_buildup", "Short Covering": "short_covering", "Long Unwinding": "long_unwinding"}
    return rows.agg(*(count(F.col("structure") == k, v) for k, v in kinds.items()), count(yes(F.col("high_conviction")), "high_conviction"), F.count("*").alias("symbols"))


def _or(c: str | Column, text: Column) -> Column:
    """text, or nothing where c is null."""
    return F.when((F.col(c) if isinstance(c, str) else c).isNotNull(), text).otherwise("")


def alert_text(rows: DataFrame, timeframe: str) -> DataFrame:
    """rows with ``alert``, the message of a fresh signal (null without one)."""
    c = F.col
    arrow = F.when(c("fresh_signal") == "Bullish", "\U0001f53a").otherwise("\U0001f53b")
    volume = F.coalesce(F.concat(F.lit("Vol "), c("vol_multiple").cast("string"), F.lit("x")), F.lit("Vol confirmed"))
    head = F.concat(arrow, F.lit(" "), "symbol", F.lit(" - "), "fresh_signal", F.lit(f" confluence on {timeframe} (confirmed: "), volume, _or("htf_direction", F.lit(", higher-timeframe trend agrees")), F.lit(")"))
    state = lambda name, value, side: F.concat(F.lit(f"{name} "), value, F.lit(" ("), side, F.lit(")"))
    values = [F.concat(F.lit("Close: "), c("close").cast("string")), state("RSI", _text("rsi"), c("rsi_state")), state("MACD", c("macd_params"), c("macd_state"))]
    values += [F.concat(F.lit("EMA/BB ("), "ema_bb_state", F.lit(")")), F.concat(F.lit("Aligned "), c("aligned").cast("string"), F.lit("/4"))]
    return rows.withColumn("alert", F.concat(head, F.lit("\n"), F.concat_ws(" | ", *values)))


def _signed(c: str, places: int) -> Column:
    """A number to so many places, which keeps its sign where nothing else is left of it."""
    shown = F.round(F.round(c, 6), places)  # so that halves go up whatever noise is below a millionth
    return F.when((shown == 0) & (F.col(c) < 0), F.lit(-0.0)).otherwise(shown)


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("nan"))


def oi_alert_text(events: DataFrame, timeframe: str) -> DataFrame:
    """events (of the open interest's state, with ``direction``) with ``alert``."""
    c = F.col
    today = _or("oi_chg_today", F.format_string(", %+.1f%% today", _signed("oi_chg_today", 1)))
    fast = _or("accel", F.format_string(" - accel %+.2fpp (30m)", _signed("accel", 2)))
    label = F.coalesce("accel_label", F.lit("Accelerating"))
    parts = [F.lit("\U0001f4c8 "), c("symbol"), F.lit(" OI just started "), label, _or("break_signal", F.concat(F.lit(" - "), "break_signal")), today, fast]
    parts += [_or("direction", F.concat(F.lit(" ("), "direction", F.lit(" confluence)"))), F.lit(f" on {timeframe}")]
    return events.withColumn("alert", F.concat(*parts))


def news_alert_text(news: DataFrame) -> DataFrame:
    """news (symbol, title, source, url, sentiment) with ``alert``."""
    mood = _or("sentiment", F.format_string(" (sentiment %+.2f)", _signed("sentiment", 2)))
    known = lambda c: F.coalesce(c, F.lit("None"))
    return news.withColumn("alert", F.concat(F.lit("\U0001f4f0 "), "symbol", F.lit(": "), known("title"), mood, F.lit("\n"), F.coalesce("source", F.lit("news")), F.lit(" \u2014 "), known("url")))


def scan_digest(rows: DataFrame) -> DataFrame:
    """One text over the usable rows of a scan (with pos, oi, oi_day_high and oi_day_low): bounded by the watchlist."""
    whole = lambda c: F.col(c).cast("long").cast("string")
    days = F.when(F.col("oi_day_low").isNotNull() & F.col("oi_day_high").isNotNull(), F.concat(F.lit(" (day range "), whole("oi_day_low"), F.lit("-"), whole("oi_day_high"), F.lit(")"))).otherwise("")
    parts = [F.lit("- "), F.col("symbol"), F.lit(": close="), F.col("close").cast("string"), F.lit(", RSI="), _text("rsi"), F.lit(" ("), F.col("rsi_state"), F.lit("), MACD "), F.col("macd_params"), F.lit(" (")]
    parts += [F.col("macd_state"), F.lit("), EMA9-vs-BBmid ("), F.col("ema_bb_state"), F.lit("), aligned="), F.col("aligned").cast("string"), F.lit("/4, fresh_signal="), F.coalesce("fresh_signal", F.lit("none"))]
    line = F.concat(*parts, _or("oi", F.concat(F.lit(", OI="), whole("oi"), days)))
    lines = F.transform(F.sort_array(F.collect_list(F.when(F.col("error").isNull(), F.struct("pos", "symbol", line.alias("line"))))), lambda x: x["line"])
    return rows.agg(F.when(F.size(lines) > 0, F.concat_ws("\n", lines)).otherwise("(no usable data in this scan yet)").alias("digest"))


def enrich(rows: DataFrame, p: Params, index: DataFrame, sector_map: DataFrame, directions: DataFrame, weights: DataFrame, setups: DataFrame, oi: DataFrame) -> DataFrame:
    """All of the above in the scan's order: breadth follows direction, not what the filters revoke."""
    out = index_filter(param_tier(rows), index, p)
    out = sector_filter(candle_filter(volume_flow_filter(out, p), p), sector_map, directions, p)
    out = weighted_score(breadth_filter(out, breadth(rows), p), weights)
    out = join_oi_state(join_setup_confidence(out, setups), oi)
    return high_conviction(positional_qualified(out, p))
