"""The paper-trade journal: resolution against later bars, and what it adds up to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeworks.params import Params

#: Agreements whose worth the journal measures, its export's columns, and what is kept of a signal (name in the snapshot: column).
FACTORS = ("signal_confirmed", "sector_agrees", "breadth_agrees", "candle_agrees", "flow_agrees", "htf_agrees")
EXPORTED = (
    "id", "symbol", "timeframe", "direction", "horizon_bars", "status", "signal_time", "entry_time", "entry_price", "exit_time", "exit_price",
    "return_pct", "mae_pct", "outcome", "cost_pct", "slippage_pct", "logged_at",
)
SNAPSHOT = {
    "rsi": "double", "rsi_state": "string", "macd_state": "string", "ema_bb_state": "string", "aligned": "int",
    "vol_multiple": "double", "vol_confirmed": "boolean", "cmf": "double", "vol_flow_direction": "string",
    "candle_pattern": "string", "candle_direction": "string", "htf_direction": "string", "adx": "double", "regime": "string",
    "signal_confirmed": "boolean", "weighted_score": "double", "in_opening_window": "boolean",
    "sector_agrees": "boolean", "breadth_agrees": "boolean", "candle_agrees": "boolean", "vol_flow_agrees": "boolean", "htf_agrees": "boolean",
    "sector": "string",
}
OURS = {"vol_flow_direction": "flow_direction", "vol_flow_agrees": "flow_agrees"}
LOW_SAMPLE, HORIZON, LONGEST = 5, 10, 100


def log_trades(rows: DataFrame, timeframe: str, horizon_bars: int | None = None, cost_pct: float | None = None, slippage_pct: float | None = None) -> DataFrame:
    """Open trades from signal rows: horizons are brought within 1 to 100 bars, costs to 0 at least; what a row lacks of the snapshot is null.

    Rows without a symbol, a direction or a time aren't logged.
    """
    horizon = max(1, min(HORIZON if horizon_bars is None else int(horizon_bars), LONGEST))
    cost, slippage = (max(0.0, float(x or 0.0)) for x in (cost_pct, slippage_pct))
    have = {c.lower() for c in rows.columns}
    kept = [(F.col(own) if (own := OURS.get(name, name)) in have else F.lit(None)).cast(kind).alias(name) for name, kind in SNAPSHOT.items()]
    factors = [F.col(c) if c in have else F.lit(None).cast("boolean").alias(c) for c in FACTORS]
    key = F.md5(F.concat_ws("|", "symbol", F.lit(timeframe), F.col("ts").cast("string"), "direction").cast("binary"))
    usable = rows.where("symbol is not null and direction in ('Bullish', 'Bearish') and ts is not null")
    return usable.select(
        key.alias("id"), "symbol", F.lit(timeframe).alias("timeframe"), "direction", "aligned", F.lit(horizon).alias("horizon_bars"), F.lit(cost).alias("cost_pct"),
        F.lit(slippage).alias("slippage_pct"), F.col("ts").alias("signal_time"), (F.col("close") if "close" in have else F.lit(None).cast("double")).alias("logged_close"), F.lit("open").alias("status"), *factors, F.struct(*kept).alias("snapshot"),
    )


def delete_trades(journal: DataFrame, ids: DataFrame) -> DataFrame:
    return journal.join(ids.select("id"), "id", "left_anti")


def forward_resolve(trades: DataFrame, bars: DataFrame) -> DataFrame:
    """Trades with entry, exit, net return, mae and status; those without enough later bars stay open.

    Each bar carries what a trade entered at its open would have come to, for each horizon that occurs (100 at most).
    Trades and bars are merged by one window in the order of time, backwards, in which a trade's entry bar is the last
    bar before it; so there is no range join and no row for each bar of a trade.
    """
    keys = ["symbol", "timeframe"]
    horizons = sorted(r.h for r in trades.select(F.col("horizon_bars").alias("h")).distinct().collect() if r.h is not None)  # log_trades allows 1 to 100
    w = Window.partitionBy(*keys).orderBy("ts")
    ends = [F.struct(F.lead("close", h).over(w).alias("close"), F.lead("ts", h).over(w).alias("ts"), F.min("low").over(w.rowsBetween(0, h)).alias("low"), F.max("high").over(w.rowsBetween(0, h)).alias("high")) for h in horizons]
    if not ends:
        ends = [F.struct(*(F.lit(None).cast(t).alias(c) for c, t in (("close", "double"), ("ts", "timestamp_ntz"), ("low", "double"), ("high", "double"))))]
    marks = bars.select(*keys, F.col("ts").alias("at"), F.lit(0).alias("trade"), F.struct("open", "ts", F.array(*ends).alias("ends")).alias("bar"))
    own = trades.select(*keys, F.col("signal_time").alias("at"), F.lit(1).alias("trade"), F.struct(*trades.columns).alias("t"))
    later = Window.partitionBy(*keys).orderBy(F.col("at").desc(), F.col("trade").desc()).rowsBetween(Window.unboundedPreceding, -1)
    met = marks.unionByName(own, allowMissingColumns=True).withColumn("e", F.last("bar", ignorenulls=True).over(later)).where("trade = 1")
    t = met.select("t.*", F.round("e.open", 2).alias("entry_price"), F.col("e.ts").alias("entry_time"), F.get("e.ends", F.array_position(F.array(*map(F.lit, horizons or [0])), F.col("t.horizon_bars")).cast("int") - 1).alias("x"))
    sign = F.when(F.col("direction") == "Bullish", 1.0).otherwise(-1.0)
    price, done = F.nullif("entry_price", F.lit(0.0)), F.col("x.close").isNotNull()
    value = F.round(sign * (F.col("x.close") - price) / price * 100 - (F.col("cost_pct") + 2 * F.col("slippage_pct")), 3)
    adverse = F.when(F.col("direction") == "Bullish", F.col("x.low")).otherwise(F.col("x.high"))
    t = t.withColumns({"exit_price": F.when(done, F.round("x.close", 2)), "exit_time": F.when(done, F.col("x.ts")), "return_pct": F.when(done, value)})
    t = t.withColumn("mae", F.when(done, F.round(F.least(sign * (adverse - price) / price * 100, F.lit(0.0)), 3) + F.lit(0.0)))
    return t.withColumn("status", F.when(F.col("return_pct").isNotNull(), "resolved").otherwise("open")).withColumn("win", F.col("return_pct") > 0).drop("x")


def export_rows(journal: DataFrame) -> DataFrame:
    """The 17 columns of a journal's export, newest first; what the journal doesn't have yet is null."""
    own = journal.withColumn("mae_pct", F.col("mae")).withColumn("outcome", F.when(F.col("win"), "win").when(~F.col("win"), "loss")) if "mae" in journal.columns else journal
    have = {c: F.col(c) for c in own.columns}
    return newest_first(own).select(*(have.get(c, F.lit(None).cast("string")).alias(c) for c in EXPORTED))


def export_csv(journal: DataFrame, folder: str) -> None:
    """The export as CSV with a header, newest first: the parts follow each other in the order of their names."""
    export_rows(journal).write.mode("overwrite").option("header", True).option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss").csv(folder)


def read_csv(spark: SparkSession, folder: str) -> DataFrame:
    """An export as a table of its columns."""
    numbers, times = {"horizon_bars": "int"}, ("signal_time", "entry_time", "exit_time", "logged_at")
    kind = lambda c: numbers.get(c) or ("timestamp_ntz" if c in times else "double" if c.endswith(("_pct", "_price")) else "string")
    schema = ", ".join(f"{c} {kind(c)}" for c in EXPORTED)
    return spark.read.schema(schema).option("header", True).option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss").csv(folder)


def _stats() -> list:
    return [F.count("*").alias("trades"), F.round(F.avg((F.col("return_pct") > 0).cast("double")) * 100, 1).alias("win_rate"), F.round(F.avg("return_pct"), 3).alias("avg_return")]


def scoreboard(journal: DataFrame) -> DataFrame:
    """Resolved trades in all and by direction, with the number of open ones."""
    out = journal.groupingSets([[], ["direction"]], "direction").agg(
        F.count_if(F.col("status") == "open").alias("open"),
        F.count_if(F.col("status") == "resolved").alias("trades"),
        F.round(F.avg(F.when(F.col("status") == "resolved", (F.col("return_pct") > 0).cast("double"))) * 100, 1).alias("win_rate"),
        F.round(F.avg(F.when(F.col("status") == "resolved", F.col("return_pct"))), 3).alias("avg_return"),
    )
    return out.withColumn("grp", F.coalesce(F.lower("direction"), F.lit("all"))).select("grp", "open", "trades", "win_rate", "avg_return")


def confidence_by_setup(journal: DataFrame) -> DataFrame:
    out = journal.where("status = 'resolved' and aligned between 2 and 4").groupBy("direction", "aligned").agg(*_stats())
    return out.withColumn("low_sample", F.col("trades") < LOW_SAMPLE).orderBy(F.col("trades").desc(), "direction", "aligned")


def confidence_by_factor(journal: DataFrame) -> DataFrame:
    long = journal.where("status = 'resolved'").select("return_pct", F.explode(F.create_map(*(x for f in FACTORS for x in (F.lit(f), F.col(f))))).alias("factor", "value"))
    return long.where("value is not null").groupBy("factor", "value").agg(*_stats()).withColumn("low_sample", F.col("trades") < LOW_SAMPLE)


def setup_confidence(journal: DataFrame) -> DataFrame:
    return confidence_by_setup(journal).where(F.col("trades") >= LOW_SAMPLE)


def risk_budget(journal: DataFrame, sector_map: DataFrame, today, p: Params) -> DataFrame:
    """One row: trades and risk of the day, open positions, their limits and whether they are exceeded, and the sectors with two or more of the day's trades."""
    own = journal.agg(F.count_if(F.to_date("logged_at") == today).alias("trades_today"), F.count_if(F.col("status") == "open").alias("open_positions"))
    sectors = sector_concentration(journal, sector_map, today).agg(F.array_sort(F.collect_list("sector")).alias("concentrated_sectors"))  # one row
    out = own.withColumn("committed_risk_pct", F.round(F.col("trades_today") * p.risk_pct, 2))
    limits = {"max_daily_risk_pct": p.max_daily_risk_pct, "max_concurrent_positions": p.max_positions, "risk_per_trade_pct": p.risk_pct, "account_capital": p.capital}
    out = out.withColumns({k: F.lit(v) for k, v in limits.items()})
    out = out.withColumn("risk_budget_exceeded", F.col("committed_risk_pct") > p.max_daily_risk_pct).withColumn("position_limit_exceeded", F.col("open_positions") > p.max_positions)
    return out.crossJoin(sectors)


def sector_concentration(journal: DataFrame, sector_map: DataFrame, today) -> DataFrame:
    own = journal.where(F.to_date("logged_at") == today).join(sector_map, "symbol")
    return own.groupBy("sector").agg(F.count("*").alias("trades")).where("trades >= 2")


def newest_first(journal: DataFrame) -> DataFrame:
    return journal.orderBy(F.col("logged_at").desc(), "id")
