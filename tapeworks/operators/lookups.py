"""Instrument lookups and the joins of a scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeworks.sources.market import INDEX_NAMES


def equity_instruments(instruments: DataFrame) -> DataFrame:
    return instruments.where("segment = 'NSE'").select(F.col("tradingsymbol").alias("symbol"), "instrument_token")


def futures_universe(instruments: DataFrame, index_names: DataFrame) -> DataFrame:
    """Distinct names of futures but for indices (a table with a column name); an anti join."""
    own = instruments.where("instrument_type = 'FUT'").select(F.trim("name").alias("name"), F.upper(F.trim("name")).alias("__key")).distinct()
    return own.join(F.broadcast(index_names.select(F.upper("name").alias("__key"))), "__key", "left_anti").select("name").orderBy("name")


def index_names(instruments: DataFrame) -> DataFrame:
    spark = instruments.sparkSession
    return spark.createDataFrame([(n,) for n in INDEX_NAMES], "name string")


def _nearest(instruments: DataFrame, today: Column) -> DataFrame:
    """For each underlying the future with the nearest expiry from today on; the first row of the dump wins ties."""
    own = instruments.where("instrument_type = 'FUT' and trim(name) <> ''").where(F.col("expiry") >= today)
    own = own.groupBy(F.trim("name").alias("name")).agg(F.min_by(F.struct("tradingsymbol", "instrument_token", "expiry"), F.struct("expiry", "row_id")).alias("x"))
    return own.select("name", "x.*")


def near_month_contract(instruments: DataFrame, today: Column) -> DataFrame:
    """The nearest future of each stock; indices are left out."""
    return _nearest(instruments.where(~F.upper(F.trim("name")).isin(*INDEX_NAMES)), today)


def index_future_contract(instruments: DataFrame, today: Column, index: str) -> DataFrame:
    return _nearest(instruments.where(F.upper(F.trim("name")) == index.upper()), today)


def index_lookup(instruments: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (exchange, tradingsymbol) with its token, whatever the segment."""
    return wanted.join(instruments.select("exchange", "tradingsymbol", "instrument_token"), ["exchange", "tradingsymbol"])


def join_instruments(watchlist: DataFrame, equities: DataFrame) -> DataFrame:
    out = watchlist.join(equities, "symbol", "left")
    return out.withColumn("error", F.when(F.col("instrument_token").isNull(), "symbol not found"))


def oi_quotes(samples: DataFrame, contracts: DataFrame) -> DataFrame:
    """Quotes of the contracts: the last open interest, and its range on the last day."""
    known = samples.where("oi is not null").withColumn("day", F.to_date("ts"))
    days = known.groupBy("symbol", "day").agg(F.max_by("oi", "ts").alias("oi"), F.max("oi").alias("oi_day_high"), F.min("oi").alias("oi_day_low"))
    last = days.groupBy("symbol").agg(F.max_by(F.struct("oi", "oi_day_high", "oi_day_low"), "day").alias("x"))
    return last.join(contracts, F.col("symbol") == F.col("name")).select("tradingsymbol", "x.oi", "x.oi_day_high", "x.oi_day_low")


def oi_snapshot(watchlist: DataFrame, contracts: DataFrame, quotes: DataFrame) -> DataFrame:
    """Open interest of each symbol through its contract; symbols without one are left out."""
    return watchlist.join(contracts, F.col("symbol") == F.col("name")).join(quotes, "tradingsymbol").select("symbol", "oi", "oi_day_high", "oi_day_low")


def join_oi(rows: DataFrame, snapshot: DataFrame) -> DataFrame:
    return rows.join(snapshot, "symbol", "left")
