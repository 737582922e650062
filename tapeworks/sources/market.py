"""Market tables, derived from the star-schema test tables so that they grow with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Names of futures whose underlying is an index.
INDEX_NAMES = (
    "NIFTY", "BANKNIFTY", "FINNIFTY", "MIDCPNIFTY", "NIFTYNXT50",
    "NIFTY NEXT 50", "SENSEX", "BANKEX", "NIFTYIT", "NIFTY IT",
)
#: Articles of a fetch.
FETCH = 50


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    sgn = F.when(F.col("event_type").isin("signup", "purchase"), 1).when(F.col("event_type") == "error", -1).otherwise(0)
    return e.select(
        F.concat(F.lit("S"), (F.col("user_id") % 10).cast("string")).alias("symbol"),
        "event_id",
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        F.col("value").alias("price"),
        (F.get_json_object("props", "$.k").cast("long") + 1).alias("qty"),
        sgn.alias("sgn"),
    )


def order_ticks(spark: SparkSession, sf_dir: str, hours: bool = False) -> DataFrame:
    """Ticks of the long history: one for each order."""
    o = read(spark, sf_dir, "orders")
    ts = F.col("o_orderdate").cast("timestamp_ntz")
    if hours:
        ts = ts + F.make_dt_interval(hours=(F.col("o_orderkey") % 24).cast("int"))
    return o.select(
        F.concat(F.lit("S"), (F.col("o_custkey") % 10).cast("string")).alias("symbol"),
        F.col("o_orderkey").alias("event_id"),
        ts.alias("ts"),
        F.col("o_totalprice").alias("price"),
        F.lit(1).cast("long").alias("qty"),
        F.lit(0).alias("sgn"),
    )


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sector_map: S<i> is in the region of nation i; S9 has no sector."""
    n = read(spark, sf_dir, "nation").where("n_nationkey < 9")
    return n.join(F.broadcast(read(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat(F.lit("S"), F.col("n_nationkey").cast("string")).alias("symbol"), F.col("r_name").alias("sector"))


def watchlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S0 to S9 by position, and SX, of which there is no instrument."""
    n = read(spark, sf_dir, "nation").where("n_nationkey <= 10")
    name = F.when(F.col("n_nationkey") == 10, "SX").otherwise(F.concat(F.lit("S"), F.col("n_nationkey").cast("string")))
    return n.select(F.col("n_nationkey").cast("int").alias("pos"), name.alias("symbol"))


def instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every eleventh part is an instrument of an index, of each in turn; row_id is the place in the dump, which lists the newest first."""
    p = read(spark, sf_dir, "part")
    key = F.col("p_partkey")
    index = F.lower(F.element_at(F.array(*map(F.lit, INDEX_NAMES)), (F.floor(key / 11) % len(INDEX_NAMES) + 1).cast("int")))
    name = F.when(key % 11 == 0, index).otherwise(F.concat(F.lit("S"), (key % 10).cast("string")))
    future = key % 3 == 0
    return p.select(
        F.when(future, "NFO").otherwise("NSE").alias("exchange"),
        F.when(future, "NFO-FUT").otherwise("NSE").alias("segment"),
        F.when(future, "FUT").otherwise("EQ").alias("instrument_type"),
        F.concat(F.lit(" "), name, F.lit(" ")).alias("name"),
        F.when(future, F.concat(name, F.lit("-"), key.cast("string"))).otherwise(F.concat(name, F.when(key >= 30, F.concat(F.lit("_"), key.cast("string"))).otherwise(""))).alias("tradingsymbol"),
        key.alias("instrument_token"),
        F.date_add(F.lit("2024-01-25").cast("date"), (28 * (F.col("p_size") % 3)).cast("int")).alias("expiry"),
        (-key).alias("row_id"),
    )


def oi_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open interest at the last tick of each 3 minutes; every 50th sample of a symbol is blank."""
    w = Window.partitionBy("symbol").orderBy("ts", "event_id")
    t = ticks(spark, sf_dir).withColumn("oi", 2000.0 + F.sum(F.col("sgn") * F.col("qty")).over(w))
    t = t.withColumn("bin", F.window("ts", "3 minutes").start)
    s = t.groupBy("symbol", "bin").agg(F.max_by(F.struct("ts", "oi", "price"), F.struct("ts", "event_id")).alias("x"))
    s = s.select("symbol", F.col("x.ts").alias("ts"), F.col("x.oi").alias("oi"), F.col("x.price").alias("close"))
    n = F.row_number().over(Window.partitionBy("symbol").orderBy("ts"))
    return s.withColumn("oi", F.when(n % 50 != 0, F.col("oi")))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles in the order of the feed (pos), in fetches of so many: an article of each document."""
    labels = read(spark, sf_dir, "labels").select("doc_id", "quality")
    d = read(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    sentiment = F.coalesce(F.col("quality") * 1.0, F.lit(0.0))
    number = lambda c: c.cast("string")

    def entity(prefix: str, n: Column, suffix: str) -> Column:
        return F.struct(F.concat(F.lit(prefix), number(n), F.lit(suffix)).alias("symbol"), sentiment.alias("sentiment_score"))

    uuid = F.md5(number(F.col("doc_id")).cast("binary"))
    return d.select(
        uuid.alias("uuid"),
        F.substring("text", 1, 80).alias("title"),
        F.concat(F.lit("https://news.example/"), number(F.col("doc_id"))).alias("url"),
        "source",
        F.date_format(F.timestamp_seconds(1706500000 + 60 * F.col("doc_id")), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("published_at"),
        "doc_id",
        (-F.col("doc_id")).alias("pos"),
        F.floor(F.col("doc_id") / FETCH).alias("fetch"),
        F.array(entity("S", F.col("doc_id") % 10, ".NS"), entity("S", (F.col("doc_id") + 3) % 10, ".BO"), entity("X", F.col("doc_id") % 7, ".US"), entity("S", (F.col("doc_id") + 5) % 10, "")).alias("entities"),
    )


def fetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fetched_at, data): what each fetch returned, a list of articles in the order of the feed."""
    fields = ("uuid", "title", "url", "source", "published_at", "entities")
    one = articles(spark, sf_dir).groupBy("fetch").agg(F.sort_array(F.collect_list(F.struct("pos", *fields))).alias("data"))
    bare = F.transform("data", lambda a: F.struct(*(a[c].alias(c) for c in fields)))
    return one.select(F.timestamp_seconds(1706500000 + 3600 * F.col("fetch")).alias("fetched_at"), bare.alias("data"))
