"""News articles: read from files, flattened by entity, kept to the symbols in scope, deduplicated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fields of an article, and suffixes of its exchanges.
ARTICLE = "struct<uuid:string,title:string,url:string,source:string,published_at:string,entities:array<struct<symbol:string,sentiment_score:double>>>"
EXCHANGES = (".NS", ".BO")
FETCH = f"fetched_at timestamp, data array<{ARTICLE}>, bad string"
FIELDS = ("uuid", "title", "url", "source", "published_at")


def read_fetches(spark: SparkSession, folder: str, stream: bool = False) -> DataFrame:
    """The JSON lines of a folder, a fetch each, by a fixed schema; a line that isn't one is kept whole in ``bad``."""
    reader = (spark.readStream if stream else spark.read).schema(FETCH).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "bad")
    return reader.json(folder)


def bad_lines(fetches: DataFrame) -> DataFrame:
    """The lines that couldn't be read.  Spark reads them only together with a column of the schema, hence fetched_at."""
    return fetches.where("bad is not null").select("fetched_at", "bad")


def article_scan(fetches: DataFrame) -> DataFrame:
    """The articles of the fetches that could be read, with their place in the feed (place: later fetches rank first, then the order within one)."""
    own = fetches.where("bad is null").select("fetched_at", F.posexplode("data").alias("i", "a"))
    return own.select("fetched_at", "a.*", F.struct((-F.unix_micros("fetched_at")).alias("fetch"), F.col("i")).alias("place"))


def bare_symbol(symbol: Column) -> Column:
    """A symbol of one of the exchanges without its suffix, upper case; null for any other."""
    own = F.upper(symbol)
    ours = own.endswith(EXCHANGES[0]) | own.endswith(EXCHANGES[1])
    return F.when(ours, F.substring(own, F.lit(1), F.length(own) - len(EXCHANGES[0])))


def news_flatten(articles: DataFrame, scope: DataFrame) -> DataFrame:
    """A row for each article and entity whose symbol is in scope; articles have ``place``, their order in the feed."""
    long = articles.select(*FIELDS, "place", F.explode("entities").alias("e"))
    long = long.select(*FIELDS, "place", bare_symbol(F.col("e.symbol")).alias("symbol"), F.col("e.sentiment_score").alias("sentiment"))
    return long.join(scope.select("symbol").distinct(), "symbol", "left_semi")


def confirmed_scope(rows: DataFrame) -> DataFrame:
    """The symbols of a scan whose signal is confirmed: those that news is kept for."""
    return rows.where("error is null and signal_confirmed").select("symbol")


def news_dedupe(flat: DataFrame, scope: DataFrame) -> DataFrame:
    """One row for each article: its first symbol in the order of the watchlist.  Articles without an id are left out."""
    ranked = flat.where("uuid is not null").join(scope.select("symbol", "pos"), "symbol")
    return ranked.groupBy("uuid").agg(F.min_by(F.struct("symbol", "title", "url", "source", "published_at", "sentiment"), "pos").alias("x")).select("uuid", "x.*")


def news_top(cache: DataFrame, n: int = 3) -> DataFrame:
    """(symbol, rank, uuid, title, ...): the first n articles of each symbol's list, in the order of the feed."""
    return cache.select("symbol", F.posexplode(F.slice("articles", 1, n)).alias("i", "a")).select("symbol", (F.col("i") + 1).alias("rank"), "a.*")


def join_news(rows: DataFrame, top: DataFrame) -> DataFrame:
    lists = top.groupBy("symbol").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "title"))), lambda x: x["title"]).alias("news"))
    return rows.join(lists, "symbol", "left")


def lists_by_symbol(fetches: DataFrame) -> DataFrame:
    """(symbol, fetched_at, articles): the list of each fetch for each symbol that it names, made within the row of the fetch."""
    names = F.array_distinct(F.flatten(F.transform("data", lambda a: F.transform(F.coalesce(a["entities"], F.array()), lambda e: bare_symbol(e["symbol"])))))
    own = fetches.where("bad is null").select("fetched_at", "data", F.explode(F.array_compact(names)).alias("symbol"))
    names_it = lambda a: F.exists(F.coalesce(a["entities"], F.array()), lambda e: bare_symbol(e["symbol"]) == F.col("symbol"))
    short = lambda a: F.struct(*(a[c].alias(c) for c in FIELDS), F.filter(a["entities"], lambda e: bare_symbol(e["symbol"]) == F.col("symbol"))[0]["sentiment_score"].alias("sentiment"))
    return own.select("symbol", "fetched_at", F.transform(F.filter("data", names_it), short).alias("articles"))


def news_cache(lists: DataFrame) -> DataFrame:
    """Each symbol's list of the latest fetch that names it, which replaces the ones before; lists as those of lists_by_symbol."""
    return lists.groupBy("symbol").agg(F.max("fetched_at").alias("fetched_at"), F.max_by("articles", "fetched_at").alias("articles"))


def alert_dedupe(alerts: DataFrame) -> DataFrame:
    """One alert for each symbol, timeframe, bar and fresh signal of the rows that deserve one."""
    return deserving(alerts).dropDuplicates(["symbol", "timeframe", "ts", "fresh_signal"])


def deserving(rows: DataFrame) -> DataFrame:
    return rows.where("fresh_signal is not null and vol_confirmed and htf_agrees")


def newest(events: DataFrame, n: int = 20, kept: int = 100) -> DataFrame:
    return events.orderBy(F.col("ts").desc(), "symbol").limit(min(n, kept))
