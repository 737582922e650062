"""Connected components of links between long ids, without collecting any of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.llm.shared import cut, cut_counted, drop_cut


def parted_anew(df: DataFrame, key: str) -> DataFrame:
    """df with its key as a new expression, so that a join on it shuffles both sides and can split a hot key."""
    return df.withColumn(key, F.col(key).bitwiseXOR(F.lit(0).cast("long")))


def _least(edges: DataFrame, name: str) -> DataFrame:
    """The smallest v of each u, with u under another name."""
    return parted_anew(edges.select(F.col("u").alias(name), "v").groupBy(name).agg(F.min("v").alias("m")), name)


def _neighbours(e: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """The edges both ways; a table (large, m) of each node's smallest neighbour; how many nodes keep the edges from being stars about their smallest node."""
    ways = F.explode(F.array(F.struct(F.col("u"), F.col("v")), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))))
    both = e.select(ways.alias("e")).select(F.col("e.u").alias("u"), F.col("e.v").alias("v"))
    least = both.groupBy(F.col("u").alias("large")).agg(F.min("v").alias("m"), F.count("*").alias("n"))
    least, seen = cut_counted(least, F.count_if((F.col("m") < F.col("large")) & (F.col("n") > 1)).alias("open"))
    return both, least.drop("n"), seen["open"]


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, comp) for every id in the links; comp is the smallest id of its component.

    Alternates the large-star and small-star steps: the number of rounds grows with the logarithm of a component's
    size, and each node of it costs a row a round.  They end once no node with a smaller neighbour has another one, which the table of smallest
    neighbours shows.  Links to null or to itself are left out.
    """
    e = cut(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    while True:
        both, least, still_open = _neighbours(e)
        if not still_open:
            drop_cut(least)
            break
        large = parted_anew(least, "large").hint("merge")  # no broadcasts: rounds are many, and each would hold memory of the driver
        down = both.join(large, both.u == large.large).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        down = down.distinct()  # every edge goes from u to a smaller v
        small = _least(down, "small").hint("merge")
        on = down.join(small, down.u == small.small).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = cut(on.unionByName(small.select(F.col("small").alias("u"), F.col("m").alias("v"))).distinct())
        drop_cut(e)
        drop_cut(least)
        e = new
    own = e.select(F.col("u").alias("id"), F.col("v").alias("comp"))
    return own.unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct())
