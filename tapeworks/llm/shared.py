"""The folder all executors share, and lineage cuts in it."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def use_shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``, or the one set for its context (tests do that)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder


#: Rows of an Arrow batch; ten times as many are Spark's default, which texts make far larger than a worker should hold.
BATCH_ROWS = 1000


def small_batches(df: DataFrame) -> DataFrame:
    """df, once its session's Arrow batches are no longer than BATCH_ROWS."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, BATCH_ROWS)
    return df


def cut(df: DataFrame) -> DataFrame:
    """df computed once: a table written to the shared folder, where lost executors don't matter, and read again.

    A table also has sizes that Spark knows, while a checkpoint keeps the estimates of its plan, which joins multiply.
    The table stays until it is dropped or the application ends, as results may still read it.
    """
    path = f"{use_shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    drop_at_end(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_at_end(spark: SparkSession, path: str) -> None:
    """Has a folder deleted when the application ends."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)


def cut_counted(df: DataFrame, *metrics: Column) -> tuple[DataFrame, dict]:
    """As cut, with aggregates (named columns) over df's rows that the same job finds."""
    seen = Observation()
    out = cut(df.observe(seen, *metrics))
    return out, seen.get


def drop_cut(df: DataFrame) -> None:
    """Removes the table that cut has written for df; nothing may read it later."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, *wanted: str) -> list[str]:
    """Column names near the wanted ones that df does not have, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for w in wanted:
        while w.lower() in taken:
            w = f"_{w}"
        taken.add(w.lower())
        out.append(w)
    return out
