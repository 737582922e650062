"""Published scans: a version is visible once its pointer is written, which comes last.

Rows lie by date and version.  A writer that dies before the pointer leaves rows that no reader looks at and that the next
``compact`` removes; a reader takes the newest pointer and reads the folders of that version alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_POINTER = "version string, date string, rows long"


def _path(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def write_rows(rows: DataFrame, folder: str, version: str) -> int:
    """The rows of a version, not yet visible; returns their number.  version: a time that sorts, such as 2024-01-29T1003."""
    path = f"{folder}/rows/date={version[:10]}/scan={version}"
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path).count()


def commit(spark: SparkSession, folder: str, version: str, rows: int) -> None:
    """Makes a version visible."""
    one = spark.createDataFrame([(version, version[:10], rows)], _POINTER)
    one.coalesce(1).write.mode("overwrite").parquet(f"{folder}/pointers/at={version}")  # one row; visible when its job commits


def publish(rows: DataFrame, folder: str, version: str) -> None:
    """Result sink: a scan's rows as a version; publishing it again replaces it."""
    commit(rows.sparkSession, folder, version, write_rows(rows, folder, version))


def versions(spark: SparkSession, folder: str) -> list[str]:
    """Visible versions, oldest first."""
    fs, at = _path(spark, f"{folder}/pointers")
    if not fs.exists(at):
        return []
    done = [s.getPath() for s in fs.listStatus(at) if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return sorted(p.getName().removeprefix("at=") for p in done)


def published(spark: SparkSession, folder: str) -> DataFrame:
    """Result source: the rows of the newest visible version, with its name as scan."""
    found = versions(spark, folder)
    if not found:
        raise LookupError(f"nothing is published in {folder}")
    return spark.read.parquet(f"{folder}/rows/date={found[-1][:10]}/scan={found[-1]}").withColumn("scan", F.lit(found[-1]))


def compact(spark: SparkSession, folder: str, keep: int = 2) -> list[str]:
    """Drops all but the newest visible versions, and rows that were never made visible and are older than those; returns what went."""
    found = versions(spark, folder)
    kept, gone = set(found[-keep:]), []
    fs, at = _path(spark, f"{folder}/rows")
    for day in fs.listStatus(at) if fs.exists(at) else []:
        for s in fs.listStatus(day.getPath()):
            version = s.getPath().getName().removeprefix("scan=")
            if version not in kept and kept and version < max(kept):
                fs.delete(_path(spark, f"{folder}/pointers/at={version}")[1], True)  # first the pointer: a reader never follows it to nothing
                fs.delete(s.getPath(), True)
                gone.append(version)
    return sorted(gone)
