"""Stages and sinks."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stage(df: DataFrame, name: str, reuse: bool = False) -> DataFrame:
    """Name an intermediate for SQL use; ``reuse`` keeps it in memory for several consumers."""
    kept = df.persist() if reuse else df
    kept.createOrReplaceTempView(name)
    return kept


def _versions(spark: SparkSession, path: str, whole: bool = True) -> list[str]:
    """Names of the version folders of a table in order; of whole ones only, or of broken ones too."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root):
        return []
    names = sorted(s.getPath().getName() for s in files.listStatus(root) if s.getPath().getName().startswith("version-"))
    # Spark's committer writes the mark after the last task: its file is the switch
    return [n for n in names if not whole or files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]


def write_replace(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Drop and create: readers find exactly the given rows once all of them are written.

    Rows go to a new version folder of the table. A version counts from the moment Spark marks its job
    as done, in one step, so a failed write leaves the old rows in place, and ``df`` may read the table
    it replaces. Old versions stay for readers at work until ``drop_old`` takes them away.
    """
    last = _versions(df.sparkSession, path, whole=False)[-1:]
    number = int(last[0].split("-")[1]) + 1 if last else 0
    writer = df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{path}/version-{number:09d}-{uuid4().hex[:8]}")


def truncate_insert(df: DataFrame, path: str, partition_by: list[str]) -> None:
    """Empty the table and insert: only the given rows are left, in the table's columns and layout.

    The switch is that of ``write_replace``: where the insert fails, the table isn't empty but as before.
    """
    table = read_back(df.sparkSession, path).schema
    write_replace(df.select(*[F.col(f.name).cast(f.dataType) for f in table]), path, partition_by)


def drop_old(spark: SparkSession, path: str) -> None:
    """Delete all versions before the newest whole one, broken ones included."""
    newest = _versions(spark, path)[-1:]
    for name in _versions(spark, path, whole=False) if newest else []:
        if name < newest[0]:
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)


def write_partitions(df: DataFrame, path: str, partition_by: list[str]) -> None:
    """Replace only the partitions present in ``df``; other partitions keep their rows."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        *partition_by).parquet(path)


def write_csv(df: DataFrame, path: str, null: str = " ") -> None:
    """CSV with header; every value quoted, NULL as a blank."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit(null)).alias(c) for c in df.columns]
    writer = df.select(*text).write.mode("overwrite").option("header", True).option("quoteAll", True)
    # the writer would trim the blank away
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """The newest whole version of a table."""
    versions = _versions(spark, path)
    if not versions:
        raise FileNotFoundError(f"no table in {path}")
    return spark.read.parquet(f"{path}/{versions[-1]}")
