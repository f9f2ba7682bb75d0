"""Session settings and reliable checkpoints.

Nothing here picks a physical strategy by hand: adaptive execution coalesces shuffles, splits
skewed join partitions and decides on broadcasts from measured sizes.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot join key even where that costs one more shuffle afterwards
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # rows take over 20 times their compressed size where a task sorts and aggregates them: small parts bound
    # its memory, and there are enough of them for shuffles of 16 GB
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "1000",
    "spark.sql.files.maxPartitionBytes": "32m",
    "spark.sql.session.timeZone": "UTC",
}

# only a new session can take these: a wide report compiles more classes than the default cache holds
STATIC = {"spark.sql.codegen.cache.maxEntries": "2000"}


def build_session(app: str = "partner_analytics", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings above; ``master=None`` keeps what spark-submit chose."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**STATIC, **SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Apply the settings to a session somebody else built; they stay set, the UTC time zone included."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so that lost executors cost nothing.

    The folder comes from ``spark.checkpoint.dir``. Only a local master, where driver and executors
    share one disk, may fall back to a temporary folder.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can write to."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="run-")
