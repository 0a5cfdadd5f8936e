"""Session settings and the shared folder used for intermediate tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings that change results or plan quality; they can be set on a running session.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def configure(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def small_batches(spark: SparkSession, most: str = "4m") -> SparkSession:
    """Rows travel to Python in Arrow batches of about ``most`` bytes, whatever the length of their texts.

    Otherwise a batch is 10,000 rows, held several times outside the heap by the executor and its Python worker. The
    setting stays on the session, because the caller executes what is returned; one that it has made itself is kept.
    """
    if spark.conf.get(ARROW_BYTES, None) is None:
        spark.conf.set(ARROW_BYTES, most)
    return spark


def get_spark(master: str = "local[8]", app: str = "labelflow", **conf: str) -> SparkSession:
    """A local session for tests and the benchmark; on a cluster pass your own session."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``, else the session's warehouse folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in this application's own folder, which is removed when the application ends."""
    context = spark.sparkContext
    root = f"{shared_dir(spark)}/labelflow-{context.applicationId}"
    path = context._jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(path)
    return f"{root}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Executions in this block remove their shuffle files when they end, not when the driver collects its garbage."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage, so several later passes read a columnar file (pruned to the columns each pass
    needs) instead of repeating the shuffles behind ``df``; the files outlive any lost executor. The shuffles
    behind ``df`` go when the file is written, so a chain of steps takes the disk of its largest one.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows out over ``spark.labelflow.inputPartitions`` tasks, if the caller sets it.

    For a single file of one row group on a machine with several cores. Unset, as on a cluster, the scan's
    own splits stay and nothing is shuffled.
    """
    n = df.sparkSession.conf.get("spark.labelflow.inputPartitions", None)
    return df.repartition(int(n)) if n else df
