"""Session settings and the shared folder for checkpoints and written tables."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(cpus: int | str = "*", app: str = "tickerloom") -> SparkSession:
    """Local session for tests and the bench; a cluster brings its own."""
    parallel = str(cpus) if cpus != "*" else "8"
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", parallel)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.files.maxPartitionBytes", "4m")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        # Recording a Python call site for every column operator makes plans slow to write.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        # Checkpoint files go when nothing refers to them any more.
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the time zone; name a checkpoint folder only where the cluster named none."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tickerloom-"))
    return spark


def shared_dir(spark: SparkSession, *parts: str) -> str:
    """A path for tables of this application below the shared folder."""
    prepare(spark)
    named = spark.conf.get("spark.checkpoint.dir", None)
    base = named or spark.sparkContext.getCheckpointDir()
    return "/".join([base.rstrip("/"), "tickerloom", spark.sparkContext.applicationId, *parts])


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within, a job's shuffle files go when the job ends, not when the driver next collects its garbage.

    For chains of checkpoints, where nothing reads them again. A frame that is run twice makes its files again.
    The setting holds for the session while the block lasts; frames returned from it run by the caller's.
    """
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def spread(df: DataFrame) -> DataFrame:
    """Give every core a share of an input with fewer splits than cores.

    Inputs with enough splits, as any large table has, are left as they are: no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def spread_stored(df: DataFrame) -> DataFrame:
    """The same for a table just read from files, where splits may be empty.

    A lone file with one row group is read by one task, however many splits it has. The splits that
    hold rows are counted, which reads the files' footers only.
    """
    cores, splits = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    if splits < cores or df.select(F.spark_partition_id()).distinct().count() >= cores:
        return spread(df)
    # By hash: dealing rows out in turn would sort them first, in the few tasks that have them.
    return df.repartition(splits, F.xxhash64(*df.columns))
