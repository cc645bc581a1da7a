"""Which keys a table holds, looked up by reading few of them.

Keys are stored in buckets by their hash, sorted, with a Bloom filter for each row group. A small batch names
its keys in the filter of the scan: only its buckets are listed, and row groups that cannot hold a key are
not read. A larger batch is joined bucket by bucket, the buckets it does not touch left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.operators.dedup import dedup_exact
from tickerloom.sources import commitlog
from tickerloom.sources.tables import read_table

BUCKETS = 256
#: Keys of a batch that are named in the scan's filter; at most so many reach the driver.
NAMED = 1_000
_THRESHOLD = "spark.sql.parquet.pushdown.inFilterThreshold"


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def add_keys(keys: DataFrame, path: str, batch_id: int, key: str = "article_hash", buckets: int = BUCKETS) -> None:
    """Store a batch's keys; a replayed batch overwrites its own."""
    rows = keys.select(F.col(key).alias("key"), F.lit(batch_id).alias("batch_id"))
    rows = rows.withColumn("bucket", _bucket(F.col("key"), buckets))
    (
        rows.repartition("bucket").sortWithinPartitions("bucket", "key")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .option("parquet.bloom.filter.enabled#key", "true")
        .option("parquet.bloom.filter.expected.ndv#key", str(1 << 15))
        .option("parquet.block.size", str(1 << 20))
        .partitionBy("bucket", "batch_id").parquet(path)
    )


def present(
    batch: DataFrame, path: str, key: str = "article_hash", before: int | None = None,
    buckets: int = BUCKETS, named: int = NAMED,
) -> DataFrame | None:
    """(key) of the batch's keys that the index holds, or held before a batch; none where it is empty."""
    spark = batch.sparkSession
    stored = read_table(spark, path)
    if stored is None:
        return None
    if before is not None:
        stored = stored.filter(F.col("batch_id") < before)
    asked = batch.select(F.col(key).alias("key")).filter("key IS NOT NULL").distinct()
    asked = asked.withColumn("bucket", _bucket(F.col("key"), buckets))
    few = asked.limit(named + 1).collect()
    if len(few) > named:
        return stored.join(asked, ["bucket", "key"], "left_semi").select("key").distinct()
    touched = F.col("bucket").isin(sorted({r.bucket for r in few})) & F.col("key").isin([r.key for r in few])
    found = stored.filter(touched).select("key").distinct()
    was = spark.conf.get(_THRESHOLD)
    # Above the threshold only the range of the keys would reach the scan.
    spark.conf.set(_THRESHOLD, str(named))
    try:
        return found.checkpoint()
    finally:
        spark.conf.set(_THRESHOLD, was)


def insert_absent(batch: DataFrame, path: str, batch_id: int, key: str = "article_hash", buckets: int = BUCKETS) -> bool:
    """Insert rows whose key is not stored, the earliest published of each; whether the batch was new.

    `path/keys` is the index and `path/table` a committed table. Keys go first, under the batch's number: a
    batch that fails in between is written again in full, as it does not meet its own keys.
    """
    spark = batch.sparkSession
    if commitlog.is_committed(spark, f"{path}/table", batch_id):
        return False
    order = F.struct("published_at", "source", "url")
    fresh = dedup_exact(batch.withColumn("__order", order), key, "__order").drop("__order")
    held = present(batch, f"{path}/keys", key, batch_id, buckets)
    if held is not None:
        fresh = fresh.join(held.withColumnRenamed("key", key), key, "left_anti")
    fresh = fresh.checkpoint()
    add_keys(fresh, f"{path}/keys", batch_id, key, buckets)
    return commitlog.append(fresh, f"{path}/table", batch_id)


def read_inserted(spark: SparkSession, path: str) -> DataFrame | None:
    return commitlog.read(spark, f"{path}/table")
