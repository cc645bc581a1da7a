"""The result table: date-partitioned Parquet, one row per article hash, first write wins."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.operators.dedup import dedup_exact
from tickerloom.schemas import SENTIMENT_RESULT

PARTITION = "published_date"


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The table with its partition column, or none where nothing was written yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def append_by_date(results: DataFrame, path: str) -> None:
    """Append under the publish date.

    The rebalance hint lets adaptive execution merge small and split large date partitions, so a
    day with a third of all rows is written by many tasks.
    """
    dated = results.withColumn(PARTITION, F.to_date("published_at"))
    dated.hint("rebalance", PARTITION).write.mode("append").partitionBy(PARTITION).parquet(path)


def absent_only(
    batch: DataFrame, table: DataFrame | None, key: str = "article_hash"
) -> DataFrame:
    """Rows of a batch, one per hash (earliest published), whose hash the table does not hold.

    The hash covers headline and URL but not the time, so the whole key column is compared; only
    that column of the table is read. The table's keys are first reduced to those of the batch:
    a micro-batch small enough for a broadcast is then looked up without shuffling the table.
    The batch is read twice; hold it where it is costly to compute.
    """
    order = F.struct("published_at", "source", "url")
    first = dedup_exact(batch.withColumn("__order", order), key, "__order").drop("__order")
    if table is None:
        return first
    stored = table.select(F.col("article_hash").alias(key))
    present = stored.join(batch.select(key), key, "left_semi")
    return first.join(present, key, "left_anti")


def write_results(batch: DataFrame, path: str) -> None:
    """Insert if absent; safe to repeat with the same batch."""
    held = batch.persist()
    try:
        append_by_date(absent_only(held, read_table(batch.sparkSession, path)), path)
    finally:
        held.unpersist()


def flatten_for_text_store(results: DataFrame) -> DataFrame:
    """Arrays as JSON text, flags as 0 and 1, times as ISO text."""
    columns = []
    for field in results.schema.fields:
        kind = field.dataType.simpleString()
        c = F.col(field.name)
        if kind.startswith("array"):
            c = F.to_json(c)
        elif kind == "boolean":
            c = c.cast("int")
        elif kind == "timestamp":
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
        columns.append(c.alias(field.name))
    return results.select(*columns)


def restore_from_text_store(flat: DataFrame) -> DataFrame:
    """The inverse; null or empty array text is an empty array."""
    kinds = {f.name: f.dataType for f in SENTIMENT_RESULT.fields}
    columns = []
    for name in flat.columns:
        kind = kinds.get(name)
        text = "" if kind is None else kind.simpleString()
        c = F.col(name)
        if text.startswith("array"):
            c = F.from_json(F.coalesce(F.nullif(c, F.lit("")), F.lit("[]")), kind)
        elif text == "boolean":
            c = c.cast("boolean")
        elif text == "timestamp":
            c = F.try_to_timestamp(c)
        columns.append(c.alias(name))
    return flat.select(*columns)
