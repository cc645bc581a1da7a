"""Append that is all or nothing, and compaction: a log of which folders hold a table's rows.

A batch writes its rows to a folder of its own and then one log entry, a single file, that names the folder. Readers
see the folders that entries name, so a write that fails half-way leaves files nobody reads, and a batch
that is delivered again finds its entry and does nothing. A base entry replaces all batches up to a number.
There is one writer at a time, as a stream has.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Row, SparkSession

_ENTRY = "batch_id long, is_base boolean, folder string"


def _entries(spark: SparkSession, path: str) -> list[Row]:
    """Entries since the base before the newest; `forget` bounds their number."""
    if not _exists(spark, f"{path}/log"):
        return []
    return spark.read.schema(_ENTRY).json(f"{path}/log/*").filter("folder IS NOT NULL").collect()


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _exists(spark: SparkSession, path: str) -> bool:
    system, place = _file_system(spark, path)
    return system.exists(place)


def _live(entries: list[Row]) -> tuple[list[Row], list[Row]]:
    """(entries that readers follow, entries that a newer base has replaced)."""
    base = max((e.batch_id for e in entries if e.is_base), default=None)
    live = [e for e in entries if (e.batch_id == base if e.is_base else base is None or e.batch_id > base)]
    return live, [e for e in entries if e not in live]


def _note(spark: SparkSession, path: str, batch_id: int, is_base: bool, folder: str) -> None:
    name = f"{'base' if is_base else 'batch'}-{batch_id:020d}"
    entry = spark.createDataFrame([(batch_id, is_base, folder)], _ENTRY)
    entry.coalesce(1).write.mode("overwrite").json(f"{path}/log/{name}")


def _write(df: DataFrame, path: str, batch_id: int, is_base: bool, by: Sequence[str] = ()) -> None:
    folder = f"data/{batch_id}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(f"{path}/{folder}")
    _note(df.sparkSession, path, batch_id, is_base, folder)


def is_committed(spark: SparkSession, path: str, batch_id: int) -> bool:
    return any(e.batch_id >= batch_id if e.is_base else e.batch_id == batch_id for e in _entries(spark, path))


def append(df: DataFrame, path: str, batch_id: int, by: Sequence[str] = ()) -> bool:
    """Add a batch's rows, or do nothing where that batch is in the table already; whether they were added.

    A table partitioned `by` columns is read folder by folder, with its schema.
    """
    if is_committed(df.sparkSession, path, batch_id):
        return False
    _write(df, path, batch_id, False, by)
    return True


def pending(spark: SparkSession, path: str) -> int:
    """Batches that the newest base does not hold."""
    return sum(not e.is_base for e in _live(_entries(spark, path))[0])


def folders(spark: SparkSession, path: str) -> list[str]:
    """Where the base and the batches after it lie."""
    return [f"{path}/{e.folder}" for e in _live(_entries(spark, path))[0]]


def read(spark: SparkSession, path: str) -> DataFrame | None:
    """Rows of the base and of the batches after it; none where nothing was committed."""
    live = folders(spark, path)
    return spark.read.parquet(*live) if live else None


def compact(
    spark: SparkSession, path: str, merge: Callable[[DataFrame], DataFrame], by: Sequence[str] = (),
    rows: DataFrame | None = None,
) -> None:
    """Replace what is committed by a new base, `merge` of all its rows."""
    live, _ = _live(_entries(spark, path))
    newest = max((e.batch_id for e in live), default=None)
    if newest is not None and any(not e.is_base for e in live):
        _write(merge(read(spark, path) if rows is None else rows), path, newest, True, by)


def forget(spark: SparkSession, path: str) -> None:
    """Remove entries and folders that the newest base has replaced, for readers that started before it
    no sooner than at the next compaction: what the last one replaced stays."""
    entries = _entries(spark, path)
    bases = sorted(e.batch_id for e in entries if e.is_base)
    if len(bases) < 2:
        return
    before = bases[-2]
    for e in entries:
        if e.batch_id < before or (e.batch_id == before and not e.is_base):
            name = f"{'base' if e.is_base else 'batch'}-{e.batch_id:020d}"
            for place in (f"{path}/log/{name}", f"{path}/{e.folder}"):
                system, target = _file_system(spark, place)
                system.delete(target, True)
