"""The commit log, compaction of the hourly log, and the key index."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tickerloom.operators import rollups as ro
from tickerloom.sources import commitlog, keyindex
from tickerloom.streaming import jobs

START = datetime(2024, 1, 1)


def numbers(spark, low, high):
    return spark.range(low, high)


def ids(frame):
    return sorted(r.id for r in frame.collect())


def test_append_is_all_or_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    assert commitlog.read(spark, path) is None and commitlog.pending(spark, path) == 0
    assert commitlog.append(numbers(spark, 0, 5), path, 0)

    # A task fails after others have written their files.
    bad = numbers(spark, 5, 1000).select(F.when(F.col("id") < 990, F.col("id")).otherwise(F.raise_error("down")).alias("id"))
    with pytest.raises(Exception, match="down"):
        commitlog.append(bad, path, 1)
    assert ids(commitlog.read(spark, path)) == [*range(5)]

    # All files are written, and the driver is lost before the entry.
    note = commitlog._note
    monkeypatch.setattr(commitlog, "_note", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        commitlog.append(numbers(spark, 5, 10), path, 1)
    assert ids(commitlog.read(spark, path)) == [*range(5)]
    monkeypatch.setattr(commitlog, "_note", note)
    assert commitlog.append(numbers(spark, 5, 10), path, 1)
    # Delivered again.
    assert not commitlog.append(numbers(spark, 5, 10), path, 1)
    assert ids(commitlog.read(spark, path)) == [*range(10)]


def test_compaction_keeps_rows_and_bounds_what_is_read(spark, tmp_path):
    path = str(tmp_path / "t")
    for i in range(12):
        commitlog.append(numbers(spark, 3 * i, 3 * i + 3).coalesce(1), path, i)
        if commitlog.pending(spark, path) == 3:
            commitlog.compact(spark, path, lambda rows: rows.coalesce(1))
            commitlog.forget(spark, path)
        found = commitlog.read(spark, path)
        assert ids(found) == [*range(3 * i + 3)]
        assert len(found.inputFiles()) <= 3
    assert len(commitlog._entries(spark, path)) <= 6
    assert len(list((tmp_path / "t" / "data").iterdir())) <= 6
    # What a base holds is committed; compacting a base alone changes nothing.
    assert not commitlog.append(numbers(spark, 0, 3), path, 4)
    before = commitlog.read(spark, path).inputFiles()
    commitlog.compact(spark, path, lambda rows: rows)
    assert commitlog.read(spark, path).inputFiles() == before


def test_hourly_log_is_compacted(spark, tmp_path):
    schema = "published_at timestamp, source string, ensemble_sentiment string, " + ", ".join(
        f"{c} double" for c in ro.AVERAGES.values()
    )
    rows = [(START + timedelta(minutes=13 * i), f"s{i % 2}", "neutral", *[0.25 * (i % 4)] * len(ro.AVERAGES)) for i in range(60)]
    inbox, log = str(tmp_path / "in"), str(tmp_path / "log")
    for k in range(6):
        spark.createDataFrame(rows[10 * k : 10 * k + 10], schema).coalesce(1).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(schema).parquet(inbox)
        jobs.start(jobs.hourly_stream(stream, log, compact_every=3), str(tmp_path / "cp")).awaitTermination()
    key = ["bucket", "source", "ensemble_sentiment", "article_count", "avg_confidence"]
    expected = ro.hourly_rollup(spark.read.parquet(inbox)).select(key).collect()
    assert sorted(jobs.read_hourly(spark, log).select(key).collect()) == sorted(expected)
    assert any(e.is_base for e in commitlog._entries(spark, log)) and commitlog.pending(spark, log) < 3


def bytes_read(spark, action):
    """Bytes that scans took in, by the metrics of their tasks."""
    context = spark.sparkContext._jsc.sc()

    def total():
        context.listenerBus().waitUntilEmpty()
        executors = context.statusStore().executorList(False)
        return sum(executors.apply(i).totalInputBytes() for i in range(executors.size()))

    before = total()
    action()
    return total() - before


def test_a_small_batch_reads_little_of_the_index(spark, tmp_path):
    # Bytes that are fetched by threads of the reader's own are in no metric.
    spark.sparkContext._jsc.hadoopConfiguration().set("parquet.hadoop.vectored.io.enabled", "false")
    path = str(tmp_path / "keys")
    stored = spark.range(400_000).select(F.sha2(F.col("id").cast("string"), 256).alias("article_hash"))
    keyindex.add_keys(stored, path, 0, buckets=16)

    def batch(n):
        some = spark.range(399_990, 399_990 + n)
        return some.select(F.sha2(F.col("id").cast("string"), 256).alias("article_hash")).coalesce(1).cache()

    whole = bytes_read(spark, lambda: spark.read.parquet(path).select("key").write.format("noop").mode("overwrite").save())
    few, many = batch(3), batch(60)
    few.count(), many.count()
    found = {}
    small = bytes_read(spark, lambda: found.update(few=keyindex.present(few, path, buckets=16).count()))
    assert found["few"] == 3 and small < whole / 4
    assert keyindex.present(many, path, buckets=16).count() == 10
    # Above the bound the keys are joined; the answer is the same.
    assert keyindex.present(many, path, buckets=16, named=5).count() == 10
    assert keyindex.present(many, path, before=0, buckets=16).count() == 0
    assert keyindex.present(many, str(tmp_path / "none")) is None


def test_insert_absent(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    schema = "article_hash string, published_at timestamp, source string, url string, v int"
    row = lambda k, minute, v: (k, START + timedelta(minutes=minute), "s", "u", v)
    first = spark.createDataFrame([row("a", 5, 1), row("a", 3, 2), row("b", 1, 3)], schema)
    second = spark.createDataFrame([row("a", 0, 4), row("c", 1, 5), row("c", 2, 6)], schema)
    assert keyindex.insert_absent(first, path, 0)
    # The driver is lost between keys and rows: the batch meets everything but its own keys.
    append = commitlog.append
    monkeypatch.setattr(commitlog, "append", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        keyindex.insert_absent(second, path, 1)
    monkeypatch.setattr(commitlog, "append", append)
    assert keyindex.insert_absent(second, path, 1) and not keyindex.insert_absent(second, path, 1)
    rows = {(r.article_hash, r.v) for r in keyindex.read_inserted(spark, path).collect()}
    assert rows == {("a", 2), ("b", 3), ("c", 5)}
