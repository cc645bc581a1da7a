"""Inputs whose splits do not all hold rows."""

from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq

from tickerloom.session import spread_stored


def filled(df):
    """Partitions with rows, and the rows of the largest."""
    sizes = df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).filter(bool).collect()
    return len(sizes), max(sizes)


def stored(path, row_group_size):
    texts = [f"{i} " + "".join(chr(97 + (i * k) % 26) for k in range(200)) for i in range(4_000)] + [None, None]
    ids = [*range(4_000), None, 3]
    pq.write_table(pa.table({"doc_id": ids, "text": texts}), path, row_group_size=row_group_size, compression="none")


def test_a_lone_row_group_is_dealt_out(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    stored(path := str(tmp_path / "lone.parquet"), 10_000)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        lone = spark.read.parquet(path)
        assert lone.rdd.getNumPartitions() >= cores and filled(lone)[0] == 1
        tasks, most = filled(spread_stored(lone))
        assert tasks >= cores and most < 2_000
        assert Counter(spread_stored(lone).collect()) == Counter(lone.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_an_input_with_enough_row_groups_stays(spark, tmp_path):
    stored(path := str(tmp_path / "many.parquet"), 100)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        many = spark.read.parquet(path)
        assert spread_stored(many) is many
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
