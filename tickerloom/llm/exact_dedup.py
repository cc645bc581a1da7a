"""Exact copies by 128-bit content hash, with the bytes compared inside every group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.membership import bitmap, fresh, maybe_members
from tickerloom.session import prepare


def one_space(text: Column) -> Column:
    """Each run of `\\x20\\x09-\\x0D` as one space; null as empty."""
    # A lone space stays as it is, so only other runs are rewritten.
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def md5_key(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def copy_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: Callable[[Column], Column] = one_space,
    content_hash: Callable[[Column], Column] = md5_key,
) -> DataFrame:
    """Per row: id, keep_id (smallest id with equal text), group_size, kept, text_sha256.

    Null texts are empty texts, and empty texts are copies of each other. Rows with an equal id and
    equal text are one document: both say kept where their id is the smallest. A null id is kept only
    if its whole group has none. Other columns are not read; an empty table gives no rows.

    Groups are counted on hashes alone, combined before the shuffle, so a group with a third of all
    rows costs one row per task. Only rows whose hash may be in a larger group travel with their
    text, by id and hash, and are compared with the keeper's bytes. Rows that collide with a
    different text under the same hash are grouped once more by the text itself.
    """
    prepare(docs.sparkSession)
    text = docs.select(F.col(id_col).alias("id"), normalise(F.col(text_col)).alias("t"))
    # Two aliases in one projection: the normalised text is computed once.
    hashed = text.select(
        "id", content_hash(F.col("t")).alias("h"), F.sha2(F.col("t"), 256).alias("text_sha256")
    ).checkpoint()
    groups = hashed.groupBy("h").agg(F.min("id").alias("keep"), F.count(F.lit(1)).alias("n"))
    many = groups.filter("n > 1").checkpoint()

    bits = bitmap(many, F.col("h")).checkpoint()
    members = (
        maybe_members(text.withColumn("h", content_hash(F.col("t"))), F.col("h"), bits)
        .join(many.select("h", "keep"), "h")
        .checkpoint()
    )
    # The smallest text stands for the keeper where a repeated id has several. Stored, so that the
    # comparison below is a plain join, whose hot keys Spark can split.
    keepers = (
        members.filter(F.col("id").eqNullSafe(F.col("keep")))
        .groupBy("h")
        .agg(F.min("t").alias("keeper_text"))
        .checkpoint()
    )
    differing = (
        members.join(keepers, "h")
        .filter(F.col("t") != F.col("keeper_text"))
        .select("id", "h", "t", F.sha2(F.col("t"), 256).alias("text_sha256"))
        .checkpoint()
    )
    apart = differing.groupBy("h", "t", "text_sha256").agg(
        F.min("id").alias("own_keep"), F.count(F.lit(1)).alias("own_n")
    )
    apart = apart.drop("t")
    taken = apart.groupBy("h").agg(F.sum("own_n").alias("gone"))
    sizes = many.join(taken, "h", "left").select(
        "h", "keep", (F.col("n") - F.coalesce("gone", F.lit(0))).alias("n")
    )
    joined = hashed.join(sizes, "h", "left").join(apart, ["h", "text_sha256"], "left")
    kept_id = F.when(F.col("own_n").isNotNull(), F.col("own_keep")).when(
        F.col("n").isNotNull(), F.col("keep")
    ).otherwise(F.col("id"))
    return joined.select(
        F.col("id").alias(id_col),
        kept_id.alias("keep_id"),
        F.coalesce("own_n", "n", F.lit(1)).cast("long").alias("group_size"),
        kept_id.eqNullSafe(F.col("id")).alias("kept"),
        "text_sha256",
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of the rows that stay.

    Rows to drop are found by id and content, so a row that repeats an id with another text is judged
    by its own text.
    """
    own, gone_id, gone_sha = (fresh(n, docs) for n in ("__own", "__id", "__sha"))
    verdict = copy_groups(docs, id_col, text_col).filter("NOT kept")
    gone = verdict.select(F.col(id_col).alias(gone_id), F.col("text_sha256").alias(gone_sha)).distinct().checkpoint()
    bits = bitmap(gone, F.col(gone_sha)).checkpoint()
    keyed = docs.withColumn(own, F.sha2(one_space(F.col(text_col)), 256))
    clean = maybe_members(keyed, F.col(own), bits, absent=True)
    rest = maybe_members(keyed, F.col(own), bits).join(
        gone, F.col(id_col).eqNullSafe(F.col(gone_id)) & (F.col(own) == F.col(gone_sha)), "left_anti"
    )
    return clean.unionByName(rest).drop(own)
