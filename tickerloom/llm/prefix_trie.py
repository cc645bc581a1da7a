"""Prefix trie of conversations by recursion on its depth, in the manner of a van Emde Boas layout.

A trie of depth 2h is cut at depth h: the sequences' first halves make the upper trie, what follows makes
lower forests, one below each distinct first half. Both are tries of depth h and are cut the same way, all
of one size in the same Spark job, so a depth of D takes log2(D) rounds. A cut names each distinct first half
by its smallest conversation and goes on with one row of it in the upper trie, however many conversations
share it. When single turns are left, each row is a node. Totals come back in the same order: forests of
equal size are added up under the node they hang from and grafted onto the path above the cut.

Nothing holds a conversation, or the conversations of a node, in one row: a conversation is a row per turn,
with names of its blocks of 2, 4, 8 ... turns that are made by pairing.

Rows without a conversation id belong to no conversation and are left out. A null role or text is empty.
Turns that stand at the same place are ordered by role, then text; repeated rows are repeated turns. Texts
count whole, whatever their length. An empty table gives no rows. Further columns are not read.
Turns and blocks are told apart by SHA-256.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.session import prepare

_WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class TrieRules:
    #: Parts that the rows of one name are dealt to when it is looked up.
    salts: int = 32
    #: Ids that agree but for this many low bits are joined into one string before the strings meet.
    chunk_bits: int = 16


_END = bytes(16)


def ordered_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, place, role, text) with places from 1 in the order of turn, nulls first.

    Rows are sorted over all tasks, so one long conversation may lie in many of them; the places at which
    a conversation goes on come from the counts of each task's first and last conversation.
    """
    turns = rows.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    order = (F.asc("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("text"))
    # The number of the task that holds a row is part of the stored table.
    held = turns.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("task", F.spark_partition_id())
    held = held.checkpoint()
    counts = held.groupBy("conv_id", "task").agg(F.count(F.lit(1)).alias("n"))
    # Only a conversation that lies in several tasks needs more than its own count.
    many = counts.groupBy("conv_id").agg(F.min("task").alias("first"), F.max("task").alias("last"))
    many = many.filter("first < last").select("conv_id")
    earlier = Window.partitionBy("conv_id").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        counts.join(many, "conv_id", "left_semi")
        .withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        .select("conv_id", "task", "before")
    )
    inside = Window.partitionBy("conv_id", "task").orderBy(*order[1:])
    numbered = held.withColumn("at", F.row_number().over(inside))
    return numbered.join(before, ["conv_id", "task"], "left").select(
        "conv_id", (F.col("at") + F.coalesce("before", F.lit(0))).alias("place"), "role", "text"
    )


def _hash(*parts: Column) -> Column:
    return F.substring(F.unhex(F.sha2(F.concat(*parts), 256)), 1, 16)


def _turn_rows(turns: DataFrame) -> DataFrame:
    """(conv, at, id, words) for every turn, with places from 0."""
    return turns.select(
        F.col("conv_id").alias("conv"), (F.col("place") - 1).alias("at"),
        _hash(F.char_length("role").cast("string"), F.lit(":"), "role", "text").alias("id"),
        F.regexp_count("text", F.lit(_WORD)).cast("long").alias("words"),
    )


def _blocks(rows: DataFrame) -> Iterator[DataFrame]:
    """Tables (conv, at, left, right) of blocks of 2, 4, 8 ... turns until one block holds all: names of the
    halves, the right one null where the conversation has ended before."""
    width = 1
    names = rows.select("conv", "at", "id")
    while True:
        half = F.pmod("at", F.lit(2 * width)) == 0
        paired = (
            names.withColumn("whole", F.col("at") - F.pmod("at", F.lit(2 * width)))
            .groupBy("conv", "whole")
            .agg(F.max(F.when(half, F.col("id"))).alias("left"), F.max(F.when(~half, F.col("id"))).alias("right"))
            .withColumnRenamed("whole", "at")
            .checkpoint()
        )
        yield paired
        if paired.filter("at > 0").isEmpty():
            return
        width *= 2
        name = F.when(F.col("right").isNull(), _hash(F.col("left"))).otherwise(_hash("left", "right"))
        names = paired.select("conv", "at", name.alias("id"))


def _named(rows: DataFrame, rules: TrieRules) -> DataFrame:
    """Rows (low, root, rep, n, left) with the smallest rep and the sum of n of each (low, root, left).

    Adds `name` and `total`. The rows of one key are dealt to parts, each part is added up first, and a
    part asks for the key's name once, so no key is bound to one task.
    """
    key = ["low", "root", "left"]
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(rules.salts)).cast("int"))
    parts = dealt.groupBy(*key, "salt").agg(F.min("rep").alias("name"), F.sum("n").alias("total"))
    names = parts.groupBy(*key).agg(
        F.min("name").alias("name"), F.sum("total").alias("total"), F.collect_set("salt").alias("salts")
    )
    return dealt.join(names.withColumn("salt", F.explode("salts")).drop("salts"), [*key, "salt"]).drop("salt")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the comma-joined strings of each group, whose rows arrive one after the other."""
    state, held = None, None
    for batch in batches:
        done = []
        for key, ids in zip(batch.column("full").to_pylist(), batch.column("ids").to_pylist()):
            if key == held:
                state.update(b"," + ids.encode())
                continue
            if state is not None:
                done.append((held, state.hexdigest()))
            state, held = sha256(ids.encode()), key
        yield _digests(done)
    if state is not None:
        yield _digests([(held, state.hexdigest())])


def _digests(rows: list[tuple[bytes, str]]) -> pa.RecordBatch:
    keys, values = [k for k, _ in rows], [v for _, v in rows]
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(values, pa.string())], ["full", "ends_sha256"])


def _summed(rows: DataFrame, *key: str) -> DataFrame:
    return rows.groupBy(*key).agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved")).checkpoint()


def prefix_trie(turns: DataFrame, conversations: DataFrame, rules: TrieRules = TrieRules()) -> DataFrame:
    """One row per distinct sequence of first turns, the empty one included: conv_id, depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    `turns` has conv_id, place (from 1), role, text; `conversations` has every conv_id, also of those
    without turns. A node's conv_id is its smallest member; with the depth it names the node.
    """
    prepare(turns.sparkSession)
    convs = conversations.select(F.col("conv_id").cast("long").alias("conv")).filter("conv IS NOT NULL").distinct()
    ids = _turn_rows(turns)
    # An end mark, without a number of words, follows the last turn.
    lengths = ids.groupBy("conv").agg(F.count(F.lit(1)).alias("at"))
    ends = convs.join(lengths, "conv", "left").select(
        "conv", F.coalesce("at", F.lit(0)).cast("long").alias("at"), F.lit(_END).alias("id"), F.lit(None).cast("long").alias("words")
    )
    rows = ids.select("conv", F.col("at").cast("long").alias("at"), "id", "words").union(ends).checkpoint()
    blocks = list(_blocks(rows))

    # Whole sequences: equal ones are one row from here on.
    whole = blocks[-1].select("conv", _hash("left", F.coalesce("right", F.lit(b""))).alias("full"))
    chunks = (
        whole.groupBy("full", F.shiftright("conv", rules.chunk_bits).alias("chunk"))
        .agg(
            F.array_join(F.array_sort(F.collect_list("conv")).cast("array<string>"), ",").alias("ids"),
            F.min("conv").alias("rep"),
            F.count(F.lit(1)).alias("n"),
        )
        .checkpoint()
    )
    least = chunks.agg(F.min("rep")).first()[0]
    start = chunks.groupBy("full").agg(F.min("rep").alias("rep"), F.sum("n").alias("n"))
    sorted_ids = chunks.select("full", "chunk", "ids").repartition("full").sortWithinPartitions("full", "chunk")
    digests = sorted_ids.drop("chunk").mapInArrow(_digest, "full binary, ends_sha256 string")
    last = start.join(digests, "full").select("rep", "ends_sha256").checkpoint()

    # Cut: rows (low, root, rep, n) are sequences from depth `low` on, below the node `root`.
    level = start.select(F.lit(0).cast("long").alias("low"), F.lit(least).cast("long").alias("root"), "rep", "n")
    cuts, levels = {}, {}
    for half in (1 << i for i in reversed(range(len(blocks)))):
        block = blocks[half.bit_length() - 1].select(
            F.col("conv").alias("rep"), F.col("at").alias("low"), "left", F.col("right").isNotNull().alias("more")
        )
        cut = _named(level.join(block, ["rep", "low"]), rules).checkpoint()
        upper = cut.groupBy("low", "root", F.col("name").alias("rep")).agg(F.max("total").alias("n"))
        lower = cut.filter("more").select((F.col("low") + half).alias("low"), F.col("name").alias("root"), "rep", "n")
        level = upper.union(lower).checkpoint()
        cuts[half], levels[half] = cut.select("low", "rep", "name", "more"), level

    # Single turns are nodes; an end mark hangs below the node at which its conversations end.
    turn = rows.select(F.col("conv").alias("rep"), F.col("at").alias("low"), "words")
    single = level.join(turn, ["rep", "low"]).checkpoint()
    at_node = [F.col("low").alias("depth"), F.col("root").alias("conv")]
    nodes = single.filter("words IS NOT NULL")
    children = nodes.groupBy(*at_node).agg(F.count(F.lit(1)).alias("n_children"))
    ended = single.filter("words IS NULL").join(last, "rep").select(*at_node, "ends_sha256")
    own = (
        nodes.select((F.col("low") + 1).alias("depth"), F.col("rep").alias("conv"), F.col("root").alias("parent"), "n", "words")
        .join(children, ["depth", "conv"], "left")
        .join(ended, ["depth", "conv"], "left")
        .select(
            "depth", "conv", "parent", "n", F.coalesce("n_children", F.lit(0)).alias("n_children"),
            F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("leaf"),
            ((F.col("n") - 1) * F.col("words")).alias("saved"), "ends_sha256",
        )
        .checkpoint()
    )

    # Up: totals of forests under their roots; two forests of one depth, one below the other, make one.
    forests = {1: _summed(own.select((F.col("depth") - 1).alias("low"), F.col("parent").alias("root"), "leaf", "saved"), "low", "root")}
    for half in sorted(cuts)[:-1]:
        hanging, upper = _hanging(forests[half], half), levels[half].select("low", "root", "rep")
        hung = hanging.join(upper, ["low", "rep"]).select("low", "root", "leaf", "saved")
        forests[2 * half] = _summed(forests[half].filter(F.pmod("low", F.lit(2 * half)) == 0).union(hung), "low", "root")
    # Down: what hangs below a path is added to all nodes on it, one halving after the other.
    added = None
    for half in sorted(cuts, reverse=True):
        grafts = _hanging(forests[half], half)
        if added is not None:
            moved = cuts[half].join(added, ["low", "rep"])
            grafts = grafts.union(moved.select("low", F.col("name").alias("rep"), "leaf", "saved"))
            lower = moved.filter("more").select((F.col("low") + half).alias("low"), "rep", "leaf", "saved")
            grafts = grafts.union(lower)
        added = _summed(grafts, "low", "rep")

    below = added.select(
        (F.col("low") + 1).alias("depth"), F.col("rep").alias("conv"), F.col("leaf").alias("leaves"), F.col("saved").alias("tokens")
    )
    zero, none = F.lit(0).cast("long"), F.lit(sha256(b"").hexdigest())
    inner = own.join(below, ["depth", "conv"], "left").select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children",
        (F.col("leaf") + F.coalesce("leaves", zero)).alias("n_leaves"),
        (F.col("saved") + F.coalesce("tokens", zero)).alias("saved_tokens"), F.coalesce("ends_sha256", none).alias("ends_sha256"),
    )
    top = (
        convs.agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"))
        .filter("n_convs > 0")
        .withColumn("depth", zero)
        .join(
            own.agg(
                F.count(F.when(F.col("depth") == 1, 1)).alias("n_children"),
                F.greatest(F.coalesce(F.sum("leaf"), zero), F.lit(1).cast("long")).alias("n_leaves"),
                F.coalesce(F.sum("saved"), zero).alias("saved_tokens"),
            )
        )
        .join(ended.filter("depth = 0").select("depth", "ends_sha256"), "depth", "left")
    )
    top = top.select(
        "conv_id", "depth", F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", none).alias("ends_sha256"),
    )
    return inner.union(top)


def _hanging(forests: DataFrame, half: int) -> DataFrame:
    """Totals of the lower forests, by the row (low, rep) of the upper trie that ends at their root."""
    return forests.filter(F.pmod("low", F.lit(2 * half)) == half).select(
        (F.col("low") - half).alias("low"), F.col("root").alias("rep"), "leaf", "saved"
    )
