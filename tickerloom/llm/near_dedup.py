"""Near-duplicates by bottom-k sketches: inverted lists, estimate on the union, exact check.

One hash function numbers the shingles of a text; the k smallest numbers are its sketch. Of two texts
with similarity 0.8 or more, each sketch holds at least c values of the other (but for one pair in
some millions), so if the values of all sketches stand in one common order, such a pair shares a
value within the first k - c + 1 of each. Rare values come first in that order: lists stay short,
and values that many texts hold are not listed unless a text has little else.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.components import components
from tickerloom.llm.membership import bit_array, bitmap, fresh, in_bits, maybe_members
from tickerloom.llm.words import Texts, mix, text_slices, words_of
from tickerloom.session import brief_shuffles, prepare

#: Standard deviations that a true pair may fall behind its expected overlap.
_SLACK = 5.5


@dataclass(frozen=True)
class NearRules:
    shingle: int = 2
    percent: int = 80
    sketch: int = 64
    #: Lists up to this length are paired at once; longer ones go through pivots first.
    short_list: int = 16
    #: Lists longer than this are cut by a second shared value before their texts meet.
    split_list: int = 10_000
    #: Texts of a block whose sets meet those of another block in one task.
    block: int = 512
    #: How many values before a shared one are looked at to tell whether two texts have met already.
    before: int = 8
    #: Cells of the fixed-size table that orders values by how many sketches hold them.
    cells: int = 1 << 18

    def shared(self, n: int) -> int:
        """Least number of common values of the sketches of a set of size n and of any similar set.

        The two sets together have at most m = n / 0.8 values. While m fits into a sketch, both sets are
        known whole. Else the k smallest values of the two sets together are a draw without return
        from at most m, of which a fifth at most is not common: all of that fifth in the draw is the
        worst case for small sets, chance is for larger ones. A smaller set may be known whole.
        """
        k, p = self.sketch, self.percent / 100
        whole, m = -(-self.percent * n // 100), 100 * n // self.percent
        if m <= k:
            return whole
        drawn = math.floor(p * k - _SLACK * math.sqrt(k * p * (1 - p) * (m - k) / (m - 1)))
        return max(1, min(whole, max(drawn, k - m * (100 - self.percent) // 100)))


def shingle_sets(texts: Texts, shingle: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle numbers of each text, below 2^63; a shorter text is one shingle."""
    words = words_of(texts, lower=True)
    counts = words.counts
    value = mix(words.hashes)
    for step in range(1, shingle):
        ahead = np.zeros_like(words.hashes)
        ahead[:-step] = words.hashes[step:]
        value = mix(value + ahead)
    for i, (a, n) in enumerate(zip(words.first, counts)):
        if n >= shingle:
            own = value[a : a + n - shingle + 1]
        else:
            own = words.hashes[a : a + n]
            own = mix(own.sum(dtype=np.uint64, keepdims=True) + np.uint64(n)) if n else own
        yield np.unique(own >> np.uint64(1))


RANGES = 128


def _signature(values: np.ndarray) -> np.ndarray:
    """Two numbers: one bit of the smallest value in each of 128 ranges; empty ranges give 0."""
    ranges = (values >> np.uint64(56)).astype(np.int64)
    held, first = np.unique(ranges, return_index=True)
    out = np.zeros(2, dtype=np.uint64)
    np.bitwise_or.at(out, held >> 6, (values[first] & np.uint64(1)) << (held & 63).astype(np.uint64))
    return out


def sketches(docs: DataFrame, rules: NearRules, id_col: str) -> DataFrame:
    """(id, n, set_a, set_b, sign_a, sign_b, sketch): size, digest, signature and sketch of each set."""
    key = docs.schema[id_col].dataType.simpleString()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in text_slices(batch):
                size, digest, signs, kept = [], [], [], []
                for values in shingle_sets(texts, rules.shingle):
                    size.append(len(values))
                    digest.append((mix(values).sum(dtype=np.uint64), mix(values + np.uint64(1 << 63)).sum(dtype=np.uint64)))
                    signs.append(_signature(values))
                    kept.append(values[: rules.sketch].astype(np.int64))
                pair = np.array(digest, dtype=np.uint64).reshape(-1, 2).view(np.int64)
                sign = np.array(signs, dtype=np.uint64).reshape(-1, 2).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(0),
                        pa.array(size, pa.int64()),
                        pa.array(pair[:, 0]),
                        pa.array(pair[:, 1]),
                        pa.array(sign[:, 0]),
                        pa.array(sign[:, 1]),
                        pa.array(kept, pa.list_(pa.int64())),
                    ],
                    ["id", "n", "set_a", "set_b", "sign_a", "sign_b", "sketch"],
                )

    schema = f"id {key}, n long, set_a long, set_b long, sign_a long, sign_b long, sketch array<long>"
    return docs.select(id_col, "text").mapInArrow(make, schema)


def _cell_counts(made: DataFrame, cells: int) -> np.ndarray:
    """How many sketch values fall into each cell: a table of fixed size, whatever the data."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, dtype=np.int64)
        for batch in batches:
            total += np.bincount(np.asarray(batch.column(0).flatten()) % cells, minlength=cells)
        held = np.flatnonzero(total)
        for a in range(0, len(held), 1 << 16):
            part = held[a : a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], ["cell", "held"])

    counted = made.select("sketch").mapInArrow(count, "cell long, held long")
    summed = counted.groupBy("cell").agg(F.sum("held").alias("held")).toPandas()
    out = np.zeros(cells, dtype=np.int32)
    out[summed["cell"].to_numpy()] = np.minimum(summed["held"].to_numpy(), 2**31 - 1)
    return out


def _distinct_sets(made: DataFrame, rules: NearRules) -> DataFrame:
    """(set_a, set_b, n, rep, sign_a, sign_b, prefix), one row per distinct set that is not empty.

    `prefix` has the leading sketch values in the common order, one more than a list needs.
    """
    table = made.sparkSession.sparkContext.broadcast(_cell_counts(made, rules.cells))
    key = made.schema["id"].dataType.simpleString()
    names = ["id", "n", "set_a", "set_b", "sign_a", "sign_b"]

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = table.value
        for batch in batches:
            prefixes = []
            for n, values in zip(batch.column(1).to_pylist(), batch.column(6)):
                own = np.asarray(values.values)
                ranked = own[np.lexsort((own, held[own % rules.cells]))]
                prefixes.append(ranked[: len(own) - rules.shared(n) + 2])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:6], pa.array(prefixes, pa.list_(pa.int64()))], [*names, "prefix"]
            )

    ordered = made.select(*names, "sketch").filter("n > 0").mapInArrow(
        order, f"id {key}, n long, set_a long, set_b long, sign_a long, sign_b long, prefix array<long>"
    )
    distinct = ordered.groupBy("set_a", "set_b", "n").agg(
        F.min("id").alias("rep"), *[F.first(c).alias(c) for c in ("sign_a", "sign_b", "prefix")]
    )
    distinct = distinct.checkpoint()
    table.destroy()
    return distinct


_TEXT = ("rep", "n", "sign_a", "sign_b")


def _postings(distinct: DataFrame, rules: NearRules) -> DataFrame:
    """(v, rep, n, sign_a, sign_b, long) of the listed values that two or more sets may hold.

    Which values those are, and which have long lists, is told by two bitmaps of fixed size, so
    values of one set only are never shuffled with their text. A value that only seems to have a long
    list is handled as if it had.
    """
    spark, key = distinct.sparkSession, distinct.schema["rep"].dataType.simpleString()
    values = distinct.select(F.explode("prefix").alias("v"))
    counted = values.groupBy("v").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    counted = counted.checkpoint()
    shared = spark.sparkContext.broadcast(bit_array(counted, "v"))
    large = spark.sparkContext.broadcast(bit_array(counted.filter(F.col("size") > rules.short_list), "v", 25))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(4)
            size = np.diff(np.asarray(lists.offsets))
            value = np.asarray(lists.flatten())
            row = np.repeat(np.arange(len(size)), size)
            # The last value of a prefix is there for the second level only.
            last = np.cumsum(size) - 1
            listed = np.ones(len(value), dtype=bool)
            listed[last[size > np.array([_needed(n, rules) for n in batch.column(1).to_pylist()], dtype=np.int64)]] = False
            whole = value.astype(np.uint64)
            on = np.flatnonzero(listed & in_bits(shared.value, whole))
            take = pa.array(row[on])
            yield pa.RecordBatch.from_arrays(
                [pa.array(value[on]), *[batch.column(i).take(take) for i in range(4)], pa.array(in_bits(large.value, whole[on]))],
                ["v", *_TEXT, "long"],
            )

    schema = f"v long, rep {key}, n long, sign_a long, sign_b long, long boolean"
    postings = distinct.select(*_TEXT, "prefix").mapInArrow(emit, schema).checkpoint()
    shared.destroy()
    large.destroy()
    return postings


def _needed(n: int, rules: NearRules) -> int:
    return min(n, rules.sketch) - rules.shared(n) + 1


def _second(frame: DataFrame, *more: str) -> DataFrame:
    """The same rows as the other side of a pair."""
    names = {"rep": "b", **{c: f"{c}2" for c in (*_TEXT[1:], *more)}}
    return frame.select("v", *[F.col(c).alias(d) for c, d in names.items()])


def _alike(rules: NearRules) -> Column:
    """Whether sizes and signatures of two texts allow the similarity.

    Of m ranges that either set fills, at the least similarity a tenth differ in their bit; the more
    the sets hold, the more ranges are filled.
    """
    sizes = F.least("n", "n2") * 100 >= F.greatest("n", "n2") * rules.percent
    apart = F.bit_count(F.col("sign_a").bitwiseXOR(F.col("sign_a2"))) + F.bit_count(
        F.col("sign_b").bitwiseXOR(F.col("sign_b2"))
    )
    p = rules.percent / 100
    union = (F.col("n") + F.col("n2")) / (1 + p)
    filled = RANGES * (1 - F.exp(-union / RANGES))
    differ = (1 - p) / 2
    return sizes & (apart <= differ * filled + _SLACK * F.sqrt(differ * (1 - differ) * filled) + 1)


def _similar(s1: np.ndarray, s2: np.ndarray, rules: NearRules) -> bool:
    """Estimate on the union of two sketches, then the exact test on the full sets, which are sorted."""
    k1, k2 = s1[: rules.sketch], s2[: rules.sketch]
    both = np.intersect1d(k1, k2, assume_unique=True)
    union = np.union1d(k1, k2)[: rules.sketch]
    if not len(union) or 2 * np.searchsorted(both, union[-1], side="right") < len(union):
        return False
    shared = len(np.intersect1d(s1, s2, assume_unique=True))
    return 100 * shared >= rules.percent * (len(s1) + len(s2) - shared)


def _linked_pairs(pairs: DataFrame, sets: DataFrame, rules: NearRules) -> DataFrame:
    """The pairs (a, b) whose full sets (id, s) are similar enough.

    Texts are dealt to blocks of about `block`. A set goes once to each block that it has a partner in, not
    once to each partner, so many pairs around few texts move few sets; a group of two blocks is of bounded
    size whatever the number of pairs.
    """
    key = sets.schema["id"].dataType.simpleString()
    blocks = sets.count() // rules.block + 1

    def block(c: str) -> Column:
        return F.pmod(F.xxhash64(c, F.lit(3)), F.lit(blocks)).cast("int")

    dealt = pairs.withColumns({"x": block("a"), "y": block("b")})
    wanted = dealt.select("x", "y", "a").union(dealt.select("x", "y", "b")).distinct().toDF("p", "q", "id")
    moved = wanted.join(sets, "id")

    def verify(held: pa.Table, asked: pa.Table) -> pa.Table:
        lists = held.column("s").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        values, ends = np.asarray(lists.flatten()), np.asarray(lists.offsets)
        ends = ends - ends[0]
        place = {k: i for i, k in enumerate(held.column("id").to_pylist())}
        own = lambda k: values[ends[place[k]] : ends[place[k] + 1]]
        pairs = zip(asked.column("a").to_pylist(), asked.column("b").to_pylist())
        kept = [_similar(own(a), own(b), rules) for a, b in pairs]
        return asked.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    return moved.groupBy("p", "q").cogroup(dealt.groupBy("x", "y")).applyInArrow(verify, f"a {key}, b {key}")


def _full_sets(docs: DataFrame, ids: DataFrame, rules: NearRules, id_col: str) -> DataFrame:
    """(id, s array<long>) of the texts with the given ids; only those are hashed again."""
    key = docs.schema[id_col].dataType.simpleString()
    ids = ids.toDF("wanted")
    bits = bitmap(ids, F.col("wanted")).checkpoint()

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in text_slices(batch):
                sets = [v.astype(np.int64) for v in shingle_sets(texts, rules.shingle)]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(sets, pa.list_(pa.int64()))], ["id", "s"])

    chosen = maybe_members(docs.select(id_col, "text"), F.col(id_col), bits)
    sets = chosen.mapInArrow(full, f"id {key}, s array<long>")
    return sets.join(ids, F.col("id") == F.col("wanted"), "left_semi")


def _verified(docs: DataFrame, pairs: DataFrame, rules: NearRules, id_col: str) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    ids = pairs.select("a").union(pairs.select("b")).distinct()
    sets = _full_sets(docs, ids, rules, id_col).checkpoint()
    return _linked_pairs(pairs, sets, rules).distinct()


def near_links(docs: DataFrame, distinct: DataFrame, rules: NearRules, id_col: str) -> DataFrame:
    """Pairs (a, b) of distinct sets that join them into the same components as all links do: components found
    on the way, as pairs of a text and its component, and the links found after.

    Short lists are paired at once. In a long one every text first meets a pivot, the text whose
    values stand in the most lists, which links a group of copies by as many pairs as it has members.
    Texts still apart are told from each other in two ways: those around one pivot by the leading
    values of their full sets, others by signature.
    """
    postings = _postings(distinct, rules)
    short = postings.filter("NOT long")
    pairs = short.join(_second(short), "v").filter((F.col("rep") < F.col("b")) & _alike(rules))
    pairs = pairs.select(F.col("rep").alias("a"), "b")
    lists = postings.filter("long").drop("long")
    sizes = lists.groupBy("v").agg(F.count(F.lit(1)).alias("size"))
    weight = lists.join(sizes, "v").groupBy("rep").agg(F.sum("size").alias("weight"))
    lists = _around_pivots(lists.join(weight, "rep"), rules).checkpoint()
    met = lists.filter(F.col("near") & (F.col("rep") != F.col("pivot")))
    met = met.select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b"))
    links = _verified(docs, pairs.union(met).distinct().checkpoint(), rules, id_col).checkpoint()
    found = components(links).checkpoint()
    stars = found.select(F.col("node").alias("a"), F.col("component").alias("b"))
    lists = _apart(lists, found).checkpoint()
    if lists.isEmpty():
        return stars
    direct = lists.filter(F.col("size") <= rules.split_list)
    split = _split(lists.filter(F.col("size") > rules.split_list), distinct)
    far = _crossed(direct, rules).union(_crossed(split, rules)).distinct().checkpoint()
    around = lists.filter("near").groupBy("v").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi")
    inner = lists.filter("near").join(around, "v", "left_semi").select("rep", "c").distinct().checkpoint()
    stars = stars.union(_verified(docs, far, rules, id_col))
    return stars.union(_linked_by_prefix(docs, inner, rules, id_col)).checkpoint()


def _around_pivots(lists: DataFrame, rules: NearRules) -> DataFrame:
    """Each row with its list's pivot and whether the text may be similar to it."""
    heads = lists.groupBy("v").agg(F.max(F.struct("weight", *_TEXT)).alias("h")).select(
        "v", F.col("h.rep").alias("pivot"), *[F.col(f"h.{c}").alias(f"{c}2") for c in _TEXT[1:]]
    )
    return lists.join(heads, "v").select("v", *_TEXT, "pivot", _alike(rules).alias("near"))


def _apart(lists: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of lists with more than one component, with component c and the list's size."""
    member = lists.join(found, lists["rep"] == found["node"], "left").withColumn("c", F.coalesce("component", "rep"))
    held = member.groupBy("v").agg(
        F.count(F.lit(1)).alias("size"), F.min("c").alias("lo"), F.max("c").alias("hi")
    ).filter("lo <> hi")
    return member.drop("node", "component").join(held.drop("lo", "hi"), "v")


def _linked_by_prefix(docs: DataFrame, chosen: DataFrame, rules: NearRules, id_col: str) -> DataFrame:
    """Links (a, b) across components c among the chosen (rep, c), from their full sets.

    With all values of a set in one order, two sets of sizes n and m that share enough have a common
    value so early in both that what stands behind it can still make up the overlap. Texts changed in
    different places do not.
    """
    key = chosen.schema["rep"].dataType.simpleString()
    sets = _full_sets(docs, chosen.select("rep"), rules, id_col).join(chosen, F.col("id") == F.col("rep"))
    sets = sets.select("rep", "c", "s").checkpoint()
    cells = _cell_counts(sets.select(F.col("s").alias("sketch")), rules.cells)
    table = sets.sparkSession.sparkContext.broadcast(cells)

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, place, value, size = [], [], [], []
            for i, values in enumerate(batch.column(2)):
                own = np.asarray(values.values)
                n = len(own)
                first = own[np.lexsort((own, table.value[own % rules.cells]))][: n + rules.percent * n // -100 + 1]
                value.append(first)
                place.append(np.arange(len(first)))
                row.append(np.full(len(first), i))
                size.append(np.full(len(first), n))
            row, place, value, size = (np.concatenate(x) for x in (row, place, value, size))
            take = pa.array(row)
            back = np.minimum(place, rules.before)
            ends = np.cumsum(back)
            earlier = value[np.arange(back.sum()) + np.repeat(np.arange(len(value)) - ends, back)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(value), batch.column(0).take(take), batch.column(1).take(take), pa.array(size), pa.array(place),
                    pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(earlier)),
                ],
                ["v", "rep", "c", "n", "i", "e"],
            )

    led = sets.mapInArrow(lead, f"v long, rep {key}, c {key}, n long, i long, e array<long>")
    held = led.groupBy("v", "c").agg(F.count(F.lit(1)).alias("k"))
    most = held.groupBy("v").agg(F.max(F.struct("k", "c")).alias("most"), F.count(F.lit(1)).alias("cs")).filter("cs > 1")
    led = led.join(most.select("v", F.col("most.c").alias("main")), "v").checkpoint()
    table.destroy()
    # Two texts of a list's main component need no link, so one of a pair is always outside of it.
    other = led.select("v", F.col("rep").alias("b"), *[F.col(x).alias(f"{x}2") for x in ("c", "n", "i", "e")])
    behind = F.least(F.col("n") - F.col("i"), F.col("n2") - F.col("i2"))
    enough = behind * (100 + rules.percent) >= (F.col("n") + F.col("n2")) * rules.percent
    # Texts that share a value shortly before this one have met there, with more behind it.
    once = ((F.col("c2") == F.col("main")) | (F.col("rep") < F.col("b"))) & ~F.arrays_overlap("e", "e2")
    pairs = led.filter("c <> main").join(other, "v").filter((F.col("c") != F.col("c2")) & enough & once)
    pairs = pairs.select(F.least("rep", "b").alias("a"), F.greatest("rep", "b").alias("b")).distinct().checkpoint()
    return _linked_pairs(pairs, sets.select(F.col("rep").alias("id"), "s").distinct(), rules)


def _split(lists: DataFrame, distinct: DataFrame) -> DataFrame:
    """Lists of two values: the list's own and the next, in order, that two similar texts share."""
    prefix = distinct.select(F.col("rep").alias("q"), "prefix")
    later = lists.join(prefix, F.col("rep") == F.col("q")).withColumn(
        "w", F.explode(F.slice("prefix", F.array_position("prefix", F.col("v")).cast("int") + 1, F.size("prefix")))
    )
    finer = later.select(F.xxhash64("v", "w").alias("v"), *_TEXT, "near", "c")
    mixed = finer.groupBy("v").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("v")
    return finer.join(mixed, "v", "left_semi")


def _crossed(lists: DataFrame, rules: NearRules) -> DataFrame:
    """Pairs (a, b) of different components in one list that may be similar, not both near its pivot."""
    pairs = lists.join(_second(lists, "c", "near"), "v").filter(
        (F.col("rep") < F.col("b")) & (F.col("c") != F.col("c2")) & ~(F.col("near") & F.col("near2")) & _alike(rules)
    )
    return pairs.select(F.col("rep").alias("a"), "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", rules: NearRules = NearRules()) -> DataFrame:
    """One row per row of `docs`: id, n_shingles, component_id, kept.

    `component_id` is the smallest id reachable over links of similarity `percent` or more; texts with
    equal sets are linked. Null and empty texts have no shingles and are linked with nothing. Rows
    that repeat an id are one document and share its links. A null id is its own component unless its
    set occurs under another id. Other columns are not read.
    """
    prepare(docs.sparkSession)
    own = docs.filter(F.col(id_col).isNotNull())
    shared = ["set_a", "set_b", "n"]
    with brief_shuffles(docs.sparkSession):
        made = sketches(docs, rules, id_col).checkpoint()
        reps = _distinct_sets(made, rules)
        links = near_links(own, reps.filter("rep IS NOT NULL"), rules, id_col)
        found = components(links)
    classes = reps.select(*shared, "rep").join(found, F.col("rep") == F.col("node"), "left")
    classes = classes.select(*shared, F.coalesce("component", "rep").alias("c"))
    component = F.coalesce("c", "id")
    return made.select("id", *shared).join(classes, shared, "left").select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        component.eqNullSafe(F.col("id")).alias("kept"),
    )


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", rules: NearRules = NearRules()) -> DataFrame:
    """All columns of the rows whose document stays."""
    gone_id = fresh("__id", docs)
    gone = near_duplicates(docs, id_col, rules).filter("NOT kept").select(F.col(id_col).alias(gone_id)).distinct()
    with brief_shuffles(docs.sparkSession):
        gone = gone.checkpoint()
        bits = bitmap(gone, F.col(gone_id)).checkpoint()
    clean = maybe_members(docs, F.col(id_col), bits, absent=True)
    rest = maybe_members(docs, F.col(id_col), bits).join(
        gone, F.col(id_col).eqNullSafe(F.col(gone_id)), "left_anti"
    )
    return clean.unionByName(rest)
