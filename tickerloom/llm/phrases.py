"""Phrases whose words occur together more often than apart, by sorting pointers to suffixes.

A suffix is a place in a piece of text and the words behind it, three at most. Suffixes are put in order
by multikey quicksort: partition by one word into less, equal and greater, go on with the next word in
the equal part. The size of an equal part is the number of occurrences of its words.

1. Words are counted over all texts, then the hashes of pairs of frequent words. What is below the least
   count ends a suffix, in all tasks alike, by bitmaps of fixed size whose false hits do no harm.
2. Each task sorts the suffixes of some MB of text and sends one row per distinct suffix with its size,
   to a place that depends on the two leading words. There the rows of all tasks are sorted again, and a
   part that cannot reach the least count is left unsorted.

Pairs of two very frequent words, of which there is a bounded list, are spread by their third word too;
the sizes of such pairs are added up at the end. Everything is kept per language.

A null language is `und`; null, empty and blank texts have no words. Rows count as often as they are
repeated. Texts are whole, whatever their length. Ties in the report go by count, then by the bytes of the
phrase. Further columns are not read; an empty table gives no rows. Words are compared by 64-bit numbers.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.llm.membership import bit_array, in_bits
from tickerloom.llm.words import byte_class, mix, text_slices, word_spans
from tickerloom.session import prepare

PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
SEPARATORS = PIECE_ENDS + b" \t"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass(frozen=True)
class PhraseRules:
    least: int = 10
    #: Percentage of a phrase's occurrences that lie in one longer phrase, from which on it is left out.
    inside: int = 50
    #: Rows of the report for each language.
    top: int = 2000
    unknown: str = "und"
    #: Text whose suffixes one task sorts together, and words of the corpus for each place they are sent to.
    slice_bytes: int = 4 << 20
    bucket_words: int = 1 << 19
    #: A word is very frequent when it is one of `heavy` or more equal shares of all words: there are at
    #: most that many such words.
    heavy: int = 4096


def _ranges(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of all ranges end to end, the range of each, and where each range begins among them."""
    first = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(start)), size)
    return np.arange(len(owner)) - first[owner] + start[owner], owner, first


def multikey_quicksort(
    keys: list[np.ndarray], weight: np.ndarray, least: int = 1
) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Order of the suffixes and, for each depth, (first place in the order, weight) of the equal parts.

    `keys[d]` holds word d of every suffix. Three-way partitioning of all open parts at once; an equal
    part goes on to the next depth. Parts below the least weight are abandoned where they are.
    """
    order = np.arange(len(weight))
    start = np.zeros(1 if len(order) else 0, dtype=np.int64)
    size = np.full(len(start), len(order), dtype=np.int64)
    found = []
    for key in keys:
        equal = [(np.zeros(0, np.int64),) * 3]
        while len(start):
            at, part, first = _ranges(start, size)
            moved = order[at]
            value = key[moved]
            ends = np.stack([value[first], value[first + size // 2], value[first + size - 1]])
            pivot = np.sort(ends, axis=0)[1][part]
            less, greater = value < pivot, value > pivot
            last = first + size
            before = [np.concatenate([[0], np.cumsum(flags)]) for flags in (less, greater)]
            n_less, n_greater = ((sums[last] - sums[first]) for sums in before)
            n_equal = size - n_less - n_greater
            own = [sums[:-1] - sums[first][part] for sums in before]
            inside = np.arange(len(at)) - first[part]
            place = np.where(
                less,
                own[0],
                np.where(greater, (n_less + n_equal)[part] + own[1], n_less[part] + inside - own[0] - own[1]),
            )
            order[start[part] + place] = moved
            heft = np.concatenate([[0], np.cumsum(weight[order[at]])])
            cuts = [first, first + n_less, first + n_less + n_equal, last]
            w_less, w_equal, w_greater = (heft[b] - heft[a] for a, b in zip(cuts, cuts[1:]))
            kept = w_equal >= least
            equal.append(((start + n_less)[kept], n_equal[kept], w_equal[kept]))
            low = (n_less > 0) & (w_less >= least)
            high = (n_greater > 0) & (w_greater >= least)
            start = np.concatenate([start[low], (start + n_less + n_equal)[high]])
            size = np.concatenate([n_less[low], n_greater[high]])
        start, size, total = (np.concatenate(x) for x in zip(*equal))
        found.append((start, total))
    return order, found


def _by_language(batch: pa.RecordBatch, rules: PhraseRules):
    """(language, rows of it, number that sets its words apart) for each language of a batch."""
    langs = pc.fill_null(batch.column("lang").cast(pa.string()), rules.unknown)
    for lang in pc.unique(langs).to_pylist():
        own = batch.filter(pc.equal(langs, lang)) if len(batch) else batch
        yield lang, own, np.uint64(xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass")))


def _keyed(hashes: np.ndarray, salt: np.uint64) -> np.ndarray:
    """Numbers of words of one language; 0 stands for no word."""
    return np.maximum(mix(hashes ^ salt), np.uint64(1))


def count_words(docs: DataFrame, rules: PhraseRules = PhraseRules()) -> DataFrame:
    """(lang, key, word, n) for every word of every language, and with null key and word its total."""

    def count(batches):
        for batch in batches:
            for lang, own, salt in _by_language(batch, rules):
                for _, texts in text_slices(own, size=rules.slice_bytes):
                    hashes, start, end = word_spans(texts, True, SEPARATORS)
                    if not len(hashes):
                        continue
                    _, one, n = np.unique(hashes, return_index=True, return_counts=True)
                    lowered = _LOWER[texts.data].tobytes()
                    words = [lowered[a:b] for a, b in zip(start[one].tolist(), end[one].tolist())]
                    keys = _keyed(hashes[one], salt).view(np.int64)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "lang": pa.array([lang] * (len(one) + 1), pa.string()),
                            "key": pa.array([*keys.tolist(), None], pa.int64()),
                            "word": pa.array([*words, None], pa.binary()).cast(pa.string()),
                            "n": pa.array(np.append(n, len(hashes)), pa.int64()),
                        }
                    )

    made = docs.select("lang", "text").mapInArrow(count, "lang string, key long, word string, n long")
    return made.groupBy("lang", "key", "word").agg(F.sum("n").alias("n"))


def _pair(w1: np.ndarray, w2: np.ndarray) -> np.ndarray:
    return mix(w1 ^ mix(w2))


def _suffixes(texts, salt, frequent, pairs=None):
    """Words 1 to 3 of all suffixes whose first two may be frequent; 0 for no third word.

    With the bitmap of `pairs`, the two words and the last two may be frequent as pairs, too.
    """
    hashes, start, _ = word_spans(texts, True, SEPARATORS)
    n = len(hashes)
    keys = _keyed(hashes, salt)
    breaks = np.cumsum(byte_class(PIECE_ENDS)[texts.data])
    # Pieces are told apart by the number of their end marks so far, and of texts so far.
    piece = breaks[start] + np.searchsorted(texts.offsets, start, side="right") if n else start
    keys = np.append(np.where(in_bits(frequent, keys), keys, np.uint64(0)), np.zeros(2, np.uint64))
    joined = np.zeros(n + 1, dtype=bool)
    joined[: max(n - 1, 0)] = piece[1:] == piece[:-1]
    joined[:n] &= (keys[:n] != 0) & (keys[1 : n + 1] != 0)
    if pairs is not None:
        at = np.flatnonzero(joined)
        joined[at] = in_bits(pairs, _pair(keys[at], keys[at + 1]))
    at = np.flatnonzero(joined)
    return keys[at], keys[at + 1], np.where(joined[at + 1], keys[at + 2], np.uint64(0))


def count_pairs(docs: DataFrame, frequent, rules: PhraseRules = PhraseRules()) -> DataFrame:
    """(pair, n): how often the hash of two neighbouring frequent words occurs."""

    def count(batches):
        for batch in batches:
            for _, own, salt in _by_language(batch, rules):
                for _, texts in text_slices(own, size=rules.slice_bytes):
                    w1, w2, _ = _suffixes(texts, salt, frequent.value)
                    pair, n = np.unique(_pair(w1, w2), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(pair.view(np.int64)), pa.array(n)], ["pair", "n"])

    made = docs.select("lang", "text").mapInArrow(count, "pair long, n long")
    return made.groupBy("pair").agg(F.sum("n").alias("n"))


def count_phrases(docs: DataFrame, words: DataFrame, total: int, rules: PhraseRules = PhraseRules()) -> DataFrame:
    """(w1, w2, w3, n): occurrences of every pair (w3 null) and triple of words that has enough of them.

    `words` are the frequent words of `count_words`, `total` the number of all words.
    """
    spark = docs.sparkSession
    share = max(total // rules.heavy, 1)
    found = [r["key"] for r in words.filter(F.col("n") >= share).select("key").limit(rules.heavy + 1).collect()]
    heavy = spark.sparkContext.broadcast(np.sort(np.array(found, dtype=np.int64).view(np.uint64)))
    frequent = spark.sparkContext.broadcast(bit_array(words, "key"))
    enough = count_pairs(docs, frequent, rules).filter(F.col("n") >= rules.least)
    pairs = spark.sparkContext.broadcast(bit_array(enough, "pair"))
    buckets = total // rules.bucket_words + 1

    def is_split(w1, w2):
        return np.isin(w1, heavy.value) & np.isin(w2, heavy.value)

    def route(batches):
        for batch in batches:
            for _, own, salt in _by_language(batch, rules):
                for _, texts in text_slices(own, size=rules.slice_bytes):
                    keys = list(_suffixes(texts, salt, frequent.value, pairs.value))
                    order, parts = multikey_quicksort(keys, np.ones(len(keys[0]), np.int64))
                    first, n = parts[-1]
                    w1, w2, w3 = (k[order[first]] for k in keys)
                    place = _pair(w1, w2)
                    place = np.where(is_split(w1, w2), mix(place ^ w3), place) % np.uint64(buckets)
                    columns = [place.astype(np.int64), w1.view(np.int64), w2.view(np.int64), w3.view(np.int64), n]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["bucket", "w1", "w2", "w3", "n"])

    def settle(rows: pa.Table) -> pa.Table:
        keys = [rows.column(c).to_numpy().view(np.uint64) for c in ("w1", "w2", "w3")]
        weight = rows.column("n").to_numpy()
        split = is_split(keys[0], keys[1])
        out = []
        # Of a pair that is spread, a part may be small everywhere and the whole large enough.
        for chosen, least in ((np.flatnonzero(split), 1), (np.flatnonzero(~split), rules.least)):
            own = [k[chosen] for k in keys]
            order, parts = multikey_quicksort(own, weight[chosen], least)
            for depth in (1, 2):
                first, n = parts[depth]
                w = [k[order[first]].view(np.int64) for k in own]
                kept = (n >= rules.least) & (w[2] != 0) if depth == 2 else np.ones(len(n), bool)
                none = np.full(len(n), depth == 1)[kept]
                third = pa.array(w[2][kept], mask=none)
                out.append(pa.table({"w1": w[0][kept], "w2": w[1][kept], "w3": third, "n": n[kept]}))
        return pa.concat_tables(out)

    routed = docs.select("lang", "text").mapInArrow(route, "bucket long, w1 long, w2 long, w3 long, n long")
    settled = routed.groupBy("bucket").applyInArrow(settle, "w1 long, w2 long, w3 long, n long")
    summed = settled.groupBy("w1", "w2", "w3").agg(F.sum("n").alias("n"))
    return summed.filter(F.col("n") >= rules.least)


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(10^6 a a / (l r)) in exact decimals: counts have at most 15 digits."""
    wide = lambda c: c.cast("decimal(15,0)")
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (wide(a) * wide(a)), wide(left) * wide(right))


def mine_phrases(docs: DataFrame, rules: PhraseRules = PhraseRules()) -> DataFrame:
    """The best `top` phrases of two and three words of each language: lang, rank, phrase, a, l, r, n, score.

    `docs` has lang and text. See the rules for what counts and what is left out.
    """
    prepare(docs.sparkSession)
    enough = F.col("n") >= rules.least
    counted = count_words(docs, rules).filter(enough | F.col("key").isNull()).checkpoint()
    totals = counted.filter("key IS NULL").select("lang", F.col("n").alias("total"))
    words = counted.filter("key IS NOT NULL").filter(enough)
    total = totals.agg(F.sum("total")).first()[0] or 0
    phrases = count_phrases(docs, words, total, rules).checkpoint()
    pairs, triples = phrases.filter("w3 IS NULL").drop("w3"), phrases.filter("w3 IS NOT NULL")

    def named(i: int) -> DataFrame:
        return words.select(
            F.col("key").alias(f"w{i}"), F.col("word").alias(f"word{i}"), F.col("n").alias(f"f{i}"),
            *([F.col("lang")] if i == 1 else []),
        )

    def counts(a: str, b: str, name: str) -> DataFrame:
        return pairs.select(F.col("w1").alias(a), F.col("w2").alias(b), F.col("n").alias(name))

    hidden = (
        triples.select("w1", "w2", "n")
        .union(triples.select("w2", "w3", "n"))
        .groupBy("w1", "w2")
        .agg(F.max("n").alias("longer"))
    )
    two = (
        pairs.join(hidden, ["w1", "w2"], "left")
        .filter(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("n") * rules.inside))
        .join(named(1), "w1")
        .join(named(2), "w2")
        .select(
            "lang", F.concat_ws(" ", "word1", "word2").alias("phrase"), F.col("n").alias("a"),
            F.col("f1").alias("l"), F.col("f2").alias("r"), _score(F.col("n"), F.col("f1"), F.col("f2")).alias("score"),
        )
    )
    three = (
        triples.join(counts("w1", "w2", "f12"), ["w1", "w2"])
        .join(counts("w2", "w3", "f23"), ["w2", "w3"])
        .join(named(1), "w1")
        .join(named(2).drop("f2"), "w2")
        .join(named(3), "w3")
        .withColumn("cut1", _score(F.col("n"), F.col("f1"), F.col("f23")))
        .withColumn("cut2", _score(F.col("n"), F.col("f12"), F.col("f3")))
    )
    by_first = F.col("cut1") <= F.col("cut2")
    three = three.select(
        "lang", F.concat_ws(" ", "word1", "word2", "word3").alias("phrase"), F.col("n").alias("a"),
        F.when(by_first, F.col("f1")).otherwise(F.col("f12")).alias("l"),
        F.when(by_first, F.col("f23")).otherwise(F.col("f3")).alias("r"),
        F.least("cut1", "cut2").alias("score"),
    )
    # The best of parts first, so that no task orders all phrases of a language.
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    part = F.pmod(F.xxhash64("phrase"), F.lit(64))
    best = two.union(three).withColumn("part", part)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)))
    best = best.filter(F.col("rank") <= rules.top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    return (
        best.filter(F.col("rank") <= rules.top)
        .join(totals, "lang")
        .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
    )
