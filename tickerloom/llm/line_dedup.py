"""Lines within one edited word of an earlier line, by deletion neighbourhoods.

A line is compared as its sequence of words. Two lines are within one edit (a word put in, left out
or replaced) only if a line with one word deleted equals the other line, or both with one word
deleted at the same place are equal. Every variant is a hashed key, and equal keys meet. The keys
name the deleted place, so a group of any size needs only its earliest line, never its pairs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.arrays import let, running
from tickerloom.llm.membership import bitmap, maybe_members
from tickerloom.session import prepare


@dataclass(frozen=True)
class LineRules:
    #: Shorter lines are not compared for an edited word: one word of three is no small edit.
    least_words: int = 8
    #: Equal lines of at least so many words go; 1 leaves blank lines only.
    equal_words: int = 1

    @property
    def shortest(self) -> int:
        return min(self.equal_words, self.least_words)


def line_words(line: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+`, unchanged."""
    return F.filter(F.split(line, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _lines(docs: DataFrame, id_col: str, least_words: int) -> DataFrame:
    """(id, no, words) of the lines that are long enough.

    Lines are cut into words before they become rows: on a column of the row the filter would cut them again.
    """
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    listed = docs.select(F.col(id_col).alias("id"), F.posexplode(F.transform(lines, line_words)).alias("no", "words"))
    return listed.filter(F.size("words") >= least_words)


def _line_key(words: Column) -> list[Column]:
    return [F.xxhash64(words).alias("ha"), F.xxhash64(words, F.lit(1)).alias("hb")]


def _half_keys(words: Column) -> Column:
    """Hashes of the first and last halves. Lines within one edit agree on one half of the shorter."""
    def of(h: Column) -> list[Column]:
        return [F.xxhash64(F.slice(words, F.lit(1), h), F.lit(0)), F.xxhash64(F.slice(words, F.size(words) - h + 1, h), F.lit(1))]

    half = F.shiftright(F.size(words), 1)
    # The shorter of two lines may have one word fewer, which halves an even number at another place.
    return F.when(F.size(words) % 2 == 1, F.array(*of(half))).otherwise(F.array(*of(half), *of(half - 1)))


def _variants(words: Column) -> Column:
    """array<struct<v, size, at>>: the line itself (at -1) and the line without each word.

    A sequence is named by the exclusive or of hashes of its words with their places, so a variant
    is what stands before the word and, moved by one place, behind it.
    """
    size = F.size(words)
    xor = lambda a, b: a.bitwiseXOR(b)
    zero = F.lit(0).cast("long")
    here = F.transform(words, lambda w, i: F.xxhash64(w, i))
    moved = F.transform(words, lambda w, i: F.xxhash64(w, i - 1))

    def listed(before: Column) -> Column:
        def build(after: Column) -> Column:
            whole = F.struct(F.element_at(before, -1).alias("v"), size.alias("size"), F.lit(-1).alias("at"))
            dropped = F.transform(
                F.sequence(F.lit(1), size),
                lambda i: F.struct(
                    F.element_at(before, i)
                    .bitwiseXOR(F.element_at(after, -1))
                    .bitwiseXOR(F.element_at(after, i + 1))
                    .alias("v"),
                    (size - 1).alias("size"),
                    (i - 1).alias("at"),
                ),
            )
            return F.concat(F.array(whole), dropped)

        return let(let(moved, lambda m: running(m, zero, xor)), build)

    return let(let(here, lambda h: running(h, zero, xor)), listed)


def within_one_word(a: Column, b: Column) -> Column:
    """Whether two word arrays differ by at most one word put in, left out or replaced."""
    shorter = F.least(F.size(a), F.size(b))
    differ = F.filter(
        F.sequence(F.lit(1), shorter + 1), lambda i: ~F.try_element_at(a, i).eqNullSafe(F.try_element_at(b, i))
    )
    first = F.coalesce(F.try_element_at(differ, F.lit(1)), shorter + 1)
    rest = lambda x, skip: F.slice(x, first + skip, F.greatest(F.size(x) - first - skip + 1, F.lit(0)))
    return (
        F.when(F.size(a) == F.size(b), rest(a, 1) == rest(b, 1))
        .when(F.size(a) == F.size(b) + 1, rest(a, 1) == rest(b, 0))
        .when(F.size(b) == F.size(a) + 1, rest(b, 1) == rest(a, 0))
        .otherwise(False)
    )


def _near_earlier(docs: DataFrame, lines: DataFrame, id_col: str, rules: LineRules) -> DataFrame:
    """(ha, hb) of the distinct lines that have an earlier line one edit away."""
    keys = lines.select("ha", "hb", F.explode("halves").alias("k"))
    line = F.struct("ha", "hb")
    shared = keys.groupBy("k").agg(F.min(line).alias("lo"), F.max(line).alias("hi")).filter("lo <> hi").select("k")
    half_bits = bitmap(shared, F.col("k")).checkpoint()
    near = maybe_members(keys, F.col("k"), half_bits).select("ha", "hb").distinct().checkpoint()
    line_bits = bitmap(near, F.col("ha")).checkpoint()

    # The words again, only of lines that agree with another on a half; one row per distinct line.
    words = _lines(docs, id_col, rules.least_words).select("id", "no", "words", *_line_key(F.col("words")))
    words = maybe_members(words, F.col("ha"), line_bits)
    distinct = (
        words.groupBy("ha", "hb")
        .agg(F.min(F.struct("id", "no")).alias("first"), F.min("words").alias("words"))
        .join(near, ["ha", "hb"], "left_semi")
        .checkpoint()
    )
    spread = distinct.select("ha", "hb", "first", F.explode(_variants(F.col("words"))).alias("x")).select(
        "ha", "hb", "first", "x.*"
    )
    met = spread.groupBy("v", "size").agg(F.min(line).alias("lo"), F.max(line).alias("hi")).filter("lo <> hi")
    met_bits = bitmap(met.select("v"), F.col("v")).checkpoint()
    meeting = maybe_members(spread, F.col("v"), met_bits).checkpoint()

    earliest = F.min(F.struct("first", "ha", "hb")).alias("e")
    by_place = meeting.filter("at >= 0").groupBy("v", "size", "at").agg(earliest)
    lines_whole = meeting.filter("at < 0").groupBy("v", "size").agg(earliest)
    lines_cut = meeting.filter("at >= 0").groupBy("v", "size").agg(earliest)
    found = [
        meeting.filter("at >= 0").join(by_place, ["v", "size", "at"]),
        meeting.filter("at >= 0").join(lines_whole, ["v", "size"]),
        meeting.filter("at < 0").join(lines_cut, ["v", "size"]),
    ]
    pairs = None
    for f in found:
        f = f.filter(F.col("e.first") < F.col("first")).select("ha", "hb", F.col("e.ha").alias("ea"), F.col("e.hb").alias("eb"))
        pairs = f if pairs is None else pairs.union(f)
    pairs = pairs.distinct()
    held = distinct.select("ha", "hb", "words")
    checked = pairs.join(held, ["ha", "hb"]).join(held.toDF("ea", "eb", "earlier"), ["ea", "eb"])
    return checked.filter(within_one_word(F.col("words"), F.col("earlier"))).select("ha", "hb").distinct()


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", rules: LineRules = LineRules()) -> DataFrame:
    """(id, no) of lines that go: an equal line, or one within one edited word, stands earlier.

    Earlier means at a smaller id, or before in the same document; whether the earlier line goes itself
    does not matter. Lines with fewer than `least_words` words go only as equal lines, blank ones never.
    """
    halves = F.when(F.size("words") >= rules.least_words, _half_keys(F.col("words")))
    lines = _lines(docs, id_col, rules.shortest).select("id", "no", *_line_key(F.col("words")), halves.alias("halves"))
    lines = lines.checkpoint()
    place = lines.select("id", "no", "ha", "hb")
    first = place.groupBy("ha", "hb").agg(F.min(F.struct("id", "no")).alias("first"), F.count(F.lit(1)).alias("n"))
    many = first.filter("n > 1").checkpoint()
    many_bits = bitmap(many, F.col("ha")).checkpoint()
    copies = maybe_members(place, F.col("ha"), many_bits).join(many, ["ha", "hb"]).filter(F.struct("id", "no") > F.col("first"))
    near = _near_earlier(docs, lines, id_col, rules).checkpoint()
    near_bits = bitmap(near, F.col("ha")).checkpoint()
    edited = maybe_members(place, F.col("ha"), near_bits).join(near, ["ha", "hb"], "left_semi")
    return copies.select("id", "no").union(edited.select("id", "no")).distinct()


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", rules: LineRules = LineRules()) -> DataFrame:
    """Per row: id, n_lines, n_removed, kept_text (the lines that stay, joined by `\\n`).

    Null texts are empty texts: one empty line. A row with a null id is returned whole and is not a
    source. Rows that repeat an id lose the lines with the numbers found for any of them. Other
    columns are not read.
    """
    prepare(docs.sparkSession)
    known = docs.filter(F.col(id_col).isNotNull()).select(id_col, "text")
    gone = repeated_lines(known, id_col, rules).groupBy("id").agg(F.collect_set("no").alias("gone")).checkpoint()
    bits = bitmap(gone, F.col("id")).checkpoint()
    rows = docs.select(F.col(id_col), F.coalesce("text", F.lit("")).alias("text"))
    lines = F.split("text", "\n", -1)
    untouched = maybe_members(rows, F.col(id_col), bits, absent=True).select(
        id_col, F.size(lines).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_removed"), F.col("text").alias("kept_text")
    )
    marked = maybe_members(rows, F.col(id_col), bits).join(gone, F.col(id_col) == F.col("id"), "left")
    numbers = F.coalesce("gone", F.array().cast("array<int>"))
    kept = marked.select(
        id_col,
        F.size(lines).cast("long").alias("n_lines"),
        F.filter(lines, lambda line, i: ~F.array_contains(numbers, i)).alias("kept"),
    )
    touched = kept.select(
        id_col, "n_lines", (F.col("n_lines") - F.size("kept")).cast("long").alias("n_removed"), F.array_join("kept", "\n").alias("kept_text")
    )
    return untouched.unionByName(touched)
