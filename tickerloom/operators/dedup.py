"""Exact and near-duplicate removal, first in arrival order wins."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.functions.fingerprint import distance, simhash64
from tickerloom.params import DEFAULTS, Params
from tickerloom.session import prepare



def dedup_exact(
    articles: DataFrame, key: str = "content_hash", arrival: str = "ordinal"
) -> DataFrame:
    """First arrival per key.

    The rank filter is pushed below the shuffle as a group limit, so a key with a third of all
    rows sends one row per task.
    """
    order = Window.partitionBy(key).orderBy(arrival)
    ranked = articles.withColumn("__rank", F.row_number().over(order))
    return ranked.filter(F.col("__rank") == 1).drop("__rank")


# --- pairs within a Hamming distance -----------------------------------------------------------


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _masks(bits: list[int], blocks: int, keep: int) -> list[int]:
    """One bit mask per choice of `keep` blocks out of `blocks` equal runs of the given bits."""
    edges = [round(i * len(bits) / blocks) for i in range(blocks + 1)]
    runs = [sum(1 << b for b in bits[lo:hi]) for lo, hi in zip(edges, edges[1:])]
    return [sum(chosen) for chosen in combinations(runs, keep)]


def _listed(masks: list[int]) -> Column:
    """The masks as one constant array."""
    return F.split(F.lit(",".join(str(_signed(m)) for m in masks)), ",").cast("array<bigint>")


def _first_match(flipped: str, masks: list[int]) -> Column:
    """Index of the first mask under which no bit differs: each pair is reported there only."""
    branches = " ".join(
        f"WHEN ({flipped} & {_signed(m)}L) = 0 THEN {i}" for i, m in enumerate(masks)
    )
    return F.expr(f"CASE {branches} END")


def _bands(fingerprint: Column, masks: Column) -> Column:
    return F.transform(
        masks,
        lambda m, i: F.struct(i.alias("band"), fingerprint.bitwiseAND(m).alias("band_key")),
    )


def banded(prints: DataFrame, max_distance: int = DEFAULTS.near_distance) -> DataFrame:
    """Rows with `fp` once for each choice of half of its blocks: adds `band` and `band_key`.

    Fingerprints within the distance have an equal key in some band.
    """
    masks = _listed(_masks(list(range(64)), 2 * max_distance, max_distance))
    return prints.select("*", F.inline(_bands(F.col("fp"), masks)))


def near_pairs(
    left: DataFrame,
    right: DataFrame | None = None,
    max_distance: int = DEFAULTS.near_distance,
    hot: int = 16_384,
) -> DataFrame:
    """(fp_a, fp_b, distance) for distinct fingerprints within `max_distance`; no pair is missed.

    Inputs are tables of distinct `fp`. With one table, each unordered pair comes once, with
    fp_a < fp_b; with two, fp_a is from the left and fp_b from the right.

    Three flipped bits touch at most three of six blocks, so some choice of three blocks is equal
    in both: twenty equi-joins on about 32 of 64 bits instead of a theta join. Only keys held
    by two or more rows enter the join. Where one key still gathers more than `hot` fingerprints
    (clusters of near copies), the same argument is applied once more to the bits outside the key,
    which leaves about 16 free bits: no final bucket can exceed 2^16 fingerprints however large
    the cluster is. The second level costs twenty rows per fingerprint, so it pays only for large
    buckets: at about 3,000 per key, comparing within the bucket was twice as fast.

    Joins on bands are sort-merge joins by hint: size estimates leave out that a fingerprint comes twenty
    times, so Spark would send a table twenty times too large through the driver.
    """
    blocks = 2 * max_distance
    keep = blocks - max_distance
    masks = _masks(list(range(64)), blocks, keep)
    bit_lists = [[b for b in range(64) if not (m >> b) & 1] for m in masks]
    inner = [m for bits in bit_lists for m in _masks(bits, blocks, keep)]
    # The masks for the bits outside one band's key.
    own_inner = F.slice(_listed(inner), F.col("band") * len(masks) + 1, len(masks))
    self_join = right is None

    a = banded(left.select("fp"), max_distance)
    b = a if self_join else banded(right.select("fp"), max_distance)
    keys = ["band", "band_key"]
    counts = a.groupBy(*keys).agg(F.count("*").alias("n"))
    if self_join:
        counts = counts.filter("n > 1").withColumn("is_hot", F.col("n") > hot)
    else:
        other = b.groupBy(*keys).agg(F.count("*").alias("m"))
        counts = counts.join(other.hint("merge"), keys).withColumn(
            "is_hot", F.greatest("n", "m") > hot
        )
    counts = counts.select(*keys, "is_hot").hint("merge")
    a = a.join(counts, keys)
    b = a if self_join else b.join(counts, keys)

    def matched(l: DataFrame, r: DataFrame, on: list[str]) -> DataFrame:
        l = l.withColumnRenamed("fp", "fp_a").alias("l")
        r = r.withColumnRenamed("fp", "fp_b").alias("r")
        pair = reduce(
            lambda x, y: x & y, [F.col(f"l.{k}") == F.col(f"r.{k}") for k in on]
        ) & (distance(F.col("fp_a"), F.col("fp_b")) <= max_distance)
        if self_join:
            pair = pair & (F.col("fp_a") < F.col("fp_b"))
        pair = pair & (F.col("l.band") == _first_match("(fp_a ^ fp_b)", masks))
        if "inner_band" in on:
            flipped = F.col("fp_a").bitwiseXOR(F.col("fp_b"))
            equal = F.transform(F.col("l.inner_masks"), lambda m: flipped.bitwiseAND(m) == 0)
            pair = pair & (F.col("l.inner_band") == F.array_position(equal, True) - 1)
        return l.join(r.hint("merge"), pair).select(
            "fp_a", "fp_b", distance(F.col("fp_a"), F.col("fp_b")).alias("distance")
        )

    def rebanded(df: DataFrame) -> DataFrame:
        finer = df.filter("is_hot").select("fp", *keys, own_inner.alias("inner_masks"))
        return finer.select(
            "*", F.inline(_bands(F.col("fp"), F.col("inner_masks"))).alias("inner_band", "inner_key")
        )

    cool = matched(a.filter("NOT is_hot"), b.filter("NOT is_hot"), keys)
    hot_a = rebanded(a)
    hot_b = hot_a if self_join else rebanded(b)
    dense = matched(hot_a, hot_b, [*keys, "inner_band", "inner_key"])
    return cool.unionByName(dense)


# --- greedy near-duplicate removal -------------------------------------------------------------


def fingerprints(articles: DataFrame, arrival: str = "ordinal") -> DataFrame:
    """(fp, arrival) of every article, written to the checkpoint folder.

    The table is small against the texts and is read many times; writing it once keeps the texts
    and the Python workers out of every later stage.
    """
    prepare(articles.sparkSession)
    return articles.select(simhash64(F.col("headline")).alias("fp"), arrival).checkpoint()


def _first_per_fingerprint(articles: DataFrame, arrival: str) -> DataFrame:
    return articles.groupBy("fp").agg(F.min(arrival).alias(arrival))


def dropped_fingerprints(
    firsts: DataFrame, params: Params, arrival: str, pairs: DataFrame | None = None
) -> DataFrame:
    """Fingerprints that lie near an earlier kept one. `pairs` may hold more fingerprints than `firsts`.

    Rounds over the pair graph, edges pointing from earlier to later: an article with no
    undecided earlier neighbour is kept and its later neighbours are dropped. Every round decides
    at least the earliest article of each component, so the loop ends by itself. Each round's
    tables are written to the shared checkpoint folder, which cuts the lineage and outlives
    executors.
    """
    if pairs is None:
        pairs = near_pairs(firsts.select("fp"), max_distance=params.near_distance)
    # By hint, no join of the loop sends a table through the driver, however many rounds it takes.
    order = firsts.select("fp", F.col(arrival).alias("at"))
    placed = (
        pairs.join(order.withColumnsRenamed({"fp": "fp_a", "at": "at_a"}).hint("merge"), "fp_a")
        .join(order.withColumnsRenamed({"fp": "fp_b", "at": "at_b"}).hint("merge"), "fp_b")
    )
    a_first = F.col("at_a") < F.col("at_b")
    edges = placed.select(
        F.when(a_first, F.col("fp_a")).otherwise(F.col("fp_b")).alias("early"),
        F.when(a_first, F.col("fp_b")).otherwise(F.col("fp_a")).alias("late"),
    ).checkpoint()
    rounds = [edges.select(F.col("late").alias("fp")).limit(0)]
    while not edges.isEmpty():
        blocked = edges.select(F.col("late").alias("early")).distinct().hint("merge")
        dropped = (
            edges.join(blocked, "early", "left_anti")
            .select(F.col("late").alias("fp")).distinct().checkpoint()
        )
        rounds.append(dropped)
        edges = (
            edges.join(dropped.withColumnRenamed("fp", "late").hint("merge"), "late", "left_anti")
            .join(dropped.withColumnRenamed("fp", "early").hint("merge"), "early", "left_anti")
            .checkpoint()
        )
    return reduce(DataFrame.unionByName, rounds)


def near_copies(
    prints: DataFrame, params: Params = DEFAULTS, arrival: str = "ordinal"
) -> DataFrame:
    """Arrivals that near de-duplication drops from a fingerprint table (`fp`, arrival)."""
    firsts = _first_per_fingerprint(prints, arrival)
    kept = firsts.join(dropped_fingerprints(firsts, params, arrival), "fp", "left_anti")
    return prints.select(arrival).join(kept.select(arrival), arrival, "left_anti")


def thin(prints: DataFrame, params: Params = DEFAULTS, arrival: str = "ordinal") -> DataFrame:
    """Rows of a fingerprint table that near de-duplication keeps."""
    return prints.join(near_copies(prints, params, arrival), arrival, "left_anti")


def dedup_near(
    articles: DataFrame, params: Params = DEFAULTS, arrival: str = "ordinal"
) -> DataFrame:
    """Drop every article near an earlier kept one; dropped articles never drop others.

    Articles with the same fingerprint share their fate with the first of them, so only distinct
    fingerprints are paired: a group of copies of any size is one node. The texts meet the list of
    dropped arrivals, which is usually small enough for Spark to leave the texts unshuffled.
    """
    dropped = near_copies(fingerprints(articles, arrival), params, arrival)
    return articles.join(dropped, arrival, "left_anti")


def dedup(articles: DataFrame, params: Params = DEFAULTS, arrival: str = "ordinal") -> DataFrame:
    """Exact, then near."""
    return dedup_near(dedup_exact(articles, arrival=arrival), params, arrival)


def drop_seen(batch: DataFrame, seen: DataFrame, key: str = "content_hash") -> DataFrame:
    """Rows whose key is not in the seen table."""
    return batch.join(seen.select(key), key, "left_anti")


def drop_near_seen(batch: DataFrame, seen: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Rows of a fingerprinted batch that are near none of the seen fingerprints."""
    own = batch.select("fp").distinct()
    before = seen.select("fp").distinct()
    near = near_pairs(own, before, max_distance=params.near_distance)
    return batch.join(near.select(F.col("fp_a").alias("fp")).distinct(), "fp", "left_anti")
