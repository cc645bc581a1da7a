"""Compression verdicts by brute force, clashing column names, rows that repeat, and the labelled sample's bound."""

from collections import Counter

import numpy as np
import pytest
import zstandard

import corpus_pipeline
from tickerloom.llm import classifier, packing, quality

SF = "/root/testdata/sf0.01"
WORKING = (
    "__at __bit __s __mask __own __id __sha __group __row __slot __copy m h t id keep n k v rep c __AT __Own"
).split()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


def plain_verdict(text, bands):
    data = text.encode()
    packed = lambda b: len(b) / len(zstandard.ZstdCompressor(level=bands.level).compress(b))

    def outside(ratio, table):
        low, high = [(lo, hi) for least, lo, hi in table if least <= len(data)][-1]
        return ratio < low or ratio > high

    whole = len(data) >= bands.whole[0][0] and outside(packed(data), bands.whole)
    pieces, at = [], 0
    while len(data) >= bands.chunk and at < len(data):
        begin = min(at, len(data) - bands.chunk)
        pieces.append(packed(data[begin : begin + bands.chunk]))
        at += bands.chunk
    out = sum(outside(r, bands.chunks) for r in pieces)
    return whole, len(pieces), out, out > bands.chunk_share * len(pieces)


def test_compression_verdicts_equal_brute_force(docs):
    bands = quality.PROSE
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    rows = quality.quality_report(docs).collect()
    for r in rows:
        whole, n, out, chunks = plain_verdict(texts[r["doc_id"]], bands)
        assert (r["ratio_failed"], r["n_chunks"], r["n_chunks_out"], r["chunks_failed"]) == (whole, n, out, chunks)
        assert r["kept"] == (not (r["base_failed"] or whole or chunks))
    beyond = [r for r in rows if not r["base_failed"]]
    assert any(r["ratio_failed"] for r in beyond) and any(r["chunks_failed"] for r in beyond)


def test_bands_reject_poor_and_keep_good_texts(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality.quality_report(docs).filter("NOT base_failed").join(labels, "doc_id").collect()
    good = [r["kept"] for r in rows if r["quality"] == 1]
    poor = [r["kept"] for r in rows if r["quality"] == 0 and r["n_bytes"] >= 2048]
    assert good and np.mean(good) == 1.0
    assert poor and np.mean(poor) < 0.2


def test_fitted_bands_hold_the_good_texts_they_saw(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    fitted = quality.fit_bands(docs, labels)
    seen = labels.filter((labels["quality"] == 1) & ~classifier.held_out(labels["doc_id"]))
    rows = quality.quality_report(docs, fitted).filter("NOT base_failed").join(seen, "doc_id", "left_semi").collect()
    assert rows and not any(r["ratio_failed"] for r in rows)
    assert [least for least, _, _ in fitted.whole] == sorted(least for least, _, _ in fitted.whole)
    assert quality.fit_bands(docs, labels.limit(0)) == quality.PROSE


def test_every_byte_is_in_a_chunk():
    for length in (0, 2047, 2048, 2049, 4096, 5000, 6144):
        starts = quality.chunk_starts(length, 2048)
        covered = {b for a in starts for b in range(a, a + 2048)}
        assert covered == (set(range(length)) if length >= 2048 else set())


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_columns_named_like_working_ones(spark, docs, name):
    good = spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1")
    prose = [r["text"] for r in docs.filter("n_chars > 1500").join(good, "doc_id", "left_semi").orderBy("doc_id").limit(3).collect()]
    extra = [w for w in WORKING if not w.startswith("__A") and not w.startswith("__O")]
    rows = [(i, prose[i % 3], *(f"{c}{i}" for c in extra)) for i in range(6)]
    table = spark.createDataFrame(rows, ["doc_id", "text", *extra])
    out = dict(corpus_pipeline.STAGES)[name](spark, table, SF)
    assert out.columns == table.columns
    kept = out.collect()
    assert {r["doc_id"] for r in kept} == (set(range(6)) if name in ("quality_rules", "secret_scan") else {0, 1, 2})
    assert all(r[c] == f"{c}{r['doc_id']}" for r in kept for c in extra)


def test_working_names_differ_from_columns_in_any_case(spark):
    from tickerloom.llm.membership import fresh

    table = spark.createDataFrame([(1, 2)], ["__AT", "__at_"])
    assert fresh("__at", table) == "__at__" and fresh("__bit", table) == "__bit"


def test_equal_rows_are_packed_in_many_groups(spark):
    row = ("doc_id long, piece int, start long, length long, ids_crc32 long", [(7, 0, 0, 100, 1)] * 900)
    table = spark.createDataFrame([*row[1], *((i, 0, 0, 50, i) for i in range(100))], row[0]).repartition(5)
    packed = packing.pack(table, packing.PackRules(group=100)).collect()
    assert len(packed) == 1000
    groups = Counter(r["sequence_id"] >> 32 for r in packed)
    assert len(groups) == 10 and max(groups.values()) < 200
    by_sequence = {}
    for r in packed:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
        assert sum(n for _, n in parts) <= 2048


def test_labelled_sample_is_the_rows_of_smallest_hash(spark, docs, monkeypatch):
    from tickerloom.session import prepare

    prepare(spark)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    x = classifier.with_statistics(docs, "doc_id")
    seen = {}
    monkeypatch.setattr(classifier, "fit_forest", lambda rows, y: seen.setdefault(len(rows), (rows, y)))
    classifier.train(x, labels)
    whole = len(next(iter(seen.values()))[1])
    classifier.train(x, labels, max_rows=40)
    rows, y = seen[40]
    assert whole > 40 and len(y) == 40
    all_rows, all_y = seen[whole]
    assert (rows == all_rows[:40]).all() and (y == all_y[:40]).all()
    # Repeated rows change nothing.
    seen.clear()
    classifier.train(x.union(x), labels, max_rows=40)
    assert (seen[40][0] == rows).all()
