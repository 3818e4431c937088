"""Pairs by tiles against brute force: what documents hold travels once per tile, whatever the number of pairs."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from quernstone.operators import dedup, tiles


@pytest.mark.parametrize("most", [4_000_000, 1])
def test_common_entries_by_either_route(most):
    rng = random.Random(5)
    sets = [sorted(rng.sample(range(60), rng.randint(0, 30))) for _ in range(25)] + [[], [7]]
    heavy = {e: e % 11 for e in range(60)}
    s = tiles.Sets(pa.chunked_array([pa.array(sets[:9], pa.list_(pa.int64())), pa.array(sets[9:], pa.list_(pa.int64()))]), pa.chunked_array([pa.array([[heavy[e] for e in x] for x in sets], pa.list_(pa.int32()))]))
    pairs = [(i, j) for i in range(len(sets)) for j in range(len(sets)) if rng.random() < 0.5]
    count, weight = s.common(np.array([i for i, _ in pairs]), np.array([j for _, j in pairs]), most)
    assert count.tolist() == [len(set(sets[i]) & set(sets[j])) for i, j in pairs]
    assert weight.tolist() == [sum(heavy[e] for e in set(sets[i]) & set(sets[j])) for i, j in pairs]


def test_met_sends_a_document_once_per_tile(spark):
    """All pairs of 60 documents in 3 blocks: 6 tiles get 60 x 3 documents, not 3,540; sources, nulls and strangers go by the rules."""
    seen = spark.sparkContext.accumulator(0)
    docs = [(i, f"t{i}", None if i == 9 else f"s{i % 4}") for i in range(60)]
    side = spark.createDataFrame(docs, "doc_id long, text string, source string")
    block = lambda i: i // 20
    pairs = [(a, b, block(a), block(b), a * b) for a in range(60) for b in range(a + 1, 60)] + [(3, 77, 0, 1, 0)]

    def calc(table):
        seen.add(len(table))
        names = table.column("text").to_pylist()
        return lambda ia, ib: [[names[i] + names[j] for i, j in zip(ia, ib, strict=True)]]

    frame = spark.createDataFrame(pairs, "a long, b long, block_a int, block_b int, ab long")
    for same, keep in ((None, lambda x, y: True), (("source", True), lambda x, y: x and x == y), (("source", False), lambda x, y: x and y and x != y)):
        before = seen.value
        got = sorted(tuple(r) for r in tiles.met(frame, side, calc, "both string", ("source",), same).collect())
        want = [(a, b, m, f"t{a}t{b}", docs[a][2], docs[b][2]) for a, b, _, _, m in pairs if b < 60 and keep(docs[a][2], docs[b][2])]
        assert got == sorted(want)
        assert seen.value - before == 180


def test_pairs_of_long_postings_come_once_with_their_blocks(spark):
    """A passage of 90 articles, two passages in some: every pair once, none lost, with any slices."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    one, two = (" ".join(word() for _ in range(70)) for _ in "ab")
    texts = [f"t\n{one if i % 3 else ''} {two if i % 5 else ''} " + " ".join(word() for _ in range(rng.randint(5, 60))) for i in range(90)]
    f = dedup.features(dedup.articles(spark.createDataFrame([(i, x, "en", "s") for i, x in enumerate(texts)], "doc_id long, text string, lang string, source string")))
    k = {r["doc_id"]: set(r["k"]) for r in f.collect()}
    want = sorted((a, b, len(k[a] & k[b])) for a in k for b in k if a < b and len(k[a] & k[b]) >= dedup.SHARED)
    for slice_rows in (2000, 11):
        got = dedup.blocked_pairs(f, slice_rows=slice_rows).collect()
        assert sorted((r["a"], r["b"], r["shared"]) for r in got) == want and all(r["block_a"] is not None and r["block_b"] is not None for r in got)


def test_pairs_travel_packed(spark):
    """30,000 pairs of three tiles: one row per tile, some bytes a pair, and all of them come back in order."""
    n = 30_000
    x = pa.table({"i_": pa.array([k % 3 for k in range(n)], pa.int32()), "j_": pa.array([2] * n, pa.int32()), "a": pa.array([k // 100 for k in range(n)]), "b": pa.array([n + k for k in range(n)]), "shared": pa.array([6 + k % 5 for k in range(n)])})
    found = [r for batch in tiles._packed(["a", "b", "shared"])(iter(x.to_batches(max_chunksize=7_000))) for r in batch.to_pylist()]
    assert [(r["i_"], r["j_"]) for r in found] == [(0, 2), (1, 2), (2, 2)] and sum(len(r["pairs_"]) for r in found) < 8 * n
    back = [pa.ipc.read_record_batch(pa.decompress(r["pairs_"][8:], int.from_bytes(r["pairs_"][:8], "little"), "zstd"), x.select(["a", "b", "shared"]).schema) for r in found]
    assert sorted((r["a"], r["b"], r["shared"]) for batch in back for r in batch.to_pylist()) == sorted(zip(*(x.column(c).to_pylist() for c in ("a", "b", "shared")), strict=True))


def test_sets_are_made_for_paired_articles_only(spark):
    """Features hold no whole sets; the sets of the articles that have pairs are made again where they meet, and give the same scores."""
    one = " ".join(f"w{i}" for i in range(120))
    texts = [one, one + " and more", one.replace("w60", "x"), " ".join(f"z{i}" for i in range(200)), None]
    art = dedup.articles(spark.createDataFrame([(i, x and f"t\n{x}", "en", "s") for i, x in enumerate(texts)], "doc_id long, text string, lang string, source string"))
    f = dedup.features(art, whole=False)
    assert "s" not in f.columns and {r["doc_id"]: r["n"] for r in f.collect()} == {0: 116, 1: 118, 2: 116, 3: 196, 4: 0}
    got = {(r["a"], r["b"]): (r["jaccard"], r["words_b"]) for r in dedup.pair_scores(dedup.blocked_pairs(f), art).collect()}
    assert got == {(0, 1): (round(116 / 118, 4), 122), (0, 2): (round(111 / 121, 4), 120), (1, 2): (round(111 / 123, 4), 120)}
