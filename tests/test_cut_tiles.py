"""Tiles of many costly pairs are cut into parts, and texts are numbered once per document of a part, not once per pair."""

from __future__ import annotations

import difflib
import random

from quernstone.functions import sequences
from quernstone.operators import dedup, tiles


def test_a_tile_of_many_pairs_is_met_in_parts(spark):
    """1,225 pairs of one tile: with a least part of 100 they are met in several tiles, each pair once."""
    met = spark.sparkContext.accumulator(0)
    side = spark.createDataFrame([(i, i * 7) for i in range(50)], "doc_id long, v long")
    pairs = spark.createDataFrame([(a, b, 0, 0) for a in range(50) for b in range(a + 1, 50)], "a long, b long, block_a int, block_b int")

    def calc(docs):
        met.add(1)
        v = docs.column("v").to_numpy()
        return lambda ia, ib: [v[ia] * 1000 + v[ib]]

    found = sorted(tuple(r) for r in tiles.met(pairs, side, calc, "x long", split=100).collect())
    assert found == [(a, b, a * 7000 + b * 7) for a in range(50) for b in range(a + 1, 50)]
    assert met.value > 5
    assert tiles.met(pairs.limit(0), side, calc, "x long", split=100).collect() == []


def test_ratios_of_numbered_texts(spark):
    rng = random.Random(6)
    base = [rng.choice(["a", "it", "é\U0001f600", "of", "x" * 30]) for _ in range(700)]
    texts = ["", None, "one two", *[" ".join(w if rng.random() > 0.1 else str(rng.random()) for w in base[: rng.randint(1, 700)]) for _ in range(9)]]
    art = dedup.articles(spark.createDataFrame([(i, x and f"t\n{x}", "en", "s") for i, x in enumerate(texts)], "doc_id long, text string, lang string, source string"))
    pairs = spark.createDataFrame([(a, b) for a in range(12) for b in range(a + 1, 12)], "a long, b long")
    got = {(r["a"], r["b"]): (r["seq_ratio"], r["head_ratio"]) for r in dedup.sequence_ratio(pairs, art).collect()}
    ratio = lambda x, y: round(difflib.SequenceMatcher(None, x, y).ratio(), 4)
    for (a, b), found in got.items():
        x, y = (texts[k] or "" for k in (a, b))
        assert found == (ratio(x.split(), y.split()), ratio(x[:2000], y[:2000]))
    assert len(got) == 66 and sequences.ratio("ab", "ab") == 1.0
