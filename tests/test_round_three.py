"""Running sums by ranges, uncapped blocking, rings of references and dictionary matching, by brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone.operators import audits, dedup, dictionary, fits, history
from quernstone.plans.ranges import running


def test_running_sums_over_a_total_order(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", None]), i, rng.randint(0, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, i long, v long").repartition(5)
    got = {r["i"]: (r["n"], r["s"]) for r in running(df, [F.col("k").asc_nulls_last(), F.col("i").desc()], {"n": F.lit(1), "s": F.col("v")}).collect()}
    total = 0
    for n, (_, i, v) in enumerate(sorted(rows, key=lambda r: (r[0] is None, r[0] or "", -r[1]))):
        assert got[i] == (n, total)
        total += v
    assert running(df.limit(0), [F.col("i")], {"n": F.lit(1)}).count() == 0


def test_states_are_carried_across_ranges(spark):
    """As-of lookups with a key that holds most rows, ties, nulls and keys without states, against a plain loop."""
    rng = random.Random(2)
    key = lambda: rng.choice(["hot"] * 8 + ["a", "b", None])
    facts = [(i, key(), rng.choice([None, *range(40)])) for i in range(300)] + [(999, "lonely", 3)]
    states = [(key(), rng.randint(0, 60), rng.choice([None, *range(20)])) for _ in range(60)]
    f, s = spark.createDataFrame(facts, "i long, k string, at long"), spark.createDataFrame(states, "k string, since long, v long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["i"]: r["as_of"] for r in history.as_of(f, s, "k", "at", "since", "v").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for i, k, at in facts:
        own = [(t, v) for x, t, v in states if x == k and v is not None and at is not None and t < at]
        assert got[i] == (max(own)[1] if own else None), (i, k, at)


def test_pooled_fit_by_dense_penalised_ridge(spark):
    rng = np.random.default_rng(0)
    sizes = {"big": 300, "mid": 40, "rare": 7, None: 12}
    rows = [(g, float(a), float(b), float(1 + 2 * a - b + e + rng.normal())) for (g, n), e in zip(sizes.items(), (0.5, -1.0, 3.0, 0.0), strict=True) for a, b in rng.normal(size=(n, 2))]
    df = spark.createDataFrame([*rows, ("big", None, 1.0, 1.0), ("big", 1.0, 1.0, None)], "g string, a double, b double, y double")
    x = np.array([[a, b, *[float(g == k) for k in sizes]] for g, a, b, _ in rows])
    y = np.array([r[3] for r in rows])
    for fixed, pooled in ((5.0, 5.0), (0.1, 100.0), (0.0, 10_000.0)):
        c = x - x.mean(axis=0)
        want = np.linalg.solve(c.T @ c + np.diag([fixed] * 2 + [pooled] * 4), c.T @ (y - y.mean()))
        weights, effects = fits.pooled_fit(df, ["a", "b"], "y", "g", fixed, pooled)
        got = {r["g"]: r for r in effects.collect()}
        assert [weights["a"], weights["b"]] == pytest.approx(want[:2], abs=1e-9)
        free = y.mean() - x.mean(axis=0) @ want
        told = [weights["one"] + weights["a"] * r[1] + weights["b"] * r[2] + got[r[0]]["effect"] for r in rows]
        assert told == pytest.approx(list(x @ want + free), abs=1e-9)
        assert {g: r["own_weight"] for g, r in got.items()} == pytest.approx({g: n / (n + pooled) for g, n in sizes.items()})
    with pytest.raises(ValueError, match="negative"):
        fits.pooled_fit(df, ["a"], "y", "g", -1.0, 1.0)
    none, effects = fits.pooled_fit(df.limit(0), ["a"], "y", "g", 1.0, 1.0)
    assert none == {"one": 0.0, "a": 0.0} and effects.count() == 0


def articles(spark, texts):
    return dedup.articles(spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string"))


@pytest.mark.parametrize("slice_rows", [500, 7])
def test_no_shared_passage_is_too_common(spark, slice_rows):
    """60 different bodies that share one passage are linked as in an exact join, whatever the slices."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    passage = " ".join(word() for _ in range(90))
    texts = [f"title {i}\n{passage} " + " ".join(word() for _ in range(rng.randint(5, 40))) for i in range(60)] + ["other\n" + " ".join(word() for _ in range(120)) for _ in range(20)] + [None, "", "x"]
    f = dedup.features(articles(spark, texts))
    sketches = {r["doc_id"]: set(sorted(r["s"])[:64]) for r in f.collect()}
    want = {(a, b): len(sketches[a] & sketches[b]) for a in sketches for b in sketches if a < b and len(sketches[a] & sketches[b]) >= dedup.SHARED}
    got = {(r["a"], r["b"]): r["shared"] for r in dedup.candidate_pairs(f, slice_rows=slice_rows).collect()}
    assert got == want and len(want) > 1500


def test_titles_block_by_their_rarer_words(spark):
    rng = random.Random(4)
    body = lambda: " ".join("".join(rng.choices("klmnop", k=7)) for _ in range(100))
    titles = ["Four candidates stand in Ashtead ward"] * 3 + ["Four candidates stand near Epsom"] + ["Common words fill every title here"] * 31
    got = {(r["a"], r["b"]): r["shared"] for r in dedup.candidate_pairs(dedup.features(articles(spark, [f"{t}\n{body()}" for t in titles]))).collect()}
    assert set(got) == {(0, 1), (0, 2), (1, 2)} and set(got.values()) == {0}


def test_rings_of_any_length(spark):
    ring = [(i, (i + 1) % 1000) for i in range(1000)]
    tail = [(5000 + i, 5001 + i) for i in range(300)] + [(6000, 17), (6001, 6000)]
    odd = [(7000, 7000), (7001, None), (None, 3), (7002, 7003), (7003, 7002), (17, 18), (8000, 8000), (8000, 17)]
    got = {r["node"]: r["on_cycle"] for r in audits.circular(spark.createDataFrame(ring + tail + odd, "a long, b long"), "a", "b").collect()}
    assert {n for n, on in got.items() if on} == {*range(1000), 7002, 7003}
    assert not got[6001] and not got[8000] and 7000 not in got
    assert audits.circular(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0
    assert audits.circular(spark.createDataFrame([(1, 2), (2, 3)], "a long, b long"), "a", "b").where("on_cycle").count() == 0


def test_dictionary_by_brute_force(spark):
    rng = random.Random(6)
    vocabulary = ["East", "Surrey", "ward", "é", "12", "the", "park"]
    texts = [(i, rng.choice([" ", "; "]).join(rng.choice(vocabulary) + rng.choice(["", "", ".", "!", "\n"]) for _ in range(rng.randint(0, 40)))) for i in range(60)] + [(60, None), (None, "the park. East")]
    aliases = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 4)))) for i in range(30)] + [(0, "the-park"), (1, "?"), (2, None), (2, "East"), (2, "east")]
    found = dictionary.matches(spark.createDataFrame(texts, "id long, t string"), "id", "t", spark.createDataFrame(aliases, "e long, a string"), "e", "a").collect()
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    want = set()
    for i, t in texts:
        parts = [p.strip() for p in re.findall(r"[^.!?\n]+[.!?]?", t or "") if words(p)]
        for no, p in enumerate(parts):
            own, ahead = words(p), words(" ".join(parts[no:]))
            for e, a in aliases:
                w = words(a)
                want |= {(i, e, " ".join(w), no, k, p) for k in range(len(own)) if w and ahead[k : k + len(w)] == w}
    assert {tuple(r) for r in found} == want and len(found) == len(want)
    plan = dictionary.matches(spark.createDataFrame(texts, "id long, t string"), "id", "t", spark.createDataFrame(aliases, "e long, a string"), "e", "a")
    assert "NestedLoop" not in plan._jdf.queryExecution().toString() and "Cartesian" not in plan._jdf.queryExecution().toString()
