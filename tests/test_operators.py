"""Edge cases of the operators on small fixtures."""

from __future__ import annotations

import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quernstone.functions import text as t
from quernstone.operators import bands, contest, dedup, history, stats
from quernstone.operators.components import connected_components
from quernstone.plans.durable import durable, join_small


def test_normalise_clips_splits_and_poisons(spark):
    df = spark.createDataFrame([("a", 1, -5.0), ("a", 2, 20.0), ("b", 1, 0.0), ("b", 2, -1.0), ("c", 1, None), ("c", 2, 3.0)], "k string, i int, x double")
    got = {(r["k"], r["i"]): r["y"] for r in contest.normalise_100(df, ["k"], "x", "y").collect()}
    assert got == {("a", 1): 0.0, ("a", 2): 100.0, ("b", 1): 50.0, ("b", 2): 50.0, ("c", 1): None, ("c", 2): None}


def test_seats_unknown_elect_nobody_and_ties_are_told(spark):
    df = spark.createDataFrame([(1, "x", 5.0, 1), (1, "y", 5.0, 1), (2, "x", 9.0, None), (3, "x", 1.0, 7)], "c int, p string, v double, s int")
    got = {(r["c"], r["p"]): (r["elected"], r["tie_at_cutoff"]) for r in contest.allocate_seats(df, ["c"], "v", ["p"], F.col("s")).collect()}
    assert got == {(1, "x"): (True, True), (1, "y"): (False, True), (2, "x"): (False, False), (3, "x"): (True, False)}


def test_band_edges(spark):
    lags = [-1, 0, 1, 3, 4, 7, 8, 14, 15, 30, 31]
    df = spark.createDataFrame([(x,) for x in lags], "lag int")
    got = [r["b"] for r in df.select("lag", bands.band_of(F.col("lag"), "standard").alias("b")).orderBy("lag").collect()]
    assert got == [None, None, "1-3", "1-3", "4-7", "4-7", "8-14", "8-14", "15-30", "15-30", None]


def test_pooling_needs_the_minimum(spark):
    rows = [("k", f"2020-0{m}-01", 1, 10.0 * m) for m in range(1, 6)]
    df = spark.createDataFrame(rows, "k string, d string, n int, total double").withColumn("d", F.col("d").cast("date"))
    got = [r["pooled"] for r in history.pool_backwards(df, "k", "d", "n", "total", 3, 5.0).orderBy("d").collect()]
    assert got == [None, None, None, 20.0, 30.0]


def test_as_of_is_strictly_earlier(spark):
    facts = spark.createDataFrame([("k", 1), ("k", 2), ("k", 5), ("z", 5)], "k string, at int")
    states = spark.createDataFrame([("k", 1, 10), ("k", 2, 20)], "k string, since int, v int")
    got = {(r["k"], r["at"]): r["as_of"] for r in history.as_of(facts, states, "k", "at", "since", "v").collect()}
    assert got == {("k", 1): None, ("k", 2): 10, ("k", 5): 20, ("z", 5): None}


def test_kappa_is_undefined_for_one_category(spark):
    one = spark.createDataFrame([("a", "a")] * 3, "x string, y string")
    assert stats.agreement(one, "x", "y").first()["kappa"] is None


def test_largest_remainder_fills_all_seats(spark):
    g = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "k string, n int")
    assert {r["k"]: r["seats"] for r in stats.largest_remainder(g, "k", "n", 10).collect()} == {"a": 4, "b": 3, "c": 3}


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 14), st.integers(0, 14)), max_size=20))
def test_components_match_union_find(spark, edges):
    up = {n: n for e in edges if e[0] != e[1] for n in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    df = spark.createDataFrame([*edges, (None, 1)], "a int, b int")
    assert {r["node"]: r["component"] for r in connected_components(df).collect()} == {n: find(n) for n in up}


def test_components_of_a_long_path(spark):
    ids = list(range(60))
    random.Random(3).shuffle(ids)
    df = spark.createDataFrame(list(zip(ids, ids[1:], strict=False)), "a int, b int")
    assert {r["component"] for r in connected_components(df).collect()} == {0}


def test_shingles_below_width_are_empty(spark):
    df = spark.createDataFrame([("a b c",), ("a b c d e f",), (None,)], "x string")
    assert [len(r["s"]) for r in df.select(t.shingles(t.tokens(F.col("x"))).alias("s")).collect()] == [0, 2, 0]


def test_canonical_urls(spark):
    want = {
        "http://M.Example.Co.uk//a//b/?utm_source=x&z=1&a=2#top": "https://example.co.uk/a/b?a=2&z=1",
        "https://web.archive.org/web/20200101000000/http://x.org/p/": "https://x.org/p",
        "https://x.org/story/amp": "https://x.org/story",
        "not a url": "",
        "https://x.org": "https://x.org/",
    }
    df = spark.createDataFrame([(k,) for k in want], "u string")
    assert {r["u"]: r["c"]["canonical"] for r in df.select("u", t.canonical_url(F.col("u")).alias("c")).collect()} == want


def test_near_class_precedence(spark):
    df = spark.createDataFrame(
        [(0.9, 0.95, 0.5, 0.0, 100, 200), (0.9, 0.95, 1.0, 0.0, 50, 200), (0.5, 0.6, 0.9, 0.0, 100, 100), (0.1, 0.2, 0.9, 0.6, 100, 100)],
        "jaccard double, containment double, length_ratio double, title_sim double, words_a int, words_b int",
    )
    assert [r["c"] for r in df.select(dedup.near_class().alias("c")).collect()] == ["partial_full_text_match", "manual_review", "probable_near_duplicate", "same_event_independent_reporting"]


def test_join_small_is_alike_on_both_sides_of_the_bound(spark):
    a = durable(spark.range(20).withColumn("k", F.col("id") % 5))
    b = durable(spark.range(4).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")))
    wide, narrow = (sorted(map(tuple, join_small(a, b, ["k"], "left", n).collect()), key=str) for n in (100, 1))
    assert wide == narrow


def test_frozen_tables_refuse_other_content(spark, tmp_path):
    import pytest

    from quernstone.sources.sinks import freeze_write

    path = str(tmp_path / "t")
    a = spark.createDataFrame([(1, "x"), (2, None)], "i int, s string")
    assert freeze_write(a, path) and not freeze_write(a.orderBy(F.desc("i")), path)
    with pytest.raises(FileExistsError):
        freeze_write(a.limit(1), path)


def test_logistic_recovers_weights(spark):
    from quernstone.operators.models import logistic_newton

    rng = random.Random(4)
    rows = [(x := rng.uniform(-2, 2), int(rng.random() < 1 / (1 + 2.718281828 ** -(0.5 + 1.5 * x)))) for _ in range(3000)]
    w = logistic_newton(spark.createDataFrame(rows, "x double, y int"), ["x"], "y")
    assert abs(w["1"] - 0.5) < 0.2 and abs(w["x"] - 1.5) < 0.2
