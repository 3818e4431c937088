"""Source mixing, source divergence and embedding whitening: invariants, brute force and edge cases."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import DATA
from quernstone.llm import divergence, mixing, whitening
from test_llm import EDGE, edge, none  # noqa: F401

DOC = "doc_id long, text string, lang string, source string"


# mixing


def filled(sizes, weights=mixing.WEIGHTS, repeats=mixing.MAX_REPEATS):
    """Targets by repeated sharing of what is left among the sources that are not full."""
    total, out = sum(sizes), {}
    weight = [weights[k % len(weights)] for k in range(len(sizes))]
    while True:
        open_ = [k for k in range(len(sizes)) if k not in out]
        left = total - sum(out.values())
        over = [k for k in open_ if weight[k] * left > repeats * sizes[k] * sum(weight[j] for j in open_)]
        if not over:
            return [out.get(k, left * weight[k] / (sum(weight[j] for j in open_) or 1)) for k in range(len(sizes))]
        out.update({k: repeats * sizes[k] for k in over})


@pytest.mark.parametrize("sizes", [[1, 900, 50, 7, 3], [0, 10, 0, 0], [5], [100, 1, 1, 1, 1, 1, 1], [0, 0]])
def test_targets_by_repeated_sharing(spark, sizes):
    rows = [(i, "w " * n, "en", f"s{i}") for i, n in enumerate(sizes)]
    got = {r["doc_id"]: r for r in mixing.taken(spark.createDataFrame(rows, DOC)).collect()}
    assert [got[i]["target"] for i in range(len(sizes))] == pytest.approx(filled(sizes))
    assert [got[i]["taken"] for i in range(len(sizes))] == [int(got[i]["target"]) for i in range(len(sizes))]


def test_mix_is_a_gapless_stream_along_the_schedule(spark):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randint(0, 40), "en", rng.choice(["a", "a", "a", "b", "c", None])) for i in range(400)]
    got = mixing.mix(spark.createDataFrame(rows, DOC)).collect()
    by_start = sorted(got, key=lambda r: r["start"])
    assert [r["start"] for r in by_start] == np.cumsum([0] + [r["words"] for r in by_start])[:-1].tolist()
    assert [r["time"] for r in by_start] == sorted(r["time"] for r in got)
    for k, source in enumerate(["a", "b", "c"]):  # each source's words by time follow the integral of its schedule
        own = [r for r in by_start if r["source"] == source]
        total = sum(r["words"] for r in own)
        half = sum(r["words"] for r in own if r["time"] < 0.5)
        area = mixing.integrated(mixing.SCHEDULES[k])
        assert half / total == pytest.approx(area[1] / area[2], abs=40 / total)


def test_inverse_of_integrated_demand(spark):
    parts = [k / 97 for k in range(97)]
    schedules, knots = ((2.0, 0.0, 0.0, 1.0), (1.0, 1.0, 3.0, 0.0)), (0.0, 0.25, 0.5, 1.0)
    df = spark.createDataFrame([(p, k) for p in parts for k in (0, 1)], "part double, place int")
    for r in df.select("part", "place", mixing.time_of(F.col("part"), F.col("place"), schedules, knots).alias("t")).collect():
        grid = np.linspace(0, r["t"], 4001)
        area = np.trapezoid(np.interp(grid, knots, schedules[r["place"]]), grid)
        assert area / mixing.integrated(schedules[r["place"]], knots)[-1] == pytest.approx(r["part"], abs=1e-5)


def test_mixing_edges(edge, none, spark):
    got = mixing.taken(edge).collect()
    assert len(got) == len(EDGE) and mixing.taken(none).count() == 0 and mixing.mix(none).count() == 0
    assert all(r["taken"] <= 3 * r["size"] for r in got)
    assert {r["taken"] for r in got if not r["size"]} == {0}
    blank = spark.createDataFrame([(1, None, "en", None), (1, " ", "en", "a")], DOC)
    assert {(r["target"], r["taken"], r["first_start"]) for r in mixing.taken(blank).collect()} == {(0.0, 0, None)}
    again = lambda: sorted(map(str, mixing.taken(edge.repartition(3, "n_chars")).collect()))
    assert again() == sorted(map(str, got)) == again()


# divergence


def brute_audit(rows, least):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(lang or "", source or "", Counter(term.findall((text or "").translate(lower)))) for _, text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        held = Counter(t for k, _, c in docs if k == lang for t in c)
        kept = [t for t, n in held.items() if n >= least]
        counts = defaultdict(Counter)
        for k, source, c in docs:
            if k == lang:
                counts[source].update({t: n for t, n in c.items() if t in set(kept)})
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}
        q, p = share(sum(counts.values(), Counter())), {s: share(c) for s, c in counts.items()}
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in counts:
            ranked = {"pair": [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in counts if o != s], "term": [(f(p[s][t], q[t]), t) for t in kept if counts[s][t] and p[s][t] > q[t]]}
            for part, found in ranked.items():
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(found) if part == "pair" or k < 10]
    return sorted(out)


def made_up(n, seed):
    rng = random.Random(seed)
    words = ["Über", "straße", "x", "prefix", "prefixed", "prefixes", "a" * 40, "a" * 41, "日本", "日本語", "don"] + ["".join(rng.choices("abcé", k=rng.randint(1, 9))) for _ in range(60)]
    return [(i, rng.choice([" ", "-", "\n"]).join(rng.choices(words, k=rng.randint(0, 30))), rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "s3", "é", None])) for i in range(n)]


@pytest.mark.parametrize("bounds", [divergence.Bounds(), divergence.Bounds(7, 1 << 15, 3, 2)])
def test_divergence_by_brute_force(spark, bounds):
    """Also with dictionaries, bitmap, blocks and tiles so small that every bound is met."""
    rows = made_up(150, 4)
    got = divergence.audit(spark.createDataFrame(rows, DOC).repartition(3), 4, bounds=bounds).collect()
    assert sorted(map(tuple, got)) == brute_audit(rows, 4)


def test_divergence_edges(edge, none, spark):
    assert divergence.audit(none).count() == 0
    got = {tuple(r) for r in divergence.audit(edge).collect()}
    assert got == set()  # one source in every language, and no term in ten documents
    two = spark.createDataFrame([(1, "a b", "en", "x"), (2, None, "en", None), (3, "c", None, "x"), (3, "c", None, "x"), (3, "c" * 100_000, "", "y")], DOC)
    assert {tuple(r) for r in divergence.audit(two).collect()} == {("en", "x", "pair", "", 0, 1), ("en", "", "pair", "x", 0, 1), ("", "x", "pair", "y", 0, 1), ("", "y", "pair", "x", 0, 1)}
    assert sorted(map(tuple, divergence.audit(two, 1).collect())) == brute_audit([tuple(r) for r in two.collect()], 1)


def test_long_shared_terms_reach_their_level(spark):
    long = "q" * 5000
    rows = [(i, f"{long} {long}z" if i % 2 else long, "en", "x") for i in range(8)]
    docs = spark.createDataFrame(rows, DOC)
    assert {bytes(r["term"]).decode() for r in divergence.kept_terms(docs, 5).collect()} == {long}


# whitening


def matrix_cases():
    rng = np.random.default_rng(1)
    turn = lambda n: np.linalg.qr(rng.standard_normal((n, n)))[0]
    yield rng.standard_normal((64, 64)), 64
    yield np.eye(30), 8
    yield turn(40), 8
    yield turn(40) @ np.diag([5.0] * 5 + [3.0] * 5 + [1.0] * 30) @ turn(40), 12
    yield turn(40) @ np.diag([1, 1 - 1e-9, 1 - 2e-9, 1 - 3e-9] + [0.1] * 36) @ turn(40), 8
    yield turn(40) @ np.diag([3.0, 2.0, 1.0] + [0.0] * 37) @ turn(40), 8
    yield np.kron(np.eye(4), rng.standard_normal((5, 5))), 20
    yield rng.standard_normal((5, 40)), 8
    yield np.array([[2.0]]), 8
    for _ in range(200):
        yield rng.integers(-2, 3, (rng.integers(1, 14), rng.integers(1, 12))).astype(float), 8


def test_solver_equals_dense_eigenvectors():
    for a, count in matrix_cases():
        r = np.linalg.qr(a, mode="r")
        e, v, trace = whitening.components(r, 1, count)
        full = np.sort(np.linalg.eigvalsh(a.T @ a))[::-1]
        k = min(count, int((full > 1e-9 * max(full[0], 1)).sum()))
        assert len(e) == k and trace == pytest.approx(full.sum(), rel=1e-12, abs=1e-12)
        if k:
            assert np.allclose(e, full[:k], rtol=1e-11)
            assert np.abs(v.T @ v - np.eye(k)).max() < 1e-11
            assert np.abs(a.T @ (a @ v) - v * e).max() < 1e-11 * max(full[0], 1) * len(full)


def test_dqds_keeps_small_values():
    """Singular values far below the largest one come out to full relative accuracy."""
    q, e = [10.0 ** (-3 * k) for k in range(8)], [10.0 ** (-3 * k - 2) for k in range(7)]
    import decimal

    decimal.getcontext().prec = 120
    dec = [decimal.Decimal(x) for x in q], [decimal.Decimal(x) for x in e]
    got = whitening.dqds(q, e)
    for value in got:  # Sturm counts of the exact matrix just above and below each value

        def below(x):
            n, d = 0, dec[0][0] - x
            count = d < 0
            n += count
            for i in range(7):
                off = dec[0][i] * dec[1][i]
                d = dec[0][i + 1] + dec[1][i] - x - off / d
                n += d < 0
            return n

        x = decimal.Decimal(value)
        assert below(x * (1 + decimal.Decimal("1e-13"))) == below(x * (1 - decimal.Decimal("1e-13"))) + 1


def brute_whitening(vectors):
    x = np.floor(1024.0 * np.array(vectors, dtype=np.float32).astype(np.float64)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    c = (n * x - s).astype(float) / n
    e, v = np.linalg.eigh(c.T @ c / n)
    return n, ((n * x - s) ** 2).sum(axis=1), (c @ v / np.sqrt(e))[:, ::-1], (e / e.sum())[::-1]


def test_whitening_by_dense_eigenvectors(spark):
    vectors = [[float(np.float32(y)) for y in r["embedding"]] for r in spark.read.parquet(f"{DATA}/embeddings.parquet").orderBy("vec_id").collect()]
    got = whitening.whiten(spark.read.parquet(f"{DATA}/embeddings.parquet").repartition(37)).orderBy("vec_id").collect()
    n, deviation, white, explained = brute_whitening(vectors)
    assert [r["deviation"] for r in got] == deviation.tolist() and {r["n"] for r in got} == {n}
    w = np.array([r["whitened"] for r in got])
    sign = np.sign((w * white[:, :8]).sum(axis=0))
    assert np.abs(w * sign - white[:, :8]).max() < 1e-8
    assert np.allclose(got[0]["explained"], explained[:8], rtol=1e-10) and got[0]["identity_error"] < 1e-9


VEC = "vec_id long, embedding array<float>, n long, vector string, part int"


def test_whitening_edges(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(1, None), (2, []), (3, [1.0, None]), (4, [nan, 1.0]), (5, [1.0, inf]), (6, [1.0, 2.0, 3.0])]
    good = [(7, [0.0, 0.0]), (7, [1.0, 0.0]), (None, [0.0, 2.0]), (8, [1.0, 2.0]), (8, [1.0, 2.0])]
    make = lambda rows: spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], VEC)
    got = whitening.whiten(make(odd + good)).collect()
    assert sorted(str(r["vec_id"]) for r in got) == sorted(["7", "7", "None", "8", "8"]) and {r["n"] for r in got} == {5}
    assert {len(r["whitened"]) for r in got} == {2} and got[0]["identity_error"] < 1e-9
    assert whitening.long_form(whitening.whiten(make(odd + good))).count() == 10
    flat = whitening.whiten(make([(i, [1.0, i / 4]) for i in range(9)])).collect()
    assert {tuple(np.abs(r["explained"]).round(9)) for r in flat} == {(1.0,)}  # a constant dimension has no component
    for rows in ([], odd[:5], [(1, [1.0, 2.0])], [(1, [0.5]), (2, [0.5])]):
        assert whitening.long_form(whitening.whiten(make(rows))).collect() == []
    assert whitening.whiten(make([(1, [3e38]), (2, [-3e38]), (3, [0.0])])).count() == 3
