"""Polygon overlap against clipping, boosted trees against a plain fit, and contributions against enumeration."""

from __future__ import annotations

import random
from itertools import combinations
from math import cos, factorial, pi, sin

import pytest
from pyspark.sql import functions as F

from quernstone.operators import geometry, trees

RINGS = "area long, hole boolean, points array<struct<x: double, y: double>>"


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


def clipped(subject, convex):
    """The subject clipped by one side of a counterclockwise convex polygon after another."""
    for (ax, ay), (bx, by) in zip(convex, convex[1:] + convex[:1], strict=True):
        side = lambda p: (bx - ax) * (p[1] - ay) - (by - ay) * (p[0] - ax)  # noqa: B023, E731
        out = []
        for p, q in zip(subject, subject[1:] + subject[:1], strict=True):
            s, t = side(p), side(q)
            if s >= 0:
                out.append(p)
            if s * t < 0:
                k = s / (s - t)
                out.append((p[0] + k * (q[0] - p[0]), p[1] + k * (q[1] - p[1])))
        subject = out
        if not subject:
            return []
    return subject


def size(ring):
    return sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:] + ring[:1], strict=True)) / 2 if ring else 0.0


def layer(spark, rings):
    real = lambda v: None if v is None else float(v)
    return geometry.edges_of(spark.createDataFrame([(a, h, p and [(real(x), real(y)) for x, y in p]) for a, h, p in rings], RINGS))


def shares(spark, a, b, cell=3.0, strip=1.7, least=1e-9, percent=1e-9):
    return {(r["area"], r["other"]): r for r in geometry.overlaps(layer(spark, a), layer(spark, b), cell, strip, least, percent).collect()}


def test_overlaps_by_clipping(spark):
    rng = random.Random(5)

    def convex(x, y, r, n):
        turns = sorted(rng.uniform(0, 2 * pi) for _ in range(n))
        return [(x + r * cos(t), y + r * sin(t)) for t in turns]

    a, b, holes = {}, {}, {}
    for i in range(25):
        x, y = rng.uniform(-10, 10), rng.uniform(-10, 10)
        a[i] = convex(x, y, 3, 7)
        holes[i] = clipped([(x - 0.5, y - 0.5), (x + 0.5, y - 0.5), (x + 0.5, y + 0.5), (x - 0.5, y + 0.5)], a[i])
        b[i] = convex(rng.uniform(-10, 10), rng.uniform(-10, 10), 2.5, 5)
    rings = [(i, False, r) for i, r in a.items()] + [(i, True, r[::-1] if i % 2 else r) for i, r in holes.items()]
    got = shares(spark, rings, [(i, False, r[::-1] if i % 3 else r) for i, r in b.items()])
    want = {(i, j): size(clipped(a[i], b[j])) - size(clipped(holes[i], b[j]) if holes[i] else []) for i in a for j in b}
    assert set(got) == {k for k, v in want.items() if v > 1e-9}
    for k, r in got.items():
        assert r["shared"] == pytest.approx(want[k], abs=1e-3)
        assert r["other_percent"] == pytest.approx(100 * want[k] / size(b[k[1]]), abs=1e-5)


def test_percentages_slivers_holes_and_parts(spark):
    ten = [(1, False, box(0, 0, 10, 10))]
    got = shares(spark, ten, [(1, False, box(0, 0, 6, 10)), (2, False, box(6, 0, 10, 10))])
    assert {k[1]: r["area_percent"] for k, r in got.items()} == {1: 60.0, 2: 40.0}
    assert shares(spark, ten, [(1, False, box(9.95, 0, 20, 10))], least=1.0) == {}  # a sliver along the border
    assert shares(spark, ten, [(1, False, box(10, 0, 20, 10))]) == {}  # a common border
    ring = [(1, False, box(0, 0, 10, 10)), (1, True, box(2, 2, 8, 8))]
    assert shares(spark, ring, [(1, False, box(3, 3, 7, 7))]) == {}  # all in the hole
    assert shares(spark, ring, [(1, False, box(1, 1, 9, 9))])[1, 1]["shared"] == 28.0
    parts = [(1, False, box(0, 0, 1, 1)), (1, False, box(50, 0, 51, 1))]
    assert shares(spark, parts, [(7, False, box(0, 0, 60, 0.5))])[1, 7]["area_percent"] == 50.0
    odd = [(1, False, [(0.0, 0.0), (1.0, 1.0)]), (2, False, []), (3, False, None), (4, False, [(0.0, 0.0), (None, 1.0), (1.0, 0.0), (1.0, 1.0)]), (None, False, box(0, 0, 1, 1))]
    assert {k: r["shared"] for k, r in shares(spark, odd, ten).items()} == {(4, 1): 0.5}
    assert shares(spark, [], ten) == {}


def test_geojson_polygons_with_holes_and_parts(spark):
    square = "[[0,0],[4,0],[4,4],[0,4],[0,0]]"
    rows = [
        (1, f'{{"type":"Polygon","coordinates":[{square},[[1,1],[2,1],[2,2],[1,2],[1,1]]]}}'), (2, f'{{"type":"MultiPolygon","coordinates":[[{square}],[[[10,10],[11,10],[11,12],[10,10]]]]}}'),
        (3, '{"type":"Point","coordinates":[1,2]}'), (4, "no json"), (5, None), (6, f'{{"type":"Polygon","coordinates":[{square.replace("]", ",9]").replace(",9],9]", ",9]]")}]}}'),
    ]
    df = spark.createDataFrame(rows, "name long, shape string")
    got = {r["area"]: (r["size"], r["x1"]) for r in geometry.outlines(geometry.edges_of(geometry.geojson_rings(df, "name", "shape"))).collect()}
    assert got == {1: (15.0, 4.0), 2: (17.0, 11.0), 6: (16.0, 4.0)}


# trees


def data(n, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        x, z, k = rng.choice([None, *[v / 4 for v in range(40)]]), rng.gauss(0, 3), rng.randint(0, 4)
        rows.append((x, z, k, (x or 4) * (1 if k < 2 else -1) + (5 if z > 1 else 0) + rng.gauss(0, 0.5), rng.randint(1, 5)))
    return rows


SCHEMA = "x double, z double, k long, y double, day int"


def plain_fit(rows, bins, rounds, depth, rate, least):
    """Trees over lists of (bins, integer target): every split tried on every node."""
    from math import floor

    mean = lambda v, r=1.0: floor(r * sum(v) / len(v) + 0.5)
    base = mean([y for _, y in rows])
    left = [y - base for _, y in rows]

    def grow(at, d):
        node = {"n": len(at), "v": mean([left[i] for i in at], rate)}
        best, found = float(sum(left[i] for i in at)) ** 2 / len(at), None
        if d < depth and len(at) >= 2 * least:
            for f in range(len(rows[0][0])):
                for b in sorted({rows[i][0][f] for i in at})[:-1]:
                    one, two = [i for i in at if rows[i][0][f] <= b], [i for i in at if rows[i][0][f] > b]
                    score = sum(float(sum(left[i] for i in s)) ** 2 / max(1, len(s)) for s in (one, two))
                    if min(len(one), len(two)) >= least and score > best:
                        best, found = score, (f, b, one, two)
        if found:
            node |= {"f": found[0], "b": found[1], "l": grow(found[2], d + 1), "r": grow(found[3], d + 1)}
        return node

    def value(node, b):
        return value(node["l"] if b[node["f"]] <= node["b"] else node["r"], b) if "f" in node else node["v"]

    out = []
    for _ in range(rounds):
        out.append(grow(range(len(rows)), 0))
        left = [r - value(out[-1], b) for r, (b, _) in zip(left, rows, strict=True)]
    return base, out


def as_dict(node):
    own = {"n": node.cover, "v": node.value}
    return own if node.feature is None else own | {"f": node.feature, "b": node.bin, "l": as_dict(node.left), "r": as_dict(node.right)}


def test_boosted_trees_equal_a_plain_fit_for_any_partitioning(spark):
    df = spark.createDataFrame(data(400, 3), SCHEMA)
    sizes = {"rounds": 4, "depth": 3, "rate": 0.4, "least": 15}
    model = trees.fit(df, ["x", "z", "k"], "y", bins=6, **sizes)
    told = df.select(trees.binned(model.features, model.edges).alias("b"), F.round(F.col("y") * trees.UNIT).cast("long").alias("y"), trees.predicted(model).alias("p")).collect()
    base, want = plain_fit([(r["b"], r["y"]) for r in told], 6, **sizes)
    assert model.base == base and [as_dict(t) for t in model.trees] == want
    again = trees.fit(df.repartition(7, "z"), ["x", "z", "k"], "y", bins=6, **sizes)
    assert [as_dict(t) for t in again.trees] == want and again.edges == model.edges
    error = sum(abs(r["p"] - r["y"] / trees.UNIT) for r in told) / len(told)
    assert error < 0.6 * sum(abs(r["y"] - base) for r in told) / len(told) / trees.UNIT
    assert all(len(e) <= 5 for e in model.edges)


def test_early_stop_takes_the_best_count_on_the_last_day(spark):
    rows = [(*r[:4], d) for d in (1, 2) for r in data(150, d)] + [(r[0], r[1], r[2], 0.0, 3) for r in data(60, 9)]  # day 3 is unlike the others
    df = spark.createDataFrame(rows, SCHEMA)
    sizes = {"depth": 2, "bins": 4, "rate": 0.3, "least": 10}
    model = trees.fit_with_early_stop(df, ["x", "z", "k"], "y", "day", 6, 2, 50, 3, **sizes)
    best = min(range(len(model.errors)), key=model.errors.__getitem__)
    assert len(model.errors) <= best + 3 and len(model.trees) == (best or 3)
    assert trees.fit_with_early_stop(df, ["x"], "y", "day", 6, 2, 1000, 3, **sizes).errors == []  # no day is large enough
    none = trees.fit_with_early_stop(df.limit(0), ["x"], "y", "day", 2, 2, 1, 1, **sizes)
    assert df.select(trees.predicted(none).alias("p")).distinct().collect()[0]["p"] == 0.0


def test_contributions_equal_enumeration_over_subsets(spark):
    df = spark.createDataFrame(data(300, 8), SCHEMA)
    model = trees.fit(df, ["x", "z", "k"], "y", 3, depth=3, bins=6, rate=0.5, least=10)
    parts = trees.contributions(model)
    got = df.select(trees.binned(model.features, model.edges).alias("b"), trees.predicted(model).alias("p"), *[c.alias(f"c_{k}") for k, c in parts.items()]).limit(40).collect()

    def expected(node, b, known):
        if node.feature is None:
            return node.value
        if node.feature in known:
            return expected(node.left if b[node.feature] <= node.bin else node.right, b, known)
        return (node.left.cover * expected(node.left, b, known) + node.right.cover * expected(node.right, b, known)) / node.cover

    of = lambda b, known: sum(expected(t, b, known) for t in model.trees)
    for r in got:
        for j, name in enumerate(model.features):
            others = [k for k in range(3) if k != j]
            want = sum(factorial(n) * factorial(2 - n) / 6 * (of(r["b"], {*s, j}) - of(r["b"], set(s))) for n in range(3) for s in combinations(others, n)) / trees.UNIT
            assert r[f"c_{name}"] == pytest.approx(want, abs=1e-9)
        assert trees.mean_prediction(model) + sum(r[f"c_{k}"] for k in parts) == pytest.approx(r["p"], abs=1e-9)
