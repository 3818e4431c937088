"""Edge cases of scans, sinks, rules, checked joins, versions, audits and fits on small fixtures."""

from __future__ import annotations

import difflib
import random

import pytest
from pyspark.sql import functions as F

from quernstone.operators import audits, fits, joins, rules, stats, versions
from quernstone.sources import readers, sinks


def test_typed_csv_refuses_what_does_not_fit(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,name\n1,"x, ""y"""\n2,\n')
    got = readers.csv_typed(spark, str(tmp_path / "a.csv"), "id int, name string").collect()
    assert [tuple(r) for r in got] == [(1, 'x, "y"'), (2, None)]
    assert [tuple(r) for r in readers.csv_strings(spark, str(tmp_path / "a.csv"), ["id", "name"]).collect()] == [("1", 'x, "y"'), ("2", None)]
    (tmp_path / "b.csv").write_text("id,name\none,x\n")
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        readers.csv_typed(spark, str(tmp_path / "b.csv"), "id int, name string").collect()


def test_unknown_settings_are_refused():
    assert readers.RunConfig.load({"minimum": 5, "arms": ["a"]}).arms == ("a",)
    with pytest.raises(ValueError, match="unknown"):
        readers.RunConfig.load({"minimun": 5})
    with pytest.raises(ValueError, match="after"):
        readers.RunConfig.load({"start": "2000-01-01"})


def test_geojson_parts_merge_by_name(spark):
    two = '{"features":[{"properties":{"name":"A"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[2,0],[2,-1.5]]]}},{"properties":{"name":"A"},"geometry":{"type":"MultiPolygon","coordinates":[[[[5,5],[6,7]]]]}}]}'
    r = readers.geo_features(spark.createDataFrame([(two,), ("{}",), (None,)], "t string"), "t", "name").collect()
    assert [tuple(x) for x in r] == [("A", 2, 5, 0.0, -1.5, 6.0, 7.0)]


def test_keyed_insert_is_idempotent(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d"), (3, None)], "k int, v string")
    count = lambda: {(r["k"], r["outcome"]): r["rows"] for r in sinks.keyed_insert(df, str(tmp_path / "t"), "k", F.col("v").isNotNull()).collect()}
    assert count() == {(1, "ok"): 1, (1, "exists"): 1, (2, "ok"): 1, (None, "quarantined"): 1, (3, "quarantined"): 1}
    assert count() == {(1, "exists"): 2, (2, "exists"): 1, (None, "quarantined"): 1, (3, "quarantined"): 1}
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_manifest_follows_content_and_rules(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "i int, s string")
    one = sinks.manifest({"t": a}, {"v": "1"})
    assert one == sinks.manifest({"t": a.orderBy(F.desc("i"))}, {"v": "1"})
    assert one[1] != sinks.manifest({"t": a}, {"v": "2"})[1] and one[1] != sinks.manifest({"t": a.limit(1)}, {"v": "1"})[1]


def test_dates_and_names(spark):
    df = spark.createDataFrame([("2 May 2013",), ("2013-05-02",), ("2013-13-02",), ("May",), (None,)], "t string")
    assert [str(r[0]) for r in df.select(rules.flexible_date(F.col("t"))).collect()] == ["2013-05-02", "2013-05-02", "None", "None", "None"]
    n = spark.createDataFrame([("SMITH, John",), ("JANE  DOE",), ("a, b, c",), ("McKay, Ann",)], "n string")
    assert [r[0] for r in n.select(rules.standard_name(F.col("n"))).collect()] == ["John SMITH", "Jane Doe", "a, b, c", "Ann McKay"]


def test_governed_columns_are_checked(spark):
    df = spark.createDataFrame([(1, 2, 3)], "id int, x int, target_share int")
    with pytest.raises(ValueError, match="unclassified"):
        rules.permitted(df, {"id": "key"})
    with pytest.raises(ValueError, match="left"):
        rules.without_outcomes(df, ["target"])
    with pytest.raises(ValueError, match="reads"):
        rules.formulas(df, [("y", "x + 1", ["z"])], {"z"})
    assert rules.permitted(rules.without_outcomes(df, ["target_share"]), {"id": "key", "x": "metadata"}).columns == ["id"]


def test_joins_refuse_what_is_not_one_to_one(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(1, 1.0), (1, 2.0)], "k int, w double")
    with pytest.raises(ValueError, match="one to one"):
        joins.one_to_one(a, b, "k")
    with pytest.raises(ValueError, match="no partner"):
        joins.joined_or_error(a, b, "k")
    assert joins.one_to_one(a, a.withColumnRenamed("v", "u"), "k").count() == 2


def test_gates_raise_on_violations(spark):
    df = spark.createDataFrame([(1, 2), (2, 1), (3, 9), (3, 3)], "a int, b int")
    report = audits.union(audits.key_gates(df, "t", "a"), audits.reference_gates(df, "r", "a", "b", df.select(F.col("a").alias("k")), "k"))
    assert {(r["layer"], r["gate"]): r["violations"] for r in report.collect()} == {("t", "repeated_key"): 1, ("t", "null_key"): 0, ("r", "dangling"): 1, ("r", "self"): 1, ("r", "mutual"): 2, ("r", "circular"): 2}
    with pytest.raises(ValueError, match="broken"):
        audits.require_zero(report)


def test_paragraph_changes_by_brute_force(spark):
    rng = random.Random(9)
    para = lambda: " ".join("".join(rng.choices("abcde", k=5)) for _ in range(9))
    pairs = []
    for i in range(25):
        a = [para() for _ in range(rng.randint(0, 6))] + ["short"]
        b = [p if rng.random() < 0.4 else (p[:-9] + "zzzzz" if rng.random() < 0.6 else para()) for p in a if rng.random() < 0.9] + [para()]
        pairs.append((i, i + 100, a, b))

    def brute(one, two):
        a, b = sorted({p for p in one if len(p) >= 40}), sorted({p for p in two if len(p) >= 40})
        left, right = [p for p in a if p not in b], [p for p in b if p not in a]
        free, modified = list(right), 0
        for p in left:
            ranked = [(difflib.SequenceMatcher(None, p, q).ratio(), q) for q in free]
            top = max((r for r, _ in ranked), default=0)
            if top >= versions.SAME_PARAGRAPH:
                free.remove(next(q for r, q in ranked if r == top))
                modified += 1
        return len(right) - modified, len(left) - modified, modified, len(set(a) & set(b))

    df = spark.createDataFrame(pairs, "a long, b long, pa array<string>, pb array<string>")
    got = {r["a"]: (r["added"], r["deleted"], r["modified"], r["common"]) for r in versions.paragraph_changes(df).collect()}
    assert got == {i: brute(a, b) for i, _, a, b in pairs} and sum(v[2] for v in got.values()) > 10


def test_median_over_ranges_is_exact(spark):
    rng = random.Random(2)
    rows = [("a", rng.random()) for _ in range(301)] + [("b", float(rng.randint(0, 3))) for _ in range(200)] + [("c", 5.0), ("d", None)]
    got = {r["k"]: r["m"] for r in stats.exact_median(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", "m").collect()}
    for k in "abc":
        v = sorted(x for g, x in rows if g == k)
        assert got[k] == (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2
    assert "d" not in got


def test_closed_form_ridge_matches_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 3))
    y = x @ [1.0, -2.0, 0.5] + 3 + rng.normal(size=200)
    df = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y, strict=True)], "x1 double, x2 double, x3 double, y double")
    r = fits.solved(df.selectExpr(*fits.MOMENTS).withColumn("penalty", F.lit(2.0))).first()
    c = x - x.mean(0)
    w = np.linalg.solve(c.T @ c + 2 * np.eye(3), c.T @ (y - y.mean()))
    assert np.allclose([r["w1"], r["w2"], r["w3"]], w) and np.isclose(r["w0"], y.mean() - w @ x.mean(0))


def test_bootstrap_counts_look_poisson(spark):
    d = stats.draws(spark.range(400).withColumn("v", F.lit(1)), "id", 500)
    total, squares = d.agg(F.sum("times"), F.sum(F.col("times") * F.col("times"))).first()
    mean = total / 200_000
    assert abs(mean - 1) < 0.02 and abs(squares / 200_000 - mean * mean - 1) < 0.03
    per = d.groupBy("replicate").agg(F.sum("times").alias("n")).agg(F.stddev("n")).first()[0]
    assert 14 < per < 26  # replicates differ as independent draws of 400 do


def test_points_keep_repeats_and_nulls(spark):
    from quernstone.operators.models import points_in_polygons

    ring = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]
    edges = [("one", *p, *q) for p, q in zip(ring, ring[1:] + ring[:1], strict=True)] + [("two", a + 1, b, c + 1, d) for a, b, c, d in [(*p, *q) for p, q in zip(ring, ring[1:] + ring[:1], strict=True)]]
    pts = spark.createDataFrame([(0.5, 0.5), (0.5, 0.5), (1.5, 0.5), (9.0, 9.0), (None, 0.5)], "x double, y double")
    got = sorted((str(r["x"]), r["area"], r["n_areas"]) for r in points_in_polygons(pts, "x", "y", spark.createDataFrame(edges, "area string, x1 double, y1 double, x2 double, y2 double"), 0.5).collect())
    assert got == [("0.5", "one", 1), ("0.5", "one", 1), ("1.5", None, 2), ("9.0", None, 0), ("None", None, 0)]


def test_drawn_sums_are_the_sums_of_draws_and_no_draw_is_a_row(spark):
    """Groups, a null one among them, values of any sign and null, keys beyond the prime, blocks that do not divide the contests."""
    x = spark.range(9000).selectExpr("if(id % 5 = 4, 3000000000 + id, id) as id", "if(id % 3 = 2, null, id % 3) as g", "if(id % 11 = 0, null, (id % 17) - 8.5D) as v", "id % 4 as n").repartition(3)
    keyed = stats.draws(x.withColumn("key", F.col("id") % stats.PRIME), "key", 37)
    for groups in (["g"], []):
        want = keyed.groupBy(*groups, "replicate").agg(F.count("*").alias("drawn"), F.sum(F.col("times") * F.col("v")).alias("v"), F.sum(F.col("times") * F.col("n")).cast("double").alias("n"))
        df = stats.drawn_sums(x, "id", 37, groups, ["v", "n"])
        assert sorted(map(str, df.collect())) == sorted(map(str, want.collect()))
        assert "Generate" not in df._jdf.queryExecution().toString()
    few = spark.createDataFrame([(5, "a", 1.0)], "id long, g string, v double")
    assert sorted(stats.drawn_sums(few, "id", 50, ["g"], ["v"]).select("replicate", "drawn").collect()) == sorted(stats.draws(few, "id", 50).groupBy("replicate").agg(F.count("*").alias("drawn")).collect())
    assert stats.drawn_sums(few.limit(0), "id", 50, ["g"], ["v"]).count() == 0
