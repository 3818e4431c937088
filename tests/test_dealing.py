"""Steps that deal rows over partitions by the size of a table give the same results, and one shuffle where the keys allow it."""

from __future__ import annotations

from conftest import DATA, rows

from quernstone.plans import audit_queries, contest_queries, stats_queries
from quernstone.plans.durable import dealt


def finely(df, n, *keys):
    return dealt(df, n, *keys, most=500)


def test_partitions_follow_the_rows(spark):
    df = spark.range(1000)
    assert dealt(df, 1000, "id", most=10).rdd.getNumPartitions() == 100 and dealt(df, 1000, "id") is df


def test_predictions_take_one_shuffle_however_many_lines(spark, monkeypatch):
    before = rows(stats_queries.spearman_within_contest(spark, DATA)), rows(stats_queries.predictions(spark, DATA))
    monkeypatch.setattr(contest_queries, "dealt", finely)
    p = stats_queries.predictions(spark, DATA)
    assert p._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(") == 1 and "REPARTITION_BY_NUM" in p._jdf.queryExecution().executedPlan().toString()
    assert (rows(stats_queries.spearman_within_contest(spark, DATA)), rows(p)) == before


def test_references_dealt_by_size_are_the_same(spark, monkeypatch):
    before = rows(audit_queries.reference_rings(spark, DATA))
    seen = []
    monkeypatch.setattr(audit_queries, "dealt", lambda df, n, *keys: seen.append(keys) or finely(df, n, *keys))
    assert rows(audit_queries.reference_rings(spark, DATA)) == before
    assert seen == [("l_orderkey",), ("l_suppkey", "other"), ("l_suppkey",)]


def test_narrow_tables_are_written_as_few_files(spark):
    """A thousand shuffle partitions give a file a core, not a file each, wherever counts, ids or links are written."""
    from quernstone.operators.components import connected_components
    from quernstone.plans import durable as plans

    df = spark.range(1000).repartition(100).selectExpr("id", "id % 7 as k")
    made = plans.durable(df, narrow=True)
    assert sorted(made.collect()) == sorted(df.collect())
    assert len(made.inputFiles()) <= spark.sparkContext.defaultParallelism < len(plans.durable(df).inputFiles())
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = connected_components(spark.range(300).selectExpr("id as a", "id - id % 3 as b"))
        assert len(found.inputFiles()) <= 2 * spark.sparkContext.defaultParallelism
        assert {(r["node"], r["component"]) for r in found.collect()} == {(i, i - i % 3) for i in range(300)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
