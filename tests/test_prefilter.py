"""Wide rows are told apart by a bitmap before they are shuffled."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quernstone.llm import near_dup
from quernstone.plans import durable


@pytest.mark.parametrize("most", [1 << 26, 32_768])
def test_likely_loses_no_row_and_shuffles_none(spark, most):
    df = spark.range(-20_000, 80_000).selectExpr("id % 60000 AS doc_id", "repeat('x', 20) AS text").union(spark.sql("SELECT CAST(NULL AS LONG), 'null'"))
    ids = durable.durable(df.select("doc_id").where("doc_id IS NULL OR doc_id % 50 = 0"))
    got = durable.likely(df, ids, "doc_id", most)
    wanted = df.where("doc_id % 50 = 0")
    assert got.where("doc_id % 50 = 0").count() == wanted.count() and got.where("doc_id IS NULL").count() == 0
    assert got.count() < wanted.count() + df.count() * (0.09 if most > 32_768 else 0.2)
    assert durable.likely(df, ids.limit(0), "doc_id").count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi, BuildRight" in plan and "hashpartitioning(doc_id" not in plan


def test_texts_without_a_partner_are_not_shuffled(spark, tmp_path):
    """The join of texts with the members of clusters, however many these are, gets the members' texts only."""
    near = " ".join(f"w{i}" for i in range(60))
    texts = [(i, " ".join(f"d{i}x{k}" for k in range(30))) for i in range(1000)] + [(2000, near), (2001, near + " end")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    clusters = spark.createDataFrame([(2000, 2000, 57), (2001, 2000, 58)], "node long, component long, n_shingles long")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = near_dup.confirmed(docs, clusters, 4, 80)
        assert [tuple(sorted(r)) for r in found.where("a <> b").collect()] == [(2000, 2001)]
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "Join LeftSemi" in plan
        out = near_dup.near_duplicates(docs, 4)
        assert {r["doc_id"]: r["component_id"] for r in out.where(F.col("doc_id") >= 1999).collect()} == {2000: 2000, 2001: 2000}
        assert out.where("kept").count() == 1001
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
