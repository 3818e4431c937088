"""Every registered query equals its SQL on the smallest dataset; queries without SQL have their own tests."""

from __future__ import annotations

import pytest

from conftest import DATA
from quernstone import catalogue

PAIRS = {n: (catalogue.queries()[n], sql) for n, sql in catalogue.oracle_sql().items()}


@pytest.mark.parametrize("name", sorted(PAIRS))
def test_query_equals_sql(name, same):
    same(name, *PAIRS[name])


def test_queries_without_sql_are_known():
    assert set(catalogue.queries()) - set(PAIRS) == {"pair_seq_ratio", "html_clean", "version_paragraphs", "boosted_contributions"}


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_ridge_matches_numpy(spark):
    import numpy as np

    from quernstone.operators import stats

    p = spark.read.parquet(f"{DATA}/lineitem.parquet").selectExpr("l_quantity", "l_discount", "l_tax", "l_extendedprice / 1000 as price")
    x = p.toPandas().to_numpy()
    a, y = x[:, :3] - x[:, :3].mean(0), x[:, 3] - x[:, 3].mean()
    want = np.linalg.solve(a.T @ a + 10 * np.eye(3), a.T @ y)
    got = stats.ridge(p, ["l_quantity", "l_discount", "l_tax"], "price", 10.0)
    assert np.allclose([got[c] for c in ("l_quantity", "l_discount", "l_tax")], want, rtol=1e-6)


def test_loo_penalty_prefers_one(spark):
    found = catalogue.queries()["loo_penalty"](spark, DATA).collect()
    assert len(found) == 3 and all(r["mse"] > 0 and r["folds"] > 1 for r in found)


def test_sequence_ratio_is_symmetric_for_equal_texts(spark):
    from quernstone.operators import dedup

    art = spark.createDataFrame([(1, "abc def"), (2, "abc def"), (3, "xyz")], "doc_id long, body string")
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "a long, b long")
    assert {(r["a"], r["b"]): r["seq_ratio"] for r in dedup.sequence_ratio(pairs, art).collect()} == {(1, 2): 1.0, (1, 3): 0.0}
