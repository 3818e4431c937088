"""Backward pooling against a walk over each key's earlier days."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from quernstone.operators import history

SCHEMA = "k string, d date, n int, total double"


def walk(rows, minimum, years):
    out = {}
    for k, d, _, _ in rows:
        entries, total, sources, oldest = 0, 0, 0, None
        earlier = sorted((r for r in rows if None not in (k, d, r[1]) and r[0] == k and r[1] < d and (r[2] or 0) > 0), key=lambda r: r[1], reverse=True)
        for _, day, n, t in earlier:
            if entries >= minimum or (d - day).days > years * 365.25:
                break
            entries, total, sources, oldest = entries + n, total + round((t or 0) * 100), sources + 1, day
        out[(k, d)] = (round(total / 100 / entries, 4) if entries >= minimum else None, entries or None, sources or None, oldest)
    return out


@pytest.mark.parametrize(("minimum", "years"), [(1, 1.0), (3, 0.5), (6, 3.0)])
def test_equals_a_walk_with_a_hot_key_and_days_without_entries(spark, minimum, years):
    """A key with half of all rows, gaps longer than the window, days whose entries are 0 or null, a null key and null days."""
    rng = random.Random(minimum)
    rows, start = [], dt.date(2001, 1, 1)
    for k, size in [("hot", 220), *[(f"k{i}", rng.randint(1, 25)) for i in range(12)]]:
        days = rng.sample(range(0, 2400, 7), size)
        rows += [(k, start + dt.timedelta(days=x), rng.choice([0, None, 1, 1, 2, 5]), rng.choice([None, rng.randint(0, 10**6) / 100])) for x in days]
    rows += [(None, start, 3, 1.0), ("k1", None, 3, 1.0)]
    rng.shuffle(rows)
    got = history.pool_backwards(spark.createDataFrame(rows, SCHEMA).repartition(5), "k", "d", "n", "total", minimum, years).collect()
    want = walk(rows, minimum, years)
    assert len(got) == len(rows) == len(want)
    for r in got:
        pooled, *rest = want[(r["k"], r["d"])]
        assert [r["pooled_n"], r["sources"], r["oldest"]] == rest, r
        assert (r["pooled"] is None) == (pooled is None) and (pooled is None or abs(r["pooled"] - pooled) < 2e-4), r
    assert sum(v[0] is not None for v in want.values()) > 40


def test_empty_table_and_bad_minimum(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert history.pool_backwards(empty, "k", "d", "n", "total", 3, 5.0).collect() == []
    with pytest.raises(ValueError, match="minimum"):
        history.pool_backwards(empty, "k", "d", "n", "total", 0, 5.0)
