from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from quernstone.plans.session import local_session

    return local_session(4, 4, "tests", "4g")


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def rows(df, columns=None):
    """Rows as sorted tuples, floats to nine digits, columns by name."""
    names = sorted(columns or df.columns)
    flat = lambda v: f"{v:.9g}" if isinstance(v, float) else "None" if v is None or v != v else str(v)
    found = df.select(*names).collect() if hasattr(df, "sparkSession") else df.select(", ".join(f'"{n}"' for n in names)).fetchall()
    return sorted(tuple(flat(v) for v in r) for r in found)


@pytest.fixture(scope="session")
def same(spark, duck):
    """Assert that a registered query equals its SQL on the smallest dataset."""

    def check(name: str, fn, sql: str) -> None:
        assert rows(fn(spark, DATA)) == rows(duck.sql(sql)), name

    return check
