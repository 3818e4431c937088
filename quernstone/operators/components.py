"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.plans.durable import durable


def _stars(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Hang neighbours on the smallest node of each neighbourhood.

    Only the minimum of a neighbourhood is aggregated (map-side combined), never its members, so a hub
    of any degree costs no task more than its share of rows.
    """
    if larger_only:
        arcs = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        arcs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = arcs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    hung = arcs.join(low, "a")
    if larger_only:
        return hung.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    own = low.select("a", F.col("m").alias("b"))
    return hung.select(F.col("b").alias("a"), F.col("m").alias("b")).union(own).where(F.col("a") != F.col("b")).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges``; component is the smallest node id reachable.

    Large-star and small-star rounds alternate until the edge table stops changing, each round written to
    the shared folder. Null ends and self-loops are ignored; a node that appears only in those has no row.
    An empty table gives an empty table.
    """
    cur = durable(
        edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
        .where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
        .distinct(),
        narrow=True,
    )
    seen = None
    for _ in range(max_rounds):
        big = _stars(cur, larger_only=True)
        cur = durable(_stars(big, larger_only=False), narrow=True)
        now = tuple(cur.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first())
        if now == seen:
            return cur.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                cur.select(F.col("b").alias("node"), F.col("b").alias("component"))
            ).distinct()
        seen = now
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")
