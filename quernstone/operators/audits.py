"""Audits as tables of counts that must be zero, and gates that refuse when they are not."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.plans.durable import durable


def count_gates(df: DataFrame, layer: str, gates: dict[str, Column]) -> DataFrame:
    """(layer, gate, violations, rows) in one pass: how many rows break each gate; a null condition does not break it."""
    one = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(F.when(c, 1)).alias(k) for k, c in gates.items()])
    pairs = F.array(*[F.struct(F.lit(k).alias("gate"), F.col(k).alias("violations")) for k in gates])
    return one.select(F.lit(layer).alias("layer"), F.explode(pairs).alias("g"), "rows").select("layer", "g.gate", "g.violations", "rows")


def key_gates(df: DataFrame, layer: str, key: str) -> DataFrame:
    """Repeated and null keys of a table, in the form of ``count_gates``."""
    per = df.groupBy(key).agg(F.count("*").alias("n"))
    out = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count(F.when((F.col("n") > 1) & F.col(key).isNotNull(), 1)).alias("repeated_key"), F.coalesce(F.sum(F.when(F.col(key).isNull(), F.col("n"))), F.lit(0)).alias("null_key"))
    return out.select(F.lit(layer).alias("layer"), F.explode(F.array(*[F.struct(F.lit(k).alias("gate"), F.col(k).alias("violations")) for k in ("repeated_key", "null_key")])).alias("g"), "rows").select("layer", "g.gate", "g.violations", "rows")


def set_gates(left: DataFrame, right: DataFrame, layer: str, key: str) -> DataFrame:
    """Keys that only one of two tables has, in the form of ``count_gates``."""
    both = left.select(key).distinct().withColumn("l", F.lit(True)).join(right.select(key).distinct().withColumn("r", F.lit(True)), key, "full")
    return count_gates(both, layer, {"left_only": F.col("r").isNull(), "right_only": F.col("l").isNull()})


def reference_gates(pairs: DataFrame, layer: str, a: str, b: str, keys: DataFrame, key: str) -> DataFrame:
    """References a -> b that point nowhere, to themselves, to each other, or around a ring of any length, in the form of ``count_gates``."""
    p = pairs.select(a, b).distinct()
    known = keys.select(F.col(key).alias(b)).distinct().withColumn("known", F.lit(True))
    back = p.select(F.col(b).alias(a), F.col(a).alias(b)).withColumn("mutual", F.lit(True))
    x = p.join(known, b, "left").join(back, [a, b], "left")
    ring = circular(p, a, b).select(F.col("node").alias(a), F.col("to").alias(b), "on_cycle")
    x = x.join(ring, [a, b], "left")
    return count_gates(x, layer, {"circular": F.col("on_cycle"), "dangling": F.col("known").isNull() & F.col(b).isNotNull(), "self": F.col(a) == F.col(b), "mutual": F.col("mutual") & (F.col(a) != F.col(b))})


def circular(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(node, to, on_cycle) for every row with a reference: whether following references from it leads back to it, however long the ring.

    Each row refers to one other; of several, the least is followed, and references to itself or from or to null are left out. Pointers are doubled: after k
    rounds a row points 2^k references ahead, and rows whose chain has ended are gone. Once that exceeds the number of rows, whatever is still
    pointed at lies on a ring. So a ring of a million rows takes twenty joins.
    """
    first = durable(pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).groupBy(F.col(a).alias("node")).agg(F.min(b).alias("to")))
    rows, ahead, jump = first.count(), 1, first
    while ahead <= rows:
        jump = durable(jump.join(jump.select(F.col("node").alias("to"), F.col("to").alias("next")), "to").select("node", F.col("next").alias("to")))
        ahead *= 2
        if jump.isEmpty():
            break
    rings = jump.select(F.col("to").alias("node")).distinct().withColumn("on_cycle", F.lit(True))
    return first.join(rings, "node", "left").na.fill(False, ["on_cycle"])


def union(*reports: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, reports)


def require_zero(report: DataFrame) -> None:
    """Refuse if any gate of a report has violations."""
    bad = report.where("violations > 0").limit(20).collect()
    if bad:
        raise ValueError(f"gates broken: {[(r['layer'], r['gate'], r['violations']) for r in bad]}")
