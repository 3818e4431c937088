"""Model operators whose passes over the data are aggregations; only small systems are solved on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernstone.plans.durable import durable


def logistic_newton(df: DataFrame, columns: list[str], y: str, ridge: float = 1e-3, steps: int = 12, tolerance: float = 1e-9) -> dict[str, float]:
    """Logistic regression by Newton steps: each step is one aggregation of gradient and Hessian sums."""
    names = ["1", *columns]
    x = [F.lit(1.0), *[F.col(c).cast("double") for c in columns]]
    w = np.zeros(len(x))
    pairs = [(i, j) for i in range(len(x)) for j in range(i, len(x))]
    for _ in range(steps):
        z = sum((F.lit(float(a)) * b for a, b in zip(w, x, strict=True)), F.lit(0.0))
        p = 1 / (1 + F.exp(-z))
        row = df.select(p.alias("p"), F.col(y).cast("double").alias("y"), *[c.alias(f"x{i}") for i, c in enumerate(x)]).agg(
            *[F.sum((F.col("y") - F.col("p")) * F.col(f"x{i}")).alias(f"g{i}") for i in range(len(x))],
            *[F.sum(F.col("p") * (1 - F.col("p")) * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"h{i}_{j}") for i, j in pairs],
        ).first()
        g = np.array([row[f"g{i}"] for i in range(len(x))]) - ridge * w
        h = np.zeros((len(x), len(x)))
        for i, j in pairs:
            h[i, j] = h[j, i] = row[f"h{i}_{j}"]
        step = np.linalg.solve(h + ridge * np.eye(len(x)), g)
        w = w + step
        if np.abs(step).max() < tolerance:
            break
    return dict(zip(names, map(float, w), strict=True))


def calibrate_to_seats(df: DataFrame, keys: list[str], logit: str, seats: Column, rounds: int = 50) -> DataFrame:
    """Shift each group's logits by one number so that its probabilities sum to its seats, by bisection.

    The group's logits are one short array (a contest's entries); the bisection runs inside the row.
    """
    per = df.groupBy(*keys).agg(F.collect_list(logit).alias("__z"), F.max(seats).cast("double").alias("__s"))
    total = lambda zs, m: F.aggregate(zs, F.lit(0.0), lambda a, z: a + 1 / (1 + F.exp(-(z + m))))
    start = F.struct(F.lit(-30.0).alias("lo"), F.lit(30.0).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        low = total(F.col("__z"), mid) < F.col("__s")
        return F.struct(F.when(low, mid).otherwise(s["lo"]).alias("lo"), F.when(low, s["hi"]).otherwise(mid).alias("hi"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, halve)
    shift = per.select(*keys, ((found["lo"] + found["hi"]) / 2).alias("shift"))
    return df.join(shift, keys).withColumn("p", 1 / (1 + F.exp(-(F.col(logit) + F.col("shift")))))


def points_in_polygons(points: DataFrame, x: str, y: str, edges: DataFrame, cell: float) -> DataFrame:
    """``points`` with area and n_areas: the area whose outline a ray from the point crosses an odd number of times,
    null unless exactly one does; n_areas tells none, one and several apart. Repeated and null points each keep their row.

    ``edges``: area, x1, y1, x2, y2 of every outline. Points and edges meet by horizontal strips of height ``cell``, an equi-join
    of each point with the few edges of its strip.
    """
    rows = durable(points.withColumn("id_", F.monotonically_increasing_id()))
    strip = lambda c: F.floor(c / cell)
    cut_up = edges.withColumn("strip_", F.explode(F.sequence(strip(F.least("y1", "y2")), strip(F.greatest("y1", "y2")))))
    up = (F.col("y1") > F.col(y)) != (F.col("y2") > F.col(y))
    cut = F.col("x1") + (F.col(y) - F.col("y1")) * (F.col("x2") - F.col("x1")) / F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0))
    crossed = rows.select("id_", x, y, strip(F.col(y)).alias("strip_")).join(cut_up, "strip_").where(up & (F.col(x) < cut))
    inside = crossed.groupBy("id_", "area").agg((F.count("*") % 2).alias("odd")).where("odd = 1")
    found = inside.groupBy("id_").agg(F.count("*").alias("n_areas"), F.max("area").alias("area"))
    out = rows.join(found, "id_", "left").withColumn("n_areas", F.coalesce("n_areas", F.lit(0)))
    return out.select(*points.columns, F.when(F.col("n_areas") == 1, F.col("area")).alias("area"), "n_areas")


def select_architecture(scores: DataFrame, model: str, fold: str, n: str, error: str, base: str, margin: float, max_adverse: int) -> DataFrame:
    """One row per model: pooled error weighted by rows, folds in which it loses to ``base``, and the verdict:
    chosen if it gains ``margin`` with at most ``max_adverse`` losing folds, the base otherwise."""
    b = scores.where(F.col(model) == base).select(fold, F.col(error).alias("__b"))
    per = scores.join(b, fold).groupBy(model).agg(
        F.round(F.sum(F.col(n) * F.col(error)) / F.sum(n), 6).alias("pooled"), F.count(F.when(F.col(error) > F.col("__b"), 1)).alias("adverse"), F.round(F.sum(F.col(n) * F.col("__b")) / F.sum(n), 6).alias("base_pooled")
    )
    ok = (F.col("base_pooled") - F.col("pooled") >= margin) & (F.col("adverse") <= max_adverse)
    won = F.max(F.when(ok, 1).otherwise(0)).over(Window.partitionBy(F.lit(0)))
    return per.withColumn("verdict", F.when(ok, "chosen").when((F.col(model) == base) & (won == 0), "kept").otherwise("rejected"))
