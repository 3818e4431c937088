"""Ridge fits over three columns from moments: sums per group, solved in closed form, as expressions that need no Python.

A table has columns x1, x2, x3 and y. ``MOMENTS`` sums them; sums of groups add up, so leaving a group out, or taking only
earlier ones, is a subtraction or a running sum of a few rows, and every fold is solved where its row lies.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAMES = ["n", "s1", "s2", "s3", "sy", "p11", "p12", "p13", "p22", "p23", "p33", "q1", "q2", "q3", "yy"]
_SUMS = ["count(*)", "sum(x1)", "sum(x2)", "sum(x3)", "sum(y)", "sum(x1 * x1)", "sum(x1 * x2)", "sum(x1 * x3)", "sum(x2 * x2)", "sum(x2 * x3)", "sum(x3 * x3)", "sum(x1 * y)", "sum(x2 * y)", "sum(x3 * y)", "sum(y * y)"]
#: SQL aggregates that make the moments of a group.
MOMENTS = [f"CAST({e} AS DOUBLE) AS {name}" for e, name in zip(_SUMS, NAMES, strict=True)]


def centred(penalty: str) -> list[str]:
    """Centred moments with the ridge penalty on the diagonal (the intercept is not shrunk)."""
    out = [f"p{i}{j} - s{i} * s{j} / n{' + ' + penalty if i == j else ''} AS c{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3) if i <= j]
    return out + [f"q{i} - s{i} * sy / n AS d{i}" for i in (1, 2, 3)]


_DET = "(c11 * (c22 * c33 - c23 * c23) - c12 * (c12 * c33 - c23 * c13) + c13 * (c12 * c23 - c22 * c13))"
#: The weights from centred moments, by Cramer's rule; null where the columns are dependent.
WEIGHTS = [
    f"(d1 * (c22 * c33 - c23 * c23) - c12 * (d2 * c33 - c23 * d3) + c13 * (d2 * c23 - c22 * d3)) / nullif({_DET}, 0) AS w1",
    f"(c11 * (d2 * c33 - c23 * d3) - d1 * (c12 * c33 - c23 * c13) + c13 * (c12 * d3 - d2 * c13)) / nullif({_DET}, 0) AS w2",
    f"(c11 * (c22 * d3 - d2 * c23) - c12 * (c12 * d3 - d2 * c13) + d1 * (c12 * c23 - c22 * c13)) / nullif({_DET}, 0) AS w3",
]
INTERCEPT = "(sy - w1 * s1 - w2 * s2 - w3 * s3) / n AS w0"


def squared_error(t: str = "t_") -> str:
    """The mean squared error of (w0..w3) on a group whose moments are prefixed ``t``."""
    m = {k: t + k for k in NAMES}
    wpw = f"w1 * w1 * {m['p11']} + w2 * w2 * {m['p22']} + w3 * w3 * {m['p33']} + 2 * (w1 * w2 * {m['p12']} + w1 * w3 * {m['p13']} + w2 * w3 * {m['p23']})"
    ws, wq = f"(w1 * {m['s1']} + w2 * {m['s2']} + w3 * {m['s3']})", f"(w1 * {m['q1']} + w2 * {m['q2']} + w3 * {m['q3']})"
    return f"({m['yy']} - 2 * (w0 * {m['sy']} + {wq}) + {m['n']} * w0 * w0 + 2 * w0 * {ws} + {wpw}) / {m['n']}"


def solved(df, penalty: str = "penalty"):
    """A table of moments with the weights w0 to w3 of each row."""
    return df.selectExpr("*", *centred(penalty)).selectExpr("*", *WEIGHTS).selectExpr("*", INTERCEPT)


def solved_sql(source: str, name: str, penalty: str = "penalty") -> str:
    """The CTEs of ``solved`` over ``source``; the last is ``name``."""
    return f"{name}_c AS (SELECT *, {', '.join(centred(penalty))} FROM {source}), {name}_w AS (SELECT *, {', '.join(WEIGHTS)} FROM {name}_c), {name} AS (SELECT *, {INTERCEPT} FROM {name}_w)"


def pooled_fit(df: DataFrame, columns: list[str], y: str, group: str, fixed: float, pooled: float) -> tuple[dict[str, float], DataFrame]:
    """A share model with two penalties: ``fixed`` on the columns' weights, ``pooled`` on one effect per ``group``; the intercept is free.

    Returns the intercept and weights, and (group, n, effect, own_weight) with own_weight = n / (n + pooled), the part of an effect that comes from the
    group's own rows. The effects are eliminated: given the rest, a group's effect is its residuals' sum over n + pooled, which leaves a system of one row per column.
    It is made of sums by group (one row per group, which may be many) and their totals, so nothing but that system reaches the driver.
    Rows with a null in y or a column are left out; null is a group of its own; no rows give weights of 0 and no groups.
    """
    if fixed < 0 or pooled < 0:
        raise ValueError("penalties must not be negative")
    names = ["one", *columns]
    x = [F.lit(1.0), *[F.col(c).cast("double") for c in columns]]
    rows = df.select(F.col(group).alias("g"), F.col(y).cast("double").alias("y"), *[c.alias(f"x{i}") for i, c in enumerate(x)]).dropna(subset=["y", *[f"x{i}" for i in range(len(x))]])
    pairs = [(i, j) for i in range(len(x)) for j in range(i, len(x))]
    z = lambda i: F.col(f"x{i}")
    per = rows.groupBy("g").agg(
        F.count("*").alias("n"), F.sum("y").alias("sy"), *[F.sum(z(i)).alias(f"s{i}") for i in range(len(x))],
        *[F.sum(z(i) * z(j)).alias(f"p{i}_{j}") for i, j in pairs], *[F.sum(z(i) * F.col("y")).alias(f"q{i}") for i in range(len(x))],
    )
    less = 1 / (F.col("n") + F.lit(float(pooled)))
    left = per.agg(
        *[F.sum(F.col(f"p{i}_{j}") - F.col(f"s{i}") * F.col(f"s{j}") * less).alias(f"p{i}_{j}") for i, j in pairs],
        *[F.sum(F.col(f"q{i}") - F.col(f"s{i}") * F.col("sy") * less).alias(f"q{i}") for i in range(len(x))],
    ).first()
    a, b = np.zeros((len(x), len(x))), np.array([left[f"q{i}"] or 0.0 for i in range(len(x))])
    for i, j in pairs:
        a[i, j] = a[j, i] = left[f"p{i}_{j}"] or 0.0
    w = np.linalg.lstsq(a + fixed * np.diag([0.0] + [1.0] * len(columns)), b, rcond=None)[0]
    residual = F.col("sy") - sum((F.lit(float(v)) * F.col(f"s{i}") for i, v in enumerate(w)), F.lit(0.0))
    effects = per.select(F.col("g").alias(group), "n", (residual * less).alias("effect"), (F.col("n") * less).alias("own_weight"))
    return dict(zip(names, map(float, w), strict=True)), effects
