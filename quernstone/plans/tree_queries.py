"""Boosted trees and pooled shares over contests: folds by election with an inner early stop, and contributions of the features."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernstone.operators import fits
from quernstone.operators import trees as t
from quernstone.plans.durable import durable
from quernstone.plans.stats_queries import PRED_SQL, predictions

FEATURES = ["predicted", "size", "party"]
FOLDS = (2, 3)
ROUNDS, DEFAULT, LEAST, INNER = 4, 2, 20, 20
SIZES = {"depth": 2, "bins": 8, "rate": 0.3, "least": LEAST}


def contests(spark, base):
    return durable(predictions(spark, base).select("contest", "party", "size", "election", F.round("predicted", 6).alias("predicted"), F.round("observed", 6).alias("observed")))


def fold_model(p, fold):
    return t.fit_with_early_stop(p.where(F.col("election") < fold), FEATURES, "observed", "election", ROUNDS, ROUNDS, INNER, DEFAULT, **SIZES)


def boosted_folds(spark, base):
    p, out = contests(spark, base), None
    for fold in FOLDS:
        model = fold_model(p, fold)
        error = lambda c: F.round(F.avg(F.abs(c - F.col("observed"))), 6)
        one = p.where(F.col("election") == fold).groupBy("election").agg(F.lit(len(model.trees)).cast("long").alias("trees"), F.count("*").alias("n"), error(t.predicted(model)).alias("mae"), error(F.col("predicted")).alias("plain_mae"))
        out = one if out is None else out.unionByName(one)
    return out


def boosted_contributions(spark, base):
    """By party of the last fold: mean absolute contribution of each feature, and the largest gap of their sum to the prediction."""
    p = contests(spark, base)
    model = fold_model(p, FOLDS[-1])
    parts = t.contributions(model)
    rows = p.where(F.col("election") == FOLDS[-1]).select("party", t.predicted(model).alias("p"), *[c.alias(f"by_{k}") for k, c in parts.items()])
    gap = F.abs(sum((F.col(f"by_{k}") for k in parts), F.lit(t.mean_prediction(model))) - F.col("p"))
    return rows.groupBy("party").agg(F.count("*").alias("n"), *[F.round(F.avg(F.abs(f"by_{k}")), 6).alias(f"by_{k}") for k in parts], F.round(F.max(gap), 6).alias("gap"))


def _fit_sql(name: str, learned: str, held: str, rounds: int) -> list[str]:
    """CTEs of one fit over ``src``: role 0 learns, 1 is held out, 2 is told; ``name``_r{k} has the residual r after k trees."""
    k, out = len(FEATURES), []
    role = f"CASE WHEN {held} THEN 1 WHEN {learned} THEN 0 ELSE 2 END"
    for i, f in enumerate(FEATURES):
        width = f"(b - a) / {t.CELLS}"
        out.append(f"{name}_w{i} AS MATERIALIZED (SELECT CAST(min({f}) AS DOUBLE) AS a, CAST(max({f}) AS DOUBLE) AS b FROM src WHERE {role} = 0)")
        out.append(f"{name}_c{i} AS MATERIALIZED (SELECT CASE WHEN b > a THEN least(floor(({f} - a) / ({width})), {t.CELLS - 1}) ELSE 0 END AS cell, count(*) AS n, any_value(a) AS a, any_value({width}) AS width FROM src, {name}_w{i} WHERE {role} = 0 GROUP BY 1)")
        out.append(f"{name}_e{i} AS MATERIALIZED (SELECT a + (cell + 1) * width AS edge FROM (SELECT *, sum(n) OVER (ORDER BY cell) AS run, sum(n) OVER () AS total, max(cell) OVER () AS last FROM {name}_c{i}) WHERE cell < last AND run * {SIZES['bins']} // total > (run - n) * {SIZES['bins']} // total)")
    bins = ", ".join(f"1 + (SELECT count(*) FROM {name}_e{i} WHERE edge <= {f}) AS b{i}" for i, f in enumerate(FEATURES))
    out.append(f"{name}_y AS MATERIALIZED (SELECT contest, party, {role} AS role, CAST(round(observed * {t.UNIT}) AS BIGINT) AS y, {bins} FROM src)")
    out.append(f"{name}_r0 AS MATERIALIZED (SELECT *, y - (SELECT CAST(floor(CAST(sum(y) AS DOUBLE) / count(*) + 0.5) AS BIGINT) FROM {name}_y WHERE role = 0) AS r FROM {name}_y)")

    def splits(rows: str, node: str) -> str:
        """(node, f, bin): the best split of each node of ``rows`` that has enough rows."""
        long = " UNION ALL ".join(f"SELECT {node} AS node, {i} AS f, b{i} AS bin, r FROM {rows} WHERE role = 0" for i in range(k))
        score = lambda s, n: f"CAST({s} AS DOUBLE) * CAST({s} AS DOUBLE) / {n}"
        return f"""SELECT node, f, bin FROM (SELECT *, {score('s', 'n')} + {score('(ts - s)', '(tn - n)')} AS score FROM
(SELECT node, f, bin, sum(s) OVER (PARTITION BY node, f ORDER BY bin) AS s, sum(n) OVER (PARTITION BY node, f ORDER BY bin) AS n, sum(s) OVER (PARTITION BY node, f) AS ts, sum(n) OVER (PARTITION BY node, f) AS tn FROM (SELECT node, f, bin, sum(r) AS s, count(*) AS n FROM ({long}) GROUP BY ALL))
WHERE n >= {LEAST} AND tn - n >= {LEAST}) WHERE score > {score('ts', 'tn')} QUALIFY row_number() OVER (PARTITION BY node ORDER BY score DESC, f, bin) = 1"""

    pick = "CASE f " + " ".join(f"WHEN {i} THEN b{i}" for i in range(k)) + " END"
    for j in range(rounds):
        a = f"{name}_{j}"
        out.append(f"{a}s AS MATERIALIZED ({splits(f'{name}_r{j}', '0')})")
        out.append(f"{a}n AS MATERIALIZED (SELECT x.*, CASE WHEN f IS NULL THEN 0 WHEN {pick} <= bin THEN 1 ELSE 2 END AS node FROM {name}_r{j} x LEFT JOIN {a}s ON true)")
        out.append(f"{a}t AS MATERIALIZED ({splits(f'(SELECT * FROM {a}n WHERE node > 0)', 'node')})")
        out.append(f"{a}l AS MATERIALIZED (SELECT x.* EXCLUDE (node), CASE WHEN s.f IS NULL THEN x.node WHEN {pick.replace('CASE f', 'CASE s.f')} <= s.bin THEN 2 * x.node + 1 ELSE 2 * x.node + 2 END AS leaf FROM {a}n x LEFT JOIN {a}t s ON x.node = s.node)")
        out.append(f"{a}v AS MATERIALIZED (SELECT leaf, CAST(floor(CAST({SIZES['rate']} AS DOUBLE) * sum(r) / count(*) + 0.5) AS BIGINT) AS v FROM {a}l WHERE role = 0 GROUP BY 1)")
        out.append(f"{name}_r{j + 1} AS MATERIALIZED (SELECT contest, party, role, y, {', '.join(f'b{i}' for i in range(k))}, r - v AS r FROM {a}l JOIN {a}v USING (leaf))")
    return out


def _folds_sql() -> str:
    out, ends = ["src AS MATERIALIZED (SELECT contest, party, size, election, round(predicted, 6) AS predicted, round(observed, 6) AS observed FROM t)"], []
    for fold in FOLDS:
        day = f"(SELECT max(election) FROM (SELECT election, count(*) AS n FROM src WHERE election < {fold} GROUP BY 1) WHERE n >= {INNER} AND election > (SELECT min(election) FROM src WHERE election < {fold}))"
        out.append(f"d{fold} AS MATERIALIZED (SELECT {day} AS day)")
        inner = f"(SELECT day FROM d{fold})"
        out += _fit_sql(f"i{fold}", f"election < {inner}", f"election = {inner} AND election < {fold}", ROUNDS)
        errors = " UNION ALL ".join(f"SELECT {j} AS k, CAST(sum(abs(r)) AS DOUBLE) / count(*) AS error FROM i{fold}_r{j} WHERE role = 1" for j in range(ROUNDS + 1))
        out.append(f"k{fold} AS MATERIALIZED (SELECT coalesce(nullif((SELECT k FROM ({errors}) WHERE error IS NOT NULL ORDER BY error, k LIMIT 1), 0), {DEFAULT}) AS trees)")
        out += _fit_sql(f"o{fold}", f"election < {fold}", "false", ROUNDS)
        told = " UNION ALL ".join(f"SELECT {j} AS k, contest, party, (y - r) / {float(t.UNIT)} AS p FROM o{fold}_r{j} WHERE role = 2" for j in range(1, ROUNDS + 1))
        ends.append(f"SELECT election, any_value(trees) AS trees, count(*) AS n, round(avg(abs(p - observed)), 6) AS mae, round(avg(abs(predicted - observed)), 6) AS plain_mae FROM ({told}) JOIN k{fold} ON k = trees JOIN src USING (contest, party) WHERE election = {fold} GROUP BY election")
    return f"WITH {PRED_SQL}, {', '.join(out)} {' UNION ALL '.join(ends)}"


FIXED, POOLED = 5.0, 200.0


def pooled_shares(spark, base):
    """Shares by one column and an effect per party, pooled by its own penalty: every party's effect and how much of it is its own."""
    p = predictions(spark, base).select("party", "observed", "predicted")
    weights, effects = fits.pooled_fit(p, ["predicted"], "observed", "party", FIXED, POOLED)
    return effects.select("party", "n", F.round("effect", 5).alias("effect"), F.round("own_weight", 6).alias("own_weight"), F.round(F.lit(weights["one"]), 5).alias("intercept"), F.round(F.lit(weights["predicted"]), 5).alias("weight"))


POOLED_SQL = f"""WITH {PRED_SQL}, g AS (SELECT party, count(*) AS n, sum(predicted) AS sx, sum(observed) AS sy, sum(predicted * predicted) AS xx, sum(predicted * observed) AS xy FROM t GROUP BY 1),
m AS (SELECT sum(n - n * n / (n + {POOLED})) AS a, sum(sx - n * sx / (n + {POOLED})) AS b, sum(xx - sx * sx / (n + {POOLED})) + {FIXED} AS c, sum(sy - n * sy / (n + {POOLED})) AS u, sum(xy - sx * sy / (n + {POOLED})) AS v FROM g),
w AS (SELECT (c * u - b * v) / (a * c - b * b) AS w0, (a * v - b * u) / (a * c - b * b) AS w1 FROM m)
SELECT party, n, round((sy - w0 * n - w1 * sx) / (n + {POOLED}), 5) AS effect, round(n / (n + {POOLED}), 6) AS own_weight, round(w0, 5) AS intercept, round(w1, 5) AS weight FROM g, w"""
QUERIES = {"pooled_shares": (pooled_shares, POOLED_SQL), "boosted_folds": (boosted_folds, _folds_sql()), "boosted_contributions": (boosted_contributions, None)}
