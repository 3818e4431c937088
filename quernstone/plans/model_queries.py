"""Model queries over lineitem contests, labelled documents and customers as points."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernstone.operators import models as m
from quernstone.plans.stats_queries import PRED_SQL, predictions
from quernstone.sources.tables import table

#: Fixed outlines over the unit square: a triangle, a square with a notch, and a corner.
OUTLINES = {"triangle": [(0.0, 0.0), (0.5, 0.0), (0.0, 0.5)], "notched": [(0.5, 0.5), (0.95, 0.5), (0.7, 0.7), (0.95, 0.95), (0.5, 0.95)], "corner": [(0.6, 0.05), (0.9, 0.05), (0.9, 0.3)]}
EDGES = [(a, *p, *q) for a, ring in OUTLINES.items() for p, q in zip(ring, ring[1:] + ring[:1], strict=True)]


def seat_calibration(spark, base):
    p = predictions(spark, base).where("size >= 3").withColumn("z", F.col("predicted") / 20)
    out = m.calibrate_to_seats(p, ["contest"], "z", F.lit(2.0))
    return out.groupBy("contest").agg(F.round(F.sum("p"), 4).alias("seats"), F.count("*").alias("entries"))


def point_in_polygon(spark, base):
    """Customers at hashed places, in at most one outline each."""
    pts = table(spark, base, "customer").select("c_custkey", ((F.col("c_custkey") * 7919 % 1000) / 1000.0 + 0.0005).alias("px"), ((F.col("c_custkey") * 104729 % 997) / 997.0 + 0.0003).alias("py"))
    edges = spark.createDataFrame(EDGES, "area string, x1 double, y1 double, x2 double, y2 double")
    return m.points_in_polygons(pts, "px", "py", edges, 1 / 16).select("c_custkey", "area", "n_areas")


def architecture_selection(spark, base):
    """Prediction, equal split and their mean, compared over elections as folds."""
    p = predictions(spark, base)
    e = lambda x: F.abs(x - F.col("observed"))
    long = p.select("election", F.explode(F.array(*[F.struct(F.lit(k).alias("model"), v.alias("e")) for k, v in {"equal": e(100 / F.col("size")), "votes": e(F.col("predicted")), "mean": e((F.col("predicted") + 100 / F.col("size")) / 2)}.items()])).alias("s"))
    s = long.groupBy("s.model", "election").agg(F.count("*").alias("n"), F.round(F.avg("s.e"), 6).alias("error"))
    return m.select_architecture(s, "model", "election", "n", "error", "equal", 0.5, 1)


QUERIES = {
    "seat_calibration": (seat_calibration, f"WITH {PRED_SQL} SELECT contest, CAST(2.0 AS DOUBLE) AS seats, count(*) AS entries FROM t WHERE size >= 3 GROUP BY contest"),
    "point_in_polygon": (point_in_polygon, f"WITH p AS (SELECT c_custkey, (c_custkey * 7919 % 1000) / 1000.0 + 0.0005 AS px, (c_custkey * 104729 % 997) / 997.0 + 0.0003 AS py FROM customer), e(area, x1, y1, x2, y2) AS (VALUES {', '.join(map(str, EDGES))}), i AS (SELECT c_custkey, area FROM p JOIN e ON (y1 > py) <> (y2 > py) AND px < x1 + (py - y1) * (x2 - x1) / nullif(y2 - y1, 0) GROUP BY ALL HAVING count(*) % 2 = 1), n AS (SELECT c_custkey, count(*) AS n, max(area) AS area FROM i GROUP BY 1) SELECT p.c_custkey, CASE WHEN n = 1 THEN area END AS area, coalesce(n, 0) AS n_areas FROM p LEFT JOIN n USING (c_custkey)"),
    "architecture_selection": (architecture_selection, f"WITH {PRED_SQL}, l AS (SELECT election, 'equal' AS model, abs(100 / size - observed) AS e FROM t UNION ALL SELECT election, 'votes', abs(predicted - observed) FROM t UNION ALL SELECT election, 'mean', abs((predicted + 100 / size) / 2 - observed) FROM t), s AS (SELECT model, election, count(*) AS n, round(avg(e), 6) AS error FROM l GROUP BY ALL), j AS (SELECT s.*, b.error AS be FROM s JOIN s b ON s.election = b.election AND b.model = 'equal'), p AS (SELECT model, round(sum(n * error) / sum(n), 6) AS pooled, count(*) FILTER (error > be) AS adverse, round(sum(n * be) / sum(n), 6) AS base_pooled FROM j GROUP BY model), o AS (SELECT *, base_pooled - pooled >= 0.5 AND adverse <= 1 AS ok FROM p) SELECT model, pooled, adverse, base_pooled, CASE WHEN ok THEN 'chosen' WHEN model = 'equal' AND NOT bool_or(ok) OVER () THEN 'kept' ELSE 'rejected' END AS verdict FROM o"),
}
