"""Polygon queries: areas around blocks of customers, with holes, against areas of their orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernstone.operators import geometry as g
from quernstone.sources.tables import table

A_KEYS, B_KEYS = 50, 70


def _diamond(x0, y0, x1, y1):
    mx, my = (x0 + x1) / 2, (y0 + y1) / 2
    return F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((x0, my), (mx, y0), (x1, my), (mx, y1))])


def customer_boxes(spark, base):
    """Blocks of customers: balance (hundreds) by key (tens)."""
    c = table(spark, base, "customer").groupBy(F.floor(F.col("c_custkey") / A_KEYS).alias("area"))
    k, x = F.col("c_custkey").cast("double") / 10, F.col("c_acctbal").cast("double") / 100
    return c.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(k).alias("y0"), F.max(k).alias("y1"))


def customer_rings(spark, base):
    """Each block's diamond, with a hole of half its extent."""
    b = customer_boxes(spark, base)
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    hole = _diamond(x0 + (x1 - x0) / 4, y0 + (y1 - y0) / 4, x1 - (x1 - x0) / 4, y1 - (y1 - y0) / 4)
    outer = b.select("area", F.lit(False).alias("hole"), _diamond(x0, y0, x1, y1).alias("points"))
    return outer.unionByName(b.select("area", F.lit(True).alias("hole"), hole.alias("points")))


def order_rings(spark, base):
    """Blocks of orders by customer: rectangles of price (four thousands) by customer key (tens)."""
    o = table(spark, base, "orders").groupBy(F.floor(F.col("o_custkey") / B_KEYS).alias("area"))
    k, x = F.col("o_custkey").cast("double") / 10, F.col("o_totalprice").cast("double") / 4000
    b = o.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(k).alias("y0"), F.max(k).alias("y1"))
    points = F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in (("x0", "y0"), ("x0", "y1"), ("x1", "y1"), ("x1", "y0"))])
    return b.select("area", F.lit(False).alias("hole"), points.alias("points"))


def polygon_overlap(spark, base):
    return g.overlaps(g.edges_of(customer_rings(spark, base)), g.edges_of(order_rings(spark, base)), 32.0, 32.0, 0.5, 0.01)


def geojson_areas(spark, base):
    """Pairs of blocks as one GeoJSON MultiPolygon each, with holes; read back, measured and boxed."""
    ring = F.transform(F.concat("points", F.slice("points", 1, 1)), lambda p: F.array(p["x"], p["y"]))
    rings = customer_rings(spark, base).select("area", F.col("hole").cast("int").alias("h"), ring.alias("ring"))
    parts = rings.groupBy("area").agg(F.transform(F.array_sort(F.collect_list(F.struct("h", "ring"))), lambda r: r["ring"]).alias("part"))
    many = parts.groupBy(F.floor(F.col("area") / 2).alias("area")).agg(F.collect_list("part").alias("coordinates"))
    text = many.select("area", F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), "coordinates")).alias("geometry"))
    found = g.outlines(g.edges_of(g.geojson_rings(text, "area", "geometry")))
    return found.select("area", *[F.round(c, 4).alias(c) for c in ("size", "x0", "y0", "x1", "y1")])


BOX_SQL = f"c AS (SELECT c_custkey // {A_KEYS} AS area, min(c_acctbal) / 100.0 AS x0, max(c_acctbal) / 100.0 AS x1, min(c_custkey) / 10.0 AS y0, max(c_custkey) / 10.0 AS y1 FROM customer GROUP BY 1)"
OVERLAP_SQL = f"""WITH {BOX_SQL},
r AS (SELECT area, 1 AS w, x0, y0, x1, y1 FROM c UNION ALL SELECT area, -1, x0 + (x1 - x0) / 4, y0 + (y1 - y0) / 4, x1 - (x1 - x0) / 4, y1 - (y1 - y0) / 4 FROM c),
m AS (SELECT *, (x0 + x1) / 2 AS mx, (y0 + y1) / 2 AS my FROM r),
e AS (SELECT area, w * s AS s, xa, ya, xb, yb FROM (SELECT area, w, unnest([struct_pack(s := 1, xa := x0, ya := my, xb := mx, yb := y1), struct_pack(s := 1, xa := mx, ya := y1, xb := x1, yb := my), struct_pack(s := -1, xa := x0, ya := my, xb := mx, yb := y0), struct_pack(s := -1, xa := mx, ya := y0, xb := x1, yb := my)], recursive := true) FROM m)),
o AS (SELECT o_custkey // {B_KEYS} AS other, min(o_totalprice) / 4000.0 AS x0, max(o_totalprice) / 4000.0 AS x1, min(o_custkey) / 10.0 AS y0, max(o_custkey) / 10.0 AS y1 FROM orders GROUP BY 1),
f AS (SELECT other, x0, x1, 1 AS s, y1 AS y FROM o UNION ALL SELECT other, x0, x1, -1, y0 FROM o),
j AS (SELECT area, other, e.s * f.s AS s, greatest(xa, x0) AS a, least(xb, x1) AS b, ya, yb, xa, xb, y FROM e JOIN f ON greatest(xa, x0) < least(xb, x1)),
v AS (SELECT *, ya + (yb - ya) * (a - xa) / (xb - xa) - y AS da, ya + (yb - ya) * (b - xa) / (xb - xa) - y AS db FROM j),
q AS (SELECT area, other, sum(s * (b - a) * ((da + db) / 4 - CASE WHEN da * db >= 0 THEN abs(da + db) / 4 ELSE (da * da + db * db) / (abs(da) + abs(db)) / 4 END)) AS shared FROM v GROUP BY ALL),
x AS (SELECT q.*, 100 * shared / ((c.x1 - c.x0) * (c.y1 - c.y0) * 3 / 8) AS ap, 100 * shared / ((o.x1 - o.x0) * (o.y1 - o.y0)) AS op FROM q JOIN c USING (area) JOIN o USING (other))
SELECT area, other, round(shared, 3) AS shared, round(ap, 6) AS area_percent, round(op, 6) AS other_percent FROM x WHERE shared >= 0.5 AND least(ap, op) >= 0.01"""

QUERIES = {
    "polygon_overlap": (polygon_overlap, OVERLAP_SQL),
    "geojson_areas": (geojson_areas, f"WITH {BOX_SQL} SELECT area // 2 AS area, round(sum((x1 - x0) * (y1 - y0) * 3 / 8), 4) AS size, round(min(x0), 4) AS x0, round(min(y0), 4) AS y0, round(max(x1), 4) AS x1, round(max(y1), 4) AS y1 FROM c GROUP BY 1"),
}
