"""Polygons as tables of edges: areas, and the overlap join of two layers, as sums over edges.

A polygon of any shape, with holes and several parts, is the signed sum of the strips below its edges. So the area that two polygons share is the sum over
pairs of their edges of sign x sign x the integral of the lower of both lines over the x range where both run: no polygon is
clipped and no geometry library is needed. Edges are cut at multiples of ``strip``, so a pair of edges meets only if both run through the same strip.

Which polygons meet at all is found by a grid: a polygon's box is posted in each cell that it touches, boxes meet in cells, and a pair belongs
to the cell that holds the lower left corner of what the boxes share, so no pair is found twice and none need be removed.

Defined results: rings with fewer than three different points have no area; which way a ring turns does not matter, its role (outer or hole) does; null
coordinates drop their point; polygons without area overlap nothing; repeated rings of an area add up; empty layers give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions.text import let
from quernstone.plans.durable import durable

POINT = "array<struct<x: double, y: double>>"


def geojson_rings(df: DataFrame, area: str, geometry: str) -> DataFrame:
    """(area, hole, points) of every ring of GeoJSON Polygons and MultiPolygons; geometries of other types, or that are not JSON, have none."""
    head = F.from_json(F.col(geometry), "type string, coordinates string")
    polygons = F.when(head["type"] == "MultiPolygon", F.from_json(head["coordinates"], "array<array<array<array<double>>>>")).when(
        head["type"] == "Polygon", F.array(F.from_json(head["coordinates"], "array<array<array<double>>>"))
    )
    parts = df.select(F.col(area).alias("area"), F.explode(polygons).alias("rings")).select("area", F.posexplode("rings").alias("k", "ring"))
    points = F.transform("ring", lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))
    return parts.select("area", (F.col("k") > 0).alias("hole"), points.alias("points"))


def edges_of(rings: DataFrame) -> DataFrame:
    """(area, xa, ya, xb, yb, sign) with xa < xb for each edge of ``rings`` (area, hole, points); upright edges bound nothing and are left out."""
    clean = F.filter(F.col("points").cast(POINT), lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    closed = let(clean, lambda p: F.transform(p, lambda a, i: F.struct(a.alias("a"), F.get(p, (i + 1) % F.size(p)).alias("b"))))
    x0 = lambda e: F.get(e, F.lit(0))["a"]["x"]  # noqa: E731  near values lose fewer digits
    turn = F.aggregate("pairs", F.lit(0.0), lambda s, e: s + ((e["a"]["x"] - x0(F.col("pairs"))) * e["b"]["y"] - (e["b"]["x"] - x0(F.col("pairs"))) * e["a"]["y"]))
    flat = rings.select("area", "hole", closed.alias("pairs")).where(F.size("pairs") > 2).withColumn("turn", turn).where("turn <> 0")
    e = flat.select("area", F.when(F.col("hole") == (F.col("turn") > 0), 1).otherwise(-1).alias("way"), F.explode("pairs").alias("e")).select("area", "way", "e.a", "e.b").where("a.x <> b.x")
    forth = F.col("a.x") < F.col("b.x")
    end = lambda first, k: F.when(forth, F.col(f"{'a' if first else 'b'}.{k}")).otherwise(F.col(f"{'b' if first else 'a'}.{k}"))
    return e.select("area", end(True, "x").alias("xa"), end(True, "y").alias("ya"), end(False, "x").alias("xb"), end(False, "y").alias("yb"), (F.col("way") * F.when(forth, 1).otherwise(-1)).alias("sign"))


def outlines(edges: DataFrame) -> DataFrame:
    """(area, size, x0, y0, x1, y1): area and box of every polygon with an area above 0."""
    size = F.sum(F.col("sign") * (F.col("xb") - F.col("xa")) * (F.col("ya") + F.col("yb")) / 2)
    box = [F.min("xa").alias("x0"), F.min(F.least("ya", "yb")).alias("y0"), F.max("xb").alias("x1"), F.max(F.greatest("ya", "yb")).alias("y1")]
    return edges.groupBy("area").agg(size.alias("size"), *box).where("size > 0")


def box_pairs(left: DataFrame, right: DataFrame, cell: float) -> DataFrame:
    """(area, other): polygons of two layers of ``outlines`` whose boxes share more than a border."""
    at = lambda c: F.floor(c / cell)

    def posted(layer: DataFrame, end: str) -> DataFrame:
        cells = layer.withColumn("cx", F.explode(F.sequence(at(F.col("x0")), at(F.col("x1"))))).withColumn("cy", F.explode(F.sequence(at(F.col("y0")), at(F.col("y1")))))
        return cells.select("cx", "cy", *[F.col(c).alias(c + end) for c in ("area", "x0", "y0", "x1", "y1")])

    met = posted(left, "_a").join(posted(right, "_b"), ["cx", "cy"])
    low = lambda k: F.greatest(f"{k}0_a", f"{k}0_b")
    share = (low("x") < F.least("x1_a", "x1_b")) & (low("y") < F.least("y1_a", "y1_b"))
    own = (F.col("cx") == at(low("x"))) & (F.col("cy") == at(low("y")))
    return met.where(share & own).select(F.col("area_a").alias("area"), F.col("area_b").alias("other"))


def lower_integral(xa: Column, xb: Column, p: tuple[Column, Column], q: tuple[Column, Column]) -> Column:
    """The integral from xa to xb of the lower of two lines, given by their values at both ends."""
    da, db = p[0] - q[0], p[1] - q[1]
    apart = F.when(da * db >= 0, F.abs(da + db) / 2).otherwise((da * da + db * db) / (2 * (F.abs(da) + F.abs(db))))
    return (xb - xa) * ((p[0] + p[1] + q[0] + q[1]) / 4 - apart / 2)


def overlaps(left: DataFrame, right: DataFrame, cell: float, strip: float, least_area: float, least_percent: float) -> DataFrame:
    """area, other, shared, area_percent, other_percent for all pairs of two layers of edges that share at least ``least_area`` and at least
    ``least_percent`` of both; slivers along common borders stay below these.

    ``cell``: about a polygon's extent; ``strip``: about an edge's.
    """
    left, right = durable(left), durable(right)
    a, b = durable(outlines(left)), durable(outlines(right))
    pairs = durable(box_pairs(a, b, cell))
    middle = a.select("area", ((F.col("y0") + F.col("y1")) / 2).alias("mid"))  # heights count from here, to lose fewer digits

    def dealt(layer: DataFrame, key: str) -> DataFrame:
        at = lambda c: F.floor(c / strip)
        own = layer.select(F.col("area").alias(key), F.struct("xa", "ya", "xb", "yb", "sign").alias(key + "_e"), F.explode(F.sequence(at(F.col("xa")), at(F.col("xb")))).alias("strip_"))
        return pairs.join(own, key).select("area", "other", "strip_", key + "_e")

    met = dealt(left, "area").join(dealt(right, "other"), ["area", "other", "strip_"]).join(middle, "area")
    p, q = F.col("area_e"), F.col("other_e")
    xa = F.greatest(p["xa"], q["xa"], F.col("strip_") * strip)
    xb = F.least(p["xb"], q["xb"], (F.col("strip_") + 1) * strip)
    y = lambda e, x: e["ya"] - F.col("mid") + (e["yb"] - e["ya"]) * ((x - e["xa"]) / (e["xb"] - e["xa"]))
    ends = met.select("area", "other", (p["sign"] * q["sign"]).alias("s"), xa.alias("a"), xb.alias("b"), p.alias("p"), q.alias("q"), "mid").where("a < b")
    a_, b_, p, q = F.col("a"), F.col("b"), F.col("p"), F.col("q")
    part = F.col("s") * lower_integral(a_, b_, (y(p, a_), y(p, b_)), (y(q, a_), y(q, b_)))
    shared = ends.groupBy("area", "other").agg(F.sum(part).alias("shared"))
    found = shared.join(a.select("area", F.col("size").alias("size_a")), "area").join(b.select(F.col("area").alias("other"), F.col("size").alias("size_b")), "other")
    of = lambda c: 100 * F.col("shared") / F.col(c)
    wanted = (F.col("shared") >= least_area) & (F.least(of("size_a"), of("size_b")) >= least_percent)
    return found.where(wanted).select("area", "other", F.round("shared", 3).alias("shared"), F.round(of("size_a"), 6).alias("area_percent"), F.round(of("size_b"), 6).alias("other_percent"))
