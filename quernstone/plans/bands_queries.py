"""Band queries over events; the anchor day is 2024-01-31, an election is a ten-day block of users."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernstone.operators import bands as b
from quernstone.sources.tables import table

ANCHOR = "DATE '2024-01-31'"
LAG = f"datediff('day', CAST(ts AS DATE), {ANCHOR})"


def _case(scheme: str, lag: str = "lag") -> str:
    return "CASE " + " ".join(f"WHEN {lag} BETWEEN {lo} AND {hi} THEN '{label}'" for s, label, lo, hi in b.BANDS if s == scheme) + " END"


BASE_SQL = f"e AS (SELECT *, {LAG} AS lag, user_id % 4 AS election, CAST(substr(props, 7, length(props) - 7) AS BIGINT) AS k FROM events)"


def events(spark, base):
    rows = table(spark, base, "events")
    return rows.withColumn("lag", b.lag_days("ts", F.lit("2024-01-31").cast("date"))).withColumn("election", F.col("user_id") % 4).withColumn(
        "k", F.get_json_object("props", "$.k").cast("long")
    )


def lag_band_assign(spark, base):
    return events(spark, base).select("event_id", "lag", b.band_of(F.col("lag"), "standard").alias("band"))


def lag_band_range_join(spark, base):
    out = b.assign_bands(events(spark, base).select("event_id", "lag"), "lag", b.band_table(spark))
    return out.groupBy("scheme", "label").agg(F.count("*").alias("n"), F.sum("lag").alias("lags"))


def lag_band_cumulative(spark, base):
    return b.cumulative(events(spark, base), "lag").groupBy("snapshot", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def compare_schemes(spark, base):
    e = events(spark, base).select(b.band_of(F.col("lag"), "standard").alias("standard"), b.band_of(F.col("lag"), "coarse").alias("coarse"))
    return e.groupBy("standard", "coarse").agg(F.count("*").alias("n"))


def _grid(spark, base):
    e = events(spark, base).withColumn("band", b.band_of(F.col("lag"), "standard"))
    labels = spark.createDataFrame([(x[1],) for x in b.BANDS if x[0] == "standard"], "band string")
    counts = {"n": F.count("*"), "loud": F.count(F.when(F.col("value") > 10, 1))}
    all_rows = events(spark, base)
    return b.zero_filled(e, {"election": all_rows.select("election"), "event_type": all_rows.select("event_type"), "band": labels}, counts)


GRID_SQL = f"""{BASE_SQL}, f AS (SELECT *, {_case('standard')} AS band FROM e),
g AS (SELECT * FROM (SELECT DISTINCT election FROM e) CROSS JOIN (SELECT DISTINCT event_type FROM e) CROSS JOIN (VALUES {', '.join(f"('{x[1]}')" for x in b.BANDS if x[0] == 'standard')}) AS v(band)),
grid AS (SELECT g.*, count(f.event_id) AS n, count(*) FILTER (f.value > 10) AS loud FROM g LEFT JOIN f ON g.election = f.election AND g.event_type = f.event_type AND g.band = f.band GROUP BY ALL)"""


def coverage_grid_zero_fill(spark, base):
    return _grid(spark, base)


def share_null_denominator(spark, base):
    w = Window.partitionBy("election", "band")
    return _grid(spark, base).select(
        "election", "event_type", "band", b.share(F.col("loud"), F.col("n")).alias("loud_share"), b.share(F.col("n"), F.sum("n").over(w)).alias("voice_share")
    )


def snapshot_rollup(spark, base):
    """Snapshot counts as sums over their member bands, by a fixed band-to-snapshot table."""
    parts = [(label, x[1]) for label, days in b.SNAPSHOTS for x in b.BANDS if x[0] == "standard" and x[3] <= days]
    member = spark.createDataFrame(parts, "snapshot string, band string")
    return _grid(spark, base).join(F.broadcast(member), "band").groupBy("election", "event_type", "snapshot").agg(F.sum("n").alias("n"), F.sum("loud").alias("loud"))


MEMBER_SQL = ", ".join(f"('{label}', '{x[1]}')" for label, days in b.SNAPSHOTS for x in b.BANDS if x[0] == "standard" and x[3] <= days)


def distinct_sources_per_cell(spark, base):
    e = events(spark, base).withColumn("band", b.band_of(F.col("lag"), "standard"))
    return e.groupBy("election", "band").agg(F.count_distinct("user_id").alias("users"), F.count_distinct("event_type").alias("kinds"))


def fanout_multiplier(spark, base):
    """An event that names several topics counts once for each; the multiplier tells by how much."""
    topics = F.filter(F.array(*[F.when(F.col("k") % m == 0, F.lit(f"t{m}")) for m in (2, 3, 5)]), lambda x: x.isNotNull())
    e = events(spark, base).withColumn("topics", topics)
    per = e.withColumn("topic", F.explode("topics")).groupBy("topic").agg(F.count("*").alias("n"))
    total = e.agg(F.count(F.when(F.size("topics") > 0, 1)).alias("named"), F.sum(F.size("topics")).cast("long").alias("mentions"))
    return per.join(F.broadcast(total)).select("topic", "n", "named", "mentions", F.round(F.col("mentions") / F.col("named"), 6).alias("multiplier"))


def arm_reconciliation(spark, base):
    """Both arms' counts and their sum, with the whole counted apart; parts must equal it."""
    e = events(spark, base).withColumn("arm", F.when(F.col("user_id") % 2 == 0, "local").otherwise("national"))
    arms = e.groupBy("election").agg(F.count(F.when(F.col("arm") == "local", 1)).alias("local"), F.count(F.when(F.col("arm") == "national", 1)).alias("national"))
    whole = e.groupBy("election").agg(F.count("*").alias("whole"))
    return arms.join(whole, "election").withColumn("agrees", F.col("local") + F.col("national") == F.col("whole"))


def training_variation_verdict(spark, base):
    """Per band and column: distinct values over the grid, and whether a column varies enough to be used."""
    g = _grid(spark, base)
    long = g.unpivot(["election", "event_type", "band"], ["n", "loud"], "column", "value")
    d = long.groupBy("band", "column").agg(F.count_distinct("value").alias("distinct_values"), F.max("value").alias("most"))
    return d.withColumn("verdict", F.when(F.col("distinct_values") <= 1, "constant").when(F.col("distinct_values") < 5, "sparse").otherwise("varies"))


def scenario_perturbation(spark, base):
    """Three more events of one kind in one election and band; shares of the whole window are recomputed."""
    hit = (F.col("election") == 1) & (F.col("event_type") == "click") & (F.col("band") == "4-7")
    g = _grid(spark, base).withColumn("m", F.when(hit, F.col("n") + 3).otherwise(F.col("n")))
    w = Window.partitionBy("election", "band")
    return g.select("election", "event_type", "band", "m", b.share(F.col("n"), F.sum("n").over(w)).alias("before"), b.share(F.col("m"), F.sum("m").over(w)).alias("after"))


def window_flags_long(spark, base):
    """Look-back membership flags, one row per event kind and look-back, with day-0 and future events named."""
    e = events(spark, base)
    flag = lambda d: F.when(F.col("lag").isNull(), "unknown").when(F.col("lag") < 0, "after").when(F.col("lag") == 0, "same_day").when(F.col("lag") <= d, "inside").otherwise("outside")
    wide = e.select("event_type", *[flag(d).alias(label) for label, d in b.SNAPSHOTS])
    long = wide.unpivot(["event_type"], [x[0] for x in b.SNAPSHOTS], "lookback", "flag")
    return long.groupBy("event_type", "lookback", "flag").agg(F.count("*").alias("n"))


def cell_sparsity(spark, base):
    """Cells, empty cells, and the upper median of counts, per band."""
    g = _grid(spark, base)
    s = g.groupBy("band").agg(F.count("*").alias("cells"), F.count(F.when(F.col("n") == 0, 1)).alias("empty"), F.array_sort(F.collect_list("n")).alias("v"))
    return s.select("band", "cells", "empty", F.get("v", F.floor(F.col("cells") / 2).cast("int")).alias("upper_median"))


FLAG_SQL = " UNION ALL ".join(
    f"SELECT event_type, '{label}' AS lookback, CASE WHEN lag IS NULL THEN 'unknown' WHEN lag < 0 THEN 'after' WHEN lag = 0 THEN 'same_day' WHEN lag <= {d} THEN 'inside' ELSE 'outside' END AS flag FROM e" for label, d in b.SNAPSHOTS
)
QUERIES = {
    "lag_band_assign": (lag_band_assign, f"WITH {BASE_SQL} SELECT event_id, lag, {_case('standard')} AS band FROM e"),
    "lag_band_range_join": (lag_band_range_join, f"WITH {BASE_SQL}, b(scheme, label, lo, hi) AS (VALUES {', '.join(map(str, b.BANDS))}) SELECT scheme, label, count(*) AS n, CAST(sum(lag) AS BIGINT) AS lags FROM e LEFT JOIN b ON lag BETWEEN lo AND hi GROUP BY ALL"),
    "lag_band_cumulative": (lag_band_cumulative, f"WITH {BASE_SQL}, s(snapshot, days) AS (VALUES {', '.join(map(str, b.SNAPSHOTS))}) SELECT snapshot, event_type, count(*) AS n, round(sum(value), 4) AS total FROM e JOIN s ON lag BETWEEN 1 AND days GROUP BY ALL"),
    "compare_schemes": (compare_schemes, f"WITH {BASE_SQL} SELECT {_case('standard')} AS standard, {_case('coarse')} AS coarse, count(*) AS n FROM e GROUP BY ALL"),
    "coverage_grid_zero_fill": (coverage_grid_zero_fill, f"WITH {GRID_SQL} SELECT * FROM grid"),
    "share_null_denominator": (share_null_denominator, f"WITH {GRID_SQL} SELECT election, event_type, band, CASE WHEN n > 0 THEN round(loud / n, 6) END AS loud_share, CASE WHEN sum(n) OVER w > 0 THEN round(n / sum(n) OVER w, 6) END AS voice_share FROM grid WINDOW w AS (PARTITION BY election, band)"),
    "snapshot_rollup": (snapshot_rollup, f"WITH {GRID_SQL}, m(snapshot, band) AS (VALUES {MEMBER_SQL}) SELECT election, event_type, snapshot, CAST(sum(n) AS BIGINT) AS n, CAST(sum(loud) AS BIGINT) AS loud FROM grid JOIN m USING (band) GROUP BY ALL"),
    "distinct_sources_per_cell": (distinct_sources_per_cell, f"WITH {BASE_SQL} SELECT election, {_case('standard')} AS band, count(DISTINCT user_id) AS users, count(DISTINCT event_type) AS kinds FROM e GROUP BY ALL"),
    "fanout_multiplier": (fanout_multiplier, f"WITH {BASE_SQL}, t AS (SELECT event_id, 't' || m AS topic FROM e, (VALUES (2), (3), (5)) AS v(m) WHERE k % m = 0) SELECT topic, count(*) AS n, (SELECT count(DISTINCT event_id) FROM t) AS named, (SELECT count(*) FROM t) AS mentions, round((SELECT count(*) FROM t) / (SELECT count(DISTINCT event_id) FROM t), 6) AS multiplier FROM t GROUP BY topic"),
    "arm_reconciliation": (arm_reconciliation, f"WITH {BASE_SQL} SELECT election, count(*) FILTER (user_id % 2 = 0) AS local, count(*) FILTER (user_id % 2 <> 0) AS national, count(*) AS whole, count(*) FILTER (user_id % 2 = 0) + count(*) FILTER (user_id % 2 <> 0) = count(*) AS agrees FROM e GROUP BY election"),
    "training_variation_verdict": (training_variation_verdict, f"WITH {GRID_SQL}, l AS (SELECT band, 'n' AS \"column\", n AS value FROM grid UNION ALL SELECT band, 'loud', loud FROM grid) SELECT band, \"column\", count(DISTINCT value) AS distinct_values, max(value) AS most, CASE WHEN count(DISTINCT value) <= 1 THEN 'constant' WHEN count(DISTINCT value) < 5 THEN 'sparse' ELSE 'varies' END AS verdict FROM l GROUP BY ALL"),
    "scenario_perturbation": (scenario_perturbation, f"WITH {GRID_SQL}, p AS (SELECT *, n + CASE WHEN election = 1 AND event_type = 'click' AND band = '4-7' THEN 3 ELSE 0 END AS m FROM grid) SELECT election, event_type, band, m, CASE WHEN sum(n) OVER w > 0 THEN round(n / sum(n) OVER w, 6) END AS before, CASE WHEN sum(m) OVER w > 0 THEN round(m / sum(m) OVER w, 6) END AS after FROM p WINDOW w AS (PARTITION BY election, band)"),
    "window_flags_long": (window_flags_long, f"WITH {BASE_SQL}, l AS ({FLAG_SQL}) SELECT event_type, lookback, flag, count(*) AS n FROM l GROUP BY ALL"),
    "cell_sparsity": (cell_sparsity, f"WITH {GRID_SQL}, s AS (SELECT band, list(n ORDER BY n) AS v FROM grid GROUP BY band) SELECT band, CAST(len(v) AS BIGINT) AS cells, CAST(len(list_filter(v, lambda x: x = 0)) AS BIGINT) AS empty, v[len(v) // 2 + 1] AS upper_median FROM s"),
}
