"""Contest queries: an order is a contest, a supplier group a party, quantity its votes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernstone.operators import contest as c
from quernstone.plans.durable import dealt
from quernstone.sources.tables import table

VOTES_SQL = """votes AS (SELECT l_orderkey AS contest, l_suppkey % 7 AS party, CAST(sum(l_quantity) AS DOUBLE) AS votes,
  CAST(sum(l_quantity * (1 + l_linenumber % 3)) AS DOUBLE) AS strength, count(*) AS lines FROM lineitem GROUP BY ALL)"""
SEATS_SQL = "CASE WHEN contest % 11 = 0 THEN NULL ELSE 1 + contest % 3 END"


def votes(spark: SparkSession, base: str) -> DataFrame:
    lines = table(spark, base, "lineitem")
    # one deal by contest serves the sums and every window over a contest
    rows = dealt(lines.select(F.col("l_orderkey").alias("contest"), (F.col("l_suppkey") % 7).alias("party"), "l_quantity", "l_linenumber"), lines.count(), "contest")
    return rows.groupBy("contest", "party").agg(
        F.sum("l_quantity").alias("votes"), F.sum(F.col("l_quantity") * (1 + F.col("l_linenumber") % 3)).alias("strength"), F.count("*").alias("lines")
    )


def seats():
    return F.when(F.col("contest") % 11 == 0, None).otherwise(1 + F.col("contest") % 3)


def contest_share_rank(spark, base):
    return c.with_rank(c.with_share(votes(spark, base), ["contest"], "votes"), ["contest"], "votes").select("contest", "party", "votes", "share", "rank")


def contest_margin_top2(spark, base):
    return c.top_two(votes(spark, base), ["contest"], "votes", ["party"])


def raw_predictions(spark, base):
    """Predicted values that hold negatives, groups of zero mass and nulls."""
    raw = F.when((F.col("contest") % 17 == 0) & (F.col("party") == 3), None).when(F.col("contest") % 13 == 0, -F.col("votes")).otherwise(F.col("strength") - 20)
    return votes(spark, base).withColumn("raw", raw)


RAW_SQL = "CASE WHEN contest % 17 = 0 AND party = 3 THEN NULL WHEN contest % 13 = 0 THEN -votes ELSE strength - 20 END"


def contest_normalise_100(spark, base):
    return c.normalise_100(raw_predictions(spark, base), ["contest"], "raw", "scaled").select("contest", "party", "scaled")


def allocated(spark, base):
    out = c.allocate_seats(votes(spark, base), ["contest"], "votes", ["party"], seats())
    out = out.withColumnsRenamed({"elected": "observed", "tie_at_cutoff": "observed_tie"}).drop("place", "seats")
    return c.allocate_seats(out, ["contest"], "strength", ["party"], seats()).withColumnRenamed("elected", "predicted")


ALLOCATED_SQL = f"""{VOTES_SQL},
s AS (SELECT *, least({SEATS_SQL}, count(*) OVER (PARTITION BY contest)) AS raw_seats,
  row_number() OVER (PARTITION BY contest ORDER BY votes DESC, party) AS po, row_number() OVER (PARTITION BY contest ORDER BY strength DESC, party) AS pp FROM votes),
s2 AS (SELECT * EXCLUDE (raw_seats), CASE WHEN contest % 11 = 0 THEN NULL ELSE raw_seats END AS seats FROM s),
a AS (SELECT *, coalesce(po <= seats, false) AS observed, coalesce(pp <= seats, false) AS predicted FROM s2)"""


def seat_allocation_topn(spark, base):
    return allocated(spark, base).select("contest", "party", "predicted", "observed")


def seat_cutoff_ties(spark, base):
    out = c.allocate_seats(votes(spark, base), ["contest"], "votes", ["party"], seats())
    return out.where("tie_at_cutoff").select("contest", "party", "votes", "place", "elected")


def party_seat_totals(spark, base):
    return c.seat_totals(allocated(spark, base), "party", "predicted", "observed")


def seat_set_accuracy(spark, base):
    return c.set_accuracy(allocated(spark, base), ["contest"], "predicted", "observed", "party")


def turnout_conflict_resolution(spark, base):
    """One tax rate per (order, return flag), or a marked conflict."""
    rows = table(spark, base, "lineitem").withColumn("known", F.when(F.col("l_linenumber") == 7, None).otherwise(F.col("l_tax")))
    return c.consensus(rows, ["l_orderkey", "l_returnflag"], "known")


def party_label_concat(spark, base):
    rows = table(spark, base, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.concat(F.lit("P"), (F.col("l_suppkey") % 7).cast("string")))).alias("p"))
    return rows.select("l_orderkey", F.array_join("p", "; ").alias("labels"), F.size("p").cast("long").alias("n_labels"))


def pivot_top_by_year(spark, base):
    """Orders per customer segment and year, years across."""
    rows = table(spark, base, "orders").join(table(spark, base, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    years = list(range(1992, 2002))
    wide = rows.withColumn("y", F.year("o_orderdate")).groupBy("c_mktsegment").pivot("y", years).agg(F.count(F.lit(1)))
    return wide.select("c_mktsegment", *[F.coalesce(F.col(str(y)), F.lit(0)).alias(f"y{y}") for y in years])


def contest_coverage(spark, base):
    """Contests per party, how many of them it could have entered, its contest rate."""
    v = votes(spark, base)
    n = v.agg(F.count_distinct("contest").alias("contests")).withColumn("k", F.lit(1))
    per = v.groupBy("party").agg(F.count("*").alias("fought"), F.count(F.when(F.col("lines") > 1, 1)).alias("with_many")).withColumn("k", F.lit(1))
    return per.join(n, "k").select("party", "fought", "with_many", "contests", F.round(F.col("fought") / F.col("contests"), 6).alias("rate"))


def contestation_grid(spark, base):
    """Every party in every contest of its status, entered or not, as counts by contest size."""
    v = votes(spark, base)
    size = v.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("contest"))).select("contest", "party", "n")
    universe = size.select("contest", "n").distinct().withColumn("party", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(6).cast("long"))))
    seen = size.select("contest", "party", F.lit(True).alias("entered"))
    grid = universe.join(seen, ["contest", "party"], "left")
    return grid.groupBy("n", "party").agg(F.count("*").alias("contests"), F.count("entered").alias("entered"))


def relative_share_round_trip(spark, base):
    """Share over the equal split, and back."""
    w = Window.partitionBy("contest")
    s = votes(spark, base).withColumn("part", F.col("votes") / F.sum("votes").over(w)).withColumn("n", F.count(F.lit(1)).over(w))
    return s.select("contest", "party", F.round(F.col("part") * F.col("n"), 6).alias("relative"), F.round(100 * (F.col("part") * F.col("n")) / F.col("n"), 6).alias("share_again"))


QUERIES = {
    "contest_share_rank": (contest_share_rank, f"WITH {VOTES_SQL} SELECT contest, party, votes, round(100 * votes / sum(votes) OVER (PARTITION BY contest), 6) AS share, rank() OVER (PARTITION BY contest ORDER BY votes DESC) AS rank FROM votes"),
    "contest_margin_top2": (contest_margin_top2, f"""WITH {VOTES_SQL}, p AS (SELECT *, row_number() OVER (PARTITION BY contest ORDER BY votes DESC, party) AS p, rank() OVER (PARTITION BY contest ORDER BY votes DESC) AS r FROM votes)
SELECT contest, max(votes) FILTER (p = 1) AS top, max(votes) FILTER (p = 2) AS second, max(votes) FILTER (p = 1) - max(votes) FILTER (p = 2) AS margin, count(*) FILTER (r = 1) AS tied_at_top FROM p GROUP BY contest"""),
    "contest_normalise_100": (contest_normalise_100, f"""WITH {VOTES_SQL}, r AS (SELECT *, {RAW_SQL} AS raw FROM votes),
m AS (SELECT *, sum(CASE WHEN raw > 0 THEN raw ELSE 0 END) OVER w AS mass, count(*) OVER w AS n, count(*) FILTER (raw IS NULL) OVER w AS nulls FROM r WINDOW w AS (PARTITION BY contest))
SELECT contest, party, round(CASE WHEN nulls > 0 THEN NULL WHEN mass > 0 THEN 100 * (CASE WHEN raw > 0 THEN raw ELSE 0 END) / mass ELSE 100.0 / n END, 6) AS scaled FROM m"""),
    "seat_allocation_topn": (seat_allocation_topn, f"WITH {ALLOCATED_SQL} SELECT contest, party, predicted, observed FROM a"),
    "seat_cutoff_ties": (seat_cutoff_ties, f"""WITH {ALLOCATED_SQL}, t AS (SELECT *, max(votes) FILTER (po = seats) OVER w AS lo, max(votes) FILTER (po = seats + 1) OVER w AS hi FROM a WINDOW w AS (PARTITION BY contest))
SELECT contest, party, votes, po AS place, observed AS elected FROM t WHERE lo = hi"""),
    "party_seat_totals": (party_seat_totals, f"WITH {ALLOCATED_SQL} SELECT party, count(*) FILTER (predicted) AS predicted_seats, count(*) FILTER (observed) AS observed_seats, count(*) FILTER (predicted) - count(*) FILTER (observed) AS difference FROM a WHERE predicted OR observed GROUP BY party"),
    "seat_set_accuracy": (seat_set_accuracy, f"WITH {ALLOCATED_SQL}, p AS (SELECT contest, bool_and(predicted = observed) AS same, count(*) AS n, count(*) FILTER (predicted = observed) AS ok FROM a GROUP BY contest) SELECT count(*) AS contests, count(*) FILTER (same) AS fully_right, round(sum(ok) / sum(n), 6) AS call_accuracy FROM p"),
    "turnout_conflict_resolution": (turnout_conflict_resolution, """WITH r AS (SELECT l_orderkey, l_returnflag, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_tax END AS known FROM lineitem)
SELECT l_orderkey, l_returnflag, CASE WHEN count(DISTINCT known) = 1 THEN max(known) END AS value, CASE WHEN count(DISTINCT known) > 1 THEN 'conflict' WHEN count(DISTINCT known) = 1 THEN 'agreed' ELSE 'unknown' END AS status, bool_and(known IS NOT NULL) AS all_known FROM r GROUP BY ALL"""),
    "party_label_concat": (party_label_concat, "SELECT l_orderkey, string_agg(DISTINCT 'P' || (l_suppkey % 7), '; ' ORDER BY 'P' || (l_suppkey % 7)) AS labels, count(DISTINCT l_suppkey % 7) AS n_labels FROM lineitem GROUP BY l_orderkey"),
    "pivot_top_by_year": (pivot_top_by_year, "SELECT c_mktsegment, " + ", ".join(f"count(*) FILTER (year(o_orderdate) = {y}) AS y{y}" for y in range(1992, 2002)) + " FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment"),
    "contest_coverage": (contest_coverage, f"WITH {VOTES_SQL} SELECT party, count(*) AS fought, count(*) FILTER (lines > 1) AS with_many, (SELECT count(DISTINCT contest) FROM votes) AS contests, round(count(*) / (SELECT count(DISTINCT contest) FROM votes), 6) AS rate FROM votes GROUP BY party"),
    "contestation_grid": (contestation_grid, f"WITH {VOTES_SQL}, s AS (SELECT contest, count(*) AS n FROM votes GROUP BY contest) SELECT n, g AS party, count(*) AS contests, count(v.party) AS entered FROM s CROSS JOIN (SELECT unnest(range(7)) AS g) LEFT JOIN votes v ON v.contest = s.contest AND v.party = g GROUP BY ALL"),
    "relative_share_round_trip": (relative_share_round_trip, f"WITH {VOTES_SQL}, s AS (SELECT contest, party, votes / sum(votes) OVER w AS part, count(*) OVER w AS n FROM votes WINDOW w AS (PARTITION BY contest)) SELECT contest, party, round(part * n, 6) AS relative, round(100 * (part * n) / n, 6) AS share_again FROM s"),
}
