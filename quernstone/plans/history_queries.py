"""History queries: a customer is an area, an order an event on its day."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernstone.operators import history as h
from quernstone.sources.tables import table

DAYS_SQL = "o AS (SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS day, o_totalprice, o_orderstatus FROM orders)"
SUM_SQL = f"{DAYS_SQL}, s AS (SELECT o_custkey, day, count(*) AS n, sum(o_totalprice) AS total FROM o GROUP BY ALL)"


def orders(spark, base):
    return table(spark, base, "orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("day"), "o_totalprice", "o_orderstatus")


def summaries(spark, base):
    return orders(spark, base).groupBy("o_custkey", "day").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))


def prev_next_event_asof(spark, base):
    out = h.previous_next(orders(spark, base), "o_custkey", "day", "o_totalprice")
    return out.select("o_orderkey", "previous_day", "previous_value", F.coalesce("previous_tie", F.lit(False)).alias("previous_tie"), "next_day", "next_value")


def as_of_state(spark, base):
    """For every line: the customer-independent latest status of its supplier group's orders before shipping."""
    facts = table(spark, base, "lineitem").select((F.col("l_suppkey") % 50).alias("g"), F.to_date("l_shipdate").alias("at"), "l_orderkey", "l_linenumber", "l_partkey")
    states = orders(spark, base).groupBy((F.col("o_custkey") % 50).alias("g"), F.col("day").alias("since")).agg(F.max("o_orderkey").alias("latest"))
    out = h.as_of(facts, states, "g", "at", "since", "latest")
    return out.groupBy("g").agg(F.count("*").alias("facts"), F.count("as_of").alias("found"), F.sum("as_of").alias("checksum"))


def strength_backward_pooling(spark, base):
    return h.pool_backwards(summaries(spark, base), "o_custkey", "day", "n", "total", 3, 5.0).drop("oldest")


def strength_trend(spark, base):
    """The pooled value against the pooled value of the pool's own oldest day."""
    now = h.pool_backwards(summaries(spark, base), "o_custkey", "day", "n", "total", 3, 5.0)
    was = now.select(F.col("o_custkey"), F.col("day").alias("oldest"), F.col("pooled").alias("pooled_before"))
    return now.join(was, ["o_custkey", "oldest"], "left").select("o_custkey", "day", "pooled", "pooled_before", F.round(F.col("pooled") - F.col("pooled_before"), 3).alias("trend"))


POOL_SQL = f"""{SUM_SQL},
j AS (SELECT a.o_custkey, a.day, b.day AS bd, b.n, b.total, sum(b.n) OVER (PARTITION BY a.o_custkey, a.day ORDER BY b.day DESC) AS run FROM s a JOIN s b ON a.o_custkey = b.o_custkey AND b.day < a.day AND datediff('day', b.day, a.day) <= 5.0 * 365.25),
p AS (SELECT o_custkey, day, CAST(sum(n) AS BIGINT) AS pooled_n, sum(total) AS t, count(*) AS sources, min(bd) AS oldest FROM j WHERE run - n < 3 GROUP BY ALL),
pool AS (SELECT s.o_custkey, s.day, CASE WHEN pooled_n >= 3 THEN round(t / pooled_n, 4) END AS pooled, pooled_n, sources, oldest FROM s LEFT JOIN p USING (o_custkey, day))"""


def election_summary(spark, base):
    return summaries(spark, base).groupBy(F.year("day").cast("long").alias("year")).agg(
        F.round(F.sum("total") / F.sum("n"), 4).alias("mean_value"), F.count_distinct(F.struct("o_custkey", "day")).alias("contests")
    )


def chronological_split(spark, base):
    fold = h.fold_of(F.col("day"), "1997-01-01", "1997-01-01", "1999-12-31")
    return orders(spark, base).groupBy(fold.alias("fold"), "o_orderstatus").agg(F.count("*").alias("n"), F.min("day").alias("first"), F.max("day").alias("last"))


def rolling_origin_splits(spark, base):
    return h.rolling_folds(orders(spark, base).withColumn("month", F.date_trunc("month", "day").cast("date")), "month")


def split_manifest_counts(spark, base):
    """Rows by yearly fold and role; a year's fold trains on earlier years and leaves later ones unused."""
    per = orders(spark, base).groupBy(F.year("day").alias("y")).agg(F.count("*").alias("n"))
    folds = per.select(F.col("y").alias("fold"))
    role = F.when(F.col("y") < F.col("fold"), "train").when(F.col("y") == F.col("fold"), "test").otherwise("unused")
    return per.join(F.broadcast(folds)).groupBy(F.col("fold").cast("long").alias("fold"), role.alias("role")).agg(F.sum("n").alias("n"))


def contest_integrity_gate(spark, base):
    """Orders whose lines fall into more than one fold; a gate wants none."""
    rows = table(spark, base, "lineitem").withColumn("fold", h.fold_of(F.to_date("l_shipdate"), "1997-01-01", "1997-01-01", "1999-12-31"))
    per = rows.groupBy("l_orderkey").agg(F.count_distinct("fold").alias("folds"))
    return per.groupBy("folds").agg(F.count("*").alias("contests"))


def roster_before_event(spark, base):
    """The standing status of a customer before each day: that of its latest earlier day, by largest order id."""
    days = orders(spark, base).groupBy("o_custkey", "day").agg(F.max(F.struct("o_orderkey", "o_orderstatus"))["o_orderstatus"].alias("status"))
    w = Window.partitionBy("o_custkey").orderBy("day")
    return days.select("o_custkey", "day", F.lag("status").over(w).alias("before"), "status")


def version_sequence(spark, base):
    """Place, predecessor and successor of each order within its customer's day-ordered family; refused
    (null) where the family repeats a day."""
    w = Window.partitionBy("o_custkey")
    o = orders(spark, base)
    n = o.groupBy("o_custkey").agg((F.count("*") == F.count_distinct("day")).alias("ordered"))
    by = w.orderBy("day", "o_orderkey")
    return o.join(n, "o_custkey").select(
        "o_orderkey", "ordered",
        F.when(F.col("ordered"), F.row_number().over(by)).cast("long").alias("place"),
        F.when(F.col("ordered"), F.lag("o_orderkey").over(by)).alias("predecessor"),
        F.when(F.col("ordered"), F.lead("o_orderkey").over(by)).alias("successor"),
    )


def stream_precedence_dedup(spark, base):
    o = orders(spark, base).select("o_custkey", "o_orderkey", "o_orderstatus")
    streams = [o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"), o.where("o_orderstatus = 'P'")]
    return h.first_wins(streams, "o_custkey", ["o_orderkey"])


def anti_join_resume(spark, base):
    """Customers still to do: not among those with an order of status F."""
    done = orders(spark, base).where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, base, "customer").join(done, "c_custkey", "left_anti").select("c_custkey", "c_mktsegment")


def set_operations(spark, base):
    """Customers with orders of both, one, or the other status."""
    o = orders(spark, base)
    a, b = (o.where(f"o_orderstatus = '{x}'").select("o_custkey").distinct() for x in "FO")
    part = lambda d, name: d.select("o_custkey", F.lit(name).alias("part"))
    return part(a.intersect(b), "both").union(part(a.exceptAll(b), "only_f")).union(part(b.exceptAll(a), "only_o"))


def latest_wins(spark, base):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("day"), F.desc("o_orderkey"))
    return orders(spark, base).withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def future_contribution_gate(spark, base):
    """Pooled rows whose sources reach the row's own day or later; must be 0."""
    p = h.pool_backwards(summaries(spark, base), "o_custkey", "day", "n", "total", 3, 5.0)
    return p.agg(F.count(F.when(F.col("oldest") >= F.col("day"), 1)).alias("violations"), F.count("pooled").alias("pooled_rows"))


MANIFEST = "CASE WHEN a.y < b.y THEN 'train' WHEN a.y = b.y THEN 'test' ELSE 'unused' END"
FOLD = lambda d: f"CASE WHEN {d} < DATE '1997-01-01' THEN 'train' WHEN {d} <= DATE '1999-12-31' THEN 'test' ELSE 'unused' END"
QUERIES = {
    "prev_next_event_asof": (prev_next_event_asof, f"""WITH {DAYS_SQL}, d AS (SELECT o_custkey, day, CASE WHEN count(DISTINCT o_totalprice) = 1 THEN max(o_totalprice) END AS v, count(DISTINCT o_totalprice) > 1 AS tie FROM o GROUP BY ALL),
n AS (SELECT *, lag(day) OVER w AS previous_day, lag(v) OVER w AS previous_value, lag(tie) OVER w AS previous_tie, lead(day) OVER w AS next_day, lead(v) OVER w AS next_value FROM d WINDOW w AS (PARTITION BY o_custkey ORDER BY day))
SELECT o_orderkey, previous_day, previous_value, coalesce(previous_tie, false) AS previous_tie, next_day, next_value FROM o JOIN n USING (o_custkey, day)"""),
    "as_of_state": (as_of_state, f"""WITH {DAYS_SQL}, st AS (SELECT o_custkey % 50 AS g, day AS since, max(o_orderkey) AS latest FROM o GROUP BY ALL),
f AS (SELECT l_suppkey % 50 AS g, CAST(l_shipdate AS DATE) AS at_day FROM lineitem),
m AS (SELECT f.g, st.latest FROM f ASOF LEFT JOIN st ON f.g = st.g AND f.at_day > st.since)
SELECT g, count(*) AS facts, count(latest) AS found, CAST(sum(latest) AS BIGINT) AS checksum FROM m GROUP BY g"""),
    "strength_backward_pooling": (strength_backward_pooling, f"WITH {POOL_SQL} SELECT o_custkey, day, pooled, pooled_n, sources FROM pool"),
    "strength_trend": (strength_trend, f"WITH {POOL_SQL} SELECT a.o_custkey, a.day, a.pooled, b.pooled AS pooled_before, round(a.pooled - b.pooled, 3) AS trend FROM pool a LEFT JOIN pool b ON a.o_custkey = b.o_custkey AND a.oldest = b.day"),
    "election_summary": (election_summary, f"WITH {SUM_SQL} SELECT year(day) AS year, round(sum(total) / sum(n), 4) AS mean_value, count(*) AS contests FROM s GROUP BY 1"),
    "chronological_split": (chronological_split, f"WITH {DAYS_SQL} SELECT {FOLD('day')} AS fold, o_orderstatus, count(*) AS n, min(day) AS first, max(day) AS last FROM o GROUP BY ALL"),
    "rolling_origin_splits": (rolling_origin_splits, f"WITH {DAYS_SQL}, p AS (SELECT CAST(date_trunc('month', day) AS DATE) AS month, count(*) AS test_rows FROM o GROUP BY 1) SELECT * FROM (SELECT month, test_rows, CAST(sum(test_rows) OVER (ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT) AS train_rows, lag(month) OVER (ORDER BY month) AS last_train FROM p) WHERE train_rows IS NOT NULL"),
    "split_manifest_counts": (split_manifest_counts, f"WITH {DAYS_SQL}, p AS (SELECT year(day) AS y, count(*) AS n FROM o GROUP BY 1) SELECT b.y AS fold, {MANIFEST} AS role, CAST(sum(a.n) AS BIGINT) AS n FROM p a CROSS JOIN p b GROUP BY ALL"),
    "contest_integrity_gate": (contest_integrity_gate, f"WITH p AS (SELECT l_orderkey, count(DISTINCT {FOLD('CAST(l_shipdate AS DATE)')}) AS folds FROM lineitem GROUP BY 1) SELECT folds, count(*) AS contests FROM p GROUP BY folds"),
    "roster_before_event": (roster_before_event, f"WITH {DAYS_SQL}, d AS (SELECT o_custkey, day, arg_max(o_orderstatus, o_orderkey) AS status FROM o GROUP BY ALL) SELECT o_custkey, day, lag(status) OVER (PARTITION BY o_custkey ORDER BY day) AS before, status FROM d"),
    "version_sequence": (version_sequence, f"WITH {DAYS_SQL}, f AS (SELECT *, (SELECT count(*) = count(DISTINCT day) FROM o b WHERE b.o_custkey = o.o_custkey) AS ordered FROM o) SELECT o_orderkey, ordered, CASE WHEN ordered THEN row_number() OVER w END AS place, CASE WHEN ordered THEN lag(o_orderkey) OVER w END AS predecessor, CASE WHEN ordered THEN lead(o_orderkey) OVER w END AS successor FROM f WINDOW w AS (PARTITION BY o_custkey ORDER BY day, o_orderkey)"),
    "stream_precedence_dedup": (stream_precedence_dedup, "SELECT o_custkey, o_orderkey, o_orderstatus, stream FROM (SELECT o_custkey, o_orderkey, o_orderstatus, CAST(instr('FOP', o_orderstatus) - 1 AS BIGINT) AS stream FROM orders WHERE o_orderstatus IN ('F', 'O', 'P')) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY stream, o_orderkey) = 1"),
    "anti_join_resume": (anti_join_resume, "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')"),
    "set_operations": (set_operations, "WITH k AS (SELECT o_custkey, bool_or(o_orderstatus = 'F') AS f, bool_or(o_orderstatus = 'O') AS o FROM orders GROUP BY 1) SELECT o_custkey, CASE WHEN f AND o THEN 'both' WHEN f THEN 'only_f' ELSE 'only_o' END AS part FROM k WHERE f OR o"),
    "latest_wins": (latest_wins, f"WITH {DAYS_SQL} SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY day DESC, o_orderkey DESC) = 1"),
    "future_contribution_gate": (future_contribution_gate, f"WITH {POOL_SQL} SELECT count(*) FILTER (oldest >= day) AS violations, count(pooled) AS pooled_rows FROM pool"),
}


def _as_text(entry: tuple, *days: str) -> tuple:
    """The query with its day columns as ISO text, so that every client reads them alike."""
    fn, sql = entry
    casts = ", ".join(f"CAST({d} AS VARCHAR) AS {d}" for d in days)
    return (lambda spark, base: fn(spark, base).withColumns({d: F.col(d).cast("string") for d in days})), f"SELECT * REPLACE ({casts}) FROM ({sql})"


for _name, _days in {
    "prev_next_event_asof": ["previous_day", "next_day"],
    "strength_backward_pooling": ["day"],
    "strength_trend": ["day"],
    "chronological_split": ["first", "last"],
    "rolling_origin_splits": ["month", "last_train"],
    "roster_before_event": ["day"],
    "latest_wins": ["day"],
}.items():
    QUERIES[_name] = _as_text(QUERIES[_name], *_days)
