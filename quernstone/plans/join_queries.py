"""Join queries: customers as areas, orders as results, lines as candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernstone.operators import joins as j
from quernstone.plans.durable import durable, join_small
from quernstone.plans.rule_queries import FACT_SQL, facts
from quernstone.plans.stats_queries import PRED_SQL, predictions
from quernstone.sources.tables import table


def features_targets_join(spark, base):
    """Features and targets of every order, joined one to one."""
    x = facts(spark, base)
    return j.one_to_one(x.select("id", "priority", "lines"), x.select("id", "total", "returned"), "id")


def bijection_report(spark, base):
    """Orders against lines by order: why that pair is not one to one."""
    left = table(spark, base, "orders").select(F.col("o_orderkey").alias("id"))
    return j.bijection_report(left, table(spark, base, "lineitem").select(F.col("l_orderkey").alias("id")), "id")


def prediction_outcome_join(spark, base):
    """Predictions joined with outcomes by id, error on a miss; the errors per election."""
    p = predictions(spark, base).withColumn("id", F.concat_ws(":", "contest", "party"))
    x = j.joined_or_error(p.select("id", "election", "predicted"), p.select("id", "observed"), "id")
    e = F.col("predicted") - F.col("observed")
    return x.groupBy("election").agg(F.count("*").alias("n"), F.round(F.avg(F.abs(e)), 6).alias("mae"), F.count(F.when(e > 0, 1)).alias("over"))


def area_aggregates(spark, base):
    """Every customer with counts and sums of its orders, zero where it has none, unknown where a sum is not defined."""
    o = facts(spark, base).groupBy("cust").agg(F.count("*").alias("orders"), F.sum("lines").alias("lines"), F.max("day").alias("last_day"), F.round(F.sum("total"), 2).alias("total"))
    cu = table(spark, base, "customer").select(F.col("c_custkey").alias("cust"), "c_mktsegment")
    x = cu.join(o, "cust", "left")
    status = F.when(F.col("orders").isNull(), "never_held").when(F.col("last_day") < F.lit("1998-01-01").cast("date"), "past").otherwise("current")
    return x.select("cust", "c_mktsegment", F.coalesce("orders", F.lit(0)).alias("orders"), F.coalesce("lines", F.lit(0)).alias("lines"), "total", status.alias("status"))


def lookup_chain(spark, base):
    """Labelled documents through their text, their language and their source; how many fall out where."""
    d = table(spark, base, "documents")
    steps = [
        ("text", d.where("length(text) >= 200").select("doc_id", F.length("text").alias("chars")), ["doc_id"], "chars"), ("language", d.where("lang IN ('en', 'de')").select("doc_id", "lang"), ["doc_id"], "lang"),
        ("source", d.where("source IS NOT NULL AND source <> 'src3'").select("doc_id", "source"), ["doc_id"], "source"),
    ]
    x = j.with_lookups(table(spark, base, "labels").select("doc_id", "quality"), steps)
    return x.groupBy("reason").agg(F.count("*").alias("records"), F.sum("quality").cast("long").alias("good"))


def scope_semi_join(spark, base):
    """Lines of orders that urgent customers of two segments placed."""
    who = table(spark, base, "customer").where("c_mktsegment IN ('BUILDING', 'MACHINERY')").select(F.col("c_custkey").alias("o_custkey"))
    orders = table(spark, base, "orders").where("o_orderpriority = '1-URGENT'").join(who, "o_custkey", "left_semi").select(F.col("o_orderkey").alias("l_orderkey"))
    lines = table(spark, base, "lineitem").join(orders, "l_orderkey", "left_semi")
    return lines.groupBy("l_returnflag").agg(F.count("*").alias("lines"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


def group_pairs(spark, base):
    """All pairs within a group whose size the data bound (an order's lines): parts bought together."""
    rows = table(spark, base, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    other = rows.select("l_orderkey", F.col("l_linenumber").alias("other_line"), F.col("l_partkey").alias("other_part"))
    x = rows.join(other, "l_orderkey").where("l_linenumber < other_line")
    return x.groupBy(F.least("l_partkey", "other_part").alias("a"), F.greatest("l_partkey", "other_part").alias("b")).agg(F.count("*").alias("together")).where("together > 1")


def paired_models(spark, base):
    """Two models' errors on the same keys, only where both give a value."""
    p = predictions(spark, base)
    one = p.select("contest", "party", F.when(F.col("predicted") > 5, F.abs(F.col("predicted") - F.col("observed"))).alias("one"))
    two = p.select("contest", "party", "election", F.when(F.col("size") > 2, F.abs(100 / F.col("size") - F.col("observed"))).alias("two"))
    x = one.join(two, ["contest", "party"]).where("one IS NOT NULL AND two IS NOT NULL")
    return x.groupBy("election").agg(F.count("*").alias("pairs"), F.count(F.when(F.col("one") < F.col("two"), 1)).alias("wins"), F.round(F.avg(F.col("two") - F.col("one")), 6).alias("gain"))


def _links(spark, base):
    """A crosswalk read from the data: a nation's name in capitals to the names of regions that its suppliers serve most."""
    n = table(spark, base, "nation").join(table(spark, base, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select(F.upper("n_name").alias("old"), F.when(F.col("n_nationkey") % 3 == 0, F.concat_ws(" ", F.upper("r_name"), F.upper("n_name"))).otherwise(F.upper("r_name")).alias("new"))


def crosswalk_names(spark, base):
    """Customers' area names of three eras, resolved to one era's names."""
    links = durable(_links(spark, base))
    known = links.where("length(old) < 8").select(F.col("old").alias("name"))
    cu = table(spark, base, "customer").join(table(spark, base, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, base, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    era = F.col("c_custkey") % 3
    name = F.when(era == 0, F.upper("n_name")).when(era == 1, F.upper("r_name")).otherwise(F.concat_ws(" ", F.upper("r_name"), F.upper("n_name")))
    out = j.name_crosswalk(cu.select("c_custkey", name.alias("name")), links, known)
    return out.groupBy("name", "resolved", "how").agg(F.count("*").alias("customers"))


def name_match_conflicts(spark, base):
    """Suppliers and customers by the number in their names: where do both name an area, and do they agree."""
    key = lambda c: F.regexp_extract(c, "([0-9]+)$", 1).cast("long")
    su = table(spark, base, "supplier").select(key("s_name").alias("number"), F.col("s_nationkey").alias("area"), (F.col("s_acctbal") >= 0).alias("solvent"))
    cu = table(spark, base, "customer").select(key("c_name").alias("number"), F.col("c_nationkey").alias("area"), (F.col("c_acctbal") >= 0).alias("solvent"))
    return j.conflict_log(su, cu, "number", ["area", "solvent"])


def reference_gate(spark, base):
    """A customer's reference value is its area's and segment's mean balance, if enough customers stand behind it."""
    cu = table(spark, base, "customer")
    ref = cu.where("c_mktsegment <> 'MACHINERY'").groupBy("c_nationkey", "c_mktsegment").agg(F.round(F.avg("c_acctbal"), 4).alias("mean"), (F.count("*") >= 3).alias("allowed"))
    return j.gated_reference(cu.select("c_custkey", "c_nationkey", "c_mktsegment"), ref, ["c_nationkey", "c_mktsegment"], "mean", "allowed").select("c_custkey", "reference", "reference_status")


#: Fixed versions of a party's name: from, to, value.
VERSIONS = [(None, "1993-06-30", "old"), ("1993-07-01", "1996-02-29", "middle"), ("1996-03-01", None, "new")]


def dated_dimension(spark, base):
    o = table(spark, base, "orders").withColumn("party", j.dated_dimension(F.to_date("o_orderdate"), VERSIONS, "unknown"))
    return o.groupBy("party", "o_orderstatus").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def max_and_first(spark, base):
    """Per customer and status the largest total and the first known priority by date and key."""
    o = facts(spark, base).withColumn("known", F.when(F.col("priority") != "4-NOT SPECIFIED", F.col("priority")))
    return o.groupBy("cust", "status").agg(F.max("total").alias("most"), F.min_by("known", F.when(F.col("known").isNotNull(), F.struct("day", "id"))).alias("first_known"))


def scope_overlap(spark, base):
    """Areas served by suppliers and by customers: rows of the overlap and the largest competing share per area."""
    cu = table(spark, base, "customer").groupBy(F.col("c_nationkey").alias("area"), F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"))
    total = durable(cu.groupBy("area").agg(F.sum("n").alias("whole"), F.sort_array(F.collect_list(F.struct("n", "segment")), asc=False).alias("ranked")))
    x = join_small(cu, total, ["area"])
    other = F.filter("ranked", lambda r: r["segment"] != F.col("segment"))
    return x.select("area", "segment", F.round(100 * F.col("n") / F.col("whole"), 4).alias("share"), F.round(100 * F.coalesce(F.get(other, F.lit(0))["n"], F.lit(0)) / F.col("whole"), 4).alias("largest_other"))


LINKS = "lk AS (SELECT upper(n_name) AS old, CASE WHEN n_nationkey % 3 = 0 THEN upper(r_name) || ' ' || upper(n_name) ELSE upper(r_name) END AS new FROM nation JOIN region ON n_regionkey = r_regionkey)"
QUERIES = {
    "features_targets_join": (features_targets_join, f"WITH {FACT_SQL} SELECT id, priority, lines, total, returned FROM f"),
    "bijection_report": (bijection_report, "WITH l AS (SELECT o_orderkey AS id, count(*) AS l FROM orders GROUP BY 1), r AS (SELECT l_orderkey AS id, count(*) AS r FROM lineitem GROUP BY 1), b AS (SELECT * FROM l FULL JOIN r USING (id)), c AS (SELECT CAST(sum(l) AS BIGINT) AS left_rows, CAST(sum(r) AS BIGINT) AS right_rows, count(*) FILTER (r IS NULL) AS left_only, count(*) FILTER (l IS NULL) AS right_only, count(*) FILTER (l > 1 OR r > 1) AS repeated_keys FROM b) SELECT *, left_only = 0 AND right_only = 0 AND repeated_keys = 0 AS bijection FROM c"),
    "prediction_outcome_join": (prediction_outcome_join, f"WITH {PRED_SQL} SELECT election, count(*) AS n, round(avg(abs(predicted - observed)), 6) AS mae, count(*) FILTER (predicted - observed > 0) AS over FROM t GROUP BY election"),
    "area_aggregates": (area_aggregates, f"WITH {FACT_SQL}, o AS (SELECT cust, count(*) AS orders, CAST(sum(lines) AS BIGINT) AS lines, max(day) AS last_day, round(sum(total), 2) AS total FROM f GROUP BY 1) SELECT c_custkey AS cust, c_mktsegment, coalesce(orders, 0) AS orders, coalesce(lines, 0) AS lines, total, CASE WHEN orders IS NULL THEN 'never_held' WHEN last_day < DATE '1998-01-01' THEN 'past' ELSE 'current' END AS status FROM customer LEFT JOIN o ON c_custkey = cust"),
    "lookup_chain": (lookup_chain, "SELECT CASE WHEN text IS NULL OR length(text) < 200 THEN 'no_text' WHEN lang IS NULL OR lang NOT IN ('en', 'de') THEN 'no_language' WHEN source IS NULL OR source = 'src3' THEN 'no_source' ELSE 'ok' END AS reason, count(*) AS records, CAST(sum(quality) AS BIGINT) AS good FROM labels LEFT JOIN documents USING (doc_id) GROUP BY 1"),
    "scope_semi_join": (scope_semi_join, "SELECT l_returnflag, count(*) AS lines, round(sum(l_quantity), 2) AS quantity FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY'))) GROUP BY 1"),
    "group_pairs": (group_pairs, "SELECT least(x.l_partkey, y.l_partkey) AS a, greatest(x.l_partkey, y.l_partkey) AS b, count(*) AS together FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND x.l_linenumber < y.l_linenumber GROUP BY ALL HAVING count(*) > 1"),
    "paired_models": (paired_models, f"WITH {PRED_SQL}, x AS (SELECT election, CASE WHEN predicted > 5 THEN abs(predicted - observed) END AS one, CASE WHEN size > 2 THEN abs(100 / size - observed) END AS two FROM t) SELECT election, count(*) AS pairs, count(*) FILTER (one < two) AS wins, round(avg(two - one), 6) AS gain FROM x WHERE one IS NOT NULL AND two IS NOT NULL GROUP BY election"),
    "crosswalk_names": (crosswalk_names, f"WITH {LINKS}, kn AS (SELECT old AS name FROM lk WHERE length(old) < 8), fw AS (SELECT old AS name, count(DISTINCT new) AS n, min(new) AS t FROM lk GROUP BY 1), bk AS (SELECT new AS name, count(DISTINCT old) AS n, min(old) AS t FROM lk GROUP BY 1), c AS (SELECT CASE c_custkey % 3 WHEN 0 THEN upper(n_name) WHEN 1 THEN upper(r_name) ELSE upper(r_name) || ' ' || upper(n_name) END AS name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey), h AS (SELECT c.name, fw.t AS ft, bk.t AS bt, CASE WHEN c.name IN (SELECT name FROM kn) THEN 'as_is' WHEN fw.n = 1 THEN 'forward' WHEN bk.n = 1 THEN 'inverse' WHEN fw.n > 1 OR bk.n > 1 THEN 'ambiguous' ELSE 'unresolved' END AS how FROM c LEFT JOIN fw ON c.name = fw.name LEFT JOIN bk ON c.name = bk.name) SELECT name, CASE how WHEN 'as_is' THEN name WHEN 'forward' THEN ft WHEN 'inverse' THEN bt END AS resolved, how, count(*) AS customers FROM h GROUP BY ALL"),
    "name_match_conflicts": (name_match_conflicts, "WITH s AS (SELECT CAST(regexp_extract(s_name, '([0-9]+)$', 1) AS BIGINT) AS number, s_nationkey AS a, s_acctbal >= 0 AS b FROM supplier), c AS (SELECT CAST(regexp_extract(c_name, '([0-9]+)$', 1) AS BIGINT) AS number, c_nationkey AS ca, c_acctbal >= 0 AS cb FROM customer), x AS (SELECT *, CASE WHEN ca IS NULL THEN 'left_only' WHEN a IS NULL THEN 'right_only' WHEN a <> ca OR b <> cb THEN 'conflict' ELSE 'agrees' END AS status FROM s FULL JOIN c USING (number)) SELECT number, status, CASE WHEN status = 'conflict' THEN concat_ws(',', CASE WHEN a <> ca THEN 'area' END, CASE WHEN b <> cb THEN 'solvent' END) ELSE '' END AS conflicts FROM x"),
    "reference_gate": (reference_gate, "WITH r AS (SELECT c_nationkey, c_mktsegment, round(avg(c_acctbal), 4) AS mean, count(*) >= 3 AS allowed FROM customer WHERE c_mktsegment <> 'MACHINERY' GROUP BY ALL) SELECT c_custkey, CASE WHEN allowed THEN mean END AS reference, CASE WHEN allowed IS NULL THEN 'no_reference' WHEN allowed THEN 'used' ELSE 'not_permitted' END AS reference_status FROM customer LEFT JOIN r USING (c_nationkey, c_mktsegment)"),
    "dated_dimension": (dated_dimension, "SELECT CASE WHEN CAST(o_orderdate AS DATE) <= DATE '1993-06-30' THEN 'old' WHEN CAST(o_orderdate AS DATE) BETWEEN DATE '1993-07-01' AND DATE '1996-02-29' THEN 'middle' WHEN CAST(o_orderdate AS DATE) >= DATE '1996-03-01' THEN 'new' ELSE 'unknown' END AS party, o_orderstatus, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL"),
    "max_and_first": (max_and_first, "SELECT o_custkey AS cust, o_orderstatus AS status, max(o_totalprice) AS most, first(o_orderpriority ORDER BY o_orderdate, o_orderkey) FILTER (o_orderpriority <> '4-NOT SPECIFIED') AS first_known FROM orders GROUP BY ALL"),
    "scope_overlap": (scope_overlap, "WITH p AS (SELECT c_nationkey AS area, c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY ALL), w AS (SELECT area, sum(n) AS whole FROM p GROUP BY 1) SELECT area, segment, round(100 * n / whole, 4) AS share, round(100 * coalesce((SELECT max(q.n) FROM p q WHERE q.area = p.area AND q.segment <> p.segment), 0) / whole, 4) AS largest_other FROM p JOIN w USING (area)"),
}
