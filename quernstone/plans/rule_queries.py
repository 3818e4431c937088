"""Row-rule queries over orders with the evidence that their lines give."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernstone.operators import rules as r
from quernstone.plans.durable import durable, join_small
from quernstone.sources.tables import table

BOUNDARY = "1997-01-01"
FACT_SQL = """f AS (SELECT o_orderkey AS id, o_custkey AS cust, CAST(o_orderdate AS DATE) AS day, o_totalprice AS total, o_orderstatus AS status, o_orderpriority AS priority,
  CAST(min(l_shipdate) AS DATE) AS first_ship, CAST(max(l_shipdate) AS DATE) AS last_ship, count(l_orderkey) AS lines, count(*) FILTER (l_returnflag = 'R') AS returned, CAST(coalesce(sum(l_quantity), 0) AS DOUBLE) AS qty
  FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_custkey, o_orderdate, o_totalprice, o_orderstatus, o_orderpriority)"""


def facts(spark, base):
    lines = table(spark, base, "lineitem").groupBy("l_orderkey").agg(
        F.to_date(F.min("l_shipdate")).alias("first_ship"), F.to_date(F.max("l_shipdate")).alias("last_ship"), F.count("*").alias("lines"),
        F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("returned"), F.sum("l_quantity").alias("qty"),
    )
    o = table(spark, base, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("cust"), F.to_date("o_orderdate").alias("day"), F.col("o_totalprice").alias("total"), F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"), "first_ship", "last_ship", F.coalesce("lines", F.lit(0)).alias("lines"), F.coalesce("returned", F.lit(0)).alias("returned"), F.coalesce("qty", F.lit(0.0)).alias("qty"),
    )


def _evidence():
    """Ship dates are evidence always, the order's own date only of open orders."""
    return F.array("first_ship", "last_ship", F.when(F.col("status") == "O", F.col("day")))


EV_SQL = """e AS (SELECT *, list_filter([first_ship, last_ship, CASE WHEN status = 'O' THEN day END], lambda x: x IS NOT NULL) AS ev FROM f),
g AS (SELECT *, list_distinct(ev) AS ds, list_min(ev) AS low, list_max(ev) AS high FROM e)"""
HOW_SQL = f"CASE WHEN len(ds) = 0 THEN 'missing' WHEN len(ds) = 1 THEN 'single' WHEN low < DATE '{BOUNDARY}' AND high >= DATE '{BOUNDARY}' THEN 'boundary_conflict' ELSE 'earliest_of_side' END"


def date_grades(spark, base):
    return facts(spark, base).select("id", F.size(F.array_compact(_evidence())).cast("long").alias("pieces"), r.grade_dates(_evidence()).alias("grade"))


def date_boundary_resolution(spark, base):
    return facts(spark, base).select("id", r.resolve_date(_evidence(), F.lit(BOUNDARY).cast("date")).alias("d")).select("id", F.col("d.date").cast("string").alias("resolved"), F.col("d.how").alias("how"))


def effective_dates(spark, base):
    """Resolved evidence first, then the order date of finished orders, then nothing."""
    d = r.resolve_date(_evidence(), F.lit(BOUNDARY).cast("date"))
    s = r.staged(("evidence", d["date"]), ("order_date", F.when(F.col("status") == "F", F.col("day"))))
    return facts(spark, base).select("id", s.alias("s")).select("id", F.col("s.value").cast("string").alias("effective"), F.col("s.stage").alias("stage"))


def _dated_texts(spark, base):
    """The order date written in the forms that sources use."""
    ts = F.col("o_orderdate")
    form = F.col("o_custkey") % 5
    text = (
        F.when(form == 0, F.date_format(ts, "yyyy-MM-dd")).when(form == 1, F.date_format(ts, "yyyyMMddHHmmss")).when(form == 2, F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+01:00")))
        .when(form == 3, F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format(ts, "d MMMM yyyy"))
    )
    return table(spark, base, "orders").select("o_orderkey", text.alias("written"))


WRITTEN_SQL = """w AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CASE o_custkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y%m%d%H%M%S') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '+01:00'
  WHEN 3 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') ELSE CAST(day(o_orderdate) AS VARCHAR) || strftime(o_orderdate, ' %B %Y') END AS written FROM orders)"""


def timestamp_forms(spark, base):
    return _dated_texts(spark, base).select("o_orderkey", r.timestamp_form(F.col("written")).alias("t")).select("o_orderkey", F.col("t.kind").alias("kind"), F.col("t.day").cast("string").alias("day"))


def flexible_dates(spark, base):
    return _dated_texts(spark, base).select("o_orderkey", r.flexible_date(F.col("written")).cast("string").alias("day"))


def standard_names(spark, base):
    """Nation names in capitals and turned around their comma, back to one form."""
    n = table(spark, base, "nation").join(table(spark, base, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    forms = F.array(F.concat_ws(", ", F.upper("n_name"), F.upper("r_name")), F.upper("n_name"), F.concat_ws(" ", F.col("n_name"), F.col("r_name")))
    long = n.select("n_nationkey", F.posexplode(forms).alias("form", "written"))
    return long.select("n_nationkey", F.col("form").cast("long").alias("form"), r.standard_name(F.col("written")).alias("name"))


CAP = lambda x: f"array_to_string(list_transform(string_split(lower({x}), ' '), lambda w: upper(w[1:1]) || w[2:]), ' ')"


def _shares(spark, base):
    """A customer's spending per year as a share of the year, and the year before it, with its segment's approval."""
    o = table(spark, base, "orders").groupBy(F.col("o_custkey").alias("cust"), F.year("o_orderdate").alias("year")).agg(F.round(F.sum("o_totalprice"), 2).alias("spent"), F.count("*").alias("orders"))
    years = durable(o.groupBy("year").agg(F.round(F.sum("spent"), 2).alias("whole")))
    now = durable(join_small(o, years, ["year"]).withColumn("share", F.round(100 * F.col("spent") / F.col("whole"), 6)))
    before = now.select("cust", (F.col("year") + 1).alias("year"), F.col("share").alias("before"))
    cu = table(spark, base, "customer").select(F.col("c_custkey").alias("cust"), "c_mktsegment", "c_acctbal")
    return now.join(before, ["cust", "year"], "left").join(cu, "cust")


SHARE_SQL = """y AS (SELECT o_custkey AS cust, year(o_orderdate) AS year, round(sum(o_totalprice), 2) AS spent, count(*) AS orders FROM orders GROUP BY ALL), yt AS (SELECT year, round(sum(spent), 2) AS whole FROM y GROUP BY 1),
n AS (SELECT y.*, round(100 * spent / whole, 6) AS share FROM y JOIN yt USING (year)), sh AS (SELECT n.*, b.share AS before, c_mktsegment, c_acctbal FROM n LEFT JOIN n b ON n.cust = b.cust AND n.year = b.year + 1 JOIN customer ON n.cust = c_custkey)"""


def gated_share_change(spark, base):
    c = r.gated_change(F.col("share"), F.col("before"), F.col("c_mktsegment") != "FURNITURE", F.col("orders"))
    return _shares(spark, base).select("cust", "year", c.alias("c")).select("cust", "year", "c.change", "c.status")


def analysis_value(spark, base):
    """The value to analyse with its provenance: published, else derived from its parts, else none."""
    x = _shares(spark, base)
    published, derived = F.when(F.col("orders") == 1, F.col("spent")), F.when(F.col("c_acctbal") > 0, F.round(F.col("spent") / F.col("orders"), 7))
    s = r.staged(("published", published), ("derived_mean", derived))
    return x.select("cust", "year", s.alias("s")).select("cust", "year", F.col("s.value").alias("value"), F.col("s.stage").alias("provenance"))


FORMULAS = [("mean_line", "round(total / lines, 8)", ["total", "lines"]), ("kept_lines", "lines - returned", ["lines", "returned"]), ("price_per_piece", "round(total / nullif(qty, 0), 8)", ["total", "qty"])]


def derived_by_formula(spark, base):
    return r.formulas(facts(spark, base), FORMULAS, {"total", "lines", "returned", "qty"}).where("lines > 0").select("id", *[x[0] for x in FORMULAS])


def _verdicts():
    yes = lambda ok, unclear: F.when(unclear, "unclear").when(ok, "yes").otherwise("no")
    return [yes(F.col("total") > 20_000, F.col("total").isNull()), yes(F.col("lines") > 0, F.lit(False)), yes(F.col("status") != "P", F.col("status") == "P"), yes(F.col("returned") < 3, F.col("returned") == 2)]


VERDICT_SQL = """[CASE WHEN total IS NULL THEN 'unclear' WHEN total > 20000 THEN 'yes' ELSE 'no' END, CASE WHEN lines > 0 THEN 'yes' ELSE 'no' END, CASE WHEN status = 'P' THEN 'unclear' ELSE 'yes' END, CASE WHEN returned = 2 THEN 'unclear' WHEN returned < 3 THEN 'yes' ELSE 'no' END]"""


def decision_combine(spark, base):
    """Four rules to one decision, and whether a second reader is needed."""
    v = _verdicts()
    unclear = F.size(F.filter(F.array(*v), lambda x: x == "unclear"))
    return facts(spark, base).select("id", r.combine_decisions(*v).alias("decision"), (unclear >= 2).alias("second_review"))


def codebook_errors(spark, base):
    """Every codebook rule that a row breaks, in order."""
    checks = [
        (F.col("total").isNull() | (F.col("total") <= 0), "total_not_positive"), (~F.col("status").isin("F", "O", "P"), "status_unknown"), (F.col("first_ship") < F.col("day"), "shipped_before_order"),
        (F.col("lines") == 0, "no_lines"), ((F.col("status") == "F") & (F.col("last_ship") > F.lit(BOUNDARY).cast("date")), "finished_but_ships_later"), (F.col("returned") > F.col("lines") / 2, "mostly_returned"),
    ]
    e = r.listed(*checks)
    return facts(spark, base).select("id", F.array_join(e, ",").alias("errors"), F.size(e).cast("long").alias("n_errors"))


BOOK_SQL = f"""list_filter([CASE WHEN total IS NULL OR total <= 0 THEN 'total_not_positive' END, CASE WHEN status NOT IN ('F', 'O', 'P') THEN 'status_unknown' END, CASE WHEN first_ship < day THEN 'shipped_before_order' END, CASE WHEN lines = 0 THEN 'no_lines' END,
  CASE WHEN status = 'F' AND last_ship > DATE '{BOUNDARY}' THEN 'finished_but_ships_later' END, CASE WHEN returned > lines / 2 THEN 'mostly_returned' END], lambda x: x IS NOT NULL)"""
STATUS = {"F": "usable", "O": "pending", "P": "partial"}
PRECEDENCE = ["5-LOW", "3-MEDIUM", "4-NOT SPECIFIED", "2-HIGH", "1-URGENT"]


def status_mapping(spark, base):
    """Two mapping tables in a row: a status for downstream use, and the use."""
    down = r.mapped(F.col("status"), STATUS, "unknown")
    use = r.mapped(down, {"usable": "analysis", "partial": "review"}, "hold")
    return facts(spark, base).groupBy(down.alias("downstream"), use.alias("use")).agg(F.count("*").alias("orders"), F.round(F.sum("total"), 2).alias("total"))


def status_precedence(spark, base):
    """A customer's status is the one of the highest precedence among its orders."""
    place = F.array_position(F.array(*map(F.lit, PRECEDENCE)), F.col("priority"))
    return facts(spark, base).groupBy("cust").agg(F.max_by("priority", place).alias("standing"), F.count_distinct("priority").alias("kinds"))


def direct_match_decisions(spark, base):
    """A customer maps directly to its nation's main segment if no threshold fails; the failures are listed."""
    cu = table(spark, base, "customer")
    per = durable(cu.groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"), F.round(F.avg("c_acctbal"), 2).alias("balance")))
    total = per.groupBy("c_nationkey").agg(F.sum("n").alias("all_"), F.max(F.struct("n", "c_mktsegment")).alias("top"))
    x = per.join(total, "c_nationkey").withColumn("share", F.round(100 * F.col("n") / F.col("all_"), 4))
    fails = r.listed((F.col("share") < 20, "share_below_20"), (F.col("n") < 3, "fewer_than_3"), (F.col("balance") < 4500, "balance_below_4500"), (F.col("top.c_mktsegment") != F.col("c_mktsegment"), "not_the_main_segment"))
    return x.select("c_nationkey", "c_mktsegment", "share", F.array_join(fails, ",").alias("failures"), F.when(F.size(fails) == 0, "direct").otherwise("review").alias("decision"))


def url_relevance(spark, base):
    """Relevance by domain and first section of the path."""
    u = F.lower("url")
    host, section = F.regexp_extract(u, r"^[a-z]+://([^/?#]*)", 1), F.regexp_extract(u, r"^[a-z]+://[^/?#]*/([^/?#]*)", 1)
    flag = F.when(host == "", "no_host").when(host.rlike(r"(^|\.)example\.org$"), "relevant_domain").when(section.isin("en", "fr"), "relevant_section").otherwise("other")
    return table(spark, base, "pages").select("page_id", section.alias("section"), flag.alias("flag"))


def outcome_free(spark, base):
    """Predictors only: outcomes are dropped and their absence asserted, the rest goes through a governed dictionary."""
    x = facts(spark, base).withColumn("outcome_total", F.col("total"))
    kinds = {"id": "key", "cust": "predictor", "day": "metadata", "priority": "predictor", "status": "metadata", "first_ship": "metadata", "last_ship": "metadata", "lines": "predictor", "returned": "predictor", "qty": "predictor"}
    return r.permitted(r.without_outcomes(x, ["outcome_total", "total"]), kinds)


def cohort(spark, base):
    """An explicit eligibility rule, with what it leaves out counted by its first failing reason."""
    reason = F.when(F.col("lines") == 0, "no_lines").when(F.col("day") < F.lit("1993-01-01").cast("date"), "too_early").when(F.col("status") == "P", "partial").otherwise("eligible")
    return facts(spark, base).groupBy(reason.alias("reason")).agg(F.count("*").alias("orders"), F.sum("lines").cast("long").alias("lines"))


def json_hash(spark, base):
    text = r.canonical_json({"id": F.col("c_custkey"), "name": F.col("c_name"), "balance": F.col("c_acctbal"), "segment": F.when(F.col("c_nationkey") != 3, F.col("c_mktsegment"))})
    return table(spark, base, "customer").select("c_custkey", F.sha2(text, 256).alias("hash"))


def zero_aware_deviation(spark, base):
    """A value's distance from its group's mean where the group has a denominator, 0 where it has none."""
    x = facts(spark, base).withColumn("rate", F.when(F.col("lines") > 0, F.col("returned") / F.col("lines")))
    mean = durable(x.groupBy("priority").agg(F.avg("rate").alias("mean")))
    return join_small(x, mean, ["priority"]).select("id", F.when(F.col("lines") > 0, F.round(F.col("rate") - F.col("mean"), 6)).otherwise(0.0).alias("deviation"))


def layer_validators(spark, base):
    """Label layers of a document validated against its own text: quality needs words, toxic needs a passage, both must be known."""
    d = table(spark, base, "labels").join(table(spark, base, "documents").select("doc_id", "text", "lang"), "doc_id")
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda x: x != ""))
    errors = r.listed(
        (~F.col("quality").isin(0, 1) | F.col("quality").isNull(), "quality:value"), ((F.col("quality") == 1) & (words < 20), "quality:too_short"), (~F.col("toxic").isin(0, 1) | F.col("toxic").isNull(), "toxic:value"),
        ((F.col("toxic") == 1) & ~F.lower("text").rlike("idiot|moron|clown|loser|trash|stupid|pathetic|disgusting"), "toxic:no_evidence"), ((F.col("toxic") == 1) & (F.col("quality") == 1), "toxic:contradicts_quality"),
    )
    route = F.when(F.size(errors) == 0, "accept").when(F.exists(errors, lambda e: e.endswith(":value")), "retry").otherwise("flag")
    return d.select("doc_id", F.array_join(errors, ",").alias("errors"), route.alias("route"))


def label_repair(spark, base):
    """Flag-only repair: contradicting labels keep their values, get a flag and leave the retry queue; counts per route and flag."""
    return layer_validators(spark, base).groupBy("route", F.when(F.col("errors").contains("contradicts"), "flagged_contradiction").when(F.col("errors") != "", "flagged_other").otherwise("clean").alias("flag")).agg(F.count("*").alias("records"))


VALID_SQL = """lv AS (SELECT doc_id, list_filter([CASE WHEN quality NOT IN (0, 1) OR quality IS NULL THEN 'quality:value' END, CASE WHEN quality = 1 AND len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\v\\f\\r]+')) < 20 THEN 'quality:too_short' END,
  CASE WHEN toxic NOT IN (0, 1) OR toxic IS NULL THEN 'toxic:value' END, CASE WHEN toxic = 1 AND NOT regexp_matches(lower(text), 'idiot|moron|clown|loser|trash|stupid|pathetic|disgusting') THEN 'toxic:no_evidence' END,
  CASE WHEN toxic = 1 AND quality = 1 THEN 'toxic:contradicts_quality' END], lambda x: x IS NOT NULL) AS e FROM labels JOIN documents USING (doc_id)),
lr AS (SELECT doc_id, array_to_string(e, ',') AS errors, CASE WHEN len(e) = 0 THEN 'accept' WHEN len(list_filter(e, lambda x: ends_with(x, ':value'))) > 0 THEN 'retry' ELSE 'flag' END AS route FROM lv)"""


def _latest(spark, base):
    w = Window.partitionBy("cust").orderBy(F.desc("day"), F.desc("id"))
    return facts(spark, base).withColumn("k", F.row_number().over(w))


def turnout_statuses(spark, base):
    """Stated against calculated: an order's total beside the sum of its lines, with the kind of disagreement."""
    lines = table(spark, base, "lineitem").groupBy("l_orderkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("calculated"))
    x = table(spark, base, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    diff = F.round(F.col("o_totalprice") - F.col("calculated"), 2)
    status = F.when(F.col("o_totalprice").isNull() & F.col("calculated").isNull(), "missing").when(F.col("calculated").isNull(), "stated_only").when(F.col("o_totalprice").isNull(), "calculated_only").when(F.abs(diff) <= 0.5, "agrees").when(F.abs(diff) <= 1000, "rounding").otherwise("conflict")
    return x.select("o_orderkey", diff.alias("difference"), status.alias("audit"))


def change_log(spark, base):
    """Field-level changes between two conversions of a record: one row per field that differs."""
    after = {"priority": F.regexp_replace("priority", "^[0-9]-", ""), "status": r.mapped(F.col("status"), STATUS, "unknown"), "total": F.round("total", 0).cast("long").cast("string")}
    before = {"priority": F.col("priority"), "status": F.col("status"), "total": F.col("total").cast("long").cast("string")}
    rows = F.array_compact(F.array(*[F.when(~before[k].eqNullSafe(after[k]), F.struct(F.lit(k).alias("field"), before[k].alias("was"), after[k].alias("is"))) for k in before]))
    return facts(spark, base).select("id", F.explode(rows).alias("c")).select("id", "c.field", "c.was", "c.is")


QUERIES = {
    "date_grades": (date_grades, f"WITH {FACT_SQL}, {EV_SQL} SELECT id, CAST(len(ev) AS BIGINT) AS pieces, CASE WHEN len(ds) = 0 THEN 'Missing' WHEN len(ds) > 1 THEN 'Uncertain' WHEN len(ev) > 1 THEN 'Confirmed' ELSE 'Probable' END AS grade FROM g"),
    "date_boundary_resolution": (date_boundary_resolution, f"WITH {FACT_SQL}, {EV_SQL} SELECT id, CASE WHEN {HOW_SQL} IN ('single', 'earliest_of_side') THEN CAST(low AS VARCHAR) END AS resolved, {HOW_SQL} AS how FROM g"),
    "effective_dates": (effective_dates, f"WITH {FACT_SQL}, {EV_SQL}, h AS (SELECT *, CASE WHEN {HOW_SQL} IN ('single', 'earliest_of_side') THEN low END AS d FROM g) SELECT id, CAST(coalesce(d, CASE WHEN status = 'F' THEN day END) AS VARCHAR) AS effective, CASE WHEN d IS NOT NULL THEN 'evidence' WHEN status = 'F' AND day IS NOT NULL THEN 'order_date' ELSE 'unresolved' END AS stage FROM h"),
    "timestamp_forms": (timestamp_forms, f"WITH {WRITTEN_SQL} SELECT o_orderkey, CASE WHEN regexp_matches(written, '^[0-9]{{4}}-..-..$') THEN 'date' WHEN regexp_matches(written, '^[0-9]{{14}}$') THEN 'compact' WHEN contains(written, '+') THEN 'iso_offset' WHEN contains(written, ':') THEN 'iso_local' ELSE 'unparsed' END AS kind, CASE WHEN regexp_matches(written, '[A-Z][a-z]') THEN NULL ELSE CAST(day AS VARCHAR) END AS day FROM w"),
    "flexible_dates": (flexible_dates, f"WITH {WRITTEN_SQL} SELECT o_orderkey, CASE WHEN regexp_matches(written, '^[0-9]{{4}}-..-..$|[A-Z][a-z]') THEN CAST(day AS VARCHAR) END AS day FROM w"),
    "standard_names": (standard_names, f"WITH n AS (SELECT n_nationkey, n_name AS a, r_name AS b FROM nation JOIN region ON n_regionkey = r_regionkey) SELECT n_nationkey, CAST(0 AS BIGINT) AS form, {CAP('b')} || ' ' || {CAP('a')} AS name FROM n UNION ALL SELECT n_nationkey, 1, {CAP('a')} FROM n UNION ALL SELECT n_nationkey, 2, CASE WHEN a || ' ' || b = upper(a || ' ' || b) THEN {CAP('a')} || ' ' || {CAP('b')} ELSE a || ' ' || b END FROM n"),
    "gated_share_change": (gated_share_change, f"WITH {SHARE_SQL}, q AS (SELECT *, CASE WHEN share IS NULL THEN 'current_missing' WHEN before IS NULL THEN 'previous_missing' WHEN c_mktsegment = 'FURNITURE' THEN 'not_approved' WHEN orders > 1 THEN 'not_comparable' ELSE 'available' END AS status FROM sh) SELECT cust, CAST(year AS INT) AS year, CASE WHEN status = 'available' THEN round(share - before, 6) END AS change, status FROM q"),
    "analysis_value": (analysis_value, f"WITH {SHARE_SQL} SELECT cust, CAST(year AS INT) AS year, CASE WHEN orders = 1 THEN spent WHEN c_acctbal > 0 THEN round(spent / orders, 7) END AS value, CASE WHEN orders = 1 THEN 'published' WHEN c_acctbal > 0 THEN 'derived_mean' ELSE 'unresolved' END AS provenance FROM sh"),
    "derived_by_formula": (derived_by_formula, f"WITH {FACT_SQL} SELECT id, round(total / lines, 8) AS mean_line, lines - returned AS kept_lines, round(total / nullif(qty, 0), 8) AS price_per_piece FROM f WHERE lines > 0"),
    "decision_combine": (decision_combine, f"WITH {FACT_SQL}, v AS (SELECT id, {VERDICT_SQL} AS v FROM f) SELECT id, CASE WHEN list_contains(v, 'no') THEN 'exclude' WHEN list_contains(v, 'unclear') THEN 'review' ELSE 'include' END AS decision, len(list_filter(v, lambda x: x = 'unclear')) >= 2 AS second_review FROM v"),
    "codebook_errors": (codebook_errors, f"WITH {FACT_SQL}, e AS (SELECT id, {BOOK_SQL} AS e FROM f) SELECT id, array_to_string(e, ',') AS errors, CAST(len(e) AS BIGINT) AS n_errors FROM e"),
    "status_mapping": (status_mapping, "WITH s AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'usable' WHEN 'O' THEN 'pending' WHEN 'P' THEN 'partial' ELSE 'unknown' END AS downstream, o_totalprice FROM orders) SELECT downstream, CASE downstream WHEN 'usable' THEN 'analysis' WHEN 'partial' THEN 'review' ELSE 'hold' END AS use, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM s GROUP BY ALL"),
    "status_precedence": (status_precedence, f"SELECT o_custkey AS cust, arg_max(o_orderpriority, list_position({PRECEDENCE}, o_orderpriority)) AS standing, count(DISTINCT o_orderpriority) AS kinds FROM orders GROUP BY 1"),
    "direct_match_decisions": (direct_match_decisions, "WITH p AS (SELECT c_nationkey, c_mktsegment, count(*) AS n, round(avg(c_acctbal), 2) AS balance FROM customer GROUP BY ALL), x AS (SELECT *, round(100 * n / sum(n) OVER w, 4) AS share, row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_mktsegment DESC) AS k FROM p WINDOW w AS (PARTITION BY c_nationkey)), e AS (SELECT *, list_filter([CASE WHEN share < 20 THEN 'share_below_20' END, CASE WHEN n < 3 THEN 'fewer_than_3' END, CASE WHEN balance < 4500 THEN 'balance_below_4500' END, CASE WHEN k > 1 THEN 'not_the_main_segment' END], lambda x: x IS NOT NULL) AS e FROM x) SELECT c_nationkey, c_mktsegment, share, array_to_string(e, ',') AS failures, CASE WHEN len(e) = 0 THEN 'direct' ELSE 'review' END AS decision FROM e"),
    "url_relevance": (url_relevance, r"WITH u AS (SELECT page_id, lower(url) AS u FROM pages), h AS (SELECT page_id, regexp_extract(u, '^[a-z]+://([^/?#]*)', 1) AS host, regexp_extract(u, '^[a-z]+://[^/?#]*/([^/?#]*)', 1) AS section FROM u) SELECT page_id, section, CASE WHEN host = '' THEN 'no_host' WHEN regexp_matches(host, '(^|\.)example\.org$') THEN 'relevant_domain' WHEN section IN ('en', 'fr') THEN 'relevant_section' ELSE 'other' END AS flag FROM h"),
    "outcome_free": (outcome_free, f"WITH {FACT_SQL} SELECT id, cust, priority, lines, returned, qty FROM f"),
    "cohort": (cohort, f"WITH {FACT_SQL} SELECT CASE WHEN lines = 0 THEN 'no_lines' WHEN day < DATE '1993-01-01' THEN 'too_early' WHEN status = 'P' THEN 'partial' ELSE 'eligible' END AS reason, count(*) AS orders, CAST(sum(lines) AS BIGINT) AS lines FROM f GROUP BY 1"),
    "json_hash": (json_hash, """SELECT c_custkey, sha256('{"balance":"' || c_acctbal || '","id":"' || c_custkey || '","name":"' || c_name || '","segment":' || CASE WHEN c_nationkey <> 3 THEN '"' || c_mktsegment || '"' ELSE 'null' END || '}') AS hash FROM customer"""),
    "zero_aware_deviation": (zero_aware_deviation, f"WITH {FACT_SQL}, x AS (SELECT *, CASE WHEN lines > 0 THEN returned / lines END AS rate FROM f), m AS (SELECT priority, avg(rate) AS mean FROM x GROUP BY 1) SELECT id, CASE WHEN lines > 0 THEN round(rate - mean, 6) ELSE 0.0 END AS deviation FROM x JOIN m USING (priority)"),
    "layer_validators": (layer_validators, f"WITH {VALID_SQL} SELECT * FROM lr"),
    "label_repair": (label_repair, f"WITH {VALID_SQL} SELECT route, CASE WHEN contains(errors, 'contradicts') THEN 'flagged_contradiction' WHEN errors <> '' THEN 'flagged_other' ELSE 'clean' END AS flag, count(*) AS records FROM lr GROUP BY ALL"),
    "turnout_statuses": (turnout_statuses, "WITH l AS (SELECT l_orderkey, round(sum(l_extendedprice), 2) AS calculated FROM lineitem GROUP BY 1), x AS (SELECT o_orderkey, o_totalprice AS t, calculated AS c, round(o_totalprice - calculated, 2) AS difference FROM orders LEFT JOIN l ON o_orderkey = l_orderkey) SELECT o_orderkey, difference, CASE WHEN t IS NULL AND c IS NULL THEN 'missing' WHEN c IS NULL THEN 'stated_only' WHEN t IS NULL THEN 'calculated_only' WHEN abs(difference) <= 0.5 THEN 'agrees' WHEN abs(difference) <= 1000 THEN 'rounding' ELSE 'conflict' END AS audit FROM x"),
    "change_log": (change_log, f"""WITH {FACT_SQL}, x AS (SELECT id, 'priority' AS field, priority AS was, regexp_replace(priority, '^[0-9]-', '') AS "is" FROM f UNION ALL SELECT id, 'status', status, CASE status WHEN 'F' THEN 'usable' WHEN 'O' THEN 'pending' WHEN 'P' THEN 'partial' ELSE 'unknown' END FROM f UNION ALL SELECT id, 'total', CAST(CAST(trunc(total) AS BIGINT) AS VARCHAR), CAST(CAST(round(total, 0) AS BIGINT) AS VARCHAR) FROM f) SELECT * FROM x WHERE was IS DISTINCT FROM "is" """),
}
