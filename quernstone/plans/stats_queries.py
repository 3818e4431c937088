"""Statistics queries: predictions over lineitem contests, raters over labelled documents."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernstone.operators import stats as s
from quernstone.plans.contest_queries import VOTES_SQL, votes
from quernstone.plans.durable import durable, join_small
from quernstone.sources.tables import table

PRED_SQL = f"""{VOTES_SQL}, t AS (SELECT *, 100 * votes / sum(votes) OVER w AS observed, 100 * strength / sum(strength) OVER w AS predicted, count(*) OVER w AS size, contest % 4 AS election FROM votes WINDOW w AS (PARTITION BY contest))"""


def predictions(spark, base):
    w = Window.partitionBy("contest")
    return votes(spark, base).select(
        "contest", "party", (F.col("contest") % 4).alias("election"), F.count(F.lit(1)).over(w).alias("size"),
        (100 * F.col("votes") / F.sum("votes").over(w)).alias("observed"), (100 * F.col("strength") / F.sum("strength").over(w)).alias("predicted"),
    )


RATER_SQL = """r AS (SELECT l.doc_id, CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS one, CASE WHEN length(text) < 80 THEN 'bad' WHEN regexp_matches(text, '[!#*]{2}') THEN 'bad' ELSE 'good' END AS two,
  quality, least(greatest(length(text) / 4000.0, 0.0), 1.0) AS p, lang, source FROM labels l JOIN documents d USING (doc_id))"""


def raters(spark, base):
    d = table(spark, base, "labels").join(table(spark, base, "documents"), "doc_id")
    return d.select(
        "doc_id", F.when(F.col("quality") == 1, "good").otherwise("bad").alias("one"),
        F.when(F.length("text") < 80, "bad").when(F.col("text").rlike("[!#*]{2}"), "bad").otherwise("good").alias("two"),
        "quality", F.least(F.greatest(F.length("text") / 4000.0, F.lit(0.0)), F.lit(1.0)).alias("p"), "lang", "source",
    )


def mae_suite_grouping_sets(spark, base):
    grains = {"all": [], "size": ["size"], "election": ["election"], "party": ["party"]}
    return s.error_suite(predictions(spark, base), "predicted", "observed", grains)


def equal_split_reference(spark, base):
    p = predictions(spark, base)
    return p.groupBy("election").agg(
        F.round(F.avg(F.abs(100 / F.col("size") - F.col("observed"))), 6).alias("reference_mae"),
        F.round(F.avg(F.abs(F.col("predicted") - F.col("observed"))), 6).alias("mae"),
        F.round(1 - F.avg(F.abs(F.col("predicted") - F.col("observed"))) / F.avg(F.abs(100 / F.col("size") - F.col("observed"))), 6).alias("improvement"),
    )


def kappa_ac1_pabak(spark, base):
    return s.agreement(raters(spark, base), "one", "two")


def agreement_gate(spark, base):
    """Two routes: kappa where marginals are balanced, AC1 where they are skewed."""
    a = s.agreement(raters(spark, base), "one", "two")
    skewed = F.col("majority") >= 0.85
    ok = F.when(skewed, F.coalesce(F.col("ac1") >= 0.6, F.lit(False))).otherwise(F.coalesce(F.col("kappa") >= 0.6, F.lit(False)))
    return a.select(skewed.alias("skewed"), F.when(skewed, "ac1").otherwise("kappa").alias("route"), ok.alias("passes"))


AGREE_SQL = f"""{RATER_SQL}, pr AS (SELECT one AS x, two AS y, count(*) AS n FROM r GROUP BY ALL),
ct AS (SELECT c, sum(nx) AS nx, sum(ny) AS ny, sum(same) AS same FROM (SELECT x AS c, n AS nx, 0 AS ny, CASE WHEN x = y THEN n ELSE 0 END AS same FROM pr UNION ALL SELECT y, 0, n, 0 FROM pr) GROUP BY c),
tt AS (SELECT sum(nx) AS n, sum(same) AS same, count(*) AS q, sum(nx * ny) AS xy, sum((nx + ny) * (nx + ny)) AS mm, max(greatest(nx, ny)) AS top FROM ct),
st AS (SELECT n, q, top, same / n AS po, xy / (n * n) AS pe, (1 - mm / (4 * n * n)) / (q - 1) AS ch FROM tt),
ag AS (SELECT CAST(n AS BIGINT) AS n, round(po, 6) AS agreement, round((po - pe) / (1 - pe), 6) AS kappa, round((po - ch) / (1 - ch), 6) AS ac1, round((q * po - 1) / (q - 1), 6) AS pabak, round(top / n, 6) AS majority FROM st)"""


def spearman_within_contest(spark, base):
    per = s.spearman(predictions(spark, base), ["contest"], "predicted", "observed")
    return per.agg(F.count("*").alias("contests"), F.count("rho").alias("defined"), F.round(F.avg("rho"), 5).alias("mean_rho"))


def pearson_min3(spark, base):
    return s.pearson(predictions(spark, base), ["party", "election"], "predicted", "observed", "r", 5)


def group_slope(spark, base):
    e = table(spark, base, "events").withColumn("x", F.dayofmonth("ts").cast("double"))
    return e.groupBy("event_type", (F.col("user_id") % 10).alias("g")).agg(F.when(F.count("*") >= 2, F.round(F.regr_slope("value", "x"), 5)).alias("slope"), F.count("*").alias("n"))


def variance_split(spark, base):
    return s.variance_split(predictions(spark, base).withColumn("v", F.round("observed", 6)), "party", "v", 2)


def with_party_mean(spark, base, of, name):
    """Predictions with their party's mean, joined from an aggregate: a party with a third of all rows stays spread."""
    p = durable(predictions(spark, base))
    return join_small(p, durable(p.groupBy("party").agg(F.avg(of).alias(name))), ["party"])


def bias_dispersion(spark, base):
    e = with_party_mean(spark, base, F.col("predicted") - F.col("observed"), "bias")
    d = F.abs(F.col("predicted") - F.col("observed") - F.col("bias"))
    return e.groupBy("party").agg(F.round(F.max("bias"), 5).alias("bias"), F.round(F.avg(d), 5).alias("dispersion"))


def demean_group(spark, base):
    return with_party_mean(spark, base, F.col("observed"), "m").select("contest", "party", F.round(F.col("observed") - F.col("m"), 5).alias("centred"))


def residual_means(spark, base):
    """Mean residual per election and party, with a floor on rows."""
    e = predictions(spark, base).withColumn("e", F.col("observed") - F.col("predicted"))
    return e.groupBy("election", "party").agg(F.count("*").alias("n"), F.when(F.count("*") >= 20, F.round(F.avg("e"), 5)).alias("residual"))


def pooled_variance(spark, base):
    per = predictions(spark, base).groupBy("election", "party").agg(F.count("*").alias("n"), F.var_samp("observed").alias("v")).where("n > 1")
    return per.agg(F.round(F.sum((F.col("n") - 1) * F.col("v")) / F.sum(F.col("n") - 1), 4).alias("pooled"), F.count("*").alias("cells"))


def brier_logloss(spark, base):
    q = F.greatest(F.least(F.col("p"), F.lit(1 - 1e-6)), F.lit(1e-6))
    y = F.col("quality")
    return raters(spark, base).groupBy("lang").agg(
        F.count("*").alias("n"), F.round(F.avg((F.col("p") - y) * (F.col("p") - y)), 6).alias("brier"),
        F.round(-F.avg(y * F.log(q) + (1 - y) * F.log(1 - q)), 6).alias("log_loss"),
    )


def calibration_bins(spark, base):
    return s.calibration(raters(spark, base), "p", "quality")


def expected_calibration_error(spark, base):
    b = s.calibration(raters(spark, base), "p", "quality", places=12)
    return b.agg(F.round(F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("mean_y"))) / F.sum("n"), 6).alias("ece"), F.sum("n").alias("n"))


def logit_round_trip(spark, base):
    q = F.greatest(F.least(F.col("p"), F.lit(0.999)), F.lit(0.001))
    z = F.log(q / (1 - q))
    return raters(spark, base).select("doc_id", F.round(z, 6).alias("logit"), F.round(1 / (1 + F.exp(-z)), 6).alias("sigmoid"))


def weighted_reallocation(spark, base):
    """Order values of nations moved to regions of a second division by customer weight."""
    cu = table(spark, base, "customer").withColumn("target", F.col("c_custkey") % 6)
    w = cu.groupBy("c_nationkey", "target").agg(F.count("*").alias("people"))
    share = F.col("people") / F.sum("people").over(Window.partitionBy("c_nationkey"))
    total = table(spark, base, "orders").join(cu, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.sum("o_totalprice").alias("value"))
    return w.withColumn("w", share).join(total, "c_nationkey").groupBy("target").agg(F.round(F.sum(F.col("w") * F.col("value")), 2).alias("value"), F.count("*").alias("parts"))


def crosswalk_topology(spark, base):
    """One-to-one, one-to-many, many-to-one or many-to-many for each old and new area pair."""
    p = table(spark, base, "customer").select("c_nationkey", (F.col("c_custkey") % 97 % 40).alias("target")).distinct()
    a = F.count(F.lit(1)).over(Window.partitionBy("c_nationkey"))
    b = F.count(F.lit(1)).over(Window.partitionBy("target"))
    kind = F.when((a == 1) & (b == 1), "one_to_one").when(b == 1, "one_to_many").when(a == 1, "many_to_one").otherwise("many_to_many")
    return p.withColumn("kind", kind).groupBy("kind").agg(F.count("*").alias("pairs"))


def stratified_hash_quota(spark, base):
    return s.hash_quota(table(spark, base, "documents").select("doc_id", "lang", "source"), ["lang", "source"], "doc_id", 3, "q1:")


def largest_remainder(spark, base):
    g = table(spark, base, "documents").groupBy("source").agg(F.count("*").alias("docs"))
    return s.largest_remainder(g, "source", "docs", 57)


def window_quota(spark, base):
    """A quota of max(1, round(n * share)) per language, filled in sha256 order."""
    d = table(spark, base, "documents").select("doc_id", "lang")
    n = d.groupBy("lang").agg(F.greatest(F.lit(1), F.round(F.count("*") * 0.07)).cast("long").alias("quota"))
    return s.quota_by_hash(d, n, "lang", "doc_id")


def top_n_tiebreak(spark, base):
    return table(spark, base, "customer").select("c_custkey", "c_name", F.round("c_acctbal", 0).alias("key")).orderBy(F.desc("key"), "c_name").limit(25)


def strata_union(spark, base):
    """Several top-n draws in one table; a row drawn twice lists both reasons."""
    cu = table(spark, base, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    parts = [cu.orderBy(F.desc("c_acctbal"), "c_custkey").limit(30).withColumn("why", F.lit("rich")), cu.orderBy("c_acctbal", "c_custkey").limit(30).withColumn("why", F.lit("poor")),
             cu.where("c_mktsegment = 'BUILDING'").orderBy(F.desc("c_acctbal"), "c_custkey").limit(30).withColumn("why", F.lit("building"))]
    out = parts[0].union(parts[1]).union(parts[2])
    return out.groupBy("c_custkey").agg(F.array_join(F.array_sort(F.collect_set("why")), ",").alias("reasons"))


def ridge_moments(spark, base):
    exact = [F.col(c).cast("decimal(12,2)").alias(c) for c in ("l_quantity", "l_discount", "l_tax")]
    return s.gram(table(spark, base, "lineitem").select(*exact, F.floor(F.col("l_extendedprice") / 100).cast("decimal(12,2)").alias("price")), ["l_quantity", "l_discount", "l_tax"], "price", 3)


REPLICATES = 2000
BOOT_SQL = f"""{PRED_SQL}, k AS (SELECT contest, any_value(election) AS election, sum(abs(predicted - observed)) AS a, sum(abs(100.0 / size - observed)) AS b, count(*) AS n FROM t GROUP BY contest),
{s.draws_sql("k", "contest", REPLICATES, "election, a, b, n")},
bs AS (SELECT replicate, sum(times * b) / sum(times * n) - sum(times * a) / sum(times * n) AS gain FROM dr GROUP BY replicate)"""


def bootstrap_gains(spark, base):
    p = predictions(spark, base)
    k = p.groupBy("contest").agg(F.sum(F.abs(F.col("predicted") - F.col("observed"))).alias("a"), F.sum(F.abs(100 / F.col("size") - F.col("observed"))).alias("b"), F.count("*").alias("n"))
    return s.drawn_sums(k, "contest", REPLICATES, [], ["a", "b", "n"]).select("replicate", (F.col("b") / F.col("n") - F.col("a") / F.col("n")).alias("gain"))


def contest_bootstrap_ci(spark, base):
    return bootstrap_gains(spark, base).agg(
        F.round(F.avg("gain"), 5).alias("mean_gain"), F.round(F.percentile("gain", 0.025), 5).alias("lower"), F.round(F.percentile("gain", 0.975), 5).alias("upper"), F.count("*").alias("replicates")
    )


def paired_bootstrap(spark, base):
    """Share of replicates in which the prediction beats the equal split, per election."""
    p = predictions(spark, base)
    k = p.groupBy("election", "contest").agg(F.sum(F.abs(100 / F.col("size") - F.col("observed")) - F.abs(F.col("predicted") - F.col("observed"))).alias("d"))
    x = s.drawn_sums(k, "contest", REPLICATES, ["election"], ["d"]).withColumn("d", F.round("d", 6))
    return x.groupBy("election").agg(F.count(F.when(F.col("d") > 0, 1)).alias("wins"), F.count("*").alias("replicates"))


def encoder_median_onehot(spark, base):
    """Median imputation with a missing flag, one-hot with an unseen bucket, standardised by population spread."""
    o = table(spark, base, "customer").withColumn("x", F.when(F.col("c_custkey") % 9 != 0, F.col("c_acctbal")))
    fit = s.exact_median(o, [], "x", "med")
    filled = o.join(F.broadcast(fit)).withColumn("f", F.coalesce("x", "med"))
    st = filled.agg(F.avg("f").alias("m"), F.stddev_pop("f").alias("sd"))
    known = ["AUTOMOBILE", "BUILDING", "FURNITURE"]
    hot = [F.when(F.col("c_mktsegment") == k, 1).otherwise(0).cast("long").alias(f"is_{k.lower()}") for k in known]
    other = F.when(F.col("c_mktsegment").isin(known), 0).otherwise(1).cast("long").alias("is_unseen")
    return filled.join(F.broadcast(st)).select("c_custkey", F.col("x").isNull().alias("missing"), F.round((F.col("f") - F.col("m")) / F.col("sd"), 5).alias("z"), *hot, other)


def interaction_nulls(spark, base):
    """flag x value: 0 where the flag is off, null only where it is on and the value is unknown."""
    o = table(spark, base, "customer").withColumn("flag", F.col("c_mktsegment") == "BUILDING").withColumn("x", F.when(F.col("c_custkey") % 9 != 0, F.col("c_acctbal")))
    return o.select("c_custkey", F.when(F.col("flag") & F.col("x").isNull(), None).when(F.col("flag"), F.col("x")).otherwise(0.0).alias("inter"))


def deciding_margin(spark, base):
    """Mean absolute error over the two leading entries of each contest."""
    w = Window.partitionBy("contest").orderBy(F.desc("observed"), "party")
    return predictions(spark, base).withColumn("r", F.row_number().over(w)).where("r <= 2").groupBy("election").agg(F.round(F.avg(F.abs(F.col("predicted") - F.col("observed"))), 5).alias("mae"), F.count("*").alias("n"))


def sign_flips(spark, base):
    """Parties whose slope changes sign between elections' halves."""
    h = predictions(spark, base).withColumn("half", F.col("election") % 2)
    b = h.groupBy("party", "half").agg(F.round(F.regr_slope("observed", "predicted") - 1, 5).alias("b"))
    p = b.groupBy("party").agg(F.max(F.when(F.col("half") == 0, F.col("b"))).alias("b0"), F.max(F.when(F.col("half") == 1, F.col("b"))).alias("b1"))
    return p.withColumn("flips", F.signum("b0") != F.signum("b1"))


QUERIES = {
    "mae_suite_grouping_sets": (mae_suite_grouping_sets, f"""WITH {PRED_SQL}, e AS (SELECT *, predicted - observed AS e FROM t)
SELECT CASE grouping_id(size, election, party) WHEN 7 THEN 'all' WHEN 3 THEN 'size' WHEN 5 THEN 'election' ELSE 'party' END AS grain, size, election, party, count(*) AS n, round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse, round(avg(e), 6) + 0.0 AS bias, round(median(abs(e)), 6) AS median_ae, round(avg(abs(e)) / avg(observed), 6) AS relative_mae FROM e GROUP BY GROUPING SETS ((), (size), (election), (party))"""),
    "equal_split_reference": (equal_split_reference, f"WITH {PRED_SQL} SELECT election, round(avg(abs(100 / size - observed)), 6) AS reference_mae, round(avg(abs(predicted - observed)), 6) AS mae, round(1 - avg(abs(predicted - observed)) / avg(abs(100 / size - observed)), 6) AS improvement FROM t GROUP BY election"),
    "kappa_ac1_pabak": (kappa_ac1_pabak, f"WITH {AGREE_SQL} SELECT * FROM ag"),
    "agreement_gate": (agreement_gate, f"WITH {AGREE_SQL} SELECT majority >= 0.85 AS skewed, CASE WHEN majority >= 0.85 THEN 'ac1' ELSE 'kappa' END AS route, CASE WHEN majority >= 0.85 THEN ac1 >= 0.6 ELSE kappa >= 0.6 END AS passes FROM ag"),
    "spearman_within_contest": (spearman_within_contest, f"WITH {PRED_SQL}, k AS (SELECT contest, rank() OVER (PARTITION BY contest ORDER BY predicted) + (count(*) OVER (PARTITION BY contest, predicted) - 1) / 2 AS x, rank() OVER (PARTITION BY contest ORDER BY observed) + (count(*) OVER (PARTITION BY contest, observed) - 1) / 2 AS y FROM t), p AS (SELECT contest, CASE WHEN count(*) >= 3 AND var_pop(x) > 0 AND var_pop(y) > 0 THEN round(corr(x, y), 6) END AS rho FROM k GROUP BY contest) SELECT count(*) AS contests, count(rho) AS defined, round(avg(rho), 5) AS mean_rho FROM p"),
    "pearson_min3": (pearson_min3, f"WITH {PRED_SQL} SELECT party, election, count(*) AS n, CASE WHEN count(*) >= 3 THEN round(corr(predicted, observed), 5) END AS r FROM t GROUP BY ALL"),
    "group_slope": (group_slope, "SELECT event_type, user_id % 10 AS g, CASE WHEN count(*) >= 2 THEN round(regr_slope(value, CAST(day(ts) AS DOUBLE)), 5) END AS slope, count(*) AS n FROM events GROUP BY ALL"),
    "variance_split": (variance_split, f"WITH {PRED_SQL}, v AS (SELECT party, round(observed, 6) AS v FROM t), p AS (SELECT party, count(v) AS n, avg(v) AS m, sum(v) AS s, sum(v * v) AS ss FROM v GROUP BY party), q AS (SELECT sum(n) AS n, sum(s) AS s, sum(ss) AS ss, sum(n * m * m) AS b FROM p) SELECT CAST(n AS BIGINT) AS n, round(ss - s * s / n, 2) AS total, round(b - s * s / n, 2) AS between, round(ss - b, 2) AS within, round((b - s * s / n) / (ss - s * s / n), 6) AS between_share FROM q"),
    "bias_dispersion": (bias_dispersion, f"WITH {PRED_SQL}, e AS (SELECT party, predicted - observed AS e FROM t), d AS (SELECT *, abs(e - avg(e) OVER (PARTITION BY party)) AS d FROM e) SELECT party, round(avg(e), 5) AS bias, round(avg(d), 5) AS dispersion FROM d GROUP BY party"),
    "demean_group": (demean_group, f"WITH {PRED_SQL} SELECT contest, party, round(observed - avg(observed) OVER (PARTITION BY party), 5) AS centred FROM t"),
    "residual_means": (residual_means, f"WITH {PRED_SQL} SELECT election, party, count(*) AS n, CASE WHEN count(*) >= 20 THEN round(avg(observed - predicted), 5) END AS residual FROM t GROUP BY ALL"),
    "pooled_variance": (pooled_variance, f"WITH {PRED_SQL}, p AS (SELECT count(*) AS n, var_samp(observed) AS v FROM t GROUP BY election, party HAVING count(*) > 1) SELECT round(sum((n - 1) * v) / sum(n - 1), 4) AS pooled, count(*) AS cells FROM p"),
    "brier_logloss": (brier_logloss, f"WITH {RATER_SQL}, q AS (SELECT *, greatest(least(p, 1 - 1e-6), 1e-6) AS q FROM r) SELECT lang, count(*) AS n, round(avg((p - quality) * (p - quality)), 6) AS brier, round(-avg(quality * ln(q) + (1 - quality) * ln(1 - q)), 6) AS log_loss FROM q GROUP BY lang"),
    "calibration_bins": (calibration_bins, f"WITH {RATER_SQL}, b AS (SELECT CAST(least(floor(p * 10), 9) AS BIGINT) AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(quality), 6) AS mean_y FROM r GROUP BY 1) SELECT a.bin, coalesce(n, 0) AS n, mean_p, mean_y FROM (SELECT unnest(range(10)) AS bin) a LEFT JOIN b USING (bin)"),
    "expected_calibration_error": (expected_calibration_error, f"WITH {RATER_SQL}, b AS (SELECT count(*) AS n, avg(p) AS mp, avg(quality) AS my FROM r GROUP BY least(floor(p * 10), 9)) SELECT round(sum(n * abs(mp - my)) / sum(n), 6) AS ece, CAST(sum(n) AS BIGINT) AS n FROM b"),
    "logit_round_trip": (logit_round_trip, f"WITH {RATER_SQL}, q AS (SELECT doc_id, greatest(least(p, 0.999), 0.001) AS q FROM r) SELECT doc_id, round(ln(q / (1 - q)), 6) AS logit, round(1 / (1 + exp(-ln(q / (1 - q)))), 6) AS sigmoid FROM q"),
    "weighted_reallocation": (weighted_reallocation, "WITH c AS (SELECT *, c_custkey % 6 AS target FROM customer), w AS (SELECT c_nationkey, target, count(*) AS people FROM c GROUP BY ALL), s AS (SELECT *, people / sum(people) OVER (PARTITION BY c_nationkey) AS w FROM w), v AS (SELECT c_nationkey, sum(o_totalprice) AS value FROM orders JOIN c ON o_custkey = c_custkey GROUP BY 1) SELECT target, round(sum(w * value), 2) AS value, count(*) AS parts FROM s JOIN v USING (c_nationkey) GROUP BY target"),
    "crosswalk_topology": (crosswalk_topology, "WITH p AS (SELECT DISTINCT c_nationkey, c_custkey % 97 % 40 AS target FROM customer), k AS (SELECT count(*) OVER (PARTITION BY c_nationkey) AS a, count(*) OVER (PARTITION BY target) AS b FROM p) SELECT CASE WHEN a = 1 AND b = 1 THEN 'one_to_one' WHEN b = 1 THEN 'one_to_many' WHEN a = 1 THEN 'many_to_one' ELSE 'many_to_many' END AS kind, count(*) AS pairs FROM k GROUP BY 1"),
    "stratified_hash_quota": (stratified_hash_quota, "SELECT doc_id, lang, source, place FROM (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY sha256('q1:' || doc_id), doc_id) AS place FROM documents) WHERE place <= 3"),
    "largest_remainder": (largest_remainder, "WITH g AS (SELECT source, count(*) AS docs FROM documents GROUP BY 1), q AS (SELECT *, 57 * docs / sum(docs) OVER () AS q FROM g), f AS (SELECT *, floor(q) AS f FROM q) SELECT source, docs, CAST(f + CASE WHEN row_number() OVER (ORDER BY round(q - f, 9) DESC, source) <= 57 - sum(f) OVER () THEN 1 ELSE 0 END AS BIGINT) AS seats FROM f"),
    "window_quota": (window_quota, "WITH n AS (SELECT lang, CAST(greatest(1, round(count(*) * 0.07)) AS BIGINT) AS quota FROM documents GROUP BY 1) SELECT lang, doc_id, place, quota FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256(CAST(doc_id AS VARCHAR)), doc_id) AS place FROM documents) JOIN n USING (lang) WHERE place <= quota"),
    "top_n_tiebreak": (top_n_tiebreak, "SELECT c_custkey, c_name, round(c_acctbal, 0) AS key FROM customer ORDER BY key DESC, c_name LIMIT 25"),
    "strata_union": (strata_union, "WITH u AS ((SELECT c_custkey, 'rich' AS why FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 30) UNION ALL (SELECT c_custkey, 'poor' FROM customer ORDER BY c_acctbal, c_custkey LIMIT 30) UNION ALL (SELECT c_custkey, 'building' FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_acctbal DESC, c_custkey LIMIT 30)) SELECT c_custkey, string_agg(why, ',' ORDER BY why) AS reasons FROM u GROUP BY 1"),
    "ridge_moments": (ridge_moments, None),
    "contest_bootstrap_ci": (contest_bootstrap_ci, f"WITH {BOOT_SQL} SELECT round(avg(gain), 5) AS mean_gain, round(quantile_cont(gain, 0.025), 5) AS lower, round(quantile_cont(gain, 0.975), 5) AS upper, count(*) AS replicates FROM bs"),
    "paired_bootstrap": (paired_bootstrap, f"WITH {PRED_SQL}, k AS (SELECT election, contest, sum(abs(100.0 / size - observed) - abs(predicted - observed)) AS d FROM t GROUP BY ALL), {s.draws_sql('k', 'contest', REPLICATES, 'election, d')}, x AS (SELECT election, replicate, round(sum(times * d), 6) AS d FROM dr GROUP BY ALL) SELECT election, count(*) FILTER (d > 0) AS wins, count(*) AS replicates FROM x GROUP BY election"),
    "encoder_median_onehot": (encoder_median_onehot, "WITH o AS (SELECT *, CASE WHEN c_custkey % 9 <> 0 THEN c_acctbal END AS x FROM customer), f AS (SELECT *, coalesce(x, median(x) OVER ()) AS f FROM o) SELECT c_custkey, x IS NULL AS missing, round((f - avg(f) OVER ()) / stddev_pop(f) OVER (), 5) AS z, CAST(c_mktsegment = 'AUTOMOBILE' AS BIGINT) AS is_automobile, CAST(c_mktsegment = 'BUILDING' AS BIGINT) AS is_building, CAST(c_mktsegment = 'FURNITURE' AS BIGINT) AS is_furniture, CAST(c_mktsegment NOT IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE') AS BIGINT) AS is_unseen FROM f"),
    "interaction_nulls": (interaction_nulls, "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN CASE WHEN c_custkey % 9 <> 0 THEN c_acctbal END ELSE 0.0 END AS inter FROM customer"),
    "deciding_margin": (deciding_margin, f"WITH {PRED_SQL} SELECT election, round(avg(abs(predicted - observed)), 5) AS mae, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY contest ORDER BY observed DESC, party) AS r FROM t) WHERE r <= 2 GROUP BY election"),
    "sign_flips": (sign_flips, f"WITH {PRED_SQL}, b AS (SELECT party, election % 2 AS half, round(regr_slope(observed, predicted) - 1, 5) AS b FROM t GROUP BY ALL), p AS (SELECT party, max(b) FILTER (half = 0) AS b0, max(b) FILTER (half = 1) AS b1 FROM b GROUP BY party) SELECT *, sign(b0) <> sign(b1) AS flips FROM p"),
}
QUERIES["ridge_moments"] = (ridge_moments, "WITH x AS (SELECT CAST(l_quantity AS DECIMAL(12,2)) AS l_quantity, CAST(l_discount AS DECIMAL(12,2)) AS l_discount, CAST(l_tax AS DECIMAL(12,2)) AS l_tax, CAST(floor(l_extendedprice / 100) AS DECIMAL(12,2)) AS price FROM lineitem), m AS (" + " UNION ALL ".join(
    ["SELECT 'one' AS i, 'one' AS j, CAST(count(*) AS DOUBLE) AS value FROM x"]
    + [f"SELECT 'one', '{k}', CAST(round(sum({k}), 3) AS DOUBLE) FROM x" for k in ("l_quantity", "l_discount", "l_tax", "price")]
    + [f"SELECT '{a}', '{b}', CAST(round(sum({a} * {b}), 3) AS DOUBLE) FROM x" for n, a in enumerate(("l_quantity", "l_discount", "l_tax", "price")) for b in ("l_quantity", "l_discount", "l_tax", "price")[n:]]
) + ") SELECT i, j, value FROM m")
