"""Fit queries: ridge by moments over lines and contest predictions, stability, placebos, frozen models, sampling designs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernstone.operators import fits as f
from quernstone.operators import models as m
from quernstone.operators import stats as s
from quernstone.plans.durable import durable, join_small
from quernstone.plans.stats_queries import PRED_SQL, RATER_SQL, REPLICATES, predictions, raters
from quernstone.sources.tables import table

PENALTIES = [0.1, 10.0, 1000.0]
LINE_SQL = "li AS (SELECT CAST(year(l_shipdate) AS INT) AS g, l_quantity AS x1, l_discount AS x2, l_tax AS x3, l_extendedprice / 1000 AS y FROM lineitem)"
LINE_MOM = f"{LINE_SQL}, mo AS (SELECT g, {', '.join(f.MOMENTS)} FROM li GROUP BY g)"


def _lines(spark, base):
    return table(spark, base, "lineitem").select(F.year("l_shipdate").alias("g"), F.col("l_quantity").alias("x1"), F.col("l_discount").alias("x2"), F.col("l_tax").alias("x3"), (F.col("l_extendedprice") / 1000).alias("y"))


def moments(df, *keys):
    return durable(df.groupBy(*keys).agg(*map(F.expr, f.MOMENTS)))


def _folds(mo, *keys):
    """Per held-out group: the moments of all other groups, and its own with prefix t_. Differences of sums, so one total per rest of keys."""
    rest = [k for k in keys if k != "g"] or ["one_"]
    mo = mo if "one_" not in rest else mo.withColumn("one_", F.lit(0))
    x = join_small(mo, durable(mo.groupBy(*rest).agg(*[F.sum(c).alias(f"a_{c}") for c in f.NAMES])), rest)
    return x.select(*keys, *[(F.col(f"a_{c}") - F.col(c)).alias(c) for c in f.NAMES], *[F.col(c).alias(f"t_{c}") for c in f.NAMES]).where("n > 0")


def ridge_fit(spark, base):
    w = f.solved(moments(_lines(spark, base)).withColumn("penalty", F.lit(10.0)))
    pairs = F.array(*[F.struct(F.lit(t).alias("term"), F.round(c, 6).alias("weight")) for t, c in (("intercept", F.col("w0")), ("l_quantity", F.col("w1")), ("l_discount", F.col("w2")), ("l_tax", F.col("w3")))])
    return w.select(F.explode(pairs).alias("p")).select("p.term", "p.weight")


def _penalties(df):
    return df.withColumn("penalty", F.explode(F.array(*map(F.lit, PENALTIES))))


def loo_penalty(spark, base):
    """Mean error of each penalty over years left out."""
    w = f.solved(_penalties(_folds(moments(_lines(spark, base), "g"), "g"))).selectExpr("penalty", f"{f.squared_error()} AS mse")
    return w.groupBy("penalty").agg(F.round(F.avg("mse"), 4).alias("mse"), F.count("*").alias("folds"))


def penalty_expanding_window(spark, base):
    """Mean error of each penalty where a year is predicted from all earlier ones, two at least."""
    mo = moments(_lines(spark, base), "g")
    before = Window.partitionBy(F.lit(0)).orderBy("g").rowsBetween(Window.unboundedPreceding, -1)  # one row a year
    x = mo.select("g", F.count("*").over(before).alias("years"), *[F.sum(c).over(before).alias(c) for c in f.NAMES], *[F.col(c).alias(f"t_{c}") for c in f.NAMES]).where("years >= 2")
    w = f.solved(_penalties(x)).selectExpr("penalty", f"{f.squared_error()} AS mse")
    return w.groupBy("penalty").agg(F.round(F.avg("mse"), 4).alias("mse"), F.count("*").alias("folds"))


def _design(spark, base, joint: bool):
    y = F.col("observed") if joint else F.col("observed") - F.col("predicted")
    return predictions(spark, base).select("contest", "party", F.col("election").alias("g"), "observed", "predicted", "size", F.col("predicted").alias("x1"), (100 / F.col("size")).alias("x2"), F.col("party").cast("double").alias("x3"), y.alias("y"))


DESIGN_SQL = "SELECT contest, party, election AS g, observed, predicted, size, predicted AS x1, 100 / size AS x2, CAST(party AS DOUBLE) AS x3, {y} AS y FROM t"
TWO_SQL = f"{PRED_SQL}, de AS (SELECT 'joint' AS approach, * FROM ({DESIGN_SQL.format(y='observed')}) UNION ALL SELECT 'residual', * FROM ({DESIGN_SQL.format(y='observed - predicted')}))"
OUT_SQL = ", ".join(f"a.a_{c} - mo.{c} AS {c}" for c in f.NAMES)
FOLD_SQL = f"{TWO_SQL}, mo AS (SELECT approach, g, {', '.join(f.MOMENTS)} FROM de GROUP BY ALL), al AS (SELECT approach, {', '.join(f'sum({c}) AS a_{c}' for c in f.NAMES)} FROM mo GROUP BY 1), fo AS (SELECT mo.approach, mo.g, 10.0 AS penalty, {OUT_SQL} FROM mo JOIN al a USING (approach)), {f.solved_sql('fo', 'so')}"


def _both(spark, base):
    one, two = _design(spark, base, True).withColumn("approach", F.lit("joint")), _design(spark, base, False).withColumn("approach", F.lit("residual"))
    return durable(one.unionByName(two))


def _fold_weights(spark, base, rows=None):
    rows = rows if rows is not None else _both(spark, base)
    return durable(f.solved(_folds(moments(rows, "approach", "g"), "approach", "g").withColumn("penalty", F.lit(10.0))).select("approach", "g", "w0", "w1", "w2", "w3"))


def fold_fit_predict(spark, base):
    """Each election predicted from the others, by residuals of the prediction and jointly; errors beside the bare prediction's."""
    rows = _both(spark, base)
    x = join_small(rows, _fold_weights(spark, base, rows), ["approach", "g"], "inner")
    fitted = F.col("w0") + F.col("w1") * F.col("x1") + F.col("w2") * F.col("x2") + F.col("w3") * F.col("x3") + F.when(F.col("approach") == "residual", F.col("predicted")).otherwise(0.0)
    return x.groupBy("approach", F.col("g").alias("election")).agg(F.count("*").alias("n"), F.round(F.avg(F.abs(fitted - F.col("observed"))), 5).alias("mae"), F.round(F.avg(F.abs(F.col("predicted") - F.col("observed"))), 5).alias("baseline"))


def coefficients_across_folds(spark, base):
    """Each coefficient over the folds: mean, least, most, and whether its sign holds."""
    w = _fold_weights(spark, base)
    long = w.select("approach", F.explode(F.array(*[F.struct(F.lit(t).alias("term"), F.col(c).alias("w")) for t, c in (("predicted", "w1"), ("equal", "w2"), ("party", "w3"))])).alias("c")).select("approach", "c.term", "c.w")
    return long.groupBy("approach", "term").agg(F.round(F.avg("w"), 6).alias("mean"), F.round(F.min("w"), 6).alias("least"), F.round(F.max("w"), 6).alias("most"), (F.count_distinct(F.signum("w")) == 1).alias("sign_holds"))


def exact_contributions(spark, base):
    """What moves each joint prediction most, as weight times distance from the fold's mean; counts per election."""
    rows = _both(spark, base).where("approach = 'joint'")
    mean = durable(rows.groupBy("g").agg(*[F.avg(c).alias(f"m_{c}") for c in ("x1", "x2", "x3")]))
    x = join_small(join_small(rows, _fold_weights(spark, base).where("approach = 'joint'").drop("approach"), ["g"], "inner"), mean, ["g"])
    part = [F.struct(F.round(F.abs(F.col(f"w{i}") * (F.col(f"x{i}") - F.col(f"m_x{i}"))), 6).alias("v"), F.lit(t).alias("t")) for i, t in ((1, "predicted"), (2, "equal"), (3, "party"))]
    return x.withColumn("top", F.greatest(*part)).groupBy(F.col("g").alias("election"), F.col("top.t").alias("term")).agg(F.count("*").alias("rows"), F.round(F.avg("top.v"), 5).alias("mean"))


CONTRIB_SQL = f"{FOLD_SQL}, mn AS (SELECT g, avg(x1) AS m1, avg(x2) AS m2, avg(x3) AS m3 FROM de WHERE approach = 'joint' GROUP BY g), cx AS (SELECT de.g, round(abs(w1 * (x1 - m1)), 6) AS v1, round(abs(w2 * (x2 - m2)), 6) AS v2, round(abs(w3 * (x3 - m3)), 6) AS v3 FROM de JOIN so ON de.g = so.g AND so.approach = 'joint' JOIN mn ON de.g = mn.g WHERE de.approach = 'joint')"


def leave_one_party_out(spark, base):
    """Coefficients refitted without each party: how far they move, and how many change sign."""
    rows = _design(spark, base, True).withColumn("g", F.col("party"))
    mo = moments(rows, "g")
    out = f.solved(_folds(mo, "g").withColumn("penalty", F.lit(10.0))).select("g", "w1", "w2", "w3")
    full = f.solved(mo.agg(*[F.sum(c).alias(c) for c in f.NAMES]).withColumn("penalty", F.lit(10.0))).select(F.col("w1").alias("f1"), F.col("w2").alias("f2"), F.col("w3").alias("f3"))
    x = durable(out.withColumn("k", F.lit(0))).join(F.broadcast(full.withColumn("k", F.lit(0))), "k")
    flips = sum((F.when(F.signum(f"w{i}") != F.signum(f"f{i}"), 1).otherwise(0) for i in (1, 2, 3)), F.lit(0))
    return x.select(F.col("g").alias("omitted"), *[F.round(f"w{i}", 6).alias(f"w{i}") for i in (1, 2, 3)], F.round(F.greatest(*[F.abs(F.col(f"w{i}") - F.col(f"f{i}")) for i in (1, 2, 3)]), 5).alias("moved"), flips.cast("long").alias("flips"))


LOPO_SQL = f"{PRED_SQL}, de AS ({DESIGN_SQL.format(y='observed')}), mo AS (SELECT party AS g, {', '.join(f.MOMENTS)} FROM de GROUP BY party), a AS (SELECT {', '.join(f'sum({c}) AS a_{c}' for c in f.NAMES)} FROM mo), fo AS (SELECT g, 10.0 AS penalty, {OUT_SQL} FROM mo, a), {f.solved_sql('fo', 'so')}, fu AS (SELECT 10.0 AS penalty, {', '.join(f'a_{c} AS {c}' for c in f.NAMES)} FROM a), {f.solved_sql('fu', 'sf')}"


def partial_pooling(spark, base):
    """Mean residuals of parties drawn to the whole, and of parties within elections drawn to their party, each by its own penalty."""
    p = predictions(spark, base).withColumn("e", F.col("observed") - F.col("predicted"))
    cell = durable(p.groupBy("party", "election").agg(F.count("*").alias("n"), F.sum("e").alias("t")))
    party = cell.groupBy("party").agg(F.sum("n").alias("np"), F.sum("t").alias("tp"))
    whole = cell.agg((F.sum("t") / F.sum("n")).alias("mean")).withColumn("k", F.lit(0))
    x = cell.withColumn("k", F.lit(0)).join(F.broadcast(whole), "k")
    x = join_small(x, durable(party), ["party"], "inner")
    at_party = F.col("mean") + F.col("np") / (F.col("np") + 200.0) * (F.col("tp") / F.col("np") - F.col("mean"))
    x = x.withColumn("pe", at_party)
    return x.select("party", "election", "n", F.round("pe", 6).alias("party_effect"), F.round(F.col("pe") + F.col("n") / (F.col("n") + 50.0) * (F.col("t") / F.col("n") - F.col("pe")), 6).alias("cell_effect"))


def estimability(spark, base):
    """Per party: rows, elections and variation, and the gates that it fails."""
    from quernstone.operators.rules import listed

    g = predictions(spark, base).groupBy("party").agg(F.count("*").alias("rows"), F.count_distinct("election").alias("elections"), F.count_distinct("size").alias("sizes"), F.round(F.stddev_samp("observed"), 5).alias("spread"))
    fails = listed((F.col("rows") < 300, "few_rows"), (F.col("elections") < 4, "few_elections"), (F.col("sizes") < 6, "little_variation"), (F.col("spread") < 15, "small_spread"))
    return g.select("*", F.array_join(fails, ",").alias("fails"), F.when(F.size(fails) == 0, "estimable").when(F.size(fails) == 1, "weak").otherwise("not_estimable").alias("verdict"))


def group_decomposition(spark, base):
    """The error with and without one group, for all rows and for small and large contests apart."""
    e = predictions(spark, base).select(F.when(F.col("size") <= 3, "small").otherwise("large").alias("arm"), (F.col("party") == 3).alias("group"), F.abs(F.col("predicted") - F.col("observed")).alias("e"))
    long = e.select(F.explode(F.array(F.lit("all"), F.col("arm"))).alias("arm"), "group", "e")
    g = long.groupBy("arm").agg(F.count("*").alias("n"), F.avg("e").alias("w"), F.avg(F.when(~F.col("group"), F.col("e"))).alias("o"))
    return g.select("arm", "n", F.round("w", 6).alias("with_group"), F.round("o", 6).alias("without_group"), F.round(F.col("w") - F.col("o"), 6).alias("delta"))


def placebo_arms(spark, base):
    """Columns that could not matter against the one that should: eligible if they vary enough, then fitted alike; the gain in error."""
    d = _design(spark, base, True)
    arms = {"real": F.col("predicted"), "placebo_wide": (F.col("contest") * 7919 % 101).cast("double"), "placebo_thin": (F.col("contest") % 2).cast("double")}
    long = d.withColumn("arm", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), c.alias("x")) for k, c in arms.items()]))).select(F.col("arm.k").alias("arm"), F.col("arm.x").alias("x1"), "x2", "x3", "y")
    long = durable(long)
    values = long.groupBy("arm").agg(F.count_distinct("x1").alias("values"))
    w = f.solved(moments(long, "arm").withColumn("penalty", F.lit(10.0))).selectExpr("arm", "(yy - sy * sy / n) / n AS base", f"{f.squared_error('')} AS mse")
    eligible = F.col("values") >= 5
    return w.join(values, "arm").select("arm", "values", F.when(eligible, "eligible").otherwise("too_few_values").alias("status"), F.when(eligible, F.round(F.col("base") - F.col("mse"), 3)).alias("gain"))


PLACEBO_SQL = f"{PRED_SQL}, d0 AS ({DESIGN_SQL.format(y='observed')}), de AS (SELECT 'real' AS arm, predicted AS x1, x2, x3, y FROM d0 UNION ALL SELECT 'placebo_wide', CAST(contest * 7919 % 101 AS DOUBLE), x2, x3, y FROM d0 UNION ALL SELECT 'placebo_thin', CAST(contest % 2 AS DOUBLE), x2, x3, y FROM d0), va AS (SELECT arm, count(DISTINCT x1) AS values FROM de GROUP BY 1), fo AS (SELECT arm, 10.0 AS penalty, {', '.join(f.MOMENTS)} FROM de GROUP BY 1), {f.solved_sql('fo', 'so')}"


def arm_combination(spark, base):
    """The best arm of every election by its gain at four places; arms that tie are all named."""
    p = predictions(spark, base)
    err = lambda x: F.avg(F.abs(x - F.col("observed")))
    equal = 100 / F.col("size")
    g = p.groupBy("election").agg(err(equal).alias("base"), err(F.col("predicted")).alias("votes"), err((F.col("predicted") + equal) / 2).alias("mean"), err(equal).alias("equal"))
    long = g.select("election", F.explode(F.array(*[F.struct(F.lit(k).alias("arm"), F.round(F.col("base") - F.col(k), 4).alias("gain")) for k in ("votes", "mean", "equal")])).alias("a")).select("election", "a.arm", "a.gain")
    best = long.groupBy("election").agg(F.max("gain").alias("best"))
    return long.join(best, "election").where("gain = best").groupBy("election").agg(F.array_join(F.array_sort(F.collect_set("arm")), "+").alias("arms"), F.max("gain").alias("gain"))


#: A frozen model: party -> intercept and slope on the distance from an equal split; others stay unadjusted.
FROZEN = {0: (0.5, 0.1), 1: (-0.25, 0.2), 2: (0.75, -0.05), 4: (0.0, 0.3)}


def frozen_model(spark, base):
    """Frozen coefficients applied per party, unsupported parties left as they are, clipped at zero and scaled to 100."""
    at = F.col("predicted") - 100 / F.col("size")
    add = F.coalesce(*[F.when(F.col("party") == k, F.lit(a) + F.lit(b) * at) for k, (a, b) in FROZEN.items()], F.lit(0.0))
    x = predictions(spark, base).select("contest", "party", F.greatest(F.lit(0.0), F.col("predicted") + add).alias("v"), F.col("party").isin(list(FROZEN)).alias("supported"))
    w = Window.partitionBy("contest")
    return x.select("contest", "party", "supported", F.round(100 * F.col("v") / F.nullif(F.sum("v").over(w), F.lit(0.0)), 5).alias("adjusted"))


FROZEN_SQL = "CASE party " + " ".join(f"WHEN {k} THEN {a} + {b} * (predicted - 100 / size)" for k, (a, b) in FROZEN.items()) + " ELSE 0.0 END"


def party_bootstrap(spark, base):
    """Per party: 2,000 resamplings of contests; a replicate that draws none of a party's contests says nothing about it."""
    p = predictions(spark, base).withColumn("d", F.abs(100 / F.col("size") - F.col("observed")) - F.abs(F.col("predicted") - F.col("observed")))
    rows = p.where("size >= 6 OR party = 6").select("contest", "party", "d")
    x = s.draws(rows, "contest", REPLICATES).groupBy("party", "replicate").agg(F.sum("times").alias("n"), F.round(F.sum(F.col("times") * F.col("d")), 6).alias("d"))
    return x.groupBy("party").agg(F.count("*").alias("defined"), F.count(F.when(F.col("d") > 0, 1)).alias("wins"), (REPLICATES - F.count("*")).alias("absent"))


def minimal_detectable_effect(spark, base):
    """Per party the effect that its interval could show at 80 percent power, with the range over parties."""
    p = predictions(spark, base).withColumn("e", F.col("observed") - F.col("predicted"))
    g = p.groupBy("party").agg(F.count("*").alias("n"), F.avg("e").alias("m"), (F.stddev_samp("e") / F.sqrt(F.count("*"))).alias("se"))
    lower, upper = F.col("m") - 1.96 * F.col("se"), F.col("m") + 1.96 * F.col("se")
    x = durable(g.select("party", "n", F.round(lower, 6).alias("lower"), F.round(upper, 6).alias("upper"), F.round((upper - lower) / (2 * 1.96) * 2.8, 6).alias("mde")))
    t = x.agg(F.min("mde").alias("least"), F.max("mde").alias("most")).withColumn("k", F.lit(0))
    middle = s.exact_median(x, [], "mde", "median").withColumn("k", F.lit(0))
    return x.withColumn("k", F.lit(0)).join(F.broadcast(t), "k").join(F.broadcast(middle), "k").drop("k").withColumn("median", F.round("median", 6))


def marginal_skew(spark, base):
    """Each rater's largest category share per language, and whether it is too skewed for kappa."""
    long = raters(spark, base).select("lang", F.explode(F.array(*[F.struct(F.lit(k).alias("rater"), F.col(k).alias("c")) for k in ("one", "two")])).alias("r")).select("lang", "r.rater", "r.c")
    n = long.groupBy("lang", "rater", "c").agg(F.count("*").alias("n")).groupBy("lang", "rater").agg(F.max("n").alias("top"), F.sum("n").alias("n"))
    return n.select("lang", "rater", "n", F.round(F.col("top") / F.col("n"), 6).alias("majority"), (F.col("top") >= 0.85 * F.col("n")).alias("skewed"))


def sign_counts(spark, base):
    """Per election: parties whose mean residual is positive, negative or zero, and those that differ in sign from the whole."""
    p = predictions(spark, base).withColumn("e", F.col("observed") - F.col("predicted"))
    cell = p.groupBy("election", "party").agg(F.round(F.avg("e"), 6).alias("m"))
    all_ = p.groupBy("party").agg(F.round(F.avg("e"), 6).alias("whole"))
    x = join_small(cell, durable(all_), ["party"], "inner")
    n = lambda c: F.count(F.when(c, 1))
    return x.groupBy("election").agg(n(F.col("m") > 0).alias("positive"), n(F.col("m") < 0).alias("negative"), n(F.col("m") == 0).alias("zero"), n(F.signum("m") != F.signum("whole")).alias("flips"))


def quota_with_top_up(spark, base):
    """Three per language in hash order, then the best of the rest until the sample has forty."""
    d = table(spark, base, "documents").select("doc_id", "lang")
    quotas = durable(d.groupBy("lang").agg(F.lit(3).alias("quota")))
    first = durable(s.quota_by_hash(d, quotas, "lang", "doc_id").select("doc_id", "lang", F.lit("quota").alias("why")))
    left = 40 - first.count()
    rest = d.join(first.select("doc_id"), "doc_id", "left_anti").orderBy(F.sha2(F.col("doc_id").cast("string"), 256), "doc_id").limit(max(0, left))
    return first.unionByName(rest.withColumn("why", F.lit("top_up")))


#: Draws per stratum, out of proportion on purpose.
DRAWS = {"AUTOMOBILE": 12, "BUILDING": 3, "FURNITURE": 7}


def disproportionate_draws(spark, base):
    cu = table(spark, base, "customer").select("c_custkey", "c_mktsegment")
    quotas = spark.createDataFrame(list(DRAWS.items()), "c_mktsegment string, quota int")
    return s.quota_by_hash(cu, durable(quotas), "c_mktsegment", "c_custkey").select("c_custkey", "c_mktsegment", "place")


def priority_queue(spark, base):
    """The hundred orders to look at first: their segment's rate of partial orders (pooled where few), then total, then key."""
    o = table(spark, base, "orders").join(table(spark, base, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    n, k = F.count("*"), F.count(F.when(F.col("o_orderstatus") == "P", 1))
    rates = durable(o.groupBy("c_nationkey").agg(n.alias("n"), k.alias("k")))
    t = rates.agg(F.sum("k").alias("k"), F.sum("n").alias("n")).first()
    pooled = (t["k"] or 0) / (t["n"] or 1)
    rate = F.round(F.when(F.col("n") >= 20, F.col("k") / F.col("n")).otherwise(F.lit(pooled)), 6)
    x = join_small(o, rates.select("c_nationkey", rate.alias("rate")), ["c_nationkey"])
    return x.select("o_orderkey", "rate", "o_totalprice").orderBy(F.desc("rate"), F.desc("o_totalprice"), "o_orderkey").limit(100)


def distinct_prediction_vectors(spark, base):
    """Models whose predictions agree in every row are one: order-free checksums of their vectors, and the first model of each."""
    p = predictions(spark, base)
    equal = 100 / F.col("size")
    arms = {"votes": F.col("predicted"), "votes_again": F.col("predicted") * 1.0, "mean": (F.col("predicted") + equal) / 2, "equal": equal, "equal_again": 200 / F.col("size") / 2}
    long = p.select("contest", "party", F.explode(F.array(*[F.struct(F.lit(k).alias("model"), F.round(v * 1000).cast("long").alias("v")) for k, v in arms.items()])).alias("a")).select("contest", "party", "a.model", "a.v")
    mix = (F.col("v") + 1) * (F.col("contest") * 7 + F.col("party") + 1) % 1_000_003
    c = long.groupBy("model").agg(F.count("*").alias("rows"), F.sum("v").alias("total"), F.sum(mix * mix % 1_000_003).alias("checksum"))
    return c.groupBy("rows", "total", "checksum").agg(F.min("model").alias("first_model"), F.count("*").alias("models"))


def seat_probabilities(spark, base):
    """Win probabilities shifted so that each contest's sum is its two seats."""
    p = predictions(spark, base).where("size >= 3").withColumn("z", F.col("predicted") / 20)
    return m.calibrate_to_seats(p, ["contest"], "z", F.lit(2.0)).select("contest", "party", F.round("p", 5).alias("p"))


def logistic_fit(spark, base):
    d = table(spark, base, "labels").join(table(spark, base, "documents"), "doc_id").select((F.length("text") / 4000).alias("size"), F.regexp_count("text", F.lit("[!#*]")).alias("marks"), "quality")
    w = m.logistic_newton(d.withColumn("marks", F.log1p("marks")), ["size", "marks"], "quality")
    return spark.createDataFrame([(k, round(v, 5)) for k, v in w.items()], "term string, weight double")


LOGIT_SQL = f"""WITH RECURSIVE d AS (SELECT length(text) / 4000 AS x1, ln(1 + length(regexp_replace(text, '[^!#*]', '', 'g'))) AS x2, quality AS y FROM labels JOIN documents USING (doc_id)),
w(k, b0, b1, b2) AS (SELECT 0, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) UNION ALL SELECT k + 1, b0 + w1, b1 + w2, b2 + w3 FROM (SELECT k, b0, b1, b2, {', '.join(f.WEIGHTS)} FROM (SELECT k, b0, b1, b2,
  sum(p * (1 - p)) + 1e-3 AS c11, sum(p * (1 - p) * x1) AS c12, sum(p * (1 - p) * x2) AS c13, sum(p * (1 - p) * x1 * x1) + 1e-3 AS c22, sum(p * (1 - p) * x1 * x2) AS c23, sum(p * (1 - p) * x2 * x2) + 1e-3 AS c33,
  sum(y - p) - 1e-3 * b0 AS d1, sum((y - p) * x1) - 1e-3 * b1 AS d2, sum((y - p) * x2) - 1e-3 * b2 AS d3 FROM (SELECT w.*, x1, x2, y, 1 / (1 + exp(-(b0 + b1 * x1 + b2 * x2))) AS p FROM w, d WHERE k < 12) GROUP BY k, b0, b1, b2)))
SELECT unnest(['1', 'size', 'marks']) AS term, round(unnest([b0, b1, b2]), 5) AS weight FROM w WHERE k = 12"""
PAIR = lambda x: ", ".join(x)
QUERIES = {
    "ridge_fit": (ridge_fit, f"WITH {LINE_SQL}, mo AS (SELECT 10.0 AS penalty, {PAIR(f.MOMENTS)} FROM li), {f.solved_sql('mo', 'so')} SELECT unnest(['intercept', 'l_quantity', 'l_discount', 'l_tax']) AS term, round(unnest([w0, w1, w2, w3]), 6) AS weight FROM so"),
    "loo_penalty": (loo_penalty, f"WITH {LINE_MOM}, a AS (SELECT {PAIR(f'sum({c}) AS a_{c}' for c in f.NAMES)} FROM mo), fo AS (SELECT g, {OUT_SQL}, {PAIR(f'mo.{c} AS t_{c}' for c in f.NAMES)}, penalty FROM mo, a, (SELECT CAST(unnest({PENALTIES}) AS DOUBLE) AS penalty)), {f.solved_sql('fo', 'so')} SELECT penalty, round(avg({f.squared_error()}), 4) AS mse, count(*) AS folds FROM so GROUP BY 1"),
    "penalty_expanding_window": (penalty_expanding_window, f"WITH {LINE_MOM}, ex AS (SELECT g, count(*) OVER w AS years, {PAIR(f'sum({c}) OVER w AS {c}' for c in f.NAMES)}, {PAIR(f'{c} AS t_{c}' for c in f.NAMES)} FROM mo WINDOW w AS (ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), fo AS (SELECT * FROM ex, (SELECT CAST(unnest({PENALTIES}) AS DOUBLE) AS penalty) WHERE years >= 2), {f.solved_sql('fo', 'so')} SELECT penalty, round(avg({f.squared_error()}), 4) AS mse, count(*) AS folds FROM so GROUP BY 1"),
    "fold_fit_predict": (fold_fit_predict, f"WITH {FOLD_SQL} SELECT approach, g AS election, count(*) AS n, round(avg(abs(w0 + w1 * x1 + w2 * x2 + w3 * x3 + CASE WHEN approach = 'residual' THEN predicted ELSE 0.0 END - observed)), 5) AS mae, round(avg(abs(predicted - observed)), 5) AS baseline FROM de JOIN so USING (approach, g) GROUP BY ALL"),
    "coefficients_across_folds": (coefficients_across_folds, f"WITH {FOLD_SQL}, lg AS (SELECT approach, unnest(['predicted', 'equal', 'party']) AS term, unnest([w1, w2, w3]) AS w FROM so) SELECT approach, term, round(avg(w), 6) AS mean, round(min(w), 6) AS least, round(max(w), 6) AS most, count(DISTINCT sign(w)) = 1 AS sign_holds FROM lg GROUP BY ALL"),
    "exact_contributions": (exact_contributions, f"WITH {CONTRIB_SQL}, tp AS (SELECT g, greatest(v1, v2, v3) AS v, CASE WHEN v1 = greatest(v1, v2, v3) THEN 'predicted' WHEN v3 = greatest(v1, v2, v3) THEN 'party' ELSE 'equal' END AS term FROM cx) SELECT g AS election, term, count(*) AS rows, round(avg(v), 5) AS mean FROM tp GROUP BY ALL"),
    "leave_one_party_out": (leave_one_party_out, f"WITH {LOPO_SQL} SELECT so.g AS omitted, round(so.w1, 6) AS w1, round(so.w2, 6) AS w2, round(so.w3, 6) AS w3, round(greatest(abs(so.w1 - sf.w1), abs(so.w2 - sf.w2), abs(so.w3 - sf.w3)), 5) AS moved, CAST((sign(so.w1) <> sign(sf.w1))::INT + (sign(so.w2) <> sign(sf.w2))::INT + (sign(so.w3) <> sign(sf.w3))::INT AS BIGINT) AS flips FROM so, sf"),
    "partial_pooling": (partial_pooling, f"WITH {PRED_SQL}, c AS (SELECT party, election, count(*) AS n, sum(observed - predicted) AS t FROM t GROUP BY ALL), p AS (SELECT party, sum(n) AS np, sum(t) AS tp FROM c GROUP BY 1), w AS (SELECT sum(t) / sum(n) AS mean FROM c), x AS (SELECT c.*, mean + np / (np + 200.0) * (tp / np - mean) AS pe FROM c JOIN p USING (party), w) SELECT party, election, n, round(pe, 6) AS party_effect, round(pe + n / (n + 50.0) * (t / n - pe), 6) AS cell_effect FROM x"),
    "estimability": (estimability, f"WITH {PRED_SQL}, g AS (SELECT party, count(*) AS rows, count(DISTINCT election) AS elections, count(DISTINCT size) AS sizes, round(stddev_samp(observed), 5) AS spread FROM t GROUP BY 1), e AS (SELECT *, list_filter([CASE WHEN rows < 300 THEN 'few_rows' END, CASE WHEN elections < 4 THEN 'few_elections' END, CASE WHEN sizes < 6 THEN 'little_variation' END, CASE WHEN spread < 15 THEN 'small_spread' END], lambda x: x IS NOT NULL) AS e FROM g) SELECT * EXCLUDE (e), array_to_string(e, ',') AS fails, CASE WHEN len(e) = 0 THEN 'estimable' WHEN len(e) = 1 THEN 'weak' ELSE 'not_estimable' END AS verdict FROM e"),
    "group_decomposition": (group_decomposition, f"WITH {PRED_SQL}, e AS (SELECT CASE WHEN size <= 3 THEN 'small' ELSE 'large' END AS arm, party = 3 AS grp, abs(predicted - observed) AS e FROM t), l AS (SELECT 'all' AS arm, grp, e FROM e UNION ALL SELECT * FROM e) SELECT arm, count(*) AS n, round(avg(e), 6) AS with_group, round(avg(e) FILTER (NOT grp), 6) AS without_group, round(avg(e) - avg(e) FILTER (NOT grp), 6) AS delta FROM l GROUP BY arm"),
    "placebo_arms": (placebo_arms, f"WITH {PLACEBO_SQL} SELECT arm, values, CASE WHEN values >= 5 THEN 'eligible' ELSE 'too_few_values' END AS status, CASE WHEN values >= 5 THEN round((yy - sy * sy / n) / n - {f.squared_error('')}, 3) END AS gain FROM so JOIN va USING (arm)"),
    "arm_combination": (arm_combination, f"WITH {PRED_SQL}, g AS (SELECT election, avg(abs(100 / size - observed)) AS b, avg(abs(predicted - observed)) AS v, avg(abs((predicted + 100 / size) / 2 - observed)) AS m FROM t GROUP BY 1), l AS (SELECT election, unnest(['votes', 'mean', 'equal']) AS arm, round(unnest([b - v, b - m, 0.0]), 4) AS gain FROM g), k AS (SELECT *, max(gain) OVER (PARTITION BY election) AS best FROM l) SELECT election, array_to_string(list_sort(list(arm)), '+') AS arms, max(gain) AS gain FROM k WHERE gain = best GROUP BY election"),
    "frozen_model": (frozen_model, f"WITH {PRED_SQL}, v AS (SELECT contest, party, party IN ({PAIR(map(str, FROZEN))}) AS supported, greatest(0.0, predicted + {FROZEN_SQL}) AS v FROM t) SELECT contest, party, supported, round(100 * v / nullif(sum(v) OVER (PARTITION BY contest), 0), 5) AS adjusted FROM v"),
    "party_bootstrap": (party_bootstrap, f"WITH {PRED_SQL}, k AS (SELECT contest, party, abs(100 / size - observed) - abs(predicted - observed) AS d FROM t WHERE size >= 6 OR party = 6), {s.draws_sql('k', 'contest', REPLICATES, 'party, d')}, x AS (SELECT party, replicate, round(sum(times * d), 6) AS d FROM dr GROUP BY ALL) SELECT party, count(*) AS defined, count(*) FILTER (d > 0) AS wins, {REPLICATES} - count(*) AS absent FROM x GROUP BY party"),
    "minimal_detectable_effect": (minimal_detectable_effect, f"WITH {PRED_SQL}, g AS (SELECT party, count(*) AS n, avg(observed - predicted) AS m, stddev_samp(observed - predicted) / sqrt(count(*)) AS se FROM t GROUP BY 1), x AS (SELECT party, n, round(m - 1.96 * se, 6) AS lower, round(m + 1.96 * se, 6) AS upper, round(((m + 1.96 * se) - (m - 1.96 * se)) / (2 * 1.96) * 2.8, 6) AS mde FROM g) SELECT *, min(mde) OVER () AS least, max(mde) OVER () AS most, round(median(mde) OVER (), 6) AS median FROM x"),
    "marginal_skew": (marginal_skew, f"WITH {RATER_SQL}, l AS (SELECT lang, 'one' AS rater, one AS c FROM r UNION ALL SELECT lang, 'two', two FROM r), n AS (SELECT lang, rater, c, count(*) AS n FROM l GROUP BY ALL) SELECT lang, rater, CAST(sum(n) AS BIGINT) AS n, round(max(n) / sum(n), 6) AS majority, max(n) >= 0.85 * sum(n) AS skewed FROM n GROUP BY ALL"),
    "sign_counts": (sign_counts, f"WITH {PRED_SQL}, c AS (SELECT election, party, round(avg(observed - predicted), 6) AS m FROM t GROUP BY ALL), a AS (SELECT party, round(avg(observed - predicted), 6) AS w FROM t GROUP BY 1) SELECT election, count(*) FILTER (m > 0) AS positive, count(*) FILTER (m < 0) AS negative, count(*) FILTER (m = 0) AS zero, count(*) FILTER (sign(m) <> sign(w)) AS flips FROM c JOIN a USING (party) GROUP BY election"),
    "quota_with_top_up": (quota_with_top_up, "WITH k AS (SELECT doc_id, lang, sha256(CAST(doc_id AS VARCHAR)) AS h FROM documents), q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY h, doc_id) AS p FROM k), r AS (SELECT *, row_number() OVER (ORDER BY h, doc_id) AS o FROM q WHERE p > 3) SELECT doc_id, lang, 'quota' AS why FROM q WHERE p <= 3 UNION ALL SELECT doc_id, lang, 'top_up' FROM r WHERE o <= 40 - (SELECT count(*) FROM q WHERE p <= 3)"),
    "disproportionate_draws": (disproportionate_draws, f"WITH q(c_mktsegment, quota) AS (VALUES {PAIR(map(str, DRAWS.items()))}), k AS (SELECT c_custkey, c_mktsegment, quota, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256(CAST(c_custkey AS VARCHAR)), c_custkey) AS place FROM customer JOIN q USING (c_mktsegment)) SELECT c_custkey, c_mktsegment, place FROM k WHERE place <= quota"),
    "priority_queue": (priority_queue, "WITH o AS (SELECT *, o_orderstatus = 'P' AS p FROM orders JOIN customer ON o_custkey = c_custkey), r AS (SELECT c_nationkey, count(*) AS n, count(*) FILTER (p) AS k FROM o GROUP BY 1), t AS (SELECT sum(k) / sum(n) AS pooled FROM r) SELECT o_orderkey, round(CASE WHEN n >= 20 THEN k / n ELSE pooled END, 6) AS rate, o_totalprice FROM o JOIN r USING (c_nationkey), t ORDER BY rate DESC, o_totalprice DESC, o_orderkey LIMIT 100"),
    "distinct_prediction_vectors": (distinct_prediction_vectors, f"WITH {PRED_SQL}, l AS (SELECT contest, party, unnest(['votes', 'votes_again', 'mean', 'equal', 'equal_again']) AS model, CAST(round(1000 * unnest([predicted, predicted, (predicted + 100 / size) / 2, 100 / size, 100 / size])) AS BIGINT) AS v FROM t), x AS (SELECT *, (v + 1) * (contest * 7 + party + 1) % 1000003 AS mx FROM l), c AS (SELECT model, count(*) AS rows, CAST(sum(v) AS BIGINT) AS total, CAST(sum(mx * mx % 1000003) AS BIGINT) AS checksum FROM x GROUP BY 1) SELECT rows, total, checksum, min(model) AS first_model, count(*) AS models FROM c GROUP BY ALL"),
    "logistic_fit": (logistic_fit, LOGIT_SQL),
    "seat_probabilities": (seat_probabilities, f"WITH RECURSIVE {PRED_SQL}, z AS (SELECT contest, party, predicted / 20 AS z FROM t WHERE size >= 3), b(k, contest, lo, hi) AS (SELECT 0, contest, CAST(-30 AS DOUBLE), CAST(30 AS DOUBLE) FROM z GROUP BY contest UNION ALL SELECT k + 1, contest, CASE WHEN s < 2 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN s < 2 THEN hi ELSE (lo + hi) / 2 END FROM (SELECT k, b.contest, lo, hi, sum(1 / (1 + exp(-(z + (lo + hi) / 2)))) AS s FROM b JOIN z ON b.contest = z.contest WHERE k < 50 GROUP BY k, b.contest, lo, hi)) SELECT z.contest, party, round(1 / (1 + exp(-(z + (lo + hi) / 2))), 5) AS p FROM z JOIN b ON z.contest = b.contest AND k = 50"),
}
