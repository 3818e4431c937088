"""Audit and evidence queries: leakage, keys, seats, dates, positions, reviews and diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernstone.operators import audits as a
from quernstone.operators import dictionary
from quernstone.operators import rules as r
from quernstone.plans.contest_queries import ALLOCATED_SQL, VOTES_SQL, allocated, votes
from quernstone.plans.durable import dealt, durable, join_small
from quernstone.plans.rule_queries import BOUNDARY, FACT_SQL, facts
from quernstone.plans.stats_queries import PRED_SQL, predictions
from quernstone.sources.tables import table

SPLIT = "CASE WHEN day < DATE '1996-01-01' THEN 'train' WHEN day < DATE '1997-06-01' THEN 'test' ELSE 'unused' END"


def with_split(df):
    return df.withColumn("split", F.when(F.col("day") < F.lit("1996-01-01").cast("date"), "train").when(F.col("day") < F.lit("1997-06-01").cast("date"), "test").otherwise("unused"))


def leakage_audit(spark, base):
    """Six groups of checks over layers: splits by date, features before outcomes, history before events, keys, sets, columns."""
    x = with_split(facts(spark, base))
    before = Window.partitionBy("cust").orderBy("day", "id")
    h = x.withColumn("previous_day", F.lag("day").over(before))
    columns = spark.createDataFrame([(c,) for c in x.columns], "name string")
    groups = {
        "split": a.count_gates(x, "split", {"train_after_boundary": (F.col("split") == "train") & (F.col("day") >= F.lit("1996-01-01").cast("date")), "test_before_train": (F.col("split") == "test") & (F.col("day") < F.lit("1996-01-01").cast("date"))}),
        "features": a.count_gates(x, "features", {"shipped_before_order": F.col("first_ship") < F.col("day"), "ships_after_boundary_in_train": (F.col("split") == "train") & (F.col("last_ship") >= F.lit(BOUNDARY).cast("date"))}),
        "history": a.count_gates(h, "history", {"previous_not_earlier": F.col("previous_day") > F.col("day")}),
        "keys": a.key_gates(x, "keys", "id"),
        "sets": a.set_gates(x.where("lines > 0").select("id"), table(spark, base, "lineitem").select(F.col("l_orderkey").alias("id")), "sets", "id"),
        "columns": a.count_gates(columns, "columns", {"outcome_named": F.col("name").rlike("outcome|target|elected")}),
    }
    return a.union(*groups.values())


def reference_integrity(spark, base):
    """Keys, equal sets and references of duplicate clusters: dangling, to itself, or circular."""
    d = table(spark, base, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    first = d.groupBy("h").agg(F.min("doc_id").alias("first"))
    refs = d.join(first, "h").where("first <> doc_id").select("doc_id", "first")
    return a.union(
        a.key_gates(d, "documents", "doc_id"), a.set_gates(table(spark, base, "labels"), d, "labels", "doc_id"), a.reference_gates(refs, "clusters", "doc_id", "first", d, "doc_id"),
    )


def reference_rings(spark, base):
    """Every supplier refers to the one that shares most orders with it: which of these references lead back to where they start."""
    li = table(spark, base, "lineitem").select("l_orderkey", "l_suppkey")
    rows = li.count()
    li = dealt(li, rows, "l_orderkey").distinct()
    both = li.join(li.select("l_orderkey", F.col("l_suppkey").alias("other")), "l_orderkey").where("l_suppkey <> other")
    # an order has some lines, so there are several pairs for each line
    both = dealt(both, 4 * rows, "l_suppkey", "other").groupBy("l_suppkey", "other").agg(F.count("*").alias("n"))
    top = dealt(both, 4 * rows, "l_suppkey").groupBy("l_suppkey").agg(F.min_by("other", F.struct(-F.col("n"), F.col("other"))).alias("partner"))
    return a.circular(top, "l_suppkey", "partner").withColumnRenamed("to", "partner")


def dictionary_evidence(spark, base):
    """Documents that hold the first four words of a benchmark item, with the sentences in which they begin, by digest."""
    item = table(spark, base, "benchmark").select("item_id", F.array_join(F.slice(dictionary.words(F.col("text")), 1, 4), " ").alias("alias"))
    found = dictionary.matches(table(spark, base, "documents"), "doc_id", "text", item, "item_id", "alias")
    return found.select("doc_id", F.col("entity").alias("item_id"), "alias", "sentence_no", "word", F.sha2("sentence", 256).alias("sentence_sha256"))


def seat_date_validation(spark, base):
    """Contests whose seats or dates do not hold together, by reason, with the smallest offender."""
    x = allocated(spark, base).groupBy("contest").agg(F.count("*").alias("entries"), F.count(F.when(F.col("observed"), 1)).alias("elected"))
    seats = F.when(F.col("contest") % 11 == 0, None).otherwise(1 + F.col("contest") % 3)
    y = x.join(facts(spark, base).select(F.col("id").alias("contest"), "day", "first_ship"), "contest", "left").withColumn("seats", seats)
    checks = r.listed(
        (F.col("seats").isNull(), "seats_unknown"), (F.col("seats") >= F.col("entries"), "uncontested"), (F.col("elected") != F.least("seats", "entries"), "elected_differs_from_seats"),
        (F.col("day").isNull(), "date_missing"), (F.col("first_ship") < F.col("day"), "date_order"), (F.dayofweek("day").isin(1, 7), "weekend"),
    )
    return y.select("contest", F.explode(checks).alias("reason")).groupBy("reason").agg(F.count("*").alias("contests"), F.min("contest").alias("first_offender"))


def ward_assertions(spark, base):
    """Assertions over contests that must never break: ranges, sums, conflicts."""
    w = Window.partitionBy("contest")
    x = votes(spark, base).withColumn("share", 100 * F.col("votes") / F.sum("votes").over(w)).withColumn("whole", F.sum("votes").over(w))
    per = x.groupBy("contest").agg(F.sum("share").alias("sum_share"))
    return a.union(
        a.count_gates(x, "wards", {"negative_votes": F.col("votes") < 0, "share_out_of_range": ~F.col("share").between(0, 100), "votes_above_whole": F.col("votes") > F.col("whole"), "strength_below_votes": F.col("strength") < F.col("votes")}),
        a.count_gates(per, "contests", {"shares_do_not_sum": F.abs(F.col("sum_share") - 100) > 1e-6}),
    )


def span_rates(spark, base):
    """Per language: how many labelled documents show the span that they claim, and whether the rate passes its threshold."""
    d = table(spark, base, "labels").join(table(spark, base, "documents"), "doc_id").where("toxic = 1")
    hit = F.lower("text").rlike("idiot|moron|clown|loser|trash|stupid|pathetic|disgusting").cast("int")
    empty = (F.length(F.trim(F.coalesce("text", F.lit("")))) < 40).cast("int")
    g = d.groupBy("lang").agg(F.count("*").alias("records"), F.round(F.avg(hit), 6).alias("verified"), F.round(F.avg(empty), 6).alias("empty"))
    return g.withColumn("passes", (F.col("verified") >= 0.5) & (F.col("empty") <= 0.1))


def chronology_ledger(spark, base):
    """All dated facts of every customer in one ledger with their place in it."""
    x = facts(spark, base)
    kinds = {"ordered": "day", "first_shipped": "first_ship", "last_shipped": "last_ship"}
    long = x.select("cust", "id", F.explode(F.array(*[F.struct(F.lit(k).alias("event"), F.col(c).alias("on")) for k, c in kinds.items()])).alias("e")).select("cust", "id", "e.event", "e.on").where("`on` IS NOT NULL")
    w = Window.partitionBy("cust").orderBy("on", "id", "event")
    return long.select("cust", "id", "event", F.col("on").cast("string").alias("on"), F.row_number().over(w).cast("long").alias("place"))


def official_reconciliation(spark, base):
    """A stated total per customer and year against the sum of lines: compared on the sample of keys both have."""
    x = facts(spark, base).withColumn("year", F.year("day"))
    one = x.groupBy("cust", "year").agg(F.round(F.sum("total"), 2).alias("stated"))
    lines = table(spark, base, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.sum("l_extendedprice").alias("v"))
    two = x.where("status <> 'P'").join(lines, "id").groupBy("cust", "year").agg(F.round(F.sum("v"), 2).alias("official"))
    y = one.join(two, ["cust", "year"], "full")
    status = F.when(F.col("official").isNull(), "no_official").when(F.col("stated").isNull(), "no_stated").when(F.abs(F.col("stated") - F.col("official")) <= 1, "equal").when(F.col("stated") > F.col("official"), "stated_higher").otherwise("official_higher")
    return y.groupBy("year", status.alias("status")).agg(F.count("*").alias("records"), F.round(F.sum("stated"), 2).alias("stated"))


def rank_elected_consistency(spark, base):
    """Contests in which somebody elected ranks behind somebody who is not, for the prediction's seats against observed votes."""
    w = Window.partitionBy("contest").orderBy(F.desc("votes"))
    x = allocated(spark, base).withColumn("rank", F.rank().over(w))
    g = x.groupBy("contest").agg(F.max(F.when(F.col("predicted"), F.col("rank"))).alias("last_elected"), F.min(F.when(~F.col("predicted"), F.col("rank"))).alias("first_lost"))
    state = F.when(F.col("last_elected").isNull(), "nobody_elected").when(F.col("first_lost").isNull(), "all_elected").when(F.col("last_elected") <= F.col("first_lost"), "consistent").otherwise("inconsistent")
    return g.groupBy(state.alias("state")).agg(F.count("*").alias("contests"))


def snippet_candidates(spark, base):
    """Candidate rows written as comma lines, pipe lines, pipe lines without a header, and running text; parsed back."""
    x = votes(spark, base).select("contest", "party", F.col("votes").cast("long").alias("votes")).withColumn("form", F.col("contest") % 4)
    name = F.concat(F.lit("Party "), F.col("party").cast("string"))
    line = (
        F.when(F.col("form") == 0, F.concat_ws(", ", name, F.col("votes").cast("string"))).when(F.col("form").isin(1, 2), F.concat(F.lit("| "), F.concat_ws(" | ", name, F.col("votes").cast("string")), F.lit(" |")))
        .otherwise(F.concat(name, F.lit(" received "), F.format_number("votes", 0), F.lit(" votes")))
    )
    text = F.array_join(F.array_sort(F.collect_list("line")), "\n")
    snippets = x.withColumn("line", line).groupBy("contest", "form").agg(text.alias("t"))
    snippets = snippets.withColumn("t", F.when(F.col("form") == 1, F.concat(F.lit("| Party | Votes |\n|---|---|\n"), F.col("t"))).otherwise(F.col("t")))
    each = snippets.select("contest", F.explode(F.split("t", "\n")).alias("l")).where(~F.col("l").rlike(r"^\|[ -]*(Party \| Votes|---)"))
    cells = F.filter(F.transform(F.split("l", r"\||, "), lambda c: F.trim(c)), lambda c: c != "")
    said = F.col("l").rlike(" received ")
    party = F.when(said, F.regexp_extract("l", "^(.*) received", 1)).otherwise(F.get(cells, F.lit(0)))
    count = F.when(said, F.regexp_replace(F.regexp_extract("l", "received ([0-9,]+) votes", 1), ",", "")).otherwise(F.get(cells, F.lit(1)))
    return each.select("contest", party.alias("party"), count.try_cast("long").alias("votes"))


def field_resolution(spark, base):
    """Each order's ship flag from its lines as evidence: one value, a conflict, or missing."""
    g = table(spark, base, "lineitem").groupBy("l_orderkey").agg(F.count_distinct("l_returnflag").alias("kinds"), F.max("l_returnflag").alias("value"))
    x = table(spark, base, "orders").join(g, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    how = F.when(F.col("kinds").isNull(), "missing").when(F.col("kinds") == 1, "resolved").otherwise("conflict")
    return x.select("o_orderkey", F.when(how == "resolved", F.col("value")).alias("value"), how.alias("how"))


def completeness_gate(spark, base):
    """Whether a contest's indexed evidence is complete, or must be searched again: votes, seats and a winner known."""
    x = allocated(spark, base).groupBy("contest").agg(F.count("*").alias("entries"), F.count(F.when(F.col("observed"), 1)).alias("winners"), F.sum("votes").alias("votes"))
    missing = r.listed((F.col("entries") < 2, "entries"), (F.col("winners") == 0, "winner"), (F.col("votes") < 20, "votes"))
    return x.groupBy(F.array_join(missing, ",").alias("missing"), F.when(F.size(missing) == 0, "accept").otherwise("search_again").alias("route")).agg(F.count("*").alias("contests"))


def repeated_names(spark, base):
    """Part names that stand for several parts: a review queue of groups, with how many brands they span."""
    g = table(spark, base, "part").groupBy("p_name").agg(F.count("*").alias("parts"), F.count_distinct("p_brand").alias("brands"), F.min("p_partkey").alias("first"), F.max("p_partkey").alias("last"))
    return g.where("parts > 1")


def continuity_evidence(spark, base):
    """Claims that a customer continues from one year to the next, validated against the years that it has."""
    y = table(spark, base, "orders").select(F.col("o_custkey").alias("cust"), F.year("o_orderdate").alias("year")).distinct()
    claims = y.select("cust", F.col("year").alias("since"), (F.col("year") + 1).alias("until"))
    found = claims.join(y.withColumnRenamed("year", "until").withColumn("seen", F.lit(True)), ["cust", "until"], "left")
    status = F.when(F.col("until") > 1998, "outside_permitted_years").when(F.col("seen"), "confirmed").otherwise("broken")
    return found.groupBy("since", status.alias("status")).agg(F.count("*").alias("customers"))


def mapping_review(spark, base):
    """Old and new areas by overlap: one to one, split, merge or many to many, and how the pair's overlap stands."""
    p = table(spark, base, "customer").groupBy(F.col("c_nationkey").alias("old"), F.length("c_mktsegment").alias("new")).agg(F.count("*").alias("n"))
    o = p.groupBy("old").agg(F.count("*").alias("outs"), F.sum("n").alias("whole"))
    i = p.groupBy("new").agg(F.count("*").alias("ins"))
    x = join_small(join_small(p, durable(o), ["old"]), durable(i), ["new"])
    kind = F.when((F.col("outs") == 1) & (F.col("ins") == 1), "one_to_one").when(F.col("ins") == 1, "split").when(F.col("outs") == 1, "merge").otherwise("many_to_many")
    share = F.round(100 * F.col("n") / F.col("whole"), 4)
    return x.select("old", "new", share.alias("percent"), kind.alias("kind"), F.when(share >= 50, "direct").when(share >= 20, "partial").otherwise("blocked").alias("resolution"))


def baseline_features(spark, base):
    """What is known of a customer before each order: earlier orders, their mean, the last one's age, first-timer or not."""
    x = facts(spark, base).groupBy("cust", "day").agg(F.count("*").alias("n"), F.sum("total").alias("t"))
    w = Window.partitionBy("cust").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    b = x.select("cust", "day", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("earlier"), (F.sum("t").over(w) / F.sum("n").over(w)).alias("mean"), F.max("day").over(w).alias("last"))
    status = F.when(F.col("earlier") == 0, "no_history").when(F.datediff("day", "last") > 730, "stale").otherwise("usable")
    return b.select("cust", F.col("day").cast("string").alias("day"), "earlier", F.round("mean", 4).alias("mean"), F.datediff("day", "last").cast("long").alias("age"), status.alias("status"))


def by_reference_eligibility(spark, base):
    """Partial orders and the last finished order of their customer that may serve as a reference."""
    x = facts(spark, base)
    ref = x.where("status = 'F'").groupBy("cust").agg(F.max("day").alias("ref_day"), F.count("*").alias("refs"))
    y = x.where("status = 'P'").join(ref, "cust", "left")
    status = F.when(F.col("refs").isNull(), "no_reference").when(F.col("ref_day") >= F.col("day"), "reference_not_earlier").when(F.datediff("day", "ref_day") > 1461, "reference_too_old").otherwise("eligible")
    return y.select("id", status.alias("status"))


def supplementary_evidence(spark, base):
    """Stated against supplementary line counts by customer: accepted, contradicted, or on one side only."""
    one = table(spark, base, "orders").where("o_orderstatus <> 'P'").groupBy(F.col("o_custkey").alias("cust")).agg(F.count("*").alias("orders"))
    two = facts(spark, base).where("lines > 0").groupBy("cust").agg(F.count("*").alias("with_lines"))
    y = one.join(two, "cust", "full")
    status = F.when(F.col("orders").isNull(), "supplementary_only").when(F.col("with_lines").isNull(), "unresolved").when(F.col("orders") == F.col("with_lines"), "accepted").otherwise("contradicted")
    return y.groupBy(status.alias("status")).agg(F.count("*").alias("customers"))


def caption_typing(spark, base):
    """Orders of one customer and day: the first is scheduled, further ones are by-events with a corrected caption."""
    w = Window.partitionBy("cust", "day").orderBy("id")
    x = facts(spark, base).withColumn("k", F.row_number().over(w))
    kind = F.when(F.col("k") == 1, "scheduled").otherwise("by_event")
    caption = F.concat_ws(" ", F.col("day").cast("string"), kind, F.when(F.col("k") > 1, F.concat(F.lit("("), F.col("k").cast("string"), F.lit(")"))))
    return x.select("id", kind.alias("kind"), caption.alias("caption"))


def label_disagreements(spark, base):
    """A reader's label against a rule's, typed: same, both unsure, one unsure, opposite."""
    d = table(spark, base, "labels").join(table(spark, base, "documents"), "doc_id")
    human = F.when(F.col("quality") == 1, "good").otherwise("bad")
    n = F.length(F.coalesce("text", F.lit("")))
    rule = F.when(n < 80, "bad").when(F.col("text").rlike("[!#*]{2}"), "bad").when(n < 400, "unclear").otherwise("good")
    kind = F.when(human == rule, "same").when(rule == "unclear", "rule_unsure").otherwise(F.concat(human, F.lit("_but_"), rule))
    return d.groupBy("lang", kind.alias("kind")).agg(F.count("*").alias("records"))


#: Places that texts are searched for.
PLACES = ["the", "was", "der", "los"]


def place_sentences(spark, base):
    """Sentences that name a place as a whole word, counted per document and place."""
    s = F.split(F.coalesce("text", F.lit("")), r"(?<=[.!?])\s+")

    def naming(p):
        return F.size(F.filter(s, lambda x: x.rlike(rf"(?i)(^|[^a-z]){p}([^a-z]|$)"))).cast("long")

    per = [F.struct(F.lit(p).alias("place"), naming(p).alias("n")) for p in PLACES]
    x = table(spark, base, "documents").select("doc_id", F.explode(F.array(*per)).alias("p")).select("doc_id", "p.place", F.col("p.n").alias("sentences"))
    return x.where("sentences > 0")


def context_cards(spark, base):
    """One nested record per labelled document: its facts, labels and errors, checked, and flattened to a hash."""
    d = table(spark, base, "labels").join(table(spark, base, "documents"), "doc_id", "left")
    card = F.struct("doc_id", F.struct("lang", "source", F.length("text").alias("chars")).alias("meta"), F.struct("quality", "toxic").alias("labels"))
    x = d.select("doc_id", card.alias("card"))
    errors = r.listed((F.col("card.meta.lang").isNull(), "no_meta"), (F.col("card.labels.quality").isNull(), "no_label"), (F.col("card.meta.chars") < 20, "tiny"))
    parts = ["doc_id", "meta.lang", "meta.source", "meta.chars", "labels.quality", "labels.toxic"]
    flat = F.concat_ws("|", *[F.coalesce(F.col(f"card.{p}").cast("string"), F.lit("")) for p in parts])
    return x.select("doc_id", F.sha2(flat, 256).alias("card_sha256"), F.array_join(errors, ",").alias("errors"))


def attribution_rate(spark, base):
    """Per source: documents that name at least one of the places, and the rate."""
    named = F.lower("text").rlike("(^|[^a-z])(" + "|".join(PLACES) + ")([^a-z]|$)")
    return table(spark, base, "documents").groupBy("source").agg(F.count("*").alias("documents"), F.count(F.when(named, 1)).alias("named"), F.round(F.count(F.when(named, 1)) / F.count("*"), 6).alias("rate"))


def corpus_by_window(spark, base):
    """Report table: events by look-back band and kind with their share of the whole."""
    lag = F.datediff(F.lit("2024-02-01").cast("date"), F.to_date("ts"))
    band = F.when(lag.between(1, 7), "1-7").when(lag.between(8, 14), "8-14").when(lag.between(15, 30), "15-30").otherwise("other")
    g = durable(table(spark, base, "events").groupBy(band.alias("band"), "event_type").agg(F.count("*").alias("events")))
    total = g.agg(F.sum("events")).first()[0] or 0
    return g.withColumn("percent", F.round(100 * F.col("events") / F.lit(total), 4))


def collection_diagnostics(spark, base):
    """Documents by language, source and size class, with how many texts are distinct."""
    n = F.length(F.coalesce("text", F.lit("")))
    size = F.when(n == 0, "empty").when(n < 400, "short").when(n < 4000, "middle").otherwise("long")
    return table(spark, base, "documents").groupBy("lang", size.alias("size")).agg(F.count("*").alias("documents"), F.count_distinct(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("texts"), F.count_distinct("source").alias("sources"))


def channel_classes(spark, base):
    """Pages by channel from their URL and heading."""
    u, t = F.lower(F.coalesce("url", F.lit(""))), F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), r"(?s)<title>([^<]*)</title>", 1))
    kind = F.when(u == "", "none").when(u.rlike(r"[?&]ref="), "referral").when(u.rlike(r"^https?://(m|amp)\."), "mobile").when(t.rlike(r"[#*$%&|<>]{3}"), "junk_heading").when(u.rlike(r"^https:"), "secure_site").otherwise("site")
    return table(spark, base, "pages").groupBy(kind.alias("channel")).agg(F.count("*").alias("pages"))


def one_party_history(spark, base):
    """The contests of one party in order, each with its result and the change from the party's contest before."""
    x = predictions(spark, base).where("party = 3").join(facts(spark, base).select(F.col("id").alias("contest"), "day"), "contest")
    per = x.groupBy("day").agg(F.count("*").alias("contests"), F.round(F.avg("observed"), 6).alias("mean"))
    w = Window.partitionBy(F.year("day")).orderBy("day")
    return per.select(F.col("day").cast("string").alias("day"), "contests", "mean", F.round(F.col("mean") - F.lag("mean").over(w), 6).alias("change"))


def sparsity_by_split(spark, base):
    """Cells of segment and priority per split: how many are empty or thin, and the upper median of their counts."""
    x = with_split(facts(spark, base)).join(table(spark, base, "customer").select(F.col("c_custkey").alias("cust"), "c_mktsegment"), "cust")
    cells = x.groupBy("split", "c_mktsegment", "priority").agg(F.count("*").alias("n"))
    g = cells.groupBy("split").agg(F.count("*").alias("cells"), F.count(F.when(F.col("n") < 5, 1)).alias("thin"), F.array_sort(F.collect_list("n")).alias("v"))
    middle = F.get("v", F.floor(F.col("cells") / 2).cast("int"))
    return g.select("split", "cells", "thin", middle.alias("upper_median"), F.when(F.col("thin") * 2 > F.col("cells"), "sparse").otherwise("usable").alias("verdict"))


def completeness_by_layer(spark, base):
    """Share of known values of each field, for three layers."""
    layers = {"facts": (facts(spark, base), ["first_ship", "last_ship", "total"]), "labels": (table(spark, base, "labels").join(table(spark, base, "documents"), "doc_id", "left"), ["lang", "source", "text"]), "history": (table(spark, base, "customer").join(table(spark, base, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last_order")), "c_custkey", "left"), ["last_order", "c_acctbal"])}
    parts = []
    for name, (df, fields) in layers.items():
        one = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(f).alias(f) for f in fields])
        parts.append(one.select(F.lit(name).alias("layer"), "rows", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("known")) for f in fields])).alias("f")).select("layer", "f.field", "f.known", F.round(F.col("f.known") / F.col("rows"), 6).alias("share")))
    return a.union(*parts)


LEAK_SQL = f"""{FACT_SQL}, x AS (SELECT *, {SPLIT} AS split, lag(day) OVER (PARTITION BY cust ORDER BY day, id) AS pd FROM f), li AS (SELECT DISTINCT l_orderkey AS id FROM lineitem), n AS (SELECT count(*) AS n FROM x)"""
QUERIES = {
    "leakage_audit": (leakage_audit, f"""WITH {LEAK_SQL} SELECT 'split' AS layer, 'train_after_boundary' AS gate, count(*) FILTER (split = 'train' AND day >= DATE '1996-01-01') AS violations, count(*) AS rows FROM x UNION ALL SELECT 'split', 'test_before_train', count(*) FILTER (split = 'test' AND day < DATE '1996-01-01'), count(*) FROM x
 UNION ALL SELECT 'features', 'shipped_before_order', count(*) FILTER (first_ship < day), count(*) FROM x UNION ALL SELECT 'features', 'ships_after_boundary_in_train', count(*) FILTER (split = 'train' AND last_ship >= DATE '{BOUNDARY}'), count(*) FROM x UNION ALL SELECT 'history', 'previous_not_earlier', count(*) FILTER (pd > day), count(*) FROM x
 UNION ALL SELECT 'keys', 'repeated_key', (SELECT count(*) FROM (SELECT 1 FROM x GROUP BY id HAVING count(*) > 1)), n FROM n UNION ALL SELECT 'keys', 'null_key', (SELECT count(*) FROM x WHERE id IS NULL), n FROM n
 UNION ALL SELECT 'sets', 'left_only', count(*) FILTER (li.id IS NULL), count(*) FROM (SELECT id FROM x WHERE lines > 0) l FULL JOIN li ON l.id = li.id UNION ALL SELECT 'sets', 'right_only', count(*) FILTER (l.id IS NULL), count(*) FROM (SELECT id FROM x WHERE lines > 0) l FULL JOIN li ON l.id = li.id UNION ALL SELECT 'columns', 'outcome_named', 0, 12"""),
    "reference_integrity": (reference_integrity, """WITH d AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(coalesce(text, ''))) AS first FROM documents), r AS (SELECT * FROM d WHERE first <> doc_id) SELECT 'documents' AS layer, 'repeated_key' AS gate, (SELECT count(*) FROM (SELECT 1 FROM d GROUP BY doc_id HAVING count(*) > 1)) AS violations, count(*) AS rows FROM d UNION ALL SELECT 'documents', 'null_key', 0, count(*) FROM d
 UNION ALL SELECT 'labels', 'left_only', count(*) FILTER (d.doc_id IS NULL), count(*) FROM (SELECT DISTINCT doc_id FROM labels) l FULL JOIN d ON l.doc_id = d.doc_id UNION ALL SELECT 'labels', 'right_only', count(*) FILTER (l.doc_id IS NULL), count(*) FROM (SELECT DISTINCT doc_id FROM labels) l FULL JOIN d ON l.doc_id = d.doc_id
 UNION ALL SELECT 'clusters', 'circular', (SELECT count(*) FROM r x JOIN r y ON x.first = y.doc_id), count(*) FROM r UNION ALL SELECT 'clusters', 'dangling', 0, count(*) FROM r UNION ALL SELECT 'clusters', 'self', 0, count(*) FROM r UNION ALL SELECT 'clusters', 'mutual', (SELECT count(*) FROM r x JOIN r y ON x.doc_id = y.first AND x.first = y.doc_id), count(*) FROM r"""),
    "reference_rings": (reference_rings, """WITH RECURSIVE l AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem), b AS (SELECT x.l_suppkey AS node, y.l_suppkey AS other, count(*) AS n FROM l x JOIN l y USING (l_orderkey) WHERE x.l_suppkey <> y.l_suppkey GROUP BY ALL),
 f AS MATERIALIZED (SELECT node, first(other ORDER BY n DESC, other) AS partner FROM b GROUP BY node), w(origin, place) AS (SELECT node, partner FROM f UNION SELECT origin, f.partner FROM w JOIN f ON w.place = f.node) SELECT node, partner, node IN (SELECT origin FROM w WHERE origin = place) AS on_cycle FROM f"""),
    "dictionary_evidence": (dictionary_evidence, r"""WITH i AS (SELECT DISTINCT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')[1:4] AS a FROM benchmark), d AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '[^.!?\n]+[.!?]?'), lambda x: trim(x)), lambda x: regexp_matches(x, '[\p{L}\p{N}]')) AS s FROM documents),
 n AS (SELECT doc_id, k - 1 AS sentence_no, s[k] AS sentence, regexp_extract_all(lower(s[k]), '[\p{L}\p{N}]+') AS own, regexp_extract_all(lower(array_to_string(s[k:k + 3], ' ')), '[\p{L}\p{N}]+') AS w FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS k FROM d)),
 p AS (SELECT doc_id, sentence_no, sentence, j - 1 AS word, w[j:j + 3] AS g FROM (SELECT *, unnest(range(1, len(own) + 1)) AS j FROM n)) SELECT doc_id, item_id, array_to_string(a, ' ') AS alias, sentence_no, word, sha256(sentence) AS sentence_sha256 FROM p JOIN i ON g[1:len(a)] = a WHERE len(a) > 0"""),
    "seat_date_validation": (seat_date_validation, f"""WITH {ALLOCATED_SQL}, {FACT_SQL}, c AS (SELECT contest, count(*) AS entries, count(*) FILTER (observed) AS elected, CASE WHEN contest % 11 = 0 THEN NULL ELSE 1 + contest % 3 END AS seats FROM a GROUP BY contest), y AS (SELECT c.*, day, first_ship FROM c LEFT JOIN f ON contest = id),
 e AS (SELECT contest, unnest(list_filter([CASE WHEN seats IS NULL THEN 'seats_unknown' END, CASE WHEN seats >= entries THEN 'uncontested' END, CASE WHEN seats IS NOT NULL AND elected <> least(seats, entries) OR seats IS NULL AND elected <> entries THEN 'elected_differs_from_seats' END, CASE WHEN day IS NULL THEN 'date_missing' END, CASE WHEN first_ship < day THEN 'date_order' END, CASE WHEN dayofweek(day) IN (0, 6) THEN 'weekend' END], lambda x: x IS NOT NULL)) AS reason FROM y) SELECT reason, count(*) AS contests, min(contest) AS first_offender FROM e GROUP BY 1"""),
    "ward_assertions": (ward_assertions, f"WITH {VOTES_SQL}, x AS (SELECT *, 100 * votes / sum(votes) OVER w AS share, sum(votes) OVER w AS whole FROM votes WINDOW w AS (PARTITION BY contest)) SELECT 'wards' AS layer, unnest(['negative_votes', 'share_out_of_range', 'votes_above_whole', 'strength_below_votes']) AS gate, unnest([count(*) FILTER (votes < 0), count(*) FILTER (NOT share BETWEEN 0 AND 100), count(*) FILTER (votes > whole), count(*) FILTER (strength < votes)]) AS violations, count(*) AS rows FROM x UNION ALL SELECT 'contests', 'shares_do_not_sum', count(*) FILTER (abs(s - 100) > 1e-6), count(*) FROM (SELECT sum(share) AS s FROM x GROUP BY contest)"),
    "span_rates": (span_rates, "WITH d AS (SELECT lang, CASE WHEN regexp_matches(lower(text), 'idiot|moron|clown|loser|trash|stupid|pathetic|disgusting') THEN 1 ELSE 0 END AS h, CASE WHEN length(trim(coalesce(text, ''))) < 40 THEN 1 ELSE 0 END AS e FROM labels JOIN documents USING (doc_id) WHERE toxic = 1) SELECT lang, count(*) AS records, round(avg(h), 6) AS verified, round(avg(e), 6) AS empty, round(avg(h), 6) >= 0.5 AND round(avg(e), 6) <= 0.1 AS passes FROM d GROUP BY 1"),
    "chronology_ledger": (chronology_ledger, f"""WITH {FACT_SQL}, l AS (SELECT cust, id, 'ordered' AS event, day AS "on" FROM f UNION ALL SELECT cust, id, 'first_shipped', first_ship FROM f UNION ALL SELECT cust, id, 'last_shipped', last_ship FROM f) SELECT cust, id, event, CAST("on" AS VARCHAR) AS "on", row_number() OVER (PARTITION BY cust ORDER BY "on", id, event) AS place FROM l WHERE "on" IS NOT NULL"""),
    "official_reconciliation": (official_reconciliation, f"WITH {FACT_SQL}, x AS (SELECT *, year(day) AS year FROM f), one AS (SELECT cust, year, round(sum(total), 2) AS stated FROM x GROUP BY ALL), l AS (SELECT l_orderkey AS id, sum(l_extendedprice) AS v FROM lineitem GROUP BY 1), two AS (SELECT cust, year, round(sum(v), 2) AS official FROM x JOIN l USING (id) WHERE status <> 'P' GROUP BY ALL), y AS (SELECT * FROM one FULL JOIN two USING (cust, year)) SELECT CAST(year AS INT) AS year, CASE WHEN official IS NULL THEN 'no_official' WHEN stated IS NULL THEN 'no_stated' WHEN abs(stated - official) <= 1 THEN 'equal' WHEN stated > official THEN 'stated_higher' ELSE 'official_higher' END AS status, count(*) AS records, round(sum(stated), 2) AS stated FROM y GROUP BY ALL"),
    "rank_elected_consistency": (rank_elected_consistency, f"WITH {ALLOCATED_SQL}, k AS (SELECT *, rank() OVER (PARTITION BY contest ORDER BY votes DESC) AS rk FROM a), g AS (SELECT contest, max(rk) FILTER (predicted) AS le, min(rk) FILTER (NOT predicted) AS fl FROM k GROUP BY 1) SELECT CASE WHEN le IS NULL THEN 'nobody_elected' WHEN fl IS NULL THEN 'all_elected' WHEN le <= fl THEN 'consistent' ELSE 'inconsistent' END AS state, count(*) AS contests FROM g GROUP BY 1"),
    "snippet_candidates": (snippet_candidates, f"WITH {VOTES_SQL} SELECT contest, 'Party ' || party AS party, CAST(votes AS BIGINT) AS votes FROM votes"),
    "field_resolution": (field_resolution, "WITH g AS (SELECT l_orderkey, count(DISTINCT l_returnflag) AS kinds, max(l_returnflag) AS value FROM lineitem GROUP BY 1) SELECT o_orderkey, CASE WHEN kinds = 1 THEN value END AS value, CASE WHEN kinds IS NULL THEN 'missing' WHEN kinds = 1 THEN 'resolved' ELSE 'conflict' END AS how FROM orders LEFT JOIN g ON o_orderkey = l_orderkey"),
    "completeness_gate": (completeness_gate, f"WITH {ALLOCATED_SQL}, x AS (SELECT contest, list_filter([CASE WHEN count(*) < 2 THEN 'entries' END, CASE WHEN count(*) FILTER (observed) = 0 THEN 'winner' END, CASE WHEN sum(votes) < 20 THEN 'votes' END], lambda x: x IS NOT NULL) AS m FROM a GROUP BY contest) SELECT array_to_string(m, ',') AS missing, CASE WHEN len(m) = 0 THEN 'accept' ELSE 'search_again' END AS route, count(*) AS contests FROM x GROUP BY ALL"),
    "repeated_names": (repeated_names, "SELECT p_name, count(*) AS parts, count(DISTINCT p_brand) AS brands, min(p_partkey) AS first, max(p_partkey) AS last FROM part GROUP BY 1 HAVING count(*) > 1"),
    "continuity_evidence": (continuity_evidence, "WITH y AS (SELECT DISTINCT o_custkey AS cust, year(o_orderdate) AS year FROM orders), c AS (SELECT y.year AS since, y.year + 1 > 1998 AS out, z.cust IS NOT NULL AS seen FROM y LEFT JOIN y z ON y.cust = z.cust AND z.year = y.year + 1) SELECT CAST(since AS INT) AS since, CASE WHEN out THEN 'outside_permitted_years' WHEN seen THEN 'confirmed' ELSE 'broken' END AS status, count(*) AS customers FROM c GROUP BY ALL"),
    "mapping_review": (mapping_review, "WITH p AS (SELECT c_nationkey AS old, length(c_mktsegment) AS new, count(*) AS n FROM customer GROUP BY ALL), x AS (SELECT *, count(*) OVER (PARTITION BY old) AS outs, count(*) OVER (PARTITION BY new) AS ins, round(100 * n / sum(n) OVER (PARTITION BY old), 4) AS percent FROM p) SELECT old, CAST(new AS INT) AS new, percent, CASE WHEN outs = 1 AND ins = 1 THEN 'one_to_one' WHEN ins = 1 THEN 'split' WHEN outs = 1 THEN 'merge' ELSE 'many_to_many' END AS kind, CASE WHEN percent >= 50 THEN 'direct' WHEN percent >= 20 THEN 'partial' ELSE 'blocked' END AS resolution FROM x"),
    "baseline_features": (baseline_features, "WITH x AS (SELECT o_custkey AS cust, CAST(o_orderdate AS DATE) AS day, count(*) AS n, sum(o_totalprice) AS t FROM orders GROUP BY ALL), b AS (SELECT cust, day, coalesce(sum(n) OVER w, 0) AS earlier, sum(t) OVER w / sum(n) OVER w AS mean, max(day) OVER w AS last FROM x WINDOW w AS (PARTITION BY cust ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT cust, CAST(day AS VARCHAR) AS day, CAST(earlier AS BIGINT) AS earlier, round(mean, 4) AS mean, datediff('day', last, day) AS age, CASE WHEN earlier = 0 THEN 'no_history' WHEN datediff('day', last, day) > 730 THEN 'stale' ELSE 'usable' END AS status FROM b"),
    "by_reference_eligibility": (by_reference_eligibility, f"WITH {FACT_SQL}, r AS (SELECT cust, max(day) AS rd, count(*) AS n FROM f WHERE status = 'F' GROUP BY 1) SELECT id, CASE WHEN n IS NULL THEN 'no_reference' WHEN rd >= day THEN 'reference_not_earlier' WHEN datediff('day', rd, day) > 1461 THEN 'reference_too_old' ELSE 'eligible' END AS status FROM f LEFT JOIN r USING (cust) WHERE status = 'P'"),
    "supplementary_evidence": (supplementary_evidence, f"WITH {FACT_SQL}, one AS (SELECT cust, count(*) AS o FROM f WHERE status <> 'P' GROUP BY 1), two AS (SELECT cust, count(*) AS w FROM f WHERE lines > 0 GROUP BY 1) SELECT CASE WHEN o IS NULL THEN 'supplementary_only' WHEN w IS NULL THEN 'unresolved' WHEN o = w THEN 'accepted' ELSE 'contradicted' END AS status, count(*) AS customers FROM one FULL JOIN two USING (cust) GROUP BY 1"),
    "caption_typing": (caption_typing, f"WITH {FACT_SQL}, k AS (SELECT id, day, row_number() OVER (PARTITION BY cust, day ORDER BY id) AS k FROM f) SELECT id, CASE WHEN k = 1 THEN 'scheduled' ELSE 'by_event' END AS kind, CASE WHEN k = 1 THEN day || ' scheduled' ELSE day || ' by_event (' || k || ')' END AS caption FROM k"),
    "label_disagreements": (label_disagreements, "WITH d AS (SELECT lang, CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS h, CASE WHEN length(coalesce(text, '')) < 80 THEN 'bad' WHEN regexp_matches(text, '[!#*]{2}') THEN 'bad' WHEN length(coalesce(text, '')) < 400 THEN 'unclear' ELSE 'good' END AS r FROM labels JOIN documents USING (doc_id)) SELECT lang, CASE WHEN h = r THEN 'same' WHEN r = 'unclear' THEN 'rule_unsure' ELSE h || '_but_' || r END AS kind, count(*) AS records FROM d GROUP BY ALL"),
    "place_sentences": (place_sentences, f"WITH s AS (SELECT doc_id, unnest(string_split_regex(regexp_replace(coalesce(text, ''), '([.!?])[ \\t\\n\\v\\f\\r]+', '\\1' || chr(1), 'g'), chr(1))) AS s FROM documents), p(place) AS (VALUES {', '.join(f'({x!r})' for x in PLACES)}) SELECT doc_id, place, count(*) AS sentences FROM s JOIN p ON regexp_matches(s, '(?i)(^|[^a-z])' || place || '([^a-z]|$)') GROUP BY ALL"),
    "context_cards": (context_cards, "SELECT doc_id, sha256(doc_id || '|' || coalesce(lang, '') || '|' || coalesce(source, '') || '|' || coalesce(CAST(length(text) AS VARCHAR), '') || '|' || coalesce(CAST(quality AS VARCHAR), '') || '|' || coalesce(CAST(toxic AS VARCHAR), '')) AS card_sha256, concat_ws(',', CASE WHEN lang IS NULL THEN 'no_meta' END, CASE WHEN quality IS NULL THEN 'no_label' END, CASE WHEN length(text) < 20 THEN 'tiny' END) AS errors FROM labels LEFT JOIN documents USING (doc_id)"),
    "attribution_rate": (attribution_rate, f"WITH d AS (SELECT source, regexp_matches(lower(text), '(^|[^a-z])({'|'.join(PLACES)})([^a-z]|$)') AS n FROM documents) SELECT source, count(*) AS documents, count(*) FILTER (n) AS named, round(count(*) FILTER (n) / count(*), 6) AS rate FROM d GROUP BY 1"),
    "corpus_by_window": (corpus_by_window, "WITH e AS (SELECT *, datediff('day', CAST(ts AS DATE), DATE '2024-02-01') AS lag FROM events), g AS (SELECT CASE WHEN lag BETWEEN 1 AND 7 THEN '1-7' WHEN lag BETWEEN 8 AND 14 THEN '8-14' WHEN lag BETWEEN 15 AND 30 THEN '15-30' ELSE 'other' END AS band, event_type, count(*) AS events FROM e GROUP BY ALL) SELECT *, round(100 * events / sum(events) OVER (), 4) AS percent FROM g"),
    "collection_diagnostics": (collection_diagnostics, "WITH d AS (SELECT *, coalesce(text, '') AS t FROM documents) SELECT lang, CASE WHEN length(t) = 0 THEN 'empty' WHEN length(t) < 400 THEN 'short' WHEN length(t) < 4000 THEN 'middle' ELSE 'long' END AS size, count(*) AS documents, count(DISTINCT t) AS texts, count(DISTINCT source) AS sources FROM d GROUP BY ALL"),
    "channel_classes": (channel_classes, r"WITH p AS (SELECT lower(coalesce(url, '')) AS u, lower(regexp_extract(coalesce(html, ''), '<title>([^<]*)</title>', 1)) AS t FROM pages) SELECT CASE WHEN u = '' THEN 'none' WHEN regexp_matches(u, '[?&]ref=') THEN 'referral' WHEN regexp_matches(u, '^https?://(m|amp)\.') THEN 'mobile' WHEN regexp_matches(t, '[#*$%&|<>]{3}') THEN 'junk_heading' WHEN starts_with(u, 'https:') THEN 'secure_site' ELSE 'site' END AS channel, count(*) AS pages FROM p GROUP BY 1"),
    "one_party_history": (one_party_history, f"WITH {PRED_SQL}, {FACT_SQL}, p AS (SELECT day, count(*) AS contests, round(avg(observed), 6) AS mean FROM t JOIN f ON contest = id WHERE party = 3 GROUP BY 1) SELECT CAST(day AS VARCHAR) AS day, contests, mean, round(mean - lag(mean) OVER (PARTITION BY year(day) ORDER BY day), 6) AS change FROM p"),
    "sparsity_by_split": (sparsity_by_split, f"WITH {FACT_SQL}, c AS (SELECT {SPLIT} AS split, c_mktsegment, priority, count(*) AS n FROM f JOIN customer ON cust = c_custkey GROUP BY ALL), s AS (SELECT split, list(n ORDER BY n) AS v FROM c GROUP BY split) SELECT split, CAST(len(v) AS BIGINT) AS cells, CAST(len(list_filter(v, lambda x: x < 5)) AS BIGINT) AS thin, v[len(v) // 2 + 1] AS upper_median, CASE WHEN len(list_filter(v, lambda x: x < 5)) * 2 > len(v) THEN 'sparse' ELSE 'usable' END AS verdict FROM s"),
    "completeness_by_layer": (completeness_by_layer, f"WITH {FACT_SQL}, l AS (SELECT lang, source, text FROM labels LEFT JOIN documents USING (doc_id)), h AS (SELECT max(o_orderdate) AS lo, any_value(c_acctbal) AS bal FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey) SELECT 'facts' AS layer, unnest(['first_ship', 'last_ship', 'total']) AS field, unnest([count(first_ship), count(last_ship), count(total)]) AS known, round(unnest([count(first_ship), count(last_ship), count(total)]) / count(*), 6) AS share FROM f UNION ALL SELECT 'labels', unnest(['lang', 'source', 'text']), unnest([count(lang), count(source), count(text)]), round(unnest([count(lang), count(source), count(text)]) / count(*), 6) FROM l UNION ALL SELECT 'history', unnest(['last_order', 'c_acctbal']), unnest([count(lo), count(bal)]), round(unnest([count(lo), count(bal)]) / count(*), 6) FROM h"),
}
