"""URL filters: fixed rules first, then trust and distrust propagated over the host link graph.

A page's verdict is that of the longest rule (host, path prefix) that fits. Pages that no rule fits take
their host's verdict: personalised PageRank spreads trust from hosts with allowed pages along links, and
distrust from hosts with blocked pages against links (who links to bad hosts is suspect); a host whose
distrust share is above THRESHOLD is blocked. Hosts that neither reaches are allowed.

Link rows are summed to (source host, target host, links) before any shuffle by host, ranks are one row per
reached host, and each round moves one row per host edge, so a host with a third of all pages costs no
more than its distinct edges. Page rows meet host verdicts in a size-checked broadcast or a skew-split join.

Defined results: null url or a url without "://" has empty host and path, fits no rule and is allowed; null
html has no links; links of a page to its own host are ignored; repeated pages count as often as they
occur; urls and pages may be of any length; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.llm.text import ascii_lower
from quernstone.plans.durable import durable, join_small

#: (verdict, host, path prefix)
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
LINK = r"""(?i)\b(?:href|src|action)\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""
DAMPING = 0.85
TOLERANCE = 1e-9  # total mass that a further round may still move
STRIDE = 6  # rounds between two writes
THRESHOLD = 0.5
PLACES = 6


def located(pages: DataFrame, url: str = "url") -> DataFrame:
    u = F.coalesce(F.col(url), F.lit(""))
    host = ascii_lower(F.regexp_extract(u, r"(?s)^.*?://([^/?#]*)", 1))
    return pages.withColumn("host", host).withColumn("path", F.regexp_extract(u, r"(?s)^.*?://[^/?#]*([^?#]*)", 1))


def rule_of(rules: list[tuple[str, str, str]] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits ``host`` and ``path``; null where none does."""
    longest = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    fits = lambda h, p: ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
    pick = [F.when(fits(h, p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for v, h, p in longest]
    return F.coalesce(*pick)


def host_edges(pages: DataFrame, html: str = "html") -> DataFrame:
    """(a, b, links) for a != b, from located pages."""
    to = F.explode(F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(LINK), F.lit(1)))
    arcs = pages.where(F.col("host") != "").select(F.col("host").alias("a"), to.alias("b"))
    arcs = arcs.withColumn("b", ascii_lower(F.col("b"))).where(F.col("a") != F.col("b"))
    return arcs.groupBy("a", "b").agg(F.count("*").alias("links"))


def propagate(edges: DataFrame, seeds: DataFrame, tolerance: float = TOLERANCE, damping: float = DAMPING) -> DataFrame:
    """(host, mass): personalised PageRank over (a, b, links) from ``seeds`` (host, mass summing to 1).

    Mass at hosts without links leaves the graph. Rounds go on until ranks move by no more than ``tolerance`` in all; as each
    round moves at most ``damping`` of the mass before it, log(tolerance) / log(damping) rounds are enough for any graph.
    Each STRIDE-th round is written to the shared folder and compared with the one written before.
    """
    out = edges.groupBy("a").agg(F.sum("links").alias("total"))
    share = durable(edges.join(out, "a").select("a", "b", (F.col("links") / F.col("total")).alias("share")))
    base = durable(seeds.select("host", ((1 - damping) * F.col("mass")).alias("mass")))
    if share.isEmpty():  # nothing moves: the fixed point is the seeds' own share
        return base
    rank = last = base
    for k in range(1, math.ceil(math.log(tolerance) / math.log(damping)) + STRIDE):
        moved = share.join(rank, F.col("a") == F.col("host")).groupBy("b").agg(F.sum(F.col("share") * F.col("mass")).alias("mass"))
        rank = base.union(moved.select("b", damping * F.col("mass"))).groupBy("host").agg(F.sum("mass").alias("mass"))
        if k % STRIDE == 0:
            rank = durable(rank)
            apart = rank.join(last.select("host", F.col("mass").alias("old")), "host", "full").agg(F.sum(F.abs(F.coalesce("mass", F.lit(0.0)) - F.coalesce("old", F.lit(0.0)))))
            if (apart.first()[0] or 0.0) <= tolerance:
                break
            last = rank
    return rank


def _seeds(ruled: DataFrame, verdict: str) -> DataFrame:
    own = ruled.where(F.col("own") == verdict).groupBy("host").agg(F.sum("n").alias("n"))
    total = own.agg(F.sum("n").alias("total")).withColumn("k", F.lit(0))
    return join_small(own.withColumn("k", F.lit(0)), total, ["k"]).select("host", (F.col("n") / F.col("total")).alias("mass"))


def host_scores(edges: DataFrame, ruled: DataFrame) -> DataFrame:
    """host, trust, distrust: both propagations from ``ruled`` (host, own: allow or block, n: its weight)."""
    trust = propagate(edges, durable(_seeds(ruled, "allow"))).select("host", F.round("mass", PLACES).alias("trust"))
    back = edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "links")
    distrust = propagate(back, durable(_seeds(ruled, "block"))).select("host", F.round("mass", PLACES).alias("distrust"))
    return reduce(lambda x, y: x.join(y, "host", "full"), [trust, distrust]).na.fill(0.0)


def host_verdict() -> Column:
    return F.when(F.col("distrust") > THRESHOLD * (F.col("trust") + F.col("distrust")), "block").otherwise("allow")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust for every row of ``pages``."""
    at = located(pages.select("page_id", "url", "html")).withColumn("r", rule_of(rules))
    edges = durable(host_edges(at))
    slim = at.select("page_id", "host", "path", "r.rule", F.col("r.verdict").alias("own"))
    ruled = durable(slim.where(F.col("own").isNotNull()).groupBy("host", "own").agg(F.count("*").alias("n")))
    scored = join_small(slim, durable(host_scores(edges, ruled)), ["host"]).na.fill(0.0, ["trust", "distrust"])
    return scored.select("page_id", "host", "path", "rule", F.coalesce("own", host_verdict()).alias("verdict"), "trust", "distrust")
