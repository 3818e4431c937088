"""Mixing sources to target weights along a time-varying curriculum.

Every source has a target: sources by code point weigh WEIGHTS in turn and share the size (in words) of all documents; a target stops at
MAX_REPEATS times its source's size and the excess is shared by weight among the others (water filling over the
sources sorted by cap and weight, with running sums). When a source is read is told by its weight's schedule: a curve of straight lines
between KNOTS of the training time 0 to 1. The schedule is integrated, and scaled to its target it is the source's cumulative demand.
A source's documents stand in hash order, round after round; the word at which a document's turn begins is put into
the inverse of the demand, a root of a quadratic in each stretch, which gives its training time. All turns are range-sorted
by time, and running words over that order give each turn's exact place in the stream.

The turn at the end of a source's demand takes only the words that are still wanted (one document per source and run),
so a source's words are its target, rounded down. Sizes, targets and places are integers or single roundings of them:
reruns agree. All running sums go by ranges (``plans/ranges.py``), so a source with a third of all rows is spread over tasks.

Defined results: a null or blank text has size 0 and is never taken; null sources are one source, the last; a null doc_id is reported; repeated
rows each count; rows that agree in all of doc_id, source and text may change places; with no words at all, targets are 0; an
empty table gives an empty table; texts of any length; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

from math import fsum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.llm.quality_rules import group_key
from quernstone.llm.text import SPACE_WORD
from quernstone.plans.durable import durable, join_small
from quernstone.plans.ranges import running

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
#: training time -> factor on the weight, by the weight's place in WEIGHTS: the heavy sources fade, the light ones grow
KNOTS = (0.0, 0.5, 1.0)
SCHEDULES = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5))


def integrated(schedule: tuple[float, ...], knots: tuple[float, ...] = KNOTS) -> list[float]:
    """The schedule's integral up to each knot."""
    parts = [(b - a) * (x + y) / 2 for a, b, x, y in zip(knots, knots[1:], schedule, schedule[1:], strict=False)]
    return [fsum(parts[:k]) for k in range(len(knots))]


def stretches(schedule: tuple[float, ...], knots: tuple[float, ...] = KNOTS) -> list[tuple[float, float, float, float, float]]:
    """(integral before, integral after, time, factor, slope) of every stretch with a demand."""
    total = integrated(schedule, knots)
    out = [(total[k], total[k + 1], knots[k], schedule[k], (schedule[k + 1] - schedule[k]) / (knots[k + 1] - knots[k])) for k in range(len(knots) - 1)]
    return [s for s in out if s[1] > s[0]]


def time_of(part: Column, place: Column, schedules=SCHEDULES, knots=KNOTS) -> Column:
    """The training time at which ``part`` (0 to 1) of a source's demand is met; ``place``: which schedule the source follows."""

    def inverse(schedule: tuple[float, ...]) -> Column:
        own = stretches(schedule, knots)
        area = part * F.lit(own[-1][1])
        root = lambda a, t, m, s: F.lit(t) + F.when(area > a, 2.0 * (area - a) / (m + F.sqrt(m * m + 2.0 * s * (area - a)))).otherwise(0.0)
        out = F.when(area < own[0][1], root(own[0][0], *own[0][2:]))
        for a, b, *rest in own[1:-1]:
            out = out.when(area < b, root(a, *rest))
        return out.otherwise(root(own[-1][0], *own[-1][2:]))

    out = F.when(place == 0, inverse(schedules[0]))
    for k, schedule in enumerate(schedules[1:], 1):
        out = out.when(place == k, inverse(schedule))
    return out


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, source_key, size, place_key: one pass over the texts, written once."""
    text = F.coalesce("text", F.lit(""))
    mark = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text))
    size = F.regexp_count(text, F.lit(SPACE_WORD)).cast("long")
    return durable(docs.select("doc_id", "source", group_key("source").alias("source_key"), size.alias("size"), mark.alias("place_key")))


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = MAX_REPEATS) -> DataFrame:
    """source, source_key, source_size, source_rank, source_start (words of all sources before), place, target."""
    sizes = rows.groupBy("source", "source_key").agg(F.sum("size").alias("source_size"))
    ranked = running(sizes, [F.col("source").asc_nulls_last()], {"source_rank": F.lit(1), "source_start": F.col("source_size")})
    place = (F.col("source_rank") % len(weights)).cast("int")
    ranked = ranked.withColumn("place", place).withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), place + 1).cast("long"))
    cap = F.lit(repeats) * F.col("source_size")
    filled = durable(running(ranked, [F.lit(1.0) * F.col("source_size") / F.col("weight"), F.col("source_rank")], {"cap_before": F.lit(repeats) * F.col("source_size"), "weight_before": F.col("weight")}))
    words, weight = filled.agg(F.sum("source_size"), F.sum("weight")).first()
    wide = lambda c: c.cast("decimal(19,0)")  # noqa: E731  products of longs
    full = wide(F.col("weight")) * wide(F.lit(words or 0) - F.col("cap_before")) > wide(cap) * wide(F.lit(weight or 0) - F.col("weight_before"))
    filled = filled.withColumn("full", full)
    held, open_ = filled.agg(F.sum(F.when(F.col("full"), cap).otherwise(0)), F.sum(F.when(~F.col("full"), F.col("weight")).otherwise(0))).first()
    share = (F.col("weight") * F.lit((words or 0) - (held or 0))).cast("double") / F.lit(float(open_ or 1))
    return durable(filled.select("source", "source_key", "source_size", "source_rank", "source_start", "place", F.when(F.col("full"), cap.cast("double")).otherwise(share).alias("target")))


def placed(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Every row with its number, its source's columns and ``offset``, the words of its source before it."""
    order = [F.col("source").asc_nulls_last(), F.col("place_key"), F.col("doc_id"), F.col("size")]
    at = running(rows, order, {"row": F.lit(1), "words_before": F.col("size")})
    found = join_small(at.drop("source"), sources, ["source_key"], "inner")
    return durable(found.withColumn("offset", F.col("words_before") - F.col("source_start")))


def turns(rows: DataFrame, repeats: int = MAX_REPEATS, schedules=SCHEDULES, knots=KNOTS) -> DataFrame:
    """row, doc_id, source, pass, words, time, start: the training stream, sorted; ``start`` is the place of the turn's first word."""
    begins = lambda k: F.lit(k) * F.col("source_size") + F.col("offset")
    words = lambda k: F.least(F.col("size"), F.floor("target").cast("long") - begins(k))
    each = F.array(*[F.struct(F.lit(k).alias("pass"), begins(k).alias("begins"), words(k).alias("words")) for k in range(repeats)])
    taken = rows.select("row", "doc_id", "source", "source_rank", "place", "target", F.explode(F.filter(each, lambda t: t["words"] > 0)).alias("t"))
    part = F.col("t.begins").cast("double") / F.col("target")
    timed = taken.select("row", "doc_id", "source", "source_rank", "t.pass", "t.begins", "t.words", time_of(part, F.col("place"), schedules, knots).alias("time"))
    stream = running(timed, [F.col("time"), F.col("source_rank"), F.col("begins")], {"start": F.col("words")})
    return stream.select("row", "doc_id", "source", "pass", "words", "time", "start")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = MAX_REPEATS, schedules=SCHEDULES, knots=KNOTS) -> DataFrame:
    """The training stream of ``docs``: see ``turns``."""
    rows = sized(docs)
    return turns(placed(rows, targets(rows, weights, repeats)), repeats, schedules, knots).drop("row")


def taken(docs: DataFrame) -> DataFrame:
    """Every document in the order of its first turn: doc_id, size, source_size, target, taken, first_start (null if it has no turn)."""
    rows = sized(docs)
    rows = placed(rows, targets(rows))
    own = turns(rows).groupBy("row").agg(F.sum("words").alias("taken"), F.min("start").alias("first_start"))
    out = rows.join(own, "row", "left").orderBy(F.col("first_start").asc_nulls_last(), "row")  # rows without a place fill ranges of their own
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), "first_start")
