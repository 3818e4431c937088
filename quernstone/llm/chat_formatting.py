"""Chat formatting: logged conversations that are a prefix of a longer one collapse into it, then the rest is rendered.

A turn's mark is a 128-bit hash of (its place, role, text); a prefix's hash is the XOR of its turns' marks.
As marks depend on the place, XOR of the first k marks identifies the sequence of k turns, and it can be
summed in parts: each conversation is cut into blocks of BLOCK turns, blocks are ranked and XORed by
ordinary aggregation, and running values are taken over the block totals and then within single blocks.
No step gathers a whole conversation by key except the final rendering of one output row.

A conversation is dropped if some longer one starts with all its turns (anti-join of its (length, hash) with
the distinct proper prefixes), or if an equal one has a smaller conv_id. Hot first turns cost one row, as
prefixes are made distinct with map-side combining before they are joined.

Defined results: turns are ordered by turn, then role and text; null turn sorts first; null role or text
count as empty; repeated equal turn rows count once each; rows with null conv_id are ignored; an empty table gives an
empty table; texts of any length are hashed whole; extra columns are ignored.

Turns with their places, and the prefix hashes, are written once each, as both are read several times.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernstone.plans.durable import durable

BLOCK = 512
ROLE = "<|{role}|>"
END = "<|end|>"


def placed(turns: DataFrame) -> DataFrame:
    """conv_id, block, role, text, place: the turn's rank in its conversation, from 1."""
    t = turns.select(
        "conv_id",
        F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).where(F.col("conv_id").isNotNull())
    t = t.withColumn("block", F.floor(F.col("turn") / BLOCK))
    sizes = t.groupBy("conv_id", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("conv_id", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    return (
        t.withColumn("r", F.row_number().over(inside))
        .join(starts, ["conv_id", "block"])
        .select("conv_id", "block", "role", "text", (F.col("start") + F.col("r")).alias("place"))
    )


def prefixes(place: DataFrame) -> DataFrame:
    """conv_id, place, h1, h2: the hash of the conversation's first ``place`` turns."""
    marks = place.select("conv_id", "block", "place", F.xxhash64("place", "role", "text").alias("m1"), F.xxhash64(F.lit(7), "text", "role", "place").alias("m2"))
    totals = marks.groupBy("conv_id", "block").agg(F.bit_xor("m1").alias("t1"), F.bit_xor("m2").alias("t2"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    carried = totals.select("conv_id", "block", *[F.coalesce(F.bit_xor(f"t{i}").over(before), zero).alias(f"c{i}") for i in (1, 2)])
    inside = Window.partitionBy("conv_id", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    run = marks.select("conv_id", "block", "place", *[F.bit_xor(f"m{i}").over(inside).alias(f"r{i}") for i in (1, 2)])
    joined = run.join(carried, ["conv_id", "block"])
    return joined.select("conv_id", "place", *[F.col(f"r{i}").bitwiseXOR(F.col(f"c{i}")).alias(f"h{i}") for i in (1, 2)])


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns of the conversations that stay."""
    return maximal_placed(durable(placed(turns)))


def maximal_placed(place: DataFrame) -> DataFrame:
    """``maximal`` of turns that already have their places."""
    at = durable(prefixes(place))
    lengths = at.groupBy("conv_id").agg(F.max(F.struct("place", "h1", "h2")).alias("w")).select("conv_id", "w.*")
    inner = at.join(lengths.select("conv_id", F.col("place").alias("n_turns")), "conv_id").where(F.col("place") < F.col("n_turns"))
    inner = inner.select("place", "h1", "h2").distinct()
    firsts = lengths.groupBy("place", "h1", "h2").agg(F.min("conv_id").alias("conv_id"))
    return firsts.join(inner, ["place", "h1", "h2"], "left_anti").select("conv_id", F.col("place").alias("n_turns"))


def render(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_chars, chat: the maximal conversations as text, turns in order."""
    place = durable(placed(turns))
    kept = place.join(maximal_placed(place), "conv_id")
    head = F.concat(F.lit(ROLE.split("{role}")[0]), F.col("role"), F.lit(ROLE.split("{role}")[1] + "\n"))
    line = F.struct("place", F.concat(head, F.col("text"), F.lit(END + "\n")).alias("line"))
    rows = kept.groupBy("conv_id").agg(F.max("n_turns").alias("n_turns"), F.array_sort(F.collect_list(line)).alias("turns"))
    chat = F.array_join(F.transform("turns", lambda x: x["line"]), "")
    return rows.select("conv_id", "n_turns", F.length(chat).cast("long").alias("n_chars"), chat.alias("chat"))
