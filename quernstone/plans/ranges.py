"""Running sums and carried values over a total order of all rows, without a task that sees them all, or all of one key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernstone.plans.durable import durable


def running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``df`` with one more column for each of ``sums`` (name -> a long): its sum over all rows before, in ``order``.

    Rows are dealt by ranges of the order and written with their range's number; each range is summed by itself, and the ranges'
    totals, one row per shuffle partition, are summed on top and joined back. A key with any share of the rows is spread over
    ranges as far as the columns of ``order`` tell its rows apart; rows that agree in all of them stay in one range, in any order.
    ``order`` is written anew in each step, so it must be made of columns of ``df`` and be deterministic.
    """
    part = durable(df.repartitionByRange(*order).withColumn("range_", F.spark_partition_id()))
    before = Window.partitionBy("range_").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = part.repartitionByRange("range_").select("*", *[F.coalesce(F.sum(c).over(before), F.lit(0)).cast("long").alias(f"{n}_in") for n, c in sums.items()])
    totals = part.groupBy("range_").agg(*[F.sum(c).alias(f"{n}_sum") for n, c in sums.items()])
    earlier = Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("range_", *[F.coalesce(F.sum(f"{n}_sum").over(earlier), F.lit(0)).cast("long").alias(f"{n}_base") for n in sums])
    out = inner.join(F.broadcast(base), "range_")  # as many rows as there are shuffle partitions
    return out.select(*[F.col(f"`{c}`") for c in df.columns], *[(F.col(f"{n}_base") + F.col(f"{n}_in")).alias(n) for n in sums])


def carried(df: DataFrame, key: str, order: list[str], value: str, name: str) -> DataFrame:
    """``df`` with ``name``: the last ``value`` that is not null among the rows of the same ``key`` before, by the columns ``order`` (ties: by ``value``, nulls first).

    Rows are dealt by ranges of (key, order), so a key with a third of all rows lies in many ranges. Each range looks back by itself; only the keys at a
    range's two ends can go on from the range before, so at most two rows per range are carried over. Rows of a null key have a key of their own.
    """
    by = [key, *order, value]
    part = durable(df.repartitionByRange(*by).withColumn("range_", F.spark_partition_id()))
    ends = part.groupBy("range_").agg(F.min(F.struct(key)).alias("low"), F.max(F.struct(key)).alias("high"))
    mine = F.struct(key)
    edge = part.where(F.col(value).isNotNull()).join(F.broadcast(ends), "range_").where(mine.eqNullSafe(F.col("low")) | mine.eqNullSafe(F.col("high")))
    last = edge.groupBy("range_", key).agg(F.max_by(value, F.struct(*by)).alias("last_"))
    # a range without a value of the key hands on what it got, so every range at whose end the key stands has a row
    at = ends.select("range_", F.explode(F.array_distinct(F.array("low", "high"))).alias("k")).select("range_", F.col(f"k.{key}").alias("key_"))
    at = at.join(last, (at["range_"] == last["range_"]) & at["key_"].eqNullSafe(last[key]), "left").select(at["range_"].alias("at_"), "key_", "last_")
    before = Window.partitionBy("key_").orderBy("at_").rowsBetween(Window.unboundedPreceding, -1)
    got = at.select("at_", "key_", F.last("last_", ignorenulls=True).over(before).alias("got_")).where("got_ is not null")
    inner = Window.partitionBy("range_", key).orderBy(*by[1:]).rowsBetween(Window.unboundedPreceding, -1)
    own = part.repartitionByRange("range_").withColumn("own_", F.last(value, ignorenulls=True).over(inner))
    out = own.join(F.broadcast(got), (F.col("range_") == F.col("at_")) & F.col(key).eqNullSafe(F.col("key_")), "left")  # at most two rows per shuffle partition
    return out.select(*[F.col(f"`{c}`") for c in df.columns], F.coalesce("own_", "got_").alias(name))
