"""Operators over contests: groups of entries that compete for a share and for seats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def with_share(df: DataFrame, keys: list[str], value: str, out: str = "share", places: int = 6) -> DataFrame:
    """Percent of the group's total; null where the total is zero."""
    total = F.sum(value).over(Window.partitionBy(*keys))
    return df.withColumn(out, F.when(total != 0, F.round(100 * F.col(value) / total, places)))


def with_rank(df: DataFrame, keys: list[str], value: str, out: str = "rank") -> DataFrame:
    """Competition rank (1, 2, 2, 4), largest value first."""
    return df.withColumn(out, F.rank().over(Window.partitionBy(*keys).orderBy(F.desc(value))).cast("long"))


def normalise_100(df: DataFrame, keys: list[str], raw: str, out: str, places: int = 6) -> DataFrame:
    """Scale to 100 within the group: negatives count as 0, zero mass is split equally, and one null makes
    the whole group null."""
    w = Window.partitionBy(*keys)
    clipped = F.greatest(F.col(raw), F.lit(0.0))
    mass, n, nulls = F.sum(clipped).over(w), F.count(F.lit(1)).over(w), F.count(F.when(F.col(raw).isNull(), 1)).over(w)
    value = F.when(nulls > 0, None).when(mass > 0, 100 * clipped / mass).otherwise(100.0 / n)
    return df.withColumn(out, F.round(value, places))


def allocate_seats(df: DataFrame, keys: list[str], value: str, tie_break: list[str], seats: Column) -> DataFrame:
    """elected for the first ``seats`` entries by value, then tie_break; unknown seats elect nobody, and
    tie_at_cutoff tells that the last seat's value is shared with an entry that missed it."""
    w = Window.partitionBy(*keys)
    place = F.row_number().over(w.orderBy(F.desc_nulls_last(value), *tie_break))
    out = df.withColumn("seats", F.when(seats.isNotNull(), F.least(seats.cast("long"), F.count(F.lit(1)).over(w)))).withColumn("place", place.cast("long"))
    last = F.max(F.when(F.col("place") == F.col("seats"), F.col(value))).over(w)
    first_out = F.max(F.when(F.col("place") == F.col("seats") + 1, F.col(value))).over(w)
    return out.withColumn("elected", F.coalesce(F.col("place") <= F.col("seats"), F.lit(False))).withColumn(
        "tie_at_cutoff", F.coalesce(last == first_out, F.lit(False))
    )


def top_two(df: DataFrame, keys: list[str], value: str, tie_break: list[str]) -> DataFrame:
    """One row per group: top and second value, margin (null without a second), ties at the top."""
    w = Window.partitionBy(*keys)
    placed = df.withColumn("__p", F.row_number().over(w.orderBy(F.desc(value), *tie_break))).withColumn("__r", F.rank().over(w.orderBy(F.desc(value))))
    return placed.groupBy(*keys).agg(
        F.max(F.when(F.col("__p") == 1, F.col(value))).alias("top"),
        F.max(F.when(F.col("__p") == 2, F.col(value))).alias("second"),
        (F.max(F.when(F.col("__p") == 1, F.col(value))) - F.max(F.when(F.col("__p") == 2, F.col(value)))).alias("margin"),
        F.count(F.when(F.col("__r") == 1, 1)).alias("tied_at_top"),
    )


def consensus(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The group's single value, or null with a status: conflict, agreed or unknown."""
    n = F.count_distinct(value)
    return df.groupBy(*keys).agg(
        F.when(n == 1, F.max(value)).alias("value"),
        F.when(n > 1, "conflict").when(n == 1, "agreed").otherwise("unknown").alias("status"),
        F.every(F.col(value).isNotNull()).alias("all_known"),
    )


def seat_totals(df: DataFrame, party: str, predicted: str, observed: str) -> DataFrame:
    """Seats per party by prediction and by observation, over the union of both parties' sets."""
    p = df.where(predicted).groupBy(party).agg(F.count("*").alias("predicted_seats"))
    o = df.where(observed).groupBy(party).agg(F.count("*").alias("observed_seats"))
    return p.join(o, party, "full").na.fill(0, ["predicted_seats", "observed_seats"]).withColumn("difference", F.col("predicted_seats") - F.col("observed_seats"))


def set_accuracy(df: DataFrame, keys: list[str], predicted: str, observed: str, member: str) -> DataFrame:
    """One row: contests, contests whose elected sets agree, share of right calls."""
    per = df.groupBy(*keys).agg(
        F.every(F.col(predicted) == F.col(observed)).alias("same"),
        F.count("*").alias("n"),
        F.count(F.when(F.col(predicted) == F.col(observed), 1)).alias("right"),
    )
    return per.agg(
        F.count("*").alias("contests"),
        F.count(F.when(F.col("same"), 1)).alias("fully_right"),
        F.round(F.sum("right") / F.sum("n"), 6).alias("call_accuracy"),
    )
