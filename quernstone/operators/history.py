"""Strictly-earlier lookups, backward pooling and chronological splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernstone.plans.durable import durable
from quernstone.plans.ranges import carried, running

DAYS_PER_YEAR = 365.25


def previous_next(df: DataFrame, key: str, day: str, value: str) -> DataFrame:
    """previous and next value of the same key by distinct day; null where that day holds two different
    values (refused as ambiguous), and never from the row's own day."""
    days = df.groupBy(key, day).agg(F.when(F.count_distinct(value) == 1, F.max(value)).alias("__v"), (F.count_distinct(value) > 1).alias("__tie"))
    w = Window.partitionBy(key).orderBy(day)
    near = days.select(
        key, day,
        F.lag(day).over(w).alias("previous_day"), F.lag("__v").over(w).alias("previous_value"), F.lag("__tie").over(w).alias("previous_tie"),
        F.lead(day).over(w).alias("next_day"), F.lead("__v").over(w).alias("next_value"),
    )
    return df.join(near, [key, day])


def as_of(facts: DataFrame, states: DataFrame, key: str, at: str, since: str, value: str) -> DataFrame:
    """The latest state strictly before each fact, by one ordered pass over both (no range join).

    States sort after facts of the same moment, so a fact never sees its own moment's state. Both are dealt by ranges of key and moment and the last state is
    carried from range to range, so a key with a third of all rows is spread over tasks. Of equal moments the greatest value holds; null states are none; repeated facts
    each keep their row.
    """
    left = facts.withColumn("__t", F.col(at)).withColumn("__k", F.lit(0)).withColumn("__v", F.lit(None).cast(states.schema[value].dataType))
    right = states.select(F.col(key), F.col(since).alias("__t"), F.lit(1).alias("__k"), F.col(value).alias("__v"))
    both = left.unionByName(right, allowMissingColumns=True)
    seen = carried(both, key, ["__t", "__k"], "__v", "as_of")
    return seen.where("__k = 0").drop("__t", "__k", "__v")


def pool_backwards(summaries: DataFrame, key: str, day: str, n: str, total: str, minimum: int, years: float, digits: int = 2) -> DataFrame:
    """(key, day, pooled, pooled_n, sources, oldest): the weighted mean over the latest earlier days, taken until
    ``minimum`` entries are reached, none older than ``years``; null if it is never reached.

    One row per key and day is expected. Days without entries (``n`` null or not positive) are no sources, but get a result. A null key or
    day gets nulls. ``total`` is summed in whole units of ``digits`` decimals, so no order of summation shows.

    No day meets its earlier days: entries are summed up over the order of (key, day), dealt by ranges. A pool begins at the last row whose
    sum lies ``minimum`` below the own one, or at the first row within ``years`` if that is later; both are looked up as states before a moment, and
    differences of the sums at both ends are the pool. A key with a third of all rows is spread over ranges.
    """
    if minimum < 1:
        raise ValueError("the minimum is at least one entry")
    counts = F.col(n) > 0
    rows = summaries.select(
        key, day, F.when(counts, F.col(n)).otherwise(0).cast("long").alias("__n"),
        F.when(counts, F.round(F.coalesce(F.col(total), F.lit(0)) * 10**digits)).otherwise(0).cast("long").alias("__total"),
    ).withColumn("__source", (F.col("__n") > 0).cast("long"))
    sums = durable(running(rows, [F.col(key), F.col(day)], {"__entries": F.col("__n"), "__sum": F.col("__total"), "__place": F.col("__source")}))
    sources = sums.where((F.col("__source") == 1) & F.col(key).isNotNull() & F.col(day).isNotNull())
    enough = sources.select(key, F.col("__entries").alias("__since"), F.col("__place").alias("__start"))
    # the state after a day is the place behind it; before all days of a key stands its first place
    first = sources.groupBy(key).agg(F.lit(None).cast("date").alias("__since"), F.min("__place").alias("__start"))
    inside = sources.select(key, F.to_date(day).alias("__since"), (F.col("__place") + 1).alias("__start")).union(first)
    at = sums.withColumn("__reach", F.col("__entries") - minimum + 1).withColumn("__from", F.date_sub(day, int(years * DAYS_PER_YEAR)))
    at = as_of(at, enough, key, "__reach", "__since", "__start").withColumnRenamed("as_of", "__enough")
    at = as_of(at, inside, key, "__from", "__since", "__start").withColumn("__start", F.greatest("__enough", "as_of"))
    start = sources.select(F.col("__place").alias("__start"), F.col("__entries").alias("__entries0"), F.col("__sum").alias("__sum0"), F.col(day).alias("oldest"))
    some = (F.col("__start") < F.col("__place")) & F.col(day).isNotNull()
    out = at.withColumn("__start", F.when(some, F.col("__start"))).join(start, "__start", "left")
    pooled_n, pooled = F.col("__entries") - F.col("__entries0"), (F.col("__sum") - F.col("__sum0")) / 10**digits
    return out.select(
        key, day, F.when(pooled_n >= minimum, F.round(pooled / pooled_n, 4)).alias("pooled"), pooled_n.alias("pooled_n"), (F.col("__place") - F.col("__start")).alias("sources"), "oldest",
    )


def fold_of(day: Column, train_until: str, test_from: str, test_until: str) -> Column:
    return F.when(day < F.lit(train_until).cast("date"), "train").when(
        (day >= F.lit(test_from).cast("date")) & (day <= F.lit(test_until).cast("date")), "test"
    ).otherwise("unused")


def rolling_folds(df: DataFrame, period: str) -> DataFrame:
    """One fold per period but the first: rows of earlier periods train, the period's rows test."""
    per = df.groupBy(period).agg(F.count("*").alias("test_rows"))
    w = Window.orderBy(period)  # one row per period
    earlier = F.sum("test_rows").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return per.select(period, "test_rows", earlier.alias("train_rows"), F.lag(period).over(w).alias("last_train")).where("train_rows IS NOT NULL")


def first_wins(streams: list[DataFrame], key: str, order: list[str]) -> DataFrame:
    """Union of decision streams; the earliest stream that names a key decides it."""
    out = None
    for i, s in enumerate(streams):
        s = s.withColumn("stream", F.lit(i).cast("long"))
        out = s if out is None else out.unionByName(s)
    w = Window.partitionBy(key).orderBy("stream", *order)
    return out.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
