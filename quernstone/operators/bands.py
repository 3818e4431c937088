"""Dated facts relative to an anchor day: disjoint lag bands, cumulative look-backs, zero-filled grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values: (scheme, label, first day, last day), days before the anchor, both ends inclusive.
BANDS = [
    ("standard", "1-3", 1, 3),
    ("standard", "4-7", 4, 7),
    ("standard", "8-14", 8, 14),
    ("standard", "15-30", 15, 30),
    ("coarse", "1-7", 1, 7),
    ("coarse", "8-30", 8, 30),
]
#: Fixed values: (label, days): "the last n days".
MAX_VALUES = 1000
SNAPSHOTS = [("last_3", 3), ("last_7", 7), ("last_14", 14), ("last_30", 30)]


def lag_days(when: str, anchor: Column) -> Column:
    """Whole calendar days before the anchor; negative after it."""
    return F.datediff(anchor, F.to_date(when)).cast("long")


def band_of(lag: Column, scheme: str) -> Column:
    """The label of the band that holds ``lag``: a constant CASE, so no join is needed; null outside all."""
    pick = [F.when(lag.between(lo, hi), label) for s, label, lo, hi in BANDS if s == scheme]
    return F.coalesce(*pick)


def band_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BANDS, "scheme string, label string, lo int, hi int")


def assign_bands(df: DataFrame, lag: str, bands: DataFrame) -> DataFrame:
    """Left range join with a fixed table of bands (a broadcast of a few rows): one row per scheme and fact."""
    return df.join(F.broadcast(bands), (F.col(lag) >= F.col("lo")) & (F.col(lag) <= F.col("hi")), "left").drop("lo", "hi")


def cumulative(df: DataFrame, lag: str) -> DataFrame:
    """One row per fact and snapshot that it belongs to."""
    member = F.filter(F.array(*[F.when(F.col(lag).between(1, days), F.lit(label)) for label, days in SNAPSHOTS]), lambda x: x.isNotNull())
    return df.withColumn("snapshot", F.explode(member))


def zero_filled(df: DataFrame, dims: dict[str, DataFrame], counts: dict[str, Column]) -> DataFrame:
    """Counts on the full grid of the dimensions' values; unseen cells are 0, never null.

    ``dims`` are tables of distinct values. The grid is their product by definition; each factor's values are counted first
    and go to the tasks as a constant array to explode, up to MAX_VALUES of them; a larger dimension is refused.
    """
    keys = list(dims)
    seen = df.groupBy(*keys).agg(*[c.alias(k) for k, c in counts.items()])
    grid = None
    for key, values in dims.items():
        values = values.select(key).distinct()
        if grid is None:
            grid = values
            continue
        found = [r[0] for r in values.limit(MAX_VALUES + 1).collect()]
        if len(found) > MAX_VALUES:
            raise ValueError(f"{key} has more than {MAX_VALUES} values; a grid over it is not a report")
        grid = grid.withColumn(key, F.explode(F.array(*[F.lit(v) for v in found]).cast(f"array<{df.schema[key].dataType.simpleString()}>")))
    return grid.join(seen, keys, "left").na.fill(0, list(counts))


def share(num: Column, den: Column, places: int = 6) -> Column:
    """Null, not 0, where the denominator is 0."""
    return F.when(den > 0, F.round(num / den, places))
