"""Checked joins: bijections, reasons for misses, crosswalks in both directions, conflict logs, dated dimensions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.plans.durable import durable, join_small


def bijection_report(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: rows and distinct keys of both sides, keys without a partner, and whether the join is one to one."""
    side = lambda df, name: df.groupBy(key).agg(F.count("*").alias(name))
    both = side(left, "l").join(side(right, "r"), key, "full")
    out = both.agg(
        F.coalesce(F.sum("l"), F.lit(0)).alias("left_rows"), F.coalesce(F.sum("r"), F.lit(0)).alias("right_rows"),
        F.count(F.when(F.col("r").isNull(), 1)).alias("left_only"), F.count(F.when(F.col("l").isNull(), 1)).alias("right_only"),
        F.count(F.when((F.col("l") > 1) | (F.col("r") > 1), 1)).alias("repeated_keys"),
    )
    return out.withColumn("bijection", (F.col("left_only") == 0) & (F.col("right_only") == 0) & (F.col("repeated_keys") == 0))


def one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The inner join by ``key``, refused unless every key stands exactly once on both sides."""
    left, right = durable(left), durable(right)
    r = bijection_report(left, right, key).first()
    if not r["bijection"]:
        raise ValueError(f"not one to one by {key}: {r.asDict()}")
    return left.join(right, key)


def joined_or_error(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The inner join by ``key``, refused if a left row has no partner."""
    left, right = durable(left), durable(right)
    missing = left.join(right, key, "left_anti").limit(5).select(key).collect()
    if missing:
        raise ValueError(f"no partner for {key} in {[m[0] for m in missing]}")
    return left.join(right, key)


def with_lookups(df: DataFrame, steps: list[tuple[str, DataFrame, list[str], str]]) -> DataFrame:
    """A chain of left joins (name, table, keys, column) and the reason a row falls out: the first lookup that gave nothing,
    or "ok"."""
    reasons = []
    for name, found, keys, column in steps:
        df = join_small(df, durable(found.select(*keys, column)), keys)
        reasons.append(F.when(F.col(column).isNull(), f"no_{name}"))
    return df.withColumn("reason", F.coalesce(*reasons, F.lit("ok")))


def name_crosswalk(names: DataFrame, links: DataFrame, known: DataFrame) -> DataFrame:
    """(name, resolved, how) for every row of ``names``: as it is if ``known`` has it, else along the crosswalk (old, new), else
    along its inverse; only an unambiguous step counts. All three compare normalised names."""
    forward = links.groupBy("old").agg(F.count_distinct("new").alias("n"), F.min("new").alias("to")).select(F.col("old").alias("name"), F.when(F.col("n") == 1, F.col("to")).alias("forward"), (F.col("n") > 1).alias("many_forward"))
    back = links.groupBy("new").agg(F.count_distinct("old").alias("n"), F.min("old").alias("to")).select(F.col("new").alias("name"), F.when(F.col("n") == 1, F.col("to")).alias("back"), (F.col("n") > 1).alias("many_back"))
    x = join_small(names, durable(known.select("name").distinct().withColumn("known", F.lit(True))), ["name"])
    x = join_small(join_small(x, durable(forward), ["name"]), durable(back), ["name"])
    how = (
        F.when(F.col("known"), "as_is").when(F.col("forward").isNotNull(), "forward").when(F.col("back").isNotNull(), "inverse")
        .when(F.col("many_forward") | F.col("many_back"), "ambiguous").otherwise("unresolved")
    )
    value = F.when(how == "as_is", F.col("name")).when(how == "forward", F.col("forward")).when(how == "inverse", F.col("back"))
    return x.select(*names.columns, value.alias("resolved"), how.alias("how"))


def conflict_log(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, status, conflicts): full outer comparison by a normalised key: agrees, conflict with the fields, or one side only."""
    l = left.select(key, F.lit(True).alias("l_"), *[F.col(f).alias(f"{f}_l") for f in fields])  # noqa: E741
    r = right.select(key, F.lit(True).alias("r_"), *[F.col(f).alias(f"{f}_r") for f in fields])
    x = l.join(r, key, "full")
    bad = F.array_compact(F.array(*[F.when(~F.col(f"{f}_l").eqNullSafe(F.col(f"{f}_r")), F.lit(f)) for f in fields]))
    status = F.when(F.col("r_").isNull(), "left_only").when(F.col("l_").isNull(), "right_only").when(F.size(bad) > 0, "conflict").otherwise("agrees")
    return x.select(key, status.alias("status"), F.when(status == "conflict", F.array_join(bad, ",")).otherwise("").alias("conflicts"))


def gated_reference(df: DataFrame, reference: DataFrame, keys: list[str], value: str, permission: str) -> DataFrame:
    """``df`` with the reference's value where its permission holds, and the lookup's status."""
    x = join_small(df, durable(reference.select(*keys, F.col(value).alias("v_"), F.col(permission).alias("p_"))), keys)
    status = F.when(F.col("p_").isNull(), "no_reference").when(~F.col("p_"), "not_permitted").otherwise("used")
    return x.withColumn("reference_status", status).withColumn("reference", F.when(status == "used", F.col("v_"))).drop("v_", "p_")


def dated_dimension(day: Column, versions: list[tuple[str | None, str | None, str]], other: str) -> Column:
    """The value of the version (from, to, value; ends included, None open) that holds ``day``: constants, so no join."""
    date = lambda d: F.lit(d).cast("date")
    inside = lambda a, b: reduce(lambda x, y: x & y, [*([day >= date(a)] if a else []), *([day <= date(b)] if b else [])], F.lit(True))
    return F.coalesce(*[F.when(inside(a, b), F.lit(v)) for a, b, v in versions], F.lit(other))
