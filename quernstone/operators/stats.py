"""Error, agreement, calibration and resampling statistics as aggregations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernstone.functions.text import let
from quernstone.plans.durable import durable, join_small


def error_suite(df: DataFrame, predicted: str, observed: str, grains: dict[str, list[str]], places: int = 6) -> DataFrame:
    """MAE, RMSE, bias, median error and relative MAE at several grains: one grouping-sets pass, and one pass for all exact medians."""
    e = durable(df.where(F.col(predicted).isNotNull() & F.col(observed).isNotNull()).withColumn("__e", F.col(predicted) - F.col(observed)))
    keys = sorted({k for g in grains.values() for k in g})
    r = lambda c, name: F.round(c, places).alias(name)
    out = e.groupingSets([[F.col(k) for k in g] for g in grains.values()], *keys).agg(
        F.grouping_id().alias("__g"),
        F.count(F.lit(1)).alias("n"),
        r(F.avg(F.abs("__e")), "mae"),
        r(F.sqrt(F.avg(F.col("__e") * F.col("__e"))), "rmse"),
        (F.round(F.avg("__e"), places) + 0.0).alias("bias"),  # no negative zero
        r(F.avg(F.abs("__e")) / F.nullif(F.avg(observed), F.lit(0.0)), "relative_mae"),
    )
    ids = {sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in g): name for name, g in grains.items()}
    grain = F.coalesce(*[F.when(F.col("__g") == i, name) for i, name in ids.items()])
    out = out.withColumn("grain", grain).drop("__g")
    # every row counts once in each grain's group, told by one string; all grains' medians then come from one deal by ranges
    part = lambda k: F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit("~"))
    group = lambda name: F.concat_ws("|", F.lit(name), *[part(k) for k in grains[name]])
    sizes = e.select(F.explode(F.array(*map(group, grains))).alias("group_"), F.abs("__e").alias("size_"))
    medians = exact_median(sizes, ["group_"], "size_", "m_").select("group_", F.round("m_", places).alias("median_ae"))
    own = F.coalesce(*[F.when(F.col("grain") == name, group(name)) for name in grains])
    return out.withColumn("group_", own).join(medians, "group_").drop("group_")


def agreement(df: DataFrame, a: str, b: str, places: int = 6) -> DataFrame:
    """One row: n, observed agreement, Cohen's kappa, Gwet's AC1, PABAK, the larger marginal's share.

    Two aggregations over category counts; kappa is null when chance agreement is certain.
    """
    pairs = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("x"), F.col(b).alias("y")).agg(F.count("*").alias("n"))
    long = pairs.select(F.col("x").alias("c"), F.col("n").alias("nx"), F.lit(0).alias("ny"), F.when(F.col("x") == F.col("y"), F.col("n")).otherwise(0).alias("same")).union(
        pairs.select("y", F.lit(0), "n", F.lit(0))
    )
    cat = long.groupBy("c").agg(*[F.sum(k).alias(k) for k in ("nx", "ny", "same")])
    t = cat.agg(
        F.sum("nx").alias("n"), F.sum("same").alias("same"), F.count("*").alias("q"), F.sum(F.col("nx") * F.col("ny")).alias("xy"),
        F.sum((F.col("nx") + F.col("ny")) * (F.col("nx") + F.col("ny"))).alias("mm"), F.max(F.greatest("nx", "ny")).alias("top"),
    )
    n, po = F.col("n"), F.col("same") / F.col("n")
    pe = F.col("xy") / (n * n)
    pi2 = F.col("mm") / (4 * n * n)  # sum of squared pooled marginals
    chance = (1 - pi2) / (F.col("q") - 1)
    r = lambda c, name: F.round(c, places).alias(name)
    return t.select(
        "n", r(po, "agreement"),
        r(F.when(pe < 1, (po - pe) / (1 - pe)), "kappa"),
        r(F.when(F.col("q") > 1, (po - chance) / (1 - chance)), "ac1"),
        r(F.when(F.col("q") > 1, (F.col("q") * po - 1) / (F.col("q") - 1)), "pabak"),
        r(F.col("top") / n, "majority"),
    )


def spearman(df: DataFrame, keys: list[str], x: str, y: str, places: int = 6) -> DataFrame:
    """Rank correlation with average ranks per group; null under three rows or without variance."""
    w = Window.partitionBy(*keys)

    def ranks(c: str) -> Column:
        return F.rank().over(w.orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, c)) - 1) / 2

    ranked = df.withColumn("__x", ranks(x)).withColumn("__y", ranks(y))
    return pearson(ranked, keys, "__x", "__y", "rho", places)


def pearson(df: DataFrame, keys: list[str], x: str, y: str, out: str = "r", places: int = 6) -> DataFrame:
    spread = F.sqrt(F.var_pop(x) * F.var_pop(y))
    r = F.when(F.count(F.lit(1)) >= 3, F.round(F.try_divide(F.covar_pop(x, y), spread), places))
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), r.alias(out))


def variance_split(df: DataFrame, group: str, value: str, places: int = 4) -> DataFrame:
    """One row: total, between-group and within-group sums of squares, and the between share."""
    per = df.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("ss"))
    t = per.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("b"))
    total, between = F.col("ss") - F.col("s") * F.col("s") / F.col("n"), F.col("b") - F.col("s") * F.col("s") / F.col("n")
    return t.select("n", F.round(total, places).alias("total"), F.round(between, places).alias("between"), F.round(total - between, places).alias("within"), F.round(between / total, 6).alias("between_share"))


def calibration(df: DataFrame, p: str, y: str, bins: int = 10, places: int = 6) -> DataFrame:
    """Reliability bins, the last one closed, empty ones kept (null means)."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("long")
    seen = df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg(p), places).alias("mean_p"), F.round(F.avg(y), places).alias("mean_y"))
    every = df.sparkSession.range(bins).select(F.col("id").alias("bin"))
    return every.join(seen, "bin", "left").na.fill(0, ["n"])


def gram(df: DataFrame, columns: list[str], y: str, places: int = 4) -> DataFrame:
    """(i, j, value): the moments that a ridge fit needs, one aggregation over all rows. Decimal columns are summed and rounded exactly, before they become doubles."""
    names = [*columns, y]
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    total = lambda c: F.round(F.sum(c), places).cast("double")
    sums = df.agg(F.count("*").cast("double").alias("n"), *[total(F.col(c)).alias(f"s_{c}") for c in names], *[total(F.col(names[i]) * F.col(names[j])).alias(f"p_{i}_{j}") for i, j in pairs])
    rows = [F.struct(F.lit("one").alias("i"), F.lit("one").alias("j"), F.col("n").alias("value"))]
    rows += [F.struct(F.lit("one").alias("i"), F.lit(c).alias("j"), F.col(f"s_{c}").alias("value")) for c in names]
    rows += [F.struct(F.lit(names[i]).alias("i"), F.lit(names[j]).alias("j"), F.col(f"p_{i}_{j}").alias("value")) for i, j in pairs]
    return sums.select(F.inline(F.array(*rows)))


def ridge(df: DataFrame, columns: list[str], y: str, penalty: float) -> dict[str, float]:
    """Ridge with an unshrunk intercept over centred columns, solved on the driver from the moments (a
    matrix of the columns' count, whatever the rows)."""
    m = {(r["i"], r["j"]): r["value"] for r in gram(df, columns, y, 12).collect()}
    n = m["one", "one"]
    names = [*columns, y]
    mean = np.array([m["one", c] / n for c in names])
    full = np.array([[m.get((a, b), m.get((b, a))) for b in names] for a in names]) - n * np.outer(mean, mean)
    w = np.linalg.solve(full[:-1, :-1] + penalty * np.eye(len(columns)), full[:-1, -1])
    return {"intercept": float(mean[-1] - w @ mean[:-1]), **dict(zip(columns, map(float, w), strict=True))}


#: The cumulative Poisson(1) probabilities that ``draws`` cuts at.
POISSON_CUTS = [0.367879441, 0.735758882, 0.919698603, 0.981011843, 0.996340153, 0.999405815, 0.999916759, 0.999989751]
PRIME = 2_147_483_647
#: ``drawn_sums``: contests and replicates that are drawn at once, groups whose sums a task holds.
BLOCK, ACROSS, MANY = 4096, 8, 1000


def _fifth(df: DataFrame, x: str, out: str) -> DataFrame:
    """Adds x^5 modulo PRIME, a permutation of its residues; all products stay below 2^62. Each power is a column of its
    own, so that it is computed once, in generated code."""
    v = F.col(x)
    df = df.withColumn("sq_", v * v % PRIME)
    df = df.withColumn("sq_", F.col("sq_") * F.col("sq_") % PRIME)
    return df.withColumn(out, F.col("sq_") * v % PRIME).drop("sq_")


def draws(contests: DataFrame, key: str, replicates: int) -> DataFrame:
    """``contests`` times replicates (replicate, times > 0): a cluster bootstrap's multiplicities, reproducible in any engine.

    Poisson(1) resampling: each contest draws its own count from integer arithmetic on (key, replicate), so replicates
    need no positions, no totals, no join and no shuffle, and a contest carries its values into its own draws.
    """
    seeds = [pow((r + 1) * 69621 % PRIME, 5, PRIME) * 39373 % PRIME for r in range(replicates)]
    each = F.expr(f"array({', '.join(f'{x}L' for x in seeds)})")  # one constant; its places are the replicates
    spread = contests.repartition(contests.sparkSession.sparkContext.defaultParallelism, key)  # before it fans out
    spread = _fifth(spread.withColumn("own_", F.pmod(F.col(key).cast("long") * 48271 + 11, F.lit(PRIME).cast("long"))), "own_", "own_").withColumn("own_", F.col("own_") * 16807 % PRIME)
    drawn = spread.select("*", F.posexplode(each).alias("at_", "x_")).select("*", F.col("at_").cast("long").alias("replicate"), ((F.col("own_") + F.col("x_")) % PRIME).alias("t_")).drop("at_", "x_")
    drawn = _fifth(drawn, "t_", "t_").where(F.col("t_") >= int(POISSON_CUTS[0] * PRIME))
    times = sum((F.when(F.col("t_") >= int(c * PRIME), 1).otherwise(0) for c in POISSON_CUTS), F.lit(0))
    return drawn.withColumn("times", times.cast("long")).drop("own_", "t_")


def _residues(x: np.ndarray) -> np.ndarray:
    """Products of residues, below 2^62, modulo PRIME = 2^31 - 1: the upper 31 bits count as much as the lower ones."""
    x = (x & PRIME) + (x >> 31)
    return x - PRIME * (x >= PRIME)


def _fifths(x: np.ndarray) -> np.ndarray:
    square = _residues(x * x)
    return _residues(_residues(square * square) * x)


def drawn_sums(contests: DataFrame, key: str, replicates: int, groups: list[str], values: list[str]) -> DataFrame:
    """(groups, replicate, values): the sums of times * value over the ``draws`` of each group that has any in a replicate, with ``drawn`` contests there.

    A draw is a number for a contest and a replicate, so a task draws a block of contests for all replicates at once and keeps one running sum for each group
    and replicate; no draw becomes a row. A task's sums leave it whenever it has met MANY groups, so neither the contests nor the groups are bounded. Null values count as 0, null keys draw nothing.
    """
    seeds = np.array([pow((r + 1) * 69621 % PRIME, 5, PRIME) * 39373 % PRIME for r in range(replicates)], np.int64)
    cuts = [int(c * PRIME) for c in POISSON_CUTS]
    kinds = [contests.schema[g].dataType.simpleString() for g in groups]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for own, sums in held.items():
                at = np.flatnonzero(sums[0])
                ids = [pa.array([x] * len(at), t) for x, t in zip(own, types, strict=True)]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(at), pa.array(sums[0, at].astype(np.int64)), *[pa.array(x[at]) for x in sums[1:]]], names=[*groups, "replicate", "drawn", *values])
            held.clear()

        for b in batches:
            types = [b.column(k).type for k in range(len(groups))]
            keyed = pa.Table.from_batches([b]).select(groups + ["one_"]).append_column("at_", pa.array(np.arange(b.num_rows)))
            for group in keyed.group_by([*groups, "one_"]).aggregate([("at_", "list")]).to_pylist():
                rows = np.array(group["at__list"])
                own = b.column("key_").to_numpy()[rows]
                seen = _fifths((own * 48271 + 11) % PRIME) * 16807 % PRIME
                value = np.stack([np.ones(len(rows)), *[b.column(f"v{k}_").to_numpy()[rows] for k in range(len(values))]])
                sums = held.setdefault(tuple(group[g] for g in groups), np.zeros((1 + len(values), replicates)))
                for lo in range(0, len(rows), BLOCK):
                    own, part = seen[lo : lo + BLOCK], value[:, lo : lo + BLOCK]
                    for r in range(0, replicates, ACROSS):
                        t = own + seeds[r : r + ACROSS, None]
                        t = _fifths(t - PRIME * (t >= PRIME)).astype(np.int32)
                        times = np.zeros(t.shape, np.int8)
                        for c in cuts:
                            times += t >= c
                        sums[0, r : r + ACROSS] += np.count_nonzero(times, axis=1)
                        sums[1:, r : r + ACROSS] += part[1:] @ times.T.astype(np.float64)
                if len(held) >= MANY:
                    yield from told()
        yield from told()

    number = [F.coalesce(F.col(v).cast("double"), F.lit(0.0)).alias(f"v{k}_") for k, v in enumerate(values)]
    slim = contests.where(F.col(key).isNotNull()).select(*groups, F.lit(0).alias("one_"), F.pmod(F.col(key).cast("long"), F.lit(PRIME).cast("long")).alias("key_"), *number)
    slim = slim.repartition(contests.sparkSession.sparkContext.defaultParallelism, "key_")
    schema = ", ".join([*[f"`{g}` {k}" for g, k in zip(groups, kinds, strict=True)], "replicate long, drawn long", *[f"`{v}` double" for v in values]])
    return slim.mapInArrow(run, schema).groupBy(*groups, "replicate").agg(F.sum("drawn").alias("drawn"), *[F.sum(v).alias(v) for v in values])


def draws_sql(source: str, key: str, replicates: int, columns: str) -> str:
    """The CTEs of ``draws`` over ``source``; the last is dr."""
    fifth = lambda x: f"(({x}) * ({x}) % {PRIME}) * (({x}) * ({x}) % {PRIME}) % {PRIME} * ({x}) % {PRIME}"
    times = " + ".join(f"CASE WHEN v >= {int(c * PRIME)} THEN 1 ELSE 0 END" for c in POISSON_CUTS)
    return f"""dk AS (SELECT *, {fifth("o")} AS own FROM (SELECT *, (CAST({key} AS BIGINT) * 48271 + 11) % {PRIME} AS o FROM {source})),
dp AS (SELECT replicate, {fifth("o")} AS rep FROM (SELECT replicate, (replicate + 1) * 69621 % {PRIME} AS o FROM (SELECT unnest(range({replicates})) AS replicate))),
dx AS (SELECT {key}, {columns}, replicate, (own * 16807 + rep * 39373) % {PRIME} AS w FROM dk, dp),
dr AS (SELECT {key}, {columns}, replicate, {times} AS times FROM (SELECT *, {fifth("w")} AS v FROM dx) WHERE v >= {int(POISSON_CUTS[0] * PRIME)})"""


def exact_median(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """(keys, out), or one row (out): the exact median of the non-null values, without a task that holds a group.

    Counts of distinct values are dealt by range; running counts go within the ranges and are shifted by the counts of the ranges before.
    """
    by = keys or ["one_"]
    rows = df if keys else df.withColumn("one_", F.lit(0))
    counted = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n_"))
    parts = durable(counted.repartitionByRange(*by, value).withColumn("part_", F.spark_partition_id()))
    sums = durable(parts.groupBy(*by, "part_").agg(F.sum("n_").alias("s_")))
    w = Window.partitionBy(*by).orderBy("part_")
    before = sums.select(*by, "part_", (F.sum("s_").over(w) - F.col("s_")).alias("before_"), F.sum("s_").over(Window.partitionBy(*by)).alias("all_"))
    run = Window.partitionBy(*by, "part_").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    at = join_small(parts.withColumn("upto_", F.sum("n_").over(run)), durable(before), [*by, "part_"]).withColumn("upto_", F.col("upto_") + F.col("before_"))
    reach = lambda k: F.min(F.when(F.col("upto_") >= k, F.col(value)))
    middle = (reach(F.floor((F.col("all_") + 1) / 2)) + reach(F.floor(F.col("all_") / 2) + 1)) / 2
    return at.groupBy(*by).agg(middle.alias(out)).select(*keys, out)


def quota_by_hash(df: DataFrame, quotas: DataFrame, stratum: str, key: str, slices: int = 64) -> DataFrame:
    """The first ``quota`` rows of each stratum (quotas: stratum, quota) in sha256 order of the key, with their place.

    A stratum is cut into slices of its hash range, counted first; only slices that the quota reaches are ranked, each
    in a task of its own, so a stratum with a third of all rows is not sorted as a whole.
    """
    h = F.sha2(F.col(key).cast("string"), 256)
    sliced = df.withColumn("h_", h).withColumn("slice_", F.floor(F.conv(F.substring("h_", 1, 8), 16, 10).cast("double") / 4294967296.0 * slices).cast("int"))
    sizes = durable(sliced.groupBy(stratum, "slice_").agg(F.count("*").alias("n_")))
    w = Window.partitionBy(stratum).orderBy("slice_")
    wanted = sizes.withColumn("before_", F.sum("n_").over(w) - F.col("n_")).join(quotas, stratum).where("before_ < quota").select(stratum, "slice_", "before_", "quota")
    ranked = join_small(sliced, durable(wanted), [stratum, "slice_"], "inner")
    place = F.row_number().over(Window.partitionBy(stratum, "slice_").orderBy("h_", key)) + F.col("before_")
    return ranked.withColumn("place", place.cast("long")).where("place <= quota").drop("h_", "slice_", "before_")


def largest_remainder(groups: DataFrame, key: str, size: str, seats: int) -> DataFrame:
    """Proportional allocation: floors first, then the largest remainders, ties by key."""
    total = F.sum(size).over(Window.partitionBy(F.lit(0)))  # one row per group
    q = groups.withColumn("__q", seats * F.col(size) / total).withColumn("__f", F.floor("__q"))
    left = seats - F.sum("__f").over(Window.partitionBy(F.lit(0)))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(F.round(F.col("__q") - F.col("__f"), 9)), key))
    return q.withColumn("seats", (F.col("__f") + F.when(place <= left, 1).otherwise(0)).cast("long")).drop("__q", "__f")


def hash_quota(df: DataFrame, strata: list[str], key: str, quota: int, salt: str = "") -> DataFrame:
    """The first ``quota`` rows of each stratum in sha256 order of the key: the same sample everywhere."""
    w = Window.partitionBy(*strata).orderBy(F.sha2(F.concat(F.lit(salt), F.col(key).cast("string")), 256), key)
    return df.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= quota)
