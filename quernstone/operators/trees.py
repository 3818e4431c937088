"""Boosted regression trees grown by aggregations, and exact Shapley contributions of their paths.

Values are cut into bins once, at quantiles of an equal-width histogram of CELLS cells (one pass for the range, one for the counts). Then each level of
each tree is one aggregation: residuals summed by (node, feature, bin), with map-side combining, so what reaches the driver is bounded by
nodes x features x bins whatever the rows; splits are chosen there. Targets, predictions and residuals are integers (units of 1 / UNIT), so
sums and therefore splits are the same for any partitioning. Predictions are carried as expressions over the bins and written every STRIDE trees.

Defined results: a null feature value has a bin of its own, the least; rows with a null target are not learned from; of equal gains the first feature and
the lowest bin win; a node without a split that leaves LEAST rows on both sides is a leaf; no rows at all give trees of one leaf with value 0.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations
from math import factorial, floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.plans.durable import durable

UNIT = 1024
CELLS = 1024
STRIDE = 8


@dataclass
class Node:
    """A leaf if ``feature`` is None; else rows whose bin of ``feature`` is at most ``bin`` go left."""

    cover: int
    value: int = 0
    feature: int | None = None
    bin: int = 0
    left: Node | None = None
    right: Node | None = None


@dataclass
class Model:
    features: list[str]
    edges: list[list[float]]
    base: int
    trees: list[Node] = field(default_factory=list)
    errors: list[float] = field(default_factory=list)  # mean absolute error on the held-out rows, by number of trees


def bin_edges(df: DataFrame, features: list[str], bins: int) -> list[list[float]]:
    """For each feature at most bins - 1 upper bounds of bins: cell borders that first reach each share of the rows."""
    f = [F.col(c).cast("double") for c in features]
    ends = df.agg(*[F.min(c).alias(f"a{i}") for i, c in enumerate(f)], *[F.max(c).alias(f"b{i}") for i, c in enumerate(f)]).first()
    width = [((ends[f"b{i}"] - ends[f"a{i}"]) / CELLS if ends[f"a{i}"] is not None else 0.0) for i in range(len(f))]
    cell = [F.least(F.floor((c - ends[f"a{i}"]) / width[i]), F.lit(CELLS - 1)) if width[i] else F.lit(0) for i, c in enumerate(f)]
    pairs = F.array(*[F.struct(F.lit(i).alias("f"), F.when(c.isNotNull(), cell[i]).cast("long").alias("cell")) for i, c in enumerate(f)])
    counts = df.select(F.explode(pairs).alias("p")).where("p.cell is not null").groupBy("p.f", "p.cell").agg(F.count("*").alias("n")).collect()
    out = []
    for i in range(len(f)):
        own = sorted((r["cell"], r["n"]) for r in counts if r["f"] == i)
        total, run, found = sum(n for _, n in own), 0, []
        for at, n in own[:-1]:
            before, run = run, run + n
            if run * bins // total > before * bins // total:
                found.append(ends[f"a{i}"] + (at + 1) * width[i])
        out.append(found)
    return out


def binned(features: list[str], edges: list[list[float]]) -> Column:
    """The row's bins as an array: 0 for null, else 1 and the number of edges that are at most the value."""
    one = lambda c, own: F.when(c.isNull(), 0).otherwise(sum(((c >= F.lit(e)).cast("int") for e in own), F.lit(1)))
    return F.array(*[one(F.col(c).cast("double"), own).cast("int") for c, own in zip(features, edges, strict=True)])


def walk(node: Node, leaf, bins: Column) -> Column:
    """The tree as an expression over the bins; ``leaf`` tells a leaf's value."""
    if node.feature is None:
        return F.lit(leaf(node))
    return F.when(F.get(bins, F.lit(node.feature)) <= node.bin, walk(node.left, leaf, bins)).otherwise(walk(node.right, leaf, bins))


def leaves(node: Node) -> list[Node]:
    return [node] if node.feature is None else leaves(node.left) + leaves(node.right)


def best_split(histogram: dict[tuple[int, int], tuple[int, int]], features: int, least: int) -> tuple[int, int] | None:
    """(feature, bin) of the split that lowers the squared error most; None if none does with ``least`` rows a side."""
    score = lambda s, n: float(s) * float(s) / n
    best, found = None, None
    for f in range(features):
        own = sorted((b, s, n) for (g, b), (s, n) in histogram.items() if g == f)
        total, rows = sum(x[1] for x in own), sum(x[2] for x in own)
        if best is None and rows:
            best = score(total, rows)
        s = n = 0
        for b, part, count in own[:-1]:
            s, n = s + part, n + count
            if n >= least and rows - n >= least and score(s, n) + score(total - s, rows - n) > best:
                best, found = score(s, n) + score(total - s, rows - n), (f, b)
    return found


def mean_of(total: int, rows: int, rate: float = 1.0) -> int:
    return floor(rate * total / rows + 0.5) if rows else 0


def fit(df: DataFrame, features: list[str], y: str, rounds: int, depth: int = 2, bins: int = 16, rate: float = 0.3, least: int = 20, held_out: Column | None = None, patience: int | None = None) -> Model:
    """Trees on ``df``; rows for which ``held_out`` is true are only measured, and growing stops when their error has not fallen for ``patience`` trees."""
    hold = F.coalesce(held_out, F.lit(False)) if held_out is not None else F.lit(False)
    learned = df.where(F.col(y).isNotNull())
    edges = bin_edges(learned.where(~hold), features, bins)
    rows = durable(learned.select(binned(features, edges).alias("bins"), F.round(F.col(y) * UNIT).cast("long").alias("y"), hold.alias("held")))
    total = rows.where(~F.col("held")).agg(F.sum("y").alias("s"), F.count("*").alias("n")).first()
    model = Model(features, edges, mean_of(total["s"], total["n"]))
    rows = rows.withColumn("r", F.col("y") - F.lit(model.base))
    best = 0

    def measure() -> float | None:
        row = rows.where("held").agg(F.sum(F.abs("r")).alias("s"), F.count("*").alias("n")).first()
        return row["s"] / row["n"] / UNIT if row["n"] else None

    for k in range(rounds):
        if held_out is not None:
            error = measure()
            if error is None:
                break
            model.errors.append(error)
            best = k if error < model.errors[best] else best
            if patience is not None and k - best >= patience:
                break
        root = Node(total["n"])
        for level in range(depth):
            open_ = [leaf for leaf in leaves(root) if level == 0 or leaf.cover >= 2 * least]
            number = {id(leaf): i for i, leaf in enumerate(open_)}
            node = walk(root, lambda leaf, number=number: number.get(id(leaf), -1), F.col("bins"))
            at = rows.where(~F.col("held")).select(node.alias("node"), "r", "bins").where("node >= 0").select("node", "r", F.posexplode("bins").alias("f", "bin"))
            found = at.groupBy("node", "f", "bin").agg(F.sum("r").alias("s"), F.count("*").alias("n")).collect()
            for i, leaf in enumerate(open_):
                own = {(x["f"], x["bin"]): (x["s"], x["n"]) for x in found if x["node"] == i}
                sums = [v for (f, _), v in own.items() if f == 0]
                s, n = sum(v[0] for v in sums), sum(v[1] for v in sums)
                leaf.cover, leaf.value = n, mean_of(s, n, rate)
                split = best_split(own, len(features), least)
                if split is None:
                    continue
                leaf.feature, leaf.bin = split
                for side, test in (("left", lambda b: b <= leaf.bin), ("right", lambda b: b > leaf.bin)):  # noqa: B023
                    part = [v for (f, b), v in own.items() if f == leaf.feature and test(b)]
                    s, n = sum(v[0] for v in part), sum(v[1] for v in part)
                    setattr(leaf, side, Node(n, mean_of(s, n, rate)))
        model.trees.append(root)
        rows = rows.withColumn("r", F.col("r") - walk(root, lambda leaf: leaf.value, F.col("bins")))
        if (k + 1) % STRIDE == 0:
            rows = durable(rows)
    if held_out is not None:
        if len(model.errors) == len(model.trees) and (error := measure()) is not None:
            model.errors.append(error)
        best = min(range(len(model.errors)), key=model.errors.__getitem__, default=0)
        model.trees = model.trees[:best]
    return model


def fit_with_early_stop(df: DataFrame, features: list[str], y: str, date: str, rounds: int, patience: int, least_inner: int, default_rounds: int, **sizes) -> Model:
    """The number of trees is the one with the least error on the last date (after the first) that has ``least_inner`` rows, learned from the
    dates before it; then all of ``df`` is learned from with that many. Without such a date, or where no tree helps, ``default_rounds``."""
    days = df.groupBy(date).agg(F.count("*").alias("n"))
    first = days.agg(F.min(date)).first()[0]
    day = days.where((F.col(date) > F.lit(first)) & (F.col("n") >= least_inner)).agg(F.max(date)).first()[0] if first is not None else None
    best, errors = 0, []
    if day is not None:
        inner = fit(df.where(F.col(date) <= F.lit(day)), features, y, rounds, held_out=F.col(date) == F.lit(day), patience=patience, **sizes)
        best, errors = len(inner.trees), inner.errors
    model = fit(df, features, y, best or default_rounds, **sizes)
    model.errors = errors
    return model


def predicted(model: Model) -> Column:
    """The prediction as an expression over the features' columns."""
    bins = binned(model.features, model.edges)
    per_tree = lambda b: sum((walk(t, lambda leaf: leaf.value, b) for t in model.trees), F.lit(model.base))
    return F.get(F.transform(F.array(bins), per_tree), F.lit(0)) / F.lit(float(UNIT))


# contributions


def paths(node: Node, conditions=()) -> list[tuple[Node, dict[int, tuple[list[tuple[int, bool]], float]]]]:
    """(leaf, {feature: (its conditions (bin, left?) on the way, share of the covers that they pass)}) of every leaf."""
    if node.feature is None:
        by: dict[int, tuple[list, float]] = {}
        for f, b, left, part in conditions:
            own = by.get(f, ([], 1.0))
            by[f] = ([*own[0], (b, left)], own[1] * part)
        return [(node, by)]
    out = []
    for child, left in ((node.left, True), (node.right, False)):
        out += paths(child, (*conditions, (node.feature, node.bin, left, child.cover / node.cover)))
    return out


def path_weights(shares: list[float], met: int) -> list[float]:
    """Each feature's Shapley share of a leaf of value 1, whose path has the cover shares ``shares``, for a row that meets the
    conditions of the features whose bits are set in ``met``: unmet or unknown ones let through what their covers say."""
    m, out = len(shares), []
    o = [met >> k & 1 for k in range(m)]
    for j in range(m):
        others, total = [k for k in range(m) if k != j], 0.0
        for size in range(m):
            weight = factorial(size) * factorial(m - size - 1) / factorial(m)
            for known in combinations(others, size):
                part = weight
                for k in others:
                    part *= o[k] if k in known else shares[k]
                total += part * (o[j] - shares[j])
        out.append(total)
    return out


def mean_prediction(model: Model) -> float:
    """The trees' mean over the rows that they were grown on."""
    return (model.base + sum(sum(leaf.value * leaf.cover for leaf in leaves(t)) / t.cover for t in model.trees if t.cover)) / UNIT


def contributions(model: Model) -> dict[str, Column]:
    """feature -> its exact contribution to the row's prediction; they and ``mean_prediction`` add up to it.

    A leaf's contributions depend on the row only through which features' conditions it meets on the way there, so each leaf is a table of 2^m constants,
    m the features on its path, looked up by expression.
    """
    terms: dict[int, list] = {}
    for tree in model.trees:
        for leaf, by in paths(tree):
            names = list(by)
            table = [path_weights([by[f][1] for f in names], met) for met in range(1 << len(names))]
            for j, f in enumerate(names):
                terms.setdefault(f, []).append((names, by, [leaf.value * w[j] / UNIT for w in table]))

    def of(f: int, bins: Column) -> Column:
        """The feature's part in all trees."""
        total = F.lit(0.0)
        for names, by, values in terms.get(f, []):
            at = F.lit(1)
            for k, g in enumerate(names):
                met = F.lit(True)
                for b, left in by[g][0]:
                    met = met & ((F.get(bins, F.lit(g)) <= b) if left else (F.get(bins, F.lit(g)) > b))
                at = at + met.cast("int") * (1 << k)
            total = total + F.element_at(F.array(*[F.lit(float(v)) for v in values]), at)
        return total

    bins = binned(model.features, model.edges)
    once = lambda i: F.get(F.transform(F.array(bins), lambda b: of(i, b)), F.lit(0))  # noqa: E731  the bins are told once per row
    return {c: once(i) for i, c in enumerate(model.features)}
