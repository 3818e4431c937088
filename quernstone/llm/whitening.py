"""Whitening of embedding vectors through a bidiagonal qd solver.

Sums by dimension come first, as exact integers. Rows are then centred exactly (n x - S, divided by n once) and reduced by blockwise QR: every
task folds its batches into one triangular factor, and factors are folded STACK at a time until one is left, so
only d by d numbers ever leave a task or reach the driver, d being the vectors' length. Householder reflections bring that factor to a bidiagonal,
whose squared singular values the differential qd algorithm with shifts (dqds) finds to high relative accuracy, and
twisted factorisations of the shifted bidiagonal's product give each one's vector: stationary from the top, progressive from the bottom,
joined where the pivot is least. Vectors of values too close for that are made orthogonal within their cluster by inverse
iteration with the same factors. A last pass over the rows projects them; the whitened rows' covariance is summed and reported.

Defined results: rows whose vector is null or empty, or holds null, NaN or infinite entries, are dropped, and so are vectors whose length is not
the commonest one (of equally common ones the least); components whose singular value is within rounding of 0 (rank deficiency, fewer
rows than dimensions, constant dimensions) do not exist, so a table of equal rows or of one row gives an empty table, as an empty
one does; equal eigenvalues share their space by any orthonormal vectors; a null vec_id is reported; repeated rows each count; a
deviation beyond a 64-bit integer is null; entries beyond 2^40 are outside the exact range and cut to it; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.plans.durable import durable

COMPONENTS = 8
STEP, OFFSET = 1024.0, 100_000
LIMIT = float(1 << 40)
STACK = 16
EPS = np.finfo(np.float64).eps
#: eigenvalues whose relative distance is below this are a cluster
CLOSE = 1e-3


# blocks of rows


def whole(batch: pa.RecordBatch, vector: str) -> tuple[pa.Array, pa.Array]:
    """(mask of usable rows, the usable vectors as lists of doubles)."""
    lists = batch.column(batch.schema.get_field_index(vector)).cast(pa.list_(pa.float64()))
    flat = lists.flatten()
    parents = lists.value_parent_indices() if hasattr(lists, "value_parent_indices") else pc.list_parent_indices(lists)
    good = pc.fill_null(pc.is_finite(flat), False).to_numpy(zero_copy_only=False)
    bad_rows = np.zeros(len(lists), dtype=bool)
    bad_rows[parents.to_numpy()[~good]] = True
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    keep = pa.array((sizes > 0) & ~bad_rows)
    return keep, lists.filter(keep)


def integers(batch: pa.RecordBatch, vector: str, size: int | None) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """(rows' numbers by length, x by length): the integer form of the usable vectors of length ``size``, or of every length."""
    keep, lists = whole(batch, vector)
    lengths, rows = pc.list_value_length(lists).to_numpy(), np.flatnonzero(keep.to_numpy(zero_copy_only=False))
    at, out = {}, {}
    for n in np.unique(lengths) if size is None else [size]:
        own = lengths == n
        c = lists.filter(pa.array(own)).flatten().to_numpy().reshape(-1, int(n))
        out[int(n)] = np.clip(np.floor(STEP * c), -LIMIT, LIMIT).astype(np.int64) + OFFSET
        at[int(n)] = rows[own]
    return at, out


def sums_by_dimension(vector: str):
    schema = pa.schema([("size", pa.int32()), ("dim", pa.int32()), ("n", pa.int64()), ("s", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, tuple[int, np.ndarray]] = {}
        for b in batches:
            for size, x in integers(b, vector, None)[1].items():
                n, s = total.get(size, (0, np.zeros(size, dtype=np.int64)))
                total[size] = (n + len(x), s + x.sum(axis=0))
        for size, (n, s) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([size] * size, pa.int32()), pa.array(range(size), pa.int32()), pa.array([n] * size, pa.int64()), pa.array(s)], schema=schema)

    return run


def centred(x: np.ndarray, n: int, s: np.ndarray) -> np.ndarray:
    """x - S / n, rounded once where n x - S fits a double."""
    return (n * x - s).astype(np.float64) / n


FACTOR = pa.schema([("part", pa.int64()), ("r", pa.list_(pa.float64()))])


def triangular(blocks: Iterator[np.ndarray], d: int) -> np.ndarray:
    r = np.zeros((0, d))
    for b in blocks:
        r = np.linalg.qr(np.vstack([r, b]), mode="r")
    return r


def factors(vector: str, n: int, s: np.ndarray):
    d = len(s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        r = triangular((centred(integers(b, vector, d)[1][d], n, s) for b in batches), d)
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([r.ravel().tolist()], pa.list_(pa.float64()))], schema=FACTOR)

    return run


def stacked(d: int):
    def run(parts: pa.Table) -> pa.Table:
        r = triangular((np.array(x.as_py()).reshape(-1, d) for x in parts["r"]), d)
        return pa.Table.from_arrays([pa.array([parts["part"][0].as_py() // STACK], pa.int64()), pa.array([r.ravel().tolist()], pa.list_(pa.float64()))], schema=FACTOR)

    return run


def r_factor(rows: DataFrame, vector: str, n: int, s: np.ndarray) -> np.ndarray:
    """The d by d triangular factor of all centred rows: a tree of QR reductions, STACK factors a node."""
    level = durable(rows.mapInArrow(factors(vector, n, s), "part long, r array<double>"))
    while level.agg(F.max("part")).first()[0] > 0:
        level = durable(level.groupBy(F.floor(F.col("part") / STACK)).applyInArrow(stacked(len(s)), "part long, r array<double>"))
    return np.array(level.first()["r"]).reshape(-1, len(s))


# the solver


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, superdiagonal, v) with u' r v bidiagonal: Householder reflections from both sides; only v is kept."""
    m, d = r.shape
    a = np.vstack([r, np.zeros((d - m, d))]) if m < d else r.copy()
    v = np.eye(d)

    def reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
        scale = np.abs(x).max(initial=0.0)
        if scale == 0:
            return x, 0.0
        u = x / scale
        u[0] += np.copysign(np.linalg.norm(u), u[0])
        return u, 2.0 / (u @ u)

    for k in range(d):
        u, t = reflector(a[k:, k].copy())
        a[k:, k:] -= t * np.outer(u, u @ a[k:, k:])
        if k < d - 2:
            u, t = reflector(a[k, k + 1 :].copy())
            a[k:, k + 1 :] -= t * np.outer(a[k:, k + 1 :] @ u, u)
            v[:, k + 1 :] -= t * np.outer(v[:, k + 1 :] @ u, u)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def dqds(q: list[float], e: list[float]) -> list[float]:
    """Eigenvalues of B'B for the upper bidiagonal B with squared diagonal ``q`` and squared superdiagonal ``e``.

    Each sweep takes a shift below the least eigenvalue: the reciprocal of the trace of (B'B)^-1, which is Newton's bound; a sweep that still meets a
    negative value (by rounding) is done again with a smaller shift. The last entry is an eigenvalue when the one above it has vanished.
    """
    found, parts = [], [(list(q), list(e), 0.0)]
    while parts:
        q, e, moved = parts.pop()
        while len(q) > 1:
            small = EPS * EPS
            cut = next((i for i in range(len(e) - 1, -1, -1) if e[i] <= small * (moved + min(q[i], q[i + 1])) or e[i] <= small * EPS * (moved + max(q))), None)
            if cut is not None:
                parts.append((q[: cut + 1], e[:cut], moved))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            if q[0] < q[-1]:  # graded upwards: turned round, small values come out first
                q, e = q[::-1], e[::-1]
                q, e = _turned(q, e)
            inverse, f = 0.0, 0.0
            for i, x in enumerate(q):
                if x <= 0:
                    inverse = float("inf")
                    break
                f = (1.0 + f * e[i - 1]) / x if i else 1.0 / x
                inverse += f
            shift = (1 - 4 * len(q) * EPS) / inverse if inverse > 0 else 0.0
            while (out := sweep(q, e, shift)) is None:
                shift = 0.0 if shift < EPS * moved else shift / 4
            q, e = out
            moved += shift
        found += [moved + x for x in q]
    return sorted(found, reverse=True)


def _turned(q: list[float], e: list[float]) -> tuple[list[float], list[float]]:
    """The array of the reversed bidiagonal, which is lower, as an upper one with the same singular values: one dqd sweep of it."""
    out_q, out_e, d = [], [], q[0]
    for i in range(len(e)):
        total = d + e[i]
        out_q.append(total)
        out_e.append(q[i + 1] * (e[i] / total) if total else 0.0)
        d = q[i + 1] * (d / total) if total else 0.0
    return [*out_q, d], out_e


def sweep(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float]] | None:
    """One dqds transform; None if the shift was beyond the least eigenvalue."""
    out_q, out_e, d = [], [], q[0] - shift
    for i in range(len(e)):
        if d < 0:
            return None
        total = d + e[i]
        if total == 0:
            out_q.append(0.0)
            out_e.append(0.0)
            d = q[i + 1] - shift
            continue
        t = q[i + 1] / total
        out_q.append(total)
        out_e.append(e[i] * t)
        d = d * t - shift
    return ([*out_q, d], out_e) if d >= 0 else None


class Twisted:
    """B'B - value, with B'B = L diag(q) L', factored from the top and from the bottom and joined at the least pivot."""

    def __init__(self, q: np.ndarray, low: np.ndarray, value: float):
        n = len(q)
        tiny = EPS * EPS * max(q.max(), abs(value))
        safe = lambda x: x if abs(x) > tiny else np.copysign(tiny, x)
        s, p = np.empty(n), np.empty(n)
        self.l, self.u = np.empty(n - 1), np.empty(n - 1)
        self.top, self.bottom = np.empty(n), np.empty(n)
        s[0] = -value
        for i in range(n):
            self.top[i] = safe(s[i] + q[i])
            if i < n - 1:
                self.l[i] = q[i] * low[i] / self.top[i]
                s[i + 1] = self.l[i] * low[i] * s[i] - value
        p[-1] = q[-1] - value
        for i in range(n - 2, -1, -1):
            self.bottom[i + 1] = safe(q[i] * low[i] * low[i] + p[i + 1])
            t = q[i] / self.bottom[i + 1]
            self.u[i] = low[i] * t
            p[i] = p[i + 1] * t - value
        gamma = s + p + value
        self.r = int(np.argmin(np.abs(gamma)))
        self.pivot = safe(gamma[self.r])

    def vector(self) -> np.ndarray:
        """The null vector of the factored matrix but for its least pivot."""
        return self.back(np.eye(1, len(self.top), self.r)[0])

    def back(self, z: np.ndarray) -> np.ndarray:
        """The solution of N' x = z, N the twisted unit factor."""
        x = z.copy()
        for i in range(self.r - 1, -1, -1):
            x[i] -= self.l[i] * x[i + 1]
        for i in range(self.r, len(x) - 1):
            x[i + 1] -= self.u[i] * x[i]
        return x / np.linalg.norm(x)

    def solve(self, b: np.ndarray) -> np.ndarray:
        """The direction of (B'B - value)^-1 b."""
        y = b.copy()
        for i in range(self.r):
            y[i + 1] -= self.l[i] * y[i]
        for i in range(len(y) - 2, self.r - 1, -1):
            y[i] -= self.u[i] * y[i + 1]
        y[: self.r] /= self.top[: self.r]
        y[self.r] /= self.pivot
        y[self.r + 1 :] /= self.bottom[self.r + 1 :]
        return self.back(y / np.abs(y).max())


def right_vectors(diagonal: np.ndarray, above: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(squared singular values, falling; right singular vectors as columns) of the bidiagonal: at most ``count``, none within rounding of 0."""
    n = len(diagonal)
    q, e = diagonal**2, above**2
    every = np.array(dqds(q.tolist(), e.tolist()))
    biggest = every.max(initial=0.0)
    values = every[:count]
    values = values[values > biggest * (n * EPS) ** 2 * 16]
    # a block ends where the bidiagonal does: a vanished entry above the diagonal, or a vanished diagonal entry
    least = EPS * np.sqrt(biggest)
    floor = np.where(np.abs(diagonal) > least, diagonal, least)
    beside = np.minimum(np.abs(diagonal[:-1]), np.abs(diagonal[1:]))
    ends = [0, *(np.flatnonzero(np.abs(above) <= EPS * np.maximum(beside, least)) + 1), n]
    rng = np.random.default_rng(0)
    out = np.zeros((n, len(values)))
    for k, value in enumerate(values):
        best = None
        cluster = [j for j in range(k) if values[j] - value <= CLOSE * values[j]]
        for a, b in zip(ends, ends[1:], strict=False):
            own_q, low = floor[a:b] ** 2, above[a : b - 1] / floor[a : b - 1]
            if b - a == 1:
                z = np.ones(1)
            else:
                factored = Twisted(own_q, low, value)
                z = factored.vector()
            near = out[a:b, cluster]
            z = z - near @ (near.T @ z)
            if cluster and np.linalg.norm(z) < 0.99 and b - a > 1:
                z = rng.standard_normal(b - a)
                for step in range(6):
                    z = z - near @ (near.T @ z)
                    size = np.linalg.norm(z)
                    if size < 1e-6:  # the cluster has taken all of this block
                        break
                    z = factored.solve(z / size) if step < 4 else z / size
            if np.linalg.norm(z) < 0.5:
                continue
            z = z / np.linalg.norm(z)
            y = floor[a:b] * z
            y[:-1] += above[a : b - 1] * z[1:]
            g = floor[a:b] * y
            g[1:] += above[a : b - 1] * y[:-1]
            miss = np.linalg.norm(g - value * z)
            if best is None or miss < best[0]:
                best = (miss, a, b, z)
        out[best[1] : best[2], k] = best[3]
    return values, out


def components(r: np.ndarray, n: int, count: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues, falling; unit eigenvectors as columns; trace) of r'r / n: at most ``count``."""
    scale = np.abs(r).max(initial=0.0)
    if scale == 0:
        return np.zeros(0), np.zeros((r.shape[1], 0)), 0.0
    diagonal, above, v = bidiagonal(r / scale)
    values, z = right_vectors(diagonal, above, count)
    return values * scale * scale / n, v @ z, float(((r / scale) ** 2).sum()) * scale * scale / n


# the operator


def projector(vector: str, columns: int, n: int, s: np.ndarray, directions: np.ndarray, roots: np.ndarray):
    d = len(s)

    def deviations(x: np.ndarray) -> pa.Array:
        y = n * x - s
        if (np.abs(y).max(initial=0).astype(np.float64) ** 2) * d < 2.0**62:
            return pa.array((y * y).sum(axis=1))
        exact = [sum(int(v) * int(v) for v in row) for row in n * x.astype(object) - s.astype(object)]
        return pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, found = integers(b, vector, d)
            w = centred(found[d], n, s) @ directions / roots
            kept = b.take(pa.array(at[d]))
            lists = pa.FixedSizeListArray.from_arrays(pa.array(w.ravel()), w.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*kept.columns[:columns], deviations(found[d]), lists], names=[*kept.schema.names[:columns], "deviation", "whitened"])

    return run


def whiten(rows: DataFrame, vector: str = "embedding", ids: tuple[str, ...] = ("vec_id",), count: int = COMPONENTS) -> DataFrame:
    """``ids``, n, deviation, whitened (an array, one entry a component), explained (likewise), identity_error: one row per usable vector."""
    empty = [*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*ids).schema], "n long, deviation long, whitened array<double>, explained array<double>, identity_error double"]
    slim = rows.select(*[F.col(f"`{c}`") for c in ids], F.col(f"`{vector}`"))
    sums = slim.select(F.col(f"`{vector}`").alias("vector")).mapInArrow(sums_by_dimension("vector"), "size int, dim int, n long, s long")
    sums = durable(sums.groupBy("size", "dim").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(28,0)")).alias("s")))
    best = sums.where("dim = 0").orderBy(F.col("n").desc(), "size").first()
    if best is None:
        return rows.sparkSession.createDataFrame([], ", ".join(empty))
    n = best["n"]
    s = np.array([int(r["s"]) for r in sums.where(F.col("size") == best["size"]).orderBy("dim").collect()], dtype=np.int64)
    r = r_factor(slim.select(F.col(f"`{vector}`").alias("vector")), "vector", n, s)
    values, directions, trace = components(r, n, count)
    if not len(values):
        return rows.sparkSession.createDataFrame([], ", ".join(empty))
    kinds = slim.toDF(*[f"c{i}" for i in range(len(ids))], "vector")
    shape = ", ".join([f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(rows.select(*ids).schema)] + ["deviation long, whitened array<double>"])
    out = durable(kinds.mapInArrow(projector("vector", len(ids), n, s, directions, np.sqrt(values)), shape))
    w = lambda i: F.element_at("whitened", i + 1)
    k = range(len(values))
    means = out.agg(*[F.avg(w(i)).alias(f"m{i}") for i in k]).first()
    moments = out.agg(*[F.avg((w(i) - means[i]) * (w(j) - means[j])).alias(f"c{i}_{j}") for i in k for j in range(i, len(values))]).first()
    error = max(abs(moments[f"c{i}_{j}"] - (i == j)) for i in k for j in range(i, len(values)))
    explained = F.array(*[F.lit(float(v / trace)) for v in values])
    named = out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(ids)], F.lit(n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"))
    return named.withColumn("identity_error", F.lit(float(error)))


def long_form(found: DataFrame, ids: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    """One row per vector and component."""
    each = F.posexplode(F.arrays_zip("whitened", "explained")).alias("k", "v")
    return found.select(*ids, "n", "deviation", "identity_error", each).select(*ids, (F.col("k") + 1).alias("component"), "n", "deviation", "v.whitened", "v.explained", "identity_error")
