"""Toxicity by class-conditional Kneser-Ney models over the bytes of words.

The models predict each byte of a word from up to ORDER - 1 bytes before it in the same word (and the word
start). Toxic and ordinary counts are kept apart at the full order and both back off to one shared
distribution of lower orders, whose continuation counts come from all documents, labelled or not; so a rare
expression that only one class has shown is judged by its context, and what neither has shown says nothing.
A document's evidence is the difference of both log-likelihoods, per byte (length-normalised) and per square
root of bytes (its signal against chance), and the same sums over single bytes whose ratio is above STRONG, where a
few toxic words of a long ordinary text show; a logistic curve over them, fitted on labelled documents that
the models have not counted, turns it into a score.

Counting is one pass over Arrow batches that yields (n-gram, counts) rows, summed by Spark; all smoothing is
joins and aggregations by n-gram. Every n-gram keeps its own log ratio, in units of 1 / UNIT so that sums are exact in
any order. The most frequent ones, at most MAX_KEYS, are broadcast; a text's counts of all others meet their ratios in a
shuffled join by n-gram, whose keys are rare, so the table grows with the corpus and no ratio depends on its size.

Labels are learned from rows with crc32(doc_id) mod 5 in 1-3 (models) and 4 (curve, a sample of at most
MAX_FIT rows); rows with 0 are held out. Without labels of both classes every score is 0.5's prior side: the
share of toxic labels, or 0 without any.

Defined results: a null text counts as empty, an empty text gets the score of no evidence; a null doc_id is
scored but never learned from; repeated rows are scored alike; an empty table gives an empty table; further
columns and other label columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.shingles import text_chunks
from quernstone.plans.durable import durable, join_small

ORDER = 6
DISCOUNT = 0.75
MAX_KEYS = 1 << 22
UNIT = 1 << 24
MAX_FIT = 20_000
STRONG = 2.5
MAX_LABELS_BROADCAST = 1_000_000

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
for _c in range(128):
    if not chr(_c).isalnum():
        _FOLD[_c] = 32


def _ngrams(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The packed n-gram that ends at each byte of a word, and its row. The word start is a space; bytes
    before it are zero."""
    b = _FOLD[data]
    first = np.zeros(len(b) + 1, dtype=bool)
    first[cuts] = True
    first = first[:-1]
    rows = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    key = b.astype(np.uint64)
    open_ = (b != 32) & ~first  # whether the byte before belongs to the context
    begun = (b != 32) & first
    key[begun] |= np.uint64(32 << 8)
    for k in range(1, ORDER):
        before = np.zeros(len(b), dtype=np.uint64)
        before[k:] = b[:-k] if k < len(b) else 0
        key |= np.where(open_, before << np.uint64(8 * k), np.uint64(0))
        if k + 1 < ORDER:
            starts = np.zeros(len(b), dtype=bool)
            starts[k:] = first[:-k] if k < len(b) else False
            stop = open_ & starts
            key[stop] |= np.uint64(32 << (8 * (k + 1)))
            spaced = np.zeros(len(b), dtype=bool)
            spaced[k:] = b[:-k] == 32 if k < len(b) else False
            open_ &= ~starts & ~spaced
    word = b != 32
    return key[word], rows[word]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, class) -> (key, n, toxic, ordinary), summed within the task."""
    keys, sums, held = [], [], 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        k, at = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.concatenate(sums)
        return k, np.stack([np.bincount(at, n[:, i], len(k)).astype(np.int64) for i in range(3)], axis=1)

    for batch in batches:
        kind = batch.column(1).to_numpy(zero_copy_only=False)
        for row, data, cuts in text_chunks(batch.column(0)):
            key, rows = _ngrams(data, cuts)
            k, n = np.unique((key << np.uint64(2)) | kind[row + rows].astype(np.uint64), return_counts=True)
            c = (k & np.uint64(3)).astype(int)
            keys.append(k >> np.uint64(2))
            sums.append(np.stack([n, n * (c == 1), n * (c == 2)], axis=1))
            held += len(k)
            if held > 4_000_000:
                k, n = merged()
                keys, sums, held = [k], [n], len(k) if len(k) < 2_000_000 else 0
                if not held:
                    keys, sums = [], []
                    yield _rows(k, n)
    if keys:
        yield _rows(*merged())


def _rows(k: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), *[pa.array(n[:, i].copy()) for i in range(3)]], ["key", "n", "toxic", "ordinary"])


def counts(docs: DataFrame) -> DataFrame:
    """(key, n, toxic, ordinary) over ``docs`` (text, kind: 0 unlabelled, 1 toxic, 2 ordinary)."""
    part = docs.select("text", "kind").mapInArrow(_count, "key long, n long, toxic long, ordinary long")
    return part.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("n", "toxic", "ordinary")])


def log_ratios(grams: DataFrame, d: float = DISCOUNT) -> DataFrame:
    """(key, n, ratio): log P(byte | context, toxic) - log P(byte | context, ordinary)."""
    low = lambda bits: F.col("key").bitwiseAND((1 << bits) - 1)
    types = grams.select("key", "n", F.lit(1).cast("long").alias("types"))
    levels = []
    for order in range(ORDER - 1, 0, -1):  # continuation counts; word starts have no left neighbour, so keep theirs
        started = F.shiftright("key", 8 * order) == 0
        types = types.withColumn("c", F.when(started, F.col("n")).otherwise(F.lit(1))).groupBy(low(8 * order).alias("key")).agg(
            F.sum("n").alias("n"), F.sum("c").alias("types")
        )
        types = durable(types)
        levels.append(types)
    shared = levels[-1].select("key", F.col("types").alias("v"))
    total = shared.agg(F.sum("v").alias("all"))
    shared = join_small(shared.withColumn("k", F.lit(0)), total.withColumn("k", F.lit(0)), ["k"]).select(
        "key", ((F.col("v") + 1 / 256) / (F.col("all") + 1)).alias("p")
    )
    for order in range(2, ORDER):
        grams_at = levels[ORDER - 1 - order].withColumn("h", F.shiftright("key", 8)).withColumn("s", low(8 * (order - 1)))
        heads = grams_at.groupBy("h").agg(F.sum("types").alias("sum"), F.count("*").alias("kinds"))
        back = shared.select(F.col("key").alias("s"), F.col("p").alias("below"))
        shared = durable(grams_at.join(heads, "h").join(back, "s").select(
            "key", ((F.greatest(F.col("types") - d, F.lit(0.0)) + d * F.col("kinds") * F.col("below")) / F.col("sum")).alias("p")
        ))
    full = grams.withColumn("h", F.shiftright("key", 8)).withColumn("s", low(8 * (ORDER - 1)))
    heads = full.groupBy("h").agg(
        *[F.sum(c).alias(f"{c}_sum") for c in ("toxic", "ordinary")],
        *[F.count(F.when(F.col(c) > 0, 1)).alias(f"{c}_kinds") for c in ("toxic", "ordinary")],
    ).where("toxic_sum + ordinary_sum > 0")
    back = shared.select(F.col("key").alias("s"), F.col("p").alias("below"))
    both = full.join(heads, "h").join(back, "s")

    def log_p(c: str):
        seen = (F.greatest(F.col(c) - d, F.lit(0.0)) + d * F.col(f"{c}_kinds") * F.col("below")) / F.col(f"{c}_sum")
        return F.log(F.when(F.col(f"{c}_sum") > 0, seen).otherwise(F.col("below")))

    return both.select("key", "n", (log_p("toxic") - log_p("ordinary")).alias("ratio"))


def in_units(ratios: DataFrame) -> DataFrame:
    """(key, n, units): the ratios as whole multiples of 1 / UNIT."""
    return ratios.select("key", "n", F.round(F.greatest(F.least("ratio", F.lit(127.0)), F.lit(-127.0)) * UNIT).cast("int").alias("units"))


def frequent(table: DataFrame, bound: int) -> tuple[np.ndarray, np.ndarray, DataFrame | None]:
    """The keys, sorted, and units of the most frequent n-grams, at most ``bound``, and a table of all others, or None."""
    level = F.floor(8 * F.log2("n"))
    least, held = None, 0
    levels = sorted(table.groupBy(level.alias("level")).count().collect(), reverse=True)
    for at, rows in levels:
        if held + rows > bound:
            break
        least, held = at, held + rows
    hot = (table.where(level >= least) if held else table.limit(0)).select("key", "units").toArrow()
    key, units = hot.column("key").to_numpy(), hot.column("units").to_numpy()
    order = np.argsort(key)
    rest = None if held == sum(r["count"] for r in levels) else table.where(level < least) if held else table
    return key[order], units[order], rest


def _pairs(rows: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs of row and key, and how often each occurs."""
    order = np.lexsort((key, rows))
    rows, key = rows[order], key[order]
    starts = np.flatnonzero(np.append(True, (rows[1:] != rows[:-1]) | (key[1:] != key[:-1])))
    return rows[starts], key[starts], np.diff(np.append(starts, len(rows)))


def evidence(docs: DataFrame, table: DataFrame, bound: int = MAX_KEYS) -> DataFrame:
    """doc_id, size, llr, strong: bytes in words, the summed log ratio, and its part above STRONG, of every row."""
    keys, units, rest = frequent(table, bound)
    shared = docs.sparkSession.sparkContext.broadcast((keys, units))
    whole, limit = rest is None, STRONG * UNIT
    names = ["doc_id", "a", "b", "key", "c", "size", "llr", "strong"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, value = shared.value
        for batch in batches:
            size, total, strong = (np.zeros(batch.num_rows) for _ in range(3))
            others = []
            for row, data, cuts in text_chunks(batch.column(1)):
                key, rows = _ngrams(data, cuts)
                key, n = key.view(np.int64), len(cuts) - 1
                size[row : row + n] = np.bincount(rows, minlength=n)
                at = np.searchsorted(known, key)
                at[at == len(known)] = 0
                found = known[at] == key if len(known) else np.zeros(len(key), dtype=bool)
                r = np.where(found, value[at], 0) if len(known) else np.zeros(len(key))
                total[row : row + n] = np.bincount(rows, r, minlength=n)
                strong[row : row + n] = np.bincount(rows, np.where(r > limit, r, 0), minlength=n)
                if not whole and not found.all():
                    others.append(_pairs(rows[~found] + row, key[~found]))
            none = pa.nulls(batch.num_rows, pa.int64())
            sums = [pa.array(x.astype(np.int64)) for x in (size, total, strong)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), none, none, *sums], names)
            for rows, key, c in others:
                who, none = pa.array(rows), pa.nulls(len(c), pa.int64())
                columns = [none, batch.column(2).take(who), batch.column(3).take(who), pa.array(key), pa.array(c), none, none, none]
                yield pa.RecordBatch.from_arrays(columns, names)

    texts = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b"))
    part = texts.mapInArrow(run, ", ".join(f"{c} long" for c in names))
    real = [(F.col(c) / d).alias(c) for c, d in (("size", 1), ("llr", UNIT), ("strong", UNIT))]
    if whole:
        return part.select("doc_id", *real)
    part = durable(part)
    mine = part.where("key is null")
    product = F.col("c") * F.col("units")
    more = part.where("key is not null").join(rest.select("key", "units").hint("merge"), "key").groupBy("a", "b").agg(
        F.sum(product).alias("llr_more"), F.sum(F.when(F.col("units") > limit, product).otherwise(0)).alias("strong_more")
    )
    copies = mine.groupBy("a", "b").agg(F.count("*").alias("copies"))  # equal texts have equal hashes and met together
    each = more.join(copies, ["a", "b"]).select("a", "b", *[F.expr(f"{c}_more div copies").alias(f"{c}_more") for c in ("llr", "strong")])
    joined = mine.join(each, ["a", "b"], "left")
    summed = [(F.col(c) + F.coalesce(F.col(f"{c}_more"), F.lit(0))).alias(c) for c in ("llr", "strong")]
    return joined.select("doc_id", "size", *summed).select("doc_id", *real)


def _fit(rows: np.ndarray, steps: int = 50) -> np.ndarray:
    """Logistic weights by Newton's method with a small ridge."""
    x, y = rows[:, :-1], rows[:, -1]
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(x.shape[1])
        w = w + np.linalg.solve(h, x.T @ (y - p) - 1e-3 * w)
    return w


def fold_of(doc_id):
    return F.crc32(doc_id.cast("string")) % 5


def features() -> list:
    size = F.greatest(F.col("size"), F.lit(1.0))
    return [
        F.lit(1.0), 50 * F.col("llr") / size, F.col("llr") / F.sqrt(size), F.log(size + 1) / 10,
        50 * F.col("strong") / size, F.col("strong") / F.sqrt(size), F.log1p("strong"),
    ]


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, llr, size, strong for every row of ``docs``."""
    known = durable(
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .where(fold_of(F.col("doc_id")) != 0)
    )
    train = known.where(fold_of(F.col("doc_id")) != 4)
    rows = join_small(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), train, ["doc_id"], "left", MAX_LABELS_BROADCAST)
    kind = F.when(F.col("toxic") == 1, 1).when(F.col("toxic") == 0, 2).otherwise(0)
    grams = durable(counts(rows.withColumn("kind", kind)))
    scored = durable(evidence(docs, durable(in_units(log_ratios(grams)))))
    fit = scored.join(known.where(fold_of(F.col("doc_id")) == 4), "doc_id")
    sample = fit.orderBy(F.xxhash64("doc_id"), "doc_id", "llr").limit(MAX_FIT).select(*[x.alias(f"x{i}") for i, x in enumerate(features())], F.col("toxic").cast("double").alias("y"))
    seen = np.column_stack([c.to_numpy().astype(float) for c in sample.toArrow().columns])
    if len(seen) and 0 < seen[:, -1].mean() < 1:
        w = _fit(seen)
        value = sum((float(c) * x for c, x in zip(w, features(), strict=True)), F.lit(0.0))
        prob = 1 / (1 + F.exp(-F.greatest(F.least(value, F.lit(30.0)), F.lit(-30.0))))
    else:
        prob = F.lit(float(seen[:, -1].mean()) if len(seen) else 0.0)
    out = scored.withColumn("score", F.round(prob, 9))
    return out.select(
        "doc_id",
        F.coalesce(fold_of(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
        "llr",
        "size",
        "strong",
    )
