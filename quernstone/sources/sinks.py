"""Guarded writes: frozen tables, stable orders, keyed inserts, resumable runs, manifests and review queues."""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def digest(df: DataFrame) -> tuple[int, int, int, str]:
    """(rows, sum, sum, columns) over two independent 64-bit hashes of every row: independent of order and partitions, one aggregation. Sums are exact, so
    repeated rows count, and the columns' names and types are part of it: 1 and '1' differ."""
    columns = [F.col(f"`{c}`") for c in sorted(df.columns)]
    total = lambda *seed: F.coalesce(F.sum(F.xxhash64(*seed, *columns).cast("decimal(20,0)")), F.lit(0).cast("decimal(30,0)"))
    rows, one, two = df.agg(F.count("*"), total(F.lit("a")), total(F.lit("b"))).first()
    kinds = ",".join(sorted(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema))
    return rows, int(one), int(two), kinds


def freeze_write(df: DataFrame, path: str, force: bool = False) -> bool:
    """Write ``df`` to ``path`` if nothing is there; equal content is left alone, other content is refused
    unless ``force``. Returns whether anything was written."""
    try:
        old = df.sparkSession.read.parquet(path)
    except AnalysisException:
        old = None
    if old is not None:
        if sorted(old.columns) == sorted(df.columns) and digest(old) == digest(df):
            return False
        if not force:
            raise FileExistsError(f"{path} is frozen with other content")
    df.write.mode("overwrite" if force else "errorifexists").parquet(path)
    return True


def ordered_write(df: DataFrame, path: str, keys: list[str], form: str = "json", files: int = 4) -> None:
    """Write in key order over ``files`` files by ranges: the files in name order, and the lines in each, follow the keys, whatever
    the input's order, and lines end in a line feed."""
    ordered = df.repartitionByRange(files, *keys).sortWithinPartitions(*keys, *[F.col(f"`{c}`") for c in df.columns if c not in keys])
    writer = ordered.write.mode("errorifexists")
    if form == "csv":
        writer.option("header", True).option("escape", '"').option("lineSep", "\n").csv(path)
    elif form == "json":
        writer.option("ignoreNullFields", False).option("lineSep", "\n").json(path)
    else:
        raise ValueError("form is csv or json")


def keyed_insert(new: DataFrame, path: str, key: str, valid: Column) -> DataFrame:
    """Append the valid rows whose key the table at ``path`` lacks; (key, outcome, rows): how many rows of a key were ok, exist
    already or are quarantined.

    Of rows that share a new key the least by hash is inserted and the others count as existing. A second run inserts nothing.
    """
    from quernstone.plans.durable import durable

    spark = new.sparkSession
    try:
        old = spark.read.parquet(path).select(key)
    except AnalysisException:
        old = new.select(key).limit(0)
    columns = [F.col(f"`{c}`") for c in new.columns]
    rows = durable(new.withColumn("valid_", F.coalesce(valid & F.col(key).isNotNull(), F.lit(False))))
    fresh = rows.where("valid_").join(old.distinct(), key, "left_anti")
    first = durable(fresh.groupBy(key).agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias("r")).select("r.*"))
    counts = rows.where("valid_").groupBy(key).agg(F.count("*").alias("n_")).join(first.select(key).withColumn("new_", F.lit(1)), key, "left")
    ok, exists = F.coalesce("new_", F.lit(0)), F.col("n_") - F.coalesce("new_", F.lit(0))
    each = counts.select(key, F.explode(F.array(F.struct(F.lit("ok").alias("outcome"), ok.cast("long").alias("rows")), F.struct(F.lit("exists").alias("outcome"), exists.alias("rows")))).alias("o"))
    bad = rows.where("NOT valid_").groupBy(key).agg(F.lit("quarantined").alias("outcome"), F.count("*").alias("rows"))
    out = durable(each.select(key, "o.*").where("rows > 0").union(bad))
    first.write.mode("append").parquet(path)
    return out


def run_batch(todo: DataFrame, log: str, key: str, outcome: Column) -> DataFrame:
    """One run over what the log at ``log`` has not finished: (key, outcome, done) is appended and returned. Only rows that
    reached their engine (outcome other than "unreached") are done; the others come again in the next run."""
    from quernstone.plans.durable import durable

    try:
        done = todo.sparkSession.read.parquet(log).where("done").select(key)
    except AnalysisException:
        done = todo.select(key).limit(0)
    rows = todo.join(done.distinct(), key, "left_anti").select(key, outcome.alias("outcome"))
    out = durable(rows.withColumn("done", F.col("outcome") != "unreached"))
    out.write.mode("append").parquet(log)
    return out


def manifest(tables: dict[str, DataFrame], rules: dict[str, str]) -> tuple[list[tuple[str, int, str]], str]:
    """([(table, rows, digest)], release id): the id is the hash of the rules and all digests, so equal content and rules have
    one id whatever the order or the partitions of the rows."""
    parts = [(name, *_named_digest(df)) for name, df in sorted(tables.items())]
    text = "\n".join([*(f"{k}={v}" for k, v in sorted(rules.items())), *(f"{n}:{rows}:{d}" for n, rows, d in parts)])
    return parts, hashlib.sha256(text.encode()).hexdigest()[:16]


def _named_digest(df: DataFrame) -> tuple[int, str]:
    rows, one, two, kinds = digest(df)
    return rows, f"{one & (2**64 - 1):016x}{two & (2**64 - 1):016x}{hashlib.sha256(kinds.encode()).hexdigest()[:8]}"


def split_write(df: DataFrame, path: str, review: Column) -> tuple[str, str]:
    """All rows to ``path``/all, those that need a human to ``path``/review; one pass over ``df``, written first."""
    df.withColumn("review_required", F.coalesce(review, F.lit(True))).write.parquet(f"{path}/all")
    df.sparkSession.read.parquet(f"{path}/all").where("review_required").write.parquet(f"{path}/review")
    return f"{path}/all", f"{path}/review"
