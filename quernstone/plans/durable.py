"""Lineage cuts that survive lost executors, and size-checked joins against small tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: the session's spark.checkpoint.dir. Where that is unset, a local session (as in
    tests) gets a temporary folder of this machine; on a cluster, whose executors would not see it, this raises."""
    where = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="quernstone-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def durable(df: DataFrame, codec: str = "zstd", narrow: bool = False) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Unlike ``checkpoint()`` the plan runs once, the file is columnar and compressed, and a later read
    prunes columns; unlike ``localCheckpoint`` it survives the loss of any executor.

    A ``narrow`` table (counts, ids, links) is dealt once more, over as many files as there are cores, as its rows are cheap to move and a file is not: on a local file system
    Hadoop starts a process for each mode that it sets, several a file, which for a moment shares (and is counted with) all of the executor's memory.
    """
    spark = df.sparkSession
    df = df.repartition(spark.sparkContext.defaultParallelism) if narrow else df
    path = f"{shared_dir(spark)}/quernstone/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(schema).parquet(path)


def dealt(df: DataFrame, rows: int, *keys: str, most: int = 250_000) -> DataFrame:
    """``df``, expected to have ``rows`` rows, dealt by ``keys`` over so many partitions that a task gets about ``most`` of them, however large the table;
    as it is where the session's own number of partitions does that. What follows by these keys, or more, needs no other shuffle."""
    parts = -(-rows // most)
    return df.repartition(parts, *keys) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def likely(df: DataFrame, ids: DataFrame, key: str, most: int = 1 << 26) -> DataFrame:
    """The rows of ``df`` whose ``key`` is in ``ids`` (a written table with that column, of longs), and some others (about 1 in 16, more only beyond most / 16 ids), without
    a shuffle of ``df``: for wide rows, before they are shuffled for a join with ``ids``. Tasks get a bitmap of the ids' hashes: 16 bits an id, at most ``most`` bits (8 MB), in
    rows of 4 KB. ``df``'s key is cast to long; null is in no ``ids``."""
    pages = max(1, min(most, 16 * ids.count()) // 32_768)
    at = lambda c: F.pmod(F.xxhash64(c.cast("long")), F.lit(pages * 32_768)) + 1
    bits = ids.where(F.col(key).isNotNull()).select(at(F.col(key)).alias("at_"))
    bits = bits.groupBy(F.bitmap_bucket_number("at_").alias("page_")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at_")).alias("bits_"))
    own = at(F.col(f"`{key}`"))
    place = F.bitmap_bit_position(own)
    byte = F.ascii(F.decode(F.substring("bits_", (F.shiftright(place, 3) + 1).cast("int"), F.lit(1)), "ISO-8859-1"))
    held = F.call_function("shiftright", byte, place.bitwiseAND(7).cast("int")).bitwiseAND(1) == 1
    return df.join(F.broadcast(bits), F.col(f"`{key}`").isNotNull() & (F.bitmap_bucket_number(own) == F.col("page_")) & held, "left_semi")


def join_small(df: DataFrame, small: DataFrame, keys: list[str], how: str = "left", max_rows: int = 50_000) -> DataFrame:
    """Join with a table expected to be small: broadcast only if its counted rows are within ``max_rows``;
    beyond that an ordinary shuffled join, whose skewed partitions adaptive execution splits.

    ``small`` must be cheap to count: a written table or an aggregate of one.
    """
    fits = small.limit(max_rows + 1).count() <= max_rows
    return df.join(F.broadcast(small) if fits else small.hint("merge"), keys, how)
