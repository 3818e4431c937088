"""Event-time operators over streams; the same functions run on batch tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """A file stream of the table, with event time as a zoned timestamp."""
    rows = spark.readStream.schema(schema).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def window_counts(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts and value sums per tumbling window and kind; rows later than the watermark are left out."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return w.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").cast("string").alias("day"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "2 hours", late: str = "2 days") -> DataFrame:
    """Sessions per user: runs of events with no gap of ``gap`` or more."""
    s = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("s"))
    return s.agg(F.count("*").alias("n")).select("user_id", F.col("s.start").cast("string").alias("start"), "n")


def drain(out: DataFrame, mode: str) -> DataFrame:
    """Run the stream over what is there, into a Parquet sink under the shared folder, and read that."""
    from quernstone.plans.durable import shared_dir

    spark = out.sparkSession
    base = f"{shared_dir(spark)}/quernstone/streams/{uuid.uuid4().hex}"

    def sink(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/epoch={epoch}")

    q = out.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(sink).start()
    q.awaitTermination()
    found = spark.read.schema(out.schema.add("epoch", "long")).parquet(f"{base}/out")
    last = found.agg(F.max("epoch").alias("epoch"))
    return found.join(F.broadcast(last), "epoch", "left_semi").drop("epoch") if mode == "complete" else found.drop("epoch")
