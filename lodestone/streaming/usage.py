"""Structured Streaming forms of telemetry and change capture (an extension of the batch operators)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.usage import per_tool

SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()), T.StructField("tool", T.StringType()), T.StructField("input_tokens", T.IntegerType()), T.StructField("output_tokens", T.IntegerType()),
        T.StructField("duration_ms", T.LongType()), T.StructField("success", T.BooleanType()), T.StructField("timestamp", T.TimestampType()),
    ]
)


def read(spark: SparkSession, path: str, schema: T.StructType = SCHEMA) -> DataFrame:
    """Telemetry files of a folder as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def windowed(usage: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Use by tool and time window; records later than the watermark are dropped, redelivered ones (by id) count once."""
    once = usage.withWatermark("timestamp", late).dropDuplicatesWithinWatermark(["id"])
    w = once.withColumn("window", F.window("timestamp", window))
    return per_tool(w, ["window"]).withColumn("day", F.col("window.start")).drop("window")


def sessions(usage: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each tool's use, ended by a gap."""
    return usage.withWatermark("timestamp", late).groupBy(F.session_window("timestamp", gap).alias("s"), "tool").agg(F.count(F.lit(1)).alias("calls")).select("tool", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "calls")


def upsert_batches(stream: DataFrame, path: str, keys: list[str], checkpoint: str, merge: Callable[[DataFrame, DataFrame, list[str]], DataFrame]):
    """Keep a table up to date from a stream: each batch is merged into a new snapshot folder, named by the batch."""

    def one(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        old = spark.read.parquet(f"{path}/v={n - 1}") if n else None
        (merge(old, batch, keys) if old is not None else batch).write.mode("overwrite").parquet(f"{path}/v={n}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
