"""Usage telemetry: totals, per tool, since a time, recent, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Default and largest number of recent records.
RECENT, MOST_RECENT = 20, 100


def totals(usage: DataFrame) -> DataFrame:
    """One row: calls, tokens in and out; zeros for no records."""
    return usage.agg(F.count(F.lit(1)).alias("total_calls"), F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"))


def per_tool(usage: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Calls, successes, failures, tokens, durations and last use by tool (and further columns)."""
    return usage.groupBy(*(by or []), "tool").agg(
        F.count(F.lit(1)).alias("calls"), F.count_if("success").alias("successes"), F.count_if(~F.col("success")).alias("failures"),
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.avg("input_tokens").alias("avg_input_tokens"),
        F.avg("duration_ms").alias("avg_ms"), F.min("duration_ms").alias("min_ms"), F.max("duration_ms").alias("max_ms"), F.max("timestamp").alias("last_used"),
    )


def since(usage: DataFrame, start: Column) -> DataFrame:
    return usage.where(F.col("timestamp") >= start)


def success_rate(successes: Column, calls: Column) -> Column:
    """Percent of successes; 0 without calls."""
    return F.when(calls > 0, successes / F.nullif(calls, F.lit(0)) * 100).otherwise(0.0)


def recent(usage: DataFrame, limit: int | None = None) -> DataFrame:
    """The latest records, ties by id; 20 unless asked, 100 at most."""
    n = RECENT if not limit or limit <= 0 else min(limit, MOST_RECENT)
    return usage.orderBy(F.desc("timestamp"), F.desc("id")).limit(n)


def retained(usage: DataFrame, cutoff: Column) -> DataFrame:
    """Records not older than the cutoff."""
    return usage.where(F.col("timestamp") >= cutoff)


def expired(usage: DataFrame, cutoff: Column) -> DataFrame:
    """One row: number of records that retention deletes."""
    return usage.where(F.col("timestamp") < cutoff).agg(F.count(F.lit(1)).alias("deleted"))


def with_default_time(usage: DataFrame, now: Column) -> DataFrame:
    """Records with their missing times set."""
    return usage.withColumn("timestamp", F.coalesce("timestamp", now))
