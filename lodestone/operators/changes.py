"""Change capture by content hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.files import upsert

KEYS = ["repo_id", "file_path"]


def file_changes(current: DataFrame, stored: DataFrame) -> DataFrame:
    """Every path of either side with its status: new, modified, deleted or unchanged."""
    c, s = current.select(*KEYS, F.col("hash").alias("new_hash")), stored.select(*KEYS, F.col("hash").alias("old_hash"))
    known = c.withColumn("__c", F.lit(True)).join(s.withColumn("__s", F.lit(True)), KEYS, "full_outer")
    status = F.when(F.col("__s").isNull(), "new").when(F.col("__c").isNull(), "deleted").when(F.col("new_hash").eqNullSafe(F.col("old_hash")), "unchanged").otherwise("modified")
    return known.select(*KEYS, status.alias("status"), "old_hash", "new_hash")


def changed(current: DataFrame, stored: DataFrame) -> DataFrame:
    """Paths that need analysis: new or with another hash."""
    return file_changes(current, stored).where(F.col("status").isin("new", "modified"))


def change_counts(current: DataFrame, stored: DataFrame) -> DataFrame:
    """Per repository: tracked, new, modified, deleted, unchanged."""
    s = F.col("status")
    return file_changes(current, stored).groupBy("repo_id").agg(F.count_if(s != "new").alias("tracked"), *[F.count_if(s == x).alias(x) for x in ("new", "modified", "deleted", "unchanged")])


def stale(stored: DataFrame, cutoff: Column) -> DataFrame:
    """Files last analysed before the cutoff."""
    return stored.where(F.col("last_analyzed") < cutoff)


def cleanup(stored: DataFrame, existing: DataFrame) -> DataFrame:
    """Tracked files that still exist; an empty list keeps none."""
    return stored.join(existing.select(*KEYS).distinct(), KEYS, "left_semi")


def track(stored: DataFrame, rows: DataFrame) -> DataFrame:
    """Stored hashes with new ones put in place."""
    return upsert(stored, rows, KEYS)


def is_stale(current: DataFrame, stored: DataFrame) -> DataFrame:
    """(repo_id, file_path, stale) for the current files: untracked or with another hash."""
    return file_changes(current, stored).where(F.col("status") != "deleted").select(*KEYS, (F.col("status") != "unchanged").alias("stale"))


def refresh(table: DataFrame, fresh_rows: DataFrame, changes: DataFrame) -> DataFrame:
    """A derived table after a change set: rows of changed and deleted paths give way to the fresh ones."""
    touched = changes.where(F.col("status") != "unchanged").select(*KEYS).distinct()
    return table.join(touched, KEYS, "left_anti").unionByName(fresh_rows.join(touched, KEYS, "left_semi"))
