"""Organisations: membership, listing, effective configuration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def listing(orgs: DataFrame, members: DataFrame) -> DataFrame:
    """Every organisation with its number of repositories, those without any included."""
    return orgs.join(members.select("org_id", "repo_id"), orgs["id"] == members["org_id"], "left").groupBy("id").agg(F.count("repo_id").alias("repo_count"))


def add(members: DataFrame, rows: DataFrame) -> DataFrame:
    """Membership with rows added; those already there stay as they are."""
    return members.unionByName(rows.distinct().join(members, ["org_id", "repo_id"], "left_anti"))


def remove(members: DataFrame, rows: DataFrame) -> DataFrame:
    return members.join(rows.select("org_id", "repo_id").distinct(), ["org_id", "repo_id"], "left_anti")


def register(members: DataFrame, rows: DataFrame) -> DataFrame:
    """Membership after registering: the organisations named in ``rows`` get just those repositories."""
    clean = rows.where((F.col("org_id") != "") & (F.col("repo_id") != "")).distinct()
    return members.join(clean.select("org_id").distinct(), "org_id", "left_anti").unionByName(clean)


def effective(orgs: DataFrame, members: DataFrame) -> DataFrame:
    """Per membership: organisation's exclude patterns with the override's added, and the override's size if not zero."""
    empty = F.array().cast("array<string>")
    m = members.select("org_id", "repo_id", F.col("override.exclude_patterns").alias("op"), F.col("override.max_file_size").alias("os"))
    j = m.join(orgs.select(F.col("id").alias("org_id"), "exclude_patterns", "max_file_size"), "org_id")
    patterns = F.array_distinct(F.filter(F.concat(F.coalesce("exclude_patterns", empty), F.coalesce("op", empty)), lambda x: x != ""))
    return j.select("org_id", "repo_id", patterns.alias("exclude_patterns"), F.when(F.col("os") != 0, F.col("os")).otherwise(F.col("max_file_size")).alias("max_file_size"))


def import_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(orgs, members) of a JSON file that maps an organisation to its repositories; reading it again changes nothing."""
    raw = spark.read.option("wholetext", True).text(path)
    orgs = raw.select(F.explode(F.from_json("value", "map<string,struct<repo_ids:array<string>>>")).alias("id", "o"))
    return orgs.select("id").distinct(), orgs.select(F.col("id").alias("org_id"), F.explode("o.repo_ids").alias("repo_id")).distinct()
