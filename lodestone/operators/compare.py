"""Comparison of repositories: overlap, duplicates, conflicts, gaps, consistency, recommendations.

Functions take ``functions`` (repo_id, path, name, signature, line_start), ``types`` (repo_id, path, name, fields) and
``files`` (repo_id, path, hash).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import dirname


def priority_rank(p: Column) -> Column:
    return F.when(p == "high", 0).when(p == "medium", 1).otherwise(2)


def gap_priority(n: Column) -> Column:
    return F.when(n >= 3, "high").when(n == 2, "medium").otherwise("low")


def severity(a: Column, b: Column) -> Column:
    """High where just one signature mentions an error, low where they are equal, else medium."""
    e = lambda c: F.contains(F.coalesce(c, F.lit("")), F.lit("error"))
    return F.when(a.eqNullSafe(b), "low").when(e(a) != e(b), "high").otherwise("medium")


def unified_stats(files: DataFrame) -> DataFrame:
    """One row: repositories, files, paths in one repository and in several."""
    per = files.groupBy("path").agg(F.count_distinct("repo_id").alias("r"), F.count(F.lit(1)).alias("n"))
    a = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_files"), F.count_if(F.col("r") == 1).alias("unique_files"), F.count_if(F.col("r") > 1).alias("overlapping_files"))
    return a.crossJoin(files.agg(F.count_distinct("repo_id").alias("total_repos")))


def file_overlap(files: DataFrame) -> DataFrame:
    """Paths in several repositories: number of repositories and whether all contents are equal."""
    g = files.groupBy("path").agg(F.count_distinct("repo_id").alias("n_repos"), F.count_distinct("hash").alias("h"), F.count_if(F.col("hash").isNull()).alias("z"))
    return g.where(F.col("n_repos") > 1).select("path", "n_repos", ((F.col("h") + F.when(F.col("z") > 0, 1).otherwise(0)) == 1).alias("identical"))


def duplicates(items: DataFrame) -> DataFrame:
    """Names in several repositories with the number of instances; the instances themselves are a join by name away."""
    g = items.groupBy("name").agg(F.count(F.lit(1)).alias("n_instances"), F.count_distinct("repo_id").alias("n_repos"))
    return g.where(F.col("n_repos") > 1).select("name", "n_instances", "n_repos", F.lit(1.0).alias("similarity"))


def duplicate_instances(items: DataFrame) -> DataFrame:
    """All instances of the names found by :func:`duplicates`."""
    return items.join(duplicates(items).select("name", "n_instances", "n_repos"), "name")


def _last(target: DataFrame, *cols: str) -> DataFrame:
    """One record a name: the last by path and line."""
    return target.groupBy("name").agg(F.max_by(F.struct(*[F.col(c).alias("target_" + c) for c in cols]), F.struct("path", "line_start")).alias("t")).select("name", "t.*")


def conflicts(functions: DataFrame, target: str) -> DataFrame:
    """Functions of other repositories whose name the target has with another signature."""
    t = _last(functions.where(F.col("repo_id") == target), "path", "line_start", "signature")
    j = functions.where(F.col("repo_id") != target).join(t, "name").where(~F.col("signature").eqNullSafe(F.col("target_signature")))
    return j.select("name", "repo_id", "path", "line_start", "signature", "target_path", "target_line_start", "target_signature", severity(F.col("signature"), F.col("target_signature")).alias("severity"))


def type_conflicts(types: DataFrame, target: str) -> DataFrame:
    """Types of other repositories whose name the target has with another number of fields."""
    sized = types.withColumn("n_fields", F.when(F.col("fields").isNull(), 0).otherwise(F.size("fields")))
    t = _last(sized.where(F.col("repo_id") == target), "path", "n_fields")
    return sized.where(F.col("repo_id") != target).join(t, "name").where(F.col("n_fields") != F.col("target_n_fields")).select("name", "repo_id", "path", "n_fields", "target_path", "target_n_fields", F.lit("medium").alias("severity"))


def gaps(items: DataFrame, target: str) -> DataFrame:
    """Names that the target lacks: number of source instances (each counts) and priority."""
    have = items.where(F.col("repo_id") == target).select("name").distinct()
    g = items.where(F.col("repo_id") != target).join(have, "name", "left_anti").groupBy("name").agg(F.count(F.lit(1)).alias("n_sources"), F.max("path").alias("file_path"))
    return g.select("name", "n_sources", "file_path", gap_priority(F.col("n_sources")).alias("priority"))


def naming_consistency(functions: DataFrame) -> DataFrame:
    """One row: names with and without underscores, share of the rarer kind, score."""
    snake = F.count_if(F.contains("name", F.lit("_")))
    a = functions.agg(F.count(F.lit(1)).alias("total"), snake.alias("snake")).withColumn("camel", F.col("total") - F.col("snake"))
    mix = F.coalesce(F.least("snake", "camel") / F.nullif("total", F.lit(0)), F.lit(0.0))
    return a.select("total", "snake", "camel", mix.alias("mix"), F.when(mix > 0.2, 0.8).otherwise(1.0).alias("score"))


def structure_consistency(files: DataFrame) -> DataFrame:
    """One row: directories that some but not all repositories have, and the score.

    Repositories are counted once a directory, not once a file.
    """
    dirs = files.select("repo_id", dirname("path").alias("dir")).where(F.col("dir") != "")
    per = dirs.groupBy("dir").agg(F.count_distinct("repo_id").alias("n"))
    total = files.agg(F.count_distinct("repo_id").alias("repos"))
    a = per.crossJoin(total).agg(F.count_if((F.col("n") > 1) & (F.col("n") < F.col("repos"))).alias("issues"))
    return a.select("issues", F.greatest(F.lit(0.5), 1.0 - F.col("issues") * 0.1).alias("score"))


def consistency(functions: DataFrame, files: DataFrame) -> DataFrame:
    """One row: naming, pattern (constant), structure and overall score."""
    n, s = naming_consistency(functions).select(F.col("score").alias("naming")), structure_consistency(files).select(F.col("score").alias("structure"))
    return n.crossJoin(s).select("naming", F.lit(0.8).alias("pattern"), "structure", ((F.col("naming") + 0.8 + F.col("structure")) / 3.0).alias("overall"))


def recommendations(metrics: DataFrame) -> DataFrame:
    """Advice for a row of metrics: duplicates, high_conflicts, high_gaps, overall, differing_files."""
    rules = F.array(
        F.when(F.col("duplicates") > 5, "Create a shared library for common functions"), F.when(F.col("high_conflicts") > 0, "Resolve severe conflicts before a merge"),
        F.when(F.col("high_gaps") > 0, "Migrate functions of high priority to the target"), F.when(F.col("overall") < 0.7, "Improve consistency to ease maintenance"),
        F.when(F.col("differing_files") > 0, "Review files that differ between repositories"),
    )
    held = F.filter(rules, lambda x: x.isNotNull())
    return metrics.select(F.posexplode(F.when(F.size(held) > 0, held).otherwise(F.array(F.lit("Repositories are well aligned")))).alias("position", "recommendation"))


def compare(functions: DataFrame, files: DataFrame, target: str) -> DataFrame:
    """One row: duplicates, severe conflicts and gaps with the target, consistency, differing files, and the advice."""
    m = duplicates(functions).agg(F.count(F.lit(1)).alias("duplicates"))
    for part in (
        conflicts(functions, target).agg(F.count_if(F.col("severity") == "high").alias("high_conflicts")), gaps(functions, target).agg(F.count_if(F.col("priority") == "high").alias("high_gaps")),
        consistency(functions, files).select("overall"), file_overlap(files).agg(F.count_if(~F.col("identical")).alias("differing_files")),
    ):
        m = m.crossJoin(part)  # rows of one each
    advice = recommendations(m).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "recommendation"))), lambda x: x["recommendation"]).alias("advice"))
    return m.crossJoin(advice)


def repo_summary(files: DataFrame, functions: DataFrame) -> DataFrame:
    """Per repository: files and functions."""
    a = files.groupBy("repo_id").agg(F.count(F.lit(1)).alias("file_count"))
    b = functions.groupBy("repo_id").agg(F.count(F.lit(1)).alias("function_count"))
    z = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return a.join(b, "repo_id", "full_outer").select("repo_id", z("file_count"), z("function_count"))


def build_systems(files: DataFrame) -> DataFrame:
    """Per repository: build system (Go modules before npm before make; empty without any) and number of main packages."""
    base = F.substring_index("path", "/", -1)
    has = lambda n: F.bool_or(base == n)
    system = F.when(has("go.mod"), "go modules").when(has("package.json"), "npm").when(has("Makefile"), "make").otherwise("")
    return files.groupBy("repo_id").agg(system.alias("build_system"), F.count_distinct(F.when(base == "main.go", dirname("path"))).alias("main_packages"))


def field_list(fields: str) -> Column:
    """Fields as one text: ``name: type`` joined by commas."""
    return F.array_join(F.transform(fields, lambda f: F.concat(f["name"], F.lit(": "), f["type"])), ", ")
