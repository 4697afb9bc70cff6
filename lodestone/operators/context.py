"""Contexts of repositories: overviews, short forms of files and functions, resources, and what fits a token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import search_keywords
from . import rank

#: Token budget unless asked otherwise, its upper limit, and what is kept back for headings.
BUDGET, MOST_BUDGET, RESERVE = 4000, 32_000, 500


def overview(extracted: DataFrame) -> DataFrame:
    """One row per repository: files, functions, types, public functions and complexity. One partial aggregation."""
    f = F.coalesce("functions", F.array())
    return extracted.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("n_files"), F.sum(F.size(f)).alias("n_functions"), F.sum(F.size(F.coalesce("types", F.array()))).alias("n_types"),
        F.sum(F.size(F.filter(f, lambda x: x["is_public"]))).alias("n_public"), F.sum(F.aggregate(f, F.lit(0).cast("long"), lambda s, x: s + x["complexity"])).alias("complexity"),
    )


def summarize_functions(functions: DataFrame) -> DataFrame:
    """Functions in short form: name, signature, description, place, summary and effects; no steps, calls or flow."""
    return functions.select("repo_id", "path", "name", "signature", "description", "is_public", "line_start", "line_end", F.coalesce("behavior.summary", F.lit("")).alias("summary"), "side_effects")


def summarize_files(extracted: DataFrame) -> DataFrame:
    """Files in short form: what they are, the signatures of their functions and the names of their types."""
    return extracted.select(
        "repo_id", "path", "package", "language", "purpose", "concepts",
        F.transform("functions", lambda f: F.struct(f["name"].alias("name"), f["signature"].alias("signature"), f["is_public"].alias("is_public"))).alias("functions"),
        F.transform("types", lambda t: F.struct(t["name"].alias("name"), t["kind"].alias("kind"), t["is_public"].alias("is_public"))).alias("types"),
    )


def compress_files(extracted: DataFrame) -> DataFrame:
    """Files with only what is public: functions with their summaries, types with their descriptions."""
    public = lambda a: F.filter(a, lambda x: x["is_public"])
    return extracted.select(
        "repo_id", "path", "package", "language", "purpose", "concepts",
        F.transform(public("functions"), lambda f: F.struct(f["name"].alias("name"), f["signature"].alias("signature"), f["behavior"]["summary"].alias("summary"), f["side_effects"].alias("side_effects"))).alias("functions"),
        F.transform(public("types"), lambda t: F.struct(t["name"].alias("name"), t["kind"].alias("kind"), t["description"].alias("description"))).alias("types"),
    )


def public_types(extracted: DataFrame) -> DataFrame:
    """Public types of every repository."""
    t = extracted.select("repo_id", "path", F.explode("types").alias("t")).where("t.is_public")
    return t.select("repo_id", "t.name", "t.kind", "t.description", "path", F.col("t.line_start").alias("line_start"))


def architecture(extracted: DataFrame) -> DataFrame:
    """Packages of every repository with their files and public functions; files that no parser knows are left out."""
    known = extracted.where((F.col("package") != "") & ~F.col("parse_error"))
    return known.groupBy("repo_id", "package").agg(F.count(F.lit(1)).alias("n_files"), F.sum(F.size(F.filter("functions", lambda f: f["is_public"]))).alias("n_public"))


def clamp_budget(tokens: int | None) -> int:
    """The budget to use: the default for none, at most the limit."""
    return BUDGET if not tokens or tokens <= 0 else min(tokens, MOST_BUDGET)


def budgeted(functions: DataFrame, query: str, cost: Column, budget: int | None = None, short: Column | None = None, key: str = "line_start") -> DataFrame:
    """Per repository, the functions relevant to a query that fit the budget less the reserve, the most relevant first.

    ``functions``: repo_id, name, description, signature, summary and ``key``. What is not relevant is left out; what
    does not fit is tried at its ``short`` cost, else skipped. Output: repo_id, key, form, used.
    """
    score = rank.relevance(search_keywords(F.lit(query)), F.col("name"), F.col("description"), F.col("signature"), F.col("summary"))
    c = functions.select("repo_id", key, score.alias("score"), cost.alias("cost"), (short if short is not None else cost).alias("short")).where(F.col("score") > 0)
    return rank.pack(c, "repo_id", key, "score", "cost", clamp_budget(budget) - RESERVE, "short" if short is not None else None)


def summary_request(extracted: DataFrame, most: int = 20) -> DataFrame:
    """What a summary of each repository is asked from: its packages, and its first public functions and types by name.

    The lists are cut to ``most`` before they are gathered, so that they stay short however large a repository is.
    """
    first = lambda df, name: df.withColumn("__r", F.row_number().over(Window.partitionBy("repo_id").orderBy(name, "path"))).where(F.col("__r") <= most).groupBy("repo_id")
    f = extracted.select("repo_id", "path", F.explode("functions").alias("f")).where("f.is_public").select("repo_id", "path", "f.name", "f.signature")
    functions = first(f, "name").agg(F.transform(F.array_sort(F.collect_list(F.struct("__r", "signature"))), lambda x: x["signature"]).alias("functions"))
    types = first(public_types(extracted), "name").agg(F.transform(F.array_sort(F.collect_list(F.struct("__r", "name"))), lambda x: x["name"]).alias("types"))
    packages = architecture(extracted).groupBy("repo_id").agg(F.count(F.lit(1)).alias("n_packages"), F.sum("n_files").alias("n_files"))
    return packages.join(functions, "repo_id", "left").join(types, "repo_id", "left")


def to_refresh(repos: DataFrame, forced: bool = False) -> DataFrame:
    """Repositories with whether their summary is to be made anew: those without one, or all if forced."""
    return repos.withColumn("state", F.when(F.lit(forced) | (F.coalesce("summary", F.lit("")) == ""), "update").otherwise("skip"))
