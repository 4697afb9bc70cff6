"""What a change set touches: callers, routes, types, risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import base_type, dirname

# fixed values: built-in type names
BUILTIN_TYPES = tuple("string int int8 int16 int32 int64 uint uint8 uint16 uint32 uint64 float32 float64 bool byte rune error any interface{} complex64 complex128 uintptr".split())


def affected_functions(calls: DataFrame, functions: DataFrame, changed: DataFrame) -> DataFrame:
    """Functions outside the changed files that call a changed function by name: with the first such call by line.

    ``changed``: repo_id, path.
    """
    keys = ["repo_id", "path"]
    names = functions.join(changed.select(*keys).distinct(), keys, "left_semi").select("repo_id", F.col("name").alias("callee")).distinct()
    hit = calls.join(names, ["repo_id", "callee"]).select("repo_id", F.col("caller_path").alias("path"), F.col("caller").alias("name"), "callee", "line")
    first = hit.groupBy("repo_id", "path", "name").agg(F.min(F.struct(F.coalesce("line", F.lit(0)), "callee")).alias("c"))
    out = first.join(changed.select(*keys).distinct(), keys, "left_anti").join(functions.select("repo_id", "path", "name", "is_public").groupBy("repo_id", "path", "name").agg(F.bool_or("is_public").alias("is_public")), ["repo_id", "path", "name"], "left")
    return out.select("repo_id", "path", "name", F.col("c.callee").alias("calls"), F.coalesce("is_public", F.lit(False)).alias("is_public"))


def change_context(calls: DataFrame, functions: DataFrame, changed: DataFrame) -> DataFrame:
    """Changed files with their functions (and public ones), the functions elsewhere that call them and what they call."""
    keys = ["repo_id", "path"]
    ch = changed.select(*keys).distinct()
    own = functions.join(ch, keys, "left_semi")
    held = own.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_functions"), F.count_if("is_public").alias("n_public"))
    names = own.select("repo_id", "path", F.col("name").alias("callee")).distinct()
    up = calls.select("repo_id", "callee", "caller_path", "caller").join(names, ["repo_id", "callee"]).where(F.col("caller_path") != F.col("path")).groupBy(*keys).agg(F.count_distinct("caller_path", "caller").alias("n_callers"))
    down = calls.select("repo_id", F.col("caller_path").alias("path"), "callee").join(ch, keys, "left_semi").groupBy(*keys).agg(F.count_distinct("callee").alias("n_callees"))
    z = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return ch.join(held, keys, "left").join(up, keys, "left").join(down, keys, "left").select(*keys, z("n_functions"), z("n_public"), z("n_callers"), z("n_callees"))


def affected_routes(routes: DataFrame, calls: DataFrame, functions: DataFrame, changed: DataFrame) -> DataFrame:
    """Routes in changed files, and routes whose handler (of the same file) calls a changed function."""
    keys = ["repo_id", "path"]
    own = routes.join(changed.select(*keys).distinct(), keys, "left_semi")
    hit = affected_functions(calls, functions, changed).select("repo_id", "path", F.col("name").alias("handler"))
    return own.unionByName(routes.join(hit, ["repo_id", "path", "handler"], "left_semi")).distinct()


def risk(n_functions: Column, n_routes: Column, n_public: Column) -> Column:
    """high above 10 functions or with any public one, medium above 3 or with routes, else low."""
    return F.when((n_public > 0) | (n_functions > 10), "high").when((n_functions > 3) | (n_routes > 0), "medium").otherwise("low")


def related_types(functions: DataFrame, types: DataFrame) -> DataFrame:
    """Types of the same file that a function's parameters or returns name, built-in ones aside."""
    t = functions.select("repo_id", "path", F.col("name").alias("function"), F.explode(F.concat("param_types", "returns")).alias("t"))
    named = t.select("repo_id", "path", "function", base_type("t").alias("name")).where(~F.col("name").isin(*BUILTIN_TYPES))
    return named.join(types.select("repo_id", "path", "name").distinct(), ["repo_id", "path", "name"]).distinct()


def type_usage(functions: DataFrame, types: DataFrame) -> DataFrame:
    """Functions of whose parameter or return types one contains a type's name, per type.

    Candidates come from the identifiers in the type texts, so no pair of unrelated rows is ever made; a name that is
    only part of an identifier does not count.
    """
    t = functions.select("repo_id", "path", F.col("name").alias("function"), F.explode(F.concat("param_types", "returns")).alias("t"))
    words = t.select("repo_id", "path", "function", F.explode(F.regexp_extract_all("t", F.lit(r"(\w+)"), F.lit(1))).alias("name"))
    # type names grow with the code, while their estimate counts one type per file's list: they must not be broadcast by it
    return words.join(types.select("repo_id", "name").distinct().hint("merge"), ["repo_id", "name"]).distinct()


def neighbours(files: DataFrame, changed: DataFrame, limit: int = 10) -> DataFrame:
    """Unchanged files of the directories of changed files, the first ``limit`` by path."""
    dirs = changed.select("repo_id", dirname("path").alias("dir")).distinct()
    near = files.withColumn("dir", dirname("path")).join(dirs, ["repo_id", "dir"], "left_semi").join(changed.select("repo_id", "path"), ["repo_id", "path"], "left_anti")
    return near.orderBy("repo_id", "path").limit(limit)


def severity_filter(comments: DataFrame, level: str) -> DataFrame:
    """Comments of at least a level: critical, important (with critical) or all; an unknown level keeps none."""
    keep = {"critical": ["critical"], "important": ["critical", "important"], "all": None}
    if level not in keep:
        return comments.where(F.lit(False))
    return comments if keep[level] is None else comments.where(F.col("severity").isin(*keep[level]))


def summary(functions: DataFrame, changed: DataFrame) -> DataFrame:
    """One row: changed files, their functions, public and internal ones."""
    f = functions.join(changed.select("repo_id", "path").distinct(), ["repo_id", "path"], "left_semi")
    a = f.agg(F.count(F.lit(1)).alias("n_functions"), F.count_if("is_public").alias("n_public"))
    return a.crossJoin(changed.select("repo_id", "path").distinct().agg(F.count(F.lit(1)).alias("n_files"))).select("n_files", "n_functions", "n_public", (F.col("n_functions") - F.col("n_public")).alias("n_internal"))
