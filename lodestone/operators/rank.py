"""Relevance scores and token budgets."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ask_keywords
from ..session import cut


def _holds(c: Column, k: Column) -> Column:
    return F.contains(F.lower(F.coalesce(c, F.lit(""))), k).cast("double")


def _score(keywords: Column, one) -> Column:
    return F.aggregate(keywords, F.lit(0.0), lambda s, k: s + one(k))


def keyword_score(query: Column, name: Column, signature: Column, description: Column, summary: Column, public: Column) -> Column:
    """Per query word of three bytes or more: 3 for the name, 1 signature, 1.5 description, 2 summary; 1.2-fold if public."""
    words = F.filter(F.split(F.lower(query), r"\s+"), lambda w: F.octet_length(w) >= 3)
    s = _score(words, lambda k: 3.0 * _holds(name, k) + _holds(signature, k) + 1.5 * _holds(description, k) + 2.0 * _holds(summary, k))
    return F.when(F.coalesce(public, F.lit(False)), s * 1.2).otherwise(s)


def relevance(keywords: Column, name: Column, description: Column, signature: Column, summary: Column) -> Column:
    """Share of keywords in the texts together, each in the name half as much again; 0 without keywords."""
    text = F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in (name, description, signature, summary)])
    s = _score(keywords, lambda k: _holds(text, k) * (1.0 + 0.5 * _holds(name, k)))
    return F.when(F.size(keywords) > 0, s / F.nullif(F.size(keywords), F.lit(0))).otherwise(0.0)


def query_type(query: Column) -> Column:
    """Kind of question: architecture, compare, explain, search or general; the first whose words occur."""
    q = F.lower(query)
    rules = (  # fixed values: words of each kind, in order of precedence
        ("architecture", "architecture|structure|design|pattern|layer|module|component|organized|layout"), ("compare", "compare|difference|different|versus|vs|between|similar"),
        ("explain", "how does|how do|explain|what does|why does|describe|works"), ("search", "where is|find|locate|which file|search|looking for"),
    )
    out = F.lit("general")
    for kind, words in reversed(rules):
        out = F.when(q.rlike(words), kind).otherwise(out)
    return out


def question_function_score(query: Column, name: Column, description: Column, signature: Column, public: Column) -> Column:
    """Score of a function for a question: keywords in name 3, description 1.5, signature 1; public 1, main 2, and 1.5 for entry code if architecture is asked."""
    s = _score(ask_keywords(query), lambda k: 3.0 * _holds(name, k) + 1.5 * _holds(description, k) + _holds(signature, k))
    s = s + F.coalesce(public, F.lit(False)).cast("double") + F.lower(name).isin("main").cast("double") * 2.0
    return s + ((query_type(query) == "architecture") & F.lower(name).rlike("handler|server|init|new")).cast("double") * 1.5


def question_file_score(query: Column, path: Column, purpose: Column, exports: Column) -> Column:
    """Score of a file for a question; half for tests, none for vendored code."""
    low = F.lower(path)
    names = F.coalesce(exports, F.array().cast("array<string>"))
    s = _score(ask_keywords(query), lambda k: 2.0 * _holds(path, k) + 1.5 * _holds(purpose, k) + F.aggregate(names, F.lit(0.0), lambda n, e: n + _holds(e, k)))
    kind = query_type(query)
    s = s + F.when(kind == "architecture", F.contains(low, F.lit("main")).cast("double") * 2.0 + low.rlike("config|server").cast("double") * 1.5).when(kind == "explain", F.size(names) * 0.1).otherwise(0.0)
    s = F.when(path.endswith("_test.go"), s * 0.5).otherwise(s)
    return F.when(low.rlike("vendor/|node_modules/"), 0.0).otherwise(s)


def question_type_score(query: Column, name: Column, description: Column, fields: Column, methods: Column, public: Column, kind: Column) -> Column:
    """Score of a type for a question."""
    z = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    each = lambda a, k: F.aggregate(z(a), F.lit(0.0), lambda n, e: n + 0.5 * _holds(e, k))
    s = _score(ask_keywords(query), lambda k: 3.0 * _holds(name, k) + 1.5 * _holds(description, k) + each(fields, k) + each(methods, k))
    return s + F.coalesce(public, F.lit(False)).cast("double") + (kind == "interface").cast("double") + (F.size(z(methods)) > 3).cast("double") * 0.5


def file_priority(path: Column) -> Column:
    low = F.lower(path)
    return F.when(low.rlike("handler|controller"), 1).when(low.rlike("model|entity"), 2).otherwise(3)


def prefix_budget(df: DataFrame, by: list[str], order: list[str], cost: str, budget: int) -> DataFrame:
    """Rows of each group in order while their costs (never negative) fit; the first overflow ends it. Adds ``used``.

    Groups are cut along their order into ranges: running sums within a range, and the sums of the ranges before it (as
    many rows as a group has ranges), so that a group with most of the rows is no single task.
    """
    part = cut(df.repartitionByRange(*by, *order).withColumn("__part", F.spark_partition_id()))
    w = Window.partitionBy(*by, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = part.groupBy(*by, "__part").agg(F.sum(cost).alias("__sum")).withColumn("__before", F.coalesce(F.sum("__sum").over(before), F.lit(0)))
    ranges = sums.where(F.col("__before") <= budget).select(*[F.col(c).alias(f"__{c}") for c in by], F.col("__part").alias("__p"), "__before")
    same = F.col("__part") == F.col("__p")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    # ranges that begin beyond the budget take no part in the sums
    near = part.join(ranges, same).withColumn("used", F.sum(cost).over(w) + F.col("__before")).where(F.col("used") <= budget)
    return near.select(*df.columns, "used")


def _folding(budget: int, has_short: bool, most: int | None):
    """Arrow function over rows sorted by group and score: one running sum, whatever the number of candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, used, seen, begun = None, 0, 0, False
        for b in batches:
            at, forms, sums = [], [], []
            for i, (q, c, m) in enumerate(zip(b.column("q").to_pylist(), b.column("c").to_pylist(), b.column("m").to_pylist())):
                if not begun or q != group:
                    group, used, seen, begun = q, 0, 0, True
                seen += 1
                if most and seen > most:
                    continue
                full = used + c <= budget
                if full or has_short and used + m <= budget:
                    used += c if full else m
                    at.append(i)
                    forms.append("full" if full else "summary")
                    sums.append(used)
            if at:
                yield pa.RecordBatch.from_arrays([b.column("q").take(pa.array(at)), b.column("k").take(pa.array(at)), pa.array(forms), pa.array(sums, pa.int64())], ["q", "k", "form", "used"])

    return run


def pack(candidates: DataFrame, by: str, key: str, score: str, cost: str, budget: int, summary_cost: str | None = None, most: int | None = None) -> DataFrame:
    """Greedy budget per query: by score (ties by key), what does not fit is tried in its summary form, else skipped.

    Output: by, key, form (full or summary), used after it. The candidates of a query are sorted and streamed past one
    running sum, so that no list of them is ever held; those whose cheapest form alone exceeds the budget are dropped
    before, as they can never be taken. Null scores and costs take no part. ``most`` bounds a query's candidates to the
    best-scored ones (a report's own limit); unset, all take part.
    """
    small = F.col(summary_cost) if summary_cost else F.col(cost)
    rows = candidates.where((F.least(F.col(cost), small) <= budget) & F.lit(budget > 0) & F.col(score).isNotNull()).select(F.col(by).alias("q"), F.col(key).alias("k"), F.col(score).cast("double").alias("s"), F.col(cost).cast("long").alias("c"), small.cast("long").alias("m"))
    kinds = f"q {candidates.schema[by].dataType.simpleString()}, k {candidates.schema[key].dataType.simpleString()}, form string, used long"
    ordered = rows.repartition("q").sortWithinPartitions("q", F.desc("s"), "k")
    return ordered.mapInArrow(_folding(budget, summary_cost is not None, most), kinds).select(F.col("q").alias(by), F.col("k").alias(key), "form", "used")


def top_per_category(df: DataFrame, category: str, score: str, ties: list[str], limits: dict[str, int]) -> DataFrame:
    """The best rows of each category with a limit, positive scores only; ties by the given columns. Adds ``place``."""
    w = Window.partitionBy(category).orderBy(F.desc(score), *ties)
    most = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv])
    return df.where((F.col(score) > 0) & F.col(category).isin(*limits)).withColumn("place", F.row_number().over(w)).where(F.col("place") <= F.try_element_at(most, F.col(category)))


def page(df: DataFrame, order: list[str], limit: int, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """(rows of a page, one row with has_more and next_offset); a limit that isn't positive counts as 20."""
    n = limit if limit > 0 else 20
    ahead = df.orderBy(*order).offset(offset).limit(n + 1)
    more = ahead.agg((F.count(F.lit(1)) > n).alias("has_more")).select("has_more", F.when(F.col("has_more"), offset + n).otherwise(0).alias("next_offset"))
    return df.orderBy(*order).offset(offset).limit(n), more


# fixed values: default and upper limits of results
LIMITS = {"search": (20, 100), "semantic": (10, 50), "concept": (20, 100), "budget": (4000, 32_000), "depth": (2, 5)}


def clamp(kind: str, asked: int | None) -> int:
    """The limit to use: the default where none or none above zero is asked, at most the upper one."""
    default, most = LIMITS[kind]
    return default if not asked or asked <= 0 else min(asked, most)
