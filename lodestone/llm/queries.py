"""Queries of the text problems, bound to the tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .bpe import encode, token_counts
from .neardup import similar_records, similarity_classes
from .packing import pack
from .secrets import credentials, redacted
from .stuffing import stuffed_pages

#: Signatures with this share of common words belong together.
SIGNATURE_SIMILARITY = 0.6
_SIGNED = (("graph_nodes", "node_key"), ("duplicate_instances", "instance_id"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of records of one table with similar signatures."""
    a, b = (similar_records(table(spark, d, t), k, "signature", SIGNATURE_SIMILARITY).select(F.lit(t).alias("table_name"), "a_key", "b_key") for t, k in _SIGNED)
    return a.unionByName(b)


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every signed record with its class of equal signatures and its number of similar records."""
    a, b = (similarity_classes(table(spark, d, t), k, "signature", SIGNATURE_SIMILARITY).select(F.lit(t).alias("table_name"), F.col("key").alias("row_key"), "class_key", "n_links") for t, k in _SIGNED)
    return a.unionByName(b)


def _patches(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """All patches and diffs with the pull request they belong to, and the repositories that own the pull requests."""
    pulls = table(spark, d, "pull_requests")
    files = table(spark, d, "pr_files").select(F.lit("pr_files").alias("table_name"), F.col("pr_file_id").alias("row_id"), F.col("pr_id").alias("owner"), F.col("patch").alias("text"))
    texts = files.unionByName(pulls.select(F.lit("pull_requests").alias("table_name"), F.col("pr_id").alias("row_id"), F.col("pr_id").alias("owner"), F.col("diff").alias("text")))
    return texts, pulls.select(F.col("pr_id").alias("owner"), F.col("repo_id").alias("name"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines of patches and diffs on which a literal credential starts."""
    texts, owners = _patches(spark, d)
    return credentials(texts, owners=owners).select("table_name", "row_id", "line_no").distinct()


def p6_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Every patch and diff with only its credentials replaced."""
    texts, owners = _patches(spark, d)
    return redacted(texts, credentials(texts, owners=owners))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids of every document's text."""
    return encode(table(spark, d, "documents"), "doc_id", "text").select(F.col("key").alias("doc_id"), "ids")


def _packed(spark: SparkSession, d: str, budget: str) -> tuple[DataFrame, int]:
    capacity = table(spark, d, "budgets").where(F.col("budget_name") == budget).agg(F.max("max_tokens")).first()[0]
    return pack(token_counts(table(spark, d, "documents"), "doc_id", "text"), capacity), capacity


def p8_contexts(spark: SparkSession, d: str) -> DataFrame:
    """Every text of at least one token in contexts of the normal budget."""
    packed, _ = _packed(spark, d, "normal")
    return packed.select(F.col("context").alias("context_id"), F.col("key").alias("doc_id"), F.col("piece").alias("piece_no"), F.col("start").alias("token_start"), F.col("size").alias("n_tokens"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the contexts of the normal budget are."""
    packed, capacity = _packed(spark, d, "normal")
    per = packed.groupBy("context").agg(F.sum("size").alias("used"), F.count(F.lit(1)).alias("pieces"))
    used = F.sum("used")
    return per.agg(
        F.lit(capacity).alias("max_tokens"), F.count(F.lit(1)).alias("n_contexts"), F.sum("pieces").alias("n_pieces"), used.alias("n_tokens"), F.max("used").alias("fullest"),
        F.ceil(used / capacity).alias("least_contexts"), F.round(used / (F.count(F.lit(1)) * capacity), 6).alias("fill"),
    )


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that are keyword stuffing or lists of links."""
    return stuffed_pages(table(spark, d, "documents"), "doc_id", "text").select(F.col("key").alias("doc_id"))


QUERIES = {f.__name__: f for f in (p3_found, p3_classes, p6_found, p6_redacted, p7_ids, p8_contexts, p8_fill, p9_found)}

_SETS = " UNION ALL ".join(
    f"SELECT '{t}' AS t, k, w FROM (SELECT DISTINCT {k} AS k, list_sort(list_distinct(list_transform(regexp_extract_all(signature, '[A-Za-z0-9]+'), lambda x: lower(x)))) AS w FROM {t} WHERE signature IS NOT NULL) WHERE len(w) > 0" for t, k in _SIGNED
)
_PAIRS = f"""WITH s AS ({_SETS}), u AS (SELECT t, k, len(w) AS n, unnest(w) AS x FROM s),
p AS (SELECT a.t, a.k AS a, b.k AS b FROM u a JOIN u b ON a.t = b.t AND a.x = b.x AND a.k < b.k GROUP BY a.t, a.k, b.k, a.n, b.n HAVING count(*) * 10 >= 6 * (a.n + b.n - count(*)))"""

SQL: dict[str, str] = {
    "p3_found": _PAIRS + " SELECT t AS table_name, a AS a_key, b AS b_key FROM p",
    "p3_classes": _PAIRS
    + """, c AS (SELECT t, w, min(k) AS class_key FROM s GROUP BY ALL), l AS (SELECT t, k, count(*) AS n FROM (SELECT t, a AS k FROM p UNION ALL SELECT t, b FROM p) GROUP BY ALL)
SELECT s.t AS table_name, s.k AS row_key, class_key, coalesce(l.n, 0) AS n_links FROM s JOIN c ON c.t = s.t AND c.w = s.w LEFT JOIN l ON l.t = s.t AND l.k = s.k""",
}
