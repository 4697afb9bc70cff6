"""Data tables in the roles of the code-knowledge entities, as DataFrames and as equal SQL views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.orphans import bare_callee
from ..session import table


def functions(spark: SparkSession, d: str) -> DataFrame:
    """One row per function of the call graph; its key serves as its line."""
    n = table(spark, d, "graph_nodes").select(
        "repo_id", F.col("file_path").alias("path"), F.col("func_name").alias("name"), F.coalesce("signature", F.lit("")).alias("signature"), F.coalesce("package", F.lit("")).alias("package"),
        F.coalesce("is_public", F.lit(False)).alias("is_public"), F.col("node_key").alias("line_start"), "node_id",
    )
    return n.dropDuplicates(["line_start"])


def calls(spark: SparkSession, d: str) -> DataFrame:
    """One row per call reference; callees by their bare names."""
    c = table(spark, d, "function_calls").dropDuplicates(["call_id"])
    return c.select("repo_id", "caller_path", "caller", bare_callee(F.col("callee")).alias("callee"), "callee_package", "callee_file", "line", "call_type", "call_id")


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Distinct caller and callee ids of the call edges with a target."""
    return table(spark, d, "graph_edges").where(F.col("to_id").isNotNull()).select("from_id", "to_id").distinct()


def files(spark: SparkSession, d: str, snapshot: int | None = None) -> DataFrame:
    """Files of each repository's last delivered snapshot (or of the one with a number): path without the repository's own folder."""
    s = table(spark, d, "repo_snapshots").where(F.col("files").isNotNull())
    s = s.where(F.col("snapshot_no") == snapshot) if snapshot else s
    last = s.groupBy("repo_id").agg(F.max_by("files", F.struct("snapshot_no", "ingested_at")).alias("files"))
    return last.select("repo_id", F.explode("files").alias("p", "f")).select("repo_id", F.regexp_replace("p", "^[^/]*/", "").alias("path"), F.col("f.file_hash").alias("hash"), F.col("f.line_count").alias("line_count"))


def usage(spark: SparkSession, d: str) -> DataFrame:
    """Events as tool calls: k of the properties is the input, its double the output, and success from 10 on."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, d, "events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("tool"), k.alias("input_tokens"), (k * 2).alias("output_tokens"), F.col("value").cast("long").alias("duration_ms"), (k >= 10).alias("success"), F.col("ts").alias("timestamp")
    )


def titles(spark: SparkSession, d: str) -> DataFrame:
    """Pull requests' titles as natural-language queries."""
    return table(spark, d, "pull_requests").select("pr_id", F.coalesce("title", F.lit("")).alias("query"))


SQL = {
    "fn": """(SELECT DISTINCT repo_id, file_path AS path, func_name AS name, coalesce(signature, '') AS signature, coalesce(package, '') AS package, coalesce(is_public, false) AS is_public, node_key AS line_start, node_id FROM graph_nodes)""",
    "calls": """(SELECT DISTINCT repo_id, caller_path, caller, regexp_extract(regexp_replace(callee, '[()\\s]', '', 'g'), '[^.]*$') AS callee, callee_package, callee_file, line, call_type, call_id FROM function_calls)""",
    "edges": "(SELECT DISTINCT from_id, to_id FROM graph_edges WHERE to_id IS NOT NULL)",
    "usage": """(SELECT event_id AS id, event_type AS tool, CAST(props->>'$.k' AS INT) AS input_tokens, 2 * CAST(props->>'$.k' AS INT) AS output_tokens, CAST(trunc(value) AS BIGINT) AS duration_ms, CAST(props->>'$.k' AS INT) >= 10 AS success, ts AS timestamp FROM events)""",
    "titles": "(SELECT pr_id, coalesce(title, '') AS query FROM pull_requests)",
}


def files_sql(snapshot: int | None = None) -> str:
    """SQL view of :func:`files`."""
    cond = f"AND snapshot_no = {snapshot}" if snapshot else ""
    return f"""(SELECT repo_id, regexp_replace(e.key, '^[^/]*/', '') AS path, e.value.file_hash AS hash, e.value.line_count AS line_count FROM (SELECT repo_id, unnest(map_entries(files)) AS e FROM
      (SELECT repo_id, arg_max(files, (snapshot_no, ingested_at)) AS files FROM repo_snapshots WHERE files IS NOT NULL {cond} GROUP BY 1)))"""


SQL["files"] = files_sql()
