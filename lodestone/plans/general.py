"""Queries of the general data problems, bound to the tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.firsts import first_k_per_key, key_profile
from ..operators.hierarchy import descendants, hierarchy, primary_callers
from ..operators.orphans import code_references, orphan_references
from ..operators.snapshots import snapshot_changes
from ..session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Three first-seen records of every callee and of every package."""
    edges = first_k_per_key(table(spark, d, "graph_edges"), "to_id", ["seen_at", "edge_id"], 3)
    nodes = first_k_per_key(table(spark, d, "graph_nodes"), "package", ["seen_at", "node_key"], 3)
    return edges.select(F.lit("to_id").alias("field_name"), F.col("edge_id").alias("row_id")).unionByName(
        nodes.select(F.lit("package").alias("field_name"), F.col("node_key").alias("row_id"))
    )


def p1_profile(spark: SparkSession, d: str) -> DataFrame:
    """Rows, first and last time of every callee and package, as delivered."""
    a = key_profile(table(spark, d, "graph_edges"), "to_id", "seen_at")
    b = key_profile(table(spark, d, "graph_nodes"), "package", "seen_at")
    cols = ["n_rows", "first_seen", "last_seen"]
    return a.select(F.lit("to_id").alias("field_name"), F.col("to_id").alias("key"), *cols).unionByName(b.select(F.lit("package").alias("field_name"), F.col("package").alias("key"), *cols))


def _tree(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy(primary_callers(table(spark, d, "graph_nodes"), table(spark, d, "graph_edges")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Path of every function from its entry function along primary callers, or the cycle it runs into."""
    return _tree(spark, d).select(F.col("node").alias("node_key"), F.col("path").alias("node_path"))


def p2_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """Depth, entry function and number of functions below, for every function."""
    return _tree(spark, d).select(F.col("node").alias("node_key"), "depth", F.col("root").alias("entry_key"), F.col("below").alias("n_below"))


def p2_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Every function below every function, with the distance."""
    return descendants(_tree(spark, d)).select(F.col("node").alias("node_key"), F.col("descendant").alias("descendant_key"), F.col("distance").cast("long").alias("distance"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """References in edges, call lists and internal calls to functions that do not exist at that time."""
    refs, parents = code_references(*(table(spark, d, t) for t in ("graph_nodes", "graph_edges", "function_calls")))
    return orphan_references(refs, parents)


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    """Number of orphan references per table and month."""
    return p4_found(spark, d).groupBy("table_name", "period").agg(F.count(F.lit(1)).alias("n_orphans"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Changes of repositories, files and functions between consecutive delivered snapshots."""
    return snapshot_changes(table(spark, d, "repo_snapshots"), table(spark, d, "function_snapshots"))


QUERIES = {f.__name__: f for f in (p1_found, p1_profile, p2_found, p2_hierarchy, p2_descendants, p4_found, p4_report, p5_found)}

_P2 = """
WITH RECURSIVE n AS (SELECT DISTINCT node_key, node_id, called_by FROM graph_nodes),
ids AS (SELECT node_id, min(node_key) AS k FROM graph_nodes GROUP BY 1),
listed AS (SELECT x.node_key, arg_min(ids.k, x.pos) AS p FROM (SELECT node_key, unnest(called_by) AS c, generate_subscripts(called_by, 1) AS pos FROM n) x JOIN ids ON ids.node_id = x.c GROUP BY 1),
first AS (SELECT to_id, arg_min(from_id, (seen_at, edge_id)) AS c FROM graph_edges WHERE to_id IS NOT NULL GROUP BY 1),
par AS (SELECT n.node_key AS k, CASE WHEN n.called_by IS NULL THEN ids.k ELSE listed.p END AS p
  FROM n LEFT JOIN listed USING (node_key) LEFT JOIN first ON first.to_id = n.node_id LEFT JOIN ids ON ids.node_id = first.c),
tree AS (SELECT k, CAST(k AS VARCHAR) AS path, 0 AS depth, k AS root FROM par WHERE p IS NULL
  UNION ALL SELECT par.k, tree.path || '/' || par.k, tree.depth + 1, tree.root FROM par JOIN tree ON par.p = tree.k),
off AS (SELECT k, p FROM par WHERE k NOT IN (SELECT k FROM tree)),
reach AS (SELECT k, p AS a FROM off UNION SELECT reach.k, off.p FROM reach JOIN off ON off.k = reach.a),
ring AS (SELECT k FROM reach WHERE k = a),
cyc AS (SELECT reach.k, min(reach.a) AS least FROM reach JOIN ring ON ring.k = reach.a GROUP BY 1)
"""

SQL = {
    "p1_found": """
WITH e AS (SELECT DISTINCT to_id, edge_id, seen_at FROM graph_edges WHERE to_id IS NOT NULL), n AS (SELECT DISTINCT package, node_key, seen_at FROM graph_nodes WHERE package IS NOT NULL)
SELECT 'to_id' AS field_name, edge_id AS row_id FROM (SELECT *, row_number() OVER (PARTITION BY to_id ORDER BY seen_at, edge_id) AS r FROM e) WHERE r <= 3
UNION ALL SELECT 'package', node_key FROM (SELECT *, row_number() OVER (PARTITION BY package ORDER BY seen_at, node_key) AS r FROM n) WHERE r <= 3""",
    "p1_profile": """
SELECT 'to_id' AS field_name, to_id AS key, count(*) AS n_rows, min(seen_at) AS first_seen, max(seen_at) AS last_seen FROM graph_edges WHERE to_id IS NOT NULL GROUP BY 2
UNION ALL SELECT 'package', package, count(*), min(seen_at), max(seen_at) FROM graph_nodes WHERE package IS NOT NULL GROUP BY 2""",
    "p2_found": _P2 + "SELECT k AS node_key, path AS node_path FROM tree UNION ALL SELECT k, 'cycle/' || least FROM cyc",
    "p2_hierarchy": _P2
    + """, up AS (SELECT unnest(string_split(path, '/')) AS a FROM tree), cnt AS (SELECT CAST(a AS BIGINT) AS k, count(*) - 1 AS n FROM up GROUP BY 1)
SELECT tree.k AS node_key, CAST(depth AS BIGINT) AS depth, root AS entry_key, n AS n_below FROM tree JOIN cnt USING (k) UNION ALL SELECT k, -1, least, -1 FROM cyc""",
    "p2_descendants": _P2
    + """, s AS (SELECT k, depth, unnest(string_split(path, '/')) AS a, generate_subscripts(string_split(path, '/'), 1) AS i FROM tree)
SELECT CAST(a AS BIGINT) AS node_key, k AS descendant_key, CAST(depth + 1 - i AS BIGINT) AS distance FROM s WHERE i <= depth""",
    "p4_found": """
WITH n AS (SELECT DISTINCT repo_id, node_id, func_name, file_path, seen_at, deleted_at FROM graph_nodes),
c AS (SELECT DISTINCT call_id, repo_id, callee, regexp_extract(regexp_replace(callee, '[()\\s]', '', 'g'), '[^.]*$') AS f, callee_file, seen_at FROM function_calls WHERE call_type = 'internal'),
r AS (SELECT 'graph_edges' AS table_name, edge_id AS row_id, to_id AS target_id, seen_at AS t FROM graph_edges WHERE to_id IS NOT NULL
  UNION SELECT 'graph_nodes', node_key, unnest(calls), refreshed_at FROM graph_nodes)
SELECT table_name, strftime(t, '%Y-%m') AS period, row_id, target_id FROM r WHERE target_id IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM n WHERE n.node_id = r.target_id AND n.seen_at <= r.t AND (n.deleted_at IS NULL OR n.deleted_at > r.t))
UNION ALL SELECT 'function_calls', strftime(seen_at, '%Y-%m'), call_id, callee FROM c WHERE callee IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM n WHERE n.repo_id = c.repo_id AND n.func_name = c.f AND (c.callee_file IS NULL OR n.file_path = c.callee_file) AND n.seen_at <= c.seen_at AND (n.deleted_at IS NULL OR n.deleted_at > c.seen_at))""",
    "p5_found": """
WITH d AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY snapshot_no) AS ord, lead(snapshot_no) OVER (PARTITION BY repo_id ORDER BY snapshot_no) AS nxt,
  lag(commit_hash) OVER (PARTITION BY repo_id ORDER BY snapshot_no) AS was
  FROM (SELECT repo_id, snapshot_no, arg_max(lower(commit_hash), ingested_at) AS commit_hash, arg_max(files, ingested_at) AS files FROM repo_snapshots WHERE files IS NOT NULL GROUP BY 1, 2)),
v AS (SELECT 'file' AS record_kind, repo_id, ord, snapshot_no, nxt, e.key AS item, e.value.file_hash AS val FROM (SELECT repo_id, ord, snapshot_no, nxt, unnest(map_entries(files)) AS e FROM d)
  UNION ALL SELECT 'function', repo_id, ord, snapshot_no, nxt, item, val FROM (SELECT repo_id, snapshot_no, file_path || ':' || func_name AS item,
    arg_max(regexp_replace(signature, '\\s+', '', 'g'), ingested_at) AS val FROM function_snapshots GROUP BY ALL) JOIN d USING (repo_id, snapshot_no)),
j AS (SELECT a.*, b.val AS was, b.item AS old, c.item AS later FROM v a LEFT JOIN v b ON b.record_kind = a.record_kind AND b.repo_id = a.repo_id AND b.item = a.item AND b.ord = a.ord - 1
  LEFT JOIN v c ON c.record_kind = a.record_kind AND c.repo_id = a.repo_id AND c.item = a.item AND c.ord = a.ord + 1)
SELECT 'repo' AS record_kind, snapshot_no, repo_id, '' AS item, 'changed' AS change_kind FROM d WHERE ord > 1 AND NOT starts_with(commit_hash, lower(was)) AND NOT starts_with(lower(was), commit_hash)
UNION ALL SELECT record_kind, snapshot_no, repo_id, item, 'added' FROM j WHERE old IS NULL AND ord > 1
UNION ALL SELECT record_kind, snapshot_no, repo_id, item, 'changed' FROM j WHERE old IS NOT NULL AND was IS DISTINCT FROM val
UNION ALL SELECT record_kind, nxt, repo_id, item, 'removed' FROM j WHERE later IS NULL AND nxt IS NOT NULL""",
}
SQL["p4_report"] = f"SELECT table_name, period, count(*) AS n_orphans FROM ({SQL['p4_found']}) GROUP BY 1, 2"
