"""Call graphs: resolution, callers, traversal to a depth, trees and text forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import dot_text, mermaid_text, node_id
from ..session import cut


def internal(calls: DataFrame) -> DataFrame:
    """Calls that may lead to a function of the same repository."""
    return calls.where((F.coalesce("callee_package", F.lit("")) == "") | (F.coalesce("call_type", F.lit("")).isin("", "internal")))


def resolve_calls(calls: DataFrame, functions: DataFrame, resolve: str = "all") -> DataFrame:
    """Edges (repo_id, from_id, to_id, line, call_type) of internal calls by the callee's name.

    ``all`` links a call with every file that has the name, ``first`` with the smallest path. A missing call type is
    ``direct``. Names that no function has give no edge.
    """
    f = functions.select("repo_id", F.col("name").alias("callee"), "path").distinct()
    if resolve == "first":
        f = f.groupBy("repo_id", "callee").agg(F.min("path").alias("path"))
    j = internal(calls).join(f, ["repo_id", "callee"])
    return j.select("repo_id", F.concat_ws(":", "caller_path", "caller").alias("from_id"), F.concat_ws(":", "path", "callee").alias("to_id"), "line", F.coalesce("call_type", F.lit("direct")).alias("call_type")).distinct()


def callers(calls: DataFrame, name: str, distinct: bool = True) -> DataFrame:
    """Who calls a name: once per calling function, or every call."""
    hit = calls.where(F.col("callee") == name)
    return hit.groupBy("repo_id", "caller_path", "caller").agg(F.min("line").alias("line")) if distinct else hit.select("repo_id", "caller_path", "caller", "line")


def callees(calls: DataFrame, caller: str) -> DataFrame:
    """What a function calls, by line."""
    return calls.where(F.col("caller") == caller).select("repo_id", "callee", "callee_package", "line", "call_type").orderBy("line", "callee")


def called_by(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """(repo_id, path, name, n_callers): internal calls of each function's name, from anywhere in its repository."""
    n = internal(calls).groupBy("repo_id", F.col("callee").alias("name")).agg(F.count(F.lit(1)).alias("n_callers"))
    return functions.select("repo_id", "path", "name").distinct().join(n, ["repo_id", "name"], "left").select("repo_id", "path", "name", F.coalesce("n_callers", F.lit(0)).alias("n_callers"))


def bfs(edges: DataFrame, start: DataFrame, depth: int, source: str = "from_id", target: str = "to_id") -> DataFrame:
    """(node, level) of all nodes within ``depth`` steps of the start nodes, each at its smallest level.

    The distinct edges are written once; then one join a level, of the frontier only (Spark broadcasts a small one, so
    that the edges stay where they are), and visited nodes are taken out by an anti join. Depth is cut to 1..5.
    """
    e = cut(edges.select(F.col(source).alias("node"), F.col(target).alias("next")).where(F.col("next").isNotNull()).distinct())
    seen = start.select("node").distinct().withColumn("level", F.lit(0))
    front = seen
    for level in range(1, max(1, min(depth, 5)) + 1):
        nxt = front.select("node").join(e, "node").select(F.col("next").alias("node")).distinct()
        front = cut(nxt.join(seen.select("node"), "node", "left_anti").withColumn("level", F.lit(level)))
        seen = seen.unionByName(front)
    return seen


def neighbourhood(edges: DataFrame, node: str, depth: int, callers_depth: int = 1) -> DataFrame:
    """Edges around a node: forward to ``depth``, backward to ``callers_depth``; each once."""
    start = edges.sparkSession.createDataFrame([(node,)], "node string")
    ahead = bfs(edges, start, depth).where(F.col("level") < max(1, min(depth, 5))).select(F.col("node").alias("from_id"))
    back = bfs(edges, start, callers_depth, "to_id", "from_id").where(F.col("level") < max(1, min(callers_depth, 5))).select(F.col("node").alias("to_id"))
    e = edges.select("from_id", "to_id").where(F.col("to_id").isNotNull()).distinct()
    return e.join(ahead, "from_id", "left_semi").unionByName(e.join(back, "to_id", "left_semi").select("from_id", "to_id")).distinct()


def call_tree(edges: DataFrame, node: str, depth: int, callers: bool = False) -> DataFrame:
    """(node, level, parent): nodes reached, each below its smallest predecessor of the level before; against the calls
    with ``callers``."""
    if callers:
        edges = edges.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"))
    start = edges.sparkSession.createDataFrame([(node,)], "node string")
    levels = bfs(edges, start, depth)
    up = levels.select(F.col("node").alias("parent"), (F.col("level") + 1).alias("level"))
    e = edges.select(F.col("from_id").alias("parent"), F.col("to_id").alias("node")).where(F.col("node").isNotNull()).distinct()
    p = levels.join(e, "node").join(up, ["parent", "level"]).groupBy("node", "level").agg(F.min("parent").alias("parent"))
    return levels.join(p, ["node", "level"], "left")


def file_calls(calls: DataFrame) -> DataFrame:
    """Distinct (callee, package) of each file."""
    return calls.select("repo_id", "caller_path", "callee", F.coalesce("callee_package", F.lit("")).alias("callee_package")).distinct()


def mermaid(edges: DataFrame) -> DataFrame:
    """Lines of a Mermaid graph, one an edge (ids with all but letters and digits as underscores, labels escaped)."""
    return edges.select(F.concat(F.lit("    "), node_id("from_id"), F.lit('["'), mermaid_text("from_id"), F.lit('"] --> '), node_id("to_id"), F.lit('["'), mermaid_text("to_id"), F.lit('"]')).alias("line"))


def dot(edges: DataFrame) -> DataFrame:
    """Lines of a DOT graph, one an edge."""
    return edges.select(F.concat(F.lit('  "'), dot_text("from_id"), F.lit('" -> "'), dot_text("to_id"), F.lit('";')).alias("line"))


def caller_details(calls: DataFrame, functions: DataFrame, name: str) -> DataFrame:
    """Callers of a name with their signatures, null where a caller is unknown."""
    f = functions.groupBy("repo_id", F.col("path").alias("caller_path"), F.col("name").alias("caller")).agg(F.min("signature").alias("signature"))
    return callers(calls, name).join(f, ["repo_id", "caller_path", "caller"], "left")


def function_context(calls: DataFrame, repo_id: str, path: str, name: str) -> DataFrame:
    """A function's neighbours: (relation, path, name, line) of its callers in the repository and of its callees."""
    own = calls.where(F.col("repo_id") == repo_id)
    up = own.where(F.col("callee") == name).select(F.lit("caller").alias("relation"), F.col("caller_path").alias("path"), F.col("caller").alias("name"), "line")
    down = own.where((F.col("caller") == name) & (F.col("caller_path") == path)).select(F.lit("callee").alias("relation"), F.col("callee_file").alias("path"), F.col("callee").alias("name"), "line")
    return up.unionByName(down).distinct()
