"""Parent-child links to full hierarchies: path, depth, root, descendants and cycles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, drop

#: Nodes that one task peels at once; a larger locality group is split.
BLOCK_NODES = 400_000


def peel(keys: np.ndarray, parents: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Leaf peeling of one block.

    ``parents`` holds row numbers, -1 where the parent is absent or outside. Leaves are peeled upwards level by level,
    each sending its subtree size to its parent; what never becomes a leaf lies on a cycle. In reverse peel order every
    node then takes path, depth and root from its parent.

    Returns path (keys from the local root, or ``cycle/<smallest key>``), depth, root key, nodes below (-1 on or below
    a cycle: not a tree) and the smallest key on the path.
    """
    n = len(keys)
    degree = np.bincount(parents[parents >= 0], minlength=n)
    below = np.zeros(n, np.int64)
    levels, front = [], np.flatnonzero(degree == 0)
    while len(front):
        levels.append(front)
        up = parents[front]
        has = up >= 0
        up = up[has]
        np.add.at(below, up, below[front[has]] + 1)
        np.subtract.at(degree, up, 1)
        up = np.unique(up)
        front = up[degree[up] == 0]
    text = keys.astype(str).astype(object)
    path = np.full(n, "", object)
    depth, root, low = np.zeros(n, np.int64), keys.copy(), keys.copy()
    cyclic = degree > 0
    for i in np.flatnonzero(cyclic):
        if not path[i]:
            ring, j = [], i
            while not ring or j != i:
                ring.append(j)
                j = parents[j]
            least = keys[ring].min()
            for j in ring:
                path[j], depth[j], root[j], low[j] = f"cycle/{least}", -1, least, least
    below[cyclic] = -1
    for front in reversed(levels):
        up = parents[front]
        top = np.maximum(up, 0)
        tied = (up >= 0) & (depth[top] < 0)
        tree = (up >= 0) & ~tied
        depth[front] = np.where(tied, -1, np.where(tree, depth[top] + 1, 0))
        root[front] = np.where(up >= 0, root[top], keys[front])
        low[front] = np.where(tree, np.minimum(low[top], keys[front]), np.where(tied, low[top], keys[front]))
        path[front] = np.where(up < 0, text[front], np.where(tied, path[top], path[top] + ("/" + text[front])))
    return path.tolist(), depth, root, below, low


_LOCAL = "block long, node long, out_parent long, path string, depth long, top long, below long, low long"


def _peel_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Peel all blocks of one partition together: links between blocks count as outside even where both are at hand."""
    rows = [b for b in batches if b.num_rows]
    if not rows:
        return
    t = pa.Table.from_batches(rows)
    block, node = t["block"].to_numpy(), t["node"].to_numpy()
    parent, at = t["parent"].fill_null(-(2**62)).to_numpy(), t["parent_block"].fill_null(-(2**62)).to_numpy()
    known = t["parent"].is_valid().to_numpy()
    order = np.argsort(node)
    pos = np.minimum(np.searchsorted(node[order], parent), len(node) - 1)
    up = order[pos]
    inside = known & (node[up] == parent) & (block == at)
    path, depth, top, below, low = peel(node, np.where(inside, up, -1))
    outside = pa.array(np.where(known & ~inside, parent, 0), mask=~(known & ~inside))
    for i in range(0, len(node), 20_000):
        j = slice(i, i + 20_000)
        cols = [pa.array(block[j]), pa.array(node[j]), outside[j], pa.array(path[j]), pa.array(depth[j]), pa.array(top[j]), pa.array(below[j]), pa.array(low[j])]
        yield pa.RecordBatch.from_arrays(cols, ["block", "node", "out_parent", "path", "depth", "top", "below", "low"])


def _chains(tops: DataFrame) -> DataFrame:
    """Paths above the local tops of blocks, by pointer doubling over the contracted links.

    ``tops``: node, ptr (local top of the outside parent, null where the chain is known to end), chain (keys from that
    top to the parent, or ``cycle/...``), low (smallest key among them). A round doubles the length that each top has
    walked, so the number of rounds is the logarithm of the links between blocks on the longest chain, and it reads and
    writes only the tops that still walk. Finite chains have suffixes of every length: once a round ends none, all that
    walk run into cycles; where they stand after as many steps as there are of them lies on the cycle.
    """
    walk = cut(tops.where(F.col("ptr").isNotNull()).select("node", "ptr", "low"))
    n, before, steps = walk.count(), -1, 1
    while n and not (n == before and steps > n):
        nxt = walk.select(F.col("node").alias("ptr"), F.col("ptr").alias("__p"), F.col("low").alias("__l"))
        more = cut(walk.join(nxt, "ptr").select("node", F.col("__p").alias("ptr"), F.least("low", "__l").alias("low")))
        drop(walk)
        walk, before, n, steps = more, n, more.count(), steps * 2
    ahead = walk.select(F.col("node").alias("ptr"), F.col("low").alias("least"))
    chains = cut(walk.join(ahead, "ptr").select("node", F.concat(F.lit("cycle/"), "least").alias("chain")))
    rest = tops.join(walk.select("node"), "node", "left_anti").select("node", "ptr", "chain")
    ended, walk = F.col("ptr").isNull(), cut(rest)
    chains, walk = chains.unionByName(walk.where(ended).select("node", "chain")), walk.where(~ended)
    while walk.limit(1).count():
        nxt = chains.select("node", F.lit(None).cast("long").alias("__p"), F.col("chain").alias("__c")).unionByName(walk.select("node", F.col("ptr").alias("__p"), F.col("chain").alias("__c")))
        chain = F.when(F.col("__c").isNull(), F.col("chain")).when(F.col("__c").startswith("cycle/"), F.col("__c")).otherwise(F.concat("__c", F.lit("/"), "chain"))
        more = cut(walk.join(nxt.withColumnRenamed("node", "ptr"), "ptr", "left").select("node", F.col("__p").alias("ptr"), chain.alias("chain")))
        chains, walk = chains.unionByName(more.where(ended).select("node", "chain")), more.where(~ended)
    return chains


def hierarchy(links: DataFrame, block_nodes: int = BLOCK_NODES) -> DataFrame:
    """Full path, depth, root and number of descendants of every node.

    ``links``: node (long), parent (long or null), locality (text: groups in which most links stay). Output: node, path
    (keys from the root joined by ``/``; ``cycle/<smallest key on the cycle>`` where the parents never end), depth (0
    for a root), root, below (number of nodes below it); depth and below are -1 and root is the cycle's smallest key
    where the parents never end.

    Nodes are laid out in blocks of one locality group; a group of more than ``block_nodes`` is split, small groups
    share a task. Each block is peeled from its leaves (:func:`peel`) in one task. Links that leave a block meet a
    contracted graph of local roots only, solved by pointer doubling on all executors.

    A parent that is no node counts as none. Null nodes are left out; of repeated nodes the smallest parent holds. A
    null locality is a group of its own. Empty input gives an empty result.
    """
    spark = links.sparkSession
    nodes = links.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("parent").alias("parent"), F.min(F.coalesce("locality", F.lit(""))).alias("locality"))
    sizes = nodes.groupBy("locality").agg(F.count(F.lit(1)).alias("n"))
    placed = cut(
        nodes.join(sizes, "locality").select(
            "node", "parent",
            F.when(F.col("n") <= block_nodes, F.xxhash64("locality"))
            .otherwise(F.xxhash64("locality", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / block_nodes)))).alias("block"),
        )
    )
    where = placed.select(F.col("node").alias("parent"), F.col("block").alias("parent_block"))
    known = placed.join(where, "parent", "left").select("block", "node", F.when(F.col("parent_block").isNotNull(), F.col("parent")).alias("parent"), "parent_block")
    # no task gets more than about a block, however many nodes there are
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-2 * placed.count() // block_nodes), 1)
    local = cut(known.repartition(parts, "block").mapInArrow(_peel_blocks, _LOCAL))
    result = local.select("node", "path", "depth", F.col("top").alias("root"), F.when(F.col("depth") < 0, -1).otherwise(F.col("below")).alias("below"))
    out = local.where(F.col("out_parent").isNotNull()).select("node", "out_parent", F.col("below").alias("size"))
    if not out.limit(1).count():
        return result
    above = local.select(F.col("node").alias("out_parent"), F.when(F.col("depth") >= 0, F.col("top")).alias("ptr"), F.col("path").alias("chain"), "low")
    chains = _chains(cut(out.join(above, "out_parent").select("node", "ptr", "chain", "low")))
    # subtree sizes of the local tops go to all nodes of the chain above them
    sent = chains.where(~F.col("chain").startswith("cycle/")).join(out, "node").select(F.explode(F.split("chain", "/")).alias("a"), (F.col("size") + 1).alias("s"))
    extra = sent.groupBy(F.col("a").cast("long").alias("node")).agg(F.sum("s").alias("extra"))
    high = chains.select(F.col("node").alias("root"), F.col("chain").alias("chain"))
    full = result.join(high, "root", "left").join(extra, "node", "left")
    path = F.when(F.col("chain").isNull() | (F.col("depth") < 0), F.col("path")).when(F.col("chain").startswith("cycle/"), F.col("chain")).otherwise(F.concat("chain", F.lit("/"), "path"))
    cyc, steps = F.col("full").startswith("cycle/"), F.split("full", "/")
    return full.withColumn("full", path).select(
        "node", F.col("full").alias("path"),
        F.when(cyc, -1).otherwise(F.size(steps) - 1).cast("long").alias("depth"),
        F.when(cyc, F.get(steps, F.lit(1))).otherwise(F.get(steps, F.lit(0))).cast("long").alias("root"),
        F.when(cyc, -1).otherwise(F.col("below") + F.coalesce("extra", F.lit(0))).cast("long").alias("below"),
    )


def descendants(tree: DataFrame) -> DataFrame:
    """All (node, descendant, distance) of a result of :func:`hierarchy`, as rows: no list grows with a subtree.

    Nodes whose parents never end have no place in a tree and are left out.
    """
    steps = tree.where(F.col("depth") > 0).select(F.col("node").alias("descendant"), F.split("path", "/").alias("s"))
    e = steps.select("descendant", F.size("s").alias("n"), F.posexplode("s").alias("i", "a"))
    return e.where(F.col("i") < F.col("n") - 1).select(F.col("a").cast("long").alias("node"), "descendant", (F.col("n") - 1 - F.col("i")).alias("distance"))


def primary_callers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Each function as the child of its primary caller: node, parent, locality.

    The primary caller is the first entry of ``called_by`` that names a record; where ``called_by`` is null, the caller
    of the first edge to the function by (seen_at, edge_id), if it is a record. An empty or unknown list has none. Of
    several records with one ``node_id`` the smallest key stands for the name.
    """
    ids = nodes.where(F.col("node_id").isNotNull()).groupBy("node_id").agg(F.min("node_key").alias("parent"))
    listed = nodes.where(F.col("called_by").isNotNull()).select("node_key", F.posexplode("called_by").alias("pos", "caller"))
    unlisted = nodes.where(F.col("called_by").isNull() & F.col("node_id").isNotNull()).select("node_key", "node_id").distinct()
    # the first edge of each callee is settled on the map side, so a callee with most of the edges costs no task more
    first = edges.where(F.col("to_id").isNotNull()).groupBy("to_id").agg(F.min_by("from_id", F.struct("seen_at", "edge_id")).alias("caller"))
    seen = unlisted.join(first, unlisted["node_id"] == first["to_id"]).select("node_key", F.lit(0).alias("pos"), "caller")
    asked = listed.unionByName(seen).where(F.col("caller").isNotNull())
    found = asked.join(ids, asked["caller"] == ids["node_id"]).groupBy("node_key").agg(F.min_by("parent", "pos").alias("parent"))
    keys = nodes.groupBy("node_key").agg(F.min("repo_id").alias("locality"))
    return keys.join(found, "node_key", "left").select(F.col("node_key").alias("node"), "parent", "locality")
