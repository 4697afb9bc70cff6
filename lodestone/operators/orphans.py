"""References to records that do not exist at the reference's time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, rows_per_task

#: Parents that one task should keep.
TASK_PARENTS = 1_000_000
#: Bits of the counted buckets of the key space, at least and at most; bounds the counts that reach the driver.
BUCKET_BITS = (12, 20)
#: Hot keys up to this number are broadcast (12 bytes each); beyond it they are joined.
BROADCAST_KEYS = 100_000
#: Parents that a task gathers before it merges those that overlap.
COMPACT_ROWS = 1 << 21
_FOREVER = np.iinfo(np.int64).max


def merged_intervals(h1: np.ndarray, h2: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Intervals of equal keys that overlap or touch, as one: repeated parents take no memory."""
    if not len(h1):
        return h1, h2, start, end
    order = np.lexsort((start, h2, h1))
    h1, h2, start, end = h1[order], h2[order], start[order], end[order]
    new = np.ones(len(h1), bool)
    new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    code = np.cumsum(new) - 1
    ends, rank = np.unique(end, return_inverse=True)
    until = ends[np.maximum.accumulate(code * len(ends) + rank) - code * len(ends)]
    new[1:] |= start[1:] > until[:-1]
    last = np.append(np.flatnonzero(new)[1:] - 1, len(h1) - 1)
    return h1[new], h2[new], start[new], until[last]


class _Intervals:
    """Existence intervals of the parents of some ranges, as sorted arrays."""

    def __init__(self, h1: np.ndarray, h2: np.ndarray, start: np.ndarray, end: np.ndarray):
        order = np.lexsort((start, h2, h1))
        h1, h2, start, end = h1[order], h2[order], start[order], end[order]
        new = np.ones(len(h1), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        self.code = np.cumsum(new) - 1
        self.u1, self.u2 = h1[new], h2[new]
        self.starts = np.unique(start)
        self.width = len(self.starts) + 1
        self.at = self.code * self.width + np.searchsorted(self.starts, start, "right")
        ends, rank = np.unique(end, return_inverse=True)
        top = np.maximum.accumulate(self.code * (len(ends) + 1) + rank) if len(end) else rank
        self.until = ends[top - self.code * (len(ends) + 1)] if len(end) else end

    def missing(self, h1: np.ndarray, h2: np.ndarray, when: np.ndarray) -> np.ndarray:
        """True where no interval of the key holds the time."""
        n = len(self.u1)
        if not n:
            return np.ones(len(h1), bool)
        i = np.searchsorted(self.u1, h1, "left")
        while True:  # equal first hashes are as good as never met
            j = np.minimum(i, n - 1)
            step = (i < n) & (self.u1[j] == h1) & (self.u2[j] != h2)
            if not step.any():
                break
            i = i + step
        known = (i < n) & (self.u1[j] == h1) & (self.u2[j] == h2)
        pos = np.searchsorted(self.at, j * self.width + np.searchsorted(self.starts, when, "right"), "right") - 1
        p = np.maximum(pos, 0)
        alive = known & (pos >= 0) & (self.code[p] == j) & (self.until[p] > when)
        return ~alive


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parents: list[tuple[np.ndarray, ...]] = []
    index: _Intervals | None = None
    held = 0

    def compact() -> tuple[np.ndarray, ...]:
        return merged_intervals(*([np.concatenate(x) for x in zip(*parents)] if parents else [np.zeros(0, np.int64)] * 4))

    for b in batches:
        kind = b.column("kind").to_numpy(zero_copy_only=False)
        cols = [b.column(c).to_numpy(zero_copy_only=False) for c in ("h1", "h2", "t0", "t1")]
        if index is None and (kind == 0).any():
            mine = kind == 0
            parents.append(tuple(c[mine].astype(np.int64) for c in cols))
            held += len(parents[-1][0])
            if held > max(COMPACT_ROWS, 2 * len(parents[0][0])):
                parents = [compact()]
                held = len(parents[0][0])
        ref = np.flatnonzero(kind == 1)
        if len(ref):
            if index is None:
                index = _Intervals(*compact())
                parents = []
            miss = ref[index.missing(cols[0][ref], cols[1][ref], cols[2][ref])]
            if len(miss):
                yield b.take(pa.array(miss)).select(["table_name", "t0", "row_id", "target_id"])


def _bucket_counts(r: DataFrame, p: DataFrame, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(references, parents) per bucket of the hashed keys: at most 2 * 2**bits partial counts, one pass."""
    bucket = F.shiftrightunsigned("h1", 64 - bits).cast("int")
    both = r.select(F.lit(1).alias("kind"), bucket.alias("k")).unionByName(p.select(F.lit(0).alias("kind"), bucket.alias("k")))
    out = np.zeros((2, 1 << bits), np.int64)
    for x in both.groupBy("kind", "k").count().toLocalIterator():
        out[x["kind"], x["k"]] = x["count"]
    return out[1], out[0]


def _hot_keys(r: DataFrame, refs: np.ndarray, bits: int, task_refs: int) -> DataFrame | None:
    """(h1, parts) of the single keys with more references than a task should get: at most references / task_refs rows.

    Only buckets with so many rows can hold one, so only their keys are counted exactly.
    """
    full = np.flatnonzero(refs > task_refs)
    if not len(full):
        return None
    bucket = F.shiftrightunsigned("h1", 64 - bits).cast("int")
    listed = r.sparkSession.createDataFrame([(int(k),) for k in full], "k int")
    counted = r.select("h1", bucket.alias("k")).join(F.broadcast(listed), "k").groupBy("h1").count()
    return cut(counted.where(F.col("count") > task_refs).select("h1", F.ceil(F.col("count") / task_refs).cast("int").alias("parts")))


def ranged_rows(refs: DataFrame, parents: DataFrame, task_refs: int | None = None, task_parents: int = TASK_PARENTS) -> DataFrame:
    """Parents and references laid out for :func:`_probe`: each partition holds one range of the hashed keys.

    The 64-bit hashes of the keys spread evenly, so equal ranges of them hold about equally many rows: their number
    follows from the counted references (:func:`rows_per_task`) and parents. Only a single key can then fill a task; such hot keys are counted
    exactly, and their references alone are spread over further ranges, with copies of that key's parents.
    """
    spark = refs.sparkSession
    r = refs.where(F.col("key").isNotNull() & F.col("at").isNotNull()).withColumn("h1", F.xxhash64("key"))
    p = parents.where(F.col("key").isNotNull() & F.col("since").isNotNull())
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    p = p.select(F.xxhash64("key").alias("h1"), F.xxhash64("key", F.lit("second")).alias("h2"), micros("since").alias("t0"), F.coalesce(micros("until"), F.lit(int(_FOREVER))).alias("t1"))
    bits = BUCKET_BITS[0]
    n_refs, n_parents = _bucket_counts(r, p, bits)
    task_refs = task_refs or rows_per_task(int(n_refs.sum()))
    tasks = max(spark.sparkContext.defaultParallelism, -(-int(n_refs.sum()) // task_refs), -(-int(n_parents.sum()) // task_parents))
    if (finer := min(BUCKET_BITS[1], (8 * tasks - 1).bit_length())) > bits:
        bits = finer
        n_refs, n_parents = _bucket_counts(r, p, bits)
    if (n_parents > task_parents).any():  # repeats of a hot key's parents end before the ranges are formed
        p = p.groupBy("h1", "h2", "t0").agg(F.max("t1").alias("t1"))
    hot = _hot_keys(r, n_refs, bits, task_refs)
    place = F.shiftright(F.shiftrightunsigned("h1", 33) * tasks, 31)
    if hot is None:
        r, p = r.withColumn("pid", place), p.withColumn("pid", place)
    else:
        hot = F.broadcast(hot) if hot.count() <= BROADCAST_KEYS else hot
        parts = F.coalesce("parts", F.lit(1))
        step = F.greatest(F.lit(1), F.floor(F.lit(tasks) / parts))
        r = r.join(hot, "h1", "left").withColumn("pid", F.pmod(place + F.pmod(F.xxhash64("row_id", "at"), parts) * step, F.lit(tasks)))
        p = p.join(hot, "h1", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1))).withColumn("pid", F.pmod(place + F.col("salt") * step, F.lit(tasks)))
    none = F.lit(None).cast("string")
    left = p.select("pid", F.lit(0).alias("kind"), "h1", "h2", "t0", "t1", none.alias("table_name"), F.lit(0).cast("long").alias("row_id"), none.alias("target_id"))
    right = r.select(
        "pid", F.lit(1).alias("kind"), "h1", F.xxhash64("key", F.lit("second")).alias("h2"),
        micros("at").alias("t0"), F.lit(0).cast("long").alias("t1"), "table_name", F.col("row_id").cast("long").alias("row_id"), "target_id",
    )
    return left.unionByName(right).repartitionById(tasks, F.col("pid").cast("int")).sortWithinPartitions("kind").drop("pid")


def orphan_references(refs: DataFrame, parents: DataFrame, task_refs: int | None = None, task_parents: int = TASK_PARENTS) -> DataFrame:
    """References whose key has no parent record at their time.

    ``refs``: table_name, key, at, row_id, target_id. ``parents``: key, since, until (null: for ever); a parent exists
    at t if since <= t < until. Output: table_name, period (yyyy-MM of the reference), row_id, target_id, distinct.

    The hashed keys are range-partitioned (:func:`ranged_rows`); each task keeps the parents of its range as sorted
    arrays and probes the references in vectorised batches by binary search (a second 64-bit hash confirms the key).

    References with a null key or time, and parents with a null key or start, are ignored.
    """
    missed = ranged_rows(refs, parents, task_refs, task_parents).mapInArrow(_probe, "table_name string, t0 long, row_id long, target_id string")
    return missed.select("table_name", F.date_format(F.timestamp_micros("t0"), "yyyy-MM").alias("period"), "row_id", "target_id").distinct()


def bare_callee(c):
    """Function name of a written callee: without parentheses, blanks and all up to the last dot."""
    return F.regexp_extract(F.regexp_replace(c, r"[()\s]", ""), r"([^.]*)$", 1)


def code_references(nodes: DataFrame, edges: DataFrame, calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(references, parents) of the call tables, for :func:`orphan_references`.

    Keys are typed texts: ``n`` for a node id, ``f`` for repository, name and file, ``r`` for repository and name.
    Null list entries name nothing and are left out; an empty entry is a reference to no function.
    """
    sep = F.lit("\u0001")
    node = lambda c: F.concat(F.lit("n"), sep, c)
    e = edges.select(F.lit("graph_edges").alias("table_name"), node(F.col("to_id")).alias("key"), F.col("seen_at").alias("at"), F.col("edge_id").alias("row_id"), F.col("to_id").alias("target_id"))
    n = nodes.select(F.col("node_key").alias("row_id"), F.col("refreshed_at").alias("at"), F.explode(F.array_distinct("calls")).alias("target_id")).select(
        F.lit("graph_nodes").alias("table_name"), node(F.col("target_id")).alias("key"), "at", "row_id", "target_id"
    )
    named = lambda repo, name, file: F.when(file.isNull(), F.concat(F.lit("r"), sep, repo, sep, name)).otherwise(F.concat(F.lit("f"), sep, repo, sep, name, sep, file))
    c = calls.where(F.col("call_type") == "internal").select(
        F.lit("function_calls").alias("table_name"), named(F.col("repo_id"), bare_callee(F.col("callee")), F.col("callee_file")).alias("key"),
        F.col("seen_at").alias("at"), F.col("call_id").alias("row_id"), F.col("callee").alias("target_id"),
    )
    keys = F.array(
        node(F.col("node_id")), F.concat(F.lit("r"), sep, F.col("repo_id"), sep, F.col("func_name")),
        F.concat(F.lit("f"), sep, F.col("repo_id"), sep, F.col("func_name"), sep, F.col("file_path")),
    )
    parents = nodes.select(F.explode(keys).alias("key"), F.col("seen_at").alias("since"), F.col("deleted_at").alias("until"))
    return e.unionByName(n).unionByName(c), parents
