"""Filling fixed-capacity contexts with texts by linear grouping.

Large lengths are sorted and cut into groups of equal cardinality; each is rounded up to the largest of its group, so
that few sizes remain. Configurations of those sizes are optimised on the driver from the histogram of lengths alone
(never more entries than the capacity). The actual texts then take the slots of their group by rank, and the small
texts go into what space is left by best fit, in shards of bounded size.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

#: Groups of large lengths; a length of at least this share of the capacity is large.
GROUPS, LARGE_SHARE = 32, 1 / 8
#: Contexts whose space one task fills with small texts.
SHARD_CONTEXTS = 20_000
#: Small texts that one task places, however short they are.
SHARD_TEXTS = 1_000_000


def grouped(histogram: dict[int, int], capacity: int, groups: int = GROUPS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group of each length 0..capacity or -1 if small, rounded size of each group, members of each group)."""
    least = max(1, int(np.ceil(capacity * LARGE_SHARE)))
    large = sorted((n for n in histogram if n >= least), reverse=True)
    of = np.full(capacity + 1, -1, np.int64)
    sizes, members = [], []
    share = max(1, -(-sum(histogram[n] for n in large) // groups))
    for n in large:
        if not sizes or members[-1] >= share or sizes[-1] == capacity:  # full pieces keep to themselves
            sizes.append(n)
            members.append(0)
        of[n] = len(sizes) - 1
        members[-1] += histogram[n]
    return of, np.array(sizes, np.int64), np.array(members, np.int64)


def fullest(sizes: np.ndarray, left: np.ndarray, capacity: int, first: int) -> np.ndarray:
    """Counts per size of the fullest configuration that has the size ``first``: subset sums as bits of one integer."""
    room = capacity - int(sizes[first])
    mask = (1 << (room + 1)) - 1
    steps, reach = [], 1
    for g in range(len(sizes)):
        most = min(int(left[g]) - (g == first), room // int(sizes[g]))
        for _ in range(max(0, most)):
            more = (reach | reach << int(sizes[g])) & mask
            if more == reach:
                break
            steps.append((g, reach))
            reach = more
    at, counts = reach.bit_length() - 1, np.zeros(len(sizes), np.int64)
    counts[first] = 1
    for g, before in reversed(steps):
        if not before >> at & 1:
            counts[g] += 1
            at -= int(sizes[g])
    return counts


def configurations(sizes: np.ndarray, members: np.ndarray, capacity: int) -> list[tuple[int, np.ndarray]]:
    """(times, counts per size) that hold all members; the largest size left is always in."""
    left, out = members.copy(), []
    while left.any():
        first = int(np.flatnonzero(left)[0])
        counts = fullest(sizes, left, capacity, first)
        times = int(min(left[g] // counts[g] for g in np.flatnonzero(counts)))
        out.append((times, counts))
        left -= times * counts
    return out


def slots(plan: list[tuple[int, np.ndarray]], groups: int) -> tuple[list[np.ndarray], int]:
    """For each group an array of (first rank, first context, members per context) and the number of contexts."""
    taken, rows, base = np.zeros(groups, np.int64), [[] for _ in range(groups)], 0
    for times, counts in plan:
        for g in np.flatnonzero(counts):
            rows[g].append((taken[g], base, counts[g]))
            taken[g] += times * counts[g]
        base += times
    return [np.array(r, np.int64).reshape(-1, 3) for r in rows], base


def best_fit(free: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """(container of each item, number of new containers): items, largest first, into the fullest that still takes them.

    Containers 0..len(free)-1 are given with their free space; further ones are opened as needed.
    """
    where: dict[int, list[int]] = {}
    for c, f in enumerate(free.tolist()):
        if f > 0:
            where.setdefault(f, []).append(c)
    spaces, out, n = sorted(where), np.empty(len(sizes), np.int64), len(free)
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        at = bisect_left(spaces, s)
        if at < len(spaces):
            f = spaces[at]
            c = where[f].pop()
            if not where[f]:
                del where[f]
                spaces.pop(at)
        else:
            c, f, n = n, capacity, n + 1
        out[i] = c
        rest = f - s
        if rest:
            if rest not in where:
                where[rest] = []
                spaces.insert(bisect_left(spaces, rest), rest)
            where[rest].append(c)
    return out, n - len(free)


def _ranking(of: np.ndarray):
    """Group, partition and rank within both, for each large piece; group -1 for small ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(int(of.max(initial=0)) + 1, np.int64)
        for b in batches:
            g = of[b.column("size").to_numpy()]
            rank = np.full(len(g), -1, np.int64)
            for x in np.unique(g[g >= 0]):
                at = np.flatnonzero(g == x)
                rank[at] = seen[x] + np.arange(len(at))
                seen[x] += len(at)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(g), pa.array(np.full(len(g), part)), pa.array(rank)], [*b.schema.names, "g", "part", "rank"])

    return run


def _placing(table: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            g, rank = b.column("g").to_numpy(), b.column("rank").to_numpy()
            context = np.empty(len(g), np.int64)
            for x in np.unique(g):
                at, t = g == x, table[x]
                row = t[np.searchsorted(t[:, 0], rank[at], "right") - 1]
                context[at] = row[:, 1] + (rank[at] - row[:, 0]) // row[:, 2]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("key", "piece", "start", "size")] + [pa.array(context)], ["key", "piece", "start", "size", "context"])

    return run


def _filling(capacity: int, contexts: int, shards: int):
    def run(t: pa.Table) -> pa.Table:
        space = t["kind"].to_numpy() == 0
        bins, items = t.filter(pa.array(space)), t.filter(pa.array(~space))
        ids = bins["context"].to_numpy()
        got, _ = best_fit(capacity - bins["size"].to_numpy(), items["size"].to_numpy(), capacity)
        fresh = got >= len(ids)
        own = np.where(fresh, 0, ids[np.minimum(got, max(0, len(ids) - 1))]) if len(ids) else np.zeros(len(got), np.int64)
        shard = t["shard"][0].as_py()
        context = np.where(fresh, contexts + (got - len(ids)) * shards + shard, own)
        return pa.table({"key": items["key"], "piece": items["piece"], "start": items["start"], "size": items["size"], "context": pa.array(context, pa.int64())})

    return run


def pack(sizes: DataFrame, capacity: int, shard_contexts: int = SHARD_CONTEXTS) -> DataFrame:
    """Contexts of at most ``capacity`` tokens with little space left over.

    ``sizes``: key, n. Output: context, key, piece, start, size: the text's tokens start .. start + size lie in the
    context. A text of 1 to ``capacity`` tokens is whole (piece 0); a longer one is cut into full pieces and a rest.
    Texts of no or unknown length get no context. Each row is a text of its own, also with a repeated or null key.

    The driver sees the histogram of lengths (at most ``capacity`` rows) and the count of contexts, nothing that grows
    with the collection. A task fills about ``shard_contexts`` contexts and places
    at most about SHARD_TEXTS texts.
    """
    kind = sizes.schema["key"].dataType.simpleString()
    n = F.col("n")
    cuts = F.explode(F.sequence(F.lit(0), F.ceil(n / capacity).cast("int") - 1))
    pieces = sizes.where(n > 0).select("key", n, cuts.alias("piece"))
    pieces = cut(pieces.select("key", "piece", (F.col("piece").cast("long") * capacity).alias("start"), F.least(F.lit(capacity), n - F.col("piece") * capacity).cast("long").alias("size")))
    histogram = {r["size"]: r["count"] for r in pieces.groupBy("size").count().collect()}  # at most capacity rows
    of, sizes_of, members = grouped(histogram, capacity)
    table, contexts = slots(configurations(sizes_of, members, capacity), len(sizes_of))
    total = sum(s * c for s, c in histogram.items())
    few = sum(c for n, c in histogram.items() if of[n] < 0)
    shards = max(1, -(-max(contexts, -(-total // capacity)) // shard_contexts), -(-few // SHARD_TEXTS))
    ranked = cut(pieces.mapInArrow(_ranking(of), f"key {kind}, piece int, start long, size long, g long, part long, rank long"))
    large = ranked.where("g >= 0")
    w = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = large.groupBy("g", "part").count().select("g", "part", F.coalesce(F.sum("count").over(w), F.lit(0)).alias("before"))
    whole = large.join(offsets, ["g", "part"]).withColumn("rank", F.col("rank") + F.col("before"))
    cols = f"key {kind}, piece int, start long, size long, context long"
    placed = cut(whole.select("key", "piece", "start", "size", "g", "rank").mapInArrow(_placing(table), cols))
    shard = lambda *c: F.pmod(F.xxhash64(*c), F.lit(shards)).cast("int").alias("shard")
    none = F.lit(None)
    space = placed.groupBy("context").agg(F.sum("size").alias("size")).select(
        shard("context"), F.lit(0).alias("kind"), none.cast(kind).alias("key"), none.cast("int").alias("piece"), none.cast("long").alias("start"), "size", "context"
    )
    small = ranked.where("g < 0").select(shard("key", "size", "part"), F.lit(1).alias("kind"), "key", "piece", "start", "size", none.cast("long").alias("context"))
    filled = space.unionByName(small).groupBy("shard").applyInArrow(_filling(capacity, contexts, shards), cols)
    return placed.unionByName(filled).select("context", "key", "piece", "start", "size")
