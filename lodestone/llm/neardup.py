"""Similarity self-join of word sets by the generalised pigeonhole principle.

A set is a sparse bit vector over the words. For a Jaccard threshold t and sizes a >= b, similar sets differ in at most
tau(a, b) = a + b - 2 * ceil(t / (1 + t) * (a + b)) bits. The bits are split into parts; if thresholds T_i >= -1 with
sum(T_i + 1) = tau + 1 are given to the parts, similar sets differ by at most T_i in some part i. Thresholds are unequal:
dynamic programming over estimated candidate counts gives each set's rare parts more and its common parts none (-1).

Frequent words that occur together share a part, so that one part takes the damage; all other words fall into parts by
hash. A part's content is matched by the sum of its word hashes, within distance T by leaving out up to T words on
either side. Candidates are verified exactly.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Buckets of the hashed word counts that reach the driver and the tasks; a fixed bound (4 bytes each).
COUNT_BITS = 17
#: Words looked at for correlation, and words in one correlated part.
FREQUENT, PART_WORDS = 48, 4
_KEYS = "key long, cls long, mark long"
#: Bits of a set's parity signature; the rest of a mark holds its size up to LARGEST.
SIGNATURE, LARGEST = 48, 32_767
#: Members of one class that meet those of another in one task.
SLICE_MEMBERS = 1_000


def tau(a: int, b: int, t: float) -> int:
    """Largest number of differing bits of similar sets of these sizes; negative: none can be similar."""
    if b < t * a - 1e-9 or a < t * b - 1e-9:
        return -1
    return a + b - 2 * int(np.ceil(round(t / (1 + t) * (a + b), 9)))


def parts_of(size: int) -> int:
    """Number of hashed parts used by a set of this size when it asks: at most about four words a part."""
    m = 12
    while m * 4 < size:
        m *= 2
    return m


def allocate(cost: np.ndarray, allowed: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Thresholds by dynamic programming.

    ``cost[r, i, k]``: estimated candidates of record r if part i takes T = k; ``allowed[r, i]``: number of words in the
    part (T stays below it, so that empty parts never match); ``need[r]`` = tau + 1. Returns T, -1 where unused.
    """
    n, parts, kinds = cost.shape
    top = int(need.max(initial=0))
    best = np.full((parts + 1, n, top + 1), np.inf)
    best[0, :, 0] = 0
    pick = np.zeros((parts, n, top + 1), np.int8)
    for i in range(parts):
        best[i + 1] = best[i]
        for k in range(min(kinds, top, int(allowed[:, i].max(initial=0)))):
            ok = (allowed[:, i] > k)[:, None]
            # a part may overshoot: what is needed beyond zero counts as zero
            src = np.maximum(np.arange(top + 1) - (k + 1), 0)
            trial = np.where(ok & (np.arange(top + 1) > 0), best[i][:, src] + cost[:, i, k][:, None], np.inf)
            better = trial < best[i + 1]
            best[i + 1] = np.where(better, trial, best[i + 1])
            pick[i][better] = k + 1
    out = np.full((n, parts), -1, np.int64)
    left = need.copy()
    rows = np.arange(n)
    for i in range(parts - 1, -1, -1):
        k = pick[i][rows, left].astype(np.int64)
        out[:, i] = k - 1
        left = np.maximum(left - k, 0)
    assert not left.any(), "thresholds can't be allocated"
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spans(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All numbers of the ranges that begin at ``first``, one range after the other."""
    ends = np.cumsum(length)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - (ends - length), length)


class _Prober:
    """Emits, for a batch of sets, the keys they are found by and the keys they ask for."""

    def __init__(self, t: float, counts: np.ndarray, total: int, frequent: dict[int, int], groups: int):
        self.t, self.counts, self.total, self.groups = t, counts, max(1, total), groups
        self.words = np.array(sorted(frequent), np.int64)
        self.group_of = np.array([frequent[w] for w in self.words.tolist()], np.int64)

    def part_ids(self, words: np.ndarray, m: int) -> np.ndarray:
        part = self.groups + (_mix(words.view(np.uint64)) % np.uint64(m)).astype(np.int64)
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
            hit = self.words[at] == words
            part = np.where(hit, self.group_of[at], part)
        return part

    def emit(self, cls: np.ndarray, offsets: np.ndarray, flat: np.ndarray, asking: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        size = np.diff(offsets)
        sums = np.zeros(len(size), np.int64)
        np.bitwise_xor.at(sums, np.repeat(np.arange(len(size)), size), np.int64(1) << (_mix(flat.view(np.uint64) + np.uint64(0x1234567)) % np.uint64(SIGNATURE)).astype(np.int64))
        mark = np.minimum(size, LARGEST).astype(np.int64) << SIGNATURE | sums
        kinds, of = np.unique(size, return_inverse=True)  # sizes are few
        asked = np.array([parts_of(s) for s in kinds.tolist()])[of]
        # a set is found in the layouts of all sets that may ask for it: those from its size to size / t
        reach = np.array([parts_of(int(np.floor(s / self.t + 1e-9))) for s in kinds.tolist()])[of]
        for m in sorted(set(asked) | set(reach)):
            rows = np.flatnonzero(asked == m if asking else (asked <= m) & (reach >= m))
            if len(rows):
                yield from self._layout(int(m), rows, asking, cls, offsets, flat, size, mark)

    def _layout(self, m, rows, asking, cls, offsets, flat, size, mark):
        parts = self.groups + m
        take = spans(offsets[rows], size[rows])
        own = np.repeat(np.arange(len(rows)), size[rows])
        words = flat[take]
        part = self.part_ids(words, m)
        cell = own * parts + part
        order = np.argsort(cell, kind="stable")
        words, cell = words[order], cell[order]
        mixed = _mix(words.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        df = np.maximum(1, self.counts[(words.view(np.uint64) >> np.uint64(64 - COUNT_BITS)).astype(np.int64)]) / self.total
        held = np.bincount(cell, minlength=len(rows) * parts)
        start = np.concatenate([[0], np.cumsum(held)])
        total = np.zeros(len(held), np.uint64)
        np.add.at(total, cell, mixed)
        salt = _mix(np.arange(parts, dtype=np.uint64) * np.uint64(1000003) + np.uint64(m))

        def key(sums: np.ndarray, p: np.ndarray, left_out: int) -> np.ndarray:
            return _mix(sums + salt[p] + np.uint64(left_out * 0x51ED2701)).view(np.int64)

        def left(cells: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
            """(sums of the cells' words with d left out, number of the cell of each)."""
            if d == 1:
                return np.repeat(total[cells], held[cells]) - mixed[spans(start[cells], held[cells])], np.repeat(np.arange(len(cells)), held[cells])
            sums, src = [], []
            for i, c in enumerate(cells.tolist()):
                w, whole = mixed[start[c] : start[c + 1]].tolist(), int(total[c])
                got = [(whole - sum(x)) & 0xFFFFFFFFFFFFFFFF for x in itertools.combinations(w, d)]
                sums += got
                src += [i] * len(got)
            return np.array(sums, np.uint64), np.array(src, np.int64)

        ids = cls[rows]
        if not asking:
            some = np.flatnonzero(held)
            yield key(total[some], some % parts, 0), ids[some // parts], mark[rows][some // parts]
            for d in range(1, (int(held.max(initial=0)) - 1) // 2 + 1):  # a cell of 2d + 1 words or more may be asked for with d left out
                deep = np.flatnonzero(held >= 2 * d + 1)
                sums, src = left(deep, d)
                c = deep[src]
                yield key(sums, c % parts, d), ids[c // parts], mark[rows][c // parts]
            return
        kinds, of = np.unique(size[rows], return_inverse=True)
        need = np.array([1 + max(tau(s, b, self.t) for b in range(max(1, int(np.ceil(self.t * s - 1e-9))), s + 1)) for s in kinds.tolist()])[of]
        h2 = held.reshape(len(rows), parts)
        kinds = int(min(h2.max(), need.max()))
        cost = np.full((len(rows), parts, kinds), float(self.total))
        # expected sets that share all but T words of a part, words taken as independent; in a correlated part as one
        e = np.zeros((len(held), int(held.max()) + 1))
        e[:, 0] = 1
        place = np.arange(len(cell)) - start[cell]
        for j in range(int(held.max())):
            at = place == j
            e[cell[at], 1:] += df[at][:, None] * e[cell[at], :-1]
        high = np.zeros(len(held))
        np.maximum.at(high, cell, df)
        cells = np.arange(len(rows) * parts).reshape(len(rows), parts)
        for k in range(kinds):
            shared = np.maximum(h2 - k, 0)
            est = np.take_along_axis(e[cells], shared[:, :, None], 2)[:, :, 0]
            est[:, : self.groups] = high[cells[:, : self.groups]]
            cost[:, :, k] = est * self.total + 0.05 * (1 + k * h2)  # each key asked for has a price too
        chosen = allocate(cost, h2, need)
        for d in range(kinds):
            hit = np.argwhere(chosen >= d)
            if not len(hit):
                continue
            c, T = cells[hit[:, 0], hit[:, 1]], chosen[hit[:, 0], hit[:, 1]]
            if d == 0:
                sums, src, lim = total[c], np.arange(len(c)), T
            else:
                sums, src = left(c, d)
                lim = (T - d)[src]
            p, who = hit[src, 1], rows[hit[src, 0]]
            for dx in range(int(lim.max(initial=-1)) + 1):  # d words left out here and dx there
                ok = lim >= dx
                yield key(sums[ok], p[ok], dx), cls[who[ok]], mark[who[ok]]


def _probing(prober_args: tuple, asking: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prober = _Prober(*prober_args)
        for b in batches:
            if not b.num_rows:
                continue
            lists = b.column("words")
            out = list(prober.emit(b.column("cls").to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten().to_numpy(), asking))
            if out:
                cols = [np.concatenate(x) for x in zip(*out)]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1]), pa.array(cols[2])], ["key", "cls", "mark"])

    return run


def word_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, words) of (key, text): sorted distinct 64-bit hashes of the runs of ASCII letters and digits in lower case.

    Null and wordless texts are left out. Only the distinct words of a batch are hashed.
    """
    for b in batches:
        lists = pc.split_pattern_regex(pc.fill_null(b.column("text"), ""), "[^A-Za-z0-9]+")
        words = pc.dictionary_encode(pc.ascii_lower(lists.flatten()))
        hashes = np.array([xxhash.xxh64_intdigest(w) if w else 0 for w in words.dictionary.to_pylist()], np.uint64).view(np.int64)
        empty = np.array([not w for w in words.dictionary.to_pylist()], bool)
        code = words.indices.to_numpy()
        row = np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy())
        row, h = row[~empty[code]], hashes[code][~empty[code]]
        order = np.lexsort((h, row))
        row, h = row[order], h[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
        row, h = row[new], h[new]
        held = np.bincount(row, minlength=b.num_rows)
        some = np.flatnonzero(held)
        offsets = np.concatenate([[0], np.cumsum(held[some])]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(some)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(h))], ["key", "words"])


def _correlated_parts(sets: DataFrame, frequent: list[int]) -> tuple[dict[int, int], int]:
    """Frequent words grouped by co-occurrence (pair counts over all sets; at most FREQUENT squared rows are collected)."""
    if not frequent:
        return {}, 0
    only = sets.select(F.array_intersect("words", F.array(*[F.lit(w) for w in frequent])).alias("w")).where(F.size("w") > 0)
    pairs = only.select(F.explode("w").alias("a"), "w").select("a", F.explode("w").alias("b")).where(F.col("a") <= F.col("b")).groupBy("a", "b").count().collect()
    both = {(r["a"], r["b"]): r["count"] for r in pairs}
    near = sorted(((c / (both[a, a] + both[b, b] - c), a, b) for (a, b), c in both.items() if a != b), reverse=True)
    group = {w: {w} for w in frequent}
    for s, a, b in near:
        if s >= 0.2 and group[a] is not group[b] and len(group[a] | group[b]) <= PART_WORDS:
            joined = group[a] | group[b]
            for w in joined:
                group[w] = joined
    number: dict[int, int] = {}
    ids: dict[int, int] = {}
    for w in frequent:
        number[w] = ids.setdefault(id(group[w]), len(ids))
    return number, len(ids)


def similar_sets(sets: DataFrame, t: float) -> DataFrame:
    """All pairs of different word sets with a Jaccard similarity of at least ``t``.

    ``sets``: cls (unique long), words (sorted distinct longs, not empty). Output: a, b (a < b). Nothing is capped: the
    candidate search has no false negatives and each candidate is verified. What reaches the driver is bounded: hashed
    word counts (2**COUNT_BITS rows), FREQUENT words and their pair counts; they steer costs, never results.
    """
    bucket = F.shiftrightunsigned("w", 64 - COUNT_BITS).cast("int")
    words = sets.select(F.explode("words").alias("w"))
    counts = np.zeros(1 << COUNT_BITS, np.int64)
    for r in words.groupBy(bucket.alias("k")).count().toLocalIterator():
        counts[r["k"]] = r["count"]
    total = sets.count()
    heavy = np.argsort(-counts)[: 4 * FREQUENT]
    heavy = heavy[counts[heavy] * 100 > total].tolist()
    frequent: list[int] = []
    if heavy:
        top = words.where(bucket.isin(heavy)).groupBy("w").count().where(F.col("count") * 100 > total)
        frequent = [r["w"] for r in top.orderBy(F.desc("count"), "w").limit(FREQUENT).collect()]
    number, groups = _correlated_parts(sets, frequent)
    args = (t, counts.astype(np.float32), total, number, groups)
    asks = sets.mapInArrow(_probing(args, True), _KEYS).select("key", F.col("cls").alias("a"), F.col("mark").alias("ma"))
    has = sets.mapInArrow(_probing(args, False), _KEYS).select("key", F.col("cls").alias("b"), F.col("mark").alias("mb"))
    na, nb = F.shiftright("ma", SIGNATURE), F.shiftright("mb", SIGNATURE)
    smaller = (nb >= na * t - 1e-9) & ((nb < na) | ((nb == na) & ((F.col("b") < F.col("a")) | (na == LARGEST))))
    # parities of word counts differ in no more places than the sets; very large sets go on to the verification
    differ = F.bit_count(F.col("ma").bitwiseXOR(F.col("mb")).bitwiseAND(F.lit((1 << SIGNATURE) - 1)))
    near = (na == LARGEST) | (nb == LARGEST) | (differ <= na + nb - 2 * F.ceil((na + nb) * (t / (1 + t)) - 1e-6))
    met = asks.join(has, "key").where(smaller & near & (F.col("a") != F.col("b"))).select("a", "b").repartition("a").dropDuplicates(["a", "b"])
    left = sets.select(F.col("cls").alias("a"), F.col("words").alias("wa"))
    right = sets.select(F.col("cls").alias("b"), F.col("words").alias("wb"))
    both = met.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("wa", "wb"))
    similar = both.where(common >= (F.size("wa") + F.size("wb") - common) * t - 1e-9)
    return similar.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def classes(records: DataFrame, key: str, text: str, digest: Callable = F.xxhash64) -> tuple[DataFrame, DataFrame]:
    """(members: key, cls; sets: cls, words) of the records that have words; equal word sets are one class.

    The word sets are made once and written. A class is named by the 64-bit digest of its words; sets that share one,
    told apart by a second digest, get names from other digests until no two sets have the same.
    """
    texts = records.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    rows = texts.mapInArrow(word_sets, f"key {records.schema[key].dataType.simpleString()}, words array<long>")
    rows = cut(rows.withColumn("cls", digest("words")))
    for seed in itertools.count(1):
        other = F.xxhash64(F.lit(seed), "words")
        sets = cut(rows.withColumn("o", other).groupBy("cls").agg(F.first("words").alias("words"), (F.min("o") != F.max("o")).alias("mixed")))
        mixed = sets.where("mixed").select("cls", "mixed")
        if not mixed.limit(1).count():
            break
        rows = cut(rows.join(mixed, "cls", "left").select("key", "words", F.when(F.col("mixed"), other).otherwise(F.col("cls")).alias("cls")))
    return cut(rows.select("key", "cls").distinct()), sets.select("cls", "words")


def _slices(members: DataFrame, slice_members: int) -> DataFrame | None:
    """(cls, slices) of the classes with more than ``slice_members`` members; None if there are none."""
    big = members.groupBy("cls").count().where(F.col("count") > slice_members).select("cls", F.ceil(F.col("count") / slice_members).cast("int").alias("slices"))
    return cut(big) if big.limit(1).count() else None


def similar_records(records: DataFrame, key: str, text: str, t: float, slice_members: int = SLICE_MEMBERS) -> DataFrame:
    """Pairs of different records (a_key < b_key) whose texts have a word-set similarity of at least ``t``.

    Repeated rows of one record count once. A record delivered with several texts pairs by any of them. Null, empty and
    wordless texts pair with nothing; empty input gives an empty result.

    The members of a large class are spread over slices of about ``slice_members``, and slices meet slices, so that no
    task makes more than about ``slice_members`` squared pairs of one class or of two.
    """
    members, sets = classes(records, key, text)
    links = similar_sets(sets, t)
    big = _slices(members, slice_members)
    none = F.lit(0)
    if big is None:
        placed = members.select("key", "cls", none.alias("i"))
        wide = links.select("a", "b", none.alias("ia"), none.alias("ib"))
    else:
        many = F.coalesce("slices", F.lit(1))
        placed = cut(members.join(big, "cls", "left").select("key", "cls", F.pmod(F.xxhash64("key"), many).cast("int").alias("i")))
        side = lambda c: big.select(F.col("cls").alias(c), F.col("slices").alias(f"s{c}"))
        upto = lambda c: F.explode(F.sequence(none, F.coalesce(c, F.lit(1)) - 1))
        wide = links.join(side("a"), "a", "left").join(side("b"), "b", "left").select("a", "b", "sb", upto("sa").alias("ia")).select("a", "b", "ia", upto("sb").alias("ib"))
    end = lambda k, c: placed.select(F.col("key").alias(k), F.col("cls").alias(c), F.col("i").alias(f"i{c}"))
    apart = wide.join(end("x", "a"), ["a", "ia"]).join(end("y", "b"), ["b", "ib"]).select("x", "y")
    # a slice meets itself and all before it
    later = end("y", "c").withColumnRenamed("ic", "j").withColumn("ic", F.explode(F.sequence(none, F.col("j"))))
    copies = end("x", "c").join(later, ["c", "ic"]).where((F.col("j") > F.col("ic")) | (F.col("x") < F.col("y"))).select("x", "y")
    pairs = apart.unionByName(copies).where(F.col("x") != F.col("y"))
    return pairs.select(F.least("x", "y").alias("a_key"), F.greatest("x", "y").alias("b_key")).distinct()


def similarity_classes(records: DataFrame, key: str, text: str, t: float) -> DataFrame:
    """One row per record: its class of equal word sets (the smallest key names it) and the number of links.

    ``n_links`` counts the other records with a similarity of at least ``t``, copies included, without making the pairs
    of copies.
    """
    members, sets = classes(records, key, text)
    sizes = members.groupBy("cls").agg(F.min("key").alias("class_key"), F.count(F.lit(1)).alias("n"))
    ends = F.array(F.struct(F.col("a").alias("cls"), F.col("b").alias("o")), F.struct(F.col("b").alias("cls"), F.col("a").alias("o")))
    both = similar_sets(sets, t).select(F.explode(ends).alias("e")).select("e.cls", "e.o")
    far = both.join(sizes.select(F.col("cls").alias("o"), "n"), "o").groupBy("cls").agg(F.sum("n").alias("far"))
    known = sizes.join(far, "cls", "left").select("cls", "class_key", (F.col("n") - 1 + F.coalesce("far", F.lit(0))).alias("n_links"))
    return members.join(known, "cls").select("key", "class_key", "n_links")
