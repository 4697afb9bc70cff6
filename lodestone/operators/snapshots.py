"""Differences between consecutive full snapshots: a two-pointer merge over range-partitioned, sorted keys.

:func:`snapshot_changes` takes many snapshots at once and streams them through one sorted pass. :class:`SnapshotStore`
keeps the last snapshot laid out for the next delivery, so that a delivery reads its own rows and those of its
predecessor only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import rows_per_task

#: Repositories of a delivery up to this number are broadcast (a name and a commit each); beyond it they are joined.
BROADCAST_REPOS = 200_000
_KEYS = ["record_kind", "repo_id", "item"]
_CHANGES = "record_kind string, snapshot_no int, repo_id string, item string, change_kind string"


def _winners(repo_snapshots: DataFrame) -> DataFrame:
    """The delivered row of each repository and snapshot, by its light columns only: no file map is moved."""
    light = repo_snapshots.where(F.col("files").isNotNull() & F.col("repo_id").isNotNull() & F.col("snapshot_no").isNotNull())
    last = light.groupBy("repo_id", "snapshot_no").agg(F.max(F.struct("ingested_at", F.coalesce("commit_hash", F.lit("")).alias("c"))).alias("v"))
    return last.select("repo_id", "snapshot_no", F.col("v.ingested_at").alias("ingested_at"), F.col("v.c").alias("commit_hash"))


def delivered_sequence(repo_snapshots: DataFrame) -> DataFrame:
    """Delivered snapshots per repository with their ordinal, neighbours and commit.

    A snapshot counts as delivered if any of its rows has non-null ``files``; of several such rows the last ingested
    one holds. Output: repo_id, snapshot_no, ord, next_no (null at the last), commit_hash ('' if unknown), previous
    commit, ingested_at. A repository has as many rows as there are snapshots, so the window never holds more.
    """
    w = Window.partitionBy("repo_id").orderBy("snapshot_no")
    return _winners(repo_snapshots).select(
        "repo_id", "snapshot_no", F.row_number().over(w).alias("ord"), F.lead("snapshot_no").over(w).alias("next_no"), "commit_hash", F.lag("commit_hash").over(w).alias("previous_commit"), "ingested_at",
    )


def same_commit(a: Column, b: Column) -> Column:
    """A hash and its abbreviation, in any letter case, are one commit; an unknown (null or empty) hash differs from nothing."""
    a, b = F.lower(F.trim(a)), F.lower(F.trim(b))
    return a.isNull() | b.isNull() | a.startswith(b) | b.startswith(a)


def bare(c: Column) -> Column:
    """Digest of a text without its white space; null stays null."""
    return F.unhex(F.md5(F.regexp_replace(c, r"(?U)\s+", "")))


def _equal(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Element by element, null equal to null."""
    same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
    return same.to_numpy(zero_copy_only=False)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams rows sorted by key and ordinal: one pointer stands on the last row that holds, one on the next.

    Between two batches only those two rows are kept.
    """

    def pairs(t: pa.Table, held: np.ndarray, begun: bool, ends: bool) -> Iterator[pa.RecordBatch]:
        """Events of the neighbouring rows that hold; the first of them has been looked at if ``begun``."""
        t = t.take(pa.array(held)).combine_chunks()
        ordinal, nxt = t["ord"].to_numpy(), t["next_no"]
        n = len(ordinal)
        follows = np.zeros(n, bool)  # the row is its predecessor's key in the next snapshot
        for c in ("h", *_KEYS):
            x = t[c].chunk(0)
            same = _equal(x.slice(1), x.slice(0, n - 1))
            follows[1:] = same if c == "h" else follows[1:] & same
        follows[1:] &= ordinal[1:] == ordinal[:-1] + 1
        value = t["value"].chunk(0)
        unlike = np.zeros(n, bool)
        unlike[1:] = ~_equal(value.slice(1), value.slice(0, n - 1))
        looked = np.arange(n) >= int(begun)
        gone = np.append(~follows[1:], ends) & pc.is_valid(nxt).to_numpy()
        for kind, rows, no in (("added", looked & ~follows & (ordinal > 1), "snapshot_no"), ("changed", looked & follows & unlike, "snapshot_no"), ("removed", gone, "next_no")):
            at = np.flatnonzero(rows)
            if len(at):
                g = t.take(pa.array(at)).combine_chunks()
                yield pa.RecordBatch.from_arrays([g["record_kind"].chunk(0), g[no].chunk(0), g["repo_id"].chunk(0), g["item"].chunk(0), pa.array([kind] * len(at))], ["record_kind", "snapshot_no", "repo_id", "item", "change_kind"])

    rest: pa.Table | None = None
    begun = False
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        t = (pa.concat_tables([rest, t]) if rest is not None else t).combine_chunks()
        n = t.num_rows
        again = np.ones(n - 1, bool)  # the next row delivers the same key in the same snapshot: it holds instead
        for c in ("h", "ord", *_KEYS):
            x = t[c].chunk(0)
            again &= _equal(x.slice(1), x.slice(0, n - 1))
        if begun:
            again[0] = False
        held = np.flatnonzero(~again)
        if len(held):
            yield from pairs(t, held, begun, False)
            rest, begun = t.take(pa.array([held[-1], n - 1])), True
        else:
            rest = t.slice(n - 1)
    if rest is not None:
        yield from pairs(rest, np.arange(rest.num_rows), begun, True)


def merge_changes(records: DataFrame, ranges: int) -> DataFrame:
    """Typed changes from all snapshots of one keyed collection in a single sorted pass.

    ``records``: record_kind, repo_id, item, ord, snapshot_no, next_no, value and ingested_at, where ord numbers the
    snapshots of the key's repository. The keys' hashes are cut into ``ranges`` equal ranges, whose bounds are known
    beforehand (nothing is sampled), each is sorted by key and ord, and :func:`_merge` walks over it: no predecessor in
    the snapshot before means added, no successor in the snapshot after removed, another value changed.

    A key delivered twice in one snapshot counts with its last ingested value. A null value equals only null.
    """
    hashed = records.withColumn("h", F.xxhash64(*_KEYS))
    place = F.shiftright(F.shiftrightunsigned("h", 33) * ranges, 31).cast("int")
    ranged = hashed.repartitionById(ranges, place).sortWithinPartitions("h", *_KEYS, "ord", "ingested_at", "value")
    return ranged.drop("ingested_at").mapInArrow(_merge, _CHANGES)


def snapshot_records(repo_snapshots: DataFrame, function_snapshots: DataFrame, seq: DataFrame) -> DataFrame:
    """Files and functions of all delivered snapshots as keyed records with a value to compare."""
    won = seq.select("repo_id", "snapshot_no", "ord", "next_no", F.col("ingested_at").alias("__at"), F.col("commit_hash").alias("__c"))
    delivered = repo_snapshots.where(F.col("files").isNotNull()).join(won, ["repo_id", "snapshot_no"]).where(F.col("ingested_at").eqNullSafe(F.col("__at")) & (F.coalesce("commit_hash", F.lit("")) == F.col("__c")))
    files = delivered.select("repo_id", "ord", "snapshot_no", "next_no", F.explode("files").alias("item", "f")).select(
        F.lit("file").alias("record_kind"), "repo_id", "item", "ord", "snapshot_no", "next_no",
        F.encode(F.col("f.file_hash"), "utf-8").alias("value"), F.lit("1970-01-01").cast("timestamp").alias("ingested_at"),
    )
    functions = function_snapshots.select(
        "repo_id", "snapshot_no", F.concat(F.coalesce("file_path", F.lit("")), F.lit(":"), F.coalesce("func_name", F.lit(""))).alias("item"),
        bare(F.col("signature")).alias("value"), F.col("ingested_at").cast("timestamp").alias("ingested_at"),
    ).join(won.select("repo_id", "snapshot_no", "ord", "next_no"), ["repo_id", "snapshot_no"]).select(
        F.lit("function").alias("record_kind"), "repo_id", "item", "ord", "snapshot_no", "next_no", "value", "ingested_at"
    )
    return files.unionByName(functions)


def snapshot_changes(repo_snapshots: DataFrame, function_snapshots: DataFrame) -> DataFrame:
    """Repository, file and function changes between a repository's consecutive delivered snapshots.

    Function rows of undelivered snapshots are ignored. Null ``file_path`` or ``func_name`` form the item as an empty
    text. Of several rows of a snapshot that tie in time and commit the files are taken together. Columns beyond those
    named are ignored.
    """
    seq = delivered_sequence(repo_snapshots)
    repos = seq.where((F.col("ord") > 1) & ~same_commit(F.nullif("commit_hash", F.lit("")), F.nullif("previous_commit", F.lit("")))).select(
        F.lit("repo").alias("record_kind"), "snapshot_no", "repo_id", F.lit("").alias("item"), F.lit("changed").alias("change_kind")
    )
    # a count of Parquet rows reads footers only; a file has at least one function on the whole
    n = function_snapshots.count()
    ranges = max(function_snapshots.sparkSession.sparkContext.defaultParallelism, -(-n // rows_per_task(n)))
    return repos.unionByName(merge_changes(snapshot_records(repo_snapshots, function_snapshots, seq), ranges))


class SnapshotStore:
    """The current state of all repositories, kept as Parquet in ``ranges`` buckets of hashed keys, sorted by key.

    A delivery is laid out in the same way, once; then old and new meet bucket by bucket in a merge join, which is a
    two-pointer walk over both sorted sides without exchange or sort. Repositories that a delivery leaves out keep their
    state, so the next one compares with their last delivered snapshot. Earlier versions stay as they are.
    """

    def __init__(self, spark: SparkSession, folder: str, ranges: int = 64):
        self.spark, self.folder, self.ranges = spark, folder.rstrip("/"), ranges
        self.version: int | None = None
        # one sorted file a bucket: the scan may rely on its order
        spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")

    def _name(self, part: str, no: int) -> str:
        return f"kept_{hashlib.md5(self.folder.encode()).hexdigest()[:16]}_{part}_{no}"

    def open(self, no: int) -> None:
        """Take up the state that an earlier session left as version ``no``."""
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self._name('state', no)} (record_kind STRING, repo_id STRING, item STRING, value BINARY) USING parquet "
            f"CLUSTERED BY (record_kind, repo_id, item) SORTED BY (record_kind, repo_id, item) INTO {self.ranges} BUCKETS LOCATION '{self.folder}/state/{no}'"
        )
        self.version = no

    def _keep(self, df: DataFrame, part: str, no: int) -> DataFrame:
        df.write.format("parquet").mode("overwrite").bucketBy(self.ranges, *_KEYS).sortBy(*_KEYS).option("path", f"{self.folder}/{part}/{no}").saveAsTable(self._name(part, no))
        return self.spark.table(self._name(part, no))

    def _merged(self, fresh: DataFrame, repos: DataFrame, no: int) -> DataFrame:
        """Old and new side by side, with whether the delivery holds the repository and whether the state knew it."""
        if self.version is None:
            old = fresh.limit(0)
        else:
            old = self.spark.table(self._name("state", self.version))
        known = old.where("record_kind = 'repo'").select("repo_id", F.lit(True).alias("known"))
        flags = repos.select("repo_id", F.lit(True).alias("now")).join(known, "repo_id", "full_outer")
        flags = F.broadcast(flags) if flags.count() <= BROADCAST_REPOS else flags
        both = old.select(*_KEYS, "value", F.lit(True).alias("was")).hint("merge").join(fresh.select(*_KEYS, F.col("value").alias("new"), F.lit(True).alias("is")), _KEYS, "full_outer")
        return both.join(flags, "repo_id", "left").withColumn("no", F.lit(no))

    def deliver(self, no: int, records: DataFrame) -> DataFrame:
        """Changes of snapshot ``no`` against the state, which it then replaces.

        ``records``: record_kind, repo_id, item, value, at; a repository counts as delivered by its row of kind ``repo``
        (value: its commit). A key that is delivered twice holds with the last ``at``, then the largest value.
        """
        last = records.groupBy(*_KEYS).agg(F.max_by("value", F.struct("at", "value")).alias("value"))
        fresh = self._keep(last.repartition(self.ranges, *_KEYS), "delivery", no)
        merged = self._merged(fresh, fresh.where("record_kind = 'repo'"), no)
        # each task holds one bucket on either side, so that the new state is written without an exchange
        stays = F.col("is").isNotNull() | F.col("now").isNull()
        self._keep(merged.where(stays).select(*_KEYS, F.when(F.col("is"), F.col("new")).otherwise(F.col("value")).alias("value")), "state", no)
        self.version = no
        text = lambda c: F.nullif(F.decode(c, "utf-8"), F.lit(""))
        unlike = F.when(F.col("record_kind") == "repo", ~same_commit(text("value"), text("new"))).otherwise(~F.col("value").eqNullSafe(F.col("new")))
        kind = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(unlike, "changed")
        return merged.where(F.col("now") & F.col("known")).select("record_kind", F.col("no").alias("snapshot_no"), "repo_id", "item", kind.alias("change_kind")).where(F.col("change_kind").isNotNull())
