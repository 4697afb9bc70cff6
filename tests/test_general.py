"""First-k, hierarchies, orphans and snapshots on small tables with nulls, ties, repeats, empties and foreign columns."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from lodestone.operators.firsts import first_k_per_key, key_profile
from lodestone.operators.hierarchy import descendants, hierarchy, peel, primary_callers
from lodestone.operators.orphans import _Intervals, bare_callee, code_references, merged_intervals, orphan_references, ranged_rows
from lodestone.operators.snapshots import SnapshotStore, delivered_sequence, merge_changes, same_commit, snapshot_changes, snapshot_records

T0 = dt.datetime(2025, 1, 1)


def at(n):
    return T0 + dt.timedelta(seconds=n)


# --- first k ------------------------------------------------------------------------------------------------------------


def test_first_k_ties_nulls_repeats_and_foreign_columns(spark):
    data = [("a", at(3), 9, "x"), ("a", at(1), 2, "x"), ("a", at(1), 1, "y"), ("a", at(1), 1, "z"), ("a", at(2), 5, None), (None, at(0), 7, "x"), ("b", at(5), 3, "x"), ("", at(5), 4, "x")]
    df = spark.createDataFrame(data, "k string, t timestamp, id long, __key string")
    got = rows(first_k_per_key(df, "k", ["t", "id"], 3).select("k", "id", "position"))
    assert got == sorted([("a", 1, 1), ("a", 2, 2), ("a", 5, 3), ("b", 3, 1), ("", 4, 1)], key=lambda t: tuple((True, str(x)) for x in t))


def test_first_k_empty_and_null_order(spark):
    df = spark.createDataFrame([], "k string, t timestamp, id long")
    assert rows(first_k_per_key(df, "k", ["t", "id"], 3)) == []
    df = spark.createDataFrame([("a", None, 1), ("a", at(1), 2)], "k string, t timestamp, id long")
    assert [r["id"] for r in first_k_per_key(df, "k", ["t", "id"], 1).collect()] == [1]


def shuffled_rows(df):
    """Rows written to shuffles while the frame is computed."""
    jvm = df.sparkSession._jvm
    df.collect()
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        if p.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
            continue
        if p.getClass().getSimpleName() == "ShuffleQueryStageExec":
            todo.append(p.plan())
            continue
        if p.getClass().getSimpleName() == "ShuffleExchangeExec":
            total += p.metrics().apply("shuffleRecordsWritten").value()
        todo += list(jvm.scala.jdk.javaapi.CollectionConverters.asJava(p.children()))
    return total


@pytest.mark.parametrize("k", [3, 1001])
def test_first_k_of_a_record_delivered_a_million_times(spark, k):
    hot = spark.range(0, 1_000_000, 1, 8).select(F.lit("hot").alias("k"), F.lit(5).alias("t"), F.lit(1).alias("id"))
    many = spark.range(0, 200_000, 1, 8).select(F.lit("wide").alias("k"), F.lit(5).alias("t"), F.col("id").cast("int").alias("id"))
    out = first_k_per_key(hot.unionByName(many), "k", ["t", "id"], k)
    assert shuffled_rows(out) <= 8 + 8 * k
    assert rows(out.groupBy("k").count()) == [("hot", 1), ("wide", k)] and out.where("k = 'wide'").agg(F.max("id")).first()[0] == k - 1


def test_first_k_spills_and_merges(spark):
    df = spark.range(0, 50_000, 1, 4).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 1000)).alias("k"), F.when(F.col("id") % 7 > 0, (50_000 - F.col("id")) % 4000 / 10.0).alias("t"), (F.col("id") % 11 > 5).alias("b"), "id")
    df = df.unionByName(df.limit(10_000))
    got = first_k_per_key(df, "k", ["t", "b", "id"], 5, table_states=300)
    from pyspark.sql import Window

    want = df.distinct().withColumn("position", F.row_number().over(Window.partitionBy("k").orderBy("t", "b", "id"))).where("position <= 5").select("k", "t", "b", "id", "position")
    assert rows(got) == rows(want)


def test_first_k_orders_nan_last(spark):
    df = spark.createDataFrame([("a", float("nan"), 1), ("a", 2.0, 2), ("a", None, 3), ("a", float("inf"), 4), ("a", float("nan"), 1)], "k string, t double, id long")
    assert [r["id"] for r in first_k_per_key(df, "k", ["t", "id"], 9).orderBy("position").collect()] == [3, 2, 4, 1]


def test_key_profile(spark):
    df = spark.createDataFrame([("a", at(1)), ("a", at(4)), (None, at(0)), ("b", None)], "k string, t timestamp")
    assert rows(key_profile(df, "k", "t")) == [("a", 2, at(1), at(4)), ("b", 1, None, None)]


# --- hierarchies --------------------------------------------------------------------------------------------------------


def naive(parents):
    out = {}
    for n in parents:
        walk, x = [], n
        while x is not None and x in parents and x not in walk:
            walk.append(x)
            x = parents[x] if parents[x] in parents else None
        if x is not None:
            out[n] = f"cycle/{min(walk[walk.index(x):])}"
        else:
            out[n] = "/".join(map(str, reversed(walk)))
    return out


def test_peel_matches_naive():
    rng = random.Random(3)
    for _ in range(60):
        n = rng.randint(1, 40)
        par = [rng.choice([-1, *range(n)]) for _ in range(n)]
        keys = np.array(rng.sample(range(1000), n), np.int64)
        path, depth, root, below, low = peel(keys, np.array(par))
        want = naive({int(keys[i]): int(keys[par[i]]) if par[i] >= 0 else None for i in range(n)})
        assert {int(k): p for k, p in zip(keys, path)} == want
        for i in range(n):
            if not path[i].startswith("cycle/"):
                ks = list(map(int, path[i].split("/")))
                assert (depth[i], root[i], low[i]) == (len(ks) - 1, ks[0], min(ks))
                assert below[i] == sum(str(keys[i]) in p.split("/") for p in path) - 1


@pytest.mark.parametrize("block", [3, 10, 1000])
def test_hierarchy_across_blocks(spark, block):
    rng = random.Random(block)
    n = 120
    par = {i: (rng.randint(0, n - 1) if rng.random() < 0.15 else i - rng.randint(1, 3)) for i in range(n)}
    par = {k: (p if p >= 0 else (None if k % 2 else 10_000)) for k, p in par.items()}  # absent parents count as none
    data = [(k, p, None if k % 11 == 0 else f"r{k % 3}") for k, p in par.items()] + [(None, 1, "r1"), (5, par[5], "r2")]
    out = hierarchy(spark.createDataFrame(data, "node long, parent long, locality string"), block_nodes=block)
    want = naive({k: p if p in par else None for k, p in par.items()})
    got = {r["node"]: r for r in out.collect()}
    assert {k: r["path"] for k, r in got.items()} == want
    for k, r in got.items():
        if not r["path"].startswith("cycle/"):
            ks = r["path"].split("/")
            assert (r["depth"], r["root"]) == (len(ks) - 1, int(ks[0]))
            assert r["below"] == sum(str(k) in p.split("/") for p in want.values() if not p.startswith("cycle/")) - 1
    pairs = {(r["node"], r["descendant"], r["distance"]) for r in descendants(out).collect()}
    assert pairs == {(int(a), k, len(p.split("/")) - 1 - i) for k, p in want.items() if not p.startswith("cycle/") for i, a in enumerate(p.split("/")[:-1])}


def test_hierarchy_empty_and_long_chain(spark):
    assert rows(hierarchy(spark.createDataFrame([], "node long, parent long, locality string"))) == []
    chain = spark.range(400).select(F.col("id").alias("node"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"), F.lit("one").alias("locality"))
    last = hierarchy(chain, block_nodes=40).where("node = 399").first()
    assert (last["depth"], last["root"]) == (399, 0) and last["path"].startswith("0/1/2/")


def test_primary_callers(spark):
    nodes = spark.createDataFrame([(1, "a", "r", None), (2, "b", "r", []), (3, "c", "r", [None, "", "zz", "b", "a"]), (4, "d", "r", None), (4, "d", "r", None), (5, "e", "r", ["e"])], "node_key long, node_id string, repo_id string, called_by array<string>")
    edges = spark.createDataFrame([(2, "c", "a", at(2)), (1, "b", "a", at(2)), (3, "x", "d", at(1)), (4, None, "d", at(9)), (5, "a", None, at(0))], "edge_id long, from_id string, to_id string, seen_at timestamp")
    got = {r["node"]: r["parent"] for r in primary_callers(nodes, edges).collect()}
    assert got == {1: 2, 2: None, 3: 2, 4: None, 5: 5}


# --- orphans ------------------------------------------------------------------------------------------------------------


def test_intervals_brute_force():
    rng = np.random.default_rng(5)
    h1, h2 = rng.integers(-5, 5, 60), rng.integers(0, 2, 60)
    start = rng.integers(0, 30, 60)
    end = np.where(rng.random(60) < 0.3, np.iinfo(np.int64).max, start + rng.integers(0, 10, 60))
    index = _Intervals(h1, h2, start, end)
    q1, q2, t = rng.integers(-7, 7, 500), rng.integers(0, 3, 500), rng.integers(-2, 45, 500)
    want = [not any(a == x and b == y and s <= w < e for a, b, s, e in zip(h1, h2, start, end)) for x, y, w in zip(q1, q2, t)]
    assert index.missing(q1, q2, t).tolist() == want
    empty = np.zeros(0, np.int64)
    assert _Intervals(empty, empty, empty, empty).missing(q1, q2, t).all()


@pytest.mark.parametrize("per_task", [5, 1_000_000])
def test_orphans_split_ranges(spark, per_task):
    parents = spark.createDataFrame([("k1", at(10), at(20)), ("k1", at(30), None), ("k2", at(0), None), (None, at(0), None), ("k3", None, None)], "key string, since timestamp, until timestamp")
    data = [("t", "k1", at(i), i, "k1") for i in range(40)] + [("t", "k2", at(5), 100, "k2"), ("t", "k3", at(5), 101, "k3"), ("t", None, at(5), 102, "x"), ("t", "k1", None, 103, "x"), ("t", "k1", at(1), 1, "k1")]
    refs = spark.createDataFrame(data, "table_name string, key string, at timestamp, row_id long, target_id string")
    got = rows(orphan_references(refs, parents, task_refs=per_task).select("row_id", "period", "target_id"))
    want = [(i, "2025-01", "k1") for i in range(40) if not (10 <= i < 20 or i >= 30)] + [(101, "2025-01", "k3")]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("scale", [1, 10])
def test_orphan_tasks_stay_bounded(spark, scale):
    n = 6_000 * scale
    key = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % (n // 4)))
    refs = spark.range(n).select(F.lit("t").alias("table_name"), key.alias("key"), F.lit(at(5)).alias("at"), F.col("id").alias("row_id"), key.alias("target_id"))
    parents = spark.range(n // 2).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id"))).alias("key"), F.lit(at(0)).alias("since"), F.when(F.col("id") % 2 == 1, F.lit(at(3))).otherwise(F.lit(at(9))).alias("until"))
    laid = ranged_rows(refs, parents, task_refs=500, task_parents=500).groupBy(F.spark_partition_id().alias("p")).agg(F.sum("kind").alias("refs"), F.sum(1 - F.col("kind")).alias("parents")).collect()
    assert sum(r["refs"] for r in laid) == n and max(r["refs"] for r in laid) < 1200 and max(r["parents"] for r in laid) < 1200
    got = {r["row_id"] for r in orphan_references(refs, parents, task_refs=500, task_parents=500).collect()}
    known = {f"k{i}" for i in range(n // 2) if i % 3 and i % 2 == 0}
    assert got == {i for i in range(n) if i % 3 and f"k{i % (n // 4)}" not in known}


def test_merged_intervals():
    h = np.zeros(6, np.int64)
    got = merged_intervals(np.array([1, 1, 1, 1, 2, 2]), h, np.array([0, 2, 9, 0, 1, 1]), np.array([5, 7, 12, 5, 3, 3]))
    assert [x.tolist() for x in got] == [[1, 1, 2], [0, 0, 0], [0, 9, 1], [7, 12, 3]]


def test_orphans_of_empty_tables(spark):
    refs = spark.createDataFrame([("t", "k", at(1), 1, "k")], "table_name string, key string, at timestamp, row_id long, target_id string")
    none = spark.createDataFrame([], "key string, since timestamp, until timestamp")
    assert orphan_references(refs, none).count() == 1
    assert orphan_references(refs.limit(0), none).count() == 0


def test_callee_names(spark):
    df = spark.createDataFrame([("Foo",), ("pkg.Foo()",), ("(*T).Foo",), (" Foo ",), ("a.b.Foo ( )",), (None,), ("",)], "c string")
    assert [r[0] for r in df.select(bare_callee(F.col("c"))).collect()] == ["Foo", "Foo", "Foo", "Foo", "Foo", None, ""]


def test_reference_lists(spark):
    nodes = spark.createDataFrame([(1, "r", "f:a", "a", "f", ["f:a", None, "", "", "q"], at(5), at(6), None)], "node_key long, repo_id string, node_id string, func_name string, file_path string, calls array<string>, seen_at timestamp, refreshed_at timestamp, deleted_at timestamp")
    edges = spark.createDataFrame([(1, "f:a", at(5)), (2, "f:a", at(4)), (3, None, at(9))], "edge_id long, to_id string, seen_at timestamp")
    calls = spark.createDataFrame([(1, "r", "a()", None, "internal", at(7)), (2, "r", "x.a", "g", "internal", at(7)), (3, "r", "A", None, "internal", at(7)), (4, "r", "b", None, "stdlib", at(7)), (5, "r", "b", None, None, at(7))], "call_id long, repo_id string, callee string, callee_file string, call_type string, seen_at timestamp")
    got = {(r["table_name"], r["row_id"], r["target_id"]) for r in orphan_references(*code_references(nodes, edges, calls)).collect()}
    assert got == {("graph_edges", 2, "f:a"), ("graph_nodes", 1, ""), ("graph_nodes", 1, "q"), ("function_calls", 2, "x.a"), ("function_calls", 3, "A")}


# --- snapshots ----------------------------------------------------------------------------------------------------------

_R = "snapshot_no int, repo_id string, commit_hash string, files map<string,struct<file_hash:string,line_count:int>>, ingested_at timestamp"
_S = "snapshot_no int, repo_id string, file_path string, func_name string, signature string, ingested_at timestamp"


def test_snapshot_changes(spark):
    f = lambda **kw: {k: (v, 1) for k, v in kw.items()}
    repos = spark.createDataFrame(
        [(1, "r", "ABCDEF0123", f(a="1", b="1"), at(1)), (1, "r", "ABCDEF0123", f(a="1", b="1"), at(2)), (2, "r", None, None, at(3)), (3, "r", "abcdef0", f(a="2", c="1"), at(4)), (4, "r", "ffff", f(), at(5)), (2, "s", "1", f(a="1"), at(1)), (None, "s", "1", f(a="1"), at(1))], _R
    )
    funcs = spark.createDataFrame(
        [(1, "r", "a", "f", "func f()", at(1)), (2, "r", "a", "g", "x", at(1)), (3, "r", "a", "f", "func  f( )\n", at(1)), (4, "r", "a", "f", "func f(int)", at(1)), (4, "r", "a", "f", "func f(old)", at(0)), (4, "r", "a", "n", None, at(0)), (1, "r", None, "h", "s", at(0)), (9, "q", "a", "f", "s", at(0))], _S
    )
    got = {tuple(r) for r in snapshot_changes(repos, funcs).select("record_kind", "snapshot_no", "item", "change_kind").collect()}
    assert got == {
        ("repo", 4, "", "changed"), ("file", 3, "a", "changed"), ("file", 3, "b", "removed"), ("file", 3, "c", "added"), ("file", 4, "a", "removed"), ("file", 4, "c", "removed"),
        ("function", 4, "a:f", "changed"), ("function", 4, "a:n", "added"), ("function", 3, ":h", "removed"),
    }


def naive_changes(versions):
    """{key: {ord: value}}, {repo: [snapshot numbers]} to changes."""
    keyed, delivered = versions
    out = set()
    for (kind, repo, item), v in keyed.items():
        nos = delivered[repo]
        for o in range(2, len(nos) + 1):
            if o in v and o - 1 not in v:
                out.add((kind, nos[o - 1], repo, item, "added"))
            elif o not in v and o - 1 in v:
                out.add((kind, nos[o - 1], repo, item, "removed"))
            elif o in v and v[o] != v[o - 1]:
                out.add((kind, nos[o - 1], repo, item, "changed"))
    return out


def test_merge_over_batches_matches_naive(spark):
    rng = random.Random(9)
    delivered = {f"r{i}": sorted(rng.sample(range(1, 9), rng.randint(1, 6))) for i in range(6)}
    keyed, data = {}, []
    for i in range(120):
        repo = f"r{i % 6}"
        nos = delivered[repo]
        v = {o: rng.choice([b"a", b"b", None]) for o in range(1, len(nos) + 1) if rng.random() < 0.7}
        keyed["file", repo, f"x{i}"] = v
        for o, x in v.items():
            nxt = nos[o] if o < len(nos) else None
            for k in range(rng.choice([0, 0, 3])):  # earlier deliveries in the same snapshot
                data.append(("file", repo, f"x{i}", o, nos[o - 1], nxt, b"old", at(k)))
            data.append(("file", repo, f"x{i}", o, nos[o - 1], nxt, bytearray(x) if x else None, at(9)))
    rng.shuffle(data)
    df = spark.createDataFrame(data, "record_kind string, repo_id string, item string, ord int, snapshot_no int, next_no int, value binary, ingested_at timestamp")
    try:
        for size in ("1", "2", "7", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            assert {tuple(r) for r in merge_changes(df, 3).collect()} == naive_changes((keyed, delivered))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_store_merges_kept_snapshots_without_exchange(spark, tmp_path):
    f = lambda **kw: {k: (v, 1) for k, v in kw.items()}
    repos = spark.createDataFrame(
        [(1, "r", "AB", f(a="1", b="1"), at(1)), (2, "r", "ab0", f(a="2"), at(1)), (2, "s", "x", f(), at(1)), (3, "s", "y", f(q="1"), at(1)), (4, "r", "cd", f(c="9"), at(1)), (4, "s", "y", f(), at(1)), (4, "u", "z", f(n="1"), at(1))], _R
    )
    funcs = spark.createDataFrame([(1, "r", "a", "f", "x", at(0)), (2, "r", "a", "f", "y", at(0)), (2, "r", "a", "f", "x ", at(1)), (3, "s", "q", "g", None, at(0)), (4, "r", "c", "h", "x", at(0))], _S)
    seq = delivered_sequence(repos)
    records = snapshot_records(repos, funcs, seq).unionByName(seq.select(F.lit("repo").alias("record_kind"), "repo_id", F.lit("").alias("item"), "ord", "snapshot_no", "next_no", F.encode("commit_hash", "utf-8").alias("value"), "ingested_at"))
    store, got = SnapshotStore(spark, str(tmp_path / "kept"), ranges=3), set()
    for no in range(1, 5):
        changes = store.deliver(no, records.where(F.col("snapshot_no") == no).withColumnRenamed("ingested_at", "at"))
        got |= {tuple(r) for r in changes.collect()}
        store = SnapshotStore(spark, str(tmp_path / "kept"), ranges=3)  # another session takes the state up
        store.open(no)
    assert got == {tuple(r) for r in snapshot_changes(repos, funcs).collect()}
    plan = changes._jdf.queryExecution().executedPlan().toString()
    main = plan.split("SortMergeJoin")[1]
    assert "SortMergeJoin" in plan and "Exchange hashpartitioning" not in main and "Sort [" not in main


def test_snapshots_empty(spark):
    assert snapshot_changes(spark.createDataFrame([], _R), spark.createDataFrame([], _S)).count() == 0


def test_same_commit(spark):
    df = spark.createDataFrame([("abcdef", "ABC"), ("abc", "abd"), (None, "x"), ("x", None)], "a string, b string")
    assert [r[0] for r in df.select(same_commit(F.col("a"), F.col("b"))).collect()] == [True, False, True, True]
