"""Packing: whole texts, capacity, cuts, and little space left over."""

import random

import numpy as np
import pytest

from lodestone.llm.packing import best_fit, configurations, fullest, grouped, pack, slots


def check(spark, sizes, capacity, **kw):
    df = spark.createDataFrame(sizes, "key long, n long").selectExpr("*", "1 AS context", "'x' AS size", "0 AS piece")
    out = pack(df, capacity, **kw).collect()
    used = {}
    for r in out:
        used[r["context"]] = used.get(r["context"], 0) + r["size"]
    assert all(0 < u <= capacity for u in used.values())
    pieces = {}
    for r in out:
        pieces.setdefault(r["key"], []).append((r["piece"], r["start"], r["size"]))
    for key, n in sizes:
        if not n:
            continue
        p = sorted(pieces[key])
        times = sum(1 for k, _ in sizes if k == key)
        assert len(p) == times * -(-n // capacity)
        assert sum(s for _, _, s in p) == n * times
        assert all(start == i * capacity and (size == capacity or i == n // capacity) for i, start, size in p)
    assert set(pieces) == {k for k, n in sizes if n}
    return len(used), sum(n or 0 for _, n in sizes)


def test_configurations_hold_all_members():
    rng = random.Random(2)
    for _ in range(30):
        hist = {rng.randint(1, 100): rng.randint(1, 50) for _ in range(20)}
        of, sizes, members = grouped(hist, 100, 8)
        plan = configurations(sizes, members, 100)
        assert (sum(t * c for t, c in plan) == members).all()
        assert all((c * sizes).sum() <= 100 for _, c in plan)
        assert all(n <= sizes[of[n]] for n in hist if of[n] >= 0)
        table, n = slots(plan, len(sizes))
        seen = set()
        for g, t in enumerate(table):
            for r in range(members[g]):
                row = t[np.searchsorted(t[:, 0], r, "right") - 1]
                seen.add(int(row[1] + (r - row[0]) // row[2]))
        assert seen == set(range(n))


def test_fullest_is_a_subset_sum():
    sizes, left = np.array([60, 41, 35, 22]), np.array([3, 3, 3, 3])
    assert (fullest(sizes, left, 100, 0) * sizes).sum() == 95  # 60 + 35
    assert (fullest(sizes, left, 104, 0) * sizes).sum() == 104  # 60 + 22 + 22


def test_best_fit_prefers_the_fullest():
    got, new = best_fit(np.array([5, 3, 9]), np.array([3, 9, 4, 10]), 10)
    assert got.tolist() == [1, 2, 0, 3] and new == 1


@pytest.mark.parametrize("seed", [1, 2])
def test_pack_random(spark, seed):
    rng = random.Random(seed)
    sizes = [(i, int(min(5000, rng.lognormvariate(4, 1.3)))) for i in range(3000)]
    n, total = check(spark, sizes, 512)
    assert n <= 1.03 * -(-total // 512)


def test_pack_several_shards(spark):
    rng = random.Random(4)
    n, total = check(spark, [(i, rng.randint(0, 300)) for i in range(2500)], 256, shard_contexts=100)
    assert n <= 1.06 * -(-total // 256)


def test_pack_edges(spark):
    assert check(spark, [(1, 0), (2, None), (3, 10), (4, 25), (5, 10), (6, 1)], 10)[0] == 5  # 10, 10, 10, 10 and 5 + 1
    assert check(spark, [(1, 3), (1, 3), (1, 3)], 10)[0] == 1
    assert pack(spark.createDataFrame([], "key long, n long"), 10).count() == 0
    assert check(spark, [(i, 6) for i in range(50)], 10)[0] == 50
    assert check(spark, [(i, 10) for i in range(5)] + [(9, 100)], 10)[0] == 15
