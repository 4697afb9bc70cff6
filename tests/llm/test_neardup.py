"""The similarity join against all pairs, on random sets and edited signatures."""

import itertools
import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from conftest import rows
from lodestone.llm.neardup import allocate, classes, parts_of, similar_records, similar_sets, similarity_classes, tau


def jaccard(a, b):
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("t", [0.6, 0.8])
def test_tau_is_exact(t):
    for a, b in itertools.product(range(1, 25), repeat=2):
        if b > a:
            continue
        for same in range(b + 1):
            if same / (a + b - same) >= t - 1e-12:
                assert a + b - 2 * same <= tau(a, b, t)
            elif a + b - 2 * same <= tau(a, b, t):
                raise AssertionError((a, b, same))


def test_allocation_covers_and_is_cheapest():
    rng = np.random.default_rng(1)
    for _ in range(50):
        held = rng.integers(0, 4, (1, 5))
        need = np.array([max(1, int(held.sum()) // 2)])
        cost = np.sort(rng.random((1, 5, 4)), axis=2)
        T = allocate(cost, held, need)[0]
        assert (T + 1).sum() >= need[0] and (T < np.maximum(held[0], 1)).all()
        price = lambda v: sum(cost[0, i, k] for i, k in enumerate(v) if k >= 0)
        best = min(price(v) for v in itertools.product(*[range(-1, h) for h in held[0]]) if sum(k + 1 for k in v) >= need[0])
        assert price(T) == pytest.approx(best)


@pytest.mark.parametrize("seed,t,most", [(1, 0.6, 12), (2, 0.6, 60), (3, 0.8, 30)])
def test_join_equals_brute_force(spark, seed, t, most):
    rng = random.Random(seed)
    common = list(range(1, 9))
    sets = set()
    while len(sets) < 250:
        s = set(rng.sample(common, rng.randint(0, 6))) | {rng.randint(10, 10**9) * 7919 for _ in range(rng.randint(1, most))}
        sets.add(frozenset(s))
        for _ in range(rng.randint(0, 3)):  # edited copies
            e = set(s)
            for _ in range(rng.randint(1, 3)):
                e.discard(rng.choice(sorted(e))) if len(e) > 1 and rng.random() < 0.5 else e.add(rng.randint(10, 10**9) * 7919)
            sets.add(frozenset(e))
    data = [(i, sorted(s)) for i, s in enumerate(sets)]
    want = {(i, j) for (i, a), (j, b) in itertools.combinations(data, 2) if jaccard(set(a), set(b)) >= t}
    got = {(r["a"], r["b"]) for r in similar_sets(spark.createDataFrame(data, "cls long, words array<long>"), t).collect()}
    assert got == want and len(want) > 50


def test_records_nulls_copies_and_case(spark):
    data = [(1, "func a(b c) d"), (2, "FUNC A ( B,  c) d"), (3, None), (4, ""), (5, "()"), (1, "func a(b c) d"), (6, "func a(b c) e"), (7, "x y z"), (None, "func a(b c) d"), (8, "Кириллица")]
    df = spark.createDataFrame(data, "k long, s string").selectExpr("k", "s", "'x' AS cls", "1 AS words", "2 AS key")
    assert rows(similar_records(df, "k", "s", 0.6)) == [(1, 2), (1, 6), (2, 6)]
    assert rows(similarity_classes(df, "k", "s", 0.6)) == [(1, 1, 2), (2, 1, 2), (6, 6, 2), (7, 7, 0)]
    assert rows(similar_records(df.limit(0), "k", "s", 0.6)) == []


def test_long_text_and_many_copies(spark):
    long = " ".join(f"w{i}" for i in range(3000))
    data = [(1, long), (2, long + " more words"), (3, long.upper())] + [(i, "a b c d e") for i in range(10, 60)]
    df = spark.createDataFrame(data, "k long, s string")
    got = set(rows(similar_records(df, "k", "s", 0.6)))
    assert {(1, 2), (1, 3), (2, 3)} <= got and len(got) == 3 + 50 * 49 // 2


def test_parts_grow_with_size():
    assert [parts_of(n) for n in (1, 48, 49, 97)] == [12, 12, 24, 48]


@pytest.mark.parametrize("n", [7, 1000])
def test_large_classes_are_sliced(spark, n):
    texts = {"a b c d e": 60, "a b c d e f": 45, "a b c d f g": 3, "q r s t": 25, "z": 1}
    data = [(i, t) for i, t in enumerate(t for t, k in texts.items() for _ in range(k))]
    random.Random(4).shuffle(data)
    df = spark.createDataFrame(data, "k long, s string").repartition(5)
    want = {(min(i, j), max(i, j)) for (i, a), (j, b) in itertools.combinations(data, 2) if jaccard(set(a.split()), set(b.split())) >= 0.6}
    got = [(r["a_key"], r["b_key"]) for r in similar_records(df, "k", "s", 0.6, slice_members=n).collect()]
    assert set(got) == want and len(got) == len(want)


def test_sets_that_share_a_digest_stay_apart(spark):
    data = [(i, f"w{i % 40} common x{i % 40} y{i % 40}") for i in range(80)]
    df = spark.createDataFrame(data, "k long, s string")
    members, sets = classes(df, "k", "s", digest=lambda w: F.pmod(F.xxhash64(w), F.lit(3)))
    assert sets.count() == sets.select("cls").distinct().count() == 40
    joined = members.join(sets, "cls").groupBy("cls").agg(F.collect_set(F.col("key") % 40).alias("k"))
    assert all(len(r["k"]) == 1 for r in joined.collect())
