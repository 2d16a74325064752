"""Problem 4 against brute force."""

import random

from strandline.llm.nearest import nearest_by_rings


def brute(left, right, tolerance):
    out = {}
    for lid, ent, lt in left:
        if None in (lid, ent, lt):
            continue
        near = [(abs(rt - lt), rt, rid) for rid, e, rt in right if e == ent and None not in (rid, rt) and abs(rt - lt) <= tolerance]
        if near:
            out[lid] = min(near)[2]
    return out


def run(spark, left, right, tolerance):
    a = spark.createDataFrame(left, "a bigint, e string, t bigint")
    b = spark.createDataFrame(right, "b bigint, e string, u bigint")
    return {r["a"]: r["b"] for r in nearest_by_rings(a, b, "a", "b", "e", "t", "u", tolerance).collect()}


def test_random(spark):
    coin = random.Random(8)
    for tolerance in (1, 20, 33):
        left = [(i, coin.choice("xyz"), coin.randrange(-3_000, 3_000)) for i in range(300)]
        right = [(i, coin.choice("xy"), coin.randrange(-3_000, 3_000)) for i in range(600)]
        assert run(spark, left, right, tolerance) == brute(left, right, tolerance)


def test_ties_edges_nulls_repeats(spark):
    left = [(1, "x", 100), (2, "x", None), (3, None, 100), (None, "x", 100), (4, "x", 500), (1, "x", 100), (5, "x", 1_000)]
    right = [(9, "x", 95), (8, "x", 95), (7, "x", 105), (6, None, 100), (None, "x", 100), (5, "x", 520), (4, "x", 1_021), (3, "x", None)]
    assert run(spark, left, right, 20) == {1: 8, 4: 5} == brute(left, right, 20)
    assert run(spark, [], right, 20) == {} == run(spark, left, [], 20)


def test_clashing_names(spark):
    a = spark.createDataFrame([(1, "x", 5, "q")], "lid bigint, ent string, lt bigint, rid string")
    b = spark.createDataFrame([(2, "x", 6, 3)], "rid bigint, ent string, rt bigint, b int")
    assert [tuple(r) for r in nearest_by_rings(a, b, "lid", "rid", "ent", "lt", "rt", 20).collect()] == [(1, 2)]
