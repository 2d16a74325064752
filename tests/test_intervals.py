"""Problem 2 against brute force."""

import random

from strandline.operators import intervals as iv

SHARD, BLOCK = 1 << iv.SHARD_BITS, 1 << iv.BLOCK_BITS


def brute(rows):
    out = set()
    for key in {r[0] for r in rows if r[0] is not None}:
        spans = sorted((s, e) for k, s, e in rows if k == key and s is not None and e is not None and e > s)
        merged = []
        for s, e in spans:
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out |= {(key, "period", s, e) for s, e in merged}
        out |= {(key, "gap", a[1], b[0]) for a, b in zip(merged, merged[1:])}
    return out


def run(spark, rows):
    df = spark.createDataFrame(rows, "k string, s bigint, e bigint")
    return {tuple(r) for r in iv.periods_and_gaps(df, ["k"], "s", "e").collect()}


def test_random_intervals_across_shards_and_blocks(spark):
    coin = random.Random(4)
    for span in (300, 5 * SHARD, 3 * BLOCK):
        rows = []
        for _ in range(400):
            s = coin.randrange(-span, span)
            rows.append((coin.choice("ab"), s, s + coin.randrange(-5, max(6, span // 60))))
        assert run(spark, rows) == brute(rows)


def test_edges_of_shards_and_blocks(spark):
    rows = [("a", 0, SHARD), ("a", SHARD, SHARD + 5), ("b", BLOCK - 3, BLOCK), ("b", BLOCK, BLOCK + 4), ("b", BLOCK + 9, BLOCK + 10),
            ("c", 5, 3 * BLOCK + 7), ("c", 3 * BLOCK + 7, 3 * BLOCK + 8), ("d", -4, -1), ("d", -1, 2)]
    assert run(spark, rows) == brute(rows)


def test_intervals_of_any_length(spark):
    coin = random.Random(5)
    rows = [("z", 0, 10**14), ("z", 10**14, 10**14 + 5), ("z", 10**15, 10**15 + 1), ("z", -(2**63), -(2**62))]
    for _ in range(200):
        s = coin.choice((coin.randrange(-(2**62), 2**62), coin.randrange(-(10**6), 10**9)))
        rows.append((coin.choice("ab"), s, s + coin.choice((1, SHARD, SHARD + 1, coin.randrange(1, 2**40)))))
    assert run(spark, rows) == brute(rows)


def test_nulls_inverted_repeats_and_empty(spark):
    rows = [("a", None, 4), ("a", 1, None), (None, 1, 4), ("a", 9, 3), ("a", 3, 3), ("a", 5, 8), ("a", 5, 8)]
    assert run(spark, rows) == {("a", "period", 5, 8)}
    assert run(spark, [("a", None, None)]) == set()


def test_clashing_columns(spark):
    df = spark.createDataFrame([("a", 1, 4, 2, "x")], "start string, end bigint, stop bigint, block int, kind string")
    got = iv.periods_and_gaps(df, ["start"], "end", "stop").collect()
    assert [tuple(r) for r in got] == [("a", "period", 1, 4)]


def test_speech_periods(spark):
    schema = (
        "utterance_id bigint, interaction_id string, speaker_role string, transcript string, speaker_file_id string, start_s double, end_s double, "
        "words array<struct<speaker:string,word:string,start_s:double,end_s:double>>"
    )
    rows = [
        (1, "i", "Speaker 1", "hi", None, 0.0, 1.0, [("B", "x", 0.5, 0.9), ("A", "y", 0.9, 1.2), ("A", "long", 2.0, 6.001), ("?", "z", 0.0, 1.0)]),
        (2, "i", "unknown", "p2 : hello", None, 3.0, 4.0, None),
        (3, "i", None, None, "s_A", 1.2, 1.5, []),
        (4, "i", None, None, "s", 1.2, 9.5, [("spk_01", "w", float("nan"), 3.0)]),
    ]
    got = {tuple(r) for r in iv.speech_periods(spark.createDataFrame(rows, schema)).collect()}
    assert got == {("i", "p1", "period", 0, 1500), ("i", "p2", "period", 500, 900), ("i", "p2", "period", 3000, 4000), ("i", "p2", "gap", 900, 3000)}
