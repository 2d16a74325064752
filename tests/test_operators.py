"""General operators on small fixtures."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions import casts, documents, geometry, text, vectors
from strandline.operators import dedupe, matching, sampling, sequences, state, summaries, windows


def values(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_cosine_and_bins(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    got = [r["c"] for r in df.select(vectors.cosine(F.col("a"), F.col("b")).alias("c")).collect()]
    assert got[0] == pytest.approx(2**-0.5) and got[1] is None
    for n in range(1, 40):
        expected = [max(1, min(20, round(p / n * 20))) for p in range(1, n + 1)]
        rows = spark.range(1, n + 1).select(vectors.progress_bin(F.col("id"), F.lit(n)).alias("b")).collect()
        assert [r["b"] for r in rows] == expected


def test_sequences(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, " "), ("a", 3, "y"), ("b", 1, "[ERROR] z"), ("b", 2, "w"), (None, 1, "v")], "k string, i int, t string")
    done = {(r["k"], r["i"], r["t"]): (r["clip_position"], r["clip_count"], r["is_final"]) for r in sequences.finalise_sequences(df, ["k"], "i").collect()}
    assert done[("a", 3, "y")] == (2, 2, True) and done[("a", 1, "x")] == (1, 2, False) and done[(None, 1, "v")] == (None, None, None)
    kept = sequences.reject_sequences(df, ["k"], text.is_error_text(F.col("t")))
    assert kept.where("k = 'b'").count() == 0 and kept.count() == 4


def test_nearest_asof_matches_bisect(spark):
    points = [(0.0, 1), (1.0, 2), (2.0, 3), (2.0, 4), (5.0, 5)]
    probes = [0.5, 1.0, 1.5, 2.0, 3.4, 3.6, 9.0, -0.4, -0.6]
    left = spark.createDataFrame([("k", p) for p in probes], "k string, t double")
    right = spark.createDataFrame([("k", *p) for p in points], "k string, t double, v int")
    got = {r["t"]: r["match_time"] for r in matching.nearest_asof(left, right, ["k"], "t", "t", "v", 1.5).collect()}
    assert got == {0.5: 1.0, 1.0: 1.0, 1.5: 2.0, 2.0: 2.0, 3.4: 2.0, 3.6: 5.0, 9.0: None, -0.4: 0.0, -0.6: 0.0}


def test_interval_join_ends_included(spark):
    i = spark.createDataFrame([("k", 1.0, 3.0), ("k", 9.0, 8.0)], "k string, s double, e double")
    s = spark.createDataFrame([("k", t) for t in (0.9, 1.0, 2.0, 3.0, 3.1, 8.5)], "k string, t double")
    assert sorted(r["t"] for r in matching.interval_join(i, s, ["k"], "s", "e", "t", 0.7).collect()) == [1.0, 2.0, 3.0]


def test_first_hit_and_exactly_one(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "x int, y string")
    right = spark.createDataFrame([(1, "q", "v1"), (9, "b", "v2"), (9, "b", "v3")], "p int, r string, v string")
    got = {r["x"]: r["hit"] for r in matching.first_hit(left, right, [("x", "p"), ("y", "r")], "v", "hit").collect()}
    assert got == {1: "v1", 2: "v2", 3: None}
    assert values(matching.exactly_one(right, "p", "v"), "p") == [(1, "v1")]


def test_hopping_windows(spark):
    df = spark.createDataFrame([(1, i) for i in (2, 3, 4, 5, 8, 9, 12)], "k int, i int")
    got = {r["window_start"]: (r["present"], r["missing"]) for r in windows.hopping_groups(df, "k", "i").collect()}
    assert got == {2: ([2, 3, 4], []), 7: ([8, 9], [7]), 12: ([12], [13, 14])}
    members = sorted(r["members"] for r in windows.suffix_groups(windows.hopping_groups(df, "k", "i"), "k").collect())
    assert members == [[2, 3, 4], [3, 4], [4]]


def test_even_indexes(spark):
    pick = lambda n, w: one(spark, windows.even_indexes(F.lit(n), w))
    assert pick(10, 4) == [0, 3, 6, 9] and pick(3, 4) == [0, 1, 2] and pick(9, 1) == [4] and pick(0, 4) == []


def test_global_ids_are_gapless(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    got = windows.global_ids(df, ["v"], "rid", "r-%04d").collect()
    assert all(r["rid"] == f"r-{r['v']:04d}" for r in got) and len(got) == 1000


def test_dedupe_and_union(spark):
    a = spark.createDataFrame([(1, "a"), (1, "a2"), (None, "n")], "k int, v string")
    b = spark.createDataFrame([(1, "b"), (2, "b")], "k int, v string")
    assert sorted(dedupe.union_first_wins([a, b], ["k"]).collect(), key=str) == sorted([(1, "a"), (1, "a2"), (2, "b"), (None, "n")], key=str)
    assert values(dedupe.best_per_key(a, ["k"], [F.col("v")]), "v") == [(1, "a2"), (None, "n")]
    assert values(dedupe.first_per_key(a.where("k = 1"), ["k"], [F.col("v")]), "v") == [(1, "a")]


def test_missing_ids_and_sampling(spark):
    df = spark.createDataFrame([(1, 2), (1, 5), (2, 0)], "k int, i int")
    assert values(summaries.missing_ids(df, "k", "i", 0), "k", "missing_id") == [(1, 0), (1, 1), (1, 3), (1, 4)]
    ids = spark.range(1000)
    a = {r[0] for r in sampling.seeded_sample(ids, "id", 50, 3).collect()}
    assert a == {r[0] for r in sampling.seeded_sample(ids.repartition(7), "id", 50, 3).collect()} and len(a) == 50
    assert 60 < sampling.bernoulli(ids, "id", 0.1, 1).count() < 140


def test_retries(spark):
    jobs = spark.createDataFrame([(i,) for i in range(6)], "job_id int")

    def attempt(targets):
        return targets.select("job_id", ((F.col("job_id") + F.col("attempts")) % 3 == 0).alias("ok"), F.lit("n").alias("note"))

    got = {r["job_id"]: (r["status"], r["attempts"], len(r["history"])) for r in state.run_with_retries(jobs, attempt, most=2).collect()}
    assert got == {0: ("success", 1, 1), 3: ("success", 1, 1), 2: ("success", 2, 2), 5: ("success", 2, 2), 1: ("failed", 2, 2), 4: ("failed", 2, 2)}


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, s string, n int")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, s string")
    assert values(state.upsert(old, new, ["k"]), "k") == [(1, "a", 1), (2, "c", 2), (3, "d", None)]


def test_casts(spark):
    cells = ["1", " TRUE ", "yes", "0", "No", "2.5", "0.0", "maybe", None, "nan", ""]
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    assert [r[0] for r in df.select(casts.to_bool(F.col("c"))).collect()] == [True, True, True, False, False, True, False, None, None, None, None]
    assert one(spark, casts.seconds_of_clock(F.lit("02:05"))) == 125 and one(spark, casts.seconds_of_clock(F.lit("1:00:01"))) == 3601
    assert one(spark, casts.seconds_of_clock(F.lit("x"))) is None
    assert one(spark, casts.wall_time_without_offset(F.lit("1970-01-01T00:00:01+05:00"))) == 1_000_000


def test_text(spark):
    assert one(spark, text.pad_single_digits(F.lit("a1 b22 3"))) == "a01 b22 03"
    assert one(spark, text.int_tuples(F.lit("x (3, 20), (4, 21) (5, y)"))) == [[3, 20], [4, 21]]
    assert [tuple(r) for r in one(spark, text.camera_groups(F.lit("(<1,2,3>, cam4)(<5>, cam6)")))] == [(4, [1, 2, 3]), (6, [5])]
    assert one(spark, text.rebase(F.lit("http://h/a%20b+c.mp4"), {"http://h/": "/d/"})) == "/d/a b+c.mp4"
    assert one(spark, text.sanitise(F.lit("..a b/c.."))) == "a_b_c" and one(spark, text.sanitise(F.lit("//"))) == "record"
    assert one(spark, text.render("{a}-{b}", {"a": F.lit(1)})) == "1-{b}"
    assert one(spark, text.join_prompts(F.lit(" "), F.lit(" u "))) == "u"
    assert one(spark, text.strip_special_tokens(F.lit("<|im_start|>hi</s> "))) == "hi"
    assert one(spark, text.clip_index(F.lit("d3u1_clip3"), strict=True)) == 3 and one(spark, text.clip_index(F.lit("d3u1_clip_3"), strict=True)) is None


def test_geometry(spark):
    assert tuple(one(spark, geometry.screen_to_video(F.lit(0.5), F.lit(0.5), 4 / 3, 16 / 9))) == (0.5, 0.5)
    assert one(spark, geometry.screen_to_video(F.lit(0.5), F.lit(0.05), 4 / 3, 16 / 9)) is None
    assert one(spark, geometry.quadrant(F.lit(0.2), F.lit(0.9))) == "bottom-left" and one(spark, geometry.quadrant(F.lit(0.45), F.lit(0.9))) is None
    pts = F.from_json(F.lit(json.dumps([{"x": 1, "y": 2, "v": 2}, {"x": 4, "y": 6, "v": 1}, {"x": 99, "y": 99, "v": 0}])), "array<struct<x:double,y:double,v:int>>")
    assert tuple(one(spark, geometry.points_box(pts))) == (1.0, 2.0, 4.0, 5.0)
    cloud = [{"x": i % 3, "y": i // 3, "v": 2} for i in range(9)] + [{"x": 500, "y": 500, "v": 2}]
    many = F.from_json(F.lit(json.dumps(cloud)), "array<struct<x:double,y:double,v:int>>")
    assert len(one(spark, geometry.without_far_points(many))) == 9


def test_documents(spark):
    doc = json.dumps({"a": {"d1u1": [{"assistant": " "}, {"response": "hi "}]}, "b": ["x", {"7": 5}], "n": {"0": "zero"}})
    df = spark.createDataFrame([(1, doc)], "i int, t string").select("i", F.try_parse_json("t").alias("doc"))
    hits = documents.find_keys(df, "doc", ["i"], r"^d\d+u\d+$").collect()
    assert [(r["i"], r["path"]) for r in hits] == [(1, "$.a.d1u1")]
    assert df.select(documents.first_text(F.col("doc"), "$.a.d1u1[0].assistant", "$.a.d1u1[1].response")).first()[0] == "hi"
    pick = df.select(documents.indexed(F.try_variant_get("doc", "$.n", "variant"), 0).cast("string"), documents.indexed(F.try_variant_get("doc", "$.b", "variant"), 0).cast("string"))
    assert tuple(pick.first()) == ("zero", "x")
    assert one(spark, documents.merge_maps(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), F.create_map(F.lit("b"), F.lit(3)))) == {"a": 1, "b": 3}
    assert [tuple(p) for p in one(spark, documents.pairs_of(F.array(*[F.lit(i) for i in range(4)])))] == [(0, 1), (2, 3)]
    assert one(spark, documents.pairs_of(F.array(F.lit(1)))) is None


def test_percentile_is_linear(spark):
    xs = np.random.default_rng(1).normal(size=37)
    df = spark.createDataFrame([(float(x),) for x in xs], "v double")
    row = df.agg(*summaries.nine_numbers("v")).first()
    assert row["p25"] == pytest.approx(np.percentile(xs, 25), abs=1e-6) and row["std_value"] == pytest.approx(xs.std(), abs=1e-6)
