"""Operators on documents, labels, states and media, on small fixtures."""

import json
import struct
import time
import wave

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from strandline import session
from strandline.functions import casts, documents, geometry, text
from strandline.operators import matching, sampling, state, summaries, windows
from strandline.sources import media


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def doc(spark, value, **keys):
    df = spark.createDataFrame([(json.dumps(value), *keys.values())], ["j", *keys])
    return df.withColumn("doc", F.parse_json("j")).drop("j")


def test_intervals_of_any_length_join(spark):
    i = spark.createDataFrame([("k", 0, 10**14, "a"), ("k", 5, 6, "b"), ("k", 100, 900, "c")], "k string, s bigint, e bigint, name string")
    s = spark.createDataFrame([("k", t) for t in (0, 5, 7, 500, 10**13, 10**14, 10**14 + 1)], "k string, t bigint")
    got = {(r["name"], r["t"]) for r in matching.interval_join(i, s, ["k"], "s", "e", "t", 10).collect()}
    assert got == {("a", t) for t in (0, 5, 7, 500, 10**13, 10**14)} | {("b", 5), ("c", 500)}
    assert matching.interval_join(i.limit(0), s, ["k"], "s", "e", "t", 10).count() == 0


def test_ranges_far_apart(spark):
    df = spark.createDataFrame([(1, 3, 200_000), (2, 5, 5), (3, 9, 2)], "k int, lo bigint, hi bigint")
    rows = windows.explode_range(df, "lo", "hi", "x", 7)
    got = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("x").alias("a"), F.max("x").alias("b")).orderBy("k").collect()
    assert [tuple(r) for r in got] == [(1, len(range(3, 200_001, 7)), 3, range(3, 200_001, 7)[-1]), (2, 1, 5, 5)]
    ids = spark.createDataFrame([("a", 1), ("a", 70_000)], "k string, i int")
    assert summaries.missing_ids(ids, "k", "i").count() == 69_998


def test_twice_the_rows_of_one_key_take_about_twice_the_time(spark):
    def seconds(n):
        left = spark.range(n).select(F.lit("k").alias("k"), (F.col("id") * 3).alias("t"))
        right = spark.range(n).select(F.lit("k").alias("k"), (F.col("id") * 3 + 1).alias("t"), F.col("id").alias("v"))
        began = time.time()
        assert matching.nearest_asof(left, right, ["k"], "t", "t", "v", 50).where("match_time IS NULL").count() == 0
        return time.time() - began

    seconds(1_000)
    assert seconds(64_000) < 3 * seconds(32_000) + 2


def test_lengths_must_agree(spark):
    a = spark.createDataFrame([(1, [1, 2]), (2, [3])], "k int, a array<int>")
    b = spark.createDataFrame([(1, ["x"]), (2, ["y"])], "k int, b array<string>")
    with pytest.raises(PySparkException, match="differ in length at 1"):
        matching.positional_join(a, b, ["k"], "a", "b").collect()
    assert [tuple(r) for r in matching.length_conflicts(a, b, ["k"], "a", "b").collect()] == [(1, 2, 1)]
    assert [tuple(r) for r in matching.positional_join(a.where("k = 2"), b, ["k"], "a", "b").collect()] == [(2, 0, 3, "y")]


def test_short_samples_and_odd_batches_are_errors(spark):
    df = spark.range(7).withColumn("k", F.lit(1))
    with pytest.raises(ValueError, match="no sample of 9"):
        sampling.seeded_sample(df, "id", 9, 1, whole=True)
    assert sampling.seeded_sample(df, "id", 7, 1, whole=True).count() == 7
    with pytest.raises(ValueError, match="do not divide"):
        windows.equal_batches(df, ["k"], ["id"], 3, must_divide=True)
    assert windows.equal_batches(df.limit(6), ["k"], ["id"], 3, must_divide=True).count() == 6


def test_ratio_join_reports_what_has_no_ratio(spark):
    rows = [("a", "H", 1, 4.0), ("a", "N", 2, 9.0), ("a", "N", 3, 2.0), ("b", "H", 4, 1.0), ("b", "N", 5, 0.0), ("c", "H", 6, 1.0), (None, "H", 7, 3.0), (None, "N", 8, 1.5)]
    df = spark.createDataFrame(rows, "k string, m string, i int, v double")
    got = {r["k"]: (r["status"], r["ratio"]) for r in matching.ratio_join(df, ["k"], "m", ("H", "N"), "v", "i").collect()}
    assert got == {"a": ("ratio", 2.0), "b": ("near_zero", None), "c": ("missing", None), None: ("ratio", 2.0)}


def test_nodes_at_any_depth(spark):
    value = {"leaf": 1}
    for i in range(14):
        value = {f"n{i}": value} if i % 2 else [value]
    found = documents.find_keys(doc(spark, value, i=1), "doc", ["i"], "^leaf$").collect()
    assert len(found) == 1 and found[0]["path"].count(".") == 15


def test_dialogues_of_any_shape(spark):
    payload = {
        "__summary__": {"files": 3},
        "folder": [
            {"file": "d1u1_clip_2", "assistant": "two"},
            {"file": "d1u1_clip3", "response": " three "},
            {"file": "d1u1_clip_2", "assistant": "two again"},
            {"file": "other", "assistant": "no clip"},
            {"file": "d9u9_clip_1", "assistant": " ", "response_text": "nine"},
            "text",
        ],
        "deep": {"d2u1": [{"assistant": "first"}, {"file": "d2u1_clip_7", "assistant": "seven"}, {"file": "d3u1_clip_5", "assistant": "of another"}, {"assistant": ""}]},
    }
    got = {(r["dialogue"], r["clip_index"]): r["text"] for r in documents.dialogue_clips(doc(spark, payload, i=1), "doc", ["i"]).collect()}
    assert got == {("d1u1", 2): "two again", ("d1u1", 3): "three", ("d9u9", 1): "nine", ("d2u1", 1): "first", ("d2u1", 7): "seven", ("d2u1", 3): "of another"}


def test_press_data_takes_the_scalars_beside_it(spark):
    payload = {"0": {"data": [[{"press_data": {"video_path": "v", "time_annot": 1}, "time_annot": 2, "current_video_time": 3.5, "more": {"x": 1}}]]}, "press_data": "no object"}
    rows = documents.press_entries(doc(spark, payload, i=1), "doc", ["i"]).select(F.to_json(F.transform_values("press", lambda k, v: F.to_json(v))).alias("p")).collect()
    assert [json.loads(r["p"]) for r in rows] == [{"video_path": '"v"', "time_annot": "2", "current_video_time": "3.5"}]


def test_message_content_and_nested_least(spark):
    cells = [("just text",), (["a", {"type": "video", "text": None}, {"text": "b"}],)]
    got = [[tuple(p) for p in doc(spark, c, i=1).select(documents.content_parts(F.col("doc")).alias("p")).first()["p"]] for (c,) in cells]
    assert got == [[("text", "just text")], [("text", "a"), ("video", None), ("text", "b")]]
    assert one(spark, documents.nested_least(F.lit([[5, 3], [9]]))) == 3


def test_jobs_advance(spark):
    registry = spark.createDataFrame([("a", "pending", None), ("b", "pending", None), ("c", "retrieved", "x"), ("d", "retrieve_error", "y"), ("e", "running", None), ("f", "pending", None)], "job_name string, status string, note string")
    polled = spark.createDataFrame([("a", "succeeded", "ok"), ("b", None, "timeout"), ("c", "failed", "late"), ("d", "expired", None), ("e", "running", None)], "job_name string, state string, note string")
    got = {r["job_name"]: (r["status"], r["note"]) for r in state.advance_jobs(registry, polled).collect()}
    assert got == {"a": ("retrieved", "ok"), "b": ("retrieve_error", "timeout"), "c": ("retrieved", "x"), "d": ("expired", None), "e": ("pending", None), "f": ("pending", None)}


def test_creation_times(spark):
    us = lambda t: one(spark, casts.created_wall_us(F.lit(t)))
    assert us("1970-01-01T00:00:01Z") == us("1970-01-01 00:00:01+02:00") == 1_000_000  # the offset is dropped
    assert us("1970-01-01T00:00:00.1234567") == 123_456 and us("1970-01-02") == 86_400_000_000
    assert {us(t) for t in ("", "n/a", "1746560472", "1970-02-30", None, "01/02/1970 10:00")} == {casts.NEVER_US}
    assert one(spark, casts.epoch_wall_us(F.lit(1.5), "Asia/Kolkata")) == 19_801_500_000
    assert one(spark, casts.seconds_of_timecode(F.lit("01:02:03:05"), 25.0)) == pytest.approx(3723.2)
    assert one(spark, casts.seconds_of_timecode(F.lit("01:62:03:05"), 25.0)) is None


def test_options(spark):
    assert one(spark, casts.option_list(F.lit("2, 1,2"))) == [1, 2] and one(spark, casts.option_list(F.lit("1,x"))) is None
    assert casts.parse_options("2,1,2", (1, 2, 3)) == [1, 2]
    for odd in ("1,4", "a"):
        with pytest.raises(ValueError):
            casts.parse_options(odd, (1, 2, 3))


def test_labels_and_layouts(spark):
    folder = lambda s: F.lit(f"results/m/2-utt_group/{s}")
    assert one(spark, text.group_size(folder("x"))) == 2 and one(spark, text.task_name(folder("My_INTENTION_run"))) == "intention"
    label = lambda m, s: one(spark, text.model_label(F.lit(m), folder(s)))
    assert label("chat", "chat_7b_intention") == "chat-7B" and label("chat", "intention") == "chat"
    assert label("Gemini", "batch_affordance_single-turn") == "Gemini-batch" and label("Gemini", "batch_affordance") == "Gemini"
    assert label("Ming-Lite-Omni-x", "x_3b") == "Ming-Lite-Omni-x"
    parts = text.group_layout(F.lit("https://h/a/u2/set_one_u2b11/g1/d3u1_clip4.mp4"))
    got = {k: one(spark, c) for k, c in parts.items()}
    assert got == {"utt_count": 2, "dataset_name": "set_one", "batch_name": "set_one_u2b11", "group_name": "g1", "clip_prefix": "d3u1", "clip_index": 4, "group_identifier": "g1/d3u1"}
    assert one(spark, text.is_error_text(F.lit("torch.cuda.X: outofmemory"))) and not one(spark, text.is_error_text(F.lit("cuda works")))


def test_points_in_pixels(spark):
    points = [{"x": 0.1 * i, "y": 0.2} for i in range(1, 7)]
    cell = lambda ps: F.from_json(F.lit(json.dumps(ps)), "array<struct<x:double,y:double>>")
    got = one(spark, geometry.pixel_points(cell(points), 100, 50))
    assert [(p["x"], p["y"], p["v"]) for p in got][1] == (20, 10, 2)
    assert one(spark, geometry.pixel_points(cell(points[:2] + [{"x": 0.0, "y": 0.0}, {"x": None, "y": None}]), 100, 50)) is None


def test_durations_from_headers(spark, tmp_path):
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(8_000), w.writeframes(b"\0" * 24_000)
    box = lambda name, body: struct.pack(">I4s", 8 + len(body), name) + body
    head = box(b"mvhd", bytes(4) + struct.pack(">IIII", 0, 0, 1_000, 2_500) + bytes(80))
    (tmp_path / "b.mp4").write_bytes(box(b"ftyp", b"isom") + box(b"mdat", b"\0" * 99) + box(b"moov", head))
    (tmp_path / "c.mp4").write_bytes(b"no media")
    rows = [(str(tmp_path / n), d) for n, d in (("a.wav", None), ("b.mp4", float("nan")), ("b.mp4", 9.0), ("c.mp4", None), ("gone.wav", None))] + [(None, None)]
    df = spark.createDataFrame(rows, "p string, d double")
    got = [r["duration_seconds"] for r in media.media_durations(df, "p", known=F.col("d")).collect()]
    assert got == [1.5, 2.5, 9.0, None, None, None]


def test_folders_of_old_runs_are_swept(spark):
    from pathlib import Path

    kept = session.stage(spark.range(3), "kept")
    root = Path(session.shared_dir(spark).removeprefix("file:")) / "strandline"
    old = root / "run-0123"
    old.mkdir()
    import os

    os.utime(old, (1, 1))
    assert session.sweep(spark) == 1 and not old.exists() and kept.count() == 3


def test_null_group_first_wins(spark):
    from strandline.operators import dedupe

    a, b = spark.createDataFrame([(None, 1)], "k int, v int"), spark.createDataFrame([(None, 2), (5, 3)], "k int, v int")
    assert sorted(r["v"] for r in dedupe.union_first_wins([a, b], ["k"]).collect()) == [1, 3]
