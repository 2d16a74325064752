"""Annotation documents and requests."""

import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.operators import annotations as an


def document(spark):
    press = lambda v: {"press_data": {"video_path": v, "video_start_time": 5, "current_video_time": "1.5"}}
    doc = {
        "nodes": {
            "n1": {"responses": [
                {"submitted": "true", "created": "2024-01-02", "annotations": {"0": {"participant": "p", "category": "c", "data": [[press("a")], [press("b"), press("c")], []]}}},
                {"submitted": 1, "created": "2024-01-02", "annotations": {"0": {"data": []}, "1": {"data": [[press("d")]]}}},
                {"submitted": False, "created": "2025-01-01", "annotations": {}},
            ]},
            "n2": {"responses": [{"submitted": "no", "created": None}]},
        }
    }
    return spark.createDataFrame([("f", json.dumps(doc))], "path string, t string").select("path", F.try_parse_json("t").alias("doc"))


def test_rows(spark):
    responses = an.response_rows(document(spark))
    assert responses.count() == 4
    latest = an.latest_submitted(responses)
    assert [(r["node_id"], r["response_index"]) for r in latest.collect()] == [("n1", 1)]
    rows = an.press_columns(an.annotation_rows(responses)).orderBy("annotation_key", "video_path").collect()
    assert [(r["annotation_key"], r["video_path"], r["video_start_time"], r["current_video_time"]) for r in rows] == [
        ("0", None, None, None), ("0", "c", "5", 1.5), ("1", "d", "5", 1.5),
    ]


def test_conform_and_speakers(spark):
    schema = T.StructType([T.StructField("b", T.LongType()), T.StructField("c", T.StringType())])
    df = spark.createDataFrame([("x", "7"), ("y", "z")], "a string, b string")
    assert [tuple(r) for r in an.conform(df, schema, "a").orderBy("a").collect()] == [("x", 7, None), ("y", None, None)]
    rows = spark.createDataFrame([(1, [2, 1, 3]), (0, [1]), (1, [None])], "p int, f array<int>")
    assert [r[0] for r in rows.select(an.floor_speakers(F.col("p"), F.col("f"))).collect()] == [[1, 2, 3], None, None]


def test_request_and_conversation(spark):
    df = spark.createDataFrame([("k", " ", "u", ["m1"])], "k string, s string, u string, m array<string>")
    line = json.loads(df.select(an.request_json(F.col("k"), F.col("s"), F.col("u"), F.col("m"))).first()[0])
    assert line == {"key": "k", "parts": [{"text": "u"}, {"uri": "m1"}]}
    turns = spark.createDataFrame([("g", 2, "two"), ("g", 1, "one"), ("g", 3, "three")], "g string, n int, t string")
    out = an.conversation(turns, ["g"], "n", "t", lambda h, x: None if x == "two" else f"{len(h)}", "g string, n int, t string, reply string")
    assert [(r["n"], r["reply"]) for r in out.orderBy("n").collect()] == [(1, "0"), (2, None), (3, "2")]


def test_embed(spark):
    df = spark.createDataFrame(pd.DataFrame({"t": ["ab", None]}))
    got = an.embed(df, "t", "v", lambda: lambda texts: [[float(len(x))] for x in texts]).collect()
    assert [r["v"] for r in got] == [[2.0], [0.0]]
