"""Sources and sinks round trip."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.sources import binary, files, sinks
from strandline.streaming import incremental


def test_json_documents_and_manifest(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"records": [{"id": 1}, {"id": 2}]}))
    (tmp_path / "b.json").write_text("{broken")
    (tmp_path / "c.json").write_text("[{\"id\": 3}]")
    docs = files.json_documents(spark, str(tmp_path))
    assert docs.where("error IS NOT NULL").count() == 1 and docs.count() == 3
    ids = files.manifest(docs).select(F.try_variant_get("record", "$.id", "int")).collect()
    assert sorted(r[0] for r in ids) == [1, 2, 3]


def test_gaze_contract(spark, tmp_path):
    (tmp_path / "g.csv").write_text("world_timestamp,x_norm,y_norm,on_surf,confidence\n1,0.5,0.5,True,\n2,x,0.5,True,0.5\n3,0.1,0.2,false,0.5\n4,0.1,0.2,,bad\n")
    rows = files.gaze_table(spark, str(tmp_path)).orderBy("world_timestamp").collect()
    assert [(r["world_timestamp"], r["confidence"]) for r in rows] == [(1.0, 1.0), (4.0, 1.0)]
    (tmp_path / "h").mkdir()
    (tmp_path / "h" / "h.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        files.gaze_table(spark, str(tmp_path / "h"))


def test_listing_and_latest_export(spark, tmp_path):
    for rec, no, name in (("r1", "000", "z.csv"), ("r1", "002", "a.csv"), ("r1", "002", "b.csv"), ("r2", "001", "a.csv")):
        (tmp_path / rec / no).mkdir(parents=True, exist_ok=True)
        (tmp_path / rec / no / name).write_text("x")
    listing = files.file_listing(spark, str(tmp_path), (".csv",))
    assert listing.count() == 4
    latest = files.latest_export(listing, F.regexp_extract("path", r"/(r\d)/", 1))
    assert sorted(r["path"][-12:] for r in latest.collect()) == ["r1/002/b.csv"[-12:], "r2/001/a.csv"[-12:]]
    assert files.named_files(listing, r"([ab])\.csv", ["letter"]).count() == 3


def test_binary_sources(spark, tmp_path):
    np.save(tmp_path / "t.npy", np.array([1.5, 2.5]))

    def pack(v):
        if isinstance(v, str):
            return bytes([0xA0 | len(v)]) + v.encode()
        if isinstance(v, float):
            import struct

            return b"\xcb" + struct.pack(">d", v)
        if isinstance(v, bytes):
            return b"\xc4" + bytes([len(v)]) + v
        if isinstance(v, list):
            return bytes([0x90 | len(v)]) + b"".join(map(pack, v))
        return bytes([0x80 | len(v)]) + b"".join(pack(k) + pack(x) for k, x in v.items())

    body = pack({"timestamp": 3.25, "norm_pos": [0.1, 0.2], "confidence": 0.9})
    (tmp_path / "g.pldata").write_bytes(pack(["gaze", body]) * 2)
    spark.dataSource.register(binary.NumpySource)
    spark.dataSource.register(binary.PacketSource)
    assert [r["value"] for r in spark.read.format("npy").load(str(tmp_path)).orderBy("pos").collect()] == [1.5, 2.5]
    rows = spark.read.format("pldata").load(str(tmp_path)).orderBy("pos").collect()
    assert [(r["topic"], r["timestamp"], r["x"], r["confidence"]) for r in rows] == [("gaze", 3.25, 0.1, 0.9)] * 2


def test_transcripts(spark, tmp_path):
    doc = {"metadata:transcript": [{"start": 0, "end": 2.5, "transcript": "a b", "words": [{"word": "a", "start": 0, "end": 1}]}, {"start": 3, "end": 4, "transcript": "", "words": []}],
           "metadata:vad": [{"start": 1, "end": 2}, [3, 4.5], ["x"]]}
    (tmp_path / "d.json").write_text(json.dumps(doc))
    docs = files.json_documents(spark, str(tmp_path))
    assert [(r["segment"], r["word"]) for r in files.transcript_words(docs).orderBy("segment").collect()] == [(0, "a"), (1, None)]
    assert [(r["start"], r["end"]) for r in files.voice_segments(docs).orderBy("pos").collect()] == [(1.0, 2.0), (3.0, 4.5)]


def test_skeletons(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"annotations": {"skeletons": [{"1": {"keypoints": [1, 2], "occluded": [0]}}, {"1": {"keypoints": [3, 4], "occluded": [1]}}]}}))
    rows = files.skeleton_tracks(files.json_documents(spark, str(tmp_path))).orderBy("frame").collect()
    assert [(r["frame"], r["person"], r["keypoints"]) for r in rows] == [(0, "1", [1.0, 2.0]), (1, "1", [3.0, 4.0])]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a|b", None), (2, "c", 0.5)], "i int, s string, x double")
    sinks.write_flat_parquet(df, str(tmp_path / "p"))
    assert files.checked_parquet(spark, str(tmp_path / "p"), ["i", "s"], 2).count() == 2
    with pytest.raises(ValueError):
        sinks.write_flat_parquet(df.select(F.array("i").alias("l")), str(tmp_path / "q"))
    with pytest.raises(ValueError):
        files.checked_parquet(spark, str(tmp_path / "p"), ["zz"])
    sinks.write_csv(df, str(tmp_path / "c"), ["s", "x", "i"])
    assert files.csv_table(spark, str(tmp_path / "c"), ["s"]).columns == ["s", "x", "i"]
    sinks.write_json_lines(df, str(tmp_path / "j"))
    assert files.json_lines(spark, str(tmp_path / "j")).count() == 2
    sinks.write_json_document(df, str(tmp_path / "d.json"), total=2)
    assert json.loads((tmp_path / "d.json").read_text())["total"] == 2
    assert "a\\|b" in sinks.markdown_table(df.orderBy("i"), ["i", "s", "x"])
    sinks.write_tsv_report(df.orderBy("i"), str(tmp_path / "r.tsv"), ["i", "x"])
    assert (tmp_path / "r.tsv").read_text() == "i\tx\n1\t\n2\t0.5\n"
    kept = str(tmp_path / "kept")
    assert sinks.read_snapshot(spark, kept) is None
    for _ in range(3):
        sinks.swap_snapshot(df, kept)
    sinks.swap_snapshot(sinks.read_snapshot(spark, kept).where("i = 1"), kept)
    assert sinks.read_snapshot(spark, kept).count() == 1
    assert len(list((tmp_path / "kept").iterdir())) == 2  # the last and the one before


def test_registry_survives_a_crash_while_it_is_swapped(spark, tmp_path):
    kept = str(tmp_path / "reg")
    sinks.swap_snapshot(spark.createDataFrame([("a", 1), ("b", 1)], "k string, n int"), kept)
    # a version whose writing was cut off: data, but no mark that it is whole
    (tmp_path / "reg" / "v-000000002").mkdir()
    (tmp_path / "reg" / "v-000000002" / "part-0.parquet").write_bytes(b"half")
    assert sorted(r["k"] for r in sinks.read_snapshot(spark, kept).collect()) == ["a", "b"]
    from strandline.operators.state import upsert

    sinks.swap_snapshot(upsert(sinks.read_snapshot(spark, kept), spark.createDataFrame([("c", 2)], "k string, n int"), ["k"]), kept)
    assert sorted(r["k"] for r in sinks.read_snapshot(spark, kept).collect()) == ["a", "b", "c"]
    assert not (tmp_path / "reg" / "v-000000002").exists()


def test_versioned_results_are_reused(spark, tmp_path):
    made = []

    def build():
        made.append(1)
        return spark.range(3)

    assert [sinks.reuse_or_build(spark, str(tmp_path / "m"), v, build).count() for v in (1, 1, 2)] == [3, 3, 3] and len(made) == 2


def test_rows_of_the_wrong_shape_are_listed(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,2\n3\n4,5,6\n7,8\n")
    assert files.csv_table(spark, str(tmp_path / "x.csv")).count() == 2
    assert sorted(r["line"] for r in files.csv_rejects(spark, str(tmp_path / "x.csv")).collect()) == ["3", "4,5,6"]
    (tmp_path / "y.csv").write_text("1,a\n2,b\n")
    assert [tuple(r) for r in files.csv_without_header(spark, str(tmp_path / "y.csv"), "n int, s string").collect()] == [(1, "a"), (2, "b")]


def test_streaming_registry(spark, tmp_path):
    source, registry = str(tmp_path / "in"), str(tmp_path / "reg")
    schema = "job string, status string, changed_at int"
    for rows in ([("a", "pending", 1), ("b", "pending", 1)], [("a", "done", 2), ("c", "pending", 2)]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        incremental.keep_registry(incremental.file_stream(spark, source, schema), registry, ["job"], str(tmp_path / "cp")).awaitTermination()
    assert sorted((r["job"], r["status"]) for r in sinks.read_snapshot(spark, registry).collect()) == [("a", "done"), ("b", "pending"), ("c", "pending")]
