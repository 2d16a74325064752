"""Problem 3: rank errors within the stated bound; merging equals one pass."""

import numpy as np
from pyspark.sql import functions as F

from strandline.llm import percentiles as pc


def worst(values, row, names=(("p05", 0.05), ("p25", 0.25), ("p50", 0.5), ("p75", 0.75), ("p95", 0.95), ("p99", 0.99))):
    s = np.sort(values)
    errors = []
    for name, q in names:
        low, high = np.searchsorted(s, row[name], "left") / len(s), np.searchsorted(s, row[name], "right") / len(s)
        errors.append(max(0.0, low - q, q - high - 1 / len(s)))
    return max(errors)


def test_rank_error_within_bound(spark):
    coin = np.random.default_rng(5)
    data = {"wide": coin.lognormal(0, 2, 60_000), "ties": np.round(coin.normal(5, 1, 30_000)), "two": np.concatenate([coin.normal(0, 1, 20_000), coin.normal(50, 1, 100)]), "tiny": np.array([4.0, 2.0]), "const": np.full(9_000, 3.5)}
    rows = [(k, i % 3, float(v)) for k, vs in data.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "g string, day int, v double").repartition(6)
    direct = {r["g"]: r for r in pc.quantiles(pc.sketch(df, ["g"], "v"), ["g"]).collect()}
    combined = {r["g"]: r for r in pc.quantiles(pc.merge(pc.sketch(df, ["g", "day"], "v"), ["g"]), ["g"]).collect()}
    for got in (direct, combined):
        assert set(got) == set(data)
        for k, vs in data.items():
            assert got[k]["n"] == len(vs)
            assert worst(vs, got[k]) <= got[k]["rank_error"] + 1e-9
            assert got[k]["rank_error"] < 0.02
    assert direct["tiny"]["rank_error"] == 0 and direct["tiny"]["p50"] == 2.0


def test_rounds_of_bounded_fan_in(spark, monkeypatch):
    monkeypatch.setattr(pc, "FAN", 3)
    monkeypatch.setattr(pc, "HELD_GROUPS", 1)
    coin = np.random.default_rng(6)
    values = coin.normal(0, 1, 40_000)
    df = spark.createDataFrame([(i % 2, float(v)) for i, v in enumerate(values)], "g int, v double").repartition(20)
    for row in pc.quantiles(pc.sketch(df, ["g"], "v"), ["g"]).collect():
        own = values[row["g"] :: 2]
        assert row["n"] == len(own) and worst(own, row) <= row["rank_error"] < 0.03


def test_bad_values_null_keys_and_empty(spark):
    df = spark.createDataFrame([(None, 1.0), (None, None), ("a", float("nan")), ("a", float("inf")), ("a", 7.0)], "levels string, v double")
    got = {r["levels"]: (r["n"], r["p50"]) for r in pc.quantiles(pc.sketch(df, ["levels"], "v"), ["levels"]).collect()}
    assert got == {None: (1, 1.0), "a": (1, 7.0)}
    assert pc.quantiles(pc.sketch(df.limit(0), ["levels"], "v"), ["levels"]).count() == 0


def test_usable_durations(spark):
    schema = "record_id bigint, dataset string, utt_count int, duration_seconds double, measured_at timestamp_ntz"
    rows = [(1, "a", 1, 2.0, None), (1, "a", 1, 2.0, None), (2, "a", 1, -1.0, None), (3, "a", None, float("nan"), None), (4, "a", None, 0.0, None)]
    assert sorted(r["record_id"] for r in pc.usable_durations(spark.createDataFrame(rows, schema)).collect()) == [1, 4]
    assert pc.usable_durations(spark.createDataFrame([], schema)).agg(F.count("*")).first()[0] == 0
