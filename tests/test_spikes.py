"""Problem 5 on series with known defects."""

import math

import numpy as np
import pytest

from strandline.operators import spikes


def series(seed, n, scale, start, step=0.05, hold=1):
    coin = np.random.default_rng(seed)
    at = np.repeat(coin.uniform(0.2, 0.8, n // 40 + 1), 40)[:n]
    x = np.repeat((at + coin.normal(0, scale, n))[::hold], hold)[:n]
    y = np.repeat((1 - at + coin.normal(0, scale, n))[::hold], hold)[:n]
    return start + step * np.arange(n), x, y


@pytest.mark.parametrize("chunk_rows", [spikes.CHUNK_ROWS, 3_000])
def test_known_defects(spark, monkeypatch, chunk_rows):
    monkeypatch.setattr(spikes, "CHUNK_ROWS", chunk_rows)  # the smaller cuts chunks by rank
    rows, truth = [], {}
    for k, (scale, hold) in enumerate([(0.004, 1), (0.03, 1), (0.01, 3)]):
        # the third crosses several chunks
        t, x, y = series(k, 14_000 if k == 0 else 3_000, scale, spikes.CHUNK_S - 20, hold=hold)
        base = 100_000 * k
        spots = {410: 1, 730: 2, 1_012: 3} if hold == 1 else {411: 1, 732: 2}
        for at, width in spots.items():
            x[at : at + width] += 25 * scale
            truth |= {base + i: "spike" for i in range(at, at + width)}
        edge = int(20 / 0.05)  # a stuck run across the chunk's edge
        x[edge - 30 : edge + 30], y[edge - 30 : edge + 30] = x[edge - 30], y[edge - 30]
        truth |= {base + i: "stuck" for i in range(edge - 30, edge + 30)}
        x[2_000], y[2_100] = math.nan, 65535.0
        truth |= {base + 2_000: "impossible", base + 2_100: "impossible"}
        for i in range(len(t)):
            conf = {2_200: "1.5", 2_201: "x", 2_202: "", 2_203: None, 2_204: "NaN"}.get(i, "0.9")
            rows.append((base + i, f"r{k}", float(t[i]), float(x[i]), float(y[i]), conf))
        truth |= {base + i: "impossible" for i in (2_200, 2_201, 2_204)}
    rows += rows[::50]  # re-delivered
    df = spark.createDataFrame(rows, "id bigint, src string, t double, x double, y double, c string")
    got = {r["id"]: r["defect"] for r in spikes.flag_readings(df, "id", "src", "t", "x", "y", "c").collect()}
    stuck_edge = {i for i, d in truth.items() if d == "stuck"}
    assert {i for i, d in got.items() if d == "impossible"} == {i for i, d in truth.items() if d == "impossible"}
    assert stuck_edge <= {i for i, d in got.items() if d == "stuck"}
    assert len([i for i, d in got.items() if d == "stuck"]) <= len(stuck_edge) + 9
    assert {i for i, d in got.items() if d == "spike"} == {i for i, d in truth.items() if d == "spike"}


def test_nulls_and_empty(spark):
    schema = "id bigint, src string, t double, x double, y double, c string, chunk int, own string"
    rows = [(1, None, 1.0, 0.5, 0.5, "7", 1, ""), (2, "a", None, 0.5, 0.5, None, 1, ""), (3, "a", 1.0, None, 0.5, "0.1", 1, ""), (None, "a", 1.0, 9e9, 0.5, "9", 1, "")]
    got = spikes.flag_readings(spark.createDataFrame(rows, schema), "id", "src", "t", "x", "y", "c").collect()
    assert [tuple(r) for r in got] == [(1, "impossible")]
    assert spikes.flag_readings(spark.createDataFrame([], schema), "id", "src", "t", "x", "y", "c").count() == 0


def test_residuals_of_an_autoregression():
    coin = np.random.default_rng(3)
    x, y = np.zeros(4_000), np.zeros(4_000)
    for i in range(1, 4_000):
        x[i], y[i] = 0.8 * x[i - 1] + coin.normal(0, 0.6), 0.8 * y[i - 1] + coin.normal(0, 0.6)
    at = np.arange(50, 3_950, 100)
    x[at] += 14.0
    flagged = np.flatnonzero(spikes.spike_positions(x, y, 1.0, 1.0, 0.8, 0.8))
    assert set(at) <= set(flagged) and len(flagged) <= len(at) + 2


def test_spike_at_the_first_and_last_samples():
    x = np.array([0.0, 40.0, 0.0, 0.1, 0.0, 0.1, 0.0, 0.1, 40.0, 0.0])
    assert np.flatnonzero(spikes.spike_positions(x, np.zeros(10), 1.0, 1.0)).tolist() == [1, 8]


def test_clock_that_stands_still(spark, monkeypatch):
    monkeypatch.setattr(spikes, "CHUNK_ROWS", 500)
    coin = np.random.default_rng(4)
    x = coin.normal(0.5, 0.01, 4_000)
    x[1_234] += 0.5
    rows = [(i, "a", 5.0, float(x[i]), 0.5 + float(x[i]) / 100, None) for i in range(4_000)]
    df = spark.createDataFrame(rows, "id bigint, src string, t double, x double, y double, c string")
    assert [tuple(r) for r in spikes.flag_readings(df, "id", "src", "t", "x", "y", "c").collect()] == [(1_234, "spike")]
