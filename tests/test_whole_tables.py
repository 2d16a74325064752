"""Queries take every model, interval and order, not a part of them."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from strandline.session import table

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_every_model_is_aligned_or_listed_as_missing(spark):
    larger = "/root/testdata/sf0.01"  # no sequences of the smallest tables agree
    labels = {r[0] for r in table(spark, larger, "clip_results").select("model_label").distinct().collect()} - {None}
    aligned = {r[0] for r in entry.queries()["aligned_models"](spark, larger).select("model_label").distinct().collect()}
    assert aligned == labels - {"vidlm-base"}
    lacking = {r[0]: r[1] for r in entry.queries()["missing_sequences"](spark, DATA).groupBy("model_label").count().collect()}
    counts = {r["model_label"]: r["missing"] for r in entry.queries()["model_coverage"](spark, DATA).collect()}
    assert lacking == {k: n for k, n in counts.items() if n}


def test_every_signup_opens_an_interval(spark):
    day = 86_400_000_000
    events = table(spark, DATA, "events").select("user_id", "event_id", "event_type", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("t")).collect()
    wanted = sorted(
        (s["event_id"], e["event_id"])
        for s in events if s["event_type"] == "signup"
        for e in events if e["user_id"] == s["user_id"] and e["event_type"] != "signup" and (e["value"] or 0) >= 1 and 0 <= e["t"] - s["t"] <= day
    )
    got = entry.queries()["signup_intervals"](spark, DATA)
    assert sorted((r["signup_id"], r["event_id"]) for r in got.collect()) == wanted
    assert got.count() > entry.queries()["interval_join"](spark, DATA).count()


def test_filters_read_every_order(spark):
    orders = table(spark, DATA, "orders").where("o_orderstatus IN ('F', 'O') AND o_orderpriority NOT LIKE '%LOW%'").select("o_orderkey").collect()
    got = entry.queries()["order_filters"](spark, DATA).select("o_orderkey").collect()
    assert sorted(got) == sorted(orders)
