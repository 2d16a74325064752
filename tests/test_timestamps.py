"""Problem 1 against the standard library and hand-made cases."""

import datetime as dt
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from strandline.operators import timestamps as ts

UTC = dt.timezone.utc


def us(*parts, zone="UTC", micro=0, fold=0):
    at = dt.datetime(*parts, microsecond=micro, tzinfo=ZoneInfo(zone), fold=fold)
    return round((at - dt.datetime(1970, 1, 1, tzinfo=UTC)).total_seconds() * 1e6)


CASES = [
    ("2025-11-04T16:41:15.214Z", None, None, us(2025, 11, 4, 16, 41, 15, micro=214000)),
    ("2025-11-04 22:10:56+0530", None, None, us(2025, 11, 4, 16, 40, 56)),
    ("2025-11-04T17:41:42.278+01", None, None, us(2025, 11, 4, 16, 41, 42, micro=278000)),
    ("20251104T164115Z", None, None, us(2025, 11, 4, 16, 41, 15)),
    ("Tue, 04 Nov 2025 22:11:09 +0530", None, None, us(2025, 11, 4, 16, 41, 9)),
    ("04 Nov 2025 17:41:33 CET", "Asia/Tokyo", "ymd", us(2025, 11, 4, 16, 41, 33)),
    ("2025-05-06T15:42:43.379-04:00[America/New_York]", "Asia/Tokyo", None, us(2025, 5, 6, 19, 42, 43, micro=379000)),
    ("09 Oct 2025 21:11:33 IST", None, None, us(2025, 10, 9, 15, 41, 33)),
    ("04/11/2025 22:10:50", "Asia/Kolkata", "dmy", us(2025, 11, 4, 16, 40, 50)),
    ("11/03/2024 01:59:32 AM", "America/New_York", "mdy", us(2024, 11, 3, 5, 59, 32)),
    ("12/31/2024 12:05:00 AM", "America/New_York", "mdy", us(2024, 12, 31, 5, 5, 0)),
    ("24.03.2025 12:14:33", "Europe/Amsterdam", "dmy", us(2025, 3, 24, 11, 14, 33)),
    ("2025/07/18 22:08:37", "Asia/Tokyo", "ymd", us(2025, 7, 18, 13, 8, 37)),
    ("2025-11-04 17:41", "Europe/Amsterdam", "dmy", us(2025, 11, 4, 16, 41)),
    ("1762274487519", None, None, 1762274487519000),
    ("1746560472", None, None, 1746560472000000),
    ("1746560461.593105", None, None, 1746560461593105),
    ("1725612687226313", None, None, 1725612687226313),
    ("2025-05-06T19:41:16.544137761Z", None, None, us(2025, 5, 6, 19, 41, 16, micro=544138)),
    ("\t2025-02-07 19:19:13  ", "Asia/Tokyo", "ymd", us(2025, 2, 7, 10, 19, 13)),
    # twice on the clock: the first; never on the clock: nothing
    ("2025-10-26 02:30:00", "Europe/Amsterdam", "dmy", us(2025, 10, 26, 2, 30, zone="Europe/Amsterdam", fold=0)),
    ("2025-03-30 02:30:00", "Europe/Amsterdam", "dmy", None),
    ("2025-06-31T25:61:00+02:00", None, None, None),
    ("2024-02-30T10:15:00Z", None, None, None),
    ("2025-13-04 09:12:44", "Europe/London", "dmy", None),
    ("0000-00-00 00:00:00", "Europe/London", "dmy", None),
    ("--:--:--", "Europe/London", "dmy", None),
    ("24-??-11 10:00", "Europe/London", "dmy", None),
    ("null", None, None, None),
    ("", None, None, None),
    (None, "Europe/London", "dmy", None),
    ("2025-11-04 17:41:00", None, None, None),
    ("2025-11-04 17:41:00", "Mars/Base", None, None),
    ("2025-11-04 17:41:00 QQT", "Europe/London", None, None),
    ("x" * 20_000, "Europe/London", "dmy", None),
]


def test_every_notation(spark):
    rows = [(i, c[0], c[1], c[2]) for i, c in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, raw string, zone string, day_order string")
    got = {r["i"]: r["utc_us"] for r in ts.normalise(df, "raw", "zone", "day_order").collect()}
    assert len(got) == len(CASES)
    for i, case in enumerate(CASES):
        assert got[i] == case[3], case


def test_rows_survive_repeats_and_clashing_names(spark):
    df = spark.createDataFrame(
        [(1, "1746560472", "UTC", "dmy", 5)] * 3 + [(2, "n/a", None, None, 6)],
        "utc_us_old int, when string, zone string, day_order string, raw int",
    )
    out = ts.normalise(df, "when", "zone", "day_order", out="at")
    assert out.columns == [*df.columns, "at"]
    assert out.where("at IS NOT NULL").count() == 3 and out.count() == 4
    with pytest.raises(ValueError):
        ts.normalise(df, "when", "zone", "day_order", out="raw")


def test_store_grows_by_unseen_entries_only(spark, tmp_path):
    book = ts.TimestampDictionary(spark, str(tmp_path / "times"))
    one = spark.createDataFrame([("1746560472", None, None)], "raw string, zone string, day_order string")
    two = one.unionByName(spark.createDataFrame([("1746560473", None, None)], one.schema))
    assert [book.update(one), book.update(two), book.update(two)] == [1, 1, 0]
    assert book.entries().count() == 2
    assert book.lookup(two).where("utc_us IS NOT NULL").count() == 2


def test_empty_table(spark):
    df = spark.createDataFrame([], "raw string, zone string, day_order string")
    assert ts.normalise(df, "raw", "zone", "day_order").count() == 0


def test_clocks(spark):
    rows = [
        (1, 500_100.25, 1.7e9, 500_000.0),
        (2, 1.7e9 + 7.5, 1.7e9, 500_000.0),
        (3, (1.7e9 + 7.5) * 1e3, 1.7e9, 500_000.0),
        (4, (1.7e9 + 7.5) * 1e6, 1.7e9, 500_000.0),
        (5, 7.5, 1.7e9, 500_000.0),
        (6, None, 1.7e9, 500_000.0),
        (7, 3e30, 1.7e9, 500_000.0),
        (8, 7.5, None, None),
        (9, 500_000.0 + 3 * 86_400, 1.7e9, 500_000.0),
        (10, (1.7e9 + 9 * 86_400) * 1e3, 1.7e9, 500_000.0),
        (11, float("nan"), 1.7e9, 500_000.0),
    ]
    df = spark.createDataFrame(rows, "i int, v double, s double, p double")
    clock = ts.clock_of(F.col("v"), F.col("s"), F.col("p"))
    got = {r["i"]: (r["c"], r["u"]) for r in df.select("i", clock.alias("c"), ts.reading_us(F.col("v"), F.col("s"), F.col("p")).alias("u")).collect()}
    assert got[1] == ("synced_s", 1_700_000_100_250_000)
    assert [got[i][0] for i in (2, 3, 4, 5)] == ["unix_s", "unix_ms", "unix_us", "relative_s"]
    assert all(got[i][1] == 1_700_000_007_500_000 for i in (2, 3, 4, 5))
    assert got[6] == got[7] == (None, None)
    assert got[8][1] is None
    # more than a day from the start
    assert got[9] == ("synced_s", (1_700_000_000 + 3 * 86_400) * 1_000_000) and got[10] == ("unix_ms", (1_700_000_000 + 9 * 86_400) * 1_000_000)
    assert got[11] == (None, None)


def test_second_run_parses_nothing(spark, tmp_path):
    from strandline.plans import core_problems

    rows = spark.createDataFrame([("world_timestamp", i, 1.7e9 + i % 7, 1.7e9, 5.0) for i in range(50)], "field_name string, record_id bigint, value double, system_s double, synced_s double")
    book = ts.ReadingDictionary(spark, str(tmp_path / "readings"))
    first = sorted(map(tuple, core_problems.instants(rows, book).collect()))
    assert book.entries().count() == 7 and book.update(rows) == 0
    assert first == sorted(map(tuple, core_problems.instants(rows, book).collect())) and len(first) == 50
