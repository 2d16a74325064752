"""Queries of the general training-data problems (1, 2 and 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import intervals, spikes, timestamps
from strandline.plans.time_sql import P1_SQL
from strandline.session import stage, table


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per recording with what places its times."""
    columns = ("recording_id", "site_zone", "site_date_order", "start_time_system_s", "start_time_synced_s")
    return table(spark, sf_dir, "recordings").select(*columns).dropDuplicates(["recording_id"])


def written_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(field_name, record_id, raw, zone, day_order) of the texts that state times."""
    video = table(spark, sf_dir, "video_timings").select(
        F.lit("video_start_time").alias("field_name"), F.col("timing_id").alias("record_id"), "recording_id", F.col("video_start_time").alias("raw")
    )
    created = table(spark, sf_dir, "selected_responses").select(
        F.lit("created").alias("field_name"), F.col("response_id").alias("record_id"), "recording_id", F.col("created").alias("raw")
    )
    sites = recordings(spark, sf_dir).select("recording_id", F.col("site_zone").alias("zone"), F.col("site_date_order").alias("day_order"))
    rows = video.unionByName(created).dropDuplicates(["field_name", "record_id"])
    return rows.join(sites, "recording_id", "left").drop("recording_id")


def foreign_clock_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(field_name, record_id, value, system_s, synced_s) of the gaze readings
    that are not on their recording's own clock.

    The filter comes before the removal of re-delivered rows, so that only the
    few foreign readings are shuffled.
    """
    starts = recordings(spark, sf_dir).select("recording_id", F.col("start_time_system_s").alias("system_s"), F.col("start_time_synced_s").alias("synced_s"))
    value, system, synced = F.col("value"), F.col("system_s"), F.col("synced_s")
    gaze = table(spark, sf_dir, "gaze_samples").select(F.col("sample_id").alias("record_id"), "recording_id", F.col("world_timestamp").alias("value"))
    foreign = gaze.join(starts, "recording_id").where(timestamps.clock_of(value, system, synced) != "synced_s")
    return foreign.select(F.lit("world_timestamp").alias("field_name"), "record_id", "value", "system_s", "synced_s").dropDuplicates(["record_id"])


def instants(rows: DataFrame, book: timestamps.Dictionary) -> DataFrame:
    """(field_name, record_id, utc_ms) of the rows whose entry denotes an instant."""
    book.update(rows)
    known = book.lookup(rows).where("utc_us IS NOT NULL")
    return known.select("field_name", F.col("record_id").cast("long").alias("record_id"), timestamps.to_ms(F.col("utc_us")).alias("utc_ms"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every written time that denotes an instant, and every reading of a
    foreign clock, as Unix milliseconds."""
    written = stage(written_times(spark, sf_dir), "written-times")
    readings = stage(foreign_clock_readings(spark, sf_dir), "foreign-readings")
    return instants(written, timestamps.TimestampDictionary(spark)).unionByName(instants(readings, timestamps.ReadingDictionary(spark)))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaze readings that no eye produced, with the kind of defect."""
    gaze = table(spark, sf_dir, "gaze_samples").select("sample_id", "recording_id", "world_timestamp", "x_norm", "y_norm", "confidence")
    starts = recordings(spark, sf_dir).select("recording_id", "start_time_system_s", "start_time_synced_s")
    value, system, synced = F.col("world_timestamp"), F.col("start_time_system_s"), F.col("start_time_synced_s")
    placed = gaze.join(starts, "recording_id", "left").select(
        "sample_id",
        "recording_id",
        F.coalesce(timestamps.reading_us(value, system, synced) / 1e6, value).alias("t"),
        "x_norm",
        "y_norm",
        "confidence",
    )
    return spikes.flag_readings(placed, "sample_id", "recording_id", "t", "x_norm", "y_norm", "confidence")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speech periods and the gaps between them, per interaction and speaker."""
    return intervals.speech_periods(table(spark, sf_dir, "utterances"))


def queries() -> dict:
    return {"p1_found": p1_found, "p2_found": p2_found, "p5_found": p5_found}


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_SQL, "p2_found": intervals.ORACLE_SQL}
