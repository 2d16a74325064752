"""Queries of the problems tagged llm, with SQL where SQL can state them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.llm import leaks, mixing, nearest, pairs, percentiles, reading, turns
from strandline.operators import timestamps
from strandline.plans.core_problems import recordings
from strandline.plans.time_sql import P4_SQL
from strandline.session import stage, table


def p3_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles per dataset and utt_count with the bound on their rank error."""
    rows = percentiles.usable_durations(table(spark, sf_dir, "duration_records"))
    return percentiles.quantiles(percentiles.sketch(rows, ["dataset", "utt_count"], "duration_seconds"), ["dataset", "utt_count"])


def p3_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of each day from the day's own sketch."""
    rows = percentiles.usable_durations(table(spark, sf_dir, "duration_records"))
    keys = ["dataset", "utt_count", "day"]
    return percentiles.quantiles(percentiles.sketch(rows, keys, "duration_seconds"), keys)


def p3_daily_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from one sketch a day, combined over the days."""
    rows = percentiles.usable_durations(table(spark, sf_dir, "duration_records"))
    daily = percentiles.sketch(rows, ["dataset", "utt_count", "day"], "duration_seconds")
    return percentiles.quantiles(percentiles.merge(daily, ["dataset", "utt_count"]), ["dataset", "utt_count"])


def p3_bound_holds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the exact ranks of all percentiles of a group lie within its
    stated rank error, counted over all rows."""
    keys = ["dataset", "utt_count"]
    rows = percentiles.usable_durations(table(spark, sf_dir, "duration_records"))
    told = stage(percentiles.quantiles(percentiles.sketch(rows, keys, "duration_seconds"), keys), "percentiles")
    names = {f"p{round(q * 100):02d}": q for q in percentiles.PERCENTILES}
    v = F.col("duration_seconds")
    ranks = [F.count_if(v < F.col(c)).alias(f"{c}_below") for c in names] + [F.count_if(v <= F.col(c)).alias(f"{c}_upto") for c in names]
    same = [rows[k].eqNullSafe(told[k]) for k in keys]
    counted = rows.join(told, same[0] & same[1]).groupBy(told["dataset"], told["utt_count"]).agg(F.count("*").alias("n"), F.max("rank_error").alias("error"), *ranks)
    room = F.col("error") + F.try_divide(F.lit(1.0), F.col("n"))
    fits = [(F.col(f"{c}_below") / F.col("n") - q <= room) & (q - F.col(f"{c}_upto") / F.col("n") <= room) for c, q in names.items()]
    return counted.select(*keys, "n", reduce(lambda x, y: x & y, fits).alias("within"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gaze sample nearest to the moment where each clip stopped."""
    places = recordings(spark, sf_dir)
    clips = table(spark, sf_dir, "video_timings").select("timing_id", "recording_id", "video_start_time", "current_video_time")
    clips = clips.dropDuplicates(["timing_id"]).join(places.select("recording_id", "site_zone", "site_date_order"), "recording_id", "left")
    clips = timestamps.normalise(clips, "video_start_time", "site_zone", "site_date_order")
    offset = F.when(F.abs("current_video_time") < 1e9, F.round(F.col("current_video_time") * 1000).cast("long"))
    clips = clips.withColumn("at_ms", timestamps.to_ms(F.col("utc_us")) + offset)
    value, system, synced = F.col("world_timestamp"), F.col("start_time_system_s"), F.col("start_time_synced_s")
    gaze = table(spark, sf_dir, "gaze_samples").select("sample_id", "recording_id", "world_timestamp")
    gaze = gaze.join(places.select("recording_id", "start_time_system_s", "start_time_synced_s"), "recording_id")
    us = timestamps.reading_us(value, system, synced)
    # made by a generator, so that filters and buckets do not make it again
    gaze = gaze.select("sample_id", "recording_id", F.explode(F.array(timestamps.to_ms(us))).alias("at_ms"))
    return nearest.nearest_by_rings(clips, gaze, "timing_id", "sample_id", "recording_id", "at_ms", "at_ms", 20)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defective answers of both clip tables with their defect."""
    results = table(spark, sf_dir, "clip_results").select(
        F.lit("clip_results").alias("pair_table"), F.col("result_id").alias("pair_id"), F.col("user_text").alias("question"), "text"
    )
    comparisons = table(spark, sf_dir, "clip_comparisons").select(
        F.lit("clip_comparisons").alias("pair_table"), F.col("comparison_id").alias("pair_id"), F.col("user_text").alias("question"), F.col("source_text").alias("text")
    )
    return pairs.defective_pairs(results.unionByName(comparisons), table(spark, sf_dir, "documents"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean speaker turns of every interaction."""
    return turns.speaker_turns(table(spark, sf_dir, "utterances"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with each evaluation item they leak."""
    return leaks.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of sources, record by record."""
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached shares of the mix."""
    return mixing.report(p9_mix(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p9_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per target whether it is used, its cap is kept, and its share is within
    two points and three of the longest documents of the target (rescaled for
    targets without documents)."""
    mixed = stage(p9_mix(spark, sf_dir), "mix")
    grain = mixed.agg(F.coalesce(F.try_divide(F.max("tokens"), F.sum("tokens")), F.lit(0.0))).scalar()
    rows = mixing.report(mixed, table(spark, sf_dir, "mix_targets"))
    used = F.col("records") > 0
    live = F.sum(F.when(used, F.col("target_share")).otherwise(0.0)).over(Window.partitionBy(F.lit(0)))
    wanted = F.when(used, F.col("target_share") / live).otherwise(0.0)
    share = F.abs(F.col("reached_share") - wanted) <= 0.02 + 3 * grain
    return rows.select("source", used.alias("used"), (F.col("most_repeats") <= F.col("max_repeats")).alias("cap_kept"), share.alias("share_kept"))


def p10_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reading level of every English document."""
    tables = (table(spark, sf_dir, name) for name in ("documents", "eval_items", "reading_labels"))
    return reading.reading_levels(*tables).select("doc_id", F.round("level", 4).alias("level"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English documents of level 4 or 5."""
    return p10_levels(spark, sf_dir).where(F.col("level") >= reading.DEMANDING).select("doc_id")


def queries() -> dict:
    return {
        "p3_daily": p3_daily,
        "p3_percentiles": p3_percentiles,
        "p3_daily_combined": p3_daily_combined,
        "p3_bound_holds": p3_bound_holds,
        "p4_found": p4_found,
        "p6_found": p6_found,
        "p7_found": p7_found,
        "p8_found": p8_found,
        "p9_mix": p9_mix,
        "p9_report": p9_report,
        "p9_kept": p9_kept,
        "p10_found": p10_found,
        "p10_levels": p10_levels,
    }


_NAME_SQL = r"nullif(regexp_replace(trim(lower(source)), '[\s-]+', '_', 'g'), '')"


def oracle_sql() -> dict[str, str]:
    """SQL of the queries whose rows SQL can state: what must hold of the others' results."""
    return {
        "p4_found": P4_SQL,
        "p3_bound_holds": """WITH r AS (SELECT DISTINCT ON (record_id) * FROM duration_records WHERE isfinite(duration_seconds) AND duration_seconds >= 0)
            SELECT dataset, utt_count, count(*) AS n, true AS within FROM r GROUP BY dataset, utt_count""",
        "p9_kept": f"""WITH t AS (SELECT DISTINCT {_NAME_SQL} AS source FROM mix_targets), d AS (SELECT DISTINCT {_NAME_SQL} AS source FROM documents WHERE text <> '')
            SELECT t.source, d.source IS NOT NULL AS used, true AS cap_kept, true AS share_kept FROM t LEFT JOIN d ON d.source = t.source""",
    }
