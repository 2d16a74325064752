"""Metrics of ordered sequences: similarity to the end, to the next, turnover.

A sequence is all rows with equal ``keys`` in the order of ``order``. Windows
and grouped aggregates share one hash partitioning on the keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.vectors import cosine, progress_bin


def number_positions(df: DataFrame, keys: list[str], order: list[str], least: int = 1) -> DataFrame:
    """Add ``position`` (from 1) and ``length``; shorter sequences than ``least`` go."""
    whole = Window.partitionBy(*keys)
    numbered = df.withColumn("position", F.row_number().over(whole.orderBy(*order))).withColumn("length", F.count("*").over(whole))
    return numbered.where(F.col("length") >= least)


def finalise_sequences(df: DataFrame, keys: list[str], index: str) -> DataFrame:
    """Add clip_position (dense rank of ``index``), clip_count (distinct
    indexes), progress_ratio, is_final and sequence_id; NULL for rows that
    lack a key part or the index."""
    complete = F.lit(True)
    for k in [*keys, index]:
        complete = complete & F.col(k).isNotNull()
    part = Window.partitionBy(*keys, complete)
    # the greatest dense rank is the number of distinct indexes
    out = df.withColumn("clip_position", F.when(complete, F.dense_rank().over(part.orderBy(index))))
    out = out.withColumn("clip_count", F.max("clip_position").over(part))
    ratio = F.col("clip_position") / F.col("clip_count")
    named = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    return (
        out.withColumn("progress_ratio", ratio)
        .withColumn("is_final", F.col("clip_position") == F.col("clip_count"))
        .withColumn("sequence_id", F.when(complete, named))
    )


def reject_sequences(df: DataFrame, keys: list[str], bad) -> DataFrame:
    """Drop every sequence that has a row for which ``bad`` holds."""
    flags = df.withColumn("_bad", F.coalesce(bad, F.lit(False)))
    return flags.withColumn("_any", F.bool_or("_bad").over(Window.partitionBy(*keys))).where(~F.col("_any")).drop("_bad", "_any")


def sequence_metrics(df: DataFrame, keys: list[str], order: list[str], vector: str, bins: int = 20) -> DataFrame:
    """Rows with position, length, to_final, to_next and bin_index, for
    sequences of at least two members. ``to_next`` is NULL on the last."""
    rows = number_positions(df, keys, order, 2)
    by = Window.partitionBy(*keys).orderBy(*order)
    last = F.last(vector).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    following = F.lead(vector).over(by)
    rows = rows.withColumn("_last", last).withColumn("_next", following)
    return (
        rows.withColumn("to_final", cosine(F.col(vector), F.col("_last")))
        .withColumn("to_next", F.when(F.col("_next").isNotNull(), cosine(F.col(vector), F.col("_next"))))
        .withColumn("bin_index", progress_bin(F.col("position"), F.col("length"), bins))
        .drop("_last", "_next")
    )


def relative_to_final(df: DataFrame, keys: list[str], order: list[str], value: str, least: float = 1e-12) -> DataFrame:
    """Add ``relative``: value over the sequence's last value; NULL where that is (near) zero."""
    by = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = F.last(value).over(by)
    return df.withColumn("relative", F.when(F.abs(last) > least, F.col(value) / last))


def turnover(metrics: DataFrame, keys: list[str], thresholds: list[float]) -> DataFrame:
    """(keys, threshold, turnover, turnover_ratio): neighbours strictly below a
    threshold, and their number over the sequence's length."""
    levels = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")
    rows = metrics.select(*keys, "length", "to_next", levels)
    below = F.coalesce(F.sum((F.col("to_next") < F.col("threshold")).cast("bigint")), F.lit(0))
    grouped = rows.groupBy(*keys, "threshold").agg(below.cast("bigint").alias("turnover"), F.max("length").alias("length"))
    return grouped.withColumn("turnover_ratio", F.col("turnover") / F.col("length"))


def weighted_turnover_position(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, position): mean relative position of the first of each neighbour
    pair, weighted by max(0, 1 - similarity); NULL if all weights are zero."""
    weight = F.greatest(F.lit(0.0), 1 - F.col("to_next"))
    paired = metrics.where("to_next IS NOT NULL")
    at = F.col("position") / F.col("length")
    return paired.groupBy(*keys).agg(F.try_divide(F.sum(weight * at), F.sum(weight)).alias("weighted_position"))


def number_islands(df: DataFrame, keys: list[str], order: list[str], same: list[str]) -> DataFrame:
    """Add ``island``: runs of neighbours with equal ``same`` columns."""
    by = Window.partitionBy(*keys).orderBy(*order)
    equal = F.lit(True)
    for c in same:
        equal = equal & F.col(c).eqNullSafe(F.lag(c).over(by))
    fresh = F.when((F.row_number().over(by) > 1) & equal, 0).otherwise(1)
    return df.withColumn("_fresh", fresh).withColumn("island", F.sum("_fresh").over(by)).drop("_fresh")


def merge_islands(df: DataFrame, keys: list[str], order: list[str], same: list[str], aggregates: list) -> DataFrame:
    """Fuse each run of equal neighbours into one row with the given aggregates."""
    return number_islands(df, keys, order, same).groupBy(*keys, "island", *same).agg(*aggregates)
