"""Joins by time, by first hit and by agreement of whole sequences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def interval_join(
    intervals: DataFrame, samples: DataFrame, keys: list[str], start: str, end: str, time: str, bucket: float, how: str = "inner"
) -> DataFrame:
    """Samples with ``start <= time <= end`` (both ends included) of equal keys.

    Intervals are spread over time buckets, so that a key with very many
    samples is joined bucket by bucket. A bucket is ``bucket`` wide, for longer
    intervals four times as much a level, so that an interval of any length
    lies in three buckets at most; a sample meets each level that intervals
    have. ``time``, ``start`` and ``end`` are numbers. Adds no column but those
    of ``samples``.
    """
    span = (F.col(end) - F.col(start)) / bucket
    level = F.when(span <= 1, 0).otherwise(F.ceil(F.log(4.0, span))).cast("int")
    width = lambda at: F.lit(float(bucket)) * F.pow(F.lit(4.0), at)
    spread = intervals.where(F.col(end) >= F.col(start)).withColumn("_level", level)
    levels = spread.agg(F.collect_set("_level").alias("levels"))
    first, last = (F.floor(F.col(c) / width(F.col("_level"))) for c in (start, end))
    spread = spread.withColumn("_bucket", F.explode(F.sequence(first, last)))
    held = samples.withColumn("_level", F.explode(levels.scalar()))
    held = held.withColumn("_bucket", F.floor(F.col(time) / width(F.col("_level"))))
    inside = (F.col(time) >= F.col(start)) & (F.col(time) <= F.col(end))
    return spread.join(held, [*keys, "_level", "_bucket"], how).where(inside).drop("_level", "_bucket")


def nearest_asof(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, right_value: str, tolerance: float) -> DataFrame:
    """``left`` plus the nearest right row's time and value, at most ``tolerance`` away.

    Between the last right row before and the first at or after a left row the
    nearer wins, and at equal distance the later. Both sides are united and cut
    into time buckets eight tolerances wide, a right row lying in each that it
    can serve, so a key with very many rows is many tasks' work; each left row
    looks back in its bucket's order and in the reverse order.
    """
    columns = left.columns
    width = max(8 * tolerance, 1)
    at = F.floor(F.col(left_time) / width)
    a = left.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], at.alias("_bucket"), F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.struct(*columns).alias("_row"), F.lit(None).cast(right.schema[right_value].dataType).alias("_v"))
    reach = F.array_distinct(F.array(*[F.floor((F.col(right_time) + d) / width) for d in (-tolerance, tolerance)]))
    b = right.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.explode(reach).alias("_bucket"), F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), F.col(right_value).alias("_v"))
    both = a.unionByName(b)
    parts = Window.partitionBy(*[f"_k{i}" for i in range(len(keys))], "_bucket")
    point = F.when(F.col("_side") == 0, F.struct(F.col("_t").alias("t"), F.col("_v").alias("v")))
    # left rows sort before right rows of the same time, so that these lie ahead
    earlier = (Window.unboundedPreceding, -1)
    back = F.last(point, ignorenulls=True).over(parts.orderBy("_t", F.desc("_side"), "_v").rowsBetween(*earlier))
    ahead = F.last(point, ignorenulls=True).over(parts.orderBy(F.desc("_t"), "_side", F.desc("_v")).rowsBetween(*earlier))
    near = both.withColumn("_b", back).withColumn("_a", ahead).where("_side = 1")
    gap_b, gap_a = F.col("_t") - F.col("_b.t"), F.col("_a.t") - F.col("_t")
    pick = F.when(gap_a.isNotNull() & (gap_b.isNull() | (gap_a <= gap_b)), F.col("_a")).otherwise(F.col("_b"))
    chosen = near.withColumn("_p", pick).withColumn("_gap", F.abs(F.col("_t") - F.col("_p.t")))
    found = F.col("_gap") <= tolerance
    return chosen.select("_row.*", F.when(found, F.col("_p.t")).alias("match_time"), F.when(found, F.col("_p.v")).alias("match_value"))


def first_hit(left: DataFrame, right: DataFrame, attempts: list[tuple[str, str]], value: str, out: str) -> DataFrame:
    """Add ``out``: ``right.value`` by the first (left column, right column)
    pair that finds a row; right keys with several rows give the smallest value."""
    hits = []
    for i, (a, b) in enumerate(attempts):
        side = right.where(F.col(b).isNotNull()).groupBy(F.col(b).alias(f"_h{i}")).agg(F.min(value).alias(f"_v{i}"))
        left = left.join(side, left[a] == side[f"_h{i}"], "left")
        hits.append(f"_v{i}")
    out_df = left.withColumn(out, F.coalesce(*hits))
    return out_df.drop(*hits, *[f"_h{i}" for i in range(len(attempts))])


def exactly_one(right: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) of keys with exactly one row; others have none."""
    grouped = right.groupBy(key).agg(F.count("*").alias("_n"), F.first(value).alias(value))
    return grouped.where("_n = 1").drop("_n")


def all_siblings(df: DataFrame, key: str, member: str, wanted: list) -> DataFrame:
    """Keys that have every wanted member."""
    held = df.where(F.col(member).isin(*wanted)).groupBy(key).agg(F.countDistinct(member).alias("_n"))
    return held.where(F.col("_n") == len(wanted)).select(key)


def aligned_sequences(left: DataFrame, right: DataFrame, keys: list[str], index: str, value: str, kept: tuple[str, ...] = ()) -> DataFrame:
    """Element pairs of sequences whose ordered index lists are identical.

    ``kept`` names further columns of ``right`` that tell its sequences apart
    (a label, say): each left sequence meets all of them, and they stay in the output.
    """

    def gathered(df: DataFrame, by: list[str], name: str) -> DataFrame:
        items = F.array_sort(F.collect_list(F.struct(F.col(index).alias("i"), F.col(value).alias("v")))).alias(name)
        return df.where(F.col(index).isNotNull()).groupBy(*by).agg(items)

    both = gathered(left, keys, "_a").join(gathered(right, [*kept, *keys], "_b"), keys).where(F.col("_a.i") == F.col("_b.i"))
    pairs = both.select(*kept, *keys, F.explode(F.arrays_zip("_a", "_b")).alias("z"))
    return pairs.select(*kept, *keys, F.col("z._a.i").alias(index), F.col("z._a.v").alias("left_value"), F.col("z._b.v").alias("right_value"))


def positional_join(left: DataFrame, right: DataFrame, keys: list[str], left_items: str, right_items: str) -> DataFrame:
    """The i-th element of one array with the i-th of the other.

    Arrays of one key that differ in length are an error (see
    ``length_conflicts``); a key that only one side has gives no row.
    """
    both = left.join(right, keys)
    conflict = F.raise_error(F.concat(F.lit("arrays differ in length at "), F.concat_ws(", ", *[F.col(k).cast("string") for k in keys])))
    zipped = F.when(F.size(left_items) == F.size(right_items), F.arrays_zip(left_items, right_items)).otherwise(conflict)
    return both.select(*keys, F.posexplode(zipped).alias("pos", "z")).select(
        *keys, "pos", F.col(f"z.{left_items}").alias("left_item"), F.col(f"z.{right_items}").alias("right_item")
    )


def length_conflicts(left: DataFrame, right: DataFrame, keys: list[str], left_items: str, right_items: str) -> DataFrame:
    """(keys, left_size, right_size) of the keys whose arrays differ in length."""
    both = left.join(right, keys).select(*keys, F.size(left_items).alias("left_size"), F.size(right_items).alias("right_size"))
    return both.where("left_size <> right_size")


def stem_report(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, status): both, left_only or right_only; null keys take no part."""
    a, b = (df.where(F.col(key).isNotNull()).select(key).distinct().withColumn(name, F.lit(True)) for df, name in ((left, "_l"), (right, "_r")))
    status = F.when(F.col("_r").isNull(), "left_only").when(F.col("_l").isNull(), "right_only").otherwise("both")
    return a.join(b, key, "full").select(key, status.alias("status"))


def ratio_join(df: DataFrame, keys: list[str], mode: str, modes: tuple[str, str], value: str, order: str, least: float = 1e-12) -> DataFrame:
    """(keys, numerator, denominator, status, ratio): the two modes of one
    metric stream joined with themselves on ``keys``.

    Of several rows of a key and mode the last by ``order`` holds. status is
    ratio, missing (no denominator) or near_zero (at most ``least``).
    """
    last = F.max_by(F.col(value), F.col(order))
    sides = [df.where(F.col(mode) == m).groupBy(*keys).agg(last.alias(name)) for m, name in zip(modes, ("numerator", "denominator"), strict=True)]
    a, b = sides[0].alias("a"), sides[1].withColumn("_has", F.lit(True)).alias("b")
    same = reduce(lambda x, y: x & y, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])
    both = a.join(b, same, "left").select(*[f"a.{k}" for k in keys], "numerator", "denominator", "_has")
    status = F.when(F.col("_has").isNull(), "missing").when(F.abs("denominator") <= least, "near_zero").otherwise("ratio")
    ratio = F.when(status == "ratio", F.try_divide("numerator", "denominator"))
    return both.select(*keys, "numerator", "denominator", status.alias("status"), ratio.alias("ratio"))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def waterfall(df: DataFrame, checks: list[tuple[str, Column]], out: str = "reject_reason") -> DataFrame:
    """Add the name of the first check that holds; NULL for rows that pass all."""
    reason = F.lit(None).cast("string")
    for name, check in reversed(checks):
        reason = F.when(F.coalesce(check, F.lit(False)), name).otherwise(reason)
    return df.withColumn(out, reason)
