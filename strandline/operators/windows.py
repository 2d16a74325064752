"""Windows over ids, counts and fixed time buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.session import stage


def explode_range(df: DataFrame, low: str, high: str, out: str, step: int = 1) -> DataFrame:
    """One row per number ``low``, ``low + step``, ... up to ``high``.

    The range is exploded by its number's digits to the base 65,536, so that
    no array is longer than that, however far apart the ends are.
    """
    kind = df.schema[low].dataType
    rows = df.where(F.col(high) >= F.col(low)).withColumn("_most", F.floor((F.col(high) - F.col(low)).cast("long") / step).cast("long")).withColumn("_at", F.lit(0).cast("long"))
    for shift in (48, 32, 16, 0):
        left = F.shiftright(F.col("_most") - F.col("_at"), shift)
        digit = F.sequence(F.lit(0).cast("long"), F.least(left, F.lit(65_535)))
        rows = rows.withColumn("_digit", F.explode(digit)).withColumn("_at", F.col("_at") + F.shiftleft("_digit", shift))
    return rows.withColumn(out, (F.col(low) + F.col("_at") * step).cast(kind)).drop("_most", "_at", "_digit")


def hopping_groups(df: DataFrame, key: str, item: str, size: int = 3, stride: int = 2) -> DataFrame:
    """(key, window_start, present, missing): windows of ``size`` consecutive
    ids from the smallest id on, hop ``size + stride``, also across gaps and
    past the largest id. ``present`` and ``missing`` are sorted id arrays."""
    hop = size + stride
    span = df.groupBy(key).agg(F.min(item).alias("lo"), F.max(item).alias("hi"))
    starts = explode_range(span, "lo", "hi", "window_start", hop).select(key, "window_start")
    wanted = starts.select(key, "window_start", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("_k"))
    wanted = wanted.withColumn("_id", F.col("window_start") + F.col("_k"))
    have = df.select(F.col(key).alias("_key"), F.col(item).alias("_item")).distinct()
    met = wanted.join(have, (F.col(key) == F.col("_key")) & (F.col("_id") == F.col("_item")), "left")
    return met.groupBy(key, "window_start").agg(
        F.array_sort(F.collect_list("_item")).alias("present"),
        F.array_sort(F.collect_list(F.when(F.col("_item").isNull(), F.col("_id")))).alias("missing"),
    )


def suffix_groups(windows: DataFrame, key: str, size: int = 3) -> DataFrame:
    """(key, window_start, group_size, members): suffixes of every complete window."""
    whole = windows.where(F.size("missing") == 0)
    sized = whole.withColumn("group_size", F.explode(F.sequence(F.lit(1), F.lit(size))))
    return sized.select(key, "window_start", "group_size", F.expr("slice(present, -group_size, group_size)").alias("members"))


def prefix_windows(df: DataFrame, count: str, length: float) -> DataFrame:
    """Explode each row into its prefixes: clip i of ``count`` covers [0, i * length]."""
    each = df.where(F.col(count) > 0).withColumn("clip_no", F.explode(F.sequence(F.lit(1).cast("int"), F.col(count).cast("int"))))
    return each.withColumn("covers_until", F.col("clip_no") * F.lit(float(length)))


def even_indexes(count: Column, wanted: int) -> Column:
    """Indexes 0..count-1 evenly spread: all if few, the middle if one is wanted."""
    all_of = F.when(count > 0, F.sequence(F.lit(0), (count - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    if wanted == 1:
        return F.when(count <= 1, all_of).otherwise(F.array(F.floor(count / 2).cast("int")))
    spread = F.transform(F.sequence(F.lit(0), F.lit(wanted - 1)), lambda i: F.rint(i * (count - 1) / (wanted - 1)).cast("int"))
    return F.when(count <= wanted, all_of).otherwise(spread)


def time_bucket(seconds: Column, width: float = 120.0) -> Column:
    """Right-closed bucket number: 0 holds only the start, 1 ends at ``width``."""
    return F.ceil(seconds / width).cast("bigint")


def equal_batches(df: DataFrame, keys: list[str], order: list[str], size: int, must_divide: bool = False) -> DataFrame:
    """Add ``batch``: rows of a key in order, ``size`` a batch, from 0.

    With ``must_divide`` a key whose rows do not fill their last batch is an error.
    """
    if must_divide:
        rest = df.groupBy(*keys).count().where(F.col("count") % size != 0)
        if odd := rest.head():
            raise ValueError(f"{odd['count']} rows do not divide into batches of {size}")
    no = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("batch", F.floor((no - 1) / size).cast("bigint"))


def in_hundred(id_: Column, block: int, size: int = 100) -> Column:
    """The id lies in the ``block``-th block (from 1) of ``size``: ids from 0 on."""
    return (id_ >= (block - 1) * size) & (id_ < block * size)


def frame_table(df: DataFrame, frames: str, fps: float) -> DataFrame:
    """Explode each row into frame_index 0..frames-1 with its time."""
    each = df.where(F.col(frames) > 0).withColumn("frame_index", F.explode(F.sequence(F.lit(0), (F.col(frames) - 1).cast("int"))))
    return each.withColumn("frame_time", F.col("frame_index") / F.lit(float(fps)))


def global_ids(df: DataFrame, order: list[str], out: str, form: str = "row-%09d") -> DataFrame:
    """Add a gapless running id over a total order without one global sort task.

    Rows are range-partitioned by the order, numbered within partitions, and
    shifted by the sizes of the partitions before (one row per partition).
    """
    spread = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    spread = stage(spread, "global-ids")
    sizes = spread.groupBy("_part").agg(F.count("*").alias("_n"))
    shift = F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")
    sizes = sizes.select("_part", shift.alias("_shift"))
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    numbered = spread.withColumn("_no", local).join(F.broadcast(sizes), "_part")
    return numbered.withColumn(out, F.format_string(form, F.col("_no") + F.col("_shift") - 1)).drop("_part", "_no", "_shift")
