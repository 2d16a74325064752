"""Grouped summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators.windows import explode_range


def nine_numbers(value: str) -> list[Column]:
    """count, min, max, mean, median, population std, quartiles, total."""
    v = F.col(value)
    quarters = F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return [
        F.count(v).alias("n"),
        F.min(v).alias("min_value"),
        F.max(v).alias("max_value"),
        F.round(F.avg(v), 6).alias("mean_value"),
        F.round(quarters[1], 6).alias("median_value"),
        F.round(F.stddev_pop(v), 6).alias("std_value"),
        F.round(quarters[0], 6).alias("p25"),
        F.round(quarters[2], 6).alias("p75"),
        F.round(F.sum(v), 4).alias("total"),
    ]


def sample_std(value: Column) -> Column:
    """Sample standard deviation, 0 for a single value."""
    return F.coalesce(F.stddev_samp(value), F.lit(0.0))


def standard_error(value: Column) -> Column:
    return sample_std(value) / F.sqrt(F.count(value))


def grouping_sets(df: DataFrame, sets: list[list[str]], aggregates: list[Column]) -> DataFrame:
    """Union of groupings in one pass; columns outside a set are NULL."""
    every = list(dict.fromkeys(c for s in sets for c in s))
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in every]).agg(*aggregates)


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0 where there is nothing."""
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def missing_ids(df: DataFrame, key: str, item: str, start: int | None = None) -> DataFrame:
    """(key, missing_id): ids between the smallest (or ``start``) and the largest that a key lacks."""
    span = df.groupBy(key).agg(F.min(item).alias("lo"), F.max(item).alias("hi"))
    low = F.lit(start).cast(df.schema[item].dataType) if start is not None else F.col("lo")
    wanted = explode_range(span.withColumn("lo", low), "lo", "hi", "missing_id").select(key, "missing_id")
    have = df.select(F.col(key).alias("_k"), F.col(item).alias("_i")).distinct()
    return wanted.join(have, (F.col(key) == F.col("_k")) & (F.col("missing_id") == F.col("_i")), "left_anti")


def frequent(df: DataFrame, keys: list[str], aggregates: list[Column], least: int = 1) -> DataFrame:
    """Groups of at least ``least`` rows with their aggregates."""
    grouped = df.groupBy(*keys).agg(F.count("*").alias("_n"), *aggregates)
    return grouped.where(F.col("_n") >= least).drop("_n")


def first_category(value: Column, categories: list[tuple[str, str]], other: str = "other") -> Column:
    """Name of the first category whose pattern the value matches."""
    out = F.lit(other)
    for name, pattern in reversed(categories):
        out = F.when(F.coalesce(value.rlike(pattern), F.lit(False)), name).otherwise(out)
    return out


def unpivot(df: DataFrame, keys: list[str], values: list[str], name: str = "stat", value: str = "value") -> DataFrame:
    """One row per key and value column, NULL values left out."""
    return df.unpivot(keys, values, name, value).where(F.col(value).isNotNull())
