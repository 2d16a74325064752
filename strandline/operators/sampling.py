"""Deterministic samples: the same rows for the same seed, whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(seed: int, key: Column) -> Column:
    """Order of drawing: a hash of seed and key, equal in any engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def seeded_sample(df: DataFrame, key: str, n: int, seed: int, whole: bool = False) -> DataFrame:
    """``n`` rows without replacement; with ``whole`` fewer rows are an error."""
    if whole and (held := df.limit(n).count()) < n:
        raise ValueError(f"{held} rows are no sample of {n}")
    return df.orderBy(draw(seed, F.col(key)), key).limit(n)


def stratified_sample(df: DataFrame, strata: list[str], key: str, n: int, seed: int) -> DataFrame:
    """At most ``n`` rows of each stratum; small strata are kept whole."""
    order = Window.partitionBy(*strata).orderBy(draw(seed, F.col(key)), key)
    return df.withColumn("_no", F.row_number().over(order)).where(F.col("_no") <= n).drop("_no")


def bernoulli(df: DataFrame, key: str, share: float, seed: int) -> DataFrame:
    """Rows whose hash falls below ``share``: needs neither sort nor shuffle."""
    return df.where(F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1_000_000)) < int(share * 1_000_000))
