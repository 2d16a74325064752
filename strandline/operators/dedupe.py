"""One row per key: by priority, by order of arrival, by an extreme."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_per_key(df: DataFrame, keys: list[str], rank: list[Column]) -> DataFrame:
    """The row with the greatest ``rank`` of each key (null keys form a group).

    An aggregate, not a window: each partition keeps one row per key before
    the shuffle, so a key with a third of all rows costs no more than others.
    """
    best = df.groupBy(*keys).agg(F.max_by(F.struct("*"), F.struct(*[r.alias(f"r{i}") for i, r in enumerate(rank)])).alias("_best"))
    return best.select("_best.*")


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The row that comes first in ``order`` of each key."""
    first = df.groupBy(*keys).agg(F.min_by(F.struct("*"), F.struct(*[r.alias(f"r{i}") for i, r in enumerate(order)])).alias("_first"))
    return first.select("_first.*")


def union_first_wins(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Union in which a key's rows come only from the first frame that has it."""
    ranked = None
    for i, df in enumerate(frames):
        mine = df.withColumn("_source", F.lit(i))
        ranked = mine if ranked is None else ranked.unionByName(mine, allowMissingColumns=True)
    # an aggregate and a join: a key with very many rows is not one task's
    lead = ranked.groupBy(*[F.col(k).alias(f"_key_{k}") for k in keys]).agg(F.min("_source").alias("_lead"))
    same = (ranked["_source"] == lead["_lead"]) & reduce(lambda a, b: a & b, [ranked[k].eqNullSafe(lead[f"_key_{k}"]) for k in keys])
    return ranked.join(lead, same, "left_semi").drop("_source")


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int, strict: bool = False) -> DataFrame:
    """First ``n`` rows of each key with their ``rank``; ``strict`` drops keys with fewer."""
    part = Window.partitionBy(*keys)
    ranked = df.withColumn("rank", F.row_number().over(part.orderBy(*order)))
    if strict:
        ranked = ranked.withColumn("_size", F.count("*").over(part)).where(F.col("_size") >= n).drop("_size")
    return ranked.where(F.col("rank") <= n)
