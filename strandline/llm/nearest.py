"""Problem 4: the record of another table nearest in time, by expanding rings.

Right rows are first reduced to those in a bucket next to some left row at the
full tolerance (a semi-join on entity and bucket, so an entity holding a third
of all rows is spread over its buckets). The rings then work on that small
set: with buckets of width ``w`` every right row within ``w`` of a left row is
in the same or an adjacent bucket, so a match at distance <= ``w`` is provably
nearest and is accepted; left rows without one go to buckets of twice the
width, until the width is the tolerance.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.session import stage

FIRST_WIDTH = 5


def _adjacent(t: Column, width: int) -> Column:
    at = F.floor(t / width)
    return F.explode(F.array(at - 1, at, at + 1))


def nearest_by_rings(
    left: DataFrame, right: DataFrame, left_id: str, right_id: str, entity: str, left_time: str, right_time: str, tolerance: int
) -> DataFrame:
    """(left_id, right_id) of the nearest right row of the same entity, at most
    ``tolerance`` whole time units away, both ends included.

    At equal distance the earlier right row wins, then the smaller right id.
    Left rows with a null entity or time, or with nothing near enough, have no
    row in the result; repeated ids count once; columns that are not named are
    ignored. Both times must be whole numbers (bigint).
    """
    lefts = left.select(F.col(left_id).alias("lid"), F.col(entity).alias("ent"), F.col(left_time).cast("long").alias("lt"))
    lefts = stage(lefts.where("lid IS NOT NULL AND ent IS NOT NULL AND lt IS NOT NULL").dropDuplicates(["lid"]), "ring-left")
    rights = right.select(F.col(right_id).alias("rid"), F.col(entity).alias("ent"), F.col(right_time).cast("long").alias("rt"))
    rights = rights.where("rid IS NOT NULL AND ent IS NOT NULL AND rt IS NOT NULL").withColumn("b", F.floor(F.col("rt") / tolerance))
    cells = stage(lefts.select("ent", _adjacent(F.col("lt"), tolerance).alias("b")).distinct(), "ring-cells")
    near = stage(rights.join(cells, ["ent", "b"], "left_semi").groupBy("ent", "rt").agg(F.min("rid").alias("rid")), "ring-right")

    widths = [FIRST_WIDTH]
    while widths[-1] < tolerance:
        widths.append(min(2 * widths[-1], tolerance))
    open_left, accepted = lefts, []
    for i, width in enumerate(min(w, tolerance) for w in widths):
        ring = open_left.withColumn("b", _adjacent(F.col("lt"), width))
        pairs = ring.join(near.withColumn("b", F.floor(F.col("rt") / width)), ["ent", "b"])
        gap = F.abs(F.col("lt") - F.col("rt"))
        best = pairs.where(gap <= width).groupBy("lid").agg(F.min(F.struct(gap.alias("gap"), "rt", "rid")).alias("best"))
        best = stage(best.select("lid", F.col("best.rid").alias("rid")), f"ring-{i}")
        accepted.append(best)
        if width < tolerance:
            open_left = open_left.join(best.select("lid"), "lid", "left_anti")
    found = reduce(DataFrame.unionByName, accepted)
    return found.select(F.col("lid").alias(left_id), F.col("rid").alias(right_id))
