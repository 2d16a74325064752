"""Screen, video and body-point geometry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EDGE = 1e-9


def screen_to_video(x: Column, y: Column, screen_ratio: float, video_ratio: float) -> Column:
    """Struct(x, y) of a screen point on a letterboxed video; NULL outside it."""
    width, height = (1.0, screen_ratio / video_ratio) if video_ratio >= screen_ratio else (video_ratio / screen_ratio, 1.0)
    vx, vy = (x - (1.0 - width) / 2.0) / width, (y - (1.0 - height) / 2.0) / height
    inside = (vx >= -EDGE) & (vx <= 1.0 + EDGE) & (vy >= -EDGE) & (vy <= 1.0 + EDGE)
    clip = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    return F.when(inside, F.struct(clip(vx).alias("x"), clip(vy).alias("y")))


def control_shift(x: Column) -> Column:
    """The comparison point half a screen away."""
    return F.pmod(x + 0.5, F.lit(1.0))


def quadrant(x: Column, y: Column, dead: float = 0.1) -> Column:
    """top/bottom-left/right; NULL within ``dead`` of an axis."""
    side = F.when(x < 0.5 - dead, "left").when(x > 0.5 + dead, "right")
    level = F.when(y < 0.5 - dead, "top").when(y > 0.5 + dead, "bottom")
    return F.when(side.isNotNull() & level.isNotNull(), F.concat(level, F.lit("-"), side))


def clamp_interval(start: Column, end: Column, most: Column) -> Column:
    """Struct(start, end) within 0..most, the end not before the start."""
    low = F.greatest(F.lit(0.0), F.least(start, most))
    return F.struct(low.alias("start"), F.greatest(low, F.least(end, most)).alias("end"))


def points_box(points: Column) -> Column:
    """Bounding box of visible points given as array<struct<x,y,v>>; NULL if none is visible."""
    seen = F.filter(points, lambda p: p["v"] > 0)
    xs, ys = F.transform(seen, lambda p: p["x"]), F.transform(seen, lambda p: p["y"])
    box = F.struct(
        F.array_min(xs).alias("x"),
        F.array_min(ys).alias("y"),
        (F.array_max(xs) - F.array_min(xs) + 1).alias("w"),
        (F.array_max(ys) - F.array_min(ys) + 1).alias("h"),
    )
    return F.when(F.size(seen) > 0, box)


def pixel_points(points: Column, width: int, height: int, valid: float = 0.5) -> Column:
    """Relative points, array<struct<x,y>>, as pixels with visibility (2 seen,
    0 not: missing or at the origin); far points go, and the whole is NULL
    unless more than ``valid`` of all points (rounded up) are left."""
    seen = F.filter(points, lambda p: p["x"].isNotNull() & p["y"].isNotNull() & ~((p["x"] == 0) & (p["y"] == 0)))
    near = without_far_points(seen)
    cut = lambda v, size: (v * size).cast("int")
    scaled = F.transform(near, lambda p: F.struct(cut(p["x"], width).alias("x"), cut(p["y"], height).alias("y"), F.lit(2).alias("v")))
    return F.when(F.size(near) > F.ceil(F.size(points) * valid), scaled)


def without_far_points(points: Column, keep: float = 0.8, factor: float = 4.0) -> Column:
    """Drop points whose mean distance to their nearest ``keep`` share of the
    points exceeds ``factor`` times the median of those means."""

    def mean_near(p: Column) -> Column:
        gaps = F.array_sort(F.transform(points, lambda q: F.sqrt((p["x"] - q["x"]) ** 2 + (p["y"] - q["y"]) ** 2)))
        near = F.slice(gaps, 1, F.greatest(F.lit(1), F.floor(F.size(points) * keep).cast("int")))
        return F.aggregate(near, F.lit(0.0), lambda a, x: a + x) / F.size(near)

    means = F.transform(points, mean_near)
    order = F.array_sort(means)
    half = F.size(order) / 2
    median = (F.get(order, F.floor((F.size(order) - 1) / 2).cast("int")) + F.get(order, F.floor(half).cast("int"))) / 2
    kept = F.filter(F.arrays_zip(points.alias("p"), means.alias("m")), lambda z: z["m"] <= factor * median)
    return F.transform(kept, lambda z: z["p"])
