"""Problem 5: readings that no sensor target produced, judged per source.

Each source's series is cut into time chunks with a halo of neighbouring
samples, so that a source holding a third of all rows is many tasks' work; a
chunk that still holds very many rows (a clock that stands still) is cut
further by rank. One shuffle orders the chunks, which are written as packed
rows and read again for the tests.

Pass 1 reduces every chunk to two mergeable summaries: histograms of the
absolute lag-1 and lag-2 differences of the series with repeats collapsed, and
a histogram of the lengths of runs of equal readings. Merged per source they
give a robust first-order autoregression (the coefficient from the ratio of
the two lags' scales, the innovation scale from the first) and the run length
the source normally shows.

Pass 2 tests each patch of one to three samples on residuals of that
autoregression: around the level before, the model predicts the patch forward,
around the level after it, backward, and the two predictions weighted by their
variances interpolate it. The additive-outlier statistic is the least residual
within the patch, the level-shift statistic how far the levels are from each
other; a patch is a spike if the outlier test wins. Flagged samples are taken
out and the tests repeated until nothing more is found. Runs are then measured
on the series without spikes; pieces of runs that touch a chunk's edge are
joined across chunks before their length is judged.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.session import stage

#: Readings further than this from the screen's middle (in screens) are impossible.
FAR_SCREENS = 3.0
CHUNK_S = 600.0
HALO_S = 5.0
#: A chunk of more rows is cut by rank into parts of about so many, with a halo of HALO_ROWS.
CHUNK_ROWS = 100_000
HALO_ROWS = 32
#: Outlier statistic (in scales of the steady look) from which a patch is a spike,
#: and how close the patch's neighbours must be to the level.
SPIKE_SCALES = 7.5
NEAR_SCALES = 6.0
LONGEST_SPIKE = 3
LEVEL_SAMPLES = 3
#: Stuck runs are at least this long, this many times the usual run, and
#: expected fewer than ``RUN_CHANCE`` times in the source.
LEAST_STUCK = 7
STUCK_TIMES = 3
RUN_CHANCE = 1e-3

_BINS, _PER_OCTAVE, _LOW = 400, 16, -20.0  # log2 bins of differences from 2^-20
_RUNS = 64
#: Central shares and the half-widths of a standard normal that hold them.
_CENTRAL = [(q, NormalDist().inv_cdf((1 + q) / 2)) for q in (0.3, 0.4, 0.5, 0.6, 0.7)]


def _bin(values: np.ndarray) -> np.ndarray:
    values = values[np.isfinite(values)]
    zero = values <= 2.0**_LOW
    at = np.floor((np.log2(np.where(zero, 1.0, values)) - _LOW) * _PER_OCTAVE).astype(np.int64) + 1
    return np.bincount(np.where(zero, 0, np.clip(at, 1, _BINS - 1)), minlength=_BINS)


def _quantile(counts: np.ndarray, q: float) -> float:
    """Quantile of a difference histogram (geometric middle of its bin)."""
    total = counts.sum()
    if not total:
        return 0.0
    at = int(np.searchsorted(np.cumsum(counts), q * total, side="left"))
    return 0.0 if at == 0 else 2.0 ** (_LOW + (at - 0.5) / _PER_OCTAVE)


def _spread(counts: np.ndarray) -> float:
    """Normal scale of a difference histogram: the mean over several central
    quantiles, as one alone sits on a grain of coarsely recorded readings."""
    return sum(_quantile(counts, q) / z for q, z in _CENTRAL) / len(_CENTRAL)


def _ordered(group: pd.DataFrame) -> pd.DataFrame:
    """Samples of a chunk in time order, each id once."""
    group = group.drop_duplicates("id")
    return group.iloc[np.lexsort((group["id"].to_numpy(), group["t"].to_numpy()))]


def _change(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Positions where a new run of equal readings begins."""
    return np.flatnonzero(np.concatenate(([True], (np.diff(x) != 0) | (np.diff(y) != 0)))) if len(x) else np.zeros(0, np.int64)


PACKED = "source string, chunk long, part int, ids array<long>, x array<double>, y array<double>, low int, high int, at array<int>, n array<long>"


def pack_chunk(group: pd.DataFrame) -> pd.DataFrame:
    """One row of a chunk's samples in order, of which those from ``low`` to
    ``high`` are its own, and the filled places of its own samples' histograms."""
    rows = _ordered(group)
    x, y = rows["x"].to_numpy(), rows["y"].to_numpy()
    own = np.flatnonzero(rows["own"].to_numpy())
    low, high = (int(own[0]), int(own[-1]) + 1) if len(own) else (0, 0)
    starts = _change(x[low:high], y[low:high])
    lengths = np.diff(np.append(starts, high - low))
    cx, cy = x[low:high][starts], y[low:high][starts]
    hists = [_bin(np.abs(s[lag:] - s[:-lag])) for s in (cx, cy) for lag in (1, 2)]
    full = np.concatenate([*hists, np.bincount(np.minimum(lengths, _RUNS), minlength=_RUNS + 1)])
    at = np.flatnonzero(full)
    key = group.iloc[0]
    row = [key["source"], int(key["chunk"]), int(key["part"]), rows["id"].to_numpy(), x, y, low, high, at.astype(np.int32), full[at]]
    return pd.DataFrame([row], columns=["source", "chunk", "part", "ids", "x", "y", "low", "high", "at", "n"])


def source_model(source: str, diffs: np.ndarray, runs: np.ndarray) -> dict:
    """Per axis the autoregression's coefficient and the scale of a steady look
    (its innovations' scale over sqrt(1 - phi^2)), and the run length that is stuck."""
    out: dict = {"source": source}
    for axis, at in (("x", 0), ("y", 2)):
        one, two = (diffs[(at + i) * _BINS : (at + i + 1) * _BINS] for i in (0, 1))
        moved = one.copy()
        moved[0] = 0
        grain = _quantile(moved, 0.01)
        d1, d2 = (_spread(h) for h in (one, two))
        phi = min(max(d2 * d2 / (d1 * d1) - 1.0, 0.0), 0.9) if d1 > 0 else 0.0
        scale = max(d1 / math.sqrt(2.0 * (1.0 - phi)) if d1 > 0 else 0.0, 0.6 * grain, 1e-5)
        out[f"phi_{axis}"], out[f"scale_{axis}"] = phi, scale
    n = int(runs.sum())
    usual = int(np.searchsorted(np.cumsum(runs), 0.99 * n, side="left")) if n else 1
    normal = runs.copy()
    normal[STUCK_TIMES * max(usual, 1) + 1 :] = 0
    mode = int(np.argmax(normal)) if n else 1
    longer = (normal * np.maximum(np.arange(_RUNS + 1) - mode, 0)).sum()
    repeat = min(longer / max(longer + normal.sum(), 1), 0.95)
    chance = math.log(RUN_CHANCE / max(n, 1)) / math.log(repeat) if repeat > 0 else 0.0
    out["stuck"] = int(max(LEAST_STUCK, STUCK_TIMES * usual, math.ceil(mode + chance)))
    return out


def _levels(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Median of the up to LEVEL_SAMPLES samples that end before each position
    and of those that begin at it; NaN where there is none."""
    w = min(LEVEL_SAMPLES, len(s))
    inner = np.median(np.lib.stride_tricks.sliding_window_view(s, w), axis=1)
    nan = np.array([np.nan])
    before = np.concatenate((nan, [np.median(s[:i]) for i in range(1, w)], inner))
    after = np.concatenate((inner, [np.median(s[i:]) for i in range(len(s) - w + 1, len(s))], nan))
    return before, after


def _interpolated(s: np.ndarray, first: np.ndarray, k: int, before: np.ndarray, after: np.ndarray, phi: float) -> list[np.ndarray]:
    """The autoregression's values of the ``k`` samples from ``first`` on, from
    the levels and the nearest samples on both sides."""
    out = []
    for i in range(k):
        f, b = phi ** (i + 1), phi ** (k - i)
        forward, backward = before + f * (s[first - 1] - before), after + b * (s[first + k] - after)
        # a prediction's variance is in proportion to 1 - phi^(2 steps)
        vf, vb = 1.0 - f * f, 1.0 - b * b
        out.append((forward * vb + backward * vf) / (vf + vb))
    return out


def spike_positions(x: np.ndarray, y: np.ndarray, scale_x: float, scale_y: float, phi_x: float = 0.0, phi_y: float = 0.0) -> np.ndarray:
    """Boolean mask of samples in patches for which the outlier test wins.

    At a series' ends levels are taken of the one or two samples there are.
    """
    flagged = np.zeros(len(x), bool)
    while True:
        at = np.flatnonzero(~flagged)
        sx, sy = x[at] / scale_x, y[at] / scale_y
        found = np.zeros(len(at), bool)
        if len(at):
            (lx, rx), (ly, ry) = _levels(sx), _levels(sy)
        for k in range(1, LONGEST_SPIKE + 1):
            first = np.arange(1, len(at) - k)
            if not len(first):
                continue
            px, py, qx, qy = lx[first], ly[first], rx[first + k], ry[first + k]
            fits = zip(_interpolated(sx, first, k, px, qx, phi_x), _interpolated(sy, first, k, py, qy, phi_y), strict=True)
            outlier = np.min([np.hypot(sx[first + i] - fx, sy[first + i] - fy) for i, (fx, fy) in enumerate(fits)], axis=0)
            shift = np.hypot(px - qx, py - qy)
            mx, my = (px + qx) / 2, (py + qy) / 2
            near = np.maximum(np.hypot(sx[first - 1] - mx, sy[first - 1] - my), np.hypot(sx[first + k] - mx, sy[first + k] - my))
            wins = (outlier > SPIKE_SCALES) & (outlier > 2 * shift) & (near < NEAR_SCALES) & (outlier > 2 * near)
            for i in range(k):
                found[first[wins] + i] = True
        if not found.any():
            return flagged
        flagged[at[found]] = True


TESTED = ("source", "chunk", "part", "id", "defect", "piece", "edge", "length", "x", "y", "least")


def _test_chunk(row) -> pd.DataFrame:
    """Spikes of one packed chunk, and its runs that are long or touch its edges."""
    x, y, ids = np.asarray(row.x), np.asarray(row.y), np.asarray(row.ids)
    spike = spike_positions(x, y, row.scale_x, row.scale_y, row.phi_x, row.phi_y)
    own = np.zeros(len(x), bool)
    own[row.low : row.high] = True
    kept = ~spike & own
    x, y, kid = x[kept], y[kept], ids[kept]
    starts = _change(x, y)
    lengths = np.diff(np.append(starts, len(x)))
    piece = np.repeat(np.arange(len(starts)), lengths)
    edge = np.zeros(len(starts), np.int64)
    if len(starts):
        edge[0] |= 1
        edge[-1] |= 2
    wanted = (lengths >= row.stuck) | (edge > 0)
    take = wanted[piece] if len(starts) else np.zeros(0, bool)
    out = [
        pd.DataFrame({"id": ids[spike & own], "defect": "spike", "piece": -1, "edge": 0, "length": 0, "x": 0.0, "y": 0.0}),
        pd.DataFrame({"id": kid[take], "defect": "stuck", "piece": piece[take], "edge": edge[piece[take]], "length": lengths[piece[take]], "x": x[take], "y": y[take]}),
    ]
    both = pd.concat(out, ignore_index=True)
    both["source"], both["chunk"], both["part"], both["least"] = row.source, row.chunk, row.part, row.stuck
    return both[list(TESTED)]


def _test_chunks(batches):
    for batch in batches:
        for row in batch.itertuples(index=False):
            yield _test_chunk(row)


def _models(batches):
    for batch in batches:
        out = []
        for source, at, n in zip(batch["source"], batch["at"], batch["n"], strict=True):
            full = np.zeros(4 * _BINS + _RUNS + 1)
            full[np.asarray(at, dtype=np.int64)] = n
            out.append(source_model(source, full[: 4 * _BINS], full[4 * _BINS :]))
        yield pd.DataFrame(out, columns=["source", "phi_x", "phi_y", "scale_x", "scale_y", "stuck"])


def _with_parts(series: DataFrame, counts: DataFrame) -> DataFrame:
    """``series`` with ``part``: 0, or in chunks of more than CHUNK_ROWS rows
    the number of the part, by rank of (t, id), that a row lies in.

    Only rows of such chunks are ranked, by range partitions, so that no task
    holds a chunk; the first and last HALO_ROWS rows of a part are also in the
    part beside it, as a halo.
    """
    hot = counts.where(F.col("count") > CHUNK_ROWS).select("source", "chunk", "count")
    size = hot.agg(F.sum("count")).first()[0]
    plain = series.withColumn("part", F.lit(0))
    if not size:
        return plain.drop("home")
    keys = ["source", "chunk"]
    ranked = series.where("own").drop("home").dropDuplicates(["source", "chunk", "id"]).join(hot.select(keys), keys, "left_semi")
    parts = max(2, math.ceil(size / CHUNK_ROWS))
    ranked = stage(ranked.repartitionByRange(parts, "source", "chunk", "t", "id").withColumn("part", F.spark_partition_id()), "hot-chunks")
    each = Window.partitionBy(*keys, "part")
    ends = ranked.withColumn("_up", F.row_number().over(each.orderBy("t", "id"))).withColumn("_down", F.row_number().over(each.orderBy(F.desc("t"), F.desc("id"))))
    order = Window.partitionBy(*keys).orderBy("part")
    beside = ranked.select(*keys, "part").distinct().withColumn("_prior", F.lag("part").over(order)).withColumn("_next", F.lead("part").over(order))
    ends = ends.where((F.col("_up") <= HALO_ROWS) | (F.col("_down") <= HALO_ROWS)).join(beside, [*keys, "part"])
    halo = [
        ends.where((F.col(at) <= HALO_ROWS) & F.col(to).isNotNull()).select(*series.drop("own", "home").columns, F.lit(False).alias("own"), F.col(to).alias("part"))
        for at, to in (("_up", "_prior"), ("_down", "_next"))
    ]
    # neither in such a chunk nor the halo of one: a chunk beside it has its own samples only
    cold = plain.join(hot.select(keys), keys, "left_anti").join(hot.select("source", F.col("chunk").alias("home")), ["source", "home"], "left_anti")
    cold = cold.drop("home").select(*[c for c in series.columns if c != "home"], "part")
    series = series.drop("home")
    return cold.unionByName(ranked).unionByName(halo[0]).unionByName(halo[1])


def is_impossible(x: Column, y: Column, confidence: Column) -> Column:
    """Not finite, several screens away, or a stated confidence outside 0..1."""
    off = [F.isnan(c) | (F.abs(c - 0.5) > FAR_SCREENS) for c in (x, y)]
    text = F.trim(confidence)
    number = text.try_cast("double")
    bad = (text != "") & (number.isNull() | F.isnan(number) | ~number.between(0, 1))
    return F.coalesce(off[0], F.lit(False)) | F.coalesce(off[1], F.lit(False)) | F.coalesce(bad, F.lit(False))


def flag_readings(df: DataFrame, id_col: str, source_col: str, time_col: str, x_col: str, y_col: str, confidence_col: str) -> DataFrame:
    """(id, defect) rows: impossible, stuck or spike; at most one per id.

    Re-delivered ids count once. A row with a null id is left out; one with a
    null source, time or coordinate takes no part in the series and can only
    be impossible. Equal times are ordered by id. Other columns of ``df`` are
    ignored, whatever their names. A run is broken where a source is silent
    for a whole chunk.
    """
    rows = df.select(
        F.col(id_col).alias("id"),
        F.col(source_col).cast("string").alias("source"),
        # made by a generator, so that what is read from it does not make it again
        F.explode(F.array(F.col(time_col).cast("double"))).alias("t"),
        F.col(x_col).cast("double").alias("x"),
        F.col(y_col).cast("double").alias("y"),
        F.col(confidence_col).cast("string").alias("confidence"),
    ).where("id IS NOT NULL")
    x, y = F.col("x"), F.col("y")
    impossible = rows.where(is_impossible(x, y, F.col("confidence"))).select("id").distinct()
    inside = (F.abs(x - 0.5) <= FAR_SCREENS) & (F.abs(y - 0.5) <= FAR_SCREENS) & (F.abs("t") < 1e15)
    home = F.floor(F.col("t") / CHUNK_S)
    lower, upper = F.floor((F.col("t") - HALO_S) / CHUNK_S), F.floor((F.col("t") + HALO_S) / CHUNK_S)
    series = (
        rows.where(inside & F.col("source").isNotNull())
        .withColumn("home", home)
        .withColumn("chunk", F.explode(F.array_distinct(F.array(home, lower, upper))))
        .select("source", "home", "chunk", "id", "t", "x", "y", (F.col("chunk") == F.col("home")).alias("own"))
    )
    # rows a chunk, counted where they lie: no sample moves for it
    counts = stage(rows.where(inside & F.col("source").isNotNull()).groupBy("source", home.alias("chunk")).count(), "chunk-rows")
    packed = _with_parts(series, counts).groupBy("source", "chunk", "part").applyInPandas(lambda g: pack_chunk(g), PACKED)
    packed = stage(packed, "packed-chunks")
    merged = (
        packed.select("source", F.explode(F.arrays_zip("at", "n")).alias("h"))
        .groupBy("source", F.col("h.at").alias("at"))
        .agg(F.sum("h.n").alias("n"))
        .groupBy("source")
        .agg(F.collect_list("at").alias("at"), F.collect_list("n").alias("n"))
    )
    model = stage(merged.mapInPandas(_models, "source string, phi_x double, phi_y double, scale_x double, scale_y double, stuck int"), "source-models")
    tested = packed.drop("at", "n").where("low < high").join(model, "source").mapInPandas(
        _test_chunks,
        "source string, chunk long, part int, id long, defect string, piece long, edge long, length long, x double, y double, least int",
    )
    tested = stage(tested, "reading-tests")
    spikes = tested.where("defect = 'spike'").select("id", F.lit("spike").alias("defect"))
    pieces = tested.where("defect = 'stuck'")
    whole = pieces.where("edge = 0")
    long_edge = pieces.where("edge > 0").join(_edge_lengths(pieces), ["source", "chunk", "part", "piece"]).where("total >= least")
    stuck = whole.select("id").unionByName(long_edge.select("id")).withColumn("defect", F.lit("stuck"))
    rank = F.when(F.col("defect") == "impossible", 0).when(F.col("defect") == "stuck", 1).otherwise(2)
    flags = impossible.withColumn("defect", F.lit("impossible")).unionByName(stuck).unionByName(spikes)
    return flags.groupBy("id").agg(F.min_by("defect", rank).alias("defect")).withColumnRenamed("id", id_col)


def _edge_lengths(pieces: DataFrame) -> DataFrame:
    """Total length of the runs that edge pieces of adjacent chunks form.

    One row per edge piece takes part: at most two per chunk, so the window
    over a source sorts its chunks, not its samples.
    """
    heads = pieces.where("edge > 0").groupBy("source", "chunk", "part", "piece").agg(*[F.first(c).alias(c) for c in ("edge", "length", "x", "y")])
    order = Window.partitionBy("source").orderBy("chunk", "part", "piece")
    before = {c: F.lag(c).over(order) for c in ("chunk", "part", "edge", "x", "y")}
    joined = (
        ((before["chunk"] == F.col("chunk") - 1) | ((before["chunk"] == F.col("chunk")) & (before["part"] < F.col("part"))))
        & before["edge"].bitwiseAND(F.lit(2)).eqNullSafe(2)
        & (F.col("edge").bitwiseAND(F.lit(1)) == 1)
        & (before["x"] == F.col("x"))
        & (before["y"] == F.col("y"))
    )
    runs = heads.withColumn("new", F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1)).withColumn("run", F.sum("new").over(order))
    totals = F.sum("length").over(Window.partitionBy("source", "run"))
    return runs.select("source", "chunk", "part", "piece", totals.alias("total"))
