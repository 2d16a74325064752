"""Problem 3: percentiles of very large columns from mergeable sketches.

A sketch is a hierarchy of compactors. Level ``h`` holds values of weight
``2**h``; a level over its capacity is sorted and every second value, from a
random start, moves up. Sketches merge level by level, so those of partitions,
days or files combine to that of all rows. Each compaction at level ``h``
shifts any rank by at most ``2**h``, up or down by a fair coin; their squares
are summed with the sketch, and Hoeffding's inequality turns the sum into the
stated bound on the rank error.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.session import stage

#: Capacity of the top level; lower levels shrink by SHRINK to LEAST.
CAPACITY = 1024
SHRINK = 2.0 / 3.0
LEAST = 16
#: Probability that the stated rank error is exceeded at one percentile.
DELTA = 0.01
#: Sketches of one group that meet in one row at most (about): more are merged in rounds.
FAN = 64
#: Sketches that a worker holds before it hands them on.
HELD_GROUPS = 4_096
#: Columns of a sketch: number of values, sum of squared shifts, levels.
SKETCH = ("sketch_n", "sketch_squares", "sketch_levels")
PERCENTILES = (0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


class Compactors:
    """One sketch: levels of values, number of values, sum of squared shifts."""

    def __init__(self, seed: int, capacity: int = CAPACITY):
        self.levels: list[np.ndarray] = [np.zeros(0)]
        self.n, self.squares, self.capacity = 0, 0.0, capacity
        self.seed, self.coin = seed, None

    def flip(self) -> int:
        if self.coin is None:
            self.coin = np.random.default_rng(self.seed)
        return int(self.coin.integers(2))

    def room(self, level: int) -> int:
        return max(LEAST, math.ceil(self.capacity * SHRINK ** (len(self.levels) - 1 - level)))

    def add(self, values: np.ndarray) -> None:
        self.levels[0] = np.concatenate([self.levels[0], values])
        self.n += len(values)
        self.compact()

    def merge(self, levels: list[np.ndarray], n: int, squares: float) -> None:
        while len(self.levels) < len(levels):
            self.levels.append(np.zeros(0))
        for h, values in enumerate(levels):
            self.levels[h] = np.concatenate([self.levels[h], values])
        self.n += n
        self.squares += squares
        self.compact()

    def compact(self) -> None:
        h = 0
        while h < len(self.levels):
            values = self.levels[h]
            if len(values) > self.room(h):
                if h + 1 == len(self.levels):
                    self.levels.append(np.zeros(0))
                values = np.sort(values)
                keep, rest = (values[:1], values[1:]) if len(values) % 2 else (values[:0], values)
                self.levels[h + 1] = np.concatenate([self.levels[h + 1], rest[self.flip() :: 2]])
                self.levels[h] = keep
                self.squares += 4.0**h
            h += 1

    def quantiles(self, at: list[float]) -> list[float | None]:
        """Values of rank ceil(q n) in the weighted sample."""
        if not self.n:
            return [None] * len(at)
        values = np.concatenate(self.levels)
        weights = np.concatenate([np.full(len(v), 2.0**h) for h, v in enumerate(self.levels)])
        order = np.argsort(values, kind="stable")
        ranks = np.cumsum(weights[order])
        picks = np.searchsorted(ranks, np.ceil(np.asarray(at) * ranks[-1] - 1e-9), side="left")
        return [float(values[order[min(i, len(order) - 1)]]) for i in picks]

    def rank_error(self) -> float:
        """Bound, as a share of n, that holds with probability 1 - DELTA; 0 while nothing was compacted."""
        return math.sqrt(2.0 * math.log(2.0 / DELTA) * self.squares) / self.n if self.n else 0.0

    def row(self) -> dict:
        return dict(zip(SKETCH, (self.n, self.squares, [v.tolist() for v in self.levels]), strict=True))


def _sketch_fields() -> list[T.StructField]:
    return [
        T.StructField(SKETCH[0], T.LongType()),
        T.StructField(SKETCH[1], T.DoubleType()),
        T.StructField(SKETCH[2], T.ArrayType(T.ArrayType(T.DoubleType()))),
    ]


def _seed(*parts: object) -> int:
    return zlib.crc32("|".join(map(str, parts)).encode())


def sketch(df: DataFrame, keys: list[str], value: str, capacity: int = CAPACITY) -> DataFrame:
    """One sketch per group: ``keys`` and the columns ``SKETCH``.

    Each partition builds sketches of what it holds before anything is
    shuffled; they merge in rounds of bounded fan-in, so a group that holds a
    third of all rows is no task's alone. Values that are null, NaN or infinite are left
    out; null keys form a group. An empty input gives no sketch.
    """
    fields = [T.StructField(k, df.schema[k].dataType) for k in keys]
    rows = df.select(*keys, F.col(value).cast("double").alias("_value")).where(F.abs("_value") < float("inf"))

    def build(batches):
        from pyspark import TaskContext

        held: dict[tuple, Compactors] = {}
        task = TaskContext.get()
        part = task.partitionId() if task else 0
        turn = 0

        def hand_on() -> pd.DataFrame:
            out = [dict(zip(keys, key, strict=True)) | s.row() | {"_part": part, "_turn": turn} for key, s in held.items()]
            held.clear()
            return pd.DataFrame(out, columns=[*keys, *SKETCH, "_part", "_turn"]).astype({k: "object" for k in keys})

        for batch in batches:
            values = batch["_value"].to_numpy(dtype=float)
            for key, rows in batch.groupby(keys, dropna=False, sort=False).indices.items():
                key = tuple(None if pd.isna(k) else k for k in (key if isinstance(key, tuple) else (key,)))
                if key not in held:
                    held[key] = Compactors(_seed(part, turn, *key), capacity)
                held[key].add(values[rows])
            if len(held) > HELD_GROUPS:
                yield hand_on()
                turn += 1
        yield hand_on()

    places = [T.StructField("_part", T.LongType()), T.StructField("_turn", T.LongType())]
    partial = rows.mapInPandas(build, T.StructType([*fields, *_sketch_fields(), *places]))
    return _merge_in_rounds(stage(partial, "sketches"), keys, ["_part", "_turn"], capacity)


def merge(sketches: DataFrame, keys: list[str], capacity: int = CAPACITY) -> DataFrame:
    """Combine the sketches of each group, level by level."""
    others = [c for c in sketches.columns if c not in keys and c not in SKETCH]
    return _merge_in_rounds(stage(sketches, "sketches"), keys, others, capacity)


def _merge_in_rounds(sketches: DataFrame, keys: list[str], others: list[str], capacity: int) -> DataFrame:
    """Merge until each group has one sketch; in a round with more than ``FAN``
    sketches of a group these are spread by a hash of ``others``."""
    while True:
        most = sketches.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
        if most <= FAN:
            return _merge_groups(sketches, keys, capacity)
        bucket = F.pmod(F.xxhash64(*others, "sketch_n", "sketch_squares"), F.lit(math.ceil(most / FAN)))
        sketches = stage(_merge_groups(sketches.withColumn("_bucket", bucket), [*keys, "_bucket"], capacity), "sketches")
        others = ["_bucket"]


def _merge_groups(sketches: DataFrame, keys: list[str], capacity: int) -> DataFrame:
    fields = [sketches.schema[k] for k in keys]
    schema = T.StructType([*fields, *_sketch_fields()])
    gathered = sketches.groupBy(*keys).agg(F.collect_list(F.struct(*SKETCH)).alias("_parts"))

    def join(batches):
        for batch in batches:
            out = []
            for *key, parts in batch[[*keys, "_parts"]].itertuples(index=False):
                total = Compactors(_seed("merge", *key), capacity)
                for part in parts:
                    total.merge([np.asarray(v, dtype=float) for v in part[SKETCH[2]]], int(part[SKETCH[0]]), float(part[SKETCH[1]]))
                out.append(dict(zip(keys, [None if pd.isna(k) else k for k in key], strict=True)) | total.row())
            yield pd.DataFrame(out, columns=schema.names).astype({k: "object" for k in keys})

    return gathered.mapInPandas(join, schema)


def quantiles(sketches: DataFrame, keys: list[str], at: tuple[float, ...] = PERCENTILES) -> DataFrame:
    """``keys, n, p05 ..., rank_error`` of merged sketches."""
    names = [f"p{round(q * 100):02d}" for q in at]
    if clash := {"n", "rank_error", *names} & set(keys):
        raise ValueError(f"keys {sorted(clash)} are names of results")
    fields = [sketches.schema[k] for k in keys]
    schema = T.StructType(
        [*fields, T.StructField("n", T.LongType()), *[T.StructField(x, T.DoubleType()) for x in names], T.StructField("rank_error", T.DoubleType())]
    )

    def read(batches):
        for batch in batches:
            out = []
            for _, row in batch.iterrows():
                s = Compactors(0)
                s.levels = [np.asarray(v, dtype=float) for v in row[SKETCH[2]]]
                s.n, s.squares = int(row[SKETCH[0]]), float(row[SKETCH[1]])
                out.append({k: row[k] for k in keys} | {"n": s.n} | dict(zip(names, s.quantiles(list(at)), strict=True)) | {"rank_error": s.rank_error()})
            yield pd.DataFrame(out, columns=[f.name for f in schema]).astype({k: "object" for k in keys})

    return sketches.mapInPandas(read, schema)


def usable_durations(records: DataFrame) -> DataFrame:
    """Each record once, with a duration that is a finite number of seconds >= 0."""
    rows = records.select("record_id", "dataset", "utt_count", "duration_seconds", F.to_date("measured_at").alias("day"))
    return rows.where((F.col("duration_seconds") >= 0) & (F.col("duration_seconds") < float("inf"))).dropDuplicates(["record_id"])
