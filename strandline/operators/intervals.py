"""Problem 2: continuous periods of overlapping intervals and the gaps between.

Times are whole milliseconds. An entity's time line is cut into shards of 2^16
units; what is set within a shard is a compressed run bitmap: the sorted starts
and ends of its set runs. An interval sets bits in its first and its last shard
only; the whole shards between are bits of a bitmap one level up, whose unit is
a shard, and so on over four levels. So an interval of any length is at most
seven pieces. Each partition unites its bitmaps before anything is shuffled;
those of one shard are united again, and the set runs of all levels are read
off. Clear runs between them are the gaps.

No step sorts an entity as a whole. Runs are ordered within blocks of ``BLOCK``
units, and blocks of an entity meet through one row per block: how far earlier
blocks reach, and what comes before the next block's first period.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions.speech import canonical_speaker, utterance_speaker

#: A shard has 2^SHARD_BITS units of its level.
SHARD_BITS = 16
LEVELS = 4
BLOCK_BITS = 26
#: Intervals whose bitmaps a worker unites at once.
HELD = 500_000
LONGEST_WORD_MS = 4000


def interval_pieces(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, level, shard, run) of half-open intervals; a run is its start and
    end within the shard as ``start << 20 | end``."""
    row, out = np.arange(len(start)), []
    for level in range(LEVELS):
        first, last = start >> SHARD_BITS, (end - 1) >> SHARD_BITS
        one = first == last
        whole = np.int64(1) << SHARD_BITS
        low, high = start - (first << SHARD_BITS), end - (last << SHARD_BITS)
        out.append((row, level, first, low << 20 | np.where(one, high, whole)))
        out.append((row[~one], level, last[~one], high[~one]))
        more = last - first > 1
        row, start, end = row[more], first[more] + 1, last[more]
    parts = [(r, np.full(len(r), level), shard, run) for r, level, shard, run in out]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def united(owner: np.ndarray, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, run) of the union of each owner's runs, sorted; touching runs join."""
    at = np.sort(owner << 36 | runs)
    owner, start, end = at >> 36, at >> 20 & 0xFFFF, at & 0xFFFFF
    reach = np.maximum.accumulate(owner << 20 | end)
    fresh = np.flatnonzero(np.concatenate(([True], (owner[1:] << 20 | start[1:]) > reach[:-1]))) if len(at) else np.zeros(0, np.int64)
    return owner[fresh], start[fresh] << 20 | reach[np.append(fresh[1:], len(at)) - 1 if len(at) else fresh] & 0xFFFFF


def _lists(owner: np.ndarray, values: np.ndarray, n: int) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=n)))), pa.int32()), pa.array(values, pa.int64()))


def _bitmaps(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """(keys, level, shard, runs) of a partition's intervals, united as far as they are held together."""

    def unite(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        row, level, shard, run = interval_pieces(table["start"].to_numpy(), table["end"].to_numpy())
        pieces = table.select(keys).take(pa.array(row)).append_column("level", pa.array(level, pa.int32())).append_column("shard", pa.array(shard, pa.int64()))
        grouped = pieces.append_column("run", pa.array(run)).group_by([*keys, "level", "shard"]).aggregate([("run", "list")]).combine_chunks()
        lists = grouped["run_list"].combine_chunks()
        owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        owner, runs = united(owner, lists.flatten().to_numpy())
        out = grouped.select([*keys, "level", "shard"]).append_column("runs", _lists(owner, runs, len(lists)))
        yield from out.to_batches(max_chunksize=10_000)

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= HELD:
            yield from unite(held)
            held, n = [], 0
    if n:
        yield from unite(held)


def _set_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """(keys, start, end) of the set runs of each shard's bitmaps."""
    for batch in batches:
        pieces = batch.column("pieces")
        inner = pieces.flatten()
        per_list = np.diff(inner.offsets.to_numpy())
        owner = np.repeat(np.repeat(np.arange(len(pieces)), np.diff(pieces.offsets.to_numpy())), per_list)
        owner, runs = united(owner, inner.flatten().to_numpy())
        shift = batch.column("level").to_numpy().astype(np.int64)[owner] * SHARD_BITS
        base = batch.column("shard").to_numpy()[owner] << SHARD_BITS
        columns = [batch.column(k).take(pa.array(owner)) for k in keys]
        columns += [pa.array(base + (runs >> 20) << shift), pa.array(base + (runs & 0xFFFFF) << shift)]
        yield pa.RecordBatch.from_arrays(columns, [*keys, "start", "end"])


def periods_and_gaps(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """(keys, kind, start_ms, end_ms): maximal set runs (period) and the clear
    runs between two successive ones (gap) of half-open intervals [start, end).

    ``start`` and ``end`` are whole units (bigint), of any size. Rows that lack
    a bound or a key, or whose end is not after the start, are left out.
    Touching intervals join; repeated rows change nothing. An empty input gives
    no rows; columns of ``df`` that are not named are ignored.
    """
    renamed = [f"_k{i}" for i in range(len(keys))]
    rows = df.select(*[F.col(k).alias(n) for k, n in zip(keys, renamed, strict=True)], F.col(start).cast("long").alias("start"), F.col(end).cast("long").alias("end"))
    for n in renamed:
        rows = rows.where(F.col(n).isNotNull())
    rows = rows.where(F.col("end") > F.col("start"))
    typed = [rows.schema[n] for n in renamed]
    bitmap = T.StructType([*typed, T.StructField("level", T.IntegerType()), T.StructField("shard", T.LongType()), T.StructField("runs", T.ArrayType(T.LongType()))])
    partial = rows.mapInArrow(lambda batches: _bitmaps(batches, renamed), bitmap)
    shards = partial.groupBy(*renamed, "level", "shard").agg(F.collect_list("runs").alias("pieces"))
    times = [T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]
    runs = shards.mapInArrow(lambda batches: _set_runs(batches, renamed), T.StructType([*typed, *times])).withColumn("block", F.shiftright("start", BLOCK_BITS))

    inside = Window.partitionBy(*renamed, "block").orderBy("start", "end")
    by_block = Window.partitionBy(*renamed).orderBy("block")
    earlier = by_block.rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("reach", F.max("end").over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    carry = runs.groupBy(*renamed, "block").agg(F.max("end").alias("tail"))
    carry = carry.select(*renamed, "block", F.max("tail").over(earlier).alias("carry"), F.max("tail").over(Window.partitionBy(*renamed)).alias("final"))
    before = F.greatest("reach", "carry")
    begun = runs.join(carry, [*renamed, "block"]).withColumn("before", before).where("before IS NULL OR start > before")
    begun = begun.withColumn("next", F.lead("before").over(inside))
    # what ends the last period of a block stands before the first period of a later one
    heads = begun.groupBy(*renamed, "block").agg(F.min_by("before", "start").alias("head"))
    heads = heads.select(*renamed, "block", F.lead("head").over(by_block).alias("head"))
    periods = begun.join(heads, [*renamed, "block"])
    named = [F.col(n).alias(k) for k, n in zip(keys, renamed, strict=True)]
    kinds = F.array(
        F.struct(F.lit("period").alias("kind"), F.col("start").alias("start_ms"), F.coalesce("next", "head", "final").alias("end_ms")),
        F.struct(F.lit("gap").alias("kind"), F.col("before").alias("start_ms"), F.col("start").alias("end_ms")),
    )
    return periods.select(*named, F.explode(kinds).alias("x")).select(*keys, "x.*").where("start_ms IS NOT NULL")


def ms(seconds: Column) -> Column:
    """Whole milliseconds of seconds; NULL if missing, NaN or infinite."""
    return F.when(F.abs(seconds) < 9e15, F.round(seconds * 1000).cast("long"))


def speech_periods(utterances: DataFrame) -> DataFrame:
    """Speech periods and silences per interaction and speaker (p1, p2, p3).

    An utterance's interval counts for its speaker, a word's for the word's
    own; words longer than ``LONGEST_WORD_MS`` are left out, as are intervals
    of a speaker that no label names.
    """
    talk = utterances.select(
        "interaction_id",
        utterance_speaker(F.col("speaker_role"), F.col("transcript"), F.col("speaker_file_id")).alias("speaker"),
        ms(F.col("start_s")).alias("start"),
        ms(F.col("end_s")).alias("end"),
    )
    words = utterances.select("interaction_id", F.explode("words").alias("w")).select(
        "interaction_id",
        canonical_speaker(F.col("w.speaker")).alias("speaker"),
        ms(F.col("w.start_s")).alias("start"),
        ms(F.col("w.end_s")).alias("end"),
    )
    words = words.where(F.col("end") - F.col("start") <= LONGEST_WORD_MS)
    return periods_and_gaps(talk.unionByName(words), ["interaction_id", "speaker"], "start", "end")


_LABEL_SQL = """CASE
  WHEN regexp_matches(t, '^(speaker|spk|participant|part|p)[\\s_.-]*0*[1-3]$') THEN 'p' || right(t, 1)
  WHEN regexp_matches(t, '^0*[1-3]$') THEN 'p' || right(t, 1)
  WHEN regexp_matches(t, '^(speaker )?[abc]$') THEN 'p' || translate(right(t, 1), 'abc', '123') END"""


def label_sql(column: str) -> str:
    blanks = r"[\s\x{00a0}]+"
    return _LABEL_SQL.replace("(t,", f"(trim(regexp_replace(lower({column}), '{blanks}', ' ', 'g')),")


_INLINE_SQL = r"""'^(?:\s|>|[\[({<]?\d[\d:.,]*\s*s?[\])}>]?[\s]|-->)*(?:\[\s*(?:(?:speaker|spk|participant|part|p)[\s_.-]*0*)?([1-3abc])\s*\]|(?:speaker|spk|participant|part|p)[\s_.-]*0*([1-3])\s*(?::|-\s)|([abc])\s*:)'"""

ORACLE_SQL = f"""
WITH u AS (SELECT DISTINCT ON (utterance_id) * FROM utterances),
talk AS (
  SELECT interaction_id,
    coalesce({label_sql("speaker_role")},
      'p' || nullif(translate(concat(
        regexp_extract(lower(transcript), {_INLINE_SQL}, 1), regexp_extract(lower(transcript), {_INLINE_SQL}, 2),
        regexp_extract(lower(transcript), {_INLINE_SQL}, 3)), 'abc', '123'), ''),
      {label_sql("regexp_extract(speaker_file_id, '_([^_]+)$', 1)")}) AS speaker,
    start_s, end_s, 1e9 AS longest FROM u),
w AS (SELECT interaction_id, unnest(words) AS w FROM u),
words AS (
  SELECT interaction_id, {label_sql("w.speaker")} AS speaker, w.start_s, w.end_s, {LONGEST_WORD_MS} AS longest FROM w),
iv AS (
  SELECT interaction_id, speaker, CAST(round(start_s * 1000) AS BIGINT) AS s, CAST(round(end_s * 1000) AS BIGINT) AS e, longest
  FROM (SELECT * FROM talk UNION ALL SELECT * FROM words)
  WHERE start_s IS NOT NULL AND end_s IS NOT NULL AND NOT isnan(start_s) AND NOT isnan(end_s)),
ok AS (SELECT * FROM iv WHERE e > s AND e - s <= longest AND speaker IS NOT NULL AND interaction_id IS NOT NULL),
m AS (
  SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY interaction_id, speaker ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    THEN 0 ELSE 1 END AS fresh FROM ok),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY interaction_id, speaker ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS no FROM m),
p AS (SELECT interaction_id, speaker, no, min(s) AS s, max(e) AS e FROM g GROUP BY ALL),
q AS (SELECT *, lag(e) OVER (PARTITION BY interaction_id, speaker ORDER BY s) AS b FROM p)
SELECT interaction_id, speaker, 'period' AS kind, s AS start_ms, e AS end_ms FROM q
UNION ALL SELECT interaction_id, speaker, 'gap', b, s FROM q WHERE b IS NOT NULL
"""
