"""Durations of media files from their headers, without decoding them."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.sources.binary import open_any


def _wave_seconds(stream: BinaryIO) -> float | None:
    rate = None
    stream.seek(12)
    while len(head := stream.read(8)) == 8:
        name, size = head[:4], struct.unpack("<I", head[4:])[0]
        if name == b"fmt ":
            rate = struct.unpack("<I", stream.read(size)[8:12])[0]
            stream.seek(size % 2, 1)
        elif name == b"data":
            return size / rate if rate else None
        else:
            stream.seek(size + size % 2, 1)
    return None


def _boxes(stream: BinaryIO, end: int) -> Iterator[tuple[bytes, int]]:
    """(name, end) of the boxes of an ISO media file from here to ``end``; the
    stream stands at a box's content when it is given."""
    while stream.tell() + 8 <= end:
        begin = stream.tell()
        size, name = struct.unpack(">I4s", stream.read(8))
        if size == 1:
            size = struct.unpack(">Q", stream.read(8))[0]
        stop = end if size == 0 else begin + size
        if stop <= begin or stop > end:
            return
        yield name, stop
        stream.seek(stop)


def _movie_seconds(stream: BinaryIO, end: int) -> float | None:
    for name, stop in _boxes(stream, end):
        if name == b"moov":
            return _movie_seconds(stream, stop)
        if name == b"mvhd":
            long = stream.read(4)[0] == 1
            stream.seek(16 if long else 8, 1)
            scale, length = struct.unpack(">IQ" if long else ">II", stream.read(12 if long else 8))
            return length / scale if scale else None
    return None


def header_seconds(stream: BinaryIO) -> float | None:
    """Seconds that the header of a WAV or ISO media file (mp4, mov, m4a)
    states; None for other files and broken headers."""
    try:
        end = stream.seek(0, 2)
        stream.seek(0)
        head = stream.read(12)
        stream.seek(0)
        if head[:4] == b"RIFF" and head[8:] == b"WAVE":
            return _wave_seconds(stream)
        return _movie_seconds(stream, end) if head[4:8] in (b"ftyp", b"moov", b"free", b"mdat", b"wide") else None
    except (struct.error, IndexError):
        return None


def media_durations(df: DataFrame, path: str, out: str = "duration_seconds", known: Column | None = None, opener: Callable[[str], BinaryIO] = open_any) -> DataFrame:
    """Add ``out``: the ``known`` duration where it is one, else the header's.

    Only headers are read, where a duration is not known, one file a row in
    Arrow batches. ``opener`` opens a path on the workers; a file that cannot
    be opened has no duration.
    """

    @F.pandas_udf("double")
    def probe(paths: pd.Series) -> pd.Series:
        def one(p: str | None) -> float | None:
            try:
                with opener(p) as stream:
                    return header_seconds(stream)
            except OSError:
                return None

        return paths.map(lambda p: one(p) if isinstance(p, str) else None).astype("float64")

    known = F.lit(None).cast("double") if known is None else F.when((known > 0) & (known < float("inf")), known)
    return df.withColumn(out, F.coalesce(known, F.nanvl(probe(F.when(known.isNull(), F.col(path))), F.lit(None))))
