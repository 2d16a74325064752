"""Data sources for binary sensor files: NumPy arrays and MessagePack streams.

Register with ``spark.dataSource.register(NumpySource)`` and read by
``spark.read.format("npy").load(path)``. Paths are local or URIs of any file
system Arrow knows (``file:``, ``hdfs:``, ``s3:``, ...). A packet file is one
partition, an array one for every ``SPAN`` values.
"""

from __future__ import annotations

import glob
import io
import os
import struct
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Values of an array that one partition reads, and that it holds at once.
SPAN, HELD = 1 << 24, 1 << 18


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """File system of a path or URI, and the path within it."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri("file://" + path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path)
    return fs.LocalFileSystem(), os.path.abspath(path)


def open_any(path: str) -> BinaryIO:
    """Readable, seekable stream of a file wherever it lies."""
    system, place = file_system(path)
    return system.open_input_file(place)


def _files(path: str, ending: str) -> list[str]:
    """Files below a folder, of a pattern of local names, or the file itself."""
    if "*" in path or "?" in path:
        return sorted(glob.glob(path.removeprefix("file://")))
    system, place = file_system(path)
    if system.get_file_info(place).type != fs.FileType.Directory:
        return [path]
    found = system.get_file_info(fs.FileSelector(place, recursive=True))
    root = path.rstrip("/")
    return sorted(root + f.path[len(place.rstrip("/")) :] for f in found if f.is_file and f.path.endswith(ending))


class _Span(InputPartition):
    def __init__(self, path: str, low: int = 0, high: int = 0):
        self.path, self.low, self.high = path, low, high


class _Reader(DataSourceReader):
    ending = ""

    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [_Span(p) for p in _files(self.path, self.ending)]


def array_header(stream: BinaryIO) -> tuple[int, np.dtype, int]:
    """(values, type, offset of the first) of an ``.npy`` stream."""
    version = np.lib.format.read_magic(stream)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, fortran, kind = read(stream)
    if kind.hasobject or (fortran and sum(n > 1 for n in shape) > 1):
        raise ValueError("only plain arrays in row order are read")
    return int(np.prod(shape, dtype=np.int64)), kind, stream.tell()


class NumpyReader(_Reader):
    ending = ".npy"

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path in _files(self.path, self.ending):
            with open_any(path) as stream:
                n = array_header(stream)[0]
            out += [_Span(path, low, min(low + SPAN, n)) for low in range(0, n, SPAN)]
        return out

    def read(self, partition: _Span) -> Iterator[tuple]:
        with open_any(partition.path) as stream:
            _, kind, offset = array_header(stream)
            stream.seek(offset + partition.low * kind.itemsize)
            for low in range(partition.low, partition.high, HELD):
                n = min(HELD, partition.high - low)
                values = np.frombuffer(stream.read(n * kind.itemsize), dtype=kind)
                if len(values) < n:
                    raise ValueError(f"{partition.path} ends before its values do")
                for i, v in enumerate(values.astype(float).tolist(), low):
                    yield partition.path, i, v


class NumpySource(DataSource):
    """(path, pos, value) of one-dimensional ``.npy`` arrays."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "path string, pos bigint, value double"

    def reader(self, schema) -> DataSourceReader:
        return NumpyReader(self.options["path"])


def unpack(stream: io.BufferedIOBase) -> object:
    """Next MessagePack value of a stream; EOFError at its end."""
    first = stream.read(1)
    if not first:
        raise EOFError
    b = first[0]

    def number(form: str) -> int | float:
        return struct.unpack(">" + form, stream.read(struct.calcsize(form)))[0]

    def several(n: int) -> list:
        return [unpack(stream) for _ in range(n)]

    def table(n: int) -> dict:
        return {unpack(stream): unpack(stream) for _ in range(n)}

    if b < 0x80:
        return b
    if b < 0x90:
        return table(b & 15)
    if b < 0xA0:
        return several(b & 15)
    if b < 0xC0:
        return stream.read(b & 31).decode("utf-8", "replace")
    if b >= 0xE0:
        return b - 256
    if b in (0xC0, 0xC2, 0xC3):
        return {0xC0: None, 0xC2: False, 0xC3: True}[b]
    sizes = {0xC4: "B", 0xC5: "H", 0xC6: "I", 0xD9: "B", 0xDA: "H", 0xDB: "I", 0xDC: "H", 0xDD: "I", 0xDE: "H", 0xDF: "I"}
    if b in sizes:
        n = number(sizes[b])
        if b <= 0xC6:
            return stream.read(n)
        if b <= 0xDB:
            return stream.read(n).decode("utf-8", "replace")
        return several(n) if b <= 0xDD else table(n)
    numbers = {0xCA: "f", 0xCB: "d", 0xCC: "B", 0xCD: "H", 0xCE: "I", 0xCF: "Q", 0xD0: "b", 0xD1: "h", 0xD2: "i", 0xD3: "q"}
    if b in numbers:
        return number(numbers[b])
    if 0xD4 <= b <= 0xD8 or 0xC7 <= b <= 0xC9:
        n = number({0xC7: "B", 0xC8: "H", 0xC9: "I"}[b]) if b <= 0xC9 else 1 << (b - 0xD4)
        return stream.read(n + 1)[1:]
    raise ValueError(f"no MessagePack type {b:#x}")


class PacketReader(_Reader):
    ending = ".pldata"

    def read(self, partition: _Span) -> Iterator[tuple]:
        with open_any(partition.path) as raw:
            # buffered: values are read a few bytes at a time
            stream = io.BufferedReader(raw, 1 << 20)
            at = 0
            while True:
                try:
                    topic, payload = unpack(stream)
                except EOFError:
                    return
                body = unpack(io.BytesIO(payload)) if isinstance(payload, bytes) else payload
                place = body.get("norm_pos") or [None, None]
                number = lambda v: None if v is None else float(v)
                yield partition.path, at, topic, number(body.get("timestamp")), number(place[0]), number(place[1]), number(body.get("confidence"))
                at += 1


class PacketSource(DataSource):
    """(path, pos, topic, timestamp, x, y, confidence) of ``[topic, payload]`` packet streams."""

    @classmethod
    def name(cls) -> str:
        return "pldata"

    def schema(self) -> str:
        return "path string, pos bigint, topic string, timestamp double, x double, y double, confidence double"

    def reader(self, schema) -> DataSourceReader:
        return PacketReader(self.options["path"])


def parallel_arrays(a, b, on: str = "pos", strict: bool = False):
    """Two arrays read by position, cut to the shorter one; with ``strict``
    arrays of different length are an error."""
    if strict and (sizes := (a.count(), b.count()))[0] != sizes[1]:
        raise ValueError(f"arrays of {sizes[0]} and {sizes[1]} values")
    return a.join(b, on)
