"""Spark data sources for files that no built-in reader splits: tagged articles, NumPy arrays, records with their length in front.

``register(spark)``, then ``spark.read.format("tagged_articles").load(path)``. A large file is several partitions. Tasks open files themselves
by pyarrow's file systems, so paths are local ones or URIs that these know.
"""

from __future__ import annotations

import ast
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a partition, unless the option ``partitionBytes`` says otherwise, and of a read.
PARTITION, STEP = 32 << 20, 1 << 20
ROWS = 1000


@dataclass
class Span(InputPartition):
    """Bytes of a file, or rows of an array."""

    path: str
    low: int
    high: int
    first: int = 0


def opened(path: str):
    system, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system, name


def files(path: str) -> list[tuple[str, int]]:
    """Files at a path, below a folder too, by name, with their sizes; hidden ones are left out."""
    system, name = opened(path)
    prefix = path[: len(path) - len(name)] if path.endswith(name) else "file://" if path.startswith("file:") else ""
    info = system.get_file_info(name)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else [x for x in system.get_file_info(fs.FileSelector(name, recursive=True)) if x.is_file]
    return sorted((prefix + x.path, x.size) for x in found if not x.base_name.startswith((".", "_")))


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.bytes = options["path"], max(1, int(options.get("partitionBytes", PARTITION)))

    def partitions(self) -> list[Span]:
        return [Span(path, low, min(size, low + self.bytes)) for path, size in files(self.path) for low in range(0, size, self.bytes)] or [Span("", 0, 0)]


class TaggedReader(_Reader):
    """Articles ``<DOC> ... </DOC>``: a partition has those that begin in its bytes, however far they go."""

    BEGIN, END = b"<DOC>", b"</DOC>"

    def read(self, span: Span) -> Iterator[tuple]:
        if not span.path:
            return
        system, name = opened(span.path)
        with system.open_input_file(name) as f:
            f.seek(span.low)
            held, at, base = b"", 0, span.low  # base: the place of held in the file
            while True:
                begin = held.find(self.BEGIN, at)
                if begin >= 0 and base + begin >= span.high:
                    return
                end = held.find(self.END, begin) if begin >= 0 else -1
                if end >= 0:
                    raw = held[begin + len(self.BEGIN) : end].decode("utf-8", "replace")
                    yield span.path, base + begin, raw.strip()
                    at = end + len(self.END)
                    continue
                # what can't begin an article any more is dropped
                keep = begin if begin >= 0 else max(at, len(held) - len(self.BEGIN) + 1)
                if begin < 0 and base + keep >= span.high:
                    return
                held, base, at = held[keep:], base + keep, 0
                more = f.read(max(STEP, len(held)))
                if not more:
                    if begin >= 0:
                        raise ValueError(f"the article at byte {base} of {span.path} is cut")
                    return
                held += more


class TaggedArticles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tagged_articles"

    def schema(self) -> str:
        return "file string, offset long, raw string"

    def reader(self, schema) -> DataSourceReader:
        return TaggedReader(self.options)


class ArrayReader(_Reader):
    """Rows of ``.npy`` files of one or two dimensions, by row ranges: the header says where a row is."""

    @staticmethod
    def header(f) -> tuple[np.dtype, tuple[int, int], bool, int]:
        start = f.read(8)
        if start[:6] != b"\x93NUMPY":
            raise ValueError("no array file")
        size, = struct.unpack("<H", f.read(2)) if start[6] == 1 else struct.unpack("<I", f.read(4))
        found = ast.literal_eval(f.read(size).decode("latin-1"))
        dtype = np.dtype(found["descr"])
        if dtype.hasobject or not np.issubdtype(dtype, np.number):
            raise ValueError("arrays of numbers only")
        shape = found["shape"]
        if len(shape) not in (1, 2):
            raise ValueError("arrays of one or two dimensions only")
        return dtype, (shape[0], shape[1] if len(shape) == 2 else 1), found["fortran_order"] and len(shape) == 2, f.tell()

    def partitions(self) -> list[Span]:
        out = []
        for path, _ in files(self.path):
            system, name = opened(path)
            with system.open_input_file(name) as f:
                dtype, (n, width), _, _ = self.header(f)
            step = max(1, self.bytes // max(1, width * dtype.itemsize))
            out += [Span(path, low, min(n, low + step)) for low in range(0, n, step)]
        return out or [Span("", 0, 0)]

    def read(self, span: Span) -> Iterator[pa.RecordBatch]:
        if not span.path:
            return
        system, name = opened(span.path)
        with system.open_input_file(name) as f:
            dtype, (n, width), by_column, start = self.header(f)
            for low in range(span.low, span.high, ROWS):
                high = min(span.high, low + ROWS)
                if by_column:
                    part = np.stack([self._numbers(f, start + (c * n + low) * dtype.itemsize, high - low, dtype) for c in range(width)], axis=1)
                else:
                    part = self._numbers(f, start + low * width * dtype.itemsize, (high - low) * width, dtype).reshape(high - low, width)
                ends = pa.array(np.arange(0, part.size + 1, width, dtype=np.int32)) if width else pa.array(np.zeros(high - low + 1, np.int32))
                row = pa.ListArray.from_arrays(ends, pa.array(part.astype(float).ravel()))
                yield pa.RecordBatch.from_arrays([pa.array([span.path] * (high - low)), pa.array(np.arange(low, high)), row], ["file", "i", "row"])

    @staticmethod
    def _numbers(f, at: int, count: int, dtype: np.dtype) -> np.ndarray:
        f.seek(at)
        data = f.read(count * dtype.itemsize)
        if len(data) != count * dtype.itemsize:
            raise ValueError("the array file is cut")
        return np.frombuffer(data, dtype)


class Arrays(DataSource):
    @classmethod
    def name(cls) -> str:
        return "numpy_arrays"

    def schema(self) -> str:
        return "file string, i long, row array<double>"

    def reader(self, schema) -> DataSourceReader:
        return ArrayReader(self.options)


class RecordReader(_Reader):
    """Records with their length in eight bytes, little-endian, in front. Only lengths are read to plan; a partition has whole records."""

    def partitions(self) -> list[Span]:
        out = []
        for path, size in files(self.path):
            system, name = opened(path)
            with system.open_input_file(name) as f:
                low = at = i = first = 0
                while at < size:
                    f.seek(at)
                    head = f.read(8)
                    length = struct.unpack("<q", head)[0] if len(head) == 8 else -1
                    if length < 0 or at + 8 + length > size:
                        raise ValueError(f"record at byte {at} of {path} is cut")
                    at, i = at + 8 + length, i + 1
                    if at - low >= self.bytes or at == size:
                        out.append(Span(path, low, at, first))
                        low, first = at, i
        return out or [Span("", 0, 0)]

    def read(self, span: Span) -> Iterator[tuple]:
        if not span.path:
            return
        system, name = opened(span.path)
        with system.open_input_file(name) as f:
            f.seek(span.low)
            at, i = span.low, span.first
            while at < span.high:
                size = struct.unpack("<q", f.read(8))[0]
                yield span.path, i, f.read(size)
                at, i = at + 8 + size, i + 1


class Records(DataSource):
    @classmethod
    def name(cls) -> str:
        return "length_prefixed"

    def schema(self) -> str:
        return "file string, i long, record binary"

    def reader(self, schema) -> DataSourceReader:
        return RecordReader(self.options)


def register(spark: SparkSession) -> None:
    for source in (TaggedArticles, Arrays, Records):
        spark.dataSource.register(source)
