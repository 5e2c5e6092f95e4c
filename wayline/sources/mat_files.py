"""MATLAB files of level 5 as a data source of Spark: ``spark.read.format("matlab5")``.

A file is a row of variables, each an element of its own, mostly compressed.
Planning reads the elements' tags and the beginnings that hold their names, so a
partition is one variable of one file, and variables that are not asked for are
not read. Rows have one number each: ``path, name, k, row, col, value``, ``k`` counting
down the columns from 0; further dimensions count as columns. A part of a struct
or cell has a name such as ``trial.pos.xy`` or ``cells(3)``, counted from 1. Text is
given as its code points, sparse arrays and objects not at all, of complex numbers the
real part.

Options: ``glob`` (of file names below the path), ``variables`` (top names, comma
separated; all by default).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from fnmatch import fnmatch

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from wayline.sources.record_files import file_system

# Fixed values of the format: data types, and classes of arrays.
TYPES = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8", 16: "u1", 17: "u2", 18: "u4"}
MATRIX, COMPRESSED = 14, 15
CELL, STRUCT, OBJECT, TEXT, SPARSE = 1, 2, 3, 4, 5
HEADER = 128

SCHEMA = "path string, name string, k long, row long, col long, value double"
BATCH = 1 << 16


def byte_order(header: bytes) -> str | None:
    """``<`` or ``>``; None for a file of another kind."""
    return {b"IM": "<", b"MI": ">"}.get(header[126:128])


def _tag(data: bytes, at: int, order: str) -> tuple[int, int, int, int]:
    """Type, size, place and end (with padding) of the element at a place."""
    first, size = struct.unpack_from(order + "II", data, at)
    if first >> 16:  # a small one keeps its data in the tag
        return first & 0xFFFF, first >> 16, at + 4, at + 8
    padded = size if first == COMPRESSED else -(-size // 8) * 8
    return first, size, at + 8, at + 8 + padded


def _numbers(data: bytes, at: int, order: str) -> tuple[np.ndarray, int]:
    kind, size, start, end = _tag(data, at, order)
    dtype = np.dtype(order + TYPES[kind])
    return np.frombuffer(data, dtype, size // dtype.itemsize, start), end


def _head(data: bytes, order: str, at: int) -> tuple[int, tuple[int, ...], str, int]:
    """Class, dimensions and name of the array whose content is at a place, and where its parts begin."""
    flags, at = _numbers(data, at, order)
    dims, at = _numbers(data, at, order)
    name, at = _numbers(data, at, order)
    return int(flags[0]) & 0xFF, tuple(int(d) for d in dims), name.tobytes().decode("latin-1"), at


def arrays(data: bytes, order: str, at: int, prefix: str | None = None) -> Iterator[tuple[str, tuple[int, ...], np.ndarray]]:
    """``name, dimensions, values`` of the numeric arrays in the matrix element at a place."""
    kind, size, start, _ = _tag(data, at, order)
    if kind != MATRIX or not size:
        return
    what, dims, name, at = _head(data, order, start)
    name = name if prefix is None else prefix
    n = int(np.prod(dims)) if dims else 0
    several = lambda k: f"({k + 1})" if n != 1 else ""
    if what in (OBJECT, SPARSE):
        return
    if what == CELL:
        for k in range(n):
            yield from arrays(data, order, at, f"{name}({k + 1})")
            at = _tag(data, at, order)[3]
    elif what == STRUCT:
        width, at = _numbers(data, at, order)
        names, at = _numbers(data, at, order)
        raw, w = names.tobytes(), int(width[0])
        fields = [raw[k : k + w].split(b"\0")[0].decode("latin-1") for k in range(0, len(raw), w)] if w else []
        for k in range(n):
            for f in fields:
                yield from arrays(data, order, at, f"{name}{several(k)}.{f}")
                at = _tag(data, at, order)[3]
    else:
        yield name, dims, _numbers(data, at, order)[0]


@dataclass
class Variable(InputPartition):
    path: str
    start: int
    size: int
    order: str


class _Reader(DataSourceReader):
    def __init__(self, root: str, glob: str, variables: set[str]) -> None:
        self.root, self.glob, self.variables = root, glob, variables

    def _plan(self, store: fs.FileSystem, path: str, size: int) -> Iterator[Variable]:
        with store.open_input_file(path) as f:
            order = byte_order(f.read_at(HEADER, 0))
            at = HEADER
            while order and at + 8 <= size:
                kind, n, start, end = _tag(f.read_at(8, at), 0, order)
                if self._wanted(f.read_at(min(n, 4096), at + start) if kind == COMPRESSED else f.read_at(min(n + 8, 4096), at), kind, order):
                    yield Variable(path, at, end, order)
                at += end

    def _wanted(self, data: bytes, kind: int, order: str) -> bool:
        if not self.variables or kind not in (MATRIX, COMPRESSED):
            return kind in (MATRIX, COMPRESSED)
        head = zlib.decompressobj().decompress(data, 4096) if kind == COMPRESSED else data
        return _head(head, order, 8)[2] in self.variables

    def partitions(self) -> Sequence[InputPartition]:
        store, root = file_system(self.root)
        info = store.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True))
        files = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and fnmatch(f.base_name, self.glob) and f.size > HEADER)
        return [v for path, size in files for v in self._plan(store, path, size)] or [Variable("", 0, 0, "<")]

    def read(self, partition: Variable) -> Iterator[pa.RecordBatch]:
        if not partition.size:
            return
        store, _ = file_system(self.root)
        with store.open_input_file(partition.path) as f:
            data = f.read_at(partition.size, partition.start)
        kind, n, start, _ = _tag(data, 0, partition.order)
        data = zlib.decompress(data[start : start + n]) if kind == COMPRESSED else data
        for name, dims, values in arrays(data, partition.order, 0):
            height = max(1, dims[0])
            for a in range(0, len(values), BATCH):
                part = values[a : a + BATCH].astype("f8")
                k = np.arange(a, a + len(part))
                columns = [[partition.path] * len(part), [name] * len(part), k, k % height, k // height, part]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["path", "name", "k", "row", "col", "value"])


class MatlabSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "matlab5"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        names = {v.strip() for v in self.options.get("variables", "").split(",") if v.strip()}
        return _Reader(self.options["path"], self.options.get("glob", "*.mat"), names)


def read(spark: SparkSession, folder: str, variables: Sequence[str] = (), glob: str = "*.mat") -> DataFrame:
    """The numbers of the files below ``folder``; see the module. Files of another kind give no rows."""
    spark.dataSource.register(MatlabSource)
    return spark.read.format("matlab5").options(glob=glob, variables=",".join(variables)).load(folder)


def columns(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """``i`` and a column for each of ``names``, vectors of one file side by side; null beyond a vector's end and of one that isn't there.

    Of names that differ in case alone, which columns can't, the first stands for all.
    """
    found = read(spark, path, [n.split(".")[0] for n in names]).where(F.col("name").isin(list(names)))
    return found.groupBy(F.col("k").alias("i")).agg(*[F.max(F.when(F.lower("name") == n.lower(), F.col("value"))).alias(n) for n in {m.lower(): m for m in reversed(names)}.values()])
