"""The binary recording files as a data source of Spark: ``spark.read.format("recordings")``.

Planning reads a file's header and its last bytes only, many files at a time; a
partition is a range of records, which a task seeks and reads in batches. So a
session is spread by its bytes, not by its files, no file is ever held, and what a
lost executor had read is read again by itself.

Options: ``kind`` (``positions``, ``spikes`` or ``signal``), ``glob`` (of file names
below the path, ``*`` by default), ``records`` (most in a partition) and ``waves``
(``true``: spikes come with their waveforms, which are neither copied nor sent otherwise).
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from fnmatch import fnmatch

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

# Fixed values of the file formats.
HEAD_END, TAIL = b"data_start", b"\r\ndata_end"
POSITION = [("ts", ">i4"), ("c", ">i2", (8,))]
SPIKE = [("ts", ">i4"), ("waveform", "i1", (50,))]
SPIKE_ROWS = 4
CUT_NAME = r"_(\d+)\.cut$"
CLU_NAME = r"\.clu\.(\d+)$"
TETRODE_NAME = r"\.(\d+)$"
SATURATION_MARGIN = 2

#: A header is looked for in so many bytes, records are sent on so many at a time, and a partition has so many at most.
HEAD_BYTES, BATCH, RECORDS = 1 << 20, 1 << 16, 1 << 20

SCHEMAS = {
    "positions": "path string, trial string, i long, ts long, " + ", ".join(f"c{j} int" for j in range(8)),
    "spikes": "path string, trial string, tet int, k long, tick long, timebase double",
    "signal": "path string, trial string, i long, v float, full boolean",
}
WAVES = "waveform array<smallint>"


def schema_of(kind: str, waves: bool) -> str:
    return SCHEMAS[kind] + (f", {WAVES}" if waves else "")


def names_of(kind: str, waves: bool) -> list[str]:
    return [c.split()[0] for c in SCHEMAS[kind].split(", ")] + ["waveform"] * waves


#: The cluster's names for stores as Arrow knows them.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs", "viewfs": "hdfs"}


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    scheme, mark, rest = path.partition(":/")
    if not mark or path.startswith("/"):
        return fs.LocalFileSystem(), path
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}:/{rest}")


def header_of(data: bytes) -> dict[str, str]:
    """A header's entries; of a key that repeats the last line counts, a line of one word has an empty value."""
    lines = [line for line in data.decode("ISO-8859-1").replace("\r\n", "\n").split("\n") if line]
    return {key: value.strip() for key, _, value in (line.partition(" ") for line in lines)}


def _number(header: dict[str, str], key: str) -> float | None:
    found = re.match(r"\s*(-?[0-9.]+)", header.get(key, ""))
    return float(found.group(1)) if found else None


def trial_of(name: str) -> str:
    """A file's name without its endings."""
    return re.sub(r"\.[^.]*$", "", re.sub(CLU_NAME, "", re.sub(CUT_NAME, "", name)))


@dataclass
class Records(InputPartition):
    """A range of a file's records."""

    path: str
    start: int  # of the first record in the file, in bytes
    first: int  # number of the first record
    count: int
    values: tuple  # what the header says about all records


class _Kind:
    """How files of one kind are cut and decoded; ``step`` records belong together."""

    step = 1

    def __init__(self, waves: bool) -> None:
        self.waves = waves

    def layout(self, name: str, header: dict[str, str]) -> tuple[np.dtype, int | None, tuple] | None:
        """The type of a record, how many count, and constants; None for a file of another kind."""
        raise NotImplementedError

    def columns(self, rows: np.ndarray, first: int, values: tuple) -> list:
        """The columns after ``path`` and ``trial``."""
        raise NotImplementedError


class _Positions(_Kind):
    def layout(self, name, header):
        n = _number(header, "num_pos_samples")
        return np.dtype(POSITION), None if n is None else int(n), ()

    def columns(self, rows, first, values):
        return [np.arange(first, first + len(rows)), rows["ts"].astype("i8"), *(rows["c"][:, j].astype("i4") for j in range(8))]


class _Spikes(_Kind):
    step = SPIKE_ROWS

    def layout(self, name, header):
        found = re.search(TETRODE_NAME, name)
        return (np.dtype(SPIKE), None, (int(found.group(1)), _number(header, "timebase"))) if found else None

    def columns(self, rows, first, values):
        ticks = rows["ts"][::SPIKE_ROWS].astype("i8")
        tet, timebase = values
        made = [np.full(len(ticks), tet, "i4"), first // SPIKE_ROWS + np.arange(len(ticks)), ticks, pa.array([timebase] * len(ticks), pa.float64())]
        if self.waves:
            flat = rows["waveform"].astype("i2").reshape(-1)
            made.append(pa.ListArray.from_arrays(np.arange(len(ticks) + 1, dtype="i4") * (len(flat) // max(1, len(ticks))), flat))
        return made


class _Signal(_Kind):
    def layout(self, name, header):
        width, n = _number(header, "bytes_per_sample"), _number(header, "num_EEG_samples")
        n = _number(header, "num_EGF_samples") if n is None else n
        return np.dtype("i1" if width in (None, 1.0) else "=i2"), None if n is None else int(n), ()

    def columns(self, rows, first, values):
        lim = np.iinfo(rows.dtype)
        full = (rows <= lim.min + SATURATION_MARGIN) | (rows >= lim.max - SATURATION_MARGIN)
        return [np.arange(first, first + len(rows)), rows.astype("f4"), full]


KINDS = {"positions": _Positions, "spikes": _Spikes, "signal": _Signal}


class _Reader(DataSourceReader):
    def __init__(self, kind: str, root: str, glob: str, waves: bool, records: int) -> None:
        self.kind, self.root, self.glob, self.waves, self.records = kind, root, glob, waves, records

    def _plan(self, path: str, size: int) -> list[Records]:
        kind, (store, _) = KINDS[self.kind](self.waves), file_system(self.root)
        with store.open_input_file(path) as f:
            head = f.read_at(min(size, HEAD_BYTES), 0)
            at = head.find(HEAD_END)
            layout = kind.layout(path.rsplit("/", 1)[-1], header_of(head[:at])) if at >= 0 else None
            if layout is None:
                return []
            dtype, count, values = layout
            start = at + len(HEAD_END)
            back = max(start, size - 32)
            mark = f.read_at(size - back, back).rfind(TAIL)
            whole = ((back + mark if mark >= 0 else size) - start) // dtype.itemsize
        whole = whole if count is None else min(whole, count)
        whole -= whole % kind.step
        share = max(kind.step, self.records - self.records % kind.step)
        return [Records(path, start + k * dtype.itemsize, k, min(share, whole - k), values) for k in range(0, whole, share)]

    def partitions(self) -> Sequence[InputPartition]:
        store, root = file_system(self.root)
        info = store.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True))
        files = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and fnmatch(f.base_name, self.glob))
        with ThreadPoolExecutor(32) as pool:
            planned = pool.map(lambda f: self._plan(*f), files)
        return [part for parts in planned for part in parts] or [Records("", 0, 0, 0, ())]

    def read(self, partition: Records) -> Iterator[pa.RecordBatch]:
        if not partition.count:
            return
        kind, (store, _) = KINDS[self.kind](self.waves), file_system(self.root)
        name = partition.path.rsplit("/", 1)[-1]
        with store.open_input_file(partition.path) as f:
            dtype = kind.layout(name, header_of(f.read_at(partition.start, 0)[: -len(HEAD_END)]))[0] if partition.first == 0 else None
            dtype = dtype or kind.layout(name, header_of(f.read_at(HEAD_BYTES, 0).partition(HEAD_END)[0]))[0]
            batch = BATCH - BATCH % kind.step
            for k in range(0, partition.count, batch):
                n = min(batch, partition.count - k)
                rows = np.frombuffer(f.read_at(n * dtype.itemsize, partition.start + k * dtype.itemsize), dtype)
                columns = [x if isinstance(x, pa.Array) else pa.array(x) for x in kind.columns(rows, partition.first + k, partition.values)]
                m = len(columns[0])
                yield pa.RecordBatch.from_arrays([pa.array([partition.path] * m), pa.array([trial_of(name)] * m), *columns], names_of(self.kind, self.waves))


class RecordingSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recordings"

    def _kind(self) -> str:
        kind = self.options.get("kind", "")
        if kind not in SCHEMAS:
            raise ValueError(f"kind must be one of {', '.join(SCHEMAS)}")
        return kind

    def _waves(self) -> bool:
        return self.options.get("waves", "false").lower() == "true" and self._kind() == "spikes"

    def schema(self) -> str:
        return schema_of(self._kind(), self._waves())

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self._kind(), self.options["path"], self.options.get("glob", "*"), self._waves(), int(self.options.get("records", RECORDS)))


def read(spark: SparkSession, folder: str, kind: str, glob: str = "*", waves: bool = False, records: int = RECORDS) -> DataFrame:
    """The records of the files below ``folder``; see the module."""
    spark.dataSource.register(RecordingSource)
    options = {"kind": kind, "glob": glob, "waves": str(waves).lower(), "records": str(records)}
    return spark.read.format("recordings").options(**options).load(folder)
