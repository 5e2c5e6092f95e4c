"""Recording files as tables: a text header of ``key value`` lines, then fixed-width binary records.

Records come from the data source of :mod:`record_files` (``read_leds``,
``read_spikes``, ``read_signal``), in ranges of a file each. Small files, such as
those of settings and clusters, are rows of ``binaryFile``, as are records where
they are at hand as contents (``leds``, ``spikes``, ``signal``: up to 2 GB a file).
Files that are not there give no rows. Every table carries ``path``, ``trial`` (the
file's name without its endings) and, for tetrodes and cuts, ``tet``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayline.operators import sequence as S
from wayline.sources import record_files as R
from wayline.sources.record_files import CLU_NAME, CUT_NAME, POSITION, SPIKE, TETRODE_NAME  # noqa: F401 (parts of this module's interface)

#: What the tracker writes for a light that it missed.
MISSING = 1023
SATURATION_SPREAD_S = 1.5


def listing(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """``path, name, trial, modified, length`` of the files below ``folder``; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files.select("path", *_names(), F.col("modificationTime").alias("modified"), "length")


def contents(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """``path, name, trial, content``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files.select("path", *_names(), "content")


def _names() -> list[Column]:
    name = F.element_at(F.split("path", "/"), -1)
    trial = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, CUT_NAME, ""), CLU_NAME, ""), r"\.[^.]*$", "")
    return [name.alias("name"), trial.alias("trial")]


def with_header(files: DataFrame) -> DataFrame:
    """``files`` with ``header``, a map; of a key that repeats the last line counts, a line of one word has an empty value."""
    head = F.split(F.decode(F.substring("content", 1, R.HEAD_BYTES), "ISO-8859-1"), R.HEAD_END.decode(), 2)[0]
    lines = F.filter(F.split(head, r"\r?\n"), lambda s: F.length(s) > 0)
    entries = F.transform(lines, lambda s: F.struct(F.substring_index(s, " ", 1).alias("k"), F.trim(F.regexp_replace(s, r"^\S*", "")).alias("v")))
    named = files.withColumn("__e", entries)
    last = F.filter("__e", lambda e, at: F.array_position(F.slice(F.col("__e.k"), at + 2, F.size("__e")), e["k"]) == 0)
    return named.withColumn("header", F.map_from_entries(last)).drop("__e")


def number(key: str) -> Column:
    """A header entry's leading number, such as 50 of ``50 hz``; null where there is none."""
    return F.regexp_extract(F.col("header")[key], r"^\s*(-?[0-9.]+)", 1).try_cast("double")


def _decoded(files: DataFrame, kind: str, waves: bool = False) -> DataFrame:
    """The records of files at hand as ``path, name, content``, decoded as those that are read by ranges."""
    made = R.KINDS[kind](waves)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, name, content in zip(*(batch.column(k) for k in range(3))):
                data = content.as_buffer()
                head = bytes(data[: R.HEAD_BYTES])
                at = head.find(R.HEAD_END)
                layout = made.layout(name.as_py(), R.header_of(head[:at])) if at >= 0 else None
                if layout is None:
                    continue
                dtype, count, values = layout
                start = at + len(R.HEAD_END)
                back = max(start, len(data) - 32)
                mark = bytes(data[back:]).rfind(R.TAIL)
                whole = ((back + mark if mark >= 0 else len(data)) - start) // dtype.itemsize
                whole = whole if count is None else min(whole, count)
                whole -= whole % made.step
                step = R.BATCH - R.BATCH % made.step
                for k in range(0, whole, step):
                    part = np.frombuffer(data, dtype, min(step, whole - k), start + k * dtype.itemsize)
                    columns = [x if isinstance(x, pa.Array) else pa.array(x) for x in made.columns(part, k, values)]
                    n = len(columns[0])
                    yield pa.RecordBatch.from_arrays([pa.array([path.as_py()] * n), pa.array([R.trial_of(name.as_py())] * n), *columns], names)

    names = R.names_of(kind, waves)
    return files.select("path", "name", "content").mapInArrow(rows, R.schema_of(kind, waves))


def _lights(rows: DataFrame, n_leds: int) -> DataFrame:
    seen = [F.nullif(F.col(f"c{j}"), F.lit(MISSING)).cast("double") for j in range(8)]
    lights = [F.struct(F.lit(k).alias("led"), seen[2 * k].alias("px"), seen[2 * k + 1].alias("py"), F.col(f"c{4 + k}").cast("double").alias("npix")) for k in range(n_leds)]
    return rows.select("path", "trial", "i", F.inline(F.array(*lights)))


def leds(files: DataFrame, n_leds: int) -> DataFrame:
    """``path, trial, i, led, px, py, npix`` from position files; what the tracker missed is null.

    With one light the first two numbers of a record are its place and the fifth
    its size; with two, places come first and sizes fifth and sixth.
    """
    return _lights(_decoded(files, "positions"), n_leds)


def read_leds(spark: SparkSession, folder: str, n_leds: int, pattern: str = "*.pos", **options) -> DataFrame:
    """As :func:`leds`, from the files below ``folder``."""
    return _lights(R.read(spark, folder, "positions", pattern, **options), n_leds)


def _timed(rows: DataFrame, waves: bool) -> DataFrame:
    return rows.select("path", "trial", "tet", "k", "tick", (F.col("tick") / F.col("timebase")).alias("t_s"), *(["waveform"] if waves else []))


def spikes(files: DataFrame, waves: bool = False) -> DataFrame:
    """``path, trial, tet, k, tick, t_s`` from tetrode files, and ``waveform`` (four channels on end) if asked for."""
    return _timed(_decoded(files, "spikes", waves), waves)


def read_spikes(spark: SparkSession, folder: str, pattern: str = "*", waves: bool = False, **options) -> DataFrame:
    """As :func:`spikes`, from the files below ``folder``."""
    return _timed(R.read(spark, folder, "spikes", pattern, waves, **options), waves)


def _marked(rows: DataFrame, fs: float) -> DataFrame:
    r = int(fs * SATURATION_SPREAD_S)
    near = {"is_bad": lambda w: F.max("full").over(w.rowsBetween(-r, r))}
    return S.framed(rows, near, r, r, keys=("path", "trial"), chunk=max(S.CHUNK, 2 * r + 1)).drop("full")


def signal(files: DataFrame, fs: float) -> DataFrame:
    """``path, trial, i, v, is_bad`` from EEG or EGF files of ``fs`` samples a second.

    Bad is what lies within 1.5 s of a sample at the limit of its type.
    """
    return _marked(_decoded(files, "signal"), fs)


def read_signal(spark: SparkSession, folder: str, fs: float, pattern: str = "*.e[eg][gf]", **options) -> DataFrame:
    """As :func:`signal`, from the files below ``folder``."""
    return _marked(R.read(spark, folder, "signal", pattern, **options), fs)


def signal_rates(files: DataFrame) -> DataFrame:
    """``path, trial, fs, n`` of EEG or EGF files, from their headers."""
    n = F.coalesce(number("num_EEG_samples"), number("num_EGF_samples")).cast("long").alias("n")
    return with_header(files).select("path", "trial", number("sample_rate").alias("fs"), n)


def cuts(files: DataFrame) -> DataFrame:
    """``path, trial, tet, k, cell`` from cluster files of both formats; cell 0 is noise."""
    text = F.decode("content", "ISO-8859-1")
    is_cut = F.col("name").rlike(CUT_NAME)
    numbers = F.when(is_cut, F.regexp_replace(F.element_at(F.split(text, r"spikes:\s"), -1), r"^\s*\d+\s*", "")).otherwise(F.regexp_replace(text, r"^\s*\d+\s*", ""))
    cells = F.filter(F.split(numbers, r"\s+"), lambda s: s != "")
    return files.select("path", "trial", _tetrode().alias("tet"), F.posexplode(cells).alias("k", "cell")).select("path", "trial", "tet", F.col("k").cast("long").alias("k"), F.col("cell").cast("int").alias("cell"))


def _tetrode() -> Column:
    return F.coalesce(F.regexp_extract("name", CUT_NAME, 1).try_cast("int"), F.regexp_extract("name", CLU_NAME, 1).try_cast("int"))


def newest_cuts(files: DataFrame, kind: str | None = None) -> DataFrame:
    """Of a listing the newest cluster file of each trial and tetrode; ``kind`` is ``cut``, ``clu`` or either. Ties to the larger path."""
    found = files.withColumn("tet", _tetrode()).where("tet is not null")
    if kind:
        found = found.where(F.col("name").rlike(CUT_NAME if kind == "cut" else CLU_NAME))
    w = Window.partitionBy("trial", "tet").orderBy(F.desc("modified"), F.desc("path"))
    return found.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def cut_path(pattern: str, path: Column, experiment: Column, tet: Column) -> Column:
    """The cluster file that a pattern with ``%PATH%``, ``%EXPERIMENT%`` and ``%TET%`` names."""
    return F.replace(F.replace(F.replace(F.lit(pattern), F.lit("%PATH%"), path), F.lit("%EXPERIMENT%"), experiment), F.lit("%TET%"), tet.cast("string"))


def sorted_spikes(spiked: DataFrame, clustered: DataFrame) -> DataFrame:
    """Spikes with their ``cell``; without a cluster file a spike's cell is null."""
    return spiked.join(clustered.select("trial", "tet", "k", "cell"), ["trial", "tet", "k"], "left")


def trials(settings: DataFrame, positions: DataFrame) -> DataFrame:
    """``trial, duration_s, n_leds, pos_fs, n_pos, ppm, window_w, window_h``, a row for each set file; columns of a missing position file are null."""
    s = with_header(settings).select("trial", number("duration").alias("duration_s"), (F.coalesce(number("colactive_1"), F.lit(0.0)) + F.coalesce(number("colactive_2"), F.lit(0.0))).cast("int").alias("n_leds"))
    p = with_header(positions).select("trial", number("sample_rate").alias("pos_fs"), number("num_pos_samples").cast("long").alias("n_pos"), number("pixels_per_metre").alias("ppm"), (number("window_max_x") - number("window_min_x")).alias("window_w"), (number("window_max_y") - number("window_min_y")).alias("window_h"))
    return s.join(p, "trial", "left")
