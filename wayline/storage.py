"""Where intermediate tables live.

Anything a job has to read twice is written as Parquet under the folder that the
cluster names in ``spark.checkpoint.dir``: every executor and the driver see it,
so a lost executor costs a task retry and never a table.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no folder and runs on one machine, as in tests.
LOCAL_DEFAULT = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session; sets the default where none is set, which only one machine may do without."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("a cluster must name a shared folder in spark.checkpoint.dir")
        named = LOCAL_DEFAULT
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark)}/wayline-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the files: cuts lineage."""
    spark = df.sparkSession
    path = new_path(spark, name)
    schema = df.schema
    df.write.parquet(path)
    _gone_at_exit(spark, path)
    out = spark.read.schema(schema).parquet(path)
    out._wayline_path = path
    return out


def read_batches(path: str, columns: tuple[str, ...], by: str | None = None, low: int = 0, high: int = 0, size: int = 1 << 16) -> Iterator[list[np.ndarray]]:
    """Columns of numbers of a table that :func:`materialize` wrote, in batches; on any executor. Nulls are NaN.

    If ``by`` is given only rows where it is from ``low`` up to and without ``high``:
    what of a file lies outside by its statistics is not read.
    """
    where, folder = fs.FileSystem.from_uri(path)
    files = sorted(f.path for f in where.get_file_info(fs.FileSelector(folder)) if f.base_name.startswith("part-"))
    for name in files:
        with where.open_input_file(name) as source, pq.ParquetFile(source) as file:
            meta = file.metadata
            groups = range(meta.num_row_groups)
            if by:
                found = [meta.row_group(g).column(file.schema_arrow.get_field_index(by)).statistics for g in groups]
                groups = [g for g, s in zip(groups, found) if not (s and s.has_min_max) or (s.max >= low and s.min < high)]
            if not len(groups):
                continue
            for batch in file.iter_batches(size, row_groups=list(groups), columns=list(columns), use_threads=False):
                made = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
                if by:
                    inside = (made[columns.index(by)] >= low) & (made[columns.index(by)] < high)
                    made = [c[inside] for c in made]
                yield made


def bucketed(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Write ``df`` bucketed and sorted by ``keys``, so that joins on them merge the files as they lie.

    There are as many buckets as shuffle partitions. A row's bucket is that of a
    shuffle by ``keys``: if ``df`` comes from one, each bucket is one file.
    """
    spark = df.sparkSession
    path, table = new_path(spark, name), f"wayline_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with sorted_scans(spark):
        df.write.bucketBy(n, *keys).sortBy(*keys).option("path", path).saveAsTable(table)
    _gone_at_exit(spark, path)
    out = spark.table(table)
    out._wayline_path, out._wayline_table = path, table
    return out


_FILE_ORDER = "spark.sql.legacy.bucketedTableScan.outputOrdering"


@contextmanager
def sorted_scans(spark: SparkSession) -> Iterator[None]:
    """Jobs planned inside take a bucket that is one file for sorted, as :func:`bucketed` wrote it."""
    before = spark.conf.get(_FILE_ORDER, None)
    spark.conf.set(_FILE_ORDER, "true")
    try:
        yield
    finally:
        spark.conf.unset(_FILE_ORDER) if before is None else spark.conf.set(_FILE_ORDER, before)


def _file_system(spark: SparkSession, path: str):
    """The file system of a path, and the path, as Hadoop has them."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _gone_at_exit(spark: SparkSession, path: str) -> None:
    """What a result may still be read from stays until the driver's JVM ends in good order."""
    fs, where = _file_system(spark, path)
    fs.deleteOnExit(where)


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`materialize` or :func:`bucketed` that nothing reads any more."""
    table = getattr(df, "_wayline_table", None)
    if table:
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {table}")
    path = getattr(df, "_wayline_path", None)
    if path:
        fs, where = _file_system(df.sparkSession, path)
        fs.delete(where, True)
