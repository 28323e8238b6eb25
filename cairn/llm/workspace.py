"""Lineage cuts: intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
#: Folders of the operators called inside each ``scratch``, the innermost last.
_scratch: list[list[str]] = []

#: Bytes of text that an operator handles at once. Spark bounds an Arrow batch by 64 MB; a longer text comes alone.
TEXT_BYTES = 256 << 10


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only in local mode, where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        folder = tempfile.mkdtemp(prefix="cairn-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _own[app] = f"file://{folder}"
    return _own[app]


def text_runs(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of rows, first and end, whose texts hold at most ``TEXT_BYTES`` together or are one."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(ends):
        before = int(ends[start - 1]) if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + TEXT_BYTES, "right")))
        yield start, end
        start = end


def text_slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The batches in runs of rows by the texts of a column."""
    for batch in batches:
        for start, end in text_runs(batch.column(column)):
            yield batch.slice(start, end - start)


def give_back() -> None:
    """Return what a task has freed to the system: workers live on and share an executor's memory with later stages."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # only some C libraries have the call
        ctypes.CDLL(None).malloc_trim(0)


def unused(name: str, columns: list[str]) -> str:
    """The name, with as many underscores behind it as make it differ from all columns in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


class Workspace:
    """Tables of one operator call.

    ``cut`` writes a DataFrame as Parquet and reads it back, so that a lost executor repeats no more
    than the work since the last cut. ``drop`` removes tables that no later step reads.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/cairn-{uuid.uuid4().hex}"
        self._n = 0
        if _scratch:
            _scratch[-1].append(self.root)

    def cut(self, df: DataFrame) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n:04d}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._cairn_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            path = getattr(table, "_cairn_path", None)
            if path:
                _delete(self.spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete, at the end, the intermediate tables of all operators called inside; their results must be written by then.

    Without it the tables stay under the shared folder, as a lazily evaluated result may still need them. For one thread.
    """
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            _delete(spark, path)
