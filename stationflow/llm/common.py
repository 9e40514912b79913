"""Helpers shared by the operators of this subpackage.

Text operators that need Python run as ``mapInArrow`` over the rows where they lie: Spark
partitions the work, a lost executor only repeats its tasks, and a task holds one Arrow batch.
"""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of text that the numpy code handles at once; longer single texts are handled whole.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id"):
    """True for the third of the documents that no model may learn labels from (null ids may be learnt from)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def bounded_sample(df: DataFrame, group: str, n: int) -> DataFrame:
    """The n rows of each group with the smallest hashes of doc_id.

    Ranks within 64 parts of a group first, so no task gets more than a few rows of a large group.
    """
    keyed = df.withColumn("_hash", F.xxhash64("doc_id"))
    order = [F.col("_hash"), F.col("doc_id")]
    for part in ([group, F.pmod("_hash", F.lit(64))], [group]):
        ranked = keyed.withColumn("_rank", F.row_number().over(Window.partitionBy(*part).orderBy(*order)))
        keyed = ranked.where(F.col("_rank") <= n).drop("_rank")
    return keyed.drop("_hash")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (``spark.checkpoint.dir``); a local one only where that is unset and Spark is local."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not re.match(r"local(\[|$)", context.master):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoints-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder that ``shared_dir`` holds."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


#: The tables that ``stored`` has written, by application.
_written: dict[str, list[str]] = {}


def stored(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a Parquet table in the shared folder; smaller than a checkpoint for many plain rows.

    A lazy result may read it, so it stays until the caller has written that result and calls ``forget``.
    """
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    _written.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(spark: SparkSession) -> int:
    """How many tables ``stored`` has written so far: what ``forget`` takes to spare those."""
    return len(_written.get(spark.sparkContext.applicationId, ()))


def forget(spark: SparkSession, since: int = 0) -> None:
    """Deletes the tables that ``stored`` has written (after the first ``since``); for a caller whose results are written."""
    paths = _written.get(spark.sparkContext.applicationId, [])
    while len(paths) > since:
        discard(spark, paths.pop())


def give_back_memory() -> None:
    """Python workers are kept for later tasks; what a task has freed goes back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column without copying; null reads as empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def row_slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes each, or of a single longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def byte_lists(column: pa.Array) -> list[bytes]:
    """Each text as UTF-8 bytes; null reads as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def map_arrow(df: DataFrame, function, schema) -> DataFrame:
    """``mapInArrow`` whose tasks give back what they have freed when they end."""

    def run(batches):
        yield from function(batches)
        give_back_memory()

    return df.mapInArrow(run, schema)
