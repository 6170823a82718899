"""Reading input tables, and tables that cut lineage in the shared folder."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; in local mode, as in tests, a temporary one where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def materialise(df: DataFrame, label: str, shuffled: bool = False, codec: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it again.

    The result survives the loss of any executor and is computed once. With
    ``shuffled``, for what an exchange has just dealt, each core writes a few files
    at most, or each task those of four partitions where there are more.
    """
    spark = df.sparkSession
    if shuffled:
        df = df.coalesce(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4))
    path = f"{shared_dir(spark)}/loomfield-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what ``materialise`` wrote for the given tables; nothing that is still to run may read them."""
    for table_ in tables:
        path = _paths.pop(table_, None)
        if path:
            spark = table_.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


#: Bytes of an Arrow batch that Spark hands to a Python worker, about, and of the slices that operators cut it into.
BATCH_BYTES, SLICE_BYTES = 2 << 20, 1 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes; one setting for all operators, and one that is there already stays."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def tidy(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """The function of a task, after which its worker, that lives on, hands the memory that it freed back to the system."""

    @wraps(task)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from task(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim:
            trim(0)

    return run


def slices(batch: pa.RecordBatch, column: int, rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Slices of at most so many rows and, but for a single longer value, SLICE_BYTES of a string column."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        stop = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + SLICE_BYTES, "right"))))
        yield batch.slice(at, stop - at)
        at = stop
