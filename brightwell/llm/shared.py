"""What the operators have in common: tables, the shared folder, written intermediate results."""

from __future__ import annotations

import ctypes
import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space that separates words: space and the ASCII controls from tab to carriage return.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only where that is unset and all runs in one process, as in tests, is a folder of our own made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not held.isDefined() and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = held.get() if held.isDefined() else "file://" + tempfile.mkdtemp(prefix="brightwell-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def make_dir(spark: SparkSession, path: str) -> None:
    """Make a folder through Hadoop's file system of that path."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(target)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a written intermediate result, through Hadoop's file system of that path."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def file_system(uri: str):
    """The file system of a folder of the shared one, for tasks, and the folder's path there."""
    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:/") else uri.replace("file:/", "file:///", 1))


def put_file(folder: str, name: str, data: bytes) -> None:
    """Write under another name and move it there: a task that runs twice leaves one whole file."""
    fs, root = file_system(folder)
    fs.create_dir(root, recursive=True)
    part = f"{root}/{uuid.uuid4().hex}.part"
    with fs.open_output_stream(part, compression=None) as f:
        f.write(data)
    fs.move(part, f"{root}/{name}")


def written(df: DataFrame, label: str, most_rows: int | None = None, rows_a_file: int = 100_000) -> tuple[DataFrame, str]:
    """Write df as Parquet to the shared folder and read it again: cuts lineage, survives lost executors.

    Where the number of rows is known to be at most most_rows, so many files are written as that needs.
    """
    spark = df.sparkSession
    if most_rows is not None:
        df = df.coalesce(max(1, -(-most_rows // rows_a_file)))
    path = shared_path(spark, label)
    held = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")  # the shuffle files of this write go when it is done
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, held)
        spark._jvm.System.gc()  # Spark deletes shuffle files when their plans are collected on the driver, else whenever that may be
    return spark.read.schema(df.schema).parquet(path), path


def lower_ascii(column):
    """Lower-case A-Z only; every other character stays."""
    return F.translate(column, UPPER, LOWER)


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that go to Python workers by bytes, however long the texts are.

    Spark reads these settings when the query runs, after the operator has returned it, so they
    stay in the session; a bound that is tighter already is kept.
    """
    for key, most in (("maxBytesPerBatch", 8 << 20), ("maxRecordsPerBatch", 2_000)):
        key = f"spark.sql.execution.arrow.{key}"
        held = int(spark.conf.get(key).rstrip("b"))
        if held <= 0 or held > most:
            spark.conf.set(key, str(most))


#: Blocks from this size on are mapped on their own, so freeing one gives it back at once.
_OWN_BLOCK = 2 << 20


@functools.cache
def _allocator():
    """The C library, told not to keep large freed blocks, with Arrow's memory from it too; None where it has no such settings."""
    lib = ctypes.CDLL(None)
    if not hasattr(lib, "mallopt") or not hasattr(lib, "malloc_trim"):
        return None
    lib.mallopt(-3, _OWN_BLOCK)  # M_MMAP_THRESHOLD; set, it no longer grows with the blocks that are freed
    lib.mallopt(-1, _OWN_BLOCK)  # M_TRIM_THRESHOLD
    lib.malloc_trim.argtypes = [ctypes.c_size_t]
    pa.set_memory_pool(pa.system_memory_pool())
    return lib


def lean(function: Callable) -> Callable:
    """function, for mapInArrow, with its worker's freed memory given back: workers stay for later tasks, several to an executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib = _allocator()
        try:
            yield from function(batches)
        finally:
            if lib is not None:
                lib.malloc_trim(0)

    return run


def packed(df: DataFrame, *columns) -> DataFrame:
    """The whole row as struct `row`, beside `columns`: no name of df can clash with a result's."""
    return df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("row"), *columns)


def map_rows(df: DataFrame, columns: list, function, found: T.StructType) -> DataFrame:
    """(row, found) for each row: function maps batches of (row, *columns) to batches of (row, found)."""
    small_batches(df.sparkSession)
    kept = packed(df, *columns)
    schema = T.StructType([T.StructField("row", kept.schema["row"].dataType), T.StructField("found", found)])
    return kept.mapInArrow(lean(function), schema)


def pieces(batch: pa.RecordBatch, column: int, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch cut into pieces of about most_bytes in one column, so that buffers stay small."""
    held = batch.column(column)
    sizes = pc.fill_null(pc.binary_length(held), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most_bytes, side="right")))
        yield batch.slice(start, stop - start)
        start = stop
