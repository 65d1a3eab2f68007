"""Shared parts of the training-data operators: reading, scratch tables, splits and text batches."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship


#: Bytes of a batch of rows that goes to a Python worker at a time, if the session names none.
BATCH = 4 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Where the session names none, a temporary folder is set for a local master, as in tests; elsewhere
    that is an error, as executors would not see it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    if not found:
        found = getattr(spark, "_ledgerline_dir", None) or "file://" + tempfile.mkdtemp(prefix="ledgerline-")
        spark._ledgerline_dir = found
        if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
            spark.sparkContext.setCheckpointDir(found)
    return found


def new_path(spark: SparkSession, name: str) -> str:
    """A folder of its own under the shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession) -> None:
    """Sends rows to Python workers in batches of BATCH bytes at most, unless the session has a limit of its own.

    By Spark's default (64 MB) the texts or shingle sets of one batch take much of what an executor has
    beside its heap, on both sides, and little of that is given back between tasks.
    """
    if "spark.sql.execution.arrow.maxBytesPerBatch" not in spark.conf.getAll:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Writes df once to the shared folder and reads it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names made of the given ones that df has not."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while f"_{name}".lower() in taken:
            name = f"_{name}"
        taken.add(f"_{name}".lower())
        out.append(f"_{name}")
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes scratch tables that nothing reads any more, and lets Spark remove the shuffle files of their steps."""
    spark = tables[0].sparkSession
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for t in tables:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(t._scratch_path)
        path.getFileSystem(hadoop).delete(path, True)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def crc_of_id(column: str = "doc_id"):
    """crc32 of an id written as text; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(value) -> bytes:
    return b"" if value is None else value.encode("utf-8", "surrogatepass")


def in_bounds(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices record batches so that each slice holds about `most` bytes of `column` (one row at least)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = batch.column(batch.schema.get_field_index(column))
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(sizes), 0), dtype=np.int64))
        start = 0
        while start < n:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def unaligned_u64(buffer: np.ndarray) -> np.ndarray:
    """The little-endian 64-bit word that starts at each byte of buffer; buffer is padded by 8 bytes."""
    return np.ndarray(shape=(len(buffer) - 7,), dtype="<u8", buffer=buffer, strides=(1,))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit words (finalizer of the splitmix generator)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
