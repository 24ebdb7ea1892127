"""Shared helpers: the shared work folder, written intermediate tables, Arrow text access."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

M64 = (1 << 64) - 1
#: A run of documents is worked on in pieces of about this many bytes.
CHUNK_BYTES = 4 << 20


def work_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a fresh local one only where it is unset."""
    tune(spark)
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = getattr(sc, "_stratalane_dir", None)
        if not found:
            found = sc._stratalane_dir = "file://" + tempfile.mkdtemp(prefix="stratalane-")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(found)
    return found


def new_dir(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = new_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text):
    """Lower-case A-Z only, JVM-side. lower() is exact, and fast, where every character is one byte."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1, from zero) and UTF-8 bytes of an Arrow string or binary array; nulls are empty."""
    import pyarrow as pa

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):  # no chunks at all
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return offsets - offsets[0], raw[offsets[0] : offsets[-1]]


def pieces(offsets: np.ndarray, most: int = CHUNK_BYTES):
    """Cut rows into runs (first, end) of about `most` bytes; a longer row stands alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        end = min(max(end, first + 1), n)
        yield first, end
        first = end


def total_bytes(docs: DataFrame, column: str) -> int:
    tune(docs.sparkSession)
    return docs.select(F.coalesce(F.sum(F.octet_length(column).cast("long")), F.lit(0))).first()[0]


def arrow_udf(schema: str):
    """F.arrow_udf for functions of arrays to an array, without hints that name pyarrow at import."""
    import inspect

    import pyarrow as pa

    def wrap(f):
        f.__annotations__ = {name: pa.Array for name in inspect.signature(f).parameters} | {"return": pa.Array}
        return F.arrow_udf(f, schema)

    return wrap


#: Bytes of a batch of rows between the JVM and a Python worker.
BATCH_BYTES = 8 << 20


def tune(spark: SparkSession) -> None:
    """Bounds the batches that go to Python workers by bytes, so that long texts don't pile up there."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def trim() -> None:
    """Gives freed memory back to the system: workers stay alive between tasks, beside others."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # no glibc
        pass


def trimmed(batches):
    for batch in batches:
        yield batch
        del batch
        trim()
