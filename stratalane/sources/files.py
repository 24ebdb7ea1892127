"""Other sources and sinks: raw little-endian binary columns, widened Parquet columns, CSV results, and what
general byte codecs and Parquet files make of the same columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Truncated
from ..operators.arrays import arrow_type, values
from ..operators.coding import U
from ..plans.blocks import supported


def read_binary(spark: SparkSession, path: str, kind: str = "<f8") -> DataFrame:
    """(path, pos, value) of files that hold nothing but little-endian numbers; a partial value at the end is an error."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        size = np.dtype(kind).itemsize
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if len(raw) % size:
                    raise Truncated(f"{name} ends within a value")
                v = np.frombuffer(raw, kind).astype(np.float64)
                for k in range(0, len(v), 65536):
                    part = v[k : k + 65536]
                    yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(name), len(part)), pa.array(k + np.arange(len(part))), pa.array(part)], names=["path", "pos", "value"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, pos long, value double")


def numeric(df: DataFrame) -> DataFrame:
    """The columns that can be encoded."""
    return df.select(*supported(df))


def widened(df: DataFrame) -> DataFrame:
    """The numeric columns by the widening rules: 8 and 16 bits to int; unsigned 64 bits (read as decimal(20,0)) to bigint
    if all values fit, else as decimals; others as they are."""
    kinds = dict(df.dtypes)
    long_ones = [c for c in supported(df) if kinds[c] == "decimal(20,0)"]
    fits = {}
    if long_ones:
        row = df.agg(*(F.coalesce(F.max(F.abs(F.col(c))), F.lit(0)).alias(c) for c in long_ones)).first()
        fits = {c: row[c] < 2**63 for c in long_ones}
    to = {"smallint": "int", "tinyint": "int"}
    return df.select(*(F.col(c).cast("bigint" if fits.get(c) else to.get(kinds[c], kinds[c])).alias(c) for c in supported(df)))


def write_csv(results: DataFrame, path: str) -> None:
    """Results as CSV with a header line."""
    results.write.mode("overwrite").option("header", True).csv(path)


#: name: (codec of pyarrow, level)
CODECS = {"lz4": ("lz4", None), "zstd-1": ("zstd", 1), "zstd-3": ("zstd", 3), "zstd-9": ("zstd", 9), "zstd-19": ("zstd", 19), "gzip-6": ("gzip", 6)}
PARQUET = {"parquet-plain": ("none", None), "parquet-snappy": ("snappy", None), "parquet-zstd-9": ("zstd", 9)}


def _squeezed(raw: bytes, codec: str, level: int | None) -> int:
    import pyarrow as pa

    return len((pa.Codec(codec, level) if level else pa.Codec(codec)).compress(raw))


def bit_shuffled(raw: bytes) -> bytes:
    """Bits of 8-byte values by significance: all lowest bits first."""
    bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), bitorder="little").tobytes()


def _as_parquet(column, codec: str, level: int | None, page: int) -> int:
    import pyarrow as pa
    import pyarrow.parquet as pq

    sink = pa.BufferOutputStream()
    pq.write_table(pa.table({"v": column}), sink, compression=codec, compression_level=level, row_group_size=page)
    return sink.getvalue().size


def baselines(lanes: DataFrame, page: int = 4096) -> DataFrame:
    """(col, codec, raw, bytes): lanes paged at the block size and put through general byte codecs, after a bit shuffle
    too, and as Parquet files with a row group per page."""

    def run(key, table):
        import pyarrow as pa

        table = table.sort_by("pos")
        kind = table.column("kind")[0].as_py()
        x = np.ascontiguousarray(table.column("lane").to_numpy())
        raw = x.tobytes()
        column = values(x.view(U), np.ones(len(x), bool), kind) if arrow_type(kind) else None
        sizes = {name: _squeezed(raw, *how) for name, how in CODECS.items()}
        sizes["bitshuffle-lz4"] = _squeezed(bit_shuffled(raw), "lz4", None)
        sizes |= {name: _as_parquet(column, codec, level, page) for name, (codec, level) in PARQUET.items()}
        got = [(key[0].as_py(), name, len(raw), size) for name, size in sizes.items()]
        return pa.table({n: pa.array(c) for n, c in zip(["col", "codec", "raw", "bytes"], zip(*got))})

    paged = lanes.withColumn("page", F.expr(f"pos div {page}"))
    sized = paged.select("col", "kind", "page", "pos", "lane").groupBy("col", "page").applyInArrow(run, "col string, codec string, raw long, bytes long")
    return sized.groupBy("col", "codec").agg(F.sum("raw").alias("raw"), F.sum("bytes").alias("bytes"))


def totals(sized: DataFrame) -> DataFrame:
    """(codec, raw, bytes, ratio) over all columns: sums first, then their ratio, so that large columns count for more."""
    out = sized.groupBy("codec").agg(F.sum("raw").alias("raw"), F.sum("bytes").alias("bytes"))
    return out.select("codec", "raw", "bytes", F.round(F.col("raw") / F.col("bytes"), 6).alias("ratio"))
