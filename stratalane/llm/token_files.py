"""Token-id output: Arrow stream files of equal-length sequences and masks, and a reader of them.

A file holds the ids of a run of documents in ascending id order, an end id after each, cut into
sequences of fixed length: columns `ids` (fixed-size list of uint16, or uint32 for large vocabularies)
and `mask` (fixed-size list of bool, false on the padding of the last sequence). Batches have equal row
counts, so sequence k of a file is a slice of a memory map. A manifest row per document names its file,
its first id there and its count; `start` counts the ids of all documents before it.

Files are written to a new folder of the shared place, under a temporary name first, so that a task
that is run again leaves the same file. Cases: null ids come first, equal ids go by text, repeated rows stand side by
side; ids are numbers or strings (in order of their bytes); a null or empty text is an end id only; very long texts are a
file of their own size; no documents make no files; other columns are dropped, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from ._common import new_dir, stash, total_bytes, trimmed

SEQUENCE = 1024
BATCH = 256


def _filesystem(uri: str):
    """The file system of a folder; s3a and s3n are the names that Spark has for s3."""
    import re

    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))


def write_file(uri: str, ids: np.ndarray, sequence: int = SEQUENCE, batch: int = BATCH) -> None:
    import os

    import pyarrow as pa

    kind = pa.uint16() if not len(ids) or int(ids.max()) < 1 << 16 else pa.uint32()
    rows = -(-len(ids) // sequence)
    flat = np.zeros(rows * sequence, kind.to_pandas_dtype())
    flat[: len(ids)] = ids
    mask = np.arange(rows * sequence) < len(ids)
    schema = pa.schema([("ids", pa.list_(kind, sequence)), ("mask", pa.list_(pa.bool_(), sequence))], metadata={"n_ids": str(len(ids)), "batch": str(batch)})
    system, path = _filesystem(uri)
    part = f"{path}.{os.getpid()}.{os.urandom(4).hex()}.tmp"
    with system.open_output_stream(part) as sink, pa.ipc.new_stream(sink, schema) as out:
        for k in range(0, rows, batch):
            a, b = k * sequence, min(k + batch, rows) * sequence
            out.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(flat[a:b]), sequence), pa.FixedSizeListArray.from_arrays(pa.array(mask[a:b]), sequence)], schema=schema))
    system.move(part, path)


class TokenFile:
    """Random access to a file's sequences and ids; from a local file without copies."""

    def __init__(self, uri: str):
        import pyarrow as pa
        from pyarrow import fs

        system, path = _filesystem(uri)
        source = pa.memory_map(path) if isinstance(system, fs.LocalFileSystem) else pa.BufferReader(system.open_input_file(path).read_buffer())
        reader = pa.ipc.open_stream(source)
        self.schema, self.batches = reader.schema, list(reader)
        self.sequence = self.schema.field("ids").type.list_size
        self.n_ids, self.batch = int(self.schema.metadata[b"n_ids"]), int(self.schema.metadata[b"batch"])
        self.flat = [b.column("ids").flatten().to_numpy() for b in self.batches]

    def __getitem__(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Sequence k and its mask; the ids are a view of the file."""
        b, r = divmod(k, self.batch)
        return self.flat[b][r * self.sequence : (r + 1) * self.sequence], self.batches[b].column("mask")[r].values.to_numpy(zero_copy_only=False)

    def ids(self, start: int, n: int) -> np.ndarray:
        """n ids from `start` on: a view, or a copy where they lie in several batches."""
        size = self.batch * self.sequence
        out = []
        while n:
            b, at = divmod(start, size)
            part = self.flat[b][at : at + n]
            out.append(part)
            start, n = start + len(part), n - len(part)
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.zeros(0, np.uint16)


def write(docs: DataFrame, encoder, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", sequence: int = SEQUENCE) -> DataFrame:
    """Encodes and writes; returns the manifest (id, block, file, first, n_tokens, start)."""
    spark = docs.sparkSession
    folder = new_dir(spark, "tokens")
    if ":" not in folder.split("/")[0]:  # a path without a scheme is one that all share, as checkpoints are
        folder = f"file://{folder}"
    _make(folder)
    blocks = max(2, -(-total_bytes(docs, text_col) // bpe.BLOCK_BYTES))
    key = _ordinal(docs, id_col)
    cut = docs.select(F.percentile_approx(key, [k / blocks for k in range(1, blocks)], min(100 * blocks, 2**31 - 1))).first()[0] or []
    cut = np.array(sorted(set(cut)))

    @F.pandas_udf("long")
    def block_of(ids):
        import pandas as pd

        return pd.Series(np.where(ids.isna(), -1, np.searchsorted(cut, ids.fillna(0).to_numpy(), "right")))

    def finish(block, ids_of, offsets, texts, ends, ids):
        import pyarrow as pa

        keys = ids_of.to_pylist()
        text = lambda k: texts[offsets[k] : offsets[k + 1]]
        tied = len(set(keys)) < len(keys)
        order = sorted(range(len(keys)), key=lambda k: (keys[k] is not None, _sortable(keys[k]), text(k) if tied else b""))
        parts = [np.append(ids[ends[k] : ends[k + 1]], np.uint32(end_id)) for k in order]
        counts = np.array([len(p) for p in parts], np.int64)
        uri = f"{folder}/part-{block + 1:09d}.arrow"
        write_file(uri, np.concatenate(parts), sequence)
        return pa.table({"id": ids_of.take(pa.array(order)), "block": pa.array([block] * len(order), pa.int64()), "file": pa.array([uri] * len(order)), "first": pa.array(np.cumsum(counts) - counts), "n_tokens": pa.array(counts)})

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(block_of(key).alias("block"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    manifest = stash(bpe.by_block(rows, blocks, encoder, finish, f"id {kind}, block long, file string, first long, n_tokens long"), "manifest")
    from pyspark.sql import Window

    # one row per file, however many documents there are
    totals = manifest.groupBy("block").agg(F.sum("n_tokens").alias("n"))
    before = totals.select("block", (F.sum("n").over(Window.orderBy("block")) - F.col("n")).alias("before"))
    return manifest.join(before, "block").select(F.col("id").alias(id_col), "block", "file", "first", "n_tokens", (F.col("before") + F.col("first")).alias("start"))


def _sortable(x):
    return x.encode() if isinstance(x, str) else 0 if x is None else x


def _ordinal(docs: DataFrame, id_col: str):
    """A number in the order of the ids: numbers as they are, of strings the seven bytes after what all begin with."""
    if docs.schema[id_col].dataType.simpleString() != "string":
        return F.col(id_col)
    lo, hi = docs.agg(F.min(id_col), F.max(id_col)).first()
    lo, hi = (lo or "").encode(), (hi or "").encode()
    same = next((k for k, (a, b) in enumerate(zip(lo, hi)) if a != b), min(len(lo), len(hi)))
    part = F.substring(F.col(id_col).cast("binary"), same + 1, 7)
    return F.when(F.col(id_col).isNotNull(), F.conv(F.rpad(F.hex(part), 14, "0"), 16, 10).cast("long"))


def _make(folder: str) -> None:
    system, path = _filesystem(folder)
    system.create_dir(path, recursive=True)


def read(manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Each document's ids (array<int>) from the files."""
    kind = manifest.schema[id_col].dataType.simpleString()
    return _read(manifest, id_col, f"i {kind}, start long, n_tokens long, ids array<int>", lambda x: x.astype(np.int32).tolist()).withColumnRenamed("i", id_col)


def checksums(manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """CRC-32 of each document's ids, read back from the files, as little-endian 32-bit integers."""
    import zlib

    kind = manifest.schema[id_col].dataType.simpleString()
    return _read(manifest, id_col, f"i {kind}, start long, n_tokens long, ids_crc32 long", lambda x: zlib.crc32(x.astype("<u4").tobytes())).withColumnRenamed("i", id_col)


def _read(manifest: DataFrame, id_col: str, schema: str, of) -> DataFrame:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        name, opened = None, None
        for batch in trimmed(batches):
            got = []
            for file, first, n in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                if file != name:
                    name, opened = file, TokenFile(file)
                got.append(of(opened.ids(first, n)))
            last = pa.array(got, pa.list_(pa.int32()) if schema.endswith("array<int>") else pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(4), batch.column(3), last], names=["i", "start", "n_tokens", "x"][:3] + [schema.split()[-2]])

    return manifest.select(id_col, "file", "first", "n_tokens", "start").mapInArrow(run, schema)
