"""Line dedup by content-defined chunks of lines.

A text's lines are hashed, and a rolling hash over the last two line hashes ends a chunk where it falls
on one value in `divisor`; boundaries so depend on nearby lines alone and find each other again when
lines before them are added or removed. Chunks of several lines that occur more than once in the corpus
are compared byte by byte, and all but the first occurrence (smallest id, then text hash, then chunk) go.

With `passages`, which op6 and the pipeline use, every place of the rolling hash is taken instead of one in
`divisor`: each two lines in a row that aren't blank, with the blank ones between them, are a chunk, and so is
a line of over LONG_WORDS words by itself. A repeated passage goes from its first to its last line then, as
its chunks overlap, whatever lines are around it. A line goes only if an earlier place has it too, so the
first occurrence of every line stays. Blank lines around stay, unless no other line does.

Cases: a null text stays null and an empty one empty; a chunk of a divisor counts only with at least two lines
that aren't blank; of a line that repeats in a row, passages keep one; null ids come last; rows that repeat as a whole are one document, which keeps or loses its
chunks in each row; other columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import M64, arrow_udf, buffers, stash, trim, trimmed

WINDOW_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Bits of the filter by which chunks that occur once mostly stay out of the exchange of texts.
FILTER_BITS = 1 << 26
#: A line of more words is a passage by itself.
LONG_WORDS = 50


def chunks(lines: list[bytes], divisor: int) -> list[tuple[int, int]]:
    """(first, end) of the chunks of a list of lines."""
    from xxhash import xxh64_intdigest as h

    out, first, before = [], 0, 0
    a, b = WINDOW_FACTORS
    for k, line in enumerate(lines):
        now = h(line)
        rolling = (before * a + now * b) & M64
        before = now
        if (rolling >> 32) % divisor == 0:
            out.append((first, k + 1))
            first = k + 1
    if first < len(lines):
        out.append((first, len(lines)))
    return out


def _several(lines: list[bytes]) -> bool:
    return sum(1 for x in lines if x.strip()) > 1


def spans(lines: list[bytes], divisor: int, passages: bool) -> list[tuple[int, int]]:
    """(first, end) of the stretches of lines that are compared."""
    if not passages:
        return [(x, y) if y - x > 1 and _several(lines[x:y]) else (x, x) for x, y in chunks(lines, divisor)]
    full = [k for k, x in enumerate(lines) if x.strip()]
    long = [(k, k + 1) for k in full if len(lines[k]) > 2 * LONG_WORDS and len(lines[k].split()) > LONG_WORDS]
    return [(x, y + 1) for x, y in zip(full, full[1:])] + long


def _filter(keys: DataFrame) -> np.ndarray:
    """A bit for the first bytes of each key: of fixed size, so that very many keys only pass more."""
    bit = F.conv(F.hex(F.substring("key", 1, 4)), 16, 10).cast("long") % FILTER_BITS
    word = keys.select(bit.alias("bit")).select(F.expr("bit div 64").alias("word"), F.expr("shiftleft(1L, cast(bit % 64 as int))").alias("bits"))
    got = word.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    return out.view(np.uint8)


def _chunk_rows(divisor: int, passages: bool, bits=None):
    with_text = bits is not None

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from xxhash import xxh3_128_digest as digest

        marked = bits.value.tobytes() if with_text else b""
        for batch in trimmed(batches):
            offsets, raw = buffers(batch.column(2))
            raw = raw.tobytes()
            row, no, keys, texts = [], [], [], []
            for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                lines = raw[a:b].split(b"\n")
                for c, (x, y) in enumerate(spans(lines, divisor, passages)):
                    if y > x:
                        text = b"\n".join(lines[x:y])
                        key = digest(text)
                        if with_text:
                            bit = int.from_bytes(key[:4], "big") % FILTER_BITS
                            if not marked[bit >> 3] >> (bit & 7) & 1:
                                continue
                            texts.append(text)
                        row.append(k)
                        no.append(c)
                        keys.append(key)
            at = pa.array(row, pa.int64())
            out = {"key": pa.array(keys, pa.binary()), "id": batch.column(0).take(at), "h": batch.column(1).take(at), "no": pa.array(no, pa.int32())}
            if with_text:
                out["chunk"] = pa.array(texts, pa.binary())
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return run


def repeats(docs: DataFrame, divisor: int, passages: bool, id_col: str, text_col: str) -> DataFrame:
    """(id, h, no): chunks to remove."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("h"), F.col(text_col).cast("string").alias("t"))
    found = rows.mapInArrow(_chunk_rows(divisor, passages), f"key binary, id {kind}, h long, no int")
    # of equal rows of a document one counts
    where = F.struct(F.col("id").isNull().alias("z"), "id", "h", "no")
    twice = found.groupBy("key").agg(F.min(where).alias("a"), F.max(where).alias("b")).where("a <> b").select("key")
    twice = stash(twice, "twice")
    bits = docs.sparkSession.sparkContext.broadcast(_filter(twice))
    found = rows.mapInArrow(_chunk_rows(divisor, passages, bits), f"key binary, id {kind}, h long, no int, chunk binary")
    found = stash(found.join(twice, "key", "left_semi"), "chunks")
    # grouping by the chunk itself compares bytes; the digest only deals them out
    first = found.groupBy("key", "chunk").agg(F.min(where).alias("first"))
    first = stash(first, "first")
    gone = found.join(first, ["key", "chunk"]).where(where != F.col("first"))
    return stash(gone.select("id", "h", "no").distinct(), "gone")


def _cut(divisor: int, passages: bool):
    @arrow_udf("struct<text:string,n_lines:bigint,n_removed:bigint>")
    def cut(text, gone):
        import pyarrow as pa

        texts, n_lines, n_removed = [], [], []
        for t, g in zip(text.to_pylist(), gone.to_pylist()):
            lines = [] if t is None else t.encode().split(b"\n")
            removed = 0
            if g:
                found, out = spans(lines, divisor, passages), bytearray(len(lines))
                for x, y in map(found.__getitem__, g):
                    out[x:y] = b"\1" * (y - x)
                kept = [x for x, o in zip(lines, out) if not o]
                if passages and not any(x.strip() for x in kept):
                    kept = []
                removed = len(lines) - len(kept)
                t = b"\n".join(kept).decode()
            texts.append(t)
            n_lines.append(len(lines))
            n_removed.append(removed)
        trim()
        return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64())], names=["text", "n_lines", "n_removed"])

    return cut


def dedup(docs: DataFrame, divisor: int = 3, id_col: str = "doc_id", text_col: str = "text", passages: bool = False) -> DataFrame:
    """(row, cut): each row as a struct with its text cut, and cut.n_lines, cut.n_removed."""
    gone = repeats(docs, divisor, passages, id_col, text_col)
    listed = gone.groupBy(F.col("id").alias("_i"), F.col("h").alias("_h")).agg(F.collect_list("no").alias("_gone"))
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64(F.col(text_col)).alias("h"))
    # always by shuffle: a list that is small today is broadcast, and the plan would change with the corpus
    rows = rows.join(listed.hint("merge"), F.col("row")[id_col].eqNullSafe(listed["_i"]) & (rows["h"] == listed["_h"]), "left")
    rows = rows.select("row", _cut(divisor, passages)(F.col("row")[text_col].cast("string"), F.col("_gone")).alias("cut"))
    return rows.select(F.col("row").withField(text_col, F.col("cut.text")).alias("row"), "cut")


def clean(docs: DataFrame, **options) -> DataFrame:
    """The documents, with their columns, less the repeated chunks or passages."""
    return dedup(docs, **options).select("row.*")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    found = dedup(docs, id_col=id_col, text_col=text_col, **options)
    text = F.coalesce(F.col("row")[text_col], F.lit(""))
    return found.select(F.col("row")[id_col].alias(id_col), "cut.n_lines", "cut.n_removed", F.length(text).cast("long").alias("n_kept_chars"), F.sha2(text, 256).alias("kept_sha256"))
