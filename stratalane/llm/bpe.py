"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

Documents are dealt into blocks. Each block's pre-tokens keep their positions and its distinct words go
to the task that owns them by hash; there each distinct word of the whole corpus is encoded once. The
ids come back to the block, are joined to the words and are put in order of position. Decoding joins
the token-byte table, which is as large as the vocabulary.

Words travel packed: one row per block and owner, in an order that both ends can rebuild. A corpus of over
GROUP_BLOCKS blocks (64 GB) is a row of such pools, each of which encodes its distinct words once.

Cases: a null or empty text has no ids; repeated rows give repeated results; very long texts are a block of their own
size; an empty table gives no rows; a text with characters that Unicode versions class differently is encoded whole by
the library; null ids are ids like any other; other columns are dropped, whatever their names.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import buffers, pieces, total_bytes, trim, trimmed
from .pretokens import cuts, dictionary

BLOCK_BYTES = 4 << 20
#: An odd multiplier (2**64 over the golden ratio), and bytes of the longest words that are hashed together.
MIX, LONG = np.uint64(0x9E3779B97F4A7C15), 64
#: Blocks whose distinct words are pooled, and blocks to an owner of words. A block so sends rows to GROUP_BLOCKS / SHARE owners at
#: most and an owner hears of GROUP_BLOCKS blocks at most: packed rows grow with the corpus, not with its square.
GROUP_BLOCKS, SHARE = 16384, 4


@functools.cache
def ranks(path: str) -> dict[bytes, int]:
    import base64

    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """How many ids each word has, and all of them end to end."""
    counts = np.fromiter(map(len, ids), np.int64, len(ids))
    return counts, np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(counts.sum()))


def _merged(counts: np.ndarray, flat: np.ndarray, more: dict[int, list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts and ids with those of the words `more`, which have none so far, put in their places."""
    ends = np.append(0, np.cumsum(counts))
    places = np.repeat(ends[list(more)], [len(x) for x in more.values()]) if more else []
    flat = np.insert(flat, places, list(itertools.chain.from_iterable(more.values()))) if more else flat
    for k, x in more.items():
        counts[k] = len(x)
    return counts, flat


class RankEncoder:
    """Encodes by a file of ranks, as tiktoken does."""

    def __init__(self, path: str, pattern: str):
        self.path, self.pattern = path, pattern

    @functools.cached_property
    def lib(self):
        import tiktoken

        return tiktoken.Encoding("own", pat_str=self.pattern, mergeable_ranks=ranks(self.path), special_tokens={})

    def __reduce__(self):
        return type(self), (self.path, self.pattern)

    def words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of words that the pattern doesn't cut."""
        encode = self.lib.encode_ordinary
        return [encode(w.decode()) for w in words]

    def flat(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return _flat(self.words(words))

    def text(self, text: str) -> list[int]:
        return self.lib.encode_ordinary(text)

    def whole(self, text: bytes) -> bool:
        """Whether the text's own strings stand for single ids, so that it can't be cut into words."""
        return False


class JsonEncoder:
    """Encodes by a tokenizer file of the tokenizers library; special tokens are found in texts, not added."""

    def __init__(self, path: str):
        self.path = path

    @functools.cached_property
    def lib(self):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    @functools.cached_property
    def special(self) -> list[bytes]:
        return [t.content.encode() for t in self.lib.get_added_tokens_decoder().values()]

    def __reduce__(self):
        return type(self), (self.path,)

    def words(self, words: list[bytes]) -> list[list[int]]:
        out = []
        for k in range(0, len(words), 20000):
            out += [x.ids for x in self.lib.encode_batch_fast([w.decode() for w in words[k : k + 20000]], add_special_tokens=False)]
        return out

    @functools.cached_property
    def newline(self) -> int | None:
        """The id that a line feed has, if it is one of its own."""
        k = self.lib.token_to_id("\u010a")  # its name in byte-level vocabularies
        return k if k is not None and self.text("\n") == [k] else None

    def flat(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Counts and ids of `words`, encoded as lines of about a hundred words, which costs less than half.

        The pattern cuts a line feed off any word but white space. Words of white space go alone, and so do all of a piece
        where a line feed isn't seen after each: the others hold none, so a full count says that none of them was taken up.
        """
        if self.newline is None:
            return _flat(self.words(words))
        lines = np.fromiter((not w.decode().isspace() and b"\n" not in w for w in words), bool, len(words))
        picked = np.flatnonzero(lines).tolist()
        counts, parts = np.zeros(len(words), np.int64), []
        for k in range(0, len(picked), 20000):
            some = [words[j] for j in picked[k : k + 20000]]
            texts = [b"\n".join([*some[j : j + 100], b""]).decode() for j in range(0, len(some), 100)]
            found = self.lib.encode_batch_fast(texts, add_special_tokens=False)
            ids = np.fromiter(itertools.chain.from_iterable(x.ids for x in found), np.uint32)
            at = np.flatnonzero(ids == self.newline)
            if len(at) == len(some):
                n, ids = np.diff(at, prepend=-1) - 1, ids[ids != self.newline]
            else:
                n, ids = _flat(self.words(some))
            counts[picked[k : k + 20000]] = n
            parts.append(ids)
        alone = np.flatnonzero(~lines).tolist()
        ids_of = dict(zip(alone, self.words([words[j] for j in alone])))
        return _merged(counts, np.concatenate([np.zeros(0, np.uint32), *parts]), ids_of)

    def text(self, text: str) -> list[int]:
        return self.lib.encode(text, add_special_tokens=False).ids

    def whole(self, text: bytes) -> bool:
        return any(s in text for s in self.special)


def _pack(*arrays: np.ndarray) -> bytes:
    """Unsigned arrays, each in the fewest bytes that its values need, compressed together."""
    import zstandard

    arrays = [a.astype(np.min_scalar_type(int(a.max()))) if a.itemsize > 1 and len(a) else a for a in arrays]
    head = np.array([[len(a), a.itemsize] for a in arrays], "<u4").tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(a.tobytes() for a in arrays))


def _unpack(blob: bytes, n: int) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    out, at = [], 8 * n
    for length, size in np.frombuffer(raw, "<u4", 2 * n).reshape(n, 2).tolist():
        out.append(np.frombuffer(raw, f"<u{size}", length, at))
        at += length * size
    return out


def _pack_rows(batches: Iterator) -> Iterator:
    """Rows (block, id, text) to one row per block and batch: the ids, and the texts compressed together."""
    import pyarrow as pa

    for batch in trimmed(batches):
        offsets, raw = buffers(batch.column(2))
        block = batch.column(0).to_numpy()
        order = np.argsort(block, kind="stable")
        heads = np.flatnonzero(np.concatenate([[True], np.diff(block[order]) != 0])) if len(order) else np.zeros(0, np.int64)
        stops = np.append(heads[1:], len(order))
        view = memoryview(np.ascontiguousarray(raw))
        lens = np.diff(offsets).astype("<u4")
        blobs = []
        for a, b in zip(heads.tolist(), stops.tolist()):
            rows = order[a:b]
            text = b"".join(view[offsets[k] : offsets[k + 1]] for k in rows.tolist())
            blobs.append(_pack(lens[rows], np.frombuffer(text, np.uint8)))
        ids = pa.ListArray.from_arrays(pa.array(np.append(heads, len(order)).astype(np.int32)), batch.column(1).take(pa.array(order)))
        yield pa.RecordBatch.from_arrays([pa.array(block[order[heads]]), ids, pa.array(blobs, pa.binary())], names=["block", "ids", "texts"])


def _unpack_rows(table):
    """Ids, offsets and bytes of the texts of a block, in the order of the packed rows."""
    got = [_unpack(x, 2) for x in table.column("texts").to_pylist()]
    lens = np.concatenate([x for x, _ in got]).astype(np.int64)
    ids = table.column("ids").combine_chunks()
    return ids.flatten(), np.append(0, np.cumsum(lens)), np.concatenate([x for _, x in got])


def _hashes(words) -> np.ndarray:
    """A 64-bit hash of each word's bytes, eight bytes at a time over all words; long ones one by one."""
    from xxhash import xxh3_64_intdigest as h

    ends, data = buffers(words)
    starts, lens = ends[:-1], np.diff(ends)
    pad = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", pad, strides=(1,))  # the eight bytes from each place on
    out = lens.astype(np.uint64) * MIX
    for at in range(0, LONG, 8):
        here = np.flatnonzero(lens > at)
        kept = np.minimum(lens[here] - at, 8).astype(np.uint64) * np.uint64(8)
        x = (out[here] ^ eight[starts[here] + at] << np.uint64(64) - kept) * MIX
        out[here] = x ^ x >> np.uint64(32)
    for k in np.flatnonzero(lens > LONG).tolist():
        out[k] = h(words[k].as_py())
    return out


def _owned(words, owners: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of a block's distinct words, and each one's owner, from the words alone."""
    hashed = _hashes(words)
    owner = ((hashed >> np.uint64(32)) * np.uint64(owners) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(hashed)  # and so by owners
    x = hashed[order]
    if (x[1:] == x[:-1]).any():  # two words of one hash: go by their bytes
        listed = words.to_pylist()
        order = np.array(sorted(range(len(listed)), key=lambda k: (hashed[k], listed[k])), np.int64)
    return order, owner


def _lists(flat: np.ndarray, counts: np.ndarray):
    """The ids of words, `counts` of `flat` each, as bytes: Arrow copies those word by word, which it doesn't with lists."""
    import pyarrow as pa

    ends = np.append(0, np.cumsum(counts, dtype=np.int64)) * 4
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(flat, "<u4"))])


def _gather(lists, at: np.ndarray) -> np.ndarray:
    """The ids of the words `at`, end to end."""
    import pyarrow as pa

    return buffers(lists.take(pa.array(at)))[1].view("<u4")


def _send(owners: int):
    def run(key, table):
        import pyarrow as pa

        trim()

        _, offsets, raw = _unpack_rows(table)
        starts, _ = cuts(offsets, raw)
        _, words = dictionary(starts, raw)
        order, owner = _owned(words, owners)
        ends, data = buffers(words.take(pa.array(order)))
        lens, who = np.diff(ends).astype("<u4"), owner[order]
        edges = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]])) if len(who) else np.zeros(0, np.int64)
        stops = np.append(edges[1:], len(who))
        first = key[0].as_py() // GROUP_BLOCKS * owners  # owners of the block's group
        blobs = [_pack(lens[a:b], data[ends[a] : ends[b]]) for a, b in zip(edges.tolist(), stops.tolist())]
        return pa.table({"block": pa.array(np.full(len(edges), key[0].as_py()), pa.int64()), "owner": pa.array(who[edges] + first, pa.int64()), "words": pa.array(blobs, pa.binary())})

    return run


def _encode(encoder):
    def run(key, table):
        import pyarrow as pa

        trim()

        blobs = [_unpack(x, 2) for x in table.column("words").to_pylist()]
        lens = [x for x, _ in blobs]
        raw = np.concatenate([x for _, x in blobs])
        sizes = np.concatenate(lens).astype(np.int64)
        codes, words = dictionary(np.cumsum(sizes) - sizes, raw)
        counts, flat = encoder.flat(words.to_pylist())
        ids = _lists(flat, counts)
        out, at = [], 0
        for x in lens:
            part = codes[at : at + len(x)]
            at += len(x)
            out.append(_pack(counts[part], _gather(ids, part)))
        return pa.table({"block": table.column("block"), "owner": table.column("owner"), "ids": pa.array(out, pa.binary())})

    return run


def _join(encoder, owners: int, finish: Callable):
    def run(key, left, right):
        trim()

        keys, offsets, raw = _unpack_rows(left)
        starts, odd = cuts(offsets, raw)
        codes, words = dictionary(starts, raw)
        order, _ = _owned(words, owners)
        got = [_unpack(x, 2) for _, x in sorted(zip(right.column("owner").to_pylist(), right.column("ids").to_pylist()))]
        none = np.zeros(0, np.int64)
        counts = np.concatenate([none, *(x.astype(np.int64) for x, _ in got)])
        if len(counts) != len(order):
            raise RuntimeError("the ids of a block don't fit its words")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        at = rank[codes]
        flat = _gather(_lists(np.concatenate([none, *(x for _, x in got)]), counts), at)
        ends = np.append(0, np.cumsum(counts[at]))[np.searchsorted(starts, offsets)]
        texts = raw.tobytes()
        for k in range(len(odd)):  # rare texts go through the library whole
            odd[k] = odd[k] or encoder.whole(texts[offsets[k] : offsets[k + 1]])
        if odd.any():
            each = [np.array(encoder.text(texts[offsets[k] : offsets[k + 1]].decode()), np.uint32) if odd[k] else flat[ends[k] : ends[k + 1]] for k in range(len(odd))]
            flat, ends = np.concatenate(each), np.append(0, np.cumsum([len(x) for x in each]))
        return finish(key[0].as_py(), keys, offsets, texts, ends.astype(np.int64), flat)

    return run


def by_block(docs: DataFrame, blocks: int, encoder, finish: Callable, schema: str) -> DataFrame:
    """docs(block, id, text) to what finish(block, keys, offsets, texts, ends, ids) makes of each block."""
    owners = max(4, min(blocks, GROUP_BLOCKS) // SHARE)
    kind = docs.schema["id"].dataType.simpleString()
    docs = docs.select("block", "id", "text").mapInArrow(_pack_rows, f"block long, ids array<{kind}>, texts binary")
    sent = docs.groupBy("block").applyInArrow(_send(owners), "block long, owner long, words binary")
    ids = sent.groupBy("owner").applyInArrow(_encode(encoder), "block long, owner long, ids binary")
    return docs.groupBy("block").cogroup(ids.groupBy("block")).applyInArrow(_join(encoder, owners, finish), schema)


def _listed(block, keys, offsets, texts, ends, ids):
    import pyarrow as pa

    return pa.table({"id": keys, "ids": pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)))})


def encode(docs: DataFrame, encoder, id_col: str = "doc_id", text_col: str = "text", then: Callable | None = None, schema: str = "ids array<int>") -> DataFrame:
    """(id, ids array<int>) of every row. `then` maps batches of these to others of `schema` in the same worker."""
    text = F.col(text_col).cast("string")
    blocks = max(2, -(-total_bytes(docs, text_col) // BLOCK_BYTES))
    docs = docs.select(F.pmod(F.xxhash64(F.col(id_col), text), F.lit(blocks)).alias("block"), F.col(id_col).alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    return by_block(docs, blocks, encoder, _finisher(then), f"id {kind}, {schema}").withColumnRenamed("id", id_col)


def _finisher(then: Callable | None) -> Callable:
    def finish(*block):
        import pyarrow as pa

        table = _listed(*block)
        return pa.Table.from_batches(list(then(table.combine_chunks().to_batches()))) if then and table.num_rows else table

    return finish


@functools.cache
def token_bytes(path: str):
    """The token-byte table: bytes of each id."""
    import pyarrow as pa

    found = ranks(path)
    table = [b""] * (max(found.values()) + 1)
    for x, k in found.items():
        table[k] = x
    return pa.array(table, pa.large_binary())


def _slices(batch, ids_col: int, most: int = 1 << 20):
    """The rows of a batch in slices of about `most` ids."""
    lens = batch.column(ids_col).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    for a, b in pieces(np.append(0, np.cumsum(lens)), most):
        yield batch.slice(a, b - a), lens[a:b]


def decoder(path: str, ids_col: str, out_col: str) -> Callable:
    """Batches of rows with ids to the same rows with their decoded bytes."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        table = token_bytes(path)
        for whole in trimmed(batches):
            at = whole.schema.get_field_index(ids_col)
            for batch, lens in _slices(whole, at):
                ends, raw = buffers(table.take(batch.column(at).flatten()))
                marks = np.append(0, np.cumsum(lens))
                text = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lens), [None, pa.py_buffer(ends[marks]), pa.py_buffer(np.ascontiguousarray(raw))])
                yield pa.RecordBatch.from_arrays([*batch.columns, text.cast(pa.binary())], names=[*batch.schema.names, out_col])

    return run


def decode(tokens: DataFrame, path: str, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """Adds the decoded bytes to rows of ids; the table of a token's bytes has the vocabulary's fixed size."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema.fields) + f", `{out_col}` binary"
    return tokens.mapInArrow(decoder(path, ids_col, out_col), schema)


def _digest(batches: Iterator) -> Iterator:
    import hashlib

    import pyarrow as pa

    decimal = pa.array([], pa.large_binary())
    for whole in trimmed(batches):
        for batch, lens in _slices(whole, 1):
            flat = batch.column(1).flatten().to_numpy()
            top = int(flat.max()) + 1 if len(flat) else 0
            if top > len(decimal):
                decimal = pa.array([b"%d " % k for k in range(top)], pa.large_binary())
            ends, raw = buffers(decimal.take(pa.array(flat)))
            marks = ends[np.append(0, np.cumsum(lens))]
            view = memoryview(np.ascontiguousarray(raw))
            hexed = [hashlib.sha256(view[a : max(a, b - 1)]).hexdigest() for a, b in zip(marks[:-1].tolist(), marks[1:].tolist())]
            ends, raw = buffers(batch.column(2))
            view = memoryview(np.ascontiguousarray(raw))
            text = [hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lens), pa.array(hexed), pa.array(text)], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])


DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def digester(path: str) -> Callable:
    """Batches (id, ids) to the id, n_tokens and SHA-256 of the ids' decimals and of the bytes that they decode to.

    Decoding and hashing take turns slice by slice."""
    decoded = decoder(path, "ids", "text")
    return lambda batches: _digest(decoded(batches))


def digests(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The digests of rows of ids."""
    kind = tokens.schema[id_col].dataType.simpleString()
    return tokens.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(digester(path), f"id {kind}, {DIGESTS}").withColumnRenamed("id", id_col)
