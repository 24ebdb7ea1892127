"""Encoding and decoding of columns as frames: a row per column and block.

encode() shuffles rows once on the block, in a few groups of columns, and runs the kernels on each block's columns;
decode() needs no shuffle, as a frame is a row; restore() gives the table with its types back, by one shuffle of frames.
Frames carry smallest and largest lane, null counts and a CRC, so that readers can skip and check.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import BY_ID, BY_NAME, FRAME_BYTES, LIMBS, MAX_BLOCK, PENALTY, REGION, BadMagic, Config, CorruptPayload, FrameError, KindMismatch, LengthMismatch, Truncated, UnknownMode, UnsupportedKind, UnsupportedVersion, allowed
from ..plans.blocks import LANES
from ..plans.work import batched
from . import arrays, kernels, limbs
from .coding import U, bit_len, order1_bytes, unvarints, varints, zigzag

SCHEMA = "col string, kind string, block long, mode int, n int, nulls int, first long, payload binary, validity binary, lo long, hi long, crc long"
#: Columns are encoded in so many groups side by side, each with a shuffle of its own columns and the position.
GROUPS = 8
#: Entropy-coded or predicted encodings are tried from these levels on.
_ENTROPY = ("balanced", "high", "max")
#: Encodings whose structure a sample with gaps doesn't show: they compete on whole blocks.
_WHOLE = ("CONST", "STRIDE", "LZ", "NUM")


def kind_of(name: str, log2: int = 16) -> kernels.Kind:
    return kernels.Kind(*LANES[name], log2)


def profile(x: np.ndarray) -> tuple[int, bool, bool]:
    """Exponent range, few distinct values (on a strided sample of hash buckets), mostly repeats."""
    if not len(x):
        return 0, True, False
    e = (x >> U(52)) & U(0x7FF)
    sample = x[:: max(len(x) // 4096, 1)]
    buckets = len(np.unique((sample * U(0x9E3779B97F4A7C15)) >> U(50)))
    equal = 1 + int((x[1:] == x[:-1]).sum())
    return int(e.max() - e.min()), buckets < 2048, 2 * equal > len(x)


def noise(x: np.ndarray, kind: kernels.Kind, low: bool, repeats: bool) -> bool:
    """Integers that fill their type in values and differences: nothing packs them."""
    if kind.family == "float" or low or repeats or len(x) < 256:
        return False
    step = max(len(x) // 2048, 1)
    at = np.arange(step, len(x), step)
    v = np.concatenate([x[:1], x[at]])
    width = int(bit_len((v.max() - v.min())[None])[0])
    moved = int(bit_len(zigzag(x[at] - x[at - 1]).max()[None])[0])
    return min(width, moved) >= 8 * kind.bytes - 4


def _score(size: int, mode: str, n: int, kind: kernels.Kind, level: str) -> int:
    return size + ((PENALTY[level] * BY_NAME[mode].weight * n * kind.bytes) >> 8)


def sample_of(x: np.ndarray) -> np.ndarray:
    """Eight runs of 64 values, spread over the block."""
    if len(x) <= 512:
        return x
    return np.concatenate([x[r * (len(x) - 64) // 7 :][:64] for r in range(8)])


def choose(x: np.ndarray, kind: kernels.Kind, cfg: Config) -> tuple[str, bytes]:
    """The encoding of a block with the least score, and its payload; earlier ones win ties."""
    level, n = cfg.level, len(x)
    entropy, penalty, matches = level in _ENTROPY, PENALTY[level], level == "max"
    raw = kernels.encode("RAW", x, kind)
    best = ("RAW", raw, _score(len(raw), "RAW", n, kind, level))
    exp_range, low, repeats = profile(x)
    if not n:
        return best[:2]
    modes = allowed(level, kind.family)
    if cfg.selection == "sample":
        return _sampled(x, kind, cfg, modes, best, low or repeats)
    if noise(x, kind, low, repeats):
        return best[:2]
    top, compressible = [], None
    for m in modes:
        if m.name == "RAW":
            continue
        if m.name in ("LZ", "TRANSPOSE", "DICT", "RLE"):
            if compressible is None:  # settled by the encodings before these
                compressible = _saves(len(best[1]), n)
            if not compressible:
                continue
        if m.name == "LZ" and not (penalty == 0 or low or repeats) or m.name == "TRANSPOSE" and not (exp_range <= 64 or repeats):
            continue
        if kernels.KERNELS[m.name][2] and m.name != "TRANSPOSE":
            plain = kernels.KERNELS[m.name][0](x, kind)
            if plain is None or not _saves(len(plain), n) or penalty == 0 and 0.9 * order1_bytes(plain) >= best[2]:
                continue
        got = kernels.encode(m.name, x, kind, penalty, False, entropy)
        if got is None:
            continue
        score = _score(len(got), m.name, n, kind, level)
        top.append((score, m.seq, m.name))
        if score < best[2]:
            best = (m.name, got, score)
    if matches:  # the two best once more with a match search before the coder
        for _, _, name in sorted(top)[:2]:
            got = kernels.encode(name, x, kind, penalty, True, entropy)
            if got is not None and len(got) < len(best[1]):
                best = (name, got, len(got))
    return best[:2]


def _saves(size: int, n: int) -> bool:
    """Whether bytes are under 95 % of 8 a value."""
    return 20 * size < 19 * 8 * n


def _sampled(x, kind, cfg: Config, modes, best, repetitive: bool) -> tuple[str, bytes]:
    """Structure of whole blocks is tried on them; of the other encodings the one with the smallest payload of a sample
    is tried on the block, and wins if its score there is the least."""
    entropy, penalty, matches = cfg.level in _ENTROPY, PENALTY[cfg.level], cfg.level == "max"

    def consider(name: str) -> None:
        nonlocal best
        got = kernels.encode(name, x, kind, penalty, matches, entropy)
        if got is not None and (score := _score(len(got), name, len(x), kind, cfg.level)) < best[2]:
            best = (name, got, score)

    for m in modes:
        if m.name in _WHOLE and (m.name != "LZ" or repetitive):
            consider(m.name)
    part, guesses = sample_of(x), []
    for m in modes:
        if m.name != "RAW" and m.name not in _WHOLE:
            got = kernels.encode(m.name, part, kind, penalty, False, entropy)
            guesses += [] if got is None else [(len(got), m.seq, m.name)]
    if guesses:
        consider(min(guesses)[2])
    return best[:2]


def pack_validity(valid: np.ndarray) -> bytes | None:
    """Bitmap or run lengths, whichever is shorter; nothing if all are valid."""
    if valid.all():
        return None
    heads = np.flatnonzero(np.concatenate([[True], valid[1:] != valid[:-1]]))
    lens = np.diff(np.append(heads, len(valid)))
    runs = varints(np.concatenate([[0], lens]) if valid[0] else lens)
    bits = np.packbits(valid, bitorder="little").tobytes()
    return b"\1" + runs if len(runs) < len(bits) else b"\0" + bits


def unpack_validity(raw: bytes | None, n: int) -> np.ndarray:
    if raw is None:
        return np.ones(n, bool)
    if raw[:1] == b"\0" and len(raw) >= 1 + -(-n // 8):
        return np.unpackbits(np.frombuffer(raw, np.uint8, -1, 1), count=n, bitorder="little").astype(bool)
    if raw[:1] == b"\1":
        lens, _ = unvarints(raw, int((np.frombuffer(raw, np.uint8, -1, 1) < 128).sum()), 1)
        if int(lens.sum()) == n and (not n or int(lens.max()) <= n):
            return np.repeat(np.arange(len(lens)) % 2 == 1, lens.astype(np.int64))
    raise FrameError("bad validity")


def plan_adaptive(x: np.ndarray) -> list[tuple[int, int]]:
    """Block bounds: 32768 values, or 131072 from a stretch on that has few distinct values or repeats."""
    out, at = [], 0
    while at < len(x):
        _, low, repeats = profile(x[at : at + REGION])
        end = min(len(x), at + (MAX_BLOCK if low or repeats else REGION))
        out.append((at, end))
        at = end
    return out


def _frames_of(name: str, kind_name: str, pos: np.ndarray, x: np.ndarray, valid: np.ndarray, cfg: Config, forced: str | None, strict: bool) -> Iterator[tuple]:
    """The frames of one column's stretch of positions."""
    wide = x.ndim == 2
    kind = kernels.Kind("int", 8, False, cfg.predictor_log2) if wide else kind_of(kind_name, cfg.predictor_log2)

    def one(part):
        if not forced:
            mode, payload = choose(part, kind, cfg)
            return BY_NAME[mode].id, payload
        got = kernels.encode(forced, part, kind, PENALTY[cfg.level], cfg.level == "max", cfg.level in _ENTROPY, whole=strict)
        if got is None:
            if strict and len(part):
                raise CorruptPayload(f"{forced} doesn't fit {name}, block from {pos[0]}")
            return BY_NAME["RAW"].id, kernels.encode("RAW", part, kind)
        return BY_NAME[forced].id, got

    cuts = [0, len(x)]
    if cfg.block_size is None:
        rank = np.cumsum(valid)
        cuts = [0, *(int(np.searchsorted(rank, b, "left")) + 1 for _, b in plan_adaptive((x[:, 0] if wide else x)[valid]))]
        cuts[-1:] = [len(x)] if len(cuts) > 1 else [0, len(x)]
    for a, b in zip(cuts, cuts[1:]):
        ok = valid[a:b]
        part = x[a:b][ok]
        mode, payload = (LIMBS, limbs.encode(part, one)) if wide else one(part)
        s = part.view(np.int64) if not wide else part[:0, 0]
        yield name, kind_name, int(pos[a]), mode, len(part), int((~ok).sum()), int(pos[a]), payload, pack_validity(ok), int(s.min()) if len(s) else None, int(s.max()) if len(s) else None, zlib.crc32(payload)


def _blocks(columns: Sequence[tuple[str, str]], cfg: Config, forced: str | None, strict: bool):
    def run(table):
        import pyarrow as pa

        pos = table.column("pos").to_numpy()
        order = None if (pos[1:] > pos[:-1]).all() else np.argsort(pos, kind="stable")
        pos = pos if order is None else pos[order]
        rows = []
        for k, (name, kind_name) in enumerate(columns):
            x, valid = arrays.lanes(table.column(f"c{k}"), kind_name)
            if order is not None:
                x, valid = x[order], valid[order]
            rows += _frames_of(name, kind_name, pos, x, valid, cfg, forced, strict)
        names = ["col", "kind", "block", "mode", "n", "nulls", "first", "payload", "validity", "lo", "hi", "crc"]
        types = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        return pa.table({k: pa.array(c, t) for k, c, t in zip(names, zip(*rows), types)})

    return run


def encode(df: DataFrame, columns: Sequence[str], cfg: Config = Config(), pos: str = "pos", forced: str | None = None, strict: bool = False) -> DataFrame:
    """Frames of the columns of df, whose rows are in the order of `pos` (dense from 0).

    Adaptive blocks are planned within stretches of 131072 positions; fixed ones are `block_size` positions. Decimals
    and 32-byte binaries (256-bit integers, lowest byte first) are stored as limbs. df is read once per group of columns.
    `forced` names an encoding to use wherever it fits; RAW stands in elsewhere. With `strict` nothing stands in: encodings that
    hold any block are used where they save nothing too, and a block that the others don't fit is an error."""
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    for c in columns:
        arrays.limbs_of(types[c])
    df = batched(df)
    size, groups = cfg.block_size or MAX_BLOCK, min(len(columns), GROUPS)
    parts = []
    for k in range(groups):
        mine = list(columns)[k::groups]
        rows = df.select(F.expr(f"`{pos}` div {size}").alias("block"), F.col(pos).cast("long").alias("pos"), *(F.col(c).alias(f"c{j}") for j, c in enumerate(mine)))
        parts.append(rows.groupBy("block").applyInArrow(_blocks([(c, types[c]) for c in mine], cfg, forced, strict), SCHEMA))
    return reduce(DataFrame.union, parts)


def open_frame(f: dict) -> tuple[np.ndarray, np.ndarray]:
    """Lanes (or rows of limbs) of a frame, zero where null, and which are valid; anything wrong raises FrameError."""
    if zlib.crc32(f["payload"]) != f["crc"]:
        raise CorruptPayload(f"checksum of {f['col']}, block {f['block']}")
    wide = arrays.limbs_of(f["kind"])
    if wide:
        if f["mode"] != LIMBS:
            raise UnknownMode(f"{f['kind']} with encoding {f['mode']}")
        kind = kernels.Kind("int", 8, False)
        dense = limbs.decode(f["payload"], f["n"], lambda mode, raw, n: kernels.decode(mode, raw, n, kind))
        if dense.shape[1] != wide:
            raise CorruptPayload("bad number of limbs")
    elif f["mode"] not in BY_ID:
        raise UnknownMode(f"unknown encoding {f['mode']}")
    else:
        dense = kernels.decode(BY_ID[f["mode"]].name, f["payload"], f["n"], kind_of(f["kind"]))
    if not f["nulls"]:
        return dense, np.ones(len(dense), bool)
    ok = unpack_validity(f["validity"], f["n"] + f["nulls"])
    if int(ok.sum()) != f["n"]:
        raise LengthMismatch("validity doesn't fit")
    x = np.zeros((len(ok), *dense.shape[1:]), U)
    x[ok] = dense
    return x, ok


def rows_of(f: dict, permissive: bool = False):
    """A frame's rows as a batch (col, kind, pos, lane, value, error)."""
    import pyarrow as pa

    error = None
    try:
        if f["kind"] not in LANES:
            raise KindMismatch(f"{f['kind']} has no lane: use restore()")
        x, ok = open_frame(f)
    except FrameError as e:
        if not permissive:
            raise
        error, x, ok = str(e), np.zeros(1, U), np.zeros(1, bool)
    n, mask = len(x), None if ok.all() else ~ok
    floats = f["kind"] in ("double", "float")
    text = lambda v: pa.repeat(pa.scalar(v, pa.string()), n)
    value = pa.array(x.view(np.float64), mask=mask) if floats else pa.nulls(n, pa.float64())
    out = [text(f["col"]), text(f["kind"]), pa.array(f["first"] + np.arange(n)), pa.array(x.view(np.int64), mask=mask), value, text(error)]
    return pa.RecordBatch.from_arrays(out, names=["col", "kind", "pos", "lane", "value", "error"])


def decode(frames: DataFrame, permissive: bool = False) -> DataFrame:
    """(col, kind, pos, lane, value, error): value is the double of float columns. Bad frames raise, or give one row with an error.

    Rows of a frame are in order of position; frames come in any order, so sort by (col, pos) where order matters."""

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            for k in range(batch.num_rows):  # one frame at a time: payloads aren't copied all at once
                yield rows_of(batch.slice(k, 1).to_pylist()[0], permissive)

    return batched(frames).mapInArrow(run, "col string, kind string, pos long, lane long, value double, error string")


def restore(frames: DataFrame, schema: T.StructType | str, pos: str = "pos") -> DataFrame:
    """The table again: (pos, columns of `schema` with their types), from frames of these columns.

    Frames of one stretch of positions meet in a task; a column stored as another type than asked for raises KindMismatch."""
    fields = (T._parse_datatype_string(schema) if isinstance(schema, str) else schema).fields
    want = [(f.name, f.dataType.simpleString()) for f in fields if f.name != pos]

    def run(table):
        import pyarrow as pa

        parts: dict[str, list] = {}
        for f in table.to_pylist():
            parts.setdefault(f["col"], []).append(f)
        out, firsts = {}, None
        for name, kind in want:
            mine = sorted(parts.get(name, []), key=lambda f: f["first"])
            for f in mine:
                if f["kind"] != kind:
                    raise KindMismatch(f"{name} is {f['kind']}, not {kind}")
            found = [open_frame(f) for f in mine]
            at = np.concatenate([f["first"] + np.arange(len(x)) for f, (x, _) in zip(mine, found)] or [np.zeros(0, np.int64)])
            if firsts is not None and not np.array_equal(at, firsts):
                raise LengthMismatch(f"positions of {name} differ from those of {want[0][0]}")
            firsts = at
            out[name] = arrays.values(np.concatenate([x for x, _ in found]), np.concatenate([ok for _, ok in found]), kind)
        return pa.table({pos: pa.array(firsts), **out})

    ddl = T.StructType([T.StructField(pos, T.LongType()), *(f for f in fields if f.name != pos)])
    mine = frames.where(F.col("col").isin([c for c, _ in want])).withColumn("_stretch", F.expr(f"first div {MAX_BLOCK}"))
    return batched(mine).groupBy("_stretch").applyInArrow(run, ddl)


def compress(df: DataFrame, column: str, cfg: Config = Config(), pos: str = "pos") -> DataFrame:
    """Frames of one column of doubles."""
    if dict(df.dtypes)[column] != "double":
        raise KindMismatch(f"{column} is {dict(df.dtypes)[column]}, not double")
    return encode(df, [column], cfg, pos)


def decompress(frames: DataFrame, column: str, pos: str = "pos") -> DataFrame:
    """(pos, column) of frames of doubles; frames of another type raise KindMismatch."""
    return restore(frames, f"`{column}` double", pos)


def length(frames: DataFrame) -> DataFrame:
    """Rows of each column, from the frames' headers alone."""
    return frames.groupBy("col").agg(F.sum(F.col("n") + F.col("nulls")).alias("rows"))


def skipping(frames: DataFrame, lo: int, hi: int) -> DataFrame:
    """Frames that may hold lanes between lo and hi (signed kinds)."""
    return frames.where((F.col("hi") >= lo) & (F.col("lo") <= hi))


def histogram(frames: DataFrame) -> DataFrame:
    """How often each encoding won."""
    names = F.create_map(*[F.lit(x) for i, m in BY_ID.items() for x in (i, m.name)], F.lit(LIMBS), F.lit("LIMBS"))
    return frames.groupBy(names[F.col("mode")].alias("mode")).agg(F.count("*").alias("blocks"), F.sum(F.length("payload")).alias("bytes"))


MAGIC = b"SLN2"
_NULLS = 1
_KINDS = [*LANES]


def header(kind: str, rows: int, nulls: bool) -> bytes:
    """Magic, version, flags, context bits, type and row count."""
    if kind not in _KINDS:
        raise UnsupportedKind(f"a stream has no room for {kind}")
    return struct.pack("<4sBBBBQ", MAGIC, 2, _NULLS if nulls else 0, 16, _KINDS.index(kind), rows)


def frame_bytes(f: dict, nulls: bool) -> bytes:
    """Encoding, count, length and payload of a frame; in streams with nulls also its null count and validity."""
    out = struct.pack("<BII", f["mode"], f["n"], len(f["payload"])) + bytes(f["payload"])
    if nulls:
        valid = bytes(f["validity"] or b"")
        out += struct.pack("<II", f["nulls"], len(valid)) + valid
    return out


def to_bytes(rows: list[dict]) -> bytes:
    """One column's frames as a stream of bytes, in order."""
    rows = sorted(rows, key=lambda r: r["first"])
    nulls = any(r["nulls"] for r in rows)
    head = header(rows[0]["kind"] if rows else "double", sum(r["n"] + r["nulls"] for r in rows), nulls)
    return head + b"".join(frame_bytes(r, nulls) for r in rows)


def from_bytes(raw: bytes) -> list[dict]:
    """The frames of a stream (kind, mode, n, nulls, first, payload, validity); anything else raises FrameError."""
    if len(raw) < 16:
        raise Truncated("truncated header")
    magic, version, flags, log2, kind, total = struct.unpack("<4sBBBBQ", raw[:16])
    if magic != MAGIC:
        raise BadMagic("bad magic")
    if version != 2:
        raise UnsupportedVersion(f"version {version}")
    if flags & ~_NULLS or not 10 <= log2 <= 16:
        raise CorruptPayload("bad header")
    if kind >= len(_KINDS):
        raise UnsupportedKind(f"type {kind}")
    out, at, first = [], 16, 0

    def take(size: int) -> bytes:
        nonlocal at
        if at + size > len(raw):
            raise Truncated("truncated frame")
        at += size
        return raw[at - size : at]

    while at < len(raw):
        mode, n, size = struct.unpack("<BII", take(FRAME_BYTES))
        if mode not in BY_ID:
            raise UnknownMode(f"unknown encoding {mode}")
        if n > MAX_BLOCK:
            raise CorruptPayload("impossible block length")
        payload, nulls, valid = take(size), 0, b""
        if flags & _NULLS:
            nulls, size = struct.unpack("<II", take(8))
            valid = take(size)
        out.append({"col": "", "kind": _KINDS[kind], "block": first, "mode": mode, "n": n, "nulls": nulls, "first": first, "payload": payload, "validity": valid or None, "crc": zlib.crc32(payload)})
        first += n + nulls
    if first != total:
        raise LengthMismatch(f"{total} rows in the header, {first} in the frames")
    return out


def stream_parts(frames: DataFrame) -> DataFrame:
    """(col, first, part): a header (first -1) and a part per frame; a column's parts in order of `first` are its stream.

    No value holds a whole column, so that columns of any size can be written."""
    totals = batched(frames).groupBy("col", "kind").agg(F.sum(F.col("n") + F.col("nulls")).alias("rows"), (F.sum("nulls") > 0).alias("any"))

    def heads(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = batch.to_pylist()
            yield pa.RecordBatch.from_pylist([{"col": r["col"], "first": -1, "part": header(r["kind"], r["rows"], r["any"])} for r in rows], pa.schema([("col", pa.string()), ("first", pa.int64()), ("part", pa.binary())]))

    def bodies(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = batch.to_pylist()
            yield pa.RecordBatch.from_pylist([{"col": r["col"], "first": r["first"], "part": frame_bytes(r, r["any"])} for r in rows], pa.schema([("col", pa.string()), ("first", pa.int64()), ("part", pa.binary())]))

    schema = "col string, first long, part binary"
    return totals.mapInArrow(heads, schema).union(frames.join(totals.select("col", "any"), "col").mapInArrow(bodies, schema))


def register(spark: SparkSession) -> None:
    """frame_encode(mode, kind, lanes) and frame_decode(mode, kind, payload, n) for SQL; null where an encoding doesn't fit."""
    import pyarrow as pa

    def frame_encode(mode: pa.Array, kind: pa.Array, lanes: pa.Array) -> pa.Array:
        rows = zip(mode.to_pylist(), kind.to_pylist(), lanes.to_pylist())
        return pa.array([None if x is None else kernels.encode(m, np.array(x, np.int64).view(U), kind_of(k), 2, False, True) for m, k, x in rows], pa.binary())

    def frame_decode(mode: pa.Array, kind: pa.Array, payload: pa.Array, n: pa.Array) -> pa.Array:
        rows = zip(mode.to_pylist(), kind.to_pylist(), payload.to_pylist(), n.to_pylist())
        return pa.array([None if x is None else kernels.decode(m, x, size, kind_of(k)).view(np.int64) for m, k, x, size in rows], pa.list_(pa.int64()))

    for f, returns in ((frame_encode, "binary"), (frame_decode, "array<long>")):
        f.__annotations__ = {k: pa.Array for k in f.__annotations__}
        spark.udf.register(f.__name__, F.arrow_udf(f, returns))
