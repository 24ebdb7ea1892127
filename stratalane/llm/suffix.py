"""Suffix-array dedup: remove every byte covered by a string of `length` bytes that also starts elsewhere.

A window's minimizer is the `gram` bytes in it with the smallest hash; equal windows have equal ones. Runs
of window starts with one minimizer are counted over the corpus; only runs whose minimizer occurs again can
hold a repeated window. Their bytes go to the shard of the minimizer, so that equal windows meet.
A shard folds equal byte runs, sorts the windows of the others with a suffix array (Larsson-Sadakane
refinement in numpy, from 8 bytes on) and takes common prefixes by Kasai's walk. A shard larger than
`SHARD_BYTES` is sorted in parts, merged by binary search of the windows of one part in another.
A minimizer of very many runs is split by the offset of the minimizer in its window, which equal windows share.

Cases: null texts are empty; texts shorter than a window have none; a repeated row is a document of its
own, so its windows do start elsewhere; windows are judged on the input and overlaps count; null ids are ids like any
other; very long texts are cut into slices that overlap by a window; an empty table gives no rows; ties don't arise, as
every occurrence goes; other columns are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import arrow_udf, buffers, pieces, stash, trim, trimmed

LENGTH, GRAM = 200, 32
#: Bytes of text whose runs are found at a time (longer texts are cut there), and bytes whose equal runs are folded.
SLICE, PIECE = 1 << 19, 2 << 20
SHARD_BYTES = 6 << 20
#: Runs of one minimizer beyond which they are split by the minimizer's offset, and the offsets in a part.
HOT_RUNS, HOT_STEP = 4096, 12
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]
_POS = np.uint64((1 << 24) - 1)


def _words(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number (a view)."""
    return np.ndarray((len(raw) - 7,), "<u8", raw, 0, (1,))


def minimizers(raw: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each window start: the minimizer's hash and its position. raw has fewer than 2**24 bytes."""
    w = _words(raw)
    n = len(raw) - gram + 1
    x = np.zeros(n, np.uint64)
    for k in range(gram // 8):
        x += w[8 * k : 8 * k + n] * _MIX[k % 4]
        x ^= x >> np.uint64(31)
    x *= _MIX[4]
    x ^= x >> np.uint64(29)
    span = length - gram + 1
    key = np.full(-(-n // span) * span, np.iinfo(np.uint64).max, np.uint64)
    key[:n] = (x & ~_POS) | np.arange(n, dtype=np.uint64)
    table = key.reshape(-1, span)
    left = np.minimum.accumulate(table, 1).ravel()
    right = np.minimum.accumulate(table[:, ::-1], 1)[:, ::-1].ravel()
    starts = len(raw) - length + 1
    at = (np.minimum(right[:starts], left[span - 1 : span - 1 + starts]) & _POS).astype(np.int64)
    return x[at], at


def runs(offsets: np.ndarray, raw: np.ndarray, length: int = LENGTH, gram: int = GRAM, stretches: bool = True):
    """Runs of window starts of one minimizer: (doc, order in its document, first, last, hash, several), positions in raw.
    several: the minimizer's position changes within the run. And, if asked for, the stretches of each run of one HOT_STEP
    of the minimizer's offset in its window: (run, first, last, step, several).

    Slices hold whole texts of SLICE bytes at most or a part of one longer text, so the order of runs depends on the text alone.
    """
    raw = np.ascontiguousarray(raw)
    out, cut, n = [], [], 0
    for a, b in pieces(offsets, SLICE):
        lo, hi = int(offsets[a]), int(offsets[b])
        for s in range(lo, hi - length + 1, SLICE):
            part = raw[s : min(hi, s + SLICE + length - 1)]
            if len(part) < length:
                continue
            h, at = minimizers(part, length, gram)
            edge = np.zeros(len(h) + 1, np.int32)
            first = np.clip(offsets[a:b] - s, 0, len(h))
            last = np.clip(offsets[a + 1 : b + 1] - s - length + 1, first, len(h))
            np.add.at(edge, first, 1)
            np.add.at(edge, last, -1)
            good = np.cumsum(edge[:-1]) > 0
            idx = np.flatnonzero(good)
            if not len(idx):
                continue
            new = np.concatenate([[True], (np.diff(idx) != 1) | (h[idx[1:]] != h[idx[:-1]])])
            begin = np.flatnonzero(new)
            end = np.append(begin[1:], len(idx)) - 1
            moved = np.cumsum(np.concatenate([[0], at[idx[1:]] != at[idx[:-1]]]))
            out.append((idx[begin] + s, idx[end] + s, h[idx[begin]], moved[end] != moved[begin]))
            if not stretches:
                continue
            q = (at[idx] - idx) // HOT_STEP
            begin = np.flatnonzero(new | np.concatenate([[True], q[1:] != q[:-1]]))
            end = np.append(begin[1:], len(idx)) - 1
            cut.append((n + np.cumsum(new)[begin] - 1, idx[begin] + s, idx[end] + s, q[begin], moved[end] != moved[begin]))
            n += int(new.sum())
    z = np.zeros(0, np.int64)
    if not out:
        return z, z, z, z, z.astype(np.uint64), z.astype(bool), (z, z, z, z, z.astype(bool))
    first, last, h, several = (np.concatenate(x) for x in zip(*out))
    doc = np.searchsorted(offsets, first, "right") - 1
    new = np.concatenate([[True], doc[1:] != doc[:-1]])
    order = np.arange(len(doc)) - np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0))
    return doc, order, first, last, h, several, tuple(np.concatenate(x) for x in zip(*cut)) if cut else (z, z, z, z, z.astype(bool))


def _run_rows(length: int, gram: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in trimmed(batches):
            offsets, raw = buffers(batch.column(2))
            for a, b in pieces(offsets, PIECE):
                doc, order, _, _, h, several, _ = runs(offsets[a : b + 1] - offsets[a], raw[offsets[a] : offsets[b]], length, gram, stretches=False)
                at = pa.array(doc + a)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), batch.column(0).take(at), batch.column(1).take(at), pa.array(order.astype(np.int32)), pa.array(np.where(several, 2, 1).astype(np.int32))], names=["v", "id", "h", "no", "n"])

    return run


def _segment_rows(length: int, gram: int, shards: int):
    """Rows (id, h, text, runs) to (shard, v, several, seg, occ): byte runs of the kept minimizers, equal ones of a batch folded."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in trimmed(batches):
            offsets, raw = buffers(batch.column(2))
            kept = batch.column(3)
            klens = np.append(0, np.cumsum(kept.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))
            kflat = kept.flatten().to_numpy()
            for a, b in pieces(offsets, PIECE):
                lo = offsets[a]
                part = np.ascontiguousarray(raw[lo : offsets[b]])
                want = kflat[klens[a] : klens[b]]
                hot = (want & 1).astype(bool)
                doc, order, first, last, h, several, steps = runs(offsets[a : b + 1] - lo, part, length, gram, stretches=bool(hot.any()))
                wdoc = np.repeat(np.arange(b - a), np.diff(klens[a : b + 1]))
                base = np.searchsorted(doc, wdoc, "left")
                pick = base + (want >> 1)
                d, f, l, v, s = doc[pick], first[pick], last[pick], h[pick], several[pick]
                off = np.zeros(len(pick), np.int64)
                # every hot run is cut where the minimizer's offset passes a step, so that a window's key depends on its bytes alone
                if hot.any():
                    of, f2, l2, q, s2 = steps
                    chosen = np.zeros(len(doc), bool)
                    chosen[pick[hot]] = True
                    k = chosen[of]
                    of, rest = of[k], ~hot
                    d, f, l, v, s, off = (np.concatenate([x[rest], y]) for x, y in ((d, doc[of]), (f, f2[k]), (l, l2[k]), (v, h[of]), (s, s2[k]), (off, q[k] + 1)))
                data, known = part.tobytes(), {}
                codes = np.fromiter((known.setdefault(data[x : y + length], len(known)) for x, y in zip(f.tolist(), l.tolist())), np.int64, len(f))
                segs = pa.array(list(known), pa.binary())
                sort = np.argsort(codes, kind="stable")
                heads = np.flatnonzero(np.concatenate([[True], np.diff(codes[sort]) != 0])) if len(sort) else np.zeros(0, np.int64)
                rows = pa.array(d[sort] + a)
                starts = (f - (offsets[a : b] - lo)[d])[sort]
                occ = pa.ListArray.from_arrays(pa.array(np.append(heads, len(sort)).astype(np.int32)), pa.StructArray.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(starts.astype(np.int64))], names=["id", "h", "s"]))
                one = sort[heads]
                shard = ((v[one] ^ (off[one].astype(np.uint64) * _MIX[0])) * _MIX[1] >> np.uint64(33)) % np.uint64(shards)
                yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int64)), pa.array((v[one] ^ off[one].astype(np.uint64) * _MIX[0]).view(np.int64)), pa.array(s[one]), segs.take(pa.array(codes[one])), occ], names=["shard", "v", "several", "seg", "occ"])

    return run


def refine(raw: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array by the first `length` bytes, and ranks: equal where those bytes are equal.

    Larsson-Sadakane: suffixes are grouped by their first 8 bytes; then only groups of several suffixes
    are sorted again by the group of the suffix h bytes on, h doubling, until `length` bytes are compared.
    """
    n = len(raw)
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    key = _words(padded)[:n].byteswap()
    sa = np.argsort(key)
    key = key[sa]
    head = np.concatenate([[True], key[1:] != key[:-1]])
    at = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank = np.empty(n + length + 1, np.int64)
    rank[n:] = -1
    rank[sa] = at
    depth = 8
    while depth < length:
        step = min(depth, length - depth)
        single = head & np.append(head[1:], True)
        todo = np.flatnonzero(~single)
        if not len(todo):
            break
        who = sa[todo]
        both = rank[who] * np.int64(n + 2) + rank[who + step] + 1
        sort = np.argsort(both)
        who, both = who[sort], both[sort]
        sa[todo] = who
        new = np.concatenate([[True], both[1:] != both[:-1]])
        head[todo] = new
        rank[who] = todo[np.maximum.accumulate(np.where(new, np.arange(len(todo)), 0))]
        depth += step
    return sa, rank[:n]


def kasai(raw: np.ndarray, at: np.ndarray, before: np.ndarray, most: int, stride: int = 16) -> np.ndarray:
    """Common prefix, up to `most`, of the suffixes `at` (ascending) and `before`, their neighbours in order.

    Kasai's walk, many stretches of text side by side: from one position to the next a common prefix
    shrinks by one at most, so that each comparison goes on where the last one ended.
    """
    out = np.zeros(len(at), np.int64)
    limit = len(raw)
    for k in range(stride):
        now = np.arange(k, len(at), stride)
        if not len(now):
            break
        got = np.zeros(len(now), np.int64)
        if k:
            follows = at[now] == at[now - 1] + 1
            got = np.where(follows, np.maximum(out[now - 1] - 1, 0), 0)
        open_ = np.arange(len(now))
        while len(open_):
            i, j = at[now[open_]] + got[open_], before[now[open_]] + got[open_]
            fits = (got[open_] < most) & (i < limit) & (j < limit)
            same = np.zeros(len(open_), bool)
            same[fits] = raw[i[fits]] == raw[j[fits]]
            open_ = open_[same]
            got[open_] += 1
        out[now] = got
    return out


def repeated(raw: np.ndarray, valid: np.ndarray, length: int) -> np.ndarray:
    """Whether the window at each valid start is the same as at another valid start."""
    n = len(raw)
    out = np.zeros(n, bool)
    if not n:
        return out
    sa, rank = refine(raw, length)
    live = sa[valid[sa]]
    same = rank[live[1:]] == rank[live[:-1]]
    a, b = live[1:][same], live[:-1][same]
    sort = np.argsort(a)
    full = kasai(raw, a[sort], b[sort], length) >= length
    out[a[sort][full]] = True
    out[b[sort][full]] = True
    return out


def _less(x: np.ndarray, i: np.ndarray, y: np.ndarray, j: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the windows x[i:] and y[j:]: (less, equal)."""
    less, open_ = np.zeros(len(i), bool), np.arange(len(i))
    wx, wy = _words(x), _words(y)
    for k in [*range(0, length - 7, 8), length - 8]:
        p, q = wx[i[open_] + k].byteswap(), wy[j[open_] + k].byteswap()
        less[open_] = p < q
        open_ = open_[p == q]
        if not len(open_):
            break
    equal = np.zeros(len(i), bool)
    equal[open_] = True
    return less, equal


def merge(x: np.ndarray, sx: np.ndarray, y: np.ndarray, sy: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Binary search of the windows sx of x among the sorted windows sy of y: which of sx, and of sy, are in both."""
    lo, hi = np.zeros(len(sx), np.int64), np.full(len(sx), len(sy), np.int64)
    while (lo < hi).any():
        mid = np.minimum((lo + hi) >> 1, len(sy) - 1)
        less, _ = _less(y, sy[mid], x, sx, length)
        go = lo < hi
        lo = np.where(go & less, mid + 1, lo)
        hi = np.where(go & ~less, mid, hi)
    inside = lo < len(sy)
    equal = np.zeros(len(sx), bool)
    equal[inside] = _less(y, sy[lo[inside]], x, sx[inside], length)[1]
    hit = np.zeros(len(sy), bool)
    hit[lo[equal]] = True
    return equal, hit


def shard_repeats(segs: list[bytes], length: int, most: int = SHARD_BYTES) -> list[np.ndarray]:
    """For each byte run, a flag per window start: the window starts elsewhere in these runs too."""
    parts, group, size = [], [], 0
    for k, x in enumerate(segs):
        if group and size + len(x) > most:
            parts.append(group)
            group, size = [], 0
        group.append(k)
        size += len(x)
    parts += [group] if group else []
    done, out = [], [None] * len(segs)
    for group in parts:
        lens = np.array([len(segs[k]) for k in group])
        ends = np.cumsum(lens)
        raw = np.frombuffer(b"".join(segs[k] for k in group), np.uint8)
        edge = np.zeros(len(raw) + 1, np.int32)
        np.add.at(edge, ends - lens, 1)
        np.add.at(edge, ends - length + 1, -1)
        valid = np.cumsum(edge[:-1]) > 0
        flags = repeated(raw, valid, length)
        if len(parts) > 1:
            sa, rank = refine(raw, length)
            live = sa[valid[sa]]
            firsts = live[np.concatenate([[True], rank[live[1:]] != rank[live[:-1]]])]  # one of each window
            for raw2, flags2, firsts2, rank2, live2 in done:
                a, b = merge(raw, firsts, raw2, firsts2, length)
                flags[live[np.isin(rank[live], rank[firsts[a]])]] = True
                flags2[live2[np.isin(rank2[live2], rank2[firsts2[b]])]] = True
            done.append((raw, flags, firsts, rank, live))
        for k, e, n in zip(group, ends.tolist(), lens.tolist()):
            out[k] = flags[e - n : e - length + 1]
    return out


def _shard(length: int):
    def run(key, table):
        import pyarrow as pa

        table = table.combine_chunks()
        coded = table.column("seg").combine_chunks().dictionary_encode()
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.combine_chunks()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        segs = coded.dictionary.to_pylist()
        occ = table.column("occ").combine_chunks()
        lens = occ.value_lengths().to_numpy(zero_copy_only=False)
        counts = np.bincount(codes, lens, len(segs))
        v, several = np.zeros(len(segs), np.int64), np.zeros(len(segs), bool)
        v[codes] = table.column("v").to_numpy()
        several[codes] = table.column("several").to_numpy(zero_copy_only=False)
        _, inverse, same = np.unique(v, return_inverse=True, return_counts=True)
        active = (same[inverse] > 1) | several
        ranges = [[(0, len(x))] if c > 1 else [] for x, c in zip(segs, counts)]
        pick = [int(k) for k in np.flatnonzero(active)]
        for k, flags in zip(pick, shard_repeats([segs[k] for k in pick], length)):
            if counts[k] < 2 and flags.any():
                edge = np.diff(np.concatenate([[0], flags.view(np.int8), [0]]))
                ranges[k] = [(int(a), int(b) - 1 + length) for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))]
        times = np.array([len(r) for r in ranges])
        of = np.repeat(codes, lens)  # segment of each occurrence
        many = times[of]
        at = np.repeat(np.arange(len(of)), many)
        flat = np.array([x for r in ranges for x in r], np.int64).reshape(-1, 2)
        base = np.cumsum(times) - times
        nth = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
        got = flat[base[of[at]] + nth] if len(at) else np.zeros((0, 2), np.int64)
        one = occ.flatten()
        where = one.field("s").to_numpy()[at]
        rows = pa.array(at)
        return pa.table({"id": one.field("id").take(rows), "h": one.field("h").take(rows), "a": pa.array(where + got[:, 0]), "b": pa.array(where + got[:, 1])})

    return run


def ranges(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h, a, b): byte ranges that repeated windows cover; they may overlap. h is xxhash64(id, text)."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"), F.col(text_col).cast("string").alias("t")).where(F.octet_length("t") >= length)
    found = stash(rows.mapInArrow(_run_rows(length, gram), f"v long, id {kind}, h long, no int, n int"), "runs")
    again = stash(found.groupBy("v").agg(F.sum("n").alias("n")).where("n > 1"), "again")
    kept = found.select("v", "id", "h", "no").join(again, "v")
    kept = kept.select("id", "h", (F.col("no").cast("long") * 2 + (F.col("n") > HOT_RUNS).cast("long")).alias("no")).distinct()
    kept = stash(kept.groupBy(F.col("id").alias("i2"), F.col("h").alias("h2")).agg(F.collect_list("no").alias("nos")), "kept")
    total = kept.select(F.coalesce(F.sum(F.size("nos")), F.lit(0))).first()[0]
    shards = max(8, int(total * (length + 90) // (4 << 20)))
    mine = rows.join(kept, rows["id"].eqNullSafe(kept["i2"]) & (rows["h"] == kept["h2"])).select("id", "h", "t", "nos")
    segs = mine.mapInArrow(_segment_rows(length, gram, shards), f"shard long, v long, several boolean, seg binary, occ array<struct<id:{kind},h:long,s:long>>")
    return stash(segs.groupBy("shard").applyInArrow(_shard(length), f"id {kind}, h long, a long, b long"), "ranges")


def _kept():
    @arrow_udf("struct<kept:binary,n_bytes:bigint,n_removed:bigint,n_spans:bigint>")
    def kept(text, spans):
        import pyarrow as pa

        out, counts = [], []
        for t, s in zip(text.to_pylist(), spans.to_pylist()):
            t = (t or "").encode()
            removed = runs = end = 0
            parts = []
            for a, b in sorted((x["a"], x["b"]) for x in s or ()):
                if a > end or not runs:
                    parts.append(t[end:a])
                    runs += 1
                    removed += b - a
                elif b > end:
                    removed += b - end
                end = max(end, b)
            parts.append(t[end:])
            out.append(b"".join(parts))
            counts.append((len(t), removed, runs))
        trim()
        return pa.StructArray.from_arrays([pa.array(out, pa.binary()), *(pa.array([c[k] for c in counts], pa.int64()) for k in range(3))], names=["kept", "n_bytes", "n_removed", "n_spans"])

    return kept


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, kept bytes, n_bytes, n_removed, n_spans) of every row."""
    found = ranges(docs, length, gram, id_col, text_col)
    listed = found.groupBy(F.col("id").alias("i2"), F.col("h").alias("h2")).agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"), F.col(text_col).cast("string").alias("t"))
    rows = rows.join(listed, rows["id"].eqNullSafe(listed["i2"]) & (rows["h"] == listed["h2"]), "left")
    return rows.select(F.col("id").alias(id_col), _kept()(F.col("t"), F.col("spans")).alias("k")).select(id_col, "k.*")
