"""Byte-level building blocks, vectorised: variable-length integers, bit packing, entropy coding of residuals."""

from __future__ import annotations

import lzma

import numpy as np

from ..config import SUB_BLOCK, FrameError

U = np.uint64
#: Interleaved states of the coder: as many as the input is worth, a power of two.
_FEWEST, _MOST, _SHARE = 16, 2048, 512


def bit_len(x: np.ndarray) -> np.ndarray:
    """Bits of unsigned 64-bit values."""
    x = np.asarray(x, U).copy()
    out = np.zeros(x.shape, np.int64)
    for s in (32, 16, 8, 4, 2, 1):
        big = x >= (U(1) << U(s))
        out[big] += s
        x[big] >>= U(s)
    return out + (x > 0)


def varint_len(x: np.ndarray) -> np.ndarray:
    return np.maximum(1, -(-bit_len(x) // 7))


def varints(x) -> bytes:
    """LEB128 of each value, one after the other."""
    x = np.asarray(x, U)
    if not len(x):
        return b""
    n = varint_len(x)
    ends = np.cumsum(n)
    out = np.zeros(int(ends[-1]), np.uint8)
    for k in range(int(n.max())):
        pick = np.flatnonzero(n > k)
        part = ((x[pick] >> U(7 * k)) & U(127)).astype(np.uint8)
        out[ends[pick] - n[pick] + k] = part | ((n[pick] > k + 1).astype(np.uint8) << 7)
    return out.tobytes()


def unvarints(raw: bytes, count: int, at: int = 0) -> tuple[np.ndarray, int]:
    """`count` values from position `at` on, and the position after them."""
    b = np.frombuffer(raw, np.uint8)[at : at + 10 * count]
    ends = np.flatnonzero(b < 128)[:count] + 1
    if len(ends) < count:
        raise FrameError("truncated integer")
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    n = ends - starts
    if count and n.max() > 10:
        raise FrameError("integer too long")
    out = np.zeros(count, U)
    for k in range(int(n.max()) if count else 0):
        pick = np.flatnonzero(n > k)
        out[pick] |= (b[starts[pick] + k] & 127).astype(U) << U(7 * k)
    return out, at + (int(ends[-1]) if count else 0)


def pack_rows(x: np.ndarray, width: int) -> np.ndarray:
    """Rows of 1024 values of `width` bits, lowest bit first, as rows of 16 * width words.

    A word holds the low bits of all values that begin in it and the rest of the one before it."""
    at = np.arange(SUB_BLOCK, dtype=np.int64) * width
    word, shift = at >> 6, (at & 63).astype(U)
    heads = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    out = np.bitwise_or.reduceat(x << shift, heads, axis=1)
    over = np.flatnonzero((at & 63) + width > 64)
    if len(over):
        out[:, word[over] + 1] |= x[:, over] >> (U(64) - shift[over])
    return out


def unpack_rows(words: np.ndarray, width: int) -> np.ndarray:
    at = np.arange(SUB_BLOCK, dtype=np.int64) * width
    word, shift = at >> 6, (at & 63).astype(U)
    out = words[:, word] >> shift
    over = np.flatnonzero((at & 63) + width > 64)
    if len(over):
        out[:, over] |= words[:, word[over] + 1] << (U(64) - shift[over])
    return out & U((1 << width) - 1) if width < 64 else out


def pack_bits(x: np.ndarray, width: int) -> bytes:
    """1024 values of `width` bits: 128 * width bytes."""
    return pack_rows(np.asarray(x, U)[None], width).astype("<u8").tobytes() if width else b""


def unpack_bits(raw: bytes, width: int) -> np.ndarray:
    if not width:
        return np.zeros(SUB_BLOCK, U)
    if len(raw) < 128 * width:
        raise FrameError("truncated bits")
    return unpack_rows(np.frombuffer(raw, "<u8", 16 * width)[None], width)[0]


def stretches(x: np.ndarray) -> np.ndarray:
    """Values as rows of 1024; the last row is filled up with its own first value, which widens no range."""
    rows = -(-len(x) // SUB_BLOCK)
    out = np.empty(rows * SUB_BLOCK, U)
    out[: len(x)] = x
    if rows:
        out[len(x) :] = x[(rows - 1) * SUB_BLOCK]
    return out.reshape(rows, SUB_BLOCK)


def for_plan(x: np.ndarray, signed: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, smallest value and bit width of every stretch."""
    rows = stretches(np.asarray(x, U))
    if not len(rows):
        return rows, np.zeros(0, U), np.zeros(0, np.int64)
    view = rows.view(np.int64) if signed else rows
    least = view.min(1).view(U)
    return rows, least, bit_len(view.max(1).view(U) - least)


def for_encode(x: np.ndarray, signed: bool) -> bytes:
    """Frame of reference by stretches of 1024: width, smallest value, packed distances from it.

    Stretches of one width are packed together."""
    rows, least, widths = for_plan(x, signed)
    if len(x) % SUB_BLOCK:
        rows[-1, len(x) % SUB_BLOCK :] = least[-1]
    rest = rows - least[:, None]
    sizes = 9 + 128 * widths
    ends = np.cumsum(sizes)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    for w in np.unique(widths).tolist():
        which = np.flatnonzero(widths == w)
        block = np.empty((len(which), 9 + 128 * w), np.uint8)
        block[:, 0] = w
        block[:, 1:9] = least[which].astype("<u8").view(np.uint8).reshape(-1, 8)
        if w:
            block[:, 9:] = pack_rows(rest[which], w).astype("<u8").view(np.uint8).reshape(len(which), -1)
        at = (ends[which] - sizes[which])[:, None] + np.arange(9 + 128 * w)
        out[at] = block
    return varints([len(x)]) + out.tobytes()


def for_size(x: np.ndarray, signed: bool) -> int:
    widths = for_plan(x, signed)[2]
    return int(varint_len(np.array([len(x)], U))[0]) + int((9 + 128 * widths).sum())


def for_decode(raw: bytes, at: int = 0) -> tuple[np.ndarray, int]:
    (n,), at = unvarints(raw, 1, at)
    n = int(n)
    if n > len(raw) * 1024:
        raise FrameError("impossible length")
    starts, widths = [], []
    for _ in range(0, n, SUB_BLOCK):
        if at + 9 > len(raw):
            raise FrameError("truncated stretch")
        width = raw[at]
        if width > 64 or at + 9 + 128 * width > len(raw):
            raise FrameError("impossible width" if width > 64 else "truncated bits")
        starts.append(at)
        widths.append(width)
        at += 9 + 128 * width
    out = np.empty((len(starts), SUB_BLOCK), U)
    data, starts, widths = np.frombuffer(raw, np.uint8), np.array(starts, np.int64), np.array(widths, np.int64)
    for w in np.unique(widths).tolist():
        which = np.flatnonzero(widths == w)
        block = data[starts[which][:, None] + np.arange(9 + 128 * w)]
        least = np.ascontiguousarray(block[:, 1:9]).view("<u8")[:, 0].astype(U)
        out[which] = (unpack_rows(np.ascontiguousarray(block[:, 9:]).view("<u8"), w) if w else U(0)) + least[:, None]
    return out.ravel()[:n], at


def zigzag(x: np.ndarray) -> np.ndarray:
    s = x.view(np.int64)
    return ((s << 1) ^ (s >> 63)).view(U)


def unzigzag(z: np.ndarray) -> np.ndarray:
    return (z >> U(1)) ^ (U(0) - (z & U(1)))


def order1_bytes(raw: bytes) -> int:
    """Estimated size of bytes coded by their predecessor: conditional entropy. Short inputs count whole."""
    if len(raw) < 64:
        return len(raw)
    b = np.frombuffer(raw, np.uint8).astype(np.int64)
    joint = np.bincount((np.concatenate([[0], b[:-1]]) << 8) | b, minlength=65536).reshape(256, 256)
    total = np.broadcast_to(joint.sum(1, keepdims=True), joint.shape)
    seen = joint > 0
    return int(np.ceil((joint[seen] * np.log2(total[seen] / joint[seen])).sum() / 8))


def normalised(counts: np.ndarray, total: int = 4096) -> np.ndarray:
    """Frequencies that sum to `total`, at least 1 for each symbol that occurs."""
    seen = counts > 0
    f = np.where(seen, np.maximum(1, counts * total // max(1, int(counts.sum()))), 0)
    while (gap := total - int(f.sum())) != 0:
        k = int(f.argmax())
        f[k] += gap if gap > 0 else -min(-gap, int(f[k]) - 1)
    return f


def _states(n: int) -> int:
    return min(_MOST, max(_FEWEST, 1 << (n // _SHARE).bit_length()))


def rans_encode(raw: bytes) -> bytes | None:
    """Order-0 asymmetric numeral system with 12-bit frequencies, in interleaved states stepped together."""
    x = np.frombuffer(raw, np.uint8)
    if not len(x):
        return None
    f = normalised(np.bincount(x, minlength=256))
    cum = np.concatenate([[0], np.cumsum(f)[:-1]])
    symbols = np.flatnonzero(f)
    lanes = _states(len(x))
    rows = -(-len(x) // lanes)
    grid = np.full(rows * lanes, symbols[0], np.uint8)
    grid[: len(x)] = x
    grid = grid.reshape(rows, lanes)
    state = np.full(lanes, 1 << 16, np.int64)
    words = []
    for r in range(rows - 1, -1, -1):
        s = grid[r]
        fs = f[s]
        full = state >= fs << 20
        words.append((state[full] & 0xFFFF).astype("<u2")[::-1])
        state[full] >>= 16
        state = (state // fs << 12) + state % fs + cum[s]
    head = varints([len(x), len(symbols)]) + bytes(symbols.astype(np.uint8)) + varints(f[symbols])
    return head + state.astype("<u4").tobytes() + np.concatenate(words)[::-1].tobytes()


def rans_decode(raw: bytes) -> bytes:
    (n, k), at = unvarints(raw, 2)
    n, k = int(n), int(k)
    if n > 1 << 24:
        raise FrameError("impossible length")
    symbols = np.frombuffer(raw, np.uint8, k, at) if at + k <= len(raw) and k else None
    if symbols is None:
        raise FrameError("truncated table")
    freq, at = unvarints(raw, k, at + k)
    lanes = _states(n)
    if int(freq.sum()) != 4096 or at + 4 * lanes > len(raw):
        raise FrameError("bad frequencies")
    f, cum = np.zeros(256, np.int64), np.zeros(256, np.int64)
    f[symbols] = freq.astype(np.int64)
    cum[symbols] = np.cumsum(f[symbols]) - f[symbols]
    slot = np.repeat(symbols, f[symbols])
    state = np.frombuffer(raw, "<u4", lanes, at).astype(np.int64)
    words = np.frombuffer(raw[at + 4 * lanes :][: (len(raw) - at - 4 * lanes) // 2 * 2], "<u2").astype(np.int64)
    rows = -(-n // lanes)
    if rows > 64 + 16 * len(words) * lanes + (1 << 20):
        raise FrameError("impossible length")
    out, used = np.empty((rows, lanes), np.uint8), 0
    for r in range(rows):
        low = state & 4095
        s = slot[low]
        out[r] = s
        state = f[s] * (state >> 12) + low - cum[s]
        need = np.flatnonzero(state < 1 << 16)
        if used + len(need) > len(words):
            raise FrameError("truncated stream")
        state[need] = (state[need] << 16) | words[used : used + len(need)]
        used += len(need)
    return out.ravel()[:n].tobytes()


#: Tags of coded residuals.
CONTEXT, RANS, MATCHED = 0, 2, 3
_FILTERS = [{"id": lzma.FILTER_LZMA2, "preset": 1, "lc": 3, "pb": 0}]


#: Decode weights of the context-modelling coder and of rANS, as in the scores of encodings.
_WEIGHT = {CONTEXT: 30, RANS: 3}


def code(raw: bytes, penalty: int, matches: bool = False) -> bytes:
    """Residual bytes by the best coder, with its tag: rANS where decoding speed counts, else the better of it and
    a context-modelling coder by size and decode cost; at the top level also after a match search."""
    cost = lambda x: len(x) + ((penalty * _WEIGHT[x[0]] * len(raw)) >> 8)
    best = bytes([RANS]) + (rans_encode(raw) or varints([0, 0]))
    if penalty < 2:
        other = bytes([CONTEXT]) + lzma.compress(raw, lzma.FORMAT_RAW, filters=_FILTERS)
        best = min(best, other, key=cost)
    if matches and len(raw) > 64:
        import zstandard

        other = bytes([MATCHED]) + zstandard.ZstdCompressor(level=12).compress(raw)
        best = other if len(other) < len(best) else best
    return best


def uncode(raw: bytes, most: int) -> bytes:
    try:
        if not raw:
            raise FrameError("no residuals")
        if raw[0] == RANS:
            (n,), _ = unvarints(raw, 1, 1)
            if int(n) > most:
                raise FrameError("too many residuals")
            return rans_decode(raw[1:]) if int(n) else b""
        if raw[0] == CONTEXT:
            return lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=_FILTERS).decompress(raw[1:], most)
        if raw[0] == MATCHED:
            import zstandard

            return zstandard.ZstdDecompressor().decompress(raw[1:], max_output_size=most)
    except FrameError:
        raise
    except Exception as e:
        raise FrameError(f"bad residuals: {e}") from e
    raise FrameError("unknown coder")
