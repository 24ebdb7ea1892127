"""Block encodings: numpy kernels from a block's lanes to a payload and back.

encode() gives None where an encoding doesn't fit a block. Lanes are unsigned 64-bit arrays.
"""

from __future__ import annotations

import numpy as np

from ..config import MAX_BLOCK, SUB_BLOCK, CorruptPayload, FrameError, LengthMismatch, Truncated, UnknownMode
from .coding import U, bit_len, code, for_decode, for_encode, for_size, pack_rows, rans_decode, rans_encode, uncode, unpack_rows, unvarints, unzigzag, varints, zigzag

#: Decimal scales that are tried for floats.
SCALES = [10.0**k for k in range(1, 8)]
#: Extrapolation coefficients by order.
NEWTON = [[1.0], [2.0, -1.0], [3.0, -3.0, 1.0], [4.0, -6.0, 4.0, -1.0]]
#: Fixed value: added and taken away, it rounds a double to an integer.
ROUND = 6755399441055744.0


def _f(x: np.ndarray) -> np.ndarray:
    return x.view(np.float64)


def _prev(x: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, x.dtype), x[:-1]]) if len(x) else x


def _le(x: np.ndarray) -> bytes:
    return x.astype("<u8").tobytes()


def _u64(raw: bytes, n: int, at: int = 0) -> np.ndarray:
    if len(raw) < at + 8 * n:
        raise Truncated("truncated values")
    return np.frombuffer(raw, "<u8", n, at).astype(U)


# --- plain encodings


def raw_encode(x, kind):
    if kind.bytes == 4:
        return (_f(x).astype("<f4") if kind.family == "float" else (x & U(0xFFFFFFFF)).astype("<u4")).tobytes()
    return _le(x)


def raw_decode(raw, n, kind):
    if len(raw) < n * kind.bytes:
        raise Truncated("truncated values")
    if kind.bytes == 4 and kind.family == "float":
        return np.frombuffer(raw, "<f4", n).astype(np.float64).view(U)
    if kind.bytes == 4:
        v = np.frombuffer(raw, "<i4" if kind.signed else "<u4", n)
        return v.astype(np.int64).view(U)
    return _u64(raw, n)


def const_encode(x, kind):
    return _le(x[:1]) if len(x) and (x == x[0]).all() else None


def const_decode(raw, n, kind):
    return np.repeat(_u64(raw, 1), n)


def stride_encode(x, kind):
    if len(x) < 2:
        return None
    d = x[1:] - x[:-1]
    return _le(np.array([x[0], d[0]])) if (d == d[0]).all() else None


def stride_decode(raw, n, kind):
    first, step = _u64(raw, 2)
    return first + step * np.arange(n, dtype=U)


def xorz_encode(x, kind):
    return varints(x ^ _prev(x))


def xorz_decode(raw, n, kind):
    return np.bitwise_xor.accumulate(unvarints(raw, n)[0]) if n else np.zeros(0, U)


def for_enc(x, kind):
    return for_encode(x, kind.signed)


def for_dec(raw, n, kind):
    return for_decode(raw)[0]


def _deltas(x):
    return zigzag(x - np.concatenate([x[:1], x[:-1]]))


def delta_encode(x, kind):
    return _le(x[:1]) + for_encode(_deltas(x), False)


def delta_decode(raw, n, kind):
    return _u64(raw, 1) + np.cumsum(unzigzag(for_decode(raw, 8)[0]), dtype=U)


# --- decimal floats


def scaled(x: np.ndarray) -> tuple[int, np.ndarray] | None:
    """The first scale at which every value is an integer exactly, and the integers."""
    v = _f(x)
    if not len(v) or not np.isfinite(v).all():
        return None
    for k, s in enumerate(SCALES):
        with np.errstate(over="ignore"):
            p = v * s
        if np.abs(p).max() >= 9e18:
            continue
        i = (np.sign(p) * np.floor(np.abs(p) + 0.5)).astype(np.int64)
        if ((i / s).view(U) == x).all():
            return k, i
    return None


def mult_encode(x, kind, penalty=None):
    got = scaled(x)
    if got is None:
        return None
    k, i = got
    packed = bytes([k, 0]) + for_encode(i.view(U), True)
    if penalty is not None:
        coded = bytes([k, 1]) + _le(i[:1].view(U)) + code(varints(_deltas(i.view(U))), penalty)
        packed = min(packed, coded, key=len)
    return packed


def mult_decode(raw, n, kind):
    if len(raw) < 2 or raw[0] >= len(SCALES):
        raise FrameError("bad scale")
    if raw[1]:
        d = unvarints(uncode(raw[10:], 10 * n + 16), n)[0]
        i = _u64(raw, 1, 2) + np.cumsum(unzigzag(d), dtype=U)
    else:
        i = for_decode(raw, 2)[0]
    return (i.view(np.int64) / SCALES[raw[0]]).view(U)


#: Powers of ten up and down, and all pairs of an exponent with a factor up to it.
UP, DOWN = [10.0**k for k in range(19)], [10.0**-k for k in range(19)]
PAIRS = [(e, f) for e in range(19) for f in range(e + 1)]
_UP_E, _DOWN_F, _UP_F, _DOWN_E = (np.array([t[p[k]] for p in PAIRS]) for t, k in ((UP, 0), (DOWN, 1), (UP, 1), (DOWN, 0)))


def alp_digits(v: np.ndarray, e, f) -> tuple[np.ndarray, np.ndarray]:
    """Integers of values scaled by 10**(e - f), and where they give the value back bit by bit."""
    return _digits(v, UP[e], DOWN[f], UP[f], DOWN[e])


def _digits(v, up_e, down_f, up_f, down_e) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(all="ignore"):
        t = v * up_e * down_f
        ok = np.isfinite(t) & (np.abs(t) < 2.0**63)
        r = np.where(ok, (t + ROUND) - ROUND, 0.0)
        d = r.astype(np.int64)
        back = d.astype(np.float64) * up_f * down_e
    return d, ok & (back.view(U) == np.broadcast_to(v, back.shape).view(U))


def alp_search(v: np.ndarray) -> tuple[int, int] | None:
    """Exponent and factor with the least estimated size on up to 32 values; None where over half don't fit."""
    s = np.ascontiguousarray(v[:: max(len(v) // 32, 1)][:32])
    d, ok = _digits(s[None, :], _UP_E[:, None], _DOWN_F[:, None], _UP_F[:, None], _DOWN_E[:, None])
    bad = (~ok).sum(1)
    most, least = np.iinfo(np.int64).max, np.iinfo(np.int64).min
    hi, lo = np.where(ok, d, least).max(1), np.where(ok, d, most).min(1)
    span = np.where(bad < len(s), hi.view(U) - lo.view(U), U(0))
    cost = np.where(bad == len(s), 64, bit_len(span)) * len(s) + 80 * bad
    best = int(np.argmin(cost))
    return None if bad[best] * 2 > len(s) else PAIRS[best]


def alp_encode(x, kind):
    head, tail = [], []
    plans = []
    for k in range(0, len(x), SUB_BLOCK):
        part = x[k : k + SUB_BLOCK]
        got = alp_search(_f(part))
        if got is None:
            return None
        d, ok = alp_digits(_f(part), *got)
        good = d[ok]
        least = int(good.min()) if len(good) else 0
        width = (int(good.max()) - least).bit_length() if len(good) else 0
        if width > 32:
            return None
        rest = np.zeros(SUB_BLOCK, U)
        rest[: len(part)] = np.where(ok, d - least, 0).view(U)
        bad = np.flatnonzero(~ok)
        plans.append((width, rest))
        head.append(bytes(got) + len(bad).to_bytes(2, "little") + (least & (1 << 64) - 1).to_bytes(8, "little") + bytes([width]))
        tail.append(bad.astype("<u2").tobytes() + _le(part[bad]))
    packed = [b""] * len(plans)
    for w in {p[0] for p in plans} - {0}:
        which = [k for k, p in enumerate(plans) if p[0] == w]
        words = pack_rows(np.stack([plans[k][1] for k in which]), w).astype("<u8")
        for k, row in zip(which, words):
            packed[k] = row.tobytes()
    return varints([len(x)]) + b"".join(a + b + c for a, b, c in zip(head, packed, tail))


def alp_decode(raw, n, kind):
    _, at = unvarints(raw, 1)
    rows = -(-n // SUB_BLOCK)
    digits, least = np.zeros((rows, SUB_BLOCK), U), np.zeros(rows, np.int64)
    up, down, patches, spots = np.ones(rows), np.ones(rows), [], {}
    for k in range(rows):
        m = min(SUB_BLOCK, n - k * SUB_BLOCK)
        if at + 13 > len(raw):
            raise Truncated("truncated stretch")
        e, f, bad = raw[at], raw[at + 1], int.from_bytes(raw[at + 2 : at + 4], "little")
        least[k], width = int.from_bytes(raw[at + 4 : at + 12], "little", signed=True), raw[at + 12]
        if width > 32 or e > 18 or f > e or bad > m:
            raise CorruptPayload("bad stretch")
        end = at + 13 + 128 * width
        if len(raw) < end + 10 * bad:
            raise Truncated("truncated exceptions")
        spots.setdefault(width, []).append((k, at + 13))
        up[k], down[k] = UP[f], DOWN[e]
        patches.append((k * SUB_BLOCK + np.frombuffer(raw, "<u2", bad, end).astype(np.int64), np.frombuffer(raw, "<u8", bad, end + 2 * bad)))
        at = end + 10 * bad
    data = np.frombuffer(raw, np.uint8)
    for width, found in spots.items():
        if width:
            starts = np.array([p for _, p in found])
            words = np.ascontiguousarray(data[starts[:, None] + np.arange(128 * width)]).view("<u8")
            digits[[k for k, _ in found]] = unpack_rows(words, width)
    with np.errstate(all="ignore"):
        v = ((digits.view(np.int64) + least[:, None]).astype(np.float64) * up[:, None] * down[:, None]).view(U).ravel()[:n]
    for where, values in patches:
        v[where] = values
    return v


def _lefts(left: np.ndarray) -> np.ndarray:
    """The eight most frequent left parts: by count, then value."""
    v, c = np.unique(left, return_counts=True)
    return v[np.lexsort((v, -c))][:8]


def rd_cut(x: np.ndarray) -> tuple[int, float]:
    """Width of the left part with the least estimated bits per value, on about 2048 values."""
    s = x[:: max(len(x) // 2048, 1)]
    best = (0, np.inf)
    for cut in range(1, 25):
        left = s >> U(64 - cut)
        d = _lefts(left)
        bad = len(s) - int(np.isin(left, d).sum())
        bits = max(1, (len(d) - 1).bit_length())
        cost = (len(s) * (64 - cut + bits) + 96 * bad) // len(s)
        if cost < best[1]:
            best = (cut, cost)
    return best


def rd_encode(x, kind, whole=False):
    if not len(x):
        return None
    cut, cost = rd_cut(x)
    left, right = x >> U(64 - cut), x & ((U(1) << U(64 - cut)) - U(1))
    d = _lefts(left)
    at = np.searchsorted(np.sort(d), left)
    order = np.argsort(d)
    at = np.minimum(at, len(d) - 1)
    hit = np.sort(d)[at] == left
    bad = np.flatnonzero(~hit)
    if not whole and (cost >= 63 or 4 * len(bad) > len(x)):
        return None
    codes = for_encode(np.where(hit, order[at], 0).astype(U), False)
    rights = for_encode(right, False)
    exceptions = b"".join([varints(bad.astype(U)), _le(left[bad])])
    return b"".join([bytes([cut, len(d)]), _le(d), varints([len(bad)]), exceptions, b"\0", varints([len(codes)]), codes, b"\0", rights])


def rd_decode(raw, n, kind):
    if len(raw) < 2 or not 1 <= raw[0] <= 24 or not 1 <= raw[1] <= 8:
        raise FrameError("bad cut")
    cut, m = raw[0], raw[1]
    d = _u64(raw, m, 2)
    (bad,), at = unvarints(raw, 1, 2 + 8 * m)
    bad = int(bad)
    if bad > n:
        raise FrameError("too many exceptions")
    where, at = unvarints(raw, bad, at)
    values = _u64(raw, bad, at)
    _, at = unvarints(raw, 1, at + 8 * bad + 1)
    codes, at = for_decode(raw, at)
    rights, _ = for_decode(raw, at + 1)
    if len(codes) != n or len(rights) != n or (bad and int(where.max()) >= n) or (n and int(codes.max()) >= m):
        raise LengthMismatch("lengths differ")
    left = d[codes.astype(np.int64)]
    left[where.astype(np.int64)] = values
    return (left << U(64 - cut)) | rights


# --- dictionaries and runs


def dict_encode(x, kind, whole=False):
    v, codes = np.unique(x, return_inverse=True)
    if not whole and len(v) > len(x) // 2 + 1:
        return None
    plain, step = _le(v), _le(v[:1]) + for_encode(_deltas(v), False)
    tag, values = (1, step) if len(step) < len(plain) else (0, plain)
    return varints([len(v)]) + bytes([tag]) + varints([len(values)]) + values + b"\0" + for_encode(codes.astype(U), False)


def dict_decode(raw, n, kind):
    (m,), at = unvarints(raw, 1)
    tag = raw[at] if at < len(raw) else 9
    (size,), at = unvarints(raw, 1, at + 1)
    part = raw[at : at + int(size)]
    v = _u64(part, int(m)) if tag == 0 else delta_decode(part, int(m), kind)
    codes, _ = for_decode(raw, at + int(size) + 1)
    if len(codes) and int(codes.max()) >= len(v):
        raise FrameError("code without value")
    return v[codes.astype(np.int64)]


def runs_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    heads = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    return x[heads], np.diff(np.append(heads, len(x)))


def rle_encode(x, kind, whole=False):
    v, lens = runs_of(x)
    if not whole and len(v) - 1 > len(x) // 2 + 1:
        return None
    return varints([len(v)]) + _le(v) + for_encode(lens.astype(U), False)


def rle_decode(raw, n, kind):
    (m,), at = unvarints(raw, 1)
    v = _u64(raw, int(m), at)
    lens, _ = for_decode(raw, at + 8 * int(m))
    if len(lens) != len(v) or int(lens.sum()) != n or (len(lens) and int(lens.max()) > n):
        raise LengthMismatch("runs don't add up")
    return np.repeat(v, lens.astype(np.int64))


# --- predictors


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0x82F63B78), t >> 1).astype(np.uint32)
    return t


_CRC = _crc_table()
_CRC_LIST = _CRC.tolist()


def context(x: np.ndarray, log2: int) -> np.ndarray:
    """CRC-32C of each value's bytes, cut to a context."""
    h = np.full(len(x), 0x9E3779B9, np.uint32)
    for k in range(8):
        h = (h >> np.uint32(8)) ^ _CRC[(h ^ ((x >> U(8 * k)) & U(255)).astype(np.uint32)) & np.uint32(255)]
    return h & np.uint32((1 << log2) - 1)


def last_in_context(x: np.ndarray, ctx: np.ndarray) -> np.ndarray:
    """The value that came last in the same context; 0 where there is none."""
    order = np.argsort(ctx, kind="stable")
    c, v = ctx[order], x[order]
    got = np.where(np.concatenate([[False], c[1:] == c[:-1]]), _prev(v), U(0)) if len(x) else v
    out = np.empty(len(x), U)
    out[order] = got
    return out


def fcm(x: np.ndarray, log2: int) -> np.ndarray:
    ctx = np.concatenate([np.zeros(1, np.uint32), context(x[:-1], log2)]) if len(x) else np.zeros(0, np.uint32)
    return last_in_context(x, ctx)


def dfcm(x: np.ndarray, log2: int) -> np.ndarray:
    return _prev(x) + fcm(x - _prev(x), log2)


def fcm_decode(residual: np.ndarray, log2: int, deltas: bool) -> np.ndarray:
    """The context of a value depends on it alone, so that each distinct one is hashed once."""
    table: dict[int, int] = {}
    contexts: dict[int, int] = {}
    out, ctx, last, mask = [], 0, 0, (1 << 64) - 1
    crc, low = _CRC_LIST, (1 << log2) - 1
    for r in residual.tolist():
        if deltas:
            v = ((last + table.get(ctx, 0)) & mask) ^ r
            x = (v - last) & mask
            last = v
        else:
            x = v = table.get(ctx, 0) ^ r
        table[ctx] = x
        ctx = contexts.get(x, -1)
        if ctx < 0:
            h, y = 0x9E3779B9, x
            for _ in range(8):
                h = (h >> 8) ^ crc[(h ^ y) & 255]
                y >>= 8
            ctx = contexts[x] = h & low
        out.append(v)
    return np.array(out, U)


def pred_encode(x, kind):
    return varints(x ^ fcm(x, kind.log2))


def pred_decode(raw, n, kind):
    return fcm_decode(unvarints(raw, n)[0], kind.log2, False)


def pred2_encode(x, kind):
    return varints(x ^ dfcm(x, kind.log2))


def pred2_decode(raw, n, kind):
    return fcm_decode(unvarints(raw, n)[0], kind.log2, True)


def extrapolated(v: np.ndarray, order: int) -> np.ndarray:
    """Newton extrapolation from the values before; fewer of them at the start."""
    out = np.zeros(len(v))
    with np.errstate(all="ignore"):
        for k in range(1, order):
            if k < len(v):
                p = 0.0
                for c, h in zip(NEWTON[k - 1], v[k - 1 :: -1]):
                    p = p + np.float64(c) * h
                out[k] = p
        if len(v) > order:
            p = np.zeros(len(v) - order)
            for k, c in enumerate(NEWTON[order - 1]):
                p = p + c * v[order - 1 - k : len(v) - 1 - k]
            out[order:] = p
    return out


def order_of(x: np.ndarray) -> int:
    """The order with the smallest mean difference on a window in the middle."""
    n = len(x)
    if n < 8:
        return 2
    w = min(1024, n)
    d = _f(x[(n - w) // 2 : (n - w) // 2 + w]).copy()
    best, least = 1, np.inf
    with np.errstate(all="ignore"):
        for k in range(1, 5):
            d = d[1:] - d[:-1]
            m = np.abs(d).sum() / len(d) if len(d) else np.inf
            if np.isfinite(m) and m < least:
                best, least = k, m
    return best


def poly_encode(x, kind):
    k = order_of(x)
    return bytes([k]) + varints(x ^ extrapolated(_f(x), k).view(U))


def _poly(raw, n, xors: bool):
    """Values from residuals, one after the other: each is predicted from those before it."""
    import struct

    if not raw or not 1 <= raw[0] <= 4:
        raise CorruptPayload("bad order")
    order, history, out = raw[0], [], []
    r = unvarints(raw, n, 1)[0]
    if not xors:
        r = np.bitwise_xor.accumulate(r).view(np.float64) if n else r
    pack, unpack = struct.Struct("<d").pack, struct.Struct("<d").unpack
    bits, value = struct.Struct("<Q").unpack, struct.Struct("<Q").pack
    for x in r.tolist():
        p = 0.0
        if history:
            for c, h in zip(NEWTON[min(order, len(history)) - 1], history):
                p = p + c * h
        v = unpack(value(bits(pack(p))[0] ^ x))[0] if xors else p + x
        history = [v, *history[: order - 1]]
        out.append(v)
    return np.array(out, np.float64).view(U)


def poly_decode(raw, n, kind):
    return _poly(raw, n, True)


def dp_encode(x, kind):
    k = order_of(x)
    v = _f(x)
    with np.errstate(all="ignore"):
        p = extrapolated(v, k)
        r = v - p
        if not ((p + r).view(U) == x).all():
            return None
    bits = r.view(U)
    return bytes([k]) + varints(bits ^ _prev(bits))


def dp_decode(raw, n, kind):
    if len(raw) < 1:
        raise Truncated("no order")
    return _poly(raw, n, False)


def ordered_encode(x, kind):
    p = np.zeros(len(x), U)
    p[1:2] = x[:1]
    if len(x) > 2:
        p[2:] = U(2) * x[1:-1] - x[:-2]
    return varints(zigzag(x - p))


def ordered_decode(raw, n, kind):
    d = unzigzag(unvarints(raw, n)[0])
    first = np.cumsum(d, dtype=U)  # differences: d0 stands alone, then second differences
    if n < 2:
        return d
    steps = np.concatenate([d[:1], np.cumsum(d[1:], dtype=U)])
    return np.cumsum(steps, dtype=U) if len(first) else d


# --- bytes


def planes_encode(x, kind):
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def planes_decode(raw, n, kind):
    if len(raw) != 8 * n:
        raise FrameError("planes don't fit")
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, n).T).view("<u8").ravel().astype(U)


def lz_encode(x, kind):
    import zstandard

    return zstandard.ZstdCompressor(level=9).compress(_le(x))


def lz_decode(raw, n, kind):
    import zstandard

    try:
        return _u64(zstandard.ZstdDecompressor().decompress(raw, max_output_size=8 * n), n)
    except zstandard.ZstdError as e:
        raise FrameError(str(e)) from e


#: Rounds of differences that the numeric backend tries, and tags of its integers and planes.
ROUNDS, _INTS, _ORDERED = 8, 255, 254
_ZERO, _PLAIN, _CODED, _PACKED = range(4)


def _ordered(x: np.ndarray) -> np.ndarray:
    """Float bits in an order of integers that is that of the floats: neighbours differ little."""
    return np.where(x >> U(63), ~x, x | U(1 << 63))


def _unordered(x: np.ndarray) -> np.ndarray:
    return np.where(x >> U(63), x & U((1 << 63) - 1), ~x)


def num_encode(x, kind):
    """Numeric backend: integers of the values (decimal digits, or float bits in order), up to seven rounds of differences,
    as byte planes, each coded for itself. The round whose planes have the least entropy is taken."""
    bases = [(_INTS if kind.family != "float" else _ORDERED, x if kind.family != "float" else _ordered(x))]
    if kind.family == "float" and (y := scaled(x)) is not None:
        bases.append((y[0], y[1].view(U)))
    best = None
    for tag, base in bases:
        d = base
        for order in range(ROUNDS):
            planes = np.ascontiguousarray((zigzag(d) if order else d).astype("<u8").view(np.uint8).reshape(-1, 8).T)
            cost = sum(map(_entropy, planes))
            if best is None or cost < best[0]:
                best = (cost, order, tag, planes)
            d = d - _prev(d)
    _, order, tag, planes = best
    return bytes([order, tag]) + b"".join(map(_plane, planes))


def _entropy(p: np.ndarray) -> float:
    """Bits of the bytes, each for itself."""
    c = np.bincount(p)
    c = c[c > 0]
    return float((c * np.log2(len(p) / c)).sum())


def _plane(p: np.ndarray) -> bytes:
    import zstandard

    if not p.any():
        return bytes([_ZERO])
    raw = p.tobytes()
    found = [(_PLAIN, raw), (_PACKED, zstandard.ZstdCompressor(level=9).compress(raw))]
    if (coded := rans_encode(raw)) is not None:
        found.append((_CODED, coded))
    tag, got = min(found, key=lambda f: len(f[1]))
    return bytes([tag]) + varints([len(got)]) + got


def num_decode(raw, n, kind):
    import zstandard

    if len(raw) < 2 or raw[0] >= ROUNDS or (raw[1] not in (_INTS, _ORDERED) and raw[1] >= len(SCALES)):
        raise CorruptPayload("bad backend header")
    planes, at = np.zeros((8, n), np.uint8), 2
    for k in range(8):
        if at >= len(raw):
            raise Truncated("truncated plane")
        tag, at = raw[at], at + 1
        if tag == _ZERO:
            continue
        (size,), at = unvarints(raw, 1, at)
        part = raw[at : at + int(size)]
        at += int(size)
        if len(part) < int(size) or tag > _PACKED:
            raise CorruptPayload("bad plane")
        try:
            got = part if tag == _PLAIN else rans_decode(part) if tag == _CODED else zstandard.ZstdDecompressor().decompress(part, max_output_size=n)
        except zstandard.ZstdError as e:
            raise CorruptPayload(str(e)) from e
        if len(got) != n:
            raise LengthMismatch("planes don't fit")
        planes[k] = np.frombuffer(got, np.uint8)
    z = np.ascontiguousarray(planes.T).view("<u8").ravel().astype(U)
    if raw[0]:
        z = unzigzag(z)
        for _ in range(raw[0]):
            z = np.cumsum(z, dtype=U)
    if raw[1] == _INTS:
        return z
    return _unordered(z) if raw[1] == _ORDERED else (z.view(np.int64) / SCALES[raw[1]]).view(U)


#: name: (encode, decode, whether its output is residuals for the coder)
KERNELS = {
    "RAW": (raw_encode, raw_decode, False),
    "CONST": (const_encode, const_decode, False),
    "STRIDE": (stride_encode, stride_decode, False),
    "XORZ": (xorz_encode, xorz_decode, False),
    "FOR": (for_enc, for_dec, False),
    "DELTA_BP": (delta_encode, delta_decode, False),
    "FLOAT_MULT": (mult_encode, mult_decode, False),
    "ALP": (alp_encode, alp_decode, False),
    "ALP_RD": (rd_encode, rd_decode, False),
    "DICT": (dict_encode, dict_decode, False),
    "RLE": (rle_encode, rle_decode, False),
    "PRED": (pred_encode, pred_decode, False),
    "PRED_RC": (pred_encode, pred_decode, True),
    "PRED2": (pred2_encode, pred2_decode, True),
    "DELTA2": (poly_encode, poly_decode, True),
    "DELTA_DP": (dp_encode, dp_decode, True),
    "ORDERED_DELTA": (ordered_encode, ordered_decode, True),
    "TRANSPOSE": (planes_encode, planes_decode, True),
    "LZ": (lz_encode, lz_decode, False),
    "NUM": (num_encode, num_decode, False),
}


#: Encodings that hold any block, and give None only where they would save nothing; not with `whole`.
ANY_BLOCK = ("ALP_RD", "DICT", "RLE")


class Kind:
    """What a kernel needs to know of a type."""

    def __init__(self, family: str, size: int, signed: bool, log2: int = 16):
        self.family, self.bytes, self.signed, self.log2 = family, size, signed, log2


def encode(mode: str, x: np.ndarray, kind: Kind, penalty: int = 0, matches: bool = False, entropy: bool = False, whole: bool = False) -> bytes | None:
    if not len(x) and mode in ("ALP", "RLE", "DICT", "DELTA_BP", "CONST", "NUM", "FLOAT_MULT", "ALP_RD"):
        return None
    enc, _, residual = KERNELS[mode]
    if mode == "FLOAT_MULT" and entropy:
        return mult_encode(x, kind, penalty)
    got = enc(x, kind, True) if whole and mode in ANY_BLOCK else enc(x, kind)
    return code(got, penalty, matches) if residual and got is not None else got


def decode(mode: str, raw: bytes, n: int, kind: Kind) -> np.ndarray:
    """Lanes of a payload; anything that isn't one raises FrameError."""
    if not 0 <= n <= MAX_BLOCK:
        raise FrameError("impossible block length")
    if mode not in KERNELS:
        raise UnknownMode(f"unknown encoding {mode}")
    _, dec, residual = KERNELS[mode]
    try:
        out = dec(uncode(raw, 11 * n + 16) if residual else raw, n, kind)
    except FrameError:
        raise
    except (ValueError, IndexError, OverflowError, MemoryError) as e:
        raise CorruptPayload(f"{mode}: {e}") from e
    if len(out) != n:
        raise LengthMismatch("decoded length differs")
    return out


__all__ = ["KERNELS", "Kind", "encode", "decode", "for_size"]
