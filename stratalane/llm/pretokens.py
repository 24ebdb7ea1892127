"""Vectorised pre-tokenising: where the public split pattern cuts a buffer of UTF-8 texts.

The pattern's matches cover a text without gaps, so a text is a list of cut positions. Letters, numbers,
white space and the rest are runs; a space joins the run after it, the last white space before a run
stands alone, and a lone apostrophe takes a contraction's letters.
"""

from __future__ import annotations

import functools

import numpy as np

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: Characters with Unicode's White_Space property.
WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Letters that the pattern takes together with an apostrophe.
CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]


@functools.cache
def tables() -> tuple[np.ndarray, np.ndarray]:
    """Class of each code point, and whether it is the same in an old and in the present Unicode version."""
    import unicodedata

    kind = {"L": LETTER, "N": NUMBER}
    n = 0x110000
    now = [unicodedata.category(chr(c)) for c in range(n)]
    cls = np.array([kind.get(x[0], OTHER) for x in now], np.uint8)
    old = np.array([kind.get(unicodedata.ucd_3_2_0.category(chr(c))[0], OTHER) for c in range(n)], np.uint8)
    stable = (old == cls) & (np.array(now) != "Cn")
    cls[WHITE] = SPACE
    stable[WHITE] = True
    return cls, stable


def cuts(offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start byte of every pre-token of texts laid end to end, and a flag for each text whose characters
    libraries of other Unicode versions may class otherwise."""
    cls_of, stable = tables()
    n = len(raw)
    odd = np.zeros(len(offsets) - 1, bool)
    if not n:
        return np.zeros(0, np.int64), odd
    pad = np.concatenate([raw, np.zeros(4, np.uint8)])
    cls = np.frombuffer(bytearray(raw.tobytes().translate(cls_of[:128].tobytes() + bytes([OTHER] * 128))), np.uint8)
    lead = np.flatnonzero(raw >= 0xC0)
    size = (raw[lead] >= 0xE0).view(np.uint8) + (raw[lead] >= 0xF0)  # bytes after the lead byte, less one
    for more in range(1, 4):
        at = lead[size == more - 1]
        cp = raw[at].astype(np.int32) & 0x3F >> more
        for k in range(1, more + 1):
            cp = cp << 6 | pad[at + k] & 0x3F
        for k in range(more + 1):
            cls[at + k] = cls_of[cp]
        odd[np.searchsorted(offsets, at[~stable[cp]], "right") - 1] = True
    first = np.zeros(n + 4, bool)
    first[offsets[:-1][offsets[:-1] < n]] = True
    run = np.empty(n + 4, bool)
    run[n:] = True
    run[0] = True
    np.not_equal(cls[1:], cls[:-1], out=run[1:n])
    run |= first
    start = run[:n].copy()
    # a run after white space of the same text
    white = cls == SPACE
    after = white[:-1] & ~white[1:] & ~first[1:n]
    start[1:] &= ~(after & (raw[:-1] == 0x20))
    start[:-1] |= after & (raw[:-1] < 0x80)
    last = np.flatnonzero(after & (raw[:-1] >= 0x80))
    for _ in range(3):
        last = np.where(raw[last] & 0xC0 == 0x80, last - 1, last)
    start[last] = True
    # contractions: an apostrophe that is a run of its own, without a space, right before letters
    p = np.flatnonzero(raw == 0x27)
    p = p[run[p]]
    if len(p):
        letters = np.concatenate([cls, np.full(4, OTHER, np.uint8)]) == LETTER
        p = p[run[p + 1] & letters[p + 1] & ~first[p + 1] & (first[p] | (pad[p - 1] != 0x20))]
        taken = np.zeros(len(p), np.int64)
        for x in CONTRACTIONS:
            fits = np.ones(len(p), bool)
            for k, ch in enumerate(x.encode()):
                fits &= (pad[p + 1 + k] == ch) & ~first[p + 1 + k]
            taken[(taken == 0) & fits] = len(x)
        p, taken = p[taken > 0], taken[taken > 0]
        start[p + 1] = False
        end = p + 1 + taken
        end = end[end < n]
        start[end[letters[end]]] = True
    return np.flatnonzero(start), odd


def dictionary(starts: np.ndarray, raw: np.ndarray):
    """Code of each pre-token and the distinct ones, an Arrow binary array."""
    import pyarrow as pa

    offsets = np.append(starts, len(raw)).astype(np.int64)
    raw = np.ascontiguousarray(raw)
    tokens = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
    coded = tokens.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
