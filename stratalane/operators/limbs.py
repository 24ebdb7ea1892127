"""Values wider than a lane as limbs: rows of unsigned 64-bit words, lowest first, two's complement.

A block is stored as its smallest value and the distances from it, each limb a payload of its own."""

from __future__ import annotations

import struct
from collections.abc import Callable

import numpy as np

from ..config import BY_ID, CorruptPayload, Truncated, UnknownMode
from .coding import U

_SIGN = U(1 << 63)


def less(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Signed a < b, row by row."""
    out = np.zeros(len(a), bool)
    tied = np.ones(len(a), bool)
    for k in range(a.shape[1] - 1, -1, -1):
        x, y = (a[:, k], b[:, k]) if k < a.shape[1] - 1 else (a[:, k] ^ _SIGN, b[:, k] ^ _SIGN)
        out |= tied & (x < y)
        tied &= x == y
    return out


def least(a: np.ndarray) -> np.ndarray:
    """The smallest row."""
    rows = a
    for k in range(a.shape[1] - 1, -1, -1):
        x = rows[:, k] ^ _SIGN if k == a.shape[1] - 1 else rows[:, k]
        rows = rows[x == x.min()]
    return rows[0]


def sub(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a - b, wrapping."""
    out, borrow = np.empty_like(a), np.zeros(len(a), U)
    for k in range(a.shape[1]):
        out[:, k] = a[:, k] - b[:, k] - borrow
        borrow = ((a[:, k] < b[:, k]) | ((a[:, k] == b[:, k]) & (borrow > 0))).astype(U)
    return out


def add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a + b, wrapping."""
    out, carry = np.empty_like(a), np.zeros(len(a), U)
    for k in range(a.shape[1]):
        half = a[:, k] + b[:, k]
        out[:, k] = half + carry
        carry = ((half < a[:, k]) | (out[:, k] < half)).astype(U)
    return out


def of_ints(values, limbs: int) -> np.ndarray:
    raw = b"".join((int(v) & ((1 << 64 * limbs) - 1)).to_bytes(8 * limbs, "little") for v in values)
    return np.frombuffer(raw, "<u8").reshape(-1, limbs).astype(U)


def to_ints(rows: np.ndarray) -> list[int]:
    return [int.from_bytes(r.astype("<u8").tobytes(), "little", signed=True) for r in rows]


def encode(rows: np.ndarray, choose: Callable[[np.ndarray], tuple[int, bytes]]) -> bytes:
    """choose(lanes) gives (encoding id, payload) of a limb."""
    n, limbs = rows.shape
    low = least(rows) if n else np.zeros(limbs, U)
    away = sub(rows, np.broadcast_to(low, rows.shape)) if n else rows
    out = [bytes([limbs]), low.astype("<u8").tobytes()]
    for k in range(limbs):
        mode, payload = choose(np.ascontiguousarray(away[:, k]))
        out.append(struct.pack("<BI", mode, len(payload)) + payload)
    return b"".join(out)


def decode(raw: bytes, n: int, undo: Callable[[str, bytes, int], np.ndarray]) -> np.ndarray:
    if not raw or raw[0] not in (1, 2, 3, 4) or len(raw) < 1 + 8 * raw[0]:
        raise CorruptPayload("bad number of limbs")
    limbs, at = raw[0], 1 + 8 * raw[0]
    low = np.frombuffer(raw, "<u8", limbs, 1).astype(U)
    out = np.empty((n, limbs), U)
    for k in range(limbs):
        if at + 5 > len(raw):
            raise Truncated("truncated limb")
        mode, size = struct.unpack("<BI", raw[at : at + 5])
        if mode not in BY_ID:
            raise UnknownMode(f"unknown encoding {mode}")
        if at + 5 + size > len(raw):
            raise Truncated("truncated limb")
        out[:, k] = undo(BY_ID[mode].name, raw[at + 5 : at + 5 + size], n)
        at += 5 + size
    return add(out, np.broadcast_to(low, out.shape))
