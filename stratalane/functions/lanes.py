"""Expressions on 64-bit lanes that stay in the JVM and never overflow, whatever the ANSI setting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_LOW = 0xFFFFFFFF
_TOP = -(1 << 63)


def low(x: Column) -> Column:
    return x.bitwiseAND(F.lit(_LOW).cast("long"))


def high(x: Column) -> Column:
    return F.shiftrightunsigned(x, 32)


def _join(hi: Column, lo: Column) -> Column:
    return F.shiftleft(hi, 32).bitwiseOR(low(lo))


def wrap_sub(a: Column, b: Column) -> Column:
    """a - b modulo 2**64, in 32-bit halves."""
    lo = low(a) - low(b)
    return _join(high(a) - high(b) + F.shiftright(lo, 32), lo)


def wrap_add(a: Column, b: Column) -> Column:
    lo = low(a) + low(b)
    return _join(high(a) + high(b) + F.shiftright(lo, 32), lo)


def wrap_sum(x: Column, window) -> Column:
    """Running sum modulo 2**64 over a window of under 2**31 rows, in 32-bit halves."""
    lo, hi = F.sum(low(x)).over(window), F.sum(high(x)).over(window)
    return _join(low(hi + F.shiftrightunsigned(lo, 32)), lo)


def flip(x: Column) -> Column:
    """Maps unsigned order to signed order, and back."""
    return x.bitwiseXOR(F.lit(_TOP).cast("long"))


def zigzag(x: Column) -> Column:
    return F.shiftleft(x, 1).bitwiseXOR(F.shiftright(x, 63))


def unzigzag(z: Column) -> Column:
    return F.shiftrightunsigned(z, 1).bitwiseXOR(-(z.bitwiseAND(F.lit(1).cast("long"))))


def bit_width(x: Column) -> Column:
    """Bits of the unsigned value: 0 for 0."""
    return F.when(x == 0, 0).otherwise(F.length(F.bin(x)))


def varint_len(x: Column) -> Column:
    """Bytes of the LEB128 form of the unsigned value."""
    return F.greatest(F.lit(1), F.ceil(bit_width(x) / 7).cast("int"))


def double_bits(x: Column) -> Column:
    return F.when(x.isNotNull(), F.reflect(F.lit("java.lang.Double"), F.lit("doubleToRawLongBits"), x.cast("double")).cast("long"))


def bits_double(lane: Column) -> Column:
    return F.when(lane.isNotNull(), F.reflect(F.lit("java.lang.Double"), F.lit("longBitsToDouble"), lane).cast("double"))


def exponent(lane: Column) -> Column:
    """Exponent bits of a double's lane."""
    return F.shiftrightunsigned(lane, 52).bitwiseAND(F.lit(0x7FF).cast("long"))


def bucket(lane: Column) -> Column:
    """Multiplicative hash of a lane to 14 bits. In decimals, halves multiplied apart, which are exact and name the lane four times only."""
    k = 0x9E3779B97F4A7C15
    big = lambda x: F.lit(str(x)).cast("decimal(20,0)")
    vl, vh = low(lane).cast("decimal(10,0)"), high(lane).cast("decimal(10,0)")
    kl, kh = F.lit(k & _LOW).cast("decimal(10,0)"), F.lit(k >> 32).cast("decimal(10,0)")
    cross = (vh * kl + vl * kh) % big(1 << 32)
    return F.floor((cross * big(1 << 32) + vl * kl) % big(1 << 64) / big(1 << 50)).cast("long")


def byte_plane(lane: Column, k: int) -> Column:
    return F.shiftrightunsigned(lane, 8 * k).bitwiseAND(F.lit(255).cast("long"))
