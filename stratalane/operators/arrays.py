"""Between Arrow columns and lanes or limbs."""

from __future__ import annotations

import re

import numpy as np

from ..config import UnsupportedType
from ..plans.blocks import LANES
from .coding import U

#: Arrow types of kinds with a lane.
_ARROW = {"double": "float64", "float": "float32", "bigint": "int64", "int": "int32", "smallint": "int16", "tinyint": "int8", "boolean": "bool_", "date": "date32"}


def limbs_of(kind: str) -> int:
    """Limbs of a wide kind: 2 of decimals, 4 of 256-bit values in 32 bytes; 0 of kinds with a lane."""
    if kind in LANES:
        return 0
    if kind.startswith("decimal("):
        return 2
    if kind == "binary":
        return 4
    raise UnsupportedType(f"no lane for {kind}")


def arrow_type(kind: str):
    import pyarrow as pa

    if kind in _ARROW:
        return getattr(pa, _ARROW[kind])()
    if kind.startswith("decimal("):
        return pa.decimal128(*map(int, re.findall(r"\d+", kind)))
    return {"timestamp": pa.timestamp("us", "UTC"), "timestamp_ntz": pa.timestamp("us"), "binary": pa.binary()}[kind]


def lanes(column, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Lanes (or rows of limbs) of an Arrow column, zero where null, and which are valid."""
    import pyarrow as pa
    import pyarrow.compute as pc

    x = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(x, pa.ChunkedArray):
        x = pa.concat_arrays(x.chunks) if x.num_chunks else pa.array([], x.type)
    valid = np.ones(len(x), bool) if not x.null_count else x.is_valid().to_numpy(zero_copy_only=False)
    if kind == "binary":
        sizes = pc.binary_length(x).fill_null(32).to_numpy()
        if (sizes != 32).any():
            raise UnsupportedType("256-bit values have 32 bytes")
        raw = b"".join(x.fill_null(b"\0" * 32).to_pylist())
        return np.frombuffer(raw, "<u8").reshape(-1, 4).astype(U), valid
    if kind.startswith("decimal("):
        rows = np.frombuffer(x.buffers()[1], "<u8", 2 * len(x), 16 * x.offset).reshape(-1, 2).astype(U) if len(x) else np.zeros((0, 2), U)
        return np.where(valid[:, None], rows, U(0)), valid
    if kind in ("timestamp", "timestamp_ntz"):
        x = x.cast(pa.timestamp("us", x.type.tz)).cast(pa.int64())
    elif kind == "date":
        x = x.cast(pa.int32())
    elif kind == "boolean":
        x = x.cast(pa.int8())
    if x.null_count:
        x = x.fill_null(0)
    v = x.to_numpy(zero_copy_only=False)
    return (v.astype(np.float64) if kind in ("double", "float") else v.astype(np.int64)).view(U), valid


def values(x: np.ndarray, valid: np.ndarray, kind: str):
    """The Arrow column of lanes or limbs: the source type again."""
    import pyarrow as pa

    to, mask = arrow_type(kind), None if valid.all() else ~valid
    if kind == "binary":
        raw = np.ascontiguousarray(x.astype("<u8")).tobytes()
        return pa.array([raw[32 * k : 32 * k + 32] if ok else None for k, ok in enumerate(valid)], to)
    if kind.startswith("decimal("):
        bits = None if mask is None else pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
        return pa.Array.from_buffers(to, len(valid), [bits, pa.py_buffer(np.ascontiguousarray(x.astype("<u8")).tobytes())])
    if kind in ("double", "float"):
        v = x.view(np.float64)
        return pa.array(v.astype(np.float32) if kind == "float" else v, to, mask=mask, from_pandas=False)
    v = x.view(np.int64)
    if kind == "boolean":
        return pa.array(v != 0, to, mask=mask)
    if kind == "date":
        return pa.array(v.astype(np.int32), pa.int32(), mask=mask).cast(to)
    if kind in ("timestamp", "timestamp_ntz"):
        return pa.array(v, pa.int64(), mask=mask).cast(to)
    return pa.array(v.astype({"bigint": np.int64, "int": np.int32, "smallint": np.int16, "tinyint": np.int8}[kind]), to, mask=mask)
