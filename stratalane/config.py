"""Levels, options and the table of encodings."""

from __future__ import annotations

from dataclasses import dataclass

MAX_BLOCK = 131072
SUB_BLOCK = 1024
REGION = 32768
HEADER_BYTES = 16
FRAME_BYTES = 9

#: The speed/ratio weight of each level, in 256ths of a byte per decoded byte.
PENALTY = {"fastest": 16, "fast": 4, "balanced": 2, "high": 0, "max": 0}
LEVELS = list(PENALTY)


@dataclass(frozen=True)
class Mode:
    name: str
    id: int
    seq: int  # order in which candidates compete; the earlier wins a tie
    weight: int  # decode cost
    level: str  # the lowest level that tries it
    family: str = "any"


#: Encodings with their ids, decode weights and levels, in order of competition.
MODES = [
    Mode("RAW", 5, 0, 0, "fastest"),
    Mode("CONST", 1, 1, 0, "fastest"),
    Mode("STRIDE", 2, 2, 0, "fastest"),
    Mode("XORZ", 3, 3, 1, "fast"),
    Mode("FOR", 50, 4, 1, "fastest"),
    Mode("DELTA_BP", 51, 5, 1, "fastest"),
    Mode("FLOAT_MULT", 17, 6, 6, "fast", "float"),
    Mode("ALP", 9, 7, 2, "fast", "float"),
    Mode("ALP_RD", 52, 8, 2, "fast", "float"),
    Mode("PRED_RC", 29, 9, 10, "high"),
    Mode("PRED", 0, 10, 3, "high"),
    Mode("PRED2", 25, 11, 10, "high"),
    Mode("DELTA2", 20, 12, 7, "high", "float"),
    Mode("DELTA_DP", 45, 13, 7, "high", "float"),
    Mode("ORDERED_DELTA", 7, 14, 7, "high"),
    Mode("LZ", 4, 15, 7, "balanced"),
    Mode("TRANSPOSE", 11, 16, 6, "balanced"),
    Mode("DICT", 19, 17, 2, "fast"),
    Mode("RLE", 53, 18, 1, "fast"),
    Mode("NUM", 54, 19, 7, "balanced"),
]
BY_NAME = {m.name: m for m in MODES}
BY_ID = {m.id: m for m in MODES}


def mode_name(mode_id: int) -> str:
    """Name of an id; "?" for an unknown one."""
    return BY_ID[mode_id].name if mode_id in BY_ID else "?"


def allowed(level: str, family: str) -> list[Mode]:
    """Encodings that compete at a level for a family of types (int or float)."""
    top = LEVELS.index(level)
    return [m for m in MODES if LEVELS.index(m.level) <= top and m.family in ("any", family)]


@dataclass(frozen=True)
class Config:
    level: str = "max"
    selection: str = "full"
    block_size: int | None = None
    predictor_log2: int = 16

    def __post_init__(self):
        if self.level not in PENALTY:
            raise ValueError(f"unknown level {self.level}")
        if self.selection not in ("full", "sample"):
            raise ValueError(f"unknown selection {self.selection}")
        if self.block_size is not None:
            object.__setattr__(self, "block_size", max(1, min(MAX_BLOCK, self.block_size)))
        object.__setattr__(self, "predictor_log2", max(10, min(16, self.predictor_log2)))


#: Id of a frame that holds limbs of wide values, each encoded for itself.
LIMBS = 60


def bound(n: int, width: int = 8) -> int:
    """Bytes that no stream of n values of a type of that width passes: (max(width, 8) + 1) a value and 1024."""
    return n * (max(width, 8) + 1) + 1024


class FrameError(ValueError):
    """A frame or stream that cannot be decoded."""


class BadMagic(FrameError):
    """The stream doesn't begin as one."""


class UnsupportedVersion(FrameError):
    """A version of the format that this library doesn't know."""


class Truncated(FrameError):
    """The bytes end too soon."""


class UnknownMode(FrameError):
    """An encoding id that isn't in the table."""


class CorruptPayload(FrameError):
    """A payload that isn't one of its encoding, or whose checksum differs."""


class LengthMismatch(FrameError):
    """Counts of values that don't add up."""


class UnsupportedKind(FrameError):
    """A type id that isn't in the table."""


class KindMismatch(FrameError, TypeError):
    """A column was asked for as another type than it has."""


class UnsupportedType(FrameError, TypeError):
    """A column type that has no lane."""
