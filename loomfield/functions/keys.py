"""Lattice keys: three signed 21-bit coordinates in one BIGINT, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the key layout.
OFFSET = 1 << 20
STEP = {"x": 1 << 42, "y": 1 << 21, "z": 1}
BLOCK_CELLS = 64

FACES = [s * STEP[a] for a in "xyz" for s in (1, -1)]
CORNERS = [i * STEP["x"] + j * STEP["y"] + k for i in (0, 1) for j in (0, 1) for k in (0, 1)]
AROUND = [i * STEP["x"] + j * STEP["y"] + k for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]


def cell(c: Column, size: float = 1.0) -> Column:
    """Lattice coordinate at or below a position."""
    return F.floor(c / size).cast("bigint")


def pack(x: Column, y: Column, z: Column) -> Column:
    """Out-of-range coordinates overflow, which is an error under ANSI mode."""
    return (x + OFFSET) * STEP["x"] + (y + OFFSET) * STEP["y"] + (z + OFFSET)


def unpack(k: Column) -> tuple[Column, Column, Column]:
    return F.shiftright(k, 42) - OFFSET, F.shiftright(k, 21).bitwiseAND(F.lit((1 << 21) - 1)) - OFFSET, k.bitwiseAND(F.lit((1 << 21) - 1)) - OFFSET


def block_of(k: Column, cells: int = BLOCK_CELLS) -> Column:
    """Key of the cube of cells that a lattice key lies in."""
    return pack(*[F.floor(c / cells).cast("bigint") for c in unpack(k)])


def mask_bit(i: Column) -> Column:
    """One of 64 bits; the last is the sign."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(i, F.lit(64)).cast("int"))


def offsets(steps: list[int]) -> Column:
    return F.array(*[F.lit(s).cast("bigint") for s in steps])
