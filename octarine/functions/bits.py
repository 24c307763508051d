"""Bit algebra on long columns: expressions only, so that they stay within generated code."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def bit(code: Column, k: int) -> Column:
    """Bit k of the code, as a long of 0 or 1."""
    return F.shiftrightunsigned(code, k).bitwiseAND(F.lit(1).cast("bigint"))


def mask(width: int) -> int:
    return (1 << width) - 1


def total(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts) if parts else F.lit(0).cast("bigint")


def permute(code: Column, p: Sequence[int]) -> Column:
    """Bit i goes to position p[i]."""
    return total([F.shiftleft(bit(code, i), to) for i, to in enumerate(p)])


def permute_by(code: Column, p: Column, bits: int) -> Column:
    """As permute(), with the permutation in an array column."""
    return total([F.call_function("shiftleft", bit(code, i), F.get(p, i).cast("int")) for i in range(bits)])


def reverse(code: Column, bits: int) -> Column:
    """Bit i goes to position bits - 1 - i; for odd widths the middle bit stays."""
    return permute(code, [bits - 1 - i for i in range(bits)])


def pack(values: Sequence[Column], bits: Sequence[int]) -> Column:
    """Values side by side, the first in the low bits: each is shifted by the widths before it, and they are summed."""
    shifts = [sum(bits[:k]) for k in range(len(bits))]
    return total([F.shiftleft(v, s) for v, s in zip(values, shifts, strict=True)])


def unpack(code: Column, bits: Sequence[int]) -> list[Column]:
    shifts = [sum(bits[:k]) for k in range(len(bits))]
    return [F.shiftright(code, s).bitwiseAND(F.lit(mask(b)).cast("bigint")) for s, b in zip(shifts, bits, strict=True)]


def morton(bits: Sequence[int]) -> list[int]:
    """The permutation from packed to interleaved bits: bit b of axis a comes after all lower bits of all axes."""
    order = sorted((b, a) for a, n in enumerate(bits) for b in range(n))
    to = {x: k for k, x in enumerate(order)}
    return [to[b, a] for a, n in enumerate(bits) for b in range(n)]


def inverse(p: Sequence[int]) -> list[int]:
    out = [0] * len(p)
    for i, to in enumerate(p):
        out[to] = i
    return out


def bit_length(n: Column) -> Column:
    """Binary digits of a count: 0 for 0."""
    return F.when(n > 0, F.length(F.bin(n))).otherwise(0)
