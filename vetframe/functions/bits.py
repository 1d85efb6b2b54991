"""Bits of 64-bit hashes held in signed longs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def widths(bands: int, bits: int = 64) -> list[int]:
    """``bands`` runs of bits, as even as can be, wider ones first."""
    return [bits // bands + (i < bits % bands) for i in range(bands)]


def masks(bands: int, bits: int = 64) -> list[tuple[int, int]]:
    """(shift, width) of each band, from the low end."""
    out, at = [], 0
    for w in widths(bands, bits):
        out.append((at, w))
        at += w
    return out


def band(hash_: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(hash_, shift).bitwiseAND(F.lit((1 << width) - 1))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))
