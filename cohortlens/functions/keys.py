"""Pseudo-random order keys computed from a row's own key.

They depend on the key and the seed only, never on the partitioning, so a
recomputed task gives the same order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INT64_MAX = (1 << 63) - 1


def md5_order(key: Column) -> Column:
    """abs() of the first 64 bits of md5(key) as a signed integer.

    The one value whose abs() overflows is mapped to the largest integer.
    """
    signed = F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 16), 16, -10).cast("bigint")
    return F.abs(F.greatest(signed, F.lit(-INT64_MAX)))


def seeded_order(key: Column, seed: float) -> Column:
    """Seeded pseudo-random order key: the md5 order of ``seed:key``."""
    return md5_order(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def unit_interval(order: Column) -> Column:
    """Map a non-negative 63-bit order key into [0, 1)."""
    return F.shiftrightunsigned(order, 10).cast("double") / F.lit(float(1 << 53))


# Fixed values of the public PostgreSQL-wiki pseudo_encrypt function.
FEISTEL_ROUNDS = 3
FEISTEL_MULTIPLIER = 1366
FEISTEL_INCREMENT = 150889
FEISTEL_MODULUS = 714025
FEISTEL_SCALE = 32767


def pseudo_encrypt(value: Column) -> Column:
    """Feistel permutation of the signed 32-bit integers, as column arithmetic."""
    value = value.cast("bigint")
    left = F.shiftright(value, 16).bitwiseAND(F.lit(65535))
    right = value.bitwiseAND(F.lit(65535))
    for _ in range(FEISTEL_ROUNDS):
        # nearest integer; an odd modulus leaves no value half way
        mixed = F.floor(
            ((right * FEISTEL_MULTIPLIER + FEISTEL_INCREMENT) % FEISTEL_MODULUS)
            / F.lit(float(FEISTEL_MODULUS)) * FEISTEL_SCALE + 0.5
        )
        left, right = right, left.bitwiseXOR(mixed)
    unsigned = F.shiftleft(right, 16) + left
    return F.shiftright(F.shiftleft(unsigned, 32), 32)  # carries the sign of bit 31
