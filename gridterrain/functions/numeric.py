"""Number helpers whose results must agree with floating-point array arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from gridterrain.schemas import ALTITUDE_TOLERANCE


def float_floor_div(a: Column, b: Column) -> Column:
    """Floor division of doubles through the remainder, for b > 0.

    ``floor(a / b)`` rounds the quotient first and can be one too high (1.0 by 0.1 is 9, not 10).
    Works in doubles throughout; the caller casts.
    """
    a, b = a.cast("double"), b.cast("double")
    rem = a % b
    whole = (a - rem) / b - F.when(rem < 0, 1.0).otherwise(0.0)
    return F.floor(whole + 0.5)


def same_altitude(a: Column, b: Column) -> Column:
    """Two altitudes closer than the tolerance."""
    return F.abs(a - b) < ALTITUDE_TOLERANCE


def mix_hash(number: Column, seed: int) -> Column:
    """A portable pseudo-random number in [0, 2^31 - 2] for a whole number and a seed."""
    prime = F.lit(2147483647).cast("bigint")
    x = F.pmod(F.pmod(number.cast("bigint"), prime) + (seed + 1), prime)
    h = (x * 48271) % prime
    h = (h * h + x) % prime
    return (h * h + x) % prime


def wide_hash(number: Column, seed: int) -> Column:
    """Like ``mix_hash``, over [0, 2^62)."""
    return mix_hash(number, seed) * F.lit(2**31) + mix_hash(number, seed + 7)
