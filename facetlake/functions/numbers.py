"""Exact decimal rounding of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def scaled_whole(x: Column, digits: int) -> Column:
    """``x * 10**digits`` rounded to a whole number from the exact binary value of ``x``.

    Ties go to even. The product is split into its rounded value and its rounding error, so a
    value just beside a tie is not mistaken for the tie.
    """
    power = float(10**digits)
    product = x * power
    wide = x * 134217729.0
    high = wide - (wide - x)
    error = (high * power - product) + (x - high) * power
    whole = F.floor(product)
    excess = (product - whole - 0.5) + error
    up = (excess > 0) | ((excess == 0) & (F.pmod(whole, F.lit(2)) == 1))
    return whole + F.when(up, 1).otherwise(0)


def round_even(x: Column, digits: int) -> Column:
    return scaled_whole(x, digits) / float(10**digits)
