"""Arithmetic with the rules of fixed-width machine types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def f32(value) -> Column:
    """A value as a 32-bit float: products and sums of such columns stay 32-bit."""
    return (value if isinstance(value, Column) else F.lit(value)).cast("float")


def divide(a: Column, b: Column) -> Column:
    """Floating-point division that gives infinity or NaN for a zero divisor, where ANSI division raises."""
    zero = F.when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))
    return F.when(b == 0, zero).otherwise(F.try_divide(a, b))


def wrap(value: Column, bits: int) -> Column:
    """An integer reduced to ``bits`` bits, two's complement."""
    if bits == 64:
        return value.cast("long")
    span = 1 << bits
    low = F.pmod(value.cast("decimal(38,0)"), F.lit(span))
    return F.when(low >= span >> 1, low - span).otherwise(low).cast("long")
