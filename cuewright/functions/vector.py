"""Vector functions: Column to Column, in double precision."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = 6  # scores are rounded to these digits before they are ranked


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def once(x: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of ``x``, which is evaluated once a row, however often ``then`` names it and in whatever lambda."""
    return F.transform(F.array(x), then)[0]


def usable(v: Column) -> Column:
    """The vector in doubles; null if it is zero, or holds a null or a number that isn't finite."""

    def held(d: Column) -> Column:
        bad = F.exists(d, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        return F.when(~bad & F.exists(d, lambda x: x != 0), d)

    return once(doubles(v), held)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column) -> Column:
    """Unit length; a zero vector gives null, so that it is never ranked (it would be NaN)."""
    norm = lambda d: F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x))
    return once(doubles(v), lambda d: once(norm(d), lambda n: F.when(n > 0, F.transform(d, lambda x: x / n))))


def rounded(x: Column, digits: int = DIGITS) -> Column:
    return F.round(x, digits)


def rounded_double(x: Column, digits: int) -> Column:
    """``x`` times a power of ten to the nearest whole number, and back, all in doubles; ``rounded`` rounds the shortest decimal that reads as ``x``.

    They differ where that decimal is a tie: 0.145 is a little less as a double times 100, so it gives 0.14 here and 0.15 there.
    """
    return F.round(x * F.lit(10.0**digits), 0) / F.lit(10.0**digits)


def pearson(x: Column, y: Column) -> Column:
    """Pearson correlation of two arrays of one length; 0.0 where either is flat or empty."""
    add = lambda v: F.aggregate(v, F.lit(0.0), lambda s, e: s + e)
    centred = lambda v: F.transform(doubles(v), lambda e: e - F.try_divide(add(doubles(v)), F.size(v)))
    a, b = centred(x), centred(y)
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b))), F.lit(0.0))
