"""Column expressions: frequencies, safe division, array algebra."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")


def divide(a: Column, b: Column) -> Column:
    """a / b, NaN where b is 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(NAN))


def rounded(c: Column | str, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(c, digits) + F.lit(0.0)


def frequency(k: Column, m: Column | int, fs: float) -> Column:
    """The frequency of bin k of m, negative from the middle on."""
    m = m if isinstance(m, Column) else F.lit(m)
    return F.when(2 * k < m, k).otherwise(k - m) * F.lit(float(fs)) / m


def cyclic_shift(x: Column, shift: Column) -> Column:
    """x moved to the right by ``shift`` places, its end coming in at its beginning."""
    n = F.size(x)
    s = F.pmod(shift.cast("int"), n)
    return F.concat(F.slice(x, n - s + 1, s), F.slice(x, F.lit(1), n - s))


def gaussian(x: Column, sigma: Column) -> Column:
    """Ten times the normal density."""
    z = x / sigma
    return F.exp(-0.5 * z * z) * 10.0 / (sigma * F.sqrt(2 * F.pi()))


def linspace(i: Column, low: float, high: float, n: int) -> Column:
    return F.lit(low) + i * F.lit((high - low) / (n - 1))


def has_nan(x: Column) -> Column:
    return F.exists(x, lambda v: v.isNull() | F.isnan(v))


def mean_of(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / F.size(x)


def let(value: Column, f) -> Column:
    """f(value), the value computed once for the row rather than wherever f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def z_score(x: Column) -> Column:
    """(x - mean) / standard deviation (ddof 0) of an array."""

    def scaled(mean: Column) -> Column:
        scale = F.sqrt(mean_of(F.transform(x, lambda v: (v - mean) * (v - mean))))
        return let(scale, lambda s: F.transform(x, lambda v: divide(v - mean, s)))

    return let(mean_of(x), scaled)


def diagonal_count(t: Column, n: Column, length: Column | int, compat: bool = False) -> Column:
    """How many cells of the trajectory matrix of a series of n values, windows of ``length``, lie on anti-diagonal t; ``compat`` follows the original's own formula, which is lower where n < 3 * length - 2 and an error where n < 2 * length - 1."""
    length = length if isinstance(length, Column) else F.lit(length)
    rows = n - length + 1
    if compat:  # as the original, which has no count here
        rows = F.when(rows - length + 1 < 1, F.raise_error(F.lit("a series must have at least 2 * length - 1 values"))).otherwise(rows)
    middle = F.least(rows - length + 1, length) if compat else F.least(rows, length)
    return F.least(t + 1, n - t, middle)
