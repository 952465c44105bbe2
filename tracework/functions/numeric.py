"""Three ways to round, guarded ratios and divisions; each analysis names the rule it follows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_repr(x: Column, digits: int) -> Column:
    """Half up on the shortest decimal form: 2.675 gives 2.68. JVM-side."""
    return F.round(x.cast("double"), digits)


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often it is used."""
    return F.transform(F.array(value), body)[0]


def _split(x):
    """The upper and the lower half of a double's digits (Veltkamp); works on columns and on numbers."""
    c = x * 134217729.0
    high = c - (c - x)
    return high, x - high


def _rounded(x: Column, digits: int, up) -> Column:
    """``x`` rounded to ``digits`` by what its exact binary value says; ``up(d, rest, k)`` decides about a fraction that differs from a half by d + rest, above k.

    The fraction times 10**digits is one double and an error that is a double too, both exact, so it is known on which side of the half it lies.
    Large values, whose result has more than 53 bits before the division, go through their decimal form.
    """
    ten = 10.0**digits
    th, tl = _split(ten)

    def fraction(f: Column, i: Column) -> Column:
        """Nearest whole number to f * ten; ``i`` is the whole number before it, which makes the last digit where there are no others."""

        def error(p: Column) -> Column:
            fh, fl = _split(f)
            return ((fh * th - p) + fh * tl + fl * th) + fl * tl

        return _let(f * ten, lambda p: F.floor(p).cast("double") + F.when(up(p - F.floor(p) - 0.5, error(p), F.floor(p) if digits else i), 1.0).otherwise(0.0))

    def whole(i: Column, n: Column) -> Column:
        text = _let((i.cast("decimal(38,0)") * F.lit(10**digits).cast("decimal(19,0)") + n.cast("decimal(19,0)")).cast("decimal(38,0)").cast("string"), lambda t: F.concat(t, F.lit(f"E-{digits}")))
        return F.when(i * ten + n < 2.0**53, (i * ten + n) / ten).otherwise(text.cast("double"))

    def magnitude(a: Column) -> Column:
        return F.when(a >= 2.0**52, a).otherwise(_let(F.floor(a).cast("double"), lambda i: _let(fraction(a - i, i), lambda n: whole(i, n))))

    x = x.cast("double")
    return F.when(~F.isnan(x), F.when(x < 0, -_let(F.abs(x), magnitude)).otherwise(_let(F.abs(x), magnitude)))


def round_binary(x: Column, digits: int) -> Column:
    """Half up (away from zero) on the exact binary value: 2.675 gives 2.67. JVM-side; null for NaN."""
    return _rounded(x, digits, lambda d, rest, k: (d > 0) | ((d == 0) & (rest >= 0)))


def round_even(x: Column, digits: int) -> Column:
    """Half to even on the exact binary value. JVM-side; null for NaN."""
    return _rounded(x, digits, lambda d, rest, k: (d > 0) | ((d == 0) & ((rest > 0) | ((rest == 0) & (k % 2 == 1)))))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def floor_div(a: Column, b: Column) -> Column:
    """Division that rounds down, also below zero; null for a zero divisor."""
    return F.floor(F.try_divide(a.cast("double"), b.cast("double"))).cast("long")


def percent(a: Column, b: Column) -> Column:
    """Whole percent, half up; 0 for a zero denominator."""
    return F.floor(100.0 * ratio(a, b) + 0.5).cast("long")


def half_up(x: Column) -> Column:
    """Nearest whole number of a non-negative value, half up."""
    return F.floor(x + 0.5).cast("long")
