"""Double-precision sums, differences and quotients rounded down or up, on columns and on NumPy arrays alike.

A result is first rounded to nearest; its exact error, from an error-free transformation, then tells whether the
neighbour below (above) is the result wanted.  Results are the tightest ones wherever neighbours are normal numbers,
and bounds everywhere: below that range they may be one step wide of it, and a sum that overflows is bounded by the
largest number.  Operands must be finite.
"""

from __future__ import annotations

from typing import Any

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Number = Any  #: a Column, an array or a number

LARGEST, SMALLEST = 1.7976931348623157e308, 5e-324
UNIT = 2.0**-53
NEIGHBOUR = UNIT * (1 + 2 * UNIT)  #: this share of a normal number, added to it, rounds to the next one
SPLITTER = 2.0**27 + 1


def _pick(condition: Number, a: Number, b: Number) -> Number:
    return F.when(condition, a).otherwise(b) if isinstance(condition, Column) else np.where(condition, a, b)


def _size(x: Number) -> Number:
    return F.abs(x) if isinstance(x, Column) else np.abs(x)


def _lit(x: Number, like: Number) -> Number:
    return F.lit(x) if isinstance(like, Column) and not isinstance(x, Column) else x


def below(x: Number) -> Number:
    return x - (_size(x) * NEIGHBOUR + SMALLEST)


def above(x: Number) -> Number:
    return x + (_size(x) * NEIGHBOUR + SMALLEST)


def sum_error(a: Number, b: Number, s: Number) -> Number:
    """a + b - s, exactly, for s = a + b rounded to nearest."""
    part = s - a
    return (a - (s - part)) + (b - part)


def product_error(a: Number, b: Number, p: Number) -> Number:
    """a * b - p, exactly, for p = a * b rounded to nearest, unless parts of it over- or underflow."""

    def halves(x: Number) -> tuple[Number, Number]:
        wide = x * SPLITTER
        high = wide - (wide - x)
        return high, x - high

    (ah, al), (bh, bl) = halves(a), halves(b)
    return al * bl - (((p - ah * bh) - al * bh) - ah * bl)


def _finite(x: Number) -> Number:
    return _size(x) <= LARGEST


def add_down(a: Number, b: Number) -> Number:
    s = a + b
    near = _pick(sum_error(a, b, s) < 0, below(s), s)
    return _pick(_finite(s), near, _pick(s > 0, _lit(LARGEST, s), s))


def add_up(a: Number, b: Number) -> Number:
    s = a + b
    near = _pick(sum_error(a, b, s) > 0, above(s), s)
    return _pick(_finite(s), near, _pick(s < 0, _lit(-LARGEST, s), s))


def sub_down(a: Number, b: Number) -> Number:
    return add_down(a, -b)


def sub_up(a: Number, b: Number) -> Number:
    return add_up(a, -b)


def _rest(a: Number, b: Number, q: Number) -> Number:
    """The sign of a / b - q: that of the remainder times the divisor's."""
    p = q * b
    rest = (a - p) - product_error(q, b, p)
    return _pick(b > 0, rest, -rest)


def div_down(a: Number, b: Number) -> Number:
    """a / b rounded down, for a divisor that is not zero and operands from 2^-450 to 2^450 in size."""
    q = a / b
    return _pick(_rest(a, b, q) < 0, below(q), q)


def div_up(a: Number, b: Number) -> Number:
    q = a / b
    return _pick(_rest(a, b, q) > 0, above(q), q)
