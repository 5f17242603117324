"""Single-precision semantics as column expressions: branches, ordered sums, first winner, bits."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")
MISSING_WORDS = ("", "nan", "na", "null")  #: texts of a missing feature, in either case (fixed values)


def single(value: float) -> Column:
    """A literal with exactly the FP32 value of ``value``."""
    return F.lit(float(np.float32(value))).cast("float")


def goes_left(x: Column, cut: Column, default_left: Column) -> Column:
    """Strict less-than in single precision; a missing value (NaN) follows the default side."""
    return F.when(F.isnan(x), default_left).otherwise(x < cut)


def or_missing(x: Column) -> Column:
    return F.coalesce(x.cast("float"), F.lit(NAN).cast("float"))


def parse_feature(text: Column) -> Column:
    """A decimal as FP32, a missing word as NaN, anything else (infinities too) as null."""
    token = F.trim(text)
    plain = F.regexp_replace(token, r"^\+", "")
    value = F.when(plain.rlike(r"^-?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), plain.try_cast("float"))
    finite = F.when(F.abs(value) < float("inf"), value)
    return F.when(F.lower(token).isin(*MISSING_WORDS), F.lit(NAN).cast("float")).otherwise(finite)


def ordered_sum(values: Column, start: Column) -> Column:
    """Adds an array<float> in its order, rounding to single precision at each step."""
    return F.aggregate(values, start.cast("float"), lambda total, x: (total + x).cast("float"))


def first_winner(scores: Column) -> Column:
    """The first index with the greatest score."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def softmax(margins: Column) -> Column:
    """Probabilities in single precision, the greatest margin subtracted first."""
    top = F.array_max(margins)
    raised = F.transform(margins, lambda m: F.exp((m - top).cast("double")).cast("float"))
    total = ordered_sum(raised, F.lit(0.0))
    return F.transform(raised, lambda r: (r / total).cast("float"))


def bits(x: Column) -> Column:
    """The 32 bits of a float, as int: -0.0 and 0.0 differ, and NaN payloads too."""
    return F.call_function("reflect", F.lit("java.lang.Float"), F.lit("floatToRawIntBits"), x.cast("float")).cast("int")


def from_bits(word: Column) -> Column:
    """The float with these bits, by exact arithmetic on its fields (NaN for all NaN words)."""
    raised = F.shiftright(word, 23).bitwiseAND(F.lit(255))
    fraction = word.bitwiseAND(F.lit((1 << 23) - 1)).cast("double")
    size = F.when(raised == 0, fraction * 2.0**-149).otherwise((fraction + 2.0**23) * F.pow(F.lit(2.0), raised.cast("double") - 150))
    size = F.when(raised < 255, size).when(fraction == 0, float("inf")).otherwise(NAN)
    return F.when(word < 0, -size).otherwise(size).cast("float")


def order_key(word: Column) -> Column:
    """A key (as long) that sorts words as their floats; both zeros have the key 0."""
    wide = word.cast("long")
    return F.when(wide < 0, F.lit(-(2**31)) - wide).otherwise(wide)


def rank_of(x: Column, cuts: Column) -> Column:
    """How many of the sorted ``cuts`` are at most ``x``; -1 for a missing value."""
    return F.when(F.isnan(x), F.lit(-1)).otherwise(F.size(F.filter(cuts, lambda c: c <= x)))


def weighted_plane(x: Column, terms: list[tuple[float, int]], threshold: float) -> Column:
    """The sum of weight times feature in double precision, term by term from +0, below a threshold."""
    total = F.lit(0.0)
    for weight, feature in terms:
        total = total + F.lit(float(np.float32(weight))) * x[feature].cast("double")
    return total < F.lit(float(threshold))


def half_ulp(x: Column) -> Column:
    """Half the gap from a finite float's magnitude to the next one: the most that rounding to it moves a number; null else."""
    size = F.abs(x.cast("float"))
    following = from_bits(bits(size) + 1).cast("double")
    return F.when((size < float("inf")) & (following < float("inf")), (following - size.cast("double")) / 2)


def lowest_bit(x: Column) -> Column:
    """The place of the lowest set bit of a long, -1 for none."""
    digits = F.bin(x.cast("long"))
    return F.when(x == 0, -1).otherwise(F.length(digits) - F.length(F.rtrim(digits, F.lit("0")))).cast("int")


def highest_bit(x: Column) -> Column:
    """The place of the highest set bit of a long, -1 for none."""
    return (F.length(F.ltrim(F.bin(x.cast("long")), F.lit("0"))) - 1).cast("int")


def soft_gate(x: Column, cut: Column, width: Column) -> tuple[Column, Column]:
    """The share of a value that goes left, sigmoid((cut - x) / width), and its derivative by x; neither overflows."""
    z = (cut.cast("double") - x.cast("double")) / width.cast("double")
    small = F.exp(-F.abs(z))
    share = F.when(z >= 0, 1 / (1 + small)).otherwise(small / (1 + small))
    return share, -small / ((1 + small) * (1 + small)) / width.cast("double")


def word_of(value: float) -> int:
    """Bits of a Python number's FP32 value, as a signed 32-bit integer."""
    return struct.unpack("<i", struct.pack("<f", value))[0]


def value_of(word: int) -> float:
    return struct.unpack("<f", struct.pack("<i", word))[0]


def decimal_text(value: float) -> str:
    """Up to nine significant digits, which single out every FP32 value."""
    return f"{float(np.float32(value)):.9g}"
