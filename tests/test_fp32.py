import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from dendrospark.functions import fp32

#: Words at the edges of single precision: extremes, both zeros, subnormals, NaNs of both signs.
WORDS = [0xFF7FFFFF, 0xBF800000, 0x80000001, 0x80000000, 0x00000000, 0x00000001, 0x3F800000, 0x7F7FFFFF, 0x7FC00001, 0xFFC12345]
SIGNED = [w - (w >> 31 << 32) for w in WORDS]


def words(spark):
    return spark.createDataFrame([(i, w) for i, w in enumerate(SIGNED)], "i int, w int")


def test_bits_round_trip(spark):
    out = words(spark).select("i", "w", fp32.from_bits(F.col("w")).alias("x")).withColumn("b", fp32.bits(F.col("x"))).orderBy("i").collect()
    for r, w in zip(out, WORDS, strict=True):
        want = struct.unpack("<f", struct.pack("<I", w))[0]
        assert math.isnan(r.x) if math.isnan(want) else (r.x == want and r.b == r.w)


def test_order_keys_follow_values(spark):
    numbers = [w for w in SIGNED if not math.isnan(fp32.value_of(w))]
    df = spark.createDataFrame([(w,) for w in numbers], "w int").select("w", fp32.order_key(F.col("w")).alias("k")).collect()
    keys = {r.w: r.k for r in df}
    for a in numbers:
        for b in numbers:
            assert (keys[a] < keys[b]) == (fp32.value_of(a) < fp32.value_of(b))


def test_branch_is_strict_and_missing_follows_its_side(spark):
    df = words(spark).select("i", fp32.from_bits(F.col("w")).alias("x"))
    for w in WORDS[:8]:
        cut = struct.unpack("<f", struct.pack("<I", w))[0]
        for side in (True, False):
            out = df.select("x", fp32.goes_left(F.col("x"), fp32.single(cut), F.lit(side)).alias("l")).collect()
            assert all(r.l == (side if math.isnan(r.x) else np.float32(r.x) < np.float32(cut)) for r in out)


def test_sums_keep_order_and_precision(spark):
    values = [1e8, 1.0, -1e8, 1.0, 0.1, 3e-8]
    df = spark.createDataFrame([(values,), (values[::-1],)], "v array<float>")
    got = [r.s for r in df.select(fp32.ordered_sum(F.col("v"), F.lit(0.5)).alias("s")).collect()]
    for g, v in zip(got, (values, values[::-1]), strict=True):
        total = np.float32(0.5)
        for x in v:
            total = np.float32(total + np.float32(x))
        assert np.float32(g) == total


def test_first_winner(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0],), ([-0.0, 0.0],), ([2.0],)], "v array<float>")
    assert [r.w for r in df.select(fp32.first_winner(F.col("v")).alias("w")).collect()] == [1, 0, 0]


@pytest.mark.parametrize(("text", "want"), [("1", 1.0), (" +2.5e1 ", 25.0), ("-.5", -0.5), ("", "nan"), (" NA", "nan"), ("Null", "nan"), ("NaN", "nan"), ("inf", None), ("Infinity", None), ("1e400", None), ("1.5f", None), ("1d", None), ("0x10", None), ("--1", None), ("++1", None), ("1 2", None)])
def test_parse_feature(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(fp32.parse_feature(F.col("t")).alias("x")).first().x
    assert math.isnan(got) if want == "nan" else got == want


def test_decimal_text_round_trips():
    for w in SIGNED[:8]:
        assert fp32.word_of(float(fp32.decimal_text(fp32.value_of(w)))) == w
