from fractions import Fraction

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dendrospark.functions import directed

WIDE = st.floats(min_value=-1e308, max_value=1e308, allow_nan=False)
SIZED = st.floats(min_value=2.0**-400, max_value=2.0**400) | st.floats(min_value=-(2.0**400), max_value=-(2.0**-400))


def tight(got, exact, down):
    """The double next to an exact number, on the right side."""
    near = float(exact)
    if down:
        return got == (near if Fraction(near) <= exact else np.nextafter(near, -np.inf))
    return got == (near if Fraction(near) >= exact else np.nextafter(near, np.inf))


@settings(max_examples=500, deadline=None)
@given(WIDE, WIDE)
def test_sums(a, b):
    exact = Fraction(a) + Fraction(b)
    low, high = float(directed.add_down(np.float64(a), np.float64(b))), float(directed.add_up(np.float64(a), np.float64(b)))
    if abs(exact) <= directed.LARGEST:
        assert Fraction(low) <= exact <= Fraction(high)
        if abs(exact) > 2.0**-1000 or exact == 0:
            assert tight(low, exact, True) and tight(high, exact, False)
    assert float(directed.sub_down(np.float64(a), np.float64(-b))) == low


@settings(max_examples=500, deadline=None)
@given(SIZED, SIZED)
def test_quotients(a, b):
    exact = Fraction(a) / Fraction(b)
    assert tight(float(directed.div_down(np.float64(a), np.float64(b))), exact, True)
    assert tight(float(directed.div_up(np.float64(a), np.float64(b))), exact, False)


def test_overflow_is_bounded():
    big = np.float64(directed.LARGEST)
    with np.errstate(over="ignore", invalid="ignore"):
        assert directed.add_down(big, big) == big and directed.add_up(big, big) == np.inf
        assert directed.add_up(-big, -big) == -big and directed.add_down(-big, -big) == -np.inf


def test_columns_equal_arrays(spark):
    rng = np.random.default_rng(5)
    a, b = (rng.normal(size=400) * 2.0 ** rng.integers(-60, 60, 400) for _ in range(2))
    df = spark.createDataFrame(list(zip(a.tolist(), b.tolist(), strict=True)), "a double, b double")
    names = ["add_down", "add_up", "sub_down", "sub_up", "div_down", "div_up"]
    got = df.select(*(getattr(directed, n)(F.col("a"), F.col("b")).alias(n) for n in names)).toPandas()
    for n in names:
        assert got[n].tolist() == getattr(directed, n)(a, b).tolist()
