"""Running values along a global order, without a task that sees all rows.

Rows are cut into ranges of the order and written once, so that every later read has the same ranges.
A range's summary (its rows, its best) is one row; summaries are as many as the ranges, which
``spark.sql.shuffle.partitions`` bounds, and are carried over on the driver.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import bounded, cut

MOST_RANGES = 1 << 20
CHUNK = 1 << 14  #: places of a chunk of a sliding window


def ranged(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``_range``, the number of the range of ``order`` that a row lies in."""
    return cut(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``_place``, from 0 along ``order``, which must tell all rows apart."""
    own = ranged(rows, *order)
    sizes = dict(bounded(own.groupBy("_range").count(), MOST_RANGES, "ranges"))
    ends = list(accumulate(sizes.get(k, 0) for k in range(max(sizes, default=-1) + 1)))
    starts = F.array(*(F.lit(n).cast("long") for n in (0, *ends)))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return own.withColumn("_place", F.get(starts, F.col("_range")) + within - 1).drop("_range")


def dense_places(rows: DataFrame, key: str) -> DataFrame:
    """(key, place): the dense rank, from 1, of each different value of ``key``."""
    return placed(rows.select(key).distinct(), key).select(key, (F.col("_place") + 1).alias("place"))


def running_least(rows: DataFrame, order: str, value: Column) -> DataFrame:
    """``rows`` with ``_least``, the least ``value`` (a struct of longs) up to each row along ``order``."""
    own = ranged(rows.withColumn("_value", value), order)
    found = sorted(bounded(own.groupBy("_range").agg(F.min("_value").alias("least")), MOST_RANGES, "ranges"))
    kind = own.schema["_value"].dataType
    carried = list(accumulate((r["least"] for r in found), min))
    before = own.sparkSession.createDataFrame([(r["_range"], tuple(c)) for r, c in zip(found[1:], carried, strict=False)], f"_range int, _before {kind.simpleString()}")
    least = F.min("_value").over(Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    joined = own.withColumn("_own", least).join(F.broadcast(before), "_range", "left")
    return joined.withColumn("_least", F.when(F.col("_before") < F.col("_own"), F.col("_before")).otherwise(F.col("_own"))).drop("_range", "_value", "_own", "_before")


def sliding(rows: DataFrame, order: str, size: int, chunk: int = CHUNK) -> DataFrame:
    """``rows`` with a copy of each for every chunk whose windows of ``size`` rows it is part of.

    Windows go over ``_chunk`` in the order of ``_place``; copies, marked ``_copy``, are dropped after.
    """
    own = placed(rows, order)
    home = F.floor(F.col("_place") / chunk)
    reach = F.floor((F.col("_place") + size - 1) / chunk)
    chunks = own.withColumn("_home", home).withColumn("_chunk", F.explode(F.sequence(home, reach)))
    return chunks.withColumn("_copy", F.col("_chunk") > F.col("_home")).drop("_home")
