"""The finite grid that an ensemble's cuts make of its domain, and audits over all of its cells."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fp32 import NAN, first_winner
from ..plans.storage import bounded
from .scoring import margins, predict

MOST_CUTS = 1 << 16


def cut_catalog(trees: DataFrame) -> DataFrame:
    """(feature, cuts): the distinct cuts of each feature in order; both zeros are one cut."""
    cuts = trees.where("feature >= 0").select("feature", (F.col("cut") + F.lit(0.0).cast("float")).alias("cut")).distinct()
    return cuts.groupBy("feature").agg(F.array_sort(F.collect_list("cut")).alias("cuts"))


def axis_bins(trees: DataFrame) -> DataFrame:
    """(feature, bins): one more than its cuts."""
    return cut_catalog(trees).select("feature", (F.size("cuts") + 1).alias("bins"))


def axis_points(trees: DataFrame, features: int, missing: bool) -> list[list[float]]:
    """A point in each bin of each feature, NaN last where features may be missing."""
    known = {r["feature"]: r["cuts"] for r in bounded(cut_catalog(trees), MOST_CUTS, "features")}
    out = []
    for f in range(features):
        cuts = [np.float32(c) for c in known.get(f, [])]
        points = [float(np.nextafter(cuts[0], np.float32(-np.inf)))] if cuts else [0.0]
        points += [float(c) for c in cuts]
        out.append([p for p in points if abs(p) < float("inf")] + [NAN] * missing)
    return out


def cells(axes: list[list[float]]) -> int:
    """Exactly how many cells the grid has."""
    total = 1
    for a in axes:
        total *= len(a)
    return total


def points(spark: SparkSession, axes: list[list[float]], most: int = 50_000_000) -> DataFrame:
    """(cell, x0, x1, ...): one point of every cell, decoded from the cell's number."""
    total = cells(axes)
    if total > most:
        raise ValueError(f"the grid has {total} cells, more than {most}")
    columns: list[Column] = []
    step = 1
    for f, a in enumerate(axes):
        at = (F.floor(F.col("cell") / step) % len(a) + 1).cast("int")
        columns.append(F.element_at(F.array(*(F.lit(v).cast("float") for v in a)), at).alias(f"x{f}"))
        step *= len(a)
    return spark.range(total).withColumnRenamed("id", "cell").select("cell", *columns)


def audit(trees: DataFrame, bias: list[float], nodes: DataFrame, root: int, features: int, missing: bool = True) -> DataFrame:
    """One row: cells and the cells on which graph and ensemble differ; must be none."""
    axes = axis_points(trees, features, missing)
    names = [f"x{f}" for f in range(features)]
    grid = points(trees.sparkSession, axes)
    both = predict(margins(grid, trees, names, bias), nodes, root, names, name="graph_class").withColumn("source_class", first_winner(F.col("margins")))
    return both.agg(F.count("*").alias("cells"), F.count_if(~F.col("graph_class").eqNullSafe(F.col("source_class"))).alias("mismatches"))


def class_cells(trees: DataFrame, bias: list[float], features: int, missing: bool = True) -> DataFrame:
    """(class, cells): how many cells of the grid each class has."""
    names = [f"x{f}" for f in range(features)]
    grid = margins(points(trees.sparkSession, axis_points(trees, features, missing)), trees, names, bias)
    return grid.groupBy(first_winner(F.col("margins")).alias("class")).agg(F.count("*").alias("cells"))


def settled_bounds(low: Fraction, high: Fraction, total: int) -> tuple[int, int]:
    """Whole cells certainly settled and certainly left, from bounds on the settled share."""
    settled = -(-low.numerator * total // low.denominator)
    return settled, total - high.numerator * total // high.denominator
