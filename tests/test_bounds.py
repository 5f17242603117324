import itertools

import numpy as np
import pytest

from dendrospark.functions.models import rule_forest, trees_table
from dendrospark.operators import evaluation, regions

CUTS = [[float(3 * i + f) for i in range(1, 10 - 2 * f)] for f in range(3)]


def value(rows, tree, x):
    own = {r[2]: r for r in rows if r[0] == tree}
    n = 0
    while own[n][3] >= 0:
        v = x[own[n][3]]
        n = own[n][7] if (own[n][6] if np.isnan(v) else np.float32(v) < np.float32(own[n][4])) else own[n][8]
    return np.float32(own[n][9])


def used(rows):
    return [sorted({r[4] for r in rows if r[3] == f}) for f in range(3)]


def some_parts(rows, seed, n=8):
    """(region, lo, hi, sides), the last one of missing values alone, and each part's points."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        ends = [sorted(rng.integers(0, len(c) + 1, 2).tolist()) for c in used(rows)]
        out.append((i, [e[0] for e in ends], [e[1] for e in ends], rng.integers(0, 2, 3).tolist()))
    out.append((n, [1] * 3, [0] * 3, [1] * 3))
    points = {}
    for i, lo, hi, sides in out:
        axes = [[(c[0] - 1, *c)[b] for b in range(a, z + 1)] + [float("nan")] * m for c, a, z, m in zip(used(rows), lo, hi, sides, strict=True)]
        points[i] = list(itertools.product(*axes))
    return out, points


@pytest.mark.parametrize(("seed", "axis"), [(1, 0), (2, 1), (3, 2)])
def test_pair_bounds(spark, seed, axis):
    rows = rule_forest(2, 2, CUTS, 3, seed)
    parts, points = some_parts(rows, seed)
    trees = trees_table(spark, rows)
    got = regions.pair_bounds(spark.createDataFrame(parts, "region int, lo array<int>, hi array<int>, sides array<int>"), regions.leaf_partitions(trees, 3), spark.createDataFrame([(0, 2), (1, 3), (0, 1)], "a int, b int"), axis)
    want = {}
    for (a, b), region in itertools.product([(0, 2), (1, 3), (0, 1)], points):
        sums = [np.float32(value(rows, a, x) + value(rows, b, x)) for x in points[region]]
        want[region, a, b] = float(min(sums)), float(max(sums))
    assert {(r.region, r.a, r.b): (r.least, r.greatest) for r in got.collect()} == want


@pytest.mark.parametrize("size", [3, 1024])
def test_pair_bounds_gather_no_regions(spark, monkeypatch, size):
    rows = rule_forest(2, 2, CUTS, 3, 5)
    parts, points = some_parts(rows, 5)
    parts.append((len(parts), [2] * 3, [1] * 3, [0] * 3))  # no points, so no bounds
    monkeypatch.setattr(regions, "LIST", size)
    parts = spark.createDataFrame(parts, "region int, lo array<int>, hi array<int>, sides array<int>")
    got = regions.pair_bounds(parts, regions.leaf_partitions(trees_table(spark, rows), 3), spark.createDataFrame([(0, 2), (1, 3), (0, 2)], "a int, b int"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    # with one list a pair, nothing is dealt by region
    assert ("Exchange hashpartitioning(region" in plan) == (size == 3)
    want = {}
    for (a, b), region in itertools.product([(0, 2), (1, 3)], points):
        sums = [np.float32(value(rows, a, x) + value(rows, b, x)) for x in points[region]]
        want[region, a, b] = float(min(sums)), float(max(sums))
    found = got.collect()
    assert len(found) == len(want) and {(r.region, r.a, r.b): (r.least, r.greatest) for r in found} == want


def test_grouped_bounds(spark):
    rows = rule_forest(9, 2, CUTS, 1, 4)
    parts, points = some_parts(rows, 7)
    trees = trees_table(spark, rows)
    table = regions.range_table(regions.axis_sums(trees, regions.leaf_partitions(trees, 3)))
    got = regions.grouped_bounds(spark.createDataFrame(parts, "region int, lo array<int>, hi array<int>, sides array<int>"), table).collect()
    assert len(got) == 2 * len(parts)
    for r in got:
        sums = [sum(float(value(rows, t, x)) for t in range(r.channel, 18, 2)) for x in points[r.region]]
        # sums of so few single-precision numbers are exact in double precision
        assert (r.least, r.greatest) == (min(sums), max(sums))


def test_grouped_bounds_refuse_trees_of_several_features(spark):
    trees = trees_table(spark, rule_forest(1, 2, CUTS, 3, 4))
    with pytest.raises(Exception, match="several features"):
        regions.axis_sums(trees, regions.leaf_partitions(trees, 3)).collect()


def test_conflicts_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(8)
    boxes = []
    for tree, leaf in itertools.product(range(3), range(30)):
        ends = np.sort(rng.integers(0, 12, (3, 2)), axis=1)
        boxes.append((tree, leaf, ends[:, 0].tolist(), ends[:, 1].tolist()))
    want = {(t, i, j) for (t, i, a, b), (u, j, c, d) in itertools.product(boxes, boxes) if t == u and i < j and all(x <= w and z <= y for x, y, z, w in zip(a, b, c, d, strict=True))}
    got = evaluation.tree_conflicts(spark.createDataFrame(boxes, "tree int, leaf int, lo array<int>, hi array<int>")).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    trees = trees_table(spark, rule_forest(2, 2, CUTS, 3, 5))
    assert evaluation.tree_conflicts(regions.leaf_partitions(trees, 3)).isEmpty()


@pytest.mark.parametrize("few", [0, 64])
def test_boxes_that_meet_are_those_of_all_pairs(spark, monkeypatch, few):
    monkeypatch.setattr(evaluation, "FEW", few)
    rng = np.random.default_rng(3)
    boxes = []
    for tree, leaf in itertools.product(range(2), range(40)):
        ends = rng.integers(0, 33, (3, 2))
        boxes.append((tree, leaf, ends.min(1).tolist(), ends.max(1).tolist(), rng.integers(0, 2, 3).tolist()))
    boxes.append((0, 40, [1] * 3, [0] * 3, [1] * 3))  # missing values alone
    table = spark.createDataFrame(boxes, "tree int, leaf int, lo array<int>, hi array<int>, sides array<int>")
    want = {}
    for (t, i, *one), (u, j, *other) in itertools.product(boxes, boxes):
        lo, hi, sides = [max(p) for p in zip(one[0], other[0])], [min(p) for p in zip(one[1], other[1])], [min(p) for p in zip(one[2], other[2])]
        if t == u and all(a <= z or m for a, z, m in zip(lo, hi, sides)):
            want[t, i, j] = lo, hi, sides
    got = regions.meet(table, table, ["tree"], 1).collect()
    assert len(got) == len(want) and {(r.tree, r.leaf, r._leaf): (r.lo, r.hi, r.sides) for r in got} == want
    conflicts = evaluation.tree_conflicts(table).collect()
    solid = {k for k in want if k[1] < k[2] and all(a <= z for a, z in zip(*want[k][:2]))}
    assert len(conflicts) == len(solid) and {tuple(r) for r in conflicts} == solid


def test_boxes_meet_by_few_rows_and_no_side_is_broadcast(spark):
    # 40 boxes over nearly all of 100,000 bins: laid out bin by bin they were 4,000,000 rows, sent to every executor
    boxes = [(0, leaf, [leaf], [99_999 - leaf], [0]) for leaf in range(40)]
    table = spark.createDataFrame(boxes, "tree int, leaf int, lo array<int>, hi array<int>, sides array<int>")
    from pyspark.sql import functions as F

    ways = regions.spans(F.get("lo", F.lit(0)), F.get("hi", F.lit(0)), F.get("sides", F.lit(0)), 17)
    assert table.select(*(F.max(F.size(w)).alias(f"n{i}") for i, w in enumerate(ways))).first() <= (60, 60)
    met = regions.meet(table, table, ["tree"], 0)
    assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()
    assert met.count() == 1600
