import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from dendrospark.functions.models import rule_forest, trees_table
from dendrospark.operators import diagrams, grid

CUTS = [[0.0, 1.5, 3.0], [-1.0, 2.0], [0.5]]


@pytest.mark.parametrize(("rounds", "depth", "seed", "bias"), [(2, 2, 3, [0.0, 0.0, 0.0]), (1, 3, 5, [0.1, -0.2, 0.3])])
def test_cells_and_nodes_are_those_of_the_grid(spark, rounds, depth, seed, bias):
    trees = trees_table(spark, rule_forest(rounds, 3, CUTS, depth, seed))
    nodes, root, ends = diagrams.class_diagram(trees, bias, 3)
    found = {int(r.terminal): int(r.cells) for r in diagrams.cells_by_terminal(nodes, root, 3).collect()}
    assert found == {r["class"]: r.cells for r in grid.class_cells(trees, bias, 3).collect()}
    rows = nodes.collect()
    by_id = {(r.axis, r.node): r.arcs for r in rows}

    def end(point):
        at = root
        for axis, x in enumerate(point):
            at = next(a.child for a in by_id[axis, at] if a.end >= x)
        return at

    cells = {p: end(p) for p in itertools.product(*(range(e + 1) for e in ends))}
    for axis in range(3):
        # as many nodes as different functions of the axes from this one on
        tails = list(itertools.product(*(range(e + 1) for e in ends[axis:])))
        heads = itertools.product(*(range(e + 1) for e in ends[:axis]))
        different = {tuple(cells[h + t] for t in tails) for h in heads}
        assert len([r for r in rows if r.axis == axis]) == len(different)
    assert all(a.child != b.child for r in rows for a, b in itertools.pairwise(r.arcs))


def test_sums_are_single_precision_in_order(spark):
    got = spark.createDataFrame([("0.1", "0.2"), ("1.0E8", "1.0"), ("-0.0", "0.0")], "a string, b string").select(diagrams.add(F.col("a"), F.col("b")).alias("s"))
    assert [np.float32(r.s) for r in got.collect()] == [np.float32(0.1) + np.float32(0.2), np.float32(1e8), np.float32(0)]
