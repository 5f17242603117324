import itertools
import math

import numpy as np
import pytest

from dendrospark.functions.models import rule_forest, trees_table
from dendrospark.operators import compiler, policy

CUTS = [[0.0, 1.5, 3.0], [-1.0, 2.0], [0.5]]


def log_probability(logits, order):
    left, total = list(order), 0.0
    while left:
        total += logits[left[0]] - math.log(sum(math.exp(logits[i]) for i in left))
        left.pop(0)
    return total


def test_gradient_by_differences_and_frequencies():
    logits = np.array([0.3, -0.5, 1.0])
    seen = {}
    for seed in range(6000):
        order, grad = policy.draw(logits, seed * 7919)
        seen[tuple(order)] = seen.get(tuple(order), 0) + 1
        if seed < 20:
            for f in range(3):
                step = np.eye(3)[f] * 1e-6
                slope = (log_probability(logits + step, order) - log_probability(logits - step, order)) / 2e-6
                assert grad[f] == pytest.approx(slope, abs=1e-6)
    for order in itertools.permutations(range(3)):
        assert seen.get(order, 0) / 6000 == pytest.approx(math.exp(log_probability(logits, order)), abs=0.03)


def test_costs_are_those_of_the_compiler(spark):
    trees = trees_table(spark, rule_forest(2, 3, CUTS, 2, 3))
    own = compiler.Ensemble([r.asDict() for r in trees.collect()], [0.0] * 3, 3, compiler.Domain())
    for order in itertools.permutations(range(3)):
        place = {f: i for i, f in enumerate(order)}
        nodes, _ = compiler.compile_graph(trees, [0.0] * 3, 3, policy=lambda nodes, p=place: min(range(len(nodes)), key=lambda i: (p[nodes[i][1]], i)))
        assert policy.graph_nodes(own, list(order), 1 << 16) == nodes.count()


def test_learning_keeps_the_best_order(spark):
    trees = trees_table(spark, rule_forest(3, 3, CUTS, 2, 4))
    progress, logits = policy.learn(trees, [0.0] * 3, 3, 4, 12)
    rows = progress.orderBy("round").collect()
    assert [r.best_cost for r in rows] == sorted((r.best_cost for r in rows), reverse=True)
    assert sorted(rows[-1].best_ordering) == [0, 1, 2] and all(math.isfinite(x) for x in logits)
    with pytest.raises(Exception, match="states"):
        policy.learn(trees, [0.0] * 3, 3, 1, 2, most=1)
