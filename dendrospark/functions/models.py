"""Schemas of models, and models made by rule for examples and tests."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .fp32 import value_of, word_of

#: A node of an additive ensemble; leaves have feature, left and right -1 and carry a value.
TREES = "tree int, channel int, node int, feature int, cut float, cut_bits int, default_left boolean, left int, right int, value float"
#: A node of a decision graph; leaves have feature, left and right -1 and carry a class.
NODES = "node int, feature int, cut float, cut_bits int, default_left boolean, left int, right int, class int"

Split = tuple[int, float, bool, int, int]


def split_mix(state: int) -> tuple[int, int]:
    """The next state and value of the SplitMix64 sequence."""
    wide = (1 << 64) - 1
    state = state + 0x9E3779B97F4A7C15 & wide
    z = state
    z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & wide
    z = (z ^ z >> 27) * 0x94D049BB133111EB & wide
    return state, z ^ z >> 31


def rule_forest(rounds: int, classes: int, cuts: list[list[float]], depth: int = 2, seed: int = 1) -> list[tuple]:
    """TREES rows of full trees whose features, cuts, default sides and leaves come from SplitMix64.

    Leaf values are small multiples of 0.1, so that the order of single-precision sums shows.
    """
    rows, state = [], seed
    for tree in range(rounds * classes):
        for node in range(2 ** (depth + 1) - 1):
            state, r = split_mix(state)
            if node < 2**depth - 1:
                feature = r % len(cuts)
                cut = cuts[feature][(r >> 16) % len(cuts[feature])]
                rows.append((tree, tree % classes, node, feature, float(np.float32(cut)), word_of(cut), bool(r >> 40 & 1), 2 * node + 1, 2 * node + 2, None))
            else:
                rows.append((tree, tree % classes, node, -1, None, None, None, -1, -1, float(np.float32((r % 21 - 10) / 10))))
    return rows


def trees_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, TREES)


def branch(node: int, feature: int, cut: float, default_left: bool, left: int, right: int) -> tuple:
    return node, feature, float(np.float32(cut)), word_of(cut), default_left, left, right, None


def branch_bits(node: int, feature: int, word: int, default_left: bool, left: int, right: int) -> tuple:
    return node, feature, value_of(word), word, default_left, left, right, None


def leaf(node: int, label: int) -> tuple:
    return node, -1, None, None, None, -1, -1, label


def nodes_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, NODES)


def demo_graph() -> tuple[list[tuple], int]:
    """Three features, three classes, five nodes, and its root."""
    return [leaf(0, 0), leaf(1, 1), leaf(2, 2), branch(3, 0, 0.0, False, 1, 0), branch(4, 2, 0.5, False, 3, 2)], 4
