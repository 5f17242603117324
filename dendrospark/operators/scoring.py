"""Rows through graphs and ensembles: classes, paths, margins.

A graph is scored in one of three ways with equal results: as one CASE expression (small graphs,
whole-stage codegen), by a join a level (no Python, and it keeps the path), or by an Arrow UDF
over node arrays (large graphs).  Models are small against the rows, and are only broadcast
within a checked bound; beyond it the level join shuffles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fp32 import first_winner, goes_left, single
from ..plans.storage import bounded
from .graph import MOST_NODES, heights

CASE_NODES = 256
BROADCAST_NODES = 1 << 16


def require_finite(rows: DataFrame, features: list[str]) -> DataFrame:
    """``rows`` with an error, when they are read, for any infinite feature."""
    bad = F.lit(False)
    for f in features:
        bad = bad | (F.abs(F.col(f)) == float("inf"))
    first = features[0]
    return rows.withColumn(first, F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit("infinite feature")).cast("float")).otherwise(F.col(first)))


def case_column(nodes: dict[int, object], root: int, features: list[str], most: int = CASE_NODES) -> Column:
    left = [most]

    def build(node: int) -> Column:
        left[0] -= 1
        if left[0] < 0:
            raise ValueError(f"the expression has more than {most} nodes")
        r = nodes[node]
        if r["feature"] == -1:
            return F.lit(r["class"])
        test = goes_left(F.col(features[r["feature"]]), single(r["cut"]), F.lit(r["default_left"]))
        return F.when(test, build(r["left"])).otherwise(build(r["right"]))

    return build(root).cast("int")


def predict(rows: DataFrame, nodes: DataFrame, root: int, features: list[str], how: str = "auto", name: str = "class") -> DataFrame:
    """``rows`` with the class that the graph gives them."""
    if how == "join":
        return paths(rows, nodes, root, features).withColumnRenamed("class", name).drop("path")
    known = {r["node"]: r for r in bounded(nodes, MOST_NODES, "graph")}
    if how in ("auto", "case"):
        try:
            return rows.withColumn(name, case_column(known, root, features))
        except ValueError:
            if how == "case":
                raise
    order = sorted(known)
    at = {n: i for i, n in enumerate(order)}
    column = lambda key, none: np.array([none if known[n][key] is None else known[n][key] for n in order])
    feature, bound, side, label = column("feature", -1), column("cut", 0).astype(np.float32), column("default_left", False).astype(bool), column("class", -1)
    down = np.array([[at.get(known[n]["right"], 0), at.get(known[n]["left"], 0)] for n in order])
    shared = rows.sparkSession.sparkContext.broadcast((feature, bound, side, down, label, at[root]))

    @F.pandas_udf("int")
    def walk(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        feature, bound, side, down, label, start = shared.value
        for columns in parts:
            x = np.stack([c.to_numpy(np.float32) for c in columns], 1)
            here = np.full(len(x), start)
            while len(open_rows := np.flatnonzero(feature[here] >= 0)):
                node = here[open_rows]
                v = x[open_rows, feature[node]]
                left = np.where(np.isnan(v), side[node], v < bound[node])
                here[open_rows] = down[node, left.astype(int)]
            yield pd.Series(label[here], dtype="int32")

    return rows.withColumn(name, walk(*(F.col(f) for f in features)))


def paths(rows: DataFrame, nodes: DataFrame, root: int, features: list[str], most: int = 4096) -> DataFrame:
    """``rows`` with ``class`` and ``path`` (the nodes visited), by one join of rows and nodes a level.

    A path longer than ``most`` nodes is an error.
    """
    top = heights(nodes).where(F.col("node") == root).first()
    if top is None:
        raise ValueError("the root is missing")
    if top["height"] + 1 > most:
        raise ValueError(f"paths may have {top['height'] + 1} nodes, more than {most}")
    side = nodes.select(*(F.col(c).alias(f"n_{c}") for c in ("node", "feature", "cut", "default_left", "left", "right", "class")))
    if nodes.count() <= BROADCAST_NODES:
        side = F.broadcast(side)
    state = rows.withColumn("_at", F.lit(root)).withColumn("path", F.array(F.lit(root)))
    x = F.element_at(F.array(*(F.col(f) for f in features)), F.col("n_feature") + 1)
    for _ in range(top["height"]):
        here = state.join(side, F.col("_at") == F.col("n_node"))
        down = F.when(F.col("n_feature") == -1, F.col("_at")).otherwise(F.when(goes_left(F.when(F.col("n_feature") >= 0, x), F.col("n_cut"), F.col("n_default_left")), F.col("n_left")).otherwise(F.col("n_right")))
        state = here.withColumn("_to", down).withColumn("path", F.when(F.col("_to") == F.col("_at"), F.col("path")).otherwise(F.concat("path", F.array("_to"))))
        state = state.withColumn("_at", F.col("_to")).select(*rows.columns, "_at", "path")
    return state.join(side, F.col("_at") == F.col("n_node")).select(*rows.columns, F.col("n_class").alias("class"), "path")


def path_steps(explained: DataFrame, nodes: DataFrame, id_col: str) -> DataFrame:
    """(id, step, node, followed, class): the paths of ``paths`` as rows."""
    flat = explained.select(id_col, "path", F.posexplode("path").alias("step", "node"))
    known = nodes.select("node", "left", "class")
    after = F.get(F.col("path"), F.col("step") + 1)
    followed = F.when(after.isNull(), None).when(after == F.col("left"), "left").otherwise("right")
    return flat.join(known, "node").select(id_col, "step", "node", followed.alias("followed"), "class")


def tree_column(nodes: dict[int, object], features: list[str]) -> Column:
    def build(node: int) -> Column:
        r = nodes[node]
        if r["feature"] == -1:
            return single(r["value"])
        return F.when(goes_left(F.col(features[r["feature"]]), single(r["cut"]), F.lit(r["default_left"])), build(r["left"])).otherwise(build(r["right"]))

    return build(0)


def margins(rows: DataFrame, trees: DataFrame, features: list[str], bias: list[float], most: int = 1024, how: str = "auto") -> DataFrame:
    """``rows`` with ``margins``: per channel, bias plus leaf values added in tree order in FP32."""
    known: dict[int, dict[int, object]] = {}
    for r in bounded(trees, MOST_NODES, "ensemble"):
        known.setdefault(r["tree"], {})[r["node"]] = r
    order = sorted(known)
    if how == "columns" or (how == "auto" and sum(map(len, known.values())) <= most):
        totals = []
        for channel, start in enumerate(bias):
            total = single(start)
            for t in order:
                if known[t][0]["channel"] == channel:
                    total = (total + tree_column(known[t], features)).cast("float")
            totals.append(total)
        return rows.withColumn("margins", F.array(*totals))
    packed = []
    for t in order:
        own = known[t]
        n = max(own) + 1
        get = lambda key, none, kind, own=own, n=n: np.array([none if i not in own or own[i][key] is None else own[i][key] for i in range(n)], kind)
        packed.append((own[0]["channel"], get("feature", -1, np.int64), get("cut", 0, np.float32), get("default_left", False, bool), np.stack([get("right", 0, np.int64), get("left", 0, np.int64)], 1), get("value", 0, np.float32)))
    shared = rows.sparkSession.sparkContext.broadcast((packed, np.array(bias, np.float32)))

    @F.pandas_udf("array<float>")
    def add(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        packed, start = shared.value
        for columns in parts:
            x = np.stack([c.to_numpy(np.float32) for c in columns], 1)
            total = np.tile(start, (len(x), 1))
            for channel, feature, bound, side, down, value in packed:
                here = np.zeros(len(x), np.int64)
                while len(open_rows := np.flatnonzero(feature[here] >= 0)):
                    node = here[open_rows]
                    v = x[open_rows, feature[node]]
                    here[open_rows] = down[node, np.where(np.isnan(v), side[node], v < bound[node]).astype(int)]
                total[:, channel] += value[here]
            yield pd.Series(list(total))

    return rows.withColumn("margins", add(*(F.col(f) for f in features)))


def classify(rows: DataFrame, trees: DataFrame, features: list[str], bias: list[float], name: str = "class", how: str = "auto") -> DataFrame:
    """``rows`` with the first class of the greatest margin."""
    return margins(rows, trees, features, bias, how=how).withColumn(name, first_winner(F.col("margins"))).drop("margins")
