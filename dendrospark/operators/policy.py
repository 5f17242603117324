"""Learning the order in which features are split, by rewarding smaller graphs.

An episode draws an order of the features (Plackett-Luce: one after another, with probabilities
in proportion to the exponentials of their logits), searches the ensemble with tests of earlier
features first, and costs the number of nodes of the graph.  Episodes are rows: Spark runs them
in parallel and averages the gradients; only logits, one for each feature, live on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.models import split_mix
from ..plans.storage import bounded
from .compiler import Domain, Ensemble
from .graph import MOST_NODES

EPISODES = "episode long, cost long, ordering array<int>, gradient array<double>"


def draw(logits: np.ndarray, seed: int) -> tuple[list[int], np.ndarray]:
    """An order of all positions and the gradient of its log-probability."""
    left, order, grad, state = list(range(len(logits))), [], np.zeros(len(logits)), seed
    while left:
        z = np.exp(logits[left] - logits[left].max())
        p = z / z.sum()
        state, r = split_mix(state)
        at = min(int(np.searchsorted(np.cumsum(p), (r >> 11) / 2**53, side="right")), len(left) - 1)
        grad[left[at]] += 1
        grad[left] -= p
        order.append(left.pop(at))
    return order, grad


def graph_nodes(own: Ensemble, order: list[int], most: int) -> int:
    """Nodes of the graph that the search finds with tests of earlier features first."""
    place = {f: i for i, f in enumerate(order)}
    pick = lambda nodes: min(range(len(nodes)), key=lambda i: (place[nodes[i][1]], i))
    start, label = own.settle(own.start())
    if label is not None:
        return 1
    kids: dict[bytes, tuple] = {}
    work = [start]
    while work:
        data = work.pop()
        if data in kids:
            continue
        if len(kids) >= most:
            raise ValueError(f"the search has more than {most} states")
        r, *kids_of = own.children(own.unpack(data), pick)
        kids[data] = ((r["feature"], own.cut_index(r), bool(r["default_left"])), *kids_of)
        work += [c for c, done in kids_of if done is None]
    names: dict[tuple, int] = {}
    done: dict[bytes, int] = {}
    stack = [start]
    while stack:
        test, *ends = kids[stack[-1]]
        ids = [names.setdefault(("leaf", k), len(names)) if k is not None else done.get(c) for c, k in ends]
        if None in ids:
            stack += [c for (c, _), i in zip(ends, ids, strict=True) if i is None]
            continue
        done[stack.pop()] = ids[0] if ids[0] == ids[1] else names.setdefault((*test, *ids), len(names))
    used, front = set(), [done[start]]
    by_id = {i: k for k, i in names.items()}
    while front:
        i = front.pop()
        if i not in used:
            used.add(i)
            front += [] if by_id[i][0] == "leaf" else by_id[i][3:]
    return len(used)


def episodes(spark: SparkSession, own: object, logits: list[float], first: int, count: int, seed: int, most: int) -> DataFrame:
    """A row (EPISODES) for each of ``count`` episodes from number ``first`` on."""

    def play(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = np.array(logits)
        for batch in source:
            out = []
            for n in batch.column("id").to_pylist():
                order, grad = draw(values, seed * 1_000_003 + n)
                out.append((n, graph_nodes(own.value, order, most), order, grad.tolist()))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.float64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["episode", "cost", "ordering", "gradient"])

    return spark.range(first, first + count).mapInArrow(play, EPISODES)


def learn(trees: DataFrame, bias: list[float], features: int, rounds: int, per_round: int, rate: float = 0.1, seed: int = 1, domain: Domain | None = None, most: int = 1 << 16) -> tuple[DataFrame, list[float]]:
    """(progress, logits): after each round the mean cost and the best order so far, the first of equals.

    A round moves the logits by ``rate`` times the mean of (mean cost - cost) times the gradient.
    """
    spark = trees.sparkSession
    own = spark.sparkContext.broadcast(Ensemble([r.asDict() for r in bounded(trees, MOST_NODES, "ensemble")], bias, features, domain or Domain()))
    logits, rows, best = [0.0] * features, [], None
    for k in range(rounds):
        played = episodes(spark, own, logits, k * per_round, per_round, seed, most)
        sums = [F.avg(F.get("gradient", F.lit(f))).alias(f"g{f}") for f in range(features)]
        cross = [F.avg(F.col("cost") * F.get("gradient", F.lit(f))).alias(f"c{f}") for f in range(features)]
        r = played.agg(F.avg("cost").alias("mean"), F.min(F.struct("cost", "episode", "ordering")).alias("best"), *sums, *cross).first()
        found = (r["best"]["cost"], r["best"]["episode"], r["best"]["ordering"])
        best = found if best is None else min(best, found)
        step = [rate * (r["mean"] * r[f"g{f}"] - r[f"c{f}"]) for f in range(features)]
        if not all(np.isfinite(step)):
            raise ValueError("the update is not finite")
        logits = [a + b for a, b in zip(logits, step, strict=True)]
        rows.append((k, float(r["mean"]), *best))
    return spark.createDataFrame(rows, "round int, mean_cost double, best_cost long, best_episode long, best_ordering array<int>"), logits
