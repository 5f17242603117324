"""Multiclass gradient boosting by distributed histograms.

Rows are read once into a table of bins.  A level of a round's trees costs one pass: each task walks
its rows down the trees so far, adds their gradients and curvatures up by class, open node, feature
and bin with numpy, and gives out one partial histogram, so what is shuffled has the size of the
histogram and not of the data.  Sums are whole numbers in units of 2 ** -28, so that no order of rows
or tasks changes them.  The summed histogram, at most ``MOST_CELLS`` cells a pass, is of the size of a
model and reaches the driver, where splits are chosen from running sums over the bins, once with
missing values to the left and once to the right.  Margins are written every ``KEEP`` rounds; trees
since then are walked again, in their order, so margins are the same FP32 sums.

``histogram`` and ``best_splits`` are the same two steps as DataFrame operations.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fp32 import word_of
from ..functions.models import TREES
from ..plans.options import training_parameters
from ..plans.storage import cut

UNIT = float(1 << 28)
MOST_CELLS = 1 << 21  #: cells of a pass: classes, open nodes, features and bins; levels of more take several
KEEP = 16


def require_labels(rows: DataFrame, label: str, classes: int) -> None:
    bad = rows.where(F.col(label).isNull() | (F.col(label) < 0) | (F.col(label) >= classes)).limit(1).collect()
    if bad:
        raise ValueError(f"labels must be from 0 to {classes - 1}")


def quantile_cuts(rows: DataFrame, features: list[str], most: int) -> list[list[float]]:
    """Up to ``most`` - 1 cuts of each feature at quantiles of its known values, in order."""
    shares = F.array(*(F.lit(k / most) for k in range(1, most)))
    known = [F.percentile_approx(F.when(~F.isnan(f), F.col(f).cast("double")), shares, F.lit(10_000)).alias(f) for f in features]
    found = rows.agg(*known).first()
    return [sorted({float(np.float32(v)) for v in found[f] or ()}) for f in features]


def bin_columns(rows: DataFrame, features: list[str], cuts: list[list[float]]) -> Column:
    """An array with the bin of each feature: how many cuts are at most the value, -1 if missing."""

    def place(x: Column, own: list[float]) -> Column:
        if not own:
            return F.when(F.isnan(x), -1).otherwise(0)
        array = F.array(*(F.lit(c).cast("float") for c in own))
        return F.when(F.isnan(x), -1).otherwise(F.size(F.filter(array, lambda c: c <= x)))

    return F.array(*(place(F.col(f), c) for f, c in zip(features, cuts, strict=True)))


def gradients(margins: Column, label: Column, classes: int) -> Column:
    """An array of (g, h) by class: softmax minus the label, and twice p(1 - p)."""
    top = F.array_max(margins)
    raised = F.transform(margins, lambda m: F.exp((m - top).cast("double")))
    total = F.aggregate(raised, F.lit(0.0), lambda a, x: a + x)
    items = []
    for k in range(classes):
        p = F.get(raised, F.lit(k)) / total
        items.append(F.struct((p - (label == k).cast("double")).alias("g"), F.greatest(2 * p * (1 - p), F.lit(1e-16)).alias("h")))
    return F.array(*items)


def histogram(rows: DataFrame) -> DataFrame:
    """(class, node, feature, bin, g, h, n) from rows with ``grads``, ``bins`` and ``at`` (open node by class)."""
    per_class = rows.select("bins", F.posexplode("grads").alias("class", "gh"), "at").withColumn("node", F.get("at", F.col("class"))).where("node >= 0")
    flat = per_class.select("class", "node", "gh", F.posexplode("bins").alias("feature", "bin"))
    return flat.groupBy("class", "node", "feature", "bin").agg(F.sum("gh.g").alias("g"), F.sum("gh.h").alias("h"), F.count("*").alias("n"))


def shrink(g: Column, alpha: float) -> Column:
    return g if alpha == 0 else F.when(g > alpha, g - alpha).when(g < -alpha, g + alpha).otherwise(0.0)


def best_splits(hist: DataFrame, p: dict[str, Any]) -> DataFrame:
    """(class, node, feature, bin, default_left, gain, g, h, gl, hl): the best split of each open node.

    ``bin`` is the last bin that goes left.  Ties go to the lower feature, bin, then to the right
    as default side.  Nodes without a split that gains more than gamma have feature null.
    """
    own = Window.partitionBy("class", "node", "feature")
    known = F.col("bin") >= 0
    run = own.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    sums = hist.withColumns({
        "g_all": F.sum("g").over(own), "h_all": F.sum("h").over(own),
        "g_gone": F.sum(F.when(known, 0.0).otherwise(F.col("g"))).over(own), "h_gone": F.sum(F.when(known, 0.0).otherwise(F.col("h"))).over(own),
        "g_run": F.sum(F.when(known, F.col("g")).otherwise(0.0)).over(run), "h_run": F.sum(F.when(known, F.col("h")).otherwise(0.0)).over(run),
        "last": F.max("bin").over(own),
    })
    both = sums.where(known).withColumn("default_left", F.explode(F.array(F.lit(False), F.lit(True))))
    g_left = F.col("g_run") + F.when(F.col("default_left"), F.col("g_gone")).otherwise(0.0)
    h_left = F.col("h_run") + F.when(F.col("default_left"), F.col("h_gone")).otherwise(0.0)
    both = both.withColumns({"gl": g_left, "hl": h_left}).withColumns({"gr": F.col("g_all") - F.col("gl"), "hr": F.col("h_all") - F.col("hl")})
    worth = lambda g, h: F.pow(shrink(F.col(g), p["alpha"]), F.lit(2.0)) / (F.col(h) + p["lambda"])
    gain = worth("gl", "hl") + worth("gr", "hr") - worth("g_all", "h_all")
    heavy = (F.col("hl") >= p["min_child_weight"]) & (F.col("hr") >= p["min_child_weight"]) & ((F.col("bin") < F.col("last")) | (~F.col("default_left") & (F.col("h_gone") > 0)))
    scored = both.withColumn("gain", F.when(heavy, gain))
    fits = F.col("gain") > max(p["gamma"], 1e-6)
    pick = F.max(F.when(fits, F.struct("gain", (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), (~F.col("default_left")).alias("r"), "gl", "hl"))).alias("pick")
    totals = F.struct(F.max("g_all").alias("g"), F.max("h_all").alias("h"))
    out = scored.groupBy("class", "node").agg(pick, totals.alias("t"))
    return out.select("class", "node", (-F.col("pick.f")).alias("feature"), (-F.col("pick.b")).alias("bin"), (~F.col("pick.r")).alias("default_left"), F.col("pick.gain").alias("gain"), F.col("t.g").alias("g"), F.col("t.h").alias("h"), F.col("pick.gl").alias("gl"), F.col("pick.hl").alias("hl"))


def leaf_value(g: float, h: float, p: dict[str, Any]) -> float:
    g = math.copysign(max(0.0, abs(g) - p["alpha"]), g)
    return float(np.float32(-g / (h + p["lambda"]) * p["eta"]))


class Tree:
    """The tree of a class in a round, on bins: what ``split`` made of its nodes so far."""

    def __init__(self) -> None:
        self.feature, self.last, self.left = [-1], [0], [-1]
        self.default_left = [False]
        self.value = [0.0]

    def split(self, node: int, feature: int, last: int, default_left: bool) -> int:
        left = len(self.feature)
        self.feature[node], self.last[node], self.default_left[node], self.left[node] = feature, last, default_left, left
        for column, empty in ((self.feature, -1), (self.last, 0), (self.left, -1), (self.default_left, False), (self.value, 0.0)):
            column += [empty, empty]
        return left

    def arrive(self, bins: np.ndarray) -> np.ndarray:
        """The node where each row of bins ends."""
        at = np.zeros(len(bins), np.int64)
        feature, last, left, default_left = (np.array(c) for c in (self.feature, self.last, self.left, self.default_left))
        rows = np.arange(len(bins))
        while True:
            own = feature[at[rows]]
            rows = rows[own >= 0]
            if not len(rows):
                return at
            node = at[rows]
            b = bins[rows, feature[node]]
            goes = np.where(b < 0, default_left[node], b <= last[node])
            at[rows] = left[node] + ~goes


def add_up(margins: np.ndarray, rounds: list[list[Tree]], bins: np.ndarray) -> np.ndarray:
    """FP32 margins after further rounds, added in their order."""
    for trees in rounds:
        for k, tree in enumerate(trees):
            margins[:, k] += np.array(tree.value, np.float32)[tree.arrive(bins)]
    return margins


def slopes(margins: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients and curvatures by row and class, in whole units: as ``gradients`` has them."""
    raised = np.exp((margins - margins.max(1, keepdims=True)).astype(np.float64))
    total = np.zeros(len(margins))
    for k in range(margins.shape[1]):
        total += raised[:, k]
    p = raised / total[:, None]
    g = p - (label[:, None] == np.arange(margins.shape[1]))
    return np.rint(g * UNIT), np.rint(np.maximum(2 * p * (1 - p), 1e-16) * UNIT)


def matrices(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Bins and margins of a batch's rows."""
    bins, margins = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for c in ("bins", "margins"))
    return bins.astype(np.int64), margins.astype(np.float32)


def level(state: DataFrame, rounds: list[list[Tree]], now: list[Tree], open_nodes: list[tuple[int, int]], width: int, features: int) -> np.ndarray:
    """The summed histogram of ``open_nodes`` (class, node): [open node, feature, bin from -1, (g, h, n)]."""
    spark = state.sparkSession
    shared = spark.sparkContext.broadcast((rounds, now, open_nodes))
    shape = (len(open_nodes), features, width + 1)

    def part(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rounds, now, open_nodes = shared.value
        sums = np.zeros((3, math.prod(shape)), np.int64)
        for batch in source:
            for start in range(0, batch.num_rows, 1 << 16):
                rows = batch.slice(start, 1 << 16)
                bins, margins = matrices(rows)
                g, h = slopes(add_up(margins, rounds, bins), rows.column("label").to_numpy())
                for k, tree in enumerate(now):
                    slot = np.full(len(tree.feature), -1)
                    for at_slot, (c, node) in enumerate(open_nodes):
                        if c == k:
                            slot[node] = at_slot
                    if (slot < 0).all():
                        continue
                    here = slot[tree.arrive(bins)]
                    own = np.flatnonzero(here >= 0)
                    # one pass over the rows of all open nodes of the class, feature by feature
                    for f in range(features):
                        cell = (here[own] * features + f) * (width + 1) + bins[own, f] + 1
                        for i, w in enumerate((g[own, k], h[own, k], None)):
                            sums[i] += np.bincount(cell, w, sums.shape[1]).astype(np.int64)
        cells = np.flatnonzero(sums[2])
        yield pa.RecordBatch.from_arrays([pa.array(cells), *(pa.array(s[cells]) for s in sums)], ["cell", "g", "h", "n"])

    partial = state.select("label", "bins", "margins").mapInArrow(part, "cell long, g long, h long, n long")
    found = partial.groupBy("cell").agg(*(F.sum(c).alias(c) for c in "ghn")).toArrow()
    out = np.zeros((math.prod(shape), 3), np.int64)
    out[found.column("cell").to_numpy()] = np.stack([found.column(c).to_numpy() for c in "ghn"], 1)
    return out.reshape(*shape, 3)


def choose(hist: np.ndarray, p: dict[str, Any]) -> dict[str, Any]:
    """The best split of a node from its histogram [feature, bin from -1, (g, h, n)], by the rules of ``best_splits``."""
    g, h, n = hist[..., 0] / UNIT, hist[..., 1] / UNIT, hist[..., 2]
    out: dict[str, Any] = {"g": float(g[0].sum()), "h": float(h[0].sum()), "feature": None}

    def worth(g: np.ndarray, h: np.ndarray) -> np.ndarray:
        return (np.sign(g) * np.maximum(np.abs(g) - p["alpha"], 0)) ** 2 / (h + p["lambda"])

    best: tuple = ()
    for f in range(len(hist)):
        seen = np.flatnonzero(n[f, 1:])
        if not len(seen):
            continue
        for default_left in (False, True):
            gl = np.cumsum(g[f, 1:]) + (g[f, 0] if default_left else 0.0)
            hl = np.cumsum(h[f, 1:]) + (h[f, 0] if default_left else 0.0)
            gr, hr = out["g"] - gl, out["h"] - hl
            gain = worth(gl, hl) + worth(gr, hr) - worth(np.array(out["g"]), np.array(out["h"]))
            last = seen[-1]
            for b in seen.tolist():
                heavy = hl[b] >= p["min_child_weight"] and hr[b] >= p["min_child_weight"] and (b < last or (not default_left and n[f, 0] > 0))
                if heavy and gain[b] > max(p["gamma"], 1e-6):
                    best = max(best, (float(gain[b]), -f, -b, not default_left, float(gl[b]), float(hl[b])))
    if best:
        f, b, default_left = -best[1], -best[2], not best[3]
        to_left = int(n[f, 1 : b + 2].sum() + (n[f, 0] if default_left else 0))
        out |= {"feature": f, "bin": b, "default_left": default_left, "gl": best[4], "hl": best[5], "left_is_less": 2 * to_left <= int(n[f].sum())}
    return out


def histograms(live: DataFrame, rounds: list[list[Tree]], now: list[Tree], open_nodes: list[tuple[int, int]], known: dict[tuple[int, int], tuple[tuple[int, int], np.ndarray]], width: int, features: int) -> list[np.ndarray]:
    """The histogram of each of ``open_nodes``.

    ``known`` gives for a node its sibling, which is among ``open_nodes`` and not in ``known``, and their parent's
    histogram; such a node is not added up over the rows.
    """
    asked = [x for x in open_nodes if x not in known]
    at_once = max(1, MOST_CELLS // (features * (width + 1)))
    found: dict[tuple[int, int], np.ndarray] = {}
    for at in range(0, len(asked), at_once):
        some = asked[at : at + at_once]
        found.update(zip(some, level(live, rounds, now, some, width, features), strict=True))
    for node, (sibling, parent) in known.items():
        found[node] = parent - found[sibling]
    return [found[x] for x in open_nodes]


def train(rows: DataFrame, features: list[str], label: str, classes: int, parameters: dict[str, Any]) -> tuple[DataFrame, list[float]]:
    """(trees, bias) fitted to all ``rows``; float features, NaN for missing, labels from 0.

    Rows are read once into bins.  With ``subsample`` below 1 each round uses the rows whose hash
    with the round and the seed falls below it.
    """
    p = training_parameters(parameters, classes)
    require_labels(rows, label, classes)
    spark = rows.sparkSession
    cuts = quantile_cuts(rows, features, int(p["max_bin"]))
    width = max(len(c) for c in cuts) + 1
    base = rows.select(F.col(label).cast("int").alias("label"), bin_columns(rows, features, cuts).alias("bins"))
    state = cut(base.withColumn("margins", F.array(*(F.lit(0.0).cast("float") for _ in range(classes)))), "margins")
    done: list[list[Tree]] = []
    kept = 0
    out: list[tuple] = []
    for turn in range(p["rounds"]):
        live = state
        if p.get("subsample", 1.0) < 1:
            live = state.where(F.pmod(F.xxhash64("bins", "label", F.lit(turn), F.lit(p["seed"])), F.lit(1 << 20)) < int(p["subsample"] * (1 << 20)))
        own = [Tree() for _ in range(classes)]
        sums: list[dict[int, tuple[float, float]]] = [{} for _ in range(classes)]
        open_nodes = [(k, 0) for k in range(classes)]
        known: dict[tuple[int, int], tuple[tuple[int, int], np.ndarray]] = {}
        for _ in range(p["max_depth"]):
            hists = histograms(live, done[kept:], own, open_nodes, known, width, len(features))
            # parents are kept while a level of them is no larger than a pass; beyond that both children are added up
            keep = len(open_nodes) * len(features) * (width + 1) <= MOST_CELLS
            further, known = [], {}
            for (k, node), hist in zip(open_nodes, hists, strict=True):
                pick = choose(hist, p)
                sums[k][node] = pick["g"], pick["h"]
                if pick["feature"] is not None:
                    left = own[k].split(node, pick["feature"], pick["bin"], pick["default_left"])
                    sums[k][left], sums[k][left + 1] = (pick["gl"], pick["hl"]), (pick["g"] - pick["gl"], pick["h"] - pick["hl"])
                    pair = [(k, left), (k, left + 1)]
                    further += pair
                    if keep:
                        known[pair[pick["left_is_less"]]] = pair[not pick["left_is_less"]], hist
            open_nodes = further
            if not open_nodes:
                break
        for k, tree in enumerate(own):
            for node, feature in enumerate(tree.feature):
                if feature < 0:
                    tree.value[node] = leaf_value(*sums[k].get(node, (0.0, 0.0)), p)
                    out.append((turn * classes + k, k, node, -1, None, None, None, -1, -1, tree.value[node]))
                else:
                    here = cuts[feature]
                    # a split after the last bin parts known values from missing ones
                    bound = here[tree.last[node]] if tree.last[node] < len(here) else float("inf")
                    out.append((turn * classes + k, k, node, feature, bound, word_of(bound), bool(tree.default_left[node]), tree.left[node], tree.left[node] + 1, None))
        done.append(own)
        if len(done) - kept >= KEEP and turn + 1 < p["rounds"]:
            state, kept = cut(with_margins(state, done[kept:]), "margins"), len(done)
    return spark.createDataFrame(out, TREES), [0.0] * classes


def with_margins(state: DataFrame, rounds: list[list[Tree]]) -> DataFrame:
    """``state`` with its margins after further rounds."""
    shared = state.sparkSession.sparkContext.broadcast(rounds)

    def part(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            if batch.num_rows:
                bins, margins = matrices(batch)
                margins = add_up(margins.copy(), shared.value, bins)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(bins) + 1) * margins.shape[1], pa.int32()), pa.array(margins.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("bins"), lists], ["label", "bins", "margins"])

    return state.select("label", "bins", "margins").mapInArrow(part, "label int, bins array<int>, margins array<float>")


def prefix(trees: DataFrame, rounds: int, classes: int) -> DataFrame:
    """The first ``rounds`` boosting rounds of an ensemble."""
    return trees.where(F.col("tree") < rounds * classes)
