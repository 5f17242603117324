"""Approximate nearest neighbours by inner product, with a hierarchical k-means tree.

The upper tree is fitted on a sample of ``SAMPLE`` rows.  Leaves grow with the square root of the rows,
up to ``MOST_LEAVES``; where the sample is too small for so many, each upper leaf gets a tree of its
own, fitted on an executor on about ``LEAF`` rows for each leaf wanted.  Every row is then put into the
leaf it descends to.  A
query visits leaves best bin first: a priority queue holds the open branches by the inner product
of the query with their centres.  How many leaves it visits is widened until, on a fixed number
of queries with exactly known neighbours over all rows, the recall wanted is reached.

A leaf with more rows than usual is cut into blocks of the usual size, so a leaf full of copies
is many small tasks; queries meet the blocks of their leaves by key.  The sampled rows in the
leaves that a query visits are among the rows it will meet, so their k-th best score bounds its
k-th best from below: a block gives out only rows at that bound or above, and at most k for a
query, and still every query gets the best k of all rows in its leaves.  A query whose leaves
hold fewer than k others visits more.  All scores are exact, in double precision, on
the vectors as given.

Defined cases: vectors that are null, all zero, or have a null or non-finite component take no
part, nor do those of another length than most (the smaller length of a tie); an id is one vector,
so of rows that share an id that with the least vector counts, and repeated rows count once; equal
scores go to the smaller id; with fewer candidates than k all are returned; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

SAMPLE = 20_000  #: rows the upper tree is fitted on; a leaf has at least LEAF of them
UPPER = 256  #: leaves of the upper tree where lower ones are fitted
MOST_LEAVES = 1 << 17  #: bound of the broadcast: 128 MB of centres at 128 dimensions
FANOUT = 8
LEAF = 24
CALIBRATION = 128  #: queries whose exact neighbours are computed
TARGET = 0.94
BLOCK = 128  #: rows of a block at least


class Tree:
    """Centres of all nodes; the children of node i are ``first[i] .. first[i] + count[i]``."""

    def __init__(self, centres: np.ndarray, first: np.ndarray, count: np.ndarray) -> None:
        self.centres, self.first, self.count = centres, first, count

    def graft(self, parts: dict[int, Tree]) -> Tree:
        """This tree with others in the place of leaves."""
        centres, first, count, size = [self.centres], self.first.copy(), self.count.copy(), len(self.first)
        firsts, counts = [], []
        for leaf, part in parts.items():
            if part.count[0]:
                # the part's root is the leaf itself
                first[leaf], count[leaf] = size + part.first[0] - 1, part.count[0]
                centres.append(part.centres[1:])
                firsts.append(np.where(part.count[1:] > 0, part.first[1:] + size - 1, 0))
                counts.append(part.count[1:])
                size += len(part.first) - 1
        return Tree(np.concatenate(centres), np.concatenate([first, *firsts]), np.concatenate([count, *counts]))

    @property
    def leaves(self) -> np.ndarray:
        return np.flatnonzero(self.count == 0)

    def descend(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector: the nearest centre at every level."""
        at = np.zeros(len(vectors), np.int64)
        while True:
            inner = np.flatnonzero(self.count[at] > 0)
            if not len(inner):
                return at
            for node in np.unique(at[inner]):
                rows = inner[at[inner] == node]
                kids = slice(self.first[node], self.first[node] + self.count[node])
                c = self.centres[kids]
                at[rows] = self.first[node] + ((c * c).sum(1) - 2 * vectors[rows] @ c.T).argmin(1)

    def visits(self, vectors: np.ndarray, most: int, sizes: dict[int, int] | None = None, need: int = 0) -> list[list[int]]:
        """The first ``most`` leaves of each query, best bin first.

        With ``sizes`` (rows by leaf) a query goes on until it has seen ``need`` rows.
        """
        out = []
        for scores in vectors @ self.centres.T:
            queue, found, rows = [(-scores[0], 0)], [], 0
            while queue and (len(found) < most or (sizes is not None and rows < need)):
                _, node = heapq.heappop(queue)
                if not self.count[node]:
                    found.append(node)
                    rows += 0 if sizes is None else sizes.get(node, 0)
                for kid in range(self.first[node], self.first[node] + self.count[node]):
                    heapq.heappush(queue, (-scores[kid], kid))
            out.append(found)
        return out


def k_means(vectors: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    centres = vectors[rng.choice(len(vectors), k, replace=False)].copy()
    own = np.zeros(len(vectors), np.int64)
    for _ in range(rounds):
        own = ((centres * centres).sum(1) - 2 * vectors @ centres.T).argmin(1)
        for j in range(k):
            if (own == j).any():
                centres[j] = vectors[own == j].mean(0)
    return centres, ((centres * centres).sum(1) - 2 * vectors @ centres.T).argmin(1)


def grow(vectors: np.ndarray, leaf: int = LEAF, fanout: int = FANOUT, seed: int = 7) -> Tree:
    rng = np.random.default_rng(seed)
    centres, first, count = [vectors.mean(0)], [0], [0]
    work = [(0, np.arange(len(vectors)))]
    while work:
        node, rows = work.pop()
        if len(rows) <= leaf or not np.ptp(vectors[rows], axis=0).any():
            continue
        c, own = k_means(vectors[rows], min(fanout, len(rows)), rng)
        used = np.unique(own)
        if len(used) < 2:
            continue
        first[node], count[node] = len(centres), len(used)
        for j in used:
            work.append((len(centres), rows[own == j]))
            centres.append(c[j])
            first.append(0)
            count.append(0)
    return Tree(np.array(centres), np.array(first), np.array(count))


def usable(vector: Column) -> Column:
    """Not null, not all zero, every component finite."""
    v = vector.cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column whose lists have equal lengths and no nulls, as float64 rows."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1) if len(flat) else np.zeros((0, 1))


def best(ids: np.ndarray, vectors: np.ndarray, query: int, q: np.ndarray, rough: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and exact scores of the query's best k in one block, by (-score, id)."""
    take = np.arange(len(ids))
    if len(ids) > k + 1:
        edge = np.partition(rough, len(ids) - k - 1)[len(ids) - k - 1]
        take = np.flatnonzero(rough >= edge - 1e-9 * max(1.0, abs(edge)))
    take = take[ids[take] != query]
    score = (vectors[take] * q).sum(1)
    order = np.lexsort((ids[take], -score))[:k]
    return ids[take][order], score[order]


def exact(rows: DataFrame, ids: np.ndarray, vectors: np.ndarray, k: int) -> DataFrame:
    """Exact neighbours of a bounded set of queries over all rows: a top k per task, then one in all."""

    def part(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            if not batch.num_rows:
                continue
            own, them = batch.column("id").to_numpy(zero_copy_only=False), matrix(batch.column("vector"))
            rough = vectors @ them.T
            out: list[tuple[int, int, float]] = []
            for i, query in enumerate(ids.tolist()):
                near, score = best(own, them, query, vectors[i], rough[i], k)
                out += [(query, int(a), float(b)) for a, b in zip(near, score, strict=True)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["query_id", "id", "score"])

    found = rows.mapInArrow(part, "query_id long, id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def calibrate(tree: Tree, rows: DataFrame, queries: DataFrame, k: int, target: float, least: int = 4) -> int:
    """How many leaves a query must visit: doubled until the measured recall is ``target``."""
    share = min(1.0, (2 * CALIBRATION + 100) / max(1, queries.count()))
    sample = queries.where(share_of(F.col("id")) < share).orderBy(F.xxhash64("id"), "id").limit(CALIBRATION).toPandas()
    if not len(sample):
        return least
    ids, vectors = sample["id"].to_numpy(), np.array(sample["vector"].tolist(), np.float64)
    truth = exact(rows, ids, vectors, k).select("query_id", "id").join(rows, "id").select("query_id", "vector").toPandas()
    if not len(truth):
        return least
    leaf = tree.descend(np.array(truth["vector"].tolist(), np.float64))
    order = dict(zip(ids.tolist(), ({n: i for i, n in enumerate(v)} for v in tree.visits(vectors, len(tree.leaves))), strict=True))
    place = np.array([order[q][n] for q, n in zip(truth["query_id"].tolist(), leaf.tolist(), strict=True)])
    visits = least
    while (place < visits).mean() < target and visits < len(tree.leaves):
        visits = int(visits * 1.25) + 1
    return visits


def bounds(ids: np.ndarray, vectors: np.ndarray, seen: np.ndarray, asks: np.ndarray, queries: np.ndarray, k: int) -> np.ndarray:
    """A lower bound of each query's k-th best score: that among the sampled rows it will meet.

    ``seen`` says which those are, for each query; its own row is left out.
    """
    if len(ids) <= k:
        return np.full(len(asks), -np.inf)
    scores = queries @ vectors.T
    scores[~seen | (asks[:, None] == ids[None, :])] = -np.inf
    kth = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k]
    return np.where(np.isfinite(kth), kth - 1e-9 * np.maximum(1.0, np.abs(kth)), -np.inf)


def pairs(ids: np.ndarray, vectors: np.ndarray, asks: np.ndarray, queries: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, exact score) of the rows of a block that may be among a query's best k."""
    hit = queries @ vectors.T >= least[:, None]
    hit &= asks[:, None] != ids[None, :]
    q, r = np.nonzero(hit)
    score = (vectors[r] * queries[q]).sum(1)
    order = np.lexsort((ids[r], -score, q))
    q, r, score = q[order], r[order], score[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    keep = place < k
    return asks[q[keep]], ids[r[keep]], score[keep]


def fit(rows: DataFrame, drawn: np.ndarray, total: int, upper: int = UPPER, most: int = MOST_LEAVES) -> Tree:
    """A tree with about the square root of ``total`` leaves, from drawn rows and, if they are too few, from all."""
    leaves = max(1, min(math.isqrt(total), most))
    if leaves * LEAF <= len(drawn) or len(drawn) <= LEAF:
        return grow(drawn, leaf=max(1, len(drawn) // leaves))
    top = grow(drawn, leaf=max(LEAF, len(drawn) // upper))
    own, times = np.unique(top.descend(drawn), return_counts=True)
    # a leaf of many rows gets many leaves, all of them rows in proportion
    share = min(1.0, leaves * LEAF / total)
    wanted = {int(n): max(1, round(leaves * int(k) / len(drawn))) for n, k in zip(own, times, strict=True)}
    shared = rows.sparkSession.sparkContext.broadcast(top)
    kind = rows.schema["vector"].dataType.simpleString()

    def place(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            leaf = shared.value.descend(matrix(batch.column("vector"))) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int64()), batch.column("vector")], ["leaf", "vector"])

    def branch(key: Any, table: pa.Table) -> pa.Table:
        leaf, vectors = key[0].as_py(), matrix(table.column("vector"))
        tree = grow(vectors, leaf=max(1, len(vectors) // wanted.get(leaf, 1)))
        n = len(tree.first)
        centres = pa.array(list(tree.centres.astype(np.float64)), pa.list_(pa.float64()))
        return pa.table([pa.array(np.full(n, leaf)), pa.array(np.arange(n)), centres, pa.array(tree.first), pa.array(tree.count)], names=["leaf", "node", "centre", "first", "count"])

    drawn_rows = rows.where(share_of(F.col("id")) < share).select("vector").mapInArrow(place, f"leaf long, vector {kind}")
    found = drawn_rows.groupBy("leaf").applyInArrow(branch, "leaf long, node long, centre array<double>, first long, count long").toPandas()
    parts = {}
    for leaf, own_rows in found.sort_values(["leaf", "node"]).groupby("leaf"):
        parts[int(leaf)] = Tree(np.array(own_rows["centre"].tolist()), own_rows["first"].to_numpy(), own_rows["count"].to_numpy())
    return top.graft(parts)


def share_of(id_col: Column) -> Column:
    """A number from 0 to 1 that an id is dealt evenly."""
    return F.pmod(F.xxhash64(id_col, F.lit("draw")), F.lit(1 << 30)) / F.lit(float(1 << 30))


def usable_rows(df: DataFrame, id_col: str, vector_col: str, is_query: Column) -> DataFrame:
    """(id, vector, asks): one row for each id, all vectors of the length that most have."""
    rows = df.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    sizes = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if sizes is not None:
        rows = rows.where(F.size("vector") == sizes["n"])
    return rows.groupBy("id").agg(F.min("vector").alias("vector"), F.max("asks").alias("asks"))


def search(df: DataFrame, id_col: str, vector_col: str, is_query: Column, k: int = 20, target: float = TARGET, sample: int = SAMPLE, upper: int = UPPER) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest rows of every query row."""
    spark = df.sparkSession
    rows = materialise(usable_rows(df, id_col, vector_col, is_query), "rows")
    kind = rows.schema["vector"].dataType.simpleString()
    total = rows.count()
    # somewhat more than the sample by hash, so that no task sorts more than that
    drawn_rows = rows.where(share_of(F.col("id")) < min(1.0, (1.2 * sample + 100) / max(1, total)))
    sampled = drawn_rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("id", "vector").toPandas()
    if not len(sampled):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    drawn = np.array(sampled["vector"].tolist(), np.float64)
    tree = fit(rows, drawn, total, upper)
    shared = spark.sparkContext.broadcast((tree, sampled["id"].to_numpy(), drawn))

    def place(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            leaf = shared.value[0].descend(matrix(batch.column("vector"))) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf, pa.int64())], [*batch.schema.names, "leaf"])

    indexed = materialise(rows.mapInArrow(place, f"id long, vector {kind}, asks boolean, leaf long"), "leaves")
    visits = calibrate(tree, indexed.select("id", "vector"), indexed.where("asks").select("id", "vector"), k, target)
    # at most as many rows as the tree has leaves, which MOST_LEAVES bounds
    usual = max(BLOCK, -(-5 * total // (4 * len(tree.leaves))))
    sizes = {r["leaf"]: r["count"] for r in indexed.groupBy("leaf").count().collect()}
    counts = {leaf: -(-n // usual) for leaf, n in sizes.items()}
    parts = spark.sparkContext.broadcast((sizes, counts))

    def ask(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, ids, drawn = shared.value
        sizes, counts = parts.value
        own_leaf = tree.descend(drawn)
        for batch in source:
            step = max(1, min(128, (1 << 24) // len(tree.first)))
            for at in range(0, batch.num_rows, step):
                own = batch.slice(at, step)
                queries, asks = matrix(own.column("vector")), own.column("id").to_numpy()
                chosen = tree.visits(queries, visits, sizes, k + 1)
                visited = np.zeros((len(asks), len(tree.count)), bool)
                for i, found in enumerate(chosen):
                    visited[i, found] = True
                least = bounds(ids, drawn, visited[:, own_leaf], asks, queries, k)
                cells = [(i, leaf, b) for i, found in enumerate(chosen) for leaf in found for b in range(counts.get(leaf, 0))]
                if cells:
                    row, leaf, block = (pa.array(c, pa.int64()) for c in zip(*cells, strict=True))
                    yield pa.RecordBatch.from_arrays([own.column("id").take(row), own.column("vector").take(row), pa.array(least).take(row), leaf, block], ["id", "vector", "least", "leaf", "block"])

    asked = indexed.where("asks").select("id", "vector").mapInArrow(ask, f"id long, vector {kind}, least double, leaf long, block long")
    # at most MOST_LEAVES rows of two numbers
    hot = spark.createDataFrame([(leaf, n) for leaf, n in counts.items() if n > 1], "leaf long, blocks long")
    of = F.coalesce("blocks", F.lit(1))
    held = indexed.select("id", "vector", "leaf").join(F.broadcast(hot), "leaf", "left").select("id", "vector", "leaf", F.pmod(F.xxhash64("id"), of).cast("long").alias("block"))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "id", "score"]
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if left.num_rows and right.num_rows:
            ids, vectors = left.column("id").to_numpy(), matrix(left.column("vector"))
            for at in range(0, right.num_rows, 512):
                own = right.slice(at, 512)
                out.append(pairs(ids, vectors, own.column("id").to_numpy(), matrix(own.column("vector")), own.column("least").to_numpy(), k))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=names)

    found = held.groupBy("leaf", "block").cogroup(asked.groupBy("leaf", "block")).applyInArrow(meet, "query_id long, id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("vec_id"), "score")
