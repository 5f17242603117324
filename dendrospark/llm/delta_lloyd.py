"""Centroid clustering by delta Lloyd, in whole numbers.

Components become floor(``SCALE`` * x), so all sums and distances are exact and no order of rows or tasks
changes the result.  The vectors are written once, in buckets by row; each round writes the rows' owners
and distances in the same buckets, so a round joins both without moving a vector.

A round compares a vector with the centroids that changed alone.  Only where its own centroid changed and
is farther than before are all compared: else none that stayed can be nearer.  What moved to another owner
is summed in its task, added there and taken off here, so a round gives out at most a row for each centroid
and task.  The sums of all vectors of a centroid are kept from round to round and changed by these
transfers.  Rounds end early once no centroid changes, since all later ones would be the same.

A lost executor costs the tasks of one round: all it reads is in the shared folder.

Defined cases: vectors that are null, of another length or with a null or non-finite component take no
part; all-zero ones do.  The first centroids are the vectors whose ids come first by hash (null ids last;
of rows with one id, by the vector); with fewer vectors than centroids there are as many centroids as
vectors.  Repeated rows each count.  Ties go to the smaller number; a centroid without vectors stays where
it is.  An empty table gives an empty result; other columns are ignored.  A component beyond ``MOST`` in
size after scaling is an error, since distances would not fit in a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import ExitStack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bucketed, materialise
from .kmeans_tree import matrix

K, ROUNDS, LENGTH, SCALE, SEED = 8, 10, 64, 1024, 3
MOST = 1 << 27  #: largest component in whole numbers: 64 squared differences of twice that fit in a long
FAST = 1 << 21  #: below it, 64 products are exact in double precision


def whole(vectors: np.ndarray) -> np.ndarray:
    """floor(SCALE * x), exact: the product of a double by a power of two is."""
    out = np.floor(SCALE * vectors)
    if len(out) and np.abs(out).max() >= MOST:
        raise ValueError(f"a component of {np.abs(out).max() / SCALE:g} is too large to cluster: distances would not fit in a long")
    return out.astype(np.int64)


def distances(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of rows and centroids, exact."""
    top = max(np.abs(rows).max(initial=0), np.abs(centroids).max(initial=0))
    if top < FAST:
        x, c = rows.astype(np.float64), centroids.astype(np.float64)
        return ((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)).astype(np.int64)
    return np.stack([((rows - c) ** 2).sum(1) for c in centroids], axis=1)


def own_distances(rows: np.ndarray, centroids: np.ndarray, owner: np.ndarray) -> np.ndarray:
    return ((rows - centroids[owner]) ** 2).sum(1)


def nearest(rows: np.ndarray, centroids: np.ndarray, changed: np.ndarray, owner: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """New owners and distances; ``owner`` is negative where there was none, ``distance`` that to the owner as it was."""
    owner, distance = owner.copy(), distance.copy()
    known = owner >= 0
    moved = known & changed[np.maximum(owner, 0)]
    now = own_distances(rows[moved], centroids, owner[moved])
    every = ~known
    every[moved] = now > distance[moved]
    distance[moved] = now
    some = np.flatnonzero(changed)
    rest = ~every
    if rest.any() and len(some):
        d = distances(rows[rest], centroids[some])
        at = d.argmin(1)
        best, number = d[np.arange(len(d)), at], some[at]
        nearer = (best < distance[rest]) | ((best == distance[rest]) & (number < owner[rest]))
        owner[rest] = np.where(nearer, number, owner[rest])
        distance[rest] = np.where(nearer, best, distance[rest])
    if every.any():
        d = distances(rows[every], centroids)
        owner[every] = d.argmin(1)
        distance[every] = d.min(1)
    return owner, distance


class Transfers:
    """What centroids gain and lose in a task: numbers of vectors and their sums."""

    def __init__(self, k: int, length: int) -> None:
        self.n = np.zeros(k, np.int64)
        self.sums = np.zeros((k, length), np.int64)

    def add(self, rows: np.ndarray, before: np.ndarray, after: np.ndarray) -> None:
        moved = before != after
        for sign, owner in ((1, after), (-1, before)):
            for k in np.unique(owner[moved & (owner >= 0)]):
                own = rows[moved & (owner == k)]
                self.n[k] += sign * len(own)
                self.sums[k] += sign * own.sum(0)

    def rows(self) -> list[int]:
        return [k for k in range(len(self.n)) if self.n[k] or self.sums[k].any()]


def vectors(df: DataFrame, id_col: str, vector_col: str, length: int) -> DataFrame:
    """(kind, at, id, vector): the usable vectors in whole numbers, each with a number of its own."""
    v = F.col(vector_col).cast("array<double>")
    usable = (F.size(v) == length) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.where(F.coalesce(usable, F.lit(False))).select(F.col(id_col).alias("id"), v.alias("vector"))
    out = T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("vector", T.ArrayType(T.IntegerType()))])

    def part(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            if batch.num_rows:
                flat = pa.array(whole(matrix(batch.column("vector"))).astype(np.int32).ravel())
                lists = pa.ListArray.from_arrays(np.arange(0, (batch.num_rows + 1) * length, length, dtype=np.int32), flat)
                yield pa.RecordBatch.from_arrays([batch.column("id"), lists], ["id", "vector"])

    numbered = rows.mapInArrow(part, out).select(F.lit("vector").alias("kind"), F.monotonically_increasing_id().alias("at"), "id", "vector")
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return numbered.repartition(n, "at")


def assign(held: DataFrame, before: DataFrame | None, centroids: np.ndarray, changed: np.ndarray) -> DataFrame:
    """(kind, at, owner, distance) of each vector and (kind, owner, n, sums) of each task's transfers."""
    rows = held.select("at", "vector")
    if before is None:
        rows = rows.select("*", F.lit(-1).alias("owner"), F.lit(0).cast("long").alias("distance"))
    else:
        rows = rows.join(before.where("kind = 'owner'").select("at", "owner", "distance").hint("shuffle_hash"), "at")
    k, length = centroids.shape
    names = ["kind", "at", "owner", "distance", "n", "sums"]

    def part(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transfers = Transfers(k, length)
        for batch in source:
            if not batch.num_rows:
                continue
            own = matrix(batch.column("vector")).astype(np.int64)
            was = batch.column("owner").to_numpy(zero_copy_only=False)
            owner, distance = nearest(own, centroids, changed, was.astype(np.int64), batch.column("distance").to_numpy(zero_copy_only=False))
            transfers.add(own, was, owner)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(["owner"] * n), batch.column("at"), pa.array(owner.astype(np.int32)), pa.array(distance), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64()))], names)
        some = transfers.rows()
        if some:
            n = len(some)
            sums = pa.array(list(transfers.sums[some]), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(["moved"] * n), pa.nulls(n, pa.int64()), pa.array(some, pa.int32()), pa.nulls(n, pa.int64()), pa.array(transfers.n[some]), sums], names)

    return rows.mapInArrow(part, "kind string, at long, owner int, distance long, n long, sums array<long>")


def seeds(held: DataFrame, k: int, seed: int, length: int) -> np.ndarray:
    """The vectors whose ids come first by hash; at most ``k`` rows reach the driver."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = held.select("vector", key.alias("key")).orderBy(F.asc_nulls_last("key"), "vector").limit(k).collect()
    return np.array([r["vector"] for r in first], np.int64).reshape(-1, length)


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def cluster(df: DataFrame, id_col: str, vector_col: str, k: int = K, rounds: int = ROUNDS, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256, centroid) of every usable vector."""
    with ExitStack() as names:
        held = names.enter_context(bucketed(vectors(df, id_col, vector_col, length), "at", "kind"))
        centroids = seeds(held, k, seed, length)
        n, sums = np.zeros(len(centroids), object), np.zeros(centroids.shape, object)
        changed, before = np.ones(len(centroids), bool), None
        for turn in range(rounds + 1):
            before = names.enter_context(bucketed(assign(held, before, centroids, changed), "at", "kind"))
            if turn == rounds:
                break
            totals = before.where("kind = 'moved'").groupBy("owner").agg(F.expr("sum(n) AS n"), *(F.expr(f"sum(sums[{i}]) AS s{i}") for i in range(length)))
            for r in totals.collect():  # a row a centroid
                n[r["owner"]] += r["n"]
                sums[r["owner"]] += np.array(r[2:], object)
            means = [s // c if c else old for s, c, old in zip(sums, n, centroids, strict=True)]
            moved = np.array(means, np.int64).reshape(centroids.shape)
            changed = (moved != centroids).any(1)
            centroids = moved
            if not changed.any():
                break
        owners = before.where("kind = 'owner'").select("at", "owner", "distance").hint("shuffle_hash")
        found = materialise(held.select("at", "id").join(owners, "at").select(F.col("id").alias(id_col), F.col("owner").alias("cluster"), "distance"), "clusters")
    inertia = {r["cluster"]: r["inertia"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    facts = [(i, inertia.get(i, 0), sum(inertia.values()), digest(c), c.tolist()) for i, c in enumerate(centroids)]
    facts = df.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string, centroid array<long>")
    return found.join(F.broadcast(facts), "cluster").select(id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid")
