import hashlib
import math

import numpy as np
import pytest

from dendrospark.llm import delta_lloyd
from dendrospark.llm.entry import op11_delta_lloyd

COLUMNS = "vec_id long, embedding array<float>, label int, owner string, at string, kind string, sums string"


def brute(rows, k=8, rounds=10):
    """Plain Lloyd over (id, vector): every vector with every centroid, every round."""
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    seeds = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [v for _, v in seeds]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    owners = lambda: [min((far(v, c), j) for j, c in enumerate(centroids)) for _, v in kept]
    for _ in range(rounds):
        own = owners()
        for j in range(len(centroids)):
            members = [v for (_, v), (_, o) in zip(kept, own, strict=True) if o == j]
            if members:
                centroids[j] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    own = owners()
    inertia = [sum(d for d, o in own if o == j) for j in range(len(centroids))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, o, d, inertia[o], sum(inertia), sha[o]) for (i, _), (d, o) in zip(kept, own, strict=True)]


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "x", "x", "x") for i, v in rows], COLUMNS).repartition(5)


def clustered(n, seed=1, spread=0.05):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 64))
    return [(i, (centres[i % 12] + spread * rng.normal(size=64)).astype(np.float32).tolist()) for i in range(n)]


def plain(rows):
    return sorted((tuple(r) for r in rows), key=str)


@pytest.mark.parametrize("spread", [0.05, 2.0])
def test_query(spark, folder, spread):
    vectors = clustered(120, spread=spread)
    odd = [(500, None), (501, [0.5] * 63), (502, [0.5] * 65), (503, [0.5] * 63 + [None]), (504, [float("nan")] + [0.5] * 63), (505, [float("inf")] + [0.5] * 63), (506, [])]
    same = [(507, [0.0] * 64), (508, [0.0] * 64), (3, vectors[3][1]), (3, vectors[4][1]), (None, vectors[5][1]), (509, [-0.0001] * 64)]
    got = op11_delta_lloyd(spark, folder(embeddings=table(spark, vectors + odd + same)))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert plain(got.collect()) == plain(brute(vectors + odd + same))


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [0.25] * 64)], [(i, [0.25] * 64) for i in range(9)], clustered(5)])
def test_few_vectors(spark, folder, rows):
    got = op11_delta_lloyd(spark, folder(embeddings=table(spark, rows))).collect()
    assert plain(got) == plain(brute(rows))


def test_a_round_compares_no_more_than_it_must():
    rng = np.random.default_rng(4)
    rows, centroids = rng.integers(-900, 900, (300, 64)), rng.integers(-900, 900, (8, 64))
    everything = np.ones(8, bool)
    owner, distance = delta_lloyd.nearest(rows, centroids, everything, np.full(300, -1), np.zeros(300, np.int64))
    full = ((rows[:, None] - centroids) ** 2).sum(2)
    assert (owner == full.argmin(1)).all() and (distance == full.min(1)).all()
    for _ in range(6):
        changed = rng.random(8) < 0.3
        centroids = np.where(changed[:, None], centroids + rng.integers(-400, 400, (8, 64)), centroids)
        # an unchanged centroid's entry is read only where a row's own one moved away
        owner, distance = delta_lloyd.nearest(rows, centroids, changed, owner, distance)
        full = ((rows[:, None] - centroids) ** 2).sum(2)
        assert (owner == full.argmin(1)).all() and (distance == full.min(1)).all()


def test_transfers_sum_to_the_clusters():
    rng = np.random.default_rng(6)
    rows, before, after = rng.integers(-9, 9, (50, 4)), rng.integers(0, 3, 50), rng.integers(0, 3, 50)
    t = delta_lloyd.Transfers(3, 4)
    t.add(rows, np.full(50, -1), before)
    t.add(rows, before, after)
    for k in range(3):
        assert t.n[k] == (after == k).sum() and (t.sums[k] == rows[after == k].sum(0)).all()


def test_large_components_stay_exact():
    top = delta_lloyd.MOST - 1
    rows = np.array([[top] * 64, [-top] * 64, [top - 1] * 64])
    d = delta_lloyd.distances(rows, np.array([[-top] * 64, [top] * 64]))
    assert d.tolist() == [[64 * (2 * top) ** 2, 0], [0, 64 * (2 * top) ** 2], [64 * (2 * top - 1) ** 2, 64]]
    with pytest.raises(ValueError, match="too large"):
        delta_lloyd.whole(np.array([[1e9]]))


def test_rounds_move_no_vectors(spark, monkeypatch):
    plans = []
    real = delta_lloyd.bucketed

    def watch(df, by, kind):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, by, kind)

    monkeypatch.setattr(delta_lloyd, "bucketed", watch)
    delta_lloyd.cluster(table(spark, clustered(60)), "vec_id", "embedding", rounds=2).collect()
    assert all("Exchange" not in p for p in plans[1:]) and "ShuffledHashJoin" in plans[2]
