import numpy as np
import pytest
from pyspark.sql import functions as F

from dendrospark.llm import kmeans_tree
from dendrospark.llm.entry import op6_kmeans_tree_ann

SCHEMA = "vec_id long, embedding array<float>, label int, id long, vector string, leaf string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, 7, "x", "y") for i, v in rows], SCHEMA).repartition(3)


def brute(rows, k=20):
    good = [(i, np.array(v, np.float32).astype(np.float64)) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    ids = np.array([i for i, _ in good])
    x = np.array([v for _, v in good])
    out = {}
    for i, q in good:
        if i % 20 == 0:
            s = (x * q).sum(1)
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def test_recall_and_exact_scores(spark, folder):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((12, 16))
    x = (centres[rng.integers(0, 12, 2500)] + 0.6 * rng.standard_normal((2500, 16))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    truth = brute(rows)
    got = {}
    for r in op6_kmeans_tree_ann(spark, folder(embeddings=table(spark, rows))).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert set(got) == set(truth)
    assert all(sorted(found) == list(range(1, 21)) for found in got.values())
    hits = [len({v for v, _ in got[q].values()} & {v for v, _ in truth[q]}) / 20 for q in truth]
    assert np.mean(hits) >= 0.9
    for q, found in got.items():
        own = dict(brute_scores(x, q))
        assert [found[r] for r in sorted(found)] == sorted(((v, pytest.approx(own[v], abs=1e-12)) for v, _ in found.values()), key=lambda p: (-own[p[0]], p[0]))


def brute_scores(x, q):
    wide = x.astype(np.float64)
    return enumerate((wide * wide[q]).sum(1).tolist())


def test_copies_ties_and_unusable_vectors(spark, folder):
    rows = [(i, [1.0, 0.0]) for i in range(60)] + [(100, None), (120, [0.0, 0.0]), (140, [float("nan"), 1.0]), (160, [1.0, None]), (180, [float("inf"), 1.0]), (61, [-1.0, 0.5])]
    out = {}
    for r in op6_kmeans_tree_ann(spark, folder(embeddings=table(spark, rows))).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.vec_id)
    assert set(out) == {0, 20, 40}
    assert out[0] == list(range(1, 21)) and out[20] == [*range(20)] and out[40] == [*range(20)]


def test_few_candidates_and_none(spark, folder):
    out = op6_kmeans_tree_ann(spark, folder(embeddings=table(spark, [(0, [1.0]), (1, [2.0]), (2, [-3.0])]))).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in out] == [(1, 2.0), (2, -3.0)]
    assert op6_kmeans_tree_ann(spark, folder(embeddings=table(spark, []))).count() == 0
    assert op6_kmeans_tree_ann(spark, folder(embeddings=table(spark, [(1, [1.0]), (3, [2.0])]))).count() == 0


def test_traversal_is_best_first_and_complete():
    rng = np.random.default_rng(6)
    x = rng.standard_normal((500, 8))
    tree = kmeans_tree.grow(x, leaf=10)
    visits = tree.visits(x[:5], 10_000)
    assert all(sorted(v) == tree.leaves.tolist() for v in visits)
    assert all(a[:3] == b for a, b in zip(visits, tree.visits(x[:5], 3), strict=True))


@pytest.mark.parametrize("target", [0.0, 0.5])
def test_every_query_gets_k_rows_however_few_leaves_it_visits(spark, target):
    """Low recall may miss neighbours, but never shortens a query's list."""
    rng = np.random.default_rng(10)
    x = rng.standard_normal((1500, 32)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    out = kmeans_tree.search(table(spark, rows), "vec_id", "embedding", F.col("vec_id") % 20 == 0, target=target)
    sizes = {r.query_id: (r.n, r.most) for r in out.groupBy("query_id").agg(F.count("*").alias("n"), F.max("rank").alias("most")).collect()}
    assert sizes == {q: (20, 20) for q in range(0, 1500, 20)}
    assert out.select("query_id", "vec_id").distinct().count() == 75 * 20


def test_lists_are_the_best_of_the_leaves_visited(spark):
    """With the tree and the visits known, each list is exact over the rows of those leaves."""
    rng = np.random.default_rng(11)
    x = rng.standard_normal((900, 16))
    tree = kmeans_tree.grow(x, leaf=30)
    leaf, ids, asks = tree.descend(x), np.arange(900), np.arange(0, 900, 20)
    chosen = tree.visits(x[asks], 3)
    seen = np.array([np.isin(leaf, c) for c in chosen])
    least = kmeans_tree.bounds(ids[::2], x[::2], seen[:, ::2], asks, x[asks], 20)
    for i, q in enumerate(asks):
        rows = np.flatnonzero(seen[i] & (ids != q))
        score = (x[rows] * x[q]).sum(1)
        want = rows[np.lexsort((rows, -score))][:20]
        mine = np.flatnonzero(seen[i])
        _, got, _ = kmeans_tree.pairs(ids[mine], x[mine], np.array([q]), x[[q]], least[[i]], 20)
        assert got.tolist() == want.tolist()


def test_blocks_of_a_hot_leaf(spark, folder, monkeypatch):
    monkeypatch.setattr(kmeans_tree, "BLOCK", 16)
    rows = [(i, [1.0, 0.25]) for i in range(200)] + [(i, [0.1, -1.0 - i / 1000]) for i in range(201, 260)]
    out = kmeans_tree.search(table(spark, rows), "vec_id", "embedding", F.col("vec_id") % 20 == 0, target=1.0)
    got = {}
    for r in out.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {q: [v for v, _ in near] for q, near in brute(rows).items()}


def test_repeated_ids_and_unequal_lengths(spark, folder):
    """An id is one vector and is listed once; vectors of another length than most take no part."""
    rows = [(i, [1.0 + i / 100, 0.5]) for i in range(60)]
    odd = [(200, [1.0, 2.0, 3.0]), (201, [9.0]), (220, [])]
    once = op6_kmeans_tree_ann(spark, folder(embeddings=table(spark, rows))).orderBy("query_id", "rank").collect()
    more = op6_kmeans_tree_ann(spark, folder(embeddings=table(spark, rows + rows + odd + [(7, [9.0, 9.0])]))).orderBy("query_id", "rank").collect()
    assert once == more and len({r.vec_id for r in once if r.query_id == 0}) == 20


def clustered(n, seed):
    rng = np.random.default_rng(seed)
    centres = np.random.default_rng(8).standard_normal((100, 16)) * 4
    x = centres[rng.integers(0, len(centres), n)] + 0.3 * rng.standard_normal((n, 16))
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def met(spark, n, seed=3):
    """Rows that a query meets, and the recall, for a tree whose leaves outgrow the sample."""
    x = clustered(n, seed)
    df = spark.createDataFrame([(i, v.tolist(), i % 20 == 0) for i, v in enumerate(x)], "id long, vector array<double>, asks boolean").repartition(4)
    tree = kmeans_tree.fit(df, x[:600], n, upper=8)
    leaf = tree.descend(x)
    assert set(leaf) <= set(tree.leaves.tolist()) and len(tree.leaves) > 600 // kmeans_tree.LEAF
    visits = kmeans_tree.calibrate(tree, df, df.where("asks"), 20, 0.94)
    asks = np.arange(0, n, 20)[:100]
    seen, hits = 0, 0
    for q, chosen in zip(asks, tree.visits(x[asks], visits), strict=True):
        rows = np.flatnonzero(np.isin(leaf, chosen))
        seen += len(rows)
        best = np.argsort(-(x @ x[q]), kind="stable")
        hits += np.isin(best[best != q][:20], rows).sum()
    return len(tree.leaves), seen / len(asks), hits / len(asks) / 20


def test_leaves_grow_with_the_table(spark):
    """On clustered vectors eight times the rows give some three times the leaves, and far fewer rows met than eight times."""
    leaves, rows, recall = met(spark, 4000)
    more_leaves, more_rows, more_recall = met(spark, 32_000)
    assert more_leaves > 2 * leaves and more_rows < 4 * rows and min(recall, more_recall) >= 0.9


def test_search_with_grafted_trees(spark):
    x = clustered(3000, 4).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    truth = brute(rows)
    got = {}
    for r in kmeans_tree.search(table(spark, rows), "vec_id", "embedding", F.col("vec_id") % 20 == 0, sample=500, upper=6).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert np.mean([len(got[q] & {v for v, _ in truth[q]}) / 20 for q in truth]) >= 0.9


def test_block_counts_of_leaves_are_joined(spark, monkeypatch):
    """However many leaves are hot, the plan has no literal for each."""
    monkeypatch.setattr(kmeans_tree, "BLOCK", 2)
    rng = np.random.default_rng(9)
    vectors = np.concatenate([rng.normal(size=(300, 8)), np.repeat(rng.normal(size=(20, 8)), 30, axis=0)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    found = kmeans_tree.search(df, "vec_id", "embedding", kmeans_tree.F.col("vec_id") % 20 == 0, k=5)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "map(" not in plan and "blocks" in plan
    assert found.groupBy("query_id").count().where("count = 5").count() == 45
