import hashlib
import json
import math

import numpy as np
import pytest

from dendrospark.functions.models import rule_forest, trees_table
from dendrospark.plans import storage
from dendrospark.sources import boosters, tables


def put(tmp_path, name, data):
    path = tmp_path / name
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return f"file://{path}"


def test_csv_with_header_and_labels(spark, tmp_path):
    path = put(tmp_path, "a.csv", 'a,"b ""x""",label\r\n1,NA,red\r\n-2.5,+3e1,"blue, dark"\r\n\r\n,4,red\r\n')
    rows, names = tables.read_csv(spark, path, target="label")
    assert names == ["a", 'b "x"']
    out = [tuple(r) for r in rows.collect()]
    assert out[1] == (-2.5, 30.0, "blue, dark") and math.isnan(out[0][1]) and math.isnan(out[2][0]) and out[2][2] == "red"


def test_csv_headers_and_targets(spark, tmp_path):
    path = put(tmp_path, "n.csv", "1,2,0\n3,4,1\n")
    rows, names = tables.read_csv(spark, path, target="last")
    assert names == ["feature_0", "feature_1"] and rows.count() == 2
    rows, _ = tables.read_csv(spark, path, target=0, header="yes")
    assert rows.count() == 1
    for target, header in (("nope", "auto"), (7, "auto"), ("last", "maybe")):
        with pytest.raises(ValueError):
            tables.read_csv(spark, path, target=target, header=header)


@pytest.mark.parametrize("text", ["a,b\n1,2\n3\n", "a,b\n1,x\n", "a,b\n1,inf\n", "a,b\n1,1e999\n"])
def test_csv_refusals(spark, tmp_path, text):
    with pytest.raises(Exception):
        tables.read_csv(spark, put(tmp_path, "bad.csv", text), header="yes")[0].collect()


def test_labels(spark):
    rows = spark.createDataFrame([(3, "b"), (1, "a"), (2, "b"), (0, "c")], "i int, t string")
    mapping = tables.first_seen_labels(rows, "t", "i")
    assert {r.label: r["class"] for r in mapping.collect()} == {"c": 0, "a": 1, "b": 2}
    out = tables.apply_labels(rows, "t", mapping)
    assert {r.t: r.label for r in out.collect()} == {"c": 0, "a": 1, "b": 2}
    with pytest.raises(Exception, match="unknown label"):
        tables.apply_labels(rows.withColumnRenamed("t", "u"), "u", mapping.where("label <> 'a'")).collect()
    with pytest.raises(ValueError):
        tables.apply_labels(rows, "t", mapping.union(mapping))


def test_json_rows(spark, tmp_path):
    path = put(tmp_path, "r.json", json.dumps({"rows": [[1, None], [2.5, -1]]}))
    out = [tuple(r) for r in tables.read_json_rows(spark, path, 2).collect()]
    assert out[1] == (1, 2.5, -1.0) and math.isnan(out[0][2])
    with pytest.raises(Exception, match="width"):
        tables.read_json_rows(spark, path, 3).collect()


def test_dense_files(spark, tmp_path):
    x = np.arange(30, dtype="<f4").reshape(10, 3)
    path = put(tmp_path, "d.bin", x.tobytes())
    out = tables.read_dense(spark, path, 10, 2, 3, hashlib.sha256(x.tobytes()).hexdigest()).orderBy("row_id").collect()
    assert [(r.row_id, r.x0, r.x1) for r in out] == [(i, *x[i, :2].tolist()) for i in range(10)]
    for rows, sha in ((9, None), (10, "0" * 64)):
        with pytest.raises(ValueError):
            tables.read_dense(spark, path, rows, 2, 3, sha)


def test_images_in_permuted_order(spark, tmp_path):
    n, size = 7, 4
    body = bytes(range(n * size))
    path = put(tmp_path, "i.idx", np.array([0x803, n, 2, 2], ">u4").tobytes() + body)
    out = tables.read_images(spark, path, n, size, 3, 5).orderBy("row_id").collect()
    assert [r.source_row for r in out] == [(3 * r + 5) % n for r in range(n)]
    assert sorted(r.source_row for r in out) == list(range(n))
    assert all(r.x0 == float(4 * r.source_row) for r in out)
    with pytest.raises(Exception):
        tables.read_images(spark, path, n + 1, size).collect()


FOREST = rule_forest(2, 3, [[0.25, 2.0], [-3.5], [7.0, 8.0, 9.5], [1e-3]], 2, 17)
BASE = [0.5, -1.25, 3.0]


def as_json(forest=FOREST, bias=BASE, features=4):
    """A forest in the library's JSON form."""
    trees = []
    for t in sorted({r[0] for r in forest}):
        own = sorted(r for r in forest if r[0] == t)
        column = lambda inner, leaf: [leaf(r) if r[3] < 0 else inner(r) for r in own]  # noqa: B023, E731
        trees.append({
            "id": t, "tree_param": {"num_nodes": str(len(own)), "size_leaf_vector": "1"}, "categories": [], "split_type": [0] * len(own),
            "left_children": column(lambda r: r[7], lambda r: -1), "right_children": column(lambda r: r[8], lambda r: -1),
            "split_indices": column(lambda r: r[3], lambda r: 0), "split_conditions": column(lambda r: r[4], lambda r: r[9]), "default_left": column(lambda r: r[6], lambda r: False),
        })
    model = {"gbtree_model_param": {"num_trees": str(len(trees))}, "tree_info": [next(r[1] for r in forest if r[0] == t["id"]) for t in trees], "iteration_indptr": list(range(0, len(trees) + 1, len(bias))), "trees": trees}
    head = {"num_feature": str(features), "num_class": str(len(bias)), "num_target": "1", "base_score": json.dumps(bias)}
    return {"version": boosters.VERSION, "learner": {"learner_model_param": head, "objective": {"name": "multi:softprob"}, "gradient_booster": {"name": "gbtree", "model": model}}}


def test_booster(spark, tmp_path):
    trees, facts = boosters.read_booster(spark, put(tmp_path, "m.json", json.dumps(as_json())))
    assert facts == {"features": 4, "classes": 3, "bias": BASE, "objective": "multi:softprob", "trees": 6}
    want = trees_table(spark, FOREST).orderBy("tree", "node").collect()
    assert trees.orderBy("tree", "node").select(*want[0].__fields__).collect() == want


def at(doc, path):
    for step in path[:-1]:
        doc = doc[step]
    return doc, path[-1]


HEAD, MODEL = ("learner", "learner_model_param"), ("learner", "gradient_booster", "model")
TREE = (*MODEL, "trees", 4)
NODES = sum(r[0] == 4 for r in FOREST)

#: What the reader says it refuses, each as one change of a sound model.
REFUSED = {
    "another format version": [(("version",), [99, 0, 0])],
    "no scalar class model": [((*MODEL[:2], "name"), "gblinear"), (("learner", "objective", "name"), "rank:pairwise")],
    "extents out of range": [((*HEAD, "num_feature"), "0"), ((*HEAD, "num_class"), "5000"), ((*HEAD, "num_class"), "three")],
    "several targets": [((*HEAD, "num_target"), "3")],
    "tree count differs": [((*MODEL, "gbtree_model_param", "num_trees"), "5"), ((*MODEL, "tree_info"), [0, 1, 2])],
    "tree channel out of range": [((*MODEL, "tree_info"), [0, 1, 2, 0, 1, 3])],
    "round offsets": [((*MODEL, "iteration_indptr"), [0, 3]), ((*MODEL, "iteration_indptr"), [0, 4, 3, 6]), ((*MODEL, "iteration_indptr"), [6])],
    "bias differs": [((*HEAD, "base_score"), "[1,2]"), ((*HEAD, "base_score"), "[1,2,Infinity]")],
    "arrays are not sound": [((*TREE, "id"), 9), ((*TREE, "categories"), [4]), ((*TREE, "split_type", 0), 1), ((*TREE, "tree_param", "num_nodes"), str(NODES + 1)), ((*TREE, "tree_param", "size_leaf_vector"), "3"), ((*TREE, "default_left"), [True])],
    "a node is not sound": [((*TREE, "split_indices", 0), 4), ((*TREE, "left_children", 0), NODES), ((*TREE, "left_children", 0), 0)],
    "reached twice or never": [((*TREE, "left_children", 0), NODES - 1)],
}


@pytest.mark.parametrize(("what", "path", "value"), [(what, *change) for what, changes in REFUSED.items() for change in changes])
def test_booster_refusals(spark, tmp_path, what, path, value):
    doc = as_json()
    where, name = at(doc, path)
    where[name] = value
    with pytest.raises(ValueError, match=what):
        boosters.read_booster(spark, put(tmp_path, "m.json", json.dumps(doc)))


def test_storage(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "i int, t string")
    plan = {"rounds": 2, "out": "x"}
    where = f"file://{tmp_path}/saved"
    storage.save(df, where, plan, rows=3)
    back, manifest = storage.load(spark, where, {"rounds": 2, "out": "elsewhere"})
    assert back.count() == 3 and manifest["rows"] == 3
    with pytest.raises(ValueError):
        storage.load(spark, where, {"rounds": 3})
    with pytest.raises(Exception):
        storage.save(df, where, plan)
    assert storage.content_id(df) == storage.content_id(df.repartition(2)) != storage.content_id(df.distinct())
    with pytest.raises(ValueError):
        storage.bounded(df, 2, "rows")
