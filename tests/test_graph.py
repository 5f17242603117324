import itertools

import pytest

from dendrospark.functions.models import branch, branch_bits, demo_graph, leaf, nodes_table
from dendrospark.operators import graph, scoring

from .test_fp32 import SIGNED

NAN = float("nan")


def run(rows, root, x):
    known = {r[0]: r for r in rows}
    at, path = root, [root]
    while known[at][1] >= 0:
        _, f, cut, _, side, left, right, _ = known[at]
        v = x[f]
        at = left if (side if v != v else v < cut) else right
        path.append(at)
    return known[at][7], path


CASES = {
    "left chain": [leaf(0, 0), leaf(1, 1), branch(2, 0, 1.0, True, 0, 1), branch(3, 0, 1.0, True, 2, 1)],
    "right chain": [leaf(0, 0), leaf(1, 1), branch(2, 0, 1.0, True, 0, 1), branch(3, 0, 1.0, True, 0, 2)],
    "two deep": [leaf(0, 0), leaf(1, 1), leaf(2, 2), branch(3, 0, 1.0, False, 1, 0), branch(4, 0, 1.0, False, 3, 2), branch(5, 0, 1.0, False, 4, 0)],
    "shared child": [leaf(0, 0), leaf(1, 1), branch(2, 0, 1.0, True, 0, 1), branch(3, 0, 1.0, True, 2, 1), branch(4, 1, 0.0, True, 3, 2)],
    "zeros differ": [leaf(0, 0), leaf(1, 1), leaf(2, 2), branch_bits(3, 0, 0, True, 0, 1), branch_bits(4, 0, -(2**31), True, 3, 2)],
    "sides differ": [leaf(0, 0), leaf(1, 1), leaf(2, 2), branch(3, 0, 1.0, False, 0, 1), branch(4, 0, 1.0, True, 3, 2)],
    "features differ": [leaf(0, 0), leaf(1, 1), leaf(2, 2), branch(3, 1, 1.0, True, 0, 1), branch(4, 0, 1.0, True, 3, 2)],
    "equal subgraphs": [leaf(0, 0), leaf(1, 1), branch(2, 0, 1.0, True, 0, 1), branch(3, 0, 1.0, True, 0, 1), branch(4, 1, 0.0, True, 2, 3)],
    "collapse shows a prefix": [leaf(0, 0), leaf(1, 1), branch(2, 0, 1.0, True, 0, 1), branch(3, 0, 1.0, True, 0, 1), branch(4, 1, 0.0, True, 2, 3), branch(5, 0, 1.0, True, 4, 1)],
    "stray nodes": [leaf(0, 0), leaf(1, 1), leaf(2, 1), branch(3, 0, 5.0, True, 1, 2), branch(4, 0, 1.0, True, 0, 1)],
}
SIZES = {"left chain": 3, "right chain": 3, "two deep": 3, "shared child": 3, "zeros differ": 5, "sides differ": 5, "features differ": 5, "equal subgraphs": 3, "collapse shows a prefix": 3, "stray nodes": 3}


@pytest.mark.parametrize(("name", "small"), [*((n, 100) for n in CASES), ("collapse shows a prefix", 0), ("zeros differ", 0)])
def test_simplify_cases(spark, name, small):
    """In memory for all cases, and by joins for two of them."""
    rows = CASES[name]
    root = max(r[0] for r in rows)
    nodes, top, fixed = graph.simplify(nodes_table(spark, rows), root, 16, small)
    assert fixed and nodes.count() == SIZES[name]
    out = [tuple(r) for r in nodes.collect()]
    words = [graph.value_of(w) for w in SIGNED]
    for x in itertools.product(words, repeat=2):
        assert run(rows, root, x)[0] == run(out, top, x)[0]
    graph.require_valid(nodes, 2, 3)


BAD = {
    "class": [leaf(0, 3), leaf(1, 1), branch(2, 0, 1.0, True, 0, 1)],
    "feature": [leaf(0, 0), leaf(1, 1), branch(2, 2, 1.0, True, 0, 1)],
    "order": [leaf(0, 0), branch(1, 0, 1.0, True, 0, 2), leaf(2, 1)],
    "equal": [leaf(0, 0), branch(1, 0, 1.0, True, 0, 0)],
    "nan": [leaf(0, 0), leaf(1, 1), branch(2, 0, NAN, True, 0, 1)],
    "missing": [leaf(0, 0), branch(2, 0, 1.0, True, 0, 1)],
    "twice": [leaf(0, 0), leaf(0, 1)],
}


@pytest.mark.parametrize("name", BAD)
def test_invalid_graphs_are_refused(spark, name):
    with pytest.raises(ValueError):
        graph.require_valid(nodes_table(spark, BAD[name]), 2, 3)


def demo_input(spark):
    rows = [(r, NAN if r == 7 else (-1.0 if r % 2 else 0.0), 0.0, 0.0 if r % 3 else 1.0) for r in range(8)]
    return spark.createDataFrame(rows, "row_id int, x0 float, x1 float, x2 float"), rows


@pytest.mark.parametrize("how", ["case", "join", "arrays"])
def test_demo_classes_and_paths(spark, how):
    rows, root = demo_graph()
    df, raw = demo_input(spark)
    nodes = nodes_table(spark, rows)
    out = {r.row_id: r["class"] for r in scoring.predict(df, nodes, root, ["x0", "x1", "x2"], how=how).collect()}
    assert out == {r[0]: run(rows, root, r[1:])[0] for r in raw}
    explained = scoring.paths(df, nodes, root, ["x0", "x1", "x2"])
    assert {r.row_id: r.path for r in explained.collect()} == {r[0]: run(rows, root, r[1:])[1] for r in raw}


def test_short_path_capacity_and_infinity_are_errors(spark):
    rows, root = demo_graph()
    df, _ = demo_input(spark)
    with pytest.raises(ValueError):
        scoring.paths(df, nodes_table(spark, rows), root, ["x0", "x1", "x2"], most=1)
    bad = spark.createDataFrame([(1, float("inf"))], "row_id int, x0 float")
    with pytest.raises(Exception, match="infinite"):
        scoring.require_finite(bad, ["x0"]).collect()


def test_codecs_round_trip_and_refuse(spark):
    rows, root = demo_graph()
    nodes = nodes_table(spark, rows)
    data = graph.encode(nodes, root, 3, 3)
    back, top, features, classes = graph.decode(spark, data)
    assert (top, features, classes) == (root, 3, 3) and graph.same_graph(back, nodes)
    for broken in (data[:10], data[:-1], b"X" + data[1:], data + b"\0"):
        with pytest.raises(ValueError):
            graph.decode(spark, broken)
    assert graph.same_graph(graph.expand_compact(*graph.compact(nodes, 3)), nodes)


def test_import_needs_single_parents(spark):
    rows, root = demo_graph()
    nodes = nodes_table(spark, CASES["equal subgraphs"])
    with pytest.raises(ValueError):
        graph.import_tree(nodes)
    tree = nodes_table(spark, [leaf(70, 0), leaf(5, 1), branch(2, 0, 1.0, True, 70, 5)])
    out, top = graph.import_tree(tree)
    assert top == 2 and sorted(r.node for r in out.collect()) == [0, 1, 2]
    with pytest.raises(ValueError):
        graph.unfold(nodes_table(spark, rows), root, most=3)


def test_equal_rows_take_an_arc_each(spark):
    arcs = spark.createDataFrame([(0, 0, 4, 7), (0, 5, 9, 8)], "node int, low int, high int, child int")
    rows = spark.createDataFrame([(1, 0, 3), (1, 0, 3), (1, 0, 6)], "id int, node int, rank int")
    assert sorted(r.child for r in graph.take_arc(rows, arcs, "id").collect()) == [7, 7, 8]


def test_arcs_are_taken_without_gathering_rows(spark):
    arcs = spark.createDataFrame([(0, 0, 4, 7), (0, 5, 9, 8), (0, 5, 9, None)], "node int, low int, high int, child int")
    rows = spark.createDataFrame([(1, 0, 3), (2, 0, 6)], "id int, node int, rank int")
    taken = graph.take_arc(rows, arcs, "id")
    # the arcs alone are grouped; rows stay in the tasks that read them
    plan = graph.take_arc(rows, arcs, "id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan
    assert {(r.id, r.child) for r in taken.collect()} == {(1, 7), (2, 8)}
    for bad in ((3, 1, 3), (4, 0, 10), (5, 0, None)):
        with pytest.raises(Exception, match=f"arcs that hold row {bad[0]}: 0"):
            graph.take_arc(spark.createDataFrame([bad], "id int, node int, rank int"), arcs, "id").collect()
