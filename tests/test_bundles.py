import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from dendrospark.functions import fp32
from dendrospark.functions.models import demo_graph, nodes_table, rule_forest, trees_table
from dendrospark.operators import bundles, graph, regions, scoring, study, training
from dendrospark.plans import storage
from dendrospark.sources import tables

NAMES = ["x", "y"]
CUTS = [[0.0, 1.0], [0.5, 2.0]]
PLAN = {"rounds": 1, "max_depth": 1, "max_bin": 4}


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    data = [(i, float(a), float(b), int(i % 3), "FIT" if i % 4 else "VALID") for i, (a, b) in enumerate(rng.uniform(-1, 3, (200, 2)))]
    return spark.createDataFrame(data, "row_id long, x float, y float, label int, role string").cache()


def combination(spark):
    """Two different teachers, one of them used twice, and a meta model on their nine probabilities."""
    zero = [0.0] * 3
    return bundles.Bundle(NAMES, 3, ["a", "b", "a"], {"a": (trees_table(spark, rule_forest(1, 3, CUTS, 2, 1)), zero), "b": (trees_table(spark, rule_forest(1, 3, CUTS, 1, 2)), zero), bundles.META: (trees_table(spark, rule_forest(2, 3, [[0.2, 0.4]] * 9, 2, 3)), zero)})


def by_hand(bundle, rows):
    """Classes by the teachers' probabilities laid side by side."""
    wide = rows
    for t, name in enumerate(bundle.teachers):
        trees, bias = bundle.models[name]
        own = scoring.margins(rows, trees, bundle.features, bias).withColumn("p", fp32.softmax(F.col("margins")))
        wide = wide.join(own.select("row_id", *(F.get("p", F.lit(k)).alias(f"t{t}_{k}") for k in range(3))), "row_id")
    trees, bias = bundle.models[bundles.META]
    return {r.row_id: r["class"] for r in scoring.classify(wide, trees, [f"t{t}_{k}" for t in range(3) for k in range(3)], bias).collect()}


def test_saved_bundles_classify_alike(spark, rows, tmp_path):
    made = combination(spark)
    path = f"file://{tmp_path}/b"
    bundles.save(made, path)
    back = bundles.load(spark, path)
    assert back.identity() == made.identity()
    got = {r.row_id: r["class"] for r in bundles.classify(back, rows, "row_id").collect()}
    assert got == by_hand(made, rows)
    scored = {r.role: (r.rows, r.errors) for r in bundles.evaluate(back, rows, "label", "role", "row_id").collect()}
    labels = {r.row_id: (r.role, r.label) for r in rows.collect()}
    for role in ("FIT", "VALID"):
        own = [i for i, (x, _) in labels.items() if x == role]
        assert scored[role] == (len(own), sum(got[i] != labels[i][1] for i in own))
    valid = rows.where("role = 'VALID'")
    assert bundles.retained(back, valid, "label", scored["VALID"][1], "row_id").count() == scored["VALID"][0]
    with pytest.raises(ValueError, match="retained"):
        bundles.retained(back, valid, "label", scored["VALID"][1] + 1, "row_id")


def test_spoiled_bundles_are_refused(spark, tmp_path):
    made = combination(spark)
    with pytest.raises(ValueError, match="needs"):
        bundles.save(bundles.Bundle(NAMES, 3, ["a", "c"], made.models), f"file://{tmp_path}/x")
    with pytest.raises(ValueError, match="needs"):
        bundles.save(bundles.Bundle(NAMES, 3, ["a"], made.models), f"file://{tmp_path}/y")
    one = bundles.Bundle(NAMES, 3, ["a"], {"a": made.models["a"]})

    def stored(name, table, facts, content=None):
        storage.save(table, f"file://{tmp_path}/{name}", {"bundle": facts}, content=content or storage.content_id(table))
        return f"file://{tmp_path}/{name}"

    table = made.models["a"][0].withColumn("model", F.lit("a"))
    facts = one.identity()
    assert bundles.load(spark, stored("good", table, facts)).teachers == ["a"]
    for name, bad, own, content, what in (
        ("content", table, facts, "0", "as it was written"),
        ("extra", table.unionByName(table.withColumn("model", F.lit("z"))), facts, None, "declares"),
        ("node", table.withColumn("feature", F.when(F.col("feature") >= 0, 7).otherwise(-1)), facts, None, "not sound"),
        ("bias", table, json.loads(json.dumps(facts)) | {"bias": {"a": [0.0]}}, None, "bias"),
    ):
        with pytest.raises(ValueError, match=what):
            bundles.load(spark, stored(name, bad, own, content))


def test_studies_stop_after_their_responses_and_go_on(spark, rows, tmp_path, monkeypatch):
    fit = rows.where("role = 'FIT'").withColumn("row_id", F.floor(F.col("row_id") / 4) * 3 + F.col("row_id") % 4 - 1)
    valid, folder = rows.where("role = 'VALID'"), f"file://{tmp_path}/study"
    run = lambda **more: study.combine(fit, valid, NAMES, "label", 3, [PLAN], [PLAN], **more)[0].collect()
    with pytest.raises(study.Stopped):
        run(folder=folder, stop_after_responses=True)
    want = run()
    monkeypatch.setattr(study, "out_of_fold", None)
    assert run(folder=folder) == want
    with pytest.raises(ValueError, match="another plan"):
        run(folder=folder, seed=1)


def test_a_study_killed_between_any_two_steps_goes_on(spark, rows, tmp_path, monkeypatch):
    """Every rename of a manifest fails once, as if the driver had died there; what is resumed equals an uninterrupted study."""
    fit = rows.where("role = 'FIT'").withColumn("row_id", F.floor(F.col("row_id") / 4) * 3 + F.col("row_id") % 4 - 1)
    valid, folder = rows.where("role = 'VALID'"), f"file://{tmp_path}/killed"
    run = lambda **more: study.combine(fit, valid, NAMES, "label", 3, [PLAN], [PLAN], **more)
    want, want_scored = run()
    move, fit_model, fitted, died = storage.move, training.train, [], set()

    def dies_once(spark, source, target):
        stage = target.split("/")[-2]
        if stage not in died:
            died.add(stage)
            raise KeyboardInterrupt(stage)
        return move(spark, source, target)

    def counted(*args):
        fitted.append(1)
        return fit_model(*args)

    monkeypatch.setattr(storage, "move", dies_once)
    monkeypatch.setattr(training, "train", counted)
    calls = 0
    while True:
        calls += 1
        try:
            found, scored = run(folder=folder)
            break
        except KeyboardInterrupt:
            continue
    assert died == {"responses", "teachers", "meta-0", "scored", "candidates"} and calls == 6
    # two folds, a teacher and a meta model, each lost once with its stage and never fitted again after that
    assert len(fitted) == 2 * (2 + 1 + 1)
    assert found.collect() == want.collect()
    assert sorted(map(tuple, scored.select(want_scored.columns).collect())) == sorted(map(tuple, want_scored.collect()))


def test_saved_tables_are_whole_or_absent(spark, tmp_path, monkeypatch):
    df, where = spark.range(5), f"file://{tmp_path}/table"
    move = storage.move
    monkeypatch.setattr(storage, "move", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        storage.save(df, where, {"a": 1})
    assert not storage.committed(spark, where)
    monkeypatch.setattr(storage, "move", move)
    storage.save(spark.range(3), where, {"a": 1})
    assert storage.load(spark, where, {"a": 1})[0].count() == 3
    with pytest.raises(FileExistsError):
        storage.save(df, where, {"a": 1})
    # a second run that passed the first check is refused at the rename
    monkeypatch.setattr(storage, "committed", lambda *a: False)
    with pytest.raises(FileExistsError):
        storage.save(df, where, {"a": 1})
    assert storage.load(spark, where)[0].count() == 3


def test_forks_keep_the_winner(spark):
    responses = spark.createDataFrame([(1, 0, 0, 0.5), (1, 1, 0, 0.25)], "row_id long, teacher int, class int, p double")
    donor = spark.createDataFrame([(0, "p"), (1, "q")], "teacher int, declaration string")
    own = spark.createDataFrame([(5, "q"), (6, "r")], "teacher int, declaration string")
    assert [(r.row_id, r.teacher, r.p) for r in bundles.fork(responses, donor, own, ["q"]).collect()] == [(1, 5, 0.25)]
    with pytest.raises(ValueError, match="winner"):
        bundles.fork(responses, donor, own, ["p", "q"])


def test_csv_is_parsed_once(spark, tmp_path, monkeypatch):
    path = tmp_path / "a.csv"
    path.write_text("a,b,c\n1,2,red\n3,,blue\n")
    folder = f"file://{tmp_path}/kept"
    want, names = tables.read_csv(spark, f"file://{path}", target="c")
    first, own = tables.retained_csv(spark, f"file://{path}", folder, target="c")
    assert own == names and first.collect()[0] == want.collect()[0]
    parse = tables.read_csv
    monkeypatch.setattr(tables, "read_csv", None)
    again, _ = tables.retained_csv(spark, f"file://{path}", folder, target="c")
    assert again.count() == 2
    monkeypatch.setattr(tables, "read_csv", parse)
    path.write_text("a,b,c\n9,2,red\n")
    assert tables.retained_csv(spark, f"file://{path}", folder, target="c")[0].first().a == 9.0


def test_lookups_want_exactly_one(spark):
    rows = spark.createDataFrame([(1, 0, 5), (2, 1, 5)], "row_id int, node int, rank int")
    arcs = spark.createDataFrame([(0, 0, 9, 7), (1, 0, 4, 8), (1, 5, 9, 9)], "node int, low int, high int, child int")
    assert {(r.row_id, r.child) for r in graph.take_arc(rows, arcs, "row_id").collect()} == {(1, 7), (2, 9)}
    for bad in (arcs.where("child <> 9"), arcs.union(spark.createDataFrame([(1, 5, 5, 3)], arcs.schema))):
        with pytest.raises(Exception, match="arcs that hold row 2"):
            graph.take_arc(rows, bad, "row_id").collect()
    costs = spark.createDataFrame([(0, 10), (1, 20)], "node int, cost int")
    assert {(r.row_id, r.cost) for r in graph.exact_lookup(rows, costs, "node", "cost").collect()} == {(1, 10), (2, 20)}
    for bad in (costs.where("node = 0"), costs.union(costs)):
        with pytest.raises(Exception, match="costs of key"):
            graph.exact_lookup(rows, bad, "node", "cost").collect()


def test_packed_graphs(spark):
    nodes, root = demo_graph()
    one = nodes_table(spark, nodes)
    packed, roots = graph.pack_graphs([(one, root), (one, 3)])
    graph.require_valid(packed, 3, 3)
    assert roots == [4, 8] and packed.count() == 10
    assert [tuple(r)[5:7] for r in packed.where("node = 9").collect()] == [(8, 7)]


def test_slopes_against_differences(spark):
    nodes, root = demo_graph()
    table, width, step = nodes_table(spark, nodes), [2.0, 1.0, 3.0], 0.5
    points = [(0, 0.5, 0.0, 1.0), (1, -4.0, 0.0, -2.0), (2, 300.0, 0.0, 0.25)]
    near = [(10 * i + 2 * f + (d > 0), *[v + d * step * (k == f) for k, v in enumerate(x)]) for i, *x in points for f in (0, 2) for d in (-1, 1)]
    make = lambda r: regions.graded_slopes(spark.createDataFrame(r, "id int, a float, b float, c float"), table, root, ["a", "b", "c"], 3, width)
    here, around = {r.id: r for r in make(points).collect()}, {r.id: r for r in make(near).collect()}
    for i in here:
        assert abs(sum(here[i].grades) - 1) < 1e-12
        for f in (0, 2):
            for k in range(3):
                slope = (around[10 * i + 2 * f + 1].grades[k] - around[10 * i + 2 * f].grades[k]) / (2 * step)
                assert abs(here[i].slopes[3 * k + f] - slope) < 5e-3
    hard = scoring.predict(spark.createDataFrame(points, "id int, a float, b float, c float"), table, root, ["a", "b", "c"]).collect()
    assert {r.id: r["class"] for r in hard} == {i: r["class"] for i, r in here.items()}
    graded = regions.graded_classes(spark.createDataFrame(points, "id int, a float, b float, c float"), table, root, ["a", "b", "c"], 3, width)
    assert all(np.allclose(r.grades, here[r.id].grades) for r in graded.collect())


def test_half_ulp_and_bits(spark):
    values = [0.0, 1.0, -1.5, 1e-45, 3.4028234663852886e38, float("inf"), float("nan")]
    got = [r.r for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v float").orderBy("i").select(fp32.half_ulp(F.col("v")).alias("r")).collect()]
    assert got == [2.0**-150, 2.0**-24, 2.0**-24, 2.0**-150, None, None, None]
    longs = spark.createDataFrame([(0,), (1,), (12,), (-(2**63),), (2**62 + 2,)], "x long")
    assert [(r.lo, r.hi) for r in longs.select(fp32.lowest_bit(F.col("x")).alias("lo"), fp32.highest_bit(F.col("x")).alias("hi")).collect()] == [(-1, -1), (0, 0), (2, 3), (63, 63), (1, 62)]
