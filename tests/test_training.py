import numpy as np
import pytest
from pyspark.sql import functions as F

from dendrospark.functions.models import trees_table
from dendrospark.operators import compiler, evaluation, grid, scoring, study, training
from dendrospark.plans import options

NAMES = ["x", "y"]
PLAN = {"rounds": 3, "max_depth": 2, "max_bin": 16, "eta": 0.5}


@pytest.fixture(scope="module")
def clusters(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(600):
        k = i % 3
        x, y = [(0, 0), (4, 0), (0, 4)][k] + rng.standard_normal(2)
        rows.append((i, float("nan") if i % 11 == 0 else float(x), float(y), k))
    return spark.createDataFrame(rows, "row_id long, x float, y float, label int").cache()


def test_learns_and_compiles(spark, clusters):
    trees, bias = training.train(clusters, NAMES, "label", 3, PLAN)
    scored = scoring.classify(clusters, trees, NAMES, bias)
    assert study.errors_of(scored, "label", "class") < 60
    assert trees.agg(F.max("tree")).first()[0] == 8
    nodes, root = compiler.compile_graph(trees, bias, 2)
    assert grid.audit(trees, bias, nodes, root, 2).first().mismatches == 0


def test_first_round_against_numpy(spark, clusters):
    """The first split of each class has the best gain over all features, bins and default sides."""
    rows = clusters.collect()
    cuts = training.quantile_cuts(clusters, NAMES, 8)
    trees, _ = training.train(clusters, NAMES, "label", 3, {"rounds": 1, "max_depth": 1, "max_bin": 8})
    got = {r.channel: r for r in trees.where("node = 0").collect()}
    x = np.array([[r.x, r.y] for r in rows], np.float32)
    label = np.array([r.label for r in rows])
    for k in range(3):
        g, h = 1 / 3 - (label == k), np.full(len(rows), 4 / 9)
        best = (-1,)
        for f in range(2):
            for cut in cuts[f]:
                for side in (False, True):
                    left = np.where(np.isnan(x[:, f]), side, x[:, f] < np.float32(cut))
                    gain = sum(g[m].sum() ** 2 / (h[m].sum() + 1) for m in (left, ~left))
                    best = max(best, (round(gain, 9), -f, -cut))
        assert (got[k].feature, got[k].cut) == (-best[1], pytest.approx(-best[2]))


def test_same_rows_same_model_and_prefixes(spark, clusters):
    one, _ = training.train(clusters, NAMES, "label", 3, PLAN | {"subsample": 0.7, "seed": 5})
    two, _ = training.train(clusters.repartition(5), NAMES, "label", 3, PLAN | {"subsample": 0.7, "seed": 5})
    keep = ["tree", "node", "feature", "cut", "default_left"]
    assert one.select(*keep).collect() == two.select(*keep).collect()
    short, _ = training.train(clusters, NAMES, "label", 3, PLAN | {"rounds": 1})
    whole, _ = training.train(clusters, NAMES, "label", 3, PLAN)
    assert training.prefix(whole, 1, 3).select(*keep).collect() == short.select(*keep).collect()


def test_bad_labels_and_parameters(spark, clusters):
    with pytest.raises(ValueError):
        training.train(clusters, NAMES, "label", 2, PLAN)
    for bad in ({}, {"rounds": 0, "max_depth": 1}, PLAN | {"eta": 0}, PLAN | {"eta": 1.5}, PLAN | {"other": 1}, PLAN | {"rounds": 1.5}, PLAN | {"subsample": 0}, PLAN | {"max_bin": 1}, PLAN | {"colsample_bytree": 0.5}, PLAN | {"lambda": float("nan")}):
        with pytest.raises(ValueError):
            options.training_parameters(bad, 3)
    with pytest.raises(ValueError):
        options.trials(PLAN, [{"rounds": 1}, {"rounds": 1}], 3)
    assert options.override({"a": [1, {"b": 2}]}, "/a/1/b", 5) == {"a": [1, {"b": 5}]}


def test_study(spark, clusters):
    fit, valid = clusters.where("row_id < 400"), clusters.where("row_id >= 400").withColumn("row_id", F.col("row_id") - 400)
    found, models = study.search(fit, valid, NAMES, "label", 3, PLAN, [{"rounds": 1, "max_depth": 1}, {"rounds": 3}])
    trials = found.collect()
    assert evaluation.winner(found).first().ord == min(trials, key=lambda r: (r.errors, r.bytes, r.ord)).ord
    assert [r.errors for r in trials] == [study.errors_of(scoring.classify(valid, trees, NAMES, bias), "label", "class") for trees, bias in models]
    table, scored = study.combine(fit, valid, NAMES, "label", 3, [PLAN | {"rounds": 1}, PLAN | {"rounds": 2}], [PLAN | {"rounds": 1}])
    rows = table.collect()
    assert [r.kind for r in rows] == ["teacher", "teacher", "combination"] and rows[2].bytes > rows[1].bytes
    gates = study.confirm(scored, table, 0, "label", 3, "row_id").collect()
    assert [g.level for g in gates] == list(range(len(gates))) and all(g.accepted for g in gates[:-1])


def test_out_of_fold_never_sees_its_fold(spark, clusters):
    """Teachers that learn a fold's rows by heart must not know the labels of that fold."""
    odd = clusters.select("row_id", F.col("row_id").cast("float").alias("x"), F.lit(0.0).cast("float").alias("y"), ((F.col("row_id") % 2) == 1).cast("int").alias("label")).where("row_id < 40")
    got = study.out_of_fold(odd, NAMES, "label", 2, [{"rounds": 1, "max_depth": 1, "max_bin": 4}], 2, 0, "row_id")
    p = {r.row_id: r.p for r in got.where("class = 1").collect()}
    assert len(p) == 40 and all((p[i] > 0.5) != (i % 2 == 1) for i in p)


def test_roles_and_holdouts(spark, clusters, tmp_path):
    with pytest.raises(ValueError):
        study.Rows(clusters, "TEST").to_fit()
    with pytest.raises(ValueError):
        study.Rows(clusters, "FIT").to_choose()
    used = study.Holdouts()
    used.spend(study.Rows(clusters, "HOLDOUT"), "a")
    with pytest.raises(ValueError):
        used.spend(study.Rows(clusters, "HOLDOUT"), "a")
    calls = []

    def classify(df):
        calls.append(1)
        return df.withColumn("class", F.lit(0))

    for _ in range(2):
        assert study.final_test(spark, f"file://{tmp_path}/final", {"model": 1}, study.Rows(clusters, "TEST"), classify, "label") == {"rows": 600, "errors": 400}
    assert calls == [1]
    with pytest.raises(ValueError):
        study.final_test(spark, f"file://{tmp_path}/final", {"model": 2}, study.Rows(clusters, "TEST"), classify, "label")


def test_blocks_and_folds(spark):
    from dendrospark.operators.evaluation import block_of, stated_block_of

    with pytest.raises(ValueError):
        block_of(F.lit(0), 2, 3)
    for sizes in ([1, 2], [0, 3], [-1, 4]):
        with pytest.raises(ValueError):
            stated_block_of(F.lit(0), sizes, 4 if sizes == [1, 2] else 3)


def test_model_table_schema(spark):
    assert trees_table(spark, []).columns[0] == "tree"


def test_margins_written_between_rounds_change_nothing(spark, clusters, monkeypatch):
    keep = ["tree", "node", "feature", "cut", "default_left", "left", "right", "value"]
    whole = training.train(clusters, NAMES, "label", 3, PLAN)[0].select(*keep).collect()
    monkeypatch.setattr(training, "KEEP", 1)
    monkeypatch.setattr(training, "MOST_CELLS", 40)
    assert training.train(clusters.repartition(3), NAMES, "label", 3, PLAN)[0].select(*keep).collect() == whole


def test_choice_equals_that_of_the_data_frame_form(spark, clusters):
    """The driver's choice on a summed histogram and ``best_splits`` agree."""
    p = options.training_parameters(PLAN, 3)
    cuts = training.quantile_cuts(clusters, NAMES, 16)
    zero = F.array(*(F.lit(0.0).cast("float") for _ in range(3)))
    rows = clusters.select("label", training.bin_columns(clusters, NAMES, cuts).alias("bins"), zero.alias("margins"))
    live = rows.withColumn("grads", training.gradients(F.col("margins"), F.col("label"), 3)).withColumn("at", F.array(*(F.lit(0) for _ in range(3))))
    want = {r["class"]: r for r in training.best_splits(training.histogram(live), p).collect()}
    width = max(map(len, cuts)) + 1
    for k, hist in enumerate(training.level(rows, [], [training.Tree() for _ in range(3)], [(k, 0) for k in range(3)], width, 2)):
        got = training.choose(hist, p)
        assert (got["feature"], got["bin"], got["default_left"]) == (want[k].feature, want[k].bin, want[k].default_left)
        assert abs(got["gl"] - want[k].gl) < 1e-5 and abs(got["h"] - want[k].h) < 1e-5


def test_less_of_two_siblings_is_added_up(spark, clusters, monkeypatch):
    """What is subtracted equals what would have been added up; rows below one node of a pair are passed over."""
    asked, level = [], training.level

    def seen(live, rounds, now, open_nodes, width, features):
        asked.append(list(open_nodes))
        return level(live, rounds, now, open_nodes, width, features)

    monkeypatch.setattr(training, "level", seen)
    plan = PLAN | {"rounds": 1, "max_depth": 3}
    some = sorted(map(tuple, training.train(clusters, NAMES, "label", 3, plan)[0].collect()))
    pairs = [len(a) for a in asked]
    asked.clear()
    monkeypatch.setattr(training, "MOST_CELLS", 0)
    assert sorted(map(tuple, training.train(clusters, NAMES, "label", 3, plan)[0].collect())) == some
    each = [len(a) for a in asked]
    assert pairs[0] == 3 and sum(each) == 3 + 2 * sum(pairs[1:]) and set(each) == {1}
