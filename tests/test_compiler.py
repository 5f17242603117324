import functools
import itertools
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from dendrospark.functions.fp32 import word_of
from dendrospark.functions.models import rule_forest, trees_table
from dendrospark.operators import compiler, evaluation, graph, grid, regions, scoring

CUTS = [[0.0, 1.5, 3.0], [-1.0, 2.0], [0.5]]


def direct(rows, bias, x):
    """Classes of the ensemble, tree by tree in single precision."""
    known = {}
    for r in rows:
        known.setdefault(r[0], {})[r[2]] = r
    total = [np.float32(b) for b in bias]
    for t in sorted(known):
        n = known[t][0]
        while n[3] >= 0:
            v = np.float32(x[n[3]])
            n = known[t][n[7] if (n[6] if np.isnan(v) else v < np.float32(n[4])) else n[8]]
        total[n[1]] = np.float32(total[n[1]] + np.float32(n[9]))
    return int(np.argmax(total))


def grid_of(cuts, missing):
    return itertools.product(*([min(c) - 1, *c] + [float("nan")] * missing for c in cuts))


def follow(nodes, root, x):
    at = nodes[root]
    while at.feature >= 0:
        v = np.float32(x[at.feature])
        at = nodes[at.left if (at.default_left if np.isnan(v) else v < np.float32(at.cut)) else at.right]
    return at["class"]


@pytest.mark.parametrize(("rounds", "depth", "seed", "policy", "missing"), [(1, 1, 1, "source", True), (2, 2, 2, "source", True), (2, 2, 3, "widest", False), (3, 2, 4, "common", True), (2, 3, 5, lambda nodes: len(nodes) - 1, True), (1, 2, 6, lambda nodes: "nonsense", True)])
def test_graph_equals_ensemble_everywhere(spark, rounds, depth, seed, policy, missing):
    rows, bias = rule_forest(rounds, 3, CUTS, depth, seed), [0.0, 0.1, -0.1]
    nodes, root = compiler.compile_graph(trees_table(spark, rows), bias, 3, compiler.Domain(missing), policy)
    graph.require_valid(nodes, 3, 3)
    known = {r.node: r for r in nodes.collect()}
    for x in grid_of(CUTS, missing):
        assert follow(known, root, x) == direct(rows, bias, x)
    assert grid.audit(trees_table(spark, rows), bias, nodes, root, 3, missing).first().mismatches == 0


def test_waves_and_joins_give_the_same_graph(spark):
    rows, bias = rule_forest(2, 3, CUTS, 2, 7), [0.0] * 3
    trees = trees_table(spark, rows)
    one, top = compiler.compile_graph(trees, bias, 3)
    two, other = compiler.compile_graph(trees, bias, 3, budget=2, small=0)
    assert top == other and graph.same_graph(one, two)


def test_a_full_search_or_none(spark):
    trees = trees_table(spark, rule_forest(2, 3, CUTS, 2, 2))
    with pytest.raises(ValueError, match="no graph"):
        compiler.compile_graph(trees, [0.0] * 3, 3, most_states=2)


def test_exactly_one_groups(spark):
    cuts = [[0.5], [0.5], [0.5], [1.0, 2.0]]
    rows, bias = rule_forest(3, 2, cuts, 2, 8), [0.0, 0.0]
    nodes, root = compiler.compile_graph(trees_table(spark, rows), bias, 4, compiler.Domain(False, [[0, 1, 2]]))
    known = {r.node: r for r in nodes.collect()}
    for hot in range(3):
        for v in (0.0, 1.0, 1.5, 2.0, 9.0):
            x = [float(i == hot) for i in range(3)] + [v]
            assert follow(known, root, x) == direct(rows, bias, x)
    free, _ = compiler.compile_graph(trees_table(spark, rows), bias, 4, compiler.Domain(False))
    assert nodes.count() <= free.count()


def test_constant_class(spark):
    rows = rule_forest(1, 2, [[0.0]], 1, 1)
    nodes, root = compiler.compile_graph(trees_table(spark, rows), [100.0, 0.0], 1)
    assert [tuple(r)[1:] for r in nodes.collect()] == [(-1, None, None, None, -1, -1, 0)] and root == 0


def test_coverage_grows_to_one(spark):
    rows = rule_forest(2, 3, CUTS, 2, 2)
    shares = []
    for waves in (0, 1, 3, None):
        found = compiler.coverage(trees_table(spark, rows), [0.0] * 3, 3, most_waves=waves, budget=1).collect()
        assert sum(r.share for r in found) == pytest.approx(1)
        shares.append(sum(r.share for r in found if r["class"] is not None))
    assert shares[0] == 0 and shares[-1] == pytest.approx(1) and shares == sorted(shares)


@pytest.mark.parametrize(("depth", "seed", "missing"), [(2, 2, True), (3, 5, True), (3, 6, False)])
def test_settled_cells_are_those_of_the_grid(spark, depth, seed, missing):
    trees = trees_table(spark, rule_forest(3, 3, CUTS, depth, seed))
    found = compiler.coverage(trees, [0.0] * 3, 3, compiler.Domain(missing), budget=50)
    assert found.where("class IS NULL").isEmpty()
    by_class = {r["class"]: r.n for r in found.groupBy("class").agg(F.sum(F.col("cells").cast("long")).alias("n")).collect() if r.n}
    assert by_class == {r["class"]: r.cells for r in grid.class_cells(trees, [0.0] * 3, 3, missing).collect()}


def test_cells_beyond_64_bits_are_exact(spark):
    # the last feature decides; the others only multiply the cells
    wide, cuts = 12, [float(i) for i in range(60)]
    rows = [(0, 0, 0, wide, 0.5, word_of(0.5), True, 1, 2, None), (0, 0, 1, -1, None, None, None, -1, -1, 1.0), (0, 0, 2, -1, None, None, None, -1, -1, -1.0)]
    tree = 2
    for f in range(wide):
        for c in cuts:
            rows += [(tree, 0, 0, f, c, word_of(c), True, 1, 2, None), (tree, 0, 1, -1, None, None, None, -1, -1, 0.0), (tree, 0, 2, -1, None, None, None, -1, -1, 0.0)]
            tree += 2
    found = compiler.coverage(trees_table(spark, rows), [0.0, 0.0], wide + 1).where("class IS NOT NULL").collect()
    by_class = {k: sum(int(r.cells) for r in found if r["class"] == k) for k in (0, 1)}
    assert by_class == {0: 2 * 62**wide, 1: 62**wide}
    with pytest.raises(ValueError, match="groups"):
        compiler.coverage(trees_table(spark, rows), [0.0, 0.0], wide + 1, compiler.Domain(False, [[0, 1]]))


def test_walks_estimate_the_tree(spark):
    rows = rule_forest(2, 3, CUTS, 2, 2)
    trees = trees_table(spark, rows)
    own = compiler.Ensemble([r.asDict() for r in trees.collect()], [0.0] * 3, 3, compiler.Domain())
    work, leaves = [own.settle(own.start())], 0
    while work:
        data, label = work.pop()
        if label is not None:
            leaves += 1
        else:
            work += own.children(own.unpack(data))[1:]
    got = compiler.work_summary(compiler.estimate_states(trees, [0.0] * 3, 3, 4000)).first()
    assert abs(got.mean - leaves) < 5 * got.standard_error


def test_regions_match_cells(spark):
    rows, bias = rule_forest(2, 3, CUTS, 2, 9), [0.0] * 3
    trees = trees_table(spark, rows)
    boxes = regions.leaf_partitions(trees, 3)
    solid = boxes.where(regions.volume(boxes.lo, boxes.hi) > 0)
    assert evaluation.tree_conflicts(solid).count() == 0
    want = {}
    for x in grid_of(grid_cuts(rows), False):
        want[direct(rows, bias, x)] = want.get(direct(rows, bias, x), 0) + 1
    got = regions.class_regions(regions.score_regions(trees, bias, 3)).collect()
    assert {r["class"]: r.cells for r in got} == want


def grid_cuts(rows):
    return [sorted({r[4] for r in rows if r[3] == f}) or [0.0] for f in range(3)]


def test_margins_agree_both_ways(spark):
    rows, bias = rule_forest(3, 3, CUTS, 3, 10), [0.5, 0.0, 0.0]
    points = [(i, *x) for i, x in enumerate(grid_of(CUTS, True))]
    df = spark.createDataFrame(points, "row_id int, x0 float, x1 float, x2 float")
    names = ["x0", "x1", "x2"]
    out = [{r.row_id: r.margins for r in scoring.margins(df, trees_table(spark, rows), names, bias, how=how).collect()} for how in ("columns", "arrays")]
    assert out[0] == out[1]
    classes = {r.row_id: r["class"] for r in scoring.classify(df, trees_table(spark, rows), names, bias).collect()}
    assert classes == {i: direct(rows, bias, x) for i, *x in points}


def test_search_goes_on_where_it_stopped(spark, tmp_path):
    trees, bias, folder = trees_table(spark, rule_forest(2, 3, CUTS, 2, 7)), [0.0] * 3, f"file://{tmp_path}/search"
    whole, top = compiler.compile_graph(trees, bias, 3)
    with pytest.raises(compiler.Paused):
        compiler.compile_graph(trees, bias, 3, budget=1, folder=folder, most_waves=2)
    kept = sorted(p.name for p in (tmp_path / "search").iterdir() if p.name.startswith("wave-"))
    assert kept == ["wave-0", "wave-1"]
    nodes, root = compiler.compile_graph(trees, bias, 3, budget=1, folder=folder)
    assert root == top and graph.same_graph(nodes, whole)
    again, _ = compiler.compile_graph(trees, bias, 3, folder=folder, most_waves=0)
    assert graph.same_graph(again, whole)
    with pytest.raises(ValueError, match="another plan"):
        compiler.compile_graph(trees, [0.0, 0.0, 1.0], 3, folder=folder)


def test_spoiled_waves_are_refused(spark, tmp_path):
    trees, bias = trees_table(spark, rule_forest(2, 3, CUTS, 2, 7)), [0.0] * 3
    own = compiler.Ensemble([r.asDict() for r in trees.collect()], bias, 3, compiler.Domain())
    first, _ = own.settle(own.start())
    wave = compiler.explored(trees, bias, 3)
    waves = compiler.Waves(spark, f"file://{tmp_path}", own, None, "source")
    waves.check([wave], first)
    for bad in (wave.unionByName(wave), wave.where(wave.state != first), wave.limit(0)):
        with pytest.raises(ValueError, match="one search"):
            waves.check([bad], first)
    kept = waves.keep(wave, 0)
    compiler.save(spark.createDataFrame([(kept.inputFiles()[0].rsplit("/", 1)[0], 1, "other")], "path string, states long, content string"), f"file://{tmp_path}/wave-1", waves.plan)
    with pytest.raises(ValueError, match="as it was written"):
        waves.restore(first)


def test_region_of_the_domain(spark):
    rows, bias = rule_forest(3, 3, CUTS, 2, 11), [0.0] * 3
    trees = trees_table(spark, rows)
    region = compiler.Region({0: (0.0, 2.9), 1: (-5.0, 0.0)}, {0: False, 2: True})
    nodes, root = compiler.compile_graph(trees, bias, 3, region=region)
    known = {r.node: r for r in nodes.collect()}
    for x in itertools.product([0.0, 1.0, 1.5, 2.9], [-5.0, -1.0, 0.0, float("nan")], [0.0, 0.5, float("nan")]):
        assert follow(known, root, x) == direct(rows, bias, x)
    assert nodes.count() <= compiler.compile_graph(trees, bias, 3)[0].count()
    for bad in (compiler.Region({0: (2.0, 1.0)}, {0: False}), compiler.Region({0: (float("nan"), 1.0)})):
        with pytest.raises(ValueError):
            compiler.compile_graph(trees, bias, 3, region=bad)
    with pytest.raises(ValueError, match="missing"):
        compiler.compile_graph(trees, bias, 3, compiler.Domain(False), region=compiler.Region({}, {0: True}))


def test_witnesses_lie_in_their_regions(spark):
    rows, bias = rule_forest(3, 3, CUTS, 2, 12), [0.0] * 3
    trees = trees_table(spark, rows)
    own = compiler.Ensemble([r.asDict() for r in trees.collect()], bias, 3, compiler.Domain())
    points = compiler.witnesses(trees, bias, 3, compiler.explored(trees, bias, 3)).collect()
    assert len({p.number for p in points}) == 5
    for p in points:
        _, lo, hi, miss, _, _ = own.unpack(bytes(p.state))
        for f, v in enumerate(p.x):
            place = sum(c <= v for c in own.cuts[f])
            assert miss[f] if np.isnan(v) else lo[f] <= place <= hi[f]
    first, _ = own.settle(own.start())
    from_start = [p for p in points if bytes(p.state) == first]
    for f, choices in enumerate(own.choices(own.unpack(first))):
        zeros = {bool(np.signbit(v)) for v in choices if v == 0}
        assert zeros == {True, False} and sum(np.isnan(v) for v in choices) == 1 and choices[0] < own.cuts[f][0]
    assert len(from_start) == 5 and all(p["class"] == direct(rows, bias, p.x) for p in from_start)


def test_screen_changes_no_graph(spark):
    for seed in (1, 2, 3):
        trees = trees_table(spark, rule_forest(2, 3, CUTS, 2, seed))
        with_it, a = compiler.compile_graph(trees, [0.0] * 3, 3)
        without, b = compiler.compile_graph(trees, [0.0] * 3, 3, screen=False)
        assert a == b and graph.same_graph(with_it, without)


def test_groups_have_witnesses(spark):
    rows = rule_forest(2, 3, [[0.5], [0.5], [0.5], [1.0, 2.0]], 2, 5)
    domain = compiler.Domain(True, [[0, 1, 2]])
    own = compiler.Ensemble([r.asDict() for r in trees_table(spark, rows).collect()], [0.0] * 3, 4, domain)
    state = own.start(compiler.Region(members={0: [1, 2]}))
    assert {tuple(own.witness(state, m)[:3]) for m in range(9)} == {(0, 1, 0), (0, 0, 1)}
    nodes, root = compiler.compile_graph(trees_table(spark, rows), [0.0] * 3, 4, domain, region=compiler.Region(members={0: [1, 2]}))
    known = {r.node: r for r in nodes.collect()}
    for hot, x in itertools.product((1, 2), (0.0, 1.5, 3.0, float("nan"))):
        point = [float(k == hot) for k in range(3)] + [x]
        assert follow(known, root, point) == direct(rows, [0.0] * 3, point)


def reach(rows, tree, x):
    """The leaf value of a point."""
    own = {r[2]: r for r in rows if r[0] == tree}
    n = 0
    while own[n][3] >= 0:
        v = x[own[n][3]]
        n = own[n][7] if (own[n][6] if np.isnan(v) else np.float32(v) < np.float32(own[n][4])) else own[n][8]
    return np.float32(own[n][9])


@pytest.mark.parametrize("seed", range(6))
def test_pairs_of_trees_are_bounded_by_what_points_reach(seed):
    rows = rule_forest(3, 2, CUTS, 3, seed)
    names = ["tree", "channel", "node", "feature", "cut", "cut_bits", "default_left", "left", "right", "value"]
    own = compiler.Ensemble([dict(zip(names, r, strict=True)) for r in rows], [0.0] * 2, 3, compiler.Domain(), visits=1000)
    axes = [[c[0] - 1, *c, float("nan")] for c in own.cuts]
    at, *region, _ = own.start()
    for t, u in itertools.combinations(range(len(own.trees)), 2):
        sums = [np.float32(np.float32(np.float32(0.3) + reach(rows, t, x)) + reach(rows, u, x)) for x in itertools.product(*axes)]
        assert own.paired(t, u, at, tuple(region), np.float32(0.3), np.float32(0.3)) == (min(sums), max(sums))


def test_pairs_give_the_same_graph_after_fewer_states(spark, monkeypatch):
    counts = []
    real = compiler.assemble_small
    monkeypatch.setattr(compiler, "assemble_small", lambda spark, rows, first: (counts.append(len(rows)), real(spark, rows, first))[1])
    for seed in (3, 8):
        trees = trees_table(spark, rule_forest(4, 3, CUTS, 3, seed))
        one, a = compiler.compile_graph(trees, [0.0] * 3, 3, joint=False)
        two, b = compiler.compile_graph(trees, [0.0] * 3, 3, gaps=False)
        three, c = compiler.compile_graph(trees, [0.0] * 3, 3)
        assert a == b == c and graph.same_graph(one, two) and graph.same_graph(one, three)
        assert counts[-1] <= counts[-2] < counts[-3]


@pytest.mark.parametrize(("seed", "depth"), [(1, 1), (2, 1), (3, 2), (4, 3)])
def test_gaps_bound_the_difference_on_every_region(seed, depth):
    """Never above the least difference that a point has; with trees of one test each, as near as rounding lets it."""
    rows = rule_forest(4, 3, CUTS, depth, seed)
    names = ["tree", "channel", "node", "feature", "cut", "cut_bits", "default_left", "left", "right", "value"]
    own = compiler.Ensemble([dict(zip(names, r, strict=True)) for r in rows], [0.1, 0.0, 0.0], 3, compiler.Domain())
    rng = np.random.default_rng(seed)
    for _ in range(12):
        ends = [sorted(rng.integers(0, len(c) + 1, 2).tolist()) for c in own.cuts]
        miss = (rng.random(3) < 0.5).tolist()
        axes = [[(c[0] - 1, *c)[i] for i in range(lo, hi + 1)] + [float("nan")] * m for c, (lo, hi), m in zip(own.cuts, ends, miss, strict=True)]
        state = [0] * len(own.trees), [e[0] for e in ends], [e[1] for e in ends], miss, [], [np.float32(b) for b in own.bias]
        for w, r in itertools.permutations(range(3), 2):
            exact, rounded = [], []
            for x in itertools.product(*axes):
                values = [[np.float32(own.bias[c])] + [reach(rows, t, x) for t in range(len(own.trees)) if own.channel[t] == c] for c in (w, r)]
                sums = [functools.reduce(lambda a, b: np.float32(a + b), v) for v in values]
                rounded.append(float(sums[0]) - float(sums[1]))
                exact.append(sum(map(Fraction, map(float, values[0]))) - sum(map(Fraction, map(float, values[1]))))
            gap, room = own.gap(state, w, r), own.rounding(state, w) + own.rounding(state, r)
            assert gap <= min(rounded) and room < 1e-5
            if depth == 1:
                # with one feature a tree, the least of each axis is met by one point
                assert gap >= float(min(exact)) - room - 1e-12
