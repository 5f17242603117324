"""Ensembles as tables of boxes: leaf partitions, their ordered sum, and graded explanations.

A box has the first and last bin of each feature; bin -1 is the missing value.  The leaf boxes of
a tree part the grid.  Adding trees one after another splits each region of the sum so far by the
boxes of the next tree that it meets, and adds their values in single precision and tree order;
nothing is joined, each region looks only at the boxes of one tree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import directed
from ..functions.fp32 import first_winner
from ..plans.storage import bounded, cut
from .grid import cut_catalog

MOST_BOXES = 1 << 16
LIST = 1024  #: overlaps of two trees' leaves that a region looks through in one row


def leaf_partitions(trees: DataFrame, features: int) -> DataFrame:
    """(tree, channel, leaf, lo, hi, value) of the boxes over numbers, and for missing values ``sides``.

    ``lo`` and ``hi`` are bins by feature.  ``sides`` has for each feature 1 if every test of it on
    the path sends a missing value along the path, else 0.
    """
    catalog = cut(cut_catalog(trees), "cuts")
    sizes = dict(bounded(catalog.select("feature", F.size("cuts")), MOST_BOXES, "features"))
    index = catalog.select("feature", F.posexplode("cuts").alias("at", "cut"))
    plain = F.col("cut") + F.lit(0.0).cast("float")
    full = cut(trees.withColumn("cut", plain).join(index, ["feature", "cut"], "left"), "nodes")
    last = F.array(*(F.lit(sizes.get(f, 0)) for f in range(features)))
    level = full.where("node = 0").select("tree", "channel", "node", "feature", "at", "default_left", "left", "right", "value", F.array(*(F.lit(0) for _ in range(features))).alias("lo"), last.alias("hi"), F.array(*(F.lit(1) for _ in range(features))).alias("sides"))
    out = None
    while not level.isEmpty():
        leaves = level.where("feature < 0").select("tree", "channel", F.col("node").alias("leaf"), "lo", "hi", "sides", "value")
        out = leaves if out is None else out.unionByName(leaves)
        inner = level.where("feature >= 0")
        parts = []
        for side in ("left", "right"):
            on = lambda i: i == F.col("feature")
            lo = F.transform("lo", lambda x, i: F.when(on(i), F.greatest(x, F.col("at") + 1)).otherwise(x)) if side == "right" else F.col("lo")
            hi = F.transform("hi", lambda x, i: F.when(on(i), F.least(x, F.col("at"))).otherwise(x)) if side == "left" else F.col("hi")
            fits = F.col("default_left") if side == "left" else ~F.col("default_left")
            sides = F.transform("sides", lambda x, i: F.when(on(i) & ~fits, 0).otherwise(x))
            parts.append(inner.select("tree", F.col(side).alias("node"), lo.alias("lo"), hi.alias("hi"), sides.alias("sides")))
        down = parts[0].unionByName(parts[1])
        level = cut(down.join(full.select("tree", "channel", "node", "feature", "at", "default_left", "left", "right", "value"), ["tree", "node"]), "level")
    return cut(out, "boxes")


def volume(lo: Column, hi: Column) -> Column:
    """How many cells a box has, without missing values."""
    sizes = F.zip_with(lo, hi, lambda a, b: F.greatest(b - a + 1, F.lit(0)).cast("long"))
    return F.aggregate(sizes, F.lit(1).cast("long"), lambda total, x: total * x)


def partition_audit(boxes: DataFrame, cells: int) -> DataFrame:
    """(tree, leaves, covered, whole): whether each tree's boxes have as many cells as the grid."""
    return boxes.groupBy("tree").agg(F.count("*").alias("leaves"), F.sum(volume(F.col("lo"), F.col("hi"))).alias("covered")).withColumn("whole", F.col("covered") == cells)


def atoms(lo: Column, hi: Column, missing: Column) -> Column:
    """The bins of an interval (none if it ends before it begins), and -1 where values may be missing."""
    numbers = F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))
    return F.concat(numbers, F.when(missing == 1, F.array(F.lit(-1))).otherwise(F.array().cast("array<int>")))


def spans(lo: Column, hi: Column, missing: Column, top: int) -> tuple[Column, Column]:
    """Two lists of (kind, level, at): what an interval of bins covers, and where it begins.

    Level k has blocks of 2^k bins.  An interval is the union of at most two blocks a level; its first bin lies in one
    block of every level.  So of two intervals, one covers the other's first bin in just one block if they meet.
    Kind 0 has the blocks of the covering side, kind 1 swaps the sides, kind 2 is for missing values.
    """
    a, z = lo.cast("long"), hi.cast("long") + 1
    cover, begin = [], []
    for k in range(top + 1):
        left, right = F.shiftright(a + ((1 << k) - 1), k), F.shiftright(z, k)
        cover += [(left < right) & (left % 2 == 1), k, left], [(left < right) & (right % 2 == 1), k, right - 1]
        begin.append((a < z, k, F.shiftright(a, k)))
    key = lambda kind, level, at: F.struct(F.lit(kind).alias("kind"), F.lit(level).alias("level"), at.alias("at"))
    none = F.when(missing == 1, key(2, 0, F.lit(0).cast("long")))
    rows = lambda covers, begins: F.array_compact(F.array(*(F.when(c, key(covers, k, x)) for c, k, x in cover), *(F.when(c, key(begins, k, x)) for c, k, x in begin), none))
    return rows(0, 1), rows(1, 0)


def meet(a: DataFrame, b: DataFrame, on: list[str], axis: int, few: Column | None = None) -> DataFrame:
    """Pairs of boxes (lo, hi, sides) of ``a`` and ``b`` that share a point, and the box of what they share.

    On one axis either box begins inside the other, and they meet there in the one block of bins that holds this
    place (``spans``); so a box is laid out over twice the logarithm of the bins, boxes apart on that axis never
    meet, and no pair comes up twice.  Boxes with ``few`` (a column of both) meet all others of ``on`` instead.
    The columns of ``b`` keep their names with a ``_`` before.
    """
    at = lambda c: F.get(c, F.lit(axis))
    most = [x.agg(F.max(at("hi"))).first()[0] for x in ([a] if a is b else [a, b])]
    ways = spans(at("lo"), at("hi"), at("sides"), max(x or 0 for x in most).bit_length())
    alone = F.array(F.struct(F.lit(3).alias("kind"), F.lit(0).alias("level"), F.lit(0).cast("long").alias("at")))
    ways = [F.inline(w if few is None else F.when(few, alone).otherwise(w)).alias("_kind", "_level", "_place") for w in ways]
    left, other = a.select("*", ways[0]), b.select("*", ways[1])
    keys = [*on, "_kind", "_level", "_place"]
    other = other.select(*keys, *(F.col(c).alias(f"_{c}") for c in b.columns if c not in on))
    greater, lesser = (lambda x, y: F.greatest(x, y)), (lambda x, y: F.least(x, y))
    lo, hi = F.zip_with("lo", "_lo", greater), F.zip_with("hi", "_hi", lesser)
    # rows are many times those that the files of the boxes let Spark expect: a merge join never holds a side whole
    both = left.join(other.hint("merge"), keys).withColumn("lo2", lo).withColumn("hi2", hi).withColumn("sides2", F.zip_with("sides", "_sides", lesser))
    shared = F.forall(F.arrays_zip("lo2", "hi2", "sides2"), lambda x: (x["lo2"] <= x["hi2"]) | (x["sides2"] == 1))
    once = F.when(F.col("_kind") == 1, at("lo") > at("_lo")).when(F.col("_kind") == 2, at("lo2") > at("hi2")).otherwise(True)
    kept = both.where(once & shared).drop("_kind", "_level", "_place", "lo", "hi", "sides", "_lo", "_hi", "_sides")
    return kept.withColumnsRenamed({"lo2": "lo", "hi2": "hi", "sides2": "sides"})


def pair_bounds(parts: DataFrame, boxes: DataFrame, pairs: DataFrame, axis: int = 0) -> DataFrame:
    """(region, a, b, least, greatest): bounds of the ordered sum of two trees inside each part of the domain.

    ``parts`` has (region, lo, hi, sides), a row a region, ``boxes`` what ``leaf_partitions`` gives, ``pairs`` (a, b), a
    before b.  Leaves count only where one point of the region reaches both, so the bounds are exact, and no wider than
    those of the trees one by one.

    Where leaves of both trees overlap is found once, for the model.  A region then looks through lists of at most
    ``LIST`` overlaps of a pair, so parts of the domain are neither laid out nor gathered.
    """
    own = boxes.select("tree", "lo", "hi", "sides", "value")
    pairs = pairs.select("a", "b").distinct()
    first = own.join(F.broadcast(pairs.withColumnRenamed("a", "tree")), "tree").withColumnRenamed("tree", "a")
    total = (F.col("value") + F.col("_value")).cast("float")
    met = cut(meet(first, own.withColumnRenamed("tree", "b"), ["b"], axis).select("a", "b", "lo", "hi", "sides", total.alias("total")), "overlaps")
    sizes = met.groupBy("a", "b").count()
    most = sizes.agg(F.max("count"), F.sum("count")).first()
    deal = F.pmod(F.xxhash64("lo", "hi", "sides"), F.ceil(F.col("count") / LIST))
    lists = met.join(sizes, ["a", "b"]).groupBy("a", "b", deal.alias("_deal")).agg(F.collect_list(F.struct("lo", "hi", "sides", "total")).alias("_met")).drop("_deal")
    every = parts.select("region", "lo", "hi", "sides").crossJoin(F.broadcast(lists) if (most[1] or 0) <= MOST_BOXES else lists)
    axes = F.sequence(F.lit(0), F.size("lo") - 1)

    def shared(x: Column) -> Column:
        at = lambda c, i: (F.get(c, i), F.get(x[c], i))
        return F.forall(axes, lambda i: (F.greatest(*at("lo", i)) <= F.least(*at("hi", i))) | (F.least(*at("sides", i)) == 1))

    totals = F.filter("_met", shared)["total"]
    out = every.select("region", "a", "b", totals.alias("_totals")).select("region", "a", "b", F.array_min("_totals").alias("least"), F.array_max("_totals").alias("greatest")).where("least IS NOT NULL")
    if (most[0] or 0) <= LIST:
        return out
    return out.groupBy("region", "a", "b").agg(F.min("least").alias("least"), F.max("greatest").alias("greatest"))


def axis_sums(trees: DataFrame, boxes: DataFrame) -> DataFrame:
    """(channel, axis, bin, least, greatest) of trees that read one feature each: their sum in every bin, -1 where values are missing.

    Trees are added in their order, rounded down and up; a tree without tests counts on axis 0, one that reads
    several features is an error.
    """
    reads = trees.groupBy("tree").agg(F.count_distinct(F.when(F.col("feature") >= 0, F.col("feature"))).alias("n"), F.greatest(F.max("feature"), F.lit(0)).alias("axis"))
    axis = F.when(F.col("n") <= 1, F.col("axis")).otherwise(F.raise_error(F.lit("a tree reads several features")).cast("int"))
    own = boxes.join(F.broadcast(reads.select("tree", axis.alias("axis"))), "tree")
    at = lambda c: F.get(c, F.col("axis"))
    steps = own.select("channel", "axis", "tree", F.col("value").cast("double").alias("value"), F.explode(atoms(at("lo"), at("hi"), at("sides"))).alias("bin"))
    values = F.array_sort(F.collect_list(F.struct("tree", "value")))
    added = lambda rule: F.aggregate(values, F.lit(0.0), lambda total, x: rule(total, x["value"]))
    return steps.groupBy("channel", "axis", "bin").agg(added(directed.add_down).alias("least"), added(directed.add_up).alias("greatest"))


def range_table(sums: DataFrame) -> DataFrame:
    """(channel, axis, level, bin, least, greatest): extremes of the 2^level bins from ``bin`` on, and the missing value at level -1.

    Any range of bins is covered by two rows of one level.
    """
    level = cut(sums.where("bin >= 0").select("channel", "axis", F.lit(0).alias("level"), "bin", "least", "greatest"), "level")
    out = sums.where("bin < 0").select("channel", "axis", F.lit(-1).alias("level"), "bin", "least", "greatest").unionByName(level)
    bins = level.agg(F.max("bin")).first()[0]
    for k in range((0 if bins is None else bins + 1).bit_length() - 1):
        ahead = level.select("channel", "axis", (F.col("bin") - (1 << k)).alias("bin"), F.col("least").alias("_least"), F.col("greatest").alias("_greatest"))
        level = level.join(ahead, ["channel", "axis", "bin"]).select("channel", "axis", F.lit(k + 1).alias("level"), "bin", F.least("least", "_least").alias("least"), F.greatest("greatest", "_greatest").alias("greatest"))
        level = cut(level, "level")
        out = out.unionByName(level)
    return out


def grouped_bounds(parts: DataFrame, table: DataFrame) -> DataFrame:
    """(region, channel, least, greatest): bounds of the exact sum of trees of one feature each inside each part of the domain.

    ``parts`` has (region, lo, hi, sides), ``table`` is a ``range_table``.  On each axis the trees are one step function,
    so its extremes are met by one bin, and those of the sum by one point.
    """
    axes = parts.select("region", F.posexplode(F.arrays_zip("lo", "hi", "sides")).alias("axis", "x")).select("region", "axis", "x.*")
    size = F.col("hi") - F.col("lo") + 1
    level = F.length(F.bin(size.cast("long"))) - 1
    both = F.array(F.struct(level.alias("level"), F.col("lo").alias("bin")), F.struct(level.alias("level"), (F.col("hi") + 1 - F.call_function("shiftleft", F.lit(1), level)).alias("bin")))
    none = F.array().cast("array<struct<level:int,bin:int>>")
    missing = F.when(F.col("sides") == 1, F.array(F.struct(F.lit(-1).alias("level"), F.lit(-1).alias("bin")))).otherwise(none)
    asked = axes.select("region", "axis", F.inline(F.array_distinct(F.concat(F.when(size > 0, both).otherwise(none), missing))))
    met = asked.join(table, ["axis", "level", "bin"]).groupBy("region", "channel", "axis").agg(F.min("least").alias("least"), F.max("greatest").alias("greatest"))
    ordered = F.array_sort(F.collect_list(F.struct("axis", "least", "greatest")))
    added = lambda rule, c: F.aggregate(ordered, F.lit(0.0), lambda total, x: rule(total, x[c]))
    return met.groupBy("region", "channel").agg(added(directed.add_down, "least").alias("least"), added(directed.add_up, "greatest").alias("greatest"))


def score_regions(trees: DataFrame, bias: list[float], features: int, most: int = 1 << 20) -> DataFrame:
    """(lo, hi, margins): regions of equal margins that part the grid of known values.

    More than ``most`` regions after any tree is an error.
    """
    boxes = leaf_partitions(trees, features)
    by_tree: dict[int, list] = {}
    for r in bounded(boxes, MOST_BOXES, "boxes"):
        if all(a <= b for a, b in zip(r["lo"], r["hi"], strict=True)):
            by_tree.setdefault(r["tree"], []).append(r)
    catalog = {r["feature"]: len(r["cuts"]) for r in bounded(cut_catalog(trees), MOST_BOXES, "features")}
    spark = trees.sparkSession
    start = [([0] * features, [catalog.get(f, 0) for f in range(features)], [float(b) for b in bias])]
    regions = spark.createDataFrame(start, "lo array<int>, hi array<int>, margins array<float>")
    for tree in sorted(by_tree):
        own = by_tree[tree]
        parts = F.array(*(F.struct(F.array(*map(F.lit, r["lo"])).alias("l"), F.array(*map(F.lit, r["hi"])).alias("h"), F.lit(r["value"]).cast("float").alias("v")) for r in own))
        both = regions.select("lo", "hi", "margins", F.explode(parts).alias("p"))
        lo, hi = F.zip_with("lo", "p.l", lambda a, b: F.greatest(a, b)), F.zip_with("hi", "p.h", lambda a, b: F.least(a, b))
        channel = own[0]["channel"]
        added = F.transform("margins", lambda m, i: F.when(i == channel, (m + F.col("p.v")).cast("float")).otherwise(m))
        met = both.select(lo.alias("lo"), hi.alias("hi"), added.alias("margins")).where(volume(F.col("lo"), F.col("hi")) > 0)
        regions = cut(met, "regions")
        if regions.count() > most:
            raise ValueError(f"more than {most} regions")
    return regions


def class_regions(regions: DataFrame) -> DataFrame:
    """(class, regions, cells) of score regions."""
    return regions.groupBy(first_winner(F.col("margins")).alias("class")).agg(F.count("*").alias("regions"), F.sum(volume(F.col("lo"), F.col("hi"))).alias("cells"))


def graded_classes(rows: DataFrame, nodes: DataFrame, root: int, features: list[str], classes: int, width: list[float], most: int = 4096) -> DataFrame:
    """``rows`` with ``grades``: the graph with each test softened to a sigmoid, as weights of the classes.

    A test's left share is the sigmoid of (cut - x) / width; a missing value takes its side whole.
    Shares flow from the root to the leaves in id order, so every node is an expression over the
    shares of its parents; the weights of a row's classes add up to one.
    """
    known = {r["node"]: r for r in bounded(nodes, most, "graph")}
    share: dict[int, Column] = {root: F.lit(1.0)}
    out = rows.withColumn("_g", F.array(*(F.lit(0.0) for _ in range(classes))))
    names: dict[int, str] = {}
    total: list[Column] = [F.lit(0.0) for _ in range(classes)]
    for n in sorted(known, reverse=True):
        if n not in share:
            continue
        name = f"_s{n}"
        out = out.withColumn(name, share[n])
        names[n] = name
        r, own = known[n], F.col(name)
        if r["feature"] < 0:
            total[r["class"]] = total[r["class"]] + own
            continue
        x = F.col(features[r["feature"]]).cast("double")
        z = (F.lit(float(r["cut"])) - x) / width[r["feature"]]
        left = F.when(F.isnan(x), float(r["default_left"])).when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))
        for child, part in ((r["left"], own * left), (r["right"], own * (1 - left))):
            share[child] = share[child] + part if child in share else part
    return out.withColumn("grades", F.array(*total)).drop("_g", *names.values())


def graded_slopes(rows: DataFrame, nodes: DataFrame, root: int, features: list[str], classes: int, width: list[float], most: int = 4096) -> DataFrame:
    """``rows`` with ``grades`` as ``graded_classes`` has them, ``slopes`` (their derivatives by each feature) and ``class``.

    From the leaves up each node gets its classes' weights and their derivatives, for all rows of a batch
    at once.  A missing value takes its side whole and has no derivative.  The hard class is followed in
    single precision.
    """
    known = sorted(bounded(nodes, most, "graph"), key=lambda r: r["node"])
    shared = rows.sparkSession.sparkContext.broadcast([r.asDict() for r in known])

    def explain(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            n = batch.num_rows
            x = np.stack([batch.column(f).to_numpy(zero_copy_only=False) for f in features], 1).astype(np.float32) if n else np.zeros((0, len(features)), np.float32)
            soft: dict[int, np.ndarray] = {}
            hard: dict[int, np.ndarray] = {}
            for r in shared.value:
                own = np.zeros((n, classes, 1 + len(features)))
                if r["feature"] < 0:
                    own[:, r["class"], 0] = 1
                    hard[r["node"]] = np.full(n, r["class"], np.int32)
                else:
                    f = r["feature"]
                    v = x[:, f].astype(np.float64)
                    gone = np.isnan(v)
                    z = (r["cut"] - np.where(gone, 0, v)) / width[f]
                    small = np.exp(-np.abs(z))
                    share = np.where(gone, float(r["default_left"]), np.where(z >= 0, 1 / (1 + small), small / (1 + small)))
                    slope = np.where(gone, 0, -small / (1 + small) ** 2 / width[f])
                    a, b = soft[r["left"]], soft[r["right"]]
                    own[:] = share[:, None, None] * a + (1 - share)[:, None, None] * b
                    own[:, :, 1 + f] += slope[:, None] * (a[:, :, 0] - b[:, :, 0])
                    left = np.where(np.isnan(x[:, f]), r["default_left"], x[:, f] < np.float32(r["cut"]))
                    hard[r["node"]] = np.where(left, hard[r["left"]], hard[r["right"]])
                soft[r["node"]] = own
            top = soft[root]
            lists = lambda m: pa.array(list(m.reshape(n, m.size // n if n else 0)), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists(top[:, :, 0]), lists(np.ascontiguousarray(top[:, :, 1:])), pa.array(hard[root])], [*batch.schema.names, "grades", "slopes", "class"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(explain, f"{kinds}, grades array<double>, slopes array<double>, class int")
