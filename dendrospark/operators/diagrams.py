"""Ensembles as shared diagrams: one node a row, an axis a level, ordered sums by pairs of nodes.

A node tests one axis and has arcs (end, child) in order: a bin up to the first arc's end goes to its child, and so on;
the last bin of an axis stands for a missing value.  Every path passes every axis.  A node's id is the hash of
its arcs, and neighbouring arcs to one child are one, so equal functions are one node, whichever tree they come from:
``distinct`` is the table of known nodes.  Children of the last axis are terminals, texts of values.

Two diagrams are combined a level at a time: the different pairs of nodes that their roots lead to, then, from the last
level up, the nodes that these pairs make.  A pair is met once however many paths lead to it, and rows are
pairs, never paths or boxes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import bounded, cut
from .grid import axis_bins
from .regions import MOST_BOXES, leaf_partitions

#: nodes of a diagram, and its roots under the keys of what they stand for
DIAGRAM = "axis int, node string, arcs array<struct<end:int,child:string>>"
Combine = Callable[[Column, Column], Column]


def merged(arcs: Column) -> Column:
    """Arcs in order without those whose next one has the same child."""
    return F.filter(arcs, lambda x, i: ~x["child"].eqNullSafe(F.get(arcs, i + 1)["child"]))


def node_id(arcs: Column) -> Column:
    return F.sha2(F.to_json(arcs), 256)


def renamed(arcs: Column, ids: Column) -> Column:
    """Arcs whose children are looked up in a map."""
    return F.transform(arcs, lambda x: F.struct(x["end"].alias("end"), F.get(F.filter(ids, lambda e: e["old"] == x["child"]), F.lit(0))["id"].alias("child")))


def reduce_up(levels: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(nodes, names): the reduced nodes of levels (old, arcs), first axis first, and the (old, id) of the first level."""
    out, names = None, None
    for axis in range(len(levels) - 1, -1, -1):
        level = levels[axis]
        if names is not None:
            # the names of a node's children come to it as rows, so that nothing depends on how many nodes a level has
            below = level.select("old", F.explode(F.array_distinct(F.col("arcs.child"))).alias("child")).join(names.select(F.col("old").alias("child"), "id"), "child")
            found = below.groupBy("old").agg(F.collect_list(F.struct(F.col("child").alias("old"), "id")).alias("ids"))
            level = level.join(found, "old").withColumn("arcs", renamed(F.col("arcs"), F.col("ids"))).drop("ids")
        level = cut(level.select("old", merged(F.col("arcs")).alias("arcs")).withColumn("id", node_id(F.col("arcs"))), "level")
        names = level.select("old", "id")
        own = level.select(F.lit(axis).alias("axis"), F.col("id").alias("node"), "arcs").dropDuplicates(["node"])
        out = own if out is None else out.unionByName(own)
    return out, names


def from_trees(trees: DataFrame, features: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, roots): the diagrams of all trees in one table, and (channel, tree, node) of each tree's root.

    From axis to axis a node is a set of leaf boxes; the boxes' ends part the axis, and boxes that reach a part are
    the set below it.
    """
    bins = {r["feature"]: r["bins"] for r in bounded(axis_bins(trees), MOST_BOXES, "features")}
    boxes = leaf_partitions(trees, features).withColumn("box", F.concat_ws(":", "tree", "leaf"))
    at = cut(boxes.select(F.col("tree").cast("string").alias("node"), "box"), "sets")
    levels = []
    for f in range(features):
        missing = bins.get(f, 1)
        lo, hi, side = (F.get(c, F.lit(f)) for c in ("lo", "hi", "sides"))
        none = F.array().cast("array<struct<s:int,e:int>>")
        spans = F.concat(F.when(lo <= hi, F.array(F.struct(lo.alias("s"), hi.alias("e")))).otherwise(none), F.when(side == 1, F.array(F.struct(F.lit(missing).alias("s"), F.lit(missing).alias("e")))).otherwise(none))
        reach = at.join(boxes.select("box", "value", F.explode(spans).alias("x")), "box").select("node", "box", "value", "x.s", "x.e")
        ends = reach.groupBy("node").agg(F.array_sort(F.collect_set("e")).alias("last"), F.collect_set(F.col("s") - 1).alias("before"))
        ends = ends.select("node", F.array_sort(F.array_distinct(F.concat("last", F.filter("before", lambda e: e >= 0)))).alias("ends"))
        met = reach.join(ends, "node").withColumn("end", F.explode(F.filter("ends", lambda e: (e >= F.col("s")) & (e <= F.col("e")))))
        if f == features - 1:
            sets = met.select("node", "end", F.col("value").cast("string").alias("child"))
        else:
            sets = met.groupBy("node", "end").agg(F.sha2(F.concat_ws(",", F.array_sort(F.collect_list("box"))), 256).alias("child"), F.collect_list("box").alias("boxes"))
        sets = cut(sets, "sets")
        levels.append(sets.groupBy(F.col("node").alias("old")).agg(F.array_sort(F.collect_list(F.struct("end", "child"))).alias("arcs")))
        if f < features - 1:
            at = cut(sets.dropDuplicates(["child"]).select(F.col("child").alias("node"), F.explode("boxes").alias("box")), "sets")
    nodes, names = reduce_up(levels)
    tops = trees.where("node = 0").select("tree", "channel", F.col("tree").cast("string").alias("old"))
    return nodes, cut(tops.join(names, "old").select("channel", "tree", F.col("id").alias("node")), "roots")


def joined(combine: Combine) -> Column:
    """Arcs of a pair, with one child for the two."""
    return F.transform("below", lambda x: F.struct(x["end"].alias("end"), combine(x["a"], x["b"]).alias("child")))


def apply(nodes: DataFrame, pairs: DataFrame, axes: int, combine: Combine) -> tuple[DataFrame, DataFrame]:
    """(nodes, roots): the diagrams of ``pairs`` (key, a, b) of roots, whose terminals are ``combine`` of both sides'."""
    one = nodes.select("axis", F.col("node").alias("a"), F.col("arcs").alias("left"))
    two = nodes.select("axis", F.col("node").alias("b"), F.col("arcs").alias("right"))
    name = lambda a, b: F.concat_ws("+", a, b)
    front, levels = cut(pairs.select("a", "b").distinct(), "pairs"), []
    for axis in range(axes):
        both = front.join(one.where(F.col("axis") == axis).drop("axis"), "a").join(two.where(F.col("axis") == axis).drop("axis"), "b")
        ends = F.array_sort(F.array_union(F.col("left.end"), F.col("right.end")))
        child = lambda arcs, e: F.get(F.filter(arcs, lambda x: x["end"] >= e), F.lit(0))["child"]
        arcs = F.transform(ends, lambda e: F.struct(e.alias("end"), child(F.col("left"), e).alias("a"), child(F.col("right"), e).alias("b")))
        both = cut(both.select(name(F.col("a"), F.col("b")).alias("old"), arcs.alias("below")), "pairs")
        join = combine if axis == axes - 1 else name
        levels.append(both.select("old", joined(join).alias("arcs")))
        if axis < axes - 1:
            front = both.select(F.explode("below").alias("x")).select("x.a", "x.b").distinct()
    made, names = reduce_up(levels)
    roots = pairs.withColumn("old", name(F.col("a"), F.col("b"))).join(names, "old").select("key", F.col("id").alias("node"))
    return made, roots


def add(a: Column, b: Column) -> Column:
    """The single-precision sum of two terminals; texts of floats are exact both ways."""
    return (a.cast("float") + b.cast("float")).cast("float").cast("string")


def fold(nodes: DataFrame, roots: DataFrame, bias: list[float], axes: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, roots (key, node)): each channel's bias and trees added up in tree order, all channels a step together."""
    order = Window.partitionBy("channel").orderBy("tree")
    turns = cut(roots.withColumn("turn", F.row_number().over(order)), "turns")
    last = turns.agg(F.max("turn").alias("n")).first()["n"] or 0
    spark = nodes.sparkSession
    wide = (1 << 31) - 1
    levels = [spark.createDataFrame([(f"{k}", [(wide, f"{k}")]) for k in range(len(bias))], "old string, arcs array<struct<end:int,child:string>>") for _ in range(axes - 1)]
    levels.append(spark.createDataFrame([(f"{k}", [(wide, float(b))]) for k, b in enumerate(bias)], "old string, arcs array<struct<end:int,child:float>>").withColumn("arcs", F.col("arcs").cast("array<struct<end:int,child:string>>")))
    total, names = reduce_up(levels)
    at = names.select(F.col("old").cast("int").alias("key"), F.col("id").alias("node"))
    for turn in range(1, last + 1):
        now = turns.where(F.col("turn") == turn).select(F.col("channel").alias("key"), F.col("node").alias("b"))
        pairs = cut(at.withColumnRenamed("node", "a").join(now, "key"), "pairs")
        made, next_at = apply(total.unionByName(nodes).dropDuplicates(["axis", "node"]), pairs, axes, add)
        # channels without a tree in this turn keep what they have
        rest = at.join(now, "key", "left_anti")
        total, at = cut(total.unionByName(made).dropDuplicates(["axis", "node"]), "diagram"), cut(next_at.unionByName(rest), "roots")
    return total, at


def clipped(nodes: DataFrame, ends: list[int]) -> DataFrame:
    """Levels' nodes with no arc beyond an axis' last bin."""
    end = F.element_at(F.array(*(F.lit(e) for e in ends)), F.col("axis") + 1)
    return nodes.withColumn("arcs", F.transform("arcs", lambda x: F.struct(F.least(x["end"], end).alias("end"), x["child"].alias("child")))).dropDuplicates(["axis", "node"])


def class_diagram(trees: DataFrame, bias: list[float], features: int) -> tuple[DataFrame, str, list[int]]:
    """(nodes, root, last bins): the diagram of an ensemble's class, the first of equals, over its grid with missing values."""
    bins = {r["feature"]: r["bins"] for r in bounded(axis_bins(trees), MOST_BOXES, "features")}
    ends = [bins.get(f, 1) for f in range(features)]
    nodes, roots = fold(*from_trees(trees, features), bias, features)
    at = {r["key"]: r["node"] for r in bounded(roots, len(bias), "channels")}
    spark, root = trees.sparkSession, at[0]
    for k in range(1, len(bias)):
        nodes_k, top = apply(nodes, spark.createDataFrame([(0, root, at[k])], "key int, a string, b string"), features, lambda a, b: F.concat_ws(";", a, b))
        nodes, root = cut(nodes.unionByName(nodes_k).dropDuplicates(["axis", "node"]), "diagram"), top.first()["node"]
    scores = lambda x: F.transform(F.split(x, ";"), lambda s: s.cast("float"))
    label = lambda x: (F.array_position(scores(x), F.array_max(scores(x))) - 1).cast("string")
    # the class of a node with itself: the same pass as any other pair
    made, top = apply(nodes, spark.createDataFrame([(0, root, root)], "key int, a string, b string"), features, lambda a, b: label(a))
    return cut(clipped(made, ends), "diagram"), top.first()["node"], ends


def cells_by_terminal(nodes: DataFrame, root: str, axes: int) -> DataFrame:
    """(terminal, cells): how many cells of the grid reach each terminal, handed down a level at a time."""
    at = nodes.sparkSession.createDataFrame([(root, 1)], "node string, cells long").withColumn("cells", F.col("cells").cast("decimal(38,0)"))
    for axis in range(axes):
        arcs = F.transform("arcs", lambda x, i: F.struct(x["child"].alias("child"), (x["end"] - F.coalesce(F.get(F.col("arcs"), i - 1)["end"], F.lit(-1))).alias("bins")))
        below = at.join(nodes.where(F.col("axis") == axis), "node").select("cells", F.explode(arcs).alias("x"))
        at = below.groupBy(F.col("x.child").alias("node")).agg(F.sum((F.col("cells") * F.col("x.bins")).cast("decimal(38,0)")).cast("decimal(38,0)").alias("cells"))
    return at.withColumnRenamed("node", "terminal")
