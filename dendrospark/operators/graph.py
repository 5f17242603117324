"""Decision graphs as tables of nodes: checks, simplification, statistics, codecs, export.

Graph-sized tables go through the same joins and aggregates as any other.  Loops run over the
graph's height, and each round is written to the shared folder.
"""

from __future__ import annotations

import struct
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.fp32 import decimal_text, value_of
from ..functions.models import NODES
from ..plans.storage import bounded, cut

MOST_NODES = 1 << 20
MOST_ARCS = 1 << 18  #: arcs that a join may send to all executors
PREDICATE = ["feature", "cut_bits", "default_left"]
COLUMNS = [x.split()[0] for x in NODES.split(", ")]


def is_leaf() -> Column:
    return F.col("feature") == -1


def invalid_nodes(nodes: DataFrame, features: int, classes: int) -> DataFrame:
    """(node, problem) of every node that breaks a rule of the schema; none for a valid graph."""
    n = F.col
    nan_word = n("cut_bits").bitwiseAND(F.lit(0x7FFFFFFF)) > 0x7F800000
    own = nodes.select(
        "node",
        F.when(is_leaf() & (n("class").isNull() | (n("class") < 0) | (n("class") >= classes)), "class out of range")
        .when(is_leaf() & ((n("left") != -1) | (n("right") != -1)), "leaf with children")
        .when(~is_leaf() & ((n("feature") < 0) | (n("feature") >= features)), "feature out of range")
        .when(~is_leaf() & (n("cut_bits").isNull() | nan_word | n("default_left").isNull()), "no usable cut")
        .when(~is_leaf() & ((n("left") >= n("node")) | (n("right") >= n("node")) | (n("left") < 0) | (n("right") < 0)), "child not before its parent")
        .when(~is_leaf() & (n("left") == n("right")), "equal children")
        .alias("problem"),
    ).where("problem IS NOT NULL")
    twice = nodes.groupBy("node").count().where("count > 1").select("node", F.lit("repeated id").alias("problem"))
    ends = edges(nodes).join(nodes.select(F.col("node").alias("child")), "child", "left_anti").select(F.col("parent").alias("node"), F.lit("child is missing").alias("problem"))
    return own.unionByName(twice).unionByName(ends)


def edges(nodes: DataFrame) -> DataFrame:
    """(parent, side, child) with side 0 for left."""
    return nodes.where(~is_leaf()).select(F.col("node").alias("parent"), F.posexplode(F.array("left", "right")).alias("side", "child"))


def require_valid(nodes: DataFrame, features: int, classes: int) -> None:
    found = invalid_nodes(nodes, features, classes).limit(3).collect()
    if found:
        raise ValueError(f"invalid graph: {[tuple(r) for r in found]}")


def reachable(nodes: DataFrame, *roots: int) -> DataFrame:
    """(node) of all nodes on paths from the roots, one join a level."""
    out = edges(nodes)
    seen = cut(nodes.where(F.col("node").isin(*roots)).select("node"), "seen")
    front = seen
    while not front.isEmpty():
        step = out.join(front.withColumnRenamed("node", "parent"), "parent").select(F.col("child").alias("node")).distinct()
        front = cut(step.join(seen, "node", "left_anti"), "front")
        seen = cut(seen.unionByName(front), "seen")
    return seen


def bypass(nodes: DataFrame) -> tuple[DataFrame, bool]:
    """Skips children that repeat their parent's test: its outcome is known on that side."""
    child = nodes.select(F.col("node").alias("at"), *(F.col(c).alias(f"c_{c}") for c in [*PREDICATE, "left", "right"]))
    changed = False
    while True:
        same = [F.col(c).eqNullSafe(F.col(f"c_{c}")) for c in PREDICATE]
        again = same[0] & same[1] & same[2] & ~is_leaf()
        out = nodes
        for side in ("left", "right"):
            pick = F.when(again, F.col(f"c_{side}")).otherwise(F.col(side))
            out = out.join(child, F.col(side) == F.col("at"), "left").select(*(pick.alias(c) if c == side else F.col(c) for c in COLUMNS))
        out = cut(out, "bypass")
        if out.exceptAll(nodes).isEmpty():
            return out, changed
        nodes, changed = out, True


def intern(nodes: DataFrame, root: int) -> tuple[DataFrame, int, bool]:
    """Replaces equal-child nodes by the child and equal nodes by the one with the least id."""
    changed = False
    while True:
        first = nodes.groupBy("feature", "cut_bits", "default_left", "left", "right", "class").agg(F.min("node").alias("first"), F.collect_list("node").alias("all"))
        equal = first.where(F.size("all") > 1).select(F.explode("all").alias("from"), F.col("first").alias("to")).where(F.col("from") != F.col("to"))
        single = nodes.where(~is_leaf() & (F.col("left") == F.col("right"))).select(F.col("node").alias("from"), F.col("left").alias("to"))
        alias = cut(equal.unionByName(single).groupBy("from").agg(F.min("to").alias("to")), "alias")
        if alias.isEmpty():
            return nodes, root, changed
        changed = True
        out = nodes.join(alias.select(F.col("from").alias("node")), "node", "left_anti")
        for side in ("left", "right"):
            out = out.join(alias, F.col(side) == F.col("from"), "left").select(*(F.coalesce("to", c).alias(c) if c == side else F.col(c) for c in COLUMNS))
        nodes = cut(out, "interned")
        moved = alias.where(F.col("from") == root).first()
        root = moved["to"] if moved else root


def renumber(nodes: DataFrame, root: int) -> tuple[DataFrame, int]:
    """Keeps what is reachable, with dense ids in which children come before parents.

    Ids keep their order; the prefix count needs one ordering of the graph, whose size is bounded.
    """
    kept = nodes.join(reachable(nodes, root), "node", "left_semi")
    ids = [r["node"] for r in bounded(kept.select("node").orderBy("node"), MOST_NODES, "graph")]
    spark = nodes.sparkSession
    new = spark.createDataFrame(list(zip(ids, range(len(ids)), strict=True)), "old int, new int")
    out = kept.join(new, F.col("node") == F.col("old")).select(F.col("new").alias("node"), *COLUMNS[1:])
    for side in ("left", "right"):
        out = out.join(new, F.col(side) == F.col("old"), "left").select(*(F.coalesce("new", F.lit(-1)).alias(c) if c == side else F.col(c) for c in COLUMNS))
    return cut(out, "renumbered"), ids.index(root)


def simplify(nodes: DataFrame, root: int, passes: int = 4, small: int = 1 << 14) -> tuple[DataFrame, int, bool]:
    """Up to ``passes`` rounds of bypass, interning and collection; whether a fixed point was reached.

    Graphs of up to ``small`` nodes, in which children come first, are rewritten in memory.
    """
    if not 1 <= passes <= 16:
        raise ValueError("passes must be from 1 to 16")
    rows = nodes.limit(small + 1).collect()
    if len(rows) <= small and all(r["left"] < r["node"] and r["right"] < r["node"] for r in rows):
        return simplify_rows(nodes.sparkSession, rows, root, passes)
    for _ in range(passes):
        before = nodes.count()
        nodes, moved = bypass(nodes)
        nodes, root, folded = intern(nodes, root)
        nodes, root = renumber(nodes, root)
        if not moved and not folded and nodes.count() == before:
            return nodes, root, True
    return nodes, root, False


def simplify_rows(spark: SparkSession, rows: list, root: int, passes: int) -> tuple[DataFrame, int, bool]:
    """One pass goes up the ids once: every node's children are final before it is looked at."""
    graph = {r["node"]: (r["feature"], r["cut_bits"], r["default_left"], r["left"], r["right"], r["class"]) for r in rows}
    for done in range(passes + 1):
        made: dict[tuple, int] = {}
        alias: dict[int, int] = {}
        kept: dict[int, tuple] = {}
        for n in sorted(graph):
            feature, word, side, left, right, label = graph[n]
            if feature >= 0:
                ends = []
                for at, child in enumerate((left, right)):
                    while graph[child][:3] == (feature, word, side):
                        child = graph[child][3 + at]
                    ends.append(alias[child])
                if ends[0] == ends[1]:
                    alias[n] = ends[0]
                    continue
                left, right = ends
            key = (feature, word, side, left, right, label)
            alias[n] = made.setdefault(key, n)
            if alias[n] == n:
                kept[n] = key
        top = alias[root]
        live, work = {top}, [top]
        while work:
            fresh = {c for c in kept[work.pop()][3:5] if c >= 0} - live
            live |= fresh
            work += fresh
        order = {n: i for i, n in enumerate(sorted(live))}
        order[-1] = -1
        after = {order[n]: (*kept[n][:3], order[kept[n][3]], order[kept[n][4]], kept[n][5]) for n in live}
        same = after == graph
        if same or done == passes:
            break
        graph, root = after, order[top]
    out = [(n, f, None if f < 0 else value_of(w), w, s, a, b, k) for n, (f, w, s, a, b, k) in sorted(graph.items())]
    return spark.createDataFrame(out, NODES), root, same


def heights(nodes: DataFrame, small: int = 1 << 14) -> DataFrame:
    """(node, height, unfolded): steps to the deepest leaf, and nodes of the tree it unfolds to (decimal).

    Up to ``small`` nodes are folded in memory, larger graphs by a join a level.
    """
    rows = nodes.select("node", "feature", "left", "right").limit(small + 1).collect()
    if len(rows) <= small:
        return fold_heights(nodes.sparkSession, rows)
    done = cut(nodes.where(is_leaf()).select("node", F.lit(0).alias("height"), F.lit(1).cast("decimal(38,0)").alias("unfolded")), "height")
    left = cut(nodes.where(~is_leaf()).select("node", "left", "right"), "left")
    while not left.isEmpty():
        a = done.select(F.col("node").alias("left"), F.col("height").alias("h1"), F.col("unfolded").alias("u1"))
        b = done.select(F.col("node").alias("right"), F.col("height").alias("h2"), F.col("unfolded").alias("u2"))
        ready = cut(left.join(a, "left").join(b, "right").select("node", (F.greatest("h1", "h2") + 1).alias("height"), (F.col("u1") + F.col("u2") + 1).cast("decimal(38,0)").alias("unfolded")), "ready")
        if ready.isEmpty():
            raise ValueError("the graph has a cycle or a missing child")
        done = cut(done.unionByName(ready), "height")
        left = cut(left.join(ready, "node", "left_anti"), "left")
    return done


def fold_heights(spark: SparkSession, rows: list) -> DataFrame:
    found = {r["node"]: (0, 1) for r in rows if r["feature"] == -1}
    left = [r for r in rows if r["feature"] != -1]
    while left:
        ready = [r for r in left if r["left"] in found and r["right"] in found]
        if not ready:
            raise ValueError("the graph has a cycle or a missing child")
        for r in ready:
            (h1, u1), (h2, u2) = found[r["left"]], found[r["right"]]
            found[r["node"]] = (max(h1, h2) + 1, u1 + u2 + 1)
        left = [r for r in left if r["node"] not in found]
    whole = [(n, h, Decimal(u)) for n, (h, u) in found.items()]
    return spark.createDataFrame(whole, "node int, height int, unfolded decimal(38,0)")


def statistics(nodes: DataFrame, root: int) -> DataFrame:
    """One row: nodes, leaves, branches, edges, predicates, features used, height, unfolded size."""
    top = heights(nodes).where(F.col("node") == root).select(F.col("height").cast("int").alias("height"), F.col("unfolded").cast("string").alias("unfolded"))
    own = nodes.agg(
        F.count("*").alias("nodes"), F.count_if(is_leaf()).alias("leaves"), F.count_if(~is_leaf()).alias("branches"), (2 * F.count_if(~is_leaf())).alias("edges"),
        F.countDistinct(F.when(~is_leaf(), F.struct(*PREDICATE))).alias("predicates"), F.countDistinct(F.when(~is_leaf(), F.col("feature"))).alias("features_used"),
    )
    return own.crossJoin(top)


def predicates(nodes: DataFrame) -> DataFrame:
    """The distinct tests of a graph, told apart by their bits, with their number in key order."""
    return nodes.where(~is_leaf()).select(*PREDICATE, "cut").distinct()


MAGIC = b"DGRAPH01"


def encode(nodes: DataFrame, root: int, features: int, classes: int) -> bytes:
    """A graph as bytes: a header and 20 bytes for each node in id order."""
    rows = bounded(nodes.orderBy("node"), MOST_NODES, "graph")
    head = struct.pack("<8siiii", MAGIC, features, classes, root, len(rows))
    body = [struct.pack("<iiiii", r["feature"], r["class"] if r["feature"] == -1 else r["cut_bits"], int(bool(r["default_left"])), r["left"], r["right"]) for r in rows]
    return head + b"".join(body)


def decode(spark: SparkSession, data: bytes) -> tuple[DataFrame, int, int, int]:
    """(nodes, root, features, classes) of an encoded graph; wrong extents and words are refused."""
    size = struct.calcsize("<8siiii")
    if len(data) < size:
        raise ValueError("truncated header")
    magic, features, classes, root, count = struct.unpack_from("<8siiii", data)
    if magic != MAGIC or count < 1 or len(data) != size + 20 * count or not 0 <= root < count:
        raise ValueError("not an encoded graph")
    rows = []
    for i in range(count):
        feature, word, side, left, right = struct.unpack_from("<iiiii", data, size + 20 * i)
        if side not in (0, 1):
            raise ValueError("invalid default side")
        rows.append((i, -1, None, None, None, left, right, word) if feature == -1 else (i, feature, value_of(word), word, bool(side), left, right, None))
    nodes = spark.createDataFrame(rows, NODES)
    require_valid(nodes, features, classes)
    return nodes, root, features, classes


def dictionary(nodes: DataFrame) -> DataFrame:
    """(predicate, feature, cut_bits, default_left, cut): distinct tests with dense numbers in key order."""
    order = Window.orderBy("feature", "default_left", "cut_bits")
    return predicates(nodes).withColumn("predicate", F.row_number().over(order) - 1)


def compact(nodes: DataFrame, classes: int) -> tuple[DataFrame, DataFrame, int]:
    """(words, dictionary, width): each node as one long, its test's number and both children.

    A leaf holds the dictionary's size plus its class.  ``width`` is the bits of a child.
    """
    table = cut(dictionary(nodes), "dictionary")
    facts = nodes.agg(F.max("node").alias("top")).first()
    width, tests = max(1, (facts["top"] or 0).bit_length()), table.count()
    if 2 * width + (tests + classes).bit_length() > 63:
        raise ValueError("the graph is too large for one word a node")
    named = nodes.alias("n").join(table.alias("d"), [F.col(f"n.{c}") == F.col(f"d.{c}") for c in PREDICATE], "left")
    number = F.when(F.col("n.feature") == -1, F.col("n.class") + tests).otherwise(F.col("d.predicate")).cast("long")
    child = lambda side: F.greatest(F.col(f"n.{side}"), F.lit(0)).cast("long")
    word = F.shiftleft(number, 2 * width).bitwiseOR(F.shiftleft(child("right"), width)).bitwiseOR(child("left"))
    return named.select(F.col("n.node").alias("node"), word.alias("word")), table, width


def expand_compact(words: DataFrame, table: DataFrame, width: int) -> DataFrame:
    """The nodes that ``compact`` packed."""
    tests = table.count()
    low = F.lit((1 << width) - 1)
    parts = words.select("node", F.shiftright("word", 2 * width).cast("int").alias("number"), F.shiftright("word", width).bitwiseAND(low).cast("int").alias("r"), F.col("word").bitwiseAND(low).cast("int").alias("l"))
    full = parts.join(table, F.col("number") == F.col("predicate"), "left")
    branch = F.col("number") < tests
    return full.select("node", F.when(branch, F.col("feature")).otherwise(-1).alias("feature"), "cut", "cut_bits", "default_left", F.when(branch, F.col("l")).otherwise(-1).alias("left"), F.when(branch, F.col("r")).otherwise(-1).alias("right"), F.when(~branch, F.col("number") - tests).alias("class"))


def unfold(nodes: DataFrame, root: int, most: int = 1 << 16) -> DataFrame:
    """The graph as a tree with one parent for each node: (path, node, ...) with path '' at the root.

    Paths are strings of L and R.  A tree of more than ``most`` nodes is refused beforehand.
    """
    size = heights(nodes).where(F.col("node") == root).first()
    if size is None or size["unfolded"] > most:
        raise ValueError(f"the tree has more than {most} nodes")
    side = nodes.select(F.col("node").alias("at"), *COLUMNS[1:])
    level = nodes.where(F.col("node") == root).select(F.lit("").alias("path"), *COLUMNS)
    out = level
    for _ in range(size["height"]):
        down = level.where(~is_leaf()).select(F.explode(F.array(F.struct(F.concat("path", F.lit("L")).alias("p"), F.col("left").alias("c")), F.struct(F.concat("path", F.lit("R")).alias("p"), F.col("right").alias("c")))).alias("x"))
        level = cut(down.select(F.col("x.p").alias("path"), F.col("x.c").alias("at")).join(side, "at").select("path", F.col("at").alias("node"), *COLUMNS[1:]), "level")
        out = out.unionByName(level)
    return out


def import_tree(tree: DataFrame, most: int = 1 << 16) -> tuple[DataFrame, int]:
    """(nodes, root) of a physical tree (node, ..., any ids): children before parents, ids dense.

    Every node but the root must have exactly one parent.
    """
    parents = edges(tree).groupBy(F.col("child").alias("node")).agg(F.count("*").alias("n"))
    joined = tree.select("node").join(parents, "node", "left")
    counts = joined.agg(F.count_if(F.col("n").isNull()).alias("roots"), F.count_if(F.col("n") > 1).alias("shared"), F.count("*").alias("all")).first()
    if counts["roots"] != 1 or counts["shared"] or counts["all"] > most:
        raise ValueError("not one tree with single parents")
    level = heights(tree)
    if level.count() != counts["all"]:
        raise ValueError("not one tree with single parents")
    order = Window.orderBy("height", "node")
    new = cut(level.select(F.col("node").alias("old"), (F.row_number().over(order) - 1).alias("new")), "new")
    out = tree.join(new, F.col("node") == F.col("old")).select(F.col("new").alias("node"), *COLUMNS[1:])
    for side in ("left", "right"):
        out = out.join(new, F.col(side) == F.col("old"), "left").select(*(F.coalesce("new", F.lit(-1)).alias(c) if c == side else F.col(c) for c in COLUMNS))
    return cut(out, "imported"), counts["all"] - 1


def same_graph(a: DataFrame, b: DataFrame) -> bool:
    """Whether two node tables have the same rows, thresholds told apart by their bits."""
    keep = [c for c in COLUMNS if c != "cut"]
    return a.select(*keep).exceptAll(b.select(*keep)).isEmpty() and b.select(*keep).exceptAll(a.select(*keep)).isEmpty()


def equations(nodes: DataFrame) -> DataFrame:
    """(node, equation): each node as a function of the input, thresholds in round-trip decimals."""
    texts = nodes.where(~is_leaf()).select("cut_bits").distinct()
    spark = nodes.sparkSession
    named = spark.createDataFrame([(r["cut_bits"], decimal_text(value_of(r["cut_bits"]))) for r in bounded(texts, MOST_NODES, "cuts")], "cut_bits int, threshold string")
    x = F.format_string("x[%d]", "feature")
    test = F.concat(F.lit("(isnan("), x, F.lit(") ? "), F.col("default_left").cast("string"), F.lit(" : "), x, F.lit(" < "), F.col("threshold"), F.lit(")"))
    body = F.when(is_leaf(), F.col("class").cast("string")).otherwise(F.concat(F.lit("if "), test, F.format_string(" then D%d(x) else D%d(x)", "left", "right")))
    return nodes.join(named, "cut_bits", "left").select("node", F.concat(F.format_string("D%d(x) = ", "node"), body).alias("equation"))


def sql_case(nodes: DataFrame, root: int, names: list[str], most: int = 512) -> str:
    """The graph as one SQL expression over named columns; refused if it unfolds beyond ``most`` nodes."""
    rows = {r["node"]: r for r in bounded(nodes, MOST_NODES, "graph")}
    left = [most]

    def text(node: int) -> str:
        left[0] -= 1
        if left[0] < 0:
            raise ValueError(f"the expression has more than {most} nodes")
        r = rows[node]
        if r["feature"] == -1:
            return str(r["class"])
        name, bound = names[r["feature"]], f"CAST({decimal_text(r['cut'])} AS FLOAT)"
        test = f"(isnan({name}) OR {name} < {bound})" if r["default_left"] else f"(NOT isnan({name}) AND {name} < {bound})"
        return f"CASE WHEN {test} THEN {text(r['left'])} ELSE {text(r['right'])} END"

    return text(root)


def pack_graphs(graphs: list[tuple[DataFrame, int]]) -> tuple[DataFrame, list[int]]:
    """One table of several graphs, the ids of each moved behind those before, and their roots in it."""
    out, roots, offset = None, [], 0
    for nodes, root in graphs:
        moved = [F.when(is_leaf(), F.lit(-1)).otherwise(F.col(c) + offset).cast("int").alias(c) for c in ("left", "right")]
        own = nodes.select((F.col("node") + offset).cast("int").alias("node"), "feature", "cut", "cut_bits", "default_left", *moved, "class")
        out = own if out is None else out.unionByName(own)
        roots.append(root + offset)
        offset += nodes.agg(F.max("node")).first()[0] + 1
    if out is None:
        raise ValueError("there are no graphs to pack")
    return out, roots


def take_arc(rows: DataFrame, arcs: DataFrame, id_col: str) -> DataFrame:
    """``rows`` (node, rank) with the ``child`` of the one arc (node, low, high, child) of their node that holds their rank.

    Each row looks through the list of its node's arcs, so rows are neither dealt anew nor gathered.  A row that no
    arc or several arcs hold is an error when it is read.
    """
    lists = arcs.groupBy(F.col("node").alias("_node")).agg(F.collect_list(F.struct("low", "high", "child")).alias("_arcs"))
    lists = F.broadcast(lists) if arcs.count() <= MOST_ARCS else lists
    holds = lambda x: F.col("rank").between(x["low"], x["high"]) & x["child"].isNotNull()
    held = rows.join(lists, F.col("node") == F.col("_node"), "left").withColumn("_held", F.filter("_arcs", holds))
    n = F.greatest(F.coalesce(F.size("_held"), F.lit(0)), F.lit(0))  # a node without arcs has no list
    wrong = F.raise_error(F.concat(F.lit("arcs that hold row "), F.col(id_col).cast("string"), F.lit(": "), n.cast("string")))
    return held.select(*rows.columns, F.when(n == 1, F.get(F.col("_held.child"), F.lit(0))).otherwise(wrong.cast("int")).alias("child"))


def exact_lookup(rows: DataFrame, costs: DataFrame, key: str, cost: str) -> DataFrame:
    """``rows`` with the cost of their key, which must be known exactly once (else an error when it is read)."""
    known = costs.groupBy(key).agg(F.count("*").alias("_n"), F.first(cost).alias(cost))
    wrong = F.raise_error(F.concat(F.lit("costs of key "), F.coalesce(F.col(key).cast("string"), F.lit("null")), F.lit(": "), F.coalesce("_n", F.lit(0)).cast("string")))
    kind = costs.schema[cost].dataType
    return rows.join(known, key, "left").select(*rows.columns, F.when(F.col("_n") == 1, F.col(cost)).otherwise(wrong.cast(kind)).alias(cost))
