"""Models drawn from the rows of a table, for the queries about models, and the same in SQL.

``drawn_forest`` makes one tree of depth two for each value of a key: its cuts are values of rows of that key,
its leaves hold the share of the tree's own class among the rows that reach them.  ``heap_graph`` makes each row a
node, row i above rows 2i + 1 and 2i + 2, so that the graph grows with the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import fp32
from .functions.models import NODES, TREES

AXES = 3


def drawn_forest(rows: DataFrame, key: Column, classes: int) -> DataFrame:
    """TREES rows: ``rows`` has row_id, x0 (NaN for missing), v0 (never missing), x1, x2, label; ``key`` numbers the trees from 0.

    Tree t tests feature t mod 3 at its root, the next one to the left and the one after to the right; even trees
    send missing values to the left.  The cut of a feature comes from the row with the least scattered number.
    """
    t, i = F.col("tree"), F.col("row_id")
    own = rows.withColumn("tree", key.cast("int"))
    place = lambda f: (i * (7919 + 2 * f)) % 10007 * 1_000_000_000_000 + i
    cuts = own.groupBy("tree").agg(*(F.min_by(x, place(f)).alias(f"c{f}") for f, x in enumerate(("v0", "x1", "x2"))))
    cut_at = F.array(*(f"c{f}" for f in range(AXES)))
    met = own.join(cuts, "tree")
    left = t % 2 == 0
    x = F.array("x0", "x1", "x2")

    def goes_left(step: int) -> Column:
        f = (t + step) % AXES
        return F.when(F.isnan(F.get(x, f)), left).otherwise(F.get(x, f) < F.get(cut_at, f))

    end = F.when(goes_left(0), F.when(goes_left(1), 0).otherwise(1)).otherwise(F.when(goes_left(2), 2).otherwise(3))
    hit = (F.col("label") == t % classes).cast("int")
    counts = met.withColumn("end", end).groupBy("tree").agg(
        *(F.count_if(F.col("end") == e).alias(f"n{e}") for e in range(4)), *(F.sum(F.when(F.col("end") == e, hit).otherwise(0)).alias(f"p{e}") for e in range(4))
    )
    full = counts.join(cuts, "tree")
    none = F.lit(None)

    def branch(node: int, step: int, a: int) -> Column:
        f = (t + step) % AXES
        c = F.get(cut_at, f)
        return F.struct(F.lit(node).alias("node"), f.cast("int").alias("feature"), c.alias("cut"), fp32.bits(c).cast("int").alias("cut_bits"), left.alias("default_left"), F.lit(a).alias("left"), F.lit(a + 1).alias("right"), none.cast("float").alias("value"))

    def leaf(node: int, e: int) -> Column:
        share = (F.floor(F.col(f"p{e}") * 1000 / F.greatest(F.col(f"n{e}"), F.lit(1))) / 1000).cast("float")
        return F.struct(F.lit(node).alias("node"), F.lit(-1).alias("feature"), none.cast("float").alias("cut"), none.cast("int").alias("cut_bits"), none.cast("boolean").alias("default_left"), F.lit(-1).alias("left"), F.lit(-1).alias("right"), share.alias("value"))

    nodes = F.explode(F.array(branch(0, 0, 1), branch(1, 1, 3), branch(2, 2, 5), *(leaf(3 + e, e) for e in range(4)))).alias("x")
    return full.select("tree", (t % classes).cast("int").alias("channel"), nodes).select("tree", "channel", "x.*").select(*(c.split()[0] for c in TREES.split(", ")))


def forest_sql(source: str, key: str, classes: int) -> str:
    """``drawn_forest`` as common tables: ``drawn`` (tree, c, dl, v), a row a tree with its cuts and leaves in lists."""
    pick = ", ".join(f"arg_min({x}, (row_id * {7919 + 2 * f}) % 10007 * 1000000000000 + row_id)" for f, x in enumerate(("v0", "x1", "x2")))
    return f"""rows_of AS (SELECT *, CAST({key} AS INTEGER) AS tree FROM {source}),
cut_of AS (SELECT tree, [{pick}] AS c, tree % 2 = 0 AS dl FROM rows_of GROUP BY tree),
ends AS (SELECT tree, c, dl, label = tree % {classes} AS hit, {leaf_sql("r.", "")} AS e FROM rows_of r JOIN cut_of USING (tree)),
drawn AS (SELECT tree, c, dl, [{', '.join(f"CAST(floor(count(*) FILTER (e = {e} AND hit) * 1000 / greatest(count(*) FILTER (e = {e}), 1)) / 1000 AS FLOAT)" for e in range(4))}] AS v FROM ends GROUP BY tree, c, dl)"""


def leaf_sql(row: str, tree: str) -> str:
    """The leaf, from 0, that a row's x0, x1, x2 reach in a row of ``drawn``."""
    x = f"[{row}x0, {row}x1, {row}x2]"

    def goes_left(step: int) -> str:
        at = f"({tree}tree + {step}) % 3 + 1"
        return f"CASE WHEN isnan({x}[{at}]) THEN {tree}dl ELSE {x}[{at}] < {tree}c[{at}] END"

    return f"CASE WHEN {goes_left(0)} THEN CASE WHEN {goes_left(1)} THEN 0 ELSE 1 END ELSE CASE WHEN {goes_left(2)} THEN 2 ELSE 3 END END"


def cells_sql(classes: int) -> str:
    """``cells``: a point of every cell of the grid of ``drawn``'s cuts, missing values included, with its class."""
    axes = ", ".join(f"b{f} AS (SELECT DISTINCT c[{f + 1}] AS x{f} FROM drawn UNION ALL SELECT min(c[{f + 1}]) - 1 FROM drawn UNION ALL SELECT CAST('nan' AS FLOAT))" for f in range(AXES))
    sums = ", ".join(f"list_reduce([CAST(0 AS FLOAT)] || coalesce(list(value ORDER BY tree) FILTER (tree % {classes} = {k}), []), lambda a, b: a + b) AS m{k}" for k in range(classes))
    winner = " ".join(f"WHEN {' AND '.join(f'm{k} >= m{o}' for o in range(classes) if o != k)} THEN {k}" for k in range(classes))
    return f"""{axes}, points AS (SELECT x0, x1, x2, row_number() OVER () AS cell FROM b0 CROSS JOIN b1 CROSS JOIN b2),
reached AS (SELECT cell, x0, x1, x2, d.tree, v[{leaf_sql("p.", "d.")} + 1] AS value FROM points p CROSS JOIN drawn d),
summed AS (SELECT cell, any_value(x0) AS x0, any_value(x1) AS x1, any_value(x2) AS x2, {sums} FROM reached GROUP BY cell),
cells AS (SELECT *, CASE {winner} END AS class FROM summed)"""


def heap_graph(rows: DataFrame, total: int, classes: int) -> tuple[DataFrame, int]:
    """(NODES rows, root): row i of ``rows`` (row_id from 0, v0, label) is node total - 1 - i, and a leaf unless both rows below it exist."""
    i = F.col("row_id")
    inner = 2 * i + 2 < total
    only = lambda c: F.when(inner, c)
    out = rows.select(
        (total - 1 - i).cast("int").alias("node"), F.when(inner, i % AXES).otherwise(-1).cast("int").alias("feature"), only(F.col("v0")).cast("float").alias("cut"), only(fp32.bits(F.col("v0"))).cast("int").alias("cut_bits"), only(i % 2 == 0).alias("default_left"),
        F.when(inner, total - 2 - 2 * i).otherwise(-1).cast("int").alias("left"), F.when(inner, total - 3 - 2 * i).otherwise(-1).cast("int").alias("right"), F.when(~inner, F.col("label")).cast("int").alias("class"),
    )
    return out.select(*(c.split()[0] for c in NODES.split(", "))), total - 1


HEAP_SQL = """n AS (SELECT count(*) AS total FROM y), heap AS (SELECT row_id AS i, total, 2 * row_id + 2 < total AS inside, v0, label, total - 1 - row_id AS node FROM y CROSS JOIN n)"""
