"""Registered queries of the engine, each with SQL that states the same result another way.

Graphs are scored in Spark as compiled; the SQL adds up the trees of the source ensemble.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .drawn import HEAP_SQL, cells_sql, drawn_forest, forest_sql, heap_graph
from .functions import directed, fp32
from .functions.models import branch, demo_graph, leaf, nodes_table, rule_forest, trees_table
from .operators import bundles, compiler, diagrams, evaluation, graph, grid, ordered, policy, regions, scoring, study, training
from .plans import storage
from .sources.tables import apply_labels, first_seen_labels
from .streaming.scoring import class_counts, latest_counts, score_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

K = 3
CUTS = [[10.0, 40.0, 90.5], [30.0, 75.0, 120.0], [25.0, 50.0, 75.0]]
FOREST = rule_forest(2, K, CUTS, depth=2, seed=11)
SECOND = rule_forest(2, K, CUTS, depth=2, seed=12)
NAMES = ["x0", "x1", "x2"]
BIAS = [0.0] * K


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# ---- inputs ----------------------------------------------------------------------------------


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with an ordinal, three float features (one missing at times), a label and a role."""
    t = spark.read.parquet(f"{sf_dir}/events.parquet")
    i = F.col("event_id")
    x0 = F.when(i % 7 == 0, F.lit(fp32.NAN)).otherwise(F.col("value")).cast("float")
    label = F.when(F.col("event_type").isin("click", "signup"), 0).when(F.col("event_type").isin("error", "view"), 1).otherwise(2)
    return t.select(i.alias("row_id"), x0.alias("x0"), F.col("user_id").cast("float").alias("x1"), (i % 100).cast("float").alias("x2"), label.alias("label"), F.when(i % 5 < 4, "FIT").otherwise("VALID").alias("role"))


EVENTS = """x AS (SELECT event_id AS row_id, CASE WHEN event_id % 7 = 0 THEN CAST('nan' AS FLOAT) ELSE CAST(value AS FLOAT) END AS x0,
  CAST(user_id AS FLOAT) AS x1, CAST(event_id % 100 AS FLOAT) AS x2,
  CASE WHEN event_type IN ('click', 'signup') THEN 0 WHEN event_type IN ('error', 'view') THEN 1 ELSE 2 END AS label,
  CASE WHEN event_id % 5 < 4 THEN 'FIT' ELSE 'VALID' END AS role FROM events)"""


BAGS = 9  #: trees of the drawn forest that is compiled
VALUED = f"{EVENTS}, y AS (SELECT x.*, CAST(e.value AS FLOAT) AS v0 FROM x JOIN events e ON e.event_id = x.row_id)"
DRAWN = f"WITH {VALUED}, {forest_sql('y', f'row_id % {BAGS}', K)}"
BY_USER = f"WITH {VALUED}, {forest_sql('y', 'x1', K)}"
DRAWN_CELLS = f"{DRAWN}, {cells_sql(K)}"
AXES_SQL = "axes AS (SELECT f - 1 AS feature, list_sort(list_distinct(list(c[f]))) AS cuts FROM drawn CROSS JOIN range(1, 4) r(f) GROUP BY f)"


def valued(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` with v0, the value of x0 where it is missing too."""
    t = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events(spark, sf_dir).join(t.select(F.col("event_id").alias("row_id"), F.col("value").cast("float").alias("v0")), "row_id")


def drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forest drawn from all events, dealt to ``BAGS`` trees."""
    return storage.cut(drawn_forest(valued(spark, sf_dir), F.col("row_id") % BAGS, K), "drawn")


def user_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree for every user, drawn from the user's events."""
    return storage.cut(drawn_forest(valued(spark, sf_dir), F.col("x1"), K), "drawn")


def tree_sql(rows: list[tuple], tree: int, names: list[str]) -> str:
    own = {r[2]: r for r in rows if r[0] == tree}

    def text(node: int) -> str:
        _, _, _, feature, cut, _, default_left, left, right, value = own[node]
        if feature < 0:
            return f"CAST({fp32.decimal_text(value)} AS FLOAT)"
        x = names[feature]
        return f"CASE WHEN CASE WHEN isnan({x}) THEN {str(default_left).lower()} ELSE {x} < CAST({fp32.decimal_text(cut)} AS FLOAT) END THEN {text(left)} ELSE {text(right)} END"

    return text(0)


def margin_sql(rows: list[tuple], channel: int, names: list[str]) -> str:
    trees = sorted({r[0] for r in rows if r[1] == channel})
    return f"list_reduce([CAST(0 AS FLOAT), {', '.join(tree_sql(rows, t, names) for t in trees)}], lambda a, b: a + b)"


def winner_sql(margins: list[str]) -> str:
    tests = [f"WHEN {' AND '.join(f'{m} >= {o}' for o in margins if o != m)} THEN {k}" for k, m in enumerate(margins)]
    return f"CASE {' '.join(tests)} END"


def scored_sql(rows: list[tuple] = FOREST, name: str = "class", source: str = "x") -> str:
    classes = max(r[1] for r in rows) + 1
    columns = ", ".join(f"{margin_sql(rows, k, NAMES)} AS m{k}" for k in range(classes))
    return f"(SELECT *, {winner_sql([f'm{k}' for k in range(classes)])} AS {name} FROM (SELECT *, {columns} FROM {source}))"


SCORED = f"WITH {EVENTS}, s AS {scored_sql()}"


def forest(spark: SparkSession, rows: list[tuple] = FOREST) -> DataFrame:
    return trees_table(spark, rows)


def compiled(spark: SparkSession) -> tuple[DataFrame, int]:
    return compiler.compile_graph(forest(spark), BIAS, len(NAMES))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.classify(events(spark, sf_dir), forest(spark), NAMES, BIAS)


# ---- scoring ---------------------------------------------------------------------------------


@query(f"{SCORED} SELECT row_id, class FROM s")
def dag_predict_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, root = compiled(spark)
    return scoring.predict(events(spark, sf_dir), nodes, root, NAMES, how="case").select("row_id", "class")


@query(f"{SCORED} SELECT row_id, class FROM s")
def dag_predict_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, root = compiled(spark)
    return scoring.predict(events(spark, sf_dir), nodes, root, NAMES, how="arrays").select("row_id", "class")


@query(f"{SCORED} SELECT row_id, class FROM s")
def dag_predict_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, root = compiled(spark)
    return scoring.predict(events(spark, sf_dir), nodes, root, NAMES, how="join").select("row_id", "class")


@query(f"{SCORED} SELECT row_id, CAST(m0 AS DOUBLE) AS m0, CAST(m1 AS DOUBLE) AS m1, CAST(m2 AS DOUBLE) AS m2 FROM s")
def ensemble_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scoring.margins(events(spark, sf_dir), forest(spark), NAMES, BIAS)
    return out.select("row_id", *(F.get("margins", F.lit(k)).cast("double").alias(f"m{k}") for k in range(K)))


@query(f"{SCORED} SELECT row_id, CAST(m0 AS DOUBLE) AS m0, CAST(m1 AS DOUBLE) AS m1, CAST(m2 AS DOUBLE) AS m2 FROM s")
def ensemble_margins_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scoring.margins(events(spark, sf_dir), forest(spark), NAMES, BIAS, how="arrays")
    return out.select("row_id", *(F.get("margins", F.lit(k)).cast("double").alias(f"m{k}") for k in range(K)))


PREFIX = [r for r in FOREST if r[0] < K]


@query(f"WITH {EVENTS}, s AS {scored_sql(PREFIX)} SELECT row_id, class FROM s")
def round_prefix_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    trees = training.prefix(forest(spark), 1, K)
    return scoring.classify(events(spark, sf_dir), trees, NAMES, BIAS).select("row_id", "class")


@query("SELECT event_id AS row_id, CASE WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END AS class FROM (SELECT event_id, event_id % 3 AS a, event_id % 4 AS b, event_id % 5 AS c FROM events)")
def first_argmax_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    scores = F.array(*((i % m).cast("float") for m in (3, 4, 5)))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(i.alias("row_id"), fp32.first_winner(scores).alias("class"))


DEMO = f"WITH {EVENTS}, d AS (SELECT row_id, x2 < 0.5 AS a, (NOT isnan(x0)) AND x0 < 20 AS b FROM (SELECT row_id, x0, x2 / 100 AS x2 FROM x))"


def demo_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, int]:
    nodes, root = demo_graph()
    nodes = [*nodes[:3], branch(3, 0, 20.0, False, 1, 0), nodes[4]]
    rows = events(spark, sf_dir).withColumn("x2", (F.col("x2") / 100).cast("float"))
    return rows, nodes_table(spark, nodes), root


@query(DEMO + """, p AS (SELECT row_id, CASE WHEN NOT a THEN [4, 2] WHEN b THEN [4, 3, 1] ELSE [4, 3, 0] END AS path FROM d)
SELECT row_id, CAST(step - 1 AS INTEGER) AS step, CAST(path[step] AS INTEGER) AS node,
  CASE WHEN step = len(path) THEN NULL WHEN path[step + 1] = CASE path[step] WHEN 4 THEN 3 ELSE 1 END THEN 'left' ELSE 'right' END AS followed,
  CAST(CASE WHEN path[step] < 3 THEN path[step] ELSE -1 END AS INTEGER) AS class
FROM (SELECT row_id, path, unnest(range(1, len(path) + 1)) AS step FROM p)""")
def explain_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, nodes, root = demo_rows(spark, sf_dir)
    steps = scoring.path_steps(scoring.paths(rows, nodes, root, NAMES), nodes, "row_id")
    return steps.withColumn("class", F.coalesce("class", F.lit(-1)))


@query(f"{SCORED} SELECT CAST(count(*) AS BIGINT) AS mismatches FROM s WHERE class IS NULL")
def compiled_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, root = compiled(spark)
    rows = events(spark, sf_dir)
    found = evaluation.mismatches(scoring.classify(rows, forest(spark), NAMES, BIAS), scoring.predict(rows, nodes, root, NAMES), "row_id")
    return found.agg(F.count("*").alias("mismatches"))


LINE = [[5.0, 20.0, 35.0], [5000.0, 30000.0, 60000.0], [0.02, 0.05, 0.08]]
LINE_FOREST = rule_forest(3, K, LINE, depth=3, seed=21)
LINE_SQL = "l AS (SELECT CAST(l_quantity AS FLOAT) AS x0, CAST(l_extendedprice AS FLOAT) AS x1, CAST(l_discount AS FLOAT) AS x2, l_returnflag FROM lineitem)"


@query(f"WITH {LINE_SQL} SELECT l_returnflag, class, CAST(count(*) AS BIGINT) AS n FROM {scored_sql(LINE_FOREST, source='l')} GROUP BY l_returnflag, class")
def lineitem_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    rows = t.select("l_returnflag", *(F.col(c).cast("float").alias(n) for c, n in zip(("l_quantity", "l_extendedprice", "l_discount"), NAMES, strict=True)))
    return scoring.classify(rows, forest(spark, LINE_FOREST), NAMES, BIAS).groupBy("l_returnflag", "class").agg(F.count("*").alias("n"))


WIDE = [f"e{i}" for i in range(64)]
WIDE_FOREST = rule_forest(2, 10, [[-0.1, 0.0, 0.1]] * 64, depth=3, seed=31)
WIDE_SQL = ", ".join(f"embedding[{i + 1}] AS e{i}" for i in range(64))


@query(f"WITH v AS (SELECT vec_id, {WIDE_SQL} FROM embeddings), m AS (SELECT vec_id, {', '.join(f'{margin_sql(WIDE_FOREST, k, WIDE)} AS m{k}' for k in range(10))} FROM v) SELECT vec_id, {winner_sql([f'm{k}' for k in range(10)])} AS class FROM m")
def embedding_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = t.select("vec_id", *(F.get("embedding", F.lit(i)).alias(n) for i, n in enumerate(WIDE)))
    return scoring.classify(rows, forest(spark, WIDE_FOREST), WIDE, [0.0] * 10, how="arrays").select("vec_id", "class")


@query(f"WITH t AS (SELECT ts, CAST(value AS FLOAT) AS x0, CAST(user_id AS FLOAT) AS x1, CAST(event_id % 100 AS FLOAT) AS x2 FROM events) SELECT strftime(CAST(ts AS TIMESTAMP), '%Y-%m-%d') AS day, class, CAST(count(*) AS BIGINT) AS rows FROM {scored_sql(source='t')} GROUP BY 1, 2")
def stream_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by day from a stream: files as they come, a compiled graph, event-time windows.

    Each batch replaces the counts in the shared folder.
    """
    nodes, root = compiled(spark)
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    source = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    rows = source.select(F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("float").alias("x0"), F.col("user_id").cast("float").alias("x1"), (F.col("event_id") % 100).cast("float").alias("x2"))
    counts = class_counts(score_stream(rows, nodes, root, NAMES), "ts", "1 day", "1 day")
    path = latest_counts(counts)
    return spark.read.schema(counts.schema).parquet(path).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "class", "rows")


# ---- evaluation and folds --------------------------------------------------------------------


@query(f"{SCORED} SELECT role, CAST(count(*) AS BIGINT) AS rows, CAST(count(*) FILTER (class <> label) AS BIGINT) AS errors, count(*) FILTER (class = label) / count(*) AS accuracy FROM s GROUP BY role")
def accuracy_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.accuracy_by_role(scored(spark, sf_dir))


@query(f"{SCORED} SELECT CAST(l.k AS INTEGER) AS label, CAST(p.k AS INTEGER) AS predicted, CAST(count(s.row_id) AS BIGINT) AS rows FROM range(3) l(k) CROSS JOIN range(3) p(k) LEFT JOIN s ON s.label = l.k AND s.class = p.k GROUP BY l.k, p.k")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.confusion(scored(spark, sf_dir), K)


TWO = f"WITH {EVENTS}, a AS {scored_sql(name='candidate')}, s AS (SELECT a.row_id, a.label, a.candidate, b.baseline FROM a JOIN (SELECT row_id, baseline FROM {scored_sql(SECOND, 'baseline')}) b USING (row_id))"


def two_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = scoring.classify(events(spark, sf_dir), forest(spark), NAMES, BIAS, name="candidate")
    return scoring.classify(first, forest(spark, SECOND), NAMES, BIAS, name="baseline")


@query(f"{TWO} SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(*) FILTER (candidate <> label) AS BIGINT) AS candidate_errors, CAST(count(*) FILTER (baseline <> label) AS BIGINT) AS baseline_errors, count(*) FILTER (candidate <> label) < count(*) FILTER (baseline <> label) AS accepted FROM s")
def holdout_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.gate(two_scored(spark, sf_dir), "candidate", "baseline")


@query(f"""{TWO}, b AS (SELECT *, ntile(7) OVER (ORDER BY row_id) - 1 AS level FROM s),
g AS (SELECT level, count(*) AS n, count(*) FILTER (candidate <> label) AS c, count(*) FILTER (baseline <> label) AS e FROM b GROUP BY level)
SELECT CAST(g.level AS INTEGER) AS level, CAST(coalesce((SELECT sum(n) FROM g h WHERE h.level < g.level), 0) AS BIGINT) AS "offset", CAST(n AS BIGINT) AS rows, CAST(c AS BIGINT) AS candidate_errors, CAST(e AS BIGINT) AS baseline_errors, c < e AS accepted
FROM g WHERE NOT EXISTS (SELECT 1 FROM g h WHERE h.level < g.level AND NOT h.c < h.e)""")
def gates_by_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = two_scored(spark, sf_dir)
    return evaluation.gates_by_block(rows, evaluation.block_of(F.col("row_id"), rows.count(), 7), "candidate", "baseline")


@query("SELECT o_orderkey AS row_id, CAST((o_orderkey % 5 + 13 % 5) % 5 AS INTEGER) AS fold FROM orders")
def fold_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("row_id"), evaluation.fold_of(F.col("o_orderkey"), 5, 13).alias("fold"))


@query("SELECT fold, CAST(count(*) AS BIGINT) AS held, CAST((SELECT count(*) FROM orders) - count(*) AS BIGINT) AS fitted, CAST(0 AS BIGINT) AS shared FROM (SELECT (o_orderkey + 3) % 5 AS fold FROM orders) GROUP BY fold")
def fold_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held and fitted rows of each fold, and rows that are in both (there must be none)."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", evaluation.fold_of(F.col("o_orderkey"), 5, 13).alias("own"))
    flags = rows.select("own", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("fold"))
    held, fitted = F.col("own") == F.col("fold"), F.col("own") != F.col("fold")
    return flags.groupBy(F.col("fold").cast("long").alias("fold")).agg(F.count_if(held).alias("held"), F.count_if(fitted).alias("fitted"), F.count_if(held & fitted).alias("shared"))


@query("SELECT o_orderkey AS row_id, CAST(ntile(7) OVER (ORDER BY o_orderkey) - 1 AS INTEGER) AS block FROM orders")
def holdout_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return rows.select(F.col("o_orderkey").alias("row_id"), evaluation.block_of(F.col("o_orderkey"), rows.count(), 7).alias("block"))


@query("SELECT o_orderkey AS row_id, CASE WHEN o_orderkey < 100 THEN 0 WHEN o_orderkey < 500 THEN 1 ELSE 2 END AS block FROM orders")
def stated_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    n = rows.count()
    return rows.select(F.col("o_orderkey").alias("row_id"), evaluation.stated_block_of(F.col("o_orderkey"), [100, 400, n - 500], n).alias("block"))


CANDIDATES = "SELECT CAST(o_orderkey AS INTEGER) AS ord, (o_orderkey * 7919) % 1009 AS errors, o_custkey % 50 AS bytes FROM orders"


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("o_orderkey")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(i.cast("int").alias("ord"), (i * 7919 % 1009).alias("errors"), (F.col("o_custkey") % 50).alias("bytes"))


@query(f"""WITH c AS ({CANDIDATES}), r AS (SELECT *, errors * 1000000000 + bytes * 10000000 + ord AS key FROM c), m AS (SELECT *, min(key) OVER (ORDER BY ord) AS best FROM r)
SELECT ord, errors, bytes, CAST(best % 10000000 AS INTEGER) AS best_ord, best = key AS became_incumbent FROM m""")
def incumbent_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.incumbents(candidates(spark, sf_dir))


@query(f"SELECT * FROM ({CANDIDATES}) ORDER BY errors, bytes, ord LIMIT 1")
def hpo_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.winner(candidates(spark, sf_dir))


@query("""WITH r AS (SELECT event_id AS row_id, t, k, CASE WHEN event_id % 11 = 0 THEN 0.9 ELSE (k + 1) / 6.0 END AS p FROM events CROSS JOIN range(2) a(t) CROSS JOIN range(3) b(k)
  WHERE NOT (event_id % 13 = 0 AND t = 1)
  UNION ALL SELECT event_id, 0, 2, 0.5 FROM events WHERE event_id % 17 = 0),
g AS (SELECT row_id, t, count(*) AS n, sum(p) AS s FROM r GROUP BY row_id, t)
SELECT e.event_id AS row_id, CAST(a.t AS INTEGER) AS teacher, CASE WHEN n IS NULL THEN 'missing' WHEN n <> 3 THEN 'repeated' ELSE 'not a distribution' END AS problem
FROM events e CROSS JOIN range(2) a(t) LEFT JOIN g ON g.row_id = e.event_id AND g.t = a.t WHERE n IS NULL OR n <> 3 OR abs(s - 1) > 0.001""")
def oof_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("row_id"))
    i = F.col("row_id")
    wide = rows.withColumn("teacher", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("class", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    p = F.when(i % 11 == 0, 0.9).otherwise((F.col("class") + 1) / 6.0)
    kept = wide.where(~((i % 13 == 0) & (F.col("teacher") == 1))).withColumn("p", p)
    again = rows.where(i % 17 == 0).select("row_id", F.lit(0).alias("teacher"), F.lit(2).alias("class"), F.lit(0.5).alias("p"))
    return evaluation.coverage_audit(kept.unionByName(again), rows, 2, 3)


@query("WITH p AS (SELECT o_orderkey AS step, o_custkey AS work, 1 + o_orderkey % 4 AS seconds FROM orders) SELECT step, round(sum(work) OVER w / sum(seconds) OVER w, 6) AS rate FROM p WINDOW w AS (ORDER BY step ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)")
def throughput_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("o_orderkey")
    progress = spark.read.parquet(f"{sf_dir}/orders.parquet").select(i.alias("step"), F.col("o_custkey").alias("work"), (1 + i % 4).alias("seconds"))
    return evaluation.throughput(progress).select("step", F.round("rate", 6).alias("rate"))


# ---- ingest ----------------------------------------------------------------------------------


@query("SELECT o_orderpriority AS label, CAST(row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS INTEGER) AS class FROM orders GROUP BY o_orderpriority")
def label_map_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_seen_labels(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderpriority", "o_orderkey")


@query("WITH m AS (SELECT o_orderpriority AS label, row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS class FROM orders GROUP BY o_orderpriority) SELECT o_orderkey, CAST(class AS INTEGER) AS label FROM orders JOIN m ON label = o_orderpriority")
def label_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return apply_labels(rows, "o_orderpriority", first_seen_labels(rows, "o_orderpriority", "o_orderkey")).select("o_orderkey", "label")


@query(r"""WITH t AS (SELECT event_id, CASE event_id % 8 WHEN 0 THEN ' ' WHEN 1 THEN 'NaN' WHEN 2 THEN '+' || value WHEN 3 THEN value || 'f' WHEN 4 THEN 'Infinity' WHEN 5 THEN '1e400' WHEN 6 THEN ' ' || value || 'e-1 ' ELSE 'na' END AS text FROM events),
u AS (SELECT event_id, lower(trim(text)) AS low, regexp_replace(trim(text), '^\+', '') AS plain FROM t)
SELECT event_id, CASE WHEN low IN ('', 'nan', 'na', 'null') THEN 'missing' WHEN NOT regexp_full_match(plain, '-?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?') OR abs(TRY_CAST(plain AS DOUBLE)) > 3.5e38 THEN 'refused' ELSE 'number' END AS kind,
  CASE WHEN low NOT IN ('', 'nan', 'na', 'null') AND regexp_full_match(plain, '-?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?') AND abs(TRY_CAST(plain AS DOUBLE)) < 3.5e38 THEN round(CAST(plain AS DOUBLE), 3) END AS value FROM u""")
def csv_feature_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, v = F.col("event_id"), F.col("value").cast("string")
    text = F.when(i % 8 == 0, " ").when(i % 8 == 1, "NaN").when(i % 8 == 2, F.concat(F.lit("+"), v)).when(i % 8 == 3, F.concat(v, F.lit("f"))).when(i % 8 == 4, "Infinity").when(i % 8 == 5, "1e400").when(i % 8 == 6, F.concat(F.lit(" "), v, F.lit("e-1 "))).otherwise("na")
    t = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", fp32.parse_feature(text).alias("x"))
    kind = F.when(F.col("x").isNull(), "refused").when(F.isnan("x"), "missing").otherwise("number")
    return t.select("event_id", kind.alias("kind"), F.when(kind == "number", F.round(F.col("x").cast("double"), 3)).alias("value"))


@query("SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(*) FILTER (event_id % 9 = 0) AS BIGINT) AS infinite, CAST(count(*) FILTER (event_id % 6 > 4) AS BIGINT) AS bad_labels, CAST(count(*) FILTER (event_id % 2 = 1) AS BIGINT) AS fractional FROM events")
def dataset_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of rows that ingest would refuse: infinite features, labels out of range, fractional labels."""
    i = F.col("event_id")
    t = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.when(i % 9 == 0, float("inf")).otherwise(F.col("value")).cast("float").alias("x"), (i % 6).alias("label"), (i / 2).cast("float").alias("raw"))
    whole = F.col("raw").cast("int").cast("float") == F.col("raw")
    return t.agg(F.count("*").alias("rows"), F.count_if(F.abs("x") == float("inf")).alias("infinite"), F.count_if((F.col("label") < 0) | (F.col("label") >= 5)).alias("bad_labels"), F.count_if(~whole).alias("fractional"))


GROUP = "SELECT event_id AS row_id FROM events WHERE (event_id % 2) + (event_id % 3 = 0)::INT + (event_id % 5 = 0)::INT = 1"


@query(GROUP)
def exactly_one_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows inside a domain whose three 0/1 features have exactly one 1."""
    i = F.col("event_id")
    flags = [(i % 2).cast("float"), F.when(i % 3 == 0, 1.0).otherwise(0.0).cast("float"), F.when(i % 5 == 0, 1.0).otherwise(0.0).cast("float")]
    inside = F.lit(True)
    for f in flags:
        inside = inside & f.isin(0.0, 1.0)
    return spark.read.parquet(f"{sf_dir}/events.parquet").where(inside & (flags[0] + flags[1] + flags[2] == 1)).select(i.alias("row_id"))


# ---- single precision ------------------------------------------------------------------------


@query("SELECT event_id, CAST(dense_rank() OVER (ORDER BY CAST(v AS FLOAT)) AS BIGINT) AS place, CAST(v AS DOUBLE) AS back FROM (SELECT event_id, CAST(CASE WHEN event_id % 2 = 0 THEN -value ELSE value END AS FLOAT) AS v FROM events)")
def float_order_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits of floats: their order keys sort as the floats do, and the bits give the floats back."""
    v = F.when(F.col("event_id") % 2 == 0, -F.col("value")).otherwise(F.col("value")).cast("float")
    words = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", fp32.bits(v).alias("word"))
    words = words.withColumn("key", fp32.order_key(F.col("word")))
    return words.join(ordered.dense_places(words, "key"), "key").select("event_id", "place", fp32.from_bits(F.col("word")).cast("double").alias("back"))


@query(f"WITH {EVENTS} SELECT row_id, CAST(CASE WHEN isnan(x0) THEN -1 ELSE (x0 >= 10)::INT + (x0 >= 40)::INT + (x0 >= 90.5)::INT END AS INTEGER) AS place FROM x")
def rank_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cuts = F.array(*(fp32.single(c) for c in CUTS[0]))
    return events(spark, sf_dir).select("row_id", fp32.rank_of(F.col("x0"), cuts).alias("place"))


@query(f"WITH {EVENTS} SELECT row_id, 0.5 * CAST(x1 AS DOUBLE) + -0.25 * CAST(x2 AS DOUBLE) + 2.0 * CAST(x1 AS DOUBLE) < 100 AS side FROM x")
def weighted_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.array(*(F.col(n) for n in NAMES))
    return events(spark, sf_dir).select("row_id", fp32.weighted_plane(x, [(0.5, 1), (-0.25, 2), (2.0, 1)], 100.0).alias("side"))


@query(f"{SCORED}, e AS (SELECT row_id, exp(CAST(m0 - greatest(m0, m1, m2) AS DOUBLE)) AS a, exp(CAST(m1 - greatest(m0, m1, m2) AS DOUBLE)) AS b, exp(CAST(m2 - greatest(m0, m1, m2) AS DOUBLE)) AS c FROM s) SELECT row_id, round(a / (a + b + c), 4) AS p0, round(b / (a + b + c), 4) AS p1, round(c / (a + b + c), 4) AS p2 FROM e")
def class_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scoring.margins(events(spark, sf_dir), forest(spark), NAMES, BIAS).withColumn("p", fp32.softmax(F.col("margins")))
    return out.select("row_id", *(F.round(F.get("p", F.lit(k)).cast("double"), 4).alias(f"p{k}") for k in range(K)))


@query("SELECT event_id, (CAST(nextafter(v, CAST('inf' AS FLOAT)) AS DOUBLE) - CAST(v AS DOUBLE)) / 2 AS radius FROM (SELECT event_id, abs(CAST(value AS FLOAT)) AS v FROM events)")
def half_ulp_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", fp32.half_ulp(F.col("value").cast("float")).alias("radius"))


@query("""WITH n AS (SELECT event_id, (event_id * 1000000007 + 7) * 1048576.0::DOUBLE AS a, floor(value * 1024) / 1024 AS b, (event_id * 1009 + 1)::DOUBLE AS c, (user_id + 3)::DOUBLE AS d FROM events),
r AS (SELECT *, a + b AS s, a - b AS t, c / d AS q, (a * 1024)::HUGEINT + (b * 1024)::HUGEINT AS sum, (a * 1024)::HUGEINT - (b * 1024)::HUGEINT AS difference FROM n),
e AS (SELECT *, (s * 1024)::HUGEINT - sum AS ds, (t * 1024)::HUGEINT - difference AS dt, (q * pow(2, 60))::HUGEINT * d::HUGEINT - (c * pow(2, 60))::HUGEINT AS dq FROM r)
SELECT event_id, CASE WHEN ds > 0 THEN nextafter(s, '-inf'::DOUBLE) ELSE s END AS add_down, CASE WHEN ds < 0 THEN nextafter(s, 'inf'::DOUBLE) ELSE s END AS add_up,
  CASE WHEN dt > 0 THEN nextafter(t, '-inf'::DOUBLE) ELSE t END AS sub_down, CASE WHEN dt < 0 THEN nextafter(t, 'inf'::DOUBLE) ELSE t END AS sub_up,
  CASE WHEN dq > 0 THEN nextafter(q, '-inf'::DOUBLE) ELSE q END AS div_down, CASE WHEN dq < 0 THEN nextafter(q, 'inf'::DOUBLE) ELSE q END AS div_up FROM e""")
def directed_rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums, differences and quotients rounded down and up; the SQL compares with 128-bit integers."""
    i = F.col("event_id")
    a, b = (i * 1000000007 + 7) * F.lit(1048576.0), F.floor(F.col("value") * 1024) / F.lit(1024.0)
    c, d = (i * 1009 + 1).cast("double"), (F.col("user_id") + 3).cast("double")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", a.alias("a"), b.alias("b"), c.alias("c"), d.alias("d"))
    sums = [getattr(directed, n)(F.col("a"), F.col("b")).alias(n) for n in ("add_down", "add_up", "sub_down", "sub_up")]
    return rows.select("event_id", *sums, directed.div_down(F.col("c"), F.col("d")).alias("div_down"), directed.div_up(F.col("c"), F.col("d")).alias("div_up"))


@query("SELECT o_orderkey, CAST(bit_count(o_orderkey) AS INTEGER) AS set_bits, CASE WHEN o_orderkey = 0 THEN -1 ELSE CAST(log2(o_orderkey & -o_orderkey) AS INTEGER) END AS lowest, CASE WHEN o_orderkey = 0 THEN -1 ELSE CAST(floor(log2(o_orderkey)) AS INTEGER) END AS highest FROM orders")
def bit_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("o_orderkey")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(x, F.bit_count(x).alias("set_bits"), fp32.lowest_bit(x).alias("lowest"), fp32.highest_bit(x).alias("highest"))


@query(f"WITH {EVENTS}, s AS (SELECT row_id, 1 / (1 + exp(-(75.0 - CAST(x1 AS DOUBLE)) / 12.5)) AS p FROM x) SELECT row_id, round(p, 6) AS share, round(-p * (1 - p) / 12.5, 6) AS slope FROM s")
def soft_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    share, slope = fp32.soft_gate(F.col("x1"), F.lit(75.0), F.lit(12.5))
    return events(spark, sf_dir).select("row_id", F.round(share, 6).alias("share"), F.round(slope, 6).alias("slope"))


@query("SELECT o_orderkey, c_acctbal AS cost FROM orders JOIN customer ON c_custkey = o_custkey")
def certified_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cost of each order's key, which must be known exactly once."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.col("o_custkey").alias("key"))
    costs = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("cost"))
    return graph.exact_lookup(orders, costs, "key", "cost").select("o_orderkey", "cost")


# ---- graphs and grids ------------------------------------------------------------------------


@query(f"{BY_USER}, {AXES_SQL} SELECT CAST(feature AS INTEGER) AS feature, CAST(len(cuts) AS INTEGER) AS cuts, CAST(list_sum(list_transform(cuts, lambda c: CAST(c AS DOUBLE))) AS DOUBLE) AS total FROM axes")
def cut_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cuts of all users' trees."""
    found = grid.cut_catalog(user_trees(spark, sf_dir))
    return found.select("feature", F.size("cuts").alias("cuts"), F.aggregate("cuts", F.lit(0.0), lambda a, c: a + c).alias("total"))


def axis_sql(f: int, cuts: list[list[float]]) -> str:
    """One value of each bin of an axis, and NaN."""
    own = [float(np.nextafter(np.float32(cuts[f][0]), np.float32(-np.inf))), *cuts[f]]
    points = ", ".join(f"(CAST({fp32.decimal_text(v)} AS FLOAT))" for v in own)
    return f"a{f} AS (SELECT * FROM (VALUES {points}, (CAST('nan' AS FLOAT))) t(x{f}))"


@query(f"{DRAWN_CELLS} SELECT class, CAST(count(*) AS BIGINT) AS cells FROM cells GROUP BY class")
def class_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.class_cells(drawn(spark, sf_dir), BIAS, len(NAMES))


@query(f"{DRAWN_CELLS} SELECT CAST(count(*) AS BIGINT) AS cells, CAST(count(*) FILTER (class IS NULL) AS BIGINT) AS mismatches FROM cells")
def grid_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The compiled graph of the drawn forest against the forest on every cell of the domain's grid."""
    trees = drawn(spark, sf_dir)
    nodes, root = compiler.compile_graph(trees, BIAS, len(NAMES))
    return grid.audit(trees, BIAS, nodes, root, len(NAMES))


def redundant_graph() -> tuple[list[tuple], int]:
    """A repeated test below itself, two equal subgraphs, a node with equal children, a stray node."""
    rows = [leaf(0, 0), leaf(1, 1), leaf(2, 1), branch(3, 1, 75.0, True, 0, 1), branch(4, 1, 75.0, True, 0, 2), branch(5, 0, 40.0, False, 3, 0), branch(6, 0, 40.0, False, 5, 4), branch(7, 2, 50.0, False, 1, 2), branch(8, 2, 25.0, True, 6, 7), branch(9, 0, 10.0, True, 0, 1)]
    return rows, 8


@query(f"WITH {EVENTS}, s AS (SELECT CASE WHEN x2 < 25 THEN CASE WHEN x1 < 75 THEN 0 ELSE 1 END ELSE 1 END AS class FROM x) SELECT class, CAST(count(*) AS BIGINT) AS n, 4 AS nodes FROM s GROUP BY class")
def simplify_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, root = redundant_graph()
    nodes, root, _ = graph.simplify(nodes_table(spark, rows), root)
    total = nodes.count()
    return scoring.predict(events(spark, sf_dir), nodes, root, NAMES).groupBy("class").agg(F.count("*").alias("n")).withColumn("nodes", F.lit(total))


def heap(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """A graph of all events, a node each."""
    rows = valued(spark, sf_dir)
    return heap_graph(rows, rows.count(), K)


SPOILT = {11: "class out of range", 13: "feature out of range", 17: "no usable cut", 19: "child not before its parent", 23: "equal children"}


@query(f"""WITH {VALUED}, {HEAP_SQL} SELECT CAST(node AS INTEGER) AS node, problem FROM (SELECT node, CASE WHEN NOT inside THEN CASE WHEN i % 11 = 0 THEN 'class out of range' END
  {' '.join(f"WHEN i % {d} = 0 THEN '{problem}'" for d, problem in SPOILT.items() if d > 11)} END AS problem FROM heap) WHERE problem IS NOT NULL""")
def invalid_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph of all events whose nodes are spoilt by their numbers, and what is found wrong with each."""
    nodes, root = heap(spark, sf_dir)
    i, inside = root - F.col("node"), F.col("feature") >= 0
    spoil = lambda d, c, v: F.when(inside & (i % d == 0), v).otherwise(F.col(c)).cast(nodes.schema[c].dataType)
    broken = nodes.select(
        "node", spoil(13, "feature", F.lit(3)).alias("feature"), "cut", spoil(17, "cut_bits", F.lit(None)).alias("cut_bits"), "default_left",
        F.when(inside & (i % 19 == 0), F.col("node")).when(inside & (i % 23 == 0), F.col("right")).otherwise(F.col("left")).cast("int").alias("left"),
        "right", F.when(~inside & (i % 11 == 0), K).otherwise(F.col("class")).cast("int").alias("class"),
    )
    return graph.invalid_nodes(broken, len(NAMES), K)


@query(f"""WITH {VALUED}, {HEAP_SQL} SELECT CAST(count(*) AS BIGINT) AS nodes, CAST(count(*) FILTER (NOT inside) AS BIGINT) AS leaves, CAST(count(*) FILTER (inside) AS BIGINT) AS branches, CAST(2 * count(*) FILTER (inside) AS BIGINT) AS edges,
  CAST(count(DISTINCT CASE WHEN inside THEN (i % 3, i % 2, v0) END) AS BIGINT) AS predicates, CAST(count(DISTINCT CASE WHEN inside THEN i % 3 END) AS BIGINT) AS features_used,
  CAST(coalesce(max(length(bin(i + 1))) FILTER (inside), 0) AS INTEGER) AS height, CAST(2 * count(*) FILTER (inside) + 1 AS VARCHAR) AS unfolded FROM heap""")
def graph_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of a graph of all events."""
    return graph.statistics(*heap(spark, sf_dir))


@query(f"""WITH {VALUED}, {HEAP_SQL} SELECT CAST(node AS INTEGER) AS node, 'D' || node || '(x) = ' || CASE WHEN NOT inside THEN CAST(label AS VARCHAR) ELSE
  'if (isnan(x[' || (i % 3) || ']) ? ' || (i % 2 = 0) || ' : x[' || (i % 3) || '] < ' || format('{{:.9g}}', CAST(v0 AS DOUBLE)) || ') then D' || (total - 2 - 2 * i) || '(x) else D' || (total - 3 - 2 * i) || '(x)' END AS equation FROM heap""")
def graph_equations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of a graph of all events as an equation."""
    return graph.equations(heap(spark, sf_dir)[0])


@query(f"{SCORED} SELECT row_id, class FROM s")
def sql_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The compiled graph, exported as SQL text and run as such."""
    nodes, root = compiled(spark)
    events(spark, sf_dir).createOrReplaceTempView("exported_rows")
    return spark.sql(f"SELECT row_id, {graph.sql_case(nodes, root, NAMES)} AS class FROM exported_rows")


BOXES = f"""{BY_USER}, {AXES_SQL}, w AS (SELECT list(len(cuts) + 1 ORDER BY feature) AS bins FROM axes),
k AS (SELECT tree, list(list_position(cuts, c[feature + 1]) ORDER BY feature) AS below FROM drawn CROSS JOIN axes GROUP BY tree),
l AS (SELECT tree, leaf, bins, CASE WHEN leaf < 2 THEN below[tree % 3 + 1] ELSE bins[tree % 3 + 1] - below[tree % 3 + 1] END * CASE leaf
  WHEN 0 THEN below[(tree + 1) % 3 + 1] WHEN 1 THEN bins[(tree + 1) % 3 + 1] - below[(tree + 1) % 3 + 1] WHEN 2 THEN below[(tree + 2) % 3 + 1] ELSE bins[(tree + 2) % 3 + 1] - below[(tree + 2) % 3 + 1] END
  * CASE WHEN leaf < 2 THEN bins[(tree + 2) % 3 + 1] ELSE bins[(tree + 1) % 3 + 1] END AS cells FROM k CROSS JOIN w CROSS JOIN range(4) r(leaf))"""


@query(f"{BOXES} SELECT tree, CAST(leaf + 3 AS INTEGER) AS leaf, CAST(cells AS BIGINT) AS cells, CAST(0 AS BIGINT) AS conflicts FROM l")
def leaf_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of every leaf box of the users' trees, and how many other leaves of its tree it overlaps (there must be none)."""
    boxes = regions.leaf_partitions(user_trees(spark, sf_dir), len(NAMES))
    met = evaluation.tree_conflicts(boxes)
    bad = met.select("tree", F.explode(F.array("a", "b")).alias("leaf")).groupBy("tree", "leaf").agg(F.count("*").alias("c"))
    sized = boxes.select("tree", "leaf", regions.volume(F.col("lo"), F.col("hi")).alias("cells"))
    return sized.join(bad, ["tree", "leaf"], "left").select("tree", "leaf", "cells", F.coalesce("c", F.lit(0)).cast("long").alias("conflicts"))


@query()
def state_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compiler.work_summary(compiler.estimate_states(drawn(spark, sf_dir), BIAS, len(NAMES), 2000))


@query(f"{BOXES} SELECT tree, CAST(count(*) AS BIGINT) AS leaves, CAST(sum(cells) AS BIGINT) AS covered, sum(cells) = any_value(bins[1] * bins[2] * bins[3]) AS whole FROM l GROUP BY tree")
def leaf_partition_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaf boxes of every user's tree cover the grid of all their cuts exactly."""
    trees = user_trees(spark, sf_dir)
    bins = {r["feature"]: r["bins"] for r in storage.bounded(grid.axis_bins(trees), len(NAMES), "features")}
    whole = int(np.prod([bins.get(f, 1) for f in range(len(NAMES))], dtype=object))
    return regions.partition_audit(regions.leaf_partitions(trees, len(NAMES)), whole)


@query(f"{DRAWN_CELLS} SELECT class, CAST(count(*) AS BIGINT) AS cells FROM cells WHERE NOT (isnan(x0) OR isnan(x1) OR isnan(x2)) GROUP BY class")
def class_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells by class from the ordered sum of the drawn trees' boxes; the SQL enumerates the cells."""
    return regions.class_regions(regions.score_regions(drawn(spark, sf_dir), BIAS, len(NAMES))).select("class", "cells")


@query(f"{DRAWN_CELLS} SELECT CAST(class AS VARCHAR) AS terminal, CAST(count(*) AS BIGINT) AS cells FROM cells GROUP BY class")
def diagram_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells by class from the shared diagram of the drawn forest."""
    nodes, root, _ = diagrams.class_diagram(drawn(spark, sf_dir), BIAS, len(NAMES))
    return diagrams.cells_by_terminal(nodes, root, len(NAMES)).select("terminal", F.col("cells").cast("long").alias("cells"))


@query(f"""{DRAWN_CELLS}, d2 AS (SELECT x0, x1, list(class ORDER BY x2) AS f FROM cells GROUP BY x0, x1), d1 AS (SELECT x0, list(class ORDER BY x1, x2) AS f FROM cells GROUP BY x0)
SELECT 0 AS axis, CAST(1 AS BIGINT) AS nodes UNION ALL SELECT 1, count(DISTINCT f) FROM d1 UNION ALL SELECT 2, count(DISTINCT f) FROM d2""")
def diagram_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of that diagram by axis: one for each different function of the axes from there on."""
    nodes, _, _ = diagrams.class_diagram(drawn(spark, sf_dir), BIAS, len(NAMES))
    return nodes.groupBy("axis").agg(F.count("*").alias("nodes"))


def used_cuts(rows: list[tuple]) -> list[list[float]]:
    return [sorted({r[4] for r in rows if r[3] == f}) for f in range(len(CUTS))]


PAIRS = [(t, t + K) for t in range(K)]


def in_parts(rows: list[tuple]) -> str:
    """SQL of each user's part of the domain in bins, and the trees' values on every cell of the grid inside it."""
    cuts = used_cuts(rows)

    def bin_of(f: int) -> str:
        return " + ".join(f"(x{f} >= CAST({fp32.decimal_text(c)} AS FLOAT))::INT" for c in cuts[f])

    ends = ", ".join(f"min({bin_of(f)}) FILTER (NOT isnan(x{f})) AS lo{f}, max({bin_of(f)}) FILTER (NOT isnan(x{f})) AS hi{f}, bool_or(isnan(x{f})) AS miss{f}" for f in range(3))
    inside = " AND ".join(f"CASE WHEN isnan(x{f}) THEN miss{f} ELSE b{f} BETWEEN lo{f} AND hi{f} END" for f in range(3))
    trees = range(max(r[0] for r in rows) + 1)
    return f"""WITH {EVENTS}, {', '.join(axis_sql(f, cuts) for f in range(3))},
u AS (SELECT CAST(x1 AS BIGINT) AS region, {ends} FROM x GROUP BY x1),
g AS (SELECT {', '.join(f"x{f}, {bin_of(f)} AS b{f}" for f in range(3))} FROM a0 CROSS JOIN a1 CROSS JOIN a2),
v AS (SELECT *, {', '.join(f"{tree_sql(rows, t, NAMES)} AS t{t}" for t in trees)} FROM g),
p AS (SELECT region, {', '.join(f"t{t}" for t in trees)} FROM u JOIN v ON {inside})"""


def user_parts(spark: SparkSession, sf_dir: str, rows: list[tuple]) -> DataFrame:
    """(region, lo, hi, sides): the bins that each user's rows reach on each axis, and whether values are missing there."""
    bins = [fp32.rank_of(F.col(n), F.array(*map(fp32.single, own))) for n, own in zip(NAMES, used_cuts(rows), strict=True)]
    seen = events(spark, sf_dir).select(F.col("x1").cast("long").alias("region"), *(b.alias(f"b{f}") for f, b in enumerate(bins)))
    known = lambda f: F.when(F.col(f"b{f}") >= 0, F.col(f"b{f}"))
    ends = [c for f in range(3) for c in (F.coalesce(F.min(known(f)), F.lit(1)).alias(f"lo{f}"), F.coalesce(F.max(known(f)), F.lit(0)).alias(f"hi{f}"), F.max((F.col(f"b{f}") < 0).cast("int")).alias(f"m{f}"))]
    out = seen.groupBy("region").agg(*ends)
    return out.select("region", *(F.array(*(f"{c}{f}" for f in range(3))).alias(n) for c, n in (("lo", "lo"), ("hi", "hi"), ("m", "sides"))))


@query(f"{in_parts(FOREST)} {' UNION ALL '.join(f'SELECT region, {a} AS a, {b} AS b, CAST(min(t{a} + t{b}) AS DOUBLE) AS least, CAST(max(t{a} + t{b}) AS DOUBLE) AS greatest FROM p GROUP BY region' for a, b in PAIRS)}")
def joint_pair_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least and greatest sum of two trees of a class inside each user's part of the domain; the SQL tries every cell."""
    pairs = spark.createDataFrame(PAIRS, "a int, b int")
    found = regions.pair_bounds(user_parts(spark, sf_dir, FOREST), regions.leaf_partitions(forest(spark), len(NAMES)), pairs)
    return found.select("region", "a", "b", F.col("least").cast("double").alias("least"), F.col("greatest").cast("double").alias("greatest"))


STUMPS = rule_forest(8, K, CUTS, depth=1, seed=17)


def stumps_sql(channel: int) -> str:
    return " + ".join(f"CAST(t{t} AS DOUBLE)" for t in range(channel, 8 * K, K))


@query(f"{in_parts(STUMPS)} {' UNION ALL '.join(f'SELECT region, {k} AS channel, min({stumps_sql(k)}) AS least, max({stumps_sql(k)}) AS greatest FROM p GROUP BY region' for k in range(K))}")
def grouped_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least and greatest exact sum of a class's trees of one test inside each user's part of the domain; the SQL tries every cell."""
    trees = forest(spark, STUMPS)
    table = regions.range_table(regions.axis_sums(trees, regions.leaf_partitions(trees, len(NAMES))))
    return regions.grouped_bounds(user_parts(spark, sf_dir, STUMPS), table)


@query(f"{SCORED} SELECT row_id, class FROM s")
def compact_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The compiled graph packed into a word a node, unpacked and used."""
    nodes, root = compiled(spark)
    back = graph.expand_compact(*graph.compact(nodes, K))
    return scoring.predict(events(spark, sf_dir), back, root, NAMES).select("row_id", "class")


@query(f"{SCORED} SELECT row_id, class FROM s")
def unfolded_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph unfolded to a tree with single parents, imported again and used."""
    nodes, root = compiled(spark)
    flat = graph.unfold(nodes, root)
    from pyspark.sql import Window

    ids = flat.select("path", (F.row_number().over(Window.orderBy("path")) - 1).alias("id"))
    tree = flat.join(ids, "path")
    for name, step in (("left", "L"), ("right", "R")):
        child = ids.select(F.col("path").alias("below"), F.col("id").alias(f"to_{name}"))
        tree = tree.join(child, F.concat("path", F.lit(step)) == F.col("below"), "left").drop("below")
    tree = tree.select(F.col("id").alias("node"), "feature", "cut", "cut_bits", "default_left", F.coalesce("to_left", F.lit(-1)).alias("left"), F.coalesce("to_right", F.lit(-1)).alias("right"), "class")
    again, top = graph.import_tree(tree)
    return scoring.predict(events(spark, sf_dir), again, top, NAMES).select("row_id", "class")


@query(f"""WITH {EVENTS}, d AS (SELECT row_id, CASE WHEN isnan(x0) THEN 0.0 ELSE 1 / (1 + exp(-(20 - CAST(x0 AS DOUBLE)) / 10)) END AS a, 1 / (1 + exp(-(0.5 - CAST(CAST(x2 / 100 AS FLOAT) AS DOUBLE)) / 0.1)) AS b FROM x)
SELECT row_id, round(b * (1 - a), 6) AS g0, round(b * a, 6) AS g1, round(1 - b, 6) AS g2 FROM d""")
def graded_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, nodes, root = demo_rows(spark, sf_dir)
    out = regions.graded_classes(rows, nodes, root, NAMES, K, [10.0, 1.0, 0.1])
    return out.select("row_id", *(F.round(F.get("grades", F.lit(k)), 6).alias(f"g{k}") for k in range(K)))


@query("""WITH m AS (SELECT o_orderkey AS model, o_orderkey AS ord, o_custkey % 40 AS plan, o_orderkey % 17 AS rounds FROM orders),
w AS (SELECT o_orderkey AS want, o_custkey % 40 AS plan, o_orderkey % 19 AS rounds FROM orders),
f AS (SELECT plan, rounds, min(ord) AS model FROM m GROUP BY plan, rounds),
r AS (SELECT w.want, w.plan, min(f.rounds) AS rounds FROM w JOIN f ON f.plan = w.plan AND f.rounds >= w.rounds GROUP BY w.want, w.plan)
SELECT want, model, rounds FROM r JOIN f USING (plan, rounds)""")
def training_cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/orders.parquet")
    i, plan = F.col("o_orderkey"), F.col("o_custkey") % 40
    models = t.select(i.alias("model"), i.alias("ord"), plan.alias("plan"), (i % 17).alias("rounds"))
    wanted = t.select(i.alias("want"), plan.alias("plan"), (i % 19).alias("rounds"))
    return study.cached_model(models, wanted).where("model IS NOT NULL")


@query("SELECT o_custkey AS bundle, CAST(sum(bytes) AS BIGINT) AS bytes FROM (SELECT DISTINCT o_custkey, o_orderkey % 7 AS model, (o_orderkey % 7) * 100 + 16 AS bytes FROM orders) GROUP BY o_custkey")
def bundle_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("o_orderkey") % 7
    return study.bundle_bytes(spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("bundle"), i.alias("model"), (i * 100 + 16).alias("bytes")))


@query("""WITH d AS (SELECT o_orderpriority AS declaration, row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS teacher FROM orders GROUP BY o_orderpriority),
r AS (SELECT o_orderkey AS row_id, o_orderkey % 5 AS teacher FROM orders), own AS (SELECT declaration, row_number() OVER (ORDER BY declaration) - 1 AS teacher FROM d WHERE declaration <> '5-LOW')
SELECT r.row_id, CAST(own.teacher AS INTEGER) AS teacher FROM r JOIN d ON d.teacher = r.teacher JOIN own ON own.declaration = d.declaration""")
def import_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    t = spark.read.parquet(f"{sf_dir}/orders.parquet")
    donor = first_seen_labels(t, "o_orderpriority", "o_orderkey").select(F.col("class").alias("teacher"), F.col("label").alias("declaration"))
    own = donor.where("declaration <> '5-LOW'").select((F.row_number().over(Window.orderBy("declaration")) - 1).cast("int").alias("teacher"), "declaration")
    responses = t.select(F.col("o_orderkey").alias("row_id"), (F.col("o_orderkey") % 5).alias("teacher"), F.lit(0).alias("class"), F.lit(1.0).alias("p"))
    return study.import_columns(responses, donor, own).select("row_id", "teacher")


@query("SELECT CAST(count(*) AS BIGINT) AS shared FROM (SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderkey % 2 = 0 INTERSECT SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderkey % 2 = 1)")
def holdout_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/orders.parquet")
    n = study.overlap(t.where("o_orderkey % 2 = 0"), t.where("o_orderkey % 2 = 1"), ["o_custkey", "o_orderpriority"])
    return spark.createDataFrame([(n,)], "shared long")


@query(f"{DRAWN_CELLS} SELECT class, CAST(count(*) AS BIGINT) AS cells FROM cells GROUP BY class")
def settled_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that a search of the drawn forest settles for each class, added up over its waves; the SQL enumerates them."""
    found = compiler.coverage(drawn(spark, sf_dir), BIAS, len(NAMES))
    return found.groupBy("class").agg(F.sum(F.col("cells").cast("long")).alias("cells")).where("cells > 0 OR class IS NULL")


@query()
def policy_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split orders that make smaller graphs, learned from parallel episodes."""
    return policy.learn(drawn(spark, sf_dir), BIAS, len(NAMES), 3, 16)[0]


@query(f"WITH {EVENTS} SELECT row_id, CAST(CASE WHEN row_id % 2 = 0 THEN CASE WHEN r < 40 THEN 3 WHEN r < 90 THEN 5 ELSE 7 END ELSE CASE WHEN r < 10 THEN 4 ELSE 6 END END AS INTEGER) AS child FROM (SELECT row_id, CAST(x2 AS INTEGER) AS r FROM x)")
def arc_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row takes the one arc of its node whose range of ranks holds its own."""
    arcs = spark.createDataFrame([(0, 0, 39, 3), (0, 40, 89, 5), (0, 90, 99, 7), (1, 0, 9, 4), (1, 10, 99, 6)], "node int, low int, high int, child int")
    rows = events(spark, sf_dir).select("row_id", (F.col("row_id") % 2).cast("int").alias("node"), F.col("x2").cast("int").alias("rank"))
    return graph.take_arc(rows, arcs, "row_id").select("row_id", "child")


@query(f"WITH {EVENTS} SELECT row_id, class FROM {scored_sql(SECOND)}")
def packed_graph_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two graphs in one table; the second is followed from its root there."""
    packed, roots = graph.pack_graphs([compiled(spark), compiler.compile_graph(forest(spark, SECOND), BIAS, len(NAMES))])
    return scoring.predict(events(spark, sf_dir), packed, roots[1], NAMES).select("row_id", "class")


REGION = compiler.Region({0: (10.0, 60.0), 1: (0.0, 80.0)}, {0: False, 1: False, 2: False})


@query(f"WITH {EVENTS} SELECT CAST(count(*) AS BIGINT) AS rows, CAST(0 AS BIGINT) AS mismatches FROM x WHERE x0 BETWEEN 10 AND 60 AND x1 BETWEEN 0 AND 80 AND NOT isnan(x0)")
def region_graph_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph compiled for a part of the domain, against the ensemble on the rows there."""
    nodes, root = compiler.compile_graph(forest(spark), BIAS, len(NAMES), region=REGION)
    rows = events(spark, sf_dir).where("x0 BETWEEN 10 AND 60 AND x1 BETWEEN 0 AND 80 AND NOT isnan(x0)")
    both = scoring.predict(scoring.classify(rows, forest(spark), NAMES, BIAS, name="expected"), nodes, root, NAMES)
    return both.agg(F.count("*").alias("rows"), F.count_if(F.col("class") != F.col("expected")).alias("mismatches"))


TALL = rule_forest(22, K, [[10.0, 25.0, 40.0, 60.0, 75.0, 90.5], [15.0, 30.0, 75.0, 100.0, 120.0], [5.0, 25.0, 50.0, 75.0, 95.0]], depth=6, seed=41)


@query(f"WITH {EVENTS} SELECT class, CAST(count(*) AS BIGINT) AS rows, CAST(0 AS BIGINT) AS mismatches FROM {scored_sql(TALL)} GROUP BY class")
def tall_forest_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by class of the graph of 66 trees of depth 6, and those that the trees themselves class otherwise."""
    trees = forest(spark, TALL)
    nodes, root = compiler.compile_graph(trees, BIAS, len(NAMES))
    both = scoring.predict(scoring.classify(events(spark, sf_dir), trees, NAMES, BIAS, name="expected"), nodes, root, NAMES)
    return both.groupBy("class").agg(F.count("*").alias("rows"), F.count_if(~F.col("class").eqNullSafe(F.col("expected"))).alias("mismatches"))


@query(f"{SCORED} SELECT role, CAST(count(*) AS BIGINT) AS rows, CAST(count(*) FILTER (class <> label) AS BIGINT) AS errors, count(*) FILTER (class = label) / count(*) AS accuracy FROM s GROUP BY role")
def bundle_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A saved bundle, read back with its checks, on the rows of both roles."""
    path = storage.shared_dir(spark) + "/bundle"
    bundles.save(bundles.Bundle(NAMES, K, ["only"], {"only": (forest(spark), BIAS)}), path)
    return bundles.evaluate(bundles.load(spark, path), events(spark, sf_dir), "label", "role", "row_id")


@query(f"""WITH {EVENTS}, s AS (SELECT row_id, 1 / (1 + exp(-(0.5 - CAST(x2 AS DOUBLE)) / 20)) AS b, CASE WHEN isnan(x0) THEN 0 ELSE 1 / (1 + exp(CAST(x0 AS DOUBLE) / 30)) END AS a,
  CASE WHEN isnan(x0) THEN 0 ELSE 1 END AS known, CASE WHEN NOT x2 < 0.5 THEN 2 WHEN NOT isnan(x0) AND x0 < 0 THEN 1 ELSE 0 END AS class FROM x)
SELECT row_id, CAST(class AS INTEGER) AS class, round(b * (1 - a), 6) AS g0, round(b * a, 6) AS g1, round(1 - b, 6) AS g2, round(known * b * a * (1 - a) / 30, 6) AS d0, round(b * (1 - b) / 20, 6) AS d2 FROM s""")
def graded_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of the classes in a softened graph, and two of their derivatives: class 0 by x0, class 2 by x2."""
    rows, root = demo_graph()
    own = events(spark, sf_dir).select("row_id", *NAMES)
    out = regions.graded_slopes(own, nodes_table(spark, rows), root, NAMES, K, [30.0, 1.0, 20.0])
    grades = [F.round(F.get("grades", F.lit(k)), 6).alias(f"g{k}") for k in range(K)]
    return out.select("row_id", "class", *grades, F.round(F.get("slopes", F.lit(0)), 6).alias("d0"), F.round(F.get("slopes", F.lit(8)), 6).alias("d2"))


# ---- training and studies --------------------------------------------------------------------

BIN_SQL = ", ".join(f"CASE WHEN isnan(x{f}) THEN -1 ELSE {' + '.join(f'(x{f} >= {c})::INT' for c in CUTS[f])} END AS b{f}" for f in range(3))
HIST_SQL = f"""WITH {EVENTS}, b AS (SELECT label, {BIN_SQL} FROM x), f AS (
  SELECT label, 0 AS feature, b0 AS bin FROM b UNION ALL SELECT label, 1, b1 FROM b UNION ALL SELECT label, 2, b2 FROM b),
h AS (SELECT CAST(k AS INTEGER) AS class, feature, CAST(bin AS INTEGER) AS bin, count(*) AS n, count(*) / 3.0 - count(*) FILTER (label = k) AS g, count(*) * (4.0 / 9) AS h FROM f CROSS JOIN range(3) r(k) GROUP BY k, feature, bin)"""


def start_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    zero = F.array(*(F.lit(0.0).cast("float") for _ in range(K)))
    rows = events(spark, sf_dir).select("label", training.bin_columns(events(spark, sf_dir), NAMES, CUTS).alias("bins"), zero.alias("margins"))
    live = rows.withColumn("grads", training.gradients(F.col("margins"), F.col("label"), K)).withColumn("at", F.array(*(F.lit(0) for _ in range(K))))
    return training.histogram(live)


@query(f"{HIST_SQL} SELECT class, feature, bin, CAST(n AS BIGINT) AS n, round(g, 4) AS g, round(h, 4) AS h FROM h")
def train_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return start_histogram(spark, sf_dir).select("class", "feature", "bin", "n", F.round("g", 4).alias("g"), F.round("h", 4).alias("h"))


@query(f"""{HIST_SQL}, t AS (SELECT class, feature, sum(g) AS ga, sum(h) AS ha, sum(g) FILTER (bin < 0) AS gm, sum(h) FILTER (bin < 0) AS hm, max(bin) AS last FROM h GROUP BY class, feature),
s AS (SELECT a.class, a.feature, a.bin, d, ga, ha, hm, last, (SELECT sum(g) FROM h b WHERE b.class = a.class AND b.feature = a.feature AND b.bin BETWEEN 0 AND a.bin) + CASE WHEN d THEN coalesce(gm, 0) ELSE 0 END AS gl,
  (SELECT sum(h) FROM h b WHERE b.class = a.class AND b.feature = a.feature AND b.bin BETWEEN 0 AND a.bin) + CASE WHEN d THEN coalesce(hm, 0) ELSE 0 END AS hl
  FROM h a JOIN t ON t.class = a.class AND t.feature = a.feature CROSS JOIN (VALUES (true), (false)) q(d) WHERE a.bin >= 0),
w AS (SELECT *, gl * gl / (hl + 1) + (ga - gl) ** 2 / (ha - hl + 1) - ga * ga / (ha + 1) AS gain FROM s WHERE hl >= 1 AND ha - hl >= 1 AND (bin < last OR (NOT d AND hm > 0)))
SELECT class, feature, bin, d AS default_left, round(gain, 4) AS gain FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY round(gain, 8) DESC, feature, bin, d) AS place FROM w WHERE gain > 1e-6) WHERE place = 1""")
def train_best_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = {"lambda": 1.0, "alpha": 0.0, "gamma": 0.0, "min_child_weight": 1.0}
    return training.best_splits(start_histogram(spark, sf_dir), p).select("class", "feature", "bin", "default_left", F.round("gain", 4).alias("gain"))


SMALL = {"rounds": 2, "max_depth": 2, "max_bin": 16, "eta": 0.5}


DEEP = {"rounds": 8, "max_depth": 4, "max_bin": 16, "eta": 0.5}


@query()
def train_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).where("role = 'FIT'")
    return training.train(rows, NAMES, "label", K, DEEP)[0]


@query("SELECT CAST(0 AS BIGINT) AS mismatches")
def train_compile_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trained ensemble, compiled, and both compared on every cell of its grid."""
    trees, bias = training.train(events(spark, sf_dir).where("role = 'FIT'"), NAMES, "label", K, SMALL)
    nodes, root = compiler.compile_graph(trees, bias, len(NAMES))
    return grid.audit(trees, bias, nodes, root, len(NAMES)).select("mismatches")


@query()
def hpo_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    found, _ = study.search(rows.where("role = 'FIT'"), rows.where("role = 'VALID'"), NAMES, "label", K, SMALL, [{"rounds": 1}, {"rounds": 2}])
    return found


def dense(rows: DataFrame) -> DataFrame:
    """Rows of the FIT role have a dense ordinal of their own: four of every five ids."""
    i = F.col("row_id")
    return rows.withColumn("row_id", F.floor(i / 5) * 4 + i % 5)


@query()
def combine_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    plans = [SMALL | {"rounds": 1}, SMALL | {"rounds": 1, "max_depth": 1}]
    found, _ = study.combine(dense(rows.where("role = 'FIT'")), rows.where("role = 'VALID'"), NAMES, "label", K, plans, [SMALL | {"rounds": 1, "max_depth": 1}])
    return found


