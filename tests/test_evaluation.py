import pytest

from dendrospark.operators import compiler, evaluation
from dendrospark.streaming import scoring as streaming


def test_gates_stop_at_the_first_tie(spark):
    rows = [(i, 0, int(i in bad), int(i in worse)) for i, (bad, worse) in enumerate([({1}, {0, 1, 2, 6})] * 9)]
    df = spark.createDataFrame(rows, "row_id long, label int, c int, b int")
    out = evaluation.gates_by_block(df, evaluation.block_of(df.row_id, 9, 3), "c", "b").orderBy("level").collect()
    assert [(g.level, g.offset, g.candidate_errors, g.baseline_errors, g.accepted) for g in out] == [(0, 0, 1, 3, True), (1, 3, 0, 0, False)]


@pytest.mark.parametrize(("rows", "blocks"), [(7, 3), (6, 3), (10, 1), (5, 5)])
def test_blocks_are_those_of_ntile(spark, rows, blocks):
    df = spark.range(rows).withColumnRenamed("id", "r")
    df.createOrReplaceTempView("blocks_in")
    want = [x.b for x in spark.sql(f"SELECT ntile({blocks}) OVER (ORDER BY r) - 1 AS b FROM blocks_in ORDER BY r").collect()]
    assert [x.b for x in df.select("r", evaluation.block_of(df.r, rows, blocks).alias("b")).orderBy("r").collect()] == want


def test_mismatches_see_missing_rows(spark):
    a = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "row_id int, class int")
    b = spark.createDataFrame([(1, 0), (2, 0), (4, 1)], "row_id int, class int")
    assert {r.row_id for r in evaluation.mismatches(a, b, "row_id").collect()} == {2, 3, 4}


def test_coverage_audit_kinds(spark):
    rows = spark.range(5).withColumnRenamed("id", "row_id")
    good = [(i, 0, k, 0.5) for i in range(5) for k in range(2)]
    bad = [r for r in good if r[0] != 1] + [(2, 0, 1, 0.5), (9, 0, 0, 1.0)]
    bad = [(3, 0, k, 0.9) if i == 3 else (i, t, k, p) for i, t, k, p in bad]
    make = lambda r: spark.createDataFrame(r, "row_id long, teacher int, class int, p double")
    assert evaluation.coverage_audit(make(good), rows, 1, 2).count() == 0
    found = {r.row_id: r.problem for r in evaluation.coverage_audit(make(bad), rows, 1, 2).collect()}
    assert found == {1: "missing", 2: "repeated", 3: "not a distribution", 9: "unknown row"}


def test_confusion_has_all_cells(spark):
    df = spark.createDataFrame([(0, 1), (0, 1), (2, 2)], "label int, class int")
    out = {(r.label, r.predicted): r.rows for r in evaluation.confusion(df, 3).collect()}
    assert len(out) == 9 and out[0, 1] == 2 and out[2, 2] == 1 and sum(out.values()) == 3
    with pytest.raises(ValueError):
        evaluation.confusion(df, 3, most_cells=8)


def test_eta(spark):
    make = lambda r: spark.createDataFrame(r, "step int, work double, seconds double")
    assert compiler.eta(make([(1, 5.0, 1.0)]), 10).first().status == "too few steps"
    out = compiler.eta(make([(i, 10.0, 2.0) for i in range(6)]), 50).first()
    assert (out.steps, out.rate, out.seconds, out.least, out.most) == (4, 5.0, 10.0, 10.0, 10.0)


def test_stream_counts(spark, tmp_path):
    from dendrospark.functions.models import demo_graph, nodes_table

    rows, root = demo_graph()
    df = spark.createDataFrame([(f"2024-01-01 00:0{i}:00", float(-i % 2), 0.0, float(i % 3 == 0)) for i in range(8)], "t string, x0 float, x1 float, x2 float")
    df = df.selectExpr("to_timestamp(t) AS ts", "x0", "x1", "x2")
    df.write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    scored = streaming.score_stream(source, nodes_table(spark, rows), root, ["x0", "x1", "x2"])
    counts = streaming.class_counts(scored, "ts", "4 minutes", "1 minute")
    running = counts.writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    running.awaitTermination()
    assert spark.table("counted").selectExpr("sum(rows) AS n").first().n == 8
