import random

import pytest
from pyspark.sql import functions as F

from dendrospark.operators import evaluation, ordered


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema).repartition(5)


@pytest.mark.parametrize("n", [0, 1, 300])
def test_running_least_and_windows_against_plain_python(spark, n):
    say = random.Random(n)
    rows = [(i * 3, say.randrange(20), say.randrange(5)) for i in range(n)]
    got = {r.ord: (r.best_ord, r.became_incumbent) for r in evaluation.incumbents(table(spark, rows, "ord int, errors long, bytes long")).collect()}
    best, want = None, {}
    for o, e, b in rows:
        best = min(x for x in (best, (e, b, o)) if x)
        want[o] = (best[2], best[2] == o)
    assert got == want
    steps = [(i, say.randrange(100), 1 + say.randrange(4)) for i in range(n)]
    rated = {r.step: r.rate for r in evaluation.throughput(table(spark, steps, "step long, work long, seconds long")).collect()}
    assert rated == {i: sum(s[1] for s in steps[max(0, i - 3) : i + 1]) / sum(s[2] for s in steps[max(0, i - 3) : i + 1]) for i in range(n)}


def test_windows_cross_chunks(spark):
    df = table(spark, [(i,) for i in range(50)], "step long")
    chunks = ordered.sliding(df, "step", 4, chunk=7)
    seen = {(r["_chunk"], r["_place"]) for r in chunks.collect()}
    assert seen == {(c, p) for c in range(9) for p in range(50) if p // 7 <= c <= (p + 3) // 7}
    assert chunks.where("NOT _copy").count() == 50


def test_dense_places(spark):
    say = random.Random(1)
    keys = [say.randrange(40) for _ in range(400)] + [7] * 300
    got = {r.key: r.place for r in ordered.dense_places(table(spark, [(k,) for k in keys], "key int"), "key").collect()}
    assert got == {k: i + 1 for i, k in enumerate(sorted(set(keys)))}


def test_no_task_sees_all_rows(spark, capsys):
    """No exchange of the plans brings all rows together."""
    df = table(spark, [(i, i % 7, i % 3) for i in range(100)], "ord int, errors long, bytes long")
    steps = df.select(F.col("ord").cast("long").alias("step"), F.col("errors").alias("work"), (F.col("bytes") + 1).alias("seconds"))
    for out in (evaluation.incumbents(df), evaluation.throughput(steps), ordered.dense_places(df, "errors")):
        out.explain()
        assert "SinglePartition" not in capsys.readouterr().out
