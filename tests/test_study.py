import random

from dendrospark.operators import study


def test_cached_model_is_the_shortest_that_covers(spark):
    """Against all pairs, with repeats and nulls; no pairs of a plan are made."""
    draw = random.Random(5)
    some = lambda n: draw.choice([None, *range(n)])
    models = [(i, some(6), some(3), some(12)) for i in range(80)]
    wanted = [(i % 50, some(3), some(14)) for i in range(60)] + [(90, 7, 1)]
    expected = {w: (None, None) for w, _, _ in wanted}
    for w in expected:
        fits = [(r, o is None, o or 0, m) for v, p, n in wanted if v == w for m, o, q, r in models if None not in (p, n, q, r) and p == q and r >= n]
        if fits:
            expected[w] = (min(fits)[3], min(fits)[0])
    out = study.cached_model(spark.createDataFrame(models, "model int, ord int, plan int, rounds int"), spark.createDataFrame(wanted, "want int, plan int, rounds int"))
    got = [(r.want, (r.model, r.rounds)) for r in out.collect()]
    assert len(got) == len(expected) and dict(got) == expected
    assert ">=" not in out._jdf.queryExecution().optimizedPlan().toString()
