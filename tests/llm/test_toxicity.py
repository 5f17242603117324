import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from dendrospark.llm import toxicity
from dendrospark.llm.entry import op3_toxicity_mil


def corpus(n=400, seed=3):
    rng = np.random.default_rng(seed)
    plain = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(10)]
    rows = []
    for i in range(n):
        toxic = int(rng.random() < 0.3)
        sentences = [" ".join(rng.choice(plain, 8)) for _ in range(rng.integers(1, 6))]
        if toxic:
            at = rng.integers(len(sentences))
            sentences[at] += " vilename" + str(rng.choice(list("abc")))
        rows.append((i, ". ".join(sentences) + ".", toxic))
    return rows


def test_noisy_or_of_log_odds():
    p = np.array([0.1, 0.5, 0.02])
    odds = toxicity.noisy_or(np.log(p / (1 - p)))
    assert 1 / (1 + np.exp(-odds)) == pytest.approx(1 - np.prod(1 - p))


def test_gradient_of_the_document_loss():
    rng = np.random.default_rng(4)
    docs = np.array([0, 0, 1, 1, 1, 2])
    rows, cols, labels = np.array([0, 1, 2, 3, 4, 5]), rng.integers(0, 3, 6), np.array([1, 0, 1])

    def loss(w):
        z = w[-1] + np.bincount(rows, w[cols], len(docs))
        none = np.bincount(docs, -np.logaddexp(0, z), 3)
        return -np.mean(np.where(labels == 1, np.log(-np.expm1(none)), none))

    w, b = toxicity.fit_weights(rows, cols, docs, labels, 3, steps=400, rate=0.05, decay=0.0)
    best = np.append(w, b)
    assert loss(best) <= min(loss(best + d) for d in 0.3 * rng.standard_normal((20, 4))) + 1e-3


def test_held_out_accuracy_and_offending_sentences(spark, folder):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t, _ in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in op3_toxicity_mil(spark, folder(documents=docs, labels=labels)).collect()}
    held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert {i for i, r in out.items() if r.held_out} == {i for i, _ in held}
    assert np.mean([out[i].predicted == y for i, y in held]) > 0.95
    model = toxicity.train(docs, labels)
    found = toxicity.score(docs, "text", ["doc_id"], model).where("predicted = 1").collect()
    texts = {i: t for i, t, _ in rows}
    hits = [any("vile" in texts[r.doc_id][s.start : s.end] for s in r.spans) for r in found]
    assert np.mean(hits) > 0.95


def test_features_and_bags_against_plain_python(spark):
    rows = corpus(80)
    sample = spark.createDataFrame([(i, t, y) for i, t, y in rows], "doc_id long, _text string, toxic int")
    want = {}
    for _, t, y in rows:
        for f in {f for w in toxicity.TOKEN.findall(t) if w not in ".!?" for f in toxicity.word_features(w)}:
            want.setdefault(f, [0, 0])[y] += 1
    assert {r.feature: [r.clean, r.toxic] for r in toxicity.feature_counts(sample).collect()} == want
    n = sum(y for _, _, y in rows)
    names = toxicity.choose_features(sample, len(rows) - n, n, 8)
    assert {"vil", "vile"} <= set(names)
    hit, cols, docs, labels = toxicity.bags(sample, names)
    assert labels.tolist() == [y for _, _, y in rows]
    flat = [(d, s) for d, (_, t, _) in enumerate(rows) for s in t.split(".") if s.strip()]
    assert docs.tolist() == [d for d, _ in flat]
    expected = sorted((k, names.index(f)) for k, (_, s) in enumerate(flat) for w in s.split() for f in toxicity.word_features(w) if f in names)
    assert sorted(zip(hit.tolist(), cols.tolist(), strict=True)) == expected


def test_edge_cases(spark, documents, no_documents, folder):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = op3_toxicity_mil(spark, folder(documents=documents, labels=none)).collect()
    assert len(out) == documents.count() and all(r.score < 0.01 and r.predicted == 0 for r in out)
    odd = spark.createDataFrame([(0, 1, 1), (0, 1, 0), (1, 1, None), (None, 1, 1), (8, 0, 1), (9, 0, 0)], none.schema)
    out = op3_toxicity_mil(spark, folder(documents=documents, labels=odd)).collect()
    assert len(out) == documents.count() and all(0 <= r.score <= 1 for r in out)
    assert op3_toxicity_mil(spark, folder(documents=no_documents, labels=odd)).count() == 0


def test_other_columns_are_no_inputs(spark):
    rows = corpus(60)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    a = spark.createDataFrame([(i, t, "en") for i, t, _ in rows], "doc_id long, text string, lang string")
    b = a.withColumn("lang", F.lit("xx")).withColumn("doc_id", F.col("doc_id") + 1000)
    one = sorted(r.score for r in toxicity.score(a, "text", ["doc_id"], model).collect())
    assert one == sorted(r.score for r in toxicity.score(b, "text", ["doc_id"], model).collect())
