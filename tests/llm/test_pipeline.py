import random

import pytest

import corpus_pipeline
from dendrospark.llm import secrets, simhash, toxicity

from .test_toxicity import corpus


@pytest.fixture
def tables(spark, folder):
    rows = corpus(200)
    texts = [(i, t) for i, t, _ in rows] + [(1000 + i, t) for i, t, _ in rows[:40]] + [(2000, None), (2001, ""), (2002, rows[0][1] + " token=abcdefgh12345678"), (2003, "only token=abcdefgh12345678 here")]
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    return folder(documents=docs, labels=labels), texts


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else {None}


def brute_kept(rows):
    """Ids that stay: those without an earlier one, of those that stay, at similarity 0.8 or more."""
    kept = []
    for i, text in rows:
        own = shingles(text)
        if not any(len(own & x) >= 0.8 * len(own | x) for _, x in kept):
            kept.append((i, own))
    return {i for i, _ in kept}


def test_near_copies_against_brute_force(spark, tables):
    """Edited copies down to similarity 0.8 go, all but the few whose fingerprints are too far; texts below it stay."""
    where, _ = tables
    say = random.Random(5)
    words = [f"w{k}" for k in range(4000)]
    rows, i = [], 0
    for group in range(30):
        base = [say.choice(words) for _ in range(say.randint(60, 300))]
        rows.append((i := i + 1, " ".join(base)))
        for _ in range(group % 4):
            edited = list(base)
            for at in say.sample(range(len(base)), len(base) // 60):
                edited[at] = say.choice(words)
            rows.append((i := i + 1, " ".join(edited)))
        far = list(base)
        for at in range(0, len(base), 10):
            far[at] = say.choice(words)
        rows.append((i := i + 1, " ".join(far)))
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, where).collect()}
    want = brute_kept(rows)
    assert len(rows) - len(want) > 30 and got >= want and len(got - want) <= 0.02 * (len(rows) - len(want))


def test_large_components_are_dealt_out(spark, tables, monkeypatch):
    """A component larger than a part: copies meet in later rounds, unlike texts of one fingerprint stay."""
    where, _ = tables
    monkeypatch.setattr(simhash, "MOST_LOCAL", 5)
    say = random.Random(6)
    base = [f"v{k}" for k in range(400)]
    rows = [(0, " ".join(base))]
    for i in range(1, 40):
        edited = list(base)
        edited[say.randrange(400)] = f"e{i}"
        rows.append((i, " ".join(edited)))
    for i in range(40, 60):
        shuffled = list(base)
        say.shuffle(shuffled)
        rows.append((i, " ".join(shuffled)))
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, where).collect()}
    assert got == brute_kept(rows) == {0, *range(40, 60)}


@pytest.mark.parametrize("bound", [7, 30])
def test_chains_lose_no_text(spark, tables, monkeypatch, bound):
    """Each text is similar to its neighbours alone: whatever a part takes in, a text goes only for one that stays."""
    where, _ = tables
    monkeypatch.setattr(simhash, "MOST_LOCAL", bound)
    say = random.Random(11)
    words, rows = [f"v{k}" for k in range(120)], []
    for i in range(150):
        rows.append((i, " ".join(words)))
        words[(i * 37) % 120] = f"e{i}"
        words[(i * 37 + 60) % 120] = f"f{i}"
    say.shuffle(rows)
    rows = [(n, t) for n, (_, t) in enumerate(rows)]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, where).collect()}
    assert got == brute_kept(rows) and len(got) < 120


def test_each_stage_against_its_decisions(spark, tables):
    where, _ = tables
    docs = spark.read.parquet(f"{where}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{where}/labels.parquet"))
    clean = corpus_pipeline.drop_toxic(spark, docs, where)
    before = {r.doc_id: r for r in docs.collect()}
    after = {r.doc_id: r for r in clean.collect()}
    assert after == {i: r for i, r in before.items() if model.score(model.raw(r.text or "")) < toxicity.THRESHOLD}
    single = {r.doc_id: r for r in corpus_pipeline.drop_near_copies(spark, clean, where).collect()}
    assert set(single) == brute_kept([(i, after[i].text) for i in sorted(after)]) and all(single[i] == after[i] for i in single)
    kept = clean.where(clean.doc_id.isin(list(single)))
    safe = {r.doc_id: r for r in corpus_pipeline.redact_secrets(spark, kept, where).collect()}
    assert set(safe) == set(single)
    for i, r in safe.items():
        spans = secrets.unwrap(single[i].text or "")[0]
        assert r.text == (secrets.redact(single[i].text, spans) if spans else single[i].text)
        assert r.n_chars == (len(r.text) if spans else single[i].n_chars)


def test_run(spark, tables):
    where, _ = tables
    pieces = corpus_pipeline.run(spark, where).collect()
    assert pieces and [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "secret_scans", "packing"]
    spans = {}
    for p in pieces:
        spans.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for own in spans.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length


def test_repeated_ids_keep_one_row(spark, tables):
    where, _ = tables
    rows = [(1, "same words in each of these rows here", "en", "s", 1)] * 3 + [(2, "other text that is not like the first", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, where).collect()) == [1, 2]
    none = docs.limit(0)
    assert corpus_pipeline.drop_near_copies(spark, none, where).count() == 0


def test_rows_without_or_with_shared_ids_are_told_apart(spark, tables):
    """Ids may be null or repeated: different texts stay, near copies under one id do not."""
    where, _ = tables
    a, b, c, d = (" ".join(f"{w}{i}" for i in range(30)) for w in "abcd")
    rows = [(None, a), (None, b), (None, b), (1, c), (1, d), (2, d), (1, a)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    out = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, docs, where).collect()]
    assert sorted(out, key=str) == sorted([(1, a), (None, b), (1, c), (1, d)], key=str)
