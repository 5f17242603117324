import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from dendrospark.llm import exact_dedup
from dendrospark.llm.entry import op12_golomb_exchange

from .conftest import LONG, TEXTS


def brute(rows):
    """(doc_id, keep_id, group_size, kept, sha) of (doc_id, text) rows."""
    groups = {}
    for at, (i, text) in enumerate(rows):
        own = "".join(c for c in text or "" if c not in " \t\n\v\f\r")
        groups.setdefault(own, []).append((-len(text or ""), i is None, i, at))
    out = []
    for own, members in groups.items():
        best = min(members, key=lambda m: (m[0], m[1], m[2] or 0, m[3]))
        sha = hashlib.sha256(own.encode()).hexdigest()
        out += [(m[2], best[2], len(members), (m[0], m[2]) == (best[0], best[2]), sha) for m in members]
    return out


def plain(rows):
    return sorted(([tuple(r) for r in rows]), key=str)


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 5000), min_size=1, max_size=300), st.integers(1, 400))
def test_golomb_round_trip(values, m):
    values = np.array(sorted(values))
    assert exact_dedup.golomb_decode(exact_dedup.golomb_encode(values, m), len(values), m).tolist() == values.tolist()


def test_golomb_is_short():
    rng = np.random.default_rng(3)
    values = np.unique(rng.integers(0, 1 << 34, 20_000))
    m = exact_dedup.parameter((1 << 34) / len(values) - 1)
    blob = exact_dedup.golomb_encode(values, m)
    assert exact_dedup.golomb_decode(blob, len(values), m).tolist() == values.tolist()
    # the best of any code is log2(gap) + 1.44 bits a number
    assert 8 * len(blob) / len(values) < np.log2((1 << 34) / len(values)) + 1.6


def test_messages_lie_in_their_owners_ranges():
    prints = np.unique(np.random.default_rng(5).integers(0, 1 << 20, 1000))
    got = []
    for owner, first, count, m, blob in exact_dedup.messages(prints, 20, 3):
        own = exact_dedup.golomb_decode(blob, count, m) + (owner << 17)
        assert own.tolist() == prints[first : first + count].tolist() and (own >> 17 == owner).all()
        got += own.tolist()
    assert got == prints.tolist()


def test_query(documents, folder, spark):
    got = op12_golomb_exchange(spark, folder(documents=documents))
    assert [c for c, _ in got.dtypes] == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    rows = got.collect()
    want = brute(TEXTS)
    # of the two rows with id 5 and one text, one stays
    assert plain(r[:3] + r[4:] for r in map(tuple, rows)) == plain(r[:3] + r[4:] for r in want)
    assert sum(r.kept for r in rows) == len({r[4] for r in want})
    assert all(r.doc_id == r.keep_id for r in rows if r.kept)


def test_empty_table(no_documents, folder, spark):
    assert op12_golomb_exchange(spark, folder(documents=no_documents)).collect() == []


@pytest.mark.parametrize(("rows", "size"), [(1 << 16, 32 << 20), (3, 32 << 20), (1 << 16, 500)])
def test_many_senders_and_hot_texts(spark, monkeypatch, rows, size):
    """A text that is a third of all rows, groups of two, and texts that differ in blanks alone."""
    monkeypatch.setattr(exact_dedup, "MOST_ROWS", rows)
    monkeypatch.setattr(exact_dedup, "MOST_BYTES", size)
    texts = [(i, f"{'\t' * (i % 5)}the hot text") for i in range(100)]
    texts += [(100 + i, f"word {i // 2}{' ' * (i % 2)}") for i in range(100)]
    texts += [(200 + i, f"alone {i}") for i in range(98)] + [(298, LONG), (299, LONG + "\n")]
    df = spark.createDataFrame(texts, "n long, body string").repartition(6)
    got = exact_dedup.groups(df, "n", "body").collect()
    assert plain(got) == plain(brute(texts))


def test_fingerprints_that_collide_are_told_apart_by_bytes(spark, monkeypatch):
    """With fingerprints of a few bits nearly all texts are suspect; the groups stay the same."""
    monkeypatch.setattr(exact_dedup, "plan", lambda n, partitions: (3, 2))
    texts = [(i, f"text {i % 40}") for i in range(120)]
    got = exact_dedup.groups(spark.createDataFrame(texts, "doc_id long, text string").repartition(5), "doc_id", "text").collect()
    assert plain(got) == plain(brute(texts))


def test_one_digest_for_two_texts_is_an_error(spark, monkeypatch):
    """Digests are the identity of a group only where its bytes are equal: else the run says so."""
    monkeypatch.setattr(exact_dedup, "digest", lambda body: bytes([7] * 31) + bytes([len(body) % 2]))
    df = spark.createDataFrame([(i, "x" * i) for i in range(8)], "doc_id long, text string").repartition(4)
    with pytest.raises(Exception, match="share a SHA-256"):
        exact_dedup.groups(df, "doc_id", "text").collect()


def test_texts_stay_in_their_buckets(spark, monkeypatch):
    """Only bitmaps are shuffled to the senders: the join reads the texts' buckets in place."""
    plans = []
    real = exact_dedup.materialise

    def watch(df, name="t"):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return real(df, name)

    monkeypatch.setattr(exact_dedup, "materialise", watch)
    exact_dedup.groups(spark.createDataFrame([(i, f"t{i % 9}") for i in range(60)], "doc_id long, text string").repartition(4), "doc_id", "text").collect()
    marked = dict(plans)["marked"]
    assert "Bucketed: true" in marked and marked.count("Exchange") <= 1
