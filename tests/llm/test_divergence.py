import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from dendrospark.llm import divergence
from dendrospark.llm.entry import op13_shard_divergence

from .conftest import CLASHING, TEXTS

LOWER = {65 + i: 97 + i for i in range(26)}


def terms(text):
    return [t.translate(LOWER) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def brute(rows, top=200):
    """(lang, source, part, item, value, rank) of (text, lang, source) rows."""
    rows = [(t or "", g or "", s or "") for t, g, s in rows]
    out = []
    for lang in {g for _, g, _ in rows}:
        own = [(terms(t), s) for t, g, s in rows if g == lang]
        docs = Counter(x for words, _ in own for x in set(words))
        kept = {t for t, n in docs.items() if n >= 3}
        counts = {s: Counter() for _, s in own}
        for words, s in own:
            counts[s].update(w for w in words if w in kept)
        whole = sum(counts.values(), Counter())

        def share(c, t):
            return 1 + 1_000_000_000 * (c[t] + 1) // (sum(c.values()) + len(kept))  # noqa: B023

        def ranked(part, source, items):
            for rank, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))):
                if part == "pair" or rank < top:
                    out.append((lang, source, part, item, value, rank + 1))  # noqa: B023

        for s, c in counts.items():
            ranked("pair", s, [(o, sum((share(c, t) - share(d, t)) ** 2 // share(d, t) for t in kept)) for o, d in counts.items() if o != s])
            ranked("term", s, [(t, (share(c, t) - share(whole, t)) ** 2 // share(whole, t)) for t in kept if c[t] and share(c, t) > share(whole, t)])
    return sorted(out)


def table(spark, rows):
    data = [(i, t, g, s, 0, *["x"] * 7, 0.5, "x", "x") for i, (t, g, s) in enumerate(rows)]
    return spark.createDataFrame(data, f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}").repartition(3)


WORDS = ["a", "B", "b", "cé", "dÉ", "don't", "x1y", "ünï", "the", "and so", "日本"]
MIXED = [(" ".join(WORDS[(i * j + j) % len(WORDS)] for j in range(1, 2 + i % 7)), ["en", "de", None][i % 3], ["s0", "s1", "s0", "s2", None, ""][i % 6]) for i in range(60)]
EDGES = [(t, "en", f"s{n % 3}") for n, (_, t) in enumerate(TEXTS)] + [(None, None, None), ("", "xx", "empty"), ("once", "yy", "a"), ("once", "yy", "b")]


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("aBé[`{@Z \x7f\x80 \n9_日"), max_size=60), st.integers(1, 9))
def test_terms(text, size):
    found = [w for p in divergence.pieces(text.encode(), size) for w in p.split()]
    assert [w.decode() for w in found] == terms(text)


@pytest.mark.parametrize("rows", [MIXED, EDGES, MIXED * 4 + EDGES])
def test_query(spark, folder, rows):
    got = op13_shard_divergence(spark, folder(documents=table(spark, rows)))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_empty_table(spark, folder):
    assert op13_shard_divergence(spark, folder(documents=table(spark, MIXED).limit(0))).collect() == []


def test_small_shards_flushes_and_ranks(spark, monkeypatch):
    """The same rows whatever the number of shards and however often a task gives out its counts."""
    monkeypatch.setattr(divergence, "SHARD", 3)
    monkeypatch.setattr(divergence, "HELD", 40)
    monkeypatch.setattr(divergence, "SLICE", 30)
    monkeypatch.setattr(divergence, "PIECE", 7)
    got = divergence.audit(table(spark, MIXED), top=2).collect()
    assert sorted(map(tuple, got)) == brute(MIXED, 2)


def test_a_hot_source(spark):
    rows = MIXED + [("the hot words of a third of all rows", "en", "s0")] * 40
    assert sorted(map(tuple, divergence.audit(table(spark, rows)).collect())) == brute(rows)


@pytest.mark.parametrize("spare", [-1, 0, 8])
def test_leading_terms_that_shards_give_out_later(spark, monkeypatch, spare):
    """The same rows if a shard gives out fewer terms of a group than lead there."""
    monkeypatch.setattr(divergence, "SPARE", spare)
    monkeypatch.setattr(divergence, "SMALL", 1)
    named = {}
    own = divergence.materialise
    monkeypatch.setattr(divergence, "materialise", lambda df, name: named.setdefault(name, own(df, name)))
    rows = [(" ".join(f"{'abcdefghij'[i % 10]}{'klmnopqrst'[j % 10]}{'uvwxyz'[j % 6]}" for j in range(30 + i % 9)), "en", f"s{i % 3}") for i in range(90)]
    rows += [("q" + " q".join("abcdefghijklmnopqrstuvwxyz"), "de", "only"), *[("x", "de", "other")] * 3] * 3
    got = divergence.audit(table(spark, rows), top=8).collect()
    assert sorted(map(tuple, got)) == brute(rows, 8)
    shards = named["kept"].select("shard").distinct().count()
    groups = named["groups"].count()
    given = named["sums"].where("part = 'term'").count()
    assert given <= shards * groups * min(8, 2 + spare)
    assert ("more" in named) == (spare < 8)
