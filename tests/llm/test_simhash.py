from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from dendrospark.llm import simhash
from dendrospark.llm.entry import op9_simhash_gray

from .conftest import TEXTS


def plain(text):
    words = [w for w in "".join(c if c not in " \t\n\v\f\r" else "\n" for c in text or "").translate({65 + i: 97 + i for i in range(26)}).split("\n") if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(codes):
    """code -> least member of its component."""
    codes = sorted(set(codes))
    label = {c: c for c in codes}
    while True:
        moved = False
        for a in codes:
            for b in codes:
                if (a ^ b).bit_count() <= 4 and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    moved = True
        if not moved:
            return label


@settings(max_examples=80, deadline=None)
@given(st.text(st.sampled_from("AbCé \n\t\u00a0x"), max_size=80))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain(text)


def test_gray_rank_follows_the_sequence():
    n = np.arange(512, dtype=np.uint64)
    assert simhash.gray_rank(n ^ (n >> np.uint64(1))).tolist() == n.tolist()


def clustered(rng, n, groups=40):
    base = rng.integers(0, 2**63, groups, np.uint64) * np.uint64(2)
    codes = base[rng.integers(0, groups, n)]
    for _ in range(5):
        codes = codes ^ (np.uint64(1) << rng.integers(0, 64, n, np.uint64)) * rng.integers(0, 2, n, np.uint64)
    return np.unique(codes)


def test_cells_that_share_a_group_share_its_edges():
    # 2,000 near copies in 25 cells, each of which has three fifths of them
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 1, np.uint64)
    codes = np.unique(base ^ (np.uint64(1) << rng.integers(0, 64, 4000, np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 4000, np.uint64)))
    seen = set()
    for _ in range(25):
        some = codes[rng.random(len(codes)) < 0.6]
        child, parent = (x.tolist() for x in simhash.cell_edges(some, 4))
        assert sorted(child) != sorted(some.tolist()) and len(set(child)) == len(child) == len(some) - 1
        above = dict(zip(child, parent, strict=True))
        assert len({above.get(above.get(c, c), above.get(c, c)) for c in some.tolist()}) == 1  # two levels
        assert max(Counter(parent).values()) <= 4 * len(some) ** 0.5
        seen |= set(zip(child, parent, strict=True))
    assert len(seen) <= 6 * len(codes)


@pytest.mark.parametrize("radius", [0, 4, 16])
@pytest.mark.parametrize("n", [0, 1, 2, 7, 9, 65, 400, 1500])
def test_links_of_a_cell_against_all_pairs(n, radius):
    codes = clustered(np.random.default_rng(n), n) if n else np.zeros(0, np.uint64)
    codes = codes[np.argsort(simhash.gray_rank(codes), kind="stable")]
    got = sorted((int(a), int(b)) for x, y in simhash.linked(codes, radius) for a, b in zip(x, y, strict=True)) if n > 1 else []
    want = [(i, j) for i, c in enumerate(codes) for j in (i + 1 + np.flatnonzero(np.bitwise_count(codes[i + 1 :] ^ c) <= radius)).tolist()]
    assert got == want


def test_bands_meet_at_the_similarity():
    """Sets at 0.8 share a band, sets at 0.2 hardly ever; few share all."""
    rng = np.random.default_rng(3)
    met = {0.8: 0, 0.2: 0}
    for share in met:
        for _ in range(300):
            common = round(180 * share)
            drawn = rng.integers(0, 2**63, 180, np.uint64)
            rest = (180 - common) // 2
            a, b = drawn[: common + rest], np.concatenate([drawn[:common], drawn[common + rest :]])
            met[share] += bool(np.isin(simhash.bands(a), simhash.bands(b)).any())
    assert met[0.8] == 300 and met[0.2] < 30
    assert len(simhash.bands(drawn)) == simhash.BANDS == len(set(simhash.bands(drawn).tolist())) and not len(simhash.bands(drawn[:0]))


def test_blocks_leave_pairs_together():
    """Codes at four bits or fewer agree in a table's key, whatever the number of blocks."""
    assert simhash.blocks_for(1000) == 5 and simhash.blocks_for(10**9) > 5


def table(spark, texts):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in texts], "doc_id long, text string, fingerprint string, label string").repartition(3)


def check(spark, rows, got):
    want = {i: plain(t) for i, t in rows}
    label = brute(want.values())
    least = {}
    for i, t in rows:
        if i is not None:
            c = label[plain(t)]
            least[c] = min(least.get(c, i), i)
    expected = Counter((i, f"{plain(t):016x}", least.get(label[plain(t)])) for i, t in rows)
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == expected


def test_query_on_edge_cases(spark, folder, documents, no_documents):
    check(spark, TEXTS, op9_simhash_gray(spark, folder(documents=documents)).collect())
    assert op9_simhash_gray(spark, folder(documents=no_documents)).count() == 0


def test_query_on_near_copies(spark, folder):
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(150):
        if i % 3 == 0 or not rows:
            text = " ".join(rng.choice(words, rng.integers(3, 120)))
        else:
            parts = rows[rng.integers(len(rows))][1].split()
            parts[rng.integers(len(parts))] = str(rng.choice(words))
            text = " ".join(parts)
        rows.append((1000 - i, text))
    check(spark, rows, op9_simhash_gray(spark, folder(documents=table(spark, rows))).collect())


@pytest.mark.parametrize("blocks", [5, 6, 7])
def test_chains_and_hot_keys(spark, monkeypatch, blocks):
    """A long chain of codes two bits apart, many near copies of one code, and strangers."""
    monkeypatch.setattr(simhash, "LEAST_CELL", 8)
    monkeypatch.setattr(simhash, "MOST_CELL", 8)
    monkeypatch.setattr(simhash, "blocks_for", lambda n, *_: blocks)
    rng = np.random.default_rng(9)
    chain = [0]
    for k in range(0, 60, 2):
        chain.append(chain[-1] ^ 3 << k)
    near = [0xF0F0F0F0F0F0F0F0 ^ 1 << a ^ 1 << b for a in range(12) for b in range(a)]
    codes = sorted({*chain, *near, *(int(x) for x in rng.integers(0, 2**63, 50))})
    signed = [(c - (c >> 63 << 64),) for c in codes]
    df = spark.createDataFrame(signed, "fingerprint long")
    nodes = df.selectExpr("fingerprint AS node", "fingerprint AS own")
    got = {r.node: r.label for r in simhash.spread(simhash.links(df), nodes).collect()}
    label = brute(codes)
    groups = {}
    for c in codes:
        groups.setdefault(label[c], []).append(c - (c >> 63 << 64))
    for members in groups.values():
        if len(members) > 1:
            assert {got[m] for m in members} == {min(members)}
        else:
            assert members[0] not in got
