import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from dendrospark.llm import packing
from dendrospark.llm.entry import VOCABULARY, op2_cost_packing

from .conftest import TEXTS


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2047), max_size=60))
def test_assignment_covers_every_token_once(lengths):
    placed = packing.assign(lengths)
    for item, n in enumerate(lengths):
        spans = sorted((s, k) for i, s, k, _ in placed if i == item)
        assert sum(k for _, k in spans) == n
        assert all(a + k == b for (a, k), (b, _) in zip(spans, spans[1:], strict=False))
    used = Counter()
    for _, _, n, at in placed:
        used[at] += n
    assert all(v <= packing.ROOM for v in used.values())
    assert sum(v < packing.ROOM for v in used.values()) <= 1


def test_costs_are_balanced():
    rng = np.random.default_rng(2)
    lengths = rng.integers(10, 400, 2000).tolist()
    spent = defaultdict(float)
    for _, _, n, at in packing.assign(lengths):
        spent[at] += packing.cost(n)
    full = sorted(spent.values())[1:]
    assert max(full) < 1.35 * (sum(full) / len(full))


def test_ids_are_those_of_the_tokenizers_library(spark, documents, folder):
    """The rank file gives the ids of the vocabulary's own library, and every id lies in one piece."""
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = op2_cost_packing(spark, folder(documents=documents)).collect()
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id, r.doc_tokens].append(r)
    for (i, text), times in Counter(TEXTS).items():
        ids = [*own.encode(text or "", add_special_tokens=False).ids, 1]
        pieces = sorted(by_doc[i, len(ids)], key=lambda r: r.start)
        covered = Counter()
        for p in pieces:
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
            covered.update(range(p.start, p.start + p.length))
        same = sum(n for (j, t), n in Counter(TEXTS).items() if j == i and t == text)
        assert covered == Counter({k: same for k in range(len(ids))}) and times == same
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for spans in sequences.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= packing.ROOM


def test_added_tokens_are_one_id(spark):
    """Strings of the vocabulary's added tokens become their id, as in the library."""
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    mark = "<|endoftext|>"
    texts = [f"a {mark} b", mark, mark * 3, f" {mark}  x", f"one\n \n{mark}\n two  {mark}", "<|endoftext|", f"<{mark}>", f"\u00e9{mark}\U0001f600"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = packing.pack_documents(docs, "text", ["doc_id"], *VOCABULARY).collect()
    assert own.encode(texts[0], add_special_tokens=False).ids.count(50256) == 1
    for i, text in enumerate(texts):
        ids = [*own.encode(text, add_special_tokens=False).ids, 1]
        pieces = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        assert [p.doc_tokens for p in pieces] == [len(ids)] * len(pieces) and sum(p.length for p in pieces) == len(ids)
        assert all(p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes()) for p in pieces)


def test_many_buckets(spark, documents):
    out = packing.pack_documents(documents, "text", ["doc_id"], *VOCABULARY, bucket_rows=2).collect()
    seen = Counter((r.sequence_id, o) for r in out for o in range(r.offset, r.offset + r.length))
    assert max(seen.values()) == 1


def test_empty_table(spark, no_documents, folder):
    assert op2_cost_packing(spark, folder(documents=no_documents)).count() == 0
