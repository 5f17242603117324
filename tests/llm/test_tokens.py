import hashlib
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from dendrospark.llm import tokens
from dendrospark.llm.entry import op7_overlap_bpe

from .conftest import TEXTS

RANKS = tokens.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
WHOLE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
CODE = tokens.Coder(RANKS, public_tokenizers.PATTERN)


def facts(text):
    ids = WHOLE.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_query_against_the_library(spark, documents, folder):
    out = op7_overlap_bpe(spark, folder(documents=documents)).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out) == Counter((i, *facts(t)) for i, t in TEXTS)


@pytest.mark.parametrize(("size", "overlap"), [(64, 16), (200, 40), (1000, 8)])
def test_small_chunks(spark, size, overlap):
    texts = ["a b  c\n\n d\te'll " * 30, "word" * 200, "  \n" * 90, "x" * 500 + " y" * 90, "'s't've 12 345é€ " * 25, "tail   "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = tokens.encode_documents(df, "text", ["doc_id"], RANKS, public_tokenizers.PATTERN, size, overlap).collect()
    assert {r.doc_id: r.ids for r in out} == {i: WHOLE.encode_ordinary(t) for i, t in enumerate(texts)}
    assert {r.doc_id: bytes(r.decoded).decode() for r in out} == dict(enumerate(texts))


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab'lsv 1\n\té.!\u3000"), max_size=120), st.integers(1, 119))
def test_boundaries_agree_after_the_first_shared_one(text, cut):
    """What stitching relies on: from a shared boundary on, both chunks go on alike."""
    start = min(cut, len(text))
    ends, at = [], 0
    for p in CODE.pieces(text):
        at += len(p)
        ends.append(at)
    later, at = [], start
    for p in CODE.pieces(text[start:]):
        at += len(p)
        later.append(at)
    joint = tokens.first_common([e for e in ends if e > start], later, len(text))
    if joint is not None:
        assert [e for e in ends if e >= joint] == [e for e in later if e >= joint]


def test_chunks_cover():
    for n in (0, 1, 99, 100, 101, 1000):
        bounds = tokens.chunk_bounds(n, 100, 20)
        assert bounds[0][0] == 0 and bounds[-1][1] == n
        assert all(b[0] < a[1] for a, b in zip(bounds, bounds[1:], strict=False))


def test_empty_table(spark, no_documents, folder):
    assert op7_overlap_bpe(spark, folder(documents=no_documents)).count() == 0
