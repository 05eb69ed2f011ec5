import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from pixelloom.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = bpe.read_ranks(PATH)
WHOLE = tiktoken.Encoding("whole", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
SMALL = bpe.TreeCodec(RANKS, public_tokenizers.PATTERN, 4)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab1 9'st.,\n\t\r é漢字😀    ll've"), max_size=120))
def test_tree_equals_whole(text):
    ids = SMALL.encode(text)
    assert ids == WHOLE.encode_ordinary(text)
    assert SMALL.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["", " ", "a" * 3000, "ab " * 5000, "word\n\n  \n" * 900, "漢字" * 2000, "x1" * 3000, "don't we'll " * 700])
def test_long_texts(text):
    codec = bpe.TreeCodec(RANKS, public_tokenizers.PATTERN, 64)
    assert codec.encode(text) == WHOLE.encode_ordinary(text)


def test_query_form(spark):
    texts = ["one two", None, "", "one two", "naïve café " * 800]
    docs = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(texts)], "doc_id long, text string, IDS string")
    rows = {r.doc_id: r for r in bpe.digests(docs, PATH, public_tokenizers.PATTERN).collect()}
    for i, t in enumerate(texts):
        ids = WHOLE.encode_ordinary(t or "")
        assert rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    out = bpe.encode(docs, PATH, public_tokenizers.PATTERN)
    assert out.columns == ["doc_id", "text", "ids", "n_tokens"]
    back = bpe.decode(out, PATH, public_tokenizers.PATTERN).select("doc_id", "decoded").collect()
    assert {r.doc_id: bytes(r.decoded).decode() for r in back} == {i: t or "" for i, t in enumerate(texts)}
    assert bpe.digests(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
