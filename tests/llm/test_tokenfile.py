import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pixelloom.llm import tokenfile

PATH = public_tokenizers.path("byte_bpe_50k.json")
WHOLE = Tokenizer.from_file(PATH)
WHOLE.encode_special_tokens = True
CACHED = tokenfile.WordEncoder(PATH, plain=True)


@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=70))
def test_coding_round_trip(values):
    control, data = tokenfile.pack(np.array(values, np.uint32))
    got = tokenfile.unpack(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), len(values))
    assert got.tolist() == values
    assert len(control) == -(-len(values) // 4)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"ab1'.st,\n\t\r é漢😀\x0b\xa0　\x1c ", " ", " ", "<|endoftext|>"]), max_size=40).map("".join), max_size=4))
def test_cached_words_equal_whole(texts):
    got = CACHED.encode(texts)
    for t, g in zip(texts, got):
        assert np.frombuffer(g, CACHED.dtype).tolist() == WHOLE.encode(t, add_special_tokens=False).ids


def test_files(spark, tmp_path):
    texts = ["one two", None, "", "one two", "naïve café\n" * 3000, " lead", "x  y <|endoftext|>"]
    docs = spark.createDataFrame([(i * 7 % 5 + i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, IDS int")
    old, tokenfile.FILE_IDS = tokenfile.FILE_IDS, 5
    try:
        files = tokenfile.write(docs, f"file://{tmp_path}/t", PATH, plain=True)
    finally:
        tokenfile.FILE_IDS = old
    rows = {r.doc_id: r for r in tokenfile.read(files).collect()}
    start = 0
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        ids = WHOLE.encode(r.text or "", add_special_tokens=False).ids + [2]
        raw = np.array(ids, "<u4").tobytes()
        got = rows[r.doc_id]
        assert (got.start, got.n_tokens, got.ids_crc32, bytes(got.ids)) == (start, len(ids), zlib.crc32(raw), raw)
        start += len(ids)
    assert sum(r.n_ids for r in files.collect()) == start
    assert tokenfile.digests(docs.limit(0), PATH).count() == 0
    odd = spark.createDataFrame([(None, "a"), (None, None), (3, "b"), (3, "b")], "doc_id long, text string")
    assert [(r.doc_id, r.start) for r in tokenfile.digests(odd, PATH).orderBy("start").collect()] == [(None, 0), (None, 1), (3, 3), (3, 5)]


LIBRARY = Tokenizer.from_file(PATH)  # nothing set


def test_query_equals_unmodified_library(spark):
    texts = ["abc <|endoftext|> def", "<|endoftext|>", "a<|endoftext|>b\n<|endoftext|> <|endoftext|>", "abc <|endoftext| > def", "abc def", None, " <|endoftext|>\n\nx", "abc <|endoftext|>, def"]
    got = sorted(tokenfile.digests(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PATH).collect())
    start = 0
    for r, t in zip(got, texts, strict=True):
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"ab1'.st,\n\t\r é漢😀\x0b\xa0　\x1c ", " ", " ", "<|endoftext|>", "<|endof"]), max_size=40).map("".join), max_size=4))
def test_added_tokens_as_the_library_finds_them(texts):
    encoder = tokenfile._encoder(PATH, False)
    for t, g in zip(texts, encoder.encode(texts)):
        assert np.frombuffer(g, encoder.dtype).tolist() == LIBRARY.encode(t, add_special_tokens=False).ids
