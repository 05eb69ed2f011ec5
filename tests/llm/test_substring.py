import hashlib
import random
import re
from collections import defaultdict

import pyarrow as pa

from pixelloom.llm import substring
from pixelloom.llm.common import WordHasher, grams


def brute(rows):
    first = {}
    words = {}
    for i, t in rows:
        words[i] = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        for k in range(len(words[i]) - 12):
            w = tuple(words[i][k : k + 13])
            if i is not None:
                first[w] = min(first.get(w, i), i)
    out = {}
    for i, ws in words.items():
        gone = set()
        for k in range(len(ws) - 12):
            if i is not None and first[tuple(ws[k : k + 13])] < i:
                gone.update(range(k, k + 13))
        kept = " ".join(w for k, w in enumerate(ws) if k not in gone)
        out[i] = (len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def corpus(seed, n):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)] + ["é", "漢字", "x" * 300]
    passages = [[r.choice(vocab) for _ in range(r.choice([12, 13, 14, 20, 60]))] for _ in range(12)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(r.randrange(0, 6)):
            parts += r.choice(passages) if r.random() < 0.6 else [r.choice(vocab) for _ in range(r.randrange(1, 30))]
        rows.append((i * 3 % n if n % 3 else i, r.choice([" ", "\n", " \t ", "\x0b"]).join(parts)))
    rows += [(n + 1, "same " * 40), (n + 2, "same " * 14), (n + 3, None), (n + 4, ""), (n + 5, "   "), (n + 6, " ".join(passages[4] * 3)), (n + 7, rows[5][1])]
    return rows


def test_against_brute_force(spark):
    for seed, n, most in ((1, 100, 1 << 22), (2, 61, 500), (3, 40, 1)):
        rows = corpus(seed, n)
        df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, Kept string").repartition(5)
        old = substring.by_bytes.__defaults__
        substring.by_bytes.__defaults__ = (most,)
        try:
            got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.digests(df).collect()}
        finally:
            substring.by_bytes.__defaults__ = old
        assert got == brute(rows)


def test_factors_point_at_equal_words(spark):
    rows = corpus(7, 80)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    words = {i: (t or "").encode().split() for i, t in rows}
    seen = defaultdict(int)
    for r in substring.parse(df).collect():
        assert r.kept is not None
        for f in r.factors:
            assert f.length >= 13 and f.ref_doc < r.doc_id
            assert words[r.doc_id][f.start : f.start + f.length] == words[f.ref_doc][f.ref_start : f.ref_start + f.length]
            seen[f.length > 13] += 1
    assert seen[True] > 20


def test_edges(spark):
    t = " ".join(f"a{i}" for i in range(30))
    df = spark.createDataFrame([(None, t), (5, t), (5, t), (6, t), (None, None)], "doc_id long, text string")
    got = sorted(((r.doc_id or -1, r.n_removed) for r in substring.digests(df).collect()))
    assert got == [(-1, 0), (-1, 0), (5, 0), (5, 0), (6, 30)]
    assert substring.digests(df.limit(0)).count() == 0
    assert substring.parse(df).columns == ["doc_id", "text", "kept", "factors", "n_words", "n_removed"]


def test_very_long_texts(spark):
    """A long text, one that holds its second half twice, and a copy, in batches of their own and in one."""
    r = random.Random(2)
    a = [f"w{r.randrange(400)}" for _ in range(60_000)]
    b = [f"v{r.randrange(400)}" for _ in range(20_000)] + a[30_000:] + a[30_000:]
    rows = [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(a))]
    for parts in (1, 3):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        assert {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256) for x in substring.digests(df).collect()} == brute(rows)


def test_forgotten_anchors_and_windows(spark):
    """What a task has met before is only a short cut: the results are those without it."""
    rows = corpus(5, 90)
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    old = substring.SEEN, substring.by_bytes.__defaults__
    try:
        for seen in (0, 3, 1 << 20):
            substring.SEEN, substring.by_bytes.__defaults__ = seen, (700,)
            assert {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256) for x in substring.digests(df).collect()} == brute(rows)
    finally:
        substring.SEEN, substring.by_bytes.__defaults__ = old


def test_windows_that_share_half_a_hash_are_not_equal(spark):
    """Different words around one anchor, whose window hashes agree in their upper 32 bits."""
    a = "w12573 w11883 w618 w2987 w2074 w18919 w12784 w15788 w5050 w4884 w10084 w14131 w4833"
    b = "w14485 w7934 w11031 w16005 w2074 w18919 w12784 w15788 w5050 w6128 w1306 w5047 w10394"
    words = [substring.doc_words(pa.array([t]), WordHasher())[0] for t in (a, b)]
    ha, hb = (int(grams(w, 13, 13)[0]) for w in words)
    assert ha != hb and ha >> 32 == hb >> 32
    assert [substring.anchors(w)[0].tolist() for w in words] == [[4], [4]]
    df = spark.createDataFrame([(1, a), (2, b), (3, b)], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring.digests(df).collect()} == {1: 0, 2: 0, 3: 13}


def test_common_anchors(spark, monkeypatch):
    """A line that all documents have, in other contexts each time, and exact passages: whether anchors are taken for common or not, the words removed are the same."""
    r = random.Random(5)
    line = " ".join(f"line{k}" for k in range(7))
    passage = " ".join(f"pass{k}" for k in range(20))
    rows = [(i, " ".join([*(f"u{r.random()}" for _ in range(15)), line, *(f"v{r.random()}" for _ in range(15)), *([passage] if i % 3 == 0 else [])])) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    texts = df.selectExpr("doc_id as _id", "text as _text")
    few = substring.common_anchors(texts)
    monkeypatch.setattr(substring, "HEAVY", 40)
    fewer = substring.common_anchors(texts)
    monkeypatch.setattr(substring, "HEAVY", 1 << 40)
    every = substring.common_anchors(texts)
    assert 0 < len(fewer) <= len(few) <= len(every) <= 20 and len(substring.common_anchors(texts.limit(0))) == 0
    want = brute(rows)
    for heavy in (1, 40, 1 << 40):
        monkeypatch.setattr(substring, "HEAVY", heavy)
        assert {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256) for x in substring.digests(df).collect()} == want
    rows = corpus(9, 70)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256) for x in substring.digests(df).collect()} == brute(rows)
