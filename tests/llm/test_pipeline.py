import hashlib
import os
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import tiktoken
from test_mixing import wanted
from test_ngram_join import brute as groups
from test_ngram_join import corpus
from test_secrets import TEXTS, every

import corpus_pipeline
from pixelloom.llm import bpe
from pixelloom.llm.common import scratch_root


def redacted(t):
    out, at = "", 0
    for s, _, _, e in every(t):
        if s >= at:
            out += t[at:s] + "[SECRET]"
        at = max(at, e)
    return out + t[at:]


def brute(rows):
    """(doc_id, text) -> copies, by plain Python."""
    rows = [r for r in rows if re.search(r"[^\W\d_]", r[1] or "")]
    comp = groups([(i, t) for i, t, _, _ in rows])
    rows = [(i, redacted(t), lang, s) for i, t, lang, s in rows if comp[i][1] == i]
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t, _, _ in rows}
    total = defaultdict(int)
    for i, _, _, s in rows:
        total[s] += size[i]
    goal = wanted(total)
    out = Counter()
    for s in total:
        u = int(hashlib.md5(f"6|{'n' if s is None else 's' + s}".encode()).hexdigest()[:8], 16) / 2**32
        e = goal[s] / total[s] if total[s] else 0.0
        mine = sorted((r for r in rows if r[3] == s), key=lambda r: (size[r[0]], int(hashlib.md5(str(r[0]).encode()).hexdigest()[:8], 16), r[0]))
        for k, r in enumerate(mine, 1):
            n = int(np.floor(e * k + u) - np.floor(e * (k - 1) + u))
            if n:
                out[r[0], r[1]] = n
    return out


def test_run_against_brute_force(spark, tmp_path):
    rows = [(i, t, "en" if i % 2 else None, ["a", "b", "hot", "hot", None][i % 5]) for i, t in corpus(3, 90)]
    rows += [(5000 + i, t, "de", "b") for i, t in enumerate(TEXTS)] + [(6000, "12 34 !!", "en", "a")]
    long = " ".join(f"w{i * 7919 % 5003}" for i in range(40_000)) + " token=abcdefgh"
    rows += [(6100, long, "en", "hot"), (6101, long, "de", "b"), (6102, "x" * 300_000, "en", "a")]  # very long texts, and a copy
    docs = spark.createDataFrame([(*r, len(r[1] or ""), "more") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, k0 string")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    whole = tiktoken.Encoding("whole", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path(corpus_pipeline.VOCABULARY)), special_tokens={})
    want = Counter()
    for (i, t), n in brute(rows).items():
        ids = np.array(whole.encode_ordinary(t), "<u4").tobytes()
        want[i, len(ids) // 4, ids, hashlib.sha256(ids).hexdigest(), hashlib.sha256(t.encode()).hexdigest()] = n
    assert Counter((r.doc_id, r.n_tokens, bytes(r.ids), r.ids_sha256, r.decoded_sha256) for r in got) == want
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_duplicates_leave_no_large_tables(spark, tmp_path):
    """What the join wrote of all texts' shingles is deleted before the next stage runs."""
    root = scratch_root(spark).removeprefix("file:")
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    docs = spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in corpus(4, 60)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))
    left = {f.split("-")[0] for f in set(os.listdir(root)) - before}
    assert left and not left & {"profiles", "met", "shared", "sets"}, left
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, g in groups(corpus(4, 60)).items() if g[1] == i)
