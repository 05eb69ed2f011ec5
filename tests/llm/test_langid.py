import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelloom.llm import langid

VOCAB = {"aa": "the of and to in that is was for with", "bb": "der die und in den von zu das mit sich", "cc": "le de un être et à il avoir ne je", "dd": "el la de que y a en un ser se", "ee": "il di che è la un a per una mi", "ff": "и в не на я быть он с что а"}


def docs(spark, n=600, langs=6):
    r = random.Random(1)
    rows = []
    for i in range(n):
        k = sorted(VOCAB)[i % langs]
        rows.append((i, " ".join(r.choice(VOCAB[k].split()) for _ in range(r.randrange(8, 60))), k, "x"))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, Score string")


@pytest.mark.parametrize("langs", [2, 4, 6])
def test_held_out_accuracy(spark, langs):
    d = docs(spark, langs=langs)
    x = langid.digests(d).join(d.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in x)
    held = [r for r in x if r.held_out]
    assert len(held) > 80 and np.mean([r.lang_pred == r.lang for r in held]) > 0.97


def test_held_out_labels_are_not_used(spark):
    d = docs(spark)
    wrong = d.withColumn("lang", F.when(langid.held_out(), "zz").otherwise(F.col("lang")))
    a, b = (sorted(map(tuple, langid.digests(x).collect())) for x in (d, wrong))
    assert a == b


def test_edges(spark):
    d = docs(spark, 200, 3)
    model = langid.trained_on_rest(d)
    odd = spark.createDataFrame([(None, None), (1, ""), (2, "123 ***\n"), (3, "the and of"), (3, "the and of"), (4, "der und " * 200_000), (5, "é")], "doc_id long, text string")
    x = langid.identify(odd, model)
    assert x.columns == ["doc_id", "text", "lang_pred", "score", "ambiguous"]
    got = x.collect()
    assert [r.lang_pred for r in got[:3]] == ["und"] * 3 and [r.score for r in got[:3]] == [0.0] * 3
    assert got[3][2:] == got[4][2:] and got[3].lang_pred == "aa" and got[5].lang_pred == "bb" and got[6].lang_pred != "und"
    assert langid.keep_identified(odd, model).columns == odd.columns and langid.keep_identified(odd, model).count() == 4
    none = d.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.digests(none).collect()} == {"und"}
    one = d.withColumn("lang", F.lit("qq"))
    assert {(r.lang_pred, r.score) for r in langid.digests(one).collect()} == {("qq", 1.0)}
    assert langid.digests(d.limit(0)).count() == 0
    assert langid.identify(docs(spark, 30), model).columns == ["doc_id", "text", "lang", "lang_pred", "score", "ambiguous"]


def test_codewords_lie_apart():
    for n in (2, 3, 4, 5, 8, 20):
        c = langid.codewords(n)
        apart = (c.shape[1] - c @ c.T)[np.triu_indices(n, 1)] / 2
        assert apart.min() >= (1 if n == 2 else c.shape[1] / 4)


def test_profile_does_not_depend_on_blocks():
    data = np.frombuffer(("Grüße an alle, " * 50).encode(), np.uint8)
    whole = langid.profile(data)
    old, langid._BLOCK = langid._BLOCK, 7
    try:
        assert np.array_equal(langid.profile(data), whole)
    finally:
        langid._BLOCK = old


def test_copies_do_not_use_up_the_sample(spark, monkeypatch):
    word = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(3))
    rows = [(i, "the same text", "aa") for i in range(1900)]
    rows += [(2000 + i, f"the text of {word(i)}", "aa") for i in range(100)] + [(3000 + i, f"der text {word(i)}", "bb") for i in range(500)]
    seen = []
    monkeypatch.setattr(langid, "fit", lambda x, y: seen.extend(zip(y, map(bytes, x))))
    langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_rows=100)
    for label in ("aa", "bb"):
        mine = [v for k, v in seen if k == label]
        assert 30 <= len(set(mine)) and len(mine) <= 75
    assert langid.MAX_ROWS == 2000


def brute_decode(model, x):
    """The nearest codeword of each row by its summed loss, one number at a time."""
    out = []
    for row in x:
        margins = [float(sum(float(a) * float(b) for a, b in zip(row, model.weights[:-1, k]) if a)) + float(model.weights[-1, k]) for k in range(model.code.shape[1])]
        loss = [sum(float(t) * np.log1p(np.exp(-m * float(c))) for m, c, t in zip(margins, word, model.trust)) for word in model.code]
        best = min(range(len(loss)), key=lambda k: loss[k])
        sharp = [np.exp(-(v - loss[best]) * model.code.shape[1]) for v in loss]
        out.append((model.labels[best], 1 / sum(sharp), sorted(loss)[1] - loss[best]))
    return out


def test_decoding_against_brute_force(spark):
    d = docs(spark, 240, 6)
    model = langid.trained_on_rest(d)
    some = d.filter("doc_id % 3 = 0")
    got = {r.doc_id: r for r in langid.identify(some, model).collect()}
    rows = some.collect()
    x = np.stack([langid.profile(np.frombuffer(r.text.encode(), np.uint8)) for r in rows])
    for r, (label, score, gap) in zip(rows, brute_decode(model, x)):
        assert got[r.doc_id].lang_pred == label and got[r.doc_id].score == pytest.approx(score, rel=1e-3)
        assert got[r.doc_id].ambiguous == (gap < langid.NEAR) or abs(gap - langid.NEAR) < 1e-4


def test_codewords_are_far_apart():
    for n in range(2, 13):
        code = langid.codewords(n)
        apart = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
        assert set(np.unique(code)) <= {-1, 1} and min(apart) >= max(1, code.shape[1] // 4)


def test_more_labels_than_rows(spark):
    d = docs(spark, 300, 6)
    model = langid.train(d, max_rows=3)
    assert model.labels == sorted(VOCAB)
    assert langid.digests(d.limit(0)).count() == 0
