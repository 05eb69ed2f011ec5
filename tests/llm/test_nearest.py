import math
import os

import numpy as np
import pytest

from pixelloom.llm import nearest


def brute(rows, k=5):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and len(v) == 16 and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in good:
        if i % 50 == 0:
            s = sorted(((-float(np.dot(q, v) / (np.sqrt(np.dot(q, q)) * np.sqrt(np.dot(v, v)))), j) for j, v in good if j != i))[:k]
            out[i] = [(j, -t) for t, j in s]
    return out


def test_recall_and_edges(spark):
    rng = np.random.default_rng(3)
    hubs = rng.normal(size=(12, 16))
    rows = [(i, [float(x) for x in hubs[i % 12] + 0.5 * rng.normal(size=16)]) for i in range(3000)]
    rows += [(3000 + i, [1.0] * 16) for i in range(900)]  # one very common vector
    rows += [(5000, None), (5050, []), (5100, [0.0] * 16), (5150, [float("nan")] + [1.0] * 15), (5200, [None] + [1.0] * 15), (5250, [1.0] * 3), (None, [1.0] * 16), (5301, [float("inf")] * 16)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, list int")
    want = brute(rows)
    old = nearest.CELL_VECTORS, nearest.CELL_QUERIES
    nearest.CELL_VECTORS, nearest.CELL_QUERIES = 200, 20
    try:
        got = {}
        for r in nearest.search(df, lists=16, probes=6).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    finally:
        nearest.CELL_VECTORS, nearest.CELL_QUERIES = old
    assert set(got) == set(want)
    hit = sum(len({j for j, _ in got[q]} & {j for j, _ in want[q]}) for q in want)
    assert hit >= 0.95 * sum(map(len, want.values()))
    for q in got:
        assert len(got[q]) == 5
        exact = dict(brute([r for r in rows if r[0] == q or r[0] in dict(got[q])], 5)[q])
        for j, s in got[q]:
            assert abs(exact[j] - s) < 1e-12
    assert [j for j, _ in got[3000]] == [3001, 3002, 3003, 3004, 3005]


def test_all_lists_is_exact(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=16)]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = brute([(r.vec_id, r.embedding) for r in df.collect()])
    got = {}
    for r in nearest.search(df, lists=8, probes=8, eps=50.0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {q: [j for j, _ in v] for q, v in want.items()}


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_recall_with_production_settings(spark, size):
    path = f"/root/testdata/{size}/embeddings.parquet"
    if not os.path.exists(path):
        pytest.skip("no tables")
    df = spark.read.parquet(path)
    x = df.select("vec_id", "embedding").toArrow()
    ids, v = x.column(0).to_numpy(), nearest.unit(np.array(x.column(1).to_pylist(), float))
    got = {}
    for r in nearest.search(df).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = 0
    for i in np.flatnonzero(ids % 50 == 0):
        s = v @ v[i]
        s[ids == ids[i]] = -2
        hit += len(got[int(ids[i])] & set(ids[np.argsort(-s)[:5]].tolist()))
    assert hit >= 0.9 * 5 * len(got) and len(got) == (ids % 50 == 0).sum()


def test_probes_follow_the_data():
    rng = np.random.default_rng(1)
    hubs = nearest.unit(rng.normal(size=(40, 32)))
    close = nearest.unit(hubs[np.arange(4000) % 40] + 0.05 * rng.normal(size=(4000, 32)))
    loose = nearest.unit(rng.normal(size=(4000, 32)))
    few, most = (nearest.probes_for(x, np.arange(4000), nearest.kmeans(x, 40), 5) for x in (close, loose))
    assert few <= 4 and most > 10


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 2.0]), (2, [3.0, 0.0])], "vec_id long, embedding array<double>")
    assert [(r["rank"], r.vec_id, r.score) for r in nearest.search(df).orderBy("rank").collect()] == [(1, 2, 1.0), (2, 1, 0.0)]
    assert nearest.search(df.limit(0)).count() == 0
    assert nearest.search(df.filter("vec_id = 0")).count() == 0
    assert nearest.search(df.filter("vec_id > 0")).count() == 0


def test_repeated_queries_are_one_question(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(v) for v in rng.normal(size=16)]) for i in range(40)]
    rows += [rows[0], (0, [9.0] * 16), rows[10]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.query_id, r["rank"], r.vec_id) for r in nearest.search(df).orderBy("query_id", "rank").collect()]
    asked = min((np.array(v, "<f8").tobytes(), v) for i, v in rows if i == 0)[1]
    want = sorted((-float(np.dot(asked, v) / np.linalg.norm(asked) / np.linalg.norm(v)), i) for i, v in rows if i != 0)[:5]
    assert got == [(0, k + 1, i) for k, (_, i) in enumerate(want)]


@pytest.mark.parametrize("spread", [0.3, None])
def test_many_vectors_with_a_small_sample(spark, spread, monkeypatch):
    """Centres in two levels, bounds that fall: recall at the settings of the query but for the sample's size."""
    monkeypatch.setattr(nearest, "A_LIST", 4)
    rng = np.random.default_rng(9)
    n, d = 20_000, 32
    x = rng.normal(size=(n, d)) if spread is None else rng.normal(size=(200, d))[rng.integers(200, size=n)] + spread * rng.normal(size=(n, d))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(8)
    asked, got = len(range(0, n, 50)), {}
    for r in nearest.search(df, sample=400).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    u = nearest.unit(x)
    hit = 0
    for q in range(0, n, 50):
        s = u @ u[q]
        s[q] = -2
        hit += len(got[q] & set(np.argsort(-s)[:5].tolist()))
    assert len(got) == asked and hit >= 0.9 * 5 * asked


def test_more_lists_than_the_sample_gives(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = nearest.unit(rng.normal(size=(50, 8))[rng.integers(50, size=6000)] + 0.1 * rng.normal(size=(6000, 8)))
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, v array<double>")
    few, many = nearest.all_centres(rows, x[:160], 10, 6000), nearest.all_centres(rows, x[:160], 77, 6000)
    assert len(few) == 10 and 60 <= len(many) <= 160


def test_bounds_fall():
    bound, best = nearest.lowered(np.array([5.0, 5.0, 1.0]), np.full((3, 2), np.inf), np.array([0, 0, 0, 1]), np.array([3.0, 1.0, 2.0, 4.0]))
    assert bound.tolist() == [2.0, 5.0, 1.0] and best[0].tolist() == [1.0, 2.0]
    bound, best = nearest.lowered(bound, best, np.array([1]), np.array([2.0]))
    assert bound.tolist() == [2.0, 4.0, 1.0]


def recall(x, got):
    u, hit = nearest.unit(x), 0
    for q in range(0, len(x), 50):
        s = u @ u[q]
        s[q] = -2
        hit += len(got.get(q, set()) & set(np.argsort(-s)[:5].tolist()))
    return hit / 5 / len(range(0, len(x), 50))


@pytest.mark.parametrize("kind", ["loose", "apart"])
def test_recall_where_the_nearest_list_holds_few(spark, kind):
    """loose: queries find fewer than k within their bound in the nearest list, which must not bound the others by 0. apart: rows in tight clusters, queries unlike them."""
    rng = np.random.default_rng(5)
    n, d = 6000, 64
    x = rng.normal(size=(n, d))
    if kind == "apart":
        rest = np.arange(n) % 50 != 0
        x[rest] = (rng.normal(size=(60, d))[np.arange(n) % 60] + 0.05 * rng.normal(size=(n, d)))[rest]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = {}
    for r in nearest.search(df, sample=2400).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert recall(x, got) >= 0.93
