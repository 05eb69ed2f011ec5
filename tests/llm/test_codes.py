import hashlib
import math

import numpy as np
import pytest

from pixelloom.llm import codes


def brute(rows, parts=16, entries=64, rounds=2):
    """The contract by full scans. rows: (vec_id, vector, label)."""
    kept = [(i, np.array([math.floor(256 * x) for x in v], object), m) for i, v, m in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    x = np.array([v for _, v, _ in kept]).astype(np.int64).reshape(len(kept), parts, -1)
    first = {}
    for (i, v, _), y in zip(kept, x):
        if i is not None:
            first[i] = min(first[i], y.ravel().tolist()) if i in first else y.ravel().tolist()
    book = np.array([first[i] for i in sorted(first)[:entries]]).reshape(-1, parts, x.shape[2]).transpose(1, 0, 2).copy()

    def nearest():
        d = ((x[:, :, None, :] - book[None]) ** 2).sum(3)
        return d.argmin(2), d.min(2)

    for _ in range(rounds):
        code, _ = nearest()
        new = book.copy()
        for p in range(parts):
            for e in range(book.shape[1]):
                own = x[code[:, p] == e, p]
                if len(own):
                    new[p, e] = own.sum(0) // len(own)
        book = new
    code, d = nearest()
    error = d.sum(1).tolist()
    of = {}
    for (_, _, m), e in zip(kept, error):
        of[m] = of.get(m, 0) + e
    digest = hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()
    return [(i, "".join(f"{c:02x}" for c in own), e, of[m], digest) for (i, _, m), own, e in zip(kept, code.tolist(), error)]


key = lambda r: (-1 if r[0] is None else r[0], r[1:])


def test_against_full_scans(spark, monkeypatch):
    monkeypatch.setattr(codes, "ROWS", 100)
    rng = np.random.default_rng(0)
    hubs = rng.normal(size=(9, 32))
    rows = [(3 * i, [float(v) for v in hubs[i % 9] * 0.3 + 0.05 * rng.normal(size=32)], [None, 1, 2, 2, 2][i % 5]) for i in range(700)]
    rows += [(5000 + i, [0.25] * 32, 9) for i in range(200)]  # one common vector
    rows += [(3, rows[1][1], 1), (6, [-5.0] * 32, None), (None, [0.1] * 32, 7)]  # repeated ids, a row without one
    rows += [(1, None, 1), (4, [float("nan")] + [0.0] * 31, 1), (7, [None] * 32, 1), (10, [float("-inf")] * 32, 1), (13, [], 1)]
    df = spark.createDataFrame([(i, v, m, "x") for i, v, m in rows], "vec_id long, embedding array<float>, label int, code string")
    want = brute([(r.vec_id, r.embedding, r.label) for r in df.collect()])
    got = [tuple(r) for r in codes.digests(df).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    scans = codes.compress(df)[2]
    assert scans[0] == len(want) * 16 * codes.GROUPS and scans[1] < scans[0] and scans[2] < 0.7 * scans[0]


def test_few_and_none(spark):
    df = spark.createDataFrame([(i, [float(i)] * 16, None) for i in range(5)], "vec_id long, embedding array<double>, label int")
    got = codes.digests(df).orderBy("vec_id").collect()
    assert [(r.code, r.error, r.label_error) for r in got] == [(f"{i:02x}" * 16, 0, 0) for i in range(5)]
    assert codes.digests(df.limit(0)).count() == 0
    assert codes.digests(df.limit(0)).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    with pytest.raises(ValueError):
        codes.digests(spark.createDataFrame([(1, [0.5] * 20, 1)], "vec_id long, embedding array<double>, label int"))
    with pytest.raises(ArithmeticError):
        codes.digests(spark.createDataFrame([(1, [1e20] * 16, 1)], "vec_id long, embedding array<double>, label int"))


def test_bounds_hold_and_stamps_stay():
    """Bounds never exceed the true distances, and use the net displacement since their own round."""
    rng = np.random.default_rng(3)
    x = rng.integers(-100, 100, size=(400, 4))
    history = [rng.integers(-100, 100, size=(1, 64, 4))]
    code = low = stamp = None
    groups = np.array_split(np.arange(64), codes.GROUPS)
    for t in range(5):
        code, best, low, stamp, _ = codes.assign(x, history, code, low, stamp)
        d = ((x[:, None] - history[-1][0]) ** 2).sum(2)
        assert (code == d.argmin(1)).all() and (best == d.min(1)).all()
        lowered = low.astype(float) - codes.net_moves(history, groups)[stamp, 0, np.arange(codes.GROUPS)]
        d = np.sqrt(d)
        d[np.arange(400), code] = np.inf
        for k, g in enumerate(groups):
            assert (lowered[:, k] <= d[:, g].min(1) + 1e-9).all()
        history.append(history[-1] + rng.integers(-3, 4, size=(1, 64, 4)))
    assert len(np.unique(stamp)) > 2
    # entries that move and come back have no net displacement, while their drifts would add up
    there = [history[0], history[0] + 5, history[0]]
    assert codes.net_moves(there, groups)[0].max() == 0
