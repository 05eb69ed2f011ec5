import math

import numpy as np
import pytest

from pixelloom.llm import negatives


def brute(rows):
    """The contract, row by row. rows: (vec_id, vector, label)."""
    kept = []
    for i, v, label in rows:
        if label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, [math.floor(256 * x) for x in v]))
    far = 1 << 62
    out = []
    for a in {i for i, *_ in kept if i is not None and i % 50 == 0}:
        _, label, v = min((i, m, x) for i, m, x in kept if i == a)
        scored = sorted((-sum(p * q for p, q in zip(v, x)), far if i is None else i, m) for i, m, x in kept if i != a)
        for s, p, _ in [y for y in scored if y[2] == label][:5]:
            window = [(-n, i) for n, i, m in scored if m != label and 50 * -s <= 100 * -n <= 95 * -s][:3]
            out += [(a, p if p < far else None, k + 1, i if i < far else None, -s, n) for k, (n, i) in enumerate(window)]
    return out


def mined(df):
    return [tuple(r) for r in negatives.hard_negatives(df).collect()]


key = lambda r: tuple(-1 if x is None else x for x in r)


@pytest.mark.parametrize("rows_a_cell", [16_384, 64])
def test_against_brute_force(spark, rows_a_cell, monkeypatch):
    monkeypatch.setattr(negatives, "CELL_ROWS", rows_a_cell)
    monkeypatch.setattr(negatives, "CELL_ANCHORS", 4)
    monkeypatch.setattr(negatives, "SCORES", 500)
    rng = np.random.default_rng(1)
    hubs = rng.normal(size=(6, 8))
    rows = []
    for i in range(900):
        x = hubs[rng.integers(6)] + 0.4 * rng.normal(size=8)
        rows.append((i, [float(v) for v in x], int(rng.integers(0, 10)) if rng.random() < 0.6 else 3))
    rows += [(1000 + i, [0.5] * 8, i % 10) for i in range(60)]  # one common vector: ties by id
    rows += [(2000, None, 1), (2050, [0.1] * 8, None), (2100, [float("nan")] + [0.1] * 7, 1), (2150, [None] + [0.1] * 7, 1), (2200, [float("inf")] * 8, 1), (2250, [], 1), (2300, [0.0] * 8, 4), (2350, [-1.0] * 8, 77)]
    rows += [(None, [0.5] * 8, 2), (None, [0.45] * 8, 3)]
    df = spark.createDataFrame([(i, v, m, "x") for i, v, m in rows], "vec_id long, embedding array<float>, label int, score string")
    want = brute([(r.vec_id, r.embedding, r.label) for r in df.collect()])
    got = mined(df)
    assert sorted(got, key=key) == sorted(want, key=key) and len(want) > 100


def test_repeats_few_and_none(spark):
    rows = [(0, [1.0, 1.0], 1), (0, [1.0, 1.0], 1), (1, [2.0, 2.0], 2), (1, [2.0, 2.0], 2), (2, [1.5, 1.0], 1), (3, [1.0, 0.5], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    # the label of id 0 is turned to 2: the rows of id 1 are its positives, and both are answered
    assert sorted(mined(df)) == sorted(brute(rows)) == [(0, 1, 1, 2, 262144, 163840)] * 2
    assert [tuple(r) for r in negatives.mine(df, least=0, most=200).collect() if r.positive_id == 2] == [(0, 2, k, 1, 163840, 262144) for k in (1, 2)]
    assert mined(df.limit(0)) == [] and mined(df.filter("vec_id = 0")) == [] and mined(df.filter("vec_id > 0")) == []


def test_slots_answer_every_window(spark):
    """Positives whose windows overlap, some with equal limits."""
    base = [(50, [1.0], 0)] + [(100 + k, [s / 256], 0) for k, s in enumerate((100, 100, 80, 60, 40))]
    base += [(1 + k * 2, [s / 256], 1) for k, s in enumerate((95, 94, 90, 76, 76, 75, 57, 50, 38, 38, 38, 37, 30, 20, 19, 1)) if (1 + k * 2) % 7 and (1 + k * 2) % 50]
    base = [(i, v, m) for i, v, m in base if i % 7]
    df = spark.createDataFrame(base, "vec_id long, embedding array<double>, label int")
    got = mined(df.withColumn("x", df.label))
    assert sorted(got) == sorted(brute(base)) and len({r[1] for r in got}) >= 3


def test_too_large(spark):
    df = spark.createDataFrame([(0, [1e30, 1.0], 1), (1, [1.0, 1.0], 1)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(ArithmeticError):
        negatives.hard_negatives(df)
