from collections import defaultdict

import pytest

from pixelloom.llm import mixing


def wanted(sizes):
    """Targets by plain resharing, source by source."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, fixed, free = 1.5 * sum(sizes.values()), {}, set(order)
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not over:
            return fixed | {s: level * weight[s] for s in free}
        for s in over:
            fixed[s] = 2.0 * sizes[s]
            left -= fixed[s]
        free -= over
    return fixed


def docs(spark):
    rows = []
    for i in range(900):
        source = [None, "a", "b", "", "é", "hot", "hot", "hot", "big"][i % 9]
        text = [None, "", " \t\n", "one", "x " * (i % 40), "same words here", "w w two\r\nthree"][i % 7]
        rows.append((i, source, text if source != "big" else "long " * (i * 3), i % 3))
    return spark.createDataFrame(rows, "doc_id long, source string, text string, copies int")


def test_plan(spark):
    d = docs(spark)
    rows = mixing.mix_plan(d).collect()
    assert len(rows) == 900
    text = {r.doc_id: r.text for r in d.collect()}
    sizes, taken, most = defaultdict(int), defaultdict(int), defaultdict(int)
    import re

    for r in rows:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", text[r.doc_id] or ""))
        assert 0 <= r.copies <= 2 and r.taken == r.copies * r.size
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        most[r.source] = max(most[r.source], r.size)
    goal = wanted(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(goal[r.source])
    for s in sizes:
        assert abs(taken[s] - goal[s]) <= 2 * most[s] + 1
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix_plan(d.repartition(7)).collect())) if None not in sizes else True


def test_mix_rows(spark):
    d = docs(spark)
    plan = {r.doc_id: r.copies for r in mixing.mix_plan(d).collect()}
    out = mixing.mix(d)
    assert out.columns == d.columns
    got = defaultdict(int)
    for r in out.collect():
        got[r.doc_id] += 1
    assert got == {k: v for k, v in plan.items() if v}


def test_edges(spark):
    d = docs(spark)
    assert mixing.mix_plan(d.limit(0)).count() == 0 and mixing.mix(d.limit(0)).count() == 0
    one = spark.createDataFrame([(1, None, None), (1, None, None), (None, "s", "a b")], "doc_id long, source string, text string")
    assert sorted(r.taken for r in mixing.mix_plan(one).collect()) == [0, 0, mixing.mix_plan(one).filter("size = 2").first().taken]
    same = spark.createDataFrame([(7, "s", "a b c")] * 10, "doc_id long, source string, text string")
    n = sum(r.copies for r in mixing.mix_plan(same).collect())
    assert n in (15, 16) and mixing.mix(same).count() == n


def test_very_long_text(spark):
    long = spark.createDataFrame([(1, "s", "ab\n" * 400_000), (2, "s", " \t" * 100_000), (3, "s", "x" * 500_000), (4, "t", "a b")], "doc_id long, source string, text string")
    rows = {r.doc_id: r for r in mixing.mix_plan(long).collect()}
    assert [rows[i].size for i in (1, 2, 3, 4)] == [400_000, 0, 1, 2] and all(r.taken <= 2 * r.size for r in rows.values())
