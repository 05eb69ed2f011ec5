import gzip
import hashlib

import pytest

from pixelloom.llm import warc


def brute(rows):
    first = {}
    for k, h in rows:
        p = (h or "").encode()
        if len(p) >= 100 and k is not None:
            first[p] = min(first.get(p, k), k)
    out = []
    for k, h in rows:
        p = (h or "").encode()
        to = first.get(p)
        again = to is not None and k != to
        out.append((k, len(p), hashlib.sha256(p).hexdigest(), "revisit" if again else "response", to if again else None, warc.iso(warc.date_of(k))))
    return sorted(out, key=str)


ROWS = [(i, u, h) for i, (u, h) in enumerate([
    ("http://a/x?y=1", "<p>short</p>"), ("http://a/ b\n", "<p>short</p>"), (None, "é" * 60), ("http://c", "é" * 60), ("http://d", None), ("http://e", ""),
    ("http://f", "long\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" * 9), ("http://g", "x" * 100), ("http://h", "x" * 100), ("http://i", "x" * 99), ("http://j", "x" * 99), ("", "big " * 50_000),
])]


@pytest.mark.parametrize("version", [1, 2])
def test_arc_round_trip(version):
    parts = [warc.arc_head("f.arc", version)] + [warc.arc_record(u, k, (h or "").encode(), version, "20200102", 0, "f.arc") for k, u, h in ROWS]
    for data in (b"".join(parts), b"".join(gzip.compress(p) for p in parts)):
        got = list(warc.arc_records(data))
        assert len(got) == len(ROWS) + 1
        assert " ".join(got[0][0]) == warc.FIELDS[version]
        for (k, u, h), (f, body) in zip(ROWS, got[1:]):
            assert warc.http_parts(body)[1] == (h or "").encode() and f["Archive-date"] == "20200102" and " " not in f["URL"]
            assert f["URL"] == (u if u and not set(u) & set(" \n") else f["URL"])
    with pytest.raises(ValueError):
        list(warc.arc_records(b"".join(parts)[:-5]))


def test_warc_fields():
    arc = b"".join([warc.arc_head("f.arc", 1), warc.arc_record("http://a", 7, b"payload", 1, "2020", 0, "f.arc"), warc.arc_record("http://b", 8, b"payload", 1, "20200102030405", 0, "f.arc")])
    got = list(warc.warc_records(b"".join(warc.convert(arc, {1: "7"}, "f.warc.gz"))))
    assert [k for k, _, _ in got] == ["warcinfo", "response", "revisit"]
    assert got[1][1]["warc-date"] == "2020-01-01T00:00:00Z" and got[2][1]["warc-date"] == "2020-01-02T03:04:05Z"
    assert got[2][1]["warc-refers-to"] == got[1][1]["warc-record-id"] and got[2][1]["warc-profile"] == warc.PROFILE
    assert got[1][2].endswith(b"\r\n\r\npayload") and not got[2][2].endswith(b"payload")


def test_query_form(spark, tmp_path):
    df = spark.createDataFrame([(k, u, h, 1) for k, u, h in ROWS], "page_id long, url string, html string, URI int").repartition(3)
    old, warc.FILE_BYTES = warc.FILE_BYTES, 150
    try:
        got = sorted(map(tuple, warc.digests(df).collect()), key=str)
        arcs = warc.pages_to_arc(df, f"file://{tmp_path}").select("uri").distinct().collect()
    finally:
        warc.FILE_BYTES = old
    assert got == brute([(k, h) for k, _, h in ROWS])
    assert {next(warc.arc_records(warc.read_bytes(r.uri)))[1][:1] for r in arcs} == {b"1", b"2"}
    assert warc.digests(df.limit(0)).count() == 0


def test_nulls_and_repeats(spark):
    t = "y" * 200
    df = spark.createDataFrame([(None, None, t), (None, None, None), (3, "u", t), (3, "u", t), (5, "u", t)], "page_id long, url string, html string")
    got = sorted(((r.page_id, r.record_type, r.refers_to) for r in warc.digests(df).collect()), key=str)
    assert got == sorted([(3, "response", None), (3, "response", None), (5, "revisit", 3), (None, "response", None), (None, "revisit", 3)], key=str)
