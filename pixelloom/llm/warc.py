"""Legacy web archives to WARC: writing ARC files, converting them, reading WARC files back.

ARC files (version 1 or 2) hold one gzip member per record; their header lines follow the field list of the version block, and a record's body has
the declared length. The converter parses both versions by that list and synthesises WARC records: identifiers as name-based UUIDs (so that
any attempt and any task makes the same), ISO timestamps from the 14-digit ones, types, and payload digests. Of records with equal payloads of at least LEAST
bytes the one with the smallest key is a response; others become revisits that refer to it.

The query writes files of both versions in turn, and a date for each page.

Files are written by workers to a shared folder; only file names that a task has sent on are read, so lost attempts leave no trace.
Which records are revisits is decided over a table of digests, never over payloads; that table goes to the converter by file. A payload that very
many records share is looked up in a broadcast list of bounded length, others by a shuffle.

Defined results: null html is an empty payload; a very long page is a record like others (a worker holds one file of FILE_BYTES and the page that fills it); a null url is stored as `about:blank`; white space in urls is percent-encoded; rows that share a key and a payload are all
responses if that key is the smallest; null keys come after all others; further columns are not looked at,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import datetime
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dealt, heavy_join, ref, scratch_path, small_batches, stage
from .storage import read_bytes, write_bytes

LEAST = 100
FILE_BYTES = 32 << 20
LEVEL = 1
DATE = "20240101000000"
#: Dates of pages lie within so many seconds after DATE.
SPREAD = 366 * 86_400
#: Fixed values of the formats: the field lists of the two ARC versions, and the WARC profile of revisits.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_KEY, _REFERS = "X-Record-Key", "X-Refers-To-Key"


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


# ---- ARC --------------------------------------------------------------------------------------------------------


def date_of(key: int | None) -> str:
    """A page's 14-digit date, made from its key, as the table has none."""
    return (datetime.datetime.strptime(DATE, "%Y%m%d%H%M%S") + datetime.timedelta(seconds=(key or 0) % SPREAD)).strftime("%Y%m%d%H%M%S")


def arc_head(name: str, version: int, date: str = DATE) -> bytes:
    """The version block, by which a reader learns the fields of all later header lines."""
    body = f"{version} 0 pixelloom\n{FIELDS[version]}\n\n".encode()
    line = f"filedesc://{name} 0.0.0.0 {date} text/plain"
    line += " 200 - - 0 " + name if version == 2 else ""
    return f"{line} {len(body)}\n".encode() + body


def arc_record(url: str | None, key: int | None, payload: bytes, version: int, date: str, at: int, name: str) -> bytes:
    url = re.sub(r"[\s\x00-\x1f]", lambda m: "".join(f"%{b:02X}" for b in m.group().encode()), url or "") or "about:blank"
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{_KEY}: {'-' if key is None else key}\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    line = f"{url} 0.0.0.0 {date} text/html"
    line += f" 200 - - {at} {name}" if version == 2 else ""
    return f"\n{line} {len(head) + len(payload)}\n".encode() + head + payload


def arc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, body) of every record of an ARC file, plain or compressed; the version block comes first and names the fields."""
    src = gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    fields: list[str] = []
    while line := src.readline():
        line = line.rstrip(b"\r\n")
        if not line:  # records are parted by a line break
            continue
        told = line.decode("utf-8", "replace")
        if not fields:
            if not told.startswith("filedesc://"):
                raise ValueError("an ARC file begins with its version block")
            body = src.read(int(told.rsplit(" ", 1)[1]))
            version, names = body.decode().split("\n")[:2]
            fields = names.split(" ")
            if int(version.split(" ")[0]) not in FIELDS:
                raise ValueError(f"ARC version {version}")
            yield dict(zip(fields, [told.split(" ")[0], *[""] * (len(fields) - 2), str(len(body))])), body
            continue
        parts = told.split(" ")
        parts = [" ".join(parts[: len(parts) - len(fields) + 1]), *parts[len(parts) - len(fields) + 1 :]]
        got = dict(zip(fields, parts))
        n = int(got["Archive-length"])
        body = src.read(n)
        if len(body) != n:
            raise ValueError("an ARC record is shorter than it declares")
        yield got, body


def http_parts(block: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and payload of an HTTP response."""
    head, gap, payload = block.partition(b"\r\n\r\n")
    if not gap:
        return {}, block
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:])}, payload


# ---- WARC -------------------------------------------------------------------------------------------------------


def record_id(key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, 'record:' + key)}>"


def iso(date: str) -> str:
    """A 14-digit ARC date as a WARC date; shorter ones are filled up."""
    d = (date + "00000101000000"[len(date) :])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_record(kind: str, fields: dict[str, str], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *[f"{k}: {v}" for k, v in fields.items()], f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def convert(arc: bytes, refers: dict[int, str], name: str) -> Iterator[bytes]:
    """WARC records (gzip members) of an ARC file. refers: position of a record -> key of the response that it revisits."""
    for nth, (f, body) in enumerate(arc_records(arc)):
        if not nth:
            yield _member(warc_record("warcinfo", {"WARC-Record-ID": record_id("file " + name), "WARC-Date": iso(DATE), "WARC-Filename": name, "Content-Type": "application/warc-fields"}, b"software: pixelloom\r\nformat: WARC File Format 1.1\r\n"))
            continue
        http, payload = http_parts(body)
        key = http.get(_KEY.lower(), "-")
        own = record_id(f"{key}" if key != "-" else f"{name} {nth}")
        out = {"WARC-Record-ID": own, "WARC-Date": iso(f["Archive-date"]), "WARC-Target-URI": f["URL"], "WARC-IP-Address": f["IP-address"], "WARC-Payload-Digest": "sha256:" + hashlib.sha256(payload).hexdigest(), "Content-Type": "application/http; msgtype=response"}
        if nth - 1 in refers:
            to = refers[nth - 1]
            yield _member(warc_record("revisit", out | {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(to), _REFERS: to}, body[: len(body) - len(payload)]))
        else:
            yield _member(warc_record("response", out, body))


def warc_records(data: bytes) -> Iterator[tuple[str, dict[str, str], bytes]]:
    """(type, fields with names in lower case, block) of every record of a WARC file."""
    src = gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    while line := src.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        fields = {}
        while (line := src.readline()) not in (b"\r\n", b"\n", b""):
            k, _, v = line.decode("utf-8", "replace").partition(":")
            fields[k.strip().lower()] = v.strip()
        n = int(fields["content-length"])
        block = src.read(n)
        if len(block) != n:
            raise ValueError("a WARC record is shorter than it declares")
        yield fields["warc-type"], fields, block


# ---- over tables ------------------------------------------------------------------------------------------------


def pages_to_arc(pages: DataFrame, folder: str, *, key_col: str = "page_id", url_col: str = "url", html_col: str = "html", version: int | None = None) -> DataFrame:
    """Writes the pages as ARC files of one version, or of both in turn; gives, already written, one row per record: uri, nth (0 for the first page), key, digest, n_bytes."""

    def run(batches):
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        parts, raw, rows = [], 0, []

        def close():
            nonlocal parts, raw, rows, seq
            uri = write_bytes(folder, f"pages-{part:06d}-{seq:04d}.arc.gz", b"".join(parts))
            out = pa.RecordBatch.from_arrays(
                [pa.array([uri] * len(rows)), pa.array(range(len(rows)), pa.int32()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows], pa.int64())],
                ["uri", "nth", "key", "digest", "n_bytes"],
            )
            parts, raw, rows, seq = [], 0, [], seq + 1
            return out

        for b in batches:
            for a in range(0, b.num_rows, 256):
                z = b.slice(a, 256)
                for key, url, html in zip(z.column(0).to_pylist(), z.column(1).to_pylist(), z.column(2).to_pylist()):
                    payload = (html or "").encode()
                    name, own = f"pages-{part:06d}-{seq:04d}.arc", version or 1 + (part + seq) % 2
                    if not parts:
                        parts.append(_member(arc_head(name, own)))
                    parts.append(_member(arc_record(url, key, payload, own, date_of(key), raw, name)))
                    raw += len(payload)
                    rows.append((key, hashlib.sha256(payload).hexdigest(), len(payload)))
                    if raw >= FILE_BYTES:
                        yield close()
        if rows:
            yield close()

    small_batches(pages.sparkSession)
    src = pages.select(ref(key_col).cast("long").alias("key"), ref(url_col).alias("url"), ref(html_col).alias("html"))
    return stage(src.mapInArrow(run, "uri string, nth int, key long, digest string, n_bytes long"), "arc-records")


def arc_to_warc(records: DataFrame, folder: str, *, least: int = LEAST) -> DataFrame:
    """Converts the ARC files that `records` lists; gives the list of WARC files (uri), already written."""
    first = records.filter(F.col("n_bytes") >= least).groupBy("digest").agg(F.min("key").alias("to"), F.count("*").alias("n")).filter("n > 1 and to is not null")
    again = heavy_join(records.filter(F.col("n_bytes") >= least), first, "digest", "n", records.count()).filter(~F.col("key").eqNullSafe(F.col("to")))
    told = again.groupBy("uri").agg(F.collect_list(F.struct("nth", "to")).alias("refers"))  # at most a file's records
    files = records.select("uri").distinct()
    jobs = dealt(files.join(told, "uri", "left").select("uri", "refers"), files.count())

    def run(batches):
        for b in batches:
            for uri, refers in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                name = uri.rsplit("/", 1)[1].replace(".arc.gz", ".warc.gz")
                known = {r["nth"]: str(r["to"]) for r in refers or []}
                yield pa.RecordBatch.from_arrays([pa.array([write_bytes(folder, name, b"".join(convert(read_bytes(uri), known, name)))])], ["uri"])

    return stage(jobs.mapInArrow(run, "uri string"), "warc-files")


def read_warc(files: DataFrame) -> DataFrame:
    """One row per response or revisit: key, url, date, record_type, record_id, payload_bytes, payload_digest, refers_to (a key).

    A response's payload is measured and digested as read and must agree with its header; a revisit's full payload is told by its headers."""

    def run(batches):
        names = ["key", "url", "date", "record_type", "record_id", "payload_bytes", "payload_digest", "refers_to"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        for b in batches:
            for uri in b.column(0).to_pylist():
                rows = []
                for kind, f, block in warc_records(read_bytes(uri)):
                    if kind not in ("response", "revisit"):
                        continue
                    http, payload = http_parts(block)
                    told = f["warc-payload-digest"].removeprefix("sha256:")
                    n = int(http["content-length"])
                    if kind == "response" and (len(payload), hashlib.sha256(payload).hexdigest()) != (n, told):
                        raise ValueError(f"{f['warc-record-id']}: the payload is not what its headers tell")
                    key = http[_KEY.lower()]
                    to = f.get(_REFERS.lower())
                    rows.append((None if key == "-" else int(key), f["warc-target-uri"], f["warc-date"], kind, f["warc-record-id"], n, told, to and int(to)))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

    schema = "key long, url string, date string, record_type string, record_id string, payload_bytes long, payload_digest string, refers_to long"
    return dealt(files, files.count()).mapInArrow(run, schema)


def digests(pages: DataFrame) -> DataFrame:
    spark = pages.sparkSession
    arcs = pages_to_arc(pages.select("page_id", "url", "html"), scratch_path(spark, "arc"))
    got = read_warc(arc_to_warc(arcs, scratch_path(spark, "warc")))
    return got.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", F.col("date").alias("warc_date"))


ORACLE = r"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS m FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN m < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN m < page_id THEN m END AS refers_to,
       strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(coalesce(page_id, 0) % 31622400), '%Y-%m-%dT%H:%M:%SZ') AS warc_date
FROM p LEFT JOIN f ON f.payload_digest = p.payload_digest AND payload_bytes >= 100
"""
