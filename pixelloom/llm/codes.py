"""Vector code compression: product codes whose codebooks are refined by exact rounds, with norm-of-sum bounds instead of full rescans.

A vector of integers floor(SCALE * x) is cut into PARTS equal parts; each part is told by the index of its nearest entry in that part's codebook of ENTRIES entries. A round
assigns all parts, then puts each entry to the floor of the mean of its parts. All distances are of integers and exact.

An assignment after the first need not look at all entries. Entries of a codebook form GROUPS groups, and for each part of each vector and each group a
lower bound is kept on the distance to the group's entries (the assigned one left out), together with the round it was measured in, its stamp. The whole
history of codebooks is at hand in every task, so a bound of stamp s is lowered by the true net displacement of the group's entries between rounds s and t, the norm of the
sum of their moves, which is never more than the sum of the norms that bounds usually drift by. Only groups whose lowered bound doesn't exceed the exact distance to the
assigned entry are scanned anew; their bounds get the stamp t. Bounds are kept in half precision, rounded down, so that they stay bounds.

The rows' state (integers, codes, bounds, stamps) is written to the shared folder once a round, and the tasks' sums for the new codebook with it: one row for each entry
that a task met, which are added up by key. The driver holds codebooks only: entries x dimensions.

Defined results: rows whose vector is null, empty, of another length than most, or holds null or non-finite components are dropped; the first codebook comes from
the smallest distinct ids, where an id is repeated from its least vector, and fewer than ENTRIES ids give fewer entries; repeated rows are coded each and count each; rows with null id are
coded like others but give no first entry (without any id there is no codebook: an error); ties go to the lower index; a dimension that PARTS doesn't divide, or
numbers whose sums leave 62 bits, are an error; null labels are one label; further columns are not looked at, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import heavy_join, lists, ref, small_batches, stage, unstage

SCALE, PARTS, ENTRIES, ROUNDS, GROUPS = 256, 16, 64, 2, 4
#: Vectors that a task works on in one go.
ROWS = 2048


def integers(vectors: DataFrame, vector_col: str, id_col: str, label_col: str) -> tuple[DataFrame, int]:
    """id, label, x (floor of SCALE times each component) of the rows that take part, and the dimension."""
    v = F.transform(ref(vector_col), lambda x: x.cast("double"))
    rows = vectors.select(ref(id_col).cast("long").alias("id"), ref(label_col).alias("label"), v.alias("v")).filter("v is not null and size(v) > 0")
    rows = rows.filter(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(F.array_max(F.transform("v", F.abs))).alias("most")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not sizes:
        return rows.select("id", "label", F.lit(None).cast("array<long>").alias("x")), 0
    d = sizes[0].d
    if (sizes[0].most * SCALE + 1) ** 2 * 4 * max(d, sizes[0].n) >= 2.0**62:
        raise ArithmeticError("components are too large for exact sums of distances")
    return rows.filter(F.size("v") == d).select("id", "label", F.transform("v", lambda x: F.floor(x * SCALE)).alias("x")), d


def first_codebook(rows: DataFrame, parts: int, entries: int) -> np.ndarray:
    """(part, entry, position): the parts of the smallest ids' vectors."""

    def least(batches):  # a task's smallest distinct ids
        held = np.empty(0, np.int64)
        for b in batches:
            held = np.unique(np.concatenate([held, b.column(0).to_numpy()]))[:entries]
        yield pa.RecordBatch.from_arrays([pa.array(held)], ["id"])

    some = rows.select("id").filter("id is not null").mapInArrow(least, "id long")
    ids = [r.id for r in some.distinct().orderBy("id").limit(entries).collect()]
    if not ids:
        raise ValueError("no row has an id to start a codebook from")
    own = rows.filter(F.col("id").isin(ids)).groupBy("id").agg(F.min("x").alias("x")).collect()  # `entries` rows
    x = np.array([r.x for r in sorted(own, key=lambda r: r.id)], np.int64)
    return np.ascontiguousarray(x.reshape(len(x), parts, -1).transpose(1, 0, 2))


def net_moves(history: list[np.ndarray], groups: list[np.ndarray]) -> np.ndarray:
    """(stamp, part, group): how far the entry of a group that moved most is now from where it was in the stamp's round, a little rounded up."""
    now = history[-1]
    far = [np.sqrt(((now - then) ** 2).sum(2).astype(float)) for then in history]
    return np.array([[[p[g].max() for g in groups] for p in f] for f in far]) * (1 + 1e-9)


def down(x: np.ndarray) -> np.ndarray:
    """Half-precision numbers that are not above x."""
    y = np.minimum(x, 60000.0).astype(np.float16)
    return np.where(y.astype(float) > x, np.nextafter(y, np.float16(-np.inf)), y).astype(np.float16)


def assign(x: np.ndarray, history: list[np.ndarray], code: np.ndarray | None, low: np.ndarray | None, stamp: np.ndarray | None):
    """One part of many vectors: x (vector, position), the part's codebooks of all rounds as (1, entry, position), and the state of the last round.

    Gives codes, squared distances, bounds (vector, group), stamps, and how many group scans were made."""
    now, t, n = history[-1][0], len(history) - 1, len(x)
    groups = np.array_split(np.arange(len(now)), min(GROUPS, len(now)))
    dist = lambda rows, g: ((x[rows, None, :] - now[None, g, :]) ** 2).sum(2)
    if code is None:
        code, low, stamp = np.zeros(n, np.int64), np.full((n, len(groups)), -np.inf), np.full((n, len(groups)), t, np.int8)
        lowered = low
    else:
        code = code.astype(np.int64)
        lowered = low.astype(float) - net_moves(history, groups)[stamp, 0, np.arange(len(groups))]
    was = ((x - now[code]) ** 2).sum(1)
    need = lowered <= np.sqrt(was.astype(float))[:, None] * (1 + 1e-9)
    near, best, scans = code.copy(), was.copy(), {}
    for k, g in enumerate(groups):
        rows = np.flatnonzero(need[:, k])
        if len(rows):
            d = dist(rows, g)
            at = d.argmin(1)
            least, index = d[np.arange(len(rows)), at], g[at]
            better = (least < best[rows]) | ((least == best[rows]) & (index < near[rows]))
            near[rows[better]], best[rows[better]] = index[better], least[better]
            scans[k] = rows, d
    low, stamp, left = down(low), stamp.copy(), near != code
    for k, g in enumerate(groups):
        # an entry that is no longer the assigned one counts for its group again; the group's other entries are bounded as of now, and so gets this round's stamp
        rows = np.flatnonzero(left & (code >= g[0]) & (code <= g[-1]))
        low[rows, k], stamp[rows, k] = down(np.minimum(lowered[rows, k], np.sqrt(was[rows].astype(float)) * (1 - 1e-9))), t
    for k, (rows, d) in scans.items():
        own = np.flatnonzero((near[rows] >= groups[k][0]) & (near[rows] <= groups[k][-1]))
        d = d.astype(float)
        d[own, near[rows[own]] - groups[k][0]] = np.inf
        low[rows, k], stamp[rows, k] = down(np.sqrt(d.min(1)) * (1 - 1e-9)), t
    return near, best, low, stamp, int(sum(len(rows) for rows, _ in scans.values()))


def next_codebook(book: np.ndarray, sums: list) -> np.ndarray:
    """Entries at the floor of their parts' mean; those without parts stay."""
    out = book.copy()
    for r in sums:
        out[r.part, r.entry] = np.array(r.total, np.int64) // r.n
    return out


STATE = "id long, label string, x array<long>, code binary, low binary, stamp binary, error long, part int, entry int, n long, total array<long>, scans long"


def _round(rows: DataFrame, history: list[np.ndarray], first: bool) -> DataFrame:
    """The state of all rows after an assignment, and a row (part, entry, n, total) for each entry that a task met; written once."""
    parts, entries, width = history[-1].shape
    groups = min(GROUPS, entries)
    names = [c.split()[0] for c in STATE.split(", ")]

    def run(batches):
        n_of, total, scans = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64), 0
        for whole in batches:
            for a in range(0, whole.num_rows, ROWS):
                b = whole.slice(a, ROWS)
                n = b.num_rows
                x = b.column(2).flatten().to_numpy().reshape(n, parts, width)
                old = None if first else [np.frombuffer(b"".join(b.column(i).to_pylist()), kind).reshape(n, parts, *more) for i, kind, more in ((3, np.uint8, ()), (4, np.float16, (groups,)), (5, np.int8, (groups,)))]
                code, low, stamp, error = np.empty((n, parts), np.uint8), np.empty((n, parts, groups), np.float16), np.empty((n, parts, groups), np.int8), np.zeros(n, np.int64)
                for p in range(parts):
                    c, d, low[:, p], stamp[:, p], seen = assign(x[:, p], [h[p : p + 1] for h in history], *((None, None, None) if first else (y[:, p] for y in old)))
                    code[:, p], error, scans = c, error + d, scans + seen
                    n_of[p] += np.bincount(c, minlength=entries)
                    np.add.at(total[p], c, x[:, p])
                made = [pa.array([r.tobytes() for r in y], pa.binary()) for y in (code, low, stamp)]
                empty = [pa.nulls(n, k) for k in (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.int64())]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *made, pa.array(error), *empty], names)
        p, e = np.nonzero(n_of)
        k = len(p)
        if k:
            empty = [pa.nulls(k, t) for t in (pa.int64(), pa.string(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.int64())]
            own = [pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(n_of[p, e]), lists(pa.array(total[p, e].ravel()), np.full(k, width)), pa.array([scans] + [0] * (k - 1), pa.int64())]
            yield pa.RecordBatch.from_arrays([*empty, *own], names)

    return stage(rows.mapInArrow(run, STATE), "codes")


def compress(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
) -> tuple[DataFrame, np.ndarray | None, list[int]]:
    """The rows (id, label as text, code: a byte for each part, error), the codebooks (part, entry, position), and the group scans of each assignment."""
    small_batches(vectors.sparkSession)
    rows, d = integers(vectors, vector_col, id_col, label_col)
    if not d:
        return rows.select("id", F.col("label").cast("string").alias("label"), F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error")), None, []
    if d % parts or entries > 256:
        raise ValueError(f"{d} dimensions don't make {parts} equal parts, or more than 256 entries")
    history = [first_codebook(rows, parts, entries)]
    rows = rows.select("id", F.col("label").cast("string").alias("label"), "x")
    state, scans = None, []
    for t in range(rounds + 1):
        new = _round(rows if state is None else state.filter("part is null").select("id", "label", "x", "code", "low", "stamp"), history, state is None)
        if state is not None:
            unstage(state)
        state = new
        sums = state.filter("part is not null").groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[i]) for i in range(d // parts)]).alias("total"), F.sum("scans").alias("scans")).collect()  # parts x entries rows
        scans.append(sum(r.scans for r in sums))
        if t < rounds:
            history.append(next_codebook(history[-1], sums))
    return state.filter("part is null").select("id", "label", "code", "error"), history[-1], scans


def digests(vectors: DataFrame) -> DataFrame:
    coded, book, _ = compress(vectors)
    named = coded.select(F.col("id").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", F.coalesce(F.concat(F.lit("="), "label"), F.lit("")).alias("own"))
    by_label = named.groupBy("own").agg(F.sum("error").alias("label_error"), F.count("*").alias("k"))
    total = named.count() if book is not None else 0
    digest = hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest() if book is not None else None
    return heavy_join(named, by_label, "own", "k", total).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


ORACLE = """
WITH r AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v, row_number() OVER (ORDER BY vec_id) - 1 AS k
           FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS (SELECT vec_id, k, p, q, v[p * (len(v) // 16) + q + 1] AS y FROM r, range(16) a(p), range(4) b(q)),
c0 AS (SELECT p, k AS e, q, y FROM x WHERE k < 64),
a0 AS (SELECT vec_id, p, arg_min(e, d * 64 + e) AS e, min(d) AS d FROM (SELECT vec_id, p, e, sum((x.y - c.y) ** 2)::BIGINT AS d FROM x JOIN c0 c USING (p, q) GROUP BY ALL) GROUP BY ALL),
m1 AS (SELECT p, e, q, CAST(floor(sum(y) / count(*)) AS BIGINT) AS y FROM x JOIN a0 USING (vec_id, p) GROUP BY ALL),
c1 AS (SELECT p, e, q, coalesce(m1.y, c0.y) AS y FROM c0 LEFT JOIN m1 USING (p, e, q)),
a1 AS (SELECT vec_id, p, arg_min(e, d * 64 + e) AS e, min(d) AS d FROM (SELECT vec_id, p, e, sum((x.y - c.y) ** 2)::BIGINT AS d FROM x JOIN c1 c USING (p, q) GROUP BY ALL) GROUP BY ALL),
m2 AS (SELECT p, e, q, CAST(floor(sum(y) / count(*)) AS BIGINT) AS y FROM x JOIN a1 USING (vec_id, p) GROUP BY ALL),
c2 AS (SELECT p, e, q, coalesce(m2.y, c1.y) AS y FROM c1 LEFT JOIN m2 USING (p, e, q)),
a2 AS (SELECT vec_id, p, arg_min(e, d * 64 + e) AS e, min(d) AS d FROM (SELECT vec_id, p, e, sum((x.y - c.y) ** 2)::BIGINT AS d FROM x JOIN c2 c USING (p, q) GROUP BY ALL) GROUP BY ALL),
z AS (SELECT vec_id, string_agg(printf('%02x', CAST(e AS INT)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY ALL)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY p, e, q)) FROM c2) AS codebooks_sha256
FROM z JOIN r USING (vec_id)
"""
