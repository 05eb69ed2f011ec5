"""Approximate nearest neighbours by largest cosine: inverted lists, and an adaptive scan of dimensions within each probed list.

Vectors are scaled to length 1 and turned by one random rotation, so that every column block holds an even share of a distance. There are about as many lists as
the root of the number of vectors, and every vector is put into its nearest one. Their centres come from k-means on a bounded sample on the driver; where the sample has too
few rows for all lists (A_LIST for each), its centres are coarse, and under each of them k-means on a larger sample, which stays in the tasks, gives its share of the lists. How
many lists a query probes is measured: for about ASKED of the queries tasks find the true neighbours among all rows, and as many lists are probed as hold TARGET of these, so clustered vectors
need few and vectors without any order need most, and queries that are unlike other rows count as what they are.

Within a list the columns are read block by block: from the partial distance over the first t of d columns a test of hypotheses tells whether the
whole distance can still beat the query's present k-th best, dist_t * d / t > best * (1 + EPS / sqrt(t)) ** 2 rejects, and a rejected
candidate is not read further. A query's k-th best starts as that among the sample, which every query is held against first; its nearest list is scanned before the others, what
was found there bounds those, and within a list the bound falls with each chunk of candidates. Survivors are scored on the original vectors in double precision.

A list's vectors and its queries are dealt over cells of bounded size (list, part of the vectors, part of the queries), so one list that
holds most rows is many tasks; each cell sends on k rows per query, which a window per query merges with those from the sample.

Defined results: vectors that are null, zero, of another length than most, or hold null or non-finite components take no part; a query has its own id left out, and so
every row with that id; rows that repeat a query's id are one question, with the vector of the least bytes; equal scores go to the smaller id; fewer than k candidates are all returned;
repeated rows are candidates each; rows with null id take no part; further columns are not looked at, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_arrow, ref, release, small_batches, stage

#: The sample: vectors at most, and numbers in them at most.
SAMPLE, SAMPLE_VALUES = 20_000, 1 << 21
#: Vectors of the sample for each list at least; about so many queries tell how many lists to probe, and the share of their neighbours that these must hold.
A_LIST, ASKED, TARGET = 16, 500, 0.97
EPS = 2.1
COLUMNS = 16
#: Numbers in all centres at most.
CENTRE_VALUES = 1 << 23
#: Candidates of a cell after which its queries' bounds are lowered.
CHUNK = 512
CELL_VECTORS, CELL_QUERIES = 4096, 1024
#: Pairs of a query and a candidate that are looked at in one go.
PAIRS = 1 << 20


def rotation(d: int, seed: int = 8) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))
    return q * np.sign(np.diag(r))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in two steps, so that tiny or huge components neither vanish nor overflow."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 8) -> np.ndarray:
    """Centres of at most k lists; equal vectors count once, so copies don't draw centres."""
    x = np.unique(x.astype(np.float32), axis=0)
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = (x @ c.T - (c * c).sum(1) / 2).argmax(1)
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], x[rng.integers(len(x), size=len(c))])
    return c


def rows_of(col) -> np.ndarray:
    return np.array([np.frombuffer(v, "<f8") for v in col.to_pylist()])


def kth_best(x: np.ndarray, y: np.ndarray, same: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x its k nearest rows of y, those in `same` left out: their positions (-1 where there are fewer) and the k-th squared distance."""
    near = x.astype(np.float32) @ y.astype(np.float32).T
    near[same] = -np.inf
    if near.shape[1] < k:
        near = np.pad(near, ((0, 0), (0, k - near.shape[1])), constant_values=-np.inf)
    top = np.argpartition(-near, k - 1, axis=1)[:, :k]
    got = np.take_along_axis(near, top, 1)
    return np.where(np.isfinite(got), top, -1), np.maximum(0, 2 - 2 * got.min(1))


def probes_for(x: np.ndarray, ids: np.ndarray, centres: np.ndarray, k: int, target: float = TARGET) -> int:
    """How many of the nearest lists hold the share `target` of the k nearest neighbours that rows of x have in x."""
    asked = np.linspace(0, len(x) - 1, min(ASKED, len(x))).astype(int)
    top, _ = kth_best(x[asked], x, ids[asked][:, None] == ids, k)
    half = (centres * centres).sum(1) / 2
    of = (x.astype(np.float32) @ centres.T - half).argmax(1)
    rank = np.argsort(np.argsort(-(x[asked].astype(np.float32) @ centres.T - half), axis=1, kind="stable"), axis=1, kind="stable")
    return enough(np.take_along_axis(rank, of[top], 1)[top >= 0], len(centres), target)


def enough(ranks: np.ndarray, most: int, target: float = TARGET) -> int:
    """How many lists hold the share `target` of neighbours in lists of these ranks."""
    ranks = np.sort(ranks)
    return int(ranks[min(len(ranks) - 1, int(np.ceil(target * len(ranks))) - 1)]) + 1 if len(ranks) else most


def true_ranks(rows: DataFrame, q_id: np.ndarray, q: np.ndarray, centres: np.ndarray, k: int) -> np.ndarray:
    """For each of the k nearest of all rows to each of q (unit vectors): which of the query's nearest lists holds it. rows: id, v. Tasks send on k rows for each of q."""
    spark, d = rows.sparkSession, q.shape[1]
    half = (centres * centres).sum(1) / 2
    sent = spark.sparkContext.broadcast((q_id, q))

    def best(batches):
        ids, asks = sent.value
        least = np.full(len(asks), -np.inf)
        i, c, score, of = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int32)
        for whole in batches:
            for a in range(0, whole.num_rows, 512):
                b = whole.slice(a, 512)
                c_id, x = b.column(0).to_numpy(), unit(b.column(1).flatten().to_numpy().reshape(-1, d))
                near = asks @ x.T
                near[ids[:, None] == c_id] = -np.inf
                at, j = np.nonzero((near >= least[:, None]) & (near > -np.inf))
                some, back = np.unique(j, return_inverse=True)
                own = (x[some].astype(np.float32) @ centres.T - half).argmax(1).astype(np.int32)
                i, c, score, of = (np.concatenate(z) for z in ((i, at.astype(np.int32)), (c, c_id[j]), (score, near[at, j]), (of, own[back])))
                order = np.lexsort((c, -score, i))
                i, c, score, of = i[order], c[order], score[order], of[order]
                rank = np.arange(len(i)) - np.searchsorted(i, i)
                least[i[rank == k - 1]] = score[rank == k - 1]
                i, c, score, of = (z[rank < k] for z in (i, c, score, of))
        yield pa.RecordBatch.from_arrays([pa.array(z) for z in (i, c, score, of)], ["i", "c", "score", "list"])
        release()

    small_batches(spark)
    order = W.partitionBy("i").orderBy(F.desc("score"), "c")
    found = rows.select("id", "v").mapInArrow(best, "i int, c long, score double, list int").withColumn("r", F.row_number().over(order))
    got = found.filter(F.col("r") <= k).select("i", "list").toArrow()  # k rows for each of q
    rank = np.argsort(np.argsort(-(q.astype(np.float32) @ centres.T - half), axis=1, kind="stable"), axis=1, kind="stable")
    return rank[got.column("i").to_numpy(), got.column("list").to_numpy()]


def lowered(bound: np.ndarray, best: np.ndarray, i: np.ndarray, dist: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The queries' k least distances so far (query, k) and bounds, after candidates at distances dist were found for queries i (ascending)."""
    n, k = best.shape
    order = np.lexsort((dist, i))
    i, dist = i[order], dist[order]
    rank = np.arange(len(i)) - np.searchsorted(i, i)
    few = rank < k
    new = np.full((n, k), np.inf)
    new[i[few], rank[few]] = dist[few]
    best = np.sort(np.concatenate([best, new], 1), axis=1)[:, :k]
    return np.minimum(bound, best[:, -1]), best


def scan_cell(q_id, q, bound, c_id, c, k: int, turn: np.ndarray, eps: float = EPS, columns: int = COLUMNS):
    """The k best candidates of one cell for each query, of those that may be as near as its bound: query indices, candidate indices, cosines."""
    d = c.shape[1]
    qr, cr = (unit(q) @ turn).astype(np.float32), (unit(c) @ turn).astype(np.float32)
    q_len, c_len = np.sqrt((q * q).sum(1)), np.sqrt((c * c).sum(1))
    first = min(columns, d)
    far = (cr[:, :first] ** 2).sum(1)
    limit = lambda t, bound: bound * (1 + eps / np.sqrt(t)) ** 2 + 1e-5 if t < d else bound + 1e-5
    out = []
    many = max(1, PAIRS // min(CHUNK, len(c)))
    for a in range(0, len(q), many):
        z = slice(a, a + many)
        now, best, seen = np.asarray(bound[z], float), np.full((len(q[z]), k), np.inf), []
        for b in range(0, len(c), CHUNK):
            y = slice(b, b + CHUNK)
            part = np.maximum(0, (qr[z, :first] ** 2).sum(1)[:, None] + far[y] - 2 * qr[z, :first] @ cr[y, :first].T)
            i, j = np.nonzero((part * (d / first) <= limit(first, now)[:, None]) & (q_id[z, None] != c_id[y]))
            dist, j, t = part[i, j], j + b, first
            while t < d and len(i):
                block = slice(t, min(d, t + columns))
                t = block.stop
                dist = dist + ((cr[j, block] - qr[i + a, block]) ** 2).sum(1)
                alive = dist * (d / t) <= limit(t, now)[i]
                i, j, dist = i[alive], j[alive], dist[alive]
            now, best = lowered(now, best, i, dist)
            seen.append((i, j, dist))
        i, j, dist = (np.concatenate(x) for x in zip(*seen))
        near = dist <= now[i] + 2e-5  # all that may be as near as the k-th
        i, j = i[near] + a, j[near]
        # the measure itself, on the original vectors
        score = np.concatenate([(q[i[b : b + 20_000]] * c[j[b : b + 20_000]]).sum(1) for b in range(0, max(1, len(i)), 20_000)]) / (q_len[i] * c_len[j])
        order = np.lexsort((c_id[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        keep = np.arange(len(i)) - np.searchsorted(i, i) < k
        out.append((i[keep], j[keep], score[keep]))
    return tuple(np.concatenate(x) for x in zip(*out))


def all_centres(rows: DataFrame, x: np.ndarray, lists: int, n: int) -> np.ndarray:
    """Centres of about so many lists. x: the sample, unit vectors. rows: id, v."""
    d = x.shape[1]
    lists = max(1, min(lists, CENTRE_VALUES // d))
    coarse = kmeans(x, min(lists, max(1, len(x) // A_LIST)))
    each = -(-lists // len(coarse))
    if lists <= max(1, len(x) // A_LIST):
        return coarse
    half = (coarse * coarse).sum(1) / 2

    def place(cols):
        y = unit(cols[0].flatten().to_numpy().reshape(-1, d)).astype(np.float32)
        return [pa.array((y @ coarse.T - half).argmax(1).astype(np.int32))]

    def split(t: pa.Table) -> pa.Table:
        y = unit(t.column("v").combine_chunks().flatten().to_numpy().reshape(-1, d))
        return pa.table({"centre": pa.array([c.astype(np.float32).tobytes() for c in kmeans(y, max(1, min(each, len(y) // A_LIST)))], pa.binary())})

    u = F.pmod(F.xxhash64("id", "v", F.lit("centres")), F.lit(1 << 30)) / float(1 << 30)
    some = append_arrow(rows.filter(u < 2.0 * A_LIST * lists / n), [F.col("v")], [("under", T.IntegerType())], place)
    got = some.select("under", "v").groupBy("under").applyInArrow(split, "centre binary").toArrow()  # CENTRE_VALUES numbers at most
    fine = [np.frombuffer(c, np.float32) for c in got.column("centre").to_pylist()]
    return np.array(fine) if len(fine) > len(coarse) else coarse


def search(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", is_query=None, k: int = 5, lists: int | None = None, probes: int | None = None, sample: int = SAMPLE, eps: float = EPS) -> DataFrame:
    """query_id, rank, vec_id, score: for each query (rows where is_query holds) its k nearest found. lists, probes: instead of what the table's size and the sample tell."""
    spark = vectors.sparkSession
    v = F.transform(ref(vector_col), lambda x: x.cast("double"))
    rows = vectors.select(ref(id_col).cast("long").alias("id"), v.alias("v")).filter("id is not null and v is not null and size(v) > 0")
    rows = rows.filter(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0))
    flag = F.coalesce(is_query if is_query is not None else F.col("id") % 50 == 0, F.lit(False))
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.count_if(flag).alias("asks")).orderBy(F.desc("n"), "d").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not sizes or not sizes[0].asks:
        return spark.createDataFrame([], schema)
    d, n = sizes[0].d, sizes[0].n
    rows = rows.filter(F.size("v") == d)
    sample = max(1, min(sample, SAMPLE_VALUES // d))
    u = F.pmod(F.xxhash64("id", "v", F.lit("lists")), F.lit(1 << 20)) / float(1 << 20)
    some = rows.filter(u < min(1.0, sample / n)).limit(2 * sample).toArrow()
    some = some if some.num_rows else rows.limit(1).toArrow()
    s_id, own = some.column("id").to_numpy(), some.column("v").combine_chunks().flatten().to_numpy().reshape(-1, d)
    x = unit(own)
    centres = kmeans(x, lists) if lists else all_centres(rows, x, max(1, round(n**0.5)), n)
    if not probes:
        few = min(ASKED, max(1, SAMPLE_VALUES // d))
        u = F.pmod(F.xxhash64("id", "v", F.lit("asked")), F.lit(1 << 20)) / float(1 << 20)
        asked = rows.filter(flag & (u < min(1.0, few / sizes[0].asks))).limit(2 * few).toArrow()
        q = unit(asked.column("v").combine_chunks().flatten().to_numpy().reshape(-1, d))
        probes = enough(true_ranks(rows, asked.column("id").to_numpy(), q, centres, k), len(centres))
    turn, probes = rotation(d), min(probes, len(centres))
    half = (centres * centres).sum(1) / 2
    sent = spark.sparkContext.broadcast((s_id, own))  # SAMPLE_VALUES numbers at most, twice that by chance

    def place(cols):
        x = cols[0].flatten().to_numpy().reshape(-1, d)
        near = unit(x).astype(np.float32) @ centres.T - half
        own = near.argmax(1)
        asks = np.flatnonzero(cols[1].to_numpy(zero_copy_only=False))
        probe, bound, best = [None] * len(x), [None] * len(x), [None] * len(x)
        if len(asks):
            s_id, s = sent.value
            ids = cols[2].to_numpy()[asks]
            top, kth = kth_best(unit(x[asks]), unit(s), ids[:, None] == s_id, k)
            far = np.argsort(-near[asks], axis=1, kind="stable")[:, :probes]
            for a, i in enumerate(asks):
                j = top[a][top[a] >= 0]
                score = (x[i] * s[j]).sum(1) / (np.sqrt((x[i] * x[i]).sum()) * np.sqrt((s[j] * s[j]).sum(1)))
                probe[i], bound[i] = far[a].tolist(), float(kth[a])
                best[i] = [{"vec_id": int(v), "score": float(w)} for v, w in zip(s_id[j], score)]
        kind = pa.list_(pa.struct([("vec_id", pa.int64()), ("score", pa.float64())]))
        return [pa.array(own.astype(np.int32)), pa.array([v.tobytes() for v in x], pa.binary()), pa.array(probe, pa.list_(pa.int32())), pa.array(bound, pa.float64()), pa.array(best, kind)]

    hits = T.ArrayType(T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())]))
    made = [("list", T.IntegerType()), ("x", T.BinaryType()), ("probe", T.ArrayType(T.IntegerType())), ("bound", T.DoubleType()), ("best", hits)]
    placed = append_arrow(rows, [F.col("v"), flag, F.col("id")], made, place)
    placed = stage(placed.select("id", "list", "x", "probe", "bound", "best"), "placed")
    asks = placed.filter("probe is not null").groupBy("id").agg(F.min(F.struct("x", "bound", "probe", "best")).alias("m")).select("id", "m.*")
    asks = stage(asks, "asked")
    each = asks.select("id", "x", "bound", F.posexplode("probe").alias("at", "list"))
    held = {r["list"]: r["n"] for r in placed.groupBy("list").agg(F.count("*").alias("n")).collect()}  # a row per list

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, others, score = [], [], []
        if left.num_rows and right.num_rows:  # a side without rows has no columns
            q_id, c_id = left.column("id").to_numpy(), right.column("c_id").to_numpy()
            i, j, score = scan_cell(q_id, rows_of(left.column("x")), left.column("bound").to_numpy(), c_id, rows_of(right.column("c")), k, turn, eps)
            ids, others = q_id[i], c_id[j]
        return pa.table({"query_id": pa.array(ids, pa.int64()), "vec_id": pa.array(others, pa.int64()), "score": pa.array(score, pa.float64())})

    def scanned(asked: DataFrame) -> DataFrame | None:
        """query_id, vec_id, score: the k best of each list that a query asks for."""
        wanted = {r["list"]: r["n"] for r in asked.groupBy("list").agg(F.count("*").alias("n")).collect()}
        parts = {z: (-(-held[z] // CELL_VECTORS), -(-wanted[z] // CELL_QUERIES)) for z in held if z in wanted}
        if not parts:
            return None
        sizes = F.broadcast(spark.createDataFrame([(z, a, b) for z, (a, b) in parts.items()], "list int, n_v int, n_q int"))  # a row per list
        many = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        cand = placed.join(sizes, "list").select("list", F.col("id").alias("c_id"), F.col("x").alias("c"), F.pmod(F.xxhash64("id", "x"), "n_v").cast("int").alias("a"), many(F.col("n_q")).alias("b"))
        ask = asked.join(sizes, "list").select("list", "id", "x", "bound", many(F.col("n_v")).alias("a"), F.pmod(F.xxhash64("id", "x"), "n_q").cast("int").alias("b"))
        key = ["list", "a", "b"]
        return ask.groupBy(*key).cogroup(cand.groupBy(*key)).applyInArrow(cell, "query_id long, vec_id long, score double")

    nearest_first = scanned(each.filter("at = 0"))
    if nearest_first is None:
        return spark.createDataFrame([], schema)
    found = stage(nearest_first, "nearest_lists")
    if probes > 1:
        order = W.partitionBy("query_id").orderBy(F.desc("score"))
        kth = found.withColumn("r", F.row_number().over(order)).filter(F.col("r") == k).select(F.col("query_id").alias("id"), (2 - 2 * F.col("score")).alias("kth"))
        rest = each.filter("at > 0").join(kth, "id", "left").withColumn("bound", F.least("bound", F.when(F.col("kth") > 0, F.col("kth")).when(F.col("kth") <= 0, 0.0))).drop("kth")  # NULL, where fewer were found, bounds nothing
        more = scanned(stage(rest, "other_lists"))
        found = found.unionByName(more) if more is not None else found
    found = found.withColumn("met", F.lit(1))
    first = asks.select(F.col("id").alias("query_id"), F.explode("best").alias("h")).select("query_id", "h.vec_id", "h.score", F.lit(0).alias("met"))
    # what the sample told counts where no list told it again
    both = found.unionByName(first).withColumn("most", F.max("met").over(W.partitionBy("query_id", "vec_id"))).filter("met = most")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
