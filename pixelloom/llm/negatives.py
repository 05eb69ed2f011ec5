"""Hard negatives for contrastive training: for each anchor and each of its positives the best rows of other labels whose score lies in a window below the positive's.

Slot-decomposed selection. The windows of an anchor's positives overlap, and a row may fall into many of them. Their upper limits cut the scores into disjoint slots, at
most one for each positive; every scored row falls into one slot, and a task keeps only the KEEP best rows of each slot. Slots stand in descending order, so the
best rows of a window are the beginning of the suffix that starts with the window's slot: slots are merged once, sorted, and each window reads KEEP rows from its slot's
start on and drops those below its lower limit. Rows are never held once for each window.

Scores are integer inner products of floor(SCALE * x), exact. Anchors are held against all rows in cells (a part of the rows, a part of the anchors) of bounded size: once for
their positives, and once for slots, when the limits are known. A cell sends on the best few rows for each anchor (and slot), so one label that holds most rows, or one
vector that all rows share, changes nothing in how work is dealt out.

Defined results: rows with null label, null or empty vector, a vector of another length than most, or null or non-finite components take no part; rows with null id are candidates
without an id, behind all others of their score; an anchor's id that is repeated is asked once (its least label, then least vector), and no row of that id is a candidate for it; other repeated
rows are candidates each; equal scores go to the smaller id; an anchor without positives has no rows, a window without candidates gives none, and a positive of negative score has an
empty window; labels are turned before anything else (relabel); inner products that could leave a long are an error; further columns are not looked at, whatever their
names; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ref, small_batches, stage

SCALE, POSITIVES, KEEP = 256, 5, 3
#: A window, in hundredths of the positive's score.
LEAST, MOST = 50, 95
#: Rows and anchors of a cell at most, tasks that the rows should make at least, and scores that are looked at in one go.
CELL_ROWS, CELL_ANCHORS, TASKS, SCORES = 16_384, 4096, 64, 1 << 20


def scores(a: np.ndarray, x: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products of integer rows: by floating point where all sums are exact in it."""
    return (a.astype(float) @ x.astype(float).T).astype(np.int64) if exact else a @ x.T


def first_k(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k first of each group by descending score, then id."""
    order = np.lexsort((ids, -score, group))
    g = group[order]
    return order[np.arange(len(g)) - np.searchsorted(g, g) < k]


def _matrix(col, d: int) -> np.ndarray:
    return col.combine_chunks().flatten().to_numpy().reshape(-1, d)


NO_ID = np.iinfo(np.int64).max


def _cells(rows: DataFrame, anchors: DataFrame, counts: tuple[int, int], best, d: int) -> DataFrame:
    """anchor, slot, id, score: what `best` keeps of each cell. best: anchor columns, candidates' ids, labels and vectors -> positions and slots."""
    n, asked = counts
    n_rows = max(1, -(-n // max(1024, min(CELL_ROWS, n // TASKS))))
    n_ask = max(1, -(-asked // CELL_ANCHORS))
    many = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = anchors.select("*", many(n_rows).alias("a")).withColumn("b", F.pmod(F.xxhash64("id"), F.lit(n_ask)).cast("int"))
    right = rows.select(F.pmod(F.xxhash64("id", "x"), F.lit(n_rows)).cast("int").alias("a"), many(n_ask).alias("b"), "id", "label", "x")

    def cell(asks: pa.Table, held: pa.Table) -> pa.Table:
        if not (asks.num_rows and held.num_rows):
            return pa.table({"anchor": pa.array([], pa.int64()), "slot": pa.array([], pa.int32()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        ids, label, x = held.column("id").fill_null(NO_ID).to_numpy(), held.column("label").to_numpy(), _matrix(held.column("x"), d)
        out = []
        step = max(1, SCORES // len(ids))
        for s in range(0, asks.num_rows, step):
            out.append(best(asks.slice(s, step), ids, label, x))
        anchor, slot, i, score = (np.concatenate(c) for c in zip(*out))
        return pa.table({"anchor": anchor, "slot": pa.array(slot.astype(np.int32)), "id": ids[i], "score": score})

    return left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(cell, "anchor long, slot int, id long, score long")


def mine(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", is_anchor=None, relabel=None, positives: int = POSITIVES, keep: int = KEEP, least: int = LEAST, most: int = MOST,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    is_anchor: a condition on column id (divisible by 50); relabel: the label to use, an expression of columns id and label."""
    spark = vectors.sparkSession
    small_batches(spark)
    v = F.transform(ref(vector_col), lambda x: x.cast("double"))
    rows = vectors.select(ref(id_col).cast("long").alias("id"), ref(label_col).cast("long").alias("label"), v.alias("v")).filter("label is not null and v is not null and size(v) > 0")
    rows = rows.filter(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    flag = is_anchor if is_anchor is not None else F.col("id") % 50 == 0
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(F.array_max(F.transform("v", F.abs))).alias("top")).orderBy(F.desc("n"), "d").limit(1).collect()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not sizes:
        return spark.createDataFrame([], schema)
    d, n, top = sizes[0].d, sizes[0].n, (sizes[0].top * SCALE + 1) ** 2 * sizes[0].d
    if top >= 2.0**56:  # windows are compared in hundredths
        raise ArithmeticError("components are too large for exact inner products")
    exact = top < 2.0**53
    rows = rows.filter(F.size("v") == d).select("id", (relabel if relabel is not None else F.col("label")).cast("long").alias("label"), F.transform("v", lambda x: F.floor(x * SCALE)).alias("x"))
    rows = stage(rows, "rows")
    own = rows.filter(F.coalesce(flag, F.lit(False))).groupBy("id").agg(F.min(F.struct("label", "x")).alias("m")).select("id", "m.label", "m.x")
    own = stage(own.filter("id is not null"), "anchors")
    asked = own.count()

    def same_label(asks: pa.Table, ids, label, x):
        a_id, a_label = asks.column("id").to_numpy(), asks.column("label").to_numpy()
        s = scores(_matrix(asks.column("x"), d), x, exact)
        i, j = np.nonzero((a_label[:, None] == label) & (a_id[:, None] != ids))
        got = s[i, j]
        z = first_k(i, got, ids[j], positives)
        return a_id[i[z]], np.zeros(len(z)), j[z], got[z]

    order = W.partitionBy("anchor").orderBy(F.desc("score"), F.col("id"))
    found = _cells(rows, own, (n, asked), same_label, d).withColumn("k", F.row_number().over(order)).filter(F.col("k") <= positives)
    pos = found.select("anchor", F.when(F.col("id") < NO_ID, F.col("id")).alias("positive_id"), F.col("score").alias("positive_score"), "k").filter("positive_score >= 0")
    # a window holds scores from ceil(least % of the positive's) to floor(most % of it); limits descend with k
    pos = pos.withColumns({"low": F.ceil(F.col("positive_score") * least / F.lit(100).cast("decimal(3,0)")).cast("long"), "high": F.floor(F.col("positive_score") * most / F.lit(100).cast("decimal(3,0)")).cast("long")})
    pos = stage(pos, "positives")
    limits = pos.groupBy("anchor").agg(F.sort_array(F.collect_set("high"), asc=False).alias("highs"), F.min("low").alias("floor"))  # `positives` limits at most
    asks = own.join(limits, own["id"] == limits["anchor"]).select("id", "label", "x", "highs", "floor")

    def slots(asks: pa.Table, ids, label, x):
        a_id, a_label = asks.column("id").to_numpy(), asks.column("label").to_numpy()
        highs, floor = asks.column("highs").to_pylist(), asks.column("floor").to_numpy()
        s = scores(_matrix(asks.column("x"), d), x, exact)
        i, j = np.nonzero((a_label[:, None] != label) & (a_id[:, None] != ids) & (s <= np.array([h[0] for h in highs])[:, None]) & (s >= floor[:, None]))
        got = s[i, j]
        slot = np.zeros(len(i), np.int64)  # how many upper limits a score lies at or below, less one
        wide = np.array([h + [np.iinfo(np.int64).min] * (positives - len(h)) for h in highs], np.int64).reshape(-1, positives)
        for k in range(1, positives):
            slot += got <= wide[i, k]
        z = first_k(i * positives + slot, got, ids[j], keep)
        return a_id[i[z]], slot[z], j[z], got[z]

    kept = _cells(rows, asks, (n, asked), slots, d)
    in_slot = W.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id")
    kept = kept.withColumn("k", F.row_number().over(in_slot)).filter(F.col("k") <= keep)
    # slots in descending order, one after the other: a suffix of this list starts with each slot
    merged = kept.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("slot", F.negative("score").alias("less"), "id"))).alias("e"))  # positives x keep rows
    each = pos.join(limits.select("anchor", "highs"), "anchor").join(merged, "anchor").withColumn("slot", F.array_position("highs", F.col("high")).cast("int") - 1)
    suffix = F.slice(F.filter("e", lambda y: y["slot"] >= F.col("slot")), 1, keep)
    got = each.select("anchor", "positive_id", "positive_score", "low", F.posexplode(suffix).alias("at", "y")).filter(-F.col("y.less") >= F.col("low"))
    negative = F.when(F.col("y.id") < NO_ID, F.col("y.id"))
    return got.select(F.col("anchor").alias("anchor_id"), "positive_id", (F.col("at") + 1).alias("rank"), negative.alias("negative_id"), "positive_score", F.negative("y.less").alias("negative_score"))


def hard_negatives(vectors: DataFrame) -> DataFrame:
    turned = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(vectors, relabel=turned)


ORACLE = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS BIGINT) AS score FROM r a JOIN r b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT a, b AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT p.a AS anchor_id, positive_id, CAST(row_number() OVER w AS INT) AS rank, n.b AS negative_id, positive_score, n.score AS negative_score
FROM p JOIN s n ON n.a = p.a AND NOT n.same AND 50 * positive_score <= 100 * n.score AND 100 * n.score <= 95 * positive_score
WINDOW w AS (PARTITION BY p.a, positive_id ORDER BY n.score DESC, n.b) QUALIFY row_number() OVER w <= 3
"""
