"""SimHash near-duplicates, found through tables of distances to reference fingerprints.

A fingerprint has a bit set where more than half of the text's 3-word shingles, repeats included, have it set in their 64-bit hash. Documents link when their
fingerprints differ in DISTANCE bits at most; a component is what links connect.

Pivot distance tables. For a row of REFERENCES fixed fingerprints the Hamming distances of every fingerprint to each of them are computed once, band by band (BANDS bands of
bits). Two fingerprints that differ in d bits have distances to any reference that differ by d at most, and the differences of their bands' distances add up to d at most. So:

* at most DISTANCE bands can differ, and in AGREE = BANDS - DISTANCE of them all table entries are equal: the entries of each choice of AGREE bands are a key of
  the exchange, and pairs meet under a key only. (Whole distances alone can't deal out the work: for unrelated fingerprints they differ by more than 3 in half of the
  cases only, so cells of a grid over them would hold nearly everything.)
* where pairs meet, one whose greatest difference over all REFERENCES whole distances exceeds DISTANCE is discarded, coordinate by coordinate;
* what is left is verified by the fingerprints themselves.

Exact copies, and all texts of one fingerprint, are one class that goes through the exchange once, told by its least document. A key with many classes is dealt over blocks: each
is joined inside, with HUBS classes of the key added to every block, and only the classes that are then still apart from the key's main component are held against all
of its blocks. A block sends on a star for each component it found, never its pairs. Nothing is capped; for one key the work can grow with (classes apart) x (its classes).

Defined results: null or empty text, or text without words, has fingerprint zero, which links like any other; with fewer than WORDS words the whole sequence is the one
shingle; very long texts are hashed whole, in blocks; rows that share an id are one document and should hold one text; rows with null id have component null and link
nothing; further columns are not looked at, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_arrow, counted_stage, heavy_join, mix64, ref, stage, text_bytes
from .graph import components, small

WORDS, SEED, DISTANCE = 3, 42, 3
BANDS, REFERENCES = 6, 16
AGREE = BANDS - DISTANCE
#: Classes of a block, hubs of a key that has several blocks, pairs that are looked at in one go, shingles that are hashed in one go.
BLOCK, HUBS, PAIRS, SHINGLES = 1024, 16, 1 << 20, 1 << 15

_EDGES = [round(64 * b / BANDS) for b in range(BANDS + 1)]
MASKS = [np.uint64(((1 << hi) - 1) ^ ((1 << lo) - 1)) for lo, hi in zip(_EDGES, _EDGES[1:])]
PIVOTS = mix64(np.arange(1, REFERENCES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
CHOICES = list(itertools.combinations(range(BANDS), AGREE))


def _lower() -> np.ndarray:
    """Bytes to bytes: A-Z lower-cased, all separators of words to a blank."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    t[9:14] = 32
    return t


def fingerprint(text: np.ndarray, table: np.ndarray = _lower()) -> int:
    """The fingerprint of a text's UTF-8 bytes."""
    x = table[text]
    blank = x == 32
    keep = ~blank
    keep[1:] |= keep[:-1]  # the first blank after a word
    x = x[keep]
    if len(x) and x[-1] == 32:
        x = x[:-1]
    if not len(x):
        return 0
    data, gap = x.tobytes(), np.flatnonzero(x == 32)
    start, end = np.concatenate([[0], gap + 1]), np.concatenate([gap, [len(x)]])
    n = max(1, len(start) - WORDS + 1)
    start, end = start[:n], end[len(end) - n :]
    ones = np.zeros(64, np.int64)
    for a in range(0, n, SHINGLES):
        h = np.array([xxhash.xxh64_intdigest(data[i:j], SEED) for i, j in zip(start[a : a + SHINGLES].tolist(), end[a : a + SHINGLES].tolist())], np.dtype("<u8"))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, *, text_col: str = "text", out: str = "fingerprint") -> DataFrame:
    """docs with the fingerprint of each text as a long (its bits, signed)."""

    def run(cols):
        data, at = text_bytes(cols[0])
        return [pa.array(np.array([fingerprint(data[a:b]) for a, b in zip(at[:-1], at[1:])], np.uint64).view(np.int64))]

    return append_arrow(docs, [ref(text_col)], [(out, T.LongType())], run)


# ---- the tables of distances ------------------------------------------------------------------------------------


def band_distances(fp: np.ndarray) -> np.ndarray:
    """(fingerprint, band, reference): distances within each band; their sum over bands is the whole distance."""
    return np.stack([np.bitwise_count((fp[:, None] ^ PIVOTS) & m) for m in MASKS], 1)


def keys_of(fp: np.ndarray) -> np.ndarray:
    """(fingerprint, choice of bands): the exchange's keys, hashes of all table entries of the chosen bands."""
    shift = (np.arange(REFERENCES) * 4).astype(np.uint64)  # a band has less than 16 bits
    told = mix64((band_distances(fp).astype(np.uint64) << shift).sum(2, dtype=np.uint64))
    out = np.empty((len(fp), len(CHOICES)), np.uint64)
    for k, bands in enumerate(CHOICES):
        key = np.full(len(fp), k + 1, np.uint64)
        for b in bands:
            key = mix64(key * np.uint64(0x9DDFEA08EB382D69) + told[:, b])
        out[:, k] = key
    return out.view(np.int64)


def verified(fp: np.ndarray, table: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (i, j) that link: first all references, then the fingerprints. table: (fingerprint, reference)."""
    for r in range(table.shape[1]):
        if not len(i):
            break
        near = np.abs(table[i, r] - table[j, r]) <= DISTANCE
        i, j = i[near], j[near]
    link = np.bitwise_count(fp[i] ^ fp[j]) <= DISTANCE
    return i[link], j[link]


def stars(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (least id, other id) that connect what the pairs (i, j) of positions connect."""
    order = np.argsort(ids, kind="stable")
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    a, b, top = rank[i], rank[j], np.arange(len(ids))
    while True:
        new, least = top.copy(), np.minimum(top[a], top[b])
        for at in (a, b, top[a], top[b]):
            np.minimum.at(new, at, least)
        new = new[new]
        if (new == top).all():
            break
        top = new
    own = np.flatnonzero(top < np.arange(len(ids)))
    return ids[order[top[own]]], ids[order[own]]


def _links(rows: DataFrame) -> DataFrame:
    """rows: key, a, b (a block of a key), side (0 left, 1 right, 2 both), node, fp. Connecting links (u, v) of each block."""

    def block(t: pa.Table) -> pa.RecordBatch | None:
        """Whole blocks, sorted."""
        key, a, b, side, node = (t.column(c).to_numpy() for c in ("key", "a", "b", "side", "node"))
        n = len(key)
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        end = np.append(np.flatnonzero(new)[1:], n)[np.cumsum(new) - 1]
        begin = np.flatnonzero(new)[np.cumsum(new) - 1]
        left = np.bincount(begin, weights=side == 0, minlength=n).astype(np.int64)[begin]  # rows of a block's left side, which come first
        at = np.arange(n)
        lo = np.where(side == 2, at + 1, begin + left)
        many = np.where(side == 1, 0, end - lo)
        fp, table, us, vs = t.column("fp").to_numpy().view(np.uint64), None, [], []
        cut = 0
        total = np.cumsum(many)
        while cut < n:
            to = max(cut + 1, int(np.searchsorted(total, (total[cut - 1] if cut else 0) + PAIRS, side="right")))
            k = many[cut:to]
            if k.sum():
                if table is None:
                    table = band_distances(fp).sum(1, dtype=np.int16)
                i = np.repeat(at[cut:to], k)
                j = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(lo[cut:to], k)
                i, j = verified(fp, table, i, j)
                # stars of this part of the pairs; parts meet again in the components
                own, z = np.unique(np.concatenate([i, j]), return_inverse=True)
                u, v = stars(node[own], z[: len(i)], z[len(i) :])
                us.append(u)
                vs.append(v)
            cut = to
        if not us:
            return None
        both = np.unique(np.stack([np.concatenate(us), np.concatenate(vs)], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["u", "v"])

    def run(batches):
        held = []
        for x in batches:
            if not x.num_rows:
                continue
            cols = [x.column(k).to_numpy() for k in range(3)]
            last = x.num_rows - 1
            same = np.flatnonzero(np.logical_or.reduce([c != c[last] for c in cols]))
            cut = int(same[-1]) + 1 if len(same) else 0  # where the batch's last block begins
            if held:
                begins = [held[-1].column(k)[held[-1].num_rows - 1].as_py() for k in range(3)]
                if not cut and begins == [int(c[last]) for c in cols]:
                    held.append(x)
                    continue
            if cut:
                t = pa.Table.from_batches([*held, x.slice(0, cut)])
                held = [x.slice(cut)]
            else:
                t = pa.Table.from_batches(held) if held else None
                held = [x]
            if t is not None and (got := block(t)) is not None:
                yield got
        if held and (got := block(pa.Table.from_batches(held))) is not None:
            yield got

    dealt = rows.select("key", "a", "b", "side", "node", "fp").repartition("key", "a", "b").sortWithinPartitions("key", "a", "b", "side")
    return dealt.mapInArrow(run, "u long, v long")


def linked(classes: DataFrame) -> DataFrame:
    """classes: node, fp (each once). node, component of those that are linked with others."""

    def spread(batches):
        for x in batches:
            for s in range(0, x.num_rows, 4096):
                b = x.slice(s, 4096)
                key = keys_of(b.column(1).to_numpy().view(np.uint64))
                k = key.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(np.repeat(b.column(0).to_numpy(), k)), pa.array(np.repeat(b.column(1).to_numpy(), k))], ["key", "node", "fp"])

    keyed = stage(classes.select("node", "fp").mapInArrow(spread, "key long, node long, fp long"), "keys")
    big = keyed.groupBy("key").agg(F.count("*").alias("m")).filter(F.col("m") > BLOCK).select("key", F.ceil(F.col("m") / BLOCK).cast("int").alias("nb"))
    big, many = counted_stage(big, "large_keys")
    rows = keyed.join(small(big, many), "key", "left").select("key", "node", "fp", F.coalesce("nb", F.lit(1)).alias("nb"))
    rows = rows.withColumn("blk", F.pmod(F.xxhash64("fp"), F.col("nb")).cast("int"))
    both = lambda x, a: x.select("key", F.col(a).alias("a"), F.lit(-1).alias("b"), F.lit(2).alias("side"), "node", "fp")
    if not many:
        return components(_links(both(rows, "blk")))
    large = stage(rows.filter("nb > 1"), "large")
    hub = large.withColumn("k", F.row_number().over(W.partitionBy("key").orderBy(F.xxhash64("fp", F.lit(3)), "fp"))).filter(F.col("k") <= HUBS)
    hub = hub.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).filter("to <> blk")
    links = stage(_links(both(rows, "blk").unionByName(both(hub, "to"))), "links")
    part = stage(components(links), "parts")
    at = large.join(part, "node", "left").select("key", "node", "fp", "nb", "blk", F.coalesce("component", "node").alias("part"))
    main = at.groupBy("key", "part").agg(F.count("*").alias("m")).groupBy("key").agg(F.max_by("part", F.struct("m", "part")).alias("main"))
    apart, alone = counted_stage(at.join(small(main, many), "key").filter("part <> main").select("key", "node", "fp", "nb"), "apart")
    if not alone:
        return part
    parts = apart.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("nr"))
    left = apart.join(small(parts, many), "key").withColumn("a", F.pmod(F.xxhash64("fp", F.lit(5)), F.col("nr")).cast("int"))
    left = left.select("key", "a", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("b"), F.lit(0).alias("side"), "node", "fp")
    right = large.join(small(parts, many), "key").select("key", F.explode(F.sequence(F.lit(0), F.col("nr") - 1)).alias("a"), F.col("blk").alias("b"), F.lit(1).alias("side"), "node", "fp")
    return components(links.unionByName(_links(left.unionByName(right))))


def join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, fp, component: one row per row of docs."""
    src = docs.select(ref(id_col).cast("long").alias("doc"), ref(text_col).alias("text"))
    own, rows = counted_stage(with_fingerprint(src, out="fp").select("doc", "fp"), "fingerprints")
    known = own.filter("doc is not null")
    classes = stage(known.groupBy("fp").agg(F.min("doc").alias("node"), F.count("*").alias("k")), "classes")
    part = linked(classes)
    named = classes.join(part, "node", "left").select("fp", F.coalesce("component", "node").alias("component"), "k")
    found = heavy_join(known, stage(named, "components"), "fp", "k", rows)
    return found.select("doc", "fp", "component").unionByName(own.filter("doc is null").withColumn("component", F.lit(None).cast("long")))


def digests(docs: DataFrame) -> DataFrame:
    return join(docs).select(F.col("doc").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
