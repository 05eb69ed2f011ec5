"""N-gram Jaccard join with filters under several global token orders.

A document is its set of distinct SHINGLE-word shingles (A-Z lower-cased). Two documents link when 100 * |A & B| >= PERCENT * |A | B|. For any
global order of tokens, linked sets share a token among their first |A| - ceil(PERCENT% of |A|) + 1. Three orders are used:

1. rare first: by the token's count in a sketch of all documents, then by hash. This order is the distributed index: the prefix tokens are
   exchanged, and a token's documents become candidates of each other. The index prefix is a little longer than it must be, so linked sets share several
   tokens in it, and documents that share fewer with all others together drop out before candidates are made.
2. ascending hash and 3. descending hash.

A pair of candidates must share prefix tokens under each of the three orders; only pairs that pass all three are verified, by exact counts of shared shingles.

What keeps the work near the input's size:

* documents with equal sets are one class, told by a hash of the set; only classes go through the index. Classes of very many documents are few
  (HEAVY of all documents at most), so their documents find their class in a broadcast list, all others by a shuffle;
* candidates of a token form a star about its least class (for very common tokens, one star per slice of classes, and one star of the slices'
  centres); the components of the stars hold every candidate pair inside them;
* where many texts share passages by chance, stars chain unrelated documents into components that grow faster than the input. So a component of more than MIXED classes
  is parted anew: tokens of up to RARE classes are counted pair by pair, and only pairs of like size that share as many as linked sets must are edges; tokens of more
  classes stay stars, each within a run of like sizes. The list of pairs has at most (RARE - 1) / 2 rows for each row of the index, and smaller components make none;
* a component is verified in blocks of bounded size. If it has several blocks, each is verified with a few hubs of the component first;
  after that only the documents that are still apart from the component's main part are verified against all its blocks. Nothing is capped:
  the work for one component can grow with (documents still apart) x (its documents), counted by matrix products inside blocks.

The sketch counts every distinct shingle of every document. It has a cell for about TOKENS_A_CELL tokens, as the input's size tells, and at most
MOST_CELLS, so what is broadcast is bounded. Tokens that share a cell share a count; an order need not be exact to be safe, only the same for all. A token of
d documents stands out of the rarest fifth once d is some roots of the mean count of a cell. Whether a token is so common that its classes are sliced is told above what a cell
holds anyhow, so tokens that nobody shares are dropped at any size of the input.

Defined results: null or empty text, or text without words, has an empty set (n_shingles 0), takes no part in the index and links with nothing; with fewer than
SHINGLE words the whole sequence is the one shingle; very long texts are taken whole (a worker holds a few numbers per word of one text, and the sets of one block);
equal sets have similarity 1; rows that share an id are one document and should hold one text (repeated rows get the same result); rows with null id have
component null; further columns of any name are kept by keep_one; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import HEAVY, WordHasher, counted_stage, grams, heavy_join, ref, release, small_batches, stage, sweep, unstage
from .graph import components, small
from .substring import by_bytes, doc_words

SHINGLE, PERCENT = 5, 80
#: The sketch: cells at least and at most, tokens for which there is one cell, bytes of text for a token, pieces in which it is added up.
LEAST_CELLS, MOST_CELLS, TOKENS_A_CELL, TOKEN_BYTES, PARTS = 1 << 16, 1 << 24, 32, 6, 64
SLICE = 2000
BLOCK_ROWS, BLOCK_SHINGLES, HUBS = 512, 400_000, 16
#: A set of n tokens has n // EXTRA more of them in the index than it must; components of more than MIXED classes are parted by pairs, over tokens of up to RARE classes.
EXTRA, MIXED, RARE = 20, 64, 32


def prefix_size(n: int) -> int:
    return n - -(-PERCENT * n // 100) + 1 if n else 0


def extra(n):
    """How many tokens more than prefix_size(n) the index takes: linked sets then share at least 1 + the smaller extra among them."""
    return n // EXTRA


def sets(col, hasher: WordHasher):
    """For each row of a string column its shingles' hashes, distinct and ascending."""
    words, begin = doc_words(col, hasher)
    all_grams = grams(words, SHINGLE)
    for a, b in zip(begin[:-1], begin[1:]):
        n = b - a
        yield np.unique(all_grams[a : b - SHINGLE + 1]) if n >= SHINGLE else grams(words[a:b], int(n)) if n else np.empty(0, np.uint64)


def fingerprint(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


# ---- verification inside a block -------------------------------------------------------------------------------


def shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """(left, right) numbers of common tokens. Rare tokens are counted pair by pair, common ones by matrix products over slabs of columns."""
    out = np.zeros((len(left), len(right)), np.int32)
    lt, rt = np.concatenate(left), np.concatenate(right)
    lr, rr = np.repeat(np.arange(len(left)), [len(x) for x in left]), np.repeat(np.arange(len(right)), [len(x) for x in right])
    u, code = np.unique(np.concatenate([lt, rt]), return_inverse=True)
    lc, rc = code[: len(lt)], code[len(lt) :]
    ln, rn = np.bincount(lc, minlength=len(u)), np.bincount(rc, minlength=len(u))
    few = (ln > 0) & (rn > 0) & (ln * rn <= 64)
    many = (ln > 0) & (rn > 0) & ~few
    lo, ro = np.argsort(lc, kind="stable"), np.argsort(rc, kind="stable")
    ls, rs = np.concatenate([[0], np.cumsum(ln)]), np.concatenate([[0], np.cumsum(rn)])
    z = np.flatnonzero(few)
    if len(z):
        pairs = ln[z] * rn[z]
        t = np.repeat(z, pairs)
        k = np.arange(pairs.sum()) - np.repeat(np.cumsum(pairs) - pairs, pairs)
        np.add.at(out, (lr[lo[ls[t] + k // rn[t]]], rr[ro[rs[t] + k % rn[t]]]), 1)
    z = np.flatnonzero(many)
    for a in range(0, len(z), 2048):
        slab = z[a : a + 2048]
        at = np.full(len(u), -1)
        at[slab] = np.arange(len(slab))
        x, y = np.zeros((len(left), len(slab)), np.float32), np.zeros((len(right), len(slab)), np.float32)
        m, n = at[lc] >= 0, at[rc] >= 0
        x[lr[m], at[lc[m]]] = 1
        y[rr[n], at[rc[n]]] = 1
        out += (x @ y.T).astype(np.int32)
    return out


def alike(left: list[np.ndarray], right: list[np.ndarray], left_rare: list[np.ndarray], right_rare: list[np.ndarray]) -> np.ndarray:
    """(left, right) booleans: linked. left_rare, right_rare: the prefixes under the first order, ascending. Candidates must share prefix tokens under all
    three orders before their sets are compared."""
    nl, nr = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    first = lambda s: [x[: prefix_size(len(x))] for x in s]
    last = lambda s: [x[len(x) - prefix_size(len(x)) :] for x in s]
    orders = [(left_rare, right_rare), (first(left), first(right)), (last(left), last(right))]
    if len(left) * len(right) <= 64:
        out = np.zeros((len(left), len(right)), bool)
        meet = lambda a, b: np.intersect1d(a, b, assume_unique=True).size
        for i in range(len(left)):
            for j in range(len(right)):
                if 100 * min(nl[i], nr[j]) >= PERCENT * max(nl[i], nr[j]) and all(meet(l[i], r[j]) for l, r in orders):
                    n = meet(left[i], right[j])
                    out[i, j] = 100 * n >= PERCENT * (nl[i] + nr[j] - n)
        return out
    mask = 100 * np.minimum(nl[:, None], nr) >= PERCENT * np.maximum(nl[:, None], nr)
    for l, r in orders:  # each filter looks at the rows and columns that the ones before left
        li, ri = np.flatnonzero(mask.any(1)), np.flatnonzero(mask.any(0))
        if not len(li):
            return mask
        mask[np.ix_(li, ri)] &= shared([l[i] for i in li], [r[j] for j in ri]) > 0
    li, ri = np.flatnonzero(mask.any(1)), np.flatnonzero(mask.any(0))
    if not len(li):
        return mask
    n = np.zeros(mask.shape, np.int32)
    n[np.ix_(li, ri)] = shared([left[i] for i in li], [right[j] for j in ri])
    return mask & (100 * n >= PERCENT * (nl[:, None] + nr - n))


def stars(ids_l: np.ndarray, ids_r: np.ndarray, link: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (least id, other id) that connect what `link` connects."""
    ids, at = np.unique(np.concatenate([ids_l, ids_r]), return_inverse=True)
    l, r = at[: len(ids_l)], at[len(ids_l) :]
    top = np.arange(len(ids))
    far = len(ids)
    while True:
        new = top.copy()
        np.minimum.at(new, r, np.where(link, top[l][:, None], far).min(0, initial=far))
        np.minimum.at(new, l, np.where(link, new[r], far).min(1, initial=far))
        new = new[new]
        if (new == top).all():
            break
        top = new
    own = np.flatnonzero(top < np.arange(len(ids)))
    return ids[top[own]], ids[own]


def _groups(batches, keys: int):
    """Runs of rows with equal keys, over batches of rows that are sorted by them; one run is held at a time."""
    held, at = [], None
    for b in batches:
        cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        cut = [0, *(np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols])) + 1).tolist(), b.num_rows] if b.num_rows else []
        for s, e in zip(cut, cut[1:]):
            key = tuple(int(c[s]) for c in cols)
            if key != at and held:
                yield at, held
                held = []
            at = key
            held.append(b.slice(s, e - s))
    if held:
        yield at, held


def _verify(df: DataFrame) -> DataFrame:
    """df: g, a, b, side (0 left, 1 right, 2 both), doc, s (the set), p (its prefix, rare first). Gives connecting links (u, v) of every group (g, a, b)."""

    def run(batches):
        held, many = [], 0
        for _, parts in _groups(batches, 3):
            t = pa.Table.from_batches(parts)
            side, ids = t.column("side").to_numpy(), t.column("doc").to_numpy()
            own, rare = ([np.frombuffer(x, np.uint64) for x in t.column(c).to_pylist()] for c in ("s", "p"))
            l, r = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
            if len(l) and len(r):
                held.append(stars(ids[l], ids[r], alike([own[i] for i in l], [own[i] for i in r], [rare[i] for i in l], [rare[i] for i in r])))
                many += len(held[-1][0])
            if many > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held)], ["u", "v"])
                held, many = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held)], ["u", "v"])
        release()

    dealt = df.select("g", "a", "b", "side", "doc", "s", "p").repartition("g", "a", "b").sortWithinPartitions("g", "a", "b")
    return dealt.mapInArrow(run, "u long, v long")


# ---- the join ---------------------------------------------------------------------------------------------------


def cell_count(text_bytes: int) -> int:
    """Cells of the sketch: a power of two that follows the input up to a bound."""
    wanted = text_bytes / TOKEN_BYTES / TOKENS_A_CELL
    n = LEAST_CELLS
    while n < wanted and n < MOST_CELLS:
        n *= 2
    return n


def cells(s: np.ndarray, many: int) -> np.ndarray:
    """The sketch's cell of each token; from high bits, as the order's ties go by the whole hash."""
    return (s >> np.uint64(64 - many.bit_length() + 1)).astype(np.int64)


def _profiles(docs: DataFrame, width: int) -> tuple[DataFrame, np.ndarray]:
    """All documents' (doc, n, fp, cid), written once, and the sketch: the sum of what every task counts over its documents. cid: half of fp."""
    names = ["doc", "n", "fp", "cid", "part", "counts"]
    parts = min(PARTS, width)
    per = width // parts

    def run(batches):
        hasher, seen = WordHasher(lower=True), np.zeros(width, np.uint32)
        for whole in batches:
            for b in by_bytes(whole, 1):
                own = list(sets(b.column(1), hasher))
                seen += np.bincount(cells(np.concatenate(own), width), minlength=width).astype(np.uint32)
                fp = [fingerprint(s) for s in own]
                cid = np.frombuffer(b"".join(fp), np.int64)[::2]
                k = b.num_rows
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in own], pa.int64()), pa.array(fp, pa.binary()), pa.array(cid), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names)
        for part in range(parts):
            mine = seen[part * per : (part + 1) * per]
            if mine.any():
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), pa.array([part], pa.int32()), pa.array([zlib.compress(mine.tobytes(), 1)], pa.binary())], names)
        del seen
        release()

    def total(batches):
        sums: dict[int, np.ndarray] = {}  # a partition holds some of the parts, whatever the number of tasks
        for b in batches:
            for part, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                got = np.frombuffer(zlib.decompress(data), np.uint32)
                sums[part] = sums[part] + got if part in sums else got.copy()
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["part", "counts"])

    x = stage(docs.mapInArrow(run, "doc long, n long, fp binary, cid long, part int, counts binary"), "profiles")
    got = x.filter("part is not null").select("part", "counts").repartition("part").mapInArrow(total, "part int, counts binary").toArrow()
    sketch = np.zeros(width, np.uint32)
    for part, data in zip(got.column(0).to_pylist(), got.column(1)):
        sketch[part * per : (part + 1) * per] = np.frombuffer(data.as_buffer(), np.uint32)
    del got
    release()
    own = stage(x.filter("part is null").select("doc", "n", "fp", "cid"), "documents")
    unstage(x)  # most of it were the tasks' counts
    return own, sketch


def rare_first(s: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A set's tokens in the first order, and their counts in the sketch."""
    n = counts[cells(s, len(counts))]
    at = np.argsort(n, kind="stable")
    return s[at], n[at].astype(np.int64)


def very_common(counts: np.ndarray) -> int:
    """The count from which a token's classes are dealt over slices. A cell also counts what other tokens add to it, about as much as the median cell holds, which grows with the
    input once there are MOST_CELLS; so the bound lies above that, and a token that isn't sliced has fewer classes than it."""
    return SLICE + 2 * int(np.median(counts))


def _postings(docs: DataFrame, sketch, least: int) -> DataFrame:
    """(token, cell, cid, need) of the index prefixes' tokens; cell: a very common token's slice of classes, else 0; need: how many of its
    prefix tokens a class shares with any that it can link with. least: the count in the sketch from which a token is very common."""
    per = SLICE

    def run(batches):
        hasher, seen = WordHasher(lower=True), set()
        counts = sketch.value
        for whole in batches:
            for b in by_bytes(whole, 1):
                tokens, slices, ids, needs = [], [], [], []
                for s in sets(b.column(1), hasher):
                    if not len(s):
                        continue
                    fp = fingerprint(s)
                    if fp in seen:  # an equal set of this task stands for it
                        continue
                    seen.add(fp)
                    cid = np.frombuffer(fp, np.int64)[0]
                    t, n = rare_first(s, counts)
                    t, n = t[: prefix_size(len(s)) + extra(len(s))], n[: prefix_size(len(s)) + extra(len(s))]
                    tokens.append(t)
                    slices.append(np.where(n >= least, 1 + np.int64((int(cid) & 0x7FFFFFFF)) % (n // per + 1), 0))
                    ids.append(np.full(len(t), cid))
                    needs.append(np.full(len(t), 1 + extra(-(-PERCENT * len(s) // 100)), np.int32))  # the smallest partner has so many extra tokens
                if tokens:
                    t = np.concatenate(tokens).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(np.concatenate(slices).astype(np.int32)), pa.array(np.concatenate(ids)), pa.array(np.concatenate(needs))], ["token", "cell", "cid", "need"])
        del seen
        release()

    return docs.filter("id is not null and text is not null").mapInArrow(run, "token long, cell int, cid long, need int")


def _shared(p: DataFrame) -> DataFrame:
    """Rows of p whose token another class has too in its cell, each once; lo: the least class there."""
    at = W.partitionBy("token", "cell").orderBy("cid")
    whole = at.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    x = p.withColumns({"lo": F.first("cid").over(whole), "hi": F.last("cid").over(whole), "before": F.lag("cid").over(at)})
    return x.filter("(cell > 0 or lo < hi) and (before is null or before < cid)").select("token", "cell", "cid", "need", "lo")


def _met(postings: DataFrame) -> DataFrame:
    """(token, cell, cid, lo) of the index prefixes' shared tokens, written once.

    A set that can link with some set of at least PERCENT% of its size shares `need` tokens of its index prefix with it. Sets that share
    fewer with all others together are left out, twice, as leaving out some makes tokens of others unshared."""
    spark = postings.sparkSession
    first = stage(_shared(postings), "met")
    sweep(spark)  # all prefixes were exchanged for it
    p = first
    for _ in range(2):
        p = _shared(p.withColumn("k", F.count("*").over(W.partitionBy("cid"))).filter("k >= need").select("token", "cell", "cid", "need"))
    p = stage(p.filter("cell > 0 or lo < cid").select("token", "cell", "cid", "lo"), "shared")
    unstage(first)
    sweep(spark)
    return p


def _stars(p: DataFrame) -> DataFrame:
    """Candidate edges (u, v) of classes: each with the least one of a token that both have."""
    inner = p.filter("lo < cid").select(F.col("lo").alias("u"), F.col("cid").alias("v"))
    centres = p.filter("cell > 0").select("token", "lo").distinct()
    outer = centres.join(centres.groupBy("token").agg(F.min("lo").alias("m")), "token").filter("m < lo").select(F.col("m").alias("u"), F.col("lo").alias("v"))
    return inner.unionByName(outer)


def _pairs(p: DataFrame, sizes: DataFrame) -> DataFrame:
    """Candidate edges (u, v) of the classes in sizes (cid, n), fewer than their stars. p: what _met gave, with all classes of a token in sizes or none.

    Linked sets share a token of more than RARE classes, where they are in one run of sizes that are PERCENT% of the next at least, or all that they must
    share are tokens of fewer classes, and are counted for the pair."""
    rows = p.filter("cell = 0").join(sizes, "cid").select("token", "cid", "n", "lo")
    least = rows.select("token", F.col("lo").alias("cid")).distinct().join(sizes, "cid")
    sets = rows.drop("lo").unionByName(least.select("token", "cid", "n")).groupBy("token").agg(F.sort_array(F.collect_list(F.struct("n", "cid"))).alias("c"))
    a = F.col("a")
    after = lambda y: ((y["n"] > a["n"]) | ((y["n"] == a["n"]) & (y["cid"] > a["cid"]))) & (PERCENT * y["n"] <= 100 * a["n"])
    both = sets.filter(F.size("c") <= RARE).select(F.explode("c").alias("a"), "c").select("a", F.explode(F.filter("c", after)).alias("b"))
    both = both.groupBy(F.col("a.cid").alias("u"), F.col("b.cid").alias("v")).agg(F.count("*").alias("k"), F.min("a.n").alias("n"))
    few = both.filter(f"k >= 1 + n div {EXTRA}").select("u", "v")
    at = W.partitionBy("token").orderBy("n", "cid")
    many = sets.filter(F.size("c") > RARE).select("token", F.explode("c").alias("x")).select("token", "x.n", "x.cid")
    many = many.withColumn("cut", F.coalesce(PERCENT * F.col("n") > 100 * F.lag("n").over(at), F.lit(True)))
    many = many.select(F.last(F.when(F.col("cut"), F.col("cid")), ignorenulls=True).over(at).alias("u"), F.col("cid").alias("v"))
    return few.unionByName(many).unionByName(_stars(p.filter("cell > 0").join(sizes, "cid", "left_semi")))


def _candidates(p: DataFrame, classes: DataFrame) -> DataFrame:
    """cid, g: components of candidates. Those of the stars, where large ones are parted by pairs; a class of a large one that is in no pair is left out."""
    name = lambda x: x.select(F.col("node").alias("cid"), F.col("component").alias("g"))
    cand = stage(name(components(_stars(p))), "candidates")
    sizes = stage(classes.join(cand, "cid").groupBy("cid").agg(F.min("n").alias("n"), F.first("g").alias("g")), "sizes")
    mixed = sizes.groupBy("g").agg(F.count("*").alias("m"), F.sum("n").alias("w")).filter((F.col("m") > min(MIXED, BLOCK_ROWS)) | (F.col("w") > BLOCK_SHINGLES))
    mixed, parted = counted_stage(mixed.select("g"), "mixed")
    if not parted:
        return cand
    sizes, many = counted_stage(sizes.join(small(mixed, parted), "g").select("cid", "n"), "mixed-sizes")
    anew = stage(name(components(_pairs(p, small(sizes, many)))), "parted")
    return cand.join(small(mixed, parted), "g", "left_anti").select("cid", "g").unionByName(anew)


def join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, n_shingles, component: one row per row of docs."""
    small_batches(docs.sparkSession)
    src = docs.select(ref(id_col).cast("long").alias("id"), ref(text_col).alias("text"))
    size = src.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    own, counts = _profiles(src, cell_count(size.bytes))
    sketch = docs.sparkSession.sparkContext.broadcast(counts)  # at most MOST_CELLS * 4 bytes
    least = very_common(counts)
    del counts
    release()
    # classes of equal sets
    classes = own.filter("n > 0 and doc is not null").groupBy("fp", "cid", "n").agg(F.min("doc").alias("rep"), F.count("*").alias("k"))
    classes = stage(classes, "classes")
    sweep(docs.sparkSession)
    met = _met(_postings(src, sketch, least))
    nodes, many = counted_stage(classes.join(_candidates(met, classes), "cid").select(F.col("rep").alias("doc"), "n", "g"), "nodes")
    unstage(met)
    sweep(docs.sparkSession)
    part = _linked(src, nodes, many, sketch)
    sketch.destroy()
    classes = classes.join(part, classes["rep"] == part["node"], "left").select("fp", F.coalesce("component", "rep").alias("component"), "k")
    classes = stage(classes, "components")
    known = heavy_join(own.filter("n > 0 and doc is not null"), classes, "fp", "k", size.rows, HEAVY)
    rest = own.filter("not (n > 0 and doc is not null)").withColumn("component", F.col("doc"))
    out = [x.select("doc", F.col("n").alias("n_shingles"), "component") for x in (known, rest)]
    return out[0].unionByName(out[1])


def _linked(src: DataFrame, nodes: DataFrame, many: int, sketch) -> DataFrame:
    """node, component of the classes (by their least documents) that are linked with others. nodes: doc, n, g of `many` classes; all links lie within the candidates' components g."""
    weight = nodes.groupBy("g").agg(F.count("*").alias("m"), F.sum("n").alias("w"))
    blocks = weight.select("g", F.ceil(F.greatest(F.col("m") / BLOCK_ROWS, F.col("w") / BLOCK_SHINGLES)).cast("int").alias("nb")).filter("nb > 1")
    blocks, parted = counted_stage(blocks, "blocks")
    nodes = nodes.join(small(blocks, parted), "g", "left").select("doc", "g", F.coalesce("nb", F.lit(1)).alias("nb"))
    nodes = nodes.withColumn("blk", F.pmod(F.xxhash64("doc"), F.col("nb")).cast("int"))

    def run(batches):
        hasher, counts = WordHasher(lower=True), sketch.value
        names = ["doc", "g", "nb", "blk", "s", "p"]
        for whole in batches:
            for b in by_bytes(whole, 4):
                own = list(sets(b.column(4), hasher))
                rare = [np.sort(rare_first(s, counts)[0][: prefix_size(len(s))]).tobytes() for s in own]
                yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array([s.tobytes() for s in own], pa.binary()), pa.array(rare, pa.binary())], names)
        release()

    text = src.join(small(nodes, many), F.col("id") == F.col("doc"))
    held = stage(text.select("doc", "g", "nb", "blk", "text").mapInArrow(run, "doc long, g long, nb int, blk int, s binary, p binary"), "sets")
    part = _verified(held, nodes, parted)
    unstage(held)
    sweep(src.sparkSession)
    return part


def _verified(held: DataFrame, nodes: DataFrame, parted: int) -> DataFrame:
    """node, component of the sets in held; what it gives no longer reads them. parted: how many components have several blocks."""
    large = held.filter("nb > 1")
    hub = large.withColumn("k", F.row_number().over(W.partitionBy("g").orderBy(F.xxhash64("doc", F.lit(3)), "doc"))).filter(F.col("k") <= HUBS)
    hub = hub.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).filter("to <> blk")
    cols = ["g", "a", "b", "side", "doc", "s", "p"]
    both = lambda x, a: x.withColumns({"a": F.col(a), "b": F.lit(-1), "side": F.lit(2)}).select(*cols)
    one = both(held, "blk").unionByName(both(hub, "to")) if parted else both(held, "blk")
    part = components(_verify(one))
    if not parted:
        return part
    # large components: what is still apart from the main part is verified against all blocks
    part = stage(part, "parts")
    at = nodes.filter("nb > 1").join(part, F.col("doc") == F.col("node"), "left").select("doc", "g", F.coalesce("component", "doc").alias("part"))
    at = stage(at, "apart")
    main = at.groupBy("g", "part").agg(F.count("*").alias("m")).groupBy("g").agg(F.max_by("part", F.struct("m", "part")).alias("main"))
    apart = at.join(small(main, parted), "g").filter("part <> main").select("doc", "g")
    apart, alone = counted_stage(apart, "alone")
    if not alone:
        return part
    rows = apart.groupBy("g").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("nr"))
    right = large.join(small(rows, parted), "g").withColumn("a", F.explode(F.sequence(F.lit(0), F.col("nr") - 1))).select("g", "a", F.col("blk").alias("b"), F.lit(1).alias("side"), "doc", "s", "p")
    left = large.join(small(apart.join(small(rows, parted), "g").select("doc", "nr"), alone), "doc").withColumn("a", F.pmod(F.xxhash64("doc", F.lit(5)), F.col("nr")).cast("int"))
    left = left.withColumn("b", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select("g", "a", "b", F.lit(0).alias("side"), "doc", "s", "p")
    links, more = counted_stage(_verify(left.unionByName(right)), "links")
    if not more:
        return part
    # what the second pass found links parts with parts
    name = lambda x, c: x.join(part.select(F.col("node").alias(c), F.col("component").alias(f"{c}_part")), c, "left").withColumn(c, F.coalesce(f"{c}_part", c)).drop(f"{c}_part")
    over = stage(components(name(name(links, "u"), "v")).select(F.col("node").alias("was"), F.col("component").alias("now")), "over")
    every = part.unionByName(links.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(part, "node", "left_anti").withColumn("component", F.col("node")))
    return every.join(small(over, 2 * more), F.col("component") == F.col("was"), "left").select("node", F.coalesce("now", "component").alias("component"))


def digests(docs: DataFrame) -> DataFrame:
    return join(docs).select(F.col("doc").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the documents of a component other than its least id; rows that repeat an id stay or go together, rows with null id stay."""
    names = docs.columns
    found = join(docs, id_col=id_col, text_col=text_col)
    drop, many = counted_stage(found.filter("doc <> component").select(F.col("doc").alias("gone")).distinct(), "drop")
    x = docs.select(*[ref(c).alias(f"d{i}") for i, c in enumerate(names)])
    x = x.join(small(drop, many), F.col(f"d{names.index(id_col)}") == F.col("gone"), "left_anti")
    return x.select(*[F.col(f"d{i}").alias(c) for i, c in enumerate(names)])


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[k:k + 4], ' ') END AS g
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS k FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT u, v FROM i JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r AS (SELECT u AS node, u AS to_node FROM e UNION SELECT r.node, e.v FROM r JOIN e ON e.u = r.to_node)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.m, w.doc_id) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN (SELECT node, min(to_node) AS m FROM r GROUP BY node) c ON c.node = w.doc_id
"""
