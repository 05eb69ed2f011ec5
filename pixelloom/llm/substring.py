"""Substring dedup by relative Lempel-Ziv parsing against an index of all documents' blocks.

A document is cut into content-defined blocks: each window of WINDOW words belongs to the least-hashed GRAM-word gram in it (its anchor), and the
windows of one anchor are a block, so equal windows lie in blocks of equal anchors wherever they occur. The index is made in two steps:

1. blocks are exchanged by their anchors, a few bytes each, and those of one document together. Only blocks whose anchor another document has too can hold a repeated window;
2. those are exchanged with the 64-bit hashes of all their windows. The index holds each window once, at its least (document, position),
   which is the reference block that a later document is factored against.

A document is then parsed from left to right: a factor starts at the first window that a smaller document holds and goes on as long as the next
window follows in the same reference. Windows that straddle two factors are windows of blocks of their own and are looked up like all others, so
nothing is lost at factor boundaries. Factors have WINDOW words or more; the words they cover are the duplicate spans.

Hot passages: a worker resolves by itself what documents of its batch share, and remembers (up to SEEN entries) what it has met before in its task. Of
an anchor that many documents share two rows go to the anchor's task, and of a window the least document's, so a passage that a third of
all rows hold costs a few rows per task. Rows that are already resolved go to their document's task and meet no other key.

Two windows count as equal if the 64-bit hashes of all their words are; anchors only decide what is looked up. An anchor that stands in very many contexts (a line that a third
of all rows hold) would bring all of them to one task: such anchors are found in a sample of SAMPLE documents, those of more than one block in HEAVY, and their windows go
each by its own hash instead. The list has HEAVY entries at most; it decides where windows meet, never which.

Defined results: null or empty text has no words and loses none; a document with fewer words than a window loses none; very long texts are parsed whole (a
worker holds one text and a few numbers per word of it); references are documents with a smaller id only, so rows that
share an id never remove each other's words, and spans are kept by id (repeated rows get the same result); rows with null id are neither reference nor
shortened; further columns are kept, and one that has the name of an output is replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ARROW_BYTES, HEAVY, WordHasher, append_arrow, grams, lists, mix64, ref, small_batches, text_bytes

WINDOW, GRAM = 13, 5
BATCH_BYTES = ARROW_BYTES
#: Anchors, and windows with their leaders, that a task remembers; beyond, it forgets the older ones and sends some rows more.
SEEN = 1 << 20
#: Documents of the sample that tells very common anchors, and the share of blocks, one in HEAVY, from which an anchor is one.
SAMPLE = 4000
_POS = np.uint64((1 << 24) - 1)
#: at: for each block of the anchor in the document, position << 5 | number of windows << 1 | whether it is known to be shared.
BLOCKS = "key long, doc long, at array<long>"
WINDOWS = "key long, doc long, pos int, hs array<long>, n int, ref_doc long, ref_pos int"
_NAMES = ["key", "doc", "pos", "hs", "n", "ref_doc", "ref_pos"]


def doc_words(col, hasher: WordHasher) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of an Arrow string column, and where each row's words begin (rows + 1 numbers)."""
    data, offsets = text_bytes(col)
    rows = len(offsets) - 1
    data = np.insert(data[offsets[0] : offsets[-1]], offsets[1:-1] - offsets[0], 32)  # a blank between rows
    at = offsets - offsets[0] + np.concatenate([np.arange(rows), [rows - 1]])
    words, starts, _ = hasher(data)
    return words, np.searchsorted(starts, at)


def anchors(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window of WINDOW words the position of its anchor (least hash, then leftmost); and all grams' hashes."""
    g = grams(words, GRAM, 4)
    key = (g & ~_POS) | (np.arange(len(g), dtype=np.uint64) & _POS)
    width, have, low = WINDOW - GRAM + 1, 1, key
    while have < width:  # minima of runs of doubling length
        step = min(have, width - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    i = np.arange(len(low), dtype=np.int64)
    return i + (((low & _POS).astype(np.int64) - i) & int(_POS)), g


def runs(*same: np.ndarray) -> np.ndarray:
    """First positions of the runs in which none of the arrays changes."""
    n = len(same[0])
    cut = np.zeros(n, bool)
    if n:
        cut[0] = True
        for x in same:
            cut[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(cut)


def _found(x: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which x are in known (ascending), and where."""
    if not len(known):
        return np.zeros(len(x), bool), np.zeros(len(x), np.int64)
    at = np.minimum(np.searchsorted(known, x), len(known) - 1)
    return known[at] == x, at


class BlockSender:
    """The rows of BLOCKS for a task's batches. common: anchors that documents are known to share, ascending."""

    def __init__(self, common: np.ndarray):
        self.common = common
        self.hot = common  # anchors that documents of this task share, ascending

    def __call__(self, ids: np.ndarray, words: np.ndarray, begin: np.ndarray) -> list[pa.Array] | None:
        if len(words) < WINDOW:
            return None
        row = np.repeat(np.arange(len(ids)), np.diff(begin))
        p, g = anchors(words)
        i = np.flatnonzero(row[: len(p)] == row[WINDOW - 1 :])
        if not len(i):
            return None
        a = runs(p[i], row[i])  # a row's windows are neighbours, and so are those of an anchor
        k = np.diff([*a, len(i)])
        f = i[a]
        key, doc, pos = g[p[f]], ids[row[f]], f - begin[row[f]]
        sure, _ = _found(key, self.hot)
        left = np.flatnonzero(~sure)
        order = left[np.lexsort((doc[left], key[left]))]
        if len(order):
            first = runs(key[order])
            last = np.append(first[1:], len(order)) - 1
            two = doc[order[first]] != doc[order[last]]  # the least and the largest document tell the anchor's task that it is shared
            shared = np.repeat(two, last - first + 1)
            shared[first[two]] = shared[last[two]] = False
            sure[order[shared]] = True
            self.hot = np.union1d(self.hot if len(self.hot) < SEEN else self.common, key[order[first[two]]])
        key = np.where(sure, mix64(doc.astype(np.uint64) * np.uint64(31)), key)
        # one row for a document's blocks of an anchor: a line that a text repeats is no more rows than one that it has once
        order = np.lexsort((pos, doc, key))
        first = runs(key[order], doc[order])
        at = (pos.astype(np.int64) << 5 | k << 1 | sure)[order]
        return [pa.array(key[order[first]].view(np.int64)), pa.array(doc[order[first]]), lists(pa.array(at), np.diff([*first, len(order)]))]


class WindowSender:
    """The rows of WINDOWS for a task's batches: blocks of windows to look up (hs), and runs of windows that are resolved (n > 0). common: anchors whose windows go each by its own hash."""

    def __init__(self, common: np.ndarray):
        self.common = common
        self.h, self.doc, self.pos = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)  # leaders, by hash

    def __call__(self, ids: np.ndarray, words: np.ndarray, begin: np.ndarray, at: np.ndarray, counts: np.ndarray) -> list[pa.Array] | None:
        """at: the blocks of all rows, counts: how many are each row's."""
        if len(words) < WINDOW or not len(at):
            return None
        row = np.repeat(np.arange(len(ids)), counts)
        k = at >> 1 & 15
        i = np.repeat(begin[row] + (at >> 5), k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        r = np.repeat(row, k)
        i, once = np.unique(i, return_index=True)
        r = r[once]
        inside = i + WINDOW <= begin[r + 1]  # rows that share an id may differ in length
        i, r = i[inside], r[inside]
        if not len(i):
            return None
        h, doc, pos = grams(words, WINDOW, 13)[i], ids[r], i - begin[r]
        # leaders: the least (document, position) of each window, of those known and of this batch
        order = np.lexsort((pos, doc, h))
        first = runs(h[order])
        size = np.diff([*first, len(order)])
        lead = order[first]
        known, where = _found(h[lead], self.h)
        if not len(self.h):
            lead_doc, lead_pos = doc[lead], pos[lead]
        else:
            older = known & (self.doc[where] < doc[lead])
            lead_doc, lead_pos = np.where(older, self.doc[where], doc[lead]), np.where(older, self.pos[where], pos[lead])
        lead_doc_of, lead_pos_of = np.empty(len(h), np.int64), np.empty(len(h), np.int64)
        lead_doc_of[order], lead_pos_of[order] = np.repeat(lead_doc, size), np.repeat(lead_pos, size)
        keep = known | (doc[lead] != doc[order[first + size - 1]])  # windows that several documents of the task have
        self._remember(h[lead][keep], lead_doc[keep], lead_pos[keep])
        done = doc > lead_doc_of
        left, z = np.flatnonzero(~done), np.flatnonzero(done)
        c = runs(r[z], lead_doc_of[z], pos[z] - lead_pos_of[z], pos[z] - np.arange(len(z)))
        n = np.diff([*c, len(z)])
        z = z[c]
        p, g = anchors(words)
        own, alone = g[p[i[left]]], _found(g[p[i[left]]], self.common)[0]
        own = np.where(alone, mix64(h[left]), own)
        a = runs(p[i[left]], own, r[left], i[left] - np.arange(len(left)))
        count = np.concatenate([np.diff([*a, len(left)]), np.zeros(len(z), np.int64)])
        f = left[a]
        hashes = lists(pa.array(h[left].view(np.int64)), count)
        none = np.zeros(len(f), np.int64)
        spread = mix64(doc[z].astype(np.uint64) * np.uint64(31) + pos[z].astype(np.uint64))
        return [
            pa.array(np.concatenate([own[a], spread]).view(np.int64)), pa.array(np.concatenate([doc[f], doc[z]])), pa.array(np.concatenate([pos[f], pos[z]]).astype(np.int32)), hashes,
            pa.array(np.concatenate([none, n]).astype(np.int32)), pa.array(np.concatenate([none, lead_doc_of[z]])), pa.array(np.concatenate([none, lead_pos_of[z]]).astype(np.int32)),
        ]

    def _remember(self, h: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> None:
        if not len(h):
            return
        if len(self.h) and len(self.h) < SEEN:
            h, doc, pos = np.concatenate([h, self.h]), np.concatenate([doc, self.doc]), np.concatenate([pos, self.pos])
        _, once = np.unique(h, return_index=True)  # the first is the newer one, which is the least
        self.h, self.doc, self.pos = h[once], doc[once], pos[once]


def by_bytes(batch: pa.RecordBatch, column: int, most: int = BATCH_BYTES):
    """Slices of a batch whose texts have about `most` bytes."""
    _, offsets = text_bytes(batch.column(column))
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1)
        yield batch.slice(a, b - a)
        a = b


def _told(columns: list[pa.Array] | None, names: list[str]):
    if columns:
        out = pa.RecordBatch.from_arrays(columns, names)
        for a in range(0, out.num_rows, 50_000):
            yield out.slice(a, 50_000)


def common_anchors(texts: DataFrame) -> np.ndarray:
    """Anchors of more than one block in HEAVY, and of several documents, in a sample of about SAMPLE documents; ascending."""
    share = F.pmod(F.xxhash64("_id", F.lit("anchors")), F.lit(1 << 30)) < (1 << 30) * min(1.0, SAMPLE / max(1, texts.count()))

    def run(batches):
        hasher = WordHasher()
        for whole in batches:
            for b in by_bytes(whole, 1):
                words, begin = doc_words(b.column(1), hasher)
                for a, e in zip(begin[:-1], begin[1:]):
                    if e - a >= WINDOW:
                        p, g = anchors(words[a:e])
                        key, n = np.unique(g[p[runs(p)]], return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["key", "n"])

    found = texts.filter(share).select("_id", "_text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"), F.count("*").alias("docs"))
    total = found.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first().total
    most = found.filter((F.col("docs") > 1) & (F.col("n") * HEAVY > total)).select("key").collect()  # HEAVY rows at most
    return np.sort(np.array([r.key for r in most], np.int64).view(np.uint64))


def shared_blocks(texts: DataFrame, common: np.ndarray) -> DataFrame:
    """texts: _id, _text (neither null). doc, at: the blocks of each document whose anchors another document has too."""

    def run(batches):
        hasher, send = WordHasher(), BlockSender(common)
        for whole in batches:
            for b in by_bytes(whole, 1):
                words, begin = doc_words(b.column(1), hasher)
                yield from _told(send(b.column(0).to_numpy(), words, begin), ["key", "doc", "at"])

    block = W.partitionBy("key")
    x = texts.select("_id", "_text").mapInArrow(run, BLOCKS)
    x = x.withColumn("lo", F.min("doc").over(block)).withColumn("hi", F.max("doc").over(block)).filter("at[0] & 1 = 1 or lo < hi")
    return x.groupBy("doc").agg(F.flatten(F.collect_list("at")).alias("at"))


def flags(texts: DataFrame) -> DataFrame:
    """doc, found: for each document with duplicate windows the array of (pos, n, bits, ref_doc, ref_pos): n windows from pos on, or those of bits, and where they occur before."""

    def run(batches):
        hasher, send = WordHasher(), WindowSender(common)
        for whole in batches:
            for b in by_bytes(whole, 1):
                words, begin = doc_words(b.column(1), hasher)
                at = b.column(2)
                counts = np.diff(at.offsets.to_numpy())
                yield from _told(send(b.column(0).to_numpy(), words, begin, at.flatten().to_numpy(), counts), _NAMES)

    common = common_anchors(texts)
    blocks = shared_blocks(texts, common)
    x = texts.join(blocks, texts["_id"] == blocks["doc"]).select("_id", "_text", "at").mapInArrow(run, WINDOWS)
    block = W.partitionBy("key")
    x = x.withColumn("lo", F.min("doc").over(block)).withColumn("hi", F.max("doc").over(block)).filter("n > 0 or lo < hi")
    x = x.select("key", "doc", "pos", "n", "ref_doc", "ref_pos", F.posexplode_outer("hs").alias("i", "h"))
    least = F.min(F.struct("doc", (F.col("pos") + F.col("i")).alias("pos"))).over(W.partitionBy("key", "h"))
    x = x.withColumn("least", least).filter("n > 0 or doc > least.doc")
    old = F.col("n") > 0
    x = x.select(
        "key", "doc", "pos", "n", F.when(old, F.col("ref_doc")).otherwise(F.col("least.doc")).alias("ref_doc"), F.when(old, F.col("ref_pos")).otherwise(F.col("least.pos") - F.col("i")).alias("ref_pos"),
        F.when(old, F.lit(0)).otherwise(F.expr("shiftleft(1, i)")).alias("bit"),
    )
    # the windows of a block come together again where they are, by key
    x = x.groupBy("key", "doc", "pos", "n", "ref_doc", "ref_pos").agg(F.bit_or("bit").alias("bits"))
    return x.groupBy("doc").agg(F.collect_list(F.struct("pos", "n", "bits", "ref_doc", "ref_pos")).alias("found"))


def factors(pos: np.ndarray, n: np.ndarray, bits: np.ndarray, ref_doc: np.ndarray, ref_pos: np.ndarray, words: int) -> tuple[np.ndarray, ...]:
    """Greedy parse: start, length, reference and start there, in words, from a document's duplicate windows."""
    row = np.repeat(np.arange(len(n)), n)
    step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    more, at = np.nonzero(bits[:, None] >> np.arange(WINDOW) & 1)
    row, step = np.concatenate([row, more]), np.concatenate([step, at])
    pos, ref_doc, ref_pos = pos[row] + step, ref_doc[row], ref_pos[row] + step
    order = np.lexsort((ref_pos, ref_doc, pos))
    order = order[runs(pos[order])]
    order = order[pos[order] + WINDOW <= words]
    pos, ref_doc, ref_pos = pos[order], ref_doc[order], ref_pos[order]
    a = runs(ref_doc, ref_pos - pos, pos - np.arange(len(pos)))  # the next window of the same reference lengthens a factor by a word
    return pos[a], np.diff([*a, len(pos)]) + WINDOW - 1, ref_doc[a], ref_pos[a]


FACTORS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("length", T.IntegerType()), T.StructField("ref_doc", T.LongType()), T.StructField("ref_start", T.IntegerType())]))


def parse(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", kept_col: str = "kept", factors_col: str = "factors", words_col: str = "n_words", removed_col: str = "n_removed") -> DataFrame:
    """Adds the factors, the numbers of words and of words removed, and the words kept, joined by one space."""
    small_batches(docs.sparkSession)
    made = [(kept_col, T.StringType()), (factors_col, FACTORS), (words_col, T.LongType()), (removed_col, T.LongType())]
    names = docs.columns
    x = docs.select(*[ref(c).alias(f"d{i}") for i, c in enumerate(names)])
    key, text = f"d{names.index(id_col)}", f"d{names.index(text_col)}"
    # both joins read the same exchange of the texts where docs has no further columns
    whole = x.filter(F.col(key).isNotNull() & F.col(text).isNotNull())
    rest = x.filter(F.col(key).isNull() | F.col(text).isNull())
    found = flags(whole.select(F.col(key).cast("long").alias("_id"), F.col(text).alias("_text")))
    whole = whole.join(found, F.col(key).cast("long") == found["doc"], "left").drop("doc")
    x = whole.unionByName(rest.withColumn("found", F.lit(None).cast(whole.schema["found"].dataType)))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("ref_doc", pa.int64()), ("ref_start", pa.int32())]))

    def run(cols):
        kept, told, n_words, n_removed = [], [], [], []
        found = cols[1].combine_chunks() if isinstance(cols[1], pa.ChunkedArray) else cols[1]
        flat = found.flatten()
        parts = [flat.field(i).to_numpy() for i in range(5)]
        ends = np.cumsum(np.where(found.is_valid().to_numpy(zero_copy_only=False), found.value_lengths().fill_null(0).to_numpy(), 0))
        for text, a, b in zip(cols[0].to_pylist(), [0, *ends[:-1].tolist()], ends.tolist()):
            words = (text or "").encode().split()  # bytes are split at the same six blanks
            got, out = [], words
            if a < b:
                got = [v.tolist() for v in factors(*[v[a:b] for v in parts], len(words))]
                gone = np.zeros(len(words), bool)
                for s, n in zip(got[0], got[1]):
                    gone[s : s + n] = True
                out = [words[i] for i in np.flatnonzero(~gone)]
            kept.append(b" ".join(out).decode())
            told.append([dict(zip(("start", "length", "ref_doc", "ref_start"), f)) for f in zip(*got)])
            n_words.append(len(words))
            n_removed.append(len(words) - len(out))
        return [pa.array(kept, pa.string()), pa.array(told, kind), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())]

    # outputs come under fixed names first, so no name of docs can clash with them
    y = append_arrow(x, [F.col(text), F.col("found")], [(f"o{i}", t) for i, (_, t) in enumerate(made)], run)
    taken = {c.lower() for c, _ in made}
    return y.select(*[F.col(f"d{i}").alias(c) for i, c in enumerate(names) if c.lower() not in taken], *[F.col(f"o{i}").alias(c) for i, (c, _) in enumerate(made)])


def digests(docs: DataFrame) -> DataFrame:
    x = parse(docs.select("doc_id", "text"))
    return x.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, k, array_to_string(ws[k:k + 12], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS k FROM w)),
least AS (SELECT g, min(doc_id) AS m FROM win GROUP BY g),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(k, k + 13)) AS p FROM win JOIN least USING (g) WHERE doc_id > m)),
word AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT word.doc_id, string_agg(x, ' ' ORDER BY word.p) AS t FROM word ANTI JOIN gone ON word.doc_id = gone.doc_id AND word.p = gone.p GROUP BY word.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g ON g.doc_id = w.doc_id LEFT JOIN kept ON kept.doc_id = w.doc_id
"""
