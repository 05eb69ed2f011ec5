"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

Documents are ranged over tasks by id, so files hold ascending ids and follow each other. Each file of up to FILE_IDS ids ranks its own ids
by frequency (ties by id), codes the ranks in 1 to 4 bytes, and keeps four 2-bit lengths in each control byte, apart from the data. The file carries its
rank table, so it can be read alone and appended corpora need no second pass. Decoding looks all lengths up in a table of 256 rows and
gathers the bytes at their running sums, in numpy.

The tokenizer's split pattern never runs across a place where white space follows a character that is none, so words with the blank before them
are encoded once per worker and looked up after that (a bounded cache); the tokenizers library encodes every word that is not in the cache.
The library finds the vocabulary's added tokens before it splits, so texts that hold one go to it whole (unless they are to count as ordinary text).

Defined results: null text is empty, and an empty text has the end id alone; a very long text is encoded whole; rows come in the order of id, null ids first; rows of one id follow each other by text, and repeated rows
are written as often as they occur; further columns are not looked at, whatever their names; an empty table writes no file.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import dealt, ref, scratch_path, small_batches, stage
from .storage import read_bytes, write_bytes

MAGIC = b"PXTOKID1"
END = 2
FILE_IDS = 1 << 23
CACHE = 400_000
_HEAD = "<8sQQQ"

#: For each control byte the four lengths in it, lowest bits first.
LENGTHS = np.array([[(c >> (2 * i) & 3) + 1 for i in range(4)] for c in range(256)], np.uint8)


# ---- the coding -------------------------------------------------------------------------------------------------


def _offset(n: int):
    """Whole numbers that hold byte offsets of n values."""
    return np.int32 if n < 1 << 28 else np.int64


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned values of up to 32 bits."""
    v = values
    most = int(v.max()) if len(v) else 0
    code = (v > 0xFF).astype(np.uint8)
    for limit in (0xFFFF, 0xFFFFFF):
        if most > limit:
            code += v > limit
    at = np.cumsum(code + np.uint8(1), dtype=_offset(len(v)))
    data = np.zeros(int(at[-1]) if len(v) else 0, np.uint8)
    at -= code
    at -= 1
    data[at] = v.astype(np.uint8)
    for k in range(1, 4):
        if most >> (8 * k):
            long = np.flatnonzero(code >= k)
            data[at[long] + k] = (v[long] >> v.dtype.type(8 * k)).astype(np.uint8)
    code = np.concatenate([code, np.zeros(-len(code) % 4, np.uint8)]).reshape(-1, 4)
    return (code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6).astype(np.uint8).tobytes(), data.tobytes()


def unpack(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    size = LENGTHS[control].ravel()[:n]
    at = np.cumsum(size, dtype=_offset(n))
    at -= size
    out = data[at].astype(np.uint32)
    for k in range(1, int(size.max()) if n else 0):
        long = np.flatnonzero(size > k)
        out[long] |= data[at[long] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def to_file(doc_ids: list, counts: np.ndarray, ids: np.ndarray) -> bytes:
    """One file: head, rank table, document ids (with a byte each that tells nulls), counts, length of the control bytes, control, data."""
    freq = np.bincount(ids, minlength=1)
    table = np.flatnonzero(freq)
    table = table[np.argsort(-freq[table], kind="stable")].astype("<u4")
    kind = np.uint16 if len(table) <= 1 << 16 else np.uint32
    rank = np.zeros(len(freq), kind)
    rank[table] = np.arange(len(table), dtype=kind)
    control, data = pack(rank[ids])
    null = np.array([d is None for d in doc_ids], np.uint8)
    keys = np.array([0 if d is None else d for d in doc_ids], "<i8")
    return b"".join([struct.pack(_HEAD, MAGIC, len(doc_ids), len(ids), len(table)), table.tobytes(), null.tobytes(), keys.tobytes(), counts.astype("<u4").tobytes(), control, data])


def from_file(data: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """Document ids, counts, ids."""
    magic, docs, n, ranks = struct.unpack_from(_HEAD, data)
    if magic != MAGIC:
        raise ValueError("not a token-id file")
    at = struct.calcsize(_HEAD)

    def take(kind, k):
        nonlocal at
        out = np.frombuffer(data, kind, k, at)
        at += out.nbytes
        return out

    table, null, keys, counts = take("<u4", ranks), take(np.uint8, docs), take("<i8", docs), take("<u4", docs)
    control = take(np.uint8, -(-n // 4))
    values = unpack(control, np.frombuffer(data, np.uint8, offset=at), n) if n else np.zeros(0, np.uint32)
    return [None if z else int(k) for z, k in zip(null, keys)], counts, table[values] if n else np.zeros(0, np.uint32)


# ---- encoding with a cache of words ------------------------------------------------------------------------------

_CHUNK = re.compile(r"[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")
_LATIN = re.compile(r"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")  # letters in every version of Unicode
_RUNS = ("  ", " \n", "\n ", "\n\n")
_BLANKS = ("", " ", "\n")
#: Punctuation that may end a word: ASCII's but for the apostrophe.
_AFTER = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class WordEncoder:
    """Ids of texts as the tokenizer gives them. It splits texts only where white space follows another character."""

    def __init__(self, path: str, most: int = CACHE, plain: bool = False):
        import os

        os.environ["TOKENIZERS_PARALLELISM"], os.environ["RAYON_NUM_THREADS"] = "false", "1"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain  # whether special tokens' strings in a text are ordinary text
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if not (plain and t.special)]
        self.most = most
        self.dtype = np.dtype("<u4")  # of the ids in the caches and in encode()'s results
        self.words: dict[str, bytes] = {}  # the word after a blank (or led by a line break) -> ids
        self.old: dict[str, bytes] = {}  # the generation before, from which words still in use come back
        self.chunks: dict[str, bytes] = {}  # anything else, as it stands
        self.model = self.tokenizer.model.tokenize
        # how the vocabulary spells bytes: printable ones as themselves, the others in order from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in plain]
        self.spelt = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}
        self.blank = self.spelt[32]
        self.tails: dict[str, bytes] = {"": b""}  # punctuation after a word -> ids
        self.line = self._ids("\n").tobytes()

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype)

    def _learn(self, new: list[str]) -> None:
        """Letters, and punctuation after them that begins with no apostrophe, are one match of the pattern each, so the model gets the
        letters straight; all else goes through the whole tokenizer."""
        model, words, tails = self.model, self.words, self.tails
        for w in new:
            if w.isascii() and w.isalpha():  # most of them
                words[w] = array("I", [t.id for t in model(self.blank + w)]).tobytes()
                continue
            led = w[:1] == "\n"
            core = w[1:] if led else w
            bare = core.rstrip(_AFTER)
            tail = core[len(bare) :]
            if bare.isascii():
                spelt = bare if bare.isalpha() else None
            else:
                spelt = bare.encode().decode("latin-1").translate(self.spelt) if _LATIN.fullmatch(bare) else None
            if spelt is None:
                words[w] = self._ids(w if led else " " + w).tobytes()
                continue
            if tail not in tails:
                if len(tails) > self.most:
                    tails.clear()
                tails[tail] = self._ids(tail).tobytes()
            ids = None if led else words.get(bare) or self.old.get(bare)  # the word without its punctuation may be known
            if ids is None:
                ids = array("I", [t.id for t in model(spelt if led else self.blank + spelt)]).tobytes()
            words[w] = (self.line if led else b"") + ids + tails[tail]

    def _text(self, t: str) -> bytes:
        if any(a in t for a in self.added):
            return self._ids(t).tobytes()
        if not t.replace("\n", "").isprintable():  # white space of other kinds, or what might be some
            return self._ids(t).tobytes()
        if t[:1] in _BLANKS or t[-1:] in _BLANKS or any(r in t for r in _RUNS):
            known, parts = self.chunks, _CHUNK.findall(t)
            for c in parts:
                if c not in known:
                    known[c] = self._ids(c).tobytes()
            return b"".join(map(known.__getitem__, parts))
        first, *parts = t.replace("\n", " \n").split(" ")
        got = list(map(self.words.get, parts))
        if None in got:
            words, old, missing = self.words, self.old, []
            for i in [i for i, ids in enumerate(got) if ids is None]:
                ids = old.get(parts[i])
                if ids is None:
                    missing.append(i)
                else:
                    got[i] = words[parts[i]] = ids
            self._learn([parts[i] for i in missing])
            for i in missing:
                got[i] = words[parts[i]]
        if first not in self.chunks:
            self.chunks[first] = self._ids(first).tobytes()
        return self.chunks[first] + b"".join(got)

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian integers of self.dtype."""
        out = []
        for t in texts:
            if len(self.words) > self.most:
                self.old, self.words = self.words, {}
            if len(self.chunks) > self.most:
                self.chunks.clear()
            out.append(self._text(t))
        return out


_encoders: dict = {}


def _encoder(path: str, plain: bool) -> WordEncoder:
    if (path, plain) not in _encoders:
        _encoders[path, plain] = WordEncoder(path, plain=plain)
    return _encoders[path, plain]


# ---- writing and reading ----------------------------------------------------------------------------------------


def write(docs: DataFrame, folder: str, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end: int = END, plain: bool = False) -> DataFrame:
    """Writes the token-id files and gives their list, already written: part, seq (their order), uri, n_docs, n_ids.

    plain: special tokens' strings in a text are ordinary text; by default they are the tokens, as in the library."""

    def run(batches):
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        encoder, keys, counts, held, n = _encoder(tokenizer, plain), [], [], [], 0
        tail, width = np.array([end], encoder.dtype).tobytes(), encoder.dtype.itemsize

        def flush():
            nonlocal keys, counts, held, n, seq
            uri = write_bytes(folder, f"ids-{part:06d}-{seq:04d}", to_file(keys, np.array(counts, np.uint32), np.frombuffer(b"".join(held), encoder.dtype)))
            row = pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([seq], pa.int64()), pa.array([uri]), pa.array([len(keys)], pa.int64()), pa.array([n], pa.int64())], ["part", "seq", "uri", "n_docs", "n_ids"])
            keys, counts, held, n, seq = [], [], [], 0, seq + 1
            return row

        for b in batches:
            ids, texts = b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()]
            for a in range(0, len(texts), 1000):
                for key, got in zip(ids[a : a + 1000], encoder.encode(texts[a : a + 1000])):
                    keys.append(key)
                    counts.append(len(got) // width + 1)
                    held += [got, tail]
                    n += counts[-1]
                    if n >= FILE_IDS:
                        yield flush()
        if keys:
            yield flush()

    small_batches(docs.sparkSession)
    x = docs.select(ref(id_col).alias("id"), ref(text_col).alias("text"))
    x = x.repartitionByRange(F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), F.col("text").asc_nulls_first())
    return stage(x.mapInArrow(run, "part long, seq long, uri string, n_docs long, n_ids long"), "token-files")


def read(files: DataFrame, *, ids_too: bool = True) -> DataFrame:
    """Reads the files: doc_id, start (ids before the document), n_tokens, ids_crc32 and, unless left out, ids (binary, little-endian unsigned 32-bit).

    The ids before a file come from a running sum over the list of files, one row each."""
    before = W.orderBy("part", "seq").rowsBetween(W.unboundedPreceding, -1)
    listed = files.select("uri", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("first"), "n_docs")

    def run(batches):
        for b in batches:
            for uri, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                keys, counts, ids = from_file(read_bytes(uri))
                ends = np.cumsum(counts, dtype=np.int64)
                starts = ends - counts
                raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
                for a in range(0, len(keys), 2000):
                    z = slice(a, a + 2000)
                    own = [raw[4 * i : 4 * j] for i, j in zip(starts[z].tolist(), ends[z].tolist())]
                    out = [pa.array(keys[z], pa.int64()), pa.array(starts[z] + first, pa.int64()), pa.array(counts[z].astype(np.int64)), pa.array([zlib.crc32(x) for x in own], pa.int64())]
                    yield pa.RecordBatch.from_arrays(out + [pa.array([x.tobytes() for x in own], pa.binary())] * ids_too, names)

    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * ids_too
    return dealt(listed, files.count()).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * ids_too)


def digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Ids are those of the library's encode(text, add_special_tokens=False) with nothing else set."""
    files = write(docs.select("doc_id", "text"), scratch_path(docs.sparkSession, "tokens"), tokenizer)
    return read(files, ids_too=False).select("doc_id", "start", "n_tokens", "ids_crc32")
