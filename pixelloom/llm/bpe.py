"""Byte-level BPE encoding and decoding by monoid tree reduction.

A text is halved until a part has at most `leaf` characters; parts are encoded alone. Two neighbours are then joined by encoding
again only a window around their border. The window grows on either side, doubling, until it reaches a firm cut, and the tokens outside
are kept.

A firm cut lies between a letter or digit and white space that follows it (or between an ASCII letter and an ASCII digit). In the
split pattern no alternative runs across such a place, none looks behind, and the only look-ahead concerns the end
of a run of white space, which cannot reach back over it. So the matches of x + y are those of x, then those of y, and as every match is
merged alone, encode(x + y) = encode(x) + encode(y): tokens outside the window are what the whole text gives. A side without a firm cut is
taken whole, so the result never depends on luck.

Decoding concatenates the tokens' bytes up the same kind of tree.

Defined results: null text is the empty text (no ids, empty bytes); a very long text is one tree (a worker holds the text and its ids); an empty table gives an empty result; null ids decode to empty bytes; rows are independent, so repeated rows and
ties need no rule; other columns are kept, and one that has the name of an output is replaced.
"""

from __future__ import annotations

import base64
import re
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_arrow, ref

LEAF = 4096
_CUT = re.compile(r"[^\W_](?=[ \t\n\r])|[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])")


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of the token's bytes and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class TreeCodec:
    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf: int = LEAF):
        self._leaf = max(2, leaf)
        self._ranks, self._pattern = ranks, pattern
        self._bytes = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self._bytes[rank] = token
        self.windows = 0

    @cached_property
    def _part(self):
        """Encodes a part alone; built on first use, as decoding needs the bytes only."""
        import tiktoken

        return tiktoken.Encoding("ranks", pat_str=self._pattern, mergeable_ranks=self._ranks, special_tokens={}).encode_ordinary

    def encode(self, text: str) -> list[int]:
        return self._span(text, 0, len(text))

    def _span(self, text: str, a: int, b: int) -> list[int]:
        if b - a <= self._leaf:
            return self._part(text[a:b])
        mid = (a + b) // 2
        return self._join(text, a, mid, b, self._span(text, a, mid), self._span(text, mid, b))

    def _join(self, text: str, a: int, mid: int, b: int, left: list[int], right: list[int]) -> list[int]:
        lo, hi = self._before(text, a, mid), self._after(text, mid, b)
        if lo == hi:  # the border itself is a firm cut
            return left + right
        self.windows += 1
        i, j = len(left), 0
        n = len(text[lo:mid].encode())
        while n > 0:
            i -= 1
            n -= len(self._bytes[left[i]])
        m = len(text[mid:hi].encode())
        while m > 0:
            m -= len(self._bytes[right[j]])
            j += 1
        if n or m:  # no token reaches over a firm cut
            raise AssertionError("a token crosses a firm cut")
        return left[:i] + self._part(text[lo:hi]) + right[j:]

    @staticmethod
    def _before(text: str, a: int, mid: int) -> int:
        """The last firm cut in (a, mid], by windows that double; a if there is none."""
        w, top = 32, mid
        while True:
            lo = max(a, mid - w)
            cuts = [m.end() for m in _CUT.finditer(text, lo, min(top + 1, len(text))) if a < m.end() <= mid]
            if cuts:
                return cuts[-1]
            if lo == a:
                return a
            w, top = 2 * w, lo

    @staticmethod
    def _after(text: str, mid: int, b: int) -> int:
        """The first firm cut in [mid, b), by windows that double; b if there is none."""
        w, lo = 32, mid - 1
        while True:
            hi = min(b, mid + w)
            m = next((m for m in _CUT.finditer(text, lo, hi) if m.end() >= mid), None)
            if m and m.end() < b:
                return m.end()
            if hi == b:
                return b
            w, lo = 2 * w, hi - 1

    def decode(self, ids) -> bytes:
        return self._cat([*ids], 0, len(ids))

    def _cat(self, ids: list[int], a: int, b: int) -> bytes:
        if b - a <= self._leaf:
            return b"".join([self._bytes[i] for i in ids[a:b]])
        mid = (a + b) // 2
        return self._cat(ids, a, mid) + self._cat(ids, mid, b)


_codecs: dict = {}


def _codec(shipped, pattern: str, leaf: int) -> TreeCodec:
    """One codec for each worker process; the ranks come from the driver as a broadcast of the vocabulary's size."""
    key = (shipped.id, pattern, leaf)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = TreeCodec(shipped.value, pattern, leaf)
    return _codecs[key]


class _Ship:
    """The ranks for the workers: the vocabulary file's size bounds what is sent (about 1 MB for 50,000 tokens)."""

    def __init__(self, spark, path: str):
        self._b = spark.sparkContext.broadcast(read_ranks(path))
        self.id = f"{path}:{self._b.id}" if hasattr(self._b, "id") else path

    @property
    def value(self):
        return self._b.value


def encode(docs: DataFrame, vocabulary: str, pattern: str, *, text_col: str = "text", ids_col: str = "ids", count_col: str = "n_tokens", leaf: int = LEAF) -> DataFrame:
    """Adds ids_col, the text's token ids as binary (little-endian unsigned 32-bit), and count_col, their number."""
    ship = _Ship(docs.sparkSession, vocabulary)

    def run(cols):
        codec = _codec(ship, pattern, leaf)
        ids = [np.array(codec.encode(t or ""), "<u4").tobytes() for t in cols[0].to_pylist()]  # lists of ints would take ten times the room
        return [pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())]

    return append_arrow(docs, [ref(text_col)], [(ids_col, T.BinaryType()), (count_col, T.LongType())], run)


def decode(ids: DataFrame, vocabulary: str, pattern: str, *, ids_col: str = "ids", bytes_col: str = "decoded", leaf: int = LEAF) -> DataFrame:
    """Adds bytes_col, the bytes that the ids in ids_col stand for (cast it to string for text)."""
    ship = _Ship(ids.sparkSession, vocabulary)

    def run(cols):
        codec = _codec(ship, pattern, leaf)
        return [pa.array([codec.decode(np.frombuffer(x or b"", "<u4").tolist()) for x in cols[0].to_pylist()], pa.binary())]

    return append_arrow(ids, [ref(ids_col)], [(bytes_col, T.BinaryType())], run)


def round_trip(docs: DataFrame, vocabulary: str, pattern: str, *, text_col: str = "text", ids_col: str = "ids", count_col: str = "n_tokens", bytes_col: str = "decoded", leaf: int = LEAF) -> DataFrame:
    """encode(), and decode() of the packed ids, in one pass through the workers: half as many processes share an executor's memory."""
    ship = _Ship(docs.sparkSession, vocabulary)

    def run(cols):
        codec = _codec(ship, pattern, leaf)
        ids = [np.array(codec.encode(t or ""), "<u4").tobytes() for t in cols[0].to_pylist()]
        back = [codec.decode(np.frombuffer(x, "<u4").tolist()) for x in ids]
        return [pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(back, pa.binary())]

    return append_arrow(docs, [ref(text_col)], [(ids_col, T.BinaryType()), (count_col, T.LongType()), (bytes_col, T.BinaryType())], run)


def digests(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    both = round_trip(docs.select("doc_id", "text"), vocabulary, pattern)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
