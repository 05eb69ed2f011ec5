"""Language identification with error-correcting output codes.

Every language gets a codeword; one binary classifier (logistic regression on hashed byte n-grams) predicts each bit of it.
Decoding adds up, bit by bit, the loss that a codeword would have against the predicted margins, weighted by how well the bit's classifier
fits, and takes the codeword with the least loss. If the runner-up is nearly as near, the row is flagged ambiguous.

The classifiers are fitted on about MAX_ROWS labelled rows of distinct texts, spread evenly over the languages and chosen by a hash of the text; a row is sent as a
vector of FEATURES numbers, so the driver's share is bounded whatever the texts' lengths. Everything else sees whole texts.

Defined results: null text, or text without a letter, is `und` with score 0 and not ambiguous; without any labelled row all texts are `und`; with one
language every text with letters is that language; equal texts get equal results (ties go to the language first by code point); rows with null id take part in prediction
and never in training; a label of few rows keeps at least one text in the sample; other columns are kept, and one that has the name of an output is replaced; an empty table
gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_arrow, ref, release, text_bytes

FEATURES = 4096
MAX_ROWS = 2000
ROUNDS, RATE, DECAY = 80, 4.0, 1e-4
NEAR = 0.02
NONE = "und"
_BLOCK = 1 << 20

# bytes that are no letters count as blanks; ASCII letters count as lower case; bytes of longer characters stay
_FOLD = np.array([i + 32 if 65 <= i <= 90 else i if 97 <= i <= 122 or i >= 128 else 32 for i in range(256)], np.uint32)


def profile(data: np.ndarray) -> np.ndarray:
    """Square roots of the counts of hashed byte 1-, 2- and 3-grams of a whole text, scaled to length 1."""
    counts = np.zeros(FEATURES)
    for a in range(0, len(data), _BLOCK):
        x = _FOLD[data[max(0, a - 2) : a + _BLOCK]]
        skip = min(a, 2)
        two = x[:-1] * np.uint32(0x9E3779B1) + x[1:]
        three = (two[:-1] * np.uint32(0x85EBCA6B) + x[2:]) * np.uint32(0xC2B2AE35)
        three = three[(x[:-2] + x[1:-1] + x[2:]) != 96]  # runs of blanks say nothing
        for g in (x[skip:] * np.uint32(0x27D4EB2F), two[max(0, skip - 1) :] * np.uint32(0xC2B2AE35), three):
            counts += np.bincount((g ^ (g >> np.uint32(15))) & np.uint32(FEATURES - 1), minlength=FEATURES)
    root = np.sqrt(counts)
    norm = np.sqrt((root * root).sum())
    return (root / norm if norm else root).astype(np.float32)


def profiles(col) -> np.ndarray:
    data, offsets = text_bytes(col)
    out = np.zeros((len(offsets) - 1, FEATURES), np.float32)
    for i in range(len(offsets) - 1):
        out[i] = profile(data[offsets[i] : offsets[i + 1]])
    return out


def codewords(n: int) -> np.ndarray:
    """(n, bits) of +1 and -1, rows far apart: all splits of the classes for up to 5, random balanced splits beyond."""
    if n <= 5:
        return np.array([[1 if k == 0 or not (b >> (k - 1)) & 1 else -1 for b in range(1, 1 << (n - 1))] for k in range(n)], np.float32).reshape(n, -1)
    rng = np.random.default_rng(n)
    bits = int(np.ceil(10 * np.log2(n)))
    best, gap = None, -1
    for _ in range(200):
        code = np.stack([rng.permutation(np.where(np.arange(n) % 2, 1, -1)) for _ in range(bits)], 1)
        apart = (bits - (code @ code.T)[np.triu_indices(n, 1)]).min()
        if apart > gap:
            best, gap = code, apart
    return best.astype(np.float32)


@dataclass
class Model:
    labels: list[str]
    code: np.ndarray
    weights: np.ndarray  # (FEATURES + 1, bits)
    trust: np.ndarray  # weight of each bit, sum 1

    def losses(self, x: np.ndarray) -> np.ndarray:
        """(rows, labels): weighted logistic loss of each codeword against the margins."""
        m = x @ self.weights[:-1] + self.weights[-1]
        return np.stack([np.logaddexp(0, -m * c) @ self.trust for c in self.code], 1)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Label index, score, gap to the runner-up."""
        if len(self.labels) == 1:
            return np.zeros(len(x), int), np.ones(len(x)), np.full(len(x), np.inf)
        loss = self.losses(x)
        best = loss.argmin(1)
        two = np.partition(loss, 1, axis=1)
        sharp = np.exp(-(loss - two[:, :1]) * self.code.shape[1])
        return best, 1 / sharp.sum(1), two[:, 1] - two[:, 0]


def fit(x: np.ndarray, y: list[str]) -> Model | None:
    """Equal rows count once per label, so that groups of copies don't outweigh the rest."""
    if not y:
        return None
    labels = sorted(set(y), key=lambda s: s.encode())
    at = {s: k for k, s in enumerate(labels)}
    k = np.array([at[s] for s in y])
    half = np.ascontiguousarray(x, np.float16)
    order = sorted(range(len(k)), key=lambda i: (k[i], half[i].tobytes()))
    keep = [i for n, i in enumerate(order) if not n or k[i] != k[order[n - 1]] or half[i].tobytes() != half[order[n - 1]].tobytes()]
    x, k = half[keep].astype(np.float32), k[keep]
    code = codewords(len(labels))
    if len(labels) == 1:
        return Model(labels, code, np.zeros((FEATURES + 1, 0), np.float32), np.zeros(0, np.float32))
    share = 1 / np.bincount(k, minlength=len(labels))[k]
    share = (share / share.sum()).astype(np.float32)[:, None]
    t = code[k]
    w = np.zeros((FEATURES + 1, code.shape[1]), np.float32)  # the last row is the bias
    v = np.zeros_like(w)
    for _ in range(ROUNDS):  # Nesterov's accelerated gradient, all bits at once
        ahead = w + 0.9 * v
        m = x @ ahead[:-1] + ahead[-1]
        g = -t / (1 + np.exp(np.clip(m * t, -30, 30))) * share
        grad = np.concatenate([x.T @ g, g.sum(0, keepdims=True)]) + DECAY * ahead
        v = 0.9 * v - RATE * grad
        w = w + v
    loss = (np.logaddexp(0, -(x @ w[:-1] + w[-1]) * t) * share).sum(0)
    trust = np.exp(-loss)
    return Model(labels, code, w, (trust / trust.sum()).astype(np.float32))


def train(labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", max_rows: int = MAX_ROWS) -> Model | None:
    """A model from about max_rows of the rows with text and label, evenly by label and at least one of each; the copies of a text count as one."""
    rows = labelled.select(ref(id_col).alias("id"), ref(text_col).alias("text"), ref(label_col).alias("label")).filter("id is not null and text is not null and label is not null")
    rows = rows.withColumn("h", F.xxhash64("text"))
    found = rows.groupBy("label").agg(F.count_distinct("h").alias("n"), F.min("h").alias("least")).collect()  # a row for each label
    counts, least = {r.label: r["n"] for r in found}, F.create_map(*[F.lit(x) for r in found for x in (r.label, r.least)])
    if not counts:
        return None
    each = max(1, max_rows // len(counts))
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, each / n))])
    u = F.pmod(F.xxhash64("h", F.lit("sample")), F.lit(1 << 20)) / float(1 << 20)
    some = rows.filter((u < F.element_at(share, F.col("label"))) | (F.col("h") == F.element_at(least, F.col("label"))))
    one = some.groupBy("label", "h").agg(F.min("id").alias("id"))  # about max_rows rows, whatever the number of copies
    some = some.join(F.broadcast(one), ["label", "h", "id"], "left_semi")
    sent = append_arrow(some.select("label", "text"), [F.col("text")], [("x", T.BinaryType())], lambda cols: [pa.array([v.tobytes() for v in profiles(cols[0]).astype(np.float16)], pa.binary())])
    got = sent.select("label", "x").toArrow()
    x = np.stack([np.frombuffer(v.as_py(), np.float16) for v in got.column("x")]) if got.num_rows else np.zeros((0, FEATURES), np.float16)
    y = got.column("label").to_pylist()
    del got
    model = fit(x, y)
    del x
    release()
    return model


def identify(docs: DataFrame, model: Model | None, *, text_col: str = "text", label_col: str = "lang_pred", score_col: str = "score", flag_col: str = "ambiguous", near: float = NEAR) -> DataFrame:
    """Adds the predicted language, a score from 0 to 1 and the flag of ambiguity."""
    made = [(label_col, T.StringType()), (score_col, T.DoubleType()), (flag_col, T.BooleanType())]

    def run(cols):
        import regex

        letter = regex.compile(r"\p{L}")
        known = np.array([model is not None and t is not None and letter.search(t) is not None for t in cols[0].to_pylist()], bool)
        names, scores, flags = np.full(len(known), NONE, object), np.zeros(len(known)), np.zeros(len(known), bool)
        col = cols[0].combine_chunks() if isinstance(cols[0], pa.ChunkedArray) else cols[0]
        for a in range(0, len(col), 512):
            mine = np.flatnonzero(known[a : a + 512]) + a
            if len(mine):
                best, score, gap = model.predict(profiles(col.take(pa.array(mine))))
                names[mine], scores[mine], flags[mine] = np.array(model.labels, object)[best], score, gap < near
        return [pa.array(names.tolist(), pa.string()), pa.array(scores), pa.array(flags)]

    return append_arrow(docs, [ref(text_col)], made, run)


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(ref(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def trained_on_rest(docs: DataFrame, **how) -> Model | None:
    """The model from the documents that are not held out."""
    return train(docs.filter(~held_out()), **how)


def digests(docs: DataFrame) -> DataFrame:
    model = trained_on_rest(docs)
    x = identify(docs.select("doc_id", "text"), model)
    return x.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


def keep_identified(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of docs whose language is known, with all their columns: rejected are texts without letters."""
    names = docs.columns
    x = identify(docs.select(*[ref(c).alias(f"d{i}") for i, c in enumerate(names)]), model, text_col=f"d{names.index('text')}", label_col="o_label", score_col="o_score", flag_col="o_flag")
    return x.filter(F.col("o_label") != NONE).select(*[F.col(f"d{i}").alias(c) for i, c in enumerate(names)])
