"""Audio media columns: lossless 8-bit samples, polyphase resampling, log-mel filterbanks, hysteresis segmentation.

A document's bytes are kept as unsigned 8-bit mono PCM in a WAV container and written to the shared folder. Features are computed from the stored
bytes, read back:

* polyphase resampling by up/down with a windowed-sinc low-pass: each output phase uses only its own branch of the filter;
* log-mel energies of overlapped Hann frames, cut into tensors of one fixed shape (FRAMES, MELS), the last padded with the floor value,
  each with the span of time it covers. Workers write them to Arrow files as columns of the fixed-shape tensor type, in half precision;
* segments of high energy: on above one threshold, off only below a lower one.

All sums run over blocks of frames, so memory follows the block and the document, not the batch.

A file counts only when the attempt that wrote it has told its name; the query's features are those of the tensors read back.

Defined results: null text is empty, and an empty text gives 64 zero bytes; a very long text is one recording, computed in blocks of frames; equal texts,
and so repeated rows, give equal values, a row for each; null media have no features; other columns are kept, and one that has an output's name is replaced;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_arrow, dealt, ref, scratch_path, small_batches, stage
from .storage import read_bytes, write_bytes

BLOCK = 64
RATE, UP, DOWN, TAPS = 16_000, 2, 5, 8
FRAME, HOP, MELS, FRAMES = 256, 128, 24, 16
#: Tensors in a file, about.
FILE_TENSORS = 1 << 15
FLOOR, ON, OFF = -8.0, 0.6, 0.35

TENSORS = T.ArrayType(T.StructType([T.StructField("start_s", T.DoubleType()), T.StructField("end_s", T.DoubleType()), T.StructField("frames", T.IntegerType()), T.StructField("logmel", T.BinaryType())]))
SPANS = T.ArrayType(T.StructType([T.StructField("start_s", T.DoubleType()), T.StructField("end_s", T.DoubleType())]))


def pad(data: bytes) -> bytes:
    """Zeros up to a positive multiple of BLOCK."""
    return data + bytes(-len(data) % BLOCK if data else BLOCK)


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    """Unsigned 8-bit mono PCM; the payload's length is even, so no chunk needs a pad byte."""
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, rate, 1, 8)
    return struct.pack("<4sI4s", b"RIFF", 4 + len(fmt) + 8 + len(payload), b"WAVE") + fmt + struct.pack("<4sI", b"data", len(payload)) + payload


def from_wav(wav: bytes) -> tuple[int, bytes]:
    """The rate and the samples of a WAV file: chunks are walked by their declared lengths."""
    if wav[:4] != b"RIFF" or wav[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(wav):
        kind, size = struct.unpack_from("<4sI", wav, at)
        if kind == b"fmt ":
            tag, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", wav, at + 8)
            if (tag, channels, bits) != (1, 1, 8):
                raise ValueError("not 8-bit mono PCM")
        elif kind == b"data":
            return rate, wav[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples")


@lru_cache(maxsize=8)
def branches(up: int, down: int, taps: int) -> np.ndarray:
    """The low-pass of width 2 * taps * max(up, down), as up branches that each have unit gain at zero frequency."""
    most = max(up, down)
    n = 2 * taps * most
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / most) * np.hanning(n + 2)[1:-1]
    h = np.concatenate([h, np.zeros(-n % up)]).reshape(-1, up).T
    return (h / h.sum(axis=1, keepdims=True)).astype(np.float32)


def resample(x: np.ndarray, up: int, down: int, taps: int = TAPS) -> np.ndarray:
    """ceil(len(x) * up / down) samples; output k is branch (k * down) % up at input (k * down) // up."""
    if (up, down) == (1, 1) or not len(x):
        return x
    b = branches(up, down, taps)
    width = b.shape[1]
    at = np.arange(-(-len(x) * up // down), dtype=np.int64) * down
    left = width // 2
    padded = np.concatenate([np.full(left, x[0], np.float32), x, np.full(width + 1, x[-1], np.float32)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, width)
    if up == 1:
        return windows[: len(x) : down] @ b[0, ::-1]
    out = np.empty(len(at), np.float32)
    for p in range(up):
        mine = np.flatnonzero(at % up == p)
        out[mine] = windows[at[mine] // up] @ b[p, ::-1]
    return out


@lru_cache(maxsize=8)
def mel_bank(rate: int, frame: int, mels: int) -> np.ndarray:
    """Triangles that are even on the mel scale, (frame // 2 + 1, mels)."""
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, mels + 2) / 2595) - 1)
    f = np.arange(frame // 2 + 1) * rate / frame
    up = (f[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    down = (edges[2:] - f[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


def log_mel(x: np.ndarray, rate: int) -> np.ndarray:
    """(frames, MELS) float32: log10 of the mel energies, at least FLOOR; a last frame is filled up with zeros."""
    n = max(1, -(-max(0, len(x) - FRAME) // HOP) + 1)
    x = np.concatenate([x, np.zeros((n - 1) * HOP + FRAME - len(x), np.float32)]) if len(x) < (n - 1) * HOP + FRAME else x
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[:: HOP][:n]
    window, bank = np.hanning(FRAME + 1)[:-1].astype(np.float32), mel_bank(rate, FRAME, MELS)
    out = np.empty((n, MELS), np.float32)
    for a in range(0, n, 2048):
        spec = np.fft.rfft(frames[a : a + 2048] * window)
        power = (spec.real**2 + spec.imag**2).astype(np.float32)
        out[a : a + 2048] = np.maximum(FLOOR, np.log10(power @ bank + 1e-8))
    return out


def loudness(mel: np.ndarray) -> np.ndarray:
    """log10 of a frame's energy over all bands."""
    return np.log10(np.exp(mel * np.float32(np.log(10))).sum(axis=1))


def hysteresis(energy: np.ndarray, on: float = ON, off: float = OFF) -> list[tuple[int, int]]:
    """Runs of frames that begin where energy reaches `on` and last until it falls under `off`; thresholds are shares of the range."""
    low, high = float(energy.min()), float(energy.max())
    if high <= low:
        return []
    state = np.where(energy >= low + on * (high - low), 1, np.where(energy < low + off * (high - low), -1, 0))
    known = np.maximum.accumulate(np.where(state != 0, np.arange(len(state)), -1))
    active = np.where(known >= 0, state[known], -1) > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[False], active, [False]]).astype(np.int8)))
    return [(int(a), int(b)) for a, b in zip(edges[0::2], edges[1::2])]


def features(wav: bytes) -> dict:
    """Everything that is derived from the stored bytes."""
    rate, payload = from_wav(wav)
    x = (np.frombuffer(payload, np.uint8).astype(np.float32) - 128) / 128
    low = rate * UP // DOWN
    mel = log_mel(resample(x, UP, DOWN), low)
    runs = hysteresis(loudness(mel))
    step = HOP / low
    tensors = []
    for a in range(0, len(mel), FRAMES):
        part = mel[a : a + FRAMES]
        full = np.full((FRAMES, MELS), FLOOR, np.float32)
        full[: len(part)] = part
        tensors.append({"start_s": a * step, "end_s": ((a + len(part) - 1) * HOP + FRAME) / low, "frames": len(part), "logmel": full.tobytes()})
    active = sum(b - a for a, b in runs)
    spans = [{"start_s": a * step, "end_s": ((b - 1) * HOP + FRAME) / low} for a, b in runs]
    return {"payload": payload, "tensors": tensors, "segments": spans, "active": active, "feature": told(mel, len(runs), active)}


def told(mel: np.ndarray, segments: int, active: int) -> str:
    """The digest that equal texts share: counts, and mean mel levels in hundredths."""
    mean = np.round(mel.mean(axis=0, dtype=np.float64) * 100).astype(int)
    return f"frames={len(mel)};segments={segments};active={active};mel=" + ",".join(map(str, mean))


def to_audio(docs: DataFrame, *, text_col: str = "text", media_col: str = "media", bytes_col: str = "n_bytes") -> DataFrame:
    """Adds the text's bytes as a WAV file, and their number before padding."""

    def run(cols):
        raw = [(t or "").encode() for t in cols[0].to_pylist()]
        return [pa.array([to_wav(pad(x)) for x in raw], pa.binary()), pa.array([len(x) for x in raw], pa.int64())]

    return append_arrow(docs, [ref(text_col)], [(media_col, T.BinaryType()), (bytes_col, T.LongType())], run)


def with_features(media: DataFrame, *, media_col: str = "media") -> DataFrame:
    """Adds tensors (float32 of shape (FRAMES, MELS) with time spans), segments, feature. Null media give nulls."""

    def run(cols):
        got = [features(m) if m is not None else None for m in cols[0].to_pylist()]
        return [
            pa.array([g and g["tensors"] for g in got], pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64()), ("frames", pa.int32()), ("logmel", pa.binary())]))),
            pa.array([g and g["segments"] for g in got], pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))),
            pa.array([g and g["feature"] for g in got], pa.string()),
        ]

    return append_arrow(media, [ref(media_col)], [("tensors", TENSORS), ("segments", SPANS), ("feature", T.StringType())], run)


def tensor_table(docs: list[int], tensors: list[dict]) -> pa.Table:
    """Tensors with their time spans, and the number of the document in its file that each belongs to."""
    kind = pa.fixed_shape_tensor(pa.float16(), (FRAMES, MELS))
    data = np.concatenate([np.frombuffer(t["logmel"], np.float32) for t in tensors]).astype(np.float16) if tensors else np.zeros(0, np.float16)
    values = pa.FixedSizeListArray.from_arrays(pa.array(data), FRAMES * MELS)
    cols = {k: pa.array([t[k] for t in tensors], kind_) for k, kind_ in (("start_s", pa.float64()), ("end_s", pa.float64()), ("frames", pa.int32()))}
    return pa.table({"doc": pa.array(docs, pa.int32()), **cols, "logmel": pa.ExtensionArray.from_storage(kind, values)})


def to_ipc(t: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_file(out, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as f:
        f.write_table(t, max_chunksize=4096)
    return out.getvalue()


def from_ipc(data: bytes) -> pa.Table:
    return pa.ipc.open_file(pa.BufferReader(data)).read_all()


def write_features(media: DataFrame, folder: str, *, id_col: str = "doc_id", media_col: str = "media", bytes_col: str = "n_bytes") -> DataFrame:
    """Computes the features of stored media and writes them: for each file of documents, one of their tensors. Gives the list, already written:
    docs and tensors (uri). A document's row holds what was read back of its media, and its segments."""
    span = pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())])
    schema = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("segments", pa.list_(span)), ("active", pa.int64())])

    def run(batches):
        from pyspark import TaskContext

        part, seq, rows, docs, tensors = TaskContext.get().partitionId(), 0, [], [], []

        def close():
            nonlocal seq, rows, docs, tensors
            name = f"{part:06d}-{seq:04d}.arrow"
            uris = [write_bytes(folder, f"docs-{name}", to_ipc(pa.Table.from_pylist(rows, schema))), write_bytes(folder, f"tensors-{name}", to_ipc(tensor_table(docs, tensors)))]
            seq, rows, docs, tensors = seq + 1, [], [], []
            return pa.RecordBatch.from_arrays([pa.array([u]) for u in uris], ["uri", "tensors"])

        for b in batches:
            for key, n, wav in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                wav = wav.as_py()
                if wav is None:
                    continue
                f = features(wav)
                p = f["payload"]
                docs += [len(rows)] * len(f["tensors"])
                tensors += f["tensors"]
                digest = {"payload_bytes": len(p), "payload_sha256": hashlib.sha256(p).hexdigest(), "tail_crc32": zlib.crc32(p[-BLOCK:]), "media_bytes": len(wav), "media_sha256": hashlib.sha256(wav).hexdigest()}
                rows.append({"id": key, "n_bytes": n, **digest, "segments": f["segments"], "active": f["active"]})
                if len(tensors) >= FILE_TENSORS:
                    yield close()
        if rows:
            yield close()

    small_batches(media.sparkSession)
    src = media.select(ref(id_col).cast("long").alias("id"), ref(bytes_col).alias("n"), ref(media_col).alias("media"))
    return stage(src.mapInArrow(run, "uri string, tensors string"), "feature-files")


def read_features(files: DataFrame) -> DataFrame:
    """A row per document of the files: what was told of its media, the feature string made from its tensors, their number and that of its segments."""
    names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_tensors", "n_segments"]

    def run(batches):
        for b in batches:
            for uri, other in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                docs, t = from_ipc(read_bytes(uri)), from_ipc(read_bytes(other)).combine_chunks()
                if tuple(t.schema.field("logmel").type.shape) != (FRAMES, MELS):
                    raise ValueError("tensors of another shape")
                mel, frames = t.column("logmel").combine_chunks().to_numpy_ndarray(), t.column("frames").to_numpy()
                ends = np.searchsorted(t.column("doc").to_numpy(), np.arange(len(docs)), side="right")
                text, many = [], np.diff([0, *ends])
                for i, (runs, active) in enumerate(zip(docs.column("segments").to_pylist(), docs.column("active").to_pylist())):
                    own = mel[ends[i] - many[i] : ends[i]].reshape(-1, MELS)[: frames[ends[i] - many[i] : ends[i]].sum()]  # only the last is padded
                    text.append(told(own, len(runs), active))
                for x in docs.select(names[:7]).append_column("feature", pa.array(text, pa.string())).append_column("n_tensors", pa.array(many, pa.int64())).append_column("n_segments", docs.column("segments").combine_chunks().value_lengths().cast(pa.int64())).to_batches(4096):
                    yield x

    schema = "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_tensors long, n_segments long"
    return dealt(files, files.count()).mapInArrow(run, schema)


def digests(docs: DataFrame) -> DataFrame:
    """One row per document, from stored media and stored tensors read back."""
    media = stage(to_audio(docs.select("doc_id", "text")).select("doc_id", "n_bytes", "media"), "media", "zstd")
    got = read_features(write_features(media, scratch_path(docs.sparkSession, "features")))
    return got.withColumnRenamed("id", "doc_id")
