import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa

from pixelloom.llm import audio


def test_wav_round_trip():
    for n in (0, 1, 63, 64, 65, 10_000):
        p = audio.pad(bytes(i % 251 for i in range(n)))
        assert len(p) % 64 == 0 and len(p) >= max(64, n)
        assert audio.from_wav(audio.to_wav(p)) == (audio.RATE, p)


def test_resample_against_direct_sum():
    x = np.random.default_rng(0).normal(size=500).astype(np.float32)
    for up, down in ((1, 2), (3, 2), (2, 3), (1, 1)):
        y = audio.resample(x, up, down)
        assert len(y) == -(-len(x) * up // down)
        if (up, down) != (1, 1):
            b = audio.branches(up, down, audio.TAPS)
            pad = lambda i: x[min(max(i, 0), len(x) - 1)]
            for k in (0, 7, len(y) - 1):
                at, p, w = k * down // up, k * down % up, b.shape[1]
                direct = sum(pad(at - w // 2 + j) * b[p][w - 1 - j] for j in range(w))
                assert abs(direct - y[k]) < 1e-4


def test_tone_lands_in_its_band_and_segments():
    rate = 8000
    t = np.arange(rate * 2) / rate
    x = np.where((t > 0.5) & (t < 1.2), np.sin(2 * np.pi * 1000 * t), 0).astype(np.float32)
    mel = audio.log_mel(x, rate)
    runs = audio.hysteresis(audio.loudness(mel))
    assert len(runs) == 1
    a, b = (r * audio.HOP / rate for r in runs[0])
    assert abs(a - 0.5) < 0.05 and abs(b - 1.2) < 0.05
    peak = int(mel[len(mel) * 2 // 5].argmax())
    bank = audio.mel_bank(rate, audio.FRAME, audio.MELS)
    assert bank[round(1000 * audio.FRAME / rate), peak] > 0.3


def test_query_form(spark):
    texts = ["hello", None, "", "hello", "é" * 70_000, "a b c " * 50]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, Media int")
    rows = {r.doc_id: r for r in audio.digests(docs).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        p = audio.pad(raw)
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert r.media_sha256 == hashlib.sha256(audio.to_wav(p)).hexdigest() and r.media_bytes == len(audio.to_wav(p))
    assert rows[0][1:] == rows[3][1:] and rows[1][1:] == rows[2][1:]
    full = audio.with_features(audio.to_audio(docs))
    assert full.columns == ["doc_id", "text", "media", "n_bytes", "tensors", "segments", "feature"]
    assert audio.digests(docs.limit(0)).count() == 0


def brute(payload):
    """Log-mel frames, their number and active runs, by sums written out."""
    x = (np.frombuffer(payload, np.uint8).astype(float) - 128) / 128
    b = audio.branches(audio.UP, audio.DOWN, audio.TAPS).astype(float)
    w = b.shape[1]
    y = []
    for k in range(-(-len(x) * audio.UP // audio.DOWN)):
        at, p = divmod(k * audio.DOWN, audio.UP)
        y.append(sum(x[min(max(at - w // 2 + j, 0), len(x) - 1)] * b[p][w - 1 - j] for j in range(w)))
    n = max(1, math.ceil(max(0, len(y) - audio.FRAME) / audio.HOP) + 1)
    y = np.array(y + [0.0] * ((n - 1) * audio.HOP + audio.FRAME - len(y)))
    t = np.arange(audio.FRAME)
    window, bank = 0.5 - 0.5 * np.cos(2 * np.pi * t / audio.FRAME), audio.mel_bank(audio.RATE * audio.UP / audio.DOWN, audio.FRAME, audio.MELS).astype(float)
    mel = []
    for i in range(n):
        f = y[i * audio.HOP : i * audio.HOP + audio.FRAME] * window
        power = [abs(np.sum(f * np.exp(-2j * np.pi * k * t / audio.FRAME))) ** 2 for k in range(audio.FRAME // 2 + 1)]
        mel.append([max(audio.FLOOR, math.log10(float(np.dot(power, bank[:, m])) + 1e-8)) for m in range(audio.MELS)])
    mel = np.array(mel)
    energy = np.log10((10**mel).sum(1))
    low, high = energy.min(), energy.max()
    runs, on = [], False
    for i, e in enumerate(energy) if high > low else []:
        now = e >= low + audio.ON * (high - low) or (on and e >= low + audio.OFF * (high - low))
        if now and not on:
            runs.append([i, i])
        if now:
            runs[-1][1] = i + 1
        on = now
    return mel, runs


def test_features_against_brute_force_and_stored_tensors(spark, tmp_path):
    rng = np.random.default_rng(4)
    texts = ["word " * 700 + "z" * 3000 + "\x01" * 4000 + "".join(chr(rng.integers(32, 0x250)) for _ in range(6000)), "short", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    media = audio.to_audio(docs)
    files = audio.write_features(media, f"file://{tmp_path}").collect()
    seen = {}
    for f in files:
        rows, t = audio.from_ipc(audio.read_bytes(f.uri)).to_pylist(), audio.from_ipc(audio.read_bytes(f.tensors))
        assert t.schema.field("logmel").type == pa.fixed_shape_tensor(pa.float16(), (audio.FRAMES, audio.MELS))
        all_mel = t.column("logmel").combine_chunks().to_numpy_ndarray()
        for i, r in enumerate(rows):
            own = [k for k, d in enumerate(t.column("doc").to_pylist()) if d == i]
            seen[r["id"]] = (np.concatenate([all_mel[k][: t.column("frames")[k].as_py()] for k in own]), r["segments"], [(t.column("start_s")[k].as_py(), t.column("end_s")[k].as_py()) for k in own])
    step = audio.HOP / (audio.RATE * audio.UP / audio.DOWN)
    for i, text in enumerate(texts):
        mel, runs = brute(audio.pad((text or "").encode()))
        got, segments, spans = seen[i]
        assert got.shape == mel.shape and np.abs(got - mel).max() < 0.02
        assert [(round(s["start_s"] / step), round(s["end_s"] / step)) for s in segments] == [(a, b + 1) for a, b in runs]  # a frame is two hops long
        assert [round(a / step) for a, _ in spans] == list(range(0, len(mel), audio.FRAMES)) and all(a < b for a, b in spans)
    assert len(seen[0][1]) >= 1
    told = {r.doc_id: r for r in audio.digests(docs).collect()}
    assert all(told[i].n_tensors == -(-len(seen[i][0]) // audio.FRAMES) and told[i].n_segments == len(seen[i][1]) and told[i].feature.startswith(f"frames={len(seen[i][0])};") for i in seen)
