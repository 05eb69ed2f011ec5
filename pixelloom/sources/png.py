"""Pictures as PNG files: encoding and decoding in numpy and zlib."""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Fixed values of the format: signature, colour type of RGB.
SIGNATURE, RGB = b"\x89PNG\r\n\x1a\n", 2


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(x: np.ndarray) -> bytes:
    """A PNG of (row, col, 3) bytes. Each line is stored as differences from the one above (filter 2)."""
    h, w, _ = x.shape
    lines = np.diff(x.astype(np.uint8).reshape(h, 3 * w), axis=0, prepend=np.zeros((1, 3 * w), np.uint8))
    raw = np.concatenate([np.full((h, 1), 2, np.uint8), lines], 1).tobytes()
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, RGB, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(raw)) + _chunk(b"IEND", b"")


def decode(data: bytes) -> np.ndarray:
    """(row, col, 3) bytes of a PNG of 8-bit RGB whose lines are stored plain or as differences from above."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    at, body, head = 8, b"", None
    while at < len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        own = data[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(kind + own):
            raise ValueError("PNG checksum")
        head, body, at = (own if kind == b"IHDR" else head), body + (own if kind == b"IDAT" else b""), at + 12 + n
    w, h, depth, colour, _, _, woven = struct.unpack(">IIBBBBB", head)
    if (depth, colour, woven) != (8, RGB, 0):
        raise ValueError("PNG kind")
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + 3 * w)
    if not np.isin(raw[:, 0], (0, 2)).all():
        raise ValueError("PNG filter")
    lines, out = raw[:, 1:], np.empty((h, 3 * w), np.uint8)
    for y in range(h):
        out[y] = lines[y] + (out[y - 1] if raw[y, 0] == 2 and y else 0)
    return out.reshape(h, w, 3)
