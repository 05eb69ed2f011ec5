"""GeoTIFF rasters as pixel relations, decoded in numpy.

Reads classic and big TIFF, either byte order, strips or tiles, pixel- or band-interleaved, uncompressed, deflate or LZW, with horizontal
differencing; and the tags that place a raster on the ground. Everything is read by byte ranges: tags from the first kilobytes (or wherever the directory
lies), and only those strips or tiles, of those bands, that a wanted window meets. So a file may be larger than memory, and many tasks may share one.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the format: bytes per field type, struct codes, tags.
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}
_CODES = {1: "B", 2: "c", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, SAMPLES, ROWS, STRIP_BYTES, PLANAR, PREDICTOR, TILE_W, TILE_H, TILES, TILE_BYTES, FORMAT = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325, 339
PIXEL_SCALE, TIE_POINT, TRANSFORM, GEO_KEYS = 33550, 33922, 34264, 34735


@dataclass
class Raster:
    bands: np.ndarray  # (band, row, col)
    transform: tuple  # a, b, c, d, e, f: x = a col + b row + c, y = d col + e row + f
    epsg: int | None


class Ranged:
    """Byte ranges of a file, or of bytes. Small reads take AHEAD bytes, which are kept for the next; counts what was read."""

    AHEAD = 4096

    def __init__(self, source):
        self.source, self.count, self.at, self.held = source, 0, 0, b""

    def get(self, at: int, n: int) -> bytes:
        if not self.at <= at <= at + n <= self.at + len(self.held):
            if isinstance(self.source, (bytes, memoryview)):
                self.at, self.held = 0, self.source
            else:
                self.source.seek(at)
                self.at, self.held = at, self.source.read(max(n, self.AHEAD) if n < self.AHEAD else n)
            self.count += len(self.held)
        return self.held[at - self.at : at - self.at + n]


def _tags(src: Ranged) -> tuple[str, dict]:
    order = {b"II": "<", b"MM": ">"}.get(bytes(src.get(0, 2)))
    if not order:
        raise ValueError("not a TIFF file")
    version = struct.unpack(order + "H", src.get(2, 2))[0]
    big = version == 43
    if version not in (42, 43):
        raise ValueError(f"TIFF version {version}")
    at = struct.unpack(order + ("Q" if big else "I"), src.get(8, 8) if big else src.get(4, 4))[0]
    n = struct.unpack(order + ("Q" if big else "H"), src.get(at, 8 if big else 2))[0]
    at += 8 if big else 2
    step, room = (20, 8) if big else (12, 4)
    entries, out = src.get(at, n * step), {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(order + ("HHQ" if big else "HHI"), entries, i * step)
        size = _SIZES.get(kind, 0) * count
        if kind not in _CODES:
            continue
        here = (i + 1) * step - room
        raw = src.get(struct.unpack_from(order + ("Q" if big else "I"), entries, here)[0], size) if size > room else entries[here : here + size]
        out[tag] = struct.unpack(f"{order}{count}{_CODES[kind]}", raw)
    return order, out


def _lzw(data: bytes) -> bytes:
    out, table, width, held, n, last = bytearray(), [], 9, 0, 0, b""
    for byte in data:
        held, n = held << 8 | byte, n + 8
        if n < width:
            continue
        n -= width
        code, held = held >> n, held & (1 << n) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        entry = table[code] if code < len(table) else last + last[:1]
        out += entry
        if last:
            table.append(last + entry[:1])
            if len(table) + 1 >= 1 << width and width < 12:
                width += 1
        last = entry
    return bytes(out)


@dataclass
class Header:
    bands: int
    height: int
    width: int
    dtype: np.dtype
    transform: tuple
    epsg: int | None


def _header(order: str, t: dict) -> Header:
    one = lambda tag, other=None: t[tag][0] if tag in t else other
    kind = np.dtype(f"{order}{ {1: 'u', 2: 'i', 3: 'f'}[one(FORMAT, 1)]}{one(BITS, 8) // 8}")
    if TRANSFORM in t:
        m = t[TRANSFORM]
        place = (m[0], m[1], m[3], m[4], m[5], m[7])
    elif PIXEL_SCALE in t:
        sx, sy, p = *t[PIXEL_SCALE][:2], t.get(TIE_POINT, (0,) * 6)
        place = (sx, 0.0, p[3] - p[0] * sx, 0.0, -sy, p[4] + p[1] * sy)
    else:
        place = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)
    keys = t.get(GEO_KEYS, ())
    named = {keys[i]: keys[i + 3] for i in range(4, len(keys), 4) if keys[i + 1] == 0}
    return Header(one(SAMPLES, 1), one(HEIGHT), one(WIDTH), kind, place, named.get(3072, named.get(2048)))


class File:
    """A raster that is read by ranges: its header, and windows of its bands."""

    def __init__(self, source):
        self.src = source if isinstance(source, Ranged) else Ranged(source)
        order, self.tags = _tags(self.src)
        self.head = _header(order, self.tags)

    def window(self, r0: int, r1: int, c0: int, c1: int, bands: list[int] | None = None) -> np.ndarray:
        """(band, row, col) of rows r0 to r1 and columns c0 to c1 (ends exclusive, inside the raster)."""
        t, head = self.tags, self.head
        one = lambda tag, other=None: t[tag][0] if tag in t else other
        bands = list(range(head.bands)) if bands is None else bands
        w, h, planar, how, ahead = head.width, head.height, one(PLANAR, 1), one(COMPRESSION, 1), one(PREDICTOR, 1)
        if how not in (1, 5, 8, 32946) or ahead not in (1, 2):
            raise ValueError(f"TIFF compression {how}, predictor {ahead}")
        tiled = TILES in t
        bw, bh = (one(TILE_W), one(TILE_H)) if tiled else (w, min(one(ROWS, h), h))
        across, down = -(-w // bw), -(-h // bh)
        at, sizes = t[TILES if tiled else STRIPS], t[TILE_BYTES if tiled else STRIP_BYTES]
        each = head.bands if planar == 1 else 1
        out = np.zeros((len(bands), r1 - r0, c1 - c0), head.dtype.newbyteorder("="))
        if not out.size:
            return out
        for plane in [None] if planar == 1 else bands:
            for y in range(r0 // bh, (r1 - 1) // bh + 1):
                for x in range(c0 // bw, (c1 - 1) // bw + 1):
                    k = (0 if plane is None else plane) * across * down + y * across + x
                    raw = self.src.get(at[k], sizes[k])
                    raw = zlib.decompress(raw) if how in (8, 32946) else _lzw(raw) if how == 5 else raw
                    rows = bh if tiled else min(bh, h - y * bh)
                    block = np.frombuffer(raw, head.dtype, rows * bw * each).reshape(rows, bw, each).astype(head.dtype.newbyteorder("="))
                    if ahead == 2:
                        block = np.cumsum(block, axis=1, dtype=block.dtype)
                    ya, yb, xa, xb = max(r0, y * bh), min(r1, y * bh + rows), max(c0, x * bw), min(c1, x * bw + bw)
                    part = block[ya - y * bh : yb - y * bh, xa - x * bw : xb - x * bw]
                    to = (slice(ya - r0, yb - r0), slice(xa - c0, xb - c0))
                    if plane is None:
                        out[(slice(None), *to)] = part[:, :, bands].transpose(2, 0, 1)
                    else:
                        out[(bands.index(plane), *to)] = part[:, :, 0]
        return out


def header(data: bytes) -> Header:
    """What the tags tell; no pixel is decoded."""
    return File(data).head


def decode(data: bytes) -> Raster:
    f = File(data)
    return Raster(f.window(0, f.head.height, 0, f.head.width), f.head.transform, f.head.epsg)


def encode(bands: np.ndarray, transform: tuple, epsg: int | None = None, *, compress: bool = True, tile: int | None = None, planar: bool = False, predictor: bool = False, order: str = "<") -> bytes:
    """A GeoTIFF of (band, row, col) values."""
    n, h, w = bands.shape
    kind = bands.dtype.newbyteorder(order)
    bw, bh = (tile, tile) if tile else (w, min(h, 64))
    blocks = []
    for plane in range(n) if planar else [None]:
        part = bands if plane is None else bands[plane : plane + 1]
        for y in range(0, h, bh):
            for x in range(0, w, bw):
                b = part[:, y : y + bh, x : x + bw]
                if tile:
                    b = np.pad(b, ((0, 0), (0, bh - b.shape[1]), (0, bw - b.shape[2])))
                if predictor:
                    b = np.diff(b, axis=2, prepend=b.dtype.type(0))
                raw = b.transpose(1, 2, 0).astype(kind).tobytes()
                blocks.append(zlib.compress(raw) if compress else raw)
    a, _, c, _, e, f = transform
    fmt = {"u": 1, "i": 2, "f": 3}[bands.dtype.kind]
    tags = [(WIDTH, "I", [w]), (HEIGHT, "I", [h]), (BITS, "H", [bands.dtype.itemsize * 8] * n), (COMPRESSION, "H", [8 if compress else 1]), (262, "H", [1]), (SAMPLES, "H", [n]), (PLANAR, "H", [2 if planar else 1]), (PREDICTOR, "H", [2 if predictor else 1]), (FORMAT, "H", [fmt] * n)]
    tags += [(TILE_W, "I", [bw]), (TILE_H, "I", [bh])] if tile else [(ROWS, "I", [bh])]
    tags += [(PIXEL_SCALE, "d", [a, -e, 0.0]), (TIE_POINT, "d", [0.0, 0.0, 0.0, c, f, 0.0])]
    tags += [(GEO_KEYS, "H", [1, 1, 0, 1, 2048 if epsg == 4326 else 3072, 0, 1, epsg])] if epsg else []
    at, starts = 8, []
    for b in blocks:
        starts.append(at)
        at += len(b) + len(b) % 2
    tags += [(TILES if tile else STRIPS, "I", starts), (TILE_BYTES if tile else STRIP_BYTES, "I", [len(b) for b in blocks])]
    tags.sort()
    code = {"H": 3, "I": 4, "d": 12}
    extra_at, entries, extra = at + 2 + 12 * len(tags) + 4, b"", b""
    for tag, k, v in tags:
        raw = struct.pack(f"{order}{len(v)}{k}", *v)
        if len(raw) > 4:
            field = struct.pack(order + "I", extra_at + len(extra))
            extra += raw + b"\0" * (len(raw) % 2)
        else:
            field = raw.ljust(4, b"\0")
        entries += struct.pack(order + "HHI", tag, code[k], len(v)) + field
    body = b"".join(b + b"\0" * (len(b) % 2) for b in blocks)
    return ({"<": b"II", ">": b"MM"}[order] + struct.pack(order + "HI", 42, at)) + body + struct.pack(order + "H", len(tags)) + entries + b"\0\0\0\0" + extra


# ---- as relations -----------------------------------------------------------------------------------------------


def files(spark: SparkSession, path: str, pattern: str = "*.tif*") -> DataFrame:
    """path, content of the rasters under a folder of any file system that Spark reads."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "content")


def profiles(rasters: DataFrame) -> DataFrame:
    """path, height, width, bands, dtype, epsg and the transform a ... f of each raster."""
    names = ["path", "height", "width", "bands", "dtype", "epsg", *"abcdef"]

    def run(batches):
        for b in batches:
            for path, data in zip(b.column(0), b.column(1)):
                r = header(data.as_py())
                row = [path.as_py(), r.height, r.width, r.bands, str(r.dtype.newbyteorder("=")), r.epsg, *map(float, r.transform)]
                kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), *[pa.float64()] * 6]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names)

    return rasters.select("path", "content").mapInArrow(run, "path string, height int, width int, bands int, dtype string, epsg int, " + ", ".join(f"{c} double" for c in "abcdef"))


def pixels(rasters: DataFrame, rows: int = 64) -> DataFrame:
    """path, row, col, is_integer and v, the bands' values as doubles (NaN becomes NULL)."""

    def run(batches):
        for b in batches:
            for path, data in zip(b.column(0), b.column(1)):
                r = decode(data.as_py())
                n, h, w = r.bands.shape
                whole = r.bands.dtype.kind in "iu"
                for y in range(0, h, rows):
                    part = r.bands[:, y : y + rows].astype(np.float64)
                    k = part.shape[1] * w
                    flat = part.reshape(n, k).T.ravel()
                    v = pa.ListArray.from_arrays(pa.array(np.arange(k + 1, dtype=np.int32) * n), pa.array(flat, from_pandas=True))
                    yy, xx = np.divmod(np.arange(k), w)
                    yield pa.RecordBatch.from_arrays([pa.array([path.as_py()] * k), pa.array((yy + y).astype(np.int32)), pa.array(xx.astype(np.int32)), pa.array([whole] * k), v], ["path", "row", "col", "is_integer", "v"])

    return rasters.select("path", "content").mapInArrow(run, "path string, row int, col int, is_integer boolean, v array<double>")


def aef(px: DataFrame) -> DataFrame:
    """All bands as the embedding; year and tile from the file's name."""
    return px.select(F.regexp_extract("path", r"/([^/]+)_\d{4}\.tiff?$", 1).alias("tile_id"), "row", "col", F.regexp_extract("path", r"_(\d{4})\.tiff?$", 1).cast("int").alias("year"), F.col("v").alias("emb"))


#: Fixed order of the optical bands.
S2_BANDS = ("b01", "b02", "b03", "b04", "b05", "b06", "b07", "b08", "b8a", "b09", "b11", "b12")


def s2(px: DataFrame) -> DataFrame:
    """Named bands; integer rasters are scaled to reflectance, others are taken as they are."""
    from .layout import S2_NAME

    n = lambda i: F.regexp_extract("path", S2_NAME, i).cast("int")
    value = lambda i: F.when(F.col("is_integer"), F.get("v", F.lit(i)) / 10000).otherwise(F.get("v", F.lit(i)))
    return px.filter(F.col("path").rlike(S2_NAME)).select(F.regexp_extract("path", r"(?i)/([^/]+)__s2_l2a_[^/]+$", 1).alias("tile_id"), "row", "col", n(1).alias("year"), n(2).alias("month"), *[value(i).alias(b) for i, b in enumerate(S2_BANDS)])


def s1(px: DataFrame) -> DataFrame:
    from .layout import S1_NAME

    n = lambda i: F.regexp_extract("path", S1_NAME, i)
    return px.filter(F.col("path").rlike(S1_NAME)).select(F.regexp_extract("path", r"(?i)/([^/]+)__s1_rtc_[^/]+$", 1).alias("tile_id"), "row", "col", n(1).cast("int").alias("year"), n(2).cast("int").alias("month"), F.lower(n(3)).alias("orbit"), F.get("v", F.lit(0)).alias("vv_linear"))
