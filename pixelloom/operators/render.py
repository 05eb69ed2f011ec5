"""Pictures of tiles with polygons drawn on them, made in tasks: a tile is one picture, put together from blocks, so neither pixels nor pictures pass the driver."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import filesink, png
from . import blocks

#: The colour of outlines.
COLOUR = (255, 40, 40)


def line(x0: int, y0: int, x1: int, y1: int) -> tuple[np.ndarray, np.ndarray]:
    """The cells (x, y) of a straight line between two cells, ends included: a step along the longer side, the other coordinate rounded half up."""
    n = max(abs(x1 - x0), abs(y1 - y0))
    t = np.arange(n + 1)
    put = lambda a, b: a + (2 * t * (b - a) + n) // (2 * n) if n else np.array([a])
    return put(x0, x1), put(y0, y1)


def draw(picture: np.ndarray, rings: list, colour: tuple = COLOUR) -> np.ndarray:
    """Rings of corners (x, y) drawn into a picture (row, col, 3); the corners beyond the last row or column fall onto it."""
    h, w, _ = picture.shape
    for ring in rings:
        for (x0, y0), (x1, y1) in zip(ring, ring[1:]):
            x, y = line(int(x0), int(y0), int(x1), int(y1))
            picture[np.clip(y, 0, h - 1), np.clip(x, 0, w - 1)] = colour
    return picture


def pictures(rgb: DataFrame, rings: DataFrame, bands: list[str], sizes: DataFrame, colour: tuple = COLOUR) -> DataFrame:
    """tile_id, content: a PNG for each tile of sizes (tile_id, height, width). rgb: tile_id, row, col and three bands from 0 to 1 (missing is black); rings: tile_id, rings
    (arrays of corners), of any number of polygons.

    Pixels are packed into blocks by the tasks that hold them, and rings are drawn where a tile's blocks meet."""
    packed = blocks.pack(rgb, bands).select("tile_id", "row0", "col0", "rows", "cols", "bands", "data", F.lit(None).cast("array<array<array<int>>>").alias("rings"))
    drawn = rings.select("tile_id", *[F.lit(None).cast(t).alias(c) for c, t in (("row0", "int"), ("col0", "int"), ("rows", "int"), ("cols", "int"), ("bands", "int"), ("data", "binary"))], "rings")
    parts = packed.unionByName(drawn)

    def paint(key: tuple, size: pa.Table, own: pa.Table) -> pa.Table:
        if not size.num_rows:
            return pa.table({"tile_id": pa.array([], pa.string()), "content": pa.array([], pa.binary())})
        at = size.to_pylist()[0]
        picture = np.zeros((at["height"], at["width"], 3), np.uint8)
        for b in own.to_batches(max_chunksize=64):
            for x in b.to_pylist():
                if x["data"] is not None:
                    v = np.frombuffer(x["data"], "<f8").reshape(x["bands"], x["rows"], x["cols"]).transpose(1, 2, 0)
                    r, c = min(x["rows"], at["height"] - x["row0"]), min(x["cols"], at["width"] - x["col0"])
                    if r > 0 and c > 0:
                        picture[x["row0"] : x["row0"] + r, x["col0"] : x["col0"] + c] = np.floor(255 * np.clip(np.nan_to_num(v[:r, :c]), 0, 1))
        for b in own.to_batches(max_chunksize=64):
            for x in b.to_pylist():
                if x["rings"] is not None:
                    draw(picture, x["rings"], colour)
        return pa.table({"tile_id": pa.array([at["tile_id"]]), "content": pa.array([png.encode(picture)], pa.binary())})

    return sizes.select("tile_id", "height", "width").groupBy("tile_id").cogroup(parts.groupBy("tile_id")).applyInArrow(paint, "tile_id string, content binary")


def write_pictures(drawn: DataFrame, folder: str) -> None:
    """A file for each tile, named after it."""
    filesink.write_files(drawn.select(F.concat("tile_id", F.lit(".png")).alias("name"), "content"), folder)


def pixels(files: DataFrame) -> DataFrame:
    """tile_id, row, col, r, g, b of pictures (tile_id, content)."""

    def run(batches):
        for b in batches:
            for tile, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = png.decode(data)
                row, col = np.divmod(np.arange(x.shape[0] * x.shape[1]), x.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array([tile] * len(row)), *[pa.array(v.astype(np.int32)) for v in (row, col, *x.reshape(-1, 3).T)]], ["tile_id", "row", "col", "r", "g", "b"])

    return files.select("tile_id", "content").mapInArrow(run, "tile_id string, row int, col int, r int, g int, b int")
