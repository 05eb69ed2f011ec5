"""Rasters as blocks: a row holds SIDE x SIDE cells of all bands as one tensor, beside the pixel relation where a cell is a row.

Blocks: the keys that tell a raster apart, row0, col0 (the block's first cell), rows, cols, bands, and data: bands x rows x cols doubles, little endian, NaN where a cell is missing.
Warping exchanges, for each block of the target grid, only the part of each source block that the target block's inverse-mapped window meets; numpy does the rest inside.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import warp as w

SIDE = 128
PLACE = [*"abcdef", "epsg"]
BLOCK = "row0 int, col0 int, rows int, cols int, bands int, data binary"


def _compact(x: np.ndarray) -> bytes:
    """Numbers for an exchange: in single precision where that is exact, as rasters mostly are."""
    small = x.astype("<f4")
    return small.tobytes() if np.array_equal(small, x, equal_nan=True) else x.astype("<f8").tobytes()


def _loose(data: bytes, bands: int, rows: int, cols: int) -> np.ndarray:
    return np.frombuffer(data, "<f4" if len(data) == 4 * bands * rows * cols else "<f8").reshape(bands, rows, cols)


def _schema(df: DataFrame, keys: list[str], rest: str) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys) + f", {rest}"


def _tensor(data: bytes, bands: int, rows: int, cols: int) -> np.ndarray:
    return np.frombuffer(data, "<f8").reshape(bands, rows, cols)


def _key_columns(keys: tuple, schema: T.StructType) -> list[pa.Array]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [pa.array([k.as_py() if isinstance(k, pa.Scalar) else k], to_arrow_type(f.dataType)) for k, f in zip(keys, schema)]


def pack(px: DataFrame, values: list[str], keys: tuple[str, ...] = ("tile_id",), side: int = SIDE) -> DataFrame:
    """A pixel relation (keys, row, col, values) as blocks; values are the bands. Blocks reach as far as their last cells.

    Tasks pack what they hold of a block before it is exchanged: a few bytes for each cell, not a row."""
    keys, n = list(keys), len(values)
    src = px.select(*keys, F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), *[F.col(v).cast("double").alias(f"v{i}") for i, v in enumerate(values)])
    part = _schema(px, keys, "row0 int, col0 int, at binary, data binary")

    def gather(batches):
        for b in batches:
            if not b.num_rows:
                continue
            row, col = b.column(len(keys)).to_numpy(), b.column(len(keys) + 1).to_numpy()
            v = np.stack([b.column(len(keys) + 2 + i).to_numpy(zero_copy_only=False).astype(float) for i in range(n)], 1)
            own = b.select(keys).to_pandas()
            for key, idx in own.assign(_r=row // side, _c=col // side).groupby([*keys, "_r", "_c"], dropna=False, sort=False).indices.items():
                *k, br, bc = key
                at = ((row[idx] - br * side) * side + col[idx] - bc * side).astype("<i4")
                yield pa.RecordBatch.from_arrays([*_key_columns(tuple(k), key_schema), pa.array([br * side], pa.int32()), pa.array([bc * side], pa.int32()), pa.array([at.tobytes()]), pa.array([v[idx].astype("<f8").tobytes()])], [*keys, "row0", "col0", "at", "data"])

    key_schema = T.StructType([px.schema[k] for k in keys])

    def merge(key: tuple, t: pa.Table) -> pa.Table:
        at = np.concatenate([np.frombuffer(x, "<i4") for x in t.column("at").to_pylist()])
        v = np.concatenate([np.frombuffer(x, "<f8").reshape(-1, n) for x in t.column("data").to_pylist()])
        r, c = np.divmod(at, side)
        out = np.full((n, int(r.max()) + 1, int(c.max()) + 1), np.nan)
        out[:, r, c] = v.T
        *k, row0, col0 = key
        cells = [pa.array([x.as_py()], pa.int32()) for x in (row0, col0)] + [pa.array([x], pa.int32()) for x in (out.shape[1], out.shape[2], n)]
        return pa.Table.from_arrays([*_key_columns(tuple(k), key_schema), *cells, pa.array([out.astype("<f8").tobytes()], pa.binary())], [*keys, "row0", "col0", "rows", "cols", "bands", "data"])

    return src.mapInArrow(gather, part).groupBy(*keys, "row0", "col0").applyInArrow(merge, _schema(px, keys, BLOCK))


def unpack(blocks: DataFrame, names: list[str], keys: tuple[str, ...] = ("tile_id",)) -> DataFrame:
    """Blocks as a pixel relation: keys, row, col and a column for each band; missing is NULL."""
    keys = list(keys)
    key_schema = T.StructType([blocks.schema[k] for k in keys])

    def run(batches):
        for b in batches:
            for x in b.to_pylist():
                data = _tensor(x["data"], x["bands"], x["rows"], x["cols"]).reshape(x["bands"], -1)
                r, c = w.cells((x["row0"], x["row0"] + x["rows"], x["col0"], x["col0"] + x["cols"]))
                own = [pa.array([x[k]] * len(r), kind.type) for k, kind in zip(keys, _key_columns(tuple(None for _ in keys), key_schema))]
                yield pa.RecordBatch.from_arrays([*own, pa.array(r.astype(np.int32)), pa.array(c.astype(np.int32)), *[pa.array(v, from_pandas=True) for v in data]], [*keys, "row", "col", *names])

    return blocks.mapInArrow(run, _schema(blocks, keys, "row int, col int, " + ", ".join(f"`{n}` double" for n in names)))


def warp(blocks: DataFrame, places: DataFrame, *, bilinear: bool, empty: float | None = None, keys: tuple[str, ...] = ("tile_id",), side: int = SIDE) -> DataFrame:
    """Blocks of the target grids, whole ones with `empty` where the source has nothing.

    places: for each raster (keys) its height, width, a ... f, epsg, and the target grid's as t_height, ... t_epsg. A block goes on, cut to what is needed, once for each
    target block that it touches; both are found by mapping rims, so nothing but a block and its own raster's place is looked at."""
    keys = list(keys)
    place = [c for c in places.columns if c not in keys]
    key_schema = T.StructType([blocks.schema[k] for k in keys])
    cut_schema = _schema(blocks, keys, "t_row int, t_col int, row0 int, col0 int, rows int, cols int, bands int, data binary")
    names = [*keys, "t_row", "t_col", "row0", "col0", "rows", "cols", "bands", "data"]
    both = lambda x: (w.Place(*[x[c] for c in PLACE]), w.Place(*[x[f"t_{c}"] for c in PLACE]))
    window = lambda x, r, c: (r, min(r + side, x["t_height"]), c, min(c + side, x["t_width"]))

    def crop(batches):
        for b in batches:
            for x in b.to_pylist():
                source, target = both(x)
                data = _tensor(x["data"], x["bands"], x["rows"], x["cols"])
                r0, c0 = x["row0"], x["col0"]
                met = w.box(source, target, (r0, r0 + x["rows"], c0, c0 + x["cols"]), x["t_height"], x["t_width"], 2 + _reach(source, target, r0, c0))
                if met is None:
                    continue
                for tr in range(met[0] // side * side, met[1], side):
                    for tc in range(met[2] // side * side, met[3], side):
                        need = w.box(target, source, window(x, tr, tc), x["height"], x["width"])
                        if need is None:
                            continue
                        ra, rb, ca, cb = max(r0, need[0]), min(r0 + x["rows"], need[1]), max(c0, need[2]), min(c0 + x["cols"], need[3])
                        if ra < rb and ca < cb:
                            part = data[:, ra - r0 : rb - r0, ca - c0 : cb - c0]
                            cells = [pa.array([v], pa.int32()) for v in (tr, tc, ra, ca, rb - ra, cb - ca, x["bands"])]
                            yield pa.RecordBatch.from_arrays([*_key_columns(tuple(x[k] for k in keys), key_schema), *cells, pa.array([_compact(part)], pa.binary())], names)

    parts = blocks.join(places, keys).mapInArrow(crop, cut_schema)  # a row for each raster, by Spark's size check
    grid = places.withColumn("t_row", F.explode(F.sequence(F.lit(0), F.col("t_height") - 1, F.lit(side)))).withColumn("t_col", F.explode(F.sequence(F.lit(0), F.col("t_width") - 1, F.lit(side))))
    bands = blocks.select(*keys, "bands").groupBy(*keys).agg(F.max("bands").alias("n_bands"))
    todo = grid.join(bands, keys)

    def make(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out_names = [*keys, "row0", "col0", "rows", "cols", "bands", "data"]
        if not left.num_rows:
            return pa.Table.from_arrays([*[c.slice(0, 0) for c in _key_columns(tuple(None for _ in keys), key_schema)], *[pa.array([], pa.int32())] * 5, pa.array([], pa.binary())], out_names)
        x = left.to_pylist()[0]
        source, target = both(x)
        at = window(x, x["t_row"], x["t_col"])
        rows, cols = w.cells(at)
        got = np.full((x["n_bands"], len(rows)), np.nan)
        need = w.box(target, source, at, x["height"], x["width"])
        if need and right.num_rows:
            data = np.full((x["n_bands"], need[1] - need[0], need[3] - need[2]), np.nan)
            for p in right.to_pylist():
                data[:, p["row0"] - need[0] : p["row0"] - need[0] + p["rows"], p["col0"] - need[2] : p["col0"] - need[2] + p["cols"]] = _loose(p["data"], p["bands"], p["rows"], p["cols"])
            v, u = target.inside(source, rows + 0.5, cols + 0.5)
            got, _ = (w.bilinear if bilinear else w.nearest)(data, v - need[0], u - need[2])
        if empty is not None:
            got = np.where(np.isnan(got), empty, got)
        cells = [pa.array([v], pa.int32()) for v in (at[0], at[2], at[1] - at[0], at[3] - at[2], x["n_bands"])]
        return pa.Table.from_arrays([*_key_columns(tuple(x[k] for k in keys), key_schema), *cells, pa.array([got.astype("<f8").tobytes()], pa.binary())], out_names)

    on = [*keys, "t_row", "t_col"]
    return todo.select(*on, *place, "n_bands").groupBy(*on).cogroup(parts.groupBy(*on)).applyInArrow(make, _schema(blocks, keys, BLOCK))


def _reach(source: w.Place, target: w.Place, row: int, col: int) -> int:
    """How many target cells a source cell may cover in a direction, rounded up: a target cell takes part of what lies a source cell away."""
    v, u = source.inside(target, np.array([row, row + 1.0, row]), np.array([col, col, col + 1.0]))
    return int(np.ceil(max(abs(v[1] - v[0]), abs(u[1] - u[0]), abs(v[2] - v[0]), abs(u[2] - u[0]))))
