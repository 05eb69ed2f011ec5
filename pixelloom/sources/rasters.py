"""Raster files read by byte ranges: headers, a data source of blocks, and windows warped onto a tile's grid where they are read.

Files are opened in workers through Arrow's file systems, by the URI that Spark lists them under, so a store that Arrow knows (local and mounted
folders, object stores, HDFS with its client library) is needed. Nothing reads a file whole: a header takes its first kilobytes, a block the strips or tiles that it meets.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from ..functions import warp
from . import geotiff

#: Cells of a block's side; bytes of files for one task of the source; requests for one task of a warp at least.
BLOCK, SHARE_BYTES, REQUESTS = 128, 64 << 20, 8
PLACE = [*"abcdef"]
HEAD = "height int, width int, bands int, dtype string, epsg int, " + ", ".join(f"{c} double" for c in PLACE)


def uri(path: str) -> str:
    """Spark writes file:/x where others write file:///x."""
    return re.sub(r"^file:/(?!/)", "file:///", path)


def opened(path: str):
    """A file of any store that Arrow knows, at random access."""
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(uri(path))
    return system.open_input_file(at)


def listing(spark: SparkSession, folder: str, pattern: str = r"(?i)\.tiff?$") -> DataFrame:
    """path, length of the files under a folder whose paths fit; contents aren't read."""
    x = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return x.filter(F.col("path").rlike(pattern)).select("path", "length")


def heads(files: DataFrame) -> DataFrame:
    """files with their headers' fields (HEAD): some kilobytes of each file are read."""
    keep, names = files.columns, [c.split()[0] for c in HEAD.split(", ")]
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), *[pa.float64()] * 6]

    def run(batches):
        for b in batches:
            rows = []
            for path in b.column(keep.index("path")).to_pylist():
                with opened(path) as f:
                    h = geotiff.File(f).head
                rows.append((h.height, h.width, h.bands, str(h.dtype.newbyteorder("=")), h.epsg, *map(float, h.transform)))
            cols = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], [*keep, *names])

    spread = files.repartition(2 * files.sparkSession.sparkContext.defaultParallelism, "path")
    return spread.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema) + ", " + HEAD)


# ---- a data source of blocks ------------------------------------------------------------------------------------


class _Share(InputPartition):
    """Files of a task, each with the share of its block rows: (path, share, of)."""

    def __init__(self, files: list[tuple[str, int, int]]):
        self.files = files


class RasterBlocks(DataSource):
    """spark.read.format("raster_blocks").load(folder): a row for each block of each raster under a folder, a file, or several paths on lines of their own.

    Columns: path, block_row, block_col, row0, col0, rows, cols, data (bands x rows x cols numbers of dtype, little endian), and the raster's header. Options: block
    (cells of a side), bands (positions, by commas), rows and cols (a:b, the window of cells; blocks are cut to it), pattern (of paths).
    Comparisons of block_row, block_col, row0, col0 and path with constants are pushed down: what they exclude isn't read."""

    SCHEMA = "path string, block_row int, block_col int, row0 int, col0 int, rows int, cols int, data binary, " + HEAD.replace("height", "raster_height").replace("width", "raster_width")

    @classmethod
    def name(cls) -> str:
        return "raster_blocks"

    def schema(self) -> str:
        return self.SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _BlockReader(dict(self.options))


def _span(text: str | None) -> tuple[int, int]:
    a, b = (text or ":").split(":")
    return int(a or 0), int(b) if b else 1 << 31


class _BlockReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options.get("path", "").split("\n") if p]
        self.pattern = options.get("pattern", r"(?i)\.tiff?$")
        self.block = int(options.get("block", BLOCK))
        self.bands = [int(b) for b in options["bands"].split(",")] if options.get("bands") else None
        self.rows, self.cols = _span(options.get("rows")), _span(options.get("cols"))
        self.only: set | None = None
        self.limits = {c: [0, 1 << 31] for c in ("block_row", "block_col", "row0", "col0")}  # first and last

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name == "path" and isinstance(f, (EqualTo, In)):
                told = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only = told if self.only is None else self.only & told
            elif name in self.limits and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and isinstance(f.value, int):
                at = self.limits[name]
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    at[0] = max(at[0], f.value + isinstance(f, GreaterThan))
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    at[1] = min(at[1], f.value - isinstance(f, LessThan))
            elif not (isinstance(f, IsNotNull) and (name == "path" or name in self.limits)):  # these are never null
                yield f

    def partitions(self) -> list[InputPartition]:
        """Files by listed size: small ones together, large ones in shares. No header is read here."""
        from pyarrow import fs

        found = []
        for path in self.paths:
            system, at = fs.FileSystem.from_uri(uri(path))
            info = system.get_file_info(at)
            lead = path[: len(path) - len(at)] if path.endswith(at) else ""
            every = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at, recursive=True))
            found += [(lead + x.path, x.size) for x in every if x.type == fs.FileType.File and re.search(self.pattern, x.path)]
        out, held, size = [], [], 0
        for path, n in sorted(found):
            if self.only is not None and path not in self.only:
                continue
            of = -(-n // SHARE_BYTES)
            if of > 1:
                out += [_Share([(path, k, of)]) for k in range(of)]
                continue
            if held and size + n > SHARE_BYTES:
                out.append(_Share(held))
                held, size = [], 0
            held, size = [*held, (path, 0, 1)], size + n
        return [*out, _Share(held)] if held or not out else out

    def read(self, partition):
        names = [c.split()[0] for c in RasterBlocks.SCHEMA.split(", ")]
        kinds = [pa.string(), *[pa.int32()] * 6, pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), *[pa.float64()] * 6]
        for path, share, of in partition.files:
            with opened(path) as source:
                f = geotiff.File(source)
                h, n = f.head, self.block
                down, across = -(-h.height // n), -(-h.width // n)
                for br in range(down * share // of, down * (share + 1) // of):
                    r0, r1 = max(br * n, self.rows[0]), min(br * n + n, h.height, self.rows[1])
                    if r0 >= r1 or not (self.limits["block_row"][0] <= br <= self.limits["block_row"][1] and self.limits["row0"][0] <= r0 <= self.limits["row0"][1]):
                        continue
                    spans = [(bc, max(bc * n, self.cols[0]), min(bc * n + n, h.width, self.cols[1])) for bc in range(across)]
                    spans = [(bc, a, b) for bc, a, b in spans if a < b and self.limits["block_col"][0] <= bc <= self.limits["block_col"][1] and self.limits["col0"][0] <= a <= self.limits["col0"][1]]
                    if not spans:
                        continue
                    line = f.window(r0, r1, spans[0][1], spans[-1][2], self.bands)  # a row of blocks at once, as strips go across
                    for bc, a, b in spans:
                        data = np.ascontiguousarray(line[:, :, a - spans[0][1] : b - spans[0][1]])
                        row = [path, br, bc, r0, a, r1 - r0, b - a, data.astype(data.dtype.newbyteorder("<")).tobytes(), h.height, h.width, len(data), str(data.dtype.newbyteorder("=")), h.epsg, *map(float, h.transform)]
                        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names)


def blocks(spark: SparkSession, paths: str | list[str], **options) -> DataFrame:
    """The blocks of rasters; options as RasterBlocks has them. Lets Spark push filters down to the source."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RasterBlocks)
    reader = spark.read.format("raster_blocks").options(**{k: str(v) for k, v in options.items()})
    return reader.load(paths if isinstance(paths, str) else "\n".join(paths))


def pixels(rows: DataFrame) -> DataFrame:
    """path, row, col, is_integer and v, the bands' values as doubles (NaN becomes NULL), of rows that blocks() gave."""

    def run(batches):
        for b in batches:
            for x in b.to_pylist():
                data = np.frombuffer(x["data"], np.dtype(x["dtype"]).newbyteorder("<")).reshape(x["bands"], x["rows"] * x["cols"])
                r, c = warp.cells((x["row0"], x["row0"] + x["rows"], x["col0"], x["col0"] + x["cols"]))
                yield pa.RecordBatch.from_arrays([pa.array([x["path"]] * len(r)), pa.array(r.astype(np.int32)), pa.array(c.astype(np.int32)), pa.array([data.dtype.kind in "iu"] * len(r)), arrays(data)], ["path", "row", "col", "is_integer", "v"])

    return rows.mapInArrow(run, "path string, row int, col int, is_integer boolean, v array<double>")


def arrays(data: np.ndarray) -> pa.ListArray:
    """(band, cell) numbers as a list for each cell; NaN becomes NULL."""
    n, k = data.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(k + 1, dtype=np.int32) * n), pa.array(data.T.astype(np.float64).ravel(), from_pandas=True))


# ---- windows on a tile's grid -----------------------------------------------------------------------------------


def reflectance(x: np.ndarray, whole: bool) -> np.ndarray:
    return x / 10000 if whole else x


def decibel(x: np.ndarray, whole: bool) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(x > 0, 10 * np.log10(x), np.nan)


def plain(x: np.ndarray, whole: bool) -> np.ndarray:
    return x


def requests(grid: DataFrame, side: int = BLOCK) -> DataFrame:
    """A row for each block of each tile's grid: tile_id, row0, col0, and the grid's place as t_ columns."""
    place = [F.col(c).alias(f"t_{c}") for c in ("height", "width", *PLACE, "epsg")]
    x = grid.select("tile_id", *place)
    x = x.withColumn("row0", F.explode(F.sequence(F.lit(0), F.col("t_height") - 1, F.lit(side))))
    return x.withColumn("col0", F.explode(F.sequence(F.lit(0), F.col("t_width") - 1, F.lit(side))))


def _target(x: dict, side: int) -> tuple[warp.Place, tuple[int, int, int, int]]:
    window = x["row0"], min(x["row0"] + side, x["t_height"]), x["col0"], min(x["col0"] + side, x["t_width"])
    return warp.Place(*[x[f"t_{c}"] for c in PLACE], x["t_epsg"]), window


def aligned(files: DataFrame, grid: DataFrame, value: Callable = plain, *, bilinear: bool, by_system: bool, fill: bool = False, side: int = BLOCK) -> DataFrame:
    """path, tile_id, row, col, v (an array of bands) of rasters on their tiles' grids. files: path, tile_id and the header's fields.

    Each block of a tile's grid is made where the file is read, from the strips or tiles that its inverse-mapped window meets: pixels aren't exchanged. Rasters with the
    grid's shape and transform (and system, with by_system) are taken as they are. Cells that a warped raster doesn't cover have no row, or zeros with fill. value:
    what numbers mean, applied before they are averaged."""
    todo = files.join(requests(grid, side), "tile_id")
    many = todo.count()  # a row for each block of each file
    todo = todo.repartition(max(1, min(many, max(2 * grid.sparkSession.sparkContext.defaultParallelism, many // REQUESTS))), "path", "row0")
    names = ["path", "tile_id", "row", "col", "v"]

    def run(batches):
        at, source, f = None, None, None
        for b in batches:
            for x in b.to_pylist():
                if x["path"] != at:
                    if source:
                        source.close()
                    at, source = x["path"], opened(x["path"])
                    f = geotiff.File(source)
                h = f.head
                target, window = _target(x, side)
                place = warp.Place(*map(float, h.transform), h.epsg)
                whole = h.dtype.kind in "iu"
                rows, cols = warp.cells(window)
                if (h.height, h.width) == (x["t_height"], x["t_width"]) and place.same_grid(target) and (not by_system or place.epsg == target.epsg):
                    got = value(f.window(*window).astype(np.float64), whole).reshape(h.bands, -1)
                    ok = np.ones(len(rows), bool)
                else:
                    need = warp.box(target, place, window, h.height, h.width)
                    got, ok = np.full((h.bands, len(rows)), np.nan), np.zeros(len(rows), bool)
                    if need:
                        v, u = target.inside(place, rows + 0.5, cols + 0.5)
                        data = value(f.window(*need).astype(np.float64), whole)
                        got, ok = (warp.bilinear if bilinear else warp.nearest)(data, v - need[0], u - need[2])
                    if fill:
                        got[:, ~ok], ok = 0.0, np.ones(len(rows), bool)
                n = int(ok.sum())
                if n:
                    yield pa.RecordBatch.from_arrays([pa.array([x["path"]] * n), pa.array([x["tile_id"]] * n), pa.array(rows[ok].astype(np.int32)), pa.array(cols[ok].astype(np.int32)), arrays(got[:, ok])], names)
        if source:
            source.close()

    return todo.sortWithinPartitions("path", "row0").mapInArrow(run, "path string, tile_id string, row int, col int, v array<double>")


def terrain(parts: DataFrame, grid: DataFrame, metric: Callable[[float, float, bool, float], tuple[float, float]], geographic: int, side: int = BLOCK) -> DataFrame:
    """tile_id, row, col, elevation, slope on the tiles' grids. parts: tile_id and an array of elevation rasters (path and header), in order of preference.

    The rasters of a tile are laid side by side on the grid of the first (the first in order counts where they overlap); of each, only the window is read that a block of
    the tile needs, with a cell around for means and another for slopes. metric: cell sizes in metres from (a, e, in degrees, middle latitude)."""
    todo = parts.join(requests(grid, side), "tile_id")
    many = todo.count()
    todo = todo.repartition(max(1, min(many, max(2 * grid.sparkSession.sparkContext.defaultParallelism, many // REQUESTS))), "tile_id", "row0")
    names = ["tile_id", "row", "col", "elevation", "slope"]

    def run(batches):
        for b in batches:
            for x in b.to_pylist():
                target, window = _target(x, side)
                first = x["parts"][0]
                a, e = first["a"], first["e"]
                west, north = min(p["c"] for p in x["parts"]), max(p["f"] for p in x["parts"])
                at = [(round((p["f"] - north) / e), round((p["c"] - west) / a)) for p in x["parts"]]
                height, width = max(r + p["height"] for (r, _), p in zip(at, x["parts"])), max(c + p["width"] for (_, c), p in zip(at, x["parts"]))
                place = warp.Place(a, 0.0, west, 0.0, e, north, first["epsg"])
                low = min(p["f"] + p["height"] * p["e"] for p in x["parts"])
                need = warp.box(target, place, window, height, width, 2)
                rows, cols = warp.cells(window)
                got = np.zeros((2, len(rows)))
                if need:
                    r0, r1, c0, c1 = need
                    z = np.full((r1 - r0, c1 - c0), np.nan)
                    for (r, c), p in reversed(list(zip(at, x["parts"]))):
                        ra, rb, ca, cb = max(r0, r), min(r1, r + p["height"]), max(c0, c), min(c1, c + p["width"])
                        if ra < rb and ca < cb:
                            with opened(p["path"]) as source:
                                own = geotiff.File(source).window(ra - r, rb - r, ca - c, cb - c, [0])[0].astype(np.float64)
                            part = z[ra - r0 : rb - r0, ca - c0 : cb - c0]
                            part[np.isfinite(own)] = own[np.isfinite(own)]
                    v, u = target.inside(place, rows + 0.5, cols + 0.5)
                    s = warp.slope(z, *metric(a, e, first["epsg"] in (None, geographic), (north + low) / 2))
                    got = np.nan_to_num(warp.bilinear(np.stack([z, s]), v - r0, u - c0)[0])
                n = len(rows)
                yield pa.RecordBatch.from_arrays([pa.array([x["tile_id"]] * n), pa.array(rows.astype(np.int32)), pa.array(cols.astype(np.int32)), pa.array(got[0]), pa.array(got[1])], names)

    return todo.mapInArrow(run, "tile_id string, row int, col int, elevation double, slope double")
