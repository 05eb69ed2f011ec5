"""Elevation cells, slope, and resampling of rasters onto another grid, in the same reference system or another.

A raster's place is its transform (a, b, c, d, e, f), as in x = a col + b row + c and y = d col + e row + f, and its EPSG code. Each of these may be a number or a column of
the grid, so that tiles may differ in place and system."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.pixel import cells_between, dem_cell, known, reproject, utm_to_lonlat

PIXEL = ["tile_id", "row", "col"]


def dem_cells(bounds: DataFrame, base_url: str = "") -> DataFrame:
    """bounds: tile_id, w, s, e, n in degrees. One row per elevation tile that a box needs, latitudes first."""
    ok = F.lit(True)
    for c in "wsen":
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    lat = bounds.filter(ok).select("tile_id", "w", "e", F.explode(cells_between(F.col("s"), F.col("n"))).alias("lat"))
    x = lat.select("tile_id", "lat", F.explode(cells_between(F.col("w"), F.col("e"))).alias("lon"))
    name = dem_cell(F.col("lat"), F.col("lon"))
    url = F.concat(F.lit(base_url), name, F.lit("/"), name, F.lit(".tif")) if base_url else name
    return x.select("tile_id", "lat", "lon", url.alias("dem"))


def mosaic(parts: DataFrame) -> DataFrame:
    """parts: tile_id, row, col, order, elevation. The first part in order that has a value wins."""
    x = parts.filter(known(F.col("elevation")).isNotNull())
    return x.groupBy(*PIXEL).agg(F.min_by("elevation", "order").alias("elevation"))


#: Metres in a degree of longitude at the equator, and of latitude.
DEGREE_X, DEGREE_Y = 111_320.0, 110_540.0


def metric_cell(a: Column, e: Column, geographic: Column, mid_lat: Column) -> tuple[Column, Column]:
    """Cell width and height in metres."""
    dx = F.when(geographic, F.abs(a) * DEGREE_X * F.greatest(F.cos(F.radians(mid_lat)), F.lit(1e-6))).otherwise(F.abs(a))
    return dx, F.when(geographic, F.abs(e) * DEGREE_Y).otherwise(F.abs(e))


def metric_size(a: float, e: float, geographic: bool, mid_lat: float) -> tuple[float, float]:
    """The same of numbers."""
    if not geographic:
        return abs(a), abs(e)
    return abs(a) * DEGREE_X * max(math.cos(math.radians(mid_lat)), 1e-6), abs(e) * DEGREE_Y


def slope(dem: DataFrame, dx: float | Column, dy: float | Column) -> DataFrame:
    """Slope in degrees: central differences inside, one-sided at the edges."""

    def gradient(line: list[str], along: str, step) -> Column:
        w = W.partitionBy(*line).orderBy(along)
        z = F.col("elevation")
        back, on = F.lag("elevation").over(w), F.lead("elevation").over(w)
        n = F.when(back.isNotNull() & on.isNotNull(), 2.0).otherwise(1.0)
        return F.coalesce((F.coalesce(on, z) - F.coalesce(back, z)) / (n * step), F.lit(0.0))

    lit = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    x = dem.withColumn("gx", gradient(["tile_id", "row"], "col", lit(dx))).withColumn("gy", gradient(["tile_id", "col"], "row", lit(dy)))
    return x.select(*PIXEL, "elevation", F.degrees(F.atan(F.hypot("gx", "gy"))).alias("slope"))


def target_grid(tiles: DataFrame, height: int, width: int) -> DataFrame:
    rows = tiles.select("tile_id").distinct().select("tile_id", F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("row"))
    return rows.select("tile_id", "row", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("col"))


def _lit(v) -> Column:
    return v if isinstance(v, Column) else F.lit(float(v))


def _at(grid: DataFrame, target: tuple, source: tuple, systems: tuple | None = None) -> DataFrame:
    """grid with u and v, the fractional source column and row of each target cell's centre; systems: EPSG codes of target and source, where they may differ."""
    a, b, c, d, e, f = map(_lit, target)
    x, y = F.col("col") + 0.5, F.col("row") + 0.5
    grid = grid.withColumns({"u": x * a + y * b + c, "v": x * d + y * e + f})
    if systems:
        grid = reproject(grid, "u", "v", *[v if isinstance(v, Column) else F.lit(v) for v in systems])
    a, b, c, d, e, f = map(_lit, source)
    det, x, y = a * e - b * d, F.col("u") - c, F.col("v") - f
    return grid.withColumns({"u": (x * e - y * b) / det, "v": (y * a - x * d) / det})


def warp_nearest(src: DataFrame, grid: DataFrame, target: tuple, source: tuple, value: str, nodata: float | None = 0.0, systems: tuple | None = None, keys: tuple = ("tile_id",)) -> DataFrame:
    """Each target cell takes the source cell that holds its centre; cells outside the source take nodata. keys: what tells a raster apart in grid and src."""
    g = _at(grid, target, source, systems).select(*keys, "row", "col", F.floor("v").cast("int").alias("sr"), F.floor("u").cast("int").alias("sc"))
    s = src.select(*keys, F.col("row").alias("sr"), F.col("col").alias("sc"), F.col(value))
    return g.join(s, [*keys, "sr", "sc"], "left").select(*keys, "row", "col", F.coalesce(value, F.lit(nodata)).alias(value) if nodata is not None else F.col(value))


def _corners(grid: DataFrame, keys: tuple) -> DataFrame:
    """grid has u and v: the four source cells around each target centre (sr, sc) with their weights w."""
    g = grid.select(*keys, "row", "col", (F.col("u") - 0.5).alias("u"), (F.col("v") - 0.5).alias("v"))
    g = g.withColumns({"c": F.floor("u").cast("int"), "r": F.floor("v").cast("int")}).withColumns({"du": F.col("u") - F.col("c"), "dv": F.col("v") - F.col("r")})
    near = F.explode(F.array(*[F.struct((F.col("r") + i).alias("sr"), (F.col("c") + j).alias("sc"), ((F.col("dv") if i else 1 - F.col("dv")) * (F.col("du") if j else 1 - F.col("du"))).alias("w")) for i in (0, 1) for j in (0, 1)]))
    return g.select(*keys, "row", "col", near.alias("n")).select(*keys, "row", "col", "n.*").filter("w > 0")


def warp_bilinear(src: DataFrame, grid: DataFrame, target: tuple, source: tuple, values: list[str], systems: tuple | None = None, keys: tuple = ("tile_id",), empty: float | None = 0.0) -> DataFrame:
    """Weights of the four source cells around a target centre, over those that have a value; `empty` where none does."""
    x = _corners(_at(grid, target, source, systems), keys).join(src.select(*keys, F.col("row").alias("sr"), F.col("col").alias("sc"), *values), [*keys, "sr", "sc"], "left")
    mean = lambda c: F.coalesce(F.sum(F.col(c) * F.col("w")) / F.sum(F.when(F.col(c).isNotNull(), F.col("w"))), F.lit(empty).cast("double"))
    return x.groupBy(*keys, "row", "col").agg(*[mean(c).alias(c) for c in values])


def warp_bilinear_array(src: DataFrame, grid: DataFrame, target: tuple, source: tuple, value: str, systems: tuple | None = None, keys: tuple = ("tile_id",)) -> DataFrame:
    """The same for a column of arrays (all bands of a raster at once); bands without a value are NULL, cells outside the source have no row."""
    x = _corners(_at(grid, target, source, systems), keys).join(src.select(*keys, F.col("row").alias("sr"), F.col("col").alias("sc"), F.col(value).alias("v")), [*keys, "sr", "sc"])
    near = x.groupBy(*keys, "row", "col").agg(F.collect_list(F.struct("w", "v")).alias("n"))  # four at most
    weight = lambda i: F.aggregate("n", F.lit(0.0), lambda a, y: a + F.when(y["v"][i].isNotNull(), y["w"]).otherwise(0.0))
    total = lambda i: F.aggregate("n", F.lit(0.0), lambda a, y: a + F.coalesce(y["v"][i] * y["w"], F.lit(0.0)))
    bands = F.sequence(F.lit(0), F.size(F.col("n")[0]["v"]) - 1)
    return near.select(*keys, "row", "col", F.transform(bands, lambda i: F.when(weight(i) > 0, total(i) / weight(i))).alias(value))


def terrain_features(dem: DataFrame, grid: DataFrame, target: tuple, source: tuple, dx: float | Column, dy: float | Column, systems: tuple | None = None) -> DataFrame:
    """Elevation and slope on the reference grid; the slope is taken on the elevation's own grid."""
    return warp_bilinear(slope(dem, dx, dy), grid, target, source, ["elevation", "slope"], systems)


def crop_or_pad(src: DataFrame, grid: DataFrame, value: str) -> DataFrame:
    """The source's top left corner on the grid; NULL where it has no cell."""
    return grid.select(*PIXEL).join(src.select(*PIXEL, value), PIXEL, "left")


def warp_or_keep(src: DataFrame, grid: DataFrame, target: tuple, source: tuple, value: str, nodata: float = 0.0) -> DataFrame:
    """Rasters on the target's grid already are taken as they are."""
    if tuple(target) == tuple(source):
        return grid.select(*PIXEL).join(src.select(*PIXEL, value), PIXEL, "left").select(*PIXEL, F.coalesce(value, F.lit(nodata)).alias(value))
    return warp_nearest(src, grid, target, source, value, nodata)


def lonlat_bounds(tiles: DataFrame, points: int = 21) -> DataFrame:
    """tiles: tile_id, zone, south, height, width, a, e (cell sizes), c, f (corner). Degrees of the box around its edges, taken at `points` each."""
    t = F.explode(F.sequence(F.lit(0), F.lit(points - 1)))
    x = tiles.withColumn("i", t).withColumn("t", F.col("i") / float(points - 1))
    side = F.explode(F.array(F.struct(F.col("t").alias("x"), F.lit(0.0).alias("y")), F.struct(F.col("t").alias("x"), F.lit(1.0).alias("y")), F.struct(F.lit(0.0).alias("x"), F.col("t").alias("y")), F.struct(F.lit(1.0).alias("x"), F.col("t").alias("y"))))
    x = x.withColumn("p", side)
    east, north = F.col("c") + F.col("p.x") * F.col("width") * F.col("a"), F.col("f") + F.col("p.y") * F.col("height") * F.col("e")
    shifted = F.when(F.col("south"), north - 10000000.0).otherwise(north)
    lon, lat = utm_to_lonlat(east, shifted, F.col("zone"))
    return x.select("tile_id", lon.alias("lon"), lat.alias("lat")).groupBy("tile_id").agg(F.min("lon").alias("w"), F.min("lat").alias("s"), F.max("lon").alias("e"), F.max("lat").alias("n"))
