"""From a folder of rasters to pixel relations on each tile's reference grid.

The reference grid of a tile is that of its first optical scene. Optical and radar rasters with the same shape and transform are taken as they are (their system isn't
looked at), others are warped; embeddings and label rasters are warped unless their system agrees too. The unit of work is a block of a tile's grid and a file: the
block is made where the file is read, from the byte ranges that it needs, so neither files nor tiles are ever whole in one place.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pixel import LONLAT, UTM_SOUTH
from ..operators import labels, terrain
from ..plans.staging import cut
from . import geotiff, layout, rasters

PIXEL = ["tile_id", "row", "col"]


@dataclass
class Relations:
    """What a job reads, keyed by pixel; missing ones are None."""

    cells: DataFrame  # tile_id, row, col: the reference grid
    s2: DataFrame | None = None
    s1: DataFrame | None = None
    aef: DataFrame | None = None
    terrain: DataFrame | None = None
    weak: DataFrame | None = None
    months: DataFrame | None = None  # tile_id, year, month of the optical scenes
    years: DataFrame | None = None  # tile_id, base_year, last_year
    grid: DataFrame | None = None  # tile_id, height, width, a ... f, epsg


def files_of(spark: SparkSession, folder: str, pattern: str, tile: int, tiles: list[str] | None) -> DataFrame | None:
    """path, tile_id of a folder's files whose names fit; None if there is no such folder. tile: the group of the pattern that names it."""
    if not layout.exists(spark, folder):
        return None
    x = rasters.listing(spark, folder, pattern).select("path", F.regexp_extract("path", pattern, tile).alias("tile_id"))
    return x if tiles is None else x.filter(F.col("tile_id").isin(tiles))


def reference_grid(scenes: DataFrame) -> DataFrame:
    """tile_id, height, width, a ... f, epsg of each tile's first scene; scenes: tile_id, year, month, path."""
    first = scenes.groupBy("tile_id").agg(F.min_by("path", F.struct("year", "month")).alias("path"))
    return rasters.heads(first).select("tile_id", "height", "width", *"abcdef", "epsg")


def grid_cells(grid: DataFrame) -> DataFrame:
    rows = grid.select("*", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("row"))
    return rows.select("*", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("col")).select(*PIXEL)


def _aligned(files: DataFrame | None, grid: DataFrame, value=rasters.plain, **how) -> DataFrame | None:
    """All pixels of the files on the tiles' grids; value: what a raster's numbers mean."""
    return None if files is None else rasters.aligned(files, grid, value, **how)


def _alerts(x: DataFrame | None, pattern: str, kind: int, names: tuple[str, str], keys: list[Column]) -> DataFrame | None:
    """Alert and date rasters side by side; pixels that only one of them has are left out."""
    if x is None:
        return None
    x = x.select(*PIXEL, *keys, F.regexp_extract("path", pattern, kind).alias("kind"), F.get("v", F.lit(0)).cast("int").alias("x"))
    on = [*PIXEL, *[c for c in x.columns if c not in (*PIXEL, "kind", "x")]]
    return x.filter("kind = 'alert'").drop("kind").withColumnRenamed("x", names[0]).join(x.filter("kind = 'alertDate'").drop("kind").withColumnRenamed("x", names[1]), on)


def weak_labels(spark: SparkSession, root: str, grid: DataFrame, tiles: list[str] | None) -> DataFrame | None:
    """Decoded alerts of all sources on the tiles' grids, a row per pixel and source that the tile has rasters of; None without any.

    Pixels of the grid that a source's raster doesn't cover count as without alert."""
    base = f"{root.rstrip('/')}/labels/train"
    raw = lambda folder, pattern, tile: files_of(spark, f"{base}/{folder}", pattern, tile, tiles)
    put = lambda files: _aligned(files, grid, bilinear=False, by_system=True)
    cells, out = grid_cells(grid), []

    def full(files: DataFrame, rows: DataFrame, *more: str) -> DataFrame:
        have = files.select("tile_id", *more).distinct()
        values = [c for c in rows.columns if c not in (*PIXEL, *more)]
        return cells.join(have, "tile_id").join(rows, [*PIXEL, *more], "left").na.fill(0, values)  # a row for each tile (and year)

    files = raw("radd", layout.RADD_NAME, 1)
    if files is not None:
        out.append(labels.radd(full(files, put(files).select(*PIXEL, F.get("v", F.lit(0)).cast("long").alias("code")))))
    files = raw("gladl", layout.GLADL_NAME, 1)
    if files is not None:
        yy = F.regexp_extract("path", layout.GLADL_NAME, 3).cast("int").alias("yy")
        both = files.select("tile_id", yy, F.regexp_extract("path", layout.GLADL_NAME, 2).alias("kind")).groupBy("tile_id", "yy").agg(F.count_distinct("kind").alias("n")).filter("n = 2 and yy between 20 and 29")
        out.append(labels.gladl_combine(labels.gladl(full(both, _alerts(put(files), layout.GLADL_NAME, 2, ("alert", "doy"), [yy]), "yy"))))
    files = raw("glads2", layout.GLADS2_NAME, 1)
    if files is not None:
        both = files.groupBy("tile_id").agg(F.count_distinct(F.regexp_extract("path", layout.GLADS2_NAME, 2)).alias("n")).filter("n = 2")
        out.append(labels.glads2(full(both, _alerts(put(files), layout.GLADS2_NAME, 2, ("alert", "day_offset"), []))))
    return labels.weak_labels(*[x.select(*PIXEL, "source", "confidence", "days") for x in out]) if out else None


def elevation(spark: SparkSession, folder: str, grid: DataFrame) -> DataFrame | None:
    """Elevation and slope on the tiles' grids, from elevation rasters named by terrain.dem_cells that have been landed in a folder.

    The rasters that a tile needs are laid side by side on one grid, the first in order where they overlap."""
    if not layout.exists(spark, folder):
        return None
    zone = F.when(F.col("epsg") == LONLAT, None).otherwise(F.col("epsg") % 100)
    utm = terrain.lonlat_bounds(grid.filter(F.col("epsg") != LONLAT).withColumns({"zone": zone, "south": F.col("epsg") > UTM_SOUTH}))
    flat = grid.filter(F.col("epsg") == LONLAT).select("tile_id", F.col("c").alias("w"), (F.col("f") + F.col("height") * F.col("e")).alias("s"), (F.col("c") + F.col("width") * F.col("a")).alias("e"), F.col("f").alias("n"))
    need = terrain.dem_cells(utm.unionByName(flat)).withColumn("part", F.struct("lat", "lon"))
    files = rasters.listing(spark, folder).withColumn("dem", F.regexp_extract("path", r"/([^/]+)\.tiff?$", 1)).join(need, "dem")
    names = ["path", "height", "width", *"abcdef", F.coalesce("epsg", F.lit(LONLAT)).alias("epsg")]
    parts = rasters.heads(files.select("path", "tile_id", "part")).groupBy("tile_id").agg(F.sort_array(F.collect_list(F.struct("part", *names))).alias("parts"))  # the few rasters that a tile needs
    none = [r.tile_id for r in grid.select("tile_id").join(parts, "tile_id", "left_anti").orderBy("tile_id").limit(5).collect()]
    if none:
        raise FileNotFoundError(f"no elevation raster in {folder} for the tiles {none} and perhaps others")

    return rasters.terrain(parts, grid, terrain.metric_size, LONLAT)


def load(spark: SparkSession, root: str, *, split: str = "train", tiles: list[str] | None = None, dem: str | None = None, strict: bool = False) -> Relations:
    """All relations of a dataset's folder, for the given tiles or all that it has.

    Tiles without optical scenes or without embeddings can't be used: they are left out, or an error if strict."""
    root = root.rstrip("/")
    s2_files = files_of(spark, f"{root}/sentinel-2/{split}", layout.S2_NAME.replace(".*", r".*/([^/]+)", 1), 1, tiles)
    aef_files = files_of(spark, f"{root}/aef-embeddings/{split}", layout.AEF_NAME, 1, tiles)
    if s2_files is None or aef_files is None:
        raise FileNotFoundError(f"no optical scenes or no embeddings under {root} for {split}")
    date = lambda i: F.regexp_extract("path", layout.S2_NAME, i).cast("int")
    scenes = s2_files.select("path", "tile_id", date(1).alias("year"), date(2).alias("month"))
    usable = scenes.select("tile_id", "year").distinct().join(aef_files.select("tile_id", F.regexp_extract("path", layout.AEF_NAME, 2).cast("int").alias("year")), ["tile_id", "year"])
    have = sorted(r.tile_id for r in usable.select("tile_id").distinct().collect())  # a row for each tile
    if strict and tiles is not None and set(tiles) - set(have):
        raise FileNotFoundError(f"no optical scenes or no embeddings of {sorted(set(tiles) - set(have))} under {root}")
    if not have:
        raise FileNotFoundError(f"no usable tiles under {root}")
    only = F.col("tile_id").isin(have)
    s2_files, aef_files, scenes = s2_files.filter(only), aef_files.filter(only), scenes.filter(only)
    grid = cut(reference_grid(scenes))  # a row for each tile, which everything below joins
    px = _aligned(s2_files, grid, rasters.reflectance, bilinear=True, by_system=False, fill=True).withColumn("is_integer", F.lit(False))
    s1_files = files_of(spark, f"{root}/sentinel-1/{split}", layout.S1_NAME.replace(".*", r".*/([^/]+)", 1), 1, have)
    s1 = None
    if s1_files is not None:
        part = lambda i: F.regexp_extract("path", layout.S1_NAME, i)
        s1 = _aligned(s1_files, grid, rasters.decibel, bilinear=True, by_system=False)
        s1 = s1.select(*PIXEL, part(1).cast("int").alias("year"), part(2).cast("int").alias("month"), F.lower(part(3)).alias("orbit"), F.get("v", F.lit(0)).alias("vv_db"))
    used = aef_files.withColumn("year", F.regexp_extract("path", layout.AEF_NAME, 2).cast("int")).join(scenes.select("tile_id", "year").distinct(), ["tile_id", "year"], "left_semi").select("path", "tile_id")
    aef = geotiff.aef(_aligned(used, grid, bilinear=True, by_system=True, fill=True))
    years = scenes.groupBy("tile_id").agg(F.min("year").alias("base_year"), F.max("year").alias("last_year"))
    return Relations(
        cells=grid_cells(grid), s2=geotiff.s2(px), s1=s1, aef=aef,
        terrain=elevation(spark, dem, grid) if dem else None, weak=weak_labels(spark, root, grid, have) if split == "train" else None,
        months=scenes.select("tile_id", "year", "month").distinct(), years=years, grid=grid,
    )
