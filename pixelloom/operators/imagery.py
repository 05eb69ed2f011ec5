"""What pictures of a tile need: composites, stretches, the choice of scenes, and polygons within a footprint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PIXEL = ["tile_id", "row", "col"]


def median_composite(obs: DataFrame, bands: list[str]) -> DataFrame:
    """Per pixel and band the median of the year's values above 0."""
    return obs.groupBy(*PIXEL, "year").agg(*[F.median(F.when(F.col(b) > 0, F.col(b))).alias(b) for b in bands])


def stretch(rgb: DataFrame, bands: list[str], by: list[str], low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Each band scaled from its percentiles to 0 ... 1, per group `by`; missing values, and bands without a range, are 0."""
    p = rgb.groupBy(*by).agg(*[F.percentile(b, F.array(F.lit(low), F.lit(high))).alias(f"p_{b}") for b in bands])
    x = rgb.join(p, by)

    def scaled(b):
        lo, hi = F.col(f"p_{b}")[0], F.col(f"p_{b}")[1]
        return F.when((hi > lo) & F.col(b).isNotNull(), F.least(F.greatest((F.col(b) - lo) / F.when(hi > lo, hi - lo), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)

    return x.select(*rgb.columns[: len(rgb.columns) - len(bands)], *[scaled(b).alias(b) for b in bands])


def pick_scene(scenes: DataFrame, year: int | None, month: int | None) -> DataFrame:
    """scenes: tile_id, year, month. Per tile the exact month, else the year's latest, else the latest of all."""
    rank = F.when((F.col("year") == F.lit(year)) & (F.col("month") == F.lit(month)), 0).when(F.col("year") == F.lit(year), 1).otherwise(2)
    w = W.partitionBy("tile_id").orderBy(rank, F.desc("year"), F.desc("month"))
    return scenes.select("tile_id", "year", "month").distinct().withColumn("rank", F.row_number().over(w)).filter("rank = 1").drop("rank")


def scene_rgb(obs: DataFrame, picked: DataFrame, bands: list[str]) -> DataFrame:
    """The bands of each tile's picked scene (tile_id, year, month), values that are not above 0 as missing."""
    x = obs.join(picked.select("tile_id", "year", "month"), ["tile_id", "year", "month"], "left_semi")  # a row for each tile
    return x.select(*PIXEL, "year", *[F.when(F.col(b) > 0, F.col(b)).alias(b) for b in bands])


def basemap(obs: DataFrame, bands: list[str], *, mode: str = "median", year: int | None = None, month: int | None = None) -> DataFrame:
    """A tile's picture, stretched: the median of a year (the asked one, else the tile's last), or one scene."""
    if mode == "median":
        last = W.partitionBy("tile_id")
        years = obs.select("tile_id", "year").distinct()
        years = years.filter(F.col("year") == year) if year is not None else years.withColumn("y", F.max("year").over(last)).filter("year = y").drop("y")
        rgb = median_composite(obs.join(years, ["tile_id", "year"], "left_semi"), bands)
    else:
        rgb = scene_rgb(obs, pick_scene(obs, year, month), bands)
    return stretch(rgb.select(*PIXEL, *bands), bands, ["tile_id"])


def clip(boxes: DataFrame, footprint: DataFrame) -> DataFrame:
    """boxes: poly_id, w, s, e, n. Polygons whose boxes meet a footprint (tile_id, w, s, e, n), touching included; they are not cut.

    Both sides are dealt over whole degrees, so the join is by equality of cells."""
    deg = lambda x: x.withColumn("lon", F.explode(F.sequence(F.floor("w").cast("int"), F.floor("e").cast("int")))).withColumn("lat", F.explode(F.sequence(F.floor("s").cast("int"), F.floor("n").cast("int"))))
    b, f = deg(boxes), deg(footprint.select("tile_id", *[F.col(c).alias(c) for c in "wsen"])).select("tile_id", "lon", "lat", *[F.col(c).alias(f"t{c}") for c in "wsen"])
    x = b.join(f, ["lon", "lat"]).filter("w <= te and e >= tw and s <= tn and n >= ts")
    return x.select("tile_id", "poly_id").distinct()


def footprint(cells: DataFrame, size: float = 10.0) -> DataFrame:
    """The box of a tile's cells in grid units."""
    return cells.groupBy("tile_id").agg((F.min("col") * size).alias("w"), (F.min("row") * size).alias("n_edge"), ((F.max("col") + 1) * size).alias("e"), ((F.max("row") + 1) * size).alias("s_edge"))
