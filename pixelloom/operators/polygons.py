"""Polygons of a GeoJSON file back to cells: what scoring a submission needs.

Rings of longitude and latitude are brought onto a tile's grid and filled line by line: each edge crosses the middles of the rows between its ends, and inside is
between the crossings of odd and even rank (the even-odd rule, so holes and parts of a multipolygon need no care). Work is a row for each crossing, dealt by tile, polygon and
row, whatever a polygon's size. Cells belong to a polygon whose inside holds their middle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.pixel import LONLAT, UTM_SOUTH, bound, lonlat_to_utm
from . import imagery, metrics, raster, terrain

FEATURE = "type string, properties map<string,string>, geometry struct<type:string,coordinates:string>"
RINGS = "array<array<array<double>>>"


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """poly_id, properties, rings of a document with a feature on each line, as sinks write it: lines are parsed where they are read, in any number of tasks."""
    line = spark.read.text(path).select(F.regexp_replace("value", r"^\s*,|,\s*$", "").alias("feature")).filter(F.col("feature").startswith("{") & F.col("feature").contains('"Feature"'))
    return parsed(line.withColumn("poly_id", F.monotonically_increasing_id()))


def parsed(features: DataFrame) -> DataFrame:
    """features: poly_id, feature (JSON text). poly_id, properties, rings; features without a polygon or multipolygon have none."""
    x = features.select("poly_id", F.from_json("feature", FEATURE).alias("f")).select("poly_id", "f.properties", "f.geometry")
    one = F.from_json("geometry.coordinates", RINGS)
    many = F.flatten(F.from_json("geometry.coordinates", f"array<{RINGS}>"))
    rings = F.when(F.col("geometry.type") == "Polygon", one).when(F.col("geometry.type") == "MultiPolygon", many)
    return x.select("poly_id", "properties", rings.alias("rings"))


def by_place(polygons: DataFrame, grid: DataFrame) -> DataFrame:
    """polygons (poly_id, rings) with the tiles whose grids their boxes meet: tile_id, poly_id, rings."""
    at = lambda i: F.flatten(F.transform("rings", lambda r: F.transform(r, lambda p: p[i])))
    boxes = polygons.filter(F.size("rings") > 0).select("poly_id", F.array_min(at(0)).alias("w"), F.array_min(at(1)).alias("s"), F.array_max(at(0)).alias("e"), F.array_max(at(1)).alias("n"))
    utm = terrain.lonlat_bounds(grid.filter(F.col("epsg") != LONLAT).withColumns({"zone": F.col("epsg") % 100, "south": F.col("epsg") > UTM_SOUTH}))
    flat = grid.filter(F.col("epsg") == LONLAT).select("tile_id", F.col("c").alias("w"), (F.col("f") + F.col("height") * F.col("e")).alias("s"), (F.col("c") + F.col("width") * F.col("a")).alias("e"), F.col("f").alias("n"))
    return imagery.clip(boxes, utm.unionByName(flat)).join(polygons.select("poly_id", "rings"), "poly_id").select("tile_id", "poly_id", "rings")


def _on_grid(lon: Column, lat: Column) -> Column:
    """Fractional column and row (x, y) of a point on a grid without rotation, whose place is in columns; for use in a lambda."""
    flat = F.col("epsg") == LONLAT
    xy = F.when(flat, F.array(lon, lat)).otherwise(lonlat_to_utm(lon, lat, F.col("epsg") % 100, let=bound))

    def at(p: Column) -> Column:
        north = p[1] + F.when(~flat & (F.col("epsg") > UTM_SOUTH), 10_000_000.0).otherwise(0.0)
        return F.struct(((p[0] - F.col("c")) / F.col("a")).alias("x"), ((north - F.col("f")) / F.col("e")).alias("y"))

    return bound([xy], at)


def runs_of(polygons: DataFrame, grid: DataFrame) -> DataFrame:
    """polygons: tile_id, poly_id, rings (longitude, latitude). tile_id, comp_id (the poly_id), row, c0, c1: the runs of cells inside, cut to the tile's grid.

    grid: tile_id, height, width, a, c, e, f, epsg."""
    place = grid.select("tile_id", "height", "width", "a", "c", "e", "f", "epsg")
    ring = polygons.filter(F.size("rings") > 0).select("tile_id", "poly_id", F.explode("rings").alias("ring")).join(place, "tile_id")  # a row for each tile
    on = ring.select("tile_id", "poly_id", "height", "width", F.transform("ring", lambda p: _on_grid(p[0], p[1])).alias("p"))
    # a ring that isn't closed ends where it began
    edge = on.select("tile_id", "poly_id", "height", "width", F.explode(F.arrays_zip(F.col("p").alias("p"), F.concat(F.slice("p", 2, F.size("p")), F.slice("p", 1, 1)).alias("q"))).alias("z"))
    x0, y0, x1, y1 = (F.col(f"z.{a}.{b}") for a in "pq" for b in "xy")
    edge = edge.select("tile_id", "poly_id", "height", "width", x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))
    first = F.greatest(F.ceil(F.least("y0", "y1") - 0.5), F.lit(0)).cast("int")
    last = F.least(F.ceil(F.greatest("y0", "y1") - 0.5) - 1, F.col("height") - 1).cast("int")
    edge = edge.withColumns({"r0": first, "r1": last}).filter("r0 <= r1").withColumn("row", F.explode(F.sequence("r0", "r1")))
    cross = edge.select("tile_id", "poly_id", "width", "row", (F.col("x0") + (F.col("row") + 0.5 - F.col("y0")) * (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0"))).alias("x"))
    line = W.partitionBy("tile_id", "poly_id", "row").orderBy("x")
    span = cross.withColumns({"k": F.row_number().over(line), "to": F.lead("x").over(line)}).filter("k % 2 = 1")
    c0, c1 = F.greatest(F.ceil(F.col("x") - 0.5), F.lit(0)).cast("int"), F.least(F.ceil(F.col("to") - 0.5) - 1, F.col("width") - 1).cast("int")
    return span.select("tile_id", F.col("poly_id").alias("comp_id"), "row", c0.alias("c0"), c1.alias("c1")).filter("c0 <= c1")


def score(pred: DataFrame, true: DataFrame, wanted: DataFrame) -> DataFrame:
    """metrics.evaluate for polygons that may overlap each other: areas are those of their unions. pred, true: tile_id, comp_id, row, c0, c1."""
    union = lambda x: raster.union(x).withColumn("comp_id", F.lit(0))
    area = metrics.evaluate(union(pred), union(true), wanted).select("tile_id", "union_iou")
    return metrics.evaluate(pred, true, wanted).drop("union_iou").join(area, "tile_id")
