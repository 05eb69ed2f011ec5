"""GeoJSON and JSON results."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pixel import bound, utm_to_lonlat
from ..plans.staging import cut


def lonlat_rings(polygons: DataFrame, tiles: DataFrame) -> DataFrame:
    """rings of pixel corners to rings of longitude and latitude; tiles: tile_id, zone, south, a, c, e, f."""
    x = polygons.join(tiles.select("tile_id", "zone", "south", "a", "c", "e", "f"), "tile_id")

    def corner(p: Column) -> Column:
        north = F.col("f") + p[1] * F.col("e")
        lonlat = utm_to_lonlat(F.col("c") + p[0] * F.col("a"), F.when(F.col("south"), north - 10000000.0).otherwise(north), F.col("zone"), let=bound)
        return F.transform(lonlat, lambda v: F.round(v, 7))

    x = x.withColumn("rings", F.transform("rings", lambda ring: F.transform(ring, corner)))
    return x.drop("zone", "south", "a", "c", "e", "f")


def features(polygons: DataFrame, *, time_step: bool = True) -> DataFrame:
    """One GeoJSON feature per row of (tile_id, comp_id, area_ha, time_step, rings); null geometry where rings is missing."""
    geometry = F.struct(F.lit("Polygon").alias("type"), F.col("rings").alias("coordinates")) if "rings" in polygons.columns else F.lit(None).cast("string")
    props = F.struct(*(["time_step"] if time_step else []), "tile_id", "area_ha")
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), props.alias("properties"), geometry.alias("geometry")), {"ignoreNullFields": "false"})
    return polygons.select("tile_id", "comp_id", feature.alias("feature"))


def tile_features(tiles: DataFrame) -> DataFrame:
    """One feature without geometry per tile_id: the metadata file that layout.tiles_from_geojson reads."""
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.col("tile_id").alias("name")).alias("properties"), F.lit(None).cast("string").alias("geometry")), {"ignoreNullFields": "false"})
    return tiles.select("tile_id", F.lit(0).alias("comp_id"), feature.alias("feature"))


def write_geojson(feats: DataFrame, path: str, *, one_file: bool = True) -> None:
    """A FeatureCollection as lines of text, in order of tile and component; the text files of the folder, read one after the other by name, are the document.

    filesink.write_document writes the same document from many tasks. one_file: a single task sorts the lines and writes one file, a line at a time, so the document is never built in memory; without it lines are ranged over
    tasks by their key, and every task writes its own."""
    spark, feats = feats.sparkSession, cut(feats)
    first = feats.agg(F.min(F.struct("tile_id", "comp_id")).alias("k")).first().k
    line = lambda part, text: spark.createDataFrame([(part, text)], "part int, line string").coalesce(1).select("part", F.lit("").alias("tile_id"), F.lit(0).cast("long").alias("comp_id"), "line")
    lead = (F.col("tile_id") == first["tile_id"]) & (F.col("comp_id") == first["comp_id"]) if first else F.lit(False)
    body = feats.select(F.lit(1).alias("part"), "tile_id", F.col("comp_id").cast("long").alias("comp_id"), F.concat(F.when(lead, "").otherwise(","), "feature").alias("line"))
    head, tail = line(0, '{"type": "FeatureCollection", "features": ['), line(2, "]}")
    if one_file:
        every = head.unionByName(body).unionByName(tail).coalesce(1).sortWithinPartitions("part", "tile_id", "comp_id")
    else:
        every = head.unionByName(body.repartitionByRange("tile_id", "comp_id").sortWithinPartitions("tile_id", "comp_id")).unionByName(tail)
    every.select("line").write.mode("overwrite").text(path)


def read_geojson(spark, path: str) -> DataFrame:
    """Features of a collection: properties as a map, geometry as JSON text."""
    doc = spark.read.schema("features array<struct<properties:map<string,string>,geometry:string>>").option("multiLine", True).json(path)
    return doc.select(F.explode("features").alias("f")).select("f.properties", "f.geometry")


def write_report(rows: DataFrame, path: str) -> None:
    rows.coalesce(1).write.mode("overwrite").json(path)


def write_record(spark: SparkSession, record: dict, path: str) -> None:
    """One JSON document, from settings or a report of bounded size."""
    spark.createDataFrame([(json.dumps(record),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_record(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r.value for r in spark.read.text(path).collect()))


def write_tuned(grid: DataFrame, path: str) -> dict:
    """The best setting of a grid search, as the settings that jobs merge, and beside it the report of all settings (a row each). Gives the settings."""
    rows = [r.asDict() for r in grid.orderBy("rank").collect()]
    best = rows[0]
    tuned = {"polygons": {"least": best["threshold"], "open_n": best["open_n"], "close_n": best["close_n"], "min_ha": best["min_ha"]}}
    write_record(grid.sparkSession, tuned, path)
    write_record(grid.sparkSession, {"best": best, "all": rows}, path.rstrip("/") + ".report")
    return tuned


def by_region(rows: DataFrame) -> DataFrame:
    """One record per region: its tiles' records, or the error that its fold ended with (a row without a tile)."""
    one = F.struct(*[c for c in rows.columns if c != "region"])
    tiles = F.sort_array(F.collect_list(F.when(F.col("tile_id").isNotNull(), one)))
    return rows.groupBy("region").agg(tiles.alias("tiles"), F.max(F.when(F.col("tile_id").isNull(), F.col("error"))).alias("error"))
