"""Where a dataset's files lie, and what file names tell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: File name patterns and path templates of the dataset.
S1_NAME = r"(?i).*__s1_rtc_(\d{4})_(\d{1,2})_(ascending|descending)\.tif$"
S2_NAME = r"(?i).*__s2_l2a_(\d{4})_(\d{1,2})\.tif$"
PATHS = {
    "s1": "sentinel-1/{split}/{tile}__s1_rtc/{tile}__s1_rtc_{year}_{month}_{orbit}.tif",
    "s2": "sentinel-2/{split}/{tile}__s2_l2a/{tile}__s2_l2a_{year}_{month}.tif",
    "aef": "aef-embeddings/{split}/{tile}_{year}.tiff",
    "radd": "labels/train/radd/radd_{tile}_labels.tif",
    "gladl_alert": "labels/train/gladl/gladl_{tile}_alert{yy:02d}.tif",
    "gladl_date": "labels/train/gladl/gladl_{tile}_alertDate{yy:02d}.tif",
    "glads2_alert": "labels/train/glads2/glads2_{tile}_alert.tif",
    "glads2_date": "labels/train/glads2/glads2_{tile}_alertDate.tif",
}


#: Names of the rasters of embeddings and of labels.
AEF_NAME = r"/([^/]+)_(\d{4})\.tiff?$"
RADD_NAME = r"/radd_([^/]+)_labels\.tif$"
GLADL_NAME = r"/gladl_([^/]+)_(alertDate|alert)(\d{2})\.tif$"
GLADS2_NAME = r"/glads2_([^/]+)_(alertDate|alert)\.tif$"


def path(root: str, kind: str, **parts) -> str:
    return f"{root.rstrip('/')}/{PATHS[kind].format(**({'split': 'train'} | parts))}"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def s2_months(names: DataFrame, col: str = "name") -> DataFrame:
    """tile_id kept, year and month of the names that fit, once each, in order."""
    return _months(names, col, S2_NAME, []).distinct().orderBy("tile_id", "year", "month")


def s1_months(names: DataFrame, col: str = "name") -> DataFrame:
    return _months(names, col, S1_NAME, [F.lower(F.regexp_extract(col, S1_NAME, 3)).alias("orbit")]).distinct().orderBy("tile_id", "year", "month", "orbit")


def _months(names: DataFrame, col: str, pattern: str, more: list[Column]) -> DataFrame:
    n = lambda i: F.regexp_extract(col, pattern, i).cast("int")
    return names.filter(F.col(col).rlike(pattern)).select("tile_id", n(1).alias("year"), n(2).alias("month"), *more)


def tiles_from_geojson(spark: SparkSession, path: str) -> DataFrame:
    """tile_id of each feature: the first non-empty of name, tile_id, id. A missing file has no tiles."""
    if not exists(spark, path):
        return spark.createDataFrame([], "tile_id string")
    doc = spark.read.schema("features array<struct<properties:map<string,string>>>").option("multiLine", True).json(path)
    props = doc.select(F.explode("features").alias("f")).select(F.col("f.properties").alias("p"))
    pick = F.coalesce(*[F.nullif(F.element_at("p", k), F.lit("")) for k in ("name", "tile_id", "id")])
    return props.select(pick.alias("tile_id")).filter("tile_id is not null")


def tiles_from_folder(spark: SparkSession, root: str, split: str = "train") -> DataFrame:
    """Tiles of the folders that hold optical scenes: listed by Spark's reader, without reading a byte of content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{root.rstrip('/')}/sentinel-2/{split}").select("path")
    tile = F.regexp_extract("path", r"/([^/]+)__s2_l2a/[^/]+$", 1)
    return files.select(tile.alias("tile_id")).filter("tile_id <> ''").distinct().orderBy("tile_id")


def resolve_tiles(spark: SparkSession, wanted: list[str] | None, geojson: str | None, root: str | None, split: str = "train") -> list[str]:
    """Tiles asked for, else those of the metadata file, else those found in the folders."""
    if wanted:
        return list(wanted)
    if geojson:
        got = [r.tile_id for r in tiles_from_geojson(spark, geojson).collect()]
        if got:
            return got
    return [r.tile_id for r in tiles_from_folder(spark, root, split).collect()] if root else []


def reference_scene(scenes: DataFrame) -> DataFrame:
    """The scene that gives a tile its grid: the first month it has."""
    return scenes.groupBy("tile_id").agg(F.min(F.struct("year", "month")).alias("s")).select("tile_id", "s.year", "s.month")
