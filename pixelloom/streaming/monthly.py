"""Incremental upkeep of the yearly statistics from a stream of monthly observations.

A year's statistics are exact percentiles over at most twelve months, so they are made anew for the pixel-years that a batch touches, from
all observations landed of them so far; the result replaces those tile-years' partitions. Late months are no special case, so no watermark is needed.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import satellite

PIXEL = ["tile_id", "row", "col"]


def keep_annual(spark: SparkSession, source: DataFrame, landing: str, target: str, checkpoint: str) -> StreamingQuery:
    """source: a stream of s2_obs rows. Lands every batch once (a batch that is run again overwrites itself), then rewrites the tile-years it touches.

    Observations land by year, tile and batch, so a batch lists and reads only the folders of the tile-years that it touches."""
    schema = source.schema
    names = source.columns

    def each(batch: DataFrame, number: int) -> None:
        batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            touched = [(r["year"], r["tile_id"]) for r in batch.select("year", "tile_id").distinct().collect()]  # a row for each tile-year of the batch
            if not touched:
                return
            landed = batch.withColumns({"in_year": F.col("year"), "in_tile": F.col("tile_id"), "batch": F.lit(number)})
            landed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("in_year", "in_tile", "batch").parquet(landing)
        finally:
            batch.unpersist()
        whole = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(*[f"{landing}/in_year={y}/in_tile={t}" for y, t in touched])
        annual = satellite.s2_annual(whole.select(*names)).withColumns({"in_year": F.col("year"), "in_tile": F.col("tile_id")})
        annual.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("in_year", "in_tile").parquet(target)

    return source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts(source: DataFrame) -> DataFrame:
    """Observations per tile, year and month of a stream: a running aggregate for dashboards."""
    return source.groupBy("tile_id", "year", "month").agg(F.count("*").alias("n"), F.avg("b08").alias("mean_b08"))
