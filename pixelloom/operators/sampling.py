"""Splits, quotas, stratified samples and weights of training pixels.

Samples are ranked by a hash of seed and position, so reruns and other engines pick the same rows. Ranks over a whole tile are needed only by
the quotas themselves; a tile is a bounded raster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.pixel import region

PIXEL = ["tile_id", "row", "col"]


def split(tiles: DataFrame, patterns: list[str], prefix: int = 5) -> DataFrame:
    """Adds is_val: a pattern matches the whole region or is found in the tile id."""
    r = region(F.col("tile_id"), prefix)
    val = F.lit(False)
    for p in patterns:
        val = val | r.rlike(f"^(?:{p})$") | F.col("tile_id").rlike(p)
    return tiles.withColumn("is_val", val)


def order_hash(seed: int, row="row", col="col") -> Column:
    """A fixed shuffle of a tile's pixels in 32-bit arithmetic."""
    x = (F.col(row).cast("long") * 65536 + F.col(col).cast("long") + seed) * F.lit(2654435761) % F.lit(4294967296)
    return (x.bitwiseXOR(F.shiftright(x, 15)) * F.lit(1103515245)) % F.lit(4294967296)


def quotas(counts: DataFrame, total: int) -> DataFrame:
    """counts: region, n. Adds alloc: the total shared by the square roots of n, rounded half to even."""
    every = W.partitionBy(F.lit(1))  # a row per region
    s = F.sum(F.sqrt("n")).over(every)
    return counts.withColumn("alloc", F.when(s > 0, F.bround(F.sqrt("n") * float(total) / s)).otherwise(0.0).cast("long"))


def tile_caps(per_tile: DataFrame, total: int, *, whole: bool = False) -> DataFrame:
    """per_tile: tile_id, region, n. The region's quota shared by the tiles' counts, rounded half to even.

    Rounding gives no row at all where a region has more than twice as many tiles as its quota has rows. whole: shares are cut to whole rows instead, and what is left of the region's quota
    goes to the largest fractions, a row each, so that it is given out whatever the number of tiles."""
    r = quotas(per_tile.groupBy("region").agg(F.sum("n").alias("n")), total).select("region", F.col("n").alias("n_region"), "alloc")
    x = per_tile.join(r, "region")
    if whole:
        share, part = F.expr("alloc * n div n_region"), F.expr("alloc * n % n_region")
        rank = F.row_number().over(W.partitionBy("region").orderBy(F.desc("part"), F.xxhash64("tile_id"), "tile_id"))  # a row for each tile
        x = x.filter("n_region > 0").withColumns({"share": share, "part": part})
        left = F.col("alloc") - F.sum("share").over(W.partitionBy("region"))
        return x.select("tile_id", "region", "n", "alloc", (F.col("share") + F.when(rank <= left, 1).otherwise(0)).alias("cap"))
    return x.select("tile_id", "region", "n", "alloc", F.when(F.col("n_region") > 0, F.bround(F.col("alloc") * F.col("n") / F.col("n_region"))).otherwise(0.0).cast("long").alias("cap"))


def stratified(pos: DataFrame, caps: DataFrame, *, strata: int = 4, seed: int = 0, conf: str = "max_confidence", whole: bool = False) -> DataFrame:
    """Up to cap positives per tile: cap // strata from each stratum of confidence, and as many more from the rest as strata fell short of.

    Strata are cut at the tile's interior quantiles; a value belongs to the stratum after all edges that are not above it. A tile with no more rows
    than its cap is kept whole. cap % strata stays unfilled unless a stratum is short; whole: it is filled from the rest as well, so that a cap below the number of strata counts."""
    q = [F.lit(i / strata) for i in range(1, strata)]
    edges = pos.groupBy("tile_id").agg(F.percentile(conf, F.array(*q)).alias("edges"), F.count("*").alias("n_tile"))
    x = pos.join(edges, "tile_id").join(caps.select("tile_id", "cap"), "tile_id").withColumn("h", order_hash(seed))
    x = x.withColumn("bucket", F.size(F.filter("edges", lambda e: e <= F.col(conf)))).withColumn("per", F.expr(f"cap div {strata}"))
    rank = F.row_number().over(W.partitionBy("tile_id", "bucket").orderBy("h", "row", "col"))
    x = x.withColumn("first", rank <= F.col("per")).withColumn("taken", F.count_if("first").over(W.partitionBy("tile_id")))
    short = (F.col("cap") if whole else F.col("per") * strata) - F.col("taken")
    again = F.row_number().over(W.partitionBy("tile_id", "first").orderBy("h", "row", "col"))
    keep = (F.col("cap") > 0) & ((F.col("n_tile") <= F.col("cap")) | F.col("first") | (again <= short))
    return x.withColumn("keep", keep).filter("keep").drop("edges", "n_tile", "cap", "h", "bucket", "per", "first", "taken", "keep")


def plain(rows: DataFrame, caps: DataFrame, *, seed: int = 0) -> DataFrame:
    """min(cap, n) rows per tile in the order of the hash."""
    x = rows.join(caps.select("tile_id", "cap"), "tile_id").withColumn("rank", F.row_number().over(W.partitionBy("tile_id").orderBy(order_hash(seed), "row", "col")))
    return x.filter("rank <= cap").drop("cap", "rank")


def weights(sample: DataFrame, *, prefix: int = 5, soft: bool = True) -> DataFrame:
    """sample: pixel, class, max_confidence, agree_count. Adds target and weight.

    Positives weigh confidence * (1 + agree / 4), negatives 1; a tile's weights are scaled to mean 1, then regions to equal sums."""
    w = F.when(F.col("class") == 1, F.col("max_confidence") * (F.lit(1.0) + F.lit(0.25) * F.col("agree_count"))).otherwise(1.0)
    x = sample.withColumn("w", w).withColumn("region", region(F.col("tile_id"), prefix))
    mean = F.avg("w").over(W.partitionBy("tile_id"))
    x = x.withColumn("w", F.when(mean > 1e-6, F.col("w") / mean).otherwise(F.col("w")))
    counts = sample.groupBy(region(F.col("tile_id"), prefix).alias("region")).agg(F.count("*").alias("n"))
    every = W.partitionBy(F.lit(1))  # a row per region
    counts = counts.withColumn("balance", F.sum("n").over(every) / (F.count("*").over(every) * F.col("n"))).drop("n")
    x = x.join(counts, "region")
    target = F.when(F.col("class") == 1, F.col("max_confidence") if soft else F.lit(1.0)).otherwise(0.0)
    return x.select(*PIXEL, "region", "class", target.alias("target"), (F.col("w") * F.col("balance")).alias("weight"))


def positive_weight(sample: DataFrame) -> DataFrame:
    """(1 - p) / p of the sampled classes; NULL unless 0 < p < 1."""
    p = F.avg(F.col("class").cast("double"))
    return sample.agg(p.alias("p")).select("p", F.when((F.col("p") > 0) & (F.col("p") < 1), (1 - F.col("p")) / F.col("p")).alias("scale_pos_weight"))


def validation(cands: DataFrame, *, most_pos: int = 20_000, most_neg: int = 40_000, seed: int = 0) -> DataFrame:
    """Per tile up to most_pos positives and most_neg negatives, hard targets, weight 1."""
    rank = F.row_number().over(W.partitionBy("tile_id", "class").orderBy(order_hash(seed), "row", "col"))
    x = cands.withColumn("rank", rank).filter(F.col("rank") <= F.when(F.col("class") == 1, most_pos).otherwise(most_neg))
    return x.select(*PIXEL, "class", F.col("class").cast("double").alias("target"), F.lit(1.0).alias("weight"))
