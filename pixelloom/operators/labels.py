"""Decoding of deforestation alerts into (confidence, days), and their fusion by consensus. Confidences are doubles throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIXEL = ["tile_id", "row", "col"]

#: Fixed values of the alert products: origins as days since 1970, first day kept, confidences by code.
RADD_ORIGIN, GLADS2_ORIGIN, FIRST_DAY = 16435, 17897, 18262
RADD_LEADS = {2: 0.6, 3: 1.0}
GLADL_SCORES = {2: 0.5, 3: 0.9}
GLADS2_SCORES = {1: 0.25, 2: 0.5, 3: 0.75, 4: 1.0}


def _score(code: Column, table: dict[int, float]) -> Column:
    out = F.lit(0.0)
    for k, v in table.items():
        out = F.when(code == k, F.lit(v)).otherwise(out)
    return out


def radd(codes: DataFrame, first_day: int = FIRST_DAY) -> DataFrame:
    """A code is a leading digit (confidence) followed by days since the origin; powers of ten stop at 10**8, so longer codes have no valid lead."""
    p = F.pow(F.lit(10.0), F.least(F.lit(9), F.length(F.col("code").cast("string"))) - 1).cast("long")
    x = codes.withColumn("p", F.when(F.col("code") > 0, p).otherwise(1)).withColumn("lead", F.expr("code div p")).withColumn("d", F.col("code") % F.col("p") + RADD_ORIGIN)
    ok = (F.col("code") > 0) & F.col("lead").isin(*RADD_LEADS) & (F.col("d") >= first_day)
    return x.select(*PIXEL, F.lit("radd").alias("source"), F.when(ok, _score(F.col("lead"), RADD_LEADS)).otherwise(0.0).alias("confidence"), F.when(ok, F.col("d")).otherwise(0).cast("int").alias("days"))


def gladl(alerts: DataFrame, first_day: int = FIRST_DAY) -> DataFrame:
    """Per year file: day of year to days since 1970; an alert code without a score keeps its day."""
    day = F.unix_date(F.make_date(F.lit(2000) + F.col("yy"), F.lit(1), F.lit(1))) + F.col("doy") - 1
    x = alerts.withColumn("d", day)
    ok = (F.col("alert") > 0) & (F.col("doy") > 0) & (F.col("d") >= first_day)
    return x.select(*PIXEL, "yy", F.when(ok, _score(F.col("alert"), GLADL_SCORES)).otherwise(0.0).alias("confidence"), F.when(ok, F.col("d")).otherwise(0).cast("int").alias("days"))


def gladl_combine(decoded: DataFrame) -> DataFrame:
    """One row per pixel: the year of highest confidence, the earliest on ties."""
    best = F.max_by(F.struct("confidence", "days"), F.struct(F.col("confidence"), -F.col("yy")))
    x = decoded.groupBy(*PIXEL).agg(best.alias("b"))
    return x.select(*PIXEL, F.lit("gladl").alias("source"), "b.confidence", F.when(F.col("b.confidence") > 0, F.col("b.days")).otherwise(0).alias("days"))


def glads2(alerts: DataFrame, first_day: int = FIRST_DAY) -> DataFrame:
    d = F.col("day_offset") + GLADS2_ORIGIN
    ok = (F.col("alert") > 0) & (F.col("day_offset") > 0) & (d >= first_day)
    x = alerts.withColumn("c", F.when(ok, _score(F.col("alert"), GLADS2_SCORES)).otherwise(0.0))
    return x.select(*PIXEL, F.lit("glads2").alias("source"), F.col("c").alias("confidence"), F.when(F.col("c") > 0, d).otherwise(0).cast("int").alias("days"))


def weak_labels(*sources: DataFrame) -> DataFrame:
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s)
    return out


def fuse(weak: DataFrame, *, single: float = 0.9, consensus: float = 0.7, agree: int = 2, forest: DataFrame | None = None) -> DataFrame:
    """Positive where one source is sure enough alone, or where several flag the pixel and the best is fairly sure. One aggregate, no join."""
    flagged = F.col("confidence") > 0
    g = weak.groupBy(*PIXEL).agg(F.max("confidence").alias("max_confidence"), F.count_if(flagged).cast("int").alias("agree_count"), F.percentile(F.when(flagged, F.col("days")), F.lit(0.5)).alias("m"))
    yes = ((F.col("max_confidence") >= F.lit(consensus)) & (F.col("agree_count") >= agree)) | (F.col("max_confidence") >= F.lit(single))
    if forest is not None:
        g = g.join(forest.select(*PIXEL, "forest"), PIXEL, "left")
        yes = yes & F.coalesce(F.col("forest"), F.lit(False))
    g = g.withColumn("binary", F.when(yes, 1).otherwise(0))
    return g.select(
        *PIXEL, "binary", (F.col("max_confidence") * F.col("binary")).alias("confidence"), "max_confidence", "agree_count", F.when(F.col("binary") == 1, F.coalesce(F.col("m").cast("int"), F.lit(0))).otherwise(0).alias("median_days")
    )


def candidates(fused: DataFrame, forest: DataFrame, hard_negative_max: float = 0.2) -> DataFrame:
    """Positive and hard negative pixels inside the forest; what lies between is left out."""
    x = fused.join(forest.select(*PIXEL, "forest"), PIXEL).filter("forest")
    return x.withColumn("class", F.when(F.col("binary") > 0, 1).when(F.col("max_confidence") <= F.lit(hard_negative_max), 0)).filter("class is not null").drop("forest")
