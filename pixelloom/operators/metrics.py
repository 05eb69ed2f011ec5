"""Overlap of predicted and true polygons on a shared pixel grid, and the search for post-processing settings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.staging import cut
from . import raster

PIXEL = ["tile_id", "row", "col"]


def union_iou(pred: DataFrame, true: DataFrame) -> DataFrame:
    """pred, true: cells. area(both) / area(either); 1 if both are empty."""
    a, b = pred.select(*PIXEL).distinct().withColumn("p", F.lit(1)), true.select(*PIXEL).distinct().withColumn("t", F.lit(1))
    g = a.join(b, PIXEL, "full_outer").agg(F.count_if(F.col("p").isNotNull() & F.col("t").isNotNull()).alias("inter"), F.count("*").alias("either"))
    return g.select("inter", "either", F.when(F.col("either") == 0, 1.0).otherwise(F.col("inter") / F.greatest("either", F.lit(1))).alias("iou"))


def touched(polygons: DataFrame, others: DataFrame) -> DataFrame:
    """Polygons (tile_id, comp_id) that meet or touch a cell of the others: a cell lies within one step in both directions."""
    near = others.select("tile_id", F.explode(F.sequence(F.col("row") - 1, F.col("row") + 1)).alias("row"), "col").distinct()
    near = near.select("tile_id", "row", F.explode(F.sequence(F.col("col") - 1, F.col("col") + 1)).alias("col")).distinct()
    return polygons.join(near, PIXEL, "left_semi").select("tile_id", "comp_id").distinct()


def _share(hit: DataFrame, every: DataFrame, name: str) -> DataFrame:
    n = every.select("tile_id", "comp_id").distinct().agg(F.count("*").alias("n"))
    return hit.agg(F.count("*").alias("hits")).crossJoin(n).select("hits", "n", (F.col("hits") / F.greatest(F.col("n"), F.lit(1))).alias(name))  # one row each


def recall(true: DataFrame, pred: DataFrame) -> DataFrame:
    """Share of true polygons that meet a prediction; 1 without true polygons, 0 without predictions."""
    return _share(touched(true, pred), true, "recall").withColumn("recall", F.when(F.col("n") == 0, 1.0).otherwise(F.col("recall")))


def false_positive_rate(pred: DataFrame, true: DataFrame) -> DataFrame:
    """Share of predicted polygons that meet no true one; 1 without true polygons, 0 without predictions."""
    x = _share(touched(pred, true), pred, "x")
    return x.select((F.col("n") - F.col("hits")).alias("misses"), "n", F.when(F.col("n") == 0, 0.0).otherwise(1 - F.col("x")).alias("fpr"))


def evaluate(pred: DataFrame, true: DataFrame, wanted: DataFrame) -> DataFrame:
    """A row for each of `wanted` (tile_id and any further keys): n_pred, n_gt, union_iou, polygon_recall, polygon_fpr_proxy.

    pred: those keys, comp_id, row, c0, c1 (polygons as runs of cells); true: the same by tile_id alone. Polygons meet where they share a cell or a corner. Everything
    comes from one join of runs by tile and row: true runs go to three rows, and overlaps count where the row is their own."""
    keys = wanted.columns
    size = F.col("c1") - F.col("c0") + 1
    p = pred.groupBy(*keys).agg(F.countDistinct("comp_id").alias("n_pred"), F.sum(size).alias("px_pred"))
    t = true.groupBy("tile_id").agg(F.countDistinct("comp_id").alias("n_gt"), F.sum(size).alias("px_gt"))
    near = true.select("tile_id", F.explode(F.sequence(F.lit(-1), F.lit(1))).alias("off"), "row", F.col("comp_id").alias("t_id"), F.col("c0").alias("t0"), F.col("c1").alias("t1"))
    near = near.withColumn("row", F.col("row") + F.col("off"))
    both = pred.join(near, ["tile_id", "row"]).filter("c0 <= t1 + 1 and t0 <= c1 + 1")
    met = both.groupBy(*keys).agg(
        F.countDistinct("comp_id").alias("hit_pred"), F.countDistinct("t_id").alias("hit_gt"),
        F.sum(F.when(F.col("off") == 0, F.greatest(F.least("c1", "t1") - F.greatest("c0", "t0") + 1, F.lit(0))).otherwise(0)).alias("inter"),
    )
    x = wanted.join(p, keys, "left").join(t, "tile_id", "left").join(met, keys, "left").na.fill(0, ["n_pred", "px_pred", "n_gt", "px_gt", "hit_pred", "hit_gt", "inter"])
    no_pred, no_gt = F.col("n_pred") == 0, F.col("n_gt") == 0
    either = F.greatest(F.col("px_pred") + F.col("px_gt") - F.col("inter"), F.lit(1))
    return x.select(
        *keys, "n_pred", "n_gt", F.when(no_pred & no_gt, 1.0).otherwise(F.col("inter") / either).alias("union_iou"),
        F.when(no_gt, 1.0).otherwise(F.col("hit_gt") / F.greatest("n_gt", F.lit(1))).alias("polygon_recall"),
        F.when(no_pred, 0.0).otherwise(1 - F.col("hit_pred") / F.greatest("n_pred", F.lit(1))).alias("polygon_fpr_proxy"),
    )


def true_polygons(binary: DataFrame, min_ha: float = 0.5, pixel_m2: float | str = 100.0) -> DataFrame:
    """Runs of the components of labelled cells (tile_id, row, col) that have at least min_ha. pixel_m2: a cell's area, or the column that holds each tile's."""
    comps = raster.components(raster.runs(binary.select(*PIXEL, *raster.named(pixel_m2))))
    return comps.join(raster.areas(comps, pixel_m2=pixel_m2, min_ha=min_ha).select("tile_id", "comp_id"), ["tile_id", "comp_id"], "left_semi")


def grid_search(prob: DataFrame, true: DataFrame, tiles: DataFrame, *, thresholds, opens, closes, areas, height, width, pixel_m2: float | str = 100.0) -> DataFrame:
    """rank, combo, threshold, open_n, close_n, min_ha, mean_iou, mean_recall, mean_fpr_proxy of every setting, best first; ties go to the first in product order.

    true: runs of true polygons; tiles: those to average over, each counts the same. One plan for all settings: a tile's cells above
    a threshold are one group, in which openings are shared by the closings that follow them, and area limits are applied to one set of components."""
    options = lambda name, values, kind: F.explode(F.array(*[F.lit(v).cast(kind) for v in values])).alias(name)
    base = prob.filter(F.col("prob") >= F.lit(float(min(thresholds)))).select(*PIXEL, "prob", *raster.named(height, width, pixel_m2), options("threshold", thresholds, "double")).filter("prob >= threshold").drop("prob")
    comps = raster.shapes(base, list(opens), list(closes), height, width)
    settings = ["threshold", "open_n", "close_n"]
    comps = cut(comps)  # read by each count below
    kept = comps.select("*", options("min_ha", areas, "double")).filter(F.col("n_px") * raster.as_column(pixel_m2) / 10000 >= F.col("min_ha")).drop("n_px", "head")
    every = [(i, float(t), o, c, float(a)) for i, (t, o, c, a) in enumerate((t, o, c, a) for t in thresholds for o in opens for c in closes for a in areas)]
    combos = prob.sparkSession.createDataFrame(every, "combo int, threshold double, open_n int, close_n int, min_ha double")
    wanted = tiles.select("tile_id").distinct().crossJoin(combos.drop("combo"))  # a row for each tile and setting
    each = evaluate(kept, true, wanted).groupBy(*settings, "min_ha").agg(F.avg("union_iou").alias("mean_iou"), F.avg("polygon_recall").alias("mean_recall"), F.avg("polygon_fpr_proxy").alias("mean_fpr_proxy"))
    x = combos.join(each, [*settings, "min_ha"])
    names = ["combo", *settings, "min_ha", "mean_iou", "mean_recall", "mean_fpr_proxy"]
    return x.withColumn("rank", F.row_number().over(W.orderBy(F.desc("mean_iou"), "combo"))).select("rank", *names)  # a row for each setting
