"""The jobs over pixel relations: train, predict, tune, cross-validate; over relations, or over a dataset's folder (the run_ functions).

Each step is one plan over all tiles. What a job uses more than once (features, fused labels, forest, predictions) is written once, to the shared folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pixel import LONLAT, region, yymm
from ..operators import labels, metrics, model, raster, sampling, satellite, terrain
from ..sources import dataset, filesink, layout, sinks
from ..sources.dataset import Relations
from . import config
from .config import DEFAULTS, Settings, merged
from .staging import cut

PIXEL = ["tile_id", "row", "col"]


def settings(over: dict | None = None) -> Settings:
    return Settings(merged(DEFAULTS, over or {}))


def _with_years(x: DataFrame | None, rel: Relations, base_year: int | None, last_year: int | None) -> DataFrame | None:
    """x with columns base_year and last_year: the given ones, else each tile's own. A given base year that a tile hasn't gives way to its first."""
    if x is None:
        return None
    if rel.years is None:
        return x.withColumns({"base_year": F.lit(base_year), "last_year": F.lit(last_year)})
    years = rel.years.select("tile_id", "base_year", "last_year")
    if base_year is not None and rel.months is not None:
        has = rel.months.filter(F.col("year") == base_year).select("tile_id", F.lit(True).alias("has")).distinct()
        years = years.join(has, "tile_id", "left").withColumn("base_year", F.when(F.col("has"), F.lit(base_year)).otherwise(F.col("base_year"))).drop("has")
    if last_year is not None:
        years = years.withColumn("last_year", F.lit(last_year))
    return x.join(years, "tile_id")  # a row for each tile, by Spark's size check


def features(rel: Relations, base_year: int | None = None, last_year: int | None = None, dims: int = 64) -> DataFrame:
    """The wide feature row of every cell. Yearly statistics serve base, last and worst drop, so they are written once."""
    annual = cut(_with_years(satellite.s2_annual(rel.s2, rel.months), rel, base_year, last_year)) if rel.s2 is not None else None
    s1 = _with_years(satellite.s1_annual(rel.s1), rel, base_year, last_year) if rel.s1 is not None else None
    return satellite.pack(
        rel.cells, dims,
        change=satellite.aef_change(rel.aef) if rel.aef is not None else None, drift=satellite.aef_drift(rel.aef) if rel.aef is not None else None,
        s1=s1, s2=annual, drop=satellite.worst_drop(annual, F.col("base_year")) if annual is not None else None,
        terrain=rel.terrain, base_year=F.col("base_year"), last_year=F.col("last_year"),
    )


def forest_mask(rel: Relations, base_year: int | None = None, least: float = 0.55) -> DataFrame:
    """Forest of the base year: by the embedding's first component and NDVI where a tile has embeddings of that year, else by NDVI, else all forest."""
    base = lambda x: _with_years(x, rel, base_year, None).filter("year = base_year")
    ndvi = base(satellite.s2_annual(rel.s2, rel.months)).select(*PIXEL, F.col("median_ndvi").alias("ndvi")) if rel.s2 is not None else None
    grid = rel.cells.select(*PIXEL)
    x = grid.join(ndvi, PIXEL, "left") if ndvi is not None else grid.withColumn("ndvi", F.lit(None).cast("double"))
    seen = x.groupBy("tile_id").agg((F.count("ndvi") > 0).alias("has_ndvi"))
    x = x.join(seen, "tile_id")
    plain = F.when(F.col("has_ndvi"), F.coalesce("ndvi", F.lit(0.0)) >= least).otherwise(True)
    if rel.aef is None:
        return x.select(*PIXEL, plain.alias("forest"))
    score = satellite.principal_scores(base(rel.aef)).join(x.select(*PIXEL, "ndvi"), PIXEL)
    split = satellite.forest_by_split(score, least).select(*PIXEL, F.col("forest").alias("by_split"))
    return x.join(split, PIXEL, "left").select(*PIXEL, F.coalesce("by_split", plain).alias("forest"))


@dataclass
class Inputs:
    """What training, tuning and validation share, each written once."""

    feats: DataFrame
    forest: DataFrame
    fused: DataFrame


def inputs(rel: Relations, conf: Settings, base_year: int | None = None, last_year: int | None = None, dims: int = 64) -> Inputs:
    fused = labels.fuse(rel.weak, **conf.fusion) if rel.weak is not None else None
    return Inputs(cut(features(rel, base_year, last_year, dims)), cut(forest_mask(rel, base_year, conf.forest.least)), cut(fused) if fused is not None else None)


def training_set(feats: DataFrame, fused: DataFrame, forest: DataFrame, conf: Settings) -> DataFrame:
    """Sampled pixels with target, weight and features: quotas by region, strata of confidence, balanced weights. The sample is a filter on the features' keys."""
    s = conf.sampling
    cands = cut(labels.candidates(fused, forest, s.hard_negative_max))
    per = lambda c: cands.filter(F.col("class") == c).groupBy("tile_id", region(F.col("tile_id")).alias("region")).agg(F.count("*").alias("n"))
    cols = [*PIXEL, "class", "max_confidence", "agree_count"]
    pos = sampling.stratified(cands.filter("class = 1"), sampling.tile_caps(per(1), s.total_positives), strata=s.strata, seed=s.seed).select(*cols)
    neg = sampling.plain(cands.filter("class = 0"), sampling.tile_caps(per(0), s.total_negatives), seed=s.seed + 1).select(*cols)
    return sampling.weights(cut(pos.unionByName(neg)), soft=conf.objective == "cross_entropy").join(feats, PIXEL)


def validation_set(feats: DataFrame, fused: DataFrame, forest: DataFrame, conf: Settings) -> DataFrame:
    return sampling.validation(labels.candidates(fused, forest, conf.sampling.hard_negative_max)).join(feats, PIXEL)


def names_of(rows: DataFrame) -> list[str]:
    return [c for c in rows.columns if c not in (*PIXEL, "region", "class", "target", "weight")]


def train(rows: DataFrame, conf: Settings, validation: DataFrame | None = None) -> PipelineModel:
    """With validation rows fitting stops early; with the binary objective positives weigh as much as negatives."""
    ratio = sampling.positive_weight(rows).first().scale_pos_weight if conf.objective == "binary" and conf.balance else None
    return model.fit(rows, names_of(rows), **conf.model, validation=validation, positive_weight=ratio)


def meta(rows: DataFrame, fitted: PipelineModel, conf: Settings, val_tiles: list[str] = ()) -> dict:
    """The record of a training run."""
    n = rows.agg(F.sort_array(F.collect_set("tile_id")).alias("tiles"), F.count_if(F.col("class") == 1).alias("n_pos"), F.count_if(F.col("class") == 0).alias("n_neg")).first()
    return {"feature_names": names_of(rows), "val_regions": list(conf.val_regions), "train_tiles": n.tiles, "val_tiles": list(val_tiles), "best_iteration": model.trees_of(fitted), "objective": conf.objective, "n_pos": n.n_pos, "n_neg": n.n_neg}


def predict(fitted: PipelineModel, feats: DataFrame, forest: DataFrame) -> DataFrame:
    """tile_id, row, col, prob; 0 outside the forest. Tiles without features are an error upstream, not an empty result."""
    return model.predict(fitted, feats.join(forest, PIXEL), forest="forest").select(*PIXEL, "prob")


#: Names of the columns that hold each tile's own size, where placed() has added them.
SIDES = {"height": "height", "width": "width"}
SIZES = {**SIDES, "pixel_m2": "pixel_m2"}


def placed(x: DataFrame, grid: DataFrame) -> DataFrame:
    """x with each tile's height, width and cell area in square metres."""
    dx, dy = terrain.metric_cell(F.col("a"), F.col("e"), F.coalesce("epsg", F.lit(0)) == LONLAT, F.col("f") + F.col("height") * F.col("e") / 2)
    return x.join(grid.select("tile_id", "height", "width", (dx * dy).alias("pixel_m2")), "tile_id")  # a row for each tile


def submit(prob: DataFrame, conf: Settings, height: int | str, width: int | str, fused: DataFrame | None = None, pixel_m2: float | str = 100.0) -> DataFrame:
    """Polygons of all tiles; dated where fused labels are given. Sizes: numbers, or the names of prob's columns that hold each tile's."""
    dates = fused.select(*PIXEL, yymm(F.col("median_days")).alias("yymm")) if fused is not None else None
    return raster.polygonize(prob, **conf.polygons, height=height, width=width, pixel_m2=pixel_m2, dates=dates)


def tune(prob: DataFrame, fused: DataFrame, conf: Settings, height: int | str, width: int | str, pixel_m2: float | str = 100.0) -> DataFrame:
    """All settings of the grid by mean overlap with the fused labels' polygons over the tiles that have labels, best first. Sizes: numbers, or names of columns that both hold."""
    truth = metrics.true_polygons(fused.filter(F.col("binary") == 1), conf.polygons.min_ha, pixel_m2)
    return metrics.grid_search(prob, truth, fused.select("tile_id").distinct(), **conf.grid, height=height, width=width, pixel_m2=pixel_m2)


#: Folds of a cross-validation that run at the same time.
FOLDS = 4


def together(spark: SparkSession, works: dict[str, Callable[[], list]], at_once: int = FOLDS) -> dict[str, list | Exception]:
    """The results of named pieces of work that run at the same time in driver threads, each with a scheduler pool and a tag of its own: what fails has its other jobs
    cancelled by its tag, and its exception as the result."""
    run = uuid.uuid4().hex[:8]

    def one(k: int, work: Callable[[], list]) -> list | Exception:
        tag = f"work-{run}-{k}"
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", tag)
        spark.addTag(tag)
        try:
            return work()
        except Exception as e:
            spark.interruptTag(tag)
            return e
        finally:
            spark.removeTag(tag)
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)

    with ThreadPoolExecutor(max(1, at_once)) as pool:
        begun = {name: pool.submit(inheritable_thread_target(spark)(one), k, work) for k, (name, work) in enumerate(works.items())}
        return {name: x.result() for name, x in begun.items()}


def cross_validate(
    rows: DataFrame, feats: DataFrame, forest: DataFrame, fused: DataFrame, conf: Settings, height: int | str, width: int | str, least_tiles: int = 1, pixel_m2: float | str = 100.0, grid: DataFrame | None = None, at_once: int = FOLDS,
) -> DataFrame:
    """Leave one region out: region, tile_id, union_iou, polygon_recall, polygon_fpr_proxy, n_pred, n_gt, error.

    For each region with enough tiles a model is fitted on the samples of all others, and each of the region's tiles is predicted, polygonized and held against its
    labels' polygons. Folds run at the same time. A fold that fails has one row with its error and no tile, a tile without features or labels a row with its error; the others go on.
    Regions are few; reports have a row for each tile. Sizes: numbers, or with grid the names that placed() gives."""
    spark = rows.sparkSession
    tiles = forest.select("tile_id").distinct().join(feats.select("tile_id", F.lit(True).alias("has_features")).distinct(), "tile_id", "left").join(fused.select("tile_id", F.lit(True).alias("has_labels")).distinct(), "tile_id", "left")
    every = tiles.withColumn("region", region(F.col("tile_id"))).orderBy("region", "tile_id").collect()
    regions: dict[str, list] = {}
    for t in every:
        regions.setdefault(t.region, []).append(t)
    at = (lambda x: placed(x, grid)) if grid is not None else lambda x: x
    truth = cut(metrics.true_polygons(at(fused.filter(F.col("binary") == 1)), conf.polygons.min_ha, pixel_m2))
    cols = ["union_iou", "polygon_recall", "polygon_fpr_proxy", "n_pred", "n_gt"]
    p = conf.polygons

    def fold(name: str, good: list[str]) -> list:
        fitted = train(rows.filter(F.col("region") != name), conf)
        mine = F.col("tile_id").isin(good)
        prob = predict(fitted, feats.filter(mine), forest.filter(mine))
        comps = raster.cleaned(at(prob), least=p.least, open_n=p.open_n, close_n=p.close_n, height=height, width=width, keys=raster.named(pixel_m2))
        kept = cut(raster.large(comps, min_ha=p.min_ha, pixel_m2=pixel_m2))
        got = metrics.evaluate(kept, truth.filter(mine), forest.filter(mine).select("tile_id").distinct())
        return [(name, r.tile_id, *[r[c] for c in cols], None) for r in got.orderBy("tile_id").collect()]

    wanted = {name: own for name, own in regions.items() if len(own) >= least_tiles}
    done = together(spark, {name: lambda name=name, own=own: fold(name, [t.tile_id for t in own if t.has_features and t.has_labels]) for name, own in wanted.items()}, at_once)
    out = []
    for name, own in wanted.items():
        out += [(name, t.tile_id, *[None] * 5, "no features" if not t.has_features else "no weak labels") for t in own if not (t.has_features and t.has_labels)]
        got = done[name]
        out += got if isinstance(got, list) else [(name, None, *[None] * 5, f"training failed ({type(got).__name__}: {str(got).splitlines()[0][:200] if str(got) else ''})")]
    return spark.createDataFrame(out, "region string, tile_id string, union_iou double, polygon_recall double, polygon_fpr_proxy double, n_pred long, n_gt long, error string")


# ---- over a dataset's folder ------------------------------------------------------------------------------------


def run_train(spark: SparkSession, root: str, out: str, conf: Settings, *, tiles: list[str] | None = None, geojson: str | None = None, dem: str | None = None, dims: int = 64) -> dict:
    """Fits a model from a dataset and writes it, its record and, with validation tiles, the history of its losses. Gives the record."""
    wanted = layout.resolve_tiles(spark, tiles, geojson, root)
    if not wanted:
        raise FileNotFoundError("no training tiles")
    rel = dataset.load(spark, root, tiles=wanted, dem=dem)
    if rel.weak is None:
        raise FileNotFoundError("no weak labels")
    x = inputs(rel, conf, dims=dims)
    side = sampling.split(x.forest.select("tile_id").distinct(), list(conf.val_regions)).collect()  # a row for each tile
    val = sorted(r.tile_id for r in side if r.is_val)
    held = F.col("tile_id").isin(val)
    if len(val) == len(side):
        raise ValueError("the validation split left no training tiles")
    rows = cut(training_set(x.feats, x.fused.filter(~held), x.forest, conf))
    check = cut(validation_set(x.feats, x.fused.filter(held), x.forest, conf)) if val else None
    fitted = train(rows, conf, check)
    model.save(fitted, f"{out}/model")
    record = meta(rows, fitted, conf, val)
    if check is not None:
        sinks.write_report(model.history(fitted, train=rows, val=check).join(model.precision_history(fitted, check), "iteration").orderBy("iteration"), f"{out}/history")
        record["val_average_precision"] = model.average_precision(model.predict(fitted, check))
    sinks.write_record(spark, record, f"{out}/meta")
    return record


def run_predict(spark: SparkSession, root: str, fitted: str, out: str, conf: Settings, *, tiles: list[str], split: str = "test", base_year: int | None = 2020, tuned: str | None = None, dem: str | None = None, dims: int = 64) -> DataFrame:
    """Writes the tiles' polygons as GeoJSON. A tile without optical scenes or embeddings is an error. tuned: settings that run_tune wrote. Polygons are dated where the split has labels."""
    conf = settings(merged(conf, sinks.read_record(spark, tuned))) if tuned else conf
    rel = dataset.load(spark, root, split=split, tiles=tiles, dem=dem, strict=True)
    x = inputs(rel, conf, base_year, dims=dims)
    prob = placed(predict(model.load(fitted), x.feats, x.forest), rel.grid)
    p = conf.polygons
    comps = cut(raster.cleaned(prob, least=p.least, open_n=p.open_n, close_n=p.close_n, **SIDES, keys=["pixel_m2"]))
    dates = x.fused.select(*PIXEL, yymm(F.col("median_days")).alias("yymm")) if x.fused is not None else None
    kept = cut(raster.polygons(comps, min_ha=p.min_ha, pixel_m2="pixel_m2", dates=dates))
    rings = raster.outlines(raster.large(comps, min_ha=p.min_ha, pixel_m2="pixel_m2"))
    place = rel.grid.select("tile_id", (F.col("epsg") % 100).alias("zone"), F.col("epsg").between(32701, 32760).alias("south"), *"acef")
    feats = sinks.features(sinks.lonlat_rings(kept.join(rings, ["tile_id", "comp_id"]), place))
    filesink.write_document(feats, out)
    return kept


def run_tune(spark: SparkSession, root: str, fitted: str, out: str, conf: Settings, *, tiles: list[str], base_year: int | None = 2020, dem: str | None = None, dims: int = 64) -> dict:
    """Writes the best settings of the grid, and the report of all, for tiles with labels."""
    rel = dataset.load(spark, root, tiles=tiles, dem=dem, strict=True)
    if rel.weak is None:
        raise FileNotFoundError("no weak labels")
    x = inputs(rel, conf, base_year, dims=dims)
    prob = cut(placed(predict(model.load(fitted), x.feats, x.forest), rel.grid))
    return sinks.write_tuned(tune(prob, placed(x.fused, rel.grid), conf, **SIZES), out)


def run_cross_validate(spark: SparkSession, root: str, out: str, conf: Settings, *, tiles: list[str] | None = None, geojson: str | None = None, dem: str | None = None, least_tiles: int = 1, dims: int = 64) -> DataFrame:
    """Writes the leave-one-region-out report, a record for each region."""
    rel = dataset.load(spark, root, tiles=layout.resolve_tiles(spark, tiles, geojson, root), dem=dem)
    x = inputs(rel, conf, dims=dims)
    rows = cut(training_set(x.feats, x.fused, x.forest, conf))
    report = cross_validate(rows, x.feats, x.forest, x.fused, conf, **SIZES, least_tiles=least_tiles, grid=rel.grid)
    sinks.write_report(sinks.by_region(report), out)
    return report


def read_settings(path: str) -> Settings:
    """Settings from a file on the driver, over the defaults."""
    return settings(config.load(path))
