import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelloom.functions import pixel as fn
from pixelloom.operators import metrics, polygons, raster
from pixelloom.sources import filesink, sinks

GRID = "tile_id string, height int, width int, a double, b double, c double, d double, e double, f double, epsg int"


def grid(spark, *rows):
    return spark.createDataFrame(list(rows), GRID)


@pytest.mark.parametrize("epsg,north", [(32618, 400000.0), (32733, 9_600_000.0)])
def test_outlines_and_back(spark, tmp_path, epsg, north):
    """Outlines written to a file and filled again are the same cells: holes, islands in holes, corner contacts, the tile's border."""
    art = [
        "#######..##",
        "#.....#..##",
        "#.###.#....",
        "#.#.#.#..#.",
        "#.###.#.#..",
        "#.....##..#",
        "#######..##",
    ]
    rng = np.random.default_rng(0)
    rows = [("a", r, c) for r, line in enumerate(art) for c, x in enumerate(line) if x == "#"]
    rows += [("b", r, c) for r in range(30) for c in range(40) if rng.random() < 0.55]
    comps = raster.components(raster.runs(spark.createDataFrame(rows, "tile_id string, row int, col int"))).cache()
    zone = epsg % 100
    tiles = spark.createDataFrame([(t, zone, epsg > 32700, 10.0, 500000.0, -10.0, north) for t in "ab"], "tile_id string, zone int, south boolean, a double, c double, e double, f double")
    x = raster.areas(comps).join(raster.outlines(comps), ["tile_id", "comp_id"]).withColumn("time_step", F.lit(None).cast("int"))
    filesink.write_document(sinks.features(sinks.lonlat_rings(x, tiles)), str(tmp_path / "doc"))
    place = (10.0, 0.0, 500000.0, 0.0, -10.0, north, epsg)
    g = grid(spark, ("a", 7, 11, *place), ("b", 30, 40, *place))
    read = polygons.read_features(spark, str(tmp_path / "doc")).cache()
    own = polygons.runs_of(read.select(F.col("properties")["tile_id"].alias("tile_id"), "poly_id", "rings"), g)
    got = raster.cells(own).select("tile_id", "row", "col").collect()
    assert len(got) == len(rows) and {tuple(r) for r in got} == set(rows)
    assert own.select("tile_id", "comp_id").distinct().count() == comps.select("tile_id", "comp_id").distinct().count()
    # by place alone, polygons of both tiles lie on either
    both = polygons.by_place(read, g)
    assert both.filter("tile_id = 'b'").count() == read.count()


def test_plain_shapes(spark):
    """A ring that isn't closed, a multipolygon with a hole, a triangle, parts outside the tile, features without polygons; a grid in degrees."""
    def geometry(kind, coordinates):
        return json.dumps({"type": "Feature", "properties": {"k": 1}, "geometry": {"type": kind, "coordinates": coordinates}})

    shapes = [
        geometry("Polygon", [[[0, 10], [4, 10], [4, 6], [0, 6]]]),
        geometry("MultiPolygon", [[[[5, 9], [9, 9], [9, 5], [5, 5], [5, 9]], [[6, 8], [8, 8], [8, 6], [6, 6], [6, 8]]], [[[1, 2], [2, 2], [2, 1], [1, 1], [1, 2]]]]),
        geometry("Polygon", [[[0, 0], [10, 0], [0, 10], [0, 0]]]),
        geometry("Polygon", [[[-5, 20], [20, 20], [20, 9], [-5, 9], [-5, 20]]]),
        geometry("Point", [1, 1]),
        json.dumps({"type": "Feature", "properties": {}, "geometry": None}),
    ]
    parsed = polygons.parsed(spark.createDataFrame(list(enumerate(shapes)), "poly_id long, feature string"))
    g = grid(spark, ("t", 10, 10, 1.0, 0.0, 0.0, 0.0, -1.0, 10.0, 4326))
    own = polygons.runs_of(parsed.select(F.lit("t").alias("tile_id"), "poly_id", "rings"), g)
    got = {}
    for r in raster.cells(own).collect():
        got.setdefault(r.comp_id, set()).add((r.row, r.col))
    ring = {(r, c) for r in range(1, 5) for c in range(5, 9)} - {(2, 6), (2, 7), (3, 6), (3, 7)}
    assert got[0] == {(r, c) for r in range(4) for c in range(4)}
    assert got[1] == ring | {(8, 1)}
    assert got[2] == {(r, c) for r in range(10) for c in range(10) if (c + 0.5) + (10 - r - 0.5) < 10}
    assert got[3] == {(0, c) for c in range(10)} and set(got) == {0, 1, 2, 3}
    assert {(r.tile_id, r.poly_id) for r in polygons.by_place(parsed, g).collect()} == {("t", i) for i in range(4)}
    assert polygons.by_place(parsed, grid(spark, ("far", 10, 10, 1.0, 0.0, 40.0, 0.0, -1.0, 10.0, 4326))).count() == 0


def test_scores_of_overlapping_polygons(spark):
    runs = "tile_id string, comp_id long, row int, c0 int, c1 int"
    pred = spark.createDataFrame([("t", 1, 0, 0, 5), ("t", 2, 0, 3, 8), ("t", 3, 9, 0, 0), ("u", 1, 0, 0, 0)], runs)
    true = spark.createDataFrame([("t", 1, 0, 6, 11), ("v", 1, 0, 0, 0)], runs)
    got = {r.tile_id: r for r in polygons.score(pred, true, spark.createDataFrame([(t,) for t in "tuvw"], "tile_id string")).collect()}
    assert got["t"].union_iou == pytest.approx(3 / 13) and got["t"].polygon_recall == 1.0 and got["t"].polygon_fpr_proxy == pytest.approx(1 / 3)
    assert (got["u"].union_iou, got["u"].polygon_recall, got["u"].polygon_fpr_proxy) == (0.0, 1.0, 1.0)
    assert (got["v"].union_iou, got["v"].polygon_recall, got["v"].polygon_fpr_proxy) == (0.0, 0.0, 0.0)
    assert (got["w"].union_iou, got["w"].polygon_recall, got["w"].polygon_fpr_proxy) == (1.0, 1.0, 0.0)
    assert metrics.evaluate(pred, true, spark.createDataFrame([("t",)], "tile_id string")).first().n_pred == 3


def test_columns_equal_numbers(spark):
    x = spark.createDataFrame([(-75.3, 3.1)], "lon double, lat double")
    got = x.select(*[v.alias(n) for v, n in zip(fn.lonlat_to_utm(F.col("lon"), F.col("lat"), F.lit(18)), "xy")]).first()
    assert tuple(got) == pytest.approx(fn.lonlat_to_utm(-75.3, 3.1, 18, ops=fn.Numbers), abs=1e-6)


def test_projections_in_lambdas_compute_each_part_once(spark):
    """Lambdas aren't compiled, so what a projection uses often must be bound; results are those of the plain Columns."""
    bound, lonlat_to_utm, utm_to_lonlat = fn.bound, fn.lonlat_to_utm, fn.utm_to_lonlat
    df = spark.createDataFrame([(431_234.5, 412_345.6, 19), (700_000.0, 9_000.0, 20)], "x double, y double, z int")
    xy = F.transform(F.array(F.struct("x", "y")), lambda p: utm_to_lonlat(p.x, p.y, F.col("z"), let=bound))[0]
    back = F.transform(F.array(F.struct("lon", "lat")), lambda p: lonlat_to_utm(p.lon, p.lat, F.col("z"), let=bound))[0]
    lon, lat = utm_to_lonlat(F.col("x"), F.col("y"), F.col("z"))
    plain = df.select("z", lon.alias("lon"), lat.alias("lat"))
    east, north = lonlat_to_utm(F.col("lon"), F.col("lat"), F.col("z"))
    assert [tuple(r[0]) for r in df.select(xy).collect()] == [(r.lon, r.lat) for r in plain.collect()]
    assert [tuple(r[0]) for r in plain.select(back).collect()] == [tuple(r) for r in plain.select(east, north).collect()]

    rings = spark.createDataFrame([("a", [[[0, 0], [1, 0], [1, 1], [0, 0]]])], "tile_id string, rings array<array<array<int>>>")
    tiles = spark.createDataFrame([("a", 19, False, 10.0, 500000.0, -10.0, 400000.0)], "tile_id string, zone int, south boolean, a double, c double, e double, f double")
    plan = sinks.lonlat_rings(rings, tiles)._jdf.queryExecution().optimizedPlan().toString().upper()
    assert plan.count("SIN(") <= 12, plan.count("SIN(")
