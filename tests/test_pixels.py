"""The operators on small relations with known results."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelloom.functions import pixel as fn
from pixelloom.operators import imagery, labels, metrics, model, raster, sampling, satellite, terrain
from pixelloom.plans import config
from pixelloom.sources import layout, sinks

PX = "tile_id string, row int, col int"


np_ops = fn.Numbers


def aef_rows(years, bands, size, seed=0):
    rng = np.random.default_rng(seed)
    return [("t", r, c, y, [float(v) for v in rng.normal(size=bands)]) for y in years for r in range(size) for c in range(size)]


def test_region(spark):
    x = spark.createDataFrame([("18NWG_6_6",), ("47QMB_0_8",)], "tile_id string")
    assert [r[0] for r in x.select(fn.region(F.col("tile_id"))).collect()] == ["18NWG", "47QMB"]


def test_indices_and_decibels(spark):
    nan = float("nan")
    x = spark.createDataFrame([(0.4, 0.1, 0.2, 10.0), (0.0, 0.0, 0.0, 0.0), (nan, 0.1, 0.2, nan), (-0.5, 0.1, 0.2, -1.0)], "b08 double, b04 double, b11 double, p double")
    got = x.select(fn.ndvi().alias("v"), fn.decibel(F.col("p")).alias("d")).collect()
    assert [r.v for r in got] == [pytest.approx(0.6), 0.0, 0.0, 0.0]
    assert [r.d for r in got] == [10.0, None, None, None]


def test_aef(spark):
    a = spark.createDataFrame(aef_rows((2020, 2021, 2024), 8, 6), PX + ", year int, emb array<double>")
    r = satellite.aef_change(a).filter("row = 1 and col = 2").first()
    by = {x.year: np.array(x.emb) for x in a.filter("row = 1 and col = 2").collect()}
    assert np.allclose(r.delta, by[2024] - by[2020]) and r.aef_norm == pytest.approx(np.linalg.norm(by[2024] - by[2020]))
    d = satellite.aef_drift(a).filter("row = 1 and col = 2").first()
    assert d.aef_max_drift == pytest.approx(max(np.linalg.norm(by[y] - by[2020]) for y in (2021, 2024)))
    tie = spark.createDataFrame([("t", 0, 0, y, [float(v)]) for y, v in ((2020, 0), (2021, 1), (2022, 1))], a.schema)
    assert satellite.aef_drift(tie).first().aef_year_of_drift == 2021
    assert satellite.aef_drift(tie.filter("year = 2020")).count() == 0
    z = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert z.select(fn.cosine_distance(F.col("a"), F.col("b"))).first()[0] == 1.0


@pytest.mark.parametrize("with_terrain", [False, True])
def test_pack(spark, with_terrain):
    a = spark.createDataFrame(aef_rows((2020, 2024), 8, 8), PX + ", year int, emb array<double>")
    t = a.select("tile_id", "row", "col").distinct().withColumns({"elevation": F.lit(float("nan")), "slope": F.lit(3.0)}) if with_terrain else None
    x = satellite.pack(a.select("tile_id", "row", "col").distinct(), 8, change=satellite.aef_change(a), terrain=t)
    assert x.count() == 64 and len(x.columns) == 3 + 24 + 4 + 6 + 14 + 4 + 2 + 2
    r = x.first()
    assert all(v is not None and math.isfinite(v) for v in r[3:])
    assert r.slope == (3.0 if with_terrain else 0.0) and r.elevation == 0.0


def test_annual_slope_uses_positions(spark):
    x = spark.createDataFrame([("t", 0, 0, 2020, m, v, 0.1, 0.1) for m, v in ((1, 0.1), (2, 0.2), (11, 0.4))] + [("t", 0, 0, 2021, 5, 0.3, 0.1, 0.1)], PX + ", year int, month int, b08 double, b04 double, b11 double")
    r = {y.year: y for y in satellite.s2_annual(x).collect()}
    v = [(b - 0.1) / (b + 0.1) for b in (0.1, 0.2, 0.4)]
    assert r[2020].slope_ndvi == pytest.approx(np.polyfit([0, 1, 2], v, 1)[0]) and r[2020].std_ndvi == pytest.approx(np.std(v)) and r[2020].p10_ndvi == pytest.approx(np.percentile(v, 10))
    assert r[2021].slope_ndvi == 0 and r[2021].std_ndvi is None
    d = satellite.worst_drop(satellite.s2_annual(x), 2021).first()
    assert d.worst_drop_year == 2020 and d.worst_drop == pytest.approx(0.0 - 0.5)


def test_forest_split(spark):
    rows = [("a", 0, i, s, v) for i, (s, v) in enumerate([(1.0, 0.7), (2.0, 0.6), (-1.0, 0.2), (-2.0, 0.9)])]
    rows += [("one", 0, 0, 1.0, 0.6), ("one", 0, 1, 2.0, 0.1), ("none", 0, 0, 1.0, None), ("none", 0, 1, -1.0, None), ("none", 0, 2, -2.0, None)]
    x = satellite.forest_by_split(spark.createDataFrame(rows, PX + ", score double, ndvi double"))
    got = {(r.tile_id, r.col): r.forest for r in x.collect()}
    assert [got["a", i] for i in range(4)] == [True, True, False, False]
    assert [got["one", i] for i in range(2)] == [True, False]
    assert [got["none", i] for i in range(3)] == [False, True, True]


def test_principal_scores(spark):
    rng = np.random.default_rng(1)
    pts = rng.normal(size=(50, 1)) * np.array([[3.0, 1.0, 0.0]]) + 0.05 * rng.normal(size=(50, 3))
    x = spark.createDataFrame([("t", 0, i, 2020, [float(v) for v in p]) for i, p in enumerate(pts)], PX + ", year int, emb array<double>").repartition(3)
    got = np.array([r.score for r in satellite.principal_scores(x).orderBy("col").collect()])
    c = pts - pts.mean(0)
    want = c @ np.linalg.svd(c)[2][0]
    assert min(np.abs(got - want).max(), np.abs(got + want).max()) < 1e-9


def test_decoders(spark):
    codes = spark.createDataFrame([("t", 0, i, c) for i, c in enumerate([0, 21828, 31828, 41828, 21826, 2182800000000, None])], PX + ", code long")
    got = {r.col: (r.confidence, r.days) for r in labels.radd(codes).collect()}
    assert got == {0: (0.0, 0), 1: (0.6, 18263), 2: (1.0, 18263), 3: (0.0, 0), 4: (0.0, 0), 5: (0.0, 0), 6: (0.0, 0)}
    g = spark.createDataFrame([("t", 0, i, yy, a, d) for i, (yy, a, d) in enumerate([(20, 2, 1), (20, 3, 366), (21, 1, 5), (19, 3, 100), (22, 3, 0)])], PX + ", yy int, alert int, doy int")
    assert [(r.confidence, r.days) for r in labels.gladl(g).orderBy("col").collect()] == [(0.5, 18262), (0.9, 18627), (0.0, 18632), (0.0, 0), (0.0, 0)]
    t = spark.createDataFrame([("t", 0, 0, yy, 3, 10) for yy in (22, 21)], g.schema)
    assert labels.gladl_combine(labels.gladl(t)).first().days == 18628 + 9
    s = spark.createDataFrame([("t", 0, i, a, o) for i, (a, o) in enumerate([(4, 400), (1, 364), (1, 365), (5, 400), (2, -3)])], PX + ", alert int, day_offset int")
    assert [(r.confidence, r.days) for r in labels.glads2(s).orderBy("col").collect()] == [(1.0, 18297), (0.0, 0), (0.25, 18262), (0.0, 0), (0.0, 0)]
    y = spark.createDataFrame([(0,), (18262,), (-5,), (100_000,)], "d int")
    assert [r[0] for r in y.select(fn.yymm(F.col("d"))).collect()] == [0, 2001, 0, 10]


def weak(spark, rows):
    return spark.createDataFrame(rows, PX + ", source string, confidence double, days int")


def test_fuse(spark):
    rows = [("t", r, c, s, {("a", 0, 0): 0.95, ("a", 1, 1): 0.55, ("b", 1, 1): 0.80, ("a", 2, 2): 0.9, ("a", 3, 3): 0.85}.get((s, r, c), 0.0), {"a": 101, "b": 200}[s]) for s in "ab" for r in range(4) for c in range(4)]
    got = {(r.row, r.col): r for r in labels.fuse(weak(spark, rows)).collect()}
    assert {k for k, r in got.items() if r.binary} == {(0, 0), (1, 1), (2, 2)}  # 0.9 alone is exactly enough
    assert got[0, 0].max_confidence == 0.95 and got[1, 1].max_confidence == 0.80 and got[1, 1].median_days == 150 and got[3, 3].median_days == 0


def test_ignore_band(spark):
    f = spark.createDataFrame([("t", 0, 0, 1, 0.95, 2), ("t", 0, 1, 0, 0.5, 1), ("t", 0, 2, 0, 0.1, 1), ("t", 0, 3, 1, 0.95, 2)], PX + ", binary int, max_confidence double, agree_count int")
    forest = f.select("tile_id", "row", "col", (F.col("col") < 3).alias("forest"))
    assert {r.col: r["class"] for r in labels.candidates(f, forest).collect()} == {0: 1, 2: 0}


def test_stratified(spark):
    rng = np.random.default_rng(0)
    c = rng.uniform(0.5, 1, 1000)
    pos = spark.createDataFrame([("t", i // 40, i % 40, float(v)) for i, v in enumerate(c)], PX + ", max_confidence double")
    cap = lambda n: spark.createDataFrame([("t", n)], "tile_id string, cap long")
    got = [r.max_confidence for r in sampling.stratified(pos, cap(200)).collect()]
    q = np.quantile(c, [0.25, 0.5, 0.75])
    assert len(got) == 200 and min(np.bincount(np.searchsorted(q, got, side="right"), minlength=4)) >= 30
    assert sampling.stratified(pos, cap(203)).count() == 200  # what doesn't divide stays unfilled
    assert sampling.stratified(pos, cap(0)).count() == 0 and sampling.stratified(pos, cap(1000)).count() == 1000
    tied = pos.withColumn("max_confidence", F.when(F.col("row") < 20, 0.9).otherwise(1.0))  # edges coincide, strata are empty
    assert sampling.stratified(tied, cap(203)).count() == 200  # what strata are short of, no more
    assert sampling.plain(pos, cap(17)).count() == 17


def test_weights(spark):
    s = spark.createDataFrame([("18NWG_1", 0, 0, 1, 0.5, 1), ("18NWG_1", 0, 1, 1, 1.0, 3), ("20NWG_1", 0, 1, 0, 0.1, 0)], PX + ", class int, max_confidence double, agree_count int")
    got = {(r.tile_id, r.col): r for r in sampling.weights(s).collect()}
    mean = (0.625 + 1.75) / 2
    assert got["18NWG_1", 0].weight == pytest.approx(0.625 / mean * 3 / (2 * 2)) and got["20NWG_1", 1].weight == pytest.approx(1.5) and got["18NWG_1", 1].target == 1.0
    assert sampling.positive_weight(s).first().scale_pos_weight == pytest.approx(0.5)
    n = spark.createDataFrame([("a", 4), ("b", 16), ("c", 0)], "region string, n long")
    assert {r.region: r.alloc for r in sampling.quotas(n, 15).collect()} == {"a": 5, "b": 10, "c": 0}


def test_dem_cells(spark):
    b = spark.createDataFrame([("a", -75.8, 3.0, -75.7, 3.1), ("b", 104.9, 13.9, 105.1, 14.1), ("c", float("nan"), 0.0, 1.0, 1.0)], "tile_id string, w double, s double, e double, n double")
    got = [(r.tile_id, r.dem) for r in terrain.dem_cells(b).collect()]
    name = "Copernicus_DSM_COG_10_{}_00_{}_00_DEM".format
    assert got == [("a", name("N03", "W076")), *[("b", name(a, o)) for a in ("N13", "N14") for o in ("E104", "E105")]]


def test_slope(spark):
    ramp = spark.createDataFrame([("r", i, j, i * 10.0) for i in range(16) for j in range(16)] + [("f", i, j, 7.0) for i in range(8) for j in range(8)], PX + ", elevation double")
    got = {(r.tile_id, r.row, r.col): r.slope for r in terrain.slope(ramp, 30, 30).collect()}
    assert all(0 <= v < 90 for v in got.values()) and got["r", 10, 10] == pytest.approx(math.degrees(math.atan(1 / 3))) == got["r", 0, 0] and got["f", 3, 3] == 0


def test_warps(spark):
    src = spark.createDataFrame([("t", i, j, float(10 * i + j)) for i in range(4) for j in range(4)], PX + ", v double")
    grid = terrain.target_grid(src, 2, 2)
    to, fr = (20.0, 0, 0, 0, -20.0, 0), (10.0, 0, 0, 0, -10.0, 0)
    near = {(r.row, r.col): r.v for r in terrain.warp_nearest(src, grid, to, fr, "v", -1.0).collect()}
    assert near == {(i, j): float(10 * (2 * i + 1) + 2 * j + 1) for i in range(2) for j in range(2)}
    lin = {(r.row, r.col): r.v for r in terrain.warp_bilinear(src, grid, to, fr, ["v"]).collect()}
    assert lin == {(i, j): 10 * (2 * i + 0.5) + 2 * j + 0.5 for i in range(2) for j in range(2)}
    out = {(r.row, r.col): r.v for r in terrain.warp_nearest(src, grid, (20.0, 0, 1000, 0, -20.0, 0), fr, "v", -1.0).collect()}
    assert set(out.values()) == {-1.0}
    assert terrain.crop_or_pad(src, terrain.target_grid(src, 6, 2), "v").filter("v is null").count() == 4
    m = spark.createDataFrame([("t", 0, 0, 1, None), ("t", 0, 0, 2, 5.0), ("t", 0, 0, 3, 6.0)], PX + ", order int, elevation double")
    assert terrain.mosaic(m).first().elevation == 5.0


def test_utm():
    lon, lat = fn.utm_to_lonlat(500000.0, 0.0, 31, ops=math)
    assert (lon, lat) == (pytest.approx(3.0), pytest.approx(0.0))
    lon, lat = fn.utm_to_lonlat(448251.795, 5411932.678, 31, ops=math)  # a well-known tower in Paris
    assert (lon, lat) == (pytest.approx(2.2945, abs=1e-4), pytest.approx(48.8582, abs=1e-4))


def numpy_ball(fg, n, grow):
    h, w_ = fg.shape
    out = fg.copy()
    for _ in range(n):
        p = np.pad(out, 1)
        near = [p[1:-1, 1:-1], p[:-2, 1:-1], p[2:, 1:-1], p[1:-1, :-2], p[1:-1, 2:]]
        out = np.logical_or.reduce(near) if grow else np.logical_and.reduce(near)
    return out


@pytest.mark.parametrize("n", [1, 2, 3])
def test_morphology(spark, n):
    fg = np.random.default_rng(n).random((24, 30)) < 0.75
    df = raster.runs(spark.createDataFrame([("t", int(i), int(j)) for i, j in zip(*np.nonzero(fg))], PX))
    cells = lambda d: {(r.row, r.col) for r in raster.cells(d).collect()}
    want = lambda a: {(int(i), int(j)) for i, j in zip(*np.nonzero(a))}
    assert cells(raster.opening(df, n, 24, 30)) == want(numpy_ball(numpy_ball(fg, n, False), n, True))
    assert cells(raster.closing(df, n, 24, 30)) == want(numpy_ball(numpy_ball(fg, n, True), n, False))


def test_components_outlines_and_dates(spark):
    art = ["##..#", "#.#.#", "###..", "....#"]
    cells = spark.createDataFrame([("t", i, j) for i, line in enumerate(art) for j, x in enumerate(line) if x == "#"], PX)
    comps = raster.components(raster.runs(cells))
    assert {r.comp_id: r.n_px for r in raster.areas(comps).collect()} == {0: 7, 4: 2, 3 * 2**20 + 4: 1}
    assert raster.areas(comps, min_ha=0.07).count() == 1
    rings = {r.comp_id: r.rings for r in raster.outlines(comps).collect()}
    area = lambda ring: sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:])) / 2
    assert sum(area(r) for r in rings[0]) == 7 and all(r[0] == r[-1] for x in rings.values() for r in x)
    full = raster.components(raster.runs(spark.createDataFrame([("t", i, j) for i in range(3) for j in range(3) if (i, j) != (1, 1)], PX)))
    got = raster.outlines(full).first().rings
    assert [abs(area(r)) for r in got] == [9, 1] and area(got[0]) > 0 > area(got[1])
    dates = spark.createDataFrame([("t", 0, 0, 2103), ("t", 0, 1, 2101), ("t", 1, 0, 0), ("t", 0, 4, 0)], PX + ", yymm int")
    of = comps.select("tile_id", "comp_id", "row", F.explode(F.sequence("c0", "c1")).alias("col"))
    assert {r.comp_id: r.time_step for r in raster.time_steps(of, dates).collect()} == {0: 2101, 4: None, 3 * 2**20 + 4: None}


def test_metrics(spark):
    cells = lambda *p: spark.createDataFrame([("t", i, j) for i, j in p], PX)
    none = cells().limit(0)
    a, b = cells((0, 0), (0, 1), (5, 5)), cells((0, 1), (0, 2), (9, 9))
    assert metrics.union_iou(a, b).first().iou == pytest.approx(1 / 5) and metrics.union_iou(none, none).first().iou == 1.0 and metrics.union_iou(a, none).first().iou == 0.0
    poly = lambda c: raster.components(raster.runs(c)).select("tile_id", "comp_id", "row", F.explode(F.sequence("c0", "c1")).alias("col"))
    assert metrics.recall(poly(b), a).first().recall == 0.5 and metrics.false_positive_rate(poly(a), b).first().fpr == 0.5
    assert metrics.recall(poly(cells((1, 1))), cells((2, 2))).first().recall == 1.0  # corners touch
    assert metrics.recall(poly(none), a).first().recall == 1.0 and metrics.recall(poly(a), none).first().recall == 0.0
    assert metrics.false_positive_rate(poly(a), none).first().fpr == 1.0 and metrics.false_positive_rate(poly(none), a).first().fpr == 0.0


def test_grid_search_ties(spark):
    p = spark.createDataFrame([("t", 3, 3, 0.9), ("t", 3, 4, 0.9), ("t", 7, 7, 0.5)], PX + ", prob double")
    true = metrics.true_polygons(p.filter("prob > 0.8"), 0.0)
    got = metrics.grid_search(p, true, p, thresholds=[0.4, 0.6, 0.8], opens=[0], closes=[0], areas=[0.0, 0.02], height=10, width=10).collect()
    assert (got[0].combo, got[0].mean_iou) == (1, 1.0) and len(got) == 6 and [r["rank"] for r in got] == [1, 2, 3, 4, 5, 6]
    # a tile without labels or predictions counts as a perfect one, and a tile's share doesn't depend on its size
    q = p.unionByName(spark.createDataFrame([("u", i, i, 0.9) for i in range(5)] + [("v", 0, 0, 0.1)], PX + ", prob double"))
    got = {r.combo: r for r in metrics.grid_search(q, true, q, thresholds=[0.6], opens=[0], closes=[0], areas=[0.0], height=10, width=10).collect()}
    assert got[0].mean_iou == pytest.approx(2 / 3) and got[0].mean_recall == 1.0 and got[0].mean_fpr_proxy == pytest.approx(1 / 3)


def test_evaluate_edges(spark):
    runs = lambda *r: spark.createDataFrame(list(r), "tile_id string, comp_id long, row int, c0 int, c1 int")
    pred = runs(("a", 1, 0, 0, 3), ("a", 2, 5, 5, 5), ("b", 1, 0, 0, 0), ("d", 1, 2, 2, 2))
    true = runs(("a", 9, 0, 2, 5), ("a", 8, 9, 9, 9), ("c", 9, 1, 1, 1), ("d", 9, 3, 3, 3))
    got = {r.tile_id: tuple(r)[1:] for r in metrics.evaluate(pred, true, spark.createDataFrame([(t,) for t in "abcde"], "tile_id string")).collect()}
    assert got["a"] == (2, 2, pytest.approx(2 / 8), 0.5, 0.5)
    assert got["b"] == (1, 0, 0.0, 1.0, 1.0) and got["c"] == (0, 1, 0.0, 0.0, 0.0) and got["e"] == (0, 0, 1.0, 1.0, 0.0)
    assert got["d"] == (1, 1, 0.0, 1.0, 0.0)  # corners touch


def test_components_and_outlines_against_flood_fill(spark):
    """Random rasters of any density, with a key beside the tile."""
    rng = np.random.default_rng(3)
    cells, want = [], {}
    for k, share in enumerate((0.2, 0.5, 0.6, 0.8)):
        x = rng.random((40, 40)) < share
        cells += [("t", k, int(i), int(j)) for i, j in zip(*np.nonzero(x))]
        seen = np.zeros_like(x)
        for i, j in zip(*np.nonzero(x)):
            if not seen[i, j]:
                todo, own = [(i, j)], set()
                seen[i, j] = True
                while todo:
                    a, b = todo.pop()
                    own.add((a, b))
                    for c, d in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)):
                        if 0 <= c < 40 and 0 <= d < 40 and x[c, d] and not seen[c, d]:
                            seen[c, d] = True
                            todo.append((c, d))
                want[k, int(i) * 2**20 + int(j)] = len(own)
    comps = raster.components(raster.runs(spark.createDataFrame(cells, "tile_id string, k int, row int, col int")))
    assert {(r.k, r.comp_id): r.n_px for r in raster.areas(comps).collect()} == want
    area = lambda ring: sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:])) / 2
    for r in raster.outlines(comps.filter("k = 2").drop("k")).collect():
        assert sum(area(x) for x in r.rings) == want[2, r.comp_id] and area(r.rings[0]) > 0 and all(area(x) < 0 for x in r.rings[1:])


def test_systems(spark):
    """Longitude and latitude to metres and back, both hemispheres, and a warp between systems."""
    rows = [(-74.3, 3.2, 18, False), (-75.0, 0.0, 18, False), (104.9, -13.9, 48, True), (-71.9, 60.5, 19, False)]
    for lon, lat, zone, south in rows:
        east, north = fn.lonlat_to_utm(lon, lat, zone, south, ops=np_ops)
        back = fn.utm_to_lonlat(east, north, zone, south, ops=np_ops)
        assert back == (pytest.approx(lon, abs=1e-7), pytest.approx(lat, abs=1e-7))
    assert fn.lonlat_to_utm(-75.0, 0.0, 18, ops=np_ops) == (pytest.approx(500000.0), pytest.approx(0.0))
    x = spark.createDataFrame([(*r, 32600 + r[2] + 100 * r[3]) for r in rows], "lon double, lat double, zone int, south boolean, epsg int")
    there = fn.reproject(x.withColumns({"x": F.col("lon"), "y": F.col("lat")}), "x", "y", F.lit(4326), F.col("epsg"))
    assert all(abs(r.x - 500_000) < 400_000 and 0 <= r.y <= 10_000_000 for r in there.collect())
    back = fn.reproject(there, "x", "y", F.col("epsg"), F.lit(4326)).collect()
    assert len(back) == 4 and all(r.x == pytest.approx(r.lon, abs=1e-7) and r.y == pytest.approx(r.lat, abs=1e-7) for r in back)
    # a plane in degrees stays the same plane when it is laid on a grid in metres
    step = 0.0001
    src = spark.createDataFrame([("t", i, j, (3.01 - (i + 0.5) * step) * 1000 + (-74.5 + (j + 0.5) * step)) for i in range(120) for j in range(120)], PX + ", z double")
    e0, n0 = fn.lonlat_to_utm(-74.495, 3.005, 18, ops=np_ops)
    grid = spark.createDataFrame([("t", i, j) for i in range(20) for j in range(20)], PX)
    to = (10.0, 0.0, e0, 0.0, -10.0, n0)
    got = terrain.warp_bilinear(src, grid, to, (step, 0.0, -74.5, 0.0, -step, 3.01), ["z"], (32618, 4326)).collect()
    for r in got:
        lon, lat = fn.utm_to_lonlat(e0 + (r.col + 0.5) * 10, n0 - (r.row + 0.5) * 10, 18, ops=np_ops)
        assert r.z == pytest.approx(lat * 1000 + lon, abs=1e-6)
    near = {(r.row, r.col): r.z for r in terrain.warp_nearest(src, grid, to, (step, 0.0, -74.5, 0.0, -step, 3.01), "z", -1.0, (32618, 4326)).collect()}
    assert all(abs(near[r.row, r.col] - r.z) < 0.06 for r in got)


def test_pictures(spark):
    x = spark.createDataFrame([("t", 0, i, 2020, float(v), 1.0) for i, v in enumerate(range(0, 101))], PX + ", year int, b04 double, b08 double")
    m = imagery.median_composite(x, ["b04", "b08"])
    s = {r.col: (r.b04, r.b08) for r in imagery.stretch(m, ["b04", "b08"], ["tile_id"]).collect()}
    assert s[0] == (0.0, 0.0) and s[100][0] == 1.0 and 0.49 < s[50][0] < 0.51 and s[50][1] == 0.0
    scenes = spark.createDataFrame([("a", 2020, 3), ("a", 2020, 8), ("a", 2021, 1), ("b", 2019, 5), ("c", 2020, 6), ("c", 2020, 9)], "tile_id string, year int, month int")
    assert {r.tile_id: (r.year, r.month) for r in imagery.pick_scene(scenes, 2020, 6).collect()} == {"a": (2020, 8), "b": (2019, 5), "c": (2020, 6)}
    assert {r.tile_id: (r.year, r.month) for r in layout.reference_scene(scenes).collect()} == {"a": (2020, 3), "b": (2019, 5), "c": (2020, 6)}


def test_files(spark, tmp_path):
    p = tmp_path / "tiles.geojson"
    p.write_text(json.dumps({"type": "FeatureCollection", "features": [{"properties": {"name": "a"}}, {"properties": {"name": "", "tile_id": "b"}}, {"properties": {"id": "c"}}, {"properties": {}}]}))
    assert [r.tile_id for r in layout.tiles_from_geojson(spark, str(p)).collect()] == ["a", "b", "c"]
    assert layout.tiles_from_geojson(spark, str(tmp_path / "none.geojson")).count() == 0
    f = tmp_path / "sentinel-2/train/b__s2_l2a"
    f.mkdir(parents=True)
    (f / "b__s2_l2a_2020_1.tif").write_bytes(b"x")
    assert layout.resolve_tiles(spark, None, str(tmp_path / "none"), str(tmp_path)) == ["b"] and layout.resolve_tiles(spark, ["z"], None, None) == ["z"]
    assert layout.path("/r", "gladl_date", tile="T", yy=5) == "/r/labels/train/gladl/gladl_T_alertDate05.tif"
    comps = raster.components(raster.runs(spark.createDataFrame([("t", 0, 0), ("t", 0, 1), ("t", 5, 5)], PX)))
    poly = raster.areas(comps).withColumn("time_step", F.lit(None).cast("int")).join(raster.outlines(comps), ["tile_id", "comp_id"])
    tiles = spark.createDataFrame([("t", 18, False, 10.0, 500000.0, -10.0, 400000.0)], "tile_id string, zone int, south boolean, a double, c double, e double, f double")
    sinks.write_geojson(sinks.features(sinks.lonlat_rings(poly, tiles)), str(tmp_path / "out"))
    text = next((tmp_path / "out").glob("part-*")).read_text()
    doc = json.loads(text)
    assert len(doc["features"]) == 2 and doc["features"][0]["properties"]["time_step"] is None and doc["features"][0]["geometry"]["coordinates"][0][0][0] == -75.0
    assert sinks.read_geojson(spark, str(tmp_path / "out")).count() == 2
    many = spark.range(50).select(F.concat(F.lit("t"), F.col("id") % 7).alias("tile_id"), F.col("id").alias("comp_id"), F.concat(F.lit('{"n": '), F.col("id"), F.lit("}")).alias("feature"))
    for one in (True, False):
        sinks.write_geojson(many, str(tmp_path / f"many{one}"), one_file=one)
        doc = json.loads("".join(p.read_text() for p in sorted((tmp_path / f"many{one}").glob("part-*"))))
        assert [f["n"] for f in doc["features"]] == sorted(range(50), key=lambda i: (i % 7, i))
    sinks.write_geojson(many.limit(0), str(tmp_path / "none"))
    assert json.loads("".join(p.read_text() for p in sorted((tmp_path / "none").glob("part-*"))))["features"] == []
    sinks.write_geojson(sinks.tile_features(spark.createDataFrame([("b",), ("a",)], "tile_id string")), str(tmp_path / "tiles"))
    assert [r.tile_id for r in layout.tiles_from_geojson(spark, str(tmp_path / "tiles")).collect()] == ["a", "b"]
    grid = spark.createDataFrame([(2, 1, 0.4, 0, 3, 0.5, 0.1, 0.2, 0.3), (1, 0, 0.5, 0, 9, 0.5, 0.2, 0.2, 0.3)], "rank int, combo int, threshold double, open_n int, close_n int, min_ha double, mean_iou double, mean_recall double, mean_fpr_proxy double")
    assert sinks.write_tuned(grid, str(tmp_path / "tuned")) == sinks.read_record(spark, str(tmp_path / "tuned")) == {"polygons": {"least": 0.5, "open_n": 0, "close_n": 9, "min_ha": 0.5}}
    assert [r["combo"] for r in sinks.read_record(spark, str(tmp_path / "tuned.report"))["all"]] == [0, 1]


def test_config(tmp_path):
    assert config.merged({"a": {"b": 1, "c": 2}, "d": 3}, {"a": {"b": 5}, "e": 1}) == {"a": {"b": 5, "c": 2}, "d": 3, "e": 1}
    p = tmp_path / "c.json"
    p.write_text('{"a": {"b": 2}}')
    assert config.load(str(p)).a.b == 2
    p.write_text("")
    assert config.load(str(p)) == {}
    assert len(config.DEFAULTS.grid.thresholds) * len(config.DEFAULTS.grid.opens) * len(config.DEFAULTS.grid.closes) * len(config.DEFAULTS.grid.areas) == 384


def test_model(spark, tmp_path):
    rng = np.random.default_rng(0)
    x = rng.uniform(size=(600, 2))
    rows = spark.createDataFrame([("t", "rst"[i % 3], float(a), float(b), float(0.9 if a > 0.5 else 0.1), 1.0) for i, (a, b) in enumerate(x)], "tile_id string, region string, a double, b double, target double, weight double")
    m = model.fit(rows, ["a", "b"], trees=10, rate=0.3, depth=3, least=5)
    got = model.predict(m, rows).select("target", "prob").collect()
    assert np.corrcoef([r.target for r in got], [r.prob for r in got])[0, 1] > 0.95
    model.save(m, str(tmp_path / "m"))
    again = model.predict(model.load(str(tmp_path / "m")), rows).select("prob").collect()
    assert [r.prob for r in again] == [r.prob for r in got]
    val = rows.filter("region = 'r'").withColumn("target", F.when(F.rand(1) < 0.5, 1.0).otherwise(0.0))  # noise: more trees don't help
    early = model.fit(rows, ["a", "b"], trees=30, rate=0.3, depth=3, least=5, validation=val)
    assert model.trees_of(early) < 30
    past = model.history(m, train=rows, val=val).orderBy("iteration").collect()
    assert len(past) == 10 and past[-1].train < past[0].train and set(past[0].asDict()) == {"iteration", "train", "val"}
    assert model.average_precision(model.predict(m, rows.withColumn("target", (F.col("a") > 0.5).cast("double")))) > 0.95
    heavy = model.fit(rows.withColumn("target", (F.col("a") > 0.9).cast("double")), ["b"], trees=3, depth=1, least=5, positive_weight=9.0)
    assert model.predict(heavy, rows).agg(F.avg("prob")).first()[0] > 0.3


def test_stream(spark, tmp_path):
    from pixelloom.streaming import monthly

    schema = PX + ", year int, month int, b08 double, b04 double, b11 double"
    rows = [("t", 0, c, 2020 + (m > 6), m, 0.1 * m, 0.1, 0.2) for c in range(3) for m in range(1, 13)]
    for part in (rows[:20], rows[20:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        src = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        monthly.keep_annual(spark, src, str(tmp_path / "landing"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    cols = ["tile_id", "row", "col", "year", "n_obs", "median_ndvi", "slope_ndvi"]
    landed = sorted(str(p.relative_to(tmp_path / "landing")) for p in (tmp_path / "landing").glob("*/*/*"))
    assert landed == ["in_year=2020/in_tile=t/batch=0", "in_year=2020/in_tile=t/batch=1", "in_year=2021/in_tile=t/batch=0", "in_year=2021/in_tile=t/batch=1"]
    got = spark.read.parquet(str(tmp_path / "out")).select(*cols)
    want = satellite.s2_annual(spark.createDataFrame(rows, schema)).select(*cols)
    near = lambda df: sorted((*r[:5], round(r[5], 9), round(r[6], 9)) for r in df.collect())
    assert near(got) == near(want)
