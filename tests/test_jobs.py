import json
import shutil
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelloom.functions import pixel as fn
from pixelloom.operators import labels, model
from pixelloom.plans import jobs
from pixelloom.sources import dataset, geotiff, layout, sinks
from test_pixels import np_ops

PX = "tile_id string, row int, col int"


def relations(spark, n=14):
    rng = np.random.default_rng(0)
    s2, weak, emb = [], [], []
    for t in ("18NWA_0", "19NWB_1"):
        for r in range(n):
            for c in range(n):
                lost = 3 <= r < 9 and 3 <= c < 10
                for y in (2020, 2021):
                    for m in (1, 6):
                        gone = lost and y == 2021
                        s2.append((t, r, c, y, m, float(0.2 if gone else 0.8 + 0.02 * rng.normal()), 0.15, 0.2))
                    emb.append((t, r, c, y, [float(v) for v in rng.normal(size=4) + (3 if lost and y == 2021 else 0)]))
                weak.append((t, r, c, "a", 0.95 if lost else 0.0, 18700 if lost else 0))
                weak.append((t, r, c, "b", 0.8 if lost and c < 8 else 0.0, 18720 if lost and c < 8 else 0))
    obs = spark.createDataFrame(s2, PX + ", year int, month int, b08 double, b04 double, b11 double")
    return jobs.Relations(cells=obs.select("tile_id", "row", "col").distinct(), s2=obs, aef=spark.createDataFrame(emb, PX + ", year int, emb array<double>"), weak=spark.createDataFrame(weak, PX + ", source string, confidence double, days int")), n


def test_train_predict_tune(spark):
    rel, n = relations(spark)
    conf = jobs.settings({"sampling": {"total_positives": 60, "total_negatives": 120}, "model": {"trees": 5, "rate": 0.3, "depth": 3, "least": 2}, "polygons": {"least": 0.5, "open_n": 1, "close_n": 0, "min_ha": 0.1}, "grid": {"thresholds": [0.5], "opens": [0, 1], "closes": [0], "areas": [0.0]}})
    feats = jobs.features(rel, 2020, 2021, dims=4).cache()
    fused = labels.fuse(rel.weak).cache()
    forest = jobs.forest_mask(jobs.Relations(rel.cells, s2=rel.s2), 2020)
    assert forest.filter("forest").count() == 2 * n * n
    assert jobs.forest_mask(jobs.Relations(rel.cells), 2020).filter("forest").count() == 2 * n * n
    assert 0 < jobs.forest_mask(rel, 2020).filter("forest").count() < 2 * n * n
    rows = jobs.training_set(feats, fused, forest, conf).cache()
    fitted = jobs.train(rows, conf)
    m = jobs.meta(rows, fitted, conf)
    assert m["n_pos"] == 56 and m["n_neg"] == 120 and m["train_tiles"] == ["18NWA_0", "19NWB_1"] and m["best_iteration"] == 5 and len(m["feature_names"]) == 3 * 4 + 32
    prob = jobs.predict(fitted, feats, forest).cache()
    got = jobs.submit(prob, conf, n, n, fused).collect()
    assert {(r.tile_id, r.time_step) for r in got} == {("18NWA_0", 2103), ("19NWB_1", 2103)}
    assert all(30 <= r.n_px <= 42 for r in got)  # of a 6 x 7 clearing, whose corners an opening removes
    best = jobs.tune(prob, fused, conf, n, n).first()
    assert best.mean_iou > 0.9 and best.combo in (0, 1) and best.mean_recall == 1.0
    cv = jobs.cross_validate(rows, feats, forest, fused, conf, n, n).collect()
    assert [(r.region, r.tile_id, r.error) for r in cv] == [("18NWA", "18NWA_0", None), ("19NWB", "19NWB_1", None)] and all(r.union_iou > 0.5 and r.n_gt == 1 for r in cv)
    # a tile without labels, and a fold whose training fails
    cv = jobs.cross_validate(rows.filter("region = '18NWA'"), feats, forest, fused.filter("tile_id = '18NWA_0'"), conf, n, n).collect()
    assert [(r.region, r.tile_id) for r in cv] == [("18NWA", None), ("19NWB", "19NWB_1")] and cv[0].error.startswith("training failed") and cv[1].error == "no weak labels"
    assert jobs.submit(prob, conf, n, n).filter(F.col("time_step").isNotNull()).count() == 0


def write(folder, kind, bands, place, epsg, **parts):
    p = folder / layout.path("x", kind, **parts)[2:]
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_bytes(geotiff.encode(bands, place, epsg))


#: Tiles of the folder: rows, columns, and cell size in metres.
TILES = {"18NWA_0": (16, 16, 10.0), "19NBD_1": (24, 20, 20.0)}
STRIP = 3  # columns at the right that were never forest


def dataset_folder(folder, tiles=TILES):
    """Two tiles of different sizes in two UTM zones, one of 20 m cells; embeddings and a label source in degrees, radar on a coarser grid, a late scene that is shifted."""
    rng = np.random.default_rng(1)
    for tile, (n, w, cell) in tiles.items():
        zone = int(tile[:2])
        e0, n0 = 500000.0, 400000.0
        place, lost = (cell, 0, e0, 0, -cell, n0), np.zeros((n, w), bool)
        lost[4:11, 4:11] = True
        bare = np.arange(w)[None] >= w - STRIP
        for y in (2020, 2021):
            gone = lost & (y == 2021)
            for m in (1, 6):
                x = np.zeros((12, n, w), np.uint16)
                x[7], x[3], x[10] = np.where(gone | bare, 2000, 8000) + rng.integers(0, 50, (n, w)), 1500, 2000
                if (y, m) == (2021, 6):  # the same ground, one cell to the east and north
                    x = np.pad(x, ((0, 0), (0, 1), (1, 0)), mode="edge")[:, 1:, :-1]
                    write(folder, "s2", x, (cell, 0, e0 - cell, 0, -cell, n0 - cell), 32600 + zone, tile=tile, year=y, month=m)
                else:
                    write(folder, "s2", x, place, 32600 + zone, tile=tile, year=y, month=m)
                write(folder, "s1", np.full((1, n // 2, w // 2), 10.0, np.float32), (2 * cell, 0, e0, 0, -2 * cell, n0), 32600 + zone, tile=tile, year=y, month=m, orbit="ascending")
            lon, lat = fn.utm_to_lonlat(e0 - 5 * cell, n0 + 5 * cell, zone, ops=np_ops)
            step = cell / 111_000
            emb = rng.normal(size=(4, n + 12, w + 12)).astype(np.float32) * 0.01 + y % 100
            emb[0, :, w + 5 - STRIP :] -= 0.5  # bare ground differs in the first dimension
            write(folder, "aef", emb, (step, 0, lon, 0, -step, lat), 4326, tile=tile, year=y)
        code = np.where(lost, 30000 + 2300, 0).astype(np.int32)[None]
        write(folder, "radd", code, place, 32600 + zone, tile=tile)
        lon, lat = fn.utm_to_lonlat(e0, n0, zone, ops=np_ops)
        write(folder, "gladl_alert", np.where(lost, 3, 0).astype(np.uint8)[None], (cell / 111_195, 0, lon, 0, -cell / 110_600, lat), 4326, tile=tile, yy=21)
        write(folder, "gladl_date", np.where(lost, 90, 0).astype(np.uint16)[None], (cell / 111_195, 0, lon, 0, -cell / 110_600, lat), 4326, tile=tile, yy=21)
    return tiles


def elevation_folder(folder, tiles=TILES):
    """A plane that rises to the north, cut into two rasters of a degree each; only the part around the tiles exists."""
    folder.mkdir(parents=True, exist_ok=True)
    for tile in tiles:
        west = int(tile[:2]) * 6 - 183
        for lon, name in ((west, f"W{-west:03d}"), (west - 1, f"W{-west + 1:03d}")):
            step, left, top = 0.001, lon if lon == west else west - 0.02, 3.64
            lat = top - (np.arange(60) + 0.5) * step
            z = np.repeat(((lat - 3.6) * 10_000)[:, None], 20, 1).astype(np.float32)
            (folder / f"Copernicus_DSM_COG_10_N03_00_{name}_00_DEM.tif").write_bytes(geotiff.encode(z[None], (step, 0, left, 0, -step, top), 4326))


def test_from_folder(spark, tmp_path):
    root = tmp_path / "data"
    dataset_folder(root)
    rel = dataset.load(spark, str(root))
    grid = {r.tile_id: (r.height, r.width, r.a, r.c, r.f, r.epsg) for r in rel.grid.collect()}
    assert grid == {"18NWA_0": (16, 16, 10.0, 500000.0, 400000.0, 32618), "19NBD_1": (24, 20, 20.0, 500000.0, 400000.0, 32619)}
    n, cells = 16, 16 * 16 + 24 * 20
    s2 = rel.s2.filter("tile_id = '18NWA_0'").cache()
    assert s2.count() == 4 * n * n and s2.filter("b04 > 0.14 and b04 < 0.16").count() == 4 * n * n - (2 * n - 1)
    assert s2.filter("b04 = 0").filter("row = 0 or col = 15").count() == 2 * n - 1  # where the shifted scene has nothing
    late = s2.filter("year = 2021 and month = 6 and b08 < 0.3 and b04 > 0").filter(f"col < {n - STRIP}").select("row", "col").collect()
    assert {tuple(r) for r in late} == {(i, j) for i in range(4, 11) for j in range(4, 11)}
    s1 = rel.s1.collect()
    assert len(s1) == 4 * cells and all(r.vv_db == pytest.approx(10.0) for r in s1)
    aef = rel.aef.collect()
    assert len(aef) == 2 * cells and all(abs(v - r.year % 100) < 0.1 for r in aef for v in r.emb[1:])
    fused = labels.fuse(rel.weak).cache()
    assert fused.count() == cells
    yes = {tuple(r) for r in fused.filter("binary = 1 and tile_id = '18NWA_0'").select("row", "col").collect()}
    assert {(i, j) for i in range(4, 11) for j in range(4, 11)} <= yes and len(yes) <= 81
    assert fused.filter("agree_count = 2").count() >= 2 * 36
    with pytest.raises(FileNotFoundError):
        dataset.load(spark, str(root), tiles=["18NWA_0", "nowhere"], strict=True)


def test_elevation_from_folder(spark, tmp_path):
    root, dem = tmp_path / "data", tmp_path / "dem"
    dataset_folder(root)
    elevation_folder(dem)
    grid = dataset.load(spark, str(root)).grid
    got = dataset.elevation(spark, str(dem), grid).collect()
    assert len(got) == 16 * 16 + 24 * 20
    for r in got:
        cell, zone = TILES[r.tile_id][2], int(r.tile_id[:2])
        _, lat = fn.utm_to_lonlat(500000.0 + (r.col + 0.5) * cell, 400000.0 - (r.row + 0.5) * cell, zone, ops=np_ops)
        assert r.elevation == pytest.approx((lat - 3.6) * 10_000, abs=0.01)
        assert r.slope == pytest.approx(np.degrees(np.arctan(10_000 / 110_540)), abs=0.01)
    for p in dem.glob("*W069*"):
        p.unlink()
    for p in dem.glob("*W070*"):
        p.unlink()
    with pytest.raises(FileNotFoundError, match="19NBD_1"):
        dataset.elevation(spark, str(dem), grid)
    assert dataset.elevation(spark, str(tmp_path / "none"), grid) is None


def test_tiles_keep_their_own_sizes(spark):
    """A closing cuts at each tile's own border, and areas follow its own cells, whatever tiles run together."""
    full = [("s", r, c, 1.0) for r in range(10) for c in range(10)]
    large = [("l", r, c, 1.0) for r in range(20) for c in range(20)]
    grid = spark.createDataFrame([("s", 10, 10, 10.0, 0.0, 0.0, 0.0, -10.0, 0.0, 32618), ("l", 20, 20, 20.0, 0.0, 0.0, 0.0, -20.0, 0.0, 32618)], "tile_id string, height int, width int, a double, b double, c double, d double, e double, f double, epsg int")
    conf = jobs.settings({"polygons": {"least": 0.5, "open_n": 0, "close_n": 3, "min_ha": 0.0}})
    one = jobs.submit(spark.createDataFrame(full, PX + ", prob double"), conf, 10, 10).first()
    both = {r.tile_id: r for r in jobs.submit(jobs.placed(spark.createDataFrame(full + large, PX + ", prob double"), grid), conf, **jobs.SIZES).collect()}
    assert both["s"].n_px == one.n_px == 16 and both["s"].area_ha == one.area_ha == pytest.approx(0.16)
    assert both["l"].n_px == 14 * 14 and both["l"].area_ha == pytest.approx(14 * 14 * 400 / 10_000)
    assert set(both["s"].asDict()) == {"tile_id", "comp_id", "n_px", "area_ha", "time_step"}


def test_jobs_over_a_folder(spark, tmp_path):
    root, out, dem = tmp_path / "data", str(tmp_path / "out"), str(tmp_path / "dem")
    dataset_folder(root)
    elevation_folder(tmp_path / "dem")
    conf = jobs.settings({"sampling": {"total_positives": 60, "total_negatives": 120}, "model": {"trees": 4, "rate": 0.3, "depth": 3, "least": 2}, "polygons": {"least": 0.5, "open_n": 0, "close_n": 1, "min_ha": 0.1}, "grid": {"thresholds": [0.5], "opens": [0, 1], "closes": [0], "areas": [0.1]}, "forest": {"least": 0.1}})
    record = jobs.run_train(spark, str(root), out, conf, dims=4, dem=dem)
    assert record["train_tiles"] == ["18NWA_0"] and record["val_tiles"] == ["19NBD_1"] and record["n_pos"] > 30 and 1 <= record["best_iteration"] <= 4
    history = spark.read.json(f"{out}/history").orderBy("iteration").collect()
    assert sinks.read_record(spark, f"{out}/meta") == record and len(history) == record["best_iteration"] and all(0 < r.average_precision <= 1 for r in history)
    best = jobs.run_tune(spark, str(root), f"{out}/model", f"{out}/tuned", conf, tiles=sorted(TILES), dims=4, dem=dem)
    report = sinks.read_record(spark, f"{out}/tuned.report")
    assert sinks.read_record(spark, f"{out}/tuned") == best and len(report["all"]) == 2 and report["best"]["mean_recall"] == 1.0 and report["best"]["mean_iou"] > 0.5
    shutil.copytree(root / "sentinel-2/train", root / "sentinel-2/test")
    shutil.copytree(root / "sentinel-1/train", root / "sentinel-1/test")
    shutil.copytree(root / "aef-embeddings/train", root / "aef-embeddings/test")
    got = jobs.run_predict(spark, str(root), f"{out}/model", f"{out}/geojson", conf, tiles=sorted(TILES), tuned=f"{out}/tuned", dims=4, dem=dem).collect()
    assert {r.tile_id for r in got} == set(TILES) and all(r.time_step is None for r in got)
    assert all(r.area_ha == pytest.approx(r.n_px * TILES[r.tile_id][2] ** 2 / 10_000) for r in got)
    doc = json.loads("".join(p.read_text() for p in sorted((tmp_path / "out/geojson").glob("part-*"))))
    lon, lat = doc["features"][0]["geometry"]["coordinates"][0][0]
    assert abs(lon + 75) < 0.01 and abs(lat - 3.617) < 0.01
    with pytest.raises(FileNotFoundError):
        jobs.run_predict(spark, str(root), f"{out}/model", f"{out}/x", conf, tiles=["nowhere"], dims=4)


def test_cross_validation_over_a_folder(spark, tmp_path):
    root, out = tmp_path / "data", str(tmp_path / "cv")
    dataset_folder(root)
    conf = jobs.settings({"sampling": {"total_positives": 60, "total_negatives": 120}, "model": {"trees": 3, "rate": 0.3, "depth": 3, "least": 2}, "polygons": {"least": 0.5, "open_n": 0, "close_n": 0, "min_ha": 0.1}, "forest": {"least": 0.1}})
    got = {r.region: r for r in jobs.run_cross_validate(spark, str(root), out, conf, dims=4).collect()}
    assert set(got) == {"18NWA", "19NBD"} and all(r.error is None and r.n_gt == 1 and r.union_iou > 0.5 for r in got.values())
    report = {r.region: r for r in spark.read.json(out).collect()}
    assert set(report) == set(got) and all(len(r.tiles) == 1 for r in report.values())


def test_folds_run_together_and_fail_alone(spark):
    """Work that fails ends as its exception, with its own jobs cancelled; the others run on, at the same time."""
    begun = time.time()
    wait = F.pandas_udf(lambda s: (time.sleep(2), s)[1], "long")

    def fine(k):
        return [k, spark.range(4, numPartitions=1).select(wait("id").alias("x")).agg(F.sum("x")).first()[0]]

    def bad():
        spark.range(4).select(F.raise_error(F.lit("no such fold"))).collect()

    got = jobs.together(spark, {"a": lambda: fine(1), "b": bad, "c": lambda: fine(3)}, 3)
    assert got["a"] == [1, 6] and got["c"] == [3, 6] and "no such fold" in str(got["b"])
    assert time.time() - begun < 30 and not spark.getTags()


def test_patience():
    assert model.best_iteration([5.0, 4.0, 4.0, 4.1, 4.2, 3.0, 3.5], 50) == 6  # past a plateau of three
    assert model.best_iteration([5.0, 4.0, 4.0, 4.1, 4.2, 3.0, 3.5], 3) == 2
    assert model.best_iteration([1.0, 2.0], 1) == 1


def test_fit_with_validation(spark, tmp_path):
    rng = np.random.default_rng(4)
    make = lambda n: spark.createDataFrame([(float(a), float(b), float((a > 0) != (b > 0)) if rng.random() < 0.8 else float(rng.integers(2)), 1.0) for a, b in rng.normal(size=(n, 2))], "x double, y double, target double, weight double")
    rows, held = make(400).cache(), make(200).cache()
    args = {"trees": 24, "rate": 0.5, "depth": 2, "least": 5, "share": 1.0, "columns": 1.0}
    fitted = model.fit(rows, ["x", "y"], validation=held, patience=4, **args)
    whole = model.fit(rows, ["x", "y"], **args)
    losses = model.losses_of(whole, held)
    best = model.best_iteration(losses, 4)
    assert model.trees_of(fitted) == best < 24
    model.save(fitted, str(tmp_path / "m"))
    again = model.load(str(tmp_path / "m"))
    assert model.trees_of(again) == best and model.losses_of(again, held) == pytest.approx(losses[:best])
    got = [r.average_precision for r in model.precision_history(fitted, held).collect()]
    assert len(got) == best
    p = [(r.prob, r.target) for r in model.predict(again, held).collect()]
    order = sorted(p, reverse=True)
    hits = np.cumsum([t for _, t in order])
    ends = [i for i in range(len(order)) if i + 1 == len(order) or order[i + 1][0] != order[i][0]]
    want = sum((hits[i] - (hits[j] if j >= 0 else 0)) / hits[-1] * hits[i] / (i + 1) for j, i in zip([-1, *ends], ends))
    assert got[-1] == pytest.approx(want, abs=0.01)
