import json

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from pixelloom.functions import warp
from pixelloom.operators import blocks, terrain
from pixelloom.sources import filesink, geotiff, rasters, sinks

PX = "tile_id string, row int, col int"
PLACE = (10.0, 0.0, 500000.0, 0.0, -10.0, 400000.0)


@pytest.fixture
def folder(tmp_path):
    rng = np.random.default_rng(0)
    kinds = {"a.tif": dict(tile=16), "b.tif": dict(tile=None), "c.tif": dict(tile=32, planar=True, predictor=True), "d.tif": dict(compress=False)}
    made = {}
    for name, how in kinds.items():
        x = rng.integers(0, 9000, (3, 150, 133)).astype(np.uint16)
        (tmp_path / name).write_bytes(geotiff.encode(x, PLACE, 32618, **how))
        made[name] = x
    return tmp_path, made


def test_same_pixels_as_whole_files(spark, folder):
    path, made = folder
    got = rasters.pixels(rasters.blocks(spark, str(path), block=64)).withColumn("path", F.element_at(F.split("path", "/"), -1))
    want = geotiff.pixels(geotiff.files(spark, str(path))).withColumn("path", F.element_at(F.split("path", "/"), -1))
    assert got.count() == 4 * 150 * 133 and got.exceptAll(want).count() == 0
    one = rasters.blocks(spark, str(path / "a.tif"), block=64).collect()
    assert len(one) == 3 * 3 and {(r.raster_height, r.raster_width, r.bands, r.dtype, r.epsg, r.c, r.f) for r in one} == {(150, 133, 3, "uint16", 32618, 500000.0, 400000.0)}


def test_windows_and_bands(spark, folder):
    path, made = folder
    got = rasters.blocks(spark, str(path), block=64, rows="70:75", cols="60:70", bands="2,0").collect()
    assert len(got) == 4 * 2
    for r in got:
        x = np.frombuffer(r.data, "<u2").reshape(2, r.rows, r.cols)
        assert (x == made[r.path.rsplit("/", 1)[1]][[2, 0], r.row0 : r.row0 + r.rows, r.col0 : r.col0 + r.cols]).all()


def test_filters_reach_the_source(spark, folder):
    path, _ = folder
    x = rasters.blocks(spark, str(path), block=64)
    one = x.filter((F.col("block_row") >= 1) & (F.col("block_row") < 2) & (F.col("col0") <= 64) & (F.col("path") == str(path / "b.tif")))
    assert {(r.path.rsplit("/", 1)[1], r.block_row, r.block_col) for r in one.collect()} == {("b.tif", 1, 0), ("b.tif", 1, 1)}
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan" in plan and "Filter (" not in plan
    # an empty selection, and filters that the source can't take
    assert x.filter("block_row > 9").count() == 0 and x.filter("rows * 2 = 44 and block_col = 2").count() == 4


def test_bytes_read(tmp_path):
    """A header takes some kilobytes, a window the tiles that it meets."""
    rng = np.random.default_rng(1)
    data = geotiff.encode(rng.integers(0, 1 << 16, (4, 1024, 1024), dtype=np.uint16), PLACE, 32618, tile=128)
    p = tmp_path / "x.tif"
    p.write_bytes(data)
    with rasters.opened(str(p)) as source:
        f = geotiff.File(source)
        assert (f.head.height, f.head.bands) == (1024, 4) and f.src.count <= 3 * f.src.AHEAD and len(data) > 8_000_000
        before = f.src.count
        f.window(130, 140, 300, 310)
        tile = max(f.tags[geotiff.TILE_BYTES])
        assert f.src.count - before <= tile + f.src.AHEAD
        before = f.src.count
        f.window(100, 140, 300, 310)  # two tiles
        assert f.src.count - before <= 2 * tile + 2 * f.src.AHEAD


def test_shares_of_a_large_file(spark, folder, monkeypatch):
    path, _ = folder
    monkeypatch.setattr(rasters, "SHARE_BYTES", 20_000)
    reader = rasters._BlockReader({"path": str(path), "block": "16"})
    parts = reader.partitions()
    assert len(parts) > 8
    got = [(b.column(0)[0].as_py(), b.column(1)[0].as_py(), b.column(2)[0].as_py()) for p in parts for b in reader.read(p)]
    assert len(got) == len(set(got)) == 4 * 10 * 9


def test_pack_and_unpack(spark):
    rng = np.random.default_rng(2)
    cells = [(t, r, c, float(rng.normal()), None if rng.random() < 0.1 else float(r * c)) for t in ("x", "y") for r in range(40) for c in range(35) if rng.random() < 0.7]
    px = spark.createDataFrame(cells, PX + ", p double, q double").repartition(5)
    packed = blocks.pack(px, ["p", "q"], side=16)
    assert packed.count() == 2 * 3 * 3
    back = {(r.tile_id, r.row, r.col): (r.p, r.q) for r in blocks.unpack(packed, ["p", "q"]).collect() if r.p is not None}
    assert back == {(t, r, c): (p, q) for t, r, c, p, q in cells}


@pytest.mark.parametrize("bilinear", [True, False])
def test_warp_equals_pixels(spark, bilinear):
    """Onto a coarser, shifted grid of the same system that reaches beyond the source, and onto one in degrees."""
    rng = np.random.default_rng(3)
    src = spark.createDataFrame([("t", r, c, float(rng.normal())) for r in range(50) for c in range(60) if rng.random() < 0.95], PX + ", z double")
    source = (10.0, 0.0, 500000.0, 0.0, -10.0, 400000.0)
    lon, lat = -75.0, 3.6186
    step = 0.00017
    for target, epsg in (((23.0, 0.0, 499960.0, 0.0, -23.0, 400070.0), 32618), ((4.0, 0.0, 500100.0, 0.0, -4.0, 399900.0), 32618), ((step, 0.0, lon, 0.0, -step, lat), 4326)):
        grid = terrain.target_grid(src, 45, 41)
        systems = (epsg, 32618)
        want = terrain.warp_bilinear(src, grid, target, source, ["z"], systems, empty=-1.0) if bilinear else terrain.warp_nearest(src, grid, target, source, "z", -1.0, systems)
        place = spark.createDataFrame([("t", 50, 60, *source, 32618, 45, 41, *target, epsg)], "tile_id string, height int, width int, a double, b double, c double, d double, e double, f double, epsg int, t_height int, t_width int, t_a double, t_b double, t_c double, t_d double, t_e double, t_f double, t_epsg int")
        got = blocks.unpack(blocks.warp(blocks.pack(src, ["z"], side=16), place, bilinear=bilinear, empty=-1.0, side=16), ["z"])
        w, g = ({(r.row, r.col): r.z for r in x.collect()} for x in (want, got))
        assert set(w) == set(g) and all(g[k] == pytest.approx(w[k], abs=1e-9) for k in w) and len({round(v, 6) for v in g.values()}) > 100


def shuffled(spark, df):
    """Bytes that a query's stages write for exchanges."""
    sc, store = spark.sparkContext, spark.sparkContext._jsc.sc().statusStore()
    seen = lambda: {(x.stageId(), x.attemptId()): x.shuffleWriteBytes() for x in (lambda l: [l.apply(i) for i in range(l.size())])(store.stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None))}
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    before = seen()
    df.write.format("noop").mode("overwrite").save()
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    return sum(n for k, n in seen().items() if k not in before)


def test_warp_exchanges_little(spark):
    """A fifth at most of what a warp of pixel rows exchanges, for rasters that are there as blocks; less than it from pixels on."""
    rng = np.random.default_rng(6)
    src = spark.createDataFrame([("18NWA_0", r, c, float(np.float32(rng.normal()))) for r in range(200) for c in range(200)], PX + ", z double").cache()
    target, source = (25.0, 0.0, -40.0, 0.0, -25.0, 60.0), (10.0, 0.0, 0.0, 0.0, -10.0, 0.0)
    place = spark.createDataFrame([("18NWA_0", 200, 200, *source, None, 90, 90, *target, None)], "tile_id string, height int, width int, a double, b double, c double, d double, e double, f double, epsg int, t_height int, t_width int, t_a double, t_b double, t_c double, t_d double, t_e double, t_f double, t_epsg int")
    packed = blocks.pack(src, ["z"]).cache()
    packed.count()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # else the small side of a fixture isn't exchanged at all
    try:
        pixels = shuffled(spark, terrain.warp_bilinear(src, terrain.target_grid(src, 90, 90), target, source, ["z"]))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    own = shuffled(spark, blocks.warp(packed, place, bilinear=True, empty=0.0))
    packing = shuffled(spark, blocks.pack(src, ["z"]))
    assert 0 < own <= pixels / 5
    assert own + packing < pixels


def test_slope_equals_pixels(spark):
    rng = np.random.default_rng(4)
    z = rng.normal(size=(9, 7))
    got = warp.slope(z, 30.0, 20.0)
    dem = spark.createDataFrame([("t", r, c, float(z[r, c])) for r in range(9) for c in range(7)], PX + ", elevation double")
    assert all(got[r.row, r.col] == pytest.approx(r.slope, abs=1e-9) for r in terrain.slope(dem, 30.0, 20.0).collect())


def test_files_of_rows(spark, tmp_path):
    rows = spark.createDataFrame([(f"sub{i % 3}/f{i}.bin", bytes([i]) * i) for i in range(20)], "name string, content binary").repartition(4)
    filesink.write_files(rows, str(tmp_path / "out"))
    filesink.write_files(rows.limit(0), str(tmp_path / "out"))
    got = {str(p.relative_to(tmp_path / "out")): p.read_bytes() for p in (tmp_path / "out").rglob("*") if p.is_file()}
    assert got == {f"sub{i % 3}/f{i}.bin": bytes([i]) * i for i in range(20)}


def feats(spark, n=300):
    return spark.createDataFrame([(f"t{i % 7}", i, json.dumps({"type": "Feature", "properties": {"i": i}, "geometry": None})) for i in range(n)], "tile_id string, comp_id long, feature string")


def test_document_of_many_tasks(spark, tmp_path):
    for n in (300, 1, 0):
        filesink.write_document(feats(spark, n), str(tmp_path / f"many{n}"))
        sinks.write_geojson(feats(spark, n), str(tmp_path / f"one{n}"))
        got = (tmp_path / f"many{n}/part-00000.json").read_text()
        assert got == "".join(p.read_text() for p in sorted((tmp_path / f"one{n}").glob("part-*")))
        assert len(json.loads(got)["features"]) == n and [p.name for p in (tmp_path / f"many{n}").iterdir()] == ["part-00000.json"]


def test_retried_tasks_leave_nothing(tmp_path):
    """Two attempts of one task, one of which fails on the way: only what was told to the driver counts; an abort removes all."""
    row = lambda t, i: Row(tile_id=t, comp_id=i, feature=json.dumps({"i": i}))

    def broken():
        yield row("a", 1)
        raise OSError("lost")

    w = filesink._GeoJsonWriter(str(tmp_path))
    with pytest.raises(OSError):
        w.write(broken())
    late = w.write(iter([row("b", 3)]))
    again = w.write(iter([row("a", 1), row("a", 2)]))
    w.write(iter([row("a", 1), row("a", 2)]))  # a speculative twin, not told
    w.commit([late, again, w.write(iter([]))])
    assert [f["i"] for f in json.loads((tmp_path / "part-00000.json").read_text())["features"]] == [1, 2, 3]
    assert [p.name for p in tmp_path.iterdir()] == ["part-00000.json"]
    w = filesink._GeoJsonWriter(str(tmp_path / "x"))
    w.abort([w.write(iter([row("a", 1)]))])
    assert list((tmp_path / "x").iterdir()) == []
