import itertools

import numpy as np
import pytest

from pixelloom.operators import satellite
from pixelloom.sources import geotiff, layout


@pytest.mark.parametrize("dtype,tile,planar,compress,order", [*itertools.product(["uint8", "uint16", "int32", "float32", "float64"], [None, 16], [False, True], [False, True], "<>")])
def test_round_trip(dtype, tile, planar, compress, order):
    x = (np.random.default_rng(0).random((3, 70, 37)) * 200).astype(dtype)
    got = geotiff.decode(geotiff.encode(x, (10.0, 0, 500000.0, 0, -10.0, 400000.0), 32618, tile=tile, planar=planar, compress=compress, predictor=dtype != "float32" and dtype != "float64", order=order))
    assert np.array_equal(got.bands, x) and got.bands.dtype == np.dtype(dtype)
    assert got.transform == (10.0, 0.0, 500000.0, 0.0, -10.0, 400000.0) and got.epsg == 32618


def pack_lzw(data):
    """Literal codes with a clear code before the width would grow."""
    bits, out = "", []
    for i in range(0, len(data), 200):
        bits += f"{256:09b}" + "".join(f"{b:09b}" for b in data[i : i + 200])
    bits += f"{257:09b}"
    bits += "0" * (-len(bits) % 8)
    return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)) + bytes(out)


def test_lzw():
    data = bytes(np.random.default_rng(1).integers(0, 256, 1500, dtype=np.uint8))
    assert geotiff._lzw(pack_lzw(data)) == data
    # the specification's example: codes 256 7 258 8 8 258 6 6 257
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    bits += "0" * (-len(bits) % 8)
    assert geotiff._lzw(bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])


def test_bad_files():
    with pytest.raises(ValueError):
        geotiff.decode(b"XX" + bytes(20))


def test_relations(spark, tmp_path):
    rng = np.random.default_rng(2)
    place = (10.0, 0, 500000.0, 0, -10.0, 400000.0)
    for month in (1, 2):
        p = tmp_path / layout.path("x", "s2", tile="18NWG_1", year=2020, month=month)[2:]
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(geotiff.encode(rng.integers(1, 9000, (12, 5, 4), dtype=np.uint16), place, 32618))
    power = np.array([[[1.0, 0.0], [np.nan, 10.0]]], np.float32)
    p = tmp_path / layout.path("x", "s1", tile="18NWG_1", year=2020, month=3, orbit="Ascending")[2:]
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_bytes(geotiff.encode(power, place))
    raster = geotiff.files(spark, str(tmp_path))
    assert {(r.height, r.width, r.bands, r.dtype) for r in geotiff.profiles(raster).collect()} == {(5, 4, 12, "uint16"), (2, 2, 1, "float32")}
    px = geotiff.pixels(raster, rows=2)
    s2 = geotiff.s2(px)
    assert s2.count() == 40 and s2.select("tile_id", "year").distinct().collect() == [("18NWG_1", 2020)]
    row = s2.filter("month = 1 and row = 3 and col = 2").first()
    want = geotiff.decode((tmp_path / layout.path("x", "s2", tile="18NWG_1", year=2020, month=1)[2:]).read_bytes()).bands[:, 3, 2]
    assert [row[b] for b in geotiff.S2_BANDS] == [pytest.approx(v / 10000) for v in want]
    s1 = satellite.s1_annual(geotiff.s1(px)).orderBy("row", "col").collect()
    assert [r.mean_vv for r in s1] == [0.0, None, None, 10.0]
    emb = tmp_path / "aef-embeddings/train"
    emb.mkdir(parents=True)
    (emb / "18NWG_1_2021.tiff").write_bytes(geotiff.encode(rng.normal(size=(8, 3, 3)).astype(np.float32), place))
    a = geotiff.aef(geotiff.pixels(geotiff.files(spark, str(emb))))
    assert a.count() == 9 and a.first().tile_id == "18NWG_1" and a.first().year == 2021 and len(a.first().emb) == 8
