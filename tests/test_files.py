import http.server
import threading

import numpy as np
import pytest

from pixelloom.operators import raster, render
from pixelloom.sources import landing, png

PX = "tile_id string, row int, col int"


def test_png_round_trip():
    x = np.random.default_rng(0).integers(0, 256, (17, 23, 3)).astype(np.uint8)
    assert (png.decode(png.encode(x)) == x).all()
    with pytest.raises(ValueError):
        png.decode(b"nothing")
    bad = bytearray(png.encode(x))
    bad[50] ^= 1
    with pytest.raises(ValueError):
        png.decode(bytes(bad))


@pytest.mark.parametrize("ends", [(0, 0, 7, 3), (7, 3, 0, 0), (2, 9, 4, 0), (5, 5, 5, 5), (3, 1, 3, 8), (9, 2, 1, 2)])
def test_lines(ends):
    x0, y0, x1, y1 = ends
    x, y = render.line(*ends)
    assert (x[0], y[0], x[-1], y[-1]) == ends and len(x) == max(abs(x1 - x0), abs(y1 - y0)) + 1
    if len(x) > 1:
        assert max(np.abs(np.diff(x)).max(), np.abs(np.diff(y)).max()) == 1
        t = np.arange(len(x)) / (len(x) - 1)
        assert (np.abs(x - (x0 + t * (x1 - x0))) <= 0.5).all() and (np.abs(y - (y0 + t * (y1 - y0))) <= 0.5).all()


def test_pictures_with_outlines(spark, tmp_path):
    """Files of pictures equal a drawing by hand: tiles of several blocks, missing cells, a tile without polygons, and one without pixels."""
    rng = np.random.default_rng(1)
    size = {"a": (200, 150), "b": (30, 40), "c": (5, 6)}
    rows, on = [], {}
    for t in "ab":
        h, w = size[t]
        for r in range(h):
            for c in range(w):
                if rng.random() < 0.9:
                    on[t, r, c] = [float(v) for v in rng.random(3)]
                    rows.append((t, r, c, *on[t, r, c]))
    rgb = spark.createDataFrame(rows, PX + ", red double, green double, blue double").repartition(3)
    cells = [("a", r, c) for r in range(120, 140) for c in range(100, 150) if (r, c) != (130, 120)] + [("a", 199, 0)]
    comps = raster.components(raster.runs(spark.createDataFrame(cells, PX)))
    sizes = spark.createDataFrame([(t, *s) for t, s in size.items()], "tile_id string, height int, width int")
    render.write_pictures(render.pictures(rgb, raster.outlines(comps).select("tile_id", "rings"), ["red", "green", "blue"], sizes), str(tmp_path))
    assert {p.name for p in tmp_path.iterdir()} == {"a.png", "b.png", "c.png"}
    inside = {(r, c) for _, r, c in cells}
    for t, (h, w) in size.items():
        want = np.zeros((h, w, 3), np.uint8)
        for r in range(h):
            for c in range(w):
                want[r, c] = np.floor(255 * np.array(on.get((t, r, c), (0, 0, 0))))
        if t == "a":
            for r in range(h + 1):
                for c in range(w + 1):
                    around = [(r + i, c + j) in inside for i in (-1, 0) for j in (-1, 0)]
                    if any(around) and not all(around):
                        want[min(r, h - 1), min(c, w - 1)] = render.COLOUR
        assert (png.decode((tmp_path / f"{t}.png").read_bytes()) == want).all()
    files = spark.createDataFrame([(t, (tmp_path / f"{t}.png").read_bytes()) for t in "c"], "tile_id string, content binary")
    assert {tuple(r) for r in render.pixels(files).collect()} == {("c", r, c, 0, 0, 0) for r in range(5) for c in range(6)}


class Server(http.server.BaseHTTPRequestHandler):
    asked: dict = {}

    def do_GET(self):
        n = Server.asked[self.path] = Server.asked.get(self.path, 0) + 1
        name = self.path.rsplit("/", 1)[1]
        if name.startswith("none"):
            return self.send_error(404)
        if name.startswith("down") or (name.startswith("later") and n == 1):
            return self.send_error(503)
        data = name.encode() * 100
        self.send_response(200)
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data[:50] if name.startswith("cut") and n == 1 or name.startswith("short") else data)
        self.close_connection = True

    def log_message(self, *a):
        pass


def test_landing(spark, tmp_path):
    """Missing files, a server that is down, once or always, connections that are cut, files that are there; and the same again."""
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        names = ["good1", "good2", "none", "down", "later", "cut", "short", "here"]
        folder = tmp_path / "dem"
        folder.mkdir()
        (folder / "here.tif").write_bytes(b"x")
        cells = spark.createDataFrame([(n,) for n in names * 3] + [(None,)], "dem string").repartition(5)
        url = f"http://127.0.0.1:{server.server_port}/base/"
        got = {r.path.rsplit("/", 1)[1]: r for r in landing.elevation(cells, str(folder), url, timeout=5.0, wait=0.05).collect()}
        assert {n: got[f"{n}.tif"].status for n in names} == {"good1": "fetched", "good2": "fetched", "none": "missing", "down": "failed", "later": "fetched", "cut": "fetched", "short": "failed", "here": "there"}
        assert got["down.tif"].error == "HTTP 503" and got["short.tif"].error and got["none.tif"].error == "HTTP 404"
        assert Server.asked["/base/none/none.tif"] == 1 and Server.asked["/base/good1/good1.tif"] == 1 and Server.asked["/base/down/down.tif"] == 3 and "/base/here/here.tif" not in Server.asked
        whole = {f"{n}.tif": f"{n}.tif".encode() * 100 for n in ("good1", "good2", "later", "cut")} | {"here.tif": b"x"}
        assert {p.name: p.read_bytes() for p in folder.iterdir()} == whole
        again = {r.path.rsplit("/", 1)[1]: r.status for r in landing.elevation(cells, str(folder), url, timeout=5.0, wait=0.05).collect()}
        assert {n for n, s in again.items() if s == "there"} == set(whole) and Server.asked["/base/good1/good1.tif"] == 1
    finally:
        server.shutdown()
