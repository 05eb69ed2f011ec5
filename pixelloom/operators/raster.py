"""Probability rasters to polygons: threshold, morphology, components, areas, dates.

Whole jobs take shapes(): a raster's cells meet in one exchange, and morphology and components are of one tile at a time. For what is larger than a task should hold, or part of
another plan, the same operations are there on runs:

the foreground is kept as horizontal runs (tile_id, row, c0, c1), inclusive. Opening and closing by n are erosions and dilations by the
L1 ball of radius n. A ball is one interval per row offset, so each operation shifts runs to 2n + 1 rows and counts how often a column
is covered: once is enough for a dilation, all 2n + 1 times for an erosion. Cells outside the tile are background. The rows grow with
runs * (2n + 1), where cells and offsets would give pixels * (2n * n + 2n + 1).

Columns of runs other than row, c0 and c1 are keys: each combination of them is a raster of its own. So many settings go through one plan,
with the setting, or the radius itself, as a column beside tile_id. A tile's height, width and cell area are such keys too: where a function takes them, the name
of a key stands for each tile's own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

PIXEL = ["tile_id", "row", "col"]


def keys_of(x: DataFrame) -> list[str]:
    return [c for c in x.columns if c not in ("row", "col", "c0", "c1")]


def named(*values) -> list[str]:
    """Those of the values that are names of keys."""
    return list(dict.fromkeys(v for v in values if isinstance(v, str)))


def as_column(v) -> Column:
    return F.col(v) if isinstance(v, str) else v if isinstance(v, Column) else F.lit(v)


def threshold(prob: DataFrame, least: float, keys: list[str] = ()) -> DataFrame:
    return prob.filter(F.col("prob") >= F.lit(least)).select(*PIXEL, *keys)


def runs(cells: DataFrame) -> DataFrame:
    """Maximal runs of neighbouring cells of a row."""
    line = [*keys_of(cells), "row"]
    island = F.col("col") - F.row_number().over(W.partitionBy(*line).orderBy("col"))
    return cells.withColumn("i", island).groupBy(*line, "i").agg(F.min("col").alias("c0"), F.max("col").alias("c1")).drop("i")


def cells(r: DataFrame) -> DataFrame:
    return r.select(*keys_of(r), "row", F.explode(F.sequence("c0", "c1")).alias("col"))


def _covered(intervals: DataFrame, times: Column) -> DataFrame:
    """Maximal runs of columns that at least `times` of the row's intervals cover: a sweep over the intervals' ends."""
    line = [*keys_of(intervals), "row"]
    ends = intervals.select(*line, F.explode(F.array(F.struct(F.col("c0").alias("c"), F.lit(1).alias("d")), F.struct((F.col("c1") + 1).alias("c"), F.lit(-1).alias("d")))).alias("e"))
    steps = ends.groupBy(*line, F.col("e.c").alias("c")).agg(F.sum("e.d").alias("d")).filter("d <> 0")
    at = W.partitionBy(*line).orderBy("c")
    x = steps.withColumn("n", F.sum("d").over(at.rowsBetween(W.unboundedPreceding, 0)))
    x = x.withColumn("on", F.col("n") >= times).withColumn("was", F.coalesce(F.lag("on").over(at), F.lit(False))).filter("on <> was")
    return x.withColumn("c1", F.lead("c").over(at) - 1).filter("on").select(*line, F.col("c").alias("c0"), "c1")


def union(r: DataFrame) -> DataFrame:
    """Maximal runs of what any of a tile's runs covers, whatever polygon they are of."""
    return _covered(r.select("tile_id", "row", "c0", "c1"), F.lit(1))


def _shifted(r: DataFrame, n: Column, sign: int) -> DataFrame:
    keys = keys_of(r)
    x = r.withColumn("d", F.explode(F.sequence(-n, n))).withColumn("w", (n - F.abs("d")) * sign)
    return x.select(*keys, (F.col("row") + F.col("d")).alias("row"), (F.col("c0") - F.col("w")).alias("c0"), (F.col("c1") + F.col("w")).alias("c1")).filter("c0 <= c1")


def dilate(r: DataFrame, n: int | str, height: int | str, width: int | str) -> DataFrame:
    """n: a radius, or the name of a key that holds it."""
    x = _shifted(r, as_column(n), 1).filter((F.col("row") >= 0) & (F.col("row") < as_column(height)))
    x = x.withColumns({"c0": F.greatest("c0", F.lit(0)), "c1": F.least(F.col("c1"), as_column(width) - 1)}).filter("c0 <= c1")
    return _covered(x, F.lit(1))


def erode(r: DataFrame, n: int | str) -> DataFrame:
    return _covered(_shifted(r, as_column(n), -1), 2 * as_column(n) + 1)


def opening(r: DataFrame, n: int | str, height: int | str, width: int | str) -> DataFrame:
    return dilate(erode(r, n), n, height, width) if n else r


def closing(r: DataFrame, n: int | str, height: int | str, width: int | str) -> DataFrame:
    return erode(dilate(r, n, height, width), n) if n else r


def _label(row, c0, c1):
    """Labels of runs (sorted by row and column): for each the position of the first run of its 4-connected component.

    Runs that touch are found by binary search in the row above, and labels sink to the least of their neighbours, and to its label, until nothing changes."""
    above = (row - 1) << 21
    lo = np.searchsorted((row << 21) + c1, above + c0, side="left")
    hi = np.searchsorted((row << 21) + c0, above + c1, side="right")
    n = np.maximum(hi - lo, 0)
    a = np.repeat(np.arange(len(row)), n)
    b = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    top = np.arange(len(row))
    while True:
        new = top.copy()
        least = np.minimum(top[a], top[b])
        np.minimum.at(new, top[a], least)
        np.minimum.at(new, top[b], least)
        while (new[new] != new).any():
            new = new[new]
        if (new == top).all():
            return top
        top = new


def components(r: DataFrame) -> DataFrame:
    """4-connected components of a raster's runs; comp_id is the first cell's row * 2**20 + column, in reading order.

    Polygons never cross tiles, and a tile is a bounded raster, so each is one group of at most (its pixels / 2) runs."""
    keys = keys_of(r)

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["row", "c0"], ignore_index=True)
        row, c0, c1 = (pdf[c].to_numpy().astype(np.int64) for c in ("row", "c0", "c1"))
        top = _label(row, c0, c1)
        pdf["comp_id"] = row[top] * (1 << 20) + c0[top]
        return pdf

    x = r.select(*keys, F.col("row").cast("int"), F.col("c0").cast("int"), F.col("c1").cast("int"))
    return x.groupBy(*keys).applyInPandas(label, T.StructType([*x.schema.fields, T.StructField("comp_id", T.LongType())]))


def _spread(x, n: int, outside: bool):
    """A boolean array grown by the L1 ball of radius n, in n steps of one; what lies beyond the array is `outside`."""
    for _ in range(n):
        y = np.pad(x, 1, constant_values=outside)
        x = x | y[:-2, 1:-1] | y[2:, 1:-1] | y[1:-1, :-2] | y[1:-1, 2:]
    return x


def _shrunk(x, n: int):
    """The same ball taken off; beyond the array is background."""
    return ~_spread(~x, n, True)


def shapes(cells: DataFrame, opens: list[int], closes: list[int], height: int | str, width: int | str) -> DataFrame:
    """Components after each opening and closing: keys, open_n, close_n, comp_id, row, c0, c1, n_px (of the component), and head, true for one run of each component.

    cells: keys, row, col. A raster's cells meet in one exchange, and everything that follows is of one tile: openings and closings on a boolean array of the part that the cells
    reach, openings shared by the closings after them, then components. A tile is a bounded raster; its array has a byte for each cell."""
    sides = named(height, width)
    keys = [c for c in keys_of(cells)]
    own = cells.select(*keys, F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"))
    fields = [own.schema[k] for k in keys] + [T.StructField(n, t) for n, t in (("open_n", T.IntegerType()), ("close_n", T.IntegerType()), ("comp_id", T.LongType()), ("row", T.IntegerType()), ("c0", T.IntegerType()), ("c1", T.IntegerType()), ("n_px", T.LongType()), ("head", T.BooleanType()))]
    reach = max(closes)

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        h, w = (int(pdf[v].iloc[0]) if v in sides else int(v) for v in (height, width))
        row, col = pdf["row"].to_numpy(), pdf["col"].to_numpy()
        ok = (row >= 0) & (row < h) & (col >= 0) & (col < w)
        row, col = row[ok], col[ok]
        out = []
        if len(row):
            # the window of the cells, with room for what a closing's dilation adds; at the raster's own border there is none
            r0, r1, k0, k1 = max(0, row.min() - reach), min(h, row.max() + reach + 1), max(0, col.min() - reach), min(w, col.max() + reach + 1)
            x = np.zeros((r1 - r0, k1 - k0), bool)
            x[row - r0, col - k0] = True
            for o in opens:
                opened = _spread(_shrunk(x, o), o, False)
                for c in closes:
                    got = _shrunk(_spread(opened, c, False), c)
                    edge = np.diff(got.astype(np.int8), axis=1, prepend=0, append=0)
                    (rr, a), (_, b) = np.nonzero(edge == 1), np.nonzero(edge == -1)
                    rr, a, b = rr.astype(np.int64) + r0, a.astype(np.int64) + k0, b.astype(np.int64) + k0 - 1
                    top = _label(rr, a, b)
                    size = np.bincount(top, weights=b - a + 1, minlength=len(top)).astype(np.int64)
                    out.append(pd.DataFrame({"open_n": o, "close_n": c, "comp_id": rr[top] * (1 << 20) + a[top], "row": rr, "c0": a, "c1": b, "n_px": size[top], "head": top == np.arange(len(top))}))
        got = pd.concat(out) if out else pd.DataFrame({f.name: [] for f in fields[len(keys) :]})
        for k in reversed(keys):
            got.insert(0, k, pdf[k].iloc[0])
        return got

    return own.groupBy(*keys).applyInPandas(work, T.StructType(fields))


def areas(comps: DataFrame, *, pixel_m2: float | str = 100.0, min_ha: float = 0.0) -> DataFrame:
    """Cells and hectares of each component that has at least min_ha."""
    g = comps.groupBy(*keys_of(comps)).agg(F.sum(F.col("c1") - F.col("c0") + 1).alias("n_px"))
    return g.withColumn("area_ha", F.col("n_px") * as_column(pixel_m2) / 10000).filter(F.col("area_ha") >= F.lit(min_ha))


def time_steps(comp_cells: DataFrame, dates: DataFrame) -> DataFrame:
    """Per component the most frequent non-zero YYMM of its cells, the smallest on ties; NULL without any."""
    x = comp_cells.join(dates.filter("yymm > 0").select(*PIXEL, "yymm"), PIXEL, "left")
    n = x.groupBy("tile_id", "comp_id", "yymm").agg(F.count("*").alias("n"))
    return n.groupBy("tile_id", "comp_id").agg(_most_frequent().alias("time_step"))


def _most_frequent() -> Column:
    """Of rows (yymm, n) the non-null yymm of the greatest n, the smallest on ties."""
    return F.max_by(F.when(F.col("yymm").isNotNull(), F.col("yymm")), F.when(F.col("yymm").isNotNull(), F.struct("n", -F.col("yymm"))))


def cleaned(prob: DataFrame, *, least: float, open_n: int, close_n: int, height: int | str, width: int | str, keys: list[str] = ()) -> DataFrame:
    """Components of what is left after threshold, opening and closing, as shapes() gives them. keys: columns of prob to be kept, beside those that height and width name."""
    kept = threshold(prob, least, named(height, width, *keys))
    return shapes(kept, [open_n], [close_n], height, width).drop("open_n", "close_n")


def large(comps: DataFrame, *, pixel_m2: float | str = 100.0, min_ha: float = 0.0) -> DataFrame:
    """All runs of the components of shapes() that have at least min_ha, with area_ha."""
    return comps.withColumn("area_ha", F.col("n_px") * as_column(pixel_m2) / 10000).filter(F.col("area_ha") >= F.lit(min_ha))


def sized(comps: DataFrame, *, pixel_m2: float | str = 100.0, min_ha: float = 0.0) -> DataFrame:
    """areas() of what shapes() gave, which knows each component's cells: no exchange."""
    return large(comps, pixel_m2=pixel_m2, min_ha=min_ha).filter("head").drop("row", "c0", "c1", "head")


def polygonize(prob: DataFrame, *, least: float, open_n: int, close_n: int, min_ha: float, height: int | str, width: int | str, dates: DataFrame | None = None, pixel_m2: float | str = 100.0) -> DataFrame:
    """tile_id, comp_id, n_px, area_ha, time_step of what is left after threshold, opening, closing and area filter."""
    comps = cleaned(prob, least=least, open_n=open_n, close_n=close_n, height=height, width=width, keys=named(pixel_m2))
    return polygons(comps, min_ha=min_ha, pixel_m2=pixel_m2, dates=dates)


def polygons(comps: DataFrame, *, min_ha: float, pixel_m2: float | str = 100.0, dates: DataFrame | None = None) -> DataFrame:
    """polygonize() from what cleaned() gave: a component's runs carry its size, so its cells meet their dates in one join."""
    cols = ["tile_id", "comp_id", "n_px", "area_ha"]
    if dates is None:
        return sized(comps, pixel_m2=pixel_m2, min_ha=min_ha).select(*cols, F.lit(None).cast("int").alias("time_step"))
    of = large(comps, pixel_m2=pixel_m2, min_ha=min_ha).select(*cols, "row", F.explode(F.sequence("c0", "c1")).alias("col"))
    x = of.join(dates.filter("yymm > 0").select(*PIXEL, "yymm"), PIXEL, "left").groupBy(*cols, "yymm").agg(F.count("*").alias("n"))
    return x.groupBy(*cols).agg(_most_frequent().alias("time_step"))


def outlines(comps: DataFrame) -> DataFrame:
    """tile_id, comp_id, rings: closed rings of pixel corners (x, y), the outer ring first, then holes, each from its first corner in reading order.

    A tile's polygons are traced together, on an array of their numbers. Each side of a cell that its polygon doesn't continue beyond is an edge with the inside on its
    right; an edge's successor turns right where it can, so that 4-connected parts stay apart where two corners touch. Successors make cycles, whose edges are put in order by
    doubling steps, all cycles at once."""

    def trace(t: pa.Table) -> pa.Table:
        row, c0, c1, comp = (t.column(c).to_numpy().astype(np.int64) for c in ("row", "c0", "c1", "comp_id"))
        names, own = np.unique(comp, return_inverse=True)
        y0, x0 = int(row.min()), int(c0.min())
        h, w = int(row.max()) - y0 + 1, int(c1.max()) - x0 + 1
        label = np.zeros((h + 2, w + 2), np.int32)  # with a border of nothing
        n = c1 - c0 + 1
        cols = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(c0, n)
        label[np.repeat(row, n) - y0 + 1, cols - x0 + 1] = np.repeat(own + 1, n)
        inner, across = label[1:-1, 1:-1], w + 1  # corners of a line
        rings = _rings(inner, [label[:-2, 1:-1], label[1:-1, 2:], label[2:, 1:-1], label[1:-1, :-2]], across)
        of, start, at = rings  # for each ring's corner: polygon, the ring's first corner, the corner
        new_ring = np.concatenate([[True], (start[1:] != start[:-1]) | (of[1:] != of[:-1])])
        first = np.flatnonzero(new_ring)
        size = np.diff(np.append(first, len(at)))
        # each ring ends with its first corner again
        put = np.arange(len(at)) + np.cumsum(new_ring) - 1
        ends = np.cumsum(size + 1) - 1
        corner = np.empty(len(at) + len(first), np.int64)
        corner[put], corner[ends] = at, at[first]
        yy, xx = np.divmod(corner, across)
        points = pa.ListArray.from_arrays(pa.array(np.arange(0, 2 * len(corner) + 1, 2, dtype=np.int32)), pa.array(np.stack([xx + x0, yy + y0], 1).ravel().astype(np.int32)))
        lines = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size + 1)]).astype(np.int32)), points)
        per = np.bincount(of[first] - 1, minlength=len(names))
        whole = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]).astype(np.int32)), lines)
        return pa.table({"tile_id": pa.array([t.column("tile_id")[0].as_py()] * len(names), pa.string()), "comp_id": pa.array(names), "rings": whole})

    return comps.select("tile_id", "comp_id", "row", "c0", "c1").groupBy("tile_id").applyInArrow(trace, "tile_id string, comp_id long, rings array<array<array<int>>>")


def _rings(inner, beside: list, across: int):
    """Corners of all rings in order: their polygon, their ring's first corner, and the corner. inner: numbers of cells; beside: those of the cells above, right, below and left."""
    h, w = inner.shape
    first = [(0, 0), (0, 1), (1, 1), (1, 0)]  # (row, column) of an edge's start from its cell: above goes right, right goes down, below goes left, left goes up
    step = np.array([1, across, -1, -across])
    many = (h + 1) * across
    kind = np.zeros(4 * many, np.int32)  # by corner and direction: the polygon that has this edge
    for d, (other, (dr, dc)) in enumerate(zip(beside, first)):
        r, c = np.nonzero((inner > 0) & (inner != other))
        kind[4 * ((r + dr) * across + c + dc) + d] = inner[r, c]
    ids = np.flatnonzero(kind)
    place = np.full(4 * many, -1, np.int64)
    place[ids] = np.arange(len(ids))
    corner, d, own = ids // 4, ids % 4, kind[ids]
    end = corner + step[d]
    following = np.full(len(ids), -1, np.int64)
    for turn in (3, 0, 1):  # left, straight, right: the last one that exists holds
        to = 4 * end + (d + turn) % 4
        has = kind[to] == own
        following[has] = place[to[has]]
    # each cycle's first edge: that of the least corner; then the steps from it
    least, jump, span = ids.copy(), following.copy(), 1
    while span < len(ids):
        least, jump, span = np.minimum(least, least[jump]), jump[jump], 2 * span
    lead = least == ids
    jump, left = np.where(lead[following], np.arange(len(ids)), following), np.where(lead[following], 0, 1)
    span = 1
    while span < len(ids):
        left, jump, span = left + left[jump], jump[jump], 2 * span
    before = np.empty(len(ids), np.int64)
    before[following] = np.arange(len(ids))
    bent = d != d[before]
    order = np.lexsort((-left, least, own))
    order = order[bent[order]]
    return own[order], least[order], corner[order]
