"""Temporal aggregates of optical, radar and embedding observations, and the wide feature row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.pixel import cosine_distance, decibel, finite, minus, ndmi, ndvi, norm

PIXEL = ["tile_id", "row", "col"]


def indices(obs: DataFrame) -> DataFrame:
    return obs.withColumns({"ndvi": ndvi(), "ndmi": ndmi()})


def s2_annual(obs: DataFrame, months: DataFrame | None = None) -> DataFrame:
    """Per pixel and year: medians, minimum, percentiles, population deviation, and the slope over the position of the tile's months.

    The position is among the months that the tile has in that year (not the calendar month), which is a dense rank over a small table of
    (tile_id, year, month): `months` where the caller has it (the list of files tells it), else read from three columns of obs. Percentiles and deviation need
    two months; median and percentiles come from one buffer."""
    x = indices(obs.select(*PIXEL, "year", "month", "b08", "b04", "b11"))
    months = (x if months is None else months).select("tile_id", "year", "month").distinct()
    x = x.join(months.withColumn("t", F.row_number().over(W.partitionBy("tile_id", "year").orderBy("month")) - 1), ["tile_id", "year", "month"])
    g = x.groupBy(*PIXEL, "year").agg(
        F.percentile("ndvi", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("p"), F.median("ndmi").alias("median_ndmi"), F.min("ndvi").alias("min_ndvi"),
        F.stddev_pop("ndvi").alias("s"), F.regr_slope("ndvi", "t").alias("k"), F.count("ndvi").alias("n_obs"),
    )
    two = F.col("n_obs") >= 2
    return g.select(
        *PIXEL, "year", "n_obs", F.col("p")[1].alias("median_ndvi"), "median_ndmi", "min_ndvi", F.when(two, F.coalesce("k", F.lit(0.0))).otherwise(0.0).alias("slope_ndvi"), F.when(two, F.col("p")[0]).alias("p10_ndvi"),
        F.when(two, F.col("p")[2]).alias("p90_ndvi"), F.when(two, F.col("s")).alias("std_ndvi"),
    )


def worst_drop(annual: DataFrame, base_year: int | Column) -> DataFrame:
    """min over years other than the base of (minimum that year - median of the base year), and the earliest year that has it.

    A pixel's years are few, so one aggregate brings them side by side; pixels without the base year or any other have no row."""
    base = F.col("year") == base_year
    g = annual.groupBy(*PIXEL).agg(F.max(F.when(base, F.col("median_ndvi"))).alias("base"), F.count_if(base).alias("n"), F.collect_list(F.when(~base, F.struct("year", "min_ndvi"))).alias("years"))
    least = F.array_min(F.transform("years", lambda y: F.struct((y["min_ndvi"] - F.col("base")).alias("drop"), y["year"].alias("year"))))
    return g.filter((F.col("n") > 0) & (F.size("years") > 0)).select(*PIXEL, least.alias("w")).select(*PIXEL, F.col("w.drop").alias("worst_drop"), F.col("w.year").alias("worst_drop_year"))


def base_last(annual: DataFrame, base_year: int, last_year: int, names=("median_ndvi", "median_ndmi", "min_ndvi", "slope_ndvi")) -> DataFrame:
    """Base and last values and their difference side by side, by conditional aggregation; an absent side counts as 0."""
    at = lambda y, c: F.coalesce(F.max(F.when(F.col("year") == y, F.col(c))), F.lit(0.0))
    x = annual.filter(F.col("year").isin(base_year, last_year)).groupBy(*PIXEL).agg(*[at(y, c).alias(f"{w}_{c}") for c in names for w, y in (("base", base_year), ("last", last_year))])
    return x.select("*", *[(F.col(f"last_{c}") - F.col(f"base_{c}")).alias(f"delta_{c}") for c in names[:2]])


def s1_annual(obs: DataFrame) -> DataFrame:
    """Mean, population deviation and minimum of the backscatter in dB (vv_db, or vv_linear as power) over months and both orbits."""
    x = obs.select(*PIXEL, "year", (F.col("vv_db") if "vv_db" in obs.columns else decibel(F.col("vv_linear"))).alias("db"))
    return x.groupBy(*PIXEL, "year").agg(F.avg("db").alias("mean_vv"), F.stddev_pop("db").alias("std_vv"), F.min("db").alias("min_vv"))


# ---- embeddings -------------------------------------------------------------------------------------------------


def aef_change(aef: DataFrame) -> DataFrame:
    """Base (first year present) and last embedding, their difference, its length and their cosine distance."""
    g = aef.groupBy(*PIXEL).agg(F.min_by("emb", "year").alias("base"), F.max_by("emb", "year").alias("last"), F.min("year").alias("base_year"), F.max("year").alias("last_year"))
    clean = lambda c: F.transform(c, finite)
    g = g.withColumn("delta", minus(F.col("last"), F.col("base")))
    return g.withColumns({"aef_norm": norm(clean(F.col("delta"))), "aef_cos": cosine_distance(F.col("base"), F.col("last"))})


def aef_drift(aef: DataFrame) -> DataFrame:
    """The largest distance of any year from the base, and the earliest year that has it; pixels with one year have none.

    A pixel's years come together once, and the distances are taken inside the array."""
    g = aef.groupBy(*PIXEL).agg(F.array_sort(F.collect_list(F.struct("year", "emb"))).alias("y"))
    first = F.col("y")[0]
    far = lambda x: F.struct(norm(F.transform(minus(x["emb"], first["emb"]), finite)).alias("d"), (-x["year"]).alias("minus_year"))
    later = F.filter("y", lambda x: x["year"] > first["year"])
    g = g.filter(F.size(later) > 0).select(*PIXEL, F.array_max(F.transform(later, far)).alias("w"))
    return g.select(*PIXEL, F.col("w.d").alias("aef_max_drift"), (-F.col("w.minus_year")).alias("aef_year_of_drift"))


# ---- packing ----------------------------------------------------------------------------------------------------


def pack(cells: DataFrame, dims: int, *, change: DataFrame | None = None, drift: DataFrame | None = None, s1: DataFrame | None = None, s2: DataFrame | None = None, drop: DataFrame | None = None, terrain: DataFrame | None = None, base_year: int | Column = 2020, last_year: int | Column = 2024) -> DataFrame:
    """One row of features per cell, of one fixed schema whatever groups are present; absent values are 0.

    All inputs are keyed by pixel, so the joins share one partitioning by pixel. base_year and last_year may be columns of s1 and s2, where tiles differ in them."""
    x = cells.select(*PIXEL)
    spec: list[tuple[str, object]] = []

    def add(df, names):
        nonlocal x
        if df is not None:
            x = x.join(df, PIXEL, "left")
        spec.extend((n, F.col(n) if df is not None else F.lit(0.0)) for n in names)

    if change is not None:
        x = x.join(change.select(*PIXEL, "base", "last", "delta", "aef_norm", "aef_cos"), PIXEL, "left")
    for part in ("base", "last", "delta"):
        spec += [(f"aef_{part}_{i}", F.get(F.col(part), F.lit(i)) if change is not None else F.lit(0.0)) for i in range(dims)]
    spec += [(n, F.col(n) if change is not None else F.lit(0.0)) for n in ("aef_norm", "aef_cos")]
    add(drift, ["aef_max_drift", "aef_year_of_drift"])
    s1_names, s2_names = ["mean_vv", "std_vv", "min_vv"], ["median_ndvi", "median_ndmi", "min_ndvi", "slope_ndvi", "p10_ndvi", "p90_ndvi", "std_ndvi"]
    for prefix, df, names in (("s1", s1, s1_names), ("s2", s2, s2_names)):
        wide = None
        if df is not None:
            at = lambda y, c: F.max(F.when(F.col("year") == y, F.col(c)))
            wide = df.filter((F.col("year") == base_year) | (F.col("year") == last_year)).groupBy(*PIXEL).agg(*[at(y, c).alias(f"{prefix}_{w}_{c}") for w, y in (("base", base_year), ("last", last_year)) for c in names])
        add(wide, [f"{prefix}_{w}_{c}" for w in ("base", "last") for c in names])
    of = dict(spec)
    for prefix, names in (("s1", s1_names[:2]), ("s2", s2_names[:2])):
        spec += [(f"{prefix}_delta_{c}", of[f"{prefix}_last_{c}"] - of[f"{prefix}_base_{c}"]) for c in names]
    add(drop, ["worst_drop", "worst_drop_year"])
    add(terrain, ["elevation", "slope"])
    return x.select(*PIXEL, *[finite(e.cast("double")).alias(n) for n, e in spec])


# ---- forest -----------------------------------------------------------------------------------------------------


def forest_by_ndvi(pixels: DataFrame, least: float = 0.55) -> DataFrame:
    return pixels.withColumn("forest", finite(F.col("ndvi")) >= least)


def forest_by_split(pixels: DataFrame, least: float | None = 0.55) -> DataFrame:
    """pixels: tile_id, row, col, score (centred, along the tile's first principal component), ndvi (may be NULL where unknown).

    The forest side of the split score > 0 has the higher median NDVI (the positive side wins ties), or is the larger one where no NDVI is
    known; then NDVI must reach `least`. A tile with one side only falls back to the NDVI test, or is all forest without NDVI."""
    pos = F.col("score") > 0
    side = pixels.groupBy("tile_id").agg(
        F.median(F.when(pos, F.col("ndvi"))).alias("mp"), F.median(F.when(~pos, F.col("ndvi"))).alias("mn"), F.count_if(pos).alias("np"), F.count_if(~pos).alias("nn"), F.count("ndvi").alias("seen")
    )
    x = pixels.join(side, "tile_id")
    one = (F.col("np") == 0) | (F.col("nn") == 0)
    up = F.when(F.col("seen") > 0, F.coalesce(F.col("mp") >= F.col("mn"), F.lit(True))).otherwise(F.col("np") >= F.col("nn"))
    test = F.when(F.col("seen") > 0, finite(F.col("ndvi")) >= least).otherwise(True) if least is not None else F.lit(True)
    return x.withColumn("forest", F.when(one, test).otherwise((F.when(up, pos).otherwise(~pos)) & test)).drop("mp", "mn", "np", "nn", "seen")


def principal_scores(aef: DataFrame) -> DataFrame:
    """tile_id, row, col, score: each pixel's coordinate along its tile's first principal component.

    The covariance of a tile is a sum over its pixels, so it is aggregated before anything is shuffled: workers send one matrix per tile and
    partition. Its leading eigenvector is that of the small symmetric matrix, with the sign that makes its largest entry positive."""
    import numpy as np
    import pandas as pd

    clean = aef.select(*PIXEL, F.transform("emb", finite).alias("emb"))

    def moments(batches):
        for pdf in batches:
            for tile, g in pdf.groupby("tile_id"):
                x = np.stack(g["emb"].to_numpy())
                yield pd.DataFrame({"tile_id": [tile], "n": [len(x)], "s": [x.sum(0).tolist()], "q": [(x.T @ x).ravel().tolist()]})

    def axis(key, pdf):
        n, s, q = pdf["n"].sum(), np.sum(np.stack(pdf["s"]), 0), np.sum(np.stack(pdf["q"]), 0)
        d = len(s)
        cov = q.reshape(d, d) / n - np.outer(s, s) / n**2
        v = np.linalg.eigh(cov)[1][:, -1]
        v = v * (1 if v[np.abs(v).argmax()] > 0 else -1)
        return pd.DataFrame({"tile_id": [key[0]], "mean": [(s / n).tolist()], "axis": [v.tolist()]})

    part = clean.select("tile_id", "emb").mapInPandas(moments, "tile_id string, n long, s array<double>, q array<double>")
    axes = part.groupBy("tile_id").applyInPandas(axis, "tile_id string, mean array<double>, axis array<double>")
    from ..functions.pixel import dot

    return clean.join(axes, "tile_id").select(*PIXEL, dot(minus(F.col("emb"), F.col("mean")), F.col("axis")).alias("score"))
