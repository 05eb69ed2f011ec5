"""Views of the star-schema tables as pixel relations, by integer arithmetic that any SQL engine evaluates alike.

The engine itself works on pixel relations (tile_id, row, col, ...) of whatever origin; these views stand in for rasters in
the checks. SQL holds the same definitions for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EDGE = 50
CELLS = EDGE * EDGE


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def s2_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly reflectances: a supplier is a pixel (and a tile of its own, so that gaps in its months matter)."""
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax")
    return li.groupBy(
        F.concat(F.lit("T"), F.col("l_suppkey").cast("string")).alias("tile_id"), F.lit(0).alias("row"), F.lit(0).alias("col"), F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month")
    ).agg(
        (F.avg(F.floor(F.col("l_extendedprice") / 10)) / 10000).alias("b08"),
        (F.avg(F.floor(F.col("l_quantity") * 100)) / 10000).alias("b04"),
        (F.avg(F.floor((F.col("l_discount") + F.col("l_tax")) * 20000)) / 10000).alias("b11"),
    )


def s1_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Backscatter in linear power; some of it is not positive."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return e.select(
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("tile_id"), F.lit(0).alias("row"), F.lit(0).alias("col"), (F.lit(2020) + F.col("event_id") % 2).cast("int").alias("year"),
        (F.dayofmonth("ts") % 12 + 1).alias("month"), F.when(F.col("event_type") < "m", "ascending").otherwise("descending").alias("orbit"), (F.col("value") - 20).alias("vv_linear"),
    )


def aef(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly embeddings: five vectors are the years 2020 to 2024 of a pixel."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    p = F.expr("vec_id div 5")
    return e.select(
        F.concat(F.lit("A"), F.expr("(vec_id div 5) div 25").cast("string")).alias("tile_id"), F.expr("((vec_id div 5) % 25) div 5").cast("int").alias("row"), (p % 5).cast("int").alias("col"),
        (F.lit(2020) + F.col("vec_id") % 5).cast("int").alias("year"), F.transform("embedding", lambda x: x.cast("double")).alias("emb"),
    )


def grid(spark: SparkSession, sf_dir: str, *extra) -> DataFrame:
    """Orders as the cells of 50 x 50 tiles."""
    k = F.col("o_orderkey")
    t = F.expr(f"o_orderkey div {CELLS}")
    name = F.concat((F.lit(18) + t % 3).cast("string"), F.lit("NW"), F.expr(f"substring('ABCD', cast((o_orderkey div {CELLS}) % 4 as int) + 1, 1)"), F.lit("_"), t.cast("string"))
    return table(spark, sf_dir, "orders").select(name.alias("tile_id"), F.expr(f"cast((o_orderkey % {CELLS}) div {EDGE} as int)").alias("row"), (k % EDGE).cast("int").alias("col"), k.alias("k"), *extra)


def prob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid(spark, sf_dir, (F.col("o_totalprice") / 500000).alias("prob"), (F.col("o_orderkey") % 11 != 0).alias("forest")).drop("k")


def dem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid(spark, sf_dir, (F.floor(F.col("o_totalprice") / 100) % 500).cast("double").alias("elevation")).drop("k")


def radd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes: a lead of 2, 3 or (invalid) 4, then days since the alert system's origin."""
    g = grid(spark, sf_dir, (F.unix_date(F.col("o_orderdate").cast("date")) + 8035 - 16435).cast("long").alias("off"))
    code = "case when k % 4 = 0 or off <= 0 then 0 else (2 + k % 3) * cast(pow(10, length(cast(off as string))) as bigint) + off end"
    return g.select("tile_id", "row", "col", F.expr(code).cast("long").alias("code"))


def gladl(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid(spark, sf_dir, F.dayofyear(F.col("o_orderdate")).alias("d"), F.explode(F.array(*[F.lit(y) for y in (20, 21, 22)])).alias("yy"))
    return g.select("tile_id", "row", "col", "yy", ((F.col("k") + F.col("yy") * 3) % 5).cast("int").alias("alert"), F.when(F.col("k") % 7 == 0, 0).otherwise((F.col("d") + F.col("yy") * 17) % 366).cast("int").alias("doy"))


def glads2(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid(spark, sf_dir)
    return g.select("tile_id", "row", "col", (F.col("k") % 6).cast("int").alias("alert"), (F.col("k") * 7 % 2000 - 20).cast("int").alias("day_offset"))


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as tiles: bounds in degrees and a listing of file names."""
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    return n.select(
        F.concat(F.lpad((k + 10).cast("string"), 2, "0"), F.lit("NW"), F.substring("n_name", 1, 1), F.lit("_"), F.col("n_regionkey").cast("string")).alias("tile_id"), F.col("n_name"), k.alias("k"),
        (k * 7 - 80 + 0.25).cast("double").alias("w"), (k * 3 - 35 + 0.5).cast("double").alias("s"), (k * 7 - 80 + 0.25 + (k % 3) * 0.9).cast("double").alias("e"), (k * 3 - 35 + 0.5 + (k % 2) * 0.75).cast("double").alias("n"),
    )


_T = f"CAST(o_orderkey // {CELLS} AS BIGINT)"
_GRID = f"(18 + {_T} % 3) || 'NW' || substr('ABCD', CAST({_T} % 4 AS INT) + 1, 1) || '_' || {_T} AS tile_id, CAST((o_orderkey % {CELLS}) // {EDGE} AS INT) AS \"row\", CAST(o_orderkey % {EDGE} AS INT) AS \"col\""

#: The same views in the oracle's SQL.
SQL = {
    "s2_obs": """SELECT 'T' || l_suppkey AS tile_id, 0 AS "row", 0 AS "col", CAST(year(l_shipdate) AS INT) AS year, CAST(month(l_shipdate) AS INT) AS month, avg(floor(l_extendedprice / 10)) / 10000 AS b08, avg(floor(l_quantity * 100)) / 10000 AS b04, avg(floor((l_discount + l_tax) * 20000)) / 10000 AS b11 FROM lineitem GROUP BY 1, 4, 5""",
    "s1_obs": """SELECT 'U' || user_id AS tile_id, 0 AS "row", 0 AS "col", CAST(2020 + event_id % 2 AS INT) AS year, CAST(day(ts) % 12 + 1 AS INT) AS month, CASE WHEN event_type < 'm' THEN 'ascending' ELSE 'descending' END AS orbit, value - 20 AS vv_linear FROM events""",
    "aef": """SELECT 'A' || ((vec_id // 5) // 25) AS tile_id, CAST(((vec_id // 5) % 25) // 5 AS INT) AS "row", CAST((vec_id // 5) % 5 AS INT) AS "col", CAST(2020 + vec_id % 5 AS INT) AS year, CAST(embedding AS DOUBLE[]) AS emb FROM embeddings""",
    "prob": f"SELECT {_GRID}, o_totalprice / 500000 AS prob, o_orderkey % 11 <> 0 AS forest FROM orders",
    "dem": f"SELECT {_GRID}, CAST(CAST(floor(o_totalprice / 100) AS BIGINT) % 500 AS DOUBLE) AS elevation FROM orders",
    "radd": f"SELECT * EXCLUDE (k, o), CAST(CASE WHEN k % 4 = 0 OR o <= 0 THEN 0 ELSE (2 + k % 3) * CAST(pow(10, length(CAST(o AS VARCHAR))) AS BIGINT) + o END AS BIGINT) AS code FROM (SELECT {_GRID}, o_orderkey AS k, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + 8035 - 16435 AS o FROM orders)",
    "gladl": f"SELECT tile_id, \"row\", \"col\", yy, CAST((k + yy * 3) % 5 AS INT) AS alert, CAST(CASE WHEN k % 7 = 0 THEN 0 ELSE (d + yy * 17) % 366 END AS INT) AS doy FROM (SELECT {_GRID}, o_orderkey AS k, dayofyear(o_orderdate) AS d, unnest([20, 21, 22]) AS yy FROM orders)",
    "glads2": f"SELECT {_GRID}, CAST(o_orderkey % 6 AS INT) AS alert, CAST(o_orderkey * 7 % 2000 - 20 AS INT) AS day_offset FROM orders",
    "tiles": """SELECT lpad(CAST(n_nationkey + 10 AS VARCHAR), 2, '0') || 'NW' || substr(n_name, 1, 1) || '_' || n_regionkey AS tile_id, n_name, n_nationkey AS k, CAST(n_nationkey * 7 - 80 AS DOUBLE) + 0.25::DOUBLE AS w, CAST(n_nationkey * 3 - 35 AS DOUBLE) + 0.5::DOUBLE AS s, CAST(n_nationkey * 7 - 80 AS DOUBLE) + 0.25::DOUBLE + (n_nationkey % 3) * 0.9::DOUBLE AS e, CAST(n_nationkey * 3 - 35 AS DOUBLE) + 0.5::DOUBLE + (n_nationkey % 2) * 0.75::DOUBLE AS n FROM nation""",
}
