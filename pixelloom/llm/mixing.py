"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

Every document of a source expects e = target / source_size copies. Its documents stand in a fixed order (size, hash
of the id, id); the running sum of expected copies, shifted by one random offset of the source, crosses an
integer boundary once per copy to be emitted. As the order goes by size, the words taken stay within about one
document of the target.

The ranks come from counts in two levels, so that a source (or a size within it) that holds most rows is never ordered in one
task: counts by (source, size), by (source, size, slice of the hash), then row numbers within a slice.

Defined results: null text has size 0, and so has an empty one; very long texts are counted whole; further columns of any name are kept by mix; a null source is a source of its own, last in order; rows with equal ids are
rows of their own (their order among equals does not change the copies of the size); a source of size 0 has target 0 and is not
taken; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACES, others, ref, stage

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
SLICE_BITS = 12


def word_count(text: Column) -> Column:
    """Number of words, without building an array of them: each word with the blanks around it shrinks to one x."""
    t = F.coalesce(text, F.lit(""))
    marks = F.regexp_replace(t, f"[{SPACES}]*+[^{SPACES}]++[{SPACES}]*+", "x")
    return F.when(t.rlike(f"[^{SPACES}]"), F.length(marks)).otherwise(0).cast("long")


def uniform(seed: int, source: Column) -> Column:
    """A number from 0 to under 1, in steps of 2**-32, that depends on seed and source alone."""
    key = F.concat(F.lit(f"{seed}|"), F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source)))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size) -> also target. One row per source, so its windows see as many rows as there are sources.

    Water filling: with w the weight and c = most * source_size the cap, a target is min(c, level * w), at the one level that hands out
    share * all sizes. In order of c / w the capped sources come first, so the level is found by running sums."""
    order = W.orderBy(F.col("source").asc_nulls_last())
    k = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (k % len(weights) + 1).cast("int"))
    x = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    every = W.partitionBy(F.lit(1))
    rising = W.partitionBy(F.lit(1)).orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    x = x.withColumn("all_size", F.sum("source_size").over(every)).withColumn("all_weight", F.sum("weight").over(every))
    before = rising.rowsBetween(W.unboundedPreceding, -1)
    x = x.withColumn("level", (F.col("all_size") * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(every)
    return x.withColumn("level", level["level"]).select("source", "source_size", F.least(F.col("cap"), F.col("level") * F.col("weight")).alias("target"))


def mix_plan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 6) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken."""
    h = F.conv(F.substring(F.md5(F.coalesce(ref(id_col).cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long")
    base = stage(docs.select(ref(id_col).alias("doc_id"), ref(source_col).alias("source"), word_count(ref(text_col)).alias("size"), h.alias("h")), "mix")
    cell = F.shiftright("h", 32 - SLICE_BITS).cast("int").alias("cell")
    cells = base.groupBy("source", "size", cell).agg(F.count("*").alias("n"))
    sizes = cells.groupBy("source", "size").agg(F.sum("n").alias("n"))
    per = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goals = targets(per, weights, share, most)
    lower = W.partitionBy("source").orderBy("size").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select("source", "size", F.coalesce(F.sum("n").over(lower), F.lit(0)).alias("below"))
    inner = W.partitionBy("source", "size").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.select("source", "size", "cell", F.coalesce(F.sum("n").over(inner), F.lit(0)).alias("within"))
    same = lambda a, b, keys: [a[k].eqNullSafe(b[k]) for k in keys]
    both = cells.alias("c").join(sizes.alias("s"), [F.col("c.source").eqNullSafe(F.col("s.source")), F.col("c.size") == F.col("s.size")])
    both = both.select("c.source", "c.size", "c.cell", (F.col("within") + F.col("below")).alias("offset"))
    both = both.alias("c").join(goals.alias("g"), F.col("c.source").eqNullSafe(F.col("g.source"))).select("c.source", "c.size", "c.cell", "offset", "source_size", "target")
    mine = W.partitionBy("source", "size", "cell").orderBy(F.col("h"), F.col("doc_id").asc_nulls_last())
    rows = base.withColumn("cell", cell).withColumn("rank", F.row_number().over(mine))
    x = rows.join(both, same(rows, both, ["source", "size", "cell"]), "left").select(rows["doc_id"], rows["source"], rows["size"], "source_size", "target", (F.col("offset") + F.col("rank")).alias("k"))
    e = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    u = uniform(seed, F.col("source").cast("string"))
    copies = F.floor(e * F.col("k") + u) - F.floor(e * (F.col("k") - 1) + u)
    return x.withColumn("copies", copies.cast("long")).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, *, id_col: str = "doc_id", **how) -> DataFrame:
    """The mixed documents: every row of docs, as often as the plan takes it, with its own columns.

    Rows that share an id share the copies that the plan gives to that id, in any assignment."""
    plan = mix_plan(docs, id_col=id_col, **how).groupBy("doc_id").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")).filter("copies > 0")
    names = others(docs, [])
    d = docs.select(*[ref(c).alias(f"k{i}") for i, c in enumerate(names)], ref(id_col).alias("mix_id"))
    x = d.join(plan, d["mix_id"].eqNullSafe(plan["doc_id"]))
    alone = x.filter("rows = 1")
    several = x.filter("rows > 1").withColumn("nth", F.row_number().over(W.partitionBy("mix_id").orderBy(*[F.hash(F.col(f"k{i}").cast("string")) for i in range(len(names))])))
    several = several.withColumn("copies", F.expr("copies div rows + if(nth <= copies % rows, 1, 0)")).drop("nth")
    x = alone.unionByName(several).filter("copies > 0").withColumn("copy", F.explode(F.expr("sequence(1L, copies)")))
    return x.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(names)])


ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, source_size * 2.0::DOUBLE AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
          / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM w),
g AS (SELECT source, source_size, least(cap, weight * (SELECT arg_min(level, cap / weight) FROM l WHERE level * weight <= cap)) AS target FROM l),
r AS (SELECT d.*, g.source_size, g.target, row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.h, d.doc_id) AS k,
             CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0.0::DOUBLE END AS e,
             CAST('0x' || substr(md5('6|' || CASE WHEN d.source IS NULL THEN 'n' ELSE 's' || d.source END), 1, 8) AS BIGINT)::DOUBLE / 4294967296.0::DOUBLE AS u
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, CAST((floor(e * k + u) - floor(e * (k - 1) + u)) * size AS BIGINT) AS taken FROM r
"""
