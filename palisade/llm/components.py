"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import materialize


def _least(links: DataFrame) -> DataFrame:
    """Adds to each (u, v) the smallest neighbour of u. Partial minima leave the map side, and the join's key isn't
    the grouping's, so that a hub's rows can be split among tasks."""
    least = links.groupBy("u").agg(F.min("v").alias("m")).select(F.bitwise_not("u").alias("_j"), "m")
    return links.withColumn("_j", F.bitwise_not("u")).join(least, "_j").drop("_j")


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _least(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u > v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    starred = _least(links)
    own = starred.select("u", F.col("m").alias("v"))
    others = starred.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return own.unionByName(others).distinct()


def components(links: DataFrame) -> DataFrame:
    """id and component (the smallest id reachable, itself included) of every id in links(a, b)."""
    now = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, seen = materialize(now, "links"), None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
        now = materialize(_small_star(_large_star(now)), "links")
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
