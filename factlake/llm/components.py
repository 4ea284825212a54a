"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from factlake.llm.common import materialized


def _least(pairs: DataFrame) -> DataFrame:
    """Per ``u`` the least of itself and its neighbours.

    Written down, so that the join that follows sees two plain shuffles and a hub's links
    can be split over tasks.
    """
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return materialized(least.select("u", F.least("u", "m").alias("m")))


def _large_star(links: DataFrame) -> DataFrame:
    """Every neighbour greater than ``u`` is linked to the least of u's neighbourhood."""
    both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    out = both.join(_least(both), "u").where(F.col("v") > F.col("u"))
    return materialized(out.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())


def _small_star(links: DataFrame) -> DataFrame:
    """``u`` and every neighbour below it are linked to the least of them; u > v here."""
    least = _least(links)
    below = links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    out = below.unionAll(least.select("u", F.col("m").alias("v")))
    return materialized(out.where(F.col("u") != F.col("v")).distinct())


def _print(links: DataFrame) -> tuple:
    mixed = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    return tuple(links.agg(F.count(F.lit(1)), mixed).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (u, v: long): root is the component's least.

    Direction, repetition and self links don't matter; null ends are ignored. Each round
    is written to the shared folder, so a lost executor repeats one round at most; the
    number of rounds grows with the logarithm of the number of nodes. A hub costs one
    pre-aggregated row in the minima and is split in the joins.
    """
    u, v = F.greatest("u", "v"), F.least("u", "v")
    known = links.where(F.col("u").isNotNull() & F.col("v").isNotNull())
    stars = known.select(u.alias("u"), v.alias("v")).where(F.col("u") != F.col("v"))
    stars = materialized(stars.distinct())
    before = None
    while before != (now := _print(stars)):
        before = now
        if now[0]:
            stars = _small_star(_large_star(stars))
    roots = stars.select(F.col("v").alias("node")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
        roots.select("node", F.col("node").alias("root"))
    )
