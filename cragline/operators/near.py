"""Neighbour joins of points (id, x, y) by a grid of cells as wide as the radius: an equi-join on cells, never all pairs.

A point is sent to its own cell, and looked for in the nine around it, so the exact predicate sees every pair in reach.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cragline.session import shuffled


def near_pairs(points: DataFrame, radius: float, *by: str) -> DataFrame:
    """(u, v, d) of each unordered pair within the radius once, u < v. by: columns in which both must be equal; they are kept."""
    return _reach(points, points, radius, *by).where("u < v")


def _reach(a: DataFrame, b: DataFrame, radius: float, *by: str) -> DataFrame:
    def cell(axis: str):
        return F.floor(F.col(axis) / radius).cast("long")

    around = F.explode(F.array(*[F.lit(i) for i in (-1, 0, 1)]))
    left = a.select(*by, F.col("id").alias("u"), F.col("x").alias("ux"), F.col("y").alias("uy"), cell("x").alias("cx"), cell("y").alias("cy"))
    left = left.withColumn("_i", around).withColumn("_j", around).select(*by, "u", "ux", "uy", (F.col("cx") + F.col("_i")).alias("cx"), (F.col("cy") + F.col("_j")).alias("cy"))
    right = b.select(*by, F.col("id").alias("v"), F.col("x").alias("vx"), F.col("y").alias("vy"), cell("x").alias("cx"), cell("y").alias("cy"))
    d = F.sqrt(F.pow(F.col("ux") - F.col("vx"), 2) + F.pow(F.col("uy") - F.col("vy"), 2))
    return left.join(shuffled(right), [*by, "cx", "cy"]).select(*by, "u", "v", d.alias("d")).where(F.col("d") <= radius)


def nearest(points: DataFrame, radius: float, k: int) -> DataFrame:
    """(u, v, d, place): up to k nearest others of each point within the radius, ties by id; points at distance 0 don't count."""
    order = Window.partitionBy("u").orderBy("d", "v")
    return _reach(points, points, radius).where("u <> v AND d > 0").withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def closest_between(points: DataFrame, labels: DataFrame, radius: float) -> DataFrame:
    """(a, b, u, v, d): for each two components (labels: id, label) with points in reach, the closest pair; a < b."""
    named = [labels.select(F.col("id").alias(p), F.col("label").alias(n)) for p, n in (("u", "a"), ("v", "b"))]
    pairs = _reach(points, points, radius).join(shuffled(named[0]), "u").join(shuffled(named[1]), "v").where("a < b")
    best = pairs.groupBy("a", "b").agg(F.min(F.struct("d", "u", "v")).alias("x"))
    return best.select("a", "b", "x.u", "x.v", "x.d")
