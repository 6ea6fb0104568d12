"""Queries on points and outlines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cragline.operators import outlines
from cragline.plans import fixtures as fx
from cragline.session import table


def outline_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which points lie inside the outlines of the suppliers, four-cornered and over one another, and how far each is from the nearest side."""
    k = F.col("s_suppkey")
    x, y = (k * 97 % 503).cast("double"), (k * 61 % 499).cast("double")
    corners = ((x, y), (x + 20 + k % 7, y + 0.5), (x + 15 + k % 5, y + 12 + k % 3), (x + 0.25, y + 9 + k % 4))
    ring = F.array(*[F.struct(a.alias("x"), b.alias("y")) for a, b in corners])
    rings = table(spark, sf_dir, "supplier").select(k.alias("ring"), F.posexplode(ring).alias("idx", "p")).select("ring", "idx", "p.x", "p.y")
    sides, points = outlines.sides_of(rings), fx.points(spark, sf_dir).withColumn("y", F.col("y") + 0.125)
    return outlines.inside(points, sides, 8.0).join(outlines.distances(points, sides, 8.0), "id").select("id", "inside", F.round("d", 6).alias("d"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"outline_points": outline_points}

ORACLES: dict[str, str] = {
    "outline_points": f"""
WITH {fx.POINTS}, k AS (SELECT s_suppkey AS k, (s_suppkey * 97 % 503)::DOUBLE AS x, (s_suppkey * 61 % 499)::DOUBLE AS y FROM supplier),
c AS (SELECT [(x, y), (x + 20 + k % 7, y + 0.5), (x + 15 + k % 5, y + 12 + k % 3), (x + 0.25, y + 9 + k % 4)]::STRUCT(x DOUBLE, y DOUBLE)[] AS c FROM k),
s AS (SELECT c[i].x AS x1, c[i].y AS y1, c[i % 4 + 1].x AS x2, c[i % 4 + 1].y AS y2 FROM c CROSS JOIN range(1, 5) t(i)),
p AS (SELECT id, x, y + 0.125 AS y FROM points),
m AS (SELECT *, greatest(0, least(1, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / (pow(x2 - x1, 2) + pow(y2 - y1, 2)))) AS t FROM p CROSS JOIN s)
SELECT id, count(*) FILTER (WHERE (y1 > y) <> (y2 > y) AND x < x1 + (y - y1) / (y2 - y1) * (x2 - x1)) % 2 = 1 AS inside,
  round(min(sqrt(pow(x - x1 - t * (x2 - x1), 2) + pow(y - y1 - t * (y2 - y1), 2))), 6) AS d FROM m GROUP BY id""",
}
