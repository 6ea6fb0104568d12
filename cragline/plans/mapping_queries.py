"""Queries on masks, depth rasters, clipping, resampling and filters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cragline.functions import mercator as m
from cragline.operators import mapping as mp
from cragline.plans import fixtures as fx
from cragline.session import table

S = fx.SIDE


def dem_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mp.resampled(fx.dem(spark, sf_dir), S, 6).withColumn("z", F.round("z", 6))


def raster_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    tiles = table(spark, sf_dir, "supplier").agg(F.count(F.lit(1)).alias("tiles"))  # one row
    points = table(spark, sf_dir, "orders").crossJoin(F.broadcast(tiles)).select(k.alias("id"), (F.col("o_custkey") % F.col("tiles")).alias("tile"), (k * 37 % 1700 / 100.0 - 0.5).alias("y"), (k * 91 % 1700 / 100.0 - 0.5).alias("x"))
    return mp.nearest_sample(points, fx.filled_dem(spark, sf_dir), S).withColumn("z", F.round("z", 6))


def land_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A five-cornered ring a tile, crossing itself."""
    k = F.col("s_suppkey")
    corners = [(0.5, 0.25), (14.5, 3.25), (2.5, 12.75), (9.5, 0.75), (12.25, 15.5)]
    ring = F.array(*[F.struct((x + k % 3 * 0.25).alias("x"), (y - k % 5 * 0.125).alias("y")) for x, y in corners])
    rings = table(spark, sf_dir, "supplier").select(k.alias("tile"), F.posexplode(ring).alias("idx", "p")).select("tile", "idx", "p.x", "p.y")
    return mp.inside_rings(fx.filled_dem(spark, sf_dir).select("tile", "r", "c"), rings)


def depth_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    at = {f"{a}{i}": (k * p % 67 / 4.0) for (a, i), p in zip([(a, i) for i in (1, 2, 3) for a in "xyz"], (3, 5, 7, 11, 13, 17, 19, 23, 29), strict=True)}
    triangles = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 997).alias("tile"), k.alias("tri"), *[v.alias(n) for n, v in at.items()])
    return mp.depth_raster(triangles, S).withColumn("depth", F.round(F.col("depth").cast("double"), 3))


def line_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = fx.tracks(spark, sf_dir).select(F.col("track").alias("line"), "idx", F.col("lat").alias("a"))
    return mp.clipped(lines, 44.25, 46.75).select("line", "idx", F.round("t0", 6).alias("t0"), F.round("t1", 6).alias("t1"))


def polyline_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = fx.tracks(spark, sf_dir).select(F.col("track").alias("line"), F.rint(F.col("lat") * 7).cast("long").alias("row"), F.col("lon").alias("value"))
    return mp.resampled_line(points).withColumn("value", F.round("value", 6))


def polyline_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same on all rows from 300 to 345, ends held."""
    points = fx.tracks(spark, sf_dir).select(F.col("track").alias("line"), F.rint(F.col("lat") * 7).cast("long").alias("row"), F.col("lon").alias("value"))
    return mp.resampled_line(points, 300, 345).withColumn("value", F.round("value", 6))


def relief_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mp.relief_caps(fx.filled_dem(spark, sf_dir), [1.0, 0.5, 0.125], 100.0).withColumn("z", F.round("z", 6))


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = fx.tracks(spark, sf_dir).select(F.col("track").alias("graph"), F.col("idx").alias("seq"), F.col("lat").alias("r"), F.col("lon").alias("c"))
    return mp.quantised_nodes(points, 2.0)


def draw_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    px, py = m.to_pixel(F.col("lon"), F.col("lat"), F.lit(9))
    strokes = fx.tracks(spark, sf_dir).select(F.floor(px / m.TILE).alias("tx"), F.floor(py / m.TILE).alias("ty"), F.col("track").alias("value"), F.struct("ele", "track", "idx").alias("o"))
    return mp.last_drawn(strokes, "o")


def local_crs(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = fx.tracks(spark, sf_dir).groupBy("track", F.floor(F.col("idx") / 3).alias("part")).agg(F.min("lon").alias("w"), F.max("lon").alias("e"), F.avg("lat").alias("lat"))
    return boxes.select("track", "part", m.utm_epsg(F.col("w"), F.col("e"), F.col("lat")).cast("long").alias("epsg"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "dem_resample": dem_resample, "raster_lookup": raster_lookup, "land_mask": land_mask, "depth_raster": depth_raster, "line_clip": line_clip,
    "polyline_resample": polyline_resample, "polyline_rows": polyline_rows, "relief_caps": relief_caps, "graph_nodes": graph_nodes, "draw_order": draw_order, "local_crs": local_crs,
}

_E = "CASE WHEN area = 0 THEN NULL ELSE ((x{j} - x{i}) * (r - y{i}) - (y{j} - y{i}) * (c - x{i})) / area END"
_M = "6378137.0::DOUBLE"
_TRI = ", ".join(f"o_orderkey * {p} % 67 / 4.0::DOUBLE AS {a}{i}" for (a, i), p in zip([(a, i) for i in (1, 2, 3) for a in "xyz"], (3, 5, 7, 11, 13, 17, 19, 23, 29), strict=True))
_SOFT = "(z * 1.0::DOUBLE + 0.5::DOUBLE * (coalesce(lag(z, 1) OVER w, first(z) OVER e) + coalesce(lead(z, 1) OVER w, last(z) OVER e)) + 0.125::DOUBLE * (coalesce(lag(z, 2) OVER w, first(z) OVER e) + coalesce(lead(z, 2) OVER w, last(z) OVER e))) / 2.25::DOUBLE"
_W = lambda g, o: f"WINDOW w AS (PARTITION BY tile, {g} ORDER BY {o}), e AS (PARTITION BY tile, {g} ORDER BY {o} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
_CORNERS = "[(0.5, 0.25), (14.5, 3.25), (2.5, 12.75), (9.5, 0.75), (12.25, 15.5)]"

ORACLES: dict[str, str] = {
    "dem_resample": f"WITH {fx.DEM} SELECT tile, (r * 6 // {S})::INT AS r, (c * 6 // {S})::INT AS c, round(avg(z), 6) AS z FROM dem WHERE NOT isnan(z) GROUP BY 1, 2, 3",
    "raster_lookup": f"""WITH {fx.FILLED}, p AS (SELECT o_orderkey AS id, o_custkey % (SELECT count(*) FROM supplier) AS tile, greatest(0, least({S - 1}, round_even(o_orderkey * 37 % 1700 / 100.0::DOUBLE - 0.5, 0)))::INT AS r, greatest(0, least({S - 1}, round_even(o_orderkey * 91 % 1700 / 100.0::DOUBLE - 0.5, 0)))::INT AS c FROM orders)
SELECT id, round(coalesce(z, 0), 6) AS z FROM p LEFT JOIN filled f ON f.tile = p.tile AND f.r = p.r AND f.c = p.c""",
    "land_mask": f"""
WITH {fx.FILLED}, p(i, x, y) AS (VALUES (0, 0.5::DOUBLE, 0.25::DOUBLE), (1, 14.5::DOUBLE, 3.25::DOUBLE), (2, 2.5::DOUBLE, 12.75::DOUBLE), (3, 9.5::DOUBLE, 0.75::DOUBLE), (4, 12.25::DOUBLE, 15.5::DOUBLE)),
e AS (SELECT s_suppkey AS tile, a.x + s_suppkey % 3 * 0.25::DOUBLE AS x1, a.y - s_suppkey % 5 * 0.125::DOUBLE AS y1, b.x + s_suppkey % 3 * 0.25::DOUBLE AS x2, b.y - s_suppkey % 5 * 0.125::DOUBLE AS y2 FROM supplier CROSS JOIN p a JOIN p b ON b.i = (a.i + 1) % 5)
SELECT f.tile, r, c, count(e.tile) FILTER (WHERE x1 + (r - y1) / (y2 - y1) * (x2 - x1) > c) % 2 = 1 AS inside
FROM filled f LEFT JOIN e ON e.tile = f.tile AND r >= least(y1, y2) AND r < greatest(y1, y2) GROUP BY f.tile, r, c""",
    "depth_raster": f"""
WITH t AS (SELECT o_custkey % 997 AS tile, o_orderkey AS tri, {_TRI} FROM orders), a AS (SELECT *, (x2 - x1) * (y3 - y1) - (x3 - x1) * (y2 - y1) AS area FROM t),
g AS (SELECT *, {_E.format(i=2, j=3)} AS w1, {_E.format(i=3, j=1)} AS w2, {_E.format(i=1, j=2)} AS w3 FROM a CROSS JOIN range({S}) r(r) CROSS JOIN range({S}) c(c)),
d AS (SELECT tile, r, c, (w1 * z1 + w2 * z2 + w3 * z3)::FLOAT AS depth, tri FROM g WHERE w1 >= 0 AND w2 >= 0 AND w3 >= 0)
SELECT tile, r::INT AS r, c::INT AS c, round(min(depth)::DOUBLE, 3) AS depth, arg_min(tri, struct_pack(d := depth, t := tri)) AS tri FROM d GROUP BY tile, r, c""",
    "line_clip": f"""
WITH {fx.TRACKS}, s AS (SELECT track AS line, idx, lat AS a, lead(lat) OVER (PARTITION BY track ORDER BY idx) AS b FROM tracks),
t AS (SELECT line, idx, CASE WHEN a = b THEN CASE WHEN a BETWEEN 44.25 AND 46.75 THEN 0 ELSE 1 END ELSE greatest(0, least((44.25 - a) / (b - a), (46.75 - a) / (b - a))) END AS t0,
  CASE WHEN a = b THEN CASE WHEN a BETWEEN 44.25 AND 46.75 THEN 1 ELSE 0 END ELSE least(1, greatest((44.25 - a) / (b - a), (46.75 - a) / (b - a))) END AS t1 FROM s WHERE b IS NOT NULL)
SELECT line, idx, round(t0, 6) AS t0, round(t1, 6) AS t1 FROM t WHERE t0 < t1""",
    "polyline_resample": f"""
WITH {fx.TRACKS}, k AS (SELECT track AS line, round_even(lat * 7, 0)::BIGINT AS k, avg(lon) AS v FROM tracks GROUP BY 1, 2),
p AS (SELECT *, lead(k) OVER (PARTITION BY line ORDER BY k) AS k2, lead(v) OVER (PARTITION BY line ORDER BY k) AS v2 FROM k),
e AS (SELECT *, unnest(range(k, coalesce(k2, k + 1))) AS "row" FROM p)
SELECT line, "row", round(v + coalesce((v2 - v) * (("row" - k)::DOUBLE / (k2 - k)), 0), 6) AS value FROM e""",
    "polyline_rows": f"""
WITH {fx.TRACKS}, k AS (SELECT track AS line, round_even(lat * 7, 0)::BIGINT AS k, avg(lon) AS v FROM tracks GROUP BY 1, 2),
g AS (SELECT line, unnest(range(least(300, min(k)), greatest(345, max(k)) + 1)) AS "row" FROM k GROUP BY line),
a AS (SELECT g.line, "row", max(k.k) FILTER (WHERE k.k <= "row") AS k0, min(k.k) FILTER (WHERE k.k >= "row") AS k1 FROM g JOIN k ON k.line = g.line GROUP BY ALL)
SELECT a.line, "row", round(CASE WHEN k0 IS NULL THEN y.v WHEN k1 IS NULL OR k1 = k0 THEN x.v ELSE x.v + (y.v - x.v) * (("row" - k0)::DOUBLE / (k1 - k0)) END, 6) AS value
FROM a LEFT JOIN k x ON x.line = a.line AND x.k = k0 LEFT JOIN k y ON y.line = a.line AND y.k = k1""",
    "relief_caps": f"""
WITH {fx.FILLED}, a AS (SELECT tile, r, c, z AS z0, {_SOFT} AS z FROM filled {_W('r', 'c')}), b AS (SELECT tile, r, c, greatest(100, least({_SOFT}, z0)) AS z FROM a {_W('c', 'r')}),
m AS (SELECT tile, r, c, min(z) OVER (PARTITION BY tile, r ORDER BY c ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS z FROM b)
SELECT tile, r, c, round(min(z) OVER (PARTITION BY tile, c ORDER BY r ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS z FROM m""",
    "graph_nodes": f"WITH {fx.TRACKS} SELECT track AS graph, round_even(lat * 2, 0)::BIGINT AS kr, round_even(lon * 2, 0)::BIGINT AS kc, arg_min(lat, idx) AS r, arg_min(lon, idx) AS c, count(*) AS n FROM tracks GROUP BY 1, 2, 3",
    "draw_order": f"""WITH {fx.TRACKS}, res AS (SELECT *, 2 * pi() * {_M} / 256 / 512 AS res FROM tracks)
SELECT floor((({_M} * radians(lon)) + pi() * {_M}) / res / 256)::BIGINT AS tx, floor((pi() * {_M} - {_M} * ln(tan(pi() / 4 + radians(lat) / 2))) / res / 256)::BIGINT AS ty,
  arg_max(track, struct_pack(e := ele, t := track, i := idx)) AS value FROM res GROUP BY 1, 2""",
    "local_crs": f"WITH {fx.TRACKS}, b AS (SELECT track, idx // 3 AS part, min(lon) AS w, max(lon) AS e FROM tracks GROUP BY ALL) SELECT track, part::BIGINT AS part, CASE WHEN e - w <= 6 THEN 32600 + least(floor(((w + e) / 2 + 180) / 6) + 1, 60) END::BIGINT AS epsg FROM b",
}
