"""Queries on rasters of many tiles: 128 x 128 cells each, cut into 4 x 4 tiles."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cragline.operators import contours, sightlines, tiles
from cragline.plans import fixtures as fx
from cragline.plans import raster_queries as rq

SIDE = fx.SIDE * fx.MOSAIC
#: Cells of a tile's side, which the results don't depend on.
TILE = SIDE // 4
AZIMUTH, SPACING, BIAS = 235.0, 40.0, 1.0
DIRECTION, RISE = (1.0, -0.5), 25.0
INTERVAL, PAD = 300.0, 3


def mosaic_half(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rasters halved with one limit each; places without a supplier are void."""
    return tiles.half(fx.relief(spark, sf_dir), TILE, PAD, (SIDE, SIDE)).withColumn("z", F.round("z", 6) + 0.0)


def mosaic_skylines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skylines towards the south-west over tile borders."""
    return sightlines.skylines(fx.relief(spark, sf_dir), TILE, SPACING, BIAS, AZIMUTH).withColumn("elevation", F.round("elevation", 6))


def mosaic_rays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rays that go two columns for each row, upwards on the map, over tile borders."""
    return sightlines.rays(fx.relief(spark, sf_dir), TILE, DIRECTION, RISE, 0.5)


def mosaic_contours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every point of every contour line, in order, joined over tile borders."""
    lines = contours.contour_lines(fx.relief(spark, sf_dir), TILE, INTERVAL)
    return lines.withColumns({a: F.round(a, 6) for a in "xy"})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "mosaic_half": mosaic_half, "mosaic_skylines": mosaic_skylines, "mosaic_rays": mosaic_rays, "mosaic_contours": mosaic_contours,
}


def _sampled(x: str, y: str) -> tuple[str, str]:
    """DuckDB FROM items: the four corners of the surface at (x, y) of rows s; and z there, NULL where a corner that counts is absent."""
    corners = "".join(
        f"\n  LEFT JOIN relief k{i}{j} ON k{i}{j}.raster = s.raster AND k{i}{j}.r = floor({y})::INT + {i} AND k{i}{j}.c = floor({x})::INT + {j}" for i in (0, 1) for j in (0, 1)
    )
    fx_, fy = f"({x} - floor({x}))", f"({y} - floor({y}))"
    weigh = " + ".join(f"CASE WHEN {w} = 0 THEN 0 ELSE {w} * k{i}{j}.z END" for i, wy in ((0, f"(1 - {fy})"), (1, fy)) for j, wx in ((0, f"(1 - {fx_})"), (1, fx_)) for w in (f"({wy} * {wx})",))
    return corners, weigh


_DX, _DY = (f"({round(f(math.radians(AZIMUTH)), 12)!r})::DOUBLE" for f in (math.sin, lambda a: -math.cos(a)))
_AHEAD = _sampled(f"(s.c + {_DX} * s.k)", f"(s.r + {_DY} * s.k)")
_ALONG = _sampled("(s.c + s.k / 2.0::DOUBLE)", "(s.r - s.k / 4.0::DOUBLE)")
_GRID = f"""g AS (SELECT t.raster AS tile, r.r::INT AS r, c.c::INT AS c, d.z FROM (SELECT DISTINCT raster FROM relief) t CROSS JOIN range({SIDE}) r(r) CROSS JOIN range({SIDE}) c(c)
  LEFT JOIN relief d ON d.raster = t.raster AND d.r = r.r AND d.c = c.c)"""
_NAME = "(({r}) * 16777216::BIGINT + ({c})) * 2 + {d}"
_EDGE = "CASE WHEN ({p} >= level) <> ({q} >= level) THEN struct_pack(p := {name}, x := ({x})::DOUBLE, y := ({y})::DOUBLE) END"


def _edge(p: str, q: str, r: str, c: str, d: int) -> str:
    share = f"(level - {p}) / ({q} - {p})"
    x, y = (c, f"{r} + {share}") if d else (f"{c} + {share}", r)
    return _EDGE.format(p=p, q=q, name=_NAME.format(r=r, c=c, d=d), x=x, y=y)


ORACLES: dict[str, str] = {
    "mosaic_half": f"""
WITH {fx.RELIEF}, {_GRID},
{rq._smooth_sql('w', 'g', '(z IS NOT NULL)::INT::DOUBLE', SIDE, PAD)}, {rq._smooth_sql('m', 'g', 'coalesce(z, 0)', SIDE, PAD)}, k AS (SELECT tile, quantile_cont(z, 0.5) AS med FROM g GROUP BY tile),
f AS (SELECT g.tile, g.r, g.c, g.z AS own, coalesce(g.z, CASE WHEN w.v > 1e-12 THEN m.v / w.v ELSE k.med END) AS z FROM g JOIN w ON w.tile = g.tile AND w.r = g.r AND w.c = g.c JOIN m ON m.tile = g.tile AND m.r = g.r AND m.c = g.c JOIN k ON k.tile = g.tile),
{rq._smooth_sql('s', 'f', 'z', SIDE, PAD)},
l AS (SELECT f.tile, f.r // 2 AS r, f.c // 2 AS c, avg(v - z) AS lap, min(own) AS lo, max(own) AS hi, quantile_cont(own, 0.5) AS med FROM f JOIN s ON s.tile = f.tile AND s.r = f.r AND s.c = f.c GROUP BY 1, 2, 3 HAVING count(own) > 0),
t AS (SELECT tile, quantile_cont(abs(lap), 0.25) AS lim FROM l GROUP BY tile)
SELECT l.tile AS raster, r::INT AS r, c::INT AS c, round(CASE WHEN lap > lim THEN lo WHEN lap < -lim THEN hi ELSE med END, 6) AS z FROM l JOIN t ON t.tile = l.tile""",
    "mosaic_skylines": f"""
WITH {fx.RELIEF}, s AS (SELECT raster, r, c, z, k FROM relief CROSS JOIN range(1, {SIDE * 3 // 2}) t(k)),
seen AS (SELECT s.raster, s.r, s.c, s.z, k, {_AHEAD[1]} AS z2 FROM s {_AHEAD[0]})
SELECT raster, r, c, round(greatest(0, degrees(atan(coalesce(max((z2 - z - {BIAS}) / (k * {SPACING}::DOUBLE)), 0)))), 6) AS elevation FROM seen GROUP BY ALL""",
    # half steps; the middle and the end of each unit step with its begin give the quadratic
    "mosaic_rays": f"""
WITH {fx.RELIEF}, s AS (SELECT raster, r, c, z, k FROM relief CROSS JOIN range(0, {2 * SIDE}) t(k) WHERE c + k / 2.0 <= {SIDE} AND r - k / 4.0 >= -1),
e AS (SELECT s.raster, s.r, s.c, k, {_ALONG[1]} - s.z - 0.5 - {RISE / 2} * k AS f FROM s {_ALONG[0]}),
q AS (SELECT raster, r, c, k, f AS f0, lead(f, 1) OVER w AS f1, lead(f, 2) OVER w AS f2 FROM e WINDOW w AS (PARTITION BY raster, r, c ORDER BY k)),
t AS (SELECT *, 2 * (f0 - 2 * f1 + f2) AS a, 4 * f1 - 3 * f0 - f2 AS b FROM q WHERE k % 2 = 0 AND f1 IS NOT NULL),
hit AS (SELECT raster, r, c, bool_or(CASE WHEN a < 0 AND -b / (2 * a) > 0 AND -b / (2 * a) < 1 THEN f0 - b * b / (4 * a) ELSE greatest(f0, f2) END > 1e-3) AS h FROM t GROUP BY ALL)
SELECT f.raster, f.r, f.c, coalesce(h, false) AS blocked FROM relief f LEFT JOIN hit h ON h.raster = f.raster AND h.r = f.r AND h.c = f.c""",
    # lines are walked from both ends, and from each crossing that is less than those beside it until a lesser one comes
    "mosaic_contours": f"""
WITH RECURSIVE {fx.RELIEF}, sq AS (SELECT a.raster, a.r, a.c, a.z AS a, b.z AS b, d.z AS d, e.z AS e FROM relief a JOIN relief b ON b.raster = a.raster AND b.r = a.r AND b.c = a.c + 1
  JOIN relief d ON d.raster = a.raster AND d.r = a.r + 1 AND d.c = a.c JOIN relief e ON e.raster = a.raster AND e.r = a.r + 1 AND e.c = a.c + 1),
lv AS (SELECT *, unnest(range(floor(least(a, b, d, e) / {INTERVAL})::BIGINT + 1, floor(greatest(a, b, d, e) / {INTERVAL})::BIGINT + 1)) * {INTERVAL}::DOUBLE AS level FROM sq),
cr AS (SELECT *, {_edge('a', 'b', 'r', 'c', 0)} AS top, {_edge('d', 'e', 'r + 1', 'c', 0)} AS bottom, {_edge('a', 'd', 'r', 'c', 1)} AS lft, {_edge('b', 'e', 'r', 'c + 1', 1)} AS rgt FROM lv),
sg AS (SELECT raster, level, unnest(CASE WHEN top IS NOT NULL AND bottom IS NOT NULL AND lft IS NOT NULL AND rgt IS NOT NULL
    THEN CASE WHEN (a >= level) = ((a + b + d + e) / 4 >= level) THEN [[top, rgt], [lft, bottom]] ELSE [[top, lft], [rgt, bottom]] END
    ELSE [list_filter([top, lft, rgt, bottom], lambda x: x IS NOT NULL)] END) AS g FROM cr),
ways AS (SELECT raster, level, g[1] AS p, g[2].p AS q FROM sg UNION ALL SELECT raster, level, g[2], g[1].p FROM sg),
nb AS MATERIALIZED (SELECT raster, level, p.p AS p, any_value(p.x) AS x, any_value(p.y) AS y, min(q) AS a, CASE WHEN count(*) = 2 THEN max(q) END AS b FROM ways GROUP BY raster, level, p.p),
walk(raster, level, line, idx, before, cur, loose) AS (
  SELECT raster, level, p, 0, p, p, b IS NULL FROM nb WHERE b IS NULL OR (p < a AND p < b)
  UNION ALL SELECT w.raster, w.level, w.line, w.idx + 1, w.cur, CASE WHEN w.idx = 0 OR n.b = w.before THEN n.a ELSE n.b END, w.loose
    FROM walk w JOIN nb n ON n.raster = w.raster AND n.level = w.level AND n.p = w.cur WHERE (w.idx = 0 OR (n.b IS NOT NULL AND w.cur <> w.line)) AND (w.loose OR w.cur >= w.line)),
ended AS (SELECT raster, level, line, loose, arg_max(cur, idx) AS last FROM walk GROUP BY ALL HAVING CASE WHEN loose THEN line < arg_max(cur, idx) ELSE line = arg_max(cur, idx) END)
SELECT w.raster, w.level, w.line, w.idx::BIGINT AS idx, round(n.x, 6) AS x, round(n.y, 6) AS y, NOT w.loose AS closed
FROM walk w JOIN ended e ON e.raster = w.raster AND e.level = w.level AND e.line = w.line AND e.loose = w.loose JOIN nb n ON n.raster = w.raster AND n.level = w.level AND n.p = w.cur""",
}
