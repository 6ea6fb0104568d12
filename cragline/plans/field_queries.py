"""Queries on distance fields, skylines, rays, seams and folds."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cragline.operators import fields as fi
from cragline.plans import fixtures as fx

S = fx.SIDE
AZIMUTHS = (180.0, 60.0, 235.0)
#: Of the seams: several levels of it lie among the heights.
INTERVAL = 600.0
MARKED = "(r * 5 + c * 11 + tile) % 23 = 0"


def distance_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fi.distance_field(fx.filled_dem(spark, sf_dir), F.expr(MARKED)).withColumn("d", F.round("d", 6))


def skyline_bake(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fi.skyline(fx.filled_dem(spark, sf_dir), S, 500.0, 1.0).withColumn("elevation", F.round("elevation", 6))


def skyline_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skylines towards three azimuths, one along the grid and two oblique."""
    return fi.skylines(fx.filled_dem(spark, sf_dir), S, 500.0, 1.0, AZIMUTHS).withColumn("elevation", F.round("elevation", 6))


def ray_oblique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rays that go two columns for each row, upwards on the map."""
    return fi.rays(fx.filled_dem(spark, sf_dir), S, (1.0, -0.5), 25.0, 0.5)


def ray_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fi.rays(fx.filled_dem(spark, sf_dir), S, (1.0, 0.0), 25.0, 0.5)


def corridor_seams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fi.seams(fx.filled_dem(spark, sf_dir), S, INTERVAL, 2.5).select("tile", F.round("cost", 6).alias("cost"))


def split_hysteresis(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = fx.tracks(spark, sf_dir).select(F.col("track").alias("line"), "idx", "lat")
    return fi.reversal_splits(lines, "lat", 1.5).select("line", "piece", F.round("at", 6).alias("at"))


def greedy_shadow(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.events(spark, sf_dir)
    lo = (F.col("event_id") * 37 % 1000).cast("double")
    return fi.longest_shadows(e.select(F.col("cell").alias("line"), F.col("event_id").alias("id"), lo.alias("lo"), (lo + F.col("event_id") % 90 + 1).alias("hi")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "distance_field": distance_field, "skyline_bake": skyline_bake, "ray_reference": ray_reference, "corridor_seams": corridor_seams,
    "split_hysteresis": split_hysteresis, "greedy_shadow": greedy_shadow, "skyline_directions": skyline_directions, "ray_oblique": ray_oblique,
}

def _sample_sql(of: str, x: str, y: str) -> tuple[str, str]:
    """DuckDB FROM items: the four corners of the surface at (x, y) of rows of; and z there, NULL off the raster."""
    corners = "".join(
        f"\n  LEFT JOIN filled k{i}{j} ON k{i}{j}.tile = {of}.tile AND k{i}{j}.r = floor({y})::INT + {i} AND k{i}{j}.c = floor({x})::INT + {j}" for i in (0, 1) for j in (0, 1)
    )
    fx_, fy = f"({x} - floor({x}))", f"({y} - floor({y}))"
    weigh = " + ".join(f"CASE WHEN {w} = 0 THEN 0 ELSE {w} * k{i}{j}.z END" for i, wy in ((0, f"(1 - {fy})"), (1, fy)) for j, wx in ((0, f"(1 - {fx_})"), (1, fx_)) for w in (f"({wy} * {wx})",))
    return f"{corners} WHERE true", weigh


_DIRECTIONS = ", ".join(f"({a}::DOUBLE, {round(math.sin(math.radians(a)), 12)!r}::DOUBLE, {round(-math.cos(math.radians(a)), 12)!r}::DOUBLE)" for a in AZIMUTHS)
_AHEAD = _sample_sql("s", "(s.c + s.dx * s.k)", "(s.r + s.dy * s.k)")
_ALONG = _sample_sql("s", "(s.c + s.k / 2.0::DOUBLE)", "(s.r - s.k / 4.0::DOUBLE)")

ORACLES: dict[str, str] = {
    "skyline_directions": f"""
WITH {fx.FILLED}, s AS (SELECT tile, r, c, z, a, dx, dy, k FROM filled CROSS JOIN (VALUES {_DIRECTIONS}) v(a, dx, dy) CROSS JOIN range(1, 24) t(k)),
seen AS (SELECT s.tile, s.r, s.c, a, s.z, k, {_AHEAD[1]} AS z2 FROM s {_AHEAD[0]})
SELECT tile, r, c, a AS azimuth, round(greatest(0, degrees(atan(coalesce(max((z2 - z - 1) / (k * 500.0::DOUBLE)), 0)))), 6) AS elevation FROM seen GROUP BY ALL""",
    # half steps; the middle and the end of each unit step with its begin give the quadratic
    "ray_oblique": f"""
WITH {fx.FILLED}, s AS (SELECT tile, r, c, z, k FROM filled CROSS JOIN range(0, {2 * S}) t(k)),
e AS (SELECT s.tile, s.r, s.c, k, {_ALONG[1]} - s.z - 0.5 - 12.5 * k AS f FROM s {_ALONG[0]}),
q AS (SELECT tile, r, c, k, f AS f0, lead(f, 1) OVER w AS f1, lead(f, 2) OVER w AS f2 FROM e WINDOW w AS (PARTITION BY tile, r, c ORDER BY k)),
t AS (SELECT *, 2 * (f0 - 2 * f1 + f2) AS a, 4 * f1 - 3 * f0 - f2 AS b FROM q WHERE k % 2 = 0 AND f2 IS NOT NULL),
hit AS (SELECT tile, r, c, bool_or(CASE WHEN a < 0 AND -b / (2 * a) > 0 AND -b / (2 * a) < 1 THEN f0 - b * b / (4 * a) ELSE greatest(f0, f2) END > 1e-3) AS h FROM t GROUP BY ALL)
SELECT f.tile, f.r, f.c, coalesce(h, false) AS blocked FROM filled f LEFT JOIN hit h ON h.tile = f.tile AND h.r = f.r AND h.c = f.c""",
    "distance_field": f"""WITH {fx.FILLED}, m AS (SELECT tile, r AS r2, c AS c2 FROM filled WHERE {MARKED}),
n AS (SELECT f.tile, r, c, min((pow(r - r2, 2) + pow(c - c2, 2), r2, c2)) FILTER (WHERE r2 IS NOT NULL) AS b FROM filled f LEFT JOIN m ON m.tile = f.tile GROUP BY f.tile, r, c)
SELECT tile, r, c, round(sqrt(b[1]), 6) AS d, b[2] AS mark_r, b[3] AS mark_c FROM n""",
    "skyline_bake": f"""WITH {fx.FILLED} SELECT a.tile, a.r, a.c, round(greatest(0, degrees(coalesce(max(atan2(b.z - a.z - 1, (b.c - a.c) * 500.0::DOUBLE)), 0))), 6) AS elevation
FROM filled a LEFT JOIN filled b ON b.tile = a.tile AND b.r = a.r AND b.c > a.c GROUP BY a.tile, a.r, a.c""",
    # along a row the bilinear surface is a line between cells, so the greatest excess is at a cell
    "ray_reference": f"""WITH {fx.FILLED} SELECT a.tile, a.r, a.c, coalesce(bool_or(b.z - a.z - 0.5 - 25 * (b.c - a.c) > 1e-3), false) AS blocked
FROM filled a LEFT JOIN filled b ON b.tile = a.tile AND b.r = a.r AND b.c > a.c GROUP BY a.tile, a.r, a.c""",
    "split_hysteresis": f"""
WITH {fx.TRACKS}, l AS (SELECT track AS line, list(lat ORDER BY idx) AS a FROM tracks GROUP BY track),
m AS (SELECT line, list_filter(list_transform(range(2, len(a) + 1), lambda i: struct_pack(a := a[i - 1], way := sign(a[i] - a[i - 1])::DOUBLE, back := abs(a[i] - a[i - 1]), cuts := []::DOUBLE[])), lambda x: x.back > 1e-12) AS moves FROM l),
f AS (SELECT line, list_reduce(list_prepend(struct_pack(a := 0::DOUBLE, way := 0::DOUBLE, back := 0::DOUBLE, cuts := []::DOUBLE[]), moves), lambda s, x:
  CASE WHEN s.way * x.way >= 0 THEN struct_pack(a := x.a, way := x.way, back := 0::DOUBLE, cuts := s.cuts)
       WHEN s.back + x.back < 1.5::DOUBLE - 1e-9 THEN struct_pack(a := x.a, way := s.way, back := s.back + x.back, cuts := s.cuts)
       ELSE struct_pack(a := x.a, way := x.way, back := 0::DOUBLE, cuts := list_append(s.cuts, x.a + x.way * (1.5::DOUBLE - s.back))) END) AS s FROM m)
SELECT line, (i - 1)::INT AS piece, round(s.cuts[i], 6) AS at FROM (SELECT line, s, unnest(range(1, len(s.cuts) + 1)) AS i FROM f)""",
    # a round takes the best span of each line and cuts the others
    "greedy_shadow": """
WITH RECURSIVE s(line, id, lo, hi, n, taken) AS (
  SELECT user_id, event_id, (event_id * 37 % 1000)::DOUBLE, (event_id * 37 % 1000 + event_id % 90 + 1)::DOUBLE, 0, false FROM events
  UNION ALL (WITH live AS (SELECT * FROM s WHERE NOT taken), b AS (SELECT line, id, lo, hi FROM live QUALIFY row_number() OVER (PARTITION BY line ORDER BY hi - lo DESC, id, lo) = 1)
    SELECT line, id, lo, hi, (SELECT max(n) FROM live) + 1, true FROM b
    UNION ALL SELECT l.line, l.id, l.lo, least(l.hi, b.lo), l.n + 1, false FROM live l JOIN b ON b.line = l.line WHERE least(l.hi, b.lo) > l.lo
    UNION ALL SELECT l.line, l.id, greatest(l.lo, b.hi), l.hi, l.n + 1, false FROM live l JOIN b ON b.line = l.line WHERE l.hi > greatest(l.lo, b.hi))
) SELECT line, n::BIGINT AS place, id, lo, hi FROM s WHERE taken""",
    "corridor_seams": f"""
WITH RECURSIVE {fx.FILLED}, p AS (SELECT tile, r, c, z, lead(z) OVER (PARTITION BY tile, r ORDER BY c) AS z2, 'h' AS kind FROM filled UNION ALL SELECT tile, r, c, z, lead(z) OVER (PARTITION BY tile, c ORDER BY r), 'v' FROM filled),
k AS (SELECT *, unnest(range(floor(least(z, z2) / {INTERVAL})::BIGINT + 1, floor(greatest(z, z2) / {INTERVAL})::BIGINT + 1)) * {INTERVAL}::DOUBLE AS level FROM p WHERE z2 <> z),
pts AS (SELECT DISTINCT tile, CASE WHEN kind = 'v' THEN r + (level - z) / (z2 - z) ELSE r END AS y, CASE WHEN kind = 'h' THEN c + (level - z) / (z2 - z) ELSE c END AS x FROM k),
ids AS (SELECT *, row_number() OVER (ORDER BY tile, y, x) AS id FROM pts),
e AS (SELECT a.id AS u, b.id AS v, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS w FROM ids a JOIN ids b ON a.tile = b.tile AND a.id <> b.id AND abs(a.y - b.y) <= 2.5 AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 2.5),
walk(id, d) USING KEY (id) AS (
  SELECT id, 0::DOUBLE FROM ids WHERE y <= 1
  UNION SELECT e.v, min(w.d + e.w) FROM walk w JOIN e ON e.u = w.id LEFT JOIN recurring.walk r ON r.id = e.v WHERE r.d IS NULL OR w.d + e.w < r.d GROUP BY e.v
)
SELECT tile, round(min(d), 6) AS cost FROM walk JOIN ids USING (id) WHERE y >= {S - 2} GROUP BY tile""",
}
