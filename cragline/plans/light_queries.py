"""Queries on shadow horizons from any side and on what a projector's light reaches."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cragline.operators import plane, projector, sweep
from cragline.plans import fixtures as fx
from cragline.session import table

SIDE = fx.SIDE * fx.MOSAIC
#: Towards the sun (east, north, up), more west than south; and the lengths of a column and a row.
SUN, SPACING = (-0.7, -0.31, 0.35), (50.0, 40.0)
#: Reliefs lie so far apart; heights become this much lower for the projector.
APART, FLATTER = 400.0, 600.0
LENS = projector.Projector((150.0, 80.0, 90.0), 0.1, 1.1, 1280, 720, (12.0, -7.0))


def horizon_oblique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shadow horizons of the reliefs under an oblique sun, in double and in single precision."""
    cells = fx.relief(spark, sf_dir)
    double, single = (sweep.horizons(cells, SPACING, SUN, s) for s in (False, True))
    joined = double.join(single.withColumnRenamed("horizon", "single"), ["raster", "r", "c"])
    return joined.select("raster", "r", "c", F.round("horizon", 6).alias("horizon"), F.round("single", 2).alias("single"))


def projector_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A place on a relief for each customer: its height, where it shows in the picture of a projector beside it, and whether light reaches it."""
    relief = fx.relief(spark, sf_dir)
    top = plane.grid_solids(relief.withColumn("z", F.col("z") / FLATTER).withColumnRenamed("raster", "tile"), 0.0, top_only=True)
    moved = lambda a, i: F.col(f"{a}{i}") + (APART * F.col("mesh") if a == "x" else 0.0)
    mesh = top.select((F.col("mesh") * (1 << 40) + F.col("tri")).alias("tri"), *[moved(a, i).alias(f"{a}{i}") for i in (1, 2, 3) for a in "xyz"])
    k = F.col("c_custkey")
    count = relief.agg((F.max("raster") + 1).alias("n"))  # one row
    at = table(spark, sf_dir, "customer").crossJoin(F.broadcast(count)).select(k.alias("id"), (APART * (k % F.col("n"))).alias("ox"), (k * 37 % 12_907 / 100.0 + 0.063).alias("x"), (k * 91 % 12_907 / 100.0 + 0.029).alias("y"))
    placed = at.select("id", (F.col("ox") + F.col("x")).alias("x"), (-F.col("y")).alias("y"), (F.col("ox") + SIDE / 2).alias("ox"), F.lit(-SIDE / 2.0).alias("oy"))
    found = projector.point_query(placed, mesh, LENS, 2.0)
    return found.select("id", "status", *[F.round(c, 4).alias(c) for c in ("z", "u", "v")])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"horizon_oblique": horizon_oblique, "projector_points": projector_points}

_EAST, _SOUTH = SUN[0] / SPACING[0], -SUN[1] / SPACING[1]
assert abs(_EAST) >= abs(_SOUTH) and _EAST < 0  # the SQL goes column by column from the west
_OFFSET, _FALL = _SOUTH / abs(_EAST), SUN[2] / abs(_EAST)
_SHIFT = math.floor(_OFFSET)


def _swept(name: str, kind: str) -> str:
    part, fall = f"{_OFFSET - _SHIFT!r}::{kind}", f"{_FALL!r}::{kind}"
    low, high = f"h.v[i + {_SHIFT}]", f"h.v[i + {_SHIFT + 1}]"
    inside = f"i + {_SHIFT} >= 1 AND i + {_SHIFT + 1} <= len(l.v)"
    up = f"CASE WHEN {inside} THEN {low} + ({high} - {low}) * {part} - {fall} END"
    return f"""{name}(raster, k, v) AS (SELECT raster, k, v::{kind}[] FROM lines WHERE k = 0 UNION ALL
  SELECT l.raster, l.k, list_transform(l.v, lambda z, i: CASE WHEN z IS NOT NULL THEN greatest(z::{kind}, coalesce({up}, z::{kind})) END) FROM {name} h JOIN lines l ON l.raster = h.raster AND l.k = h.k + 1)"""


_M = [[f"({v!r})::DOUBLE" for v in row] for row in LENS.matrix().tolist()]
_EYE = LENS.place

ORACLES: dict[str, str] = {
    "horizon_oblique": f"""
WITH RECURSIVE {fx.RELIEF}, size AS (SELECT raster, max(r) + 1 AS h, max(c) + 1 AS w FROM relief GROUP BY raster),
grid AS (SELECT s.raster, c.c, r.r, z FROM size s CROSS JOIN range({SIDE}) c(c) CROSS JOIN range({SIDE}) r(r) LEFT JOIN relief f ON f.raster = s.raster AND f.r = r.r AND f.c = c.c WHERE r.r < s.h AND c.c < s.w),
lines AS MATERIALIZED (SELECT raster, c AS k, list(z ORDER BY r) AS v FROM grid GROUP BY raster, c), {_swept('a', 'DOUBLE')}, {_swept('b', 'FLOAT')}
SELECT f.raster, f.r, f.c, round(a.v[f.r + 1], 6) AS horizon, round(b.v[f.r + 1]::DOUBLE, 2) AS single FROM relief f JOIN a ON a.raster = f.raster AND a.k = f.c JOIN b ON b.raster = f.raster AND b.k = f.c""",
    # light is tried against all triangles of the relief
    "projector_points": f"""
WITH {fx.RELIEF}, f AS (SELECT raster, r, c, z / {FLATTER}::DOUBLE AS z FROM relief),
sq AS (SELECT a.raster, a.r, a.c, a.z AS nw, b.z AS ne, d.z AS sw, e.z AS se FROM f a JOIN f b ON b.raster = a.raster AND b.r = a.r AND b.c = a.c + 1
  JOIN f d ON d.raster = a.raster AND d.r = a.r + 1 AND d.c = a.c JOIN f e ON e.raster = a.raster AND e.r = a.r + 1 AND e.c = a.c + 1),
k AS (SELECT c_custkey AS id, c_custkey % (SELECT max(raster) + 1 FROM relief) AS raster, c_custkey * 37 % 12907 / 100.0::DOUBLE + 0.063::DOUBLE AS x, c_custkey * 91 % 12907 / 100.0::DOUBLE + 0.029::DOUBLE AS y FROM customer),
h AS (SELECT k.*, CASE WHEN y - r >= x - c THEN nw + (y - r) * (sw - nw) + (x - c) * (se - sw) ELSE nw + (x - c) * (ne - nw) + (y - r) * (se - ne) END AS z
  FROM k LEFT JOIN sq ON sq.raster = k.raster AND sq.r = floor(y) AND sq.c = floor(x)),
p AS (SELECT *, x - {SIDE / 2} AS px, {SIDE / 2} - y AS py FROM h), d AS (SELECT *, px - {_EYE[0]} AS dx, py - {_EYE[1]} AS dy, z - {_EYE[2]} AS dz FROM p),
w AS (SELECT *, {_M[2][0]} * px + {_M[2][1]} * py + {_M[2][2]} * z + {_M[2][3]} AS w FROM d),
uv AS (SELECT *, CASE WHEN w > 0 THEN ({_M[0][0]} * px + {_M[0][1]} * py + {_M[0][2]} * z + {_M[0][3]}) / w END AS u, CASE WHEN w > 0 THEN ({_M[1][0]} * px + {_M[1][1]} * py + {_M[1][2]} * z + {_M[1][3]}) / w END AS v, sqrt(dx * dx + dy * dy + dz * dz) AS far FROM w),
tri AS (SELECT raster, c - {SIDE / 2} AS x1, {SIDE / 2} - r AS y1, nw AS z1, 0 AS ax, -1 AS ay, sw - nw AS az, 1 AS gx, -1 AS gy, se - nw AS gz FROM sq UNION ALL SELECT raster, c - {SIDE / 2}, {SIDE / 2} - r, nw, 1, -1, se - nw, 1, 0, ne - nw FROM sq),
m AS (SELECT q.id, q.dx / far AS dx, q.dy / far AS dy, q.dz / far AS dz, {_EYE[0]} - x1 AS sx, {_EYE[1]} - y1 AS sy, {_EYE[2]} - z1 AS sz, ax, ay, az, gx, gy, gz FROM uv q JOIN tri t ON t.raster = q.raster WHERE q.z IS NOT NULL),
x AS (SELECT *, dy * gz - dz * gy AS hx, dz * gx - dx * gz AS hy, dx * gy - dy * gx AS hz, sy * az - sz * ay AS qx, sz * ax - sx * az AS qy, sx * ay - sy * ax AS qz FROM m),
y AS (SELECT id, ax * hx + ay * hy + az * hz AS det, sx * hx + sy * hy + sz * hz AS u, dx * qx + dy * qy + dz * qz AS v, gx * qx + gy * qy + gz * qz AS t FROM x),
first AS (SELECT id, min(t / det) AS t FROM y WHERE det <> 0 AND u / det >= -1e-9 AND v / det >= -1e-9 AND (u + v) / det <= 1 + 1e-9 AND t / det > 1e-9 GROUP BY id)
SELECT q.id, CASE WHEN z IS NULL THEN 'miss' WHEN u IS NULL OR NOT (u >= 0 AND u < {LENS.width} AND v >= 0 AND v < {LENS.height}) THEN 'outside' WHEN abs(first.t - far) < 0.02 THEN 'visible' ELSE 'hidden' END AS status,
  round(z, 4) AS z, round(u, 4) AS u, round(v, 4) AS v FROM uv q LEFT JOIN first ON first.id = q.id""",
}
