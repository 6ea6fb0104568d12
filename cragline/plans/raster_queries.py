"""Queries on rasters: one tile a supplier."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cragline.operators import raster as ra
from cragline.plans import fixtures as fx

S = fx.SIDE
SUN, RISE, OFFSET = (0.6, 0.48, 0.64), 25.0, 0.375
#: The fixture's heights run from about -740 to 1,340: the sea, what counts as void and how deep it is are among them.
SEA, VOID, FLOOR, STEEP, INTERVAL = 120.0, -700.0, -350.0, 800.0, 250.0
#: Another coast.
COAST, COAST_VOID, COAST_FLOOR, COAST_STEEP = 300.0, -900.0, -200.0, 500.0


def _rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) + 0.0 for c in columns})


def dem_clean_voids(spark: SparkSession, sf_dir: str, sea: float = SEA, void: float = VOID) -> DataFrame:
    cells = ra.clamp_negative(ra.clean_voids(fx.dem(spark, sf_dir).withColumn("z", F.col("z") - sea), void))
    return cells.select("tile", "r", "c", F.round(F.when(F.isnan("z"), None).otherwise(F.col("z")), 6).alias("z"))


def dem_sea_level(spark: SparkSession, sf_dir: str, sea: float = SEA, floor: float = FLOOR) -> DataFrame:
    cells = fx.dem(spark, sf_dir).withColumn("z", F.col("z") - sea)
    done = ra.sea_level(cells, (F.col("r") * 7 + F.col("c") * 3) % 5 != 0, floor, 4)
    return done.select("tile", "r", "c", F.round(F.when(F.isnan("z"), None).otherwise(F.col("z")), 6).alias("z"))


def dem_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ra.blocks(fx.dem(spark, sf_dir)), "low", "high", "mean", "median")


def dem_box_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ra.box_mean(fx.filled_dem(spark, sf_dir), S, 3), "mean")


def dem_half(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ra.half(fx.filled_dem(spark, sf_dir), S), "z")


def dem_half_voids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same on tiles with voids and absent cells."""
    return _rounded(ra.half(fx.dem(spark, sf_dir), S, 3), "z")


def dem_nozzle_pyramid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Halved twice, since a third time would make pixels wider than half a nozzle."""
    return _rounded(ra.nozzle_pyramid(fx.filled_dem(spark, sf_dir), S, 0.8, 0.72, 0.4), "z")


def dem_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ra.normals(fx.filled_dem(spark, sf_dir), 500.0, 500.0), "nx", "ny", "nz").drop("z")


def dem_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cragline.session import table

    k = F.col("o_orderkey")
    tiles = table(spark, sf_dir, "supplier").agg(F.count(F.lit(1)).alias("tiles"))
    points = table(spark, sf_dir, "orders").crossJoin(F.broadcast(tiles)).select(
        k.alias("id"), (F.col("o_custkey") % F.col("tiles")).alias("tile"), (k * 37 % 1700 / 100.0 - 0.5).alias("y"), (k * 91 % 1700 / 100.0 - 0.5).alias("x")
    )
    return _rounded(ra.bilinear(points, fx.filled_dem(spark, sf_dir), S), "z", places=7)


def dem_height_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = fx.dem(spark, sf_dir)
    top = cells.where(~F.isnan("z")).groupBy("tile").agg(F.max("z").alias("top"))
    curved = ra.height_curve(cells.join(top, "tile"), F.lit(0.0), F.col("top"), 1.5, 30.0, 0.7)
    return _rounded(curved.select("tile", "r", "c", "mm"), "mm")


def contour_levels(spark: SparkSession, sf_dir: str, threshold: float = STEEP) -> DataFrame:
    ranges = fx.dem(spark, sf_dir).where(~F.isnan("z")).groupBy("tile").agg(F.min("z").alias("low"), F.max("z").alias("high"))
    return ra.contour_levels(ranges, threshold, 100.0, 500.0)


def contour_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ra.contour_crossings(fx.filled_dem(spark, sf_dir), INTERVAL), "r", "c")


def horizon_cardinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ra.horizon_cardinal(fx.filled_dem(spark, sf_dir), RISE), "horizon").drop("z")


def horizon_sheared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ra.horizon_sheared(fx.filled_dem(spark, sf_dir), S, OFFSET, RISE), "horizon")


def shade_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = ra.normals(ra.horizon_cardinal(fx.filled_dem(spark, sf_dir), RISE), 500.0, 500.0)
    lit = ra.shaded(cells, SUN, 0.2, 0.5)
    return lit.select("tile", "r", "c", "light", ra.exposed(F.col("light"), 1.1, 0.05, 1 / 2.2).alias("exposed"))


def layer_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Satellite colour under light, then contours, then a river line, each blended over what is below."""
    from pyspark.sql import Window

    cells = fx.filled_dem(spark, sf_dir)
    row, column = ra.along_row(), ra.along_column()
    diff = lambda f, w: F.coalesce(f("z").over(w), F.col("z"))
    gx, gy = F.abs(diff(F.lead, row) - diff(F.lag, row)) / 2, F.abs(diff(F.lead, column) - diff(F.lag, column)) / 2
    light = (F.col("r") * 16 + F.col("c")).cast("double")
    base = 255 * (1 - F.lit(0.8)) + (50 + F.col("r") * 10) * 0.8
    inked = ra.blended(base * light / 255, 120.0, ra.contour_alpha(F.col("z"), gx + gy, INTERVAL, 1.5))
    river = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - F.abs(F.col("r") - F.col("c")) / 2.0))
    return cells.select("tile", "r", "c", F.rint(F.greatest(F.lit(0.0), F.least(F.lit(255.0), ra.blended(inked, 30.0, river)))).cast("int").alias("value"))


def _mirror_sql(axis: str, pad: int) -> str:
    return f"unnest(list_filter([{axis}, CASE WHEN {axis} BETWEEN 1 AND {pad} THEN -{axis} END, CASE WHEN {axis} < {S - 1} AND {axis} >= {S - 1 - pad} THEN {2 * (S - 1)} - {axis} END], lambda x: x IS NOT NULL))"


def _box_sql(pad: int, source: str = "filled") -> str:
    return f"""ax AS (SELECT tile, r, c, z, {_mirror_sql('c', pad)} AS a FROM {source}),
bx AS (SELECT tile, r, c, a, avg(z) OVER (PARTITION BY tile, r ORDER BY a ROWS BETWEEN {pad} PRECEDING AND {pad} FOLLOWING) AS v FROM ax QUALIFY a = c),
ay AS (SELECT tile, r, c, v, {_mirror_sql('r', pad)} AS b FROM bx),
box AS (SELECT tile, r, c, avg(v) OVER (PARTITION BY tile, c ORDER BY b ROWS BETWEEN {pad} PRECEDING AND {pad} FOLLOWING) AS mean, b FROM ay QUALIFY b = r)"""


def _mirrored(side: int, axis: str, pad: int) -> str:
    return f"unnest(list_filter([{axis}, CASE WHEN {axis} BETWEEN 1 AND {pad} THEN -{axis} END, CASE WHEN {axis} < {side - 1} AND {axis} >= {side - 1 - pad} THEN {2 * (side - 1)} - {axis} END], lambda x: x IS NOT NULL))"


def _smooth_sql(name: str, source: str, column: str, side: int, pad: int) -> str:
    """A table name (tile, r, c, v): means of a column of source over squares."""
    rows = f"ROWS BETWEEN {pad} PRECEDING AND {pad} FOLLOWING"
    return f"""{name}_a AS (SELECT tile, r, c, {column} AS v, {_mirrored(side, 'c', pad)} AS a FROM {source}),
{name}_b AS (SELECT tile, r, c, a, avg(v) OVER (PARTITION BY tile, r ORDER BY a {rows}) AS v FROM {name}_a QUALIFY a = c),
{name}_c AS (SELECT tile, r, c, v, {_mirrored(side, 'r', pad)} AS b FROM {name}_b),
{name} AS (SELECT tile, r, c, avg(v) OVER (PARTITION BY tile, c ORDER BY b {rows}) AS v, b FROM {name}_c QUALIFY b = r)"""


def _half_sql(name: str, source: str, side: int, pad: int) -> str:
    """A table name (tile, r, c, z): source (dense, valid) halved."""
    return f"""{_smooth_sql(name + '_s', source, 'z', side, pad)},
{name}_l AS (SELECT f.tile, f.r // 2 AS r, f.c // 2 AS c, avg(v - z) AS lap, min(z) AS lo, max(z) AS hi, quantile_cont(z, 0.5) AS med FROM {source} f JOIN {name}_s s ON s.tile = f.tile AND s.r = f.r AND s.c = f.c GROUP BY 1, 2, 3),
{name}_t AS (SELECT tile, quantile_cont(abs(lap), 0.25) AS lim FROM {name}_l GROUP BY tile),
{name} AS (SELECT l.tile, r::INT AS r, c::INT AS c, CASE WHEN lap > lim THEN lo WHEN lap < -lim THEN hi ELSE med END AS z FROM {name}_l l JOIN {name}_t t ON t.tile = l.tile)"""


_VALID = "SELECT * FROM dem WHERE NOT isnan(z)"
_CARDINAL = f"k AS (SELECT *, {S} - c AS k FROM filled), h AS (SELECT tile, r, c, z, max(z + {RISE} * k) OVER (PARTITION BY tile, r ORDER BY k) - {RISE} * k AS horizon FROM k)"
_NORMALS = """n0 AS (SELECT *, -(coalesce(lead(z) OVER x, z) - coalesce(lag(z) OVER x, z)) / ((coalesce(lead(c) OVER x, c) - coalesce(lag(c) OVER x, c)) * 500.0::DOUBLE) AS sx,
  (coalesce(lead(z) OVER y, z) - coalesce(lag(z) OVER y, z)) / ((coalesce(lead(r) OVER y, r) - coalesce(lag(r) OVER y, r)) * 500.0::DOUBLE) AS sy
  FROM SRC WINDOW x AS (PARTITION BY tile, r ORDER BY c), y AS (PARTITION BY tile, c ORDER BY r)),
n AS (SELECT *, sx / sqrt(sx * sx + sy * sy + 1) AS nx, sy / sqrt(sx * sx + sy * sy + 1) AS ny, 1 / sqrt(sx * sx + sy * sy + 1) AS nz FROM n0)"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "dem_clean_voids": dem_clean_voids, "dem_sea_level": dem_sea_level, "dem_blocks": dem_blocks, "dem_box_mean": dem_box_mean, "dem_half_pyramid": dem_half,
    "dem_half_voids": dem_half_voids, "dem_nozzle_pyramid": dem_nozzle_pyramid,
    "dem_max_pyramid": lambda s, d: _rounded(ra.max_pyramid(fx.dem(s, d), 4), "z"), "dem_normals": dem_normals, "dem_bilinear": dem_bilinear,
    "dem_height_curve": dem_height_curve, "contour_levels": contour_levels, "contour_crossings": contour_crossings, "horizon_cardinal": horizon_cardinal,
    "horizon_sheared": horizon_sheared, "shade_cells": shade_cells, "layer_composite": layer_composite,
    "dem_clean_voids_coast": lambda s, d: dem_clean_voids(s, d, COAST, COAST_VOID), "dem_sea_level_coast": lambda s, d: dem_sea_level(s, d, COAST, COAST_FLOOR),
    "contour_levels_coast": lambda s, d: contour_levels(s, d, COAST_STEEP),
}

ORACLES: dict[str, str] = {
    "dem_clean_voids": f"WITH {fx.DEM} SELECT tile, r, c, round(CASE WHEN isnan(z) OR z - {SEA} <= {VOID} THEN NULL WHEN z < {SEA} THEN 0 ELSE z - {SEA} END, 6) AS z FROM dem",
    "dem_sea_level": f"""
WITH RECURSIVE {fx.DEM}, below AS (SELECT tile, r, c FROM dem WHERE NOT isnan(z) AND z < {SEA} AND (r * 7 + c * 3) % 5 <> 0),
reach(tile, r, c, r0, c0) AS (
  SELECT tile, r, c, r, c FROM below
  UNION SELECT b.tile, b.r, b.c, x.r0, x.c0 FROM reach x JOIN below b ON b.tile = x.tile AND abs(b.r - x.r) + abs(b.c - x.c) = 1
), sizes AS (SELECT tile, r0 AS r, c0 AS c, count(*) AS size FROM reach GROUP BY 1, 2, 3)
SELECT d.tile, d.r, d.c, round(CASE WHEN isnan(z) THEN NULL WHEN z >= {SEA} THEN z - {SEA} WHEN size >= 4 THEN greatest(z - {SEA}, {FLOOR}) ELSE 0 END, 6) AS z
FROM dem d LEFT JOIN sizes s ON s.tile = d.tile AND s.r = d.r AND s.c = d.c""",
    "dem_blocks": f"WITH {fx.DEM} SELECT tile, (r // 2)::INT AS r, (c // 2)::INT AS c, round(min(z), 6) AS low, round(max(z), 6) AS high, round(avg(z), 6) AS mean, round(quantile_cont(z, 0.5), 6) AS median, count(*) AS n FROM ({_VALID}) GROUP BY 1, 2, 3",
    "dem_box_mean": f"WITH {fx.FILLED}, {_box_sql(3)} SELECT tile, r, c, round(mean, 6) AS mean FROM box",
    "dem_half_pyramid": f"""
WITH {fx.FILLED}, {_box_sql(12)}, lap AS (SELECT f.tile, f.r // 2 AS r, f.c // 2 AS c, avg(mean - z) AS lap FROM filled f JOIN box b ON b.tile = f.tile AND b.r = f.r AND b.c = f.c GROUP BY 1, 2, 3),
lim AS (SELECT tile, quantile_cont(abs(lap), 0.25) AS lim FROM lap GROUP BY tile),
b AS (SELECT tile, r // 2 AS r, c // 2 AS c, min(z) AS lo, max(z) AS hi, quantile_cont(z, 0.5) AS med FROM filled GROUP BY 1, 2, 3)
SELECT b.tile, b.r::INT AS r, b.c::INT AS c, round(CASE WHEN lap > lim THEN lo WHEN lap < -lim THEN hi ELSE med END, 6) AS z FROM b JOIN lap l ON l.tile = b.tile AND l.r = b.r AND l.c = b.c JOIN lim ON lim.tile = b.tile""",
    "dem_half_voids": f"""
WITH {fx.DEM}, g AS (SELECT t.tile, r.r::INT AS r, c.c::INT AS c, CASE WHEN NOT isnan(d.z) THEN d.z END AS z FROM (SELECT DISTINCT tile FROM dem) t CROSS JOIN range({S}) r(r) CROSS JOIN range({S}) c(c) LEFT JOIN dem d ON d.tile = t.tile AND d.r = r.r AND d.c = c.c),
{_smooth_sql('w', 'g', '(z IS NOT NULL)::INT::DOUBLE', S, 3)}, {_smooth_sql('m', 'g', 'coalesce(z, 0)', S, 3)}, k AS (SELECT tile, quantile_cont(z, 0.5) AS med FROM g GROUP BY tile),
f AS (SELECT g.tile, g.r, g.c, g.z AS own, coalesce(g.z, CASE WHEN w.v > 1e-12 THEN m.v / w.v ELSE k.med END) AS z FROM g JOIN w ON w.tile = g.tile AND w.r = g.r AND w.c = g.c JOIN m ON m.tile = g.tile AND m.r = g.r AND m.c = g.c JOIN k ON k.tile = g.tile),
{_smooth_sql('s', 'f', 'z', S, 3)},
l AS (SELECT f.tile, f.r // 2 AS r, f.c // 2 AS c, avg(v - z) AS lap, min(own) AS lo, max(own) AS hi, quantile_cont(own, 0.5) AS med FROM f JOIN s ON s.tile = f.tile AND s.r = f.r AND s.c = f.c GROUP BY 1, 2, 3 HAVING count(own) > 0),
t AS (SELECT tile, quantile_cont(abs(lap), 0.25) AS lim FROM l GROUP BY tile)
SELECT l.tile, r::INT AS r, c::INT AS c, round(CASE WHEN lap > lim THEN lo WHEN lap < -lim THEN hi ELSE med END, 6) AS z FROM l JOIN t ON t.tile = l.tile""",
    "dem_nozzle_pyramid": f"WITH {fx.FILLED}, {_half_sql('h1', 'filled', S, 12)}, {_half_sql('h2', 'h1', S // 2, 7)} SELECT tile, r, c, round(z, 6) AS z FROM h2",
    "dem_max_pyramid": f"WITH {fx.DEM} SELECT l::INT AS level, tile, (r >> l)::INT AS r, (c >> l)::INT AS c, round(max(z), 6) AS z FROM ({_VALID}) CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS l) GROUP BY 1, 2, 3, 4",
    "dem_normals": f"WITH {fx.FILLED}, {_NORMALS.replace('SRC', 'filled')} SELECT tile, r, c, round(nx, 6) + 0 AS nx, round(ny, 6) + 0 AS ny, round(nz, 6) AS nz FROM n",
    "dem_bilinear": f"""
WITH {fx.FILLED}, p AS (SELECT o_orderkey AS id, o_custkey % (SELECT count(*) FROM supplier) AS tile, greatest(0, least({S - 1}, o_orderkey * 37 % 1700 / 100.0::DOUBLE - 0.5)) AS y, greatest(0, least({S - 1}, o_orderkey * 91 % 1700 / 100.0::DOUBLE - 0.5)) AS x FROM orders),
k AS (SELECT id, p.tile, least(floor(y) + i, {S - 1})::INT AS r, least(floor(x) + j, {S - 1})::INT AS c, (CASE WHEN i = 0 THEN 1 - (y - floor(y)) ELSE y - floor(y) END) * (CASE WHEN j = 0 THEN 1 - (x - floor(x)) ELSE x - floor(x) END) AS w
  FROM p CROSS JOIN (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) v(i, j))
SELECT id, round(sum(w * z), 7) AS z FROM k JOIN filled f ON f.tile = k.tile AND f.r = k.r AND f.c = k.c GROUP BY id""",
    "dem_height_curve": f"""
WITH {fx.DEM}, top AS (SELECT tile, max(z) AS top FROM ({_VALID}) GROUP BY tile),
t AS (SELECT d.tile, r, c, CASE WHEN isnan(z) THEN 0 ELSE greatest(-1, least(1, z / greatest(top, 1e-12))) END AS t FROM dem d JOIN top ON top.tile = d.tile)
SELECT tile, r, c, round(1.5 + sign(t) * pow(abs(t), 0.7::DOUBLE) * 30, 6) AS mm FROM t""",
    "contour_levels": f"""
WITH {fx.DEM}, g AS (SELECT tile, min(z) AS lo, max(z) AS hi FROM ({_VALID}) GROUP BY tile),
fine AS (SELECT tile, unnest(list_transform(range(floor(lo / 100)::BIGINT, ceil(least(hi, {STEEP}) / 100)::BIGINT + 1), lambda i: i * 100.0::DOUBLE)) AS level FROM g WHERE lo <= {STEEP}),
coarse AS (SELECT tile, unnest(list_transform(range(greatest(2, floor(lo / 500)::BIGINT), ceil(hi / 500)::BIGINT + 1), lambda i: i * 500.0::DOUBLE)) AS level FROM g WHERE hi > {STEEP})
SELECT tile, level FROM fine WHERE level <= {STEEP} UNION SELECT tile, level FROM coarse WHERE level > {STEEP}""",
    "contour_crossings": f"""
WITH {fx.FILLED}, p AS (SELECT tile, r, c, z, lead(z) OVER (PARTITION BY tile, r ORDER BY c) AS z2, 'h' AS kind FROM filled UNION ALL SELECT tile, r, c, z, lead(z) OVER (PARTITION BY tile, c ORDER BY r), 'v' FROM filled),
k AS (SELECT *, unnest(range(floor(least(z, z2) / {INTERVAL})::BIGINT + 1, floor(greatest(z, z2) / {INTERVAL})::BIGINT + 1)) * {INTERVAL}::DOUBLE AS level FROM p WHERE z2 <> z)
SELECT tile, level, round(CASE WHEN kind = 'v' THEN r + (level - z) / (z2 - z) ELSE r END, 6) AS r, round(CASE WHEN kind = 'h' THEN c + (level - z) / (z2 - z) ELSE c END, 6) AS c, kind FROM k""",
    "horizon_cardinal": f"WITH {fx.FILLED}, {_CARDINAL} SELECT tile, r, c, round(horizon, 6) AS horizon FROM h",
    "horizon_sheared": f"""
WITH {fx.FILLED}, g AS (SELECT t.tile, q, k, q - {OFFSET} * k AS a, {S - 1} - k AS c FROM (SELECT DISTINCT tile FROM dem) t CROSS JOIN range({S + 6}) x(q) CROSS JOIN range({S}) y(k)),
z AS (SELECT g.tile, q, k, lo.z * (1 - (a - floor(a))) + hi.z * (a - floor(a)) + {RISE} * k AS lifted FROM g
  LEFT JOIN filled lo ON lo.tile = g.tile AND lo.c = g.c AND lo.r = floor(a) AND a BETWEEN 0 AND {S - 1}
  LEFT JOIN filled hi ON hi.tile = g.tile AND hi.c = g.c AND hi.r = least(floor(a) + 1, {S - 1}) AND a BETWEEN 0 AND {S - 1})
SELECT tile, q::INT AS q, k::INT AS k, round(max(lifted) OVER (PARTITION BY tile, q ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - {RISE} * k, 6) AS horizon FROM z""",
    "shade_cells": f"""
WITH {fx.FILLED}, {_CARDINAL}, {_NORMALS.replace('SRC', 'h')},
l AS (SELECT tile, r, c, round(255 * least(1, 0.2::DOUBLE + 0.8::DOUBLE * CASE WHEN horizon > z + 0.5 THEN 0 ELSE greatest(0, nx * {SUN[0]}::DOUBLE + ny * {SUN[1]}::DOUBLE + nz * {SUN[2]}::DOUBLE) END))::INT AS light FROM n)
SELECT *, round_even((0.05::DOUBLE + 0.95::DOUBLE * pow(greatest(0, least(1, light / 255.0::DOUBLE * 1.1)), 1 / 2.2::DOUBLE)) * 255, 0)::INT AS exposed FROM l""",
    "layer_composite": f"""
WITH {fx.FILLED}, g AS (SELECT *, abs(coalesce(lead(z) OVER x, z) - coalesce(lag(z) OVER x, z)) / 2 + abs(coalesce(lead(z) OVER y, z) - coalesce(lag(z) OVER y, z)) / 2 AS g FROM filled
  WINDOW x AS (PARTITION BY tile, r ORDER BY c), y AS (PARTITION BY tile, c ORDER BY r)),
a AS (SELECT *, (255 * (1 - 0.8::DOUBLE) + (50 + r * 10) * 0.8::DOUBLE) * (r * 16 + c)::DOUBLE / 255 AS base,
  CASE WHEN abs(z) > 0.05 THEN greatest(0, least(1, 1.25::DOUBLE - abs((z + {INTERVAL / 2}) - {INTERVAL} * floor((z + {INTERVAL / 2}) / {INTERVAL}) - {INTERVAL / 2}) / greatest(g, 0.1))) ELSE 0 END AS a1, greatest(0, least(1, 1 - abs(r - c) / 2.0::DOUBLE)) AS a2 FROM g)
SELECT tile, r, c, round_even(greatest(0, least(255, (base * (1 - a1) + 120 * a1) * (1 - a2) + 30 * a2)), 0)::INT AS value FROM a""",
    "dem_clean_voids_coast": f"WITH {fx.DEM} SELECT tile, r, c, round(CASE WHEN isnan(z) OR z - {COAST} <= {COAST_VOID} THEN NULL WHEN z < {COAST} THEN 0 ELSE z - {COAST} END, 6) AS z FROM dem",
    "dem_sea_level_coast": f"""
WITH RECURSIVE {fx.DEM}, below AS (SELECT tile, r, c FROM dem WHERE NOT isnan(z) AND z < {COAST} AND (r * 7 + c * 3) % 5 <> 0),
reach(tile, r, c, r0, c0) AS (
  SELECT tile, r, c, r, c FROM below
  UNION SELECT b.tile, b.r, b.c, x.r0, x.c0 FROM reach x JOIN below b ON b.tile = x.tile AND abs(b.r - x.r) + abs(b.c - x.c) = 1
), sizes AS (SELECT tile, r0 AS r, c0 AS c, count(*) AS size FROM reach GROUP BY 1, 2, 3)
SELECT d.tile, d.r, d.c, round(CASE WHEN isnan(z) THEN NULL WHEN z >= {COAST} THEN z - {COAST} WHEN size >= 4 THEN greatest(z - {COAST}, {COAST_FLOOR}) ELSE 0 END, 6) AS z
FROM dem d LEFT JOIN sizes s ON s.tile = d.tile AND s.r = d.r AND s.c = d.c""",
    "contour_levels_coast": f"""
WITH {fx.DEM}, g AS (SELECT tile, min(z) AS lo, max(z) AS hi FROM ({_VALID}) GROUP BY tile),
fine AS (SELECT tile, unnest(list_transform(range(floor(lo / 100)::BIGINT, ceil(least(hi, {COAST_STEEP}) / 100)::BIGINT + 1), lambda i: i * 100.0::DOUBLE)) AS level FROM g WHERE lo <= {COAST_STEEP}),
coarse AS (SELECT tile, unnest(list_transform(range(greatest(2, floor(lo / 500)::BIGINT), ceil(hi / 500)::BIGINT + 1), lambda i: i * 500.0::DOUBLE)) AS level FROM g WHERE hi > {COAST_STEEP})
SELECT tile, level FROM fine WHERE level <= {COAST_STEEP} UNION SELECT tile, level FROM coarse WHERE level > {COAST_STEEP}""",
}
