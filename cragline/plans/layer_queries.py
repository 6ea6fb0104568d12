"""Queries on map layers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cragline.functions import parse
from cragline.operators import fields as fi
from cragline.operators import graph as g
from cragline.operators import layers as la
from cragline.operators import raster as ra
from cragline.plans import fixtures as fx
from cragline.plans import raster_queries as rq
from cragline.session import table, written

S = fx.SIDE
PROGRESS = 0.6
#: Added before rounding: sums of the fixtures' decimals often end just where a rounding turns.
OFF = 1.3705491e-5


def layer_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All layers in their order: white, satellite, semantic colour, light, contours, streets, rivers (as far as revealed), peaks, divides."""
    cells = fx.filled_dem(spark, sf_dir)
    row, column = ra.along_row(), ra.along_column()
    diff = lambda f, w: F.coalesce(f("z").over(w), F.col("z"))
    gradient = F.abs(diff(F.lead, row) - diff(F.lag, row)) / 2 + F.abs(diff(F.lead, column) - diff(F.lag, column)) / 2
    r, c = F.col("r").cast("double"), F.col("c").cast("double")
    white = F.lit(255 * 0.9)
    satellite = white * (1 - 0.8) + la.held((40 + r * 12) * 1.25, 0.0, 255.0) * 0.8
    semantic = satellite * (1 - 0.3) + (30 + c * 9) * 0.3
    light = semantic * (r * 16 + c) / 255
    weight, one = (F.col("c") % 4) / 4.0, F.lit(1.0)
    river = la.line_alpha(F.abs(r - c) / 2, la.weighted_width(weight, F.lit(3.0)), one) * la.revealed((r + c) / 30, F.lit(PROGRESS))
    inks = [
        (120.0, ra.contour_alpha(F.col("z"), gradient, 250.0, 1.5)), (200.0, la.line_alpha(F.abs(r + c - 14), la.weighted_width(weight, F.lit(2.0)), one) * 0.7),
        (60.0, river), (250.0, la.line_alpha(F.sqrt((r - 5) * (r - 5) + (c - 9) * (c - 9)), F.lit(3.0), one)), (10.0, la.line_alpha(F.abs(r - 11), F.lit(1.0), one) * 0.5),
    ]
    return cells.select("tile", "r", "c", la.composited(light, inks).alias("value"))


def layer_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers that are tables: light and shadow of the tiles' terrain, its contours, a river along the least cell of each row, as wide as the
    supplier's reach weighs and shown as far as it has come, and the tile's peak."""
    cells = fx.filled_dem(spark, sf_dir)
    row, column = ra.along_row(), ra.along_column()
    light = ra.shaded(ra.normals(ra.horizon_cardinal(cells, rq.RISE), 500.0, 500.0), rq.SUN, 0.2, 0.5).select("tile", "r", "c", "light")
    diff = lambda f, w: F.coalesce(f("z").over(w), F.col("z"))
    gradient = F.abs(diff(F.lead, row) - diff(F.lag, row)) / 2 + F.abs(diff(F.lead, column) - diff(F.lag, column)) / 2
    least = F.row_number().over(Window.partitionBy("tile", "r").orderBy("z", "c")) == 1
    highest = F.row_number().over(Window.partitionBy("tile").orderBy(F.desc("z"), "r", "c")) == 1
    marked = written(cells.withColumns({"gradient": gradient, "river": least, "peak": highest}), "layers")
    river = fi.distance_field(marked, F.col("river")).select("tile", "r", "c", F.col("d").alias("to_river"), "mark_r")
    peak = fi.distance_field(marked, F.col("peak")).select("tile", "r", "c", F.col("d").alias("to_peak"))
    weights = g.width_weights(fx.reaches(spark, sf_dir), "q").select(F.col("id").alias("tile"), "weight")
    every = marked.join(light, ["tile", "r", "c"]).join(river, ["tile", "r", "c"]).join(peak, ["tile", "r", "c"]).join(weights, "tile", "left")
    width = la.weighted_width(F.coalesce("weight", F.lit(0.0)), F.lit(4.0))
    inks = [
        (120.0, ra.contour_alpha(F.col("z"), F.col("gradient"), 250.0, 1.5)), (60.0, la.soft_line_alpha(F.col("to_river"), width) * la.revealed(F.col("mark_r") / (S - 1), F.lit(PROGRESS))),
        (250.0, la.line_alpha(F.col("to_peak"), F.lit(3.0), F.lit(1.0))),
    ]
    return every.select("tile", "r", "c", la.composited(F.col("light").cast("double") + OFF, inks).alias("value"))


def contour_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = fx.filled_dem(spark, sf_dir)
    ways = {fill: la.single_level_alpha(F.col("z"), 200.0, F.lit(60.0), 2.0, fill) for fill in ("line", "above", "below")}
    return cells.select("tile", "r", "c", *[F.round(v, 6).alias(n) for n, v in ways.items()])


def screen_gather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heights under screen pixels, one an order; every eleventh misses."""
    k = F.col("o_orderkey")
    tiles = table(spark, sf_dir, "supplier").agg(F.count(F.lit(1)).alias("tiles"))  # one row
    u = F.when(k % 11 == 0, la.MISS).otherwise(k * 7919 % 65535).cast("int")
    screen = table(spark, sf_dir, "orders").crossJoin(F.broadcast(tiles)).select(k.alias("id"), (F.col("o_custkey") % F.col("tiles")).alias("tile"), u.alias("u"), F.when(u == la.MISS, la.MISS).otherwise(k * 104729 % 65535).cast("int").alias("v"))
    return la.gathered(screen, fx.filled_dem(spark, sf_dir), S, S).select("id", "r", "c", F.round("z", 6).alias("z"))


def chroma_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heights of each tile as a channel that is sampled 2 % further out from the middle."""
    cells = fx.filled_dem(spark, sf_dir)
    at = la.radially_scaled(F.col("c").cast("double"), F.col("r").cast("double"), S, S, 1.02)
    points = cells.select(F.concat_ws(":", "tile", "r", "c").alias("id"), "tile", at["y"].alias("y"), at["x"].alias("x"))
    return ra.bilinear(points, cells, S).withColumn("z", F.round(F.col("z") + OFF, 4))


def pace_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), parse.pace(F.col("o_orderkey") % 1000 / 64.0).alias("pace"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "layer_order": layer_order, "layer_tables": layer_tables, "contour_fill": contour_fill, "screen_gather": screen_gather, "chroma_resample": chroma_resample, "pace_text": pace_text,
}

_HELD = lambda v, high="1": f"greatest(0, least({high}, {v}))"
_OVER = lambda below, ink, alpha: f"({below}) * (1 - {_HELD(alpha)}) + {ink}::DOUBLE * {_HELD(alpha)}"
_LINE = lambda d, width: _HELD(f"({width}) / 2 + 0.5::DOUBLE - {d}")
_LIGHT = "((229.5::DOUBLE * 0.2::DOUBLE + greatest(0, least(255, (40 + r * 12) * 1.25::DOUBLE)) * 0.8::DOUBLE) * 0.7::DOUBLE + (30 + c * 9) * 0.3::DOUBLE) * (r * 16 + c) / 255"
_STREET = f"{_LINE('abs(r + c - 14)', '1 + (c % 4) / 4.0::DOUBLE')} * 0.7::DOUBLE"
_RIVER = f"{_LINE('abs(r - c) / 2.0::DOUBLE', '1 + 2 * ((c % 4) / 4.0::DOUBLE)')} * {_HELD(f'({PROGRESS}::DOUBLE * 1.005::DOUBLE - (r + c) / 30.0::DOUBLE) / 0.005::DOUBLE')}"

_REACHES = "WITH " + fx.REACHES + " SELECT id, q FROM reaches"

ORACLES: dict[str, str] = {
    "layer_order": f"""
WITH {fx.FILLED}, g AS (SELECT *, abs(coalesce(lead(z) OVER x, z) - coalesce(lag(z) OVER x, z)) / 2 + abs(coalesce(lead(z) OVER y, z) - coalesce(lag(z) OVER y, z)) / 2 AS g FROM filled
  WINDOW x AS (PARTITION BY tile, r ORDER BY c), y AS (PARTITION BY tile, c ORDER BY r)),
l0 AS (SELECT *, {_LIGHT} AS v, CASE WHEN abs(z) > 0.05 THEN greatest(0, least(1, 1.25::DOUBLE - abs((z + 125) - 250 * floor((z + 125) / 250) - 125) / greatest(g, 0.1))) ELSE 0 END AS a FROM g),
l1 AS (SELECT *, {_OVER('v', 120, 'a')} AS v1 FROM l0), l2 AS (SELECT *, {_OVER('v1', 200, _STREET)} AS v2 FROM l1), l3 AS (SELECT *, {_OVER('v2', 60, _RIVER)} AS v3 FROM l2),
l4 AS (SELECT *, {_OVER('v3', 250, _LINE('sqrt((r - 5) * (r - 5) + (c - 9) * (c - 9))', '3'))} AS v4 FROM l3)
SELECT tile, r, c, round_even({_HELD(_OVER('v4', 10, _LINE('abs(r - 11)', '1') + ' * 0.5::DOUBLE'), '255')}, 0)::INT AS value FROM l4""",
    "layer_tables": f"""
WITH {fx.FILLED}, light AS (SELECT tile, r, c, light FROM ({rq.ORACLES['shade_cells']})), q AS (SELECT id, greatest(q, 0) AS q FROM ({_REACHES})),
wt AS (SELECT id, greatest(0, least(1, ln(1 + q) / ln(1 + greatest((SELECT quantile_cont(q, 0.995) FROM q), 0.1)))) AS w FROM q),
g AS (SELECT *, abs(coalesce(lead(z) OVER x, z) - coalesce(lag(z) OVER x, z)) / 2 + abs(coalesce(lead(z) OVER y, z) - coalesce(lag(z) OVER y, z)) / 2 AS g,
  row_number() OVER (PARTITION BY tile, r ORDER BY z, c) = 1 AS river, row_number() OVER (PARTITION BY tile ORDER BY z DESC, r, c) = 1 AS peak FROM filled
  WINDOW x AS (PARTITION BY tile, r ORDER BY c), y AS (PARTITION BY tile, c ORDER BY r)),
rv AS (SELECT a.tile, a.r, a.c, min((pow(a.r - b.r, 2) + pow(a.c - b.c, 2), b.r)) AS m FROM g a JOIN g b ON b.tile = a.tile AND b.river GROUP BY a.tile, a.r, a.c),
d AS (SELECT g.*, l.light + {OFF}::DOUBLE AS v, sqrt(m[1]) AS dr, m[2] AS mr, sqrt(pow(g.r - p.r, 2) + pow(g.c - p.c, 2)) AS dp, 1 + 3 * coalesce(wt.w, 0) AS width
  FROM g JOIN light l ON l.tile = g.tile AND l.r = g.r AND l.c = g.c JOIN rv ON rv.tile = g.tile AND rv.r = g.r AND rv.c = g.c JOIN g p ON p.tile = g.tile AND p.peak LEFT JOIN wt ON wt.id = g.tile),
t AS (SELECT *, greatest(0, least(1, (dr - greatest(0, width / 2 - 0.65::DOUBLE)) / (width / 2 + 0.65::DOUBLE - greatest(0, width / 2 - 0.65::DOUBLE)))) AS t,
  CASE WHEN abs(z) > 0.05 THEN greatest(0, least(1, 1.25::DOUBLE - abs((z + 125) - 250 * floor((z + 125) / 250) - 125) / greatest(g, 0.1))) ELSE 0 END AS a FROM d),
l1 AS (SELECT *, {_OVER('v', 120, 'a')} AS v1 FROM t),
l2 AS (SELECT *, {_OVER('v1', 60, f"(1 - t * t * (3 - 2 * t)) * " + _HELD(f"({PROGRESS}::DOUBLE * 1.005::DOUBLE - mr / {S - 1}.0::DOUBLE) / 0.005::DOUBLE"))} AS v2 FROM l1)
SELECT tile, r, c, round_even({_HELD(_OVER('v2', 250, _LINE('dp', '3')), '255')}, 0)::INT AS value FROM l2""",
    "contour_fill": f"""WITH {fx.FILLED} SELECT tile, r, c, round(CASE WHEN abs(z) > 0.05 THEN {_HELD('1.5::DOUBLE - abs(z - 200) / 60')} ELSE 0 END, 6) AS line, round({_HELD('(z - 200) / 60 + 0.5::DOUBLE')}, 6) AS above,
  round(1 - {_HELD('(z - 200) / 60 + 0.5::DOUBLE')}, 6) AS below FROM filled""",
    "screen_gather": f"""
WITH {fx.FILLED}, s AS (SELECT o_orderkey AS id, o_custkey % (SELECT count(*) FROM supplier) AS tile, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey * 7919 % 65535 END AS u, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey * 104729 % 65535 END AS v FROM orders),
t AS (SELECT id, tile, CASE WHEN v IS NOT NULL THEN least(floor((v::FLOAT / 65534::FLOAT * {S - 1}::FLOAT)::DOUBLE), {S - 1})::INT END AS r, CASE WHEN u IS NOT NULL THEN least(floor((u::FLOAT / 65534::FLOAT * {S - 1}::FLOAT)::DOUBLE), {S - 1})::INT END AS c FROM s)
SELECT id, t.r, t.c, round(z, 6) AS z FROM t LEFT JOIN filled f ON f.tile = t.tile AND f.r = t.r AND f.c = t.c""",
    "chroma_resample": f"""
WITH {fx.FILLED}, p AS (SELECT tile || ':' || r || ':' || c AS id, tile, greatest(0, least({S - 1}, 7.5::DOUBLE + (r - 7.5::DOUBLE) * 1.02::DOUBLE)) AS y, greatest(0, least({S - 1}, 7.5::DOUBLE + (c - 7.5::DOUBLE) * 1.02::DOUBLE)) AS x FROM filled),
k AS (SELECT id, p.tile, least(floor(y) + i, {S - 1})::INT AS r, least(floor(x) + j, {S - 1})::INT AS c, (CASE WHEN i = 0 THEN 1 - (y - floor(y)) ELSE y - floor(y) END) * (CASE WHEN j = 0 THEN 1 - (x - floor(x)) ELSE x - floor(x) END) AS w
  FROM p CROSS JOIN (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) v(i, j))
SELECT id, round(sum(w * z) + {OFF}::DOUBLE, 4) AS z FROM k JOIN filled f ON f.tile = k.tile AND f.r = k.r AND f.c = k.c GROUP BY id""",
    "pace_text": "SELECT o_orderkey AS id, printf('%02d:%02d', floor(o_orderkey % 1000 / 64.0::DOUBLE)::INT, floor((o_orderkey % 1000 / 64.0::DOUBLE - floor(o_orderkey % 1000 / 64.0::DOUBLE)) * 60)::INT) AS pace FROM orders",
}
