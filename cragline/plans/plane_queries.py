"""Queries on sections, areas, rasters of lines, contour lines, solids, projections and clocks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cragline.functions import mercator as m
from cragline.operators import contours
from cragline.operators import plane as pl
from cragline.plans import fixtures as fx
from cragline.session import table

S = fx.SIDE
X0, Y0, SQUARE = 6.5, 44.5, 3.0
BASE, INTERVAL = -1000.0, 250.0
BOX = (5.0, 43.75, 16.0, 48.25)
#: Corners of the plane of points, and where a projector puts them.
SOURCE, TARGET = [(0.0, 0.0), (512.0, 0.0), (512.0, 512.0), (0.0, 512.0)], [(10.0, 20.0), (1900.0, 60.0), (1850.0, 1050.0), (40.0, 1000.0)]
#: Added before rounding: sums of the fixtures' decimals often end just where a rounding turns.
OFF = 1.3705491e-5
MATRIX = pl.homography(SOURCE, TARGET)
ROADS = {"motorway": 1.0, "trunk": 0.6}


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.tracks(spark, sf_dir).select(F.col("track").alias("line"), "idx", F.col("lon").alias("x"), F.col("lat").alias("y"))


def section_in_square(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pl.sections_in_square(_lines(spark, sf_dir), F.lit(X0), F.lit(Y0), SQUARE)
    return found.select("line", "first", "last", F.round("extent", 6).alias("extent"), F.round("length", 6).alias("length"))


def ring_largest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each brand's four-cornered rings, one a part, the largest."""
    k = F.col("p_partkey")
    corners = ((F.lit(0.0), F.lit(0.0)), (k % 7 + 1.0, F.lit(0.5)), (k % 5 + 2.0, k % 3 + 2.0), (F.lit(0.25), k % 4 + 1.0))
    ring = F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in corners])
    rings = table(spark, sf_dir, "part").select("p_brand", k.alias("ring"), F.posexplode(ring).alias("idx", "p")).select("p_brand", "ring", "idx", "p.x", "p.y")
    return pl.largest_rings(rings, "p_brand").withColumn("area", F.round("area", 6))


def river_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = fx.tracks(spark, sf_dir).select(F.col("track").alias("line"), "idx", "lon", "lat")
    return pl.arc_lengths(points, F.lit(0.25), F.lit(0.75)).select("line", "idx", F.round("km", 5).alias("km"), F.round("phase", 7).alias("phase"))


def void_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pl.filled_voids(fx.dem(spark, sf_dir)).withColumn("z", F.round("z", 6))


def _scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Track points in quarter pixels of a raster of 128 x 64."""
    k, n = F.col("event_id"), F.col("cell")
    from pyspark.sql import Window

    idx = F.row_number().over(Window.partitionBy("cell").orderBy("t_us", "event_id"))
    return fx.events(spark, sf_dir).select(n.alias("line"), idx.alias("idx"), (k * 37 % 512 / 4.0).alias("x"), (k * 91 % 256 / 4.0).alias("y"), (idx / 1024.0).alias("phase"))


def line_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many steps of lines fall on each pixel."""
    return pl.line_cells(_scaled(spark, sf_dir)).groupBy("y", "x").agg(F.count(F.lit(1)).alias("n"))


def track_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tracks, drawn three pixels wide, a hundred on a raster."""
    points = _scaled(spark, sf_dir).withColumn("raster", F.floor(F.col("line") / 100))
    found = pl.track_raster(points, 128, 64, 3)
    return found.select("raster", "y", "x", F.round(F.col("phase") + OFF, 7).alias("phase"), F.round("cover", 6).alias("cover"))


def contour_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each tile and level: how many contour lines there are, how many of them closed, and their length."""
    from pyspark.sql import Window

    lines = contours.contour_lines(fx.filled_dem(spark, sf_dir).withColumnRenamed("tile", "raster"), S, INTERVAL).withColumnRenamed("raster", "tile")
    w = Window.partitionBy("tile", "level", "line").orderBy("idx")
    step = F.sqrt(F.pow(F.col("x") - F.lag("x").over(w), 2) + F.pow(F.col("y") - F.lag("y").over(w), 2))
    per = lines.withColumn("step", step).groupBy("tile", "level", "line").agg(F.max("closed").alias("closed"), F.sum("step").alias("length"))
    return per.groupBy("tile", "level").agg(F.count(F.lit(1)).alias("lines"), F.count_if("closed").alias("closed"), F.round(F.sum("length"), 5).alias("length"))


def solid_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Solids of tiles: connected parts, faces, volume, open edges, and whether they hold material. Every fifth tile lacks a face, and beside
    every seventh floats a scrap."""
    solids = pl.grid_solids(fx.filled_dem(spark, sf_dir), BASE).where("mesh % 5 <> 0 OR tri <> 0")
    o, x, y, z = ((100.0, 0.0, 0.0), (100.125, 0.0, 0.0), (100.0, 0.125, 0.0), (100.0, 0.0, 0.125))
    scrap = F.explode(F.array(*[F.struct(F.lit(-1 - k).cast("long").alias("tri"), *[F.lit(p[d]).alias(f"{a}{i}") for i, p in enumerate(f, 1) for d, a in enumerate("xyz")]) for k, f in enumerate(((o, y, x), (o, x, z), (o, z, y), (x, y, z)))])).alias("f")
    scraps = fx.filled_dem(spark, sf_dir).where("tile % 7 = 0").select(F.col("tile").alias("mesh")).distinct().select("mesh", scrap).select("mesh", "f.*")
    parts = pl.mesh_parts(solids.unionByName(scraps))
    kept = pl.holds_material(F.col("faces"), F.col("volume"), F.col("open"), 2000)
    return parts.select(F.col("mesh").alias("tile"), "faces", F.round(F.col("volume") + OFF, 3).alias("volume"), "open", kept.alias("kept"))


def _apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upper faces of the solids, tiles 32 apart along x."""
    faces = pl.grid_solids(fx.filled_dem(spark, sf_dir), BASE, top_only=True)
    return faces.select((F.col("mesh") * (1 << 40) + F.col("tri")).alias("tri"), *[(F.col(f"{a}{i}") + (32.0 * F.col("mesh") if a == "x" else 0.0)).alias(f"{a}{i}") for i in (1, 2, 3) for a in "xyz"])


def surface_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rays straight down on the tiles' meshes, one an order: where they hit."""
    k = F.col("o_orderkey")
    tiles = table(spark, sf_dir, "supplier").agg(F.count(F.lit(1)).alias("tiles"))  # one row
    at = table(spark, sf_dir, "orders").crossJoin(F.broadcast(tiles)).select(
        k.alias("ray"), (32.0 * (F.col("o_custkey") % F.col("tiles")) + k * 37 % 1487 / 100.0 + 0.063).alias("ox"), (-(k * 91 % 1487) / 100.0 - 0.029).alias("oy"),
        F.lit(5000.0).alias("oz"), F.lit(0.0).alias("dx"), F.lit(0.0).alias("dy"), F.lit(-1.0).alias("dz"),
    )
    return pl.first_hits(at, _apart(spark, sf_dir), 1.0).select("ray", F.round(5000 - F.col("t") + OFF, 3).alias("z"))


def map_homography(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = pl.projected(F.col("x") % 512, F.col("y"), MATRIX)
    return fx.points(spark, sf_dir).select("id", *[F.round(v, 6).alias(n) for n, v in at.items()])


def map_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = pl.map_xy(F.col("lon"), F.col("lat"), BOX, 640.0, 360.0)
    return fx.tracks(spark, sf_dir).select("track", "idx", *[F.round(v, 6).alias(n) for n, v in at.items()])


def mask_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each tile's cells that a mask covers, and how many of these lie below 0."""
    from cragline.plans import mapping_queries as mq

    joined = mq.land_mask(spark, sf_dir).join(fx.filled_dem(spark, sf_dir), ["tile", "r", "c"])
    return joined.groupBy("tile").agg(F.avg(F.col("inside").cast("double")).alias("coverage"), F.count_if(F.col("inside") & (F.col("z") < 0)).alias("below"))


def near_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = fx.points(spark, sf_dir)
    labels = points.select("id", (F.floor(F.col("id") / 3) % 5).alias("label"))
    return pl.nearest_between(points, labels, 12.0, 2).select("a", "b", "u", "v", F.round("d", 6).alias("d"), "place")


def playback_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a clock from 05:00 that runs a minute a second and around after 16 hours shows at each event, the eased share of that, and the
    greatest value that its cell has reached."""
    now = F.col("t_us") / 1e6
    shown = pl.looping_clock(now, F.lit(1.7e9), F.lit(60.0), 18_000.0, 57_600.0)
    e = fx.events(spark, sf_dir).withColumn("o", F.struct("t_us", "event_id"))
    return e.select("event_id", F.round(shown, 3).alias("second"), F.round(pl.smooth_step((shown - 18_000) / 57_600), 6).alias("eased"), pl.monotonic("value", "cell", "o").alias("reached"))


def road_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices of road tiles that are neither ramp nor tunnel, with their weight and place."""
    k = F.col("o_orderkey")
    raw = table(spark, sf_dir, "orders").select(
        k.alias("id"), F.element_at(F.array(*[F.lit(c) for c in ("motorway", "trunk", "primary")]), (k % 3 + 1).cast("int")).alias("class"), (k % 5 == 0).alias("ramp"),
        F.when(k % 7 == 0, "tunnel").alias("brunnel"), (134 + k % 3).alias("tx"), (90 + k % 2).alias("ty"), (k * 37 % 4096).alias("px"), (k * 91 % 4096).alias("py"),
    )
    weight = F.create_map(*[F.lit(x) for pair in ROADS.items() for x in pair])
    roads = raw.where(F.col("class").isin(*ROADS) & ~F.col("ramp") & ~F.coalesce(F.col("brunnel") == "tunnel", F.lit(False)))
    lon, lat = m.from_tile(F.lit(8), F.col("tx"), F.col("ty"), F.col("px") / 4096, F.col("py") / 4096)
    return roads.select("id", weight[F.col("class")].alias("weight"), F.round(lon, 7).alias("lon"), F.round(lat, 7).alias("lat"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "section_in_square": section_in_square, "ring_largest": ring_largest, "river_arcs": river_arcs, "void_fill": void_fill, "line_raster": line_raster,
    "track_raster": track_raster, "contour_lines": contour_lines, "solid_volumes": solid_volumes, "surface_hits": surface_hits, "map_homography": map_homography,
    "map_place": map_place, "mask_coverage": mask_coverage, "near_between": near_between, "playback_clock": playback_clock, "road_vertices": road_vertices,
}

_SCALED = """scaled AS (SELECT user_id AS line, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS idx, event_id * 37 % 512 / 4.0::DOUBLE AS x, event_id * 91 % 256 / 4.0::DOUBLE AS y FROM events),
ends AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM scaled WINDOW w AS (PARTITION BY line ORDER BY idx)),
steps AS (SELECT *, unnest(range(0, n + 1)) AS k FROM (SELECT *, greatest(1, ceil(greatest(abs(x2 - x), abs(y2 - y))))::BIGINT AS n FROM ends WHERE x2 IS NOT NULL)),
cells AS (SELECT line, idx, round_even(x + (x2 - x) * (k::DOUBLE / n), 0)::BIGINT AS x, round_even(y + (y2 - y) * (k::DOUBLE / n), 0)::BIGINT AS y, k::DOUBLE / n AS t FROM steps)"""
_TAPS = "(VALUES (-1, 0.125::DOUBLE), (0, 0.75::DOUBLE), (1, 0.125::DOUBLE)) k(d, v)"
_SQUARES = f"""sq AS (SELECT tile, r, c, z AS a, lead(z) OVER (PARTITION BY tile, r ORDER BY c) AS b, lead(z) OVER (PARTITION BY tile, c ORDER BY r) AS d FROM filled),
sq4 AS (SELECT *, lead(d) OVER (PARTITION BY tile, r ORDER BY c) AS e FROM sq QUALIFY b IS NOT NULL AND d IS NOT NULL AND e IS NOT NULL),
lv AS (SELECT *, unnest(range(floor(least(a, b, d, e) / {INTERVAL})::BIGINT + 1, floor(greatest(a, b, d, e) / {INTERVAL})::BIGINT + 1)) * {INTERVAL}::DOUBLE AS level FROM sq4),
cr AS (SELECT *, CASE WHEN (a >= level) <> (b >= level) THEN struct_pack(p := 'h:' || r || ':' || c, x := c + (level - a) / (b - a), y := r::DOUBLE) END AS top,
  CASE WHEN (d >= level) <> (e >= level) THEN struct_pack(p := 'h:' || (r + 1) || ':' || c, x := c + (level - d) / (e - d), y := (r + 1)::DOUBLE) END AS bottom,
  CASE WHEN (a >= level) <> (d >= level) THEN struct_pack(p := 'v:' || r || ':' || c, x := c::DOUBLE, y := r + (level - a) / (d - a)) END AS lft,
  CASE WHEN (b >= level) <> (e >= level) THEN struct_pack(p := 'v:' || r || ':' || (c + 1), x := (c + 1)::DOUBLE, y := r + (level - b) / (e - b)) END AS rgt FROM lv),
sg AS (SELECT tile, level, unnest(CASE WHEN top IS NOT NULL AND bottom IS NOT NULL AND lft IS NOT NULL AND rgt IS NOT NULL
    THEN CASE WHEN (a >= level) = ((a + b + d + e) / 4 >= level) THEN [[top, rgt], [lft, bottom]] ELSE [[top, lft], [rgt, bottom]] END
    ELSE [list_filter([top, lft, rgt, bottom], lambda x: x IS NOT NULL)] END) AS g FROM cr),
seg AS (SELECT tile, level, g[1].p AS p, g[2].p AS q, sqrt(pow(g[1].x - g[2].x, 2) + pow(g[1].y - g[2].y, 2)) AS len FROM sg)"""
_H = [[repr(float(v)) + "::DOUBLE" for v in row] for row in MATRIX]
_W = f"({_H[2][0]} * x + {_H[2][1]} * y + {_H[2][2]})"

ORACLES: dict[str, str] = {
    "section_in_square": f"""
WITH {fx.TRACKS}, p AS (SELECT track AS line, idx, lon AS x, lat AS y, lon BETWEEN {X0} AND {X0 + SQUARE} AND lat BETWEEN {Y0} AND {Y0 + SQUARE} AS ins FROM tracks),
n AS (SELECT *, lag(ins) OVER w AS before, lead(ins) OVER w AS after, sum((ins AND NOT coalesce(lag_ins, false))::INT) OVER (PARTITION BY line ORDER BY idx) AS run
  FROM (SELECT *, lag(ins) OVER (PARTITION BY line ORDER BY idx) AS lag_ins FROM p) WINDOW w AS (PARTITION BY line ORDER BY idx)),
rows AS (SELECT line, idx, x, y, run FROM n WHERE ins UNION ALL SELECT line, idx, x, y, run FROM n WHERE NOT ins AND before UNION ALL SELECT line, idx, x, y, run + 1 FROM n WHERE NOT ins AND after),
st AS (SELECT *, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)), 0) AS step FROM rows WINDOW w AS (PARTITION BY line, run ORDER BY idx)),
runs AS (SELECT line, run, min(idx) AS first, max(idx) AS last, greatest(max(x) - min(x), max(y) - min(y)) AS extent, sum(step) AS length FROM st GROUP BY ALL)
SELECT line, first, last, round(extent, 6) AS extent, round(length, 6) AS length FROM runs QUALIFY row_number() OVER (PARTITION BY line ORDER BY extent DESC, length DESC, first) = 1""",
    "ring_largest": """
WITH k AS (SELECT p_brand, p_partkey AS ring, p_partkey % 7 + 1.0::DOUBLE AS x1, 0.5::DOUBLE AS y1, p_partkey % 5 + 2.0::DOUBLE AS x2, p_partkey % 3 + 2.0::DOUBLE AS y2, p_partkey % 4 + 1.0::DOUBLE AS y3 FROM part),
a AS (SELECT p_brand, ring, abs(x1 * y2 - x2 * y1 + x2 * y3 - 0.25::DOUBLE * y2) / 2 AS area FROM k)
SELECT p_brand, ring, round(area, 6) AS area FROM a QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY area DESC, ring) = 1""",
    "river_arcs": f"""
WITH {fx.TRACKS}, s AS (SELECT track AS line, idx, coalesce(6371.0088::DOUBLE * sqrt(pow(radians(lon - lag(lon) OVER w) * cos(radians((lat + lag(lat) OVER w) / 2)), 2) + pow(radians(lat - lag(lat) OVER w), 2)), 0) AS step
  FROM tracks WINDOW w AS (PARTITION BY track ORDER BY idx)),
u AS (SELECT line, idx, sum(step) OVER (PARTITION BY line ORDER BY idx) AS km FROM s), t AS (SELECT *, max(km) OVER (PARTITION BY line) AS whole FROM u)
SELECT line, idx, round(km, 5) AS km, round(0.25::DOUBLE + 0.5::DOUBLE * CASE WHEN whole > 0 THEN km / whole ELSE 0 END, 7) AS phase FROM t""",
    "void_fill": f"""WITH {fx.DEM}, f AS (SELECT tile, quantile_cont(z, 0.5) AS fill FROM dem WHERE NOT isnan(z) GROUP BY tile)
SELECT d.tile, r, c, round(CASE WHEN isnan(z) THEN coalesce(fill, z) ELSE z END, 6) AS z FROM dem d LEFT JOIN f ON f.tile = d.tile""",
    "line_raster": f"WITH {_SCALED} SELECT y, x, count(*) AS n FROM cells GROUP BY ALL",
    "track_raster": f"""
WITH {_SCALED}, centre AS (SELECT line // 100 AS raster, y, x, min((idx + t) / 1024.0::DOUBLE) AS late FROM cells GROUP BY ALL),
mask AS (SELECT raster, y + i AS y, x + j AS x, min(late) AS late FROM centre CROSS JOIN range(-1, 2) a(i) CROSS JOIN range(-1, 2) b(j) WHERE x + j BETWEEN 0 AND 127 AND y + i BETWEEN 0 AND 63 GROUP BY ALL),
ax AS (SELECT raster, y, x + d AS x, sum(late * v) AS late, sum(v) AS cover FROM mask CROSS JOIN {_TAPS} WHERE x + d BETWEEN 0 AND 127 GROUP BY ALL),
b AS (SELECT raster, y + d AS y, x, sum(late * k.v) AS late, sum(cover * k.v) AS cover FROM ax CROSS JOIN {_TAPS} WHERE y + d BETWEEN 0 AND 63 GROUP BY ALL)
SELECT raster, y, x, round(CASE WHEN cover > 1e-6 THEN late / cover ELSE 0 END + {OFF}::DOUBLE, 7) AS phase, round(cover, 6) AS cover FROM b""",
    # lines are components of crossings; a closed one has no crossing with a single piece
    "contour_lines": f"""
WITH RECURSIVE {fx.FILLED}, {_SQUARES},
w AS (SELECT tile, level, p, q FROM seg UNION ALL SELECT tile, level, q, p FROM seg), deg AS (SELECT tile, level, p, count(*) AS n FROM w GROUP BY ALL),
reach(tile, level, p, other) AS (SELECT tile, level, p, p FROM deg UNION SELECT x.tile, x.level, x.p, w.q FROM reach x JOIN w ON w.tile = x.tile AND w.level = x.level AND w.p = x.other),
lab AS (SELECT tile, level, p, min(other) AS line FROM reach GROUP BY ALL),
comp AS (SELECT tile, level, line, bool_and(n = 2) AS closed FROM lab JOIN deg USING (tile, level, p) GROUP BY ALL),
len AS (SELECT tile, level, sum(len) AS length FROM seg GROUP BY ALL)
SELECT tile, level, count(*) AS lines, count(*) FILTER (WHERE closed) AS closed, round(max(length), 5) AS length FROM comp JOIN len USING (tile, level) GROUP BY tile, level""",
    "solid_volumes": f"""
WITH {fx.FILLED}, sq AS (SELECT tile, r, c, z AS a, lead(z) OVER (PARTITION BY tile, r ORDER BY c) AS b, lead(z) OVER (PARTITION BY tile, c ORDER BY r) AS d FROM filled),
s AS (SELECT *, lead(d) OVER (PARTITION BY tile, r ORDER BY c) AS e FROM sq QUALIFY e IS NOT NULL)
SELECT tile, {4 * (S - 1) ** 2 + 8 * (S - 1)}::BIGINT - (tile % 5 = 0)::INT AS faces, round(sum((a + d + e) / 6 + (a + e + b) / 6 - {BASE}::DOUBLE - CASE WHEN tile % 5 = 0 AND r = 0 AND c = 0 THEN a / 6 ELSE 0 END) + {OFF}::DOUBLE, 3) AS volume,
  CASE WHEN tile % 5 = 0 THEN 3 ELSE 0 END::BIGINT AS open, tile % 5 <> 0 AS kept FROM s GROUP BY tile
UNION ALL SELECT DISTINCT tile, 4, round(0.125::DOUBLE * 0.125::DOUBLE * 0.125::DOUBLE / 6 + {OFF}::DOUBLE, 3), 0, false FROM s WHERE tile % 7 = 0""",
    "surface_hits": f"""
WITH {fx.FILLED}, k AS (SELECT o_orderkey AS ray, o_custkey % (SELECT count(*) FROM supplier) AS tile, o_orderkey * 37 % 1487 / 100.0::DOUBLE + 0.063::DOUBLE AS x, o_orderkey * 91 % 1487 / 100.0::DOUBLE + 0.029::DOUBLE AS y FROM orders),
q AS (SELECT ray, x - floor(x) AS u, y - floor(y) AS v, a.z AS nw, b.z AS ne, d.z AS sw, e.z AS se FROM k
  JOIN filled a ON a.tile = k.tile AND a.r = floor(y) AND a.c = floor(x) JOIN filled b ON b.tile = k.tile AND b.r = floor(y) AND b.c = floor(x) + 1
  JOIN filled d ON d.tile = k.tile AND d.r = floor(y) + 1 AND d.c = floor(x) JOIN filled e ON e.tile = k.tile AND e.r = floor(y) + 1 AND e.c = floor(x) + 1)
SELECT ray, round(CASE WHEN v >= u THEN nw + v * (sw - nw) + u * (se - sw) ELSE nw + u * (ne - nw) + v * (se - ne) END + {OFF}::DOUBLE, 3) AS z FROM q""",
    "map_homography": f"""WITH {fx.POINTS}, p AS (SELECT id, x % 512 AS x, y FROM points)
SELECT id, round(({_H[0][0]} * x + {_H[0][1]} * y + {_H[0][2]}) / {_W}, 6) AS u, round(({_H[1][0]} * x + {_H[1][1]} * y + {_H[1][2]}) / {_W}, 6) AS v FROM p""",
    "map_place": f"""WITH {fx.TRACKS}, t AS (SELECT *, lon BETWEEN {BOX[0]} AND {BOX[2]} AND lat BETWEEN {BOX[1]} AND {BOX[3]} AS ins FROM tracks)
SELECT track, idx, round(CASE WHEN ins THEN (lon - {BOX[0]}) / {BOX[2] - BOX[0]} * 640 END, 6) AS x, round(CASE WHEN ins THEN (lat - {BOX[1]}) / {BOX[3] - BOX[1]} * 360 END, 6) AS y FROM t""",
    "near_between": f"""
WITH {fx.POINTS}, l AS (SELECT *, id // 3 % 5 AS label, count(*) OVER (PARTITION BY id // 3 % 5) AS n FROM points),
p AS (SELECT a.label AS a, b.label AS b, a.id AS u, b.id AS v, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS d FROM l a JOIN l b ON abs(a.x - b.x) <= 12 AND abs(a.y - b.y) <= 12 AND a.label <> b.label AND (a.n, a.label) < (b.n, b.label))
SELECT a, b, u, v, round(d, 6) AS d, row_number() OVER (PARTITION BY u, b ORDER BY d, v)::INT AS place FROM p WHERE d <= 12 QUALIFY place <= 2""",
    "playback_clock": """
WITH s AS (SELECT *, (epoch_us(ts) / 1e6::DOUBLE - 1.7e9::DOUBLE) * 60 AS e FROM events), c AS (SELECT *, 18000 + (e - 57600.0::DOUBLE * floor(e / 57600.0::DOUBLE)) AS shown FROM s)
SELECT event_id, round(shown, 3) AS second, round(pow((shown - 18000) / 57600, 2) * (3 - 2 * (shown - 18000) / 57600), 6) AS eased, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS reached FROM c""",
    "road_vertices": """
WITH r AS (SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.6::DOUBLE END AS weight, (134 + o_orderkey % 3 + o_orderkey * 37 % 4096 / 4096.0::DOUBLE) / 256 AS fx, (90 + o_orderkey % 2 + o_orderkey * 91 % 4096 / 4096.0::DOUBLE) / 256 AS fy FROM orders)
SELECT k AS id, weight, round(fx * 360 - 180, 7) AS lon, round(degrees(2 * atan(exp(pi() * (1 - 2 * fy))) - pi() / 2), 7) AS lat FROM r WHERE weight IS NOT NULL AND k % 5 <> 0 AND k % 7 <> 0""",
}


def _coverage() -> str:
    from cragline.plans import mapping_queries as mq

    return f"""WITH {fx.FILLED}, m AS (SELECT * FROM ({mq.ORACLES['land_mask']}))
SELECT m.tile, avg(inside::INT::DOUBLE) AS coverage, count(*) FILTER (WHERE inside AND z < 0) AS below FROM m JOIN filled f ON f.tile = m.tile AND f.r = m.r AND f.c = m.c GROUP BY m.tile"""


ORACLES["mask_coverage"] = _coverage()
