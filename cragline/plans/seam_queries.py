"""Queries on corridors between print tiles: shortcuts of graphs, and the seams themselves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cragline.operators import junctions, near, seams
from cragline.plans import fixtures as fx
from cragline.session import written

SIDE = fx.SIDE * fx.MOSAIC
#: Reach of the points' edges and of their shortcuts, and how much longer a way round may be.
NEAR, REACH, ALPHA = 12.0, 20.0, 1.6
#: Of the seams: levels, how far a line may turn back, reach of shortcuts, and lengths of a row and a column.
FINE, COARSE, THRESHOLD, TURN, RADIUS, SPACING = 150.0, 450.0, 300.0, 3.0, 3.0, (10.0, 9.0)


def graph_detours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of points that lie much nearer than the graph of a third of their neighbours says."""
    points = fx.points(spark, sf_dir)
    edges = near.near_pairs(points, NEAR).where("(u + v) % 3 = 0")
    found = seams.detours(points.withColumn("graph", F.lit(0)), edges.select(F.lit(0).alias("graph"), "u", "v", F.col("d").alias("w")), REACH, ALPHA)
    return found.select("u", "v", F.round("d", 6).alias("d"))


def corridors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(corridor, raster, axis, r0, r1, c0, c1): three bands of ten cells each way over each relief."""
    bands = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.lit(k).alias("k")) for a in "yx" for k in (1, 2, 3)])).alias("b")
    middle = F.col("b.k") * (SIDE // 4)
    along = F.col("b.axis") == "y"
    low, high = middle - 5, middle + 5
    number = F.col("raster") * 8 + F.col("b.k") + F.when(along, 0).otherwise(4)
    ends = {"r0": F.when(along, 0).otherwise(low), "r1": F.when(along, SIDE).otherwise(high), "c0": F.when(along, low).otherwise(0), "c1": F.when(along, high).otherwise(SIDE)}
    found = fx.relief(spark, sf_dir).select("raster").distinct().select("raster", bands)
    return found.select(number.alias("corridor"), "raster", F.col("b.axis").alias("axis"), *[v.cast("int").alias(k) for k, v in ends.items()])


def seam_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each corridor's seam, point by point, or why it has none."""
    bands = corridors(spark, sf_dir)
    nodes, edges = seams.seam_graph(fx.relief(spark, sf_dir), bands, SIDE // 4, FINE, COARSE, THRESHOLD, TURN, RADIUS * SPACING[0], ALPHA, SPACING)
    found = seams.paths(nodes, edges, bands, SPACING, SPACING[0])
    return found.withColumns({a: F.round(a, 5) for a in ("r", "c", "cost")})


def seam_junctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seams, laid anew where those of both directions cross."""
    every = seam_paths(spark, sf_dir).where("reason IS NULL")
    lines = written(every.select(F.col("corridor").alias("line"), F.col("seq").alias("idx"), "r", "c"), "seams")
    down, across = (corridors(spark, sf_dir).where(F.col("axis") == a).select("raster", F.col("corridor").alias(n), F.col(f"{b}0").alias(b)) for a, n, b in (("y", "v", "c"), ("x", "h", "r")))
    crossings = down.join(across, "raster").select((F.col("v") * (1 << 20) + F.col("h")).alias("junction"), "v", "h", (F.col("r") + 5.0).alias("r"), (F.col("c") + 5.0).alias("c"))
    found, _ = junctions.refined(lines, crossings, 8.0, RADIUS * SPACING[0], ALPHA, SPACING)
    return found.select(F.col("line").alias("corridor"), "idx", F.round("r", 5).alias("r"), F.round("c", 5).alias("c"))


def line_splice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks in which four of ten points are replaced by three, every other time backwards; replacements that begin inside others don't count."""
    lines = fx.tracks(spark, sf_dir).select(F.col("track").alias("line"), "idx", F.col("lat").alias("r"), F.col("lon").alias("c"))
    k = F.floor(F.col("idx") / 10)
    begins = lines.where("idx % 10 IN (2, 4)").select("line", (k + F.when(F.col("idx") % 10 == 4, 1000).otherwise(0)).alias("id"), F.col("idx").alias("first"), (F.col("idx") + 3).alias("last"), k.alias("k"))
    begins = begins.join(lines.select("line", F.col("idx").alias("last")), ["line", "last"], "left_semi")
    spread = begins.withColumn("seq", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).withColumn("idx", F.when(F.col("k") % 2 == 0, F.col("first") + F.col("seq")).otherwise(F.col("last") - F.col("seq")))
    moved = lines.join(spread, ["line", "idx"]).select("line", "id", "first", "last", "seq", (F.col("r") + 0.001 * (F.col("seq") + 1)).alias("r"), "c")
    found = junctions.spliced(lines, moved)
    return found.select("line", "idx", F.round("r", 6).alias("r"), F.round("c", 6).alias("c"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"graph_detours": graph_detours, "seam_paths": seam_paths, "seam_junctions": seam_junctions, "line_splice": line_splice}

ORACLES: dict[str, str] = {
    "graph_detours": f"""
WITH RECURSIVE {fx.POINTS}, p AS (SELECT a.id AS u, b.id AS v, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS d FROM points a JOIN points b ON abs(a.x - b.x) <= {REACH} AND abs(a.y - b.y) <= {REACH} AND a.id < b.id),
e AS (SELECT u, v, d AS w FROM p WHERE d <= {NEAR} AND (u + v) % 3 = 0 UNION ALL SELECT v, u, d FROM p WHERE d <= {NEAR} AND (u + v) % 3 = 0),
walk(u, x, d) USING KEY (u, x) AS (
  SELECT id, id, 0::DOUBLE FROM points
  UNION SELECT w.u, e.v, min(w.d + e.w) FROM walk w JOIN e ON e.u = w.x LEFT JOIN recurring.walk r ON r.u = w.u AND r.x = e.v
    WHERE w.d + e.w <= {ALPHA * REACH} AND (r.d IS NULL OR w.d + e.w < r.d) GROUP BY w.u, e.v
)
SELECT p.u, p.v, round(p.d, 6) AS d FROM p LEFT JOIN walk w ON w.u = p.u AND w.x = p.v WHERE p.d > 0 AND p.d <= {REACH} AND (w.d IS NULL OR w.d > {ALPHA}::DOUBLE * p.d)""",
    # a replacement is turned where its ends lie nearer to the section's ends that way
    "line_splice": f"""
WITH {fx.TRACKS}, l AS (SELECT track AS line, idx, lat AS r, lon AS c FROM tracks),
s AS (SELECT a.line, a.idx AS f, a.r AS fr, a.c AS fc, b.r AS lr, b.c AS lc, a.idx // 10 % 2 = 0 AS even FROM l a JOIN l b ON b.line = a.line AND b.idx = a.idx + 3 WHERE a.idx % 10 = 2),
m AS (SELECT s.*, q.seq, p.r + 0.001::DOUBLE * (q.seq + 1) AS r, p.c FROM s CROSS JOIN range(3) q(seq) JOIN l p ON p.line = s.line AND p.idx = CASE WHEN even THEN f + q.seq ELSE f + 3 - q.seq END),
e AS (SELECT line, f, arg_min(r, seq) AS ar, arg_min(c, seq) AS ac, arg_max(r, seq) AS br, arg_max(c, seq) AS bc FROM m GROUP BY line, f),
t AS (SELECT s.line, s.f, sqrt(pow(ar - fr, 2) + pow(ac - fc, 2)) + sqrt(pow(br - lr, 2) + pow(bc - lc, 2)) > sqrt(pow(br - fr, 2) + pow(bc - fc, 2)) + sqrt(pow(ar - lr, 2) + pow(ac - lc, 2)) AS turned FROM s JOIN e ON e.line = s.line AND e.f = s.f),
every AS (SELECT l.line, l.idx AS o, 0 AS q, l.r, l.c FROM l LEFT JOIN s ON s.line = l.line AND l.idx BETWEEN s.f AND s.f + 3 WHERE s.line IS NULL
  UNION ALL SELECT m.line, m.f, CASE WHEN turned THEN -seq ELSE seq END, m.r, m.c FROM m JOIN t ON t.line = m.line AND t.f = m.f),
kept AS (SELECT *, lag(r) OVER w AS br, lag(c) OVER w AS bc FROM every WINDOW w AS (PARTITION BY line ORDER BY o, q))
SELECT line, row_number() OVER (PARTITION BY line ORDER BY o, q)::INT - 1 AS idx, round(r, 6) AS r, round(c, 6) AS c FROM kept WHERE br IS NULL OR br <> r OR bc <> c""",
}
