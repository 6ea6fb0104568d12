"""Queries on points, graphs, river networks and meshes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cragline.operators import graph as g
from cragline.operators import near
from cragline.plans import fixtures as fx
from cragline.session import shuffled, written
from cragline.sources import files

RADIUS = 12.0


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_pairs(fx.points(spark, sf_dir), RADIUS).select("u", "v", F.col("d").alias("w"))


def graph_shortest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of each point to the nearest of every hundredth, within 60."""
    sources = fx.points(spark, sf_dir).where("id % 100 = 0").select("id")
    return g.distances(_edges(spark, sf_dir), sources, 60.0).select("id", F.round("d", 6).alias("d"))


def graph_mst(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each component, edges and total weight of its minimum spanning tree."""
    edges = written(_edges(spark, sf_dir), "edges")
    tree = g.spanning_forest(edges).join(shuffled(g.components(edges)), F.col("u") == F.col("id"))
    return tree.groupBy(F.col("label").alias("component")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("w"), 4).alias("total"))


def graph_bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What joins the components of short steps between two thirds of the points, in steps up to RADIUS."""
    points = written(fx.points(spark, sf_dir), "points")
    steps = near.near_pairs(points.where("id % 3 <> 0"), 6.0).select("u", "v")
    return g.bridges(points, steps, RADIUS).select("u", "v", F.round("w", 6).alias("d"))


def graph_borders(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = fx.tracks(spark, sf_dir).select(F.col("track").alias("graph"), F.col("idx").alias("id"), "lat")
    return g.border_links(nodes, "lat", 43.5, 48.25).withColumn("length", F.round("length", 6))


def near_closest(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = fx.points(spark, sf_dir)
    labels = points.select("id", (F.floor(F.col("id") / 3) % 5).alias("label"))
    return near.closest_between(points, labels, RADIUS).select("a", "b", F.round("d", 6).alias("d"))


def _edge_sets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    points = fx.points(spark, sf_dir)
    return near.near_pairs(points.where("id % 3 <> 0"), RADIUS).select("u", "v"), near.near_pairs(points.where("id % 3 <> 1"), RADIUS).select("u", "v")


def edge_symmetric_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _edge_sets(spark, sf_dir)
    return a.exceptAll(b).union(b.exceptAll(a))


def edge_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _edge_sets(spark, sf_dir)
    return a.intersect(b)


def river_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.network_phases(fx.reaches(spark, sf_dir)).select("id", F.round("begin", 6).alias("begin"), F.round("end", 6).alias("end"))


def river_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.width_weights(fx.reaches(spark, sf_dir), "q").select("id", F.round("weight", 6).alias("weight"))


def river_reveal_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reaches whose begin, in 1/65535, lies in the band that is newly shown."""
    phased = g.network_phases(fx.reaches(spark, sf_dir)).withColumn("step", F.rint(F.col("begin") * 65535).cast("long"))
    return phased.where("step > 16383 AND step <= 49151").select("id", "step")


def shared_divides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that the squares of two raster cells share: two thirds of all cells are basins of their own."""
    cells = fx.dem(spark, sf_dir).where("(r + c) % 3 <> 0")
    corner = lambda i, j: F.col("tile") * 1000 + (F.col("r") + i) * 17 + F.col("c") + j
    return g.shared_edges_of(cells.select(F.array(corner(0, 0), corner(0, 1), corner(1, 1), corner(1, 0)).alias("ps")))


def _triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two triangles for each cell that has four corners (r, c), split along the falling diagonal."""
    cells = fx.dem(spark, sf_dir).where(~F.isnan("z"))
    v = lambda i, j: F.col("tile") * 1000 + (F.col("r") + i) * 17 + F.col("c") + j
    upper = F.struct(v(0, 0).alias("a"), v(0, 1).alias("b"), v(1, 1).alias("c2"))
    lower = F.struct(v(0, 0).alias("a"), v(1, 1).alias("b"), v(1, 0).alias("c2"))
    return cells.select("tile", "z", F.explode(F.array(upper, lower)).alias("t")).select("tile", "z", F.col("t.a").alias("a"), F.col("t.b").alias("b"), F.col("t.c2").alias("c"))


def mesh_boundary_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.boundary_edges(_triangles(spark, sf_dir).select("a", "b", "c"))


def _solids(spark: SparkSession, sf_dir: str, turned: str) -> DataFrame:
    """(path, r, c, x1..z3): triangles over three neighbouring cells, a path for each tile; those turned look down."""
    from cragline.operators import raster as ra

    cells = fx.filled_dem(spark, sf_dir)
    near3 = cells.withColumns({"zx": F.lead("z").over(ra.along_row()), "zy": F.lead("z").over(ra.along_column())}).where("zx IS NOT NULL AND zy IS NOT NULL")
    corner = lambda x, y, z: F.struct((F.col("c") + x).cast("double").alias("x"), (F.col("r") + y).cast("double").alias("y"), F.col(z).alias("z"))
    right, below = corner(1, 0, "zx"), corner(0, 1, "zy")
    ends = [corner(0, 0, "z"), F.when(F.expr(turned), below).otherwise(right), F.when(F.expr(turned), right).otherwise(below)]
    placed = near3.select(F.col("tile").alias("path"), "r", "c", *[e.alias(f"p{i}") for i, e in enumerate(ends, 1)])
    return placed.select("path", "r", "c", *[F.col(f"p{i}.{a}").alias(f"{a}{i}") for i in (1, 2, 3) for a in "xyz"])


#: Which triangles are wound the other way.
_TURNED = "(r * 5 + c * 3) % 4 = 0"


def mesh_upward(spark: SparkSession, sf_dir: str, turned: str = "false") -> DataFrame:
    """Triangles that look up, at any height; those that a rule winds the other way are dropped."""
    kept = files.upward(_solids(spark, sf_dir, turned))
    return kept.select(F.col("path").alias("tile"), "r", "c", F.round(F.greatest("z1", "z2", "z3"), 4).alias("top"))


def mesh_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    solids = _solids(spark, sf_dir, "false")
    n = solids.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    return files.mesh_bounds(solids).join(n, "path").select(F.col("path").alias("tile"), F.round("min_z", 4).alias("low"), F.round("max_z", 4).alias("high"), "n")


def mesh_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of the triangles that look up, where a rule on r and c turns some."""
    ends = files.mesh_bounds(files.upward(_solids(spark, sf_dir, _TURNED)))
    return ends.select(F.col("path").alias("tile"), *[F.round(f"{end}_{a}", 4).alias(f"{end}_{a}") for a in "xyz" for end in ("min", "max")])


_PAIRS = f"{fx.POINTS}, pairs AS (SELECT a.id AS u, b.id AS v, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS d FROM points a JOIN points b ON abs(a.x - b.x) <= {RADIUS} AND abs(a.y - b.y) <= {RADIUS} WHERE sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= {RADIUS})"
_SETS = f"{fx.POINTS}, p AS (SELECT a.id AS u, b.id AS v FROM points a JOIN points b ON a.id < b.id AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= {RADIUS}), a AS (SELECT u, v FROM p WHERE u % 3 <> 0 AND v % 3 <> 0), b AS (SELECT u, v FROM p WHERE u % 3 <> 1 AND v % 3 <> 1)"
_PHASES = f"{fx.REACHES}, up AS (SELECT id, id AS root, len AS s, len FROM reaches WHERE down NOT IN (SELECT id FROM reaches) UNION ALL SELECT r.id, u.root, u.s + r.len, r.len FROM reaches r JOIN up u ON r.down = u.id), ph AS (SELECT id, 1 - s / max(s) OVER (PARTITION BY root) AS b, len / max(s) OVER (PARTITION BY root) AS l FROM up)"
_LOOKING_UP = f"""{fx.FILLED}, n AS (SELECT *, lead(z) OVER (PARTITION BY tile, r ORDER BY c) AS zx, lead(z) OVER (PARTITION BY tile, c ORDER BY r) AS zy, (r * 5 + c * 3) % 4 = 0 AS turned FROM filled),
v AS (SELECT tile, r, c, z AS z1, c::DOUBLE AS x1, r::DOUBLE AS y1, CASE WHEN turned THEN c ELSE c + 1 END::DOUBLE AS x2, CASE WHEN turned THEN r + 1 ELSE r END::DOUBLE AS y2, CASE WHEN turned THEN zy ELSE zx END AS z2,
  CASE WHEN turned THEN c + 1 ELSE c END::DOUBLE AS x3, CASE WHEN turned THEN r ELSE r + 1 END::DOUBLE AS y3, CASE WHEN turned THEN zx ELSE zy END AS z3 FROM n WHERE zx IS NOT NULL AND zy IS NOT NULL),
up AS (SELECT * FROM v WHERE (x2 - x1) * (y3 - y1) - (y2 - y1) * (x3 - x1) > 1e-12)"""
_CORNER = lambda i, j: f"(tile * 1000 + (r + {i}) * 17 + c + {j})"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "near_pairs": lambda s, d: near.near_pairs(fx.points(s, d), RADIUS).select("u", "v", F.round("d", 6).alias("d")),
    "near_knn": lambda s, d: near.nearest(fx.points(s, d), RADIUS, 3).select("u", "v", F.round("d", 6).alias("d"), "place"),
    "near_closest": near_closest,
    "graph_components": lambda s, d: g.components(_edges(s, d)),
    "graph_shortest_path": graph_shortest,
    "graph_two_core": lambda s, d: g.two_core(_edges(s, d)),
    "graph_mst_bridges": graph_mst,
    "graph_bridges": graph_bridges, "graph_borders": graph_borders,
    "edge_symmetric_difference": edge_symmetric_difference,
    "edge_intersect": edge_intersect,
    "river_phases": river_phases,
    "river_width": river_width,
    "river_reveal_band": river_reveal_band,
    "shared_divides": shared_divides,
    "mesh_boundary_edges": mesh_boundary_edges,
    "mesh_upward": mesh_upward,
    "mesh_bounds": mesh_bounds,
    "mesh_upward_turned": lambda s, d: mesh_upward(s, d, _TURNED),
    "mesh_box": mesh_box,
}

_COMPONENTS = f"WITH RECURSIVE {_PAIRS}, reach(id, other) AS (SELECT u, u FROM pairs WHERE u <> v UNION SELECT r.id, p.v FROM reach r JOIN pairs p ON p.u = r.other), comp AS (SELECT id, min(other) AS label FROM reach GROUP BY id)"
ORACLES: dict[str, str] = {
    "near_pairs": f"WITH {_PAIRS} SELECT u, v, round(d, 6) AS d FROM pairs WHERE u < v",
    "near_knn": f"WITH {_PAIRS} SELECT u, v, round(d, 6) AS d, row_number() OVER (PARTITION BY u ORDER BY d, v)::INT AS place FROM pairs WHERE u <> v AND d > 0 QUALIFY place <= 3",
    "near_closest": f"WITH {_PAIRS} SELECT u // 3 % 5 AS a, v // 3 % 5 AS b, round(min(d), 6) AS d FROM pairs WHERE u // 3 % 5 < v // 3 % 5 GROUP BY 1, 2",
    "graph_components": f"{_COMPONENTS} SELECT id, label FROM comp",
    # rounds of leaving out edges with an end of degree below two
    "graph_two_core": f"""
WITH RECURSIVE {_PAIRS}, core(n, u, v) AS (
  SELECT 0, u, v FROM pairs WHERE u < v
  UNION ALL (WITH now AS (SELECT * FROM core WHERE n < 100), ends AS (SELECT x FROM (SELECT u AS x FROM now UNION ALL SELECT v FROM now) GROUP BY x HAVING count(*) >= 2)
    SELECT n + 1, u, v FROM now WHERE u IN (SELECT x FROM ends) AND v IN (SELECT x FROM ends))
) SELECT u, v FROM core WHERE n = 100""",
    # short steps come first, and the forest's other edges are the bridges
    "graph_bridges": f"""
WITH RECURSIVE {_PAIRS}, old AS (SELECT *, d <= 6 AND u % 3 <> 0 AND v % 3 <> 0 AS had FROM pairs WHERE u < v),
ranked AS (SELECT u, v, d, had, row_number() OVER (ORDER BY NOT had, d, u, v) AS k FROM old),
ways AS (SELECT u, v, k FROM ranked UNION ALL SELECT v, u, k FROM ranked),
walk(k, x) AS (SELECT k, u FROM ranked UNION SELECT w.k, y.v FROM walk w JOIN ways y ON y.u = w.x AND y.k < w.k)
SELECT r.u, r.v, round(r.d, 6) AS d FROM ranked r WHERE NOT had AND NOT EXISTS (SELECT 1 FROM walk w WHERE w.k = r.k AND w.x = r.v)""",
    "graph_borders": f"""
WITH {fx.TRACKS}, e AS (SELECT track AS graph, arg_min(idx, struct_pack(a := lat, i := idx)) AS lo, min(lat) AS a, arg_min(idx, struct_pack(a := -lat, i := idx)) AS hi, max(lat) AS b FROM tracks GROUP BY track)
SELECT graph, lo AS id, 43.5::DOUBLE AS border, round(a - 43.5::DOUBLE, 6) AS length FROM e WHERE a > 43.5 UNION ALL SELECT graph, hi, 48.25::DOUBLE, round(48.25::DOUBLE - b, 6) FROM e WHERE b < 48.25""",
    # an edge belongs to the forest unless lesser edges join its ends
    "graph_mst_bridges": f"""{_COMPONENTS},
ranked AS (SELECT u, v, d, row_number() OVER (ORDER BY d, u, v) AS k FROM pairs WHERE u < v),
ways AS (SELECT u, v, k FROM ranked UNION ALL SELECT v, u, k FROM ranked),
walk(k, x) AS (SELECT k, u FROM ranked UNION SELECT w.k, y.v FROM walk w JOIN ways y ON y.u = w.x AND y.k < w.k),
tree AS (SELECT r.* FROM ranked r WHERE NOT EXISTS (SELECT 1 FROM walk w WHERE w.k = r.k AND w.x = r.v))
SELECT label AS component, count(*) AS n, round(sum(d), 4) AS total FROM tree t JOIN comp c ON c.id = t.u GROUP BY 1""",
    "graph_shortest_path": f"""
WITH RECURSIVE {_PAIRS}, walk(id, d, n) AS (
  SELECT id, 0::DOUBLE, 0 FROM points WHERE id % 100 = 0
  UNION SELECT p.v, min(w.d + p.d), w.n + 1 FROM walk w JOIN pairs p ON p.u = w.id AND p.u <> p.v WHERE w.d + p.d <= 60 AND w.n < 60 GROUP BY p.v, w.n
) SELECT id, round(min(d), 6) AS d FROM walk GROUP BY id""",
    "edge_symmetric_difference": f"WITH {_SETS} (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT SELECT * FROM a)",
    "edge_intersect": f"WITH {_SETS} SELECT * FROM a INTERSECT SELECT * FROM b",
    "river_phases": f"WITH RECURSIVE {_PHASES} SELECT id, round(b, 6) AS begin, round(b + l, 6) AS \"end\" FROM ph",
    "river_width": f"WITH {fx.REACHES}, t AS (SELECT greatest(quantile_cont(q, 0.995), 0.1) AS top FROM reaches) SELECT id, round(greatest(0, least(1, ln(1 + q) / ln(1 + top))), 6) AS weight FROM reaches CROSS JOIN t",
    "river_reveal_band": f"WITH RECURSIVE {_PHASES} SELECT id, round_even(b * 65535, 0)::BIGINT AS step FROM ph WHERE round_even(b * 65535, 0) > 16383 AND round_even(b * 65535, 0) <= 49151",
    "shared_divides": f"""
WITH {fx.DEM}, k AS (SELECT tile, r, c FROM dem WHERE (r + c) % 3 <> 0), e AS (
  SELECT DISTINCT tile, r, c, least(p, q) AS u, greatest(p, q) AS v FROM (
    SELECT tile, r, c, unnest([{_CORNER(0, 0)}, {_CORNER(0, 1)}, {_CORNER(1, 1)}, {_CORNER(1, 0)}]) AS p, unnest([{_CORNER(0, 1)}, {_CORNER(1, 1)}, {_CORNER(1, 0)}, {_CORNER(0, 0)}]) AS q FROM k))
SELECT u, v, count(*) AS n FROM e GROUP BY u, v HAVING count(*) >= 2""",
    "mesh_boundary_edges": f"""
WITH {fx.DEM}, t AS (SELECT unnest([{_CORNER(0, 0)}, {_CORNER(0, 1)}, {_CORNER(1, 1)}, {_CORNER(0, 0)}, {_CORNER(1, 1)}, {_CORNER(1, 0)}]) AS p, unnest([{_CORNER(0, 1)}, {_CORNER(1, 1)}, {_CORNER(0, 0)}, {_CORNER(1, 1)}, {_CORNER(1, 0)}, {_CORNER(0, 0)}]) AS q FROM dem WHERE NOT isnan(z))
SELECT least(p, q) AS u, greatest(p, q) AS v FROM t GROUP BY 1, 2 HAVING count(*) = 1""",
    "mesh_upward": f"WITH {fx.FILLED}, n AS (SELECT *, lead(z) OVER (PARTITION BY tile, r ORDER BY c) AS zx, lead(z) OVER (PARTITION BY tile, c ORDER BY r) AS zy FROM filled) SELECT tile, r, c, round(greatest(z, zx, zy), 4) AS top FROM n WHERE zx IS NOT NULL AND zy IS NOT NULL",
    "mesh_bounds": f"WITH {fx.FILLED}, n AS (SELECT *, lead(z) OVER (PARTITION BY tile, r ORDER BY c) AS zx, lead(z) OVER (PARTITION BY tile, c ORDER BY r) AS zy FROM filled) SELECT tile, round(min(least(z, zx, zy)), 4) AS low, round(max(greatest(z, zx, zy)), 4) AS high, count(*) AS n FROM n WHERE zx IS NOT NULL AND zy IS NOT NULL GROUP BY tile",
    "mesh_upward_turned": f"WITH {_LOOKING_UP} SELECT tile, r, c, round(greatest(z1, z2, z3), 4) AS top FROM up",
    "mesh_box": f"""WITH {_LOOKING_UP} SELECT tile, min(least(x1, x2, x3)) AS min_x, max(greatest(x1, x2, x3)) AS max_x, min(least(y1, y2, y3)) AS min_y, max(greatest(y1, y2, y3)) AS max_y,
  round(min(least(z1, z2, z3)), 4) AS min_z, round(max(greatest(z1, z2, z3)), 4) AS max_z FROM up GROUP BY tile""",
}
