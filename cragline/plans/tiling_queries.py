"""Queries on tilings, clearance tables, runs and retention."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cragline.functions import parse
from cragline.operators import tiling as ti
from cragline.plans import fixtures as fx
from cragline.session import table


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 900 + 100).cast("double").alias("total"), (F.col("o_orderkey") % 7 * 20 + 100).cast("double").alias("bed"), F.lit(10.0).alias("overlap")
    )


def tile_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ti.tile_starts(_sizes(spark, sf_dir))


def tile_corridors(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = _sizes(spark, sf_dir)
    return ti.corridors(ti.tile_starts(sizes), sizes, 0.5)


def tile_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = _sizes(spark, sf_dir)
    return ti.crop_bounds(ti.tile_starts(sizes), sizes, 0.4, 3.0)


def _grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("id"), (k % 4 + 1).cast("int").alias("nx"), (k % 3 + 1).cast("int").alias("ny"), (F.lit(0.125) * (k % 8)).alias("side"), F.lit(0.0).alias("border"))


def clearance_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ti.clearance_rows(_grids(spark, sf_dir))


def clearance_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed back from text, of which half is written with ';' and decimal commas."""
    rows = ti.clearance_rows(_grids(spark, sf_dir))
    european = F.regexp_replace(F.regexp_replace("text", ",", ";"), r"\.", ",")
    return ti.parse_clearance(rows.withColumn("text", F.when(F.col("id") % 2 == 0, european).otherwise(F.col("text"))))


def inside_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ti.inside_runs(fx.tracks(spark, sf_dir).select(F.col("track").alias("line"), "idx", (F.col("lat") > 45).alias("inside")))


def offset_polyline(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = fx.tracks(spark, sf_dir).select(F.col("track").alias("line"), "idx", F.col("lon").alias("x"), F.col("lat").alias("y"))
    return ti.offset_polyline(lines, 0.25).select("line", "idx", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def retention_evict(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = fx.events(spark, sf_dir).select(
        F.col("cell").alias("store"), F.col("event_id").alias("file"), F.col("t_us").alias("mtime"), F.rint(F.col("value") * 100).cast("long").alias("bytes"), (F.col("event_id") % 11 == 0).alias("pinned")
    )
    return ti.evicted(files, F.lit(100_000))


def content_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", ti.content_key("p_name", "p_brand", "p_size").alias("key"))


def elevation_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    text = F.when(k % 5 == 0, F.concat((k % 9).cast("string"), F.lit(",810 m"))).when(k % 5 == 1, F.concat(k.cast("string"), F.lit(",5 m")))
    text = text.when(k % 5 == 2, F.concat(k.cast("string"), F.lit(" ft"))).when(k % 5 == 3, F.concat(F.lit("-"), k.cast("string"), F.lit(".25"))).otherwise("unknown")
    return table(spark, sf_dir, "part").select("p_partkey", F.round(parse.elevation(text), 6).alias("metres"))


def tile_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.when(F.col("p_partkey") % 2 == 0, "tile_").otherwise(""), F.lpad((F.col("p_partkey") % 97).cast("string"), 2, "0"), F.lit("_"), F.lpad(F.col("p_size").cast("string"), 2, "0"))
    name = F.when(F.col("p_partkey") % 13 == 0, "none").otherwise(name)
    found = parse.tile_name(name)
    return table(spark, sf_dir, "part").select("p_partkey", found["ty"].alias("ty"), found["tx"].alias("tx"))


_SIZES = "s AS (SELECT o_orderkey AS id, (o_custkey % 900 + 100)::DOUBLE AS total, (o_orderkey % 7 * 20 + 100)::DOUBLE AS bed, 10.0::DOUBLE AS ov FROM orders)"
_STARTS = f"{_SIZES}, n AS (SELECT *, greatest(1, ceil(greatest(total - ov, 0) / (bed - ov)))::INT AS n FROM s), p AS (SELECT id, total, bed, ov, unnest(range(n))::INT AS i, n FROM n), st AS (SELECT *, -0.5::DOUBLE * greatest(0, bed + (n - 1) * (bed - ov) - total) + i * (bed - ov) AS start FROM p)"
_GRIDS = "g AS (SELECT s_suppkey AS id, (s_suppkey % 4 + 1)::INT AS nx, (s_suppkey % 3 + 1)::INT AS ny, 0.125::DOUBLE * (s_suppkey % 8) AS side FROM supplier), t AS (SELECT id, nx, ny, side, ty::INT AS ty, tx::INT AS tx FROM g, range(ny) a(ty), range(nx) b(tx))"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "tile_plan": tile_plan, "tile_corridors": tile_corridors, "tile_bounds": tile_bounds, "clearance_format": clearance_format, "clearance_parse": clearance_parse,
    "inside_runs": inside_runs, "offset_polyline": offset_polyline, "retention_evict": retention_evict, "content_keys": content_keys, "elevation_text": elevation_text,
    "tile_names": tile_names,
}

ORACLES: dict[str, str] = {
    "tile_plan": f"WITH {_STARTS} SELECT id, i, start FROM st",
    "tile_corridors": f"WITH {_STARTS} SELECT id, i, round_even(start / 0.5, 0)::BIGINT AS c0, least(round_even(total / 0.5, 0), round_even(start / 0.5, 0) + round_even(ov / 0.5, 0))::BIGINT AS c1 FROM st WHERE i > 0 AND least(round_even(total / 0.5, 0), round_even(start / 0.5, 0) + round_even(ov / 0.5, 0)) > round_even(start / 0.5, 0)",
    "tile_bounds": f"WITH {_STARTS} SELECT id, i, floor(greatest(0, start - 3) / 0.4::DOUBLE)::BIGINT AS p0, ceil(least(total, start - 3 + bed + 6) / 0.4::DOUBLE)::BIGINT AS p1 FROM st",
    "clearance_format": f"""
WITH {_GRIDS}, f AS (SELECT *, format('{{:8.3f}}', side) AS s, format('{{:8.3f}}', 0.0::DOUBLE) AS z, repeat(' ', 8) AS b FROM t),
r AS (SELECT id, ty, unnest([0, 1, 2]) AS k, tx, unnest([b || ',' || CASE WHEN ty = 0 THEN z ELSE s END || ',' || b,
  CASE WHEN tx = 0 THEN z ELSE s END || ',' || lpad(format('{{:02d}}_{{:02d}}', ty, tx), 8, ' ') || ',' || CASE WHEN tx = nx - 1 THEN z ELSE s END, b || ',' || CASE WHEN ty = ny - 1 THEN z ELSE s END || ',' || b]) AS x FROM f)
SELECT id, (ty * 3 + k)::BIGINT AS line, string_agg(x, ',' ORDER BY tx) AS text FROM r GROUP BY id, ty, k""",
    "clearance_parse": f"""WITH {_GRIDS} SELECT id, tx, ty, unnest(['top', 'left', 'right', 'bottom']) AS edge,
  unnest([CASE WHEN ty = 0 THEN 0 ELSE side END, CASE WHEN tx = 0 THEN 0 ELSE side END, CASE WHEN tx = nx - 1 THEN 0 ELSE side END, CASE WHEN ty = ny - 1 THEN 0 ELSE side END]) AS mm FROM t""",
    "inside_runs": f"""WITH {fx.TRACKS}, i AS (SELECT track, idx, idx - row_number() OVER (PARTITION BY track ORDER BY idx) AS isl FROM tracks WHERE lat > 45),
r AS (SELECT track AS line, min(idx) AS f, max(idx) AS l FROM i GROUP BY track, isl) SELECT line, row_number() OVER (PARTITION BY line ORDER BY f)::INT AS run, f AS "first", l AS "last" FROM r""",
    "offset_polyline": f"""
WITH {fx.TRACKS}, d AS (SELECT track, idx, lon AS x, lat AS y, lead(lon) OVER w - lon AS dx, lead(lat) OVER w - lat AS dy FROM tracks WINDOW w AS (PARTITION BY track ORDER BY idx)),
n AS (SELECT *, dy / (CASE WHEN sqrt(dx * dx + dy * dy) = 0 THEN 1 ELSE sqrt(dx * dx + dy * dy) END) AS nx, -dx / (CASE WHEN sqrt(dx * dx + dy * dy) = 0 THEN 1 ELSE sqrt(dx * dx + dy * dy) END) AS ny FROM d),
v AS (SELECT *, coalesce(nx, 0) + coalesce(lag(nx) OVER w, 0) AS sx, coalesce(ny, 0) + coalesce(lag(ny) OVER w, 0) AS sy FROM n WINDOW w AS (PARTITION BY track ORDER BY idx)),
l AS (SELECT *, CASE WHEN sqrt(sx * sx + sy * sy) = 0 THEN 1 ELSE sqrt(sx * sx + sy * sy) END AS l FROM v)
SELECT track AS line, idx, round(x + sx / l * 0.25, 6) AS x, round(y + sy / l * 0.25, 6) AS y FROM l""",
    "retention_evict": """
WITH f AS (SELECT user_id AS store, event_id AS file, epoch_us(ts) AS mtime, round_even(value * 100, 0)::BIGINT AS bytes, event_id % 11 = 0 AS pinned FROM events),
t AS (SELECT *, sum(bytes) OVER (PARTITION BY store) AS total, coalesce(sum(bytes) OVER (PARTITION BY store, pinned ORDER BY mtime, file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone FROM f)
SELECT store, file FROM t WHERE NOT pinned AND total - gone > 100000""",
    "content_keys": "SELECT p_partkey, sha256(length(p_name) || ':' || p_name || length(p_brand) || ':' || p_brand || length(p_size::VARCHAR) || ':' || p_size) AS key FROM part",
    "elevation_text": """SELECT p_partkey, round(CASE p_partkey % 5 WHEN 0 THEN (p_partkey % 9) * 1000 + 810 WHEN 1 THEN p_partkey + 0.5::DOUBLE WHEN 2 THEN p_partkey * 0.3048::DOUBLE WHEN 3 THEN -(p_partkey + 0.25::DOUBLE) END, 6) AS metres FROM part""",
    "tile_names": "SELECT p_partkey, CASE WHEN p_partkey % 13 <> 0 THEN (p_partkey % 97)::INT END AS ty, CASE WHEN p_partkey % 13 <> 0 THEN p_size END AS tx FROM part",
}
