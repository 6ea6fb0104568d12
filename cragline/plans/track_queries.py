"""Queries on tracks, places and map scales."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cragline.functions import mercator as m
from cragline.functions import parse
from cragline.operators import tracks as tr
from cragline.plans import fixtures as fx
from cragline.session import table


def track_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.speeds(fx.tracks(spark, sf_dir)).select("track", "idx", F.round("speed", 4).alias("speed"))


def track_pace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.speeds(fx.tracks(spark, sf_dir), "min/km").select("track", "idx", F.round("speed", 6).alias("pace"))


def track_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = fx.tracks(spark, sf_dir).withColumn("cents", F.rint(F.col("ele") * 100))
    return tr.smoothed(whole, "cents", 50, "smooth").select("track", "idx", F.round("smooth", 4).alias("smooth"))


def track_distance_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.distances(fx.tracks(spark, sf_dir)).select("track", "idx", F.round("metres", 2).alias("metres"), F.round("phase", 6).alias("phase"))


def track_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.split_segments(fx.tracks(spark, sf_dir), F.col("ele") >= 1)


def track_densified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of each track with steps of 20 km at most, counted and averaged."""
    dense = tr.densified(fx.tracks(spark, sf_dir), 20_000.0)
    return dense.groupBy("track").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("lat"), 6).alias("lat"), F.round(F.avg("lon"), 6).alias("lon"))


def mercator_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of zoom 12 that tracks touch, with their points."""
    px, py = m.to_pixel(F.col("lon"), F.col("lat"), F.lit(12))
    tiles = fx.tracks(spark, sf_dir).select(F.floor(px / m.TILE).alias("tx"), F.floor(py / m.TILE).alias("ty"), "ele")
    return tiles.groupBy("tx", "ty").agg(F.count(F.lit(1)).alias("points"), F.max("ele").alias("top"))


def zoom_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", m.zoom_for(F.col("p_retailprice") / 10 - 91).alias("zoom"))


def scale_bar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", tr.scale_bar(F.col("o_totalprice") / 100, F.lit(113.0)).alias("metres"))


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("P"), (k % 700).cast("string")).alias("name"), k.alias("row"), (43.5 + k % 49 / 10.0).alias("lat"),
        (4.9 + k % 115 / 10.0).alias("lon"), (k * 997 % 1_000_000).alias("population"), "c_acctbal",
    )


def places_in_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = _places(spark, sf_dir).where((F.col("population") > 50_000) & F.col("lat").between(44.0, 47.5) & F.col("lon").between(5.0, 14.0))
    return tr.last_by_name(inside.drop("c_acctbal"), "row")


def peaks_with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks with the elevation their tag says, or that of the raster below them."""
    k = F.col("c_custkey")
    tag = F.when(k % 4 == 0, F.concat(k.cast("string"), F.lit(" m"))).when(k % 4 == 1, F.concat((k % 9 + 1).cast("string"), F.lit(",810 m")))
    tag = tag.when(k % 4 == 2, F.concat((k * 3).cast("string"), F.lit(" ft"))).otherwise("unknown")
    peaks = table(spark, sf_dir, "customer").select(k.alias("peak"), tag.alias("tag"), (k % 16).cast("int").alias("r"), (k * 7 % 16).cast("int").alias("c"), "c_nationkey")
    cells = fx.filled_dem(spark, sf_dir).select(F.col("tile"), "r", "c", "z")
    joined = peaks.withColumn("tile", F.col("c_nationkey").cast("long")).join(cells, ["tile", "r", "c"], "left")
    return joined.select("peak", F.round(F.coalesce(parse.elevation(F.col("tag")), "z"), 4).alias("ele"))


_M = "6378137.0::DOUBLE"
_SPEED = f"""
WITH {fx.TRACKS}, xy AS (SELECT *, {_M} * radians(lon) AS x, {_M} * ln(tan(pi() / 4 + radians(lat) / 2)) AS y FROM tracks),
d AS (SELECT track, idx, lead(x) OVER w - x AS dx, lead(y) OVER w - y AS dy, (lead(t_us) OVER w - t_us) / 1e6::DOUBLE AS s FROM xy WINDOW w AS (PARTITION BY track ORDER BY idx)),
v AS (SELECT track, idx, CASE WHEN dx IS NOT NULL THEN CASE WHEN s > 0 THEN sqrt(dx * dx + dy * dy) / s ELSE 0 END END AS ms FROM d)"""
_HAVERSINE = "2 * 6371008.8::DOUBLE * asin(least(1, sqrt(pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2))))"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "track_speed": track_speed, "track_pace": track_pace, "track_smooth": track_smooth, "track_distance_phase": track_distance_phase,
    "track_colour_runs": lambda s, d: tr.colour_runs(fx.tracks(s, d), "ele"), "track_segments": track_segments, "track_densified": track_densified,
    "mercator_tiles": mercator_tiles, "zoom_choice": zoom_choice, "scale_bar": scale_bar, "places_in_bbox": places_in_bbox,
    "peaks_with_fallback": peaks_with_fallback,
}

ORACLES: dict[str, str] = {
    "track_speed": f"{_SPEED} SELECT track, idx, round(coalesce(ms, lag(ms) OVER (PARTITION BY track ORDER BY idx), 0) * 3.6::DOUBLE, 4) AS speed FROM v",
    "track_pace": f"""{_SPEED}, p AS (SELECT track, idx, CASE WHEN ms > 0 THEN 1000 / ms / 60 ELSE ms END AS p FROM v)
SELECT track, idx, round(coalesce(p, lag(p) OVER (PARTITION BY track ORDER BY idx), 0), 6) AS pace FROM p""",
    "track_smooth": f"""
WITH {fx.TRACKS}, n AS (SELECT *, round_even(ele * 100, 0) AS cents, count(*) OVER (PARTITION BY track) AS n FROM tracks),
w AS (SELECT *, least(50, n // 10 + 1) AS w0 FROM n), s AS (SELECT *, CASE WHEN w0 >= 3 AND w0 % 2 = 0 THEN w0 + 1 ELSE w0 END AS w FROM w)
SELECT a.track, a.idx, round(sum(b.cents) / a.w, 4) AS smooth FROM s a JOIN s b ON a.track = b.track
  AND b.idx BETWEEN a.idx - ceil((a.w - 1) / 2.0) AND a.idx + floor((a.w - 1) / 2.0) GROUP BY a.track, a.idx, a.w""",
    "track_distance_phase": f"""
WITH {fx.TRACKS}, p AS (SELECT *, lag(lat) OVER w AS lat1, lat AS lat2, lag(lon) OVER w AS lon1, lon AS lon2 FROM tracks WINDOW w AS (PARTITION BY track ORDER BY idx)),
s AS (SELECT track, idx, sum(coalesce({_HAVERSINE}, 0)) OVER (PARTITION BY track ORDER BY idx) AS metres FROM p)
SELECT track, idx, round(metres, 2) AS metres, round(CASE WHEN max(metres) OVER (PARTITION BY track) > 0 THEN metres / max(metres) OVER (PARTITION BY track) ELSE 0 END, 6) AS phase FROM s""",
    "track_colour_runs": f"""
WITH {fx.TRACKS}, b AS (SELECT track, min(ele) AS low, max(ele) AS high FROM tracks GROUP BY track),
s AS (SELECT track, idx, (ele + lead(ele) OVER (PARTITION BY track ORDER BY idx)) / 2 AS mean FROM tracks),
c AS (SELECT s.track, idx, round_even(greatest(0, least(1, (mean - low) / (CASE WHEN high = low THEN 1 ELSE high - low END))) * 255, 0)::INT AS colour FROM s JOIN b USING (track) WHERE mean IS NOT NULL),
m AS (SELECT *, (coalesce(lag(colour) OVER (PARTITION BY track ORDER BY idx), -1) <> colour)::INT AS begins FROM c),
r AS (SELECT *, sum(begins) OVER (PARTITION BY track ORDER BY idx)::BIGINT AS run FROM m)
SELECT track, run, colour, min(idx) AS "first", max(idx) AS "last" FROM r GROUP BY track, run, colour""",
    "track_segments": f"""
WITH {fx.TRACKS}, m AS (SELECT track, idx, ele >= 1 AS ok, sum((NOT ele >= 1)::INT) OVER (PARTITION BY track ORDER BY idx)::BIGINT AS seg FROM tracks)
SELECT track, seg, count(*) AS n, min(idx) AS "first", max(idx) AS "last" FROM m WHERE ok GROUP BY track, seg HAVING count(*) > 1""",
    "track_densified": f"""
WITH {fx.TRACKS}, p AS (SELECT track, idx, lat AS lat1, lon AS lon1, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2 FROM tracks WINDOW w AS (PARTITION BY track ORDER BY idx)),
n AS (SELECT *, coalesce(least(greatest(ceil(({_HAVERSINE}) / 20000), 1), 4096), 1)::INT AS n FROM p),
k AS (SELECT *, unnest(range(n)) AS k FROM n)
SELECT track, count(*) AS n, round(avg(lat1 + coalesce(lat2 - lat1, 0) * (k::DOUBLE / n)), 6) AS lat, round(avg(lon1 + coalesce(lon2 - lon1, 0) * (k::DOUBLE / n)), 6) AS lon FROM k GROUP BY track""",
    "mercator_tiles": f"""
WITH {fx.TRACKS}, res AS (SELECT *, 2 * pi() * {_M} / 256 / 4096 AS res FROM tracks)
SELECT floor((({_M} * radians(lon)) + pi() * {_M}) / res / 256)::BIGINT AS tx, floor((pi() * {_M} - {_M} * ln(tan(pi() / 4 + radians(lat) / 2))) / res / 256)::BIGINT AS ty,
       count(*) AS points, max(ele) AS top FROM res GROUP BY 1, 2""",
    "zoom_choice": f"SELECT p_partkey, coalesce(CASE WHEN p_retailprice / 10 - 91 > 0 THEN (SELECT min(z) FROM range(21) t(z) WHERE 2 * pi() * {_M} / 256 / pow(2, z) <= p_retailprice / 10 - 91) END, 20)::INT AS zoom FROM part",
    "scale_bar": """WITH s AS (SELECT floor(b * pow(10::DOUBLE, e))::BIGINT AS m FROM range(1, 10) t(e) CROSS JOIN (VALUES (1.0::DOUBLE), (2.5::DOUBLE), (5.0::DOUBLE)) v(b))
SELECT o_orderkey, (SELECT max(m) FROM s WHERE m / (o_totalprice / 100) <= 113) AS metres FROM orders""",
    "places_in_bbox": """
WITH p AS (SELECT concat('P', c_custkey % 700) AS name, c_custkey AS "row", 43.5::DOUBLE + c_custkey % 49 / 10.0::DOUBLE AS lat, 4.9::DOUBLE + c_custkey % 115 / 10.0::DOUBLE AS lon, c_custkey * 997 % 1000000 AS population FROM customer)
SELECT name, arg_max(lat, "row") AS lat, arg_max(lon, "row") AS lon, arg_max(population, "row") AS population FROM p
WHERE population > 50000 AND lat BETWEEN 44.0::DOUBLE AND 47.5::DOUBLE AND lon BETWEEN 5 AND 14 GROUP BY name""",
    "peaks_with_fallback": f"""
WITH {fx.FILLED}, p AS (SELECT c_custkey AS peak, c_nationkey::BIGINT AS tile, (c_custkey % 16)::INT AS r, (c_custkey * 7 % 16)::INT AS c, c_custkey % 4 AS kind, c_custkey AS k FROM customer)
SELECT peak, round(coalesce(CASE kind WHEN 0 THEN k::DOUBLE WHEN 1 THEN ((k % 9 + 1) * 1000 + 810)::DOUBLE WHEN 2 THEN k * 3 * 0.3048::DOUBLE END, z), 4) AS ele
FROM p LEFT JOIN filled f ON f.tile = p.tile AND f.r = p.r AND f.c = p.c""",
}
