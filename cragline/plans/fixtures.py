"""Inputs derived from the relational tables, in Spark and as DuckDB text. Their sizes follow the tables'."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cragline.functions.solar import micros
from cragline.session import table

#: Cells of a tile's side, azimuths of a skyline, and the place of the sun queries.
SIDE, ANGLES, LATITUDE, LONGITUDE, DAY = 16, 24, 45.95, 10.65, "2024-01-15"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, cell, ts, t_us, value); ts has no zone."""
    raw = table(spark, sf_dir, "events")
    ts = F.col("ts").cast("timestamp_ntz")
    return raw.select("event_id", F.col("user_id").alias("cell"), ts.alias("ts"), micros(ts).alias("t_us"), "value")


def toggles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell, t_ms): transitions on a 15-minute grid, with equal times in a cell."""
    return events(spark, sf_dir).select("cell", (F.col("event_id") % 96 * 900_000).alias("t_ms"))


TOGGLES = "toggles AS (SELECT user_id AS cell, (event_id % 96) * 900000 AS t_ms FROM events)"


def skylines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell, elevations): a horizon for each customer."""
    cells = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cell"))
    azimuths = F.sequence(F.lit(0), F.lit(ANGLES - 1))
    return cells.select("cell", F.transform(azimuths, lambda a: ((F.col("cell") * 31 + a * 17) % 70 / 2.0).cast("float")).alias("elevations"))


def dem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tile, r, c, z DOUBLE): a raster tile for each supplier; cells without a line item are absent, some are void (NaN)."""
    lines = table(spark, sf_dir, "lineitem")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    placed = lines.select(F.col("l_suppkey").alias("tile"), (F.col("l_orderkey") % SIDE).cast("int").alias("r"), (F.col("l_partkey") % SIDE).cast("int").alias("c"), cents.alias("cents"))
    # a task of the table holds few items of a cell, so they are shuffled first: sums before would take its memory and spare little
    cells = placed.repartition("tile", "r", "c").groupBy("tile", "r", "c").agg(F.floor(F.sum("cents") / F.count(F.lit(1))).alias("mean"))
    void = (F.col("r") * 31 + F.col("c") * 17) % 97 == 0
    return cells.select("tile", "r", "c", F.when(void, F.lit(float("nan"))).otherwise(F.col("mean") / 5000.0 - 760).alias("z"))


DEM = f"""means AS (SELECT l_suppkey AS tile, (l_orderkey % {SIDE})::INT AS r, (l_partkey % {SIDE})::INT AS c,
  floor(sum(round(l_extendedprice * 100)::BIGINT)::DOUBLE / count(*)) / 5000.0::DOUBLE - 760 AS z FROM lineitem GROUP BY 1, 2, 3),
dem AS (SELECT tile, r, c, CASE WHEN (r * 31 + c * 17) % 97 = 0 THEN 'NaN'::DOUBLE ELSE z END AS z FROM means)"""


def filled_dem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tile, r, c, z) with every cell of every tile; absent and void cells are 0."""
    cells = dem(spark, sf_dir)
    grid = F.explode(F.sequence(F.lit(0), F.lit(SIDE - 1)))
    tiles = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("tile")).distinct()  # those of dem(), without its cells
    whole = tiles.select("tile", grid.alias("r")).select("tile", "r", grid.alias("c"))
    joined = whole.join(cells, ["tile", "r", "c"], "left")
    return joined.select("tile", "r", "c", F.when(F.col("z").isNull() | F.isnan("z"), F.lit(0.0)).otherwise(F.col("z")).alias("z"))


FILLED = f"""{DEM}, filled AS (SELECT t.tile, r.r::INT AS r, c.c::INT AS c, coalesce(CASE WHEN NOT isnan(d.z) THEN d.z END, 0) AS z
  FROM (SELECT DISTINCT tile FROM dem) t CROSS JOIN range({SIDE}) r(r) CROSS JOIN range({SIDE}) c(c) LEFT JOIN dem d ON d.tile = t.tile AND d.r = r.r AND d.c = c.c)"""


#: Tiles of a relief's side.
MOSAIC = 8


def relief(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(raster, r, c, z): 64 suppliers' tiles as one raster, in rows of 8; places without a supplier have no cells."""
    k = F.col("tile").cast("long")
    row, column = F.floor(k % MOSAIC**2 / MOSAIC) * SIDE + F.col("r"), k % MOSAIC * SIDE + F.col("c")
    return filled_dem(spark, sf_dir).select(F.floor(k / MOSAIC**2).alias("raster"), row.cast("int").alias("r"), column.cast("int").alias("c"), "z")


RELIEF = f"""{FILLED}, relief AS (SELECT tile // {MOSAIC**2} AS raster, (tile % {MOSAIC**2} // {MOSAIC} * {SIDE} + r)::INT AS r, (tile % {MOSAIC} * {SIDE} + c)::INT AS c, z FROM filled)"""


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(track, idx, lat, lon, ele, t_us): a track for each user, points by time."""
    order = Window.partitionBy("cell").orderBy("t_us", "event_id")
    e = events(spark, sf_dir)
    return e.select(
        F.col("cell").alias("track"), F.row_number().over(order).alias("idx"), (43.5 + F.col("event_id") % 49 / 10.0).alias("lat"),
        (4.9 + F.col("event_id") % 115 / 10.0).alias("lon"), F.col("value").alias("ele"), "t_us",
    )


TRACKS = """tracks AS (SELECT user_id AS track, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS idx,
  43.5::DOUBLE + (event_id % 49) / 10.0::DOUBLE AS lat, 4.9::DOUBLE + (event_id % 115) / 10.0::DOUBLE AS lon, value AS ele, epoch_us(ts) AS t_us FROM events)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, x, y): parts on a plane whose area grows with their number, so that neighbourhoods stay alike."""
    parts = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return parts.select(k.alias("id"), (F.floor(k / 2000) * 503 + k * 37 % 503).cast("double").alias("x"), (k * 91 % 499).cast("double").alias("y"))


POINTS = "points AS (SELECT p_partkey AS id, (floor(p_partkey / 2000) * 503 + p_partkey * 37 % 503)::DOUBLE AS x, (p_partkey * 91 % 499)::DOUBLE AS y FROM part)"


def reaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, down, len, q): a river reach for each supplier; four roots."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    down = F.when(k < 4, F.lit(-1)).otherwise(F.floor(k / 2)).cast("long")
    return s.select(k.alias("id"), down.alias("down"), (1 + k % 9).cast("double").alias("len"), (F.abs("s_acctbal") / 100).alias("q"))


REACHES = "reaches AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey < 4 THEN -1 ELSE s_suppkey // 2 END AS down, (1 + s_suppkey % 9)::DOUBLE AS len, abs(s_acctbal) / 100 AS q FROM supplier)"
