"""Tracks: speed, smoothing, distance, colour runs, segments. Points are (track, idx, lat, lon, ele, t_us); windows run by track."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from cragline.functions import mercator as m

#: Units of speed by name, from metres a second.
UNITS = {"m/s": 1.0, "km/h": 3.6, "kt": 1.943844}


def by_track(*order: str) -> WindowSpec:
    return Window.partitionBy("track").orderBy(*(order or ("idx",)))


def speeds(points: DataFrame, unit: str = "km/h") -> DataFrame:
    """points with speed to the next point (Mercator metres a second, in unit; 'min/km' is a pace); the last point repeats the
    one before. A missing or not increasing time gives 0."""
    x, y = m.to_mercator(F.col("lon"), F.col("lat"))
    w = by_track()
    at = points.withColumns({"_x": x, "_y": y})
    at = at.withColumns({"_dx": F.lead("_x").over(w) - F.col("_x"), "_dy": F.lead("_y").over(w) - F.col("_y"), "_s": (F.lead("t_us").over(w) - F.col("t_us")) / 1e6})
    metres = F.sqrt(F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy"))
    per_second = F.when(F.col("_dx").isNotNull(), F.when(F.col("_s") > 0, metres / F.col("_s")).otherwise(0.0))
    value = F.when(per_second > 0, 1000.0 / per_second / 60.0).otherwise(per_second) if unit == "min/km" else per_second * UNITS[unit]
    at = at.withColumn("_v", value)
    return at.withColumn("speed", F.coalesce("_v", F.lag("_v").over(w), F.lit(0.0))).drop("_x", "_y", "_dx", "_dy", "_s", "_v")


def smoothed(points: DataFrame, column: str, width: int, out: str) -> DataFrame:
    """points with the moving average of a column: width is bounded by a tenth of the track, odd from 3 on; ends count as zero."""
    n = F.count(F.lit(1)).over(Window.partitionBy("track"))
    w = F.least(F.lit(width), F.floor(n / 10).cast("int") + 1)
    sized = points.withColumn("_w", F.when((w >= 3) & (w % 2 == 0), w + 1).otherwise(w))
    upto = by_track().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sized = sized.withColumn("_sum", F.sum(column).over(upto)).withColumn("_n", n)
    # the sum of a frame whose width is a column is a difference of two running sums
    sums = F.collect_list("_sum").over(by_track().rowsBetween(-(width // 2 + 2), width // 2 + 2))
    first = F.greatest(F.col("idx") - (width // 2 + 2), F.lit(1))
    half_up, half_down = F.floor((F.col("_w") - 1) / 2).cast("int"), F.ceil((F.col("_w") - 1) / 2).cast("int")
    sized = sized.withColumn("_sums", sums).withColumn("_first", first)
    end = F.least(F.col("idx") + half_up, F.col("_n").cast("int"))
    begin = F.col("idx") - half_down - 1
    high = F.get("_sums", (end - F.col("_first")).cast("int"))
    low = F.when(begin >= 1, F.get("_sums", (begin - F.col("_first")).cast("int"))).otherwise(0.0)
    return sized.withColumn(out, (high - low) / F.col("_w")).drop("_w", "_sum", "_n", "_sums", "_first")


def distances(points: DataFrame) -> DataFrame:
    """points with metres along the track and phase, its share of the whole (0 where the whole is 0)."""
    w = by_track()
    step = m.haversine(F.lag("lon").over(w), F.lag("lat").over(w), F.col("lon"), F.col("lat"))
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    along = points.withColumn("_step", F.coalesce(step, F.lit(0.0))).withColumn("metres", F.sum("_step").over(upto)).drop("_step")
    total = F.max("metres").over(Window.partitionBy("track"))
    return along.withColumn("phase", F.when(total > 0, F.col("metres") / total).otherwise(0.0))


def palette_index(value: Column, low: Column, high: Column) -> Column:
    """0..255 of a value between bounds, half to even; equal bounds count as one apart."""
    upper = F.when(high == low, low + 1.0).otherwise(high)
    return F.rint(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / (upper - low))) * 255).cast("int")


def colour_runs(points: DataFrame, column: str) -> DataFrame:
    """(track, run, colour, first, last): maximal runs of segments whose mean value has one palette index."""
    w = by_track()
    bounds = points.groupBy("track").agg(F.min(column).alias("low"), F.max(column).alias("high"))
    segments = points.select("track", "idx", ((F.col(column) + F.lead(column).over(w)) / 2).alias("mean")).where("mean IS NOT NULL")
    coloured = segments.join(bounds, "track").select("track", "idx", palette_index(F.col("mean"), F.col("low"), F.col("high")).alias("colour"))
    begins = (F.coalesce(F.lag("colour").over(w), F.lit(-1)) != F.col("colour")).cast("int")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = coloured.withColumn("begins", begins).withColumn("run", F.sum("begins").over(upto))
    return runs.groupBy("track", "run", "colour").agg(F.min("idx").alias("first"), F.max("idx").alias("last"))


def split_segments(points: DataFrame, valid: Column) -> DataFrame:
    """(track, seg, n, first, last): an invalid point ends the segment; segments of one point are left out."""
    upto = by_track().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = points.withColumn("_ok", valid).withColumn("seg", F.sum((~F.col("_ok")).cast("int")).over(upto))
    kept = marked.where("_ok").groupBy("track", "seg").agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("first"), F.max("idx").alias("last"))
    return kept.where("n > 1")


def densified(points: DataFrame, max_step: float, most: int = 4096) -> DataFrame:
    """(track, idx, k, lat, lon): points with steps in between so that none is longer than max_step metres (at most most a segment)."""
    w = by_track()
    ends = points.select("track", "idx", "lat", "lon", F.lead("lat").over(w).alias("lat2"), F.lead("lon").over(w).alias("lon2"))
    n = F.least(F.greatest(F.ceil(m.haversine(F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2")) / max_step), F.lit(1)), F.lit(most)).cast("int")
    steps = ends.withColumn("_n", F.coalesce(n, F.lit(1))).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    f = F.col("k") / F.col("_n")
    return steps.select(
        "track", "idx", "k", (F.col("lat") + F.coalesce(F.col("lat2") - F.col("lat"), F.lit(0.0)) * f).alias("lat"),
        (F.col("lon") + F.coalesce(F.col("lon2") - F.col("lon"), F.lit(0.0)) * f).alias("lon"),
    )


def last_by_name(places: DataFrame, order: str) -> DataFrame:
    """One row a name: the last by order wins."""
    columns = [c for c in places.columns if c not in ("name", order)]
    picked = places.groupBy("name").agg(F.max_by(F.struct(*columns), order).alias("x"))
    return picked.select("name", *[F.col(f"x.{c}").alias(c) for c in columns])


def scale_bar(metres_per_pt: Column, most_pt: Column) -> Column:
    """The longest of 1, 2.5, 5 times a power of ten (10 m to 5e9 m) whose bar fits; null if none does."""
    lengths = F.array(*[F.lit(int(b * 10**e)).cast("long") for e in range(1, 10) for b in (1, 2.5, 5)])
    return F.array_max(F.filter(lengths, lambda s: s / metres_per_pt <= most_pt))
