"""Print tilings, clearance tables, runs, offsets and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tile_starts(sizes: DataFrame) -> DataFrame:
    """(id, i, start): the least number of beds that span total with the overlap, centred; rows (id, total, bed, overlap)."""
    step = F.col("bed") - F.col("overlap")
    n = F.greatest(F.lit(1), F.ceil(F.greatest(F.col("total") - F.col("overlap"), F.lit(0.0)) / step)).cast("int")
    first = -0.5 * F.greatest(F.lit(0.0), F.col("bed") + (n - 1) * step - F.col("total"))
    planned = sizes.where("overlap < bed").select("id", step.alias("step"), first.alias("first"), F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
    return planned.select("id", "i", (F.col("first") + F.col("i") * F.col("step")).alias("start"))


def corridors(starts: DataFrame, sizes: DataFrame, mm_per_px: float) -> DataFrame:
    """(id, i, c0, c1): the overlap of tile i with the one before, in pixels, half to even; empty ones are left out."""
    joined = starts.where("i > 0").join(sizes, "id")
    c0 = F.rint(F.col("start") / mm_per_px).cast("long")
    c1 = F.least(F.rint(F.col("total") / mm_per_px).cast("long"), c0 + F.rint(F.col("overlap") / mm_per_px).cast("long"))
    return joined.select("id", "i", c0.alias("c0"), c1.alias("c1")).where("c1 > c0")


def clip_interval(start: Column, size: Column, total: Column) -> tuple[Column, Column]:
    return F.greatest(F.lit(0.0), start), F.least(total, start + size)


def crop_bounds(starts: DataFrame, sizes: DataFrame, mm_per_px: float, pad_mm: float) -> DataFrame:
    """(id, i, p0, p1): pixels of a tile's clipped interval, padded, floor and ceiling, within the raster."""
    joined = starts.join(sizes, "id")
    low, high = clip_interval(F.col("start") - pad_mm, F.col("bed") + 2 * pad_mm, F.col("total"))
    return joined.select("id", "i", F.floor(low / mm_per_px).alias("p0"), F.ceil(high / mm_per_px).alias("p1"))


def clearance_rows(grids: DataFrame) -> DataFrame:
    """(id, line, text) of grids (id, nx, ny, side, border): a 3 x 3 block a tile; fields are eight wide, three decimals."""
    cells = grids.select("*", F.explode(F.sequence(F.lit(0), F.col("ny") - 1)).alias("ty"))
    field = lambda v: F.format_string("%8.3f", v)
    blank = F.lit(" " * 8)

    def edge(at_border: Column) -> Column:
        return field(F.when(at_border, F.col("border")).otherwise(F.col("side")))

    def row(body) -> Column:
        return F.array_join(F.transform(F.sequence(F.lit(0), F.col("nx") - 1), body), ",")

    top = row(lambda tx: F.concat_ws(",", blank, edge(F.col("ty") == 0), blank))
    bottom = row(lambda tx: F.concat_ws(",", blank, edge(F.col("ty") == F.col("ny") - 1), blank))
    middle = row(lambda tx: F.concat_ws(",", edge(tx == 0), F.lpad(F.format_string("%02d_%02d", F.col("ty"), tx), 8, " "), edge(tx == F.col("nx") - 1)))
    return cells.select("id", F.col("ty"), F.posexplode(F.array(top, middle, bottom)).alias("k", "text")).select("id", (F.col("ty") * 3 + F.col("k")).cast("long").alias("line"), "text")


def parse_clearance(lines: DataFrame) -> DataFrame:
    """(id, tx, ty, edge, mm) of rows (id, line, text) without blank and comment lines: ';' separates where it occurs, else ','; a
    comma left in a field is a decimal mark. A missing or negative value, or another tile's name, raises an error."""
    fields = F.split(F.col("text"), F.when(F.contains("text", F.lit(";")), F.lit(";")).otherwise(F.lit(",")))
    kept = lines.where((F.trim("text") != "") & ~F.trim("text").startswith("#"))
    cells = kept.select("id", "line", F.posexplode(fields).alias("col", "field")).select(
        "id", F.floor(F.col("line") / 3).cast("int").alias("ty"), F.floor(F.col("col") / 3).cast("int").alias("tx"), (F.col("line") % 3 * 3 + F.col("col") % 3).cast("int").alias("k"), F.trim("field").alias("field")
    )
    edges = ((1, "top"), (3, "left"), (5, "right"), (7, "bottom"))
    fields = [F.max(F.when(F.col("k") == k, F.col("field"))).alias(e) for k, e in ((4, "label"), *edges)]
    tiles = cells.groupBy("id", "tx", "ty").agg(*fields)
    name = F.format_string("%02d_%02d", F.col("ty"), F.col("tx"))
    right_name = F.coalesce((F.col("label") == "") | (F.col("label") == name), F.lit(True))

    def checked(edge: str) -> Column:
        value = F.regexp_replace(edge, ",", ".").try_cast("double")
        return F.when(~right_name, F.raise_error(F.concat(F.lit("another tile's name stands at "), name)).cast("double")).when(value >= 0, value).otherwise(
            F.raise_error(F.concat(F.lit(f"missing, negative or no number for {edge} of "), name)).cast("double")
        )

    each = F.explode(F.array(*[F.struct(F.lit(e).alias("edge"), checked(e).alias("mm")) for _, e in edges])).alias("x")
    return tiles.select("id", "tx", "ty", each).select("id", "tx", "ty", "x.edge", "x.mm")


def inside_runs(samples: DataFrame) -> DataFrame:
    """(line, run, first, last) of samples (line, idx, inside): maximal runs of inside."""
    w = Window.partitionBy("line").orderBy("idx")
    islands = samples.where("inside").withColumn("island", F.col("idx") - F.row_number().over(w))
    runs = islands.groupBy("line", "island").agg(F.min("idx").alias("first"), F.max("idx").alias("last"))
    return runs.select("line", F.row_number().over(Window.partitionBy("line").orderBy("first")).alias("run"), "first", "last")


def offset_polyline(points: DataFrame, distance: float) -> DataFrame:
    """(line, idx, x, y) moved to the right of travel by distance along vertex normals (sums of both sides', made unit)."""
    w = Window.partitionBy("line").orderBy("idx")
    seg = points.withColumns({"_dx": F.lead("x").over(w) - F.col("x"), "_dy": F.lead("y").over(w) - F.col("y")})
    length = F.sqrt(F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy"))
    length = F.when(length == 0, 1.0).otherwise(length)
    seg = seg.withColumns({"_nx": F.col("_dy") / length, "_ny": -F.col("_dx") / length})
    both = {a: F.coalesce(F.col(n), F.lit(0.0)) + F.coalesce(F.lag(n).over(w), F.lit(0.0)) for a, n in (("_sx", "_nx"), ("_sy", "_ny"))}
    seg = seg.withColumns(both)
    norm = F.sqrt(F.col("_sx") * F.col("_sx") + F.col("_sy") * F.col("_sy"))
    norm = F.when(norm == 0, 1.0).otherwise(norm)
    return seg.select("line", "idx", (F.col("x") + F.col("_sx") / norm * distance).alias("x"), (F.col("y") + F.col("_sy") / norm * distance).alias("y"))


def evicted(files: DataFrame, limit: Column) -> DataFrame:
    """(store, file) to remove, oldest first and never pinned ones, until the total (pinned ones included) is within limit.
    files: (store, file, mtime, bytes, pinned)."""
    total = F.sum("bytes").over(Window.partitionBy("store"))
    before = Window.partitionBy("store", "pinned").orderBy("mtime", "file").rowsBetween(Window.unboundedPreceding, -1)
    left = files.withColumn("_total", total).withColumn("_gone", F.coalesce(F.sum("bytes").over(before), F.lit(0)))
    return left.where(~F.col("pinned") & (F.col("_total") - F.col("_gone") > limit)).select("store", "file")


def content_key(*columns: str) -> Column:
    """SHA-256 over columns, each with its length before it, so that no two lists of values read alike."""
    parts = [F.concat(F.length(F.coalesce(F.col(c).cast("string"), F.lit(""))).cast("string"), F.lit(":"), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns]
    return F.sha2(F.concat(*parts).cast("binary"), 256)
