"""Polygons, triangles and lines on rasters: even-odd masks, depth rasters, clipping, resampling, filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cragline.operators import raster as ra


def resampled(cells: DataFrame, side: int, target: int) -> DataFrame:
    """(tile, r, c, z): averages over the valid cells that fall in each cell of a coarser grid."""
    at = [F.floor(F.col(a) * target / side).cast("int").alias(a) for a in ("r", "c")]
    return cells.where(F.col("z").isNotNull() & ~F.isnan("z")).groupBy("tile", *at).agg(F.avg("z").alias("z"))


def nearest_sample(points: DataFrame, cells: DataFrame, side: int) -> DataFrame:
    """points (id, tile, y, x) with the value of the nearest cell, half to even, held at the edges; absent cells give 0."""
    held = {n: F.greatest(F.lit(0), F.least(F.lit(side - 1), F.rint(F.col(a)).cast("int"))) for n, a in (("r", "y"), ("c", "x"))}
    return points.withColumns(held).join(cells, ["tile", "r", "c"], "left").select("id", F.coalesce("z", F.lit(0.0)).alias("z"))


def inside_rings(cells: DataFrame, rings: DataFrame) -> DataFrame:
    """(tile, r, c, inside) by the even-odd rule, for cell centres and closed rings (tile, idx, x, y): an edge counts for the cells
    of the rows that it crosses, to the left of the crossing."""
    w = Window.partitionBy("tile").orderBy("idx")
    first = [F.first(a).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) for a in ("x", "y")]
    edges = rings.select("tile", F.col("x").alias("x1"), F.col("y").alias("y1"), F.coalesce(F.lead("x").over(w), first[0]).alias("x2"), F.coalesce(F.lead("y").over(w), first[1]).alias("y2"))
    edges = edges.where("y1 <> y2").select("tile", "x1", "y1", "x2", "y2", F.least("y1", "y2").alias("low"), F.greatest("y1", "y2").alias("high"))
    rows = F.explode(F.sequence(F.ceil("low").cast("int"), F.greatest(F.ceil(F.col("high")) - 1, F.ceil("low")).cast("int")))
    crossings = edges.withColumn("r", rows).where("low <= r AND r < high")
    crossings = crossings.select("tile", "r", (F.col("x1") + (F.col("r") - F.col("y1")) / (F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1"))).alias("at"))
    per_row = crossings.groupBy("tile", "r").agg(F.collect_list("at").alias("at"))  # an edge of a ring each
    right = F.size(F.filter(F.coalesce("at", F.array().cast("array<double>")), lambda x: x > F.col("c")))
    return cells.join(per_row, ["tile", "r"], "left").select("tile", "r", "c", (right % 2 == 1).alias("inside"))


def _rank(x: Column) -> Column:
    """Whole numbers of 32 bits in the order of FLOAT values: the bits of the size, with its sign. NaN is above all numbers, null above NaN."""
    size = F.abs(x.cast("double"))
    exponent = F.greatest(F.lit(-126.0), F.floor(F.log2(size) + 1e-8))  # no FLOAT lies within 1e-8 below a power of two
    bits = (exponent + 126) * 2**23 + size / F.pow(F.lit(2.0), exponent - 23)
    bits = F.when(size == 0, 0.0).when(size == float("inf"), float(0x7F800000)).otherwise(bits)
    return F.when(x.isNull(), 0x7F800002).when(F.isnan(x), 0x7F800001).otherwise((F.signum(x.cast("double")) * bits).cast("long"))


def depth_raster(triangles: DataFrame, side: int) -> DataFrame:
    """(tile, r, c, depth, tri): the nearest triangle (tile, tri, x1, y1, z1 .. z3) over each cell centre, depths compared as FLOAT,
    ties to the least id, a long; one without depth (null) is behind all others. Each triangle is spread over the cells of its box.

    A depth and half of an id are one long, so that tasks keep the least in a table of cells; for the least struct they would sort all rows.
    """
    lo = lambda a: F.greatest(F.lit(0), F.ceil(F.least(f"{a}1", f"{a}2", f"{a}3")).cast("int"))
    hi = lambda a: F.least(F.lit(side - 1), F.floor(F.greatest(f"{a}1", f"{a}2", f"{a}3")).cast("int"))
    area = (F.col("x2") - F.col("x1")) * (F.col("y3") - F.col("y1")) - (F.col("x3") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    boxed = triangles.withColumn("_area", area).withColumns({"_r0": lo("y"), "_r1": hi("y"), "_c0": lo("x"), "_c1": hi("x")})
    boxed = boxed.where("_area <> 0 AND _r0 <= _r1 AND _c0 <= _c1")
    spread = boxed.withColumn("r", F.explode(F.sequence("_r0", "_r1"))).withColumn("c", F.explode(F.sequence("_c0", "_c1")))

    def edge(i: int, j: int):
        return ((F.col(f"x{j}") - F.col(f"x{i}")) * (F.col("r") - F.col(f"y{i}")) - (F.col(f"y{j}") - F.col(f"y{i}")) * (F.col("c") - F.col(f"x{i}"))) / F.col("_area")

    weighed = spread.withColumns({"w1": edge(2, 3), "w2": edge(3, 1), "w3": edge(1, 2)}).where("w1 >= 0 AND w2 >= 0 AND w3 >= 0")
    depth = (F.col("w1") * F.col("z1") + F.col("w2") * F.col("z2") + F.col("w3") * F.col("z3")).cast("float")
    ranked = weighed.select("tile", "r", "c", F.col("tri").cast("long").alias("tri"), depth.alias("depth")).withColumn("rank", _rank(F.col("depth")))
    low = F.lit(0xFFFFFFFF)
    packed = F.shiftleft("rank", 32).bitwiseOR(F.col("tri").bitwiseAND(low))
    halves = ranked.groupBy("tile", "r", "c", F.shiftright("tri", 32).alias("high")).agg(F.min(packed).alias("least"), F.min("depth").alias("depth"))
    tri = F.shiftleft("high", 32).bitwiseOR(F.col("least").bitwiseAND(low))
    best = halves.groupBy("tile", "r", "c").agg(F.min(F.struct(F.shiftright("least", 32).alias("rank"), tri.alias("tri"), "depth")).alias("b"))
    return best.select("tile", "r", "c", "b.depth", "b.tri")


def clipped(points: DataFrame, low: float, high: float) -> DataFrame:
    """(line, idx, t0, t1) of points (line, idx, a): the share of each segment whose axis value lies in low..high; none where it is
    empty."""
    w = Window.partitionBy("line").orderBy("idx")
    seg = points.select("line", "idx", "a", F.lead("a").over(w).alias("b")).where("b IS NOT NULL")
    d = F.col("b") - F.col("a")
    at = [(v - F.col("a")) / F.nullif(d, F.lit(0.0)) for v in (low, high)]
    flat = F.col("a").between(low, high)
    t0 = F.when(d == 0, F.when(flat, 0.0).otherwise(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(*at)))
    t1 = F.when(d == 0, F.when(flat, 1.0).otherwise(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(*at)))
    return seg.select("line", "idx", t0.alias("t0"), t1.alias("t1")).where("t0 < t1")


def resampled_line(points: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """(line, row, value) at every whole row of points (line, row, value): values of equal rows are averaged, rows in between are
    interpolated. first, last: rows to reach at least, where the values of a line's own ends are held."""
    w = Window.partitionBy("line").orderBy("row")
    knots = points.groupBy("line", "row").agg(F.avg("value").alias("value"))
    pairs = knots.select("line", "row", "value", F.lead("row").over(w).alias("row2"), F.lead("value").over(w).alias("value2"), F.lag("row").over(w).isNull().alias("begins"))
    low = F.col("row") if first is None else F.when(F.col("begins"), F.least(F.col("row"), F.lit(first))).otherwise(F.col("row"))
    high = F.col("row") if last is None else F.greatest(F.col("row"), F.lit(last))
    steps = pairs.withColumn("k", F.explode(F.sequence(low, F.coalesce(F.col("row2") - 1, high))))
    f = F.when(F.col("row2").isNotNull(), F.greatest(F.lit(0.0), (F.col("k") - F.col("row")) / (F.col("row2") - F.col("row")))).otherwise(0.0)
    return steps.select("line", F.col("k").alias("row"), (F.col("value") + F.coalesce(F.col("value2") - F.col("value"), F.lit(0.0)) * f).alias("value"))


def relief_caps(cells: DataFrame, weights: list[float], floor: float) -> DataFrame:
    """(tile, r, c, z): smoothed by symmetric weights (centre first) along rows, then columns, edges repeated; not above the terrain,
    not below floor; then the least of each 3 x 3 square."""
    total = weights[0] + 2 * sum(weights[1:])

    def smoothed(w) -> object:
        value = F.col("z") * weights[0]
        for k, weight in enumerate(weights[1:], 1):
            ends = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
            value = value + weight * (F.coalesce(F.lag("z", k).over(w), F.first("z").over(ends)) + F.coalesce(F.lead("z", k).over(w), F.last("z").over(ends)))
        return value / total

    soft = cells.withColumn("z0", F.col("z")).withColumn("z", smoothed(ra.along_row())).withColumn("z", smoothed(ra.along_column()))
    capped = soft.withColumn("z", F.greatest(F.lit(floor), F.least("z", "z0"))).drop("z0")
    for w in (ra.along_row(), ra.along_column()):
        capped = capped.withColumn("z", F.min("z").over(w.rowsBetween(-1, 1)))
    return capped.select("tile", "r", "c", "z")


def quantised_nodes(points: DataFrame, q: float) -> DataFrame:
    """(graph, kr, kc, r, c, n): points (graph, seq, r, c) merged on a grid of 1 / q, half to even; the first coordinate is kept."""
    keyed = points.withColumns({"kr": F.rint(F.col("r") * q).cast("long"), "kc": F.rint(F.col("c") * q).cast("long")})
    merged = keyed.groupBy("graph", "kr", "kc").agg(F.min_by(F.struct("r", "c"), "seq").alias("p"), F.count(F.lit(1)).alias("n"))
    return merged.select("graph", "kr", "kc", "p.r", "p.c", "n")


def last_drawn(strokes: DataFrame, order: str) -> DataFrame:
    """(tx, ty, value): of strokes (tx, ty, value, order) over a pixel the last by order shows."""
    return strokes.groupBy("tx", "ty").agg(F.max_by("value", order).alias("value"))
