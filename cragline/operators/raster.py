"""Raster operators on cells (tile, r, c, z). Windows and joins run within a tile, so work scales with tiles.

A void is NaN. Whole-tile statistics are aggregates by tile joined back on it.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from cragline.operators import tiles

NAN = float("nan")


def along_row() -> WindowSpec:
    return Window.partitionBy("tile", "r").orderBy("c")


def along_column() -> WindowSpec:
    return Window.partitionBy("tile", "c").orderBy("r")


def clean_voids(cells: DataFrame, sentinel: float = -32000.0) -> DataFrame:
    """Finite values at or below the sentinel become void."""
    return cells.withColumn("z", F.when(~F.isnan("z") & (F.col("z") <= sentinel), NAN).otherwise(F.col("z")))


def clamp_negative(cells: DataFrame) -> DataFrame:
    """Values below 0 become 0; voids stay (greatest() would take NaN as the greatest)."""
    return cells.withColumn("z", F.when(~F.isnan("z") & (F.col("z") < 0), 0.0).otherwise(F.col("z")))


def patch_sizes(r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Of distinct cells, how many lie in each one's 4-connected patch."""
    wide = int(c.max()) + 2
    at = r.astype(np.int64) * wide + c
    order = np.argsort(at)
    at = at[order]
    ends = []
    for step in (1, wide):  # pairs of neighbours, as places in at
        place = np.searchsorted(at, at + step)
        found = np.flatnonzero((place < len(at)) & (at[np.minimum(place, len(at) - 1)] == at + step))
        ends.append((found, place[found]))
    u, v = (np.concatenate(x) for x in zip(*ends, strict=True))
    label = np.arange(len(at))
    while len(u):
        low, high = np.minimum(label[u], label[v]), np.maximum(label[u], label[v])
        np.minimum.at(label, high, low)  # roots hook to the least root they meet
        while (label != label[label]).any():
            label = label[label]
        apart = label[u] != label[v]
        u, v = u[apart], v[apart]
    sizes = np.empty(len(at), np.int64)
    sizes[order] = np.bincount(label, minlength=len(at))[label]
    return sizes


def sea_level(cells: DataFrame, land: Column, floor: float, min_patch: int) -> DataFrame:
    """Cells below 0: on land, patches (4-connected, within a tile) of min_patch cells or more are held to floor; all others become 0.

    Only cells below 0 are dealt by tile, to be labelled; a tile of them is a task's.
    """
    below = cells.where(~F.isnan("z") & (F.col("z") < 0) & land).select("tile", "r", "c")

    def run(tile: pd.DataFrame) -> pd.DataFrame:
        return tile.assign(size=patch_sizes(tile["r"].to_numpy(), tile["c"].to_numpy()))

    sized = below.groupBy("tile").applyInPandas(run, f"tile {cells.schema['tile'].dataType.simpleString()}, r int, c int, size long")
    joined = cells.join(sized, ["tile", "r", "c"], "left")
    kept = F.when(F.col("size") >= min_patch, F.greatest(F.col("z"), F.lit(floor))).otherwise(0.0)
    return joined.withColumn("z", F.when(~F.isnan("z") & (F.col("z") < 0), kept).otherwise(F.col("z"))).drop("size")


def blocks(cells: DataFrame) -> DataFrame:
    """(tile, r, c, low, high, mean, median, n) of 2 x 2 blocks over valid cells; a block without any is absent."""
    halves = [F.floor(F.col(a) / 2).cast("int").alias(a) for a in ("r", "c")]
    return cells.where(F.col("z").isNotNull() & ~F.isnan("z")).groupBy("tile", *halves).agg(
        F.min("z").alias("low"), F.max("z").alias("high"), F.avg("z").alias("mean"), F.percentile("z", F.lit(0.5)).alias("median"), F.count(F.lit(1)).alias("n")
    )


def box_mean(cells: DataFrame, side: int, pad: int, column: str = "z", out: str = "mean") -> DataFrame:
    """Mean over a (2 * pad + 1) square around each cell of dense tiles of so many cells a side, reflected without the edge cell."""
    def mirrored(axis: str) -> Column:
        at = F.col(axis)
        low = F.when((at >= 1) & (at <= pad), -at)
        high = F.when((at < side - 1) & (at >= side - 1 - pad), 2 * (side - 1) - at)
        return F.array_compact(F.array(at, low, high))

    across = cells.select("tile", "r", "c", F.col(column).alias("_v"), F.explode(mirrored("c")).alias("_a"))
    row = Window.partitionBy("tile", "r").orderBy("_a").rowsBetween(-pad, pad)
    across = across.withColumn("_v", F.avg("_v").over(row)).where("_a = c").drop("_a")
    down = across.select("tile", "r", "c", "_v", F.explode(mirrored("r")).alias("_a"))
    column_window = Window.partitionBy("tile", "c").orderBy("_a").rowsBetween(-pad, pad)
    return down.withColumn(out, F.avg("_v").over(column_window)).where("_a = r").select("tile", "r", "c", out)


def half(cells: DataFrame, side: int, pad: int = 12) -> DataFrame:
    """(tile, r, c, z): tiles.half() where each tile of so many cells a side is a raster of its own."""
    return tiles.half(cells.withColumnRenamed("tile", "raster"), side, pad, (side, side)).withColumnRenamed("raster", "tile")


def halvings(side: int, width_mm: float, height_mm: float, nozzle_mm: float) -> int:
    """How often a raster of that side can be halved while its pixels stay within half a nozzle."""
    if nozzle_mm <= 0:
        raise ValueError("a nozzle has a diameter above 0")
    n = 0
    while side >= 2 and max(width_mm, height_mm) / ((side + 1) // 2) <= nozzle_mm / 2:
        side, n = (side + 1) // 2, n + 1
    return n


def nozzle_pyramid(cells: DataFrame, side: int, width_mm: float, height_mm: float, nozzle_mm: float, pad: int = 12) -> DataFrame:
    """cells halved as often as halvings() says; sides are even down to the last step."""
    for _ in range(halvings(side, width_mm, height_mm, nozzle_mm)):
        cells, side = half(cells, side, min(pad, side - 1)), side // 2
    return cells


def max_pyramid(cells: DataFrame, levels: int) -> DataFrame:
    """(level, tile, r, c, z): greatest values of 2 x 2 blocks, level by level from 1."""
    out, level = None, cells.where(F.col("z").isNotNull() & ~F.isnan("z"))
    for i in range(1, levels + 1):
        level = level.groupBy("tile", F.floor(F.col("r") / 2).cast("int").alias("r"), F.floor(F.col("c") / 2).cast("int").alias("c")).agg(F.max("z").alias("z"))
        named = level.select(F.lit(i).alias("level"), "tile", "r", "c", "z")
        out = named if out is None else out.unionByName(named)
    return out


def normals(cells: DataFrame, dx: float, dy: float) -> DataFrame:
    """cells with the unit normal (nx, ny, nz), by central differences, one-sided at edges; r grows to the south."""
    row, column = along_row(), along_column()
    left, right = (F.coalesce(f("z").over(row), F.col("z")) for f in (F.lag, F.lead))
    up, down = (F.coalesce(f("z").over(column), F.col("z")) for f in (F.lag, F.lead))
    across = F.coalesce(F.lead("c").over(row), F.col("c")) - F.coalesce(F.lag("c").over(row), F.col("c"))
    along = F.coalesce(F.lead("r").over(column), F.col("r")) - F.coalesce(F.lag("r").over(column), F.col("r"))
    raw = cells.withColumns({"_x": -(right - left) / (across * dx), "_y": (down - up) / (along * dy)})
    s = 1 / F.sqrt(F.col("_x") * F.col("_x") + F.col("_y") * F.col("_y") + 1)
    return raw.withColumns({"nx": F.col("_x") * s, "ny": F.col("_y") * s, "nz": s}).drop("_x", "_y")


def bilinear(points: DataFrame, cells: DataFrame, side: int) -> DataFrame:
    """points (id, tile, y, x) with z, interpolated between four cells and held at the edges: four weights, one join, one sum."""
    y, x = (F.greatest(F.lit(0.0), F.least(F.lit(side - 1.0), F.col(a))) for a in ("y", "x"))
    r, c = F.floor(y).cast("int"), F.floor(x).cast("int")
    corners = [
        F.struct(F.least(r + i, F.lit(side - 1)).alias("r"), F.least(c + j, F.lit(side - 1)).alias("c"), ((1 - (y - r)) if i == 0 else (y - r)).alias("wy"), ((1 - (x - c)) if j == 0 else (x - c)).alias("wx"))
        for i in (0, 1) for j in (0, 1)
    ]
    spread = points.select("id", "tile", F.explode(F.array(*corners)).alias("k")).select("id", "tile", "k.*")
    joined = spread.join(cells, ["tile", "r", "c"])
    return joined.groupBy("id").agg(F.sum(F.col("wy") * F.col("wx") * F.col("z")).alias("z"))


def height_curve(cells: DataFrame, low: Column, high: Column, bottom: float, height: float, exponent: float) -> DataFrame:
    """cells with mm: the signed power of the height within low..high, held to -1..1; voids are at the bottom."""
    t = F.when(F.isnan("z"), 0.0).otherwise((F.col("z") - low) / F.greatest(high - low, F.lit(1e-12)))
    t = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), t))
    return cells.withColumn("mm", bottom + F.signum(t) * F.pow(F.abs(t), F.lit(exponent)) * height)


def contour_levels(ranges: DataFrame, threshold: float, fine: float, coarse: float) -> DataFrame:
    """(tile, level) of ranges (tile, low, high): multiples of fine up to the threshold and of coarse above it, from the last at or below low
    to the first at or above high. Multiples are counted in whole numbers, so each level comes once."""
    def multiples(step: float, first: Column, last: Column) -> Column:
        some = F.transform(F.sequence(first.cast("long"), last.cast("long")), lambda k: k * F.lit(step))
        return F.when(first <= last, some).otherwise(F.array().cast("array<double>"))

    low, high = F.col("low"), F.col("high")
    most = lambda step: math.floor(threshold / step + 1e-9)
    below = multiples(fine, F.floor(low / fine), F.least(F.ceil(high / fine), F.lit(most(fine))))
    above = multiples(coarse, F.greatest(F.floor(low / coarse), F.lit(most(coarse) + 1)), F.when(high > threshold, F.ceil(high / coarse)).otherwise(F.lit(most(coarse))))
    return ranges.select("tile", F.explode(F.concat(below, above)).alias("level"))


def contour_crossings(cells: DataFrame, interval: float) -> DataFrame:
    """(tile, level, r, c, kind): where a level lies between a cell and its right ('h') or lower ('v') neighbour, interpolated."""
    out = None
    for kind, w, axis in (("h", along_row(), "c"), ("v", along_column(), "r")):
        pair = cells.withColumn("z2", F.lead("z").over(w)).where(F.col("z2").isNotNull() & ~F.isnan("z") & ~F.isnan("z2") & (F.col("z") != F.col("z2")))
        low, high = F.least("z", "z2"), F.greatest("z", "z2")
        k = F.explode(F.sequence((F.floor(low / interval) + 1).cast("long"), F.greatest(F.floor(high / interval), F.floor(low / interval) + 1).cast("long")))
        at = pair.select("tile", "r", "c", "z", "z2", low.alias("low"), high.alias("high"), k.alias("k")).withColumn("level", F.col("k") * interval)
        at = at.where((F.col("level") > F.col("low")) & (F.col("level") <= F.col("high")))
        f = (F.col("level") - F.col("z")) / (F.col("z2") - F.col("z"))
        moved = {a: (F.col(a) + f if a == axis else F.col(a).cast("double")) for a in ("r", "c")}
        found = at.select("tile", "level", moved["r"].alias("r"), moved["c"].alias("c"), F.lit(kind).alias("kind"))
        out = found if out is None else out.unionByName(found)
    return out


def horizon_cardinal(cells: DataFrame, rise: float, axis: str = "c", towards: int = 1) -> DataFrame:
    """cells with horizon: the shadow height from a sun along +axis (towards 1) or -axis (-1), falling by rise a cell."""
    order = F.col(axis).desc() if towards > 0 else F.col(axis).asc()
    other = "r" if axis == "c" else "c"
    w = Window.partitionBy("tile", other).orderBy(order)
    k = F.row_number().over(w)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = cells.withColumn("_k", k).withColumn("_lifted", F.col("z") + rise * F.col("_k"))
    return placed.withColumn("horizon", F.max("_lifted").over(upto) - rise * F.col("_k")).drop("_k", "_lifted")


def horizon_sheared(cells: DataFrame, side: int, offset: float, rise: float) -> DataFrame:
    """(tile, q, k, horizon): along lines that shift by offset rows a column (from the last column on), the greatest height
    before step k, less rise a step; null at the first. Heights are interpolated between two rows."""
    steps = F.explode(F.sequence(F.lit(0), F.lit(side - 1)))
    shift = math.floor(-abs(offset) * side) if offset < 0 else 0
    lines = F.explode(F.sequence(F.lit(shift), F.lit(side - 1 + (math.ceil(abs(offset) * side) if offset > 0 else 0))))
    grid = cells.select("tile").distinct().select("tile", lines.alias("q")).select("tile", "q", steps.alias("k"))
    a = F.col("q") - offset * F.col("k")
    grid = grid.withColumn("a", a).withColumn("c", side - 1 - F.col("k"))
    inside = (F.col("a") >= 0) & (F.col("a") <= side - 1)
    grid = grid.withColumn("lo", F.when(inside, F.floor("a").cast("int"))).withColumn("hi", F.least(F.col("lo") + 1, F.lit(side - 1)))
    low = cells.select("tile", F.col("r").alias("lo"), "c", F.col("z").alias("z_lo"))
    high = cells.select("tile", F.col("r").alias("hi"), "c", F.col("z").alias("z_hi"))
    z = grid.join(low, ["tile", "lo", "c"], "left").join(high, ["tile", "hi", "c"], "left")
    f = F.col("a") - F.floor("a")
    z = z.withColumn("lifted", F.col("z_lo") * (1 - f) + F.col("z_hi") * f + rise * F.col("k"))
    before = Window.partitionBy("tile", "q").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    return z.select("tile", "q", "k", (F.max("lifted").over(before) - rise * F.col("k")).alias("horizon"))


def shaded(cells: DataFrame, sun: tuple[float, float, float], ambient: float, bias: float) -> DataFrame:
    """cells (nx, ny, nz, z, horizon) with light 0..255, rounded half away from zero; night is 0."""
    dot = F.greatest(F.lit(0.0), F.col("nx") * sun[0] + F.col("ny") * sun[1] + F.col("nz") * sun[2])
    lit = F.when(F.col("horizon") > F.col("z") + bias, 0.0).otherwise(dot)
    value = F.round(255 * F.least(F.lit(1.0), ambient + (1 - ambient) * lit)).cast("int")
    return cells.withColumn("light", value if sun[2] > 0 else F.lit(0))


def exposed(light: Column, gain: float, floor: float, gamma: float) -> Column:
    """0..255 after gain, gamma and shadow floor, half to even."""
    v = F.greatest(F.lit(0.0), F.least(F.lit(1.0), light / 255.0 * gain))
    return F.rint((floor + (1 - floor) * F.pow(v, F.lit(gamma))) * 255).cast("int")


def contour_alpha(z: Column, gradient: Column, interval: float, width: float) -> Column:
    """Coverage 0..1 of the nearest contour line; none within 5 cm of sea level."""
    d = F.abs(F.pmod(z + interval / 2, F.lit(interval)) - interval / 2)
    cover = F.greatest(F.lit(0.0), F.least(F.lit(1.0), width / 2 + 0.5 - d / F.greatest(gradient, F.lit(0.1))))
    return F.when(F.abs(z) > 0.05, cover).otherwise(0.0)


def blended(base: Column, ink: float, alpha: Column) -> Column:
    return base * (1 - alpha) + ink * alpha
