"""Rasters larger than a task: cells (raster, r, c, z) are cut into tiles, with a halo of their neighbours' cells where a result needs it,
and what tiles find is cut back to the cells that they own. Results don't depend on the tiling, to the last bit: a cell's sums run in the
same order in every tile that holds its surroundings.

Rows and columns count from 0; a void is NaN or an absent cell.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts of a value's range in which percentiles() looks for its ranks first.
HISTOGRAM = 1024


def extents(cells: DataFrame, size: tuple[int, int] | None = None) -> DataFrame:
    """(raster, height, width): of all rasters as given, or each as far as its cells reach."""
    if size is not None:
        return cells.select("raster").distinct().select("raster", F.lit(size[0]).alias("height"), F.lit(size[1]).alias("width"))
    return cells.groupBy("raster").agg((F.max("r") + 1).cast("int").alias("height"), (F.max("c") + 1).cast("int").alias("width"))


def haloed(cells: DataFrame, side: int, before: int, after: int, spans: bool = False) -> DataFrame:
    """cells with the tile (ti, tj) of side cells that each goes to: its own, and those within before cells below or to the right of it and
    after cells above or to the left. Tiles that own no cell of the raster may appear, they have nothing to tell; where cells have the
    raster's height and width (spans), there are none beyond these."""

    def tiles(axis: str) -> Column:
        first, last = F.floor((F.col(axis) - after) / side), F.floor((F.col(axis) + before) / side)
        if spans:
            last = F.least(last, F.floor((F.col("height" if axis == "r" else "width") - 1) / side))
        return F.sequence(F.greatest(first, F.lit(0)).cast("int"), last.cast("int"))

    if not before and not after:
        return cells.select("*", F.floor(F.col("r") / side).cast("int").alias("ti"), F.floor(F.col("c") / side).cast("int").alias("tj"))
    return cells.withColumn("ti", F.explode(tiles("r"))).withColumn("tj", F.explode(tiles("c")))


def window_of(rows: pd.DataFrame, side: int, before: int, after: int, height: int | None = None, width: int | None = None) -> tuple[np.ndarray, int, int]:
    """A tile's cells and halo as an array, NaN where there is none, and the row and column at which the array begins. With a height and
    width the array ends where the raster does."""
    r0, c0 = max(0, int(rows["ti"].iloc[0]) * side - before), max(0, int(rows["tj"].iloc[0]) * side - before)
    r1, c1 = (int(rows[t].iloc[0]) * side + side + after for t in ("ti", "tj"))
    z = np.full((min(r1, height or r1) - r0, min(c1, width or c1) - c0), np.nan)
    z[rows["r"].to_numpy() - r0, rows["c"].to_numpy() - c0] = rows["z"].to_numpy()
    return z, r0, c0


def percentiles(values: DataFrame, share: float, by: str = "raster") -> DataFrame:
    """(by, q) of values (by, v): the exact percentile, interpolated between two ranks.

    A histogram of each group's range says which of its parts hold the two ranks; only these parts' distinct values are put in order, so
    no task sorts or holds a whole group.
    """
    spans = values.groupBy(by).agg(F.min("v").alias("least"), F.max("v").alias("most"), F.count(F.lit(1)).alias("n"))
    rank = share * (F.col("n") - 1)
    spans = spans.select(by, "least", ((F.col("most") - F.col("least")) / HISTOGRAM).alias("step"), F.floor(rank).alias("low"), F.ceil(rank).alias("high"), (rank - F.floor(rank)).alias("part"))
    part = F.when(F.col("step") > 0, F.floor((F.col("v") - F.col("least")) / F.col("step"))).otherwise(0)
    counted = values.groupBy(by, "v").agg(F.count(F.lit(1)).alias("n")).join(spans, by).withColumn("place", part.cast("int"))
    upto = Window.partitionBy(by).orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    heights = counted.groupBy(by, "place", "low", "high").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(upto))
    begin = F.col("upto") - F.col("n")
    holding = heights.where(((begin <= F.col("low")) & (F.col("low") < F.col("upto"))) | ((begin <= F.col("high")) & (F.col("high") < F.col("upto"))))
    inside = counted.join(holding.select(by, "place", begin.alias("begin")), [by, "place"])
    order = Window.partitionBy(by, "place").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = inside.withColumn("end", F.col("begin") + F.sum("n").over(order))
    at = lambda k: F.min(F.when(F.col("end") > F.col(k), F.col("v")))
    found = ranked.groupBy(by).agg(at("low").alias("a"), at("high").alias("b"), F.first("part").alias("part"))
    return found.select(by, (F.col("a") + (F.col("b") - F.col("a")) * F.col("part")).alias("q"))


def mirrored(i: np.ndarray, n: int) -> np.ndarray:
    """Places beyond either end of n, reflected without the end itself."""
    return np.where(i < 0, -i, np.where(i >= n, 2 * (n - 1) - i, i))


def square_sums(values: np.ndarray, rows: np.ndarray, cols: np.ndarray, pad: int, origin: tuple[int, int], size: tuple[int, int]) -> np.ndarray:
    """Of an array that begins at origin in a raster of some size: sums over (2 * pad + 1) squares around the given rows and columns,
    mirrored at the raster's ends, one neighbour after the other."""
    near = range(-pad, pad + 1)
    across = sum(values[:, mirrored(cols + d, size[1]) - origin[1]] for d in near)
    return sum(across[mirrored(rows + d, size[0]) - origin[0]] for d in near)


def fours(values: np.ndarray) -> np.ndarray:
    """values from an even row and column on as four arrays, a cell of each block of 2 x 2 in each; NaN beyond the ends."""
    even = np.full([n + n % 2 for n in values.shape], np.nan)
    even[: values.shape[0], : values.shape[1]] = values
    return np.stack([even[i::2, j::2] for i in (0, 1) for j in (0, 1)])


def _reliefs(cells: DataFrame, side: int, pad: int, size: tuple[int, int] | None) -> DataFrame:
    """(raster, r, c, lift, low, middle, high) of blocks of four cells that have a valid one: lift is by how much their surroundings' mean
    lies above them."""
    from cragline.session import written

    cells = written(cells.select("raster", F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), "z"), "raster-cells")
    known = cells.where(F.col("z").isNotNull() & ~F.isnan("z"))
    spans = extents(cells, size)
    voids = known.groupBy("raster").agg(F.count(F.lit(1)).alias("n")).join(spans, "raster").where(F.col("n") < F.col("height").cast("long") * F.col("width")).select("raster")
    medians = percentiles(known.join(voids, "raster", "left_semi").select("raster", F.col("z").alias("v")), 0.5)
    around = spans.join(medians, "raster", "left")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        height, width, median = int(rows["height"].iloc[0]), int(rows["width"].iloc[0]), rows["q"].iloc[0]
        if pad >= min(height, width):
            raise ValueError(f"a raster of {height} x {width} is too small for a square of {pad} cells around each")
        z, r0, c0 = window_of(rows, side, 2 * pad, 2 * pad, height, width)
        begins = [int(rows[t].iloc[0]) * side for t in ("ti", "tj")]
        own = [np.arange(b, min(b + side, n)) for b, n in zip(begins, (height, width), strict=True)]
        if not all(map(len, own)):
            return pd.DataFrame(columns=["raster", "r", "c", "lift", "low", "middle", "high"])
        wide = [np.arange(max(0, o[0] - pad), min(n, o[-1] + 1 + pad)) for o, n in zip(own, (height, width), strict=True)]
        valid = ~np.isnan(z)
        part = np.ix_(wide[0] - r0, wide[1] - c0)
        filled = z[part]
        if not valid[part].all():
            count = square_sums(valid.astype(float), *wide, pad, (r0, c0), (height, width))
            total = square_sums(np.where(valid, z, 0.0), *wide, pad, (r0, c0), (height, width))
            filled = np.where(valid[part], filled, np.where(count > 0, total / np.maximum(count, 1), median))
        inner = np.ix_(own[0] - wide[0][0], own[1] - wide[1][0])
        lift = square_sums(filled, *own, pad, (wide[0][0], wide[1][0]), (height, width)) / (2 * pad + 1) ** 2 - filled[inner]
        lifts, heights = (fours(a) for a in (lift, z[np.ix_(own[0] - r0, own[1] - c0)]))
        n = (~np.isnan(heights)).sum(axis=0)
        order = np.sort(heights, axis=0)  # NaN last
        at = lambda k: np.take_along_axis(order, k[None], 0)[0]
        middle = (at(np.maximum(n - 1, 0) // 2) + at(n // 2 % 4)) / 2
        inside = (~np.isnan(lifts)).sum(axis=0)
        found = {"lift": np.nansum(lifts, axis=0) / np.maximum(inside, 1), "low": order[0], "middle": middle, "high": at(np.maximum(n - 1, 0))}
        r, c = (np.arange(b // 2, b // 2 + k) for b, k in zip(begins, middle.shape, strict=True))
        kept = n > 0
        where = {"raster": rows["raster"].iloc[0], "r": np.broadcast_to(r[:, None], kept.shape)[kept], "c": np.broadcast_to(c, kept.shape)[kept]}
        return pd.DataFrame(where | {name: v[kept] for name, v in found.items()})

    kind = cells.schema["raster"].dataType.simpleString()
    cut = haloed(known.join(around, "raster"), side, 2 * pad, 2 * pad, spans=True)

    def tile(table: pa.Table) -> pa.Table:
        fields = [table.schema.field("raster"), *[pa.field(n, pa.int32()) for n in ("r", "c")], *[pa.field(n, pa.float64()) for n in ("lift", "low", "middle", "high")]]
        return pa.Table.from_pandas(run(table.to_pandas()), pa.schema(fields), preserve_index=False)

    # Arrow: as pandas, a group's many short columns would take longer than its sums
    return cut.groupBy("raster", "ti", "tj").applyInArrow(tile, f"raster {kind}, r int, c int, lift double, low double, middle double, high double")


def half(cells: DataFrame, side: int, pad: int = 12, size: tuple[int, int] | None = None) -> DataFrame:
    """(raster, r, c, z): rasters halved, edges kept. Of four cells the least is taken where their surroundings lie above them by more than a
    limit, the greatest where they lie below by more, else the median; the limit is the raster's 25th percentile of such differences.
    Surroundings are (2 * pad + 1) squares; voids count as the mean of the valid cells in theirs, or as the raster's median; blocks
    without a valid cell are absent. side is even.

    Tiles find the differences, with a halo of 2 * pad; the limit is one of the whole raster; the choice is made last.
    """
    from cragline.session import written

    blocks = written(_reliefs(cells, side, pad, size), "reliefs")
    limits = percentiles(blocks.select("raster", F.abs("lift").alias("v")), 0.25).withColumnRenamed("q", "limit")
    z = F.when(F.abs("lift") <= F.col("limit"), F.col("middle")).when(F.col("lift") > 0, F.col("low")).otherwise(F.col("high"))
    return blocks.join(limits, "raster").select("raster", "r", "c", z.alias("z"))


def packed(cells: DataFrame, side: int) -> DataFrame:
    """(raster, ti, tj, rows, cols, low, top, z): a row a tile; z holds its cells and one more row and column below and to the right, row by row,
    NaN where there is none. rows and cols are how many of its own it has, low and top their least and greatest with the halo's."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        z, r0, c0 = window_of(rows, side, 0, 1)
        own = ~np.isnan(z[:side, :side])
        if not own.any():
            return pd.DataFrame(columns=["raster", "ti", "tj", "rows", "cols", "low", "top", "z"])
        first = rows.iloc[0]
        counts = [int(np.flatnonzero(own.any(axis))[-1]) + 1 for axis in (1, 0)]
        return pd.DataFrame([[first["raster"], first["ti"], first["tj"], *counts, np.nanmin(z), np.nanmax(z), z.ravel()]], columns=["raster", "ti", "tj", "rows", "cols", "low", "top", "z"])

    kind = cells.schema["raster"].dataType.simpleString()
    cut = haloed(cells.select("raster", F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), "z"), side, 0, 1)
    return cut.groupBy("raster", "ti", "tj").applyInPandas(run, f"raster {kind}, ti int, tj int, rows int, cols int, low double, top double, z array<double>")
