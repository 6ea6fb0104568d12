"""Skylines and rays over rasters of many tiles, cells (raster, r, c, z).

A tile's cells look along one direction through the tiles that lie there, its own first. Tiles are paired by arithmetic on their numbers,
and a pair is made only if the other tile's top stands high enough to matter. A task takes one tile at a time, and the others one after
the other by distance, so it holds two tiles whatever the raster's size.

The surface between four cells is bilinear. A direction is one for all cells, so the weights of a step are, too: results are the same to
the last bit for every side of tiles.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cragline.operators import tiles
from cragline.session import written


class _Facing:
    """A tile (rows x cols cells at r0, c0) and another one that it looks through."""

    def __init__(self, z: np.ndarray, at: tuple[int, int], other: np.ndarray, begin: tuple[int, int], side: int) -> None:
        self.z, self.at, self.other, self.begin, self.side = z, at, other, begin, side

    def times(self, dx: float, dy: float) -> tuple[float, float]:
        """Between which steps along a direction some cell can lie over the other tile."""
        first, last = 0.0, math.inf
        for d, own, n, begin in ((dy, self.at[0], self.z.shape[0], self.begin[0]), (dx, self.at[1], self.z.shape[1], self.begin[1])):
            low, high = begin - (own + n - 1) - 1, begin + self.side - own + 1
            if d == 0:
                if low > 0 or high < 0:
                    return 1.0, 0.0
                continue
            a, b = sorted((low / d, high / d))
            first, last = max(first, a), min(last, b)
        return first, last

    def part(self, x: int, y: int) -> tuple[slice, slice] | None:
        """The cells whose square, x columns and y rows on, is the other tile's."""
        spans = []
        for own, n, begin, move in ((self.at[0], self.z.shape[0], self.begin[0], y), (self.at[1], self.z.shape[1], self.begin[1], x)):
            low, high = max(0, begin - move - own), min(n, begin + self.side - move - own)
            if low >= high:
                return None
            spans.append(slice(low, high))
        return spans[0], spans[1]

    def surface(self, part: tuple[slice, slice], x: int, y: int, dx: float, dy: float) -> np.ndarray:
        """The surface at (c + dx, r + dy) for the cells of a part, within their square x columns and y rows on."""
        out = np.zeros((part[0].stop - part[0].start, part[1].stop - part[1].start))
        r, c = self.at[0] + part[0].start + y - self.begin[0], self.at[1] + part[1].start + x - self.begin[1]
        for i, wy in ((0, 1 - (dy - y)), (1, dy - y)):
            for j, wx in ((0, 1 - (dx - x)), (1, dx - x)):
                if wx * wy != 0:
                    out += wy * wx * self.other[r + i : r + i + out.shape[0], c + j : c + j + out.shape[1]]
        return out


def _pairs(stats: DataFrame, side: int, dx: float, dy: float) -> DataFrame:
    """(raster, ti, tj, low, bi, bj, since) of tiles (raster, ti, tj, low): which tiles lie towards a direction, and after how many steps at
    least."""
    along_c = abs(dx) >= abs(dy)
    major, minor = ("tj", "ti") if along_c else ("ti", "tj")
    go, drift = (dx, dy) if along_c else (dy, dx)
    counts = stats.groupBy("raster").agg((F.max("ti") + 1).alias("ni"), (F.max("tj") + 1).alias("nj"))
    placed = stats.select("raster", "ti", "tj", "low").join(counts, "raster")
    n_major, n_minor = (F.col("nj"), F.col("ni")) if along_c else (F.col("ni"), F.col("nj"))
    reach = n_major - 1 - F.col(major) if go > 0 else F.col(major)
    steps = placed.withColumn("m", F.explode(F.sequence(F.lit(0), reach))).withColumn("n_minor", n_minor)
    since = F.greatest(F.lit(0.0), (F.col("m") - 1) * side / abs(go))
    aside = [drift * since / side, drift * (F.col("m") + 1) / abs(go)]
    low, high = F.floor(F.least(*aside)) - 1, F.floor(F.greatest(*aside)) + 1
    steps = steps.withColumn("since", since).withColumn("b", F.explode(F.sequence(F.greatest(F.col(minor) + low, F.lit(0)).cast("int"), F.least(F.col(minor) + high, F.col("n_minor") - 1).cast("int"))))
    ahead = F.col(major) + (1 if go > 0 else -1) * F.col("m")
    bi, bj = (F.col("b"), ahead) if along_c else (ahead, F.col("b"))
    return steps.where("b >= 0").select("raster", "ti", "tj", "low", bi.cast("int").alias("bi"), bj.cast("int").alias("bj"), "since")


def _looked(cells: DataFrame, side: int, dx: float, dy: float, matters: Callable[[], object], start: Callable[[np.ndarray], np.ndarray], look: Callable[[_Facing, np.ndarray], None], out: str, out_type: pa.DataType) -> DataFrame:
    """(raster, r, c, out): start(z) of a tile, changed by look(facing, found) for each tile that it looks through and for which matters()."""
    packs = written(tiles.packed(cells, side), "packs")
    stats = packs.select("raster", "ti", "tj", "low", "top")
    other = stats.select("raster", F.col("ti").alias("bi"), F.col("tj").alias("bj"), "top")
    pairs = _pairs(stats, side, dx, dy).join(other, ["raster", "bi", "bj"]).where(matters())
    payload = packs.select("raster", F.col("ti").alias("bi"), F.col("tj").alias("bj"), "rows", "cols", "z")
    seen = pairs.select("raster", "ti", "tj", "since", "bi", "bj").join(payload, ["raster", "bi", "bj"])
    heads = packs.select("raster", "ti", "tj", F.lit(-1.0).alias("since"), F.col("ti").alias("bi"), F.col("tj").alias("bj"), "rows", "cols", "z")
    dealt = heads.unionByName(seen).repartition("raster", "ti", "tj").sortWithinPartitions("raster", "ti", "tj", "since", "bi", "bj")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, tile, z, found, at = ["raster", "r", "c", out], None, None, None, (0, 0)

        def told() -> pa.RecordBatch:
            r, c = np.nonzero(~np.isnan(z))
            arrays = [pa.array([tile] * len(r), kind), pa.array(r + at[0], pa.int32()), pa.array(c + at[1], pa.int32()), pa.array(found[r, c], out_type)]
            return pa.RecordBatch.from_arrays(arrays, names)

        for batch in batches:
            kind = batch.schema.field("raster").type
            for i in range(batch.num_rows):
                row = {k: batch.column(k)[i] for k in ("raster", "since", "bi", "bj", "rows", "cols")}
                row = {k: v.as_py() for k, v in row.items()}
                array = batch.column("z")[i].values.to_numpy(zero_copy_only=False).reshape(side + 1, side + 1)
                begin = (row["bi"] * side, row["bj"] * side)
                if row["since"] < 0:  # the next tile's own
                    if z is not None:
                        yield told()
                    tile, at, z = row["raster"], begin, array[: row["rows"], : row["cols"]].copy()
                    found = start(z)
                else:
                    look(_Facing(z, at, array, begin, side), found)
        if z is not None:
            yield told()

    kinds = {pa.float64(): "double", pa.bool_(): "boolean"}
    return dealt.mapInArrow(run, f"raster {cells.schema['raster'].dataType.simpleString()}, r int, c int, {out} {kinds[out_type]}")


def skylines(cells: DataFrame, side: int, spacing: float, bias: float, azimuth: float) -> DataFrame:
    """(raster, r, c, elevation): degrees to which the terrain rises above a cell (and bias) towards an azimuth (from the north, -r, over the
    east, +c), seen at steps of one cell; 0 where it doesn't. side is that of the tiles."""
    # a whole number of cells is meant where the sine of an angle misses it by a rounding
    dx, dy = round(math.sin(math.radians(azimuth)), 12), round(-math.cos(math.radians(azimuth)), 12)

    def look(facing: _Facing, best: np.ndarray) -> None:
        first, last = facing.times(dx, dy)
        top, room = np.nanmax(facing.other), facing.z + bias
        for k in range(max(1, math.floor(first)), math.ceil(min(last, 1e9)) + 1 if first <= last else 0):
            if not (top - room > best * (k * spacing)).any():
                break
            x, y = math.floor(dx * k), math.floor(dy * k)
            part = facing.part(x, y)
            if part is not None:
                rise = (facing.surface(part, x, y, dx * k, dy * k) - facing.z[part] - bias) / (k * spacing)
                best[part] = np.fmax(best[part], rise)

    found = _looked(cells, side, dx, dy, lambda: F.col("top") > F.col("low") + bias, np.zeros_like, look, "slope", pa.float64())
    return found.select("raster", "r", "c", F.degrees(F.atan("slope")).alias("elevation"))


def rays(cells: DataFrame, side: int, direction: tuple[float, float], rise: float, bias: float, least: float = 1e-3) -> DataFrame:
    """(raster, r, c, blocked): whether the surface stands more than least above the ray that begins bias above a cell and goes by direction
    (columns, rows) and up by rise with each unit. side is that of the tiles.

    Between two places where rays cross a row or a column, which are the same for all cells, the excess is a quadratic, known by three values.
    """
    dx, dy = direction
    if not all(map(math.isfinite, (dx, dy, rise))):
        raise ValueError("a ray's direction is not finite")

    def look(facing: _Facing, blocked: np.ndarray) -> None:
        first, last = facing.times(dx, dy)
        if first > last:
            return
        steps = {n: range(max(0, math.floor(first * abs(d)) - 1), math.ceil(last * abs(d)) + 2) for n, d in (("x", dx), ("y", dy)) if d}
        crossings = sorted({k / abs(d) for n, d in (("x", dx), ("y", dy)) if d for k in steps[n]})
        for low, high in zip(crossings, crossings[1:], strict=False):
            middle = (low + high) / 2
            x, y = math.floor(dx * middle), math.floor(dy * middle)
            part = facing.part(x, y)
            if part is None:
                continue
            begin, half_way, end = (facing.surface(part, x, y, dx * t, dy * t) - (facing.z[part] + bias) - rise * t for t in (low, middle, high))
            bend, slope = 2 * (begin - 2 * half_way + end), 4 * half_way - 3 * begin - end
            top = np.fmax(begin, end)
            with np.errstate(all="ignore"):
                peak = -slope / (2 * bend)
                top = np.where((bend < 0) & (peak > 0) & (peak < 1), begin + slope * peak / 2, top)
            blocked[part] |= ~np.isnan(half_way) & (top > least)

    if dx == 0 and dy == 0:
        return cells.where("NOT isnan(z)").select("raster", F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), F.lit(False).alias("blocked"))
    # what rises by the least number of steps at least is above the lowest cell's ray there; a falling ray is lower further on
    matters = (lambda: F.col("top") - F.col("low") - bias - rise * F.col("since") > 0) if rise >= 0 else (lambda: F.lit(True))
    return _looked(cells, side, dx, dy, matters, lambda z: np.zeros(z.shape, bool), look, "blocked", pa.bool_())
