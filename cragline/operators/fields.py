"""Distance fields, skylines, ray tests, seams and folds over rasters and lines."""

from __future__ import annotations

import bisect
import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cragline.operators import raster as ra
from cragline.operators.batches import by_groups


#: Columns that a task measures at once.
COLUMN_BLOCK = 64
#: Contour points whose steps a task holds at once.
SEAM_ROWS = 20_000


def nearest_by_columns(reach: np.ndarray) -> np.ndarray:
    """Of each column's rows (columns are the first axis), the row whose mark, so far away within that row (-1: none there), is nearest to
    each; of equals the first. -1 where no row has a mark.

    Squared distances to a row's mark are a parabola over the rows. From the top down the parabolas that are least somewhere are kept
    with the last row at which each is; two of them cross once, so a new one takes whole stretches from the last. All columns go on
    together, row by row.
    """
    many, height = reach.shape
    lifts = reach.astype(np.int64) ** 2
    kept, until = np.full((many, height + 1), -1), np.full((many, height + 1), -1)  # rows, and the last place at which the one before still is the nearest
    n = np.zeros(many, np.int64)
    for q in range(height):
        at = np.flatnonzero(reach[:, q] >= 0)
        met = np.full(many, -1)
        left = at[n[at] > 0]
        while len(left):
            p, top = kept[left, n[left] - 1], until[left, n[left] - 1]
            meet = (q * q + lifts[left, q] - p * p - lifts[left, p]) // (2 * (q - p))
            gone = meet <= top
            met[left[~gone]] = meet[~gone]
            n[left[gone]] -= 1
            left = left[gone]
            left = left[n[left] > 0]
        kept[at, n[at]], until[at, n[at]] = q, np.where(n[at] > 0, met[at], -1)
        n[at] += 1
    column, k = np.nonzero((np.arange(height + 1) > 0) & (np.arange(height + 1) < n[:, None]) & (until < height - 1))
    begins = np.zeros((many, height), np.int64)
    np.add.at(begins, (column, until[column, k] + 1), 1)
    found = np.take_along_axis(kept, np.cumsum(begins, 1), 1)
    found[n == 0] = -1
    return found


def nearest_by_column(reach: np.ndarray) -> np.ndarray:
    """nearest_by_columns() of one column."""
    return nearest_by_columns(reach[None])[0]


def distance_field(cells: DataFrame, marked: Column) -> DataFrame:
    """(tile, r, c, d, mark_r, mark_c): exact distance to the tile's nearest marked cell, and which that is (of equals the least row, then
    column); null in a tile without one.

    Two windows find the nearest mark within each row; then a column's rows are measured in linear time. A task holds some columns of
    a tile, not the tile, and of small tiles many at a time.
    """
    w = ra.along_row()
    upto, after = w.rowsBetween(Window.unboundedPreceding, Window.currentRow), w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    at = F.when(marked, F.col("c"))
    rows = cells.select("tile", F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), F.last(at, True).over(upto).alias("low"), F.first(at, True).over(after).alias("high"))
    left = F.col("high").isNull() | (F.col("c") - F.col("low") <= F.col("high") - F.col("c"))
    rows = rows.select("tile", "r", "c", F.when(left, F.col("low")).otherwise(F.col("high")).cast("int").alias("mark"), F.floor(F.col("c") / COLUMN_BLOCK).cast("int").alias("block"))

    def run(rows: pa.Table) -> pa.Table:
        r, c = (rows.column(n).to_numpy().astype(np.int64) for n in ("r", "c"))
        mark = rows.column("mark").fill_null(-1).to_numpy().astype(np.int64)
        tile = rows.column("tile").combine_chunks().dictionary_encode("encode").indices.to_numpy()
        new = np.ones(len(r), bool)
        new[1:] = (c[1:] != c[:-1]) | (tile[1:] != tile[:-1])
        column, begins = np.cumsum(new) - 1, np.flatnonzero(new)
        heights = np.maximum.reduceat(r, begins) + 1
        near, mark_c = np.full(len(r), -1), np.full(len(r), -1)
        # columns of about one height together
        size = np.ceil(np.log2(heights)).astype(np.int64)
        for k in np.unique(size):
            of = np.flatnonzero(size[column] == k)
            place = (np.cumsum(size == k) - 1)[column[of]]
            marks = np.full((int((size == k).sum()), int(heights[size == k].max())), -1)
            marks[place, r[of]] = mark[of]
            reach = np.full(marks.shape, -1)
            known = mark[of] >= 0
            reach[place[known], r[of][known]] = np.abs(mark[of] - c[of])[known]
            near[of] = nearest_by_columns(reach)[place, r[of]]
            mark_c[of] = marks[place, near[of]]
        none = near < 0
        d = np.sqrt(((r - near) ** 2 + (mark_c - c) ** 2).astype(np.float64))
        return pa.table({"tile": rows.column("tile"), "r": rows.column("r"), "c": rows.column("c"), "d": pa.array(d, mask=none), "mark_r": pa.array(near.astype(np.int32), mask=none), "mark_c": pa.array(mark_c.astype(np.int32), mask=none)})

    kind = cells.schema["tile"].dataType.simpleString()
    return by_groups(rows, ["tile", "block"], ["c", "r"], run, f"tile {kind}, r int, c int, d double, mark_r int, mark_c int")


def _grids(tiles: pa.Table, side: int) -> np.ndarray:
    """Dense tiles, sorted by row and column, as an array each."""
    return tiles.column("z").to_numpy().astype(np.float64).reshape(-1, side, side)


def sampled(z: np.ndarray, dx: float, dy: float) -> np.ndarray:
    """The bilinear surface at (c + dx, r + dy) for every cell (r, c) of a raster or of many, NaN off the raster. The offset is one for all
    cells, so its four weights are too, and each corner is a shifted view of the raster."""
    height, width = z.shape[-2:]
    x, y = math.floor(dx), math.floor(dy)
    out = np.zeros_like(z)
    for i, wy in ((y, 1 - (dy - y)), (y + 1, dy - y)):
        for j, wx in ((x, 1 - (dx - x)), (x + 1, dx - x)):
            if wx * wy == 0:
                continue
            moved = np.full_like(z, np.nan)
            if abs(i) < height and abs(j) < width:
                moved[..., max(0, -i) : height - max(0, i), max(0, -j) : width - max(0, j)] = z[..., max(0, i) : height + min(0, i), max(0, j) : width + min(0, j)]
            out += wy * wx * moved
    return out


def skylines(cells: DataFrame, side: int, spacing: float, bias: float, azimuths: tuple[float, ...]) -> DataFrame:
    """(tile, r, c, azimuth, elevation): degrees to which the terrain rises above a cell (and bias) towards an azimuth, seen at steps of
    one cell; 0 where it doesn't. Azimuths run from the north (-r) over the east (+c).

    A tile of side cells is a task's, which takes many at a time. Steps go outwards for all cells at once, and a tile's end when nothing as
    high as its top could stand out any more.
    """
    def run(tiles: pa.Table) -> pa.Table:
        z = _grids(tiles, side)
        found = []
        for azimuth in azimuths:
            # a whole number of cells is meant where the sine of an angle misses it by a rounding
            dx, dy = (round(f(math.radians(azimuth)), 12) for f in (math.sin, lambda a: -math.cos(a)))
            best, room = np.zeros_like(z), z.max((1, 2), keepdims=True) - z - bias
            left = np.arange(len(z))
            for k in range(1, math.ceil(side * 1.5)):
                left = left[(room[left] > best[left] * k * spacing).any((1, 2))]
                if not len(left):
                    break
                best[left] = np.fmax(best[left], (sampled(z[left], dx * k, dy * k) - z[left] - bias) / (k * spacing))
            of = tiles.select(["tile", "r", "c"])
            found.append(of.append_column("azimuth", pa.array(np.full(len(of), azimuth))).append_column("elevation", pa.array(np.degrees(np.arctan(best)).ravel())))
        return pa.concat_tables(found)

    kind = cells.schema["tile"].dataType.simpleString()
    placed = cells.select("tile", F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), F.col("z").cast("double").alias("z"))
    return by_groups(placed, ["tile"], ["r", "c"], run, f"tile {kind}, r int, c int, azimuth double, elevation double")


def skyline(cells: DataFrame, side: int, spacing: float, bias: float) -> DataFrame:
    """(tile, r, c, elevation) of skylines towards +c."""
    return skylines(cells, side, spacing, bias, (90.0,)).drop("azimuth")


def blocked(z: np.ndarray, dx: float, dy: float, rise: float, bias: float, least: float = 1e-3) -> np.ndarray:
    """Of each cell, whether the bilinear surface stands more than least above its ray, which begins bias above the cell and goes (dx, dy)
    and up by rise with each unit. A ray without direction meets nothing; one whose direction isn't finite raises an error.

    The excess is a quadratic between two places where rays cross a row or a column, and these places are the same for all cells. Three
    values of a quadratic give its greatest.
    """
    if not all(map(math.isfinite, (dx, dy, rise))):
        raise ValueError("a ray's direction is not finite")
    out = np.zeros(z.shape, bool)
    crossings = sorted({k / abs(d) for d in (dx, dy) if d for k in range(max(z.shape[-2:]))})
    excess = lambda t: sampled(z, dx * t, dy * t) - (z + bias) - rise * t
    begin = excess(0.0)
    for low, high in zip(crossings, crossings[1:], strict=False):
        middle, end = excess((low + high) / 2), excess(high)
        bend, slope = 2 * (begin - 2 * middle + end), 4 * middle - 3 * begin - end
        top = np.fmax(begin, end)
        with np.errstate(all="ignore"):
            peak = -slope / (2 * bend)
            top = np.where((bend < 0) & (peak > 0) & (peak < 1), begin + slope * peak / 2, top)
        out |= ~np.isnan(middle) & (top > least)
        begin = end
    return out


def rays(cells: DataFrame, side: int, direction: tuple[float, float], rise: float, bias: float) -> DataFrame:
    """(tile, r, c, blocked) for every cell of dense tiles, many tiles at a time."""

    def run(tiles: pa.Table) -> pa.Table:
        return tiles.select(["tile", "r", "c"]).append_column("blocked", pa.array(blocked(_grids(tiles, side), *direction, rise, bias).ravel()))

    kind = cells.schema["tile"].dataType.simpleString()
    placed = cells.select("tile", F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), F.col("z").cast("double").alias("z"))
    return by_groups(placed, ["tile"], ["r", "c"], run, f"tile {kind}, r int, c int, blocked boolean")


def _steps(tile: np.ndarray, r: np.ndarray, c: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(u, v, length) of each two points of a tile within the radius, u before v; points lie in order of tile and r."""
    found: list[tuple[np.ndarray, ...]] = []
    u = np.arange(len(r))
    for ahead in range(1, len(r)):
        u = u[: np.searchsorted(u, len(r) - ahead)]
        v = u + ahead
        u = u[(tile[u] == tile[v]) & (r[v] - r[u] <= radius)]
        if not len(u):
            break
        v = u + ahead
        d = np.sqrt((c[u] - c[v]) ** 2 + (r[u] - r[v]) ** 2)
        near = d <= radius
        found.append((u[near], v[near], d[near]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (u[:0], u[:0], np.zeros(0))


def _cheapest(n: int, u: np.ndarray, v: np.ndarray, w: np.ndarray, tile: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of n points each one's least cost from a first one of its tile (inf: none), and the fewest steps that cost it. Rounds relax the edges
    (u, v, w), either way, of the tiles that the round before changed."""
    cost, hops = np.where(first, 0.0, np.inf), np.where(first, 0, n)
    order = np.argsort(np.concatenate((v, u)), kind="stable")
    source, target, w = np.concatenate((u, v))[order], np.concatenate((v, u))[order], np.concatenate((w, w))[order]

    def rounds(value: np.ndarray, source: np.ndarray, target: np.ndarray, more) -> None:
        left = np.arange(len(source))
        while len(left):
            begins = np.flatnonzero(np.append(True, target[left][1:] != target[left][:-1]))
            at, least = target[left][begins], np.minimum.reduceat(value[source[left]] + more[left], begins)
            better = least < value[at]
            value[at[better]] = least[better]
            left = left[np.isin(tile[target[left]], tile[at[better]])]

    rounds(cost, source, target, w)
    kept = (cost[source] + w == cost[target]) & (cost[target] < np.inf)
    rounds(hops, source[kept], target[kept], np.ones(int(kept.sum()), np.int64))
    return cost, hops


def seams(cells: DataFrame, side: int, interval: float, radius: float) -> DataFrame:
    """(tile, cost, hops): the cheapest way from a tile's first row to its last along contour points, steps of radius at most; of equal costs
    the one of fewest steps.

    Only the points are dealt by tile; a task finds the steps between them and relaxes many tiles' at once.
    """
    points = ra.contour_crossings(cells, interval).select(F.col("tile").cast("long").alias("tile"), F.col("r").cast("double").alias("r"), F.col("c").cast("double").alias("c")).distinct()

    def run(rows: pa.Table) -> pa.Table:
        tile, r, c = (rows.column(n).to_numpy() for n in ("tile", "r", "c"))
        cost, hops = _cheapest(len(r), *_steps(tile, r, c, radius), tile, r <= 1)
        ends = np.flatnonzero((r >= side - 2) & (r > 1) & (cost < np.inf))
        ends = ends[np.lexsort((hops[ends], cost[ends], tile[ends]))]
        ends = ends[np.flatnonzero(np.append(True, tile[ends][1:] != tile[ends][:-1]))] if len(ends) else ends
        return pa.table({"tile": tile[ends], "cost": cost[ends], "hops": hops[ends]})

    return by_groups(points, ["tile"], ["r", "c"], run, "tile long, cost double, hops long", SEAM_ROWS)


def reversal_splits(points: DataFrame, axis: str, limit: float, *by: str) -> DataFrame:
    """(by, line, piece, at, after, upto, way) of points (by, line, idx, axis): a line has a direction along the axis, at first that of its first move. Where it
    goes back by limit without a move along its direction between, it is cut, at the axis value of that place, and goes on in the new
    direction (way). Values are taken to nine decimals; after and upto are the points between which the place lies.

    Between two turning points all moves go one way, so a stretch as long as limit settles the direction, whatever it was: it cuts the
    line if the one that was settled before differs. Windows alone tell.
    """
    keys = [*by, "line"]
    order = Window.partitionBy(*keys).orderBy("idx")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    value = F.round(F.col(axis).cast("double"), 9)
    moves = points.select(*keys, "idx", value.alias("a")).withColumn("way", F.signum(F.col("a") - F.lag("a").over(order)))
    # a point where the next way differs is a corner, and so are both ends
    steps = moves.where("way IS NULL OR way <> 0").withColumn("onward", F.lead("way").over(order))
    corners = steps.where("way IS NULL OR onward IS NULL OR way <> onward").withColumn("length", F.abs(F.round(F.col("a") - F.lag("a").over(order), 9)))
    settled = F.last(F.when(F.col("length") >= limit, F.col("way")), True).over(before)
    first = F.first("way", True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    begins = {"held": F.coalesce(settled, first), "from": F.lag("a").over(order), "after": F.lag("idx").over(order)}
    cut = corners.withColumns(begins).where((F.col("length") >= limit) & (F.col("way") != F.col("held")))
    return cut.select(*keys, (F.row_number().over(order) - 1).alias("piece"), F.round(F.col("from") + F.col("way") * limit, 9).alias("at"), "after", F.col("idx").alias("upto"), "way")


def longest_shadows(spans: DataFrame) -> DataFrame:
    """(line, place, id, lo, hi) of spans (line, id, lo, hi): the longest is taken, the others lose what lies in it, and so on; of
    equal lengths the least id, then the least lo.

    Of spans alike in both ends only the one with the least id can show. Spans are grouped by where they overlap, so that a line
    is split wherever nothing covers it; within a group they wait in a heap.
    """
    alone = spans.groupBy("line", "lo", "hi").agg(F.min("id").alias("id"))
    order = Window.partitionBy("line").orderBy("lo", "hi")
    reach = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    clusters = alone.withColumn("gap", F.coalesce(F.col("lo") >= reach, F.lit(True)).cast("long"))
    clusters = clusters.withColumn("cluster", F.sum("gap").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))

    def shown(ids: list, los: list[float], his: list[float]) -> list[tuple]:
        heap = [(lo - hi, i, lo, hi) for i, lo, hi in zip(ids, los, his, strict=True)]
        heapq.heapify(heap)
        begins: list[float] = []  # of the spans taken, which don't overlap, in order; and their ends
        ends: list[float] = []
        out = []
        while heap:
            _, i, lo, hi = heapq.heappop(heap)
            left = []  # what no taken span covers
            at, k = lo, bisect.bisect_right(ends, lo)
            while k < len(begins) and begins[k] < hi:
                if begins[k] > at:
                    left.append((at, begins[k]))
                at, k = max(at, ends[k]), k + 1
            if at < hi:
                left.append((at, hi))
            if left == [(lo, hi)]:
                k = bisect.bisect(begins, lo)
                begins.insert(k, lo)
                ends.insert(k, hi)
                out.append((i, lo, hi))
            else:
                for a, b in left:
                    heapq.heappush(heap, (a - b, i, a, b))
        return out

    def run(rows: pa.Table) -> pa.Table:
        line, cluster = rows.column("line").combine_chunks(), rows.column("cluster").to_numpy()
        code = line.dictionary_encode("encode").indices.to_numpy()
        begins = [0, *(np.flatnonzero((code[1:] != code[:-1]) | (cluster[1:] != cluster[:-1])) + 1).tolist(), len(code)]
        i, lo, hi = (rows.column(n).to_pylist() for n in ("id", "lo", "hi"))
        found, of = [], []
        for a, b in zip(begins, begins[1:], strict=False):
            taken = shown(i[a:b], lo[a:b], hi[a:b])
            found += taken
            of += [a] * len(taken)
        return pa.table({"line": line.take(pa.array(of, pa.int64())), **{n: pa.array([x[k] for x in found], rows.schema.field(n).type) for k, n in enumerate(("id", "lo", "hi"))}})

    kind = ", ".join(f"{c} {spans.schema[c].dataType.simpleString()}" for c in ("line", "id")) + ", lo double, hi double"
    clusters = clusters.select("line", "cluster", "id", F.col("lo").cast("double").alias("lo"), F.col("hi").cast("double").alias("hi"))
    taken = by_groups(clusters, ["line", "cluster"], ["lo", "hi"], run, kind)
    place = F.row_number().over(Window.partitionBy("line").orderBy(F.col("lo") - F.col("hi"), "id", "lo")).cast("long")
    return taken.select("line", place.alias("place"), "id", "lo", "hi")
