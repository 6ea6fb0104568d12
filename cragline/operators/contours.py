"""Contour lines of rasters cut into tiles, cells (raster, r, c, z): each tile follows the pieces in its squares, and lines that leave a tile
are joined to those of its neighbours.

A crossing (where a line crosses the edge between two cells) has a number made from the edge's place, so both tiles at a border name it
alike. Fragments are put in order by doubling pointers along them, so rounds are the logarithm of the fragments in a line and no task holds a
line, a level or a raster. A line begins at the end with the lesser number; a closed one at its least number, from there to the lesser of
the two beside it, and repeats it at the end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cragline.operators import graph, tiles
from cragline.operators.batches import by_groups
from cragline.session import discard, written

#: Columns a raster may have: a crossing's number is ((row * WIDE) + column) * 2, and one more for an edge that goes down.
WIDE = 1 << 24
#: Cells whose pieces a task chains at once.
ROWS = 50_000


def pieces(z: np.ndarray, r0: int, c0: int, interval: float) -> tuple[np.ndarray, ...]:
    """(k, p, q, x1, y1, x2, y2): the pieces of contour lines, of level k * interval, within the squares of four cells of an array that
    begins at a row and column; p and q number their crossings. A corner at the level is above it. Where opposite corners agree against
    the others, the two that differ from the mean of all are cut off."""
    corners = [z[:-1, :-1], z[:-1, 1:], z[1:, :-1], z[1:, 1:]]
    whole = ~np.isnan(sum(corners))
    r, c = np.nonzero(whole)
    corners = np.stack([v[whole] for v in corners])
    low, high = np.floor(corners.min(0) / interval), np.floor(corners.max(0) / interval)
    many = (high - low).astype(np.int64)
    at = np.repeat(np.arange(len(r)), many)
    k = (low[at] + 1 + np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)).astype(np.int64)
    a, b, d, e = corners[:, at]
    r, c, level = r[at] + r0, c[at] + c0, k * interval
    up = [v >= level for v in (a, b, d, e)]

    def share(v: np.ndarray, w: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            return (level - v) / (w - v)

    number = lambda row, col, down: (row.astype(np.int64) * WIDE + col) * 2 + down
    # top, left, right, bottom: which crosses, its number and its place
    edges = [
        (up[0] != up[1], number(r, c, 0), c + share(a, b), r + 0.0), (up[0] != up[2], number(r, c, 1), c + 0.0, r + share(a, d)),
        (up[1] != up[3], number(r, c + 1, 1), c + 1.0, r + share(b, e)), (up[2] != up[3], number(r + 1, c, 0), c + share(d, e), r + 1.0),
    ]
    crossed, names, xs, ys = (np.stack([edge[i] for edge in edges]) for i in range(4))
    saddle = crossed.all(0)
    centre = (a + b + d + e) / 4 >= level
    first = np.argmax(crossed, 0)
    last = 3 - np.argmax(crossed[::-1], 0)
    turned = saddle & (up[0] == centre)
    # of saddles: top with right and left with bottom, or top with left and right with bottom
    ends = [(first, np.where(saddle, np.where(turned, 2, 1), last), np.ones(len(k), bool)), (np.where(turned, 1, 2), np.full(len(k), 3), saddle)]
    out = []
    for s, t, has in ends:
        i = np.flatnonzero(has)
        out.append([k[i], *(v[w[i], i] for v, w in ((names, s), (names, t), (xs, s), (ys, s), (xs, t), (ys, t)))])
    return tuple(np.concatenate(v) for v in zip(*out, strict=True))


def chains(k: np.ndarray, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, bool]]]:
    """The ends of pieces (places in the concatenation of p and q) that stand for each crossing, and the chains of pieces as lists of such
    crossings, each with whether it is closed."""
    n = len(p)
    order = np.lexsort((np.concatenate((p, q)), np.concatenate((k, k))))
    names, levels = np.concatenate((p, q))[order], np.concatenate((k, k))[order]
    new = np.ones(2 * n, bool)
    new[1:] = (names[1:] != names[:-1]) | (levels[1:] != levels[:-1])
    node = np.empty(2 * n, np.int64)
    node[order] = np.cumsum(new) - 1
    other = np.concatenate((node[n:], node[:n]))[order]
    begin = np.flatnonzero(new)
    paired = np.zeros(len(begin), bool)
    paired[:-1], paired[-1:] = np.diff(begin) == 2, 2 * n - begin[-1:] == 2
    one = other[begin].tolist()
    two = np.where(paired, other[np.minimum(begin + 1, 2 * n - 1)], -1).tolist() if n else []
    seen, found = bytearray(len(begin)), []
    for start in [*np.flatnonzero(~paired).tolist(), *np.flatnonzero(paired).tolist()]:  # lesser numbers first
        if seen[start]:
            continue
        loop = two[start] >= 0
        chain, before, at = [start], start, min(one[start], two[start]) if loop else one[start]
        seen[start] = 1
        while at != start and at >= 0:
            chain.append(at)
            seen[at] = 1
            before, at = at, two[at] if one[at] == before else one[at]
        found.append((np.array(chain + chain[:1] * loop), loop))
    return order[begin] if n else begin, found


def fragments(cells: DataFrame, side: int, interval: float) -> DataFrame:
    """(raster, k, closed, ids, xs, ys): the lines that each tile's squares have, whole or as far as they go."""

    def run(rows: pa.Table) -> pa.Table:
        code = rows.column("raster").combine_chunks().dictionary_encode("encode").indices.to_numpy()
        r, c, ti, tj, z = (rows.column(n).to_numpy() for n in ("r", "c", "ti", "tj", "z"))
        begins = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (ti[1:] != ti[:-1]) | (tj[1:] != tj[:-1])))
        found = []
        for n, (i, j) in enumerate(zip(begins.tolist(), [*begins[1:].tolist(), len(z)], strict=True)):
            window = np.full((side + 1, side + 1), np.nan)
            r0, c0 = int(ti[i]) * side, int(tj[i]) * side
            window[r[i:j] - r0, c[i:j] - c0] = z[i:j]
            part = pieces(window, r0, c0, interval)
            found.append((np.full(len(part[0]), n), *part))
        of, k, p, q, x1, y1, x2, y2 = (np.concatenate(v) for v in zip(*found, strict=True))
        # lines of another level or tile have another key
        names = np.lexsort((k, of))
        key = np.empty(len(k), np.int64)
        key[names] = np.cumsum(np.append(True, (k[names][1:] != k[names][:-1]) | (of[names][1:] != of[names][:-1]))[: len(k)])
        first, chained = chains(key, p, q)
        at = np.concatenate([i for i, _ in chained]) if chained else np.zeros(0, np.int64)
        offsets = np.cumsum([0, *(len(i) for i, _ in chained)]).astype(np.int32)
        ids, xs, ys = (np.concatenate(v)[first][at] for v in ((p, q), (x1, x2), (y1, y2)))
        level, tile = (np.concatenate((v, v))[first][at[offsets[:-1]]] for v in (k, of))
        lists = {n: pa.ListArray.from_arrays(offsets, v) for n, v in (("ids", ids), ("xs", xs), ("ys", ys))}
        return pa.table({"raster": rows.column("raster").take(pa.array(begins[tile])), "k": level, "closed": pa.array([closed for _, closed in chained], pa.bool_()), **lists})

    cut = tiles.haloed(cells.where(F.col("z").isNotNull() & ~F.isnan("z")).select("raster", F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), F.col("z").cast("double").alias("z")), side, 0, 1)
    cut = cut.select("raster", "r", "c", "z", F.col("ti").cast("long").alias("ti"), F.col("tj").cast("long").alias("tj"))
    kind = cells.schema["raster"].dataType.simpleString()
    return by_groups(cut, ["raster", "ti", "tj"], [], run, f"raster {kind}, k long, closed boolean, ids array<long>, xs array<double>, ys array<double>", ROWS)


def _partners(open_ends: DataFrame) -> DataFrame:
    """(f, s, f2, s2) of open_ends (f, s, raster, k, name): ends of two fragments that are one crossing."""
    other = open_ends.select("raster", "k", "name", F.col("f").alias("f2"), F.col("s").alias("s2"))
    return open_ends.join(other, ["raster", "k", "name"]).where("f <> f2 OR s <> s2").select("f", "s", "f2", "s2", "raster", "k", "name")


def _joined(parts: DataFrame) -> DataFrame:
    """(f, line, closed, reverse, skip) of open fragments (f, raster, k, head, tail, n): which line each belongs to, whether that is closed, in
    which direction it goes along, and how many points come before it."""
    ends = parts.select("f", "raster", "k", F.posexplode(F.array("head", "tail")).alias("s", "name"))
    partners = written(_partners(ends), "partners")
    labels = written(graph.components(partners.select(F.col("f").alias("u"), F.col("f2").alias("v"))), "line-labels")
    of = parts.join(labels, F.col("f") == F.col("id"), "left").select("f", F.coalesce("label", "f").alias("line"), "n", "head", "tail", (F.col("head") == F.col("tail")).alias("bent"))
    met = partners.groupBy("f").agg(F.count(F.lit(1)).alias("met"))
    counts = of.join(met, "f", "left").groupBy("line").agg(F.sum(2 - F.coalesce("met", F.lit(0))).alias("free"))
    rings = counts.where("free = 0").select("line")
    # a ring is cut at its least border crossing
    cuts = partners.join(of.select("f", "line"), "f").join(rings, "line", "left_semi").groupBy("line").agg(F.min("name").alias("cut"))
    kept = partners.join(of.select("f", "line"), "f").join(cuts, "line", "left").where("cut IS NULL OR name <> cut").select("f", "s", "f2", "s2")
    # a state is a fragment left by one of its ends; before it comes what is left into its other end
    states = of.select("f", "line", "n", "head", "tail", F.explode(F.array(F.lit(0), F.lit(1))).alias("s"))
    came = kept.select("f", (1 - F.col("s")).alias("s"), (2 * F.col("f2") + F.col("s2")).alias("to"))
    enters = F.when(F.col("s") == 1, F.col("head")).otherwise(F.col("tail"))
    states = states.join(came, ["f", "s"], "left").select((2 * F.col("f") + F.col("s")).alias("id"), "f", "s", "line", "to", F.lit(0).cast("long").alias("skip"), (F.col("n") - 1).alias("step"), enters.alias("begin"))
    at = written(states.select("id", "f", "s", "line", "to", "skip", "step", "begin", F.when(F.col("to").isNull(), F.col("id")).alias("first")), "states")
    # skip: points of what lies between a state and the one that its pointer has reached; step: of the state itself
    at = written(at.join(at.select(F.col("id").alias("to"), F.col("step").alias("_step")), "to", "left").select("id", "f", "s", "line", "to", F.coalesce("_step", F.lit(0)).cast("long").alias("skip"), "begin", "first"), "states")
    while not at.where("to IS NOT NULL").isEmpty():
        on = at.select(F.col("id").alias("to"), F.col("to").alias("to2"), F.col("skip").alias("skip2"), F.coalesce("first", "to").alias("first2"), F.col("begin").alias("begin2"))
        moved = at.join(on, "to", "left").select(
            "id", "f", "s", "line", F.col("to2").alias("to"), (F.col("skip") + F.coalesce("skip2", F.lit(0))).alias("skip"),
            F.coalesce("begin2", "begin").alias("begin"), F.coalesce("first", F.when(F.col("to2").isNull(), F.coalesce("first2", "to"))).alias("first"),
        )
        old, at = at, written(moved, "states")
        discard(old)
    # of the two ways along a line the one from the lesser end, for rings either
    best = at.groupBy("line").agg(F.min(F.struct("begin", "first")).alias("b"))
    chosen = at.join(best, "line").where(F.struct("begin", "first") == F.col("b"))
    return chosen.join(cuts, "line", "left").select("f", "line", F.col("cut").isNotNull().alias("closed"), (F.col("s") == 0).alias("reverse"), "skip")


def contour_lines(cells: DataFrame, side: int, interval: float) -> DataFrame:
    """(raster, level, line, idx, x, y, closed): all contour lines, point by point; line is the number of a line's first crossing. Void cells
    have no lines around them. side is that of the tiles; it changes nothing in the result."""
    parts = written(fragments(cells, side, interval).withColumn("f", F.monotonically_increasing_id()), "fragments")
    whole = parts.where("closed").select("raster", "k", F.col("ids")[0].alias("line"), F.posexplode(F.arrays_zip("ids", "xs", "ys")).alias("idx", "p"), "closed")
    whole = whole.select("raster", "k", "line", F.col("idx").cast("long").alias("idx"), "p.xs", "p.ys", "closed")

    loose = parts.where("NOT closed")
    ends = loose.select("f", "raster", "k", F.col("ids")[0].alias("head"), F.element_at("ids", -1).alias("tail"), F.size("ids").cast("long").alias("n"))
    placed = loose.join(_joined(ends).withColumnRenamed("closed", "ring"), "f")
    turn = lambda c: F.when(F.col("reverse"), F.reverse(c)).otherwise(F.col(c)).alias(c)
    points = placed.select("raster", "k", "line", "ring", "skip", turn("ids"), turn("xs"), turn("ys"))
    # the first crossing of a fragment but the first is the last one of the fragment before
    points = points.select("raster", "k", "line", "ring", "skip", F.posexplode(F.arrays_zip("ids", "xs", "ys")).alias("i", "p")).where("i > 0 OR skip = 0")
    points = written(points.select("raster", "k", "line", "ring", (F.col("skip") + F.col("i")).alias("idx"), "p.ids", "p.xs", "p.ys"), "line-points")

    straight = points.where("NOT ring")
    firsts = straight.where("idx = 0").select("line", F.col("ids").alias("first"))
    straight = straight.join(firsts, "line").select("raster", "k", F.col("first").alias("line"), "idx", "xs", "ys", F.lit(False).alias("closed"))

    # rings: the point at the cut is there twice; turn them so that the least number is first and goes on to the lesser beside it
    rings = points.where("ring")
    lasts = rings.groupBy("line").agg(F.max("idx").alias("n"), F.min(F.struct("ids", "idx")).alias("least"))
    rings = rings.join(lasts, "line").where("idx < n")
    beside = rings.where((F.pmod(F.col("idx") - F.col("least.idx"), F.col("n")) == 1) | (F.pmod(F.col("least.idx") - F.col("idx"), F.col("n")) == 1))
    onward = beside.groupBy("line").agg(F.min_by(F.pmod(F.col("idx") - F.col("least.idx"), F.col("n")) == 1, "ids").alias("onward"))
    away = F.col("idx") - F.col("least.idx")
    rings = rings.join(onward, "line").select("raster", "k", F.col("least.ids").alias("line"), F.pmod(F.when(F.col("onward"), away).otherwise(-away), F.col("n")).alias("idx"), "n", "xs", "ys")
    rings = rings.select("raster", "k", "line", F.explode(F.when(F.col("idx") == 0, F.array("idx", "n")).otherwise(F.array("idx"))).alias("idx"), "xs", "ys", F.lit(True).alias("closed"))

    every = whole.unionByName(straight).unionByName(rings)
    return every.select("raster", (F.col("k") * F.lit(interval)).alias("level"), "line", "idx", F.col("xs").alias("x"), F.col("ys").alias("y"), "closed")
