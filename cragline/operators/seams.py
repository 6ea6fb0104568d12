"""Seams: least-cost lines along contours from one end of a corridor to the other, for many corridors of many rasters at once.

Contours of a corridor's cells are cut where they turn back (fields.reversal_splits), thinned to the longest in each stretch
(fields.longest_shadows), merged into a graph on a grid of half pixels, and joined by shortcuts where going round costs much more than the
straight way (detours). All that is joins, windows and groups over all corridors. What is left of one corridor, a graph of a few
thousand nodes, is then a task's: parts are bridged, the ends are led to the borders, and the path of least cost is followed back.

Corridors of either direction are laid so that rows run along them.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cragline.operators import contours, mapping, near
from cragline.operators import fields as fi
from cragline.session import shuffled

#: Cells of a bucket's side, by which corridors meet their cells.
BUCKET = 64
#: A node's number is its half-pixel row times this, and its half-pixel column.
KEY = 1 << 24


def crops(cells: DataFrame, corridors: DataFrame) -> DataFrame:
    """(raster, r, c, z) of cells and corridors (corridor, raster, axis, r0, r1, c0, c1): raster is the corridor's number, r counts along
    its axis ('y': rows, 'x': columns) from its begin, c across it; ends are not included."""
    spans = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / BUCKET), F.floor((F.col(b) - 1) / BUCKET)))
    wide = corridors.where("r1 > r0 AND c1 > c0").withColumn("br", spans("r0", "r1")).withColumn("bc", spans("c0", "c1"))
    placed = cells.select("raster", "r", "c", "z", F.floor(F.col("r") / BUCKET).alias("br"), F.floor(F.col("c") / BUCKET).alias("bc"))
    inside = placed.join(wide, ["raster", "br", "bc"]).where("r >= r0 AND r < r1 AND c >= c0 AND c < c1")
    down, right = F.col("r") - F.col("r0"), F.col("c") - F.col("c0")
    along = F.col("axis") == "y"
    return inside.select(F.col("corridor").alias("raster"), F.when(along, down).otherwise(right).cast("int").alias("r"), F.when(along, right).otherwise(down).cast("int").alias("c"), "z")


def split_edges(points: DataFrame, limit: float, *by: str) -> DataFrame:
    """(by, line, piece, idx, x1, y1, x2, y2) of points (by, line, idx, x, y): the steps of lines, which become pieces where they turn back
    along y by limit; a step with a cut is two."""
    keys = [*by, "line"]
    cuts = fi.reversal_splits(points, "y", limit, *by).select(*keys, F.col("after").alias("idx"), F.struct("at", "upto", "way").alias("cut"))
    order = Window.partitionBy(*keys).orderBy("idx")
    ends = {f"{a}2": F.lead(a).over(order) for a in "xy"}
    steps = points.join(cuts, [*keys, "idx"], "left").withColumns(ends | {"held": F.last("cut", True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))})
    way, at = F.col("held.way"), F.col("held.at")
    passes = (F.col("idx") < F.col("held.upto")) & (way * F.round("y", 9) < way * at) & (way * at <= way * F.round("y2", 9))
    steps = steps.where("x2 IS NOT NULL").withColumn("cut_here", F.coalesce(passes, F.lit(False)))
    before = F.coalesce(F.sum(F.col("cut_here").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    t = (at - F.col("y")) / (F.col("y2") - F.col("y"))
    middle = F.col("x") + t * (F.col("x2") - F.col("x"))
    edge = lambda piece, x1, y1, x2, y2: F.struct(piece.alias("piece"), x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))
    whole = edge(F.col("n"), F.col("x"), F.col("y"), F.col("x2"), F.col("y2"))
    halves = F.array(edge(F.col("n"), F.col("x"), F.col("y"), middle, at), edge(F.col("n") + 1, middle, at, F.col("x2"), F.col("y2")))
    cut = steps.withColumn("n", before).select(*keys, "idx", F.explode(F.when(F.col("cut_here"), halves).otherwise(F.array(whole))).alias("e"))
    return cut.select(*keys, "e.piece", "idx", "e.x1", "e.y1", "e.x2", "e.y2")


def unshadowed(edges: DataFrame) -> DataFrame:
    """edges (raster, level, line, piece, idx, x1..y2), each clipped to what longest_shadows leaves its piece along y."""
    reach = edges.groupBy("raster", "level", "line", "piece").agg(F.min(F.least("y1", "y2")).alias("lo"), F.max(F.greatest("y1", "y2")).alias("hi")).where("hi > lo")
    named = reach.withColumn("id", F.row_number().over(Window.partitionBy("raster").orderBy("level", "line", "piece")).cast("long"))
    taken = fi.longest_shadows(named.select(F.col("raster").alias("line"), "id", "lo", "hi")).select(F.col("line").alias("raster"), "id", "lo", "hi")
    of = edges.join(named.select("raster", "level", "line", "piece", "id"), ["raster", "level", "line", "piece"]).join(taken, ["raster", "id"])
    rise = F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0))
    ends = [(F.col(k) - F.col("y1")) / rise for k in ("lo", "hi")]
    flat = F.col("y1").between(F.col("lo"), F.col("hi"))
    a = F.when(rise.isNull(), F.when(flat, 0.0)).otherwise(F.greatest(F.lit(0.0), F.least(*ends)))
    b = F.when(rise.isNull(), F.when(flat, 1.0)).otherwise(F.least(F.lit(1.0), F.greatest(*ends)))
    at = lambda n, t: F.col(f"{n}1") + t * (F.col(f"{n}2") - F.col(f"{n}1"))
    kept = of.withColumns({"a": a, "b": b}).where("a < b")
    return kept.select("raster", "level", "line", "piece", "idx", at("x", F.col("a")).alias("x1"), at("y", F.col("a")).alias("y1"), at("x", F.col("b")).alias("x2"), at("y", F.col("b")).alias("y2"))


def spacings(corridors: DataFrame, spacing: tuple[float, float]) -> DataFrame:
    """(graph, sy, sx): lengths of a step along each corridor and across it, of those of a row and a column."""
    along = F.col("axis") == "y"
    return corridors.select(F.col("corridor").alias("graph"), *[F.when(along, spacing[i]).otherwise(spacing[1 - i]).alias(n) for i, n in ((0, "sy"), (1, "sx"))])


def half_pixel_graph(edges: DataFrame, scales: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (graph, id, r, c, x, y) and edges (graph, u, v, w) of edges (raster, level, line, piece, idx, x1..y2): ends merge on a grid of half
    pixels and keep the first one's place; x, y and w are lengths by scales (graph, sy, sx)."""
    seq = lambda end: F.struct("level", "line", "piece", "idx", F.lit(end).alias("end"))
    ends = F.explode(F.array(*[F.struct(seq(i).alias("seq"), F.col(f"y{i + 1}").alias("r"), F.col(f"x{i + 1}").alias("c")) for i in (0, 1)]))
    points = edges.select(F.col("raster").alias("graph"), ends.alias("p")).select("graph", "p.seq", "p.r", "p.c")
    number = lambda r, c: (F.rint(F.col(r) * 2).cast("long") * KEY + F.rint(F.col(c) * 2).cast("long"))
    nodes = mapping.quantised_nodes(points, 2.0).join(scales, "graph")
    nodes = nodes.select("graph", (F.col("kr") * KEY + F.col("kc")).alias("id"), "r", "c", (F.col("c") * F.col("sx")).alias("x"), (F.col("r") * F.col("sy")).alias("y"))
    keyed = edges.select(F.col("raster").alias("graph"), number("y1", "x1").alias("p"), number("y2", "x2").alias("q")).where("p <> q")
    pairs = keyed.select("graph", F.least("p", "q").alias("u"), F.greatest("p", "q").alias("v")).distinct()
    from_, to = (nodes.select("graph", F.col("id").alias(n), F.col("x").alias(f"{n}x"), F.col("y").alias(f"{n}y")) for n in "uv")
    w = F.sqrt(F.pow(F.col("ux") - F.col("vx"), 2) + F.pow(F.col("uy") - F.col("vy"), 2))
    return nodes, pairs.join(from_, ["graph", "u"]).join(to, ["graph", "v"]).select("graph", "u", "v", w.alias("w"))


def detours(points: DataFrame, edges: DataFrame, radius: float, alpha: float) -> DataFrame:
    """(graph, u, v, d): pairs of points (graph, id, x, y) within the radius for which going by the edges (graph, u, v, w) is longer than alpha
    times the straight way, or impossible. Weights are lengths, at least the straight ways.

    A search from u need not go further than alpha * radius, so the plane is cut into squares with a halo of that: a task holds a square's
    pairs and the edges around them, whatever the graph's size.
    """
    reach = alpha * radius
    side = max(4 * reach, 1e-9)
    square = lambda a, move=0.0: F.floor((F.col(a) + move) / side).cast("long")
    around = lambda a: F.explode(F.sequence(square(a, -reach), square(a, reach)))
    near_by = points.withColumn("i", around("x")).withColumn("j", around("y")).select("graph", "id", "i", "j")
    kept = edges.where("u <> v").join(shuffled(near_by.withColumnRenamed("id", "u")), ["graph", "u"]).join(shuffled(near_by.withColumnRenamed("id", "v")), ["graph", "v", "i", "j"])
    own = points.select("graph", F.col("id").alias("u"), square("x").alias("i"), square("y").alias("j"))
    pairs = near.near_pairs(points, radius, "graph").where("d > 0").join(shuffled(own), ["graph", "u"])
    rows = pairs.select("graph", "i", "j", "u", "v", F.col("d").alias("w"), F.lit(True).alias("asked")).unionByName(kept.select("graph", "i", "j", "u", "v", "w", F.lit(False).alias("asked")))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        asked = rows["asked"].to_numpy()
        ways: dict[int, list[tuple[int, float]]] = {}
        for u, v, w in rows.loc[~asked, ["u", "v", "w"]].itertuples(index=False):
            ways.setdefault(u, []).append((v, w))
            ways.setdefault(v, []).append((u, w))
        pairs, longer = rows.loc[asked, ["graph", "u", "v", "w"]], []
        for u, group in pairs.groupby("u", sort=True):
            limit = alpha * group["w"].max()
            far = _searched(ways, [int(u)], limit)[0]
            longer.append(group[[far.get(v, np.inf) > alpha * d for v, d in zip(group["v"], group["w"], strict=True)]])
        return pd.concat(longer).rename(columns={"w": "d"}) if longer else pd.DataFrame(columns=["graph", "u", "v", "d"])

    kind = points.schema["graph"].dataType.simpleString()
    return rows.groupBy("graph", "i", "j").applyInPandas(run, f"graph {kind}, u long, v long, d double")


def _searched(ways: dict[int, list[tuple[int, float]]], starts: list[int], limit: float = np.inf) -> tuple[dict[int, float], dict[int, int]]:
    """Distances from the nearest start, up to a limit, and the node before each (of equals the one that was settled first)."""
    settled: dict[int, float] = {}
    came: dict[int, int] = {}
    heap = [(0.0, s, s) for s in starts]
    while heap:
        d, node, before = heapq.heappop(heap)
        if node in settled:
            continue
        settled[node], came[node] = d, before
        for other, w in ways.get(node, ()):
            if other not in settled and d + w <= limit:
                heapq.heappush(heap, (d + w, other, node))
    return settled, came


def _parts(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least node of each node's part, by lowering labels along edges and jumping to the label's label."""
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, u, label[v])
        np.minimum.at(low, v, label[u])
        low = low[low]
        if (low == label).all():
            return label
        label = low


def bridged(x: np.ndarray, y: np.ndarray, u: np.ndarray, v: np.ndarray, block: int = 512) -> list[tuple[int, int, float]]:
    """The shortest links (a, b, length) between points that make one part of what edges (u, v) leave apart: in each round every part is
    linked to the nearest point of another, of equals the one with the least numbers."""
    out: list[tuple[int, int, float]] = []
    u, v = np.asarray(u, np.int64), np.asarray(v, np.int64)
    while len(parts := np.unique(label := _parts(len(x), u, v))) > 1:
        best: dict[int, tuple[float, int, int]] = {}
        for begin in range(0, len(x), block):
            rows = np.arange(begin, min(len(x), begin + block))
            d = np.hypot(x[rows, None] - x, y[rows, None] - y)
            d[label[rows, None] == label] = np.inf
            to = d.argmin(1)
            for i, j, far in zip(rows.tolist(), to.tolist(), d[np.arange(len(rows)), to].tolist(), strict=True):
                key = (far, min(i, j), max(i, j))
                best[label[i]] = min(best.get(label[i], key), key)
        fresh = sorted({best[p] for p in parts.tolist()})
        taken = []
        for far, i, j in fresh:  # equal lengths may close a ring: each link must join two parts
            now = _parts(len(x), np.append(u, [t[1] for t in taken]).astype(np.int64), np.append(v, [t[2] for t in taken]).astype(np.int64)) if taken else label
            if now[i] != now[j]:
                taken.append((far, i, j))
        u, v = np.append(u, [t[1] for t in taken]), np.append(v, [t[2] for t in taken])
        out += [(i, j, far) for far, i, j in taken]
    return out


def seam_graph(cells: DataFrame, corridors: DataFrame, side: int, fine: float, coarse: float, threshold: float, turn: float, radius: float, alpha: float, spacing: tuple[float, float] = (1.0, 1.0)) -> tuple[DataFrame, DataFrame]:
    """Nodes (graph, id, r, c, x, y) and edges (graph, u, v, w) of corridors' contours with their shortcuts. Levels are multiples of fine up to the
    threshold, of coarse above it; a line that turns back by turn (rows) is cut; radius is a length."""
    from cragline.session import written

    lines = contours.contour_lines(crops(cells, corridors), side, fine)
    lines = lines.where((F.col("level") <= threshold) | (F.pmod(F.col("level"), F.lit(coarse)) == 0))
    nodes, edges = half_pixel_graph(written(unshadowed(written(split_edges(lines, turn, "raster", "level"), "seam-pieces")), "seam-edges"), spacings(corridors, spacing))
    nodes, edges = written(nodes, "seam-nodes"), written(edges, "seam-ways")
    more = detours(nodes, edges, radius, alpha).withColumnRenamed("d", "w")
    return nodes, edges.unionByName(more)


def paths(nodes: DataFrame, edges: DataFrame, corridors: DataFrame, spacing: tuple[float, float] = (1.0, 1.0), step: float = 1.0) -> DataFrame:
    """(corridor, raster, seq, r, c, cost, reason): each corridor's least-cost path over its graph, from its first row to its last, in the
    raster's rows and columns; cost is the length so far. Ways longer than step get points between. A corridor without a path is one row
    with a reason.

    Parts are bridged by their shortest links; the node nearest to either border, if it isn't on it, is led there straight.
    """
    size = F.when(F.col("axis") == "y", F.col("r1") - F.col("r0")).otherwise(F.col("c1") - F.col("c0"))
    wanted = corridors.select(F.col("corridor").alias("graph"), size.cast("long").alias("u")).join(spacings(corridors, spacing), "graph")
    wanted = wanted.select("graph", "u", F.col("sy").alias("r"), F.col("sx").alias("c"), F.lit("corridor").alias("kind"))
    rows = wanted.unionByName(nodes.select("graph", F.col("id").alias("u"), "r", "c", F.lit("node").alias("kind")), True)
    rows = rows.unionByName(edges.select("graph", "u", "v", "w", F.lit("edge").alias("kind")), True)

    def failed(graph: int, reason: str) -> pd.DataFrame:
        return pd.DataFrame({"graph": [graph], "seq": pd.array([None], "Int64"), "a": [np.nan], "b": [np.nan], "cost": [np.nan], "reason": [reason]})

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        graph = rows["graph"].iloc[0]
        corridor = rows[rows["kind"] == "corridor"]
        if corridor.empty:
            return failed(graph, "no such corridor").iloc[:0]
        last, sy, sx = float(corridor["u"].iloc[0] - 1), corridor["r"].iloc[0], corridor["c"].iloc[0]
        found = rows[rows["kind"] == "node"].sort_values("u")
        if last < 1:
            return failed(graph, "no length")
        if found.empty:
            return failed(graph, "no contours")
        ids, r, c = (found[n].to_numpy() for n in ("u", "r", "c"))
        ids = ids.astype(np.int64)
        links = rows[rows["kind"] == "edge"]
        u, v = (np.searchsorted(ids, links[n].to_numpy().astype(np.int64)) for n in "uv")
        ways: dict[int, list[tuple[int, float]]] = {}

        def way(i: int, j: int, w: float) -> None:
            ways.setdefault(i, []).append((j, w))
            ways.setdefault(j, []).append((i, w))

        for i, j, w in zip(u.tolist(), v.tolist(), links["w"].tolist(), strict=True):
            way(i, j, w)
        for i, j, w in bridged(c * sx, r * sy, u, v):
            way(i, j, w)
        first, end = int(r.argmin()), int(r.argmax())
        for border, node in ((0.0, first), (last, end)):
            if abs(r[node] - border) > 1e-9:
                r, c = np.append(r, border), np.append(c, c[node])
                way(node, len(r) - 1, abs(r[node] - border) * sy)
                first, end = (len(r) - 1, end) if border == 0.0 else (first, len(r) - 1)
        far, came = _searched(ways, [first])
        if end not in far:
            return failed(graph, "no path")
        path = [end]
        while path[-1] != first:
            path.append(came[path[-1]])
        path.reverse()
        a, b, cost = [r[first]], [c[first]], [0.0]
        for i, j in zip(path, path[1:], strict=False):
            many = max(1, int(np.ceil((far[j] - far[i]) / step - 1e-9)))
            t = np.arange(1, many + 1) / many
            a += (r[i] + (r[j] - r[i]) * t).tolist()
            b += (c[i] + (c[j] - c[i]) * t).tolist()
            cost += (far[i] + (far[j] - far[i]) * t).tolist()
        return pd.DataFrame({"graph": graph, "seq": pd.array(range(len(a)), "Int64"), "a": a, "b": b, "cost": cost, "reason": None})

    kind = corridors.schema["corridor"].dataType.simpleString()
    found = rows.groupBy("graph").applyInPandas(run, f"graph {kind}, seq long, a double, b double, cost double, reason string")
    along = F.col("axis") == "y"
    placed = found.join(corridors.withColumnRenamed("corridor", "graph"), "graph")
    r, c = F.when(along, F.col("a")).otherwise(F.col("b")) + F.col("r0"), F.when(along, F.col("b")).otherwise(F.col("a")) + F.col("c0")
    some = lambda v: F.when(F.col("reason").isNull(), v)
    return placed.select(F.col("graph").alias("corridor"), "raster", "seq", some(r).alias("r"), some(c).alias("c"), some(F.col("cost")).alias("cost"), "reason")
