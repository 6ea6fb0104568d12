"""Where seams cross: each crossing is laid anew so that both seams share as much as they can without running in rings, and the lines are
spliced with what replaces their sections.

A junction's two sections, from top to bottom and from left to right, become one graph with its shortcuts and bridges. Least-cost paths
join neighbouring ends around the middle: four quadrants. A ring that none of the ends is part of lies between two quadrants; it is
added to the one that shares most with it, edge by edge, so that its other side is given up. The new sections are the paths over what the
quadrants have left.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cragline.operators import plane, seams
from cragline.session import written

#: Rounds of a junction's rings; each takes at least one away.
ROUNDS = 200


def rings_of(edges: set[tuple[int, int]]) -> list[set[tuple[int, int]]]:
    """Of undirected edges (u < v) those that no peeling of ends takes away, by connected parts."""
    beside: dict[int, set[int]] = {}
    for u, v in edges:
        beside.setdefault(u, set()).add(v)
        beside.setdefault(v, set()).add(u)
    loose = [n for n, others in beside.items() if len(others) == 1]
    while loose:
        n = loose.pop()
        for other in beside.pop(n, ()):
            beside[other].discard(n)
            if len(beside[other]) == 1:
                loose.append(other)
    parts, seen = [], set()
    for n in sorted(k for k, others in beside.items() if others):
        if n in seen:
            continue
        reach, part = [n], set()
        seen.add(n)
        while reach:
            at = reach.pop()
            part |= {(min(at, o), max(at, o)) for o in beside[at]}
            fresh = beside[at] - seen
            seen |= fresh
            reach += fresh
        parts.append(part)
    return parts


def _edges_of(path: list[int]) -> set[tuple[int, int]]:
    return {(min(p, q), max(p, q)) for p, q in zip(path, path[1:], strict=False)}


def _path(ways: dict[int, list[tuple[int, float]]], start: int, end: int) -> list[int] | None:
    came = seams._searched(ways, [start])[1]
    if end not in came:
        return None
    path = [end]
    while path[-1] != start:
        path.append(came[path[-1]])
    return path[::-1]


def untangled(ways: dict[int, list[tuple[int, float]]], ends: tuple[int, int, int, int]) -> tuple[list[int], list[int]] | str:
    """The paths from top to bottom and from left to right over the quadrants' edges; or why there are none. ends: top, right, bottom, left."""
    quadrants = []
    for p, q in zip(ends, ends[1:] + ends[:1], strict=True):
        path = _path(ways, p, q)
        if path is None:
            return "no path between two ends"
        quadrants.append(_edges_of(path))
    length = {(min(u, v), max(u, v)): w for u, others in ways.items() for v, w in others}
    for _ in range(ROUNDS):
        loose = [ring for ring in rings_of(set().union(*quadrants)) if not {n for e in ring for n in e} & set(ends)]
        if not loose:
            break
        for ring in loose:
            nodes = {n for e in ring for n in e}
            share = [(len(nodes & {n for e in q for n in e}), sum(length[e] for e in q & ring), -i) for i, q in enumerate(quadrants)]
            quadrants[-max(share)[2]] ^= ring
    else:
        return "rings without end"
    left: dict[int, list[tuple[int, float]]] = {}
    for u, v in sorted(set().union(*quadrants)):
        left.setdefault(u, []).append((v, length[u, v]))
        left.setdefault(v, []).append((u, length[u, v]))
    down, across = _path(left, ends[0], ends[2]), _path(left, ends[3], ends[1])
    return (down, across) if down and across else "no path over what is left"


def junction_paths(sections: DataFrame, radius: float, alpha: float, spacing: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """(junction, kind, seq, r, c, reason) of sections (junction, kind, idx, r, c), kind 'v' (down) or 'h' (across): what replaces them. A
    junction that fails is one row with a reason. radius and alpha are of shortcuts (seams.detours), a row and a column so long."""
    order = Window.partitionBy("junction", "kind").orderBy("idx")
    steps = sections.withColumns({"x2": F.lead("c").over(order), "y2": F.lead("r").over(order)}).where("x2 IS NOT NULL")
    edges = steps.select(F.col("junction").alias("raster"), F.lit(0.0).alias("level"), F.col("kind").alias("line"), F.lit(0).alias("piece"), "idx", F.col("c").alias("x1"), F.col("r").alias("y1"), "x2", "y2")
    scales = sections.select(F.col("junction").alias("graph")).distinct().select("graph", F.lit(spacing[0]).alias("sy"), F.lit(spacing[1]).alias("sx"))
    nodes, ways = (written(df, "junctions") for df in seams.half_pixel_graph(edges, scales))
    ways = ways.unionByName(seams.detours(nodes, ways, radius, alpha).withColumnRenamed("d", "w"))

    key = F.rint(F.col("r") * 2).cast("long") * seams.KEY + F.rint(F.col("c") * 2).cast("long")
    least = lambda kind, by: F.min(F.when(F.col("kind") == kind, F.struct(by.alias("by"), "idx", "key")))["key"]
    ends = sections.withColumn("key", key).groupBy("junction").agg(
        least("v", F.col("r")).alias("e0"), least("h", -F.col("c")).alias("e1"), least("v", -F.col("r")).alias("e2"), least("h", F.col("c")).alias("e3")
    )
    rows = ends.select(F.col("junction").alias("graph"), F.posexplode(F.array("e0", "e1", "e2", "e3")).alias("v", "u"), F.lit("end").alias("kind"))
    rows = rows.select("graph", "u", F.col("v").cast("long").alias("v"), "kind").unionByName(nodes.select("graph", F.col("id").alias("u"), "r", "c", "x", "y", F.lit("node").alias("kind")), True)
    rows = rows.unionByName(ways.select("graph", "u", "v", "w", F.lit("way").alias("kind")), True)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        graph = rows["graph"].iloc[0]
        failed = lambda reason: pd.DataFrame({"junction": [graph], "kind": [None], "seq": pd.array([None], "Int64"), "r": [np.nan], "c": [np.nan], "reason": [reason]})
        found = rows[rows["kind"] == "node"].sort_values("u")
        ids = found["u"].to_numpy().astype(np.int64)
        ends = rows[rows["kind"] == "end"].sort_values("v")["u"]
        if ends.isna().any() or not set(ends.astype(np.int64)) <= set(ids.tolist()):
            return failed("a section has no step")
        links = rows[rows["kind"] == "way"]
        u, v = (np.searchsorted(ids, links[n].to_numpy().astype(np.int64)) for n in "uv")
        every = list(zip(u.tolist(), v.tolist(), links["w"].tolist(), strict=True)) + seams.bridged(found["x"].to_numpy(), found["y"].to_numpy(), u, v)
        ways: dict[int, list[tuple[int, float]]] = {}
        for i, j, w in every:
            ways.setdefault(i, []).append((j, w))
            ways.setdefault(j, []).append((i, w))
        paths = untangled(ways, tuple(np.searchsorted(ids, ends.to_numpy().astype(np.int64)).tolist()))
        if isinstance(paths, str):
            return failed(paths)
        r, c = found["r"].to_numpy(), found["c"].to_numpy()
        return pd.concat([pd.DataFrame({"junction": graph, "kind": kind, "seq": pd.array(range(len(p)), "Int64"), "r": r[p], "c": c[p], "reason": None}) for kind, p in zip("vh", paths, strict=True)])

    kind = sections.schema["junction"].dataType.simpleString()
    return rows.groupBy("graph").applyInPandas(run, f"junction {kind}, kind string, seq long, r double, c double, reason string")


def spliced(lines: DataFrame, replacements: DataFrame) -> DataFrame:
    """(line, idx, r, c) of lines (line, idx, r, c) with the points first..last of each of replacements (line, id, first, last, seq, r, c)
    replaced, numbered anew. A replacement is turned if its ends then lie nearer to those of the section; of replacements that begin before
    an earlier one (by first, then id) has ended only the earlier counts; a point equal to the one before is left out."""
    spans = replacements.select("line", "id", "first", "last").distinct().where("first <= last")
    order = Window.partitionBy("line").orderBy("first", "id")
    spans = spans.withColumn("reach", F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))).where("reach IS NULL OR first > reach").drop("reach")
    place = F.struct("r", "c")
    ends = replacements.groupBy("line", "id").agg(F.min_by(place, "seq").alias("a"), F.max_by(place, "seq").alias("b"), F.max("seq").alias("n"))
    at = lines.select("line", "idx", place.alias("p"))
    spans = spans.join(ends, ["line", "id"]).join(at.withColumnsRenamed({"idx": "first", "p": "f"}), ["line", "first"]).join(at.withColumnsRenamed({"idx": "last", "p": "l"}), ["line", "last"])
    away = lambda p, q: F.sqrt(F.pow(F.col(f"{p}.r") - F.col(f"{q}.r"), 2) + F.pow(F.col(f"{p}.c") - F.col(f"{q}.c"), 2))
    spans = written(spans.select("line", "id", "first", "last", (away("a", "f") + away("b", "l") > away("b", "f") + away("a", "l")).alias("turned")), "spans")

    # a point is kept unless the last span that begins at it or before it reaches it
    marks = lines.select("line", "idx", "r", "c", F.lit(None).cast("long").alias("until")).unionByName(spans.select("line", F.col("first").alias("idx"), F.lit(None).cast("double").alias("r"), F.lit(None).cast("double").alias("c"), F.col("last").cast("long").alias("until")))
    upto = Window.partitionBy("line").orderBy("idx").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    kept = marks.withColumn("held", F.max("until").over(upto)).where("r IS NOT NULL AND (held IS NULL OR idx > held)").select("line", F.col("idx").cast("long").alias("o"), F.lit(0).cast("long").alias("seq"), "r", "c")
    fresh = replacements.join(spans, ["line", "id", "first", "last"]).select("line", F.col("first").cast("long").alias("o"), F.when(F.col("turned"), -F.col("seq")).otherwise(F.col("seq")).cast("long").alias("seq"), "r", "c")
    along = Window.partitionBy("line").orderBy("o", "seq")
    every = kept.unionByName(fresh).withColumns({"br": F.lag("r").over(along), "bc": F.lag("c").over(along)}).where("br IS NULL OR br <> r OR bc <> c")
    return every.select("line", (F.row_number().over(along) - 1).alias("idx"), "r", "c")


def refined(lines: DataFrame, crossings: DataFrame, half_width: float, radius: float, alpha: float, spacing: tuple[float, float] = (1.0, 1.0)) -> tuple[DataFrame, DataFrame]:
    """Lines (line, idx, r, c) laid anew within squares around crossings (junction, v, h, r, c), where line v goes down and h across; and
    (junction, reason) of those that failed, whose lines stay as they are."""

    def section(kind: str) -> tuple[DataFrame, Column]:
        of = crossings.select("junction", F.col(kind).alias("of"), F.col("r").alias("mr"), F.col("c").alias("mc"))
        near = of.join(lines, of["of"] == lines["line"]).select(F.struct("junction", "of").alias("line"), "idx", F.col("c").alias("x"), F.col("r").alias("y"), (F.col("mc") - half_width).alias("x0"), (F.col("mr") - half_width).alias("y0"))
        return near, plane.sections_in_square(near, F.col("x0"), F.col("y0"), 2 * half_width).select("line.junction", "line.of", F.lit(kind).alias("kind"), "first", "last")

    spans = written(section("v")[1].unionByName(section("h")[1]), "sections")
    points = spans.join(lines.withColumnRenamed("line", "of"), "of").where("idx BETWEEN first AND last").select("junction", "kind", "idx", "r", "c")
    both = points.groupBy("junction").agg(F.count_distinct("kind").alias("n")).where("n = 2").select("junction")
    found = written(junction_paths(points.join(both, "junction", "left_semi"), radius, alpha, spacing), "replacements")
    new = found.where("reason IS NULL").join(spans, ["junction", "kind"]).select(F.col("of").alias("line"), F.col("junction").alias("id"), "first", "last", "seq", "r", "c")
    apart = crossings.select("junction").join(both, "junction", "left_anti").select("junction", F.lit("a seam doesn't pass the square").alias("reason"))
    return spliced(lines, new), found.where("reason IS NOT NULL").select("junction", "reason").unionByName(apart)
