"""Graphs as edge tables (u, v, w). Iterations run to a fixpoint; each round's table goes to the shared folder, which ends lineage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cragline.operators import near
from cragline.session import discard, joining, shuffled, written

#: Tables of nodes met that a search by rounds reads at most.
MERGED = 8


def both_ways(edges: DataFrame) -> DataFrame:
    cols = [c for c in edges.columns if c not in ("u", "v")]
    return edges.select("u", "v", *cols).unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), *cols))


def components(edges: DataFrame) -> DataFrame:
    """(id, label): label is the least id of the component.

    In each round a node hooks to the node of least priority among itself, its neighbours and their neighbours, and edges are
    contracted: a star falls together at once. Priorities are hashes that change from round to round, so nodes fall by a constant
    factor even on a path with sorted ids. A node that many edges share is aggregated within map tasks first.
    """
    links = edges.select("u", "v").where("u <> v")
    hooks = []
    while True:
        priority = lambda c: F.xxhash64(F.lit(len(hooks)), c)
        ways = both_ways(links)
        near_least = ways.groupBy("u").agg(F.min_by("v", priority("v")).alias("v")).select(
            F.col("u").alias("v"), F.when(priority("v") < priority("u"), F.col("v")).otherwise(F.col("u")).alias("to")
        )  # the least of a node and its neighbours
        hook = ways.join(shuffled(near_least), "v").groupBy(F.col("u").alias("id")).agg(F.min_by("to", priority("to")).alias("to"))
        hook = written(hook, "hook")
        hooks.append(hook)
        named = [joining(hook.select(F.col("id").alias(p), F.col("to").alias(n))) for p, n in (("u", "a"), ("v", "b"))]
        moved = links.join(named[0], "u").join(named[1], "v")
        before, links = links, written(moved.where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "links")
        if len(hooks) > 1:
            discard(before)
        if links.isEmpty():
            break
    labels = hooks[0].withColumnRenamed("to", "label")
    for hook in hooks[1:]:
        labels = labels.join(joining(hook.select(F.col("id").alias("label"), "to")), "label", "left").select("id", F.coalesce("to", "label").alias("label"))
    least = labels.groupBy("label").agg(F.min("id").alias("least"))
    return labels.join(shuffled(least), "label").select("id", F.col("least").alias("label"))


def distances(edges: DataFrame, sources: DataFrame, cutoff: float | None = None) -> DataFrame:
    """(id, d, via): shortest distance from the nearest of sources (id), up to a cutoff, and the node before (least of equals).

    Rounds relax the edges of the nodes that improved in the round before, until none does. A round writes these nodes alone; the tables
    of every MERGED rounds become one.
    """
    ways = written(both_ways(edges.select("u", "v", "w")), "ways")
    front = written(sources.select("id", F.lit(0.0).alias("d")).distinct(), "front")
    known = [front]
    least = lambda tables: reduce(DataFrame.unionByName, tables).groupBy("id").agg(F.min("d").alias("d"))
    while True:
        tried = joining(front).join(ways, F.col("id") == F.col("u")).select(F.col("v").alias("id"), (F.col("d") + F.col("w")).alias("d"))
        tried = tried.where(F.col("d") <= cutoff) if cutoff is not None else tried
        tried = tried.groupBy("id").agg(F.min("d").alias("d"))
        better = tried.join(shuffled(least(known).withColumnRenamed("d", "had")), "id", "left").where("had IS NULL OR d < had").select("id", "d")
        front = written(better, "front")
        if front.isEmpty():
            break
        known.append(front)
        if len(known) > MERGED:
            known = [written(least(known), "known")]
    best = written(least(known), "best")
    came = ways.select(F.col("v").alias("id"), F.col("u").alias("via"), "w").join(shuffled(best.select(F.col("id").alias("via"), F.col("d").alias("dv"))), "via")
    came = came.join(shuffled(best), "id").where(F.abs(F.col("dv") + F.col("w") - F.col("d")) <= 1e-9 * (1 + F.col("d"))).where("d > 0")
    return best.join(shuffled(came.groupBy("id").agg(F.min("via").alias("via"))), "id", "left")


def two_core(edges: DataFrame) -> DataFrame:
    """Edges left after nodes of degree below two are taken away until none is.

    Nodes of degree one and two make chains; a chain that has an end goes as a whole, found by components. So a path is one round, and a
    tree as many as the logarithm of its nodes.
    """
    left = written(edges.select("u", "v"), "core")
    while True:
        degrees = written(both_ways(left).groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n <= 2").select(F.col("u").alias("id"), (F.col("n") < 2).alias("end")), "degrees")
        if degrees.where("end").isEmpty():
            return left
        low = degrees.select("id")
        inside = left.join(joining(low.withColumnRenamed("id", "u")), "u", "left_semi").join(joining(low.withColumnRenamed("id", "v")), "v", "left_semi")
        labels = written(components(inside), "chains")
        named = degrees.join(joining(labels), "id", "left").select("id", "end", F.coalesce("label", "id").alias("label"))
        gone = shuffled(named.join(shuffled(named.where("end").select("label").distinct()), "label", "left_semi").select("id"))
        kept = left.join(gone, left["u"] == gone["id"], "left_anti").join(gone, left["v"] == gone["id"], "left_anti")
        old, left = left, written(kept, "core")
        discard(old)


def spanning_forest(edges: DataFrame, joined: DataFrame | None = None) -> DataFrame:
    """Edges (u, v, w) of a minimum spanning forest by Boruvka's rounds; ties by (w, u, v), so it is unique. joined (id, label): nodes of a
    label count as one, so that only edges between labels are chosen."""
    left = edges.select("u", "v", "w", F.col("u").alias("a"), F.col("v").alias("b"))
    for end in ("a", "b") if joined is not None else ():
        named = joined.select(F.col("id").alias(end), F.col("label").alias("_to"))
        left = left.join(shuffled(named), end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
    left = written(left.where("a <> b"), "mst")
    chosen = None
    while not left.isEmpty():
        best = F.min(F.struct("w", "u", "v")).alias("e")
        ways = left.select("a", "w", "u", "v").union(left.select(F.col("b"), "w", "u", "v"))
        picked = written(ways.groupBy("a").agg(best).select("e.u", "e.v", "e.w").distinct(), "picked")
        chosen = picked if chosen is None else chosen.union(picked)
        hooked = joining(picked).join(left.select("u", "v", "w", "a", "b"), ["u", "v", "w"]).select(F.col("a").alias("u"), F.col("b").alias("v"))
        labels = written(components(hooked), "tree-labels")
        moved = left
        for end in ("a", "b"):
            moved = moved.join(joining(labels.select(F.col("id").alias(end), F.col("label").alias(f"_{end}"))), end)
        left = written(moved.where("_a <> _b").select("u", "v", "w", F.col("_a").alias("a"), F.col("_b").alias("b")), "mst")
    return (chosen if chosen is not None else left.select("u", "v", "w")).distinct()


def bridges(points: DataFrame, edges: DataFrame, radius: float) -> DataFrame:
    """(u, v, w): the least edges between points (id, x, y) within the radius that join what edges (u, v) leave apart, as far as can be."""
    pairs = near.near_pairs(points, radius).withColumnRenamed("d", "w")
    return spanning_forest(pairs, written(components(edges), "labels"))


def border_links(nodes: DataFrame, axis: str, low: float, high: float) -> DataFrame:
    """(graph, id, border, length) of nodes (graph, id, axis): of each graph the node nearest to either border of the axis (the least id of
    equals), and the straight way there; none where it lies on the border or beyond."""
    ends = nodes.groupBy("graph").agg(F.min(F.struct(F.col(axis).alias("at"), "id")).alias("first"), F.min(F.struct((-F.col(axis)).alias("at"), "id")).alias("last"))
    both = F.explode(F.array(
        F.struct(F.col("first.id").alias("id"), F.lit(low).alias("border"), (F.col("first.at") - low).alias("length")),
        F.struct(F.col("last.id").alias("id"), F.lit(high).alias("border"), (high + F.col("last.at")).alias("length")),
    )).alias("x")
    return ends.select("graph", both).select("graph", "x.*").where("length > 0")


def network_phases(reaches: DataFrame) -> DataFrame:
    """(id, root, begin, end) of reaches (id, down, len): each tributary ends when what receives it begins; the longest way of a
    network begins at 0 and its root ends at 1. An unknown down is a root; a cycle raises an error.

    Distances to the root come from doubling pointers, so rounds are the logarithm of the longest way.
    """
    known = reaches.select(F.col("id").alias("down"), F.lit(True).alias("known"))
    length = F.greatest("len", F.lit(1e-5))
    at = reaches.join(known, "down", "left").select(
        "id", F.when(F.col("known"), F.col("down")).alias("to"), F.when(F.col("known").isNull(), F.col("id")).alias("root"), length.alias("sum"), length.alias("len")
    )
    at = written(at, "phases")
    for _ in range(at.count().bit_length() + 1):
        if at.where("root IS NULL").isEmpty():
            break
        further = at.select(F.col("id").alias("to"), F.col("to").alias("to2"), F.col("root").alias("root2"), F.col("sum").alias("sum2"))
        doubled = F.col("sum") + F.coalesce("sum2", F.lit(0.0))
        old, at = at, written(at.join(further, "to", "left").select("id", F.col("to2").alias("to"), F.coalesce("root", "root2").alias("root"), doubled.alias("sum"), "len"), "phases")
        discard(old)
    else:
        if not at.where("root IS NULL").isEmpty():
            raise ValueError("the network has a cycle")
    spans = at.groupBy("root").agg(F.max("sum").alias("span"))
    begin = 1 - F.col("sum") / F.col("span")
    return at.join(spans, "root").select("id", "root", begin.alias("begin"), (begin + F.col("len") / F.col("span")).alias("end"))


def width_weights(q: DataFrame, column: str) -> DataFrame:
    """q with weight 0..1: log1p of the discharge over that of the 99.5th percentile (0.1 at least); what isn't finite counts 0."""
    clean = q.withColumn("_q", F.when(F.col(column).isNull() | F.isnan(column) | (F.abs(column) == float("inf")), 0.0).otherwise(F.greatest(F.col(column), F.lit(0.0))))
    top = clean.agg(F.greatest(F.percentile("_q", F.lit(0.995)), F.lit(0.1)).alias("_top"))
    weight = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.log1p("_q") / F.log1p("_top")))
    return clean.crossJoin(F.broadcast(top)).withColumn("weight", weight).drop("_q", "_top")


#: Parts that sides() deals to, for each of spark.sql.shuffle.partitions: a side takes few bytes in a shuffle and ten times as many in a table of counts.
SIDE_PARTS = 4


def sides(keyed: DataFrame, *keys: str) -> DataFrame:
    """keyed, shuffled by keys, to be counted by them. A task of the input holds few sides twice, so counts there would fill its memory for
    nothing."""
    return keyed.repartition(SIDE_PARTS * int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def shared_edges(rings: DataFrame) -> DataFrame:
    """(u, v, n) of rings (ring, idx, p), closed: edges that two rings or more have, whichever way they run."""
    w = Window.partitionBy("ring").orderBy("idx")
    first = F.first("p").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    edges = rings.select("ring", "p", F.coalesce(F.lead("p").over(w), first).alias("q")).where("p <> q")
    keyed = edges.select("ring", F.least("p", "q").alias("u"), F.greatest("p", "q").alias("v")).distinct()
    return sides(keyed, "u", "v").groupBy("u", "v").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


def shared_edges_of(rings: DataFrame) -> DataFrame:
    """shared_edges() of rings that are a row each, ps their points in order: no ring is shuffled, only its edges."""
    onward = F.concat(F.slice("ps", 2, F.size("ps")), F.slice("ps", 1, 1))
    edges = F.array_distinct(F.zip_with("ps", onward, lambda p, q: F.when(p != q, F.struct(F.least(p, q).alias("u"), F.greatest(p, q).alias("v")))))
    keyed = rings.select(F.explode(F.array_compact(edges)).alias("e")).select("e.u", "e.v")
    return sides(keyed, "u", "v").groupBy("u", "v").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


def boundary_edges(triangles: DataFrame) -> DataFrame:
    """(u, v) of triangles (a, b, c): edges that one triangle alone has; none on a watertight mesh."""
    three = F.explode(F.array(F.struct(F.col("a").alias("p"), F.col("b").alias("q")), F.struct(F.col("b").alias("p"), F.col("c").alias("q")), F.struct(F.col("c").alias("p"), F.col("a").alias("q")))).alias("s")
    keyed = triangles.select(three).select(F.least("s.p", "s.q").alias("u"), F.greatest("s.p", "s.q").alias("v"))
    return sides(keyed, "u", "v").groupBy("u", "v").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("u", "v")
