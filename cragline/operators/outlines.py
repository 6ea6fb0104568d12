"""Points and outlines: which points lie inside, and how far each is from the nearest side.

Sides are (x1, y1, x2, y2); any number of closed rings, in any order. A point is inside if a line to its right crosses an odd number of
sides. Only sides in a point's own square are crossed one by one; those wholly to its right are counted by running sums of where they begin
and end. The nearest side is looked for from large boxes of sides down to small ones, of which those that may hold it are kept.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cragline.session import joining, shuffled, written

#: Points that ask the sides of one small box in one go; more of them are dealt with copies of these sides.
ASKING = 50_000


def sides_of(rings: DataFrame) -> DataFrame:
    """(x1, y1, x2, y2) of rings (ring, idx, x, y), closed; sides without length are left out."""
    w = Window.partitionBy("ring").orderBy("idx")
    ends = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sides = rings.select(F.col("x").alias("x1"), F.col("y").alias("y1"), *[F.coalesce(F.lead(a).over(w), F.first(a).over(ends)).alias(f"{a}2") for a in "xy"])
    return sides.where("x1 <> x2 OR y1 <> y2")


def _box(sides: DataFrame):
    """One row: least and greatest x and y, and how many sides; null without sides."""
    return sides.agg(F.min(F.least("x1", "x2")).alias("x0"), F.max(F.greatest("x1", "x2")).alias("x1"), F.min(F.least("y1", "y2")).alias("y0"), F.max(F.greatest("y1", "y2")).alias("y1"), F.count(F.lit(1)).alias("n")).first()


def _sound(points: DataFrame) -> DataFrame:
    return points.where("abs(x) < double('infinity') AND abs(y) < double('infinity')").select("id", "x", "y")


def inside(points: DataFrame, sides: DataFrame, band: float) -> DataFrame:
    """(id, inside) of points (id, x, y); a point on a side may count either way.

    Points and sides meet in squares as wide as band. Sides in the columns to the right of a point's count where they begin at its y or below
    and end above it: these columns are the union of a few aligned stretches (one, two, four, ... columns), and in each stretch of a band
    a running sum along y tells.
    """
    box = _box(sides)
    if box["x0"] is None:
        return points.select("id", F.lit(False).alias("inside"))
    first, bottom, top = (math.floor(box[k] / band) for k in ("x0", "y0", "y1"))
    levels = (math.floor(box["x1"] / band) - first + 1).bit_length()
    at = lambda v, begin=0: (F.floor(v / band) - begin).cast("long")
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    met = _sound(points).where((F.col("x") <= box["x1"]) & F.col("y").between(box["y0"], box["y1"]))
    met = met.select("id", "x", "y", F.greatest(at(F.col("x"), first), F.lit(-1)).alias("i"), at(F.col("y")).alias("j"))
    crossing = sides.where("y1 <> y2").select("*", at(F.least("x1", "x2"), first).alias("i0"), at(F.greatest("x1", "x2"), first).alias("i1"), at(low).alias("j0"), at(high).alias("j1"))

    # in each band a side counts from its lower end, or the band's, up to its upper end
    bands = crossing.select("i0", "j0", "j1", low.alias("low"), high.alias("high"), F.explode(F.sequence("j0", "j1")).alias("j"))
    ends = F.explode(F.array(
        F.struct(F.when(F.col("j") > F.col("j0"), float("-inf")).otherwise(F.col("low")).alias("y"), F.lit(1).alias("n")),
        F.struct(F.when(F.col("j") < F.col("j1"), float("inf")).otherwise(F.col("high")).alias("y"), F.lit(-1).alias("n")),
    )).alias("e")
    steps = bands.select("j", "i0", ends).select("j", "i0", "e.y", "e.n").where("y < double('infinity')").groupBy("j", "i0", "y").agg(F.sum("n").alias("n"))
    stretches = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright("i0", k).alias("node")) for k in range(levels + 1)])).alias("s")
    steps = steps.select("j", "y", "n", stretches).groupBy("j", "s.level", "s.node", "y").agg(F.sum("n").alias("n"))
    after = F.col("i") + 1
    begins = [F.shiftright(after + ((1 << k) - 1), k) for k in range(levels + 1)]
    wanted = [F.when((b % 2 == 1) if k < levels else (after == 0), F.struct(F.lit(k).alias("level"), b.alias("node"))) for k, b in enumerate(begins)]
    asked = met.select("id", "y", "j", F.explode(F.array_compact(F.array(*wanted))).alias("s")).select("j", "s.level", "s.node", "y", F.lit(0).cast("long").alias("n"), "id")
    upto = Window.partitionBy("j", "level", "node").orderBy("y").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    right = asked.unionByName(steps.withColumn("id", F.lit(None).cast(points.schema["id"].dataType))).withColumn("n", F.sum("n").over(upto)).where("id IS NOT NULL").select("id", "n")

    own = crossing.withColumn("j", F.explode(F.sequence("j0", "j1"))).withColumn("i", F.explode(F.sequence("i0", "i1"))).select("i", "j", "x1", "y1", "x2", "y2")
    crossed = met.join(own, ["i", "j"]).where((F.col("y1") > F.col("y")) != (F.col("y2") > F.col("y")))
    crossed = crossed.where(F.col("x") < F.col("x1") + (F.col("y") - F.col("y1")) / (F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1")))
    odd = right.unionByName(crossed.select("id", F.lit(1).cast("long").alias("n"))).groupBy("id").agg((F.sum("n") % 2 == 1).alias("odd"))
    return points.select("id").join(shuffled(odd), "id", "left").select("id", F.coalesce("odd", F.lit(False)).alias("inside"))


def _reach(x: Column, y: Column) -> tuple[Column, Column]:
    """Squares of the least distance to a box (lx, hx, ly, hy), and of one within which there is a side: each face of the box touches one."""
    gap = lambda v, a: F.greatest(F.lit(0.0), F.col(f"l{a}") - v, v - F.col(f"h{a}"))
    below = lambda v, a: v + v <= F.col(f"l{a}") + F.col(f"h{a}")
    near = lambda v, a: F.when(below(v, a), v - F.col(f"l{a}")).otherwise(v - F.col(f"h{a}"))
    far = lambda v, a: F.when(below(v, a), v - F.col(f"h{a}")).otherwise(v - F.col(f"l{a}"))
    square = lambda v, w: v * v + w * w
    return square(gap(x, "x"), gap(y, "y")), F.least(square(near(x, "x"), far(y, "y")), square(far(x, "x"), near(y, "y")))


def candidates(points: DataFrame, placed: DataFrame) -> DataFrame:
    """(id, x, y, i, j): for each of points (id, x, y) the squares (i, j) that may hold its nearest side, of placed sides (i, j, x1, y1, x2, y2).

    Four squares make one of the next level, up to one or few that hold all. From there down a point keeps the squares whose box begins
    no further away than another one's box surely has a side.
    """
    least, most = (lambda a: F.min(F.least(f"{a}1", f"{a}2"))), (lambda a: F.max(F.greatest(f"{a}1", f"{a}2")))
    boxes = [f"{e}{a}" for a in "xy" for e in "lh"]
    leaves = placed.groupBy("i", "j").agg(least("x").alias("lx"), most("x").alias("hx"), least("y").alias("ly"), most("y").alias("hy"))
    levels = [written(leaves, "side-boxes")]
    spread = levels[0].agg(*[f(a).alias(f"{n}{a}") for a in "ij" for n, f in (("l", F.min), ("h", F.max))]).first()
    while any(spread[f"h{a}"] >> (len(levels) - 1) > (spread[f"l{a}"] >> (len(levels) - 1)) + 1 for a in "ij"):
        up = levels[-1].groupBy(*[F.shiftright(a, 1).alias(a) for a in "ij"]).agg(*[(F.min if b[0] == "l" else F.max)(b).alias(b) for b in boxes])
        levels.append(written(up, "side-boxes"))
    kept = points.repartition("id").crossJoin(F.broadcast(levels[-1]))  # four rows at most
    for k in range(len(levels) - 1, -1, -1):
        if k < len(levels) - 1:
            kept = kept.join(joining(levels[k].select(F.shiftright("i", 1).alias("_i"), F.shiftright("j", 1).alias("_j"), "i", "j", *boxes)), ["_i", "_j"])
        begin, sure = _reach(F.col("x"), F.col("y"))
        kept = kept.withColumns({"_begin": begin, "_sure": F.min(sure).over(Window.partitionBy("id"))}).where(F.col("_begin") <= F.col("_sure") * (1 + 1e-9))
        kept = kept.select("id", "x", "y", F.col("i").alias("_i"), F.col("j").alias("_j"))
    return kept.withColumnsRenamed({"_i": "i", "_j": "j"})


def distances(points: DataFrame, sides: DataFrame, cell: float) -> DataFrame:
    """(id, d) of points (id, x, y): the distance to the nearest side, whether inside or not; null where there are no sides or no place.

    Sides lie in the square of their middle, as wide as cell, or down to a quarter of it where squares would hold many.
    """
    box = _box(sides)
    if box["x0"] is None:
        return points.select("id", F.lit(None).cast("double").alias("d"))
    few = math.sqrt(8 * max((box["x1"] - box["x0"]) * (box["y1"] - box["y0"]), 1e-300) / box["n"])
    size = cell / 2 ** min(2, max(0, math.ceil(math.log2(cell / few))))
    square = lambda a: F.floor((F.col(f"{a}1") + F.col(f"{a}2")) / (2 * size)).cast("long")
    placed = written(sides.select(square("x").alias("i"), square("y").alias("j"), "x1", "y1", "x2", "y2"), "outline-sides")
    asked = written(candidates(_sound(points), placed), "outline-asked")
    # squares that many points ask are copied, and the points are dealt among the copies
    copies = written(asked.groupBy("i", "j").agg(F.ceil(F.count(F.lit(1)) / ASKING).alias("copies")), "outline-copies")
    wanted = placed.join(joining(copies), ["i", "j"]).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).drop("copies")
    dealt = asked.join(joining(copies), ["i", "j"]).withColumn("copy", F.pmod(F.xxhash64("id"), F.col("copies"))).drop("copies")
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("x") - F.col("x1")) * dx + (F.col("y") - F.col("y1")) * dy) / (dx * dx + dy * dy)))
    d = F.sqrt(F.pow(F.col("x") - F.col("x1") - t * dx, 2) + F.pow(F.col("y") - F.col("y1") - t * dy, 2))
    found = dealt.join(shuffled(wanted), ["i", "j", "copy"]).groupBy("id").agg(F.min(d).alias("d"))
    return points.select("id").join(shuffled(found), "id", "left")
