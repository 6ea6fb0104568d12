"""Whole groups, many in one call."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cragline.operators import contours, graph, plane
from cragline.operators import fields as fi
from cragline.operators.batches import by_groups


def test_groups_come_whole_and_many_at_once(spark):
    rng = random.Random(4)
    rows = [(None if g == 7 else g, "ab"[g % 2], rng.random()) for g in range(200) for _ in range(rng.choice((1, 2, 30, 120)))]

    def run(table: pa.Table) -> pa.Table:
        return table.append_column("call", pa.array(np.full(len(table), hash(table.column("v")[0].as_py()))))

    found = by_groups(spark.createDataFrame(rows, "g long, h string, v double"), ["g", "h"], ["v"], run, "g long, h string, v double, call long", 500).cache()
    assert sorted((r["g"] or -1, r["h"], r["v"]) for r in found.collect()) == sorted((g or -1, h, v) for g, h, v in rows)
    assert found.groupBy("g", "h").agg(F.count_distinct("call").alias("n")).where("n <> 1").isEmpty()
    assert found.select("call").distinct().count() <= len(rows) / 500 + 4  # of 200 groups


def test_tiles_of_all_sizes_are_measured_together(spark):
    rng = random.Random(5)
    sizes = {t: (rng.randint(1, 9), rng.randint(1, 70)) for t in range(30)} | {99: (90, 3)}
    marks = {t: {(rng.randrange(h), rng.randrange(w)) for _ in range(rng.randint(0, 3))} for t, (h, w) in sizes.items()}
    rows = [(t, r, c, float((r, c) in marks[t])) for t, (h, w) in sizes.items() for r in range(h) for c in range(w)]
    found = fi.distance_field(spark.createDataFrame(rows, "tile long, r int, c int, z double"), F.col("z") > 0).collect()
    assert len(found) == len(rows)
    for x in found:
        best = min((((x["r"] - r) ** 2 + (x["c"] - c) ** 2, r, c) for r, c in marks[x["tile"]]), default=(None, None, None))
        assert (x["d"] is None) == (best[0] is None) and (x["mark_r"], x["mark_c"]) == best[1:] and (best[0] is None or x["d"] == best[0] ** 0.5)


def test_many_columns_are_measured_like_all_pairs():
    rng = np.random.default_rng(6)
    reach = np.where(rng.random((40, 25)) < rng.random((40, 1)), rng.integers(0, 12, (40, 25)), -1)
    wanted = [[min(np.flatnonzero(a >= 0), key=lambda q, x=x, a=a: ((x - q) ** 2 + a[q] ** 2, q), default=-1) for x in range(25)] for a in reach]
    assert fi.nearest_by_columns(reach).tolist() == wanted


def test_contours_of_many_rasters_are_chained_together(spark):
    rng = random.Random(9)
    rows = [(n, r, c, rng.uniform(0, 50)) for n in range(12) for r in range(9) for c in range(9)]
    cells = spark.createDataFrame(rows, "raster long, r int, c int, z double")
    every = contours.fragments(cells, 4, 10.0)
    assert "MapInArrow" in every._jdf.queryExecution().toString()  # and no call for each tile
    place = lambda df: sorted((r["raster"], r["k"], r["closed"], tuple(r["ids"]), tuple(r["xs"]), tuple(r["ys"])) for r in df.collect())
    assert place(every.where("raster = 5")) == place(contours.fragments(cells.where("raster = 5"), 4, 10.0))


def test_edges_of_rings_in_rows_are_those_of_rings_by_points(spark):
    rng = random.Random(10)
    rings = [(n, [rng.randrange(12) for _ in range(rng.randint(0, 7))]) for n in range(60)]
    one = graph.shared_edges_of(spark.createDataFrame(rings, "ring long, ps array<long>"))
    other = graph.shared_edges(spark.createDataFrame([(n, i, p) for n, ps in rings for i, p in enumerate(ps)], "ring long, idx int, p long"))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, other.collect()))


def test_steps_of_lines_carry_the_values_of_both_ends(spark):
    points = spark.createDataFrame([(1, 1, 0.0, 0.0, 0.5), (1, 2, 2.0, 1.0, 0.75), (1, 3, 2.0, 1.0, 1.0)], "line long, idx int, x double, y double, phase double")
    found = {(r["idx"], r["t"], r["phase"], r["phase2"]) for r in plane.line_cells(points, carried=("phase",)).collect()}
    assert found == {(1, 0.0, 0.5, 0.75), (1, 0.5, 0.5, 0.75), (1, 1.0, 0.5, 0.75), (2, 0.0, 0.75, 1.0), (2, 1.0, 0.75, 1.0)}
