"""Outlines and distance fields against brute force, and graph searches in few rounds."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cragline.operators import fields as fi
from cragline.operators import graph, outlines


def test_points_in_outlines_and_their_distances(spark):
    rng = random.Random(3)
    rings = {n: [(rng.uniform(0, 90), rng.uniform(0, 60)) for _ in range(rng.randint(3, 9))] for n in range(12)}
    rings[50] = [(10.0, 10.0), (80.0, 10.0), (80.0, 10.0), (80.0, 50.0), (10.0, 50.0)]  # with a side without length
    points = [(i, rng.uniform(-40, 130), rng.uniform(-30, 90)) for i in range(250)] + [(900, 4000.0, -2500.0), (901, None, 3.0), (902, math.nan, 3.0)]
    sides = outlines.sides_of(spark.createDataFrame([(n, i, x, y) for n, ring in rings.items() for i, (x, y) in enumerate(ring)], "ring long, idx int, x double, y double"))
    df = spark.createDataFrame(points, "id long, x double, y double")
    inside = {r["id"]: r["inside"] for r in outlines.inside(df, sides, 7.0).collect()}
    far = {r["id"]: r["d"] for r in outlines.distances(df, sides, 2.0).collect()}
    every = [(p, q) for ring in rings.values() for p, q in zip(ring, ring[1:] + ring[:1], strict=True) if p != q]
    assert far[901] is None and far[902] is None and len(far) == len(points) == len(inside)
    for i, x, y in points[:-2]:
        odd, best = 0, math.inf
        for (a, b), (c, d) in every:
            odd += (b > y) != (d > y) and x < a + (y - b) / (d - b) * (c - a)
            t = max(0.0, min(1.0, ((x - a) * (c - a) + (y - b) * (d - b)) / ((c - a) ** 2 + (d - b) ** 2)))
            best = min(best, math.hypot(x - a - t * (c - a), y - b - t * (d - b)))
        assert inside[i] == (odd % 2 == 1) and far[i] == pytest.approx(best)
    none = sides.limit(0)
    assert {r["d"] for r in outlines.distances(df, none, 2.0).collect()} == {None} and not any(r["inside"] for r in outlines.inside(df, none, 2.0).collect())


def test_far_points_ask_few_of_many_sides(spark):
    rng = random.Random(8)
    corners = [(rng.uniform(0, 300), rng.uniform(0, 300)) for _ in range(1500)]
    rings = [(n, i, x + dx, y + dy) for n, (x, y) in enumerate(corners) for i, (dx, dy) in enumerate(((0.0, 0.0), (9.0, 0.5), (4.0, 7.0)))]
    sides = outlines.sides_of(spark.createDataFrame(rings, "ring long, idx int, x double, y double"))
    points = [(i, rng.uniform(2000, 9000), rng.uniform(-500, 700)) for i in range(400)] + [(1000 + i, rng.uniform(0, 300), rng.uniform(0, 300)) for i in range(50)]
    df = spark.createDataFrame(points, "id long, x double, y double")
    placed = sides.select(*[F.floor((F.col(f"{a}1") + F.col(f"{a}2")) / 16).cast("long").alias(n) for n, a in (("i", "x"), ("j", "y"))], "x1", "y1", "x2", "y2")
    asked = outlines.candidates(df, placed).join(placed, ["i", "j"]).where("id < 1000").count()
    assert 400 <= asked < 400 * 100  # of 4,500 sides each
    a, b, c, d = (np.array([r[n] for r in sides.collect()]) for n in ("x1", "y1", "x2", "y2"))
    far, odd = ({r["id"]: r[1] for r in found.collect()} for found in (outlines.distances(df, sides, 8.0), outlines.inside(df, sides, 8.0)))
    for i, x, y in points:
        t = np.clip(((x - a) * (c - a) + (y - b) * (d - b)) / ((c - a) ** 2 + (d - b) ** 2), 0, 1)
        assert far[i] == pytest.approx(np.hypot(x - a - t * (c - a), y - b - t * (d - b)).min())
        with np.errstate(all="ignore"):
            assert odd[i] == (np.sum(((b > y) != (d > y)) & (x < a + (y - b) / (d - b) * (c - a))) % 2 == 1)


def test_columns_are_measured_like_all_pairs():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 60):
        for share in (0.0, 0.1, 0.5, 1.0):
            reach = np.where(rng.random(n) < share, rng.integers(0, 12, n), -1)
            marks = np.flatnonzero(reach >= 0)
            wanted = [min(marks, key=lambda q, x=x: ((x - q) ** 2 + reach[q] ** 2, q), default=-1) for x in range(n)]
            assert fi.nearest_by_column(reach).tolist() == wanted


def test_distance_fields_name_the_nearest_mark(spark):
    rng = random.Random(2)
    size = (40, 130)  # over two blocks of columns
    marks = {(rng.randrange(size[0]), rng.randrange(size[1])) for _ in range(25)}
    rows = [(1, r, c, float((r, c) in marks)) for r in range(size[0]) for c in range(size[1])]
    found = fi.distance_field(spark.createDataFrame(rows, "tile long, r int, c int, z double"), F.col("z") > 0).collect()
    assert len(found) == len(rows)
    for x in found:
        d2, r, c = min(((x["r"] - r) ** 2 + (x["c"] - c) ** 2, r, c) for r, c in marks)
        assert (x["mark_r"], x["mark_c"]) == (r, c) and x["d"] == pytest.approx(math.sqrt(d2))


def test_the_two_core_of_long_paths_and_trees(spark):
    path = [(i, i + 1) for i in range(1500)]
    ring = [(5000 + i, 5000 + (i + 1) % 9) for i in range(9)] + [(1500, 5000)]
    tree = [(9000 + i, 9000 + (i - 1) // 2) for i in range(1, 200)] + [(9010, 5004)]
    two = [(7000, 7001), (7001, 7002), (7000, 7002), (7002, 7100), (7100, 7200), (7200, 7201), (7201, 7202), (7200, 7202)]
    found = graph.two_core(spark.createDataFrame(path + ring + tree + two, "u long, v long"))
    assert {(r["u"], r["v"]) for r in found.collect()} == set(ring[:-1]) | set(two)


def test_distances_along_a_path_of_many_rounds(spark):
    edges = spark.createDataFrame([(i, i + 1, 1.0) for i in range(20)] + [(0, 15, 9.5)], "u long, v long, w double")
    found = {r["id"]: r["d"] for r in graph.distances(edges, spark.createDataFrame([(0,)], "id long")).collect()}
    assert found == {i: min(float(i), 9.5 + abs(i - 15)) for i in range(21)}
