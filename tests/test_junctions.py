"""Junctions and splices on small cases worked out by hand, and whole junctions checked for their ends and rings."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from cragline.operators import junctions


def test_rings_are_what_peeling_leaves():
    square = {(1, 2), (2, 3), (3, 4), (1, 4)}
    assert junctions.rings_of(square | {(4, 5), (5, 6)}) == [square]
    far = {(10, 11), (11, 12), (10, 12)}
    assert junctions.rings_of(square | far) == [square, far] and junctions.rings_of({(1, 2), (2, 3)}) == [] and junctions.rings_of(set()) == []


def grid_ways(edges):
    ways = {}
    for u, v, w in edges:
        ways.setdefault(u, []).append((v, w))
        ways.setdefault(v, []).append((u, w))
    return ways


def test_a_cross_stays_and_a_ring_in_the_middle_opens():
    cross = grid_ways([(0, 4, 1.0), (1, 4, 1.0), (2, 4, 1.0), (3, 4, 1.0)])
    assert junctions.untangled(cross, (0, 1, 2, 3)) == ([0, 4, 2], [3, 4, 1])
    # a ring 10-11-12-13 whose four corners lead to top, right, bottom and left
    ring = grid_ways([(0, 10, 1.0), (1, 11, 1.0), (2, 12, 1.0), (3, 13, 1.0), (10, 11, 1.0), (11, 12, 1.0), (12, 13, 1.0), (10, 13, 1.0)])
    down, across = junctions.untangled(ring, (0, 1, 2, 3))
    shared = {(min(p, q), max(p, q)) for path in (down, across) for p, q in itertools.pairwise(path)}
    assert down[0] == 0 and down[-1] == 2 and across[0] == 3 and across[-1] == 1 and junctions.rings_of(shared) == []
    assert junctions.untangled(grid_ways([(0, 1, 1.0), (2, 3, 1.0)]), (0, 1, 2, 3)) == "no path between two ends"


def sections(spark, rows):
    return spark.createDataFrame(rows, "junction long, kind string, idx int, r double, c double")


def test_junctions_keep_their_ends_and_have_no_rings(spark):
    down = [(1, "v", i, float(i), 6 + 1.5 * math.sin(i / 2)) for i in range(13)]
    across = [(1, "h", i, 6 + 1.2 * math.cos(i), float(i)) for i in range(13)]
    lone = [(2, "v", 0, 0.0, 3.0), (2, "h", 0, 3.0, 0.0), (2, "h", 1, 3.0, 6.0)]
    # the two run beside each other in the middle, a pixel apart
    beside = [(3, "v", i, float(i), 5.0) for i in range(11)] + [(3, "h", i, r, c) for i, (r, c) in enumerate([(2.0, 0.0), (2.0, 3.5), *((k, 4.0) for k in range(3, 9)), (8.0, 6.5), (8.0, 10.0)])]
    beside = [(j, k, i, float(r), c) for j, k, i, r, c in beside]
    found = junctions.junction_paths(sections(spark, down + across + lone + beside), 3.0, 1.7).collect()
    assert [r["reason"] for r in found if r["junction"] == 2] == ["a section has no step"]
    for junction, ends in ((1, {"v": ((0.0, 6.0), 12.0), "h": ((7.2, 0.0), 12.0)}), (3, {"v": ((0.0, 5.0), 10.0), "h": ((2.0, 0.0), 10.0)})):
        paths = {k: [(r["r"], r["c"]) for r in sorted((r for r in found if r["junction"] == junction and r["kind"] == k), key=lambda r: r["seq"])] for k in "vh"}
        assert paths["v"][0] == pytest.approx(ends["v"][0][:2]) and paths["v"][-1][0] == ends["v"][1]
        assert paths["h"][0] == pytest.approx(ends["h"][0][:2]) and paths["h"][-1][1] == ends["h"][1]
        edges = {tuple(sorted(e)) for p in paths.values() for e in itertools.pairwise(p)}
        number = {p: i for i, p in enumerate(sorted({p for e in edges for p in e}))}
        inner = [ring for ring in junctions.rings_of({(number[a], number[b]) for a, b in edges}) if not {n for e in ring for n in e} & {number[p[i]] for p in paths.values() for i in (0, -1)}]
        assert inner == []
        assert set(paths["v"]) & set(paths["h"])  # they cross at a node


def test_splices_turn_skip_and_join(spark):
    lines = [(n, i, float(i), 0.0) for n in (1, 2) for i in range(10)]
    new = [(1, 5, 2, 4, s, 4.0 - s, 1.0) for s in range(3)]  # backwards
    new += [(1, 6, 4, 6, 0, 99.0, 99.0)]  # begins inside the one before
    new += [(1, 7, 8, 9, s, v, 0.0) for s, v in enumerate((7.0, 8.5, 9.0))]  # its first point is the line's last kept one
    new += [(2, 1, 8, 12, 0, 50.0, 50.0)]  # ends where the line has no point
    got = junctions.spliced(spark.createDataFrame(lines, "line long, idx int, r double, c double"), spark.createDataFrame(new, "line long, id long, first int, last int, seq int, r double, c double"))
    rows = {n: [(r["r"], r["c"]) for r in got.where(F.col("line") == n).orderBy("idx").collect()] for n in (1, 2)}
    assert rows[1] == [(0, 0), (1, 0), (2, 1), (3, 1), (4, 1), (5, 0), (6, 0), (7, 0), (8.5, 0), (9, 0)]
    assert rows[2] == [(float(i), 0) for i in range(10)]
    assert [r["idx"] for r in got.where("line = 1").orderBy("idx").collect()] == list(range(10))


def test_refined_lines_change_near_crossings_alone(spark):
    lines = [(1, i, float(i), 10 + math.sin(i)) for i in range(30)] + [(2, i, 12 + math.cos(i), float(i)) for i in range(30)] + [(3, i, float(i), 28.0) for i in range(30)]
    df = spark.createDataFrame(lines, "line long, idx int, r double, c double")
    crossings = spark.createDataFrame([(1, 1, 2, 12.0, 10.0), (2, 1, 3, 20.0, 10.0)], "junction long, v long, h long, r double, c double")
    found, failed = junctions.refined(df, crossings, 5.0, 2.0, 1.7)
    rows = {}
    for r in found.collect():
        rows.setdefault(r["line"], []).append((r["idx"], r["r"], r["c"]))
    assert {r["junction"]: r["reason"] for r in failed.collect()} == {2: "a seam doesn't pass the square"}
    assert sorted(rows[3]) == [(i, float(i), 28.0) for i in range(30)]
    for n, old in ((1, lines[:30]), (2, lines[30:60])):
        new = {p[1:] for p in rows[n]}
        assert {p[2:] for p in old if max(abs(p[2] - 12.0), abs(p[3] - 10.0)) > 7} <= new and sorted(p[0] for p in rows[n]) == list(range(len(rows[n])))
