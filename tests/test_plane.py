"""Lines, solids and projections on small cases worked out by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cragline.operators import contours
from cragline.operators import plane as pl


def grid(spark, z, name="raster"):
    return spark.createDataFrame([(1, r, c, float(v)) for r, row in enumerate(z) for c, v in enumerate(row)], f"{name} long, r int, c int, z double")


def test_a_peak_has_closed_contours_and_a_ramp_open_ones(spark):
    peak = grid(spark, [[4 - abs(r - 3) - abs(c - 3) for c in range(7)] for r in range(7)])
    lines = contours.contour_lines(peak, 16, 1.5).collect()
    assert {(r["level"], r["closed"]) for r in lines} >= {(3.0, True), (1.5, True)}
    ring = sorted((r["idx"], r["x"], r["y"]) for r in lines if r["level"] == 1.5)
    assert ring[0][1:] == ring[-1][1:] and len(ring) == 1 + len({p[1:] for p in ring})
    ramp = contours.contour_lines(grid(spark, [[c for c in range(5)]] * 4), 16, 2.0).where("level = 2").orderBy("idx").collect()
    assert [(r["x"], r["y"], r["closed"]) for r in ramp] == [(2.0, float(y), False) for y in range(4)]


def test_a_saddle_is_cut_by_its_mean():
    top, left, right, bottom = 0, 1, 3, contours.WIDE * 2
    for z, want in (([[2, 0], [0, 2]], {(top, right), (left, bottom)}), ([[1.2, 0], [0, 1.2]], {(top, left), (right, bottom)})):
        k, p, q, *_ = contours.pieces(np.array(z, float), 0, 0, 1.0)
        assert {(a, b) for level, a, b in zip(k, p, q, strict=True) if level == 1} == want


def test_solids_are_watertight_and_scraps_are_told(spark):
    box = pl.grid_solids(grid(spark, [[2.0] * 4] * 3, "tile"), 0.0)
    part = pl.mesh_parts(box).select("*", pl.holds_material(F.col("faces"), F.col("volume"), F.col("open")).alias("kept")).collect()
    assert [(r["open"], r["volume"], r["kept"]) for r in part] == [(0, pytest.approx(2 * 2 * 3), True)]
    opened = pl.mesh_parts(box.where("tri % 16 <> 0")).withColumn("kept", pl.holds_material(F.col("faces"), F.col("volume"), F.col("open"))).collect()
    assert opened[0]["open"] > 0 and opened[0]["kept"] is False


def test_homography_meets_its_corners(spark):
    source, target = [(0, 0), (4, 0), (4, 3), (0, 3)], [(10, 12), (90, 15), (80, 70), (5, 66)]
    h = pl.homography(source, target)
    df = spark.createDataFrame([(float(x), float(y)) for x, y in source], "x double, y double")
    at = pl.projected(F.col("x"), F.col("y"), h)
    found = [tuple(r) for r in df.select(at["u"], at["v"]).collect()]
    assert all(math.dist(p, q) < 1e-9 for p, q in zip(found, target, strict=True))
    with pytest.raises(ValueError, match="convex"):
        pl.homography(source, [(0, 0), (4, 0), (1, 1), (0, 3)])
    assert np.allclose(pl.homography(source, source), np.eye(3))


def test_places_outside_a_map_are_null(spark):
    df = spark.createDataFrame([(5.0, 45.0), (6.0, 46.0), (7.1, 45.0)], "lon double, lat double")
    at = pl.map_xy(F.col("lon"), F.col("lat"), (5.0, 45.0, 7.0, 47.0), 100.0, 50.0)
    assert [tuple(r) for r in df.select(at["x"], at["y"]).collect()] == [(0.0, 0.0), (50.0, 25.0), (None, 0.0)] or [r[0] for r in df.select(at["x"]).collect()] == [0.0, 50.0, None]


def test_parts_are_those_of_whole_meshes_however_small_the_squares(spark, monkeypatch):
    """Two boxes in one mesh, far apart, and one over many squares; the parts don't depend on the squares."""
    boxes = pl.grid_solids(grid(spark, [[2.0] * 9] * 5, "tile"), 0.0)
    moved = boxes.select("mesh", (F.col("tri") + (1 << 40)).alias("tri"), *[(F.col(f"{a}{i}") + (40.0 if a == "x" else 0.0)).alias(f"{a}{i}") for i in (1, 2, 3) for a in "xyz"])
    other = boxes.withColumn("mesh", F.lit(2).cast("long"))
    mesh = boxes.unionByName(moved).unionByName(other).unionByName(moved.where("tri % 16 = 1").withColumn("mesh", F.lit(3).cast("long")))
    found = {}
    for square in (256.0, 1.5):
        monkeypatch.setattr(pl, "PART_SQUARE", square)
        found[square] = sorted((r["mesh"], r["faces"], round(r["volume"], 6), r["open"]) for r in pl.mesh_parts(mesh).collect())
    assert found[256.0] == found[1.5]
    assert [r for r in found[1.5] if r[0] < 3] == [(1, 176, 64.0, 0), (1, 176, 64.0, 0), (2, 176, 64.0, 0)]
    assert all(r[3] >= 3 for r in found[1.5] if r[0] == 3)
    assert pl.mesh_parts(mesh.limit(0)).count() == 0
