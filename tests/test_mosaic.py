"""Results on rasters cut into tiles equal those on one tile, row for row, and plain computations."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cragline.operators import contours, sightlines, tiles
from cragline.operators import fields as fi

RNG = np.random.default_rng(56)
#: As wide as three tiles and a bit, with voids; then one without.
HOLED = np.where(RNG.random((38, 44)) < 0.06, np.nan, RNG.uniform(-2, 15, (38, 44)))
HOLED[5:20, 7:24] = np.nan
DENSE = RNG.uniform(-2, 15, (19, 27))


def cells(spark, *rasters):
    rows = [(n, r, c, float(v)) for n, z in enumerate(rasters) for r, row in enumerate(z) for c, v in enumerate(row) if r or c or not math.isnan(v)]
    return spark.createDataFrame(rows, "raster long, r int, c int, z double")


def rows_of(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("side", [8, 12])
def test_half_does_not_depend_on_tiles(spark, side):
    df = cells(spark, HOLED, DENSE[:18, :26])
    whole = rows_of(tiles.half(df, 64, 3))
    assert rows_of(tiles.half(df, side, 3)) == whole and len(whole) > 300


def test_half_takes_edges_and_medians(spark):
    z = np.zeros((16, 16))
    z[:, 7:] = 10.0  # a step inside a column of blocks
    found = {(r["r"], r["c"]): r["z"] for r in tiles.half(cells(spark, z), 4, 2).collect()}
    assert len(found) == 64 and set(found.values()) <= {0.0, 5.0, 10.0} and all(found[r, 0] == 0.0 and found[r, 7] == 10.0 for r in range(8))
    assert rows_of(tiles.half(cells(spark, np.full((16, 16), 3.0)), 4, 2)) == sorted((0, r, c, 3.0) for r in range(8) for c in range(8))
    assert tiles.half(cells(spark), 4, 2).count() == 0
    with pytest.raises(Exception, match="too small"):
        tiles.half(cells(spark, DENSE[:4, :4]), 4, 5).collect()


def test_percentiles_are_exact(spark):
    random.seed(3)
    groups = {0: [random.choice([0.0, 0.0, random.uniform(-5, 900)]) for _ in range(2000)], 1: [7.0] * 30, 2: [1.5], 3: [1e-300, 5.0, 1e300]}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "raster long, v double")
    for share in (0.0, 0.25, 0.5, 0.995, 1.0):
        found = {r["raster"]: r["q"] for r in tiles.percentiles(df, share).collect()}
        assert all(found[k] == pytest.approx(np.percentile(vs, 100 * share), rel=1e-12) for k, vs in groups.items())


@pytest.mark.parametrize("azimuth", [0.0, 90.0, 61.5, 235.0])
def test_skylines_do_not_depend_on_tiles(spark, azimuth):
    df = cells(spark, HOLED, DENSE)
    whole = rows_of(sightlines.skylines(df, 64, 2.0, 0.5, azimuth))
    assert rows_of(sightlines.skylines(df, 10, 2.0, 0.5, azimuth)) == whole
    square = DENSE[:19, :19]
    one = fi.skylines(cells(spark, square).withColumnRenamed("raster", "tile"), 19, 2.0, 0.5, (azimuth,))
    assert rows_of(sightlines.skylines(cells(spark, square), 6, 2.0, 0.5, azimuth)) == [pytest.approx(r) for r in rows_of(one.select("tile", "r", "c", "elevation"))]


@pytest.mark.parametrize("direction", [(1.0, 0.0), (0.0, -1.0), (0.8, 0.6), (-0.6, 0.8), (-1.0, -0.25), (0.31, -0.95)])
def test_rays_do_not_depend_on_tiles(spark, direction):
    df = cells(spark, HOLED, DENSE)
    whole = rows_of(sightlines.rays(df, 64, direction, 0.4, 1.0))
    for rise in (0.4, -0.2):
        assert rows_of(sightlines.rays(df, 7, direction, rise, 1.0)) == rows_of(sightlines.rays(df, 64, direction, rise, 1.0))
    dense = fi.blocked(DENSE, *direction, 0.4, 1.0)
    assert [r[3] for r in whole if r[0] == 1] == dense.ravel().tolist()


def test_rays_without_or_with_odd_directions(spark):
    assert not any(r[3] for r in rows_of(sightlines.rays(cells(spark, DENSE), 7, (0.0, 0.0), 1.0, 0.5)))
    with pytest.raises(ValueError, match="not finite"):
        sightlines.rays(cells(spark, DENSE), 7, (math.nan, 0.0), 1.0, 0.5)


@pytest.mark.parametrize("side", [5, 16])
def test_contours_do_not_depend_on_tiles(spark, side):
    smooth = np.array([[8 * math.sin(r / 5) * math.cos(c / 7) + 0.02 * r for c in range(60)] for r in range(50)])
    smooth[20:23, 30:33] = np.nan
    df = cells(spark, HOLED, smooth)
    whole = rows_of(contours.contour_lines(df, 64, 2.5))
    assert rows_of(contours.contour_lines(df, side, 2.5)) == whole
    assert len({r[:3] for r in whole if r[0] == 1}) > 10 and {r[6] for r in whole if r[0] == 1} == {True, False}
    assert contours.contour_lines(cells(spark), side, 2.5).count() == 0


def test_contours_are_lines_from_square_to_square(spark):
    lines = {}
    for raster, level, line, idx, x, y, closed in rows_of(contours.contour_lines(cells(spark, DENSE), 8, 3.0)):
        lines.setdefault((level, line, closed), []).append((idx, x, y))
    for (level, _, closed), points in lines.items():
        assert [p[0] for p in points] == list(range(len(points)))
        places = [p[1:] for p in points]
        assert (places[0] == places[-1]) == closed and len(set(places[closed:])) == len(places) - closed
        for (x, y), (u, v) in zip(places, places[1:], strict=False):
            assert max(abs(x - u), abs(y - v)) <= 1 and math.floor((x + u) / 2) == math.floor(min(x, u) + 1e-12)
        for x, y in places:
            r, c = math.floor(y), math.floor(x)
            z = DENSE[r, c] + (x - c) * (DENSE[r, min(c + 1, 26)] - DENSE[r, c]) if y == r else DENSE[r, c] + (y - r) * (DENSE[min(r + 1, 18), c] - DENSE[r, c])
            assert z == pytest.approx(level)
        if not closed:
            assert all(x in (0, 26) or y in (0, 18) for x, y in (places[0], places[-1]))


def test_a_halo_reaches_neighbours_alone(spark):
    df = spark.createDataFrame([(0, r, c, 1.0) for r in range(8) for c in range(8)], "raster long, r int, c int, z double")
    sent = tiles.haloed(df, 4, 1, 2)
    sizes = {(r["ti"], r["tj"]): r["n"] for r in sent.groupBy("ti", "tj").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert {k: sizes[k] for k in ((0, 0), (0, 1), (1, 0), (1, 1))} == {(0, 0): 36, (0, 1): 30, (1, 0): 30, (1, 1): 25}


def test_halving_makes_no_tile_beyond_a_raster(spark):
    """A raster of one tile is one group for all its cells, however wide the halo."""
    spanned = cells(spark, np.ones((16, 16)), np.ones((15, 13))).withColumns({"height": F.when(F.col("raster") == 0, 16).otherwise(15), "width": F.when(F.col("raster") == 0, 16).otherwise(13)})
    cut = tiles.haloed(spanned, 16, 24, 24, spans=True)
    assert cut.count() == 256 + 195 and rows_of(cut.select("raster", "ti", "tj").distinct()) == [(0, 0, 0), (1, 0, 0)]
    found = tiles.fours(np.array([[1.0, 2.0, 5.0], [3.0, np.nan, 6.0]]))
    np.testing.assert_array_equal(found[:, 0], [[1, 5], [2, np.nan], [3, 6], [np.nan, np.nan]])
