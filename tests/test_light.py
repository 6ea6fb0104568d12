"""Horizons under oblique suns, rays in any direction, projectors and track rasters on small cases and against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cragline.operators import plane, projector, sweep
from cragline.plans import catalogue


def cells(spark, *rasters):
    rows = [(n, r, c, float(v)) for n, z in enumerate(rasters) for r, row in enumerate(z) for c, v in enumerate(row)]
    return spark.createDataFrame(rows, "raster long, r int, c int, z double")


def horizon(spark, z, spacing, sun, single=False):
    out = np.full(np.shape(z), np.nan)
    for x in sweep.horizons(cells(spark, z), spacing, sun, single).collect():
        out[x["r"], x["c"]] = x["horizon"]
    return out


def plain_horizon(z, spacing, sun):
    """By following each cell's way to the sun: the horizon upstream, interpolated, is a mean of two such ways."""
    h, w = z.shape
    east, south = sun[0] / spacing[0], -sun[1] / spacing[1]
    done = {}

    def at(r, c):
        if (r, c) not in done:
            main, other = (east, south) if abs(east) >= abs(south) else (south, east)
            up = int(math.copysign(1, main))
            place, n = ((r, h) if abs(east) >= abs(south) else (c, w))
            onward = place + other / abs(main)
            before = c + up if abs(east) >= abs(south) else r + up
            best = z[r, c]
            if 0 <= before < (w if abs(east) >= abs(south) else h) and 0 <= onward <= n - 1:
                low = math.floor(onward)
                high = min(low + 1, n - 1)
                one, two = ((at(low, before), at(high, before)) if abs(east) >= abs(south) else (at(before, low), at(before, high)))
                best = max(best, one + (two - one) * (onward - low) - sun[2] / abs(main))
            done[r, c] = best
        return done[r, c]

    return np.array([[at(r, c) for c in range(w)] for r in range(h)])


def test_a_peak_casts_its_shadow_straight_and_aslant(spark):
    z = np.zeros((9, 9))
    z[4, 4] = 4
    found = horizon(spark, z, (1.0, 1.0), (1 / math.sqrt(2), 0.0, 1 / math.sqrt(2)))
    assert found[4] == pytest.approx([0, 1, 2, 3, 4, 0, 0, 0, 0]) and (found[3] == 0).all()
    found = horizon(spark, z, (1.0, 1.0), (1 / math.sqrt(3),) * 3)
    assert found[5, 3] == pytest.approx(3) and found[6, 2] == pytest.approx(2)
    assert np.isinf(horizon(spark, z, (1.0, 1.0), (1.0, 0.0, -0.1))).all() and (horizon(spark, z, (1.0, 1.0), (0.0, 0.0, 1.0)) == z).all()


@pytest.mark.parametrize("sun", [(0.5, 0.4, 0.3), (-0.5, 0.2, 0.3), (0.1, -0.9, 0.2), (-0.3, 0.8, 0.4), (0.0, -1.0, 0.3)])
def test_oblique_horizons_equal_plain_recursion(spark, sun):
    z = np.random.default_rng(8).uniform(0, 9, (11, 14))
    wanted = plain_horizon(z, (2.0, 3.0), sun)
    assert horizon(spark, z, (2.0, 3.0), sun) == pytest.approx(wanted)
    assert horizon(spark, z, (2.0, 3.0), sun, True) == pytest.approx(wanted, abs=1e-4)


def test_horizons_of_voids_and_nothing(spark):
    z = np.array([[5.0, math.nan, 0.0, 0.0]])
    assert horizon(spark, z, (1.0, 1.0), (-1.0, 0.0, 1.0)).tolist()[0][2:] == [0.0, 0.0]
    assert sweep.horizons(cells(spark), (1.0, 1.0), (-1.0, 0.0, 1.0)).count() == 0


def test_rays_in_any_direction_equal_all_triangles(spark):
    rng = np.random.default_rng(3)
    triangles = [(i, *(rng.uniform(0, 20, 3) + rng.uniform(-5, 5, (3, 3))).ravel().tolist()) for i in range(150)]
    rays = []
    for i in range(200):
        way = rng.normal(size=3)
        if i % 5 == 0:
            way[rng.integers(0, 3)] = 0.0
        if i % 7 == 0:
            way = np.eye(3)[i % 3] * (-1) ** i
        rays.append((i, *rng.uniform(-5, 25, 3).tolist(), *way.tolist()))
    rays.append((200, 1.0, 1.0, 1.0, 0.0, 0.0, 0.0))
    names = ", ".join(f"{a}{i} double" for i in (1, 2, 3) for a in "xyz")
    mesh = spark.createDataFrame(triangles, f"tri long, {names}")
    sent = spark.createDataFrame(rays, "ray long, ox double, oy double, oz double, dx double, dy double, dz double")
    found = {r["ray"]: (r["tri"], r["t"]) for r in plane.first_hits(sent, mesh, 1.5).collect()}
    wanted = {}
    for ray, *values in rays[:-1]:
        o, d = np.array(values[:3]), np.array(values[3:])
        for tri, *corners in triangles:
            p, q, s = np.array(corners).reshape(3, 3)
            m = np.column_stack((-d, q - p, s - p))
            if abs(np.linalg.det(m)) > 1e-12:
                t, u, v = np.linalg.solve(m, o - p)
                if u >= 0 and v >= 0 and u + v <= 1 and t > 1e-9:
                    wanted[ray] = min(wanted.get(ray, (math.inf, 0)), (t, tri))
    assert len(wanted) > 30 and found.keys() == wanted.keys()
    assert all(found[k][0] == tri and found[k][1] == pytest.approx(t) for k, (t, tri) in wanted.items())
    with pytest.raises(Exception, match="not finite"):
        plane.first_hits(spark.createDataFrame([(1, 0.0, 0.0, 0.0, math.nan, 0.0, 1.0)], sent.schema), mesh, 1.5).collect()


def test_a_projector_sees_what_nothing_hides(spark):
    """A wall on flat ground: places behind it are hidden, before it visible."""
    ground = [(0, -50.0, -50.0, 0.0, 50.0, -50.0, 0.0, 50.0, 50.0, 0.0), (1, -50.0, -50.0, 0.0, 50.0, 50.0, 0.0, -50.0, 50.0, 0.0)]
    wall = [(2, 10.0, -40.0, 0.0, 10.0, 40.0, 0.0, 10.0, 40.0, 8.0), (3, 10.0, -40.0, 0.0, 10.0, 40.0, 8.0, 10.0, -40.0, 8.0)]
    names = ", ".join(f"{a}{i} double" for i in (1, 2, 3) for a in "xyz")
    mesh = spark.createDataFrame(ground + wall, f"tri long, {names}")
    lens = projector.Projector((60.0, 0.0, 30.0), 0.0, 0.8, 400, 300)
    places = spark.createDataFrame([(1, 5.0, 0.0), (2, 20.0, 3.0), (3, -40.0, 0.0), (4, 70.0, 0.0), (5, 30.0, 49.0)], "id long, x double, y double").withColumns({"ox": F.lit(0.0), "oy": F.lit(0.0)})
    found = {r["id"]: r for r in projector.point_query(places, mesh, lens, 4.0).collect()}
    assert {k: r["status"] for k, r in found.items()} == {1: "hidden", 2: "visible", 3: "visible", 4: "miss", 5: "outside"}
    assert found[2]["z"] == pytest.approx(0.0) and found[4]["z"] is None
    m = lens.matrix()
    # the origin is in the middle; a place's pixel and depth lead back to it
    assert m[:, 3] / m[2, 3] == pytest.approx([200.0, 150.0, 1.0])
    for p in ((5.0, 7.0, 1.0), (-20.0, 3.0, 4.0)):
        u, v, depth = m @ (*p, 1.0)
        back = np.array(lens.place) + np.linalg.inv(m[:, :3]) @ (u, v, depth)
        assert back == pytest.approx(p)
    assert projector.Projector(*lens[:5], mirror=True).matrix()[0] == pytest.approx(400 * m[2] - m[0])
    turned = projector.Projector((60.0, 0.0, 30.0), math.pi / 2, 0.8, 400, 300).matrix() @ (0.0, 9.0, 0.0, 1.0)
    straight = m @ (0.0, 9.0, 0.0, 1.0)
    assert abs(turned[1] / turned[2] - 150) < 1e-9 and abs(turned[0] / turned[2] - 200) == pytest.approx(abs(straight[1] / straight[2] - 150))


def test_all_kinds_of_places_occur(spark, sf_dir):
    kinds = {r["status"] for r in catalogue.QUERIES["projector_points"](spark, sf_dir).collect()}
    assert kinds == {"visible", "hidden", "outside", "miss"}


def test_the_earliest_track_counts_and_its_phase_is_blurred_with_it(spark):
    points = [(0, 1, 1, 0.0, 5.0, 0.0), (0, 1, 2, 20.0, 5.0, 0.4), (0, 2, 1, 10.0, 0.0, 0.8), (0, 2, 2, 10.0, 12.0, 1.0)]
    df = spark.createDataFrame(points, "raster long, line long, idx int, x double, y double, phase double")
    found = {(r["y"], r["x"]): r for r in plane.track_raster(df, 24, 10, 1).collect()}
    assert found[5, 5]["phase"] == pytest.approx((0.75 * 0.1 + 0.125 * (0.08 + 0.12)) / 1.0) and found[5, 5]["cover"] == pytest.approx(0.75)
    assert found[6, 5]["phase"] == pytest.approx(0.1) and found[6, 5]["cover"] == pytest.approx(0.125)
    assert found[5, 10]["phase"] < 0.45 and max(k[0] for k in found) == 9 and (3, 12) not in found
    wide = {(r["y"], r["x"]): r for r in plane.track_raster(df, 24, 10, 3).collect()}
    assert wide[6, 5]["cover"] == pytest.approx(1 - 0.125) and wide[6, 15]["phase"] == pytest.approx(0.28, abs=0.001)  # the brush reaches it one pixel before
    assert plane.track_raster(df.limit(0), 24, 10, 3).count() == 0


def test_phases_grow_along_random_tracks(spark):
    random.seed(2)
    x = [random.uniform(0, 5)]
    for _ in range(8):
        x.append(x[-1] + random.uniform(1, 4))
    points = [(0, 1, i, v, 4.0, i / 8) for i, v in enumerate(x)]
    df = spark.createDataFrame(points, "raster long, line long, idx int, x double, y double, phase double")
    row = [r["phase"] for r in plane.track_raster(df, 60, 9, 1).where("y = 4 AND cover > 0.7").orderBy("x").collect()]
    assert row == sorted(row) and 0 <= row[0] and row[-1] <= 1
