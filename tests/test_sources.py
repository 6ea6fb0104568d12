"""File formats, streams, and operators that SQL doesn't express."""

import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from cragline.operators import fields as fi
from cragline.operators import tracks as tr
from cragline.sources import files
from cragline.streaming import controls
from tests.test_operators import grid

GPX = """<?xml version="1.0"?><gpx xmlns="http://www.topografix.com/GPX/1/1"><trk><trkseg>
<trkpt lat="45.5" lon="7.1"><ele>100</ele><time>2024-05-01T10:00:00Z</time></trkpt><trkpt lat="45.6" lon="7.2"/>
<trkpt lat="x" lon="7.2"/><trkpt lat="45.8" lon="7.3"/></trkseg><trkseg><trkpt lat="46" lon="8"/><trkpt lat="46.1" lon="8.1"/></trkseg></trk></gpx>"""


def test_gpx_points_and_segments(spark, tmp_path):
    (tmp_path / "a.gpx").write_text(GPX)
    points = files.read_gpx(spark, str(tmp_path / "a.gpx"))
    rows = points.orderBy("seg", "idx").collect()
    assert [(r["seg"], r["idx"], r["lat"], r["ele"]) for r in rows][:3] == [(0, 0, 45.5, 100.0), (0, 1, 45.6, 0.0), (0, 2, None, 0.0)]
    assert rows[0]["ts"].isoformat() == "2024-05-01T10:00:00" and len(rows) == 6
    one = points.withColumn("track", F.col("seg").cast("long"))
    found = tr.split_segments(one, F.col("lat").isNotNull()).collect()
    assert sorted((r["track"], r["n"]) for r in found) == [(0, 2), (1, 2)]


def test_gazetteer_and_peaks(spark, tmp_path):
    line = "\t".join(["1", "Alp", "Alp", "", "46.0", "7.5", "T", "PK", "CH"] + [""] * 5 + ["0", "", "4000", "Europe/Zurich", "2024-01-01"])
    (tmp_path / "g.txt").write_text(line + "\n" + line.replace("\tPK", "\tPPL") + "\nshort\tline\n")
    rows = files.read_gazetteer(spark, str(tmp_path / "g.txt"))
    assert rows.count() == 2 and [r["lat"] for r in files.peaks(rows).collect()] == [46.0]


def test_height_tiles(spark, tmp_path):
    z = np.arange(9, dtype=">i2").reshape(3, 3)
    z[1, 1] = files.VOID
    (tmp_path / "S02W005.hgt").write_bytes(z.tobytes())
    rows = {(r["r"], r["c"]): r["z"] for r in files.read_height_tiles(spark, str(tmp_path)).collect()}
    assert rows[(2, 1)] == 7 and rows[(1, 1)] is None and len(rows) == 9
    assert files.read_height_tiles(spark, str(tmp_path)).select("lat0", "lon0").first()[:] == (-2, -5)


def stl(triangles):
    return b"\0" * 80 + struct.pack("<I", len(triangles)) + b"".join(struct.pack("<12fH", 0, 0, 0, *t, 0) for t in triangles)


def test_stl_filter_bounds_and_damage(spark, tmp_path):
    up, down = (0, 0, 1, 1, 0, 1, 0, 1, 1), (0, 0, 0, 0, 1, 0, 1, 0, 0)
    (tmp_path / "a.stl").write_bytes(stl([up, down]))
    mesh = files.read_stl(spark, str(tmp_path))
    assert [r["tri"] for r in files.upward(mesh).collect()] == [0]
    bounds = files.mesh_bounds(mesh).first()
    assert (bounds["min_z"], bounds["max_z"], bounds["max_x"]) == (0, 1, 1)
    (tmp_path / "a.stl").write_bytes(stl([up])[:-3])
    with pytest.raises(Exception, match="length"):
        files.read_stl(spark, str(tmp_path)).collect()


def test_obj_lines(spark, tmp_path):
    points = spark.createDataFrame([(1, 2, 1.0, 0.0, 0.0), (1, 1, 0.0, 0.0, 0.5)], "line long, idx int, x double, y double, z double")
    files.write_obj_lines(points, str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    assert text == "v 0.000000 0.000000 0.500000\nv 1.000000 0.000000 0.000000\nl -2 -1\n"


def test_stream_hands_over_the_latest_patch(spark, tmp_path):
    schema = "control string, seq long, patch map<string,string>, persist boolean"
    rows = [("sun", 1, {"time": "a", "floor": "1"}, True), ("sun", 2, {"time": "b"}, False), ("map", 1, {"x": "1"}, None)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    seen = []
    query = controls.apply_latest(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), lambda df, n: seen.extend(map(tuple, df.collect())), str(tmp_path / "ck"))
    query.processAllAvailable()
    query.stop()
    assert sorted(seen) == [("map", "x", "1", False, 1), ("sun", "floor", "1", True, 2), ("sun", "time", "b", True, 2)]


def test_distance_field_of_an_unmarked_tile_is_null(spark):
    found = fi.distance_field(grid(spark, [[1.0] * 4] * 4), F.lit(False)).collect()
    assert len(found) == 16 and all(r["d"] is None for r in found)


@pytest.mark.parametrize(("z", "at", "direction", "bias", "blocked"), [
    ([[3.0 * x + 2 * y for x in range(6)] for y in range(6)], (1, 1), (1.0, 0.0), 0.5, True),
    ([[0.0] * 6 for _ in range(6)], (1, 1), (0.6, 0.8), 0.5, False),
    ([[0.0, 4.0], [0.0, 0.0]], (0, 1), (0.8, -0.6), 0.9, True),
    ([[0.0, 4.0], [0.0, 0.0]], (0, 1), (0.8, -0.6), 3.1, False),
])
def test_rays(z, at, direction, bias, blocked):
    assert bool(fi.blocked(np.array(z), *direction, 0.0, bias)[at[1], at[0]]) is blocked


def test_rays_without_direction_meet_nothing():
    assert not fi.blocked(np.array([[0.0, 9.0], [9.0, 9.0]]), 0.0, 0.0, -1.0, 0.0).any()
    with pytest.raises(ValueError, match="finite"):
        fi.blocked(np.zeros((2, 2)), float("nan"), 0.0, 0.0, 0.0)


def test_rays_equal_dense_sampling():
    rng = np.random.default_rng(56)
    z = rng.uniform(-2, 15, (9, 11))
    for _ in range(60):
        x, y, angle = int(rng.integers(0, 10)), int(rng.integers(0, 8)), rng.uniform(0, 6.28)
        dx, dy = np.cos(angle), np.sin(angle)
        best = -1e9
        for t in np.arange(0, 20, 0.002):
            px, py = x + dx * t, y + dy * t
            if not (0 <= px <= 10 and 0 <= py <= 8):
                break
            cx, cy = min(int(px), 9), min(int(py), 7)
            u, v = px - cx, py - cy
            s = z[cy, cx] * (1 - u) * (1 - v) + z[cy, cx + 1] * u * (1 - v) + z[cy + 1, cx] * (1 - u) * v + z[cy + 1, cx + 1] * u * v
            best = max(best, s - z[y, x] - 1.0 - 0.4 * t)
        if abs(best) > 0.05:
            assert fi.blocked(z, dx, dy, 0.4, 1.0)[y, x] == (best > 0)


def test_splits_follow_long_stretches_alone(spark):
    """Cuts don't change with points between, with small wiggles, or (but for the sign) with the axis turned; each lies limit beyond a turn."""
    random.seed(1)
    turns = [0.0]
    for i in range(40):
        turns.append(turns[-1] + (-1) ** i * random.choice([0.5, 1.25, 2.0, 3.75]))

    def cuts(values):
        df = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "line long, idx int, v double")
        return [r["at"] for r in fi.reversal_splits(df, "v", 2.0).orderBy("piece").collect()]

    wanted = cuts(turns)
    between = [v for a, b in zip(turns, turns[1:], strict=False) for v in (a, a, a + (b - a) / 4, a + (b - a) / 2)] + turns[-1:]
    assert wanted and cuts(between) == wanted and cuts([-v for v in turns]) == [-v for v in wanted]
    assert all(any(abs(abs(at - v) - 2.0) < 1e-9 for v in turns) for at in wanted)
    assert cuts([0.0, 10.0, 8.5, 9.0, 7.5, 8.0, 6.5]) == [] and cuts([0.0, 10.0, 8.0]) == [8.0] and cuts([0.0, -1.0, 10.0, 9.0, 12.0, 1.0]) == [1.0, 10.0]


def test_shadows_of_a_line(spark):
    spans = spark.createDataFrame([(1, 1, 0.0, 5.0), (1, 2, 4.0, 12.0), (1, 3, 11.0, 13.0), (1, 4, 5.0, 6.0)], "line long, id long, lo double, hi double")
    assert [tuple(r)[2:] for r in fi.longest_shadows(spans).orderBy("place").collect()] == [(2, 4.0, 12.0), (1, 0.0, 4.0), (3, 12.0, 13.0)]


def test_many_shadows_equal_plain_rounds(spark):
    random.seed(7)
    spans = [(line, i % 90, float(lo), float(lo + random.randint(1, 12))) for line in (1, 2) for i in range(120) for lo in [random.randint(0, 150)]]
    wanted = []
    for line in (1, 2):
        left, place = [s[1:] for s in spans if s[0] == line], 0
        while left:
            i, a, b = min(left, key=lambda s: (s[1] - s[2], s[0], s[1]))
            place += 1
            wanted.append((line, place, i, a, b))
            left = [(k, p, q) for k, lo, hi in left for p, q in ((lo, min(hi, a)), (max(lo, b), hi)) if q > p]
    found = fi.longest_shadows(spark.createDataFrame(spans, "line long, id long, lo double, hi double"))
    assert sorted(map(tuple, found.collect())) == wanted


def test_flat_stretches_do_not_turn_a_line(spark):
    values = [0, 1, 1, 3, 2, 2, 1.5, 1.5, 0, 0, 2]
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(values)] + [(2, 0, 5.0)], "line long, idx int, v double")
    assert [tuple(r)[:3] for r in fi.reversal_splits(df, "v", 2.0).orderBy("piece").collect()] == [(1, 0, 1.0), (1, 1, 2.0)]
