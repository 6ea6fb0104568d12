"""Hand-computed fixtures and independent versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cragline.functions import parse, solar
from cragline.operators import events as ev
from cragline.operators import graph
from cragline.operators import graph as g
from cragline.operators import near, scan, tiling
from cragline.operators import raster as ra
from cragline.operators import tracks as tr


def grid(spark, values, tile=0):
    cells = [(tile, r, c, float(z)) for r, row in enumerate(values) for c, z in enumerate(row)]
    return spark.createDataFrame(cells, "tile long, r int, c int, z double")


def table(df, column="z"):
    out = {}
    for row in df.collect():
        out.setdefault(row["r"], {})[row["c"]] = row[column]
    return [[out[r][c] for c in sorted(out[r])] for r in sorted(out)]


def test_horizon_of_one_peak(spark):
    z = [[0.0] * 9 for _ in range(9)]
    z[4][4] = 4.0
    found = table(ra.horizon_cardinal(grid(spark, z), 1.0), "horizon")
    assert found[4] == [0, 1, 2, 3, 4, 0, 0, 0, 0]
    assert found[3] == [0] * 9


def test_sea_level_keeps_large_land_patches(spark):
    z = [[50.0] * 12 for _ in range(8)]
    for r in (1, 2):
        for c in (1, 2, 3):
            z[r][c] = -5.0
    z[1][1], z[4][2], z[5][3], z[7][0], z[0][10] = -500.0, -3.0, -3.0, -32768.0, 40.0
    for c in (7, 8, 9):
        z[6][c] = -300.0
    cells = ra.clean_voids(grid(spark, z))
    land = ~((F.col("r") == 6) & F.col("c").between(7, 9)) & ~((F.col("r") == 0) & (F.col("c") == 10))
    found = table(ra.sea_level(cells, land, -20.0, 4))
    assert (found[1][1], found[2][3], found[4][2], found[6][8], found[0][10]) == (-20.0, -5.0, 0.0, 0.0, 40.0)
    assert math.isnan(found[7][0])


def test_sea_level_follows_a_snake(spark):
    snake = [[-1.0 if r % 2 == 0 or c == (15 if r % 4 == 1 else 0) else 1.0 for c in range(16)] for r in range(16)]
    below = sum(v < 0 for row in snake for v in row)
    held, gone = (ra.sea_level(grid(spark, snake), F.lit(True), -5.0, least) for least in (below, below + 1))
    assert held.where("z = -1").count() == below and gone.where("z < 0").count() == 0


def test_patch_sizes_equal_flood_fill():
    rng = np.random.default_rng(4)
    for share in (0.3, 0.6, 0.9):
        r, c = np.nonzero(rng.random((23, 31)) < share)
        cells = set(zip(r.tolist(), c.tolist(), strict=True))
        sizes = {}
        while left := cells - sizes.keys():
            patch, todo = set(), [min(left)]
            while todo:
                y, x = todo.pop()
                if (y, x) in cells and (y, x) not in patch:
                    patch.add((y, x))
                    todo += [(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)]
            sizes |= dict.fromkeys(patch, len(patch))
        order = rng.permutation(len(r))
        assert ra.patch_sizes(r[order], c[order]).tolist() == [sizes[r[k], c[k]] for k in order]


def test_network_phases_meet_at_confluences(spark):
    rows = [(10, 20, 8.0), (11, 20, 2.0), (12, 21, 1.0), (20, 30, 3.0), (21, 30, 1.0), (30, 0, 2.0)]
    found = {r["id"]: r for r in g.network_phases(spark.createDataFrame(rows, "id long, down long, len double")).collect()}
    for child, parent, _ in rows[:-1]:
        assert found[child]["end"] == pytest.approx(found[parent]["begin"], abs=1e-6)
    assert found[10]["begin"] == 0 and found[30]["end"] == 1 and found[11]["begin"] > found[10]["begin"]


def test_network_cycle_raises(spark):
    with pytest.raises(ValueError, match="cycle"):
        g.network_phases(spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0)], "id long, down long, len double"))


def test_parity_replay_with_duplicates(spark):
    initial = spark.createDataFrame([(0, False), (1, True), (2, False), (3, True)], "cell long, initial boolean")
    times = [(0, 1000), (0, 2000), (0, 2500), (0, 3000), (1, 3000), (3, 1500)]
    flips = spark.createDataFrame(times, "cell long, t_ms long")
    for at in (0, 1000, 1500, 2000, 2750, 3000, 4000):
        found = {r["cell"]: r["lit"] for r in ev.state_at(initial, flips, F.lit(at)).collect()}
        start = {0: False, 1: True, 2: False, 3: True}
        assert found == {c: s ^ (sum(cell == c and t <= at for cell, t in times) % 2 == 1) for c, s in start.items()}


def test_bounded_day_equals_full_day(spark):
    random.seed(82)
    cells = [(i, [random.uniform(1, 25) for _ in range(24)]) for i in range(30)] + [(99, [89.0] * 24)]
    skylines = spark.createDataFrame(cells, "cell long, elevations array<float>")
    whole, bounded = (sorted(map(tuple, ev.compile_day(skylines, 24, "2026-10-25", 45.95, 10.65, bounded=b).collect())) for b in (False, True))
    assert whole == bounded and whole and all(cell != 99 for cell, _ in whole)


def test_sun_stands_high_over_the_equator(spark):
    sun = solar.at_second("2026-03-20", F.lit(12 * 3600), F.lit(0.0), F.lit(0.0))
    assert spark.range(1).select(sun["altitude"].alias("a")).first()["a"] > 87


def test_zigzag_round_trip(spark):
    codes = [(c, k, random.randint(-(2**31), 2**31)) for c in range(5) for k in range(40)]
    df = spark.createDataFrame(codes, "cell long, k int, code long")
    assert sorted(map(tuple, ev.unzigzag(ev.zigzag_deltas(df)).collect())) == sorted(codes)


def test_day_equals_plain_bisection(spark):
    """Transitions of raw horizons against the same rule in plain Python, to the precision; the day's last step counts too."""
    random.seed(24)
    cells = [(i, [random.uniform(1, 25) for _ in range(24)]) for i in range(6)]
    skylines = spark.createDataFrame(cells, "cell long, elevations array<float>")

    def lit(elevations, second):
        azimuth, altitude = solar.of_day("2026-10-25", np.float64(second), 45.95, 10.65)
        q = azimuth * 24 / 360
        e = [np.float32(elevations[(int(q) + k) % 24]) for k in (0, 1)]
        return altitude > 0 and np.float32(altitude) > e[0] * np.float32(1 - q % 1) + e[1] * np.float32(q % 1)

    wanted = []
    for cell, elevations in cells:
        for s in range(0, 86_400, 600):
            low, high, was = s, s + 600, lit(elevations, s)
            if lit(elevations, high) != was:
                while high - low > 0.01:
                    low, high = ((low + high) / 2, high) if lit(elevations, (low + high) / 2) == was else (low, (low + high) / 2)
                wanted.append((cell, low * 1000))
    found = sorted(map(tuple, ev.compile_day(skylines, 24, "2026-10-25", 45.95, 10.65).collect()))
    assert [c for c, _ in found] == [c for c, _ in sorted(wanted)] and wanted
    assert all(abs(t - w) <= 50 for (_, t), (_, w) in zip(found, sorted(wanted), strict=True))
    polar = spark.createDataFrame([(1, [0.5] * 24)], "cell long, elevations array<float>")
    assert ev.compile_day(polar, 24, "2026-10-25", 45.95, 180.0, step=7000).count() == 2  # noon at 0 h: light until evening, and from morning on


@pytest.mark.parametrize(("day", "zone", "dates", "minutes"), [
    ("2026-10-27", "Europe/Zurich", ["2026-10-26", "2026-10-27"], 1440), ("2026-03-29", "Europe/Zurich", ["2026-03-28", "2026-03-29"], 1380),
    ("2026-10-27", "Asia/Tokyo", ["2026-10-26", "2026-10-27"], 1440), ("2026-10-27", "UTC", ["2026-10-27"], 1440),
])
def test_local_days(spark, day, zone, dates, minutes):
    row = spark.createDataFrame([(day, zone)], "d string, zone string").withColumn("day", F.to_date("d")).select(ev.utc_dates("day", "zone").alias("dates"), ev.minutes_of_day("day", "zone").alias("m")).first()
    assert [str(d) for d in row["dates"]] == dates and row["m"] == minutes


def test_components_of_a_sorted_path(spark):
    """10,000 nodes in a row: rounds grow with the logarithm."""
    path = spark.range(9_999).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    before, rounds = graph.written, []
    graph.written = lambda df, name: rounds.append(name) or before(df, name)
    try:
        found = graph.components(path.unionByName(spark.createDataFrame([(20_000, 20_001)], "u long, v long")))
        assert sorted(map(tuple, found.groupBy("label").count().collect())) == [(0, 10_000), (20_000, 2)]
    finally:
        graph.written = before
    assert rounds.count("hook") <= 20


@pytest.mark.parametrize(("text", "metres"), [("1,234,567 ft", 1234567 * 0.3048), ("12,5", 12.5), ("nan", None), ("1e3", None), ("3 miles", None), ("4810 Metres", 4810), ("4,810 m",  4810), ("4810,5 m", 4810.5), ("100 ft", 30.48), ("unknown", None), ("", None), ("-12.5", -12.5)])
def test_elevation_text(spark, text, metres):
    found = spark.createDataFrame([(text,)], "t string").select(parse.elevation(F.col("t")).alias("m")).first()["m"]
    assert found == (metres if metres is None else pytest.approx(metres))


def test_running_total_over_slices(spark, monkeypatch):
    monkeypatch.setattr(scan, "SLICE_ROWS", 50)
    df = spark.createDataFrame([(i * 3, i % 7) for i in range(500)], "k long, v long")
    found = [r["s"] for r in scan.running_total(df, "k", "v", "s").orderBy("k").collect()]
    assert found == [sum(j % 7 for j in range(i + 1)) for i in range(500)]


def test_near_pairs_equal_brute_force(spark):
    random.seed(5)
    points = [(i, random.uniform(-50, 50), random.uniform(-50, 50)) for i in range(200)]
    found = {(r["u"], r["v"]) for r in near.near_pairs(spark.createDataFrame(points, "id long, x double, y double"), 9.0).collect()}
    assert found == {(a[0], b[0]) for a in points for b in points if a[0] < b[0] and math.hypot(a[1] - b[1], a[2] - b[2]) <= 9.0}


def test_shortest_paths_and_forest_equal_plain_versions(spark):
    random.seed(6)
    edges = sorted({(min(a, b), max(a, b)) for a, b in ((random.randrange(40), random.randrange(40)) for _ in range(70)) if a != b})
    rows = [(u, v, float(random.randint(1, 20))) for u, v in edges]
    df = spark.createDataFrame(rows, "u long, v long, w double")
    best = {0: 0.0}
    for _ in range(60):
        for u, v, w in rows:
            for a, b in ((u, v), (v, u)):
                if a in best and best[a] + w < best.get(b, 1e9):
                    best[b] = best[a] + w
    found = {r["id"]: r["d"] for r in g.distances(df, spark.createDataFrame([(0,)], "id long")).collect()}
    assert found == best
    parent = list(range(40))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    total = 0.0
    for u, v, w in sorted(rows, key=lambda r: (r[2], r[0], r[1])):
        if root(u) != root(v):
            parent[root(u)] = root(v)
            total += w
    assert g.spanning_forest(df).agg(F.sum("w")).first()[0] == total
    degree = {e: True for e in edges}
    while True:
        n = {}
        for u, v in degree:
            n[u], n[v] = n.get(u, 0) + 1, n.get(v, 0) + 1
        weak = [e for e in degree if n[e[0]] < 2 or n[e[1]] < 2]
        if not weak:
            break
        for e in weak:
            del degree[e]
    assert {(r["u"], r["v"]) for r in g.two_core(df).collect()} == set(degree)


def test_moving_average_counts_ends_as_zero(spark):
    df = spark.createDataFrame([(1, i, float(i)) for i in range(1, 41)], "track long, idx int, v double")
    found = [r["s"] for r in tr.smoothed(df, "v", 50, "s").orderBy("idx").collect()]
    padded = [0.0] * 2 + [float(i) for i in range(1, 41)] + [0.0] * 2
    assert found == pytest.approx([sum(padded[i : i + 5]) / 5 for i in range(40)])


def test_clearance_table_of_another_tile_is_refused(spark):
    rows = tiling.clearance_rows(spark.createDataFrame([(1, 2, 1, 0.075, 0.0)], "id long, nx int, ny int, side double, border double"))
    assert tiling.parse_clearance(rows).count() == 8
    wrong = rows.withColumn("text", F.regexp_replace("text", "00_01", "00_02"))
    with pytest.raises(Exception, match="another tile"):
        tiling.parse_clearance(wrong).collect()


def test_eviction_spares_pinned_days(spark):
    files = [(1, d * 10 + i, d, 100, d == 0) for d in range(3) for i in range(5)]
    df = spark.createDataFrame(files, "store long, file long, mtime long, bytes long, pinned boolean")
    assert {r["file"] // 10 for r in tiling.evicted(df, F.lit(1100)).collect()} == {1}
