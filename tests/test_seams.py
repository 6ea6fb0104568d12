"""Corridor seams: each stage on small cases, and whole paths checked in DuckDB for continuity, ends and least cost."""

import heapq
import itertools
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cragline.operators import seams

SPACING = (2.0, 3.0)


def plain_far(edges, start):
    ways = {}
    for u, v, w in edges:
        ways.setdefault(u, []).append((v, w))
        ways.setdefault(v, []).append((u, w))
    far, heap = {}, [(0.0, start)]
    while heap:
        d, u = heapq.heappop(heap)
        if u not in far:
            far[u] = d
            for v, w in ways.get(u, ()):
                heapq.heappush(heap, (d + w, v))
    return far


@pytest.mark.parametrize("alpha", [1.2, 2.0, 5.0])
def test_detours_equal_searches_over_whole_graphs(spark, alpha):
    rng = random.Random(4)
    points = [(g, i, rng.uniform(0, 60), rng.uniform(0, 40)) for g in (1, 2) for i in range(140)]
    far = lambda p, q: math.dist(p[2:], q[2:])
    edges = [(p[0], p[1], q[1], far(p, q)) for p, q in itertools.combinations(points, 2) if p[0] == q[0] and far(p, q) < 5 and (p[1] + q[1]) % 2]
    found = seams.detours(spark.createDataFrame(points, "graph long, id long, x double, y double"), spark.createDataFrame(edges, "graph long, u long, v long, w double"), 6.0, alpha)
    wanted = set()
    for g in (1, 2):
        own = [p for p in points if p[0] == g]
        by = {p[1]: plain_far([e[1:] for e in edges if e[0] == g], p[1]) for p in own}
        wanted |= {(g, p[1], q[1]) for p, q in itertools.combinations(own, 2) if far(p, q) <= 6 and by[p[1]].get(q[1], math.inf) > alpha * far(p, q)}
    assert {tuple(r)[:3] for r in found.collect()} == wanted and wanted


def test_bridges_are_a_least_forest_between_parts():
    rng = np.random.default_rng(2)
    for n in (1, 2, 30):
        x, y = rng.integers(0, 9, n).astype(float), rng.integers(0, 9, n).astype(float)
        u, v = np.array([], int), np.array([], int)
        links = seams.bridged(x, y, u, v, block=7)
        assert len(links) == n - 1
        parts, total = list(range(n)), 0.0
        for d, i, j in sorted((math.hypot(x[i] - x[j], y[i] - y[j]), i, j) for i, j in itertools.combinations(range(n), 2)):
            if parts[i] != parts[j]:
                parts, total = [parts[i] if p == parts[j] else p for p in parts], total + d
        assert sum(link[2] for link in links) == pytest.approx(total)


def test_lines_become_pieces_where_they_turn(spark):
    points = [(0, 1.0, 5, i, float(x), float(y)) for i, (x, y) in enumerate([(0, 0), (0, 10), (4, 8), (4, 5), (8, 9), (8, 2)])]
    df = spark.createDataFrame(points, "raster long, level double, line long, idx long, x double, y double")
    found = seams.split_edges(df, 4.0, "raster", "level").orderBy("piece", "idx").collect()
    # from 10 back to 5 is cut at 6, from 5 up to 9 at 9 (the end of the stretch), from 9 down to 2 at 5
    assert [(r["piece"], r["y1"], r["y2"]) for r in found] == [(0, 0, 10), (0, 10, 8), (0, 8, 6), (1, 6, 5), (1, 5, 9), (2, 9, 9), (2, 9, 5), (3, 5, 2)]
    assert all(r["x1"] == pytest.approx(r["x2"]) or r["y1"] != r["y2"] for r in found)
    whole = seams.split_edges(df, 50.0, "raster", "level").collect()
    assert [r["piece"] for r in whole] == [0] * 5


def test_shadowed_parts_of_pieces_go(spark):
    rows = [(0, 1.0, 1, 0, 0, 0.0, 0.0, 0.0, 10.0), (0, 2.0, 7, 0, 0, 3.0, 8.0, 3.0, 14.0), (0, 2.0, 8, 0, 0, 5.0, 2.0, 5.0, 6.0), (1, 2.0, 8, 0, 0, 5.0, 2.0, 5.0, 6.0)]
    df = spark.createDataFrame(rows, "raster long, level double, line long, piece long, idx long, x1 double, y1 double, x2 double, y2 double")
    found = sorted((r["raster"], r["x1"], r["y1"], r["y2"]) for r in seams.unshadowed(df).collect())
    assert found == [(0, 0.0, 0.0, 10.0), (0, 3.0, 10.0, 14.0), (1, 5.0, 2.0, 6.0)]


def relief(spark):
    z = [(0, r, c, 20 * math.sin(r / 6) + 15 * math.cos(c / 4) + (r * 7 + c * 5) % 11 * 0.3) for r in range(70) for c in range(50)]
    flat = [(1, r, c, 3.0) for r in range(30) for c in range(20)]
    return spark.createDataFrame(z + flat, "raster long, r int, c int, z double")


def corridors(spark):
    rows = [(1, 0, "y", 0, 70, 10, 22), (2, 0, "x", 20, 34, 0, 50), (3, 1, "y", 0, 30, 4, 12), (4, 0, "y", 0, 70, 40, 40), (5, 0, "y", 5, 6, 10, 20), (6, 9, "x", 0, 10, 0, 10)]
    return spark.createDataFrame(rows, "corridor long, raster long, axis string, r0 int, r1 int, c0 int, c1 int")


def test_seams_are_whole_ways_of_least_cost(spark):
    bands = corridors(spark)
    nodes, edges = seams.seam_graph(relief(spark), bands, 16, 5.0, 15.0, 10.0, 4.0, 9.0, 1.8, SPACING)
    nodes, edges = nodes.toPandas(), edges.toPandas()
    assert set(nodes["graph"]) == {1, 2}
    sent = [spark.createDataFrame(x) for x in (nodes, edges)]
    found = seams.paths(*sent, bands, SPACING, 2.0).toPandas()
    failed = found[found["reason"].notna()]
    assert dict(zip(failed["corridor"], failed["reason"], strict=True)) == {3: "no contours", 4: "no contours", 5: "no length", 6: "no contours"}
    db = duckdb.connect()
    path = found[found["reason"].isna()]
    db.register("path", path)
    # whole: numbers without gaps, steps as long as the cost says and never beyond the step; from border to border, inside the corridor
    steps = db.execute("""SELECT corridor, max(abs(d - w)) AS off, max(w) AS longest, bool_and(n = 1) AS whole FROM (
      SELECT corridor, sqrt(pow((r - lag(r) OVER o) * 2, 2) + pow((c - lag(c) OVER o) * 3, 2)) AS d, cost - lag(cost) OVER o AS w, seq - lag(seq) OVER o AS n FROM path WINDOW o AS (PARTITION BY corridor ORDER BY seq)) WHERE n IS NOT NULL GROUP BY corridor""").fetchall()
    assert {s[0] for s in steps} == {1, 2} and not [s for s in steps if not (s[1] < 1e-9 and s[2] <= 2.0 + 1e-8 and s[3])]
    ends = db.execute("SELECT corridor, arg_min(r, seq), arg_max(r, seq), arg_min(c, seq), arg_max(c, seq), min(r), max(r), min(c), max(c), max(cost) FROM path GROUP BY corridor ORDER BY corridor").fetchall()
    assert ends[0][1:3] == (0.0, 69.0) and ends[1][3:5] == (0.0, 49.0)
    assert 10 <= ends[0][7] and ends[0][8] <= 21 and 20 <= ends[1][5] and ends[1][6] <= 33
    for corridor, last, cost in ((1, 69.0, ends[0][9]), (2, 49.0, ends[1][9])):
        n, e = nodes[nodes["graph"] == corridor].sort_values("id", ignore_index=True), edges[edges["graph"] == corridor]
        number = {k: i for i, k in enumerate(n["id"])}
        links = [(number[a], number[b], w) for a, b, w in zip(e["u"], e["v"], e["w"], strict=True)]
        along = 2.0 if corridor == 1 else 3.0
        x, y = n["c"].to_numpy() * (5.0 - along), n["r"].to_numpy() * along
        links += seams.bridged(x, y, np.array([a[0] for a in links]), np.array([a[1] for a in links]))
        db.execute("CREATE OR REPLACE TABLE e (u BIGINT, v BIGINT, w DOUBLE)")
        db.executemany("INSERT INTO e VALUES (?, ?, ?)", links + [(b, a, w) for a, b, w in links])
        first, end = int(n["r"].argmin()), int(n["r"].argmax())
        least = db.execute(f"""WITH RECURSIVE walk(x, d) USING KEY (x) AS (SELECT {first}::BIGINT, 0::DOUBLE
          UNION SELECT e.v, min(w.d + e.w) FROM walk w JOIN e ON e.u = w.x LEFT JOIN recurring.walk k ON k.x = e.v WHERE k.d IS NULL OR w.d + e.w < k.d GROUP BY e.v) SELECT d FROM walk WHERE x = {end}""").fetchone()[0]
        assert cost == pytest.approx(least + along * (n["r"].min() + last - n["r"].max()))


def test_crops_meet_their_cells_alone(spark):
    found = seams.crops(relief(spark), corridors(spark))
    z = {(r["raster"], r["r"], r["c"]): r["z"] for r in relief(spark).collect()}
    rows = found.collect()
    assert len(rows) == 70 * 12 + 14 * 50 + 30 * 8 + 10
    assert all(r["z"] == z[0, r["r"], r["c"] + 10] for r in rows if r["raster"] == 1) and all(r["z"] == z[0, r["c"] + 20, r["r"]] for r in rows if r["raster"] == 2)
    assert seams.paths(*[spark.createDataFrame([], s) for s in ("graph long, id long, r double, c double", "graph long, u long, v long, w double")], corridors(spark).limit(0)).count() == 0
    assert found.groupBy("raster").agg(F.max("r").alias("r")).where("raster = 2").first()["r"] == 49
