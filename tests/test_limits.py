"""What keeps memory, seconds and spilled bytes in bounds on large tables."""

import re

import numpy as np
from pyspark.sql import functions as F

from cragline.operators import graph, mapping, plane
from cragline.plans import fixtures


def _planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _before_shuffles(df):
    """Whether an aggregate or a sort feeds a shuffle."""
    return re.search(r"Exchange[^\n]*\n[^\n]*(Aggregate|Sort)", _planned(df))


def test_sides_and_cells_are_shuffled_before_they_are_counted(spark, sf_dir):
    triangles = spark.createDataFrame([(1, 2, 3), (1, 3, 4), (3, 4, 5), (1, 2, 3)], "a long, b long, c long")
    alone = graph.boundary_edges(triangles)
    rings = spark.createDataFrame([([1, 2, 3],), ([1, 3, 4],)], "ps array<long>")
    shared = graph.shared_edges_of(rings)
    for df in (alone, shared, fixtures.dem(spark, sf_dir)):
        assert "Exchange" in _planned(df) and not _before_shuffles(df)
    assert sorted(map(tuple, alone.collect())) == [(1, 4), (3, 5), (4, 5)]
    assert sorted(map(tuple, shared.collect())) == [(1, 3, 2)]


def test_rays_join_by_squares_alone_and_solids_are_built_in_two_shuffles(spark):
    cells = spark.createDataFrame([(1, r, c, float(r * c)) for r in range(4) for c in range(4)], "tile long, r int, c int, z double")
    top = plane.grid_solids(cells, 0.0, top_only=True)
    assert len(re.findall("Exchange hash", _planned(top))) == 2 and "filter(" not in _planned(top)
    rays = spark.createDataFrame([(7, 1.25, -1.75, 50.0, 0.0, 0.0, -1.0)], "ray long, ox double, oy double, oz double, dx double, dy double, dz double")
    found = plane.first_hits(rays, top.drop("mesh"), 2.0)
    joins = re.findall(r"Join Inner, (.*)", found._jdf.queryExecution().optimizedPlan().toString())
    assert len(joins) == 1 and not re.search("[*/+-]", joins[0])
    assert [(r["ray"], r["t"]) for r in found.collect()] == [(7, 50.0 - 2.25)]


def test_depth_ranks_are_the_bits_of_floats(spark):
    rng = np.random.default_rng(5)
    bits = np.concatenate([rng.integers(0, 0x7F800000, 3000), np.arange(0, 40), np.arange(0x7F7FFFF0, 0x7F800001)] + [np.arange(-2, 3) + (k << 23) for k in range(1, 255)])
    x = bits.astype(np.uint32).view(np.float32).astype(float)
    rows = [(k, float(s * v), int(s) * int(b)) for s in (1, -1) for k, (v, b) in enumerate(zip(x, bits, strict=True))]
    df = spark.createDataFrame(rows + [(-1, float("nan"), 0x7F800001), (-2, None, 0x7F800002)], "k long, x double, wanted long").withColumn("x", F.col("x").cast("float"))
    assert df.withColumn("rank", mapping._rank(F.col("x"))).where("rank <> wanted OR rank IS NULL").collect() == []


def test_depth_raster_keeps_the_least_without_sorting_all_rows(spark):
    names = "tile long, tri long, " + ", ".join(f"{a}{i} double" for i in (1, 2, 3) for a in "xyz")
    flat = lambda tri, z: (1, tri, 0.0, 0.0, z, 2.0, 0.0, z, 0.0, 2.0, z)
    far, odd, void = 1 << 40, float("nan"), None
    for triangles, depth, tri in (
        ([flat(far + 3, 1.5), flat(far + 2, 1.5), flat(far + (1 << 33), 1.5)], 1.5, far + 2), ([flat(2, 1.5), flat(far, -1.5), flat(1, -1.0)], -1.5, far),
        ([flat(2, 0.0), flat(-far, -0.0), flat(-1, 1e-40)], 0.0, -far), ([flat(2, odd), flat(5, 3.0), flat(1, void)], 3.0, 5), ([flat(2, 1.0), flat(1, 1.0 + 1e-12)], 1.0, 1),
    ):
        found = mapping.depth_raster(spark.createDataFrame(triangles, names), 4)
        assert sorted((r["r"], r["c"]) for r in found.collect()) == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (2, 0)]
        assert {(r["depth"], r["tri"]) for r in found.collect()} == {(depth, tri)}
    spread = _planned(found).split("Exchange")[-1]
    assert "HashAggregate" in spread and "Sort" not in spread
