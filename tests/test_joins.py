"""Joins of tables that are small on disk and large in memory, as narrow columns of keys are."""

import re

import pytest
from pyspark.sql import functions as F

from cragline import session
from cragline.operators import graph, near
from cragline.operators import plane as pl


@pytest.fixture(scope="module")
def grid(spark, tmp_path_factory):
    """(id, x, y) as far apart as 6 * sqrt(2) at most, from a file of keys."""
    path = str(tmp_path_factory.mktemp("joins") / "points")
    spark.range(400).write.parquet(path)
    return spark.read.parquet(path).select("id", (F.col("id") % 20 * 6.0).alias("x"), (F.floor(F.col("id") / 20) * 6.0).alias("y"))


def _planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _labels(grid):
    return grid.select("id", (F.col("id") % 5).alias("label"))


@pytest.mark.parametrize("query", ["near_pairs", "nearest", "closest_between", "nearest_between"])
def test_neighbour_joins_broadcast_no_points(grid, query):
    found = {
        "near_pairs": lambda: near.near_pairs(grid, 6.0), "nearest": lambda: near.nearest(grid, 6.0, 3),
        "closest_between": lambda: near.closest_between(grid, _labels(grid), 6.0), "nearest_between": lambda: pl.nearest_between(grid, _labels(grid), 6.0, 2),
    }[query]()
    assert not re.search("Broadcast", _planned(found)) and found.count()


def test_graph_joins_broadcast_few_rows_only(spark, monkeypatch):
    edges = spark.createDataFrame([(k, k + 1) for k in range(9)] + [(20, 21)], "u long, v long")
    monkeypatch.setattr(session, "BROADCAST_ROWS", 5)
    few, many = (session.joining(session.written(spark.range(n), "rows")) for n in (5, 6))
    assert "Broadcast" in _planned(spark.range(9).join(few, "id")) and "Broadcast" not in _planned(spark.range(9).join(many, "id"))
    monkeypatch.setattr(session, "BROADCAST_ROWS", 0)
    found = graph.components(edges)
    assert "Broadcast" not in _planned(found)
    assert sorted(map(tuple, found.collect())) == [(k, 0) for k in range(10)] + [(20, 20), (21, 20)]
