"""Every query against its DuckDB SQL, on the smallest tables."""

import pytest

from cragline.plans import catalogue, graph_queries
from tests import comparing


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_equals_sql(spark, sf_dir, name):
    found = catalogue.QUERIES[name](spark, sf_dir)
    wanted = comparing.views(sf_dir).execute(catalogue.ORACLES[name])
    columns = [c[0] for c in wanted.description]
    assert sorted(found.columns) == sorted(columns)
    assert comparing.rows(found.columns, found.collect()) == comparing.rows(columns, wanted.fetchall())


def test_every_sql_has_a_query():
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES)


def test_all_kinds_of_cells_and_levels_occur(spark, sf_dir):
    clean = [r["z"] for r in catalogue.QUERIES["dem_clean_voids_coast"](spark, sf_dir).collect()]
    assert None in clean and 0 in clean and any(z for z in clean)
    sea = [r["z"] for r in catalogue.QUERIES["dem_sea_level_coast"](spark, sf_dir).collect()]
    assert None in sea and 0 in sea and -200 in sea and any(z and -200 < z < 0 for z in sea) and any(z and z > 0 for z in sea)
    levels = {r["level"] for r in catalogue.QUERIES["contour_levels_coast"](spark, sf_dir).collect()}
    assert 1000 in levels and 400 in levels and not levels & {600, 700, 800, 900}


def test_turned_triangles_are_dropped(spark, sf_dir):
    place = lambda df: {(r["tile"], r["r"], r["c"]) for r in df.collect()}
    every = place(graph_queries._solids(spark, sf_dir, "false").withColumnRenamed("path", "tile"))
    turned, low = (place(catalogue.QUERIES[name](spark, sf_dir)) for name in ("mesh_upward_turned", "mesh_upward"))
    assert turned < every and all((r * 5 + c * 3) % 4 == 0 for _, r, c in every - turned)
    assert low < every and len(low) > len(every) / 2


def test_high_triangles_stay(spark, sf_dir, tmp_path):
    """The surface is wound upwards at every height, so all of it is kept; prices of 600,000 lie above 9,000."""
    every = {(r["path"], r["r"], r["c"]) for r in graph_queries._solids(spark, sf_dir, "false").collect()}
    found = catalogue.QUERIES["mesh_upward"](spark, sf_dir).collect()
    assert len(found) == len(every) and {(r["tile"], r["r"], r["c"]) for r in found} == every
    assert sum(r["top"] > 400 for r in found) > len(every) / 4
    rows = [(r, c, 1, 600_000.0) for r in range(3) for c in range(3)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_extendedprice double").write.parquet(str(tmp_path / "lineitem.parquet"))
    assert sum(r["top"] == 11_240 for r in catalogue.QUERIES["mesh_upward"](spark, str(tmp_path)).collect()) == 9
