"""Registered queries against their comparison SQL, and the shape of their plans."""
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from sphereframe.functions import geometry as g
from sphereframe.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are not here")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_every_sphere_query_has_comparison_sql():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(catalog.QUERIES) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", ["bilinear_points", "cube_identify_mean", "region_query_multi", "raster_corner_mean",
                                  "tile_blend_shared", "tile_missing", "pole_constraint", "grid_phase_report",
                                  "export_stored", "tile_cost_bitmap", "point_groups"])
def test_query_equals_its_sql_and_uses_no_cross_join(spark, name):
    df = contract.queries()[name](spark, DATA)
    plan = plan_of(df)
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan and "Python" not in plan
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    want = con.execute(contract.oracle_sql()[name]).df()
    got = df.toPandas()[list(want.columns)]
    keys = [c for c in want.columns if want[c].dtype.kind != "f"] or list(want.columns)
    got, want = (f.sort_values(keys).reset_index(drop=True) for f in (got, want))
    assert len(got) == len(want)
    for c in want.columns:
        if want[c].dtype.kind == "f":
            assert (got[c] - want[c]).abs().max() < 2e-6
        else:
            assert (got[c] == want[c]).all()


def test_scans_read_only_needed_columns(spark):
    plan = contract.queries()["tile_blend_shared"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<vec_id:bigint,embedding:array<float>>" in plan


def test_large_fields_are_not_broadcast(spark):
    from sphereframe.operators import sampling
    from sphereframe.sources import grids
    points = g.add_lonlat_direction(spark.range(10).select(
        F.col("id").alias("point_id"), (F.col("id") * 7.0).alias("lon"), F.lit(3.0).alias("lat")))
    for n, hinted in ((16, True), (4096, False)):
        field = grids.cube_nodes(spark, n).withColumn("v", F.lit(1.0))
        logical = sampling.sample_cube(points, field, n)._jdf.queryExecution().optimizedPlan().toString()
        assert ("rightHint=(strategy=broadcast)" in logical) == hinted
