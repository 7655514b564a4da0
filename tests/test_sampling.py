import random

import brute
import pytest
from pyspark.sql import functions as F

from sphereframe.functions import geometry as g
from sphereframe.operators import filters, lookup, sampling
from sphereframe.sources import grids, store


def random_cube(spark, n, seed=0, shared=True):
    rng = random.Random(seed)
    field = {(f, y, x): rng.uniform(-5, 5) for f in range(6) for y in range(n + 1) for x in range(n + 1)}
    field = brute.identify(field, n) if shared else field
    return field, spark.createDataFrame([(*k, v) for k, v in field.items()], "face int, y int, x int, v double")


def random_lonlat(spark, h, seed=0):
    rng = random.Random(seed)
    field = {(y, x): rng.uniform(-5, 5) for y in range(h + 1) for x in range(2 * h)}
    for y in (0, h):
        for x in range(2 * h):
            field[y, x] = field[y, 0]
    return field, spark.createDataFrame([(*k, v) for k, v in field.items()], "y int, x int, v double")


def as_dict(df):
    return {(r.face, r.y, r.x): r.v for r in df.collect()}


def close(a, b, tol=1e-9):
    assert a.keys() == b.keys()
    worst = max(abs(a[k] - b[k]) for k in a)
    assert worst < tol, worst


def test_identify_mean_owner_and_boundary_only(spark):
    n = 4
    raw, df = random_cube(spark, n, shared=False)
    want = brute.identify(raw, n)
    close(as_dict(sampling.identify(df, n)), want)
    close(as_dict(sampling.identify(df, n, boundary_only=True)), want)
    owner = as_dict(sampling.identify(df, n, "owner"))
    for members in brute.groups(n).values():
        assert {owner[m] for m in members} == {raw[min(members)]}


def test_bilinear_and_nearest_cube(spark):
    n = 6
    field, df = random_cube(spark, n, 1)
    rng = random.Random(2)
    pts = [(i, *brute.unit([rng.gauss(0, 1) for _ in range(3)])) for i in range(400)]
    p = spark.createDataFrame(pts, "i int, vx double, vy double, vz double")
    for options in ({}, {"prune": True}):
        got = {r.i: r.v for r in sampling.sample_cube(p, df, n, **options).collect()}
        assert all(abs(got[i] - brute.sample(field, v, n)) < 1e-9 for i, *v in pts)
    near = {r.i: r.v for r in sampling.sample_cube_nearest(p, df, n).collect()}
    for i, *v in pts:
        f, y, x = brute.chart(v, n)
        assert near[i] == field[f, int(y + 0.5), int(x + 0.5)]


def test_lonlat_lookup_folds_everywhere(spark):
    h = 5
    field, df = random_lonlat(spark, h)
    pts = [(i, -4 + i * 0.37, -13 + i * 0.91) for i in range(50)] + [(50, 0.0, 3.0), (51, 5.0, 9.5), (52, 2.0, 10.0)]
    p = spark.createDataFrame(pts, "i int, ny double, nx double")
    got = {r.i: r.v for r in sampling.sample_lonlat(p, df, h).collect()}
    assert all(abs(got[i] - brute.lonlat(field, y, x, h)) < 1e-9 for i, y, x in pts)


def test_missing_coordinates_give_missing_values(spark):
    _, df = random_lonlat(spark, 4)
    p = spark.createDataFrame([(1, None, 2.0), (2, 1.0, 1.0)], "i int, ny double, nx double")
    got = {r.i: r.v for r in sampling.sample_lonlat(p, df, 4).collect()}
    assert got[1] is None and got[2] is not None


def test_halo_reads_cross_every_edge(spark):
    n, radius = 5, 2
    field, df = random_cube(spark, n, 3)
    got = as_dict(sampling.with_halo(df, n, radius))
    want = {(f, y, x): brute.read(field, f, y, x, n) for f in range(6)
            for y in range(-radius, n + radius + 1) for x in range(-radius, n + radius + 1)}
    close(got, want)


def test_halo_of_a_large_face_uses_only_the_band(spark):
    n = 24  # larger than the band, so the near-edge filter is active
    f = sampling.field_from_expression(spark, n, v=F.col("vx") + 2 * F.col("vy") + F.lit(0.3) * F.col("vz"))
    out = g.add_direction(sampling.with_halo(f, n, 2), n)
    err = out.agg(F.max(F.abs(F.col("v") - F.col("vx") - 2 * F.col("vy") - F.lit(0.3) * F.col("vz")))).first()[0]
    assert out.where("v is null").count() == 0 and err < 5e-3


@pytest.mark.parametrize("n_new", [3, 8])
def test_resize_cube(spark, n_new):
    n = 4
    field, df = random_cube(spark, n, 4)
    want = {(f, y, x): brute.bilinear(field, f, y * n / n_new, x * n / n_new, n)
            for f in range(6) for y in range(n_new + 1) for x in range(n_new + 1)}
    close(as_dict(sampling.resize_cube(df, n, n_new)), brute.identify(want, n_new))


def test_constant_field_survives_every_resampling(spark):
    n, h = 4, 6
    f = sampling.field_from_expression(spark, n, v=F.lit(7.5))
    ll = sampling.cube_to_lonlat(f, n, h)
    back = sampling.lonlat_to_cube(sampling.resize_lonlat(ll, h, 9), 9, 5)
    for df, rows in ((ll, (h + 1) * 2 * h), (back, 6 * 36)):
        r = df.agg(F.count("v"), F.min("v"), F.max("v")).first()
        assert r[0] == rows and abs(r[1] - 7.5) < 1e-9 and abs(r[2] - 7.5) < 1e-9


def test_poles_of_projected_field_are_exact_axis_points(spark):
    n, h = 4, 6
    field, df = random_cube(spark, n, 5)
    poles = sampling.cube_to_lonlat(df, n, h).where(F.col("y").isin(0, h)).groupBy("y").agg(
        F.min("v").alias("a"), F.max("v").alias("b")).collect()
    for r in poles:
        want = brute.sample(field, (0, 0, 1 if r.y == 0 else -1), n)
        assert abs(r.a - want) < 1e-12 and r.a == r.b


def test_hot_keys_are_spread_and_results_stay_whole(spark):
    rows = spark.range(30000).select("id", F.when(F.col("id") % 3 == 0, F.lit(5)).otherwise(
        (F.col("id") % 1000).cast("int")).alias("k"))
    table = spark.range(1000).select(F.col("id").cast("int").alias("k"), (F.col("id") * 10).alias("v"))
    plain = lookup.keyed_lookup(rows, table, ["k"])
    spread = lookup.keyed_lookup(rows, table, ["k"], spread_hot_keys=True, hot_share=0.05, salts=16)
    assert spread.columns == plain.columns
    assert spread.exceptAll(plain).isEmpty() and plain.exceptAll(spread).isEmpty()
    assert spread.count() == 30000


def test_lookup_without_size_bound_is_not_broadcast_by_hint(spark):
    small = spark.range(10).withColumnRenamed("id", "k")
    assert lookup.broadcast_if_bounded(small, None) is small
    assert lookup.broadcast_if_bounded(small, 10 ** 9) is small
    assert lookup.broadcast_if_bounded(small, 10) is not small


def test_results_do_not_depend_on_partitioning(spark):
    n = 4
    _, df = random_cube(spark, n, 6)
    got = []
    for parts in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got.append(as_dict(filters.filter_cube_axis(df.repartition(int(parts)), n, [0.25, 0.5, 0.25], "x")))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    close(got[0], got[1], 1e-12)


def test_checkpoint_folder_is_taken_from_the_session(spark):
    assert store.checkpoint_folder(spark) == store.checkpoint_folder(spark)


def test_generators(spark):
    assert grids.cube_nodes(spark, 3).distinct().count() == 96
    assert grids.lonlat_nodes(spark, 3).distinct().count() == 24
    plan = grids.tile_plan(spark, 24, 8, 4, include_endpoint=True)
    assert plan.count() == 6 * 8 * 8 and plan.agg(F.min("ty"), F.max("tx")).first() == (-4, 24)
    assert list(grids.tile_origins(24, 8, 4)) == list(range(-4, 24, 4))
    with pytest.raises(ValueError):
        grids.window_pixels(spark, 8, 16)
    with pytest.raises(ValueError):
        grids.window_pixels(spark, 8, 8, (0, -1, 4, 4))
