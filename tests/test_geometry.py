import math
import random

import brute
import pytest
from pyspark.sql import functions as F

from sphereframe.functions import climate_math as cm
from sphereframe.functions import geometry as g
from sphereframe.operators import sampling
from sphereframe.sources import grids


def test_directions_match_tangent_form_inside_and_great_circle_outside(spark):
    rows = [(f, y, x) for f in range(6) for y in (-3.5, 0.0, 1.25, 4.0, 8.0, 9.0) for x in (-2.0, 0.5, 8.0, 10.0)]
    df = spark.createDataFrame(rows, "face int, y double, x double")
    for row in g.add_direction(df, 8).collect():
        want = brute.great_circle(row.face, row.y, row.x, 8)
        assert all(abs(a - b) < 1e-12 for a, b in zip((row.vx, row.vy, row.vz), want))
        if 0 <= row.y <= 8 and 0 <= row.x <= 8:
            inside = brute.direction(row.face, row.y, row.x, 8)
            assert all(abs(a - b) < 1e-12 for a, b in zip((row.vx, row.vy, row.vz), inside))


def test_degenerate_angles_fall_back_to_the_face_plane(spark):
    df = spark.createDataFrame([(f, 12.0, 12.0) for f in range(6)], "face int, y double, x double")
    for row in g.add_direction(df, 8).collect():  # both angles are exactly 90 degrees
        want = brute.unit(tuple(brute.R[row.face][k] + brute.D[row.face][k] for k in range(3)))
        assert all(abs(a - b) < 1e-9 for a, b in zip((row.vx, row.vy, row.vz), want))


def test_unit_cube_points_have_largest_component_one(spark):
    out = g.add_direction(grids.cube_nodes(spark, 5), 5, normalize=False)
    worst = out.agg(F.max(F.abs(F.greatest(F.abs("vx"), F.abs("vy"), F.abs("vz")) - 1))).first()[0]
    assert worst < 1e-15


def test_round_trip_of_random_directions(spark):
    rng = random.Random(3)
    rows = [(i, *brute.unit([rng.gauss(0, 1) for _ in range(3)])) for i in range(3000)]
    df = spark.createDataFrame(rows, "i int, vx double, vy double, vz double")
    c = g.add_cube_coordinates(df, 16)
    back = g.add_direction(c, 16, y="cy", x="cx", out=("bx", "by", "bz"))
    err = back.agg(F.max(F.abs(F.col("vx") - F.col("bx")) + F.abs(F.col("vy") - F.col("by"))
                         + F.abs(F.col("vz") - F.col("bz")))).first()[0]
    assert err < 1e-12
    for row in c.limit(200).collect():
        f, y, x = brute.chart((row.vx, row.vy, row.vz), 16)
        assert f == row.face and abs(y - row.cy) < 1e-9 and abs(x - row.cx) < 1e-9


def test_ties_go_to_the_first_axis_and_zero_is_positive(spark):
    s = 1 / math.sqrt(2)
    rows = [(s, s, 0.0, 0), (-s, s, 0.0, 2), (0.0, s, s, 1), (0.0, -s, -s, 3), (0.0, 0.0, 1.0, 4), (0.0, 0.0, -1.0, 5)]
    df = spark.createDataFrame(rows, "vx double, vy double, vz double, want int")
    assert df.where(g.owning_face() != F.col("want")).count() == 0


def test_area_weight_integrates_to_the_sphere(spark):
    n = 48
    mid = grids.cube_nodes(spark, n).where((F.col("y") < n) & (F.col("x") < n)).withColumns(
        {"y": F.col("y") + 0.5, "x": F.col("x") + 0.5})
    total = g.add_area_weight(mid, n).agg(F.sum("area")).first()[0]
    step = math.pi / 2 / n
    assert abs(total * step * step - 4 * math.pi) < 2e-3


@pytest.mark.parametrize("n", [2, 3, 8])
def test_alias_counts(spark, n):
    sizes = {r.aliases: r.nodes for r in sampling.alias_group_sizes(grids.cube_nodes(spark, n), n).collect()}
    assert sizes[3] == 8 and sizes.get(2, 0) == 12 * (n - 1) and sum(sizes.values()) == 6 * n * n + 2


def test_key_aliases_are_inverse_of_node_key(spark):
    n = 5
    kx, ky, kz = g.node_key("face", "y", "x", n)
    keyed = grids.cube_nodes(spark, n).select("face", "y", "x", kx.alias("kx"), ky.alias("ky"), kz.alias("kz"))
    wrong = keyed.where(~F.array_contains(g.key_aliases(n), F.struct("face", "y", "x"))).count()
    want = {k: sorted(v) for k, v in brute.groups(n).items()}
    got = {(r.kx, r.ky, r.kz): sorted(map(tuple, r.a)) for r in keyed.select("kx", "ky", "kz").distinct().withColumn(
        "a", g.key_aliases(n)).collect()}
    assert wrong == 0 and got == want


def test_fold_matches_reflection(spark):
    h = 4
    df = spark.range(0, 40).select((F.col("id") - 20).alias("y"), (F.col("id") * 3 - 50).alias("x"))
    fy, fx = g.fold_lonlat("y", "x", h)
    for r in df.select("y", "x", fy.alias("fy"), fx.alias("fx")).collect():
        assert (r.fy, r.fx) == brute.fold(r.y, r.x, h)


def test_signed_roots_and_nearest(spark):
    df = spark.createDataFrame([(-6.25,), (0.0,), (9.0,)], "v double")
    got = df.select(g.signed_sqrt("v"), g.signed_square(g.signed_sqrt("v")), g.nearest_index(F.col("v"))).collect()
    assert [tuple(r) for r in got] == [(-2.5, -6.25, -6), (0.0, 0.0, 0), (3.0, 9.0, 9)]


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(None,), (5.0,), (-5.0,), (0.25,)], "v double")
    assert [r[0] for r in df.select(g.clip("v", -1.0, 1.0)).collect()] == [None, 1.0, -1.0, 0.25]


def test_overlap_weights(spark):
    df = spark.range(8)
    got = df.select(g.linear_overlap_weight("id", 8), g.tent_overlap_weight("id", 8)).collect()
    for k, (a, b) in enumerate(got):
        assert abs(a - (1 - 0.999 * abs(k - 3.5) / 3.5)) < 1e-12
        assert abs(b - max(1e-3, 1 - abs(-1 + 2 * k / 7))) < 1e-12


def test_weight_list_contract(spark):
    texts = ["0.2,0.2,1,0.2,0.2", "1,1,1,1", "1,1,1,1,5", "a,1,1,1,1", "1,1,1,1,nan", "0.001,1,1,1,1"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(cm.parse_weight_list(F.col("t")).isNotNull()).collect()] == [True] + [False] * 5


def test_finalise_climate_extremes(spark):
    rows = list(zip(*[map(float, c) for c in ([-6000, 0, 500, 2500, 8000, 0], [-30.0, -10, 20, 40, 10, 45], [-500.0, -100, 0, 100, 500, 1500],
                    [0.0, 100, 500, 2000, 5000, 10000], [20, 50, 90, 150, 200, 300])]))
    df = spark.createDataFrame(rows, "elev double, temp double, temp_std double, precip double, precip_cv double")
    a, b, p1, p99 = -8.0, 500.0, 60.0, 1400.0
    out = cm.finalise_climate(df, a_temp_std=a, b_temp_std=b, temp_std_p1=p1, temp_std_p99=p99).collect()
    for (e, t, s, p, c), got in zip(rows, out):
        lapse = min(max(-6.5 + 0.0015 * p, -9.8), -4) / 1000
        t = min(max(t + lapse * max(0, e), -10), 40)
        t = t if t > 20 else (t - 20) * 1.25 + 20
        base = max(p1, -(a * t + b))
        s = max((s - p1) / (p99 - p1) * (p99 - base) + base + a * t + b, 20)
        c *= max(0, (185 - 0.04111 * p) / 185)
        assert all(abs(x - y) < 1e-9 for x, y in zip((got.temp, got.temp_std, got.precip_cv), (t, s, c)))
