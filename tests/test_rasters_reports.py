import math
import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_filters_tiles import ll_dict
from test_sampling import as_dict, close, random_cube, random_lonlat

from sphereframe.functions import geometry as g
from sphereframe.operators import climate, distribution, filters, quality, raster, region, sampling
from sphereframe.sources import grids, guide, store

REQUEST = "request_id int, west double, south double, east double, north double, width int, height int"


# ----------------------------------------------------------------------------- rasters
def pixel_frame(spark, a):
    rows = [("heightmap", r, c, None if math.isnan(v) else float(v)) for (r, c), v in np.ndenumerate(a)]
    return spark.createDataFrame(rows, "band string, row_i int, col_i int, v double")


def nodes_of(spark, a):
    h = a.shape[0]
    px = raster.premultiply(pixel_frame(spark, a)).drop("band")
    return raster.complete_lattice(raster.corner_mean(px, h), h), h


def test_corner_means_wrap_and_share_poles(spark):
    rng = np.random.default_rng(0)
    a = rng.normal(size=(4, 8))
    a[1, 3] = a[0, 0] = np.nan
    nodes, h = nodes_of(spark, a)
    got = {(r.y, r.x): (r.value, r.coverage) for r in nodes.collect()}
    filled, ok = np.nan_to_num(a), (~np.isnan(a)).astype(float)
    for y in range(h + 1):
        for x in range(8):
            for k, p in enumerate((filled, ok)):
                if y in (0, h):
                    want = p[0 if y == 0 else -1].mean()
                else:
                    want = (p[y - 1, x] + p[y, x] + p[y - 1, x - 1] + p[y, x - 1]) / 4
                assert abs(got[y, x][k] - want) < 1e-12


def test_absent_pixels_equal_null_pixels(spark):
    a = np.arange(32, dtype=float).reshape(4, 8)
    a[2, 5] = np.nan
    full, h = nodes_of(spark, a)
    px = raster.premultiply(pixel_frame(spark, a).where("v is not null")).drop("band")
    sparse = raster.complete_lattice(raster.corner_mean(px, h), h)
    assert full.exceptAll(sparse).isEmpty()


def test_footprint_against_a_direct_sum(spark):
    rng = np.random.default_rng(1)
    nodes, h = nodes_of(spark, rng.normal(size=(6, 12)))
    n = 2
    field = {(r.y, r.x): r.value for r in nodes.collect()}
    want = {}
    for f in range(6):
        for y in range(n + 1):
            for x in range(n + 1):
                s = t = 0
                for dy in ((k + 0.5) / 8 - 0.5 for k in range(8)):
                    for dx in ((k + 0.5) / 8 - 0.5 for k in range(8)):
                        v = brute.great_circle(f, y + dy, x + dx, n)
                        a, b = (math.pi / 4 * (2 * i / n - 1) for i in (x + dx, y + dy))
                        w = math.cos(a) * math.cos(b) / (math.cos(b) ** 2 + (math.cos(a) * math.sin(b)) ** 2) ** 1.5
                        s += w * brute.lonlat(field, h * (0.5 - math.asin(v[2]) / math.pi), h * (math.atan2(v[1], v[0]) / math.pi + 1), h)
                        t += w
                want[f, y, x] = s / t
    got = raster.raster_to_cube(nodes, h, n).select("face", "y", "x", F.col("value").alias("v"))
    close(as_dict(got), brute.identify(want, n))


def test_footprint_samples_merge_before_the_lookup(spark, monkeypatch):
    nodes, h = nodes_of(spark, np.random.default_rng(3).normal(size=(6, 12)))
    looked_up, lookup = [], sampling.keyed_lookup
    monkeypatch.setattr(sampling, "keyed_lookup", lambda rows, *a, **k: looked_up.append(rows.count()) or lookup(rows, *a, **k))
    assert raster.footprint_mean(grids.cube_nodes(spark, 4), nodes, h, 4).count() == 150
    assert looked_up[0] < 150 * 64 / 4  # of 64 samples a node


def test_constant_raster_and_full_gap(spark):
    nodes, h = nodes_of(spark, np.full((4, 8), -1600.0))
    r = raster.raster_to_cube(nodes, h, 2).agg(F.min("value"), F.max("value"), F.min("coverage")).first()
    assert abs(r[0] + 1600) < 1e-9 and abs(r[1] + 1600) < 1e-9 and abs(r[2] - 1) < 1e-12
    gap, h = nodes_of(spark, np.full((4, 8), np.nan))
    imported = raster.raster_to_cube(gap, h, 2)
    fallback = sampling.field_from_expression(spark, 2, heightmap=F.lit(-900.0))
    out = raster.build_guide({"heightmap": imported}, fallback, 2)
    assert out.agg(F.max(F.abs(F.col("heightmap") + 30.0))).first()[0] < 1e-9  # encoded fallback


def test_fill_blends_in_metres_then_encodes(spark):
    n = 2
    imported = grids.cube_nodes(spark, n).withColumns({"value": F.lit(50.0), "coverage": F.lit(0.5)})
    fallback = sampling.field_from_expression(spark, n, heightmap=F.lit(10.0))  # signed root of 100 m
    out = raster.fill(imported, fallback, n, "heightmap", space="metres")
    assert out.agg(F.max(F.abs(F.col("heightmap") - 10.0))).first()[0] < 1e-9  # 50 + half of 100 = 100 m


def test_contract_violations(spark):
    good = pixel_frame(spark, np.ones((4, 8)))
    assert raster.require_raster(good, 4) is good
    with pytest.raises(ValueError):
        raster.require_raster(good.withColumn("row_i", F.col("row_i") + 1), 4)
    bad = good.withColumns({"band": F.lit("precipitation"), "v": F.lit(-1.0)})
    with pytest.raises(ValueError):
        raster.require_raster(bad, 4)
    with pytest.raises(ValueError):
        raster.check_draft_parameters(10.0, 10.0, 0.2)


def test_draft_mappings(spark):
    px = spark.createDataFrame([(0, 0, 0, 8, 1.0), (0, 1, 255, 8, 1.0), (0, 2, 65535, 16, 1.0), (0, 3, 128, 8, 0.0)],
                               "row_i int, col_i int, code int, bits int, alpha double")
    new = {"mapping_version": "linear-v1", "black_metres": -100.0, "white_metres": 900.0}
    assert [r.value for r in raster.draft_pixels(px, new).orderBy("col_i").collect()] == [-100.0, 900.0, 900.0, 0.0]
    old = {"ocean_depth_hint_metres": 0.0, "white_metres": 900.0}
    assert [r.value for r in raster.draft_pixels(px, old).orderBy("col_i").collect()] == [-2000.0, 900.0, 900.0, 0.0]


def test_guide_of_requested_nodes_equals_full_guide(spark, tmp_path):
    n = 2
    px = pixel_frame(spark, np.random.default_rng(2).normal(size=(4, 8)) * 1000)
    px.drop("band").write.parquet(str(tmp_path / "heightmap.parquet"))
    channels = guide.read_channels(spark, str(tmp_path))
    assert set(channels) == {"heightmap"}
    source = guide.RasterGuide({c: (p, 4) for c, p in channels.items()}, seed=3)
    full = source.guide(n)
    assert full.columns == ["face", "y", "x", *guide.CHANNELS]
    nodes = spark.createDataFrame([(0, 0, 0), (3, 1, 1), (5, 2, 1)], "face int, y int, x int")
    keyed = {(r.face, r.y, r.x): r.heightmap for r in full.collect()}
    for r in source.guide_nodes(nodes, n).collect():
        assert abs(r.heightmap - keyed[r.face, r.y, r.x]) < 1e-9
    with pytest.raises(ValueError):
        guide.read_channels(spark, str(tmp_path / "none"))


def test_brightness_guide_uses_the_map_only_where_opaque(spark):
    px = grids.pixel_lattice(spark, 4, 8).withColumns(
        {"code": F.lit(255), "bits": F.lit(8), "alpha": F.when(F.col("col_i") < 8, 1.0).otherwise(0.0)})
    info = {"mapping_version": "linear-v1", "black_metres": -100.0, "white_metres": 900.0}
    out = guide.BrightnessGuide(px, 4, info).guide(2)
    assert out.agg(F.max(F.abs(F.col("heightmap") - 30.0))).first()[0] < 1e-9


# ----------------------------------------------------------------------------- climate
def regression(t, e, win):
    """Direct sums over every valid window."""
    out, half = {}, win // 2
    for y in range(half, t.shape[0] - half):
        for x in range(half, t.shape[1] - half):
            tt, ee = t[y - half:y + half + 1, x - half:x + half + 1], e[y - half:y + half + 1, x - half:x + half + 1]
            land = ee > 0
            cover = land.mean()
            mean = lambda a: (a * land).mean() / (cover + 1e-6)
            me, mt, var = mean(ee), mean(tt), mean(ee * ee) - mean(ee) ** 2
            beta = -0.0065 if var < 1 or cover < 0.02 else (mean(ee * tt) - me * mt) / (var + 1e-6)
            beta = min(max(beta, -0.012), 0.0)
            out[y, x] = (t[y, x] - beta * e[y, x], beta)
    return out


@pytest.mark.parametrize("block", [4096, 6])
@pytest.mark.parametrize("slope,ocean", [(-0.0065, False), (0.01, False), (-0.02, False), (-0.005, True)])
def test_lapse_rate(spark, slope, ocean, block):
    rng = np.random.default_rng(4)
    e = rng.uniform(1, 3000, (12, 13))
    if ocean:
        e[rng.random(e.shape) < 0.6] = 0
    t = 25 + slope * e + rng.normal(size=e.shape) * (1 if ocean else 0)
    df = spark.createDataFrame([(y, x, float(t[y, x]), float(v)) for (y, x), v in np.ndenumerate(e)],
                               "y int, x int, temp double, elev double")
    got = {(r.y, r.x): (r.baseline, r.beta) for r in climate.local_baseline(df, [], (0, 11), (0, 12), win=7, block=block).collect()}
    want = regression(t, e, 7)
    assert got.keys() == want.keys()
    assert max(abs(got[k][i] - want[k][i]) for k in want for i in (0, 1)) < 1e-6


def test_flat_land_uses_the_standard_lapse(spark):
    df = grids.pixel_lattice(spark, 17, 17).select(F.col("row_i").alias("y"), F.col("col_i").alias("x"),
                                                   F.lit(20.0).alias("temp"), F.lit(10.0).alias("elev"))
    r = climate.local_baseline(df, [], (0, 16), (0, 16)).agg(F.min("beta"), F.max("beta"), F.min("baseline")).first()
    assert r[0] == r[1] == -0.0065 and abs(r[2] - 20.065) < 1e-9


def test_climate_features_of_a_constant_world(spark):
    n = 4
    coarse = sampling.field_from_expression(spark, n, z=F.lit(10.0), temp=F.lit(20.0), temp_std100=F.lit(350.0),
                                            precip=F.lit(1000.0), precip_cv=F.lit(50.0))
    f = climate.climate_features(coarse, n)
    p = spark.createDataFrame([(1, 10.0, 20.0, 1000.0), (2, 179.9, -89.0, -50.0)], "i int, lon double, lat double, e double")
    got = {r.i: r for r in climate.climate_at(p, f, n, "e").collect()}
    assert abs(got[1].temp - (20 + 0.0065 * 100 - 6.5)) < 1e-9 and abs(got[2].temp - 20.65) < 1e-9
    assert abs(got[1].temp_std - 3.5) < 1e-9 and f.schema["beta"].metadata["unit"] == "degC/m"


# ----------------------------------------------------------------------------- distributions
def test_exact_quantiles_with_one_dominant_value(spark):
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.normal(size=4000), np.full(2500, 0.125), [np.nan] * 5])
    rng.shuffle(v)
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    points = distribution.quantile_points()
    got = {r.i: r.q for r in distribution.exact_quantiles(df, "v", points, partitions=5).collect()}
    want = np.quantile(v[~np.isnan(v)], points)
    assert len(got) == 64 and max(abs(got[i] - want[i]) for i in range(64)) < 1e-12


def test_quantiles_per_channel(spark):
    rng = np.random.default_rng(8)
    groups = {"a": rng.normal(size=900), "b": np.full(700, 2.0), "c": rng.uniform(size=3)}
    df = spark.createDataFrame([(k, float(x)) for k, v in groups.items() for x in v], "channel string, v double")
    points = [0.0, 0.1, 0.5, 0.999, 1.0]
    got = {(r.channel, r.i): r.q for r in distribution.exact_quantiles(df, "v", points, ["channel"], partitions=3).collect()}
    for k, v in groups.items():
        assert max(abs(got[k, i] - q) for i, q in enumerate(np.quantile(v, points))) < 1e-12


def test_single_value_and_tie_repair(spark):
    df = spark.createDataFrame([(3.0,)] * 10, "v double")
    q = distribution.quantile_table(df, "v", "c").first()["q"]
    assert len(q) == 64 and q[0] == 3.0 and all(b > a for a, b in zip(q, q[1:]))
    t = spark.createDataFrame([([1.0, 1.0, 1.0, 2.0, 5.0, 5.0],)], "q array<double>")
    got = distribution.break_ties(t).first()["q"]
    assert np.allclose(got, [1.0, 1.1, 1.2, 2.0, 5.0, 5.1])


def test_quantile_mapping_is_a_clamped_interpolation(spark):
    rng = np.random.default_rng(6)
    s, t = np.sort(rng.normal(size=64)), np.sort(rng.uniform(0, 9, 64))
    make = lambda q: spark.createDataFrame([("a", [float(x) for x in q])], "channel string, q array<double>")
    v = [float(x) for x in np.concatenate([rng.normal(size=300) * 2, s])]
    df = spark.createDataFrame([("a", x) for x in v], "channel string, v double")
    got = [(r.v, r.mapped) for r in distribution.quantile_map(df, "v", make(s), make(t)).collect()]
    assert max(abs(m - np.interp(x, s, t)) for x, m in got) < 1e-9


@pytest.mark.parametrize("portable", [True, False])
def test_noise_is_unit_shared_and_independent_of_order(spark, portable):
    n = 40
    nodes = grids.cube_nodes(spark, n)
    a = distribution.gaussian_cube_noise(nodes, n, 2 ** 64 - 1, 3, portable=portable)
    r = a.agg(F.avg("noise"), F.stddev_pop("noise")).first()
    assert abs(r[0]) < 0.05 and abs(r[1] - 1) < 0.05
    assert quality.shared_node_error(a.withColumnRenamed("noise", "v"), n).first()[0] == 0
    part = distribution.gaussian_cube_noise(nodes.where("face = 2").repartition(3), n, 2 ** 64 - 1, 3, portable=portable)
    assert part.exceptAll(a).isEmpty()
    other = distribution.gaussian_cube_noise(nodes, n, 2 ** 64 - 1, 4, out="w", portable=portable)
    assert abs(a.join(other, ["face", "y", "x"]).agg(F.corr("noise", "w")).first()[0]) < 0.05
    poles = distribution.gaussian_lonlat_noise(grids.lonlat_nodes(spark, 6), 6, 1, 2, portable=portable)
    assert poles.where("y in (0, 6)").select("y", "noise").distinct().count() == 2


def test_ocean_drop_keeps_land_and_about_half_of_the_sea(spark):
    df = spark.range(4000).select("id", F.when(F.col("id") < 2000, -5.0).when(F.col("id") < 2010, -40000.0).otherwise(3.0).alias("e"))
    kept = distribution.drop_ocean_rows(df, "e", 0.5, ["id"])
    assert kept.where("e >= 0").count() == 1990 and kept.where("e < -30000").count() == 0
    assert 850 < kept.where("e < 0").count() < 1150


def test_smooth_guide_is_continuous_and_seeded(spark):
    a = distribution.smooth_guide_cube(spark, 7, 4)
    b = distribution.smooth_guide_cube(spark, 8, 4)
    assert quality.shared_node_error(a.withColumnRenamed("heightmap", "v"), 4).first()[0] == 0
    assert quality.field_error(a.withColumnRenamed("heightmap", "v"), b.withColumnRenamed("heightmap", "v"),
                               ["face", "y", "x"]).first().rmse > 1
    ll = distribution.smooth_guide_lonlat(spark, 7, 6)
    assert ll.where("y in (0, 6)").select("y", "heightmap").distinct().count() == 2


# ----------------------------------------------------------------------------- regions
def test_validation_codes(spark):
    rows = [(1, 170.0, -10.0, -170.0, 10.0, 4, 2), (2, 0.0, 0.0, 0.0, 1.0, 4, 2), (3, 0.0, 5.0, 1.0, 1.0, 4, 2),
            (4, 0.0, -91.0, 1.0, 1.0, 4, 2), (5, float("nan"), 0.0, 1.0, 1.0, 4, 2), (6, 0.0, 0.0, 1.0, 1.0, 1000, 1000),
            (7, 0.0, 0.0, 1.0, 1.0, 0, 2), (8, 0.0, 0.0, 181.0, 1.0, 4, 2), (9, -180.0, -90.0, 180.0, 90.0, 8, 4)]
    df = spark.createDataFrame(rows, REQUEST)
    got = {r.request_id: r.error for r in region.validate(df, 1024).collect()}
    assert got == {1: None, 2: "bounds_order", 3: "bounds_order", 4: "bounds_order", 5: "bounds_not_finite",
                   6: "exceeds_native_detail", 7: "size_not_positive", 8: "longitude_out_of_range", 9: None}


def test_guide_heights(spark):
    df = spark.createDataFrame([(1, -2.0, -2.0, 2.0, 2.0, 512, 512), (2, -180.0, -90.0, 180.0, 90.0, 128, 64)], REQUEST)
    assert {r.request_id: r.guide_height for r in region.preview_guide_height(df).collect()} == {1: 92, 2: 4}


@pytest.mark.parametrize("prune", [False, True])
def test_region_pixels_match_direct_samples(spark, prune):
    n = 6
    field, df = random_cube(spark, n, 11)
    rows = [(1, 170.0, -10.0, -170.0, 10.0, 5, 4), (2, -180.0, 80.0, 180.0, 90.0, 6, 3), (3, 0.0, 9.0, 1.0, 1.0, 4, 2)]
    requests = spark.createDataFrame(rows, REQUEST)
    out = region.region_query(requests, df, n, signed_root="v", prune=prune).collect()
    squared = {k: math.copysign(v * v, v) for k, v in field.items()}
    assert len(out) == 20 + 18
    for r in out:
        _, w, s, e, nn, width, height = rows[r.request_id - 1]
        e = e + 360 if e < w else e
        lon, lat = (math.radians(a) for a in (w + (r.col_i + 0.5) * (e - w) / width, nn - (r.row_i + 0.5) * (nn - s) / height))
        v = (math.cos(lat) * math.cos(lon), math.cos(lat) * math.sin(lon), math.sin(lat))
        assert abs(r.v - brute.sample(squared, v, n)) < 1e-9


def test_window_equals_global_and_edges(spark):
    h = 8
    field, df = random_lonlat(spark, h, 12)
    whole = {(r.row_i, r.col_i): r.v for r in region.export_window(df, h, h).collect()}
    win = region.export_window(df, h, h, (12, 2, 8, 4)).collect()
    assert len(win) == 32 and all(r.v == whole[r.row_i + 2, (r.col_i + 12) % 16] for r in win)
    assert max(r.lon for r in win) > 180
    assert abs(whole[0, 0] - brute.lonlat(field, 0.5, 0.5, h)) < 1e-12


def test_cost_guard(spark):
    r = spark.createDataFrame([(1,), (2,)], "request_id int")
    est = spark.createDataFrame([(1, 10), (2, 5000)], "request_id int, tiles bigint")
    assert {x.request_id: x.error for x in region.guard_cost(r, est, 2000).collect()} == {1: None, 2: "too_many_tiles"}
    assert region.guard_cost(r, est, None).where("error is not null").isEmpty()


# ----------------------------------------------------------------------------- reports
def test_phase_report_sees_a_lattice_artifact(spark):
    h = 32
    base = sampling.add_node_direction(grids.lonlat_nodes(spark, h), h)
    smooth = base.select("y", "x", (F.col("vx") + F.col("vy")).alias("v"))
    striped = smooth.withColumn("v", F.col("v") + F.when(F.col("y") % 8 == 3, F.pmod("x", F.lit(2))).otherwise(0))
    low, high = (quality.grid_phase_report(d, h + 1, 2 * h).first().row_phase_ratio for d in (smooth, striped))
    assert low < 1.3 and high > 4


def test_edge_report_of_a_smooth_field_is_near_one(spark):
    n = 24
    f = sampling.field_from_expression(spark, n, v=F.col("vx") + 2 * F.col("vy") + F.lit(0.3) * F.col("vz"))
    rows = quality.edge_report(f, n).collect()
    assert len(rows) == 12 and all(0.8 < r.ratio < 1.25 for r in rows)
    steep = f.withColumn("v", F.col("v") + F.when(F.col("face") == 4, 5.0).otherwise(0.0))
    assert quality.edge_report(steep, n).agg(F.max("ratio")).first()[0] > 3
    assert abs(quality.shared_node_error(steep, n).first()[0] - 5) < 1e-9


def test_isotropic_field_has_ratio_one(spark):
    h = 64
    d = sampling.add_node_direction(grids.lonlat_nodes(spark, h), h).select("y", "x", (F.col("vx") + F.col("vz")).alias("v"))
    rows = {r.latitude_degrees: r for r in quality.polar_anisotropy(d, h).collect()}
    assert len(rows) == 13
    equator = rows[0.0]  # d/d(east) of vx is -sin(lon); d/d(north) is vz's slope, one
    assert abs(equator.direction_ratio - math.sqrt(0.5)) < 0.02


def test_state_report_flags_a_steep_seam_and_a_wrong_checksum(spark):
    h = 16
    d = sampling.add_node_direction(grids.lonlat_nodes(spark, h), h).select("y", "x", F.col("vz").alias("v"))
    good = quality.verify_state(d, h).first()
    assert good.passed and good.nodes == 17 * 32 and good.pole_n == 0
    steep = d.withColumn("v", F.when((F.col("x") == 0) & F.col("y").between(1, h - 1), 10000.0).otherwise(0.0))
    s = quality.verify_state(steep, h).first()
    assert s.passed and s.seam_outlier and not good.seam_outlier  # continuous, yet anomalous
    total = store.content_checksum(d, ["y", "x"]).first().asDict()
    assert quality.verify_state(d, h, total).first().passed
    assert not quality.verify_state(d.withColumn("v", F.col("v") + (F.col("y") == 3).cast("int")), h, total).first().passed
    broken = d.withColumn("v", F.when((F.col("y") == 0) & (F.col("x") == 1), 5.0).otherwise(F.col("v")))
    assert not quality.verify_state(broken, h).first().passed
    short = quality.verify_region(d, ["y", "x"], total).first()
    assert short.passed and short.finite


def test_tile_boundary_ratio_sees_jumps_at_the_stride(spark):
    n = 48
    f = grids.cube_nodes(spark, n).withColumn("v", F.floor(F.col("x") / 16) * 5.0 + F.col("x") * 0.1 + F.floor(F.col("y") / 16) * 5.0 + F.col("y") * 0.1)
    r = quality.tile_boundary_ratio(f, n, 16).first()
    assert abs(r.boundary_rms - 5.1) < 1e-9 and abs(r.nearby_rms - 0.1) < 1e-9


def test_land_metrics_and_layout(spark):
    h = 8
    d = sampling.add_node_direction(grids.lonlat_nodes(spark, h), h).select("y", "x", (F.col("vz") * 100).alias("v"))
    same = quality.land_metrics(d, d, h).first()
    assert same.land_iou == 1 and same.agreement == 1 and same.rmse == 0 and abs(same.mean_elevation) < 1e-9
    with pytest.raises(Exception, match="same keys"):
        quality.land_metrics(d.where("y <> 2"), d, h).collect()
    with pytest.raises(Exception, match="same keys"):
        quality.field_error(d.where("y <> 2"), d, ["y", "x"]).collect()
    opposite = quality.land_metrics(d, d.withColumn("v", -F.col("v")), h).first()
    assert opposite.land_iou == 0
    painted = grids.pixel_lattice(spark, 16, 32).withColumn("code", F.when(F.col("row_i") < 8, 200).otherwise(0))
    values = grids.pixel_lattice(spark, 8, 16).withColumn("v", F.when(F.col("row_i") < 4, 10.0 + F.col("col_i")).otherwise(-5.0))
    r = quality.layout_compare(values, painted, 8, 2, 4000.0).first()
    assert r.land_iou == r.agreement == r.painted_land_kept == r.painted_ocean_below_sea == 1 and r.ocean_std == 0


def test_same_rows_reports_both_sides(spark):
    a, b = spark.range(5), spark.range(1, 7)
    assert {r.id: r.surplus for r in quality.same_rows(a, b).collect()} == {0: 1, 5: -1, 6: -1}


def test_same_rows_counts_only_rows_of_unequal_buckets(spark):
    rows = spark.range(1000).selectExpr("id % 400 AS k", "if(id % 7 = 0, null, id % 5 / 3D) AS v")
    zeros = spark.sql("SELECT 0L AS k, 0D AS v UNION ALL SELECT 1L, double('NaN')")
    signed = spark.sql("SELECT 0L AS k, -0D AS v UNION ALL SELECT 1L, double('NaN')")
    equal = quality.same_rows(rows.unionByName(zeros), signed.unionByName(rows))
    assert equal.isEmpty() and "LeftSemi" in equal._jdf.queryExecution().optimizedPlan().toString()
    changed = quality.same_rows(rows, rows.where("k <> 3").unionByName(rows.where("k = 3").selectExpr("k + 1000 AS k", "v")))
    assert sum(r.surplus for r in changed.collect()) == 0 and {r.k for r in changed.collect()} == {3, 1003}
