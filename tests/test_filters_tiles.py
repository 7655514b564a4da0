import math
import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_sampling import as_dict, close, random_cube, random_lonlat

from sphereframe.functions import geometry as g
from sphereframe.operators import filters, sampling, tiles
from sphereframe.sources import grids, store, tile_store
from sphereframe.streaming import requests as stream

WEIGHTS = [0.1, 0.2, 0.4, 0.2, 0.1]


def ll_dict(df):
    return {(r.y, r.x): r.v for r in df.collect()}


def constrain(field, h):
    w, out = 2 * h, dict(field)
    for y in (0, h):
        mean = sum(field[y, x] for x in range(w)) / w
        out.update({(y, x): mean for x in range(w)})
    for y in {1, h - 1}:
        modes = np.fft.rfft([field[y, x] for x in range(w)])
        modes[2:] = 0
        out.update({(y, x): float(v) for x, v in enumerate(np.fft.irfft(modes, n=w))})
    return out


@pytest.mark.parametrize("block", [4096, 3])
def test_cube_filter_with_and_without_blocks(spark, block):
    n = 4
    field, df = random_cube(spark, n, 1)
    want = brute.filter_axis(brute.filter_axis(field, n, WEIGHTS, "x"), n, WEIGHTS, "y")
    close(as_dict(filters.filter_cube(df, n, WEIGHTS, block=block)), want)


def test_cube_reduce_keeps_every_other_node(spark):
    n = 4
    field, df = random_cube(spark, n, 2)
    tri = [0.25, 0.5, 0.25]
    full = brute.filter_axis(brute.filter_axis(field, n, tri, "x"), n, tri, "y")
    want = {(f, y // 2, x // 2): v for (f, y, x), v in full.items() if y % 2 == 0 and x % 2 == 0}
    close(as_dict(filters.reduce_cube(df, n, 2)), want)


@pytest.mark.parametrize("h,weights,block", [(6, WEIGHTS, 4096), (6, WEIGHTS, 5), (2, [1 / 11] * 11, 4096)])
def test_lonlat_filter_wraps_and_folds(spark, h, weights, block):
    """The last case has a kernel wider than the lattice is high."""
    field, df = random_lonlat(spark, h, 3)
    r = len(weights) // 2
    taps = list(zip(range(-r, r + 1), weights))
    row = {(y, x): sum(w * field[y, (x + o) % (2 * h)] for o, w in taps) for y, x in field}
    want = {(y, x): sum(w * row[brute.fold(y + o, x, h)] for o, w in taps) for y, x in field}
    close(ll_dict(filters.filter_lonlat(df, h, weights, constrained=False, block=block)), want)


@pytest.mark.parametrize("scale", [2, 4])
def test_lonlat_reduce_is_the_triangular_gather(spark, scale):
    h = 8
    field, df = random_lonlat(spark, h, 4)
    w = lambda o: (1 - abs(o) / scale) / scale
    want = {(y, x): sum(w(p) * w(q) * field[brute.fold(y * scale + p, x * scale + q, h)]
                        for p in range(1 - scale, scale) for q in range(1 - scale, scale))
            for y in range(h // scale + 1) for x in range(2 * h // scale)}
    close(ll_dict(filters.reduce_lonlat(df, h, scale, constrained=False)), want)
    close(ll_dict(filters.reduce_lonlat(df, h, scale)), constrain(want, h // scale))


def test_operators_that_read_twice_evaluate_their_input_once(spark):
    from sphereframe.operators import distribution
    h, size = 8, 4
    counted = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            counted.add(b.num_rows)
            yield b
    field = spark.range((h + 1) * 2 * h).select(
        (F.col("id") / (2 * h)).cast("int").alias("y"), (F.col("id") % (2 * h)).cast("int").alias("x"), F.sin("id").alias("v"))
    rows = field.count()
    seen = field.mapInArrow(count, field.schema)
    assert filters.constrain(seen, h).count() == rows == counted.value
    distribution.exact_quantiles(seen, "v", [0.1, 0.5]).collect()
    assert counted.value == 2 * rows
    origins = spark.range(9).select(F.lit(0).alias("face"), ((F.col("id") - 1) * 2).cast("int").alias("ty")).crossJoin(
        spark.range(8).select((F.col("id") * 2).cast("int").alias("tx")))
    made = origins.select("*", F.array_repeat(F.lit(1.0), size * size).alias("values"))
    blended = tiles.blend_lonlat(made.mapInArrow(count, made.schema), h, size, window="linear")
    assert blended.count() == rows and counted.value == 2 * rows + made.count()
    with pytest.raises(ValueError, match="uncovered"):
        tiles.blend_lonlat(made.where("tx > 4"), h, size, window="linear")
    caps = filters.constrain(field, h)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(y, [0,1,7,8])" in caps


def test_pole_constraint_is_the_low_pass_of_cap_rows(spark):
    h = 5
    rng = random.Random(9)
    field = {(y, x): rng.uniform(-3, 3) for y in range(h + 1) for x in range(2 * h)}
    df = spark.createDataFrame([(*k, v) for k, v in field.items()], "y int, x int, v double")
    close(ll_dict(filters.constrain(df, h)), constrain(field, h))


def test_low_frequency_merge_leaves_a_consistent_field_alone(spark):
    n = 8
    low = sampling.field_from_expression(spark, n // 2, v=F.lit(3.0))
    zero = sampling.field_from_expression(spark, n, v=F.lit(0.0))
    out = filters.merge_low_frequency_cube(zero, n, low, n // 2).agg(F.min("v"), F.max("v")).first()
    assert abs(out[0] - 3) < 1e-9 and abs(out[1] - 3) < 1e-9


def test_differences_skip_the_first_and_cross_blocks(spark):
    df = spark.range(20).select(F.lit(0).alias("y"), F.col("id").cast("int").alias("x"), (F.col("id") ** 2).alias("v"))
    got = {r.x: r.d for r in filters.differences(df, ["y"], "x", "v", 0, 19, block=6).collect()}
    assert got == {x: x * x - (x - 1) ** 2 for x in range(1, 20)}


# ----------------------------------------------------------------------------- tiles
def weight(k, size):
    mid = (size - 1) / 2
    return 1 - 0.999 * abs(k - mid) / mid


def random_tiles(spark, n, size, stride, seed=0):
    rng = random.Random(seed)
    origins = list(grids.tile_origins(n, size, stride, True))
    t = {(f, y, x): [rng.uniform(-1, 1) for _ in range(size * size)] for f in range(6) for y in origins for x in origins}
    return t, spark.createDataFrame([(*k, v) for k, v in t.items()], "face int, ty int, tx int, values array<double>")


def dense_blend(t, n, size):
    num, den = {}, {}
    for (f, ty, tx), values in t.items():
        for k, v in enumerate(values):
            y, x = ty + k // size, tx + k % size
            if 0 <= y <= n and 0 <= x <= n:
                w = weight(k // size, size) * weight(k % size, size)
                num[f, y, x] = num.get((f, y, x), 0) + w * v
                den[f, y, x] = den.get((f, y, x), 0) + w
    return num, den


def test_blend_with_shared_weights_adds_before_dividing(spark):
    n, size, stride = 8, 8, 6  # with half overlap the summed weights would be equal everywhere
    t, df = random_tiles(spark, n, size, stride)
    num, den = dense_blend(t, n, size)
    want = {}
    for members in brute.groups(n).values():
        v = sum(num[m] for m in members) / sum(den[m] for m in members)
        want.update({m: v for m in members})
    got = tiles.blend_cube(df, n, size).withColumnRenamed("values", "v")
    close(as_dict(got), want)
    mean = brute.identify({k: num[k] / den[k] for k in num}, n)
    close(as_dict(tiles.blend_cube(df, n, size, shared=False).withColumnRenamed("values", "v")), mean)
    assert max(abs(mean[k] - want[k]) for k in want) > 1e-3  # the two rules really differ


def test_repeated_predictions_of_one_hot_tile_all_count(spark):
    n, size, stride = 8, 8, 4
    t, df = random_tiles(spark, n, size, stride)
    hot = spark.range(400).select(F.lit(0).alias("face"), F.lit(0).alias("ty"), F.lit(0).alias("tx"),
                                  F.array_repeat(F.lit(1.0), size * size).alias("values"))
    num, den = dense_blend(t, n, size)
    got = as_dict(tiles.blend_cube(df.unionByName(hot), n, size).withColumnRenamed("values", "v"))
    w = 400 * weight(3, size) * weight(3, size)
    assert abs(got[0, 3, 3] - (num[0, 3, 3] + w) / (den[0, 3, 3] + w)) < 1e-9


def test_blend_at_nodes_equals_dense_blend(spark):
    n, size, stride = 12, 8, 4
    t, df = random_tiles(spark, n, size, stride, 1)
    full = as_dict(tiles.blend_cube(df, n, size).withColumnRenamed("values", "v"))
    rng = random.Random(5)
    nodes = [(rng.randrange(6), rng.randrange(n + 1), rng.randrange(n + 1)) for _ in range(60)] + [(0, 0, 0), (4, n, n)]
    want = spark.createDataFrame(nodes + nodes[:5], "face int, y int, x int")
    got = as_dict(tiles.blend_at_nodes(want, df, n, size, stride, include_endpoint=True).withColumnRenamed("values", "v"))
    close(got, {k: full[k] for k in set(nodes)})
    needed = tiles.tiles_for_nodes(want, n, size, stride, True)
    pruned = tiles.blend_at_nodes(want, tiles.saved_tiles(needed, df), n, size, stride, include_endpoint=True)
    close(as_dict(pruned.withColumnRenamed("values", "v")), got)
    assert needed.count() < df.count()


def test_uncovered_nodes_are_reported(spark):
    n = 8
    _, df = random_tiles(spark, n, 8, 4)
    for shared in (True, False):
        with pytest.raises(Exception, match="uncovered"):
            tiles.blend_cube(df.where("face <> 3"), n, 8, shared=shared).collect()
    with pytest.raises(Exception, match="uncovered"):
        tiles.blend_at_nodes(grids.cube_nodes(spark, n), df.where("face <> 3"), n, 8, 4, include_endpoint=True).collect()
    left = grids.cube_nodes(spark, n).where("face <> 3")
    assert tiles.uncovered_nodes(grids.cube_nodes(spark, n), left).count() == (n + 1) ** 2


def test_incomplete_input_is_an_error(spark):
    field = grids.cube_nodes(spark, 8).withColumn("v", F.lit(1.0))
    origins = spark.createDataFrame([(0, 0, 0), (0, 2, 0)], "face int, ty int, tx int")
    with pytest.raises(Exception, match="multiples of 4"):
        tiles.repeat_context(origins, field, 8, 8, 4).collect()
    for call in (lambda: filters.reduce_cube(field, 8, 3), lambda: filters.merge_low_frequency_cube(field, 8, field, 3),
                 lambda: filters.merge_low_frequency_lonlat(field.select("y", "x", "v"), 8, field, 3)):
        with pytest.raises(ValueError, match="divide"):
            call()
    line = spark.range(20).where("id <> 10").select(F.lit(0).alias("k"), F.col("id").cast("int").alias("x"), F.lit(1.0).alias("v"))
    with pytest.raises(Exception, match="gaps along x"):
        filters.tap_filter(line, ["k"], "x", [0.25, 0.5, 0.25], ["v"], 1, 18).collect()
    with pytest.raises(Exception, match="gaps along x"):
        filters.differences(line, ["k"], "x", "v", 0, 19).collect()


def test_context_scoring_and_batches(spark):
    n, size, stride = 8, 8, 4
    field, df = random_cube(spark, n, 7)
    origins = grids.tile_plan(spark, n, size, stride, True)
    ctx = tiles.gather_context(origins.unionByName(origins), df, n, size)  # repeats collapse
    rows = {(r.face, r.ty, r.tx): r["values"] for r in ctx.collect()}
    assert len(rows) == ctx.count() == origins.count()
    for key in [(0, -4, -4), (4, 4, 0), (5, 8, 8)]:
        for k, v in enumerate(rows[key]):
            f, y, x = key[0], key[1] + k // size, key[2] + k % size
            if not (0 <= y <= n and 0 <= x <= n):
                f, y, x = brute.chart(brute.great_circle(f, y, x, n), n)
            assert abs(v - field[f, int(y + 0.5), int(x + 0.5)]) < 1e-9
    one, many = (tiles.score_tiles(ctx, tiles.stencil_scorer(0.5), size, batch=b) for b in (1, 50))
    as_text = lambda d: d.select("face", "ty", "tx", F.transform("values", lambda v: F.round(v, 9)).alias("v"))
    assert as_text(one).exceptAll(as_text(many)).isEmpty()
    columns = ctx.withColumn("values", tiles.stencil_column("values", size, 0.5))
    assert as_text(one).exceptAll(as_text(columns)).isEmpty()


def test_bad_scorer_output_is_refused(spark):
    ctx = spark.createDataFrame([(0, 0, 0, [1.0] * 4)], "face int, ty int, tx int, values array<double>")
    with pytest.raises(Exception, match="finite tile"):
        tiles.score_tiles(ctx, lambda: (lambda a: a["values"] * float("nan")), 2).collect()


def test_multi_channel_blend_equals_single(spark):
    n = 8
    _, df = random_tiles(spark, n, 8, 4)
    two = df.withColumn("more", F.transform("values", lambda v: v * 3))
    out = tiles.blend_cube(two, n, 8, channels=["values", "more"])
    assert out.agg(F.max(F.abs(F.col("more") - 3 * F.col("values")))).first()[0] < 1e-9


def test_incremental_scoring_only_adds_missing_tiles(spark, tmp_path):
    n, size = 8, 8
    _, df = random_cube(spark, n, 8)
    plan = grids.tile_plan(spark, n, size, 4, True)
    saved = tile_store.open_tiles(spark, str(tmp_path / "store"), size, {"model": 1})
    contexts = lambda origins: tiles.gather_context(origins, df, n, size)
    first, counts = stream.score_incremental(plan.where("face < 2"), contexts, tiles.stencil_scorer(), saved, "one")
    third = plan.where("face = 1").count()
    assert first.count() == 2 * third == counts["used"] == counts["scored"] and counts["reused"] == 0

    def never():
        raise AssertionError("a saved tile was scored again")
    again, counts = stream.score_incremental(plan.where("face = 1"), contexts, never, saved, "two")
    assert again.count() == third == counts["reused"] and counts["scored"] == 0 and list(saved.commits()) == ["one"]
    with pytest.raises(ValueError, match="other tiles"):
        stream.score_incremental(plan, contexts, never, saved, "one")
    full, counts = stream.score_incremental(plan, contexts, tiles.stencil_scorer(), saved, "three")
    assert full.count() == saved.read().count() == saved.keys().distinct().count() == plan.count()
    assert (counts["used"], counts["reused"], counts["scored"]) == (6 * third, 2 * third, 4 * third)
    assert saved.commits()["three"]["reused"] == 2 * third and saved.differences().isEmpty()


def test_a_batch_shows_whole_or_not_at_all(spark, tmp_path):
    size, path = 2, str(tmp_path / "store")
    saved = tile_store.open_tiles(spark, path, size, {"model": 1})
    rows = lambda lo, hi: spark.range(lo, hi, 1, 4).select(F.lit(0).alias("face"), F.col("id").cast("int").alias("ty"), F.lit(0).alias("tx"),
                                                           F.array_repeat(F.col("id").cast("double"), 4).alias("values"))
    saved.append(rows(0, 10), "a")

    def dies():
        def predict(arrays):
            if (arrays["values"] > 35).any():
                raise RuntimeError("lost")
            return arrays["values"]
        return predict
    with pytest.raises(Exception, match="lost"):
        saved.append(tiles.score_tiles(rows(10, 40), dies, size), "b")
    assert saved.read().count() == 10 and list(saved.commits()) == ["a"]
    for wrong, text in ((F.array(F.lit(1.0)), "2 x 2"), (F.array_repeat(F.lit(float("nan")), 4), "2 x 2"), (F.lit(None).cast("array<double>"), "2 x 2")):
        with pytest.raises(Exception, match=text):
            saved.append(rows(10, 12).withColumn("values", wrong), "c")
    assert saved.append(rows(10, 40), "b")["rows"] == 30
    assert saved.append(rows(0, 99), "b")["rows"] == 30 and saved.read().count() == 40  # the repeated batch adds nothing
    record = saved.compact()
    assert record["rows"] == saved.read().count() == 40 and len(saved.commits()) == 1 and saved.compact() is None
    with pytest.raises(ValueError, match="different settings"):
        tile_store.open_tiles(spark, path, size, {"model": 2})


def test_bad_stored_tiles_raise_when_they_are_read(spark, tmp_path):
    saved = tile_store.open_tiles(spark, str(tmp_path / "store"), 2)
    good = spark.createDataFrame([(0, 0, 0, [1.0, 2.0, 3.0, 4.0]), (0, 4, 0, [5.0, 6.0, 7.0, 8.0])], tile_store.SCHEMA)
    folder = saved.append(good, "a")["folder"]
    assert saved.differences().isEmpty()
    bad = good.withColumn("values", F.when(F.col("ty") == 4, F.array_repeat(F.lit(float("inf")), 4)).otherwise(F.col("values")))
    bad.write.mode("overwrite").parquet(f"{saved.path}/data/{folder}")
    assert [r.batch for r in saved.differences().collect()] == ["a"]
    with pytest.raises(Exception, match="stored tile 0 4 0 is invalid"):
        saved.read().collect()
    assert saved.keys().count() == 2
    store.write_manifest(spark, str(tmp_path / "other/commits/x"), {})
    with pytest.raises(ValueError, match="no manifest"):
        tile_store.open_tiles(spark, str(tmp_path / "other"), 2)


def test_estimate_spans_tiles_and_grows_with_the_region(spark):
    r = spark.createDataFrame([(1, 0.1, 0.1, 1.0, 1.0, 4, 4), (2, -179.0, -89.0, 179.0, 89.0, 64, 32)],
                              "request_id int, west double, south double, east double, north double, width int, height int")
    got = {x.request_id: x.tiles for x in tiles.estimate_tiles(r, 2048).collect()}
    assert 1 < got[1] < got[2]


SIZED = "request_id int, west double, south double, east double, north double, width int, height int"
AREAS = [(1, 0.1, 0.1, 1.0, 1.0, 4, 4), (2, -179.0, -89.0, 179.0, 89.0, 64, 32), (3, 20.0, -30.0, 60.0, 30.0, 16, 40), (4, 5.0, 5.0, 5.5, 5.2, 1, 1)]


def test_bitmap_and_sketch_counts(spark):
    r = spark.createDataFrame(AREAS, SIZED)
    exact = {x.request_id: x.tiles for x in tiles.estimate_tiles(r, 16384).collect()}
    assert {x.request_id: x.tiles for x in tiles.estimate_tiles_bitmap(r, 16384).collect()} == exact and max(exact.values()) > 500
    sketch = {x.request_id: x.tiles for x in tiles.estimate_tiles_sketch(r, 16384).collect()}
    assert sketch.keys() == exact.keys() and all(abs(sketch[k] - v) <= max(1, 4 * tiles.SKETCH_ERROR * v) for k, v in exact.items())
    plan = tiles.estimate_tiles_bitmap(r, 16384)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 3  # the samples, the bitmaps by block, the sums


def test_costs_equal_plain_distinct_tiles_and_exchange_bitmaps(spark):
    r = spark.createDataFrame(AREAS, SIZED)
    back = F.sequence(F.lit(-1), F.lit(0))
    for n, stride in ((4096, 384), (600, 20)):  # tiles in one block, and over edges of many
        p = tiles._sample_tiles(tiles._sized(r, n), n, stride, stride).withColumn("oy", F.explode(back)).withColumn("ox", F.explode(back))
        rows = p.select("request_id", "face", F.expr("by + oy"), F.expr("bx + ox")).distinct()
        want = {x.request_id: x["count"] for x in rows.groupBy("request_id").count().collect()}
        assert {x.request_id: x.tiles for x in tiles.estimate_tiles(r, n, stride=stride, halo=stride).collect()} == want
        for x in tiles.estimate_tiles_until(r, n, 100_000, stride=stride, halo=stride).collect():
            assert x.tiles == want[x.request_id] and not x.exceeds
    for estimate in (tiles.estimate_tiles, tiles.estimate_tiles_sketch):  # row chunks of the requests, then bitmaps
        plan = estimate(r, 4096)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 2 and "bit_or" in plan


def test_early_stop_stores_one_row_a_request(spark, monkeypatch):
    stored, stage = [], tiles.stage
    monkeypatch.setattr(tiles, "stage", lambda df, name: stored.append(stage(df, name)) or stored[-1])
    tiles.estimate_tiles_until(spark.createDataFrame(AREAS, SIZED), 4096, 100, first_rows=1)
    assert len(stored) > 2 and max(t.count() for t in stored) == len(AREAS)


def test_early_stop_agrees_and_expands_less(spark):
    r = spark.createDataFrame(AREAS, SIZED)
    exact = {x.request_id: x.tiles for x in tiles.estimate_tiles(r, 4096).collect()}
    for limit in (0, 8, 10_000):
        got = {x.request_id: x for x in tiles.estimate_tiles_until(r, 4096, limit, first_rows=1).collect()}
        assert got.keys() == exact.keys()
        for k, v in exact.items():
            assert got[k].exceeds == (v > limit) and got[k].tiles == min(v, limit + 1)
    got = {x.request_id: x for x in tiles.estimate_tiles_until(r, 4096, 8, first_rows=1).collect()}
    assert got[2].sample_rows <= 2 < 32 and got[3].sample_rows < 40 and got[4].sample_rows == 1
    assert tiles.estimate_tiles_until(r.where("false"), 4096, 8).count() == 0
    with pytest.raises(ValueError):
        tiles.estimate_tiles_until(r, 4096, -1)


def test_groups_are_bounded_ordered_and_keep_duplicates(spark):
    i = F.col("id")
    hot = spark.range(4000).select((i % 1500).alias("point_id"), F.lit(12.3).alias("lon"), F.lit(5.5).alias("lat"))
    rest = spark.range(3000).select((i + 5000).alias("point_id"), ((i * 7919) % 36000 / 100 - 179.9).alias("lon"), ((i * 311) % 178 - 88.5).alias("lat"))
    p = g.add_lonlat_direction(hot.unionByName(rest))
    rows = tiles.point_groups(p, 64, 16, most=256, partitions=6).collect()
    assert max(len(r.ids) for r in rows) == 256 and sum(len(r.ids) for r in rows) == 7000
    whole = {}
    for r in sorted(rows, key=lambda r: (r.face, r.by, r.bx, r.chunk)):
        seen = whole.setdefault((r.face, r.by, r.bx), [])
        assert len(seen) == r.chunk * 256  # chunks are numbered without gaps, all but the last full
        seen += r.ids
    want = {}
    for r in tiles.cluster_points(p, 64, 16).select("face", "by", "bx", "point_id").collect():
        want.setdefault((r.face, r.by, r.bx), []).append(r.point_id)
    assert whole == {k: sorted(v) for k, v in want.items()} and max(map(len, whole.values())) >= 4000
    assert tiles.point_groups(p.where("false"), 64, 16).count() == 0


def test_clustered_points_keep_all_rows_and_split_a_hot_tile(spark):
    p = spark.range(6000).select(F.col("id").alias("point_id"), F.when(F.col("id") % 2 == 0, F.lit(12.3)).otherwise(
        F.col("id") % 360 - F.lit(180.0)).alias("lon"), F.lit(5.5).alias("lat"))
    c = tiles.cluster_points(g.add_lonlat_direction(p), 64, 16, partitions=6)
    sizes = [r[0] for r in c.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert sum(sizes) == 6000 and max(sizes) < 3000
