"""Block stores: equal to node tables, pruned, and checked by their digest tree."""
import re

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from test_sampling import random_cube, random_lonlat

from sphereframe.functions import geometry as g
from sphereframe.operators import blocks as reads
from sphereframe.operators import climate, quality, region, sampling, tiles
from sphereframe.sources import blocks, grids, store

REQUEST = "request_id int, west double, south double, east double, north double, width int, height int"


def points(spark, count=300):
    i = F.col("id")
    lon, lat = -180 + (i * 7919 % 36000) / 100 + 0.003, -90 + (i * 104729 % 18000) / 100 + 0.003
    return g.add_lonlat_direction(spark.range(count).select(i.alias("point_id"), lon.alias("lon"), lat.alias("lat")))


def by_id(df, key="point_id"):
    return {r[key]: r.v for r in df.collect()}


def near(a, b):
    return a.keys() == b.keys() and all((x is None) == (b[k] is None) and (x is None or abs(x - b[k]) < 1e-9) for k, x in a.items())


@pytest.mark.parametrize(("n", "block"), [(10, 4), (5, 16)])
def test_cube_blocks_equal_the_node_table(spark, tmp_path, n, block):
    _, field = random_cube(spark, n)
    stored = blocks.write_blocks(field, str(tmp_path / "b"), blocks.Lattice("cube", n, block), {"seed": 3}, "double")
    p = points(spark).unionByName(points(spark, 1).withColumns({"point_id": F.lit(-1).cast("bigint"), "vx": F.lit(float("nan"))}))
    assert near(by_id(reads.sample_cube(p, stored)), by_id(sampling.sample_cube(p, field, n)))


def test_lonlat_blocks_equal_the_node_table(spark, tmp_path):
    h = 9
    _, field = random_lonlat(spark, h)
    stored = blocks.write_blocks(field, str(tmp_path / "b"), blocks.Lattice("lonlat", h, 4), {}, "double")
    p = g.add_lonlat_node(points(spark), h)
    assert near(by_id(reads.sample_lonlat(p, stored)), by_id(sampling.sample_lonlat(p, field, h)))
    key = F.col("row_i") * 1000 + F.col("col_i")
    for window in (None, (14, 2, 8, 5)):
        a, b = region.export_stored(stored, h, window), region.export_window(field, h, h, window)
        assert near(by_id(a.withColumn("k", key), "k"), by_id(b.withColumn("k", key), "k"))


@pytest.mark.parametrize(("size", "stride", "block"), [(8, 4, 4), (5, 5, 3)])
def test_contexts_equal_those_of_cells(spark, tmp_path, size, stride, block):
    n = 12
    _, field = random_cube(spark, n)
    stored = blocks.write_blocks(field, str(tmp_path / "b"), blocks.Lattice("cube", n, block), {}, "double")
    plan = grids.tile_plan(spark, n, size, stride, True)
    got = reads.gather_context(plan, stored, size, size, "v")
    want = {(r.face, r.ty, r.tx): r["values"] for r in tiles.gather_context(plan, field, n, size).collect()}
    have = {(r.face, r.ty, r.tx): r["values"] for r in got.collect()}
    assert have == want
    text = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "CartesianProduct" not in text
    made = [line for line in text.splitlines() if "Generate explode" in line]
    assert made and all(re.search(r"\[b[yx]#\d+\]$", line) for line in made)  # tiles become block places, never cells
    with pytest.raises(Exception, match="beyond the halo"):
        reads.gather_context(spark.createDataFrame([(0, -9, 0)], "face int, ty int, tx int"), stored, size, 8, "v").collect()


def changed_copy(stored, path, change):
    table = change(stored._table())
    table.write.partitionBy("part").parquet(f"{path}/field")
    for k in range(stored.info["levels"]):
        stored._level(k).write.parquet(f"{path}/digests/level={k}")
    store.write_manifest(stored.spark, f"{path}/identity", stored.info)


def test_one_changed_block_is_found_by_reading_it_only(spark, tmp_path):
    n = 16
    _, field = random_cube(spark, n)
    stored = blocks.write_blocks(field, str(tmp_path / "b"), blocks.Lattice("cube", n, 4), {"a": 1})
    bad = stored.lattice.curve(F.lit(2), F.lit(1), F.lit(3))
    key = spark.range(1).select(bad.alias("z")).first().z
    changed_copy(stored, str(tmp_path / "c"), lambda t: t.withColumn("v", F.when(
        F.col("z") == key, F.reverse("v")).otherwise(F.col("v"))))
    other = blocks.open_blocks(spark, str(tmp_path / "c"), {"a": 1})
    one = spark.createDataFrame([(key,)], "z bigint")
    rest = stored.read().select("z").where(F.col("z") != key)
    assert [r.z for r in other.damaged(one).collect()] == [r.z for r in other.damaged().collect()] == [key]
    assert other.damaged(rest).isEmpty() and other.read(rest).count() == stored.lattice.blocks - 1
    with pytest.raises(Exception, match="does not match its digest"):
        other.read(one).select("v").collect()
    assert stored.damaged().isEmpty() and stored.wrong_digests().isEmpty()


def test_changed_digests_do_not_match_the_root(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(blocks, "FAN_BITS", 3)  # several levels on a small field
    n = 16
    _, field = random_cube(spark, n)
    stored = blocks.write_blocks(field, str(tmp_path / "b"), blocks.Lattice("cube", n, 4), {})
    assert stored.info["levels"] == 4
    for k in range(stored.info["levels"]):
        path = str(tmp_path / f"c{k}")
        stored._table().write.partitionBy("part").parquet(f"{path}/field")
        for j in range(stored.info["levels"]):
            level = stored._level(j)
            level = level.withColumn("digest", F.when(F.col("z") == 0, F.lit(7).cast("bigint")).otherwise(F.col("digest"))) if j == k else level
            level.write.parquet(f"{path}/digests/level={j}")
        store.write_manifest(spark, f"{path}/identity", stored.info)
        if k == stored.info["levels"] - 1:
            with pytest.raises(ValueError, match="manifest"):
                blocks.open_blocks(spark, path)
            continue
        other = blocks.open_blocks(spark, path)
        assert {r.level for r in other.wrong_digests().collect()} >= {k}
        with pytest.raises(ValueError, match="level above"):
            other.read(spark.createDataFrame([(0,)], "z bigint"))
        other.read(spark.createDataFrame([(200,)], "z bigint")).count() if k == 0 else None  # a group that is sound
    assert stored.wrong_digests(spark.createDataFrame([(0,)], "z bigint")).isEmpty()


def test_incomplete_fields_identity_units_and_versions(spark, tmp_path):
    n = 6
    _, field = random_cube(spark, n)
    lattice = blocks.Lattice("cube", n, 4)
    for k, (wrong, message) in enumerate([
            (field.where("not (face = 3 and y = 2 and x = 5)"), "missing or repeated"),
            (field.unionByName(field.where("face = 0 and y = 0 and x = 0")), "missing or repeated"),
            (field.withColumn("v", F.when(F.col("y") == 3, F.lit(float("inf"))).otherwise(F.col("v"))), "not finite"),
            (field.where("face < 5"), "expected 24 blocks")]):
        with pytest.raises(Exception, match=message):
            blocks.write_blocks(wrong, str(tmp_path / f"w{k}"), lattice, {})
    blocks.write_blocks(field.withMetadata("v", {"unit": "m"}), str(tmp_path / "b"), lattice, {"seed": 1})
    assert blocks.open_blocks(spark, str(tmp_path / "b"), {"seed": 1}, {"v": "m"}).values["v"].metadata == {"unit": "m"}
    for kwargs, message in (({"identity": {"seed": 2}}, "identity"), ({"units": {"v": "feet"}}, "not stored in feet"), ({"units": {"w": "m"}}, "not stored")):
        with pytest.raises(ValueError, match=message):
            blocks.open_blocks(spark, str(tmp_path / "b"), **kwargs)
    with pytest.raises(FileExistsError):
        blocks.write_blocks(field, str(tmp_path / "b"), lattice, {})
    store.write_manifest(spark, str(tmp_path / "old/identity"), {"version": 1})
    with pytest.raises(ValueError, match="version 1"):
        blocks.open_blocks(spark, str(tmp_path / "old"))


def test_small_requests_open_few_row_groups(spark, tmp_path):
    n, block, path = 64, 4, tmp_path / "b"
    _, field = random_cube(spark, n)
    stored = blocks.write_blocks(field, str(path), blocks.Lattice("cube", n, block), {}, group_bytes=2048)
    one = spark.createDataFrame([(1, 10.0, 5.0, 12.0, 7.0, 4, 3), (2, -80.0, -60.0, -79.0, -59.0, 2, 2)], REQUEST)
    out = region.region_query_stored(one, stored)
    want = region.region_query(one, field.withColumn("v", F.col("v").cast("float").cast("double")), n)
    key = F.concat_ws(" ", "request_id", "row_i", "col_i")
    assert near(by_id(out.withColumn("k", key), "k"), by_id(want.withColumn("k", key), "k"))
    text = out._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in text and "GreaterThanOrEqual(z," in text and "PartitionFilters: [" in text
    touched = [5, 6, 900]
    _, spans = stored.ranges(spark.createDataFrame([(z,) for z in touched], "z bigint"))
    opened = total = 0
    for f in sorted(path.glob("field/part=*/*.parquet")):
        meta = pq.ParquetFile(f).metadata
        at = next(i for i in range(meta.num_columns) if meta.row_group(0).column(i).path_in_schema == "z")
        for i in range(meta.num_row_groups):
            s = meta.row_group(i).column(at).statistics
            total += 1
            opened += any(s.min <= high and low <= s.max for low, high in spans)
    assert 1 <= opened <= 3 < 10 < total


def test_many_ranges_are_merged_by_the_smallest_gaps(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(blocks, "RANGES", 3)
    stored = blocks.BlockStore(spark, "", blocks.Lattice("cube", 64, 4), None, {})
    keys = [1, 2, 3, 50, 52, 400, 401, 1500]
    folders, spans = stored.ranges(spark.createDataFrame([(z,) for z in keys], "z bigint"))
    assert folders == [0] and spans == [(1, 52), (400, 401), (1500, 1500)]
    assert stored.ranges(spark.createDataFrame([], "z bigint")) == ([], [])


def test_curve_is_one_to_one(spark):
    lattice = blocks.Lattice("cube", 100, 7)
    rows, cols = lattice.count
    i = F.col("id")
    place = [F.floor(i / (rows * cols)), F.floor(i / cols) % rows, i % cols]
    z = spark.range(lattice.blocks).select(lattice.curve(*place).alias("z")).agg(F.countDistinct("z").alias("k"), F.max("z").alias("m")).first()
    assert z.k == lattice.blocks and z.m < 6 << 2 * lattice.bits and blocks.Lattice("lonlat", 100, 7).count == (15, 29)


def test_small_fields_compare_all_digests_when_they_are_opened(spark, tmp_path):
    _, field = random_cube(spark, 8)
    stored = blocks.write_blocks(field, str(tmp_path / "b"), blocks.Lattice("cube", 8, 4), {})
    path = str(tmp_path / "c")
    stored._table().write.partitionBy("part").parquet(f"{path}/field")
    stored._level(0).withColumn("digest", F.col("digest") + (F.col("z") == 3).cast("int")).write.parquet(f"{path}/digests/level=0")
    stored._level(1).write.parquet(f"{path}/digests/level=1")
    store.write_manifest(spark, f"{path}/identity", stored.info)
    with pytest.raises(ValueError, match="digests of its blocks"):
        blocks.open_blocks(spark, path)


def test_stored_report_equals_that_of_the_node_table(spark, tmp_path):
    h = 19  # blocks of uneven size
    _, field = random_lonlat(spark, h)
    stored = blocks.write_blocks(field, str(tmp_path / "b"), blocks.Lattice("lonlat", h, 4), {}, "double")
    got, want = quality.verify_stored(stored, stored.info["root"]).first(), quality.verify_state(field, h).first()
    for c in want.asDict():
        same = abs(got[c] - want[c]) < 1e-9 if isinstance(want[c], float) else got[c] == want[c]
        assert same, c
    ratios = [r.direction_ratio for r in quality.polar_anisotropy(field, h).collect()]
    assert got.checksum_matches and abs(got.polar_ratio_high - max(ratios)) < 1e-9 and abs(got.polar_ratio_low - min(ratios)) < 1e-9
    assert not quality.verify_stored(stored, "0").first().checksum_matches
    plan = reads.line_sums(stored, "v")._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Scan parquet .*field", plan.split("== Initial Plan ==")[0])) <= 1 and plan.count("piece") == 0


def test_climate_bands_keep_units_and_version(spark, tmp_path):
    n = 4
    values = {b: (F.col("y") * (k + 1) + F.col("x")).cast("double") for k, b in enumerate(climate.FEATURES)}
    bands = grids.cube_nodes(spark, n).withColumns(values)
    climate.write_climate(bands, str(tmp_path / "c"), n, 2)
    saved = climate.open_climate(spark, str(tmp_path / "c"))
    assert saved.values["beta"].metadata["unit"] == "degC/m" and saved.values.names == climate.FEATURES
    back = reads.nearest(grids.cube_nodes(spark, n), saved, "face", "y", "x")
    assert bands.join(back.select("face", "y", "x", F.col("beta").alias("b")), ["face", "y", "x"]).where("beta <> b").isEmpty()
    blocks.write_blocks(bands, str(tmp_path / "plain"), blocks.Lattice("cube", n, 2), {})
    blocks.write_blocks(bands, str(tmp_path / "old"), blocks.Lattice("cube", n, 2), {"climate": "sphere-climate-0"})
    blocks.write_blocks(bands, str(tmp_path / "bare"), blocks.Lattice("cube", n, 2), {"climate": climate.CLIMATE_VERSION})
    for name, text in (("plain", "no climate"), ("old", "is not"), ("bare", "five bands")):
        with pytest.raises(ValueError, match=text):
            climate.open_climate(spark, str(tmp_path / name))
    with pytest.raises(ValueError, match="two intervals"):
        climate.write_climate(bands, str(tmp_path / "small"), 1)
