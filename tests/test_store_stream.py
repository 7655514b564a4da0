import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from test_sampling import as_dict, random_cube, random_lonlat

from sphereframe.operators import quality, region
from sphereframe.sources import store
from sphereframe.streaming import requests as stream


def test_cube_field_round_trip_and_refusals(spark, tmp_path):
    n, path = 3, str(tmp_path / "run")
    field, df = random_cube(spark, n)
    store.write_cube_field(df, path, n, {"seed": "18446744073709551615", "units": "m"}, block=2)
    saved, info = store.open_run(spark, path, {"units": "m"})
    assert dict(saved.dtypes)["v"] == "float" and info["intervals"] == n
    assert max(abs(v - field[k]) for k, v in as_dict(saved).items()) < 1e-6
    with pytest.raises(FileExistsError):
        store.write_cube_field(df, path, n, {})
    with pytest.raises(ValueError, match="identity"):
        store.open_run(spark, path, {"units": "feet"})
    scan = saved.where("face = 2")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(face" in scan


def test_corrupt_content_fails_the_checksum(spark, tmp_path):
    n, path = 2, str(tmp_path / "run")
    _, df = random_cube(spark, n)
    store.write_cube_field(df, path, n, {})
    changed = store.load_cube_field(spark, path, ["v"]).withColumn("v", F.col("v") + (F.col("y") == 1).cast("float"))
    changed = spark.createDataFrame(changed.collect(), changed.schema)  # nine rows per face
    changed.write.mode("overwrite").partitionBy("face").parquet(f"{path}/field")
    with pytest.raises(ValueError, match="checksum"):
        store.open_run(spark, path, {})


def test_incomplete_and_nonfinite_fields_are_refused(spark, tmp_path):
    _, df = random_cube(spark, 2)
    with pytest.raises(ValueError, match="rows"):
        store.write_cube_field(df.where("face < 5"), str(tmp_path / "a"), 2, {})
    with pytest.raises(FloatingPointError):
        store.write_cube_field(df.withColumn("v", F.lit(float("nan"))), str(tmp_path / "b"), 2, {})


def test_checksums_ignore_order_but_not_content(spark):
    _, df = random_lonlat(spark, 4)
    for make in (store.content_checksum, store.portable_checksum):
        one = make(df, ["y", "x"]).first()
        assert make(df.repartition(5).sort(F.desc("v")), ["y", "x"]).first() == one
        assert make(df.withColumn("v", F.col("v") + (F.col("y") == 2).cast("int")), ["y", "x"]).first() != one


def test_manifest_is_written_once(spark, tmp_path):
    path = str(tmp_path / "m")
    store.write_manifest(spark, path, {"b": [1, 2], "a": {"x": None}})
    store.write_manifest(spark, path, {"a": {"x": None}, "b": [1, 2]})
    with pytest.raises(ValueError):
        store.write_manifest(spark, path, {"b": [1, 3], "a": {"x": None}})
    assert store.read_manifest(spark, path) == {"a": {"x": None}, "b": [1, 2]}


def test_stage_record_restores_without_recomputing(spark, tmp_path):
    path = str(tmp_path / "stage")
    _, df = random_cube(spark, 2)
    first = store.record_stage(df, path, ["face", "y", "x"], 54, "coarse")
    again = store.record_stage(df.withColumn("v", F.lit(0.0)), path, ["face", "y", "x"], 54, "coarse")
    assert quality.same_rows(first, again).isEmpty()
    with pytest.raises(ValueError):
        store.record_stage(df, path, ["face", "y", "x"], 55, "coarse")


def test_lonlat_store_export_and_region_sinks(spark, tmp_path):
    h = 4
    _, df = random_lonlat(spark, h)
    saved = store.write_lonlat_field(df, str(tmp_path / "f"), h, {"units": "m"})
    assert saved.count() == 40
    out = region.export_window(df, h, h, (6, 1, 4, 2))
    store.write_export(out, str(tmp_path / "w"), h, h, {}, (6, 1, 4, 2))
    info = store.read_manifest(spark, str(tmp_path / "w/identity"))
    assert (info["west"], info["east"], info["north"], info["south"]) == (90, 270, 45, -45)
    assert spark.read.parquet(str(tmp_path / "w/grid")).count() == 8
    grid = out.select(F.lit(1).alias("request_id"), "row_i", "col_i", "v")
    store.write_region(grid, str(tmp_path / "r"), {"bounds": [0, 0, 1, 1]})
    assert store.read_manifest(spark, str(tmp_path / "r/identity"))["coverage"] == "region"


def test_snapshot_keeps_the_first_input(spark, tmp_path):
    path = str(tmp_path / "in")
    store.snapshot_input(spark.range(3), path)
    assert store.snapshot_input(spark.range(9), path).count() == 3


def test_schema_assertion_and_observation(spark, tmp_path):
    df = spark.createDataFrame([(1, 2, 1.5)], "y int, x int, v float")
    assert store.assert_schema(df, store.field_schema(["v"], ["y", "x"])) is df
    with pytest.raises(ValueError):
        store.assert_schema(df, T.StructType([T.StructField("y", T.LongType())]))
    seen_df, seen = store.observe_stage(spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "v double"), "audit")
    seen_df.write.parquet(str(tmp_path / "o"))
    assert seen.get == {"rows": 3, "bad": 2}


def write_requests(path, name, rows):
    keys = ["request_id", "ts", "west", "south", "east", "north", "width", "height"]
    path.mkdir(exist_ok=True)
    (path / name).write_text("\n".join(json.dumps(dict(zip(keys, r))) for r in rows))


GOOD = (1, "2024-01-01T00:10:00", 170.0, -10.0, -170.0, 10.0, 4, 2)
BAD = (2, "2024-01-01T00:20:00", 0.0, 10.0, 1.0, -10.0, 4, 2)
LATER = (3, "2024-01-01T05:00:00", 0.0, 0.0, 10.0, 10.0, 2, 2)


def test_request_loop_isolates_bad_rows_and_resumes(spark, tmp_path):
    h = 6
    _, field = random_lonlat(spark, h)
    inbox, good, bad, state = (tmp_path / k for k in ("in", "good", "bad", "state"))
    write_requests(inbox, "a.json", [GOOD, BAD])
    run = lambda: stream.serve(stream.read_requests(spark, str(inbox)), field, h, str(good), str(bad), str(state)).awaitTermination()
    run()
    write_requests(inbox, "b.json", [LATER])
    run()  # continues after the first batch
    pixels = spark.read.parquet(str(good))
    assert {r.request_id: r["count"] for r in pixels.groupBy("request_id").count().collect()} == {1: 8, 3: 4}
    assert [(r.request_id, r.error) for r in spark.read.parquet(str(bad)).collect()] == [(2, "bounds_order")]
    batch = spark.createDataFrame([(1, 170.0, -10.0, -170.0, 10.0, 4, 2)],
                                  "request_id bigint, west double, south double, east double, north double, width int, height int")
    want = region.region_query_lonlat(batch, field, h).select("row_i", "col_i", F.round("v", 9))
    assert want.exceptAll(pixels.where("request_id = 1").select("row_i", "col_i", F.round("v", 9))).isEmpty()


def run_append(df, out, state):
    df.writeStream.format("parquet").option("checkpointLocation", str(state)).outputMode("append").trigger(
        availableNow=True).start(str(out)).awaitTermination()


def test_progress_windows_and_repeated_requests(spark, tmp_path):
    inbox = tmp_path / "in"
    write_requests(inbox, "a.json", [GOOD, BAD, GOOD])
    write_requests(inbox, "b.json", [LATER])
    requests = stream.read_requests(spark, str(inbox), max_files=1)
    run_append(stream.progress(requests, "1 hour", "1 hour"), tmp_path / "p", tmp_path / "ps")
    rows = spark.read.parquet(str(tmp_path / "p")).collect()
    assert [(r.start.hour, r.requests, r.errors) for r in rows] == [(0, 3, 1)]
    run_append(stream.unique_requests(requests), tmp_path / "u", tmp_path / "us")
    assert sorted(r.request_id for r in spark.read.parquet(str(tmp_path / "u")).collect()) == [1, 2, 3]


def test_request_loop_answers_a_repeated_request_once_across_restarts(spark, tmp_path):
    h = 6
    _, field = random_lonlat(spark, h)
    inbox, good, bad, state = (tmp_path / k for k in ("in", "good", "bad", "state"))
    run = lambda: stream.serve(stream.read_requests(spark, str(inbox)), field, h, str(good), str(bad), str(state),
                               repeats_within="2 days").awaitTermination()
    write_requests(inbox, "a.json", [GOOD, GOOD, BAD])
    run()
    write_requests(inbox, "b.json", [GOOD, BAD, LATER, (4, "2020-01-01T00:00:00", *LATER[2:])])  # repeats, and one too late
    run()
    pixels = spark.read.parquet(str(good))
    assert {r.request_id: r["count"] for r in pixels.groupBy("request_id").count().collect()} == {1: 8, 3: 4}
    assert [r.request_id for r in spark.read.parquet(str(bad)).collect()] == [2]
