"""Registered queries: every operator applied to inputs derived from whole driver tables."""
from __future__ import annotations

import dataclasses
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import climate_math as cm
from ..functions import geometry as g
from ..operators import climate, distribution, filters, quality, raster, region, sampling, tiles
from ..operators import blocks as block_reads
from ..sources import blocks, grids, guide, store, tile_store
from ..streaming import requests as stream
from . import inputs

QUERIES = {}

# Fixed parameters of the registered queries (not properties of any data).
COEFFICIENTS = {"a_temp_std": -8.0, "b_temp_std": 500.0, "temp_std_p1": 60.0, "temp_std_p99": 1400.0}
DRAFT = {"mapping_version": "linear-v1", "black_metres": -3000.0, "white_metres": 5000.0, "refinement": 0.2}
LEGACY_DRAFT = {"ocean_depth_hint_metres": 0.0, "white_metres": 5000.0, "refinement": 0.2}
SEED = 42


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Integers as BIGINT, doubles rounded without negative zero."""
    out = []
    for f in df.schema:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.IntegerType, T.ShortType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), digits) + F.lit(0.0)
        out.append(c.alias(f.name))
    return df.select(*out)


def _scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder next to the session's checkpoints, for queries that write."""
    root = store.checkpoint_folder(spark)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def _directed(spark, d):
    return g.add_lonlat_direction(inputs.points(spark, d))


def _node_points(spark, d):
    return g.add_lonlat_node(_directed(spark, d), inputs.sizes(spark, d).h).drop(*g.VEC)


# ----------------------------------------------------------------------------- projection
@register
def project_points_to_cube(spark, d):
    p = g.add_cube_coordinates(_directed(spark, d), inputs.sizes(spark, d).n)
    return tidy(p.select("point_id", "face", "cy", "cx"))


@register
def points_per_face_tile(spark, d):
    return tidy(tiles.points_per_tile(_directed(spark, d), 256, 32))


@register
def cube_area_weight_by_face(spark, d):
    f = g.add_area_weight(inputs.cube_raw(spark, d), inputs.sizes(spark, d).n)
    return tidy(f.groupBy("face").agg(F.sum("area").alias("area"),
                                      (F.sum(F.col("area") * F.col("v")) / F.sum("area")).alias("mean_v")))


@register
def unique_node_count(spark, d):
    return tidy(sampling.alias_group_sizes(inputs.cube_raw(spark, d), inputs.sizes(spark, d).n))


@register
def cube_node_directions(spark, d):
    n = inputs.sizes(spark, d).n
    f = g.add_direction(inputs.cube_raw(spark, d), n)
    f = g.add_direction(f, n, normalize=False, out=("ux", "uy", "uz"))
    return tidy(f.select("face", "y", "x", *g.VEC, "ux", "uy", "uz"))


@register
def signed_root_round_trip(spark, d):
    f = inputs.node_field(spark, d).withColumn("root", g.signed_sqrt("v"))
    return tidy(f.select("y", "x", "root", g.signed_square("root").alias("square")))


# ----------------------------------------------------------------------------- lookups
@register
def node_field_fold(spark, d):
    h = inputs.sizes(spark, d).h
    i = F.col("event_id")
    p = inputs.table(spark, d, "events").select(
        i.alias("point_id"), (F.pmod(i * 31, F.lit(4 * h)) - h).alias("gy"),
        (F.pmod(i * 7, F.lit(6 * h)) - 2 * h).alias("gx"))
    return tidy(sampling.gather_lonlat(p, inputs.node_field(spark, d), h, y="gy", x="gx"))


@register
def bilinear_points(spark, d):
    s = sampling.sample_lonlat(_node_points(spark, d), inputs.node_field(spark, d), inputs.sizes(spark, d).h)
    return tidy(s.select("point_id", "v"))


@register
def nearest_points(spark, d):
    p = _node_points(spark, d).withColumns({"ny": g.nearest_index("ny"), "nx": g.nearest_index("nx")})
    s = sampling.gather_lonlat(p, inputs.node_field(spark, d), inputs.sizes(spark, d).h, y="ny", x="nx")
    return tidy(s.select("point_id", "v"))


@register
def cube_bilinear_points(spark, d):
    s = sampling.sample_cube(_directed(spark, d), inputs.cube_field(spark, d), inputs.sizes(spark, d).n)
    return tidy(s.select("point_id", "v"))


@register
def cube_nearest_points(spark, d):
    s = sampling.sample_cube_nearest(_directed(spark, d), inputs.cube_field(spark, d), inputs.sizes(spark, d).n)
    return tidy(s.select("point_id", "v"))


@register
def cube_bilinear_hot_keys(spark, d):
    """Same values with every cell's points spread over sub-keys (shuffled, salted plan)."""
    from ..operators import lookup
    n = inputs.sizes(spark, d).n
    p = g.add_cube_coordinates(_directed(spark, d), n, out=("face", "cy", "cx")).withColumns(
        {"y": g.nearest_index("cy"), "x": g.nearest_index("cx")})
    hit = lookup.keyed_lookup(p.select("point_id", "face", "y", "x"), inputs.cube_field(spark, d),
                              ["face", "y", "x"], spread_hot_keys=True)
    return tidy(hit.select("point_id", "v"))


@register
def cube_halo(spark, d):
    n = inputs.sizes(spark, d).n
    return tidy(sampling.with_halo(inputs.cube_field(spark, d), n, 2))


# ----------------------------------------------------------------------------- shared nodes, resampling
@register
def cube_identify_mean(spark, d):
    return tidy(sampling.identify(inputs.cube_raw(spark, d), inputs.sizes(spark, d).n))


@register
def cube_identify_owner(spark, d):
    return tidy(sampling.identify(inputs.cube_raw(spark, d), inputs.sizes(spark, d).n, "owner"))


@register
def cube_bilinear_resample(spark, d):
    n = inputs.sizes(spark, d).n
    return tidy(sampling.resize_cube(inputs.cube_field(spark, d), n, 3 * n // 2))


@register
def lonlat_resample(spark, d):
    h = inputs.sizes(spark, d).h
    return tidy(sampling.resize_lonlat(inputs.node_field(spark, d), h, 3 * h // 2))


@register
def expression_field(spark, d):
    """A field from an expression over directions, at the size that the rows of the table give."""
    v = F.col("vx") * 1000 + F.col("vy") * F.col("vz") * 907
    return tidy(sampling.field_from_expression(spark, inputs.sizes(spark, d).n, v=v), 5)


@register
def cube_to_lonlat(spark, d):
    s = inputs.sizes(spark, d)
    return tidy(sampling.cube_to_lonlat(inputs.cube_field(spark, d), s.n, s.h))


# ----------------------------------------------------------------------------- regions and exports
@register
def region_validate(spark, d):
    return region.validate(inputs.requests(spark, d), 40).select("request_id", "error")


@register
def region_validate_codes(spark, d):
    """Requests with every kind of fault; each is told by its first one."""
    m = F.col("request_id") % 7
    r = inputs.requests(spark, d).withColumns({
        "west": F.when(m == 0, F.lit(float("nan"))).when(m == 1, F.col("west") + 400).otherwise(F.col("west")),
        "width": F.when(m == 2, F.lit(0)).when(m == 3, F.lit(400)).otherwise(F.col("width"))})
    return region.validate(r, 40).select("request_id", "error")


@register
def region_guide_height(spark, d):
    big = inputs.requests(spark, d).withColumns({"width": F.col("width") * 128, "height": F.col("height") * 128})
    return tidy(region.preview_guide_height(big).select("request_id", "guide_height"))


@register
def region_query_multi(spark, d):
    field = inputs.cube_field(spark, d).withColumn("v", g.signed_sqrt("v"))
    return tidy(region.region_query(inputs.requests(spark, d), field, inputs.sizes(spark, d).n,
                                    signed_root="v").select("request_id", "row_i", "col_i", "v"))


def _cube_blocks(spark, d, kind="float"):
    lattice = blocks.Lattice("cube", inputs.sizes(spark, d).n, 8)
    path = _scratch(spark, "cube-blocks")
    blocks.write_blocks(inputs.cube_field(spark, d), path, lattice, {"source": "lineitem"}, kind)
    return blocks.open_blocks(spark, path, {"source": "lineitem"})


def _lonlat_blocks(spark, d, kind="float"):
    path = _scratch(spark, "lonlat-blocks")
    field = inputs.node_field(spark, d).withMetadata("v", {"unit": "m"})
    blocks.write_blocks(field, path, blocks.Lattice("lonlat", inputs.sizes(spark, d).h, 8), {}, kind)
    return blocks.open_blocks(spark, path, units={"v": "m"})


@register
def region_query_stored(spark, d):
    """The same requests from a field saved in blocks, of which the touched ones are read and checked."""
    out = region.region_query_stored(inputs.requests(spark, d), _cube_blocks(spark, d))
    return tidy(out.select("request_id", "row_i", "col_i", "v"), 3)


@register
def region_query_lonlat_stored(spark, d):
    out = region.region_query_stored(inputs.requests(spark, d), _lonlat_blocks(spark, d))
    return tidy(out.select("request_id", "row_i", "col_i", "v"), 3)


@register
def export_stored(spark, d):
    """A window over the date line and the whole half-resolution grid, both from one saved field."""
    stored, h = _lonlat_blocks(spark, d), inputs.sizes(spark, d).h
    window = region.export_stored(stored, h, _dateline(h)).withColumn("grid", F.lit("window"))
    return tidy(window.unionByName(region.export_stored(stored, h // 2).withColumn("grid", F.lit("global"))), 3)


@register
def block_damage(spark, d):
    """Blocks of three faces whose values changed on disk after they were saved, found by reading the whole field and by
    reading every fourth block only."""
    s = _cube_blocks(spark, d)
    hit = (F.col("by") * 5 + F.col("bx") * 3 + F.col("face")) % 3 == 0
    changed = s.read().withColumn("v", F.when(hit & (F.col("face") % 2 == 1), F.transform("v", lambda e: e + F.lit(1).cast("float"))).otherwise(F.col("v")))
    path = _scratch(spark, "damaged")
    changed.withColumn("part", F.shiftright("z", s.lattice.folder_shift).cast("int")).write.partitionBy("part").parquet(f"{path}/field")
    for k in range(s.info["levels"]):
        s._level(k).write.parquet(f"{path}/digests/level={k}")
    store.write_manifest(spark, f"{path}/identity", s.info)
    other = blocks.open_blocks(spark, path)
    some = s.read().select("z").where("z % 4 = 0")
    found = other.damaged().withColumn("read", F.lit("all")).unionByName(other.damaged(some).withColumn("read", F.lit("fourth")))
    return tidy(found.select("read", "face", F.col("by").alias("block_y"), F.col("bx").alias("block_x")))


@register
def region_query_lonlat(spark, d):
    out = region.region_query_lonlat(inputs.requests(spark, d), inputs.node_field(spark, d), inputs.sizes(spark, d).h)
    return tidy(out.select("request_id", "row_i", "col_i", "lon", "lat", "v"))


def _dateline(h):
    return (2 * h - 8, h // 2 - 4, 16, 8)


@register
def export_window_dateline(spark, d):
    h = inputs.sizes(spark, d).h
    return tidy(region.export_window(inputs.node_field(spark, d), h, h, _dateline(h)))


@register
def export_global_half(spark, d):
    h = inputs.sizes(spark, d).h
    return tidy(region.export_window(inputs.node_field(spark, d), h, h // 2).select("row_i", "col_i", "v"))


@register
def export_saved(spark, d):
    """An exported window written with its place, and read back."""
    h, path = inputs.sizes(spark, d).h, _scratch(spark, "export")
    out = region.export_window(inputs.node_field(spark, d), h, h, _dateline(h))
    store.write_export(out, path, h, h, {}, _dateline(h))
    return tidy(spark.read.schema(out.schema).parquet(f"{path}/grid"))


@register
def window_equals_global(spark, d):
    """Number of window pixels that differ from the same pixels of the global export."""
    h = inputs.sizes(spark, d).h
    f = inputs.node_field(spark, d)
    x, y, _, _ = _dateline(h)
    w = region.export_window(f, h, h, _dateline(h)).select(
        (F.col("row_i") + y).alias("row_i"), F.pmod(F.col("col_i") + F.lit(x), F.lit(2 * h)).alias("col_i"),
        F.round("v", 6).alias("v"))
    whole = region.export_window(f, h, h).select("row_i", "col_i", F.round("v", 6).alias("u"))
    j = w.join(whole, ["row_i", "col_i"], "left")
    return tidy(j.agg(F.count(F.lit(1)).alias("pixels"),
                      F.count_if(~F.col("v").eqNullSafe(F.col("u"))).alias("different")))


@register
def sub_region_equals_region(spark, d):
    """Both halves of a request hold the same pixel values as the request itself."""
    h = inputs.sizes(spark, d).h
    r, f = region.good_requests(inputs.requests(spark, d)), inputs.node_field(spark, d)
    full = region.region_query_lonlat(r, f, h).select(
        "request_id", "row_i", "col_i", F.round("v", 6).alias("v"))
    middle, rows = (F.col("south") + F.col("north")) / 2, (F.col("height") / 2).cast("int")
    halves = []
    for edge, below in (("south", 0), ("north", 1)):
        part = r.withColumns({edge: middle, "height": rows})
        halves.append(region.region_query_lonlat(part, f, h).select(
            "request_id", (F.col("row_i") + F.lit(below)).alias("row_i"), "col_i", F.round("v", 6).alias("v")))
    surplus = quality.same_rows(full, halves[0].unionByName(halves[1]))
    return tidy(surplus.agg(F.count(F.lit(1)).alias("different")))


# ----------------------------------------------------------------------------- rasters and guides
@register
def raster_contract(spark, d):
    """Contract counts of three bands, two of which break every rule somewhere."""
    px = inputs.pixels(spark, d)
    shifted = px.select(F.lit("precipitation").alias("band"), (F.col("row_i") - 1).alias("row_i"), "col_i", "v")
    folded = px.select(F.lit("temperature_std").alias("band"), "row_i", F.floor(F.col("col_i") / 2).cast("int").alias("col_i"),
                       (F.col("v") * F.lit(5e34)).alias("v"))
    return tidy(raster.check_raster(px.unionByName(shifted).unionByName(folded), inputs.sizes(spark, d).pixel_h, 2.0, -120.0))


def _raster_nodes(spark, d):
    h = inputs.sizes(spark, d).pixel_h
    px = raster.premultiply(inputs.pixels(spark, d), band="heightmap").drop("band")
    return raster.complete_lattice(raster.corner_mean(px, h), h), h


@register
def raster_corner_mean(spark, d):
    nodes, _ = _raster_nodes(spark, d)
    return tidy(nodes)


@register
def draft_corner_mean(spark, d):
    h = inputs.sizes(spark, d).pixel_h
    px = raster.draft_pixels(inputs.brightness_pixels(spark, d), DRAFT)
    return tidy(raster.complete_lattice(raster.corner_mean(px, h), h))


@register
def draft_legacy_mapping(spark, d):
    return tidy(raster.draft_pixels(inputs.brightness_pixels(spark, d), LEGACY_DRAFT))


@register
def raster_to_cube(spark, d):
    nodes, h = _raster_nodes(spark, d)
    return tidy(raster.raster_to_cube(nodes, h, inputs.sizes(spark, d).n))


@register
def guide_fill(spark, d):
    """Imported raster over a fallback field, blended in raw values and then encoded."""
    nodes, h = _raster_nodes(spark, d)
    n = inputs.sizes(spark, d).n
    imported = raster.raster_to_cube(nodes, h, n)
    fallback = inputs.cube_field(spark, d).withColumnRenamed("v", "heightmap")
    return tidy(raster.build_guide({"heightmap": imported}, fallback, n))


@register
def guide_from_files(spark, d):
    """Corner means of the channels that a folder holds, two of five."""
    s, folder = inputs.sizes(spark, d), _scratch(spark, "channels")
    px = inputs.pixels(spark, d).select("row_i", "col_i", "v")
    px.write.parquet(f"{folder}/heightmap.parquet")
    px.withColumn("v", F.abs("v")).write.parquet(f"{folder}/precipitation.parquet")
    found = guide.read_channels(spark, folder)
    rows = None
    for band, pixels in found.items():
        part = raster.complete_lattice(raster.corner_mean(raster.premultiply(pixels.drop("band"), band=band), s.pixel_h), s.pixel_h)
        part = part.select(F.lit(band).alias("band"), "y", "x", "value", "coverage")
        rows = part if rows is None else rows.unionByName(part)
    return tidy(rows, 5)


@register
def guide_partial_channels(spark, d):
    """Two imported channels of five; the others keep the fallback."""
    s = inputs.sizes(spark, d)
    px = inputs.pixels(spark, d).drop("band")
    channels = {"heightmap": (px, s.pixel_h),
                "precipitation": (px.withColumn("v", F.abs("v")), s.pixel_h)}

    def fallback(nodes, n):
        return inputs.cube_climate(spark, d).select(
            "face", "y", "x", g.signed_square("z").alias("heightmap"), F.col("temp").alias("temperature"),
            F.col("temp_std100").alias("temperature_std"), F.col("precip").alias("precipitation"),
            F.col("precip_cv").alias("precipitation_cv"))
    return tidy(guide.RasterGuide(channels, fallback).guide(s.n), 5)


@register
def footprint_requested_nodes(spark, d):
    """Footprint means of only those nodes that lie next to a point."""
    nodes, h = _raster_nodes(spark, d)
    n = inputs.sizes(spark, d).n
    p = g.add_cube_coordinates(_directed(spark, d), n)
    wanted = p.select("face", g.nearest_index("cy").alias("y"), g.nearest_index("cx").alias("x")).distinct()
    return tidy(raster.footprint_mean(wanted, nodes, h, n))


@register
def draft_fill(spark, d):
    """Brightness map over an encoded fallback, blended in metres."""
    s = inputs.sizes(spark, d)
    px = raster.draft_pixels(inputs.brightness_pixels(spark, d), DRAFT).drop("land")
    nodes = raster.complete_lattice(raster.corner_mean(px, s.pixel_h), s.pixel_h)
    imported = raster.raster_to_cube(nodes, s.pixel_h, s.n)
    fallback = inputs.cube_field(spark, d).select("face", "y", "x", g.signed_sqrt("v").alias("heightmap"))
    return tidy(raster.fill(imported, fallback, s.n, "heightmap", space="metres"))


@register
def climate_finalise(spark, d):
    return tidy(cm.finalise_climate(inputs.climate_nodes(spark, d), temp_std="temp_std100", **COEFFICIENTS))


@register
def smooth_guide_at_points(spark, d):
    p = _directed(spark, d).withColumn("f", distribution.smooth_field(SEED))
    return tidy(p.select("point_id", "f", (F.lit(2200.0) * F.col("f") - F.lit(900.0)).alias("elev")))


@register
def smooth_guide_channels(spark, d):
    """All five channels of the smooth seeded world at points."""
    return tidy(distribution.guide_channels(_directed(spark, d), SEED).select("point_id", *cm.CHANNELS))


@register
def channel_rescale(spark, d):
    """Stored channels to model units and back, one channel less another, and spacing on the ground."""
    spacing = g.ground_spacing(6371.0, inputs.sizes(spark, d).h)
    c = inputs.climate_nodes(spark, d)
    return tidy(c.select(
        "y", "x", cm.standardise(F.col("temp"), 12.5, 4.0).alias("standard"),
        cm.unstandardise(cm.standardise(F.col("precip"), 700.0, 35.0), 38.6, -31.4).alias("rescaled"),
        cm.channel_difference(F.col("temp_std100"), F.col("precip_cv")).alias("rest"), F.lit(spacing).alias("spacing_km")))


# ----------------------------------------------------------------------------- tiles
@register
def tile_context_lonlat(spark, d):
    """Planned tiles over a node field, with the sum and the corners of what lies under each."""
    s = inputs.sizes(spark, d)
    c = tiles.gather_context_lonlat(grids.lonlat_tile_plan(spark, s.h, 8, 4), inputs.node_field(spark, d), s.h, 8)
    return tidy(c.select("ty", "tx", F.aggregate("values", F.lit(0.0), lambda a, v: a + v).alias("total"),
                         F.get("values", F.lit(0)).alias("first"), F.get("values", F.lit(63)).alias("last")), 4)


@register
def tile_accounting(spark, d):
    """Tiles of the doubled lattice that all points use, found saved or to be scored."""
    n = 2 * inputs.sizes(spark, d).tile_n
    p = g.add_cube_coordinates(_directed(spark, d), n)
    nodes = p.select("face", g.nearest_index("cy").alias("y"), g.nearest_index("cx").alias("x"))
    needed = tiles.tiles_for_nodes(nodes, n, 8, 4, include_endpoint=True)
    return tidy(tiles.account(needed, inputs.tiles(spark, d)))


def _plan(spark, d):
    return grids.tile_plan(spark, inputs.sizes(spark, d).tile_n, 8, 4, include_endpoint=True)


@register
def tile_plan(spark, d):
    """Planned tiles with the number of predictions present for each."""
    have = inputs.tiles(spark, d).groupBy("face", "ty", "tx").agg(F.count(F.lit(1)).alias("c"))
    j = _plan(spark, d).join(have, ["face", "ty", "tx"], "left")
    return tidy(j.select("face", "ty", "tx", F.coalesce("c", F.lit(0)).alias("predictions")))


def _inset_requests(spark, d):
    """Requests drawn in a little, so that no sample lies exactly on a face edge."""
    return inputs.requests(spark, d).withColumns({
        "west": F.col("west") + 3e-3, "east": F.col("east") - 3e-3,
        "south": F.col("south") + 2e-3, "north": F.col("north") - 2e-3})


@register
def tile_cost_estimate(spark, d):
    return tidy(tiles.estimate_tiles(region.good_requests(_inset_requests(spark, d)), 4096))


@register
def tile_cost_bitmap(spark, d):
    return tidy(tiles.estimate_tiles_bitmap(region.good_requests(_inset_requests(spark, d)), 4096))


@register
def tile_cost_sketch(spark, d):
    """Whether the approximate count of each request is within four standard errors of the exact one."""
    r = region.good_requests(_inset_requests(spark, d))
    both = tiles.estimate_tiles(r, 4096).join(tiles.estimate_tiles_sketch(r, 4096).withColumnRenamed("tiles", "about"), "request_id")
    return both.select("request_id", (F.abs(F.col("about") - F.col("tiles")) <= F.greatest(
        F.lit(1.0), F.col("tiles") * (4 * tiles.SKETCH_ERROR))).alias("within"))


@register
def tile_cost_stopped(spark, d):
    """Counts that stop beyond twelve tiles, in rounds of sample rows."""
    r = region.good_requests(_inset_requests(spark, d))
    return tidy(tiles.estimate_tiles_until(r, 4096, 12, first_rows=1))


@register
def tile_cost_guard(spark, d):
    r = region.validate(_inset_requests(spark, d))
    est = tiles.estimate_tiles(r.where(F.col("error").isNull()), 4096)
    return tidy(region.guard_cost(r, est, limit=12).select(
        "request_id", F.coalesce("tiles", F.lit(0)).alias("tiles"), "error"))


@register
def tile_round_trip(spark, d):
    """Tiles to cells and back; reports values that changed."""
    t = inputs.tiles(spark, d).select("vec_id", "face", "ty", "tx", "values")
    back = tiles.collect_tiles(tiles.explode_tiles(t, 8).withColumnRenamed("values", "v"), 8,
                               keys=["vec_id", "face", "ty", "tx"]).withColumnRenamed("values", "again")
    j = t.join(back.select("vec_id", "again"), "vec_id")
    same = F.forall(F.zip_with(F.transform("values", lambda v: v.cast("double")), "again",
                               lambda a, b: a == b), lambda e: e)
    return tidy(j.agg(F.count(F.lit(1)).alias("tiles"), F.count_if(same & (F.size("again") == 64)).alias("same")))


@register
def tile_blend_cube(spark, d):
    t = inputs.tiles(spark, d).select("face", "ty", "tx", "values")
    return tidy(tiles.blend_cube(t, inputs.sizes(spark, d).tile_n, 8, window="tent", shared=False))


@register
def tile_blend_shared(spark, d):
    t = inputs.tiles(spark, d).select("face", "ty", "tx", "values")
    return tidy(tiles.blend_cube(t, inputs.sizes(spark, d).tile_n, 8))


def _cover_h(sizes):
    return 4 * (sizes.origins - 1)


@register
def tile_blend_channels(spark, d):
    """Two channels share one weight sum."""
    t = inputs.tiles(spark, d).select("face", "ty", "tx", "values", F.transform(
        "values", lambda v: v.cast("double") * F.col("label")).alias("scaled"))
    return tidy(tiles.blend_cube(t, inputs.sizes(spark, d).tile_n, 8, channels=["values", "scaled"]))


@register
def tile_blend_lonlat(spark, d):
    """All tiles laid over a longitude/latitude lattice, folding over both poles."""
    s = inputs.sizes(spark, d)
    h = _cover_h(s)
    t = inputs.tiles(spark, d).select(
        F.col("ty"), (F.col("tx") + F.lit(4) + F.when(F.col("face") % 2 == 1, F.lit(h)).otherwise(F.lit(0))).alias("tx"),
        "values")
    return tidy(tiles.blend_lonlat(t, h, 8))


@register
def tile_blend_at_nodes(spark, d):
    n = inputs.sizes(spark, d).tile_n
    p = g.add_cube_coordinates(_directed(spark, d), n)
    nodes = p.select("face", g.nearest_index("cy").alias("y"), g.nearest_index("cx").alias("x"))
    t = inputs.tiles(spark, d)
    return tidy(tiles.blend_at_nodes(nodes, t, n, 8, 4, include_endpoint=True))


@register
def tile_dependencies(spark, d):
    n = inputs.sizes(spark, d).tile_n
    p = g.add_cube_coordinates(_directed(spark, d), n)
    nodes = p.select(
        "face", g.nearest_index("cy").alias("y"), g.nearest_index("cx").alias("x"))
    return tidy(tiles.tiles_for_nodes(nodes, n, 8, 4, include_endpoint=True))


@register
def tile_missing(spark, d):
    """Planned tiles of the doubled lattice that the saved table lacks."""
    saved = inputs.tiles(spark, d)
    return tidy(tiles.missing_tiles(grids.tile_plan(spark, 2 * inputs.sizes(spark, d).tile_n, 8, 4, include_endpoint=True), saved))


def _contexts(spark, d):
    n = inputs.sizes(spark, d).n
    return tiles.gather_context(grids.tile_plan(spark, n, 8, 4, True), inputs.cube_field(spark, d), n, 8), n


@register
def tile_saved(spark, d):
    """Saved tiles that requests need, with how often each was saved."""
    n = inputs.sizes(spark, d).tile_n
    p = g.add_cube_coordinates(_directed(spark, d), n)
    nodes = p.select("face", g.nearest_index("cy").alias("y"), g.nearest_index("cx").alias("x"))
    needed = tiles.tiles_for_nodes(nodes, n, 8, 4, include_endpoint=True)
    kept = tiles.saved_tiles(needed, inputs.tiles(spark, d))
    return tidy(kept.groupBy("face", "ty", "tx").agg(F.count(F.lit(1)).alias("copies")))


@register
def points_clustered(spark, d):
    """Points with their storage tile, ordered inside range partitions."""
    p = tiles.cluster_points(_directed(spark, d), 256, 32)
    return tidy(p.select("point_id", "face", F.col("by").alias("tile_y"), F.col("bx").alias("tile_x")))


@register
def point_groups(spark, d):
    """Ordered chunks of at most 50 points a storage tile."""
    c = tiles.point_groups(_directed(spark, d), 64, 32, most=50)
    return tidy(c.select("face", F.col("by").alias("tile_y"), F.col("bx").alias("tile_x"), "chunk", F.size("ids").alias("points"),
                         F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256")))


@register
def tile_score_stencil(spark, d):
    """Plan, gather with halo, score in Arrow batches, blend."""
    contexts, n = _contexts(spark, d)
    return tidy(tiles.blend_cube(tiles.score_tiles(contexts, tiles.stencil_scorer(0.25), 8), n, 8))


@register
def tile_score_blocks(spark, d):
    """The same tiles put together from stored blocks by slicing."""
    stored = _cube_blocks(spark, d, "double")
    n = stored.lattice.size
    contexts = block_reads.gather_context(grids.tile_plan(spark, n, 8, 4, True), stored, 8, 8, "v")
    return tidy(tiles.blend_cube(tiles.score_tiles(contexts, tiles.stencil_scorer(0.25), 8), n, 8))


@register
def tile_score_channels(spark, d):
    """Two context channels and a coarse condition go in, two blended channels come out."""
    n = inputs.sizes(spark, d).n
    field = store.cut_lineage(inputs.cube_climate(spark, d).select("face", "y", "x", "temp", "precip"))
    origins = grids.tile_plan(spark, n, 8, 4, True)
    context = tiles.gather_context(origins, field, n, 8, {"temp": "temp", "precip": "precip"})
    low = tiles.crop_context(origins, field, n, 4, value="temp").withColumnRenamed("values", "cond")

    def load():
        def predict(a):
            mean = a["cond"].mean(axis=(1, 2), keepdims=True)
            return {"temp": a["temp"] - mean, "precip": 0.5 * a["precip"]}
        return predict
    scored = tiles.score_tiles(context.join(low, ["face", "ty", "tx"]), load, 8,
                               {"temp": (8, 8), "precip": (8, 8), "cond": (4, 4)}, ["temp", "precip"])
    return tidy(tiles.blend_cube(scored, n, 8, channels=["temp", "precip"]))


@register
def tile_score_columns(spark, d):
    """The same scorer as array expressions."""
    contexts, n = _contexts(spark, d)
    scored = contexts.withColumn("values", tiles.stencil_column("values", 8, 0.25))
    return tidy(tiles.blend_cube(scored, n, 8))


@register
def tile_crop_context(spark, d):
    """4 x 4 bilinear coarse neighbourhood of every saved tile, four nodes to a coarse cell."""
    n = inputs.sizes(spark, d).n
    origins = grids.tile_plan(spark, 4 * n, 16, 8, True)
    c = tiles.crop_context(origins, inputs.cube_field(spark, d), n, 4)
    return tidy(c.select("face", "ty", "tx", F.posexplode("values").alias("k", "v")), 5)


@register
def tile_repeat_context(spark, d):
    n = inputs.sizes(spark, d).n
    origins = grids.tile_plan(spark, 4 * n, 16, 8, True)
    c = tiles.repeat_context(origins, inputs.cube_field(spark, d), n, 16, factor=4)
    return tidy(c.select("face", "ty", "tx", F.posexplode("values").alias("k", "v")), 5)


# ----------------------------------------------------------------------------- filters
@register
def filter_gauss_lonlat(spark, d):
    return tidy(filters.filter_lonlat(inputs.node_field(spark, d), inputs.sizes(spark, d).h, grids.gaussian_kernel()), 5)


@register
def filter_triangular_reduce(spark, d):
    return tidy(filters.reduce_lonlat(inputs.node_field(spark, d), inputs.sizes(spark, d).h, 4), 5)


@register
def laplacian_merge_lonlat(spark, d):
    h = inputs.sizes(spark, d).h
    f = store.cut_lineage(inputs.node_field(spark, d))  # read by every level of the merge
    low = filters.reduce_lonlat(f, h, 4)
    return tidy(filters.merge_low_frequency_lonlat(f, h, low, h // 4), 5)


@register
def filter_gauss_cube(spark, d):
    return tidy(filters.filter_cube(inputs.cube_field(spark, d), inputs.sizes(spark, d).n, grids.gaussian_kernel()), 5)


@register
def filter_triangular_reduce_cube(spark, d):
    return tidy(filters.reduce_cube(inputs.cube_field(spark, d), inputs.sizes(spark, d).n, 2), 5)


@register
def laplacian_merge_cube(spark, d):
    n = inputs.sizes(spark, d).n
    f = store.cut_lineage(inputs.cube_field(spark, d))
    low = store.cut_lineage(filters.reduce_cube(f, n, 2, stored=True))
    return tidy(filters.merge_low_frequency_cube(f, n, low, n // 2), 5)


@register
def pole_constraint(spark, d):
    c = inputs.climate_nodes(spark, d).select("y", "x", "elev", "temp")
    return tidy(filters.constrain(c, inputs.sizes(spark, d).h))


# ----------------------------------------------------------------------------- climate
@register
def local_lapse_rate(spark, d):
    h = inputs.sizes(spark, d).h
    c = inputs.climate_nodes(spark, d).withColumn("elev", F.greatest("elev", F.lit(0.0)))
    return tidy(climate.local_baseline(c, [], (0, h), (0, 2 * h - 1)))


@register
def climate_features_cube(spark, d):
    return tidy(climate.climate_features(inputs.cube_climate(spark, d), inputs.sizes(spark, d).n))


@register
def climate_stored(spark, d):
    """Features saved with units and version, opened under that contract and read back at every node."""
    n, path = inputs.sizes(spark, d).n, _scratch(spark, "climate")
    climate.write_climate(climate.climate_features(inputs.cube_climate(spark, d), n), path, n, 8, "double")
    saved = climate.open_climate(spark, path)
    return tidy(block_reads.nearest(grids.cube_nodes(spark, n), saved, "face", "y", "x"))


@register
def climate_at_points(spark, d):
    n = inputs.sizes(spark, d).n
    f = climate.climate_features(inputs.cube_climate(spark, d), n)
    p = climate.climate_at(inputs.points(spark, d), f, n, "value")
    return tidy(p.select("point_id", "temp", "temp_std", "precip", "precip_cv", "beta"))


@register
def climate_export_window(spark, d):
    """Five climate bands on an export window that crosses the date line."""
    s = inputs.sizes(spark, d)
    px = region.export_window(inputs.node_field(spark, d), s.h, s.h, _dateline(s.h))
    f = climate.climate_features(inputs.cube_climate(spark, d), s.n)
    out = climate.climate_at(px, f, s.n, "v", prune=True)
    return tidy(out.select("row_i", "col_i", "temp", "temp_std", "precip", "precip_cv", "beta"))


# ----------------------------------------------------------------------------- distributions
@register
def quantile_table(spark, d):
    q = distribution.quantile_table(inputs.table(spark, d, "lineitem"), "l_extendedprice", "price")
    return tidy(q.select("channel", F.posexplode("q").alias("i", "q")), 4)


@register
def quantile_table_approximate(spark, d):
    """Whether the true rank of each approximate quantile is within one part in ``accuracy`` of the wanted one."""
    rows, accuracy = inputs.table(spark, d, "lineitem").select("l_extendedprice"), 10_000
    table = distribution.quantile_table(rows, "l_extendedprice", "price", approximate=True, accuracy=accuracy)
    q = table.first()["q"]  # one row of 64 numbers
    below = [F.count_if(F.col("l_extendedprice") < v) for v in q]
    upto = [F.count_if(F.col("l_extendedprice") <= v) for v in q]
    ranks = rows.agg(F.count("l_extendedprice").alias("n"), F.array(*below).alias("below"), F.array(*upto).alias("upto"))
    points = F.array(*[F.lit(float(p)) for p in distribution.quantile_points(len(q))])
    each = ranks.select("n", F.posexplode(F.arrays_zip(points.alias("p"), "below", "upto")).alias("i", "r"))
    wanted, slack = F.col("r.p") * F.col("n"), F.col("n") / accuracy + 1
    return tidy(each.select(F.lit("price").alias("channel"), "i", (
        (F.col("r.below") - slack <= wanted) & (wanted <= F.col("r.upto") + slack)).alias("within")))


@register
def quantile_table_ties(spark, d):
    """Heavily repeated values: the strictly increasing repair is used."""
    q = distribution.quantile_table(inputs.table(spark, d, "lineitem"), "l_quantity", "quantity")
    return tidy(q.select("channel", F.posexplode("q").alias("i", "q")), 4)


@register
def quantile_map(spark, d):
    """Two populations, each with its own target: northern rows to orders, southern to line items."""
    h = inputs.sizes(spark, d).h
    f = inputs.node_field(spark, d).withColumn("channel", F.when(F.col("y") < h // 2, F.lit("n")).otherwise(F.lit("s")))
    prices = inputs.table(spark, d, "orders").select(F.lit("n").alias("channel"), F.col("o_totalprice").alias("p")).unionByName(
        inputs.table(spark, d, "lineitem").select(F.lit("s").alias("channel"), F.col("l_extendedprice").alias("p")))
    mapped = distribution.quantile_map(f, "v", distribution.quantile_tables(f, "v"),
                                       distribution.quantile_tables(prices, "p"))
    return tidy(mapped.select("y", "x", "channel", "mapped"), 4)


@register
def drop_ocean(spark, d):
    f = distribution.drop_ocean_rows(inputs.node_field(spark, d), "v", 0.5, ["y", "x"], portable=True)
    return tidy(f)


@register
def seeded_gaussian_nodes(spark, d):
    n = inputs.sizes(spark, d).n
    f = distribution.gaussian_cube_noise(inputs.cube_field(spark, d), n, SEED, 7, portable=True)
    mixed = cm.mix_signal_noise(cm.standardise(F.col("v"), 0.0, 2500.0), F.col("noise"), 0.3)
    return tidy(f.withColumn("mixed", mixed).select("face", "y", "x", "noise", "mixed"))


@register
def seeded_gaussian_lonlat(spark, d):
    h = inputs.sizes(spark, d).h
    f = distribution.gaussian_lonlat_noise(inputs.node_field(spark, d), h, SEED, 9, 2, portable=True)
    return tidy(f.select("y", "x", "noise"))


# ----------------------------------------------------------------------------- reports
@register
def grid_phase_profile(spark, d):
    h = inputs.sizes(spark, d).h
    return tidy(quality.grid_phase_profile(inputs.node_field(spark, d), h + 1, 2 * h))


@register
def grid_phase_report(spark, d):
    h = inputs.sizes(spark, d).h
    return tidy(quality.grid_phase_report(inputs.node_field(spark, d), h + 1, 2 * h))


@register
def edge_report(spark, d):
    return tidy(quality.edge_report(inputs.cube_field(spark, d), inputs.sizes(spark, d).n))


@register
def shared_node_error(spark, d):
    return tidy(quality.shared_node_error(inputs.cube_raw(spark, d), inputs.sizes(spark, d).n))


@register
def polar_anisotropy(spark, d):
    return tidy(quality.polar_anisotropy(inputs.node_field(spark, d), inputs.sizes(spark, d).h))


def _climate_elevation(spark, d):
    return inputs.climate_nodes(spark, d).select("y", "x", F.col("elev").alias("v"))


@register
def area_weighted_land_metrics(spark, d):
    h = inputs.sizes(spark, d).h
    smooth = filters.filter_lonlat(inputs.node_field(spark, d), h, grids.gaussian_kernel())
    return tidy(quality.land_metrics(smooth, inputs.node_field(spark, d), h))


@register
def layout_compare(spark, d):
    s = inputs.sizes(spark, d)
    values = region.export_window(inputs.node_field(spark, d), s.h, s.pixel_h // 4).select("row_i", "col_i", "v")
    painted = inputs.brightness_pixels(spark, d).select("row_i", "col_i", F.when(
        F.col("alpha") > 0, F.pmod("code", F.lit(256))).otherwise(F.lit(0)).alias("code"))
    return tidy(quality.layout_compare(values, painted, s.pixel_h // 4, 4, 4000.0))


@register
def field_error(spark, d):
    a = filters.constrain(_climate_elevation(spark, d), inputs.sizes(spark, d).h)
    return tidy(quality.field_error(a, inputs.node_field(spark, d), ["y", "x"]))


@register
def stored_lonlat_tolerance(spark, d):
    """A node field saved as float32, opened with its checks, against what was saved: exact, and within tolerance."""
    field, path = inputs.node_field(spark, d), _scratch(spark, "nodes")
    store.write_lonlat_field(field, path, inputs.sizes(spark, d).h, {"units": "m"})
    saved, _ = store.open_lonlat_run(spark, path, {"units": "m"})
    loose = quality.within_tolerance(saved, field, ["y", "x"], relative=1e-6)
    exact = quality.within_tolerance(saved, field, ["y", "x"], relative=0.0, absolute=0.0)
    return tidy(loose.withColumn("tolerance", F.lit("float")).unionByName(exact.withColumn("tolerance", F.lit("none"))))


@register
def verify_state_report(spark, d):
    s = inputs.sizes(spark, d)
    return tidy(quality.verify_state(inputs.node_field(spark, d), s.h))


@register
def verify_stored_report(spark, d):
    """The report of a saved field in blocks, and of a copy one of whose digests is wrong."""
    stored = _lonlat_blocks(spark, d, "double")
    path = _scratch(spark, "changed")
    stored._table().write.partitionBy("part").parquet(f"{path}/field")
    for k in range(stored.info["levels"]):
        level = stored._level(k)
        level = level.withColumn("digest", F.when(F.col("z") == 1, F.lit(0).cast("bigint")).otherwise(F.col("digest"))) if k == 0 else level
        level.write.parquet(f"{path}/digests/level={k}")
    store.write_manifest(spark, f"{path}/identity", stored.info)
    both = [quality.verify_stored(s, stored.info["root"]).withColumn("copy", F.lit(name))
            for s, name in ((stored, "saved"), (dataclasses.replace(stored, path=path), "changed"))]
    return tidy(both[0].unionByName(both[1]))


@register
def seam_vs_interior(spark, d):
    h = inputs.sizes(spark, d).h
    f = inputs.node_field(spark, d)
    around = filters.differences(filters.lonlat_halo(f, h, 0, 1), ["y"], "x", "v", -1, 2 * h)
    around = around.where(F.col("x").between(0, 2 * h - 1))
    return tidy(around.groupBy("y").agg(F.max(F.when(F.col("x") == 0, F.abs("d"))).alias("seam_step"),
                                        F.sqrt(F.avg(F.when(F.col("x") > 0, F.col("d") * F.col("d")))).alias("inner_rms")))


@register
def row_spread(spark, d):
    return tidy(quality.row_spread(inputs.climate_nodes(spark, d), "elev"))


@register
def tile_boundary_ratio(spark, d):
    n = inputs.sizes(spark, d).n
    return tidy(quality.tile_boundary_ratio(inputs.cube_field(spark, d), n, 4))


@register
def residual_stats(spark, d):
    return tidy(quality.residual_stats(inputs.cube_field(spark, d), inputs.sizes(spark, d).n))


@register
def field_extremes(spark, d):
    return tidy(quality.field_extremes(inputs.cube_raw(spark, d), ["face", "y", "x"]))


@register
def ocean_audit(spark, d):
    return tidy(quality.ocean_audit(inputs.node_field(spark, d), inputs.sizes(spark, d).h))


@register
def area_mean_pixels(spark, d):
    """Area-weighted mean and range of the exported pixel grid."""
    h = inputs.sizes(spark, d).h
    px = region.export_window(inputs.node_field(spark, d), h, h).withColumn("w", g.latitude_weight_pixels("row_i", h))
    return tidy(px.agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("mean_v"),
                       F.min("v").alias("low"), F.max("v").alias("high")))


@register
def verify_region_report(spark, d):
    """Short reports on the answers of all requests as saved, and on a copy in which one value changed."""
    grid = region.region_query_lonlat(inputs.requests(spark, d), inputs.node_field(spark, d),
                                      inputs.sizes(spark, d).h).select("request_id", "row_i", "col_i", F.round("v", 6).alias("v"))
    keys, path = ["request_id", "row_i", "col_i"], _scratch(spark, "region")
    store.write_region(grid, path, {"source": "requests"})
    saved = store.load_region(spark, path)
    digest = store.read_manifest(spark, f"{path}/identity")
    first = saved.agg(F.min(F.struct(*keys)).alias("k")).select("k.*").withColumn("__hit", F.lit(1.0))
    wrong = saved.join(F.broadcast(first), keys, "left").withColumn("v", F.col("v") + F.coalesce("__hit", F.lit(0.0))).drop("__hit")
    return quality.verify_region(saved, keys, digest).withColumn("copy", F.lit("saved")).unionByName(
        quality.verify_region(wrong, keys, digest).withColumn("copy", F.lit("changed")))


# ----------------------------------------------------------------------------- storage
@register
def field_checksum(spark, d):
    f = inputs.node_field(spark, d).withColumn("v", F.round("v", 3))
    return store.portable_checksum(f, ["y", "x"], 3)


@register
def manifest_compare(spark, d):
    """Keys that differ between the identities of two derived fields."""
    def identity(df, name):
        return df.agg(F.create_map(
            F.lit("name"), F.lit(name), F.lit("rows"), F.count(F.lit(1)).cast("string"),
            F.lit("units"), F.lit("m")).alias("info"))
    return store.manifest_differences(identity(inputs.node_field(spark, d), "nodes"),
                                      identity(inputs.cube_raw(spark, d), "cube"))


@register
def weight_list_parse(spark, d):
    e = inputs.table(spark, d, "events")
    v = F.col("value")
    text = F.concat_ws(",", F.lit("0.2"), F.lit(" 0.2"), F.when(v > 60, F.lit("bad")).otherwise(F.lit("1.0")),
                       F.round(F.pmod("event_id", F.lit(50)) / F.lit(10.0), 1).cast("string"), F.lit("0.2"))
    p = e.select("event_id", cm.parse_weight_list(text).alias("w"))
    return tidy(p.select("event_id", F.col("w").isNotNull().alias("ok"), F.get("w", F.lit(3)).alias("fourth")))


@register
def record_digest(spark, d):
    return inputs.table(spark, d, "documents").select("doc_id", store.record_digest("text").alias("sha256"))


@register
def stored_field_query(spark, d):
    """Save, verify and reopen a cube field, then answer points from the saved table."""
    s = inputs.sizes(spark, d)
    path = _scratch(spark, "field")
    store.write_cube_field(inputs.cube_field(spark, d), path, s.n, {"units": "m"})
    field, _ = store.open_run(spark, path, {"units": "m"})
    return tidy(sampling.sample_cube_nearest(_directed(spark, d), field, s.n).select("point_id", "v"), 2)


# ----------------------------------------------------------------------------- streaming
def _request_stream(spark, d):
    schema = inputs.table(spark, d, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return inputs.requests_from(events)


def _run_append(df, path):
    q = df.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(
        availableNow=True).start(f"{path}/out")
    q.awaitTermination()
    return f"{path}/out"


@register
def stream_region_requests(spark, d):
    """Requests as a file stream joined with a static field; the sink is read back."""
    s = inputs.sizes(spark, d)
    field = store.cut_lineage(inputs.node_field(spark, d))
    out = stream.answer(_request_stream(spark, d), field, s.h)
    path = _run_append(out.select("request_id", "row_i", "col_i", "v"), _scratch(spark, "answers"))
    return tidy(spark.read.schema("request_id bigint, row_i int, col_i int, v double").parquet(path))


def _served(spark, d, field):
    path = _scratch(spark, "served")
    q = stream.serve(_request_stream(spark, d), field, inputs.sizes(spark, d).h, f"{path}/good", f"{path}/bad", f"{path}/state")
    q.awaitTermination()
    bad = spark.read.schema("request_id bigint, ts timestamp, error string, batch int").parquet(f"{path}/bad")
    good = spark.read.schema("request_id bigint, row_i int, col_i int, v double, batch int").parquet(f"{path}/good")
    good = good.groupBy("request_id").agg(F.count("v").alias("pixels"), F.sum("v").alias("total"))
    return tidy(bad.select("request_id", "error", F.lit(0).alias("pixels"), F.lit(0.0).alias("total")).unionByName(
        good.select("request_id", F.lit(None).cast("string").alias("error"), "pixels", "total")), 4)


@register
def stream_bad_requests(spark, d):
    """What the request loop wrote: an error for each bad request, and the pixels of each good one."""
    return _served(spark, d, store.cut_lineage(inputs.node_field(spark, d)))


@register
def stream_served_blocks(spark, d):
    """The same from a field in blocks."""
    return _served(spark, d, _lonlat_blocks(spark, d, "double"))


@register
def stream_batch_counts(spark, d):
    """What a listener heard while the stream ran."""
    counts = stream.BatchCounts("heard")
    spark.streams.addListener(counts)
    try:
        _run_append(stream.observe_requests(_request_stream(spark, d), "heard").select("request_id", "error"), _scratch(spark, "heard"))
        if not counts.finished.wait(60) or counts.failure:
            raise RuntimeError(f"the stream did not end well: {counts.failure}")
    finally:
        spark.streams.removeListener(counts)
    rows = [(b, c["requests"], c["errors"], c["pixels"]) for b, c in counts.rows.items()]
    heard = spark.createDataFrame(rows, "batch bigint, requests bigint, errors bigint, pixels bigint")
    return heard.agg(*[F.sum(c).alias(c) for c in ("requests", "errors", "pixels")])


@register
def stream_unique_requests(spark, d):
    """Requests in two deliveries, with repeats within and across them, rows too late, and a restart between; each is kept once."""
    path, r = _scratch(spark, "unique"), inputs.requests(spark, d)
    late = r.withColumns({"request_id": F.col("request_id") + 10**9, "ts": F.col("ts") - F.expr("INTERVAL 20 YEARS")})
    first = r.where("request_id % 3 <> 0")
    for delivery in (first.unionByName(first.where("request_id % 4 = 1")), r.unionByName(late)):
        delivery.write.mode("append").parquet(f"{path}/inbox")
        arriving = spark.readStream.schema(r.schema).parquet(f"{path}/inbox")
        _run_append(stream.unique_requests(arriving, "3650 days").select("request_id", "ts"), path)
    kept = spark.read.schema("request_id bigint, ts timestamp").parquet(f"{path}/out")
    return kept.select("request_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))


@register
def observed_stages(spark, d):
    """An input kept once, a stage written and restored, and what was counted while another was written."""
    path, s = _scratch(spark, "stages"), inputs.sizes(spark, d)
    kept = store.snapshot_input(inputs.node_field(spark, d), f"{path}/input")
    again = store.snapshot_input(kept.limit(0), f"{path}/input")
    stage = store.record_stage(again, f"{path}/stage", ["y", "x"], (s.h + 1) * 2 * s.h, "nodes")
    back = store.record_stage(stage.withColumn("v", F.lit(0.0)), f"{path}/stage", ["y", "x"], (s.h + 1) * 2 * s.h, "nodes")
    holes, seen = store.observe_stage(back.withColumn("v", F.when(F.col("y") % 5 > 0, F.col("v"))), "holes")
    holes.write.parquet(f"{path}/holes")
    return tidy(back.agg(F.count(F.lit(1)).alias("nodes"), F.sum("v").alias("total")).withColumns(
        {"observed": F.lit(seen.get["rows"]), "bad": F.lit(seen.get["bad"])}), 3)


@register
def stream_progress(spark, d):
    """Requests per hour of event time, every window included."""
    path = _scratch(spark, "progress")
    stream.keep_progress(_request_stream(spark, d), f"{path}/out", f"{path}/state").awaitTermination()
    rows = stream.latest_progress(spark, f"{path}/out")
    return rows.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@register
def stream_tile_store(spark, d):
    """Tiles that a request stream needs are scored once and kept; the store is read back."""
    s = inputs.sizes(spark, d)
    n, field = s.n, store.cut_lineage(inputs.cube_field(spark, d))
    path = _scratch(spark, "tiles")

    def needed(requests):
        p = g.add_cube_coordinates(g.add_lonlat_direction(region.region_pixels(requests)), n)
        nodes = p.select("face", g.nearest_index("cy").alias("y"), g.nearest_index("cx").alias("x"))
        return tiles.tiles_for_nodes(nodes, n, 8, 4, include_endpoint=True)

    def contexts(origins):
        return tiles.gather_context(origins, field, n, 8)
    kept = tile_store.open_tiles(spark, f"{path}/store", 8, {"model": "stencil"})
    for _ in range(2):  # the second, fresh run of the stream finds every tile saved
        q = stream.feed_tile_store(_request_stream(spark, d), needed, contexts, tiles.stencil_scorer(), kept, _scratch(spark, "state"))
        q.awaitTermination()
    return tidy(kept.read().select("face", "ty", "tx", F.aggregate(
        "values", F.lit(0.0), lambda a, v: a + v).alias("total")), 4)


@register
def tile_run_counts(spark, d):
    """Tiles of half the points, then of all points, then again; between them a batch dies and one is repeated."""
    n, field = inputs.sizes(spark, d).n, store.stage(inputs.cube_field(spark, d), "field")
    p = g.add_cube_coordinates(_directed(spark, d), n)
    nodes = p.select("point_id", "face", g.nearest_index("cy").alias("y"), g.nearest_index("cx").alias("x"))
    kept = tile_store.open_tiles(spark, _scratch(spark, "store"), 8)
    dead = spark.range(1).select(*[F.lit(0).alias(k) for k in tiles.TILE_KEY], F.array_repeat(F.lit(0.0), 64).alias("values"))
    rows = []
    for run, (part, batch) in enumerate(((nodes.where("point_id % 2 = 0"), "half"), (nodes, "all"), (nodes, "all"))):
        dead.write.parquet(f"{kept.path}/data/batch=dead-{run}")  # no record names it
        needed = tiles.tiles_for_nodes(part, n, 8, 4, include_endpoint=True)
        out, counts = stream.score_incremental(
            needed, lambda o: tiles.gather_context(o, field, n, 8), tiles.stencil_scorer(), kept, batch)
        found = out.agg(F.count(F.lit(1)).alias("found"))
        rows.append(found.select(F.lit(run + 1).alias("run"), *[F.lit(counts[k]).alias(k) for k in ("used", "reused", "scored")], "found"))
    return tidy(rows[0].unionByName(rows[1]).unionByName(rows[2]))
