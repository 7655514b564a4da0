"""Verification and comparison reports; every report is a small table from distributed sums."""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..sources.blocks import BlockStore
from ..sources.store import content_checksum, stage
from . import blocks, sampling
from .filters import differences

BUCKETS = 1 << 16  # of rows that are compared by hash sums

EPS = 1e-12


def _rms(d):
    d = F.col(d) if isinstance(d, str) else d
    return F.sqrt(F.avg(d * d))


def _not_finite(v):
    v = F.col(v) if isinstance(v, str) else v
    return v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))


def _combine(parts: list[DataFrame]) -> DataFrame:
    """One row from several one-row tables with different columns, without a join."""
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    return rows.agg(*[F.max(c).alias(c) for c in rows.columns])


# ----------------------------------------------------------------------------- grid phase
def grid_phase_profile(grid: DataFrame, rows: int, cols: int, period: int = 8,
                       value: str = "v") -> DataFrame:
    """Mean gradient RMS by index phase, for rows (along x) and columns (along y)."""
    y0, y1, x0, x1 = rows // 8, rows - rows // 8, cols // 8, cols - cols // 8
    across = differences(grid.where(F.col("y").between(y0, y1 - 1)), ["y"], "x", value, 0, cols - 1)
    down = differences(grid.where(F.col("x").between(x0, x1 - 1)), ["x"], "y", value, 0, rows - 1)
    lines = (across.groupBy(F.lit("row").alias("axis"), F.col("y").alias("line")).agg(_rms("d").alias("rms"))
             .unionByName(down.groupBy(F.lit("column").alias("axis"), F.col("x").alias("line"))
                          .agg(_rms("d").alias("rms"))))
    return lines.groupBy("axis", F.pmod("line", F.lit(period)).cast("int").alias("phase")).agg(
        F.avg("rms").alias("rms"))


def grid_phase_report(grid: DataFrame, rows: int, cols: int, period: int = 8,
                      value: str = "v") -> DataFrame:
    """Largest over smallest phase mean per axis: a value far above 1 shows a lattice artifact."""
    return _phase_ratios(grid_phase_profile(grid, rows, cols, period, value))


def _phase_ratios(p: DataFrame) -> DataFrame:
    def ratio(axis):
        rms = F.when(F.col("axis") == axis, F.col("rms"))
        return F.max(rms) / F.greatest(F.min(rms), F.lit(EPS))
    return p.agg(ratio("row").alias("row_phase_ratio"), ratio("column").alias("column_phase_ratio"))


# ----------------------------------------------------------------------------- directions
def ring_points(spark, latitudes: Sequence[float], count: int = 512) -> DataFrame:
    """Points on rings of latitude, both hemispheres."""
    rings = [float(s * d) for d in latitudes for s in ((1,) if d == 0 else (1, -1))]
    points = spark.range(count).select(
        F.col("id").cast("int").alias("point"),
        F.explode(F.array(*[F.lit(r) for r in rings])).alias("latitude_degrees"))
    return points.withColumn("__lon", F.lit(-math.pi) + F.lit(2 * math.pi / count) * F.col("point"))


def _step(df: DataFrame, q: Sequence[str], t: Sequence[str], angle: str) -> DataFrame:
    """Move from a unit vector along a tangent by an angle."""
    return df.withColumns({name: F.col(q[k]) * F.cos(F.col(angle)) + F.col(t[k]) * F.sin(F.col(angle))
                           for k, name in enumerate(g.VEC)})


def polar_anisotropy(field: DataFrame, h: int, latitudes=(0, 45, 60, 75, 80, 85, 88),
                     count: int = 512, value: str = "v") -> DataFrame:
    """East-west against north-south differences at equal distance on rings of latitude.

    The sample is a fixed number of ring points; the field is reduced to the cells they touch.
    """
    s = sampling.sample_lonlat(anisotropy_points(field.sparkSession, h, latitudes, count), field.select("y", "x", value), h, prune=True)
    return _anisotropy(s, value)


def anisotropy_points(spark, h: int, latitudes=(0, 45, 60, 75, 80, 85, 88), count: int = 512) -> DataFrame:
    """Two places a step apart, east and west and north and south of each ring point, as node coordinates with a sign."""
    p = ring_points(spark, latitudes, count)
    lat, lon = F.radians("latitude_degrees"), F.col("__lon")
    p = p.withColumns({"q0": F.cos(lat) * F.cos(lon), "q1": F.cos(lat) * F.sin(lon), "q2": F.sin(lat)})
    east = F.struct(F.lit("east").alias("axis"), (-F.sin(lon)).alias("t0"), F.cos(lon).alias("t1"),
                    F.lit(0.0).alias("t2"))
    north = F.struct(F.lit("north").alias("axis"), (-F.sin(lat) * F.cos(lon)).alias("t0"),
                     (-F.sin(lat) * F.sin(lon)).alias("t1"), F.cos(lat).alias("t2"))
    p = p.withColumn("__t", F.explode(F.array(east, north))).select(
        "point", "latitude_degrees", "q0", "q1", "q2", "__t.axis", "__t.t0", "__t.t1", "__t.t2")
    p = p.withColumn("sign", F.explode(F.array(F.lit(1.0), F.lit(-1.0))))
    p = p.withColumn("angle", F.col("sign") * F.lit(math.pi / h))
    p = g.add_lonlat_node(_step(p, ("q0", "q1", "q2"), ("t0", "t1", "t2"), "angle"), h)
    return p.select("latitude_degrees", "axis", "point", "sign", "ny", "nx")


def _anisotropy(s: DataFrame, value: str) -> DataFrame:
    d = s.groupBy("latitude_degrees", "axis", "point").agg(F.sum(F.col("sign") * F.col(value)).alias("d"))

    def rms(axis):
        return F.sqrt(F.avg(F.when(F.col("axis") == axis, F.col("d") * F.col("d"))))
    out = d.groupBy("latitude_degrees").agg(rms("east").alias("east_west_rms"),
                                            rms("north").alias("north_south_rms"))
    return out.withColumn("direction_ratio", F.col("east_west_rms")
                          / F.greatest(F.col("north_south_rms"), F.lit(EPS)))


# ----------------------------------------------------------------------------- cube edges
def face_pairs(spark) -> DataFrame:
    """The twelve unordered pairs of faces that share an edge."""
    p = spark.range(0, 36, 1, 1).select((F.floor(F.col("id") / 6)).cast("int").alias("f"),
                                        F.pmod("id", F.lit(6)).cast("int").alias("g"))
    dot = sum((g.face_axis("f", g.NORMAL, k) * g.face_axis("g", g.NORMAL, k) for k in range(3)), F.lit(0.0))
    return p.where((F.col("f") < F.col("g")) & (dot == 0))


def edge_report(field: DataFrame, n: int, count: int = 256, value: str = "v") -> DataFrame:
    """Gradient RMS across each cube edge against the interiors next to it."""
    a = [g.face_axis("f", g.NORMAL, k) for k in range(3)]
    b = [g.face_axis("g", g.NORMAL, k) for k in range(3)]
    p = face_pairs(field.sparkSession)
    p = p.withColumns({**{f"m{k}": a[k] + b[k] for k in range(3)},
                       **{f"t{k}": (a[k] - b[k]) / F.lit(math.sqrt(2)) for k in range(3)},
                       "l0": a[1] * b[2] - a[2] * b[1], "l1": a[2] * b[0] - a[0] * b[2],
                       "l2": a[0] * b[1] - a[1] * b[0]})
    p = p.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    s = F.lit(-0.9) + F.col("point") * F.lit(1.8 / (count - 1))
    p = p.withColumns({f"r{k}": F.col(f"m{k}") + s * F.col(f"l{k}") for k in range(3)})
    p = p.withColumn("__n", F.sqrt(sum((F.col(f"r{k}") ** 2 for k in range(3)), F.lit(0.0))))
    p = p.withColumns({f"q{k}": F.col(f"r{k}") / F.col("__n") for k in range(3)})
    # (difference, angle in steps of 1/n, sign): the edge itself and one interior on each side.
    stops = [("edge", 1, 1), ("edge", -1, -1), ("inner", 5, 1), ("inner", 3, -1),
             ("outer", -3, 1), ("outer", -5, -1)]
    p = p.withColumn("__s", F.explode(F.array(*[F.struct(
        F.lit(part).alias("part"), F.lit(k / n).alias("angle"), F.lit(float(sign)).alias("sign"))
        for part, k, sign in stops])))
    p = p.select("f", "g", "point", *[f"q{k}" for k in range(3)], *[f"t{k}" for k in range(3)],
                 "__s.part", "__s.angle", "__s.sign")
    p = _step(p, ("q0", "q1", "q2"), ("t0", "t1", "t2"), "angle").select(
        "f", "g", "point", "part", "sign", *g.VEC)
    v = sampling.sample_cube(p, field.select(*sampling.CUBE_KEY, value), n, prune=True)
    d = v.groupBy("f", "g", "part", "point").agg(F.sum(F.col("sign") * F.col(value)).alias("d"))
    edge = F.when(F.col("part") == "edge", F.col("d") * F.col("d"))
    near = F.when(F.col("part") != "edge", F.col("d") * F.col("d"))
    out = d.groupBy(F.col("f").alias("face_a"), F.col("g").alias("face_b")).agg(
        F.sqrt(F.avg(edge)).alias("edge_rms"), F.sqrt(F.avg(near)).alias("nearby_rms"))
    return out.withColumn("ratio", F.col("edge_rms") / F.greatest(F.col("nearby_rms"), F.lit(EPS)))


def shared_node_error(field: DataFrame, n: int, value: str = "v") -> DataFrame:
    """Largest disagreement between aliases of one physical node and its first owner."""
    kx, ky, kz = g.node_key("face", "y", "x", n)
    edge = field.where(g.on_face_boundary("y", "x", n))
    v, owner = F.col(value), F.min_by(value, F.expr(f"(face * {n + 1}L + y) * {n + 1}L + x"))
    nodes = edge.groupBy(kx, ky, kz).agg(F.max(v).alias("hi"), F.min(v).alias("lo"), owner.alias("o"))
    return nodes.agg(F.max(F.greatest(F.col("hi") - F.col("o"), F.col("o") - F.col("lo")))
                     .alias("shared_node_error"))


# ----------------------------------------------------------------------------- state report
def _probes(spark, h: int) -> DataFrame:
    """Places along the date line, at the poles and near them, as node coordinates."""
    eps = 1e-6
    line = F.array(*[F.struct(F.lit(part).alias("part"), F.lit(kind).alias("kind"),
                              F.lit(c).alias("c"), F.lit(sign).alias("sign"))
                     for part, kind, c, sign in (
                         ("seam", "col", 0.0, 1.0), ("seam", "col", 2.0 * h, -1.0),
                         ("crossing", "col", -eps, 1.0), ("crossing", "col", eps, -1.0),
                         ("pole_n", "row", 0.0, 1.0), ("pole_s", "row", float(h), 1.0),
                         ("cap_n", "row", eps, 1.0), ("cap_s", "row", h - eps, 1.0),
                         ("far_n", "row", eps * 100, 1.0), ("far_s", "row", h - eps * 100, 1.0))])
    p = spark.range(0, 129, 1, 1).select(F.col("id").alias("i"), F.explode(line).alias("__l"))
    p = p.select("i", "__l.*")
    along = F.col("i") / F.lit(128.0)
    return p.withColumns({"ny": F.when(F.col("kind") == "col", along * h).otherwise(F.col("c")),
                          "nx": F.when(F.col("kind") == "col", F.col("c")).otherwise(along * (2 * h))})


def _probe_parts(s: DataFrame, value: str) -> list[DataFrame]:
    d = s.where(F.col("kind") == "col").groupBy("part", "i").agg(
        F.abs(F.sum(F.col("sign") * F.col(value))).alias("d"))
    gaps = d.agg(F.max(F.when(F.col("part") == "seam", F.col("d"))).alias("dateline_error"),
                 F.max(F.when(F.col("part") == "crossing", F.col("d"))).alias("dateline_gap"))
    spread = s.where(F.col("kind") == "row").agg(*[
        (F.max(F.when(F.col("part") == k, F.col(value))) - F.min(F.when(F.col("part") == k, F.col(value))))
        .alias(k) for k in ("pole_n", "pole_s", "cap_n", "cap_s", "far_n", "far_s")])
    return [gaps, spread]


def _state_report(parts: list[DataFrame], h: int, checked: bool) -> DataFrame:
    report = _combine(parts)
    matches = F.col("checksum_matches") if checked else F.lit(True)
    report = report.withColumn("edge_ratio", F.col("seam_edge_rms")
                               / F.greatest(F.col("ordinary_edge_rms"), F.lit(EPS)))
    passed = ((F.col("not_finite") == 0) & (F.col("nodes") == (h + 1) * 2 * h)
              & (F.col("dateline_error") < 1e-8) & (F.greatest("pole_n", "pole_s") < 1e-8) & matches
              & (F.col("cap_n") <= F.col("far_n") * 0.011 + 1e-5)
              & (F.col("cap_s") <= F.col("far_s") * 0.011 + 1e-5))
    return report.withColumns({
        "passed": passed, "seam_outlier": F.col("edge_ratio") > 5,
        "phase_warning": F.greatest("row_phase_ratio", "column_phase_ratio") > 1.15})


def verify_stored(stored: BlockStore, expected_root: str | None = None, value: str = "v") -> DataFrame:
    """The same report, and directions near the poles, of a longitude/latitude field in blocks.

    Seam, belt, phases, range, content and checksum come from one scan of the blocks; probes and rings read the few blocks
    under them.  The checksum holds if no block differs from its digest, the digests give the root of the manifest, and that
    is ``expected_root``, if given.
    """
    spark, h = stored.spark, stored.lattice.size
    lines = stage(blocks.line_sums(stored, value), "lines")
    belt = (F.col("axis") == "row") & F.col("line").between(max(1, h // 8), h - h // 8 - 1)
    sound = expected_root in (None, stored.info["root"]) and stored.wrong_digests().isEmpty()
    whole = lines.agg(
        F.sqrt(F.sum(F.when(belt, F.col("seam"))) / F.count_if(belt)).alias("seam_edge_rms"),
        F.sqrt(F.sum(F.when(belt, F.col("squares"))) / F.sum(F.when(belt, F.col("steps")))).alias("ordinary_edge_rms"),
        F.sum("nodes").alias("nodes"), F.sum("bad").alias("not_finite"), F.min("low").alias("low"), F.max("high").alias("high"),
        (F.lit(sound) & (F.sum("damaged") == 0)).alias("checksum_matches"))
    trim = F.when(F.col("axis") == "row", F.col("line").between((h + 1) // 8, h + 1 - (h + 1) // 8 - 1)).otherwise(
        F.col("line").between(2 * h // 8, 2 * h - 2 * h // 8 - 1))
    phases = lines.where(trim).groupBy("axis", (F.col("line") % 8).alias("phase")).agg(F.avg(F.sqrt(F.col("squares") / F.col("steps"))).alias("rms"))
    probes = _probes(spark, h).select(F.lit("probe").alias("of"), "i", "part", "kind", "sign", "ny", "nx")
    rings = anisotropy_points(spark, h).select(F.lit("ring").alias("of"), "latitude_degrees", "axis", "point", "sign", "ny", "nx")
    s = stage(blocks.sample_lonlat(probes.unionByName(rings, allowMissingColumns=True), stored, check=False), "probes")
    polar = _anisotropy(s.where("of = 'ring'"), value).agg(
        F.min("direction_ratio").alias("polar_ratio_low"), F.max("direction_ratio").alias("polar_ratio_high"))
    return _state_report([whole, _phase_ratios(phases), polar, *_probe_parts(s.where("of = 'probe'"), value)], h, True)


def verify_state(field: DataFrame, h: int, expected: dict | None = None, value: str = "v") -> DataFrame:
    """One-row integrity report of a global node field.

    Probe points, seam, ordinary edges, phase profile and content each reduce to one row on
    their own; the rows are then merged by a union.
    """
    spark, field = field.sparkSession, field.select("y", "x", value)
    probes = _probe_parts(sampling.sample_lonlat(_probes(spark, h), field, h, prune=True), value)
    y0, y1 = max(1, h // 8), h - h // 8 - 1
    belt = field.where(F.col("y").between(y0, y1))
    ends = belt.where(F.col("x").isin(0, 2 * h - 1)).groupBy("y").agg(
        F.sum(F.when(F.col("x") == 0, F.col(value)).otherwise(-F.col(value))).alias("d"))
    seam = ends.agg(_rms("d").alias("seam_edge_rms"))
    inner = differences(belt, ["y"], "x", value, 0, 2 * h - 1).agg(_rms("d").alias("ordinary_edge_rms"))
    content = field.agg(F.count(F.lit(1)).alias("nodes"), F.count_if(_not_finite(value)).alias("not_finite"),
                        F.min(value).alias("low"), F.max(value).alias("high"))
    phase = grid_phase_report(field, h + 1, 2 * h, value=value)
    parts = [*probes, seam, inner, content, phase]
    if expected is not None:
        parts.append(content_checksum(field, ["y", "x"]).select(
            ((F.col("hash_sum") == expected["hash_sum"]) & (F.col("hash_xor") == expected["hash_xor"]))
            .alias("checksum_matches")))
    return _state_report(parts, h, expected is not None)


def verify_region(grid: DataFrame, keys: Sequence[str], expected: dict, value: str = "v") -> DataFrame:
    """Short integrity report of a regional grid: finite values and intact content."""
    finite = grid.agg((F.count_if(_not_finite(value)) == 0).alias("finite"))
    both = _combine([finite, content_checksum(grid, keys)])
    same = ((F.col("hash_sum") == expected["hash_sum"]) & (F.col("hash_xor") == expected["hash_xor"]))
    return both.select("finite", same.alias("checksum_matches"), (F.col("finite") & same).alias("passed"))


# ----------------------------------------------------------------------------- comparisons
def _pairs(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Both sides by key; a key that only one side has is an error."""
    both = left.withColumn("__l", F.lit(True)).join(right.withColumn("__r", F.lit(True)), list(keys), "full_outer")
    alone = F.raise_error(F.lit("the compared tables do not hold the same keys")).cast("boolean")
    matched = F.when(F.col("__l") & F.col("__r"), F.lit(True)).otherwise(alone)
    return both.where(matched).drop("__l", "__r")


def land_metrics(actual: DataFrame, expected: DataFrame, h: int, value: str = "v") -> DataFrame:
    """Area-weighted land and elevation scores of one node field against another."""
    key = ["y", "x"]
    both = _pairs(actual.select(*key, F.col(value).alias("a")), expected.select(*key, F.col(value).alias("e")), key)
    both = both.where(F.col("y") < h).withColumn("w", g.latitude_weight_nodes("y", h))
    w, land, want = F.col("w"), F.col("a") > 0, F.col("e") > 0

    def area(mask):
        return F.sum(F.when(mask, w).otherwise(F.lit(0.0)))
    d = F.col("a") - F.col("e")
    sums = both.agg(F.sum("w").alias("total"), area(land).alias("land"), area(want).alias("want"),
                    area(land & want).alias("inter"), area(land | want).alias("union"),
                    area(land == want).alias("agree"), F.sum(w * d * d).alias("dd"),
                    F.sum(w * F.col("a")).alias("s1"), F.sum(w * F.col("a") * F.col("a")).alias("s2"),
                    F.min("a").alias("low"), F.max("a").alias("high"))
    t = F.col("total")
    mean = F.col("s1") / t
    return sums.select(
        (F.col("land") / t).alias("land_fraction"), (F.col("want") / t).alias("guide_land_fraction"),
        (F.col("inter") / F.greatest(F.col("union"), F.lit(EPS))).alias("land_iou"),
        (F.col("agree") / t).alias("agreement"), F.sqrt(F.col("dd") / t).alias("rmse"),
        mean.alias("mean_elevation"),
        F.sqrt(F.greatest(F.col("s2") / t - mean * mean, F.lit(0.0))).alias("std_elevation"), "low", "high")


def layout_compare(values: DataFrame, painted: DataFrame, h: int, factor: int, white: float) -> DataFrame:
    """Generated pixels against a painted map that is ``factor`` times finer.

    ``values(row_i, col_i, v)`` has ``h`` rows; ``painted(row_i, col_i, code)`` holds 8-bit grey.
    A coarse pixel is painted land when at least half of its block is.
    """
    block = painted.groupBy(F.floor(F.col("row_i") / F.lit(factor)).cast("int").alias("row_i"),
                            F.floor(F.col("col_i") / F.lit(factor)).cast("int").alias("col_i")).agg(
        F.avg(F.when(F.col("code") > 0, 1.0).otherwise(0.0)).alias("share"),
        (F.avg("code") * F.lit(white / 255.0)).alias("height"))
    j = _pairs(values, block, ["row_i", "col_i"]).withColumns(
        {"want": F.col("share") >= 0.5, "w": g.latitude_weight_pixels("row_i", h)})
    w, land, want, v = F.col("w"), F.col("v") > 0, F.col("want"), F.col("v")

    def area(mask):
        return F.sum(F.when(mask, w).otherwise(F.lit(0.0)))
    floor = F.lit(EPS)
    s = j.agg(area(land & want).alias("inter"), area(land | want).alias("union"),
              area(land == want).alias("agree"), F.sum("w").alias("total"), area(want).alias("want"),
              area(~want).alias("sea"), area((v < 0) & ~want).alias("below"),
              F.try_divide(F.covar_pop(F.when(want, v), F.when(want, F.col("height"))),
                           F.stddev_pop(F.when(want, v)) * F.stddev_pop(F.when(want, F.col("height"))))
              .alias("land_height_correlation"),  # NULL where either side is constant
              F.min("v").alias("low"), F.max("v").alias("high"),
              F.min(F.when(~want, v)).alias("ocean_low"), F.max(F.when(~want, v)).alias("ocean_high"),
              F.stddev_pop(F.when(~want, v)).alias("ocean_std"))
    return s.select((F.col("inter") / F.greatest("union", floor)).alias("land_iou"),
                    (F.col("agree") / F.col("total")).alias("agreement"),
                    (F.col("inter") / F.greatest("want", floor)).alias("painted_land_kept"),
                    (F.col("below") / F.greatest("sea", floor)).alias("painted_ocean_below_sea"),
                    "land_height_correlation", "low", "high", "ocean_low", "ocean_high", "ocean_std")


def field_error(actual: DataFrame, expected: DataFrame, keys: Sequence[str], value: str = "v") -> DataFrame:
    """RMSE, largest error and RMSE relative to the expected field."""
    both = _pairs(actual.select(*keys, F.col(value).alias("a")), expected.select(*keys, F.col(value).alias("e")), keys)
    d = F.col("a") - F.col("e")
    s = both.agg(_rms(d).alias("rmse"), F.max(F.abs(d)).alias("max_absolute"), _rms("e").alias("__e"))
    return s.select("rmse", "max_absolute",
                    (F.col("rmse") / F.greatest(F.col("__e"), F.lit(EPS))).alias("relative_rmse"))


def within_tolerance(actual: DataFrame, expected: DataFrame, keys: Sequence[str], value: str = "v",
                     relative: float = 1e-5, absolute: float = 1e-8) -> DataFrame:
    """How many values there are, and how many lie within ``absolute + relative * |expected|``.

    Values that are not finite agree with nothing; keys of one side only are an error.
    """
    both = _pairs(actual.select(*keys, F.col(value).alias("a")), expected.select(*keys, F.col(value).alias("e")), keys)
    near = F.abs(F.col("a") - F.col("e")) <= F.lit(absolute) + F.lit(relative) * F.abs("e")
    good = ~_not_finite("a") & ~_not_finite("e") & near
    return both.agg(F.count(F.lit(1)).alias("values"), F.count_if(good).alias("within"))


def tile_boundary_ratio(field: DataFrame, n: int, stride: int, value: str = "v") -> DataFrame:
    """Jump RMS at tile boundaries against jumps eight nodes to either side, both axes."""
    parts = []
    for axis, other in (("x", "y"), ("y", "x")):
        d = differences(field.select(*sampling.CUBE_KEY, value), ["face", other], axis, value, 0, n)
        parts.append(d.select(F.col(axis).alias("i"), "d"))
    d = parts[0].unionByName(parts[1])

    def at(offset):
        i = F.col("i") - F.lit(offset)
        return (F.pmod(i, F.lit(stride)) == 0) & (i >= stride) & (i < n - 8)
    dd = F.col("d") * F.col("d")
    near_n = at(8).cast("int") + at(-8).cast("int")
    s = d.agg(F.avg(F.when(at(0), dd)).alias("b"), F.sum(dd * near_n).alias("s"), F.sum(near_n).alias("c"))
    near = F.sqrt(F.col("s") / F.nullif("c", F.lit(0)))
    return s.select(F.lit(stride).alias("stride"), F.sqrt("b").alias("boundary_rms"), near.alias("nearby_rms"),
                    (F.sqrt("b") / F.greatest(near, F.lit(EPS))).alias("ratio"))


def residual_stats(field: DataFrame, n: int, value: str = "v") -> DataFrame:
    """Spread, neighbour RMS along x and range of a cube field."""
    d = differences(field.select(*sampling.CUBE_KEY, value), ["face", "y"], "x", value, 0, n)
    s = field.agg(F.stddev_pop(value).alias("std"), F.min(value).alias("low"), F.max(value).alias("high"))
    return _combine([s, d.agg(_rms("d").alias("neighbour_rms"))])


def row_spread(field: DataFrame, value: str = "v") -> DataFrame:
    """Largest minus smallest value of every row (zero on a shared pole)."""
    return field.groupBy("y").agg((F.max(value) - F.min(value)).alias("spread"))


def field_extremes(field: DataFrame, keys: Sequence[str], value: str = "v") -> DataFrame:
    """Smallest and largest value with their places; equal values resolve to the first place."""
    place = F.struct(*keys)
    low = F.min(F.struct(F.col(value).alias("v"), place.alias("p")))
    high = F.max(F.struct(F.col(value).alias("v"), F.struct(*[(-F.col(k)).alias(k) for k in keys]).alias("p")))
    s = field.agg(low.alias("l"), high.alias("h"))
    return s.select(F.col("l.v").alias("low"), *[F.col(f"l.p.{k}").alias(f"low_{k}") for k in keys],
                    F.col("h.v").alias("high"), *[(-F.col(f"h.p.{k}")).alias(f"high_{k}") for k in keys])


def ocean_audit(field: DataFrame, h: int, value: str = "v") -> DataFrame:
    """Underwater nodes: count, share of area, depth range, and RMS of neighbour differences."""
    v, w = F.col(value), g.latitude_weight_nodes("y", h)
    d = differences(field.select("y", "x", value), ["y"], "x", value, 0, 2 * h - 1)
    wet_pair = (v < 0) & (v - F.col("d") < 0)
    rms = d.agg(F.sqrt(F.avg(F.when(wet_pair, F.col("d") * F.col("d")))).alias("neighbour_rms"))
    s = field.agg(F.count_if(v < 0).alias("underwater"),
                  (F.sum(F.when(v < 0, w).otherwise(0.0)) / F.sum(w)).alias("area_share"),
                  F.min(F.when(v < 0, v)).alias("deepest"), F.max(F.when(v < 0, v)).alias("shallowest"),
                  F.count_if(v == 0).alias("exactly_zero"))
    return _combine([s, rms])


def same_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of either side without an equal partner on the other; empty when both are equal.

    Both sides are staged.  Sums of two 64-bit hashes by bucket tell where they differ, so a task's state is bounded by
    ``BUCKETS``; only rows of unequal buckets are exchanged and counted.  Halves of a hash are summed apart, which cannot
    overflow below 2^31 rows of a bucket.
    """
    columns = left.columns
    a = left.withColumn("__side", F.lit(1))
    b = right.select(*columns).withColumn("__side", F.lit(-1))
    both = stage(a.unionByName(b), "sides")
    first, second = F.xxhash64(*columns), F.xxhash64(*columns, F.lit(1))
    bucket = F.pmod(first, F.lit(BUCKETS)).cast("int").alias("__bucket")
    halves = [half for h in (first, second) for half in (F.shiftright(h, 32), h.bitwiseAND(F.lit(0xFFFFFFFF)))]
    sums = both.groupBy(bucket).agg(F.sum("__side").alias("__n"), *[
        F.sum(half * F.col("__side")).alias(f"__h{k}") for k, half in enumerate(halves)])
    unequal = sums.where((F.col("__n") != 0) | (F.greatest(*[F.abs(f"__h{k}") for k in range(4)]) > 0)).select("__bucket")
    rows = both.select("*", bucket).join(F.broadcast(unequal), "__bucket", "left_semi")
    return (rows.groupBy(*columns).agg(F.sum("__side").alias("surplus"))
            .where(F.col("surplus") != 0))
