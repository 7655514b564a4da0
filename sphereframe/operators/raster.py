"""Imported pixel rasters: contract checks, corner means, area footprints and gap filling."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import climate_math as cm
from ..functions import geometry as g
from ..sources import grids
from . import sampling

FLOAT32_QUARTER = 3.4028234663852886e38 / 4


def valid_value(value) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))


def brightness(code="code", bits="bits") -> Column:
    """Grey level 0..1 of an 8-bit or 16-bit code."""
    return F.when(F.col(bits) == 16, F.col(code) / F.lit(65535.0)).otherwise(F.col(code) / F.lit(255.0))


def grey_to_metres(grey, black, white, mapping: str = "linear-v1") -> Column:
    """Elevation of a grey level; the older mapping has a fixed depth for exact black."""
    grey = F.col(grey) if isinstance(grey, str) else grey
    if mapping == "linear-v1":
        return F.lit(black) + F.lit(white - black) * grey
    return F.when(grey == 0, F.lit(black)).otherwise(F.lit(white) * grey)


def check_draft_parameters(black: float, white: float, refinement: float) -> None:
    if not white > black:
        raise ValueError("white elevation must be above black elevation")
    if not 0.01 <= refinement <= 4:
        raise ValueError("refinement must be between 0.01 and 4")


def draft_pixels(pixels: DataFrame, info: dict) -> DataFrame:
    """Brightness pixels as metres, premultiplied by coverage; ``info`` holds saved settings."""
    mapping = info.get("mapping_version", "legacy")
    if mapping == "linear-v1":
        black = info["black_metres"]
    else:
        depth = info.get("ocean_depth_hint_metres", 0.0)
        black = -(depth if depth > 0 else 2000.0)
    check_draft_parameters(black, info["white_metres"], info.get("refinement", 0.2))
    grey = brightness()
    metres = grey_to_metres(grey, float(black), float(info["white_metres"]), mapping)
    return pixels.select("row_i", "col_i", (metres * F.col("alpha")).alias("value"),
                         F.col("alpha").alias("coverage"),
                         (F.when(grey > 0, F.col("alpha")).otherwise(F.lit(0.0))).alias("land"))


def converted(scale: float = 1.0, offset: float = 0.0) -> Column:
    """Pixel values as the guide uses them: scaled, and spread of temperature in hundredths."""
    factor = F.when(F.col("band") == "temperature_std", F.lit(100.0)).otherwise(F.lit(1.0))
    return (F.col("v") * F.lit(float(scale)) + F.lit(float(offset))) * factor


def check_raster(pixels: DataFrame, h: int, scale: float = 1.0, offset: float = 0.0) -> DataFrame:
    """One row per band with the counts that decide whether a raster keeps its contract.

    Limits apply to converted values.  Pixels of one place are counted first, so ``duplicates`` is the
    number of rows too many.
    """
    pixels = pixels.withColumn("v", converted(scale, offset))
    ok = valid_value("v")
    index = F.when(F.col("band") == "heightmap", 0).when(F.col("band") == "temperature", 1).otherwise(2)
    places = pixels.groupBy("band", "row_i", "col_i").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(ok).alias("valid"),
        F.count_if(ok & (index == 2) & (F.col("v") < 0)).alias("negative"),
        F.count_if(ok & (F.abs("v") > FLOAT32_QUARTER)).alias("too_large"))
    return places.groupBy("band").agg(
        F.sum("rows").alias("pixels"), F.sum(F.col("rows") - 1).alias("duplicates"),
        F.sum(F.when(F.col("row_i").between(0, h - 1) & F.col("col_i").between(0, 2 * h - 1), 0)
              .otherwise(F.col("rows"))).alias("outside"),
        F.sum("negative").alias("negative"), F.sum("too_large").alias("too_large"), F.sum("valid").alias("valid"))


def require_raster(pixels: DataFrame, h: int, scale: float = 1.0, offset: float = 0.0) -> DataFrame:
    """Fail when a band breaks its contract; returns the pixels unchanged."""
    if h < 2:
        raise ValueError("a raster needs at least two rows")
    bad = check_raster(pixels, h, scale, offset).where(
        (F.col("outside") > 0) | (F.col("negative") > 0) | (F.col("too_large") > 0) | (F.col("duplicates") > 0))
    wrong = bad.collect()  # one row per band
    if wrong:
        raise ValueError("; ".join(f"{r.band}: {r.asDict()}" for r in wrong))
    return pixels


def require_brightness(pixels: DataFrame, rows: int) -> DataFrame:
    """Fail unless a painted map has two rows at least and lies within ``rows x 2 rows`` places, one pixel each."""
    if rows < 2:
        raise ValueError("a painted map needs at least two rows")
    inside = F.col("row_i").between(0, rows - 1) & F.col("col_i").between(0, 2 * rows - 1)
    found = pixels.groupBy("row_i", "col_i").agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.sum(F.when(inside, 0).otherwise(F.col("n"))), F.lit(0)).alias("outside"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"), F.max("row_i").alias("last"),
        F.max("col_i").alias("right")).first()
    if found.outside or found.duplicates or found.last != rows - 1 or found.right != 2 * rows - 1:
        raise ValueError(f"a painted map must be twice as wide as high, with one pixel for each place: {found.asDict()}")
    return pixels


def premultiply(pixels: DataFrame, scale: float = 1.0, offset: float = 0.0,
                band: str | None = None) -> DataFrame:
    """Values times validity, plus validity, so that later means stay linear.

    Missing pixels need no row: they add nothing to either sum.
    """
    factor = 100.0 if band == "temperature_std" else 1.0
    raw = F.col("v") * F.lit(scale) + F.lit(offset)
    ok = valid_value(raw)
    return pixels.select(*[c for c in pixels.columns if c not in ("v",)],
                         F.when(ok, raw * F.lit(factor)).otherwise(F.lit(0.0)).alias("value"),
                         F.when(ok, F.lit(1.0)).otherwise(F.lit(0.0)).alias("coverage"))


def corner_mean(pixels: DataFrame, h: int, extra: Sequence[str] = ()) -> DataFrame:
    """Node lattice from pixels: mean of the four touching pixels, poles from their whole row.

    Sums are divided by the full number of touching pixels, so absent pixels count as zero value
    and zero coverage.  The two poles are pre-aggregated per row and then written to all columns.
    """
    extra = list(extra)
    values = [c for c in pixels.columns if c not in ("row_i", "col_i", *extra)]
    w = 2 * h
    corners = F.array(*[F.struct((F.col("row_i") + dy).cast("int").alias("y"),
                                 F.pmod(F.col("col_i") + F.lit(dx), F.lit(w)).cast("int").alias("x"))
                        for dy in (0, 1) for dx in (0, 1)])
    e = pixels.select(*extra, F.explode(corners).alias("__c"), *values)
    # A pole is touched twice by each pixel of its row; a full row adds up to 2w.
    pole = F.col("__c.y").isin(0, h)
    sums = e.groupBy(*extra, F.col("__c.y").alias("y"),
                     F.when(pole, F.lit(0)).otherwise(F.col("__c.x")).alias("x")).agg(
        *[F.sum(v).alias(v) for v in values])
    at_pole = F.col("y").isin(0, h)
    count = F.when(at_pole, F.lit(2.0 * w)).otherwise(F.lit(4.0))
    columns = F.when(at_pole, F.sequence(F.lit(0), F.lit(w - 1))).otherwise(F.array(F.col("x")))
    return sums.select(*extra, "y", F.explode(columns).alias("x"),
                       *[(F.col(v) / count).alias(v) for v in values])


def complete_lattice(nodes: DataFrame, h: int) -> DataFrame:
    """Nodes that no pixel touched appear with zero value and coverage."""
    values = [c for c in nodes.columns if c not in ("y", "x")]
    return grids.lonlat_nodes(nodes.sparkSession, h).join(nodes, ["y", "x"], "left").select(
        "y", "x", *[F.coalesce(v, F.lit(0.0)).alias(v) for v in values])


def footprint_mean(nodes: DataFrame, raster: DataFrame, h: int, n: int,
                   samples: int = 8) -> DataFrame:
    """Area-weighted mean of a raster over the footprint of each given cube node.

    Every footprint is sampled on a ``samples x samples`` lattice.  A node's samples are made in one task, where those in
    one raster cell merge to four corner weights; only these are looked up and exchanged.
    """
    values = [c for c in raster.columns if c not in ("y", "x")]
    steps = F.array(*[F.lit((k + 0.5) / samples - 0.5) for k in range(samples)])
    tasks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    p = nodes.select("face", "y", "x").repartition(tasks, "face", "y", "x").withColumn("oy", F.explode(steps))
    p = p.withColumn("ox", F.explode(steps))
    p = p.withColumns({"sy": F.col("y") + F.col("oy"), "sx": F.col("x") + F.col("ox")})
    p = g.add_area_weight(p, n, "sy", "sx", "area")
    p = g.add_direction(p, n, "face", "sy", "sx", normalize=False)
    p = g.add_lonlat_node(p, h).select("face", "y", "x", "area", "ny", "nx")
    s = sampling.weighted_sums_lonlat(p, raster, h, sampling.CUBE_KEY, "area")
    return s.select("face", "y", "x", *[(F.col(v) / F.col("area")).alias(v) for v in values])


def raster_to_cube(raster: DataFrame, h: int, n: int, samples: int = 8) -> DataFrame:
    """Footprint means on all cube nodes, with shared nodes identified."""
    nodes = grids.cube_nodes(raster.sparkSession, n)
    return sampling.identify(footprint_mean(nodes, raster, h, n, samples), n)


def fill(imported: DataFrame, fallback: DataFrame, n: int, channel: str, *,
         space: str = "raw") -> DataFrame:
    """Imported value where covered, fallback elsewhere, mixed by coverage.

    ``raw`` blends physical values and encodes elevation afterwards; ``metres`` decodes the
    fallback elevation, blends, and encodes again.
    """
    key = sampling.CUBE_KEY
    both = fallback.join(imported.select(*key, "value", "coverage"), key, "left")
    value, cover = F.coalesce("value", F.lit(0.0)), F.coalesce("coverage", F.lit(0.0))
    if space == "raw":
        mixed = value + (F.lit(1.0) - g.clip(cover, 0.0, 1.0)) * F.col(channel)
        mixed = g.signed_sqrt(mixed) if channel == cm.CHANNELS[0] else mixed
    elif space == "metres":
        mixed = g.signed_sqrt(value + (F.lit(1.0) - cover) * g.signed_square(channel))
    else:
        raise ValueError("space must be 'raw' or 'metres'")
    out = both.withColumn(channel, mixed).select(*fallback.columns)
    return sampling.identify(out, n)


def build_guide(imported: dict[str, DataFrame], fallback: DataFrame, n: int) -> DataFrame:
    """Five-channel guide: every imported channel blended over the raw fallback, then encoded.

    ``imported`` maps a channel to its ``(face, y, x, value, coverage)`` table; missing channels
    keep the fallback.  Elevation is encoded once, after blending.
    """
    if not imported:
        raise ValueError("at least one channel must be imported")
    unknown = set(imported) - set(cm.CHANNELS)
    if unknown:
        raise ValueError(f"unknown channels: {sorted(unknown)}")
    key, guide = sampling.CUBE_KEY, fallback
    for channel, table in imported.items():
        t = table.select(*key, F.col("value").alias("__v"), F.col("coverage").alias("__c"))
        guide = guide.join(t, key, "left").withColumn(channel, F.coalesce("__v", F.lit(0.0)) + (
            F.lit(1.0) - g.clip(F.coalesce("__c", F.lit(0.0)), 0.0, 1.0)) * F.col(channel)).drop("__v", "__c")
    guide = guide.withColumn(cm.CHANNELS[0], g.signed_sqrt(cm.CHANNELS[0]))
    return sampling.identify(guide.select(*key, *[c for c in cm.CHANNELS if c in guide.columns]), n)
