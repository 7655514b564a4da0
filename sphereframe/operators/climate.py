"""Local lapse-rate regression and climate features."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import climate_math as cm
from ..functions import geometry as g
from ..sources.blocks import BlockStore, Lattice, open_blocks, write_blocks
from ..sources.store import cut_lineage
from . import sampling
from .filters import BLOCK, _own_block, _with_blocks

FEATURES = ["baseline", "temp_std100", "precip", "precip_cv", "beta"]


def local_baseline(grid: DataFrame, lines: Sequence[str], y_range: tuple[int, int],
                   x_range: tuple[int, int], *, temp="temp", elev="elev", win: int = 15,
                   block: int = BLOCK) -> DataFrame:
    """Land-weighted regression of temperature on elevation in a moving box.

    ``elev`` is metres above the sea with water at zero.  Outputs exist where the whole box lies
    inside the given index ranges.  Box sums are two one-dimensional frames, which carry the
    centre's own values along and so need no second join.
    """
    if win < 3 or win % 2 != 1:
        raise ValueError("the window must be odd and at least 3")
    land = F.when(F.col(elev) > 0, F.lit(1.0)).otherwise(F.lit(0.0))
    t, e = F.col(temp) * land, F.col(elev) * land
    moments = {"__l": land, "__t": t, "__e": e, "__ee": e * F.col(elev), "__et": t * F.col(elev)}
    p = grid.select(*lines, "y", "x", temp, elev, *[c.alias(k) for k, c in moments.items()])
    own = F.struct(F.col(temp).alias("t"), F.col(elev).alias("e")).alias("__own")
    p = p.select(*lines, "y", "x", own, *moments)
    p = _box(p, [*lines, "x"], "y", win, list(moments), y_range, block)
    p = _box(p, [*lines, "y"], "x", win, list(moments), x_range, block)
    area = F.lit(float(win * win))
    cover = F.col("__l") / area
    p = p.withColumn("__cover", cover)
    mean = {k: F.col(k) / area / (F.col("__cover") + F.lit(1e-6)) for k in ("__t", "__e", "__ee", "__et")}
    p = p.withColumns({f"{k}m": c for k, c in mean.items()})
    p = p.withColumn("__var", F.col("__eem") - F.col("__em") * F.col("__em"))
    slope = (F.col("__etm") - F.col("__em") * F.col("__tm")) / (F.col("__var") + F.lit(1e-6))
    slope = F.when((F.col("__var") < 1) | (F.col("__cover") < 0.02), F.lit(-0.0065)).otherwise(slope)
    p = p.withColumn("beta", g.clip(slope, -0.012, 0.0))
    return p.select(*lines, "y", "x", (F.col("__own.t") - F.col("beta") * F.col("__own.e")).alias("baseline"),
                    "beta")


def _box(p, line, axis, win, moments, bounds, block):
    """Box sums of the moments; the struct of own values rides along in the same window pass."""
    half, (low, high) = win // 2, bounds
    w = Window.partitionBy(*line, "__block").orderBy(axis).rowsBetween(-half, half)
    length = high - low + 1
    q = _with_blocks(p, axis, half, length, block).withColumns(
        {f"{m}s": F.sum(m).over(w) for m in moments})
    q = q.where(F.col(axis).between(low + half, high - half) & _own_block(axis, half, length, block))
    return q.select(*line, axis, "__own", *[F.col(f"{m}s").alias(m) for m in moments])


def climate_features(coarse: DataFrame, n: int, block: int = BLOCK) -> DataFrame:
    """Compact features of a coarse cube field.

    ``coarse`` has ``z`` (signed-root elevation), ``temp``, ``temp_std100``, ``precip`` and
    ``precip_cv`` columns.  The regression reads seven nodes across every face edge.
    """
    coarse = cut_lineage(coarse)  # read three times below
    haloed = sampling.with_halo(coarse.select(*sampling.CUBE_KEY, "z", "temp"), n, 7, materialise=False)
    grid = haloed.select(*sampling.CUBE_KEY, "temp",
                         F.pow(F.greatest(F.col("z"), F.lit(0.0)), F.lit(2.0)).alias("elev"))
    fit = local_baseline(grid, ["face"], (-7, n + 7), (-7, n + 7), block=block)
    both = coarse.select(*sampling.CUBE_KEY, "temp_std100", "precip", "precip_cv").join(
        fit, sampling.CUBE_KEY)
    out = sampling.identify(both.select(*sampling.CUBE_KEY, *FEATURES), n)
    return cm.describe_bands(out)


CLIMATE_VERSION = "sphere-climate-1"  # of the bands, their order and units


def write_climate(features: DataFrame, path: str, n: int, block: int = 64, kind: str = "float") -> BlockStore:
    """Save the five bands of a cube field in blocks, with their units and the version of their meaning."""
    if n < 2:
        raise ValueError("a climate field has two intervals a face at least")
    bands = cm.describe_bands(features.select(*sampling.CUBE_KEY, *cm.BAND_UNITS))
    return write_blocks(bands, path, Lattice("cube", n, block), {"climate": CLIMATE_VERSION}, kind)


def open_climate(spark, path: str) -> BlockStore:
    """Open saved bands; another version, other bands or other units are refused."""
    saved = open_blocks(spark, path)
    if "climate" not in saved.info:
        raise ValueError(f"{path} holds a field, but no climate")
    if saved.info["climate"] != CLIMATE_VERSION:
        raise ValueError(f"climate version {saved.info['climate']} is not {CLIMATE_VERSION}")
    units = {f.name: f.metadata.get("unit") for f in saved.values}
    if units != {band: unit for band, (_, unit) in cm.BAND_UNITS.items()} or saved.lattice.kind != "cube" or saved.lattice.size < 2:
        raise ValueError(f"{path} does not hold the five bands in their units")
    return saved


def climate_at(points: DataFrame, features: DataFrame, n: int, elevation: str,
               prune: bool = False) -> DataFrame:
    """Climate of points with ``lon, lat`` and an elevation column."""
    p = g.add_lonlat_direction(points)
    p = sampling.sample_cube(p, features, n, prune=prune)
    return cm.adjust_to_elevation(p, elevation).drop(*g.VEC)
