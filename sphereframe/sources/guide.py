"""Guide sources: anything that can give the five channels of a cube guide."""
from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import climate_math as cm
from ..functions import geometry as g
from ..operators import distribution, raster, sampling
from . import grids
from .store import CUBE_KEY, exists, cut_lineage

CHANNELS = cm.CHANNELS
PIXEL_SCHEMA = "row_i int, col_i int, v double"


class GuideSource(Protocol):
    """A source gives its guide on all cube nodes, or on requested nodes only."""

    def guide(self, n: int) -> DataFrame: ...

    def guide_nodes(self, nodes: DataFrame, n: int) -> DataFrame: ...


def read_channels(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Pixel tables of whichever of the five channels a folder holds."""
    found = {c: spark.read.schema(PIXEL_SCHEMA).parquet(f"{folder}/{c}.parquet").select(
        F.lit(c).alias("band"), "row_i", "col_i", "v")
        for c in CHANNELS if exists(spark, f"{folder}/{c}.parquet")}
    if not found:
        raise ValueError("no channel found; expected at least one of: " + ", ".join(CHANNELS))
    return found


def _lattice(channels: dict[str, DataFrame], h: int) -> DataFrame:
    """Corner means of several rasters of one resolution side by side."""
    out = None
    for c, pixels in channels.items():
        part = raster.premultiply(pixels.select("row_i", "col_i", "v"), band=c)
        part = raster.complete_lattice(raster.corner_mean(part, h), h).select(
            "y", "x", F.col("value").alias(f"{c}_value"), F.col("coverage").alias(f"{c}_coverage"))
        out = part if out is None else out.join(part, ["y", "x"])
    return out


def _with_aliases(nodes: DataFrame, n: int) -> DataFrame:
    """Every chart entry of the requested physical nodes, so that edges agree with the full guide."""
    kx, ky, kz = g.node_key("face", "y", "x", n)
    keys = nodes.select(kx.alias("kx"), ky.alias("ky"), kz.alias("kz")).distinct()
    return sampling.spread_to_aliases(keys, n)


@dataclass
class RasterGuide:
    """Imported rasters, ``{channel: (pixels, rows)}``, blended over a fallback of raw channels.

    ``fallback(nodes, n)`` gives the five raw channels for nodes with a direction.
    """
    channels: dict[str, tuple[DataFrame, int]]
    fallback: object = None
    seed: int = 0

    def __post_init__(self):
        for channel, (pixels, rows) in self.channels.items():
            raster.require_raster(pixels.withColumn("band", F.lit(channel)), rows)

    def _fallback(self, nodes: DataFrame, n: int) -> DataFrame:
        nodes = g.add_direction(nodes.select(*CUBE_KEY), n)
        if self.fallback is not None:
            return self.fallback(nodes, n)
        return distribution.guide_channels(nodes, self.seed).drop(*g.VEC)

    def guide(self, n: int) -> DataFrame:
        spark = next(iter(self.channels.values()))[0].sparkSession
        return self.guide_nodes(grids.cube_nodes(spark, n), n)

    def guide_nodes(self, nodes: DataFrame, n: int) -> DataFrame:
        every = _with_aliases(nodes, n)
        imported = {}
        for h in sorted({rows for _, rows in self.channels.values()}):
            same = {c: px for c, (px, rows) in self.channels.items() if rows == h}
            means = cut_lineage(sampling.identify(raster.footprint_mean(every, _lattice(same, h), h, n), n))
            for c in same:  # channels of one resolution share a footprint pass
                imported[c] = means.select(*CUBE_KEY, F.col(f"{c}_value").alias("value"),
                                           F.col(f"{c}_coverage").alias("coverage"))
        out = raster.build_guide(imported, self._fallback(every, n), n)
        return out.join(nodes.select(*CUBE_KEY).distinct(), CUBE_KEY, "left_semi")


@dataclass
class BrightnessGuide:
    """A painted grey map for elevation; the other channels come from the fallback."""
    pixels: DataFrame
    rows: int
    info: dict
    seed: int = 0

    def __post_init__(self):
        raster.require_brightness(self.pixels, self.rows)

    def _fallback(self, nodes: DataFrame, n: int) -> DataFrame:
        d = g.add_direction(nodes.select(*CUBE_KEY), n)
        raw = distribution.guide_channels(d, self.seed).drop(*g.VEC)
        return raw.withColumn(CHANNELS[0], g.signed_sqrt(CHANNELS[0]))

    def guide(self, n: int) -> DataFrame:
        return self.guide_nodes(grids.cube_nodes(self.pixels.sparkSession, n), n)

    def guide_nodes(self, nodes: DataFrame, n: int) -> DataFrame:
        every = _with_aliases(nodes, n)
        lattice = raster.complete_lattice(raster.corner_mean(
            raster.draft_pixels(self.pixels, self.info).drop("land"), self.rows), self.rows)
        imported = sampling.identify(raster.footprint_mean(every, lattice, self.rows, n), n)
        out = raster.fill(imported, self._fallback(every, n), n, CHANNELS[0], space="metres")
        return out.join(nodes.select(*CUBE_KEY).distinct(), CUBE_KEY, "left_semi")
