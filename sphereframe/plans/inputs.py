"""Sphere inputs derived from the driver tables.

Lattice sizes follow the row counts, so every input grows with its table while each lattice cell
keeps about the same number of source rows.  Means are exact integer sums divided once,
by multiples of a prime, so that results do not sit on decimal ties when they are rounded.
"""
from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from math import floor, sqrt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import sampling


@dataclass(frozen=True)
class Sizes:
    h: int        # latitude intervals of the node field
    n: int        # intervals per cube face
    pixel_h: int  # rows of the pixel raster
    origins: int  # tile origins per axis

    @property
    def tile_n(self) -> int:
        return 4 * (self.origins - 2)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _versions(spark, sf_dir) -> tuple[int, ...]:
    """When the counted tables were last written."""
    out = []
    for t in ("lineitem", "orders", "embeddings"):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{t}.parquet")
        out.append(path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).getModificationTime())
    return tuple(out)


@lru_cache(maxsize=32)
def _sizes(spark, sf_dir, versions) -> Sizes:
    items, orders, vectors = (table(spark, sf_dir, t).count()  # answered from Parquet footers
                              for t in ("lineitem", "orders", "embeddings"))
    return Sizes(h=16 * max(1, floor(sqrt(items / 15000))), n=4 * max(1, floor(sqrt(items / 210) / 4)),
                 pixel_h=16 * max(1, floor(sqrt(orders / 3750))), origins=max(2, floor(sqrt(vectors / 6))))


def sizes(spark: SparkSession, sf_dir: str) -> Sizes:
    return _sizes(spark, sf_dir, _versions(spark, sf_dir))


def _mod(c, by):
    return F.pmod(c, F.lit(by)).cast("int")


def points(spark, sf_dir) -> DataFrame:
    """Scattered places with a value; the 0.003 keeps them off face ties and lattice nodes."""
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        i.alias("point_id"),
        (F.lit(-180.0) + F.pmod(i * 7919, F.lit(36000)) / F.lit(100.0) + F.lit(3e-3)).alias("lon"),
        (F.lit(-90.0) + F.pmod(i * 104729, F.lit(18000)) / F.lit(100.0) + F.lit(3e-3)).alias("lat"),
        "value")


def _cents(column):
    return F.round(F.col(column) * 100).cast("bigint")


def node_field(spark, sf_dir) -> DataFrame:
    """Node field of mixed sign with shared poles."""
    h = sizes(spark, sf_dir).h
    cells = table(spark, sf_dir, "lineitem").select(
        _mod(F.col("l_partkey"), h + 1).alias("y"),
        _mod(F.col("l_suppkey") * 31 + F.col("l_linenumber") + F.col("l_orderkey"), 2 * h).alias("x"),
        (_cents("l_extendedprice") - 4000000).alias("cents"))
    pole = F.col("y").isin(0, h)
    sums = cells.groupBy("y", F.when(pole, F.lit(0)).otherwise(F.col("x")).alias("x")).agg(
        F.sum("cents").alias("s"), F.count(F.lit(1)).alias("c"))
    columns = F.when(pole, F.sequence(F.lit(0), F.lit(2 * h - 1))).otherwise(F.array("x"))
    return sums.select("y", F.explode(columns).alias("x"), (F.col("s") / (F.col("c") * F.lit(1007.0))).alias("v"))


def climate_nodes(spark, sf_dir) -> DataFrame:
    """Five physical channels on the node lattice."""
    h = sizes(spark, sf_dir).h
    c = table(spark, sf_dir, "lineitem").select(
        _mod(F.col("l_partkey"), h + 1).alias("y"),
        _mod(F.col("l_suppkey") * 31 + F.col("l_linenumber") + F.col("l_orderkey"), 2 * h).alias("x"),
        *_climate_parts())
    return c.groupBy("y", "x").agg(*_climate_means())


def _climate_parts():
    return [(_cents("l_extendedprice") - 4000000).alias("cents"), F.round("l_quantity").cast("bigint").alias("qty"),
            F.round(F.col("l_discount") * 100).cast("bigint").alias("disc"),
            F.round(F.col("l_tax") * 100).cast("bigint").alias("tax"), F.col("l_linenumber").cast("bigint").alias("ln")]


def _climate_means():
    c = F.count(F.lit(1))
    return [(F.sum("cents") / (c * F.lit(1007.0))).alias("elev"),
            (F.lit(30.0) - F.sum("qty") / (c * F.lit(5.0))).alias("temp"),
            (F.lit(300.0) + F.sum("disc") * F.lit(10.0) / c).alias("temp_std100"),
            (F.lit(400.0) + F.sum("tax") * F.lit(200.0) / c).alias("precip"),
            (F.lit(40.0) + F.sum("ln") / (c * F.lit(1.0))).alias("precip_cv")]


def _cube_cells(spark, sf_dir, *parts) -> DataFrame:
    n = sizes(spark, sf_dir).n
    side = n + 1
    cell = F.pmod(F.col("l_orderkey") * 31 + F.col("l_partkey") * 7 + F.col("l_suppkey") * 13
                  + F.col("l_linenumber"), F.lit(6 * side * side))
    c = table(spark, sf_dir, "lineitem").select(cell.alias("cell"), *parts)
    return c.withColumns({"face": F.floor(F.col("cell") / F.lit(side * side)).cast("int"),
                          "y": _mod(F.floor(F.col("cell") / F.lit(side)), side), "x": _mod(F.col("cell"), side)})


def cube_raw(spark, sf_dir) -> DataFrame:
    """Cube field whose aliases still disagree."""
    cells = _cube_cells(spark, sf_dir, (_cents("l_extendedprice") - 4000000).alias("cents"))
    return cells.groupBy("face", "y", "x").agg(
        (F.sum("cents") / (F.count(F.lit(1)) * F.lit(1007.0))).alias("v"))


def cube_field(spark, sf_dir) -> DataFrame:
    return sampling.identify(cube_raw(spark, sf_dir), sizes(spark, sf_dir).n)


def cube_climate(spark, sf_dir) -> DataFrame:
    """Coarse climate channels on the cube, elevation as signed root, aliases identified."""
    means = _cube_cells(spark, sf_dir, *_climate_parts()).groupBy("face", "y", "x").agg(*_climate_means())
    z = means.withColumn("z", g.signed_sqrt("elev")).select(
        "face", "y", "x", "z", "temp", "temp_std100", "precip", "precip_cv")
    return sampling.identify(z, sizes(spark, sf_dir).n)


def _pixel_groups(spark, sf_dir, *aggs) -> DataFrame:
    h = sizes(spark, sf_dir).pixel_h
    px = table(spark, sf_dir, "orders").select(
        _mod(F.col("o_orderkey"), h).alias("row_i"),
        _mod(F.col("o_custkey") * 7 + F.floor(F.col("o_orderkey") / F.lit(h)), 2 * h).alias("col_i"),
        _cents("o_totalprice").alias("cents"), (F.col("o_orderstatus") == "P").cast("int").alias("open"))
    return px.groupBy("row_i", "col_i").agg(
        F.sum("cents").alias("s"), F.count(F.lit(1)).alias("c"), F.sum("open").alias("open"), *aggs)


def pixels(spark, sf_dir) -> DataFrame:
    """Global raster; pixels without a pending order are nodata, and some are absent."""
    v = F.when(F.col("open") > 0, F.col("s") / (F.col("c") * F.lit(5003.0)) - F.lit(4000.0))
    return _pixel_groups(spark, sf_dir).select(F.lit("heightmap").alias("band"), "row_i", "col_i", v.alias("v"))


def brightness_pixels(spark, sf_dir) -> DataFrame:
    bits = F.when(F.col("c") % 2 == 0, F.lit(16)).otherwise(F.lit(8))
    code = F.when(F.col("c") % 2 == 0, F.col("s") % 65536).otherwise(F.col("s") % 256)
    return _pixel_groups(spark, sf_dir).select(
        "row_i", "col_i", code.cast("int").alias("code"), bits.alias("bits"),
        F.when(F.col("open") > 0, F.lit(1.0)).otherwise(F.lit(0.0)).alias("alpha"))


def tiles(spark, sf_dir) -> DataFrame:
    """Overlapping 8 x 8 tiles, stride 4; every vector is a tile, later ones repeat origins."""
    p = sizes(spark, sf_dir).origins
    slot = F.pmod(F.floor(F.col("vec_id") / F.lit(6)), F.lit(p * p))
    return table(spark, sf_dir, "embeddings").select(
        _mod(F.col("vec_id"), 6).alias("face"),
        (F.lit(-4) + F.lit(4) * F.floor(slot / F.lit(p))).cast("int").alias("ty"),
        (F.lit(-4) + F.lit(4) * F.pmod(slot, F.lit(p))).cast("int").alias("tx"),
        F.col("embedding").alias("values"), "vec_id", "label")


def requests_from(events: DataFrame) -> DataFrame:
    """Region requests, one in ten with south above north, some across the date line."""
    i = F.col("event_id")
    a, b = F.pmod(i * 137, F.lit(360)).cast("double"), F.pmod(i * 53, F.lit(171)).cast("double")
    west, south = F.lit(-180.0) + a, F.lit(-90.0) + b
    return events.select(
        i.alias("request_id"), F.col("ts").cast("timestamp").alias("ts"), west.alias("west"), south.alias("south"),
        F.when(a > 340, west - F.lit(340.0)).otherwise(west + F.lit(20.0)).alias("east"),
        (south + F.when(F.pmod(i, F.lit(10)) == 9, F.lit(-10.0)).otherwise(F.lit(10.0))).alias("north"),
        F.lit(4).alias("width"), F.lit(2).alias("height"))


def requests(spark, sf_dir) -> DataFrame:
    return requests_from(table(spark, sf_dir, "events"))
