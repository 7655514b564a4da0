"""Quantile tables, histogram matching and seeded random fields."""
from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import climate_math as cm
from ..functions import geometry as g
from ..sources import grids
from ..sources.store import cut_lineage
from . import sampling
from .filters import constrain
from .lookup import broadcast_if_bounded


RANGE_VALUES = 2_000_000  # distinct values in a range partition


def quantile_points(count: int = 64, eps: float = 1e-4) -> list[float]:
    return [eps + (1 - 2 * eps) * i / (count - 1) for i in range(count)]


def exact_quantiles(df: DataFrame, value: str, points: Sequence[float], by: Sequence[str] = (),
                    partitions: int | None = None) -> DataFrame:
    """Interpolated order statistics of one column, per group, without sorting a group in one task.

    Equal values are counted first, so a value that holds a third of all rows is one row from
    then on.  These counts are stored, so the rows are read once: sampling the ranges and sizing
    them read the counts.  Distinct values are range partitioned once, across groups, and kept in
    the checkpoint folder; only one total per partition and group is accumulated in order, and only
    partitions that contain a wanted rank are looked at again.
    """
    by = list(by)
    spark = df.sparkSession
    counts = cut_lineage(df.where(F.col(value).isNotNull() & ~F.isnan(value))
                         .groupBy(*by, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c")))
    if partitions is None:  # a range of distinct values has to fit one task
        partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(counts.count() / RANGE_VALUES))
    ranged = cut_lineage(counts.repartitionByRange(partitions, *by, "v")
                         .withColumn("part", F.spark_partition_id()))
    totals = ranged.groupBy(*by, "part").agg(F.sum("c").alias("t"))  # at most partitions x groups rows
    run = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    starts = totals.select(*by, "part", "t", (F.sum("t").over(run) - F.col("t")).alias("before"),
                           F.sum("t").over(Window.partitionBy(*by)).alias("total"))
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p"))
                       for i, p in enumerate(points)])
    ranks = starts.select(*by, "part", "before", "t", "total", F.explode(wanted).alias("__w"))
    place = F.col("__w.p") * (F.col("total") - F.lit(1))
    ranks = ranks.select(*by, "part", "before", F.col("__w.i").alias("i"), place.alias("place"), "t",
                         F.explode(F.array(F.lit(0), F.lit(1))).alias("upper"), "total")
    rank = F.least(F.floor("place") + F.col("upper"), F.col("total") - F.lit(1))
    ranks = ranks.withColumn("rank", rank).where(
        (F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("t")))
    # Two ranks per wanted point and group, whatever the data size.
    key = [*by, "part"]
    touched = ranged.join(ranks.select(*key).distinct(), key, "left_semi")
    inside = Window.partitionBy(*key).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    spans = touched.select(*key, "v", "c", F.sum("c").over(inside).alias("end"))
    hit = spans.join(ranks, key).where(
        (F.col("rank") - F.col("before") < F.col("end"))
        & (F.col("rank") - F.col("before") >= F.col("end") - F.col("c")))
    both = hit.groupBy(*by, "i").agg(F.max(F.when(F.col("upper") == 0, F.col("v"))).alias("lo"),
                                     F.max(F.when(F.col("upper") == 1, F.col("v"))).alias("hi"),
                                     F.max("place").alias("place"))
    share = F.col("place") - F.floor("place")
    return both.select(*by, "i", (F.col("lo") + (F.col("hi") - F.col("lo")) * share).alias("q"))


def break_ties(table: DataFrame) -> DataFrame:
    """Make a short sorted quantile array strictly increasing, in one fold over its entries."""
    gaps = F.filter(F.transform(F.sequence(F.lit(1), F.size("q") - 1),
                                lambda k: F.get("q", k) - F.get("q", k - 1)), lambda d: d > 0)
    t = table.withColumn("__step", F.coalesce(F.array_min(gaps), F.lit(1e-10)) * F.lit(0.1))
    fixed = F.aggregate(
        F.slice("q", 2, F.greatest(F.size("q") - 1, F.lit(0))), F.slice("q", 1, 1),
        lambda done, q: F.concat(done, F.array(
            F.when(q <= F.element_at(done, -1), F.element_at(done, -1) + F.col("__step"))
            .otherwise(q))))
    return t.withColumn("q", fixed).drop("__step")


def quantile_tables(df: DataFrame, value: str, channel: str = "channel", count: int = 64,
                    eps: float = 1e-4, approximate: bool = False, accuracy: int = 10_000) -> DataFrame:
    """One row ``(channel, q ARRAY)`` per channel, with ``count`` strictly increasing quantiles.

    ``approximate=True`` merges bounded sketches instead of counting distinct values.
    """
    points = quantile_points(count, eps)
    if approximate:
        rows = df.where(~F.isnan(value)).groupBy(F.col(channel).alias("channel")).agg(
            F.percentile_approx(value, [float(p) for p in points], accuracy).alias("q"))
    else:
        ordered = F.array_sort(F.collect_list(F.struct("i", "q")))  # ``count`` entries per channel
        rows = exact_quantiles(df.withColumnRenamed(channel, "channel"), value, points, ["channel"]).groupBy(
            "channel").agg(F.transform(ordered, lambda s: s["q"]).alias("q"))
    return break_ties(rows)


def quantile_table(df: DataFrame, value: str, channel: str, **options) -> DataFrame:
    """The table of a single population, labelled ``channel``."""
    return quantile_tables(df.select(F.lit(channel).alias("channel"), value), value, **options)


def quantile_map(df: DataFrame, value: str, source: DataFrame, target: DataFrame, count: int = 64,
                 out: str = "mapped") -> DataFrame:
    """Replace each value by the target value at the same quantile.

    ``source`` and ``target`` are quantile tables keyed by ``channel``; ``df`` has that column.
    """
    tables = source.select("channel", F.col("q").alias("__s")).join(
        target.select("channel", F.col("q").alias("__t")), "channel")
    # One row of two arrays per channel, made once and counted; broadcast while that is small.
    tables = cut_lineage(tables)
    tables = broadcast_if_bounded(tables, tables.count(), 64 + 16 * count)
    j = df.join(tables, "channel", "left")
    v = F.col(value)
    index = sum(((v >= F.get("__s", F.lit(k))).cast("int") for k in range(1, count - 1)), F.lit(0))
    j = j.withColumn("__k", index)
    j = j.withColumns({"__s0": F.get("__s", F.col("__k")), "__s1": F.get("__s", F.col("__k") + 1),
                       "__t0": F.get("__t", F.col("__k")), "__t1": F.get("__t", F.col("__k") + 1)})
    mapped = (F.when(v <= F.col("__s0"), F.col("__t0")).when(v >= F.col("__s1"), F.col("__t1"))
              .otherwise(F.col("__t0") + (v - F.col("__s0")) * (F.col("__t1") - F.col("__t0"))
                         / (F.col("__s1") - F.col("__s0"))))
    return j.withColumn(out, mapped).drop("__s", "__t", "__k", "__s0", "__s1", "__t0", "__t1")


# ----------------------------------------------------------------------------- random fields
def uniform_hash(parts: Sequence, portable: bool = False) -> Column:
    """Uniform number in (0, 1) from key columns; the same for any partitioning or query order.

    ``portable=True`` uses a digest that other engines reproduce; the default is a fast hash.
    """
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    if portable:
        digest = F.md5(F.concat_ws(":", *[c.cast("string") for c in cols]))
        bits = F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint")
        return (bits.cast("double") + F.lit(0.5)) / F.lit(float(2 ** 48))
    bits = F.shiftrightunsigned(F.xxhash64(*cols), 11)
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(2 ** 53))


def gaussian_hash(parts: Sequence, portable: bool = False) -> Column:
    u1, u2 = uniform_hash([*parts, "u"], portable), uniform_hash([*parts, "v"], portable)
    return F.sqrt(F.lit(-2.0) * F.ln(u1)) * F.cos(F.lit(2 * math.pi) * u2)


def gaussian_cube_noise(nodes: DataFrame, n: int, seed: int | str, stream: int, channel: int = 0,
                        out: str = "noise", portable: bool = False) -> DataFrame:
    """One unit Gaussian draw per physical node: aliases share the key, so no join is needed."""
    kx, ky, kz = g.node_key("face", "y", "x", n)
    return nodes.withColumn(out, gaussian_hash([str(seed), stream, channel, kx, ky, kz], portable))


def gaussian_lonlat_noise(nodes: DataFrame, h: int, seed: int | str, stream: int, channel: int = 0,
                          out: str = "noise", portable: bool = False) -> DataFrame:
    column = F.when(F.col("y").isin(0, h), F.lit(0)).otherwise(F.col("x"))
    return nodes.withColumn(out, gaussian_hash([str(seed), stream, channel, F.col("y"), column], portable))


def smooth_field(seed: int, v=g.VEC) -> Column:
    """Sum of twelve sine waves over the sphere with seeded directions and phases."""
    total = F.lit(0.0)
    for wave in smooth_waves(seed):
        inner = F.lit(wave[-1])
        for c, k in zip(v, wave):
            inner = inner + F.lit(k) * F.col(c)
        total = total + F.sin(inner)
    return total / F.lit(math.sqrt(6.0))


def smooth_waves(seed: int, count: int = 12) -> list[tuple[float, float, float, float]]:
    """Wave vectors (normal, spread 2) and phases, every number a digest of the seed and its place."""
    def unit(wave, part):
        digest = hashlib.sha256(f"smooth:{seed}:{wave}:{part}".encode()).digest()
        return (int.from_bytes(digest[:6], "big") + 0.5) / 2 ** 48
    normal = NormalDist(0.0, 2.0)
    return [(*(normal.inv_cdf(unit(k, axis)) for axis in "xyz"), 2 * math.pi * unit(k, "phase")) for k in range(count)]


def guide_channels(nodes: DataFrame, seed: int) -> DataFrame:
    """Five raw channels of the smooth seeded world at directions."""
    d = nodes.withColumn("__f", smooth_field(seed))
    f, zz = F.col("__f"), F.col("vz") * F.col("vz")
    return d.withColumns({
        cm.CHANNELS[0]: F.lit(2200.0) * f - F.lit(900.0),
        cm.CHANNELS[1]: F.lit(28.0) - F.lit(48.0) * zz,
        cm.CHANNELS[2]: F.lit(350.0) + F.lit(200.0) * zz,
        cm.CHANNELS[3]: F.lit(1200.0) + F.lit(400.0) * F.tanh(f),
        cm.CHANNELS[4]: F.lit(55.0) + F.lit(10.0) * F.tanh(f)}).drop("__f")


def smooth_guide_cube(spark: SparkSession, seed: int, n: int, encoded: bool = True) -> DataFrame:
    """Five smooth seeded channels on the cube, the default fallback of a guide."""
    nodes = guide_channels(g.add_direction(grids.cube_nodes(spark, n), n), seed).drop(*g.VEC)
    if encoded:
        nodes = nodes.withColumn(cm.CHANNELS[0], g.signed_sqrt(cm.CHANNELS[0]))
    return sampling.identify(nodes, n)


def smooth_guide_lonlat(spark: SparkSession, seed: int, h: int) -> DataFrame:
    nodes = sampling.add_node_direction(grids.lonlat_nodes(spark, h), h)
    guide = guide_channels(nodes, seed).drop(*g.VEC)
    guide = guide.withColumn(cm.CHANNELS[0], g.signed_sqrt(cm.CHANNELS[0]))
    return constrain(guide, h)


def drop_ocean_rows(df: DataFrame, elevation: str, drop: float, key: Sequence[str],
                    seed: int = 0, portable: bool = False) -> DataFrame:
    """Keep land, and a seeded share ``1-drop`` of the ocean; very low values are invalid."""
    u = uniform_hash([str(seed), *[F.col(k) for k in key]], portable)
    return df.where((F.col(elevation) >= -30000) & ((u > drop) | (F.col(elevation) >= 0)))
