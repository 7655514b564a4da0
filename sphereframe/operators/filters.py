"""Separable filters, differences, reductions and pole constraints.

A filter runs as one window over ``(line, block)``: lines are cut in blocks and every block
carries copies of the few rows its taps need from the neighbours, so a window group never grows
with the grid.  Halo rows come from a narrow expression on longitude/latitude lattices and from a
linear-size join on the cube.
"""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..sources import grids
from ..sources.store import cut_lineage
from . import sampling
from .sampling import CUBE_KEY, value_columns

BLOCK = 4096


def _with_blocks(df: DataFrame, axis: str, radius: int, length: int, block: int) -> DataFrame:
    """Add a block id along an axis; rows within ``radius`` of a block edge join both blocks."""
    if length + 2 * radius <= block:
        return df.withColumn("__block", F.lit(0))
    b = F.lit(block)
    return df.withColumn("__block", F.explode(F.sequence(
        F.floor((F.col(axis) - radius) / b), F.floor((F.col(axis) + radius) / b))))


def _own_block(axis: str, radius: int, length: int, block: int) -> Column:
    if length + 2 * radius <= block:
        return F.lit(True)
    return F.floor(F.col(axis) / F.lit(block)) == F.col("__block")


def _follows(axis: str, w) -> Column:
    """Whether the index of a row is the one after the row before it (the first row of a line has none)."""
    return F.coalesce(F.lag(axis).over(w) == F.col(axis) - 1, F.lit(True))


def tap_filter(df: DataFrame, line: Sequence[str], axis: str, weights: Sequence[float],
               values: Sequence[str], low: int, high: int, every: int = 1,
               block: int = BLOCK) -> DataFrame:
    """Weighted sum of neighbours along ``axis`` in a fixed order of terms.

    ``df`` must hold a gap-free run of indices from ``low - radius`` to ``high + radius`` in every
    line; a gap or a repeated index is an error.  Only outputs in ``low..high`` that are multiples of
    ``every`` are kept.
    """
    radius = len(weights) // 2
    length = high - low + 1
    w = Window.partitionBy(*line, "__block").orderBy(axis)

    def taps(v):
        total = None
        for offset, weight in zip(range(-radius, radius + 1), weights):
            tap = (F.col(v) if offset == 0 else
                   F.lag(v, -offset).over(w) if offset < 0 else F.lead(v, offset).over(w))
            term = F.lit(float(weight)) * tap
            total = term if total is None else total + term
        return F.when(_follows(axis, w), total).otherwise(F.raise_error(F.lit(f"a line has gaps along {axis}")).cast("double"))
    keep = F.col(axis).between(low, high) & _own_block(axis, radius, length, block)
    if every > 1:
        keep &= F.pmod(F.col(axis), F.lit(every)) == 0
    out = _with_blocks(df, axis, radius, length, block).withColumns(
        {f"__f_{v}": taps(v) for v in values}).where(keep)
    return out.select(*line, axis, *[F.col(f"__f_{v}").alias(v) for v in values])


def differences(df: DataFrame, line: Sequence[str], axis: str, value: str, low: int, high: int,
                out: str = "d", block: int = BLOCK) -> DataFrame:
    """First difference to the previous index on the same line (none for the first)."""
    w = Window.partitionBy(*line, "__block").orderBy(axis)
    length = high - low + 1
    d = _with_blocks(df, axis, 1, length, block).withColumn(
        out, F.when(_follows(axis, w), F.col(value) - F.lag(value).over(w)).otherwise(
            F.raise_error(F.lit(f"a line has gaps along {axis}")).cast("double")))
    return d.where(F.col(out).isNotNull() & _own_block(axis, 1, length, block)).drop("__block")


# ----------------------------------------------------------------------------- cube
def _cube_pass(field: DataFrame, n: int, weights: Sequence[float], axis: str, every: int,
               block: int) -> DataFrame:
    """One unidentified filter pass; reads ``field`` twice (faces and the band at their edges)."""
    other = "x" if axis == "y" else "y"
    values = value_columns(field, CUBE_KEY)
    haloed = sampling.with_halo(field, n, len(weights) // 2, axes=(axis,), materialise=False)
    out = tap_filter(haloed, ["face", other], axis, weights, values, 0, n, every, block)
    return out.select(*CUBE_KEY, *values)


def filter_cube_axis(field: DataFrame, n: int, weights: Sequence[float], axis: str, *,
                     stored: bool = False, block: int = BLOCK) -> DataFrame:
    """One pass of a separable filter on all faces, reading across face edges.

    The pass is written to the checkpoint folder, because the next one reads it twice; after
    that, only face-edge rows are shuffled to identify aliases.  ``stored=True`` says that
    ``field`` is itself cheap to read twice (a saved table or an earlier pass).
    """
    field = field if stored else cut_lineage(field)
    out = cut_lineage(_cube_pass(field, n, weights, axis, 1, block))
    return sampling.identify(out, n, boundary_only=True)


def filter_cube(field: DataFrame, n: int, weights: Sequence[float], *, stored: bool = False,
                block: int = BLOCK) -> DataFrame:
    once = filter_cube_axis(field, n, weights, "x", stored=stored, block=block)
    return filter_cube_axis(once, n, weights, "y", stored=True, block=block)


def reduce_cube(field: DataFrame, n: int, scale: int, *, stored: bool = False,
                block: int = BLOCK) -> DataFrame:
    """Antialiased reduction by an integer factor; only kept nodes pass the second filter."""
    if scale < 1 or n % scale:
        raise ValueError("the scale must divide the intervals of a face")
    weights = grids.triangular_kernel(scale)
    once = filter_cube_axis(field, n, weights, "x", stored=stored, block=block)
    kept = _cube_pass(once, n, weights, "y", scale, block).where(F.pmod(F.col("x"), F.lit(scale)) == 0)
    small = kept.withColumns({c: (F.col(c) / F.lit(scale)).cast("int") for c in ("y", "x")})
    return sampling.identify(small, n // scale)


def merge_low_frequency_cube(residual: DataFrame, n: int, low: DataFrame, n_low: int) -> DataFrame:
    """Residual detail plus a low-frequency field that was made consistent with it."""
    if n_low < 1 or n % n_low:
        raise ValueError("the low lattice must divide the intervals of a face")
    scale = n // n_low
    values = value_columns(residual, CUBE_KEY)
    provisional = _add_scaled_cube(residual, n, low, n_low, values)
    smooth = filter_cube(reduce_cube(provisional, n, scale), n_low, grids.gaussian_kernel())
    return sampling.identify(_add_scaled_cube(residual, n, smooth, n_low, values), n)


def _add_scaled_cube(residual, n, low, n_low, values):
    renamed = low.select(*CUBE_KEY, *[F.col(v).alias(f"__low_{v}") for v in values])
    both = sampling.at_scaled_nodes(residual, renamed, n_low, n, [f"__low_{v}" for v in values])
    return both.select(*CUBE_KEY, *[(F.col(v) + F.col(f"__low_{v}")).alias(v) for v in values])


# ----------------------------------------------------------------------------- lon/lat
def lonlat_halo(field: DataFrame, h: int, radius_y: int = 0, radius_x: int = 0) -> DataFrame:
    """The field plus copies beyond the poles (half a turn away) and beyond the date line.

    Copies come from one narrow expression; a radius may exceed the lattice itself.
    """
    values = value_columns(field, ["y", "x"])
    y, x, w = F.col("y"), F.col("x"), 2 * h
    if radius_y:
        turns = range(-(radius_y // w) - 1, radius_y // w + 2)
        opposite = F.pmod(x + F.lit(h), F.lit(w)).cast("int")
        places = [(y + F.lit(w * k), x) for k in turns] + [(F.lit(w * k) - y, opposite) for k in turns]
        # A pole mirrors onto itself; only the unturned copy of it is kept.
        mirrored_pole = [F.lit(False)] * len(turns) + [y.isin(0, h)] * len(turns)
        copies = F.array(*[F.when(py.between(-radius_y, h + radius_y) & ~pole,
                                  F.struct(py.alias("y"), px.alias("x")))
                           for (py, px), pole in zip(places, mirrored_pole)])
        field = field.select(F.explode(copies).alias("__p"), *values).where(F.col("__p").isNotNull())
        field = field.select(F.col("__p.y").alias("y"), F.col("__p.x").alias("x"), *values)
    if radius_x:
        shifts = range(-(radius_x // w) - 1, radius_x // w + 2)
        copies = F.array(*[F.when((F.col("x") + F.lit(w * k)).between(-radius_x, w - 1 + radius_x),
                                  F.col("x") + F.lit(w * k)) for k in shifts])
        field = field.select("y", F.explode(copies).alias("x"), *values).where(F.col("x").isNotNull())
    return field


def filter_lonlat(field: DataFrame, h: int, weights: Sequence[float],
                  constrained: bool = True, block: int = BLOCK) -> DataFrame:
    """Separable filter with the sphere's own halo: wrap along rows, fold over poles."""
    values = value_columns(field, ["y", "x"])
    radius = len(weights) // 2
    across = tap_filter(lonlat_halo(field, h, 0, radius), ["y"], "x", weights, values,
                        0, 2 * h - 1, block=block)
    out = tap_filter(lonlat_halo(across, h, radius, 0), ["x"], "y", weights, values, 0, h,
                     block=block).select("y", "x", *values)
    return constrain(out, h) if constrained else out


def reduce_lonlat(field: DataFrame, h: int, scale: int, constrained: bool = True) -> DataFrame:
    """Antialiased reduction as one scatter.

    A node feeds at most two outputs per axis, so it is sent to them with its weight and summed:
    one shuffle, after a partial aggregate that already shrinks the data by ``scale^2``.
    """
    if h % scale:
        raise ValueError("the scale must divide the latitude intervals")
    values = value_columns(field, ["y", "x"])
    s, rows, cols = F.lit(scale), h // scale, 2 * h // scale
    e = lonlat_halo(field, h, scale - 1, 0)
    for axis in ("y", "x"):
        first = F.floor(F.col(axis) / s).cast("int")
        e = e.withColumn(f"__o{axis}", F.explode(F.array(first, first + 1)))
        e = e.withColumn(f"__w{axis}", (F.lit(1.0) - F.abs(
            F.col(axis) - F.col(f"__o{axis}") * s) / s) / s).where(F.col(f"__w{axis}") > 0)
    e = e.where(F.col("__oy").between(0, rows))
    out = e.groupBy(F.col("__oy").alias("y"), F.pmod(F.col("__ox"), F.lit(cols)).cast("int").alias("x")).agg(
        *[F.sum(F.col("__wy") * F.col("__wx") * F.col(v)).alias(v) for v in values])
    return constrain(out, rows) if constrained else out


def constrain(field: DataFrame, h: int, stored: bool = False) -> DataFrame:
    """One value per pole; the rows next to the poles keep only their mean and first harmonic.

    The field is needed twice, for the four cap rows and for the result.  It is evaluated once, into a table sorted by row,
    so the caps come from the row groups that hold them; ``stored`` says that the field is a stored table already.
    """
    values = value_columns(field, ["y", "x"])
    if not stored:
        field = cut_lineage(field.sortWithinPartitions("y"))
    width = 2 * h
    angle = F.lit(2 * math.pi / width) * F.col("x")
    aggs = []
    for v in values:
        aggs += [F.avg(v).alias(f"__m_{v}"),
                 (F.sum(F.col(v) * F.cos(angle)) * F.lit(2.0 / width)).alias(f"__c_{v}"),
                 (F.sum(F.col(v) * F.sin(angle)) * F.lit(2.0 / width)).alias(f"__s_{v}")]
    caps = field.where(F.col("y").isin(0, 1, h - 1, h)).groupBy("y").agg(*aggs)
    both = field.join(F.broadcast(caps), "y", "left")  # at most four rows

    def fixed(v):
        ring = F.col(f"__m_{v}") + F.col(f"__c_{v}") * F.cos(angle) + F.col(f"__s_{v}") * F.sin(angle)
        return (F.when(F.col("y").isin(0, h), F.col(f"__m_{v}"))
                .when(F.col("y").isin(1, h - 1), ring).otherwise(F.col(v)))
    return both.select("y", "x", *[fixed(v).alias(v) for v in values])


def merge_low_frequency_lonlat(residual: DataFrame, h: int, low: DataFrame, h_low: int) -> DataFrame:
    if h_low < 1 or h % h_low:
        raise ValueError("the low lattice must divide the latitude intervals")
    scale = h // h_low
    values = value_columns(residual, ["y", "x"])
    provisional = _add_scaled_lonlat(residual, h, low, h_low, values)
    reduced = reduce_lonlat(provisional, h, scale)
    smooth = filter_lonlat(reduced, h_low, grids.gaussian_kernel())
    return constrain(_add_scaled_lonlat(residual, h, smooth, h_low, values), h)


def _add_scaled_lonlat(residual, h, low, h_low, values):
    ratio = F.lit(h_low / h)
    points = residual.withColumns({"ny": F.col("y") * ratio, "nx": F.col("x") * ratio})
    renamed = low.select("y", "x", *[F.col(v).alias(f"__low_{v}") for v in values])
    both = sampling.sample_lonlat(points, renamed, h_low)
    return both.select("y", "x", *[(F.col(v) + F.col(f"__low_{v}")).alias(v) for v in values])
