"""Lookups and tile contexts straight from stored blocks: rows are points or tiles and blocks, never nodes."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..sources import grids
from ..sources.blocks import BlockStore
from . import sampling
from .lookup import pin


def _with_blocks(points: DataFrame, stored: BlockStore, check: bool = True) -> DataFrame:
    """Points with the block of their key ``z``; -1 is no block."""
    blocks = stored.read(points.select("z").where("z >= 0"), check)
    return points.join(blocks.select("z", "y0", "x0", "w", *stored.values.names), "z", "left")


def _keyed(points: DataFrame, stored: BlockStore, face: Column, y: str, x: str, also: Sequence[str] = ()) -> DataFrame:
    by, bx = stored.lattice.owner(F.col(y), F.col(x))
    known = face.isNotNull() & (F.col(y) >= 0) & (F.col(x) >= 0)
    z = F.when(known, stored.lattice.curve(face, by, bx)).otherwise(F.lit(-1).cast("bigint"))
    return pin(points.withColumn("z", F.coalesce(z, F.lit(-1).cast("bigint"))), ["z", y, x, *also])


def bilinear(points: DataFrame, stored: BlockStore, face: str | None, y: str, x: str, check: bool = True) -> DataFrame:
    """Bilinear values at fractional indices on the lattice; a missing coordinate gives NULL."""
    kept, values, (rows, cols) = points.columns, stored.values.names, stored.lattice.last
    p = sampling.split_index(points, F.col(y), F.col(x), rows, cols)
    p = _keyed(p, stored, F.col(face) if face else F.lit(0), "cell_y", "cell_x", ["__fy", "__fx"])
    j = _with_blocks(p, stored, check)
    at = (F.col("cell_y") - F.col("y0")) * F.col("w") + F.col("cell_x") - F.col("x0")
    j = j.withColumns({f"__{v}_{s}": F.get(v, at + F.col("w") * (s // 2) + s % 2).cast("double") for v in values for s in range(4)})
    return j.select(*[c for c in kept if c not in values], *[sampling.blend(v).alias(v) for v in values])


def nearest(points: DataFrame, stored: BlockStore, face: str, y: str, x: str) -> DataFrame:
    """Values at integer node indices inside the faces."""
    kept, values = points.columns, stored.values.names
    j = _with_blocks(_keyed(points, stored, F.col(face), y, x), stored)
    at = (F.col(y) - F.col("y0")) * F.col("w") + F.col(x) - F.col("x0")
    return j.select(*kept, *[F.get(v, at).cast("double").alias(f"__v_{v}") for v in values]).select(
        *kept, *[F.col(f"__v_{v}").alias(v) for v in values])


def sample_cube(points: DataFrame, stored: BlockStore, v=g.VEC) -> DataFrame:
    p = g.add_cube_coordinates(points, stored.lattice.size, v, ("__pf", "__cy", "__cx"))
    return bilinear(p, stored, "__pf", "__cy", "__cx").drop("__pf", "__cy", "__cx")


def sample_lonlat(points: DataFrame, stored: BlockStore, ny: str = "ny", nx: str = "nx", check: bool = True) -> DataFrame:
    p = points.withColumns(dict(zip(("__y", "__x"), g.fold_lonlat(ny, nx, stored.lattice.size), strict=True)))
    return bilinear(p, stored, None, "__y", "__x", check).drop("__y", "__x")


# ----------------------------------------------------------------------------- tile contexts
def _home(c: Column, block: int, last: int, count: int) -> Column:
    """Block index of any index: the stored blocks inside 0..last, strips of blocks counted on before and after."""
    b = F.lit(block)
    return (F.when(c < 0, F.floor(c / b)).when(c > last, F.lit(count) + F.floor((c - (last + 1)) / b))
            .otherwise(F.least(F.floor(c / b), F.lit(count - 1))).cast("int"))


def halo_strips(stored: BlockStore, radius: int, value: str) -> DataFrame:
    """Rectangles of nearest-node values around each face, cut like its blocks; their size is linear in the face's side."""
    n, lattice = stored.lattice.size, stored.lattice
    p = g.add_direction(grids_halo(stored, radius), n, normalize=False)
    p = g.add_cube_coordinates(p, n, out=("__of", "__oy", "__ox"))
    p = p.withColumns({"__iy": g.nearest_index("__oy"), "__ix": g.nearest_index("__ox")}).select("face", "y", "x", "__of", "__iy", "__ix")
    read = nearest(p, stored, "__of", "__iy", "__ix")
    by, bx = (_home(F.col(c), lattice.block, n, lattice.count[0]) for c in ("y", "x"))
    strips = read.groupBy("face", by.alias("by"), bx.alias("bx")).agg(
        F.min("y").alias("y0"), F.min("x").alias("x0"), (F.max("y") - F.min("y") + 1).alias("h"), (F.max("x") - F.min("x") + 1).alias("w"),
        F.array_sort(F.collect_list(F.struct("y", "x", value))).alias("nodes"))
    return strips.select("face", "by", "bx", "y0", "x0", (F.col("y0") + F.col("h") - 1).alias("y1"), (F.col("x0") + F.col("w") - 1).alias("x1"),
                         "w", F.col(f"nodes.{value}").alias("piece"))


def grids_halo(stored: BlockStore, radius: int) -> DataFrame:
    return sampling.halo_nodes(grids.cube_nodes(stored.spark, stored.lattice.size), stored.lattice.size, radius)


def gather_context(origins: DataFrame, stored: BlockStore, size: int, reach: int, value: str) -> DataFrame:
    """Row-major context of each tile ``(face, ty, tx)``, at most ``reach`` nodes beyond the faces.

    A tile meets a few blocks; from each it takes one rectangle by slicing, and its rows are put together from those.  Equals
    :func:`sphereframe.operators.tiles.gather_context`, with a row for each tile and block instead of one for each cell.
    """
    lattice, n = stored.lattice, stored.lattice.size
    key = ["face", "ty", "tx"]
    b = lattice.block

    def span(c: str, count: int) -> Column:
        return F.sequence(_home(F.col(c), b, n, count), _home(F.col(c) + (size - 1), b, n, count))
    far = F.raise_error(F.lit("a tile reaches beyond the halo")).cast("int")
    legal = [F.when(F.col(c).between(-reach, n + reach - size + 1), F.col(c)).otherwise(far).alias(c) for c in ("ty", "tx")]
    parts = origins.select("face", *legal).distinct()
    parts = parts.withColumn("by", F.explode(span("ty", lattice.count[0]))).withColumn("bx", F.explode(span("tx", lattice.count[1])))
    inside = F.col("by").between(0, lattice.count[0] - 1) & F.col("bx").between(0, lattice.count[1] - 1)
    parts = pin(parts.withColumn("z", F.when(inside, lattice.curve(F.col("face"), F.col("by"), F.col("bx")))), ["by", "bx", "z"])

    def own(c: str, count: int) -> Column:
        return F.when(F.col(c) == count - 1, F.lit(n)).otherwise(F.col(c) * b + (b - 1))
    faces = parts.where("z is not null")
    blocks = stored.read(faces.select("z")).select(
        "z", "y0", "x0", own("by", lattice.count[0]).alias("y1"), own("bx", lattice.count[1]).alias("x1"), "w", F.col(value).cast("array<double>").alias("piece"))
    frame = ["y0", "x0", "y1", "x1", "w", "piece"]
    met = faces.join(blocks, "z").select(*key, *frame).unionByName(
        parts.where("z is null").join(halo_strips(stored, reach, value), ["face", "by", "bx"]).select(*key, *frame))
    top, left = F.greatest("ty", "y0"), F.greatest("tx", "x0")
    bottom, right = F.least(F.col("ty") + (size - 1), F.col("y1")), F.least(F.col("tx") + (size - 1), F.col("x1"))
    met = met.withColumns({"top": top, "left": left, "bottom": bottom, "wide": right - left + 1})
    rows = F.transform(F.sequence("top", "bottom"), lambda y: F.slice(
        "piece", (y - F.col("y0")) * F.col("w") + F.col("left") - F.col("x0") + 1, F.col("wide")))
    cut = met.select(*key, F.struct("left", "top", "bottom", rows.alias("rows")).alias("cut"))
    gathered = cut.groupBy(*key).agg(F.array_sort(F.collect_list("cut")).alias("cuts"))  # a few rectangles, size^2 values in all
    line = lambda y: F.flatten(F.transform(
        F.filter("cuts", lambda c: y.between(c["top"], c["bottom"])), lambda c: F.get(c["rows"], y - c["top"])))
    tile = F.flatten(F.transform(F.sequence(F.col("ty"), F.col("ty") + (size - 1)), line))
    torn = F.raise_error(F.lit("the blocks lack nodes under a tile")).cast("array<double>")
    return gathered.select(*key, tile.alias("values")).select(
        *key, F.when(F.size("values") == size * size, F.col("values")).otherwise(torn).alias("values"))


# ----------------------------------------------------------------------------- line sums
def line_sums(stored: BlockStore, value: str) -> DataFrame:
    """Sums of squared steps along every row and column of a longitude/latitude field, from one scan of its blocks.

    ``axis, line, squares, steps`` leave out the step over the date line, which rows have in ``seam``.  Rows also hold
    ``nodes, bad, low, high`` of their values, and ``damaged`` blocks that begin with them.  A block sums up its own part of
    each line, so what is shuffled is linear in the side of the blocks.
    """
    h, (down, _) = stored.lattice.size, stored.lattice.count
    b = stored.read(check=False).select(
        "y0", "x0", "h", "w", F.col(value).cast("array<double>").alias("v"), (~F.col("stored").eqNullSafe(F.col("found"))).alias("off"),
        (F.col("by") == down - 1).alias("bottom"), (F.col("x0") + F.col("w") - 1 == 2 * h).alias("right"))
    w, zero = F.col("w"), F.lit(0.0)

    def add(a, e):
        return a + e

    def squares(one, two):
        return F.zip_with(one, two, lambda p, q: (q - p) * (q - p))

    def row(r):
        line = F.slice("v", r * w + 1, w)
        steps = squares(F.slice(line, F.lit(1), w - 1), F.slice(line, F.lit(2), w - 1))
        own = F.slice(line, F.lit(1), w - 1)
        return F.struct(
            F.lit("row").alias("axis"), (F.col("y0") + r).alias("line"),
            F.aggregate(F.slice(steps, F.lit(1), w - F.when(F.col("right"), 2).otherwise(1)), zero, add).alias("squares"),
            (w - F.when(F.col("right"), 2).otherwise(1)).cast("bigint").alias("steps"),
            F.when(F.col("right"), F.element_at(steps, w - 1)).alias("seam"), (w - 1).cast("bigint").alias("nodes"),
            F.size(F.filter(own, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))).cast("bigint").alias("bad"),
            F.array_min(own).alias("low"), F.array_max(own).alias("high"), ((r == 0) & F.col("off")).cast("bigint").alias("damaged"))

    def column(c):
        height = F.col("h")
        at = lambda r: F.get("v", r * w + c)
        nothing = F.lit(None)
        return F.struct(
            F.lit("column").alias("axis"), (F.col("x0") + c).alias("line"),
            F.aggregate(F.sequence(F.lit(0), height - 2), zero, lambda a, r: a + (at(r + 1) - at(r)) * (at(r + 1) - at(r))).alias("squares"),
            (height - 1).cast("bigint").alias("steps"), nothing.cast("double").alias("seam"), nothing.cast("bigint").alias("nodes"),
            nothing.cast("bigint").alias("bad"), nothing.cast("double").alias("low"), nothing.cast("double").alias("high"),
            nothing.cast("bigint").alias("damaged"))
    rows = F.transform(F.sequence(F.lit(0), F.col("h") - F.when(F.col("bottom"), 1).otherwise(2)), row)
    columns = F.transform(F.sequence(F.lit(0), w - 2), column)
    e = b.select(F.explode(F.concat(rows, columns)).alias("e")).select("e.*")
    return e.groupBy("axis", "line").agg(*[F.sum(c).alias(c) for c in ("squares", "steps", "seam", "nodes", "bad", "damaged")],
                                         F.min("low").alias("low"), F.max("high").alias("high"))
