"""Point lookups, halos, shared nodes and resampling of cube and longitude/latitude fields.

Bilinear lookups join each point **once**: the field is first turned into a table of cells that
carry their four corner values (one hash aggregate over the field), so points are neither
multiplied by four nor grouped again, and need no unique id.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..sources import grids
from ..sources.store import cut_lineage
from .lookup import keyed_lookup, pin

CUBE_KEY = ["face", "y", "x"]


def value_columns(field: DataFrame, keys: Sequence[str]) -> list[str]:
    return [c for c in field.columns if c not in keys]


# ----------------------------------------------------------------------------- shared nodes
def identify(field: DataFrame, n: int, how: str = "mean", boundary_only: bool = False) -> DataFrame:
    """Give all aliases of one physical node the same value.

    ``mean`` averages the aliases; ``owner`` copies the value of the first one in face, row,
    column order, which keeps the variance of noise.  The grouping yields one row per physical
    node and the aliases are written back by a narrow expression, so there is one shuffle and
    no join.  ``boundary_only`` (for stored fields, whose scan is cheap to repeat) shuffles the
    face edges alone.
    """
    values = value_columns(field, CUBE_KEY)
    if boundary_only:
        edge = g.on_face_boundary("y", "x", n)
        inner = field.where(~edge).select(*CUBE_KEY, *values)
        return inner.unionByName(identify(field.where(edge), n, how))
    kx, ky, kz = g.node_key("face", "y", "x", n)
    keyed = field.withColumns({"kx": kx, "ky": ky, "kz": kz})
    if how == "mean":
        aggs = [F.avg(v).alias(v) for v in values]
    elif how == "owner":
        # One BIGINT as the order keeps the aggregate buffer flat, so it stays a hash aggregate.
        order = F.expr(f"(face * {n + 1}L + y) * {n + 1}L + x")
        aggs = [F.min_by(v, order).alias(v) for v in values]
    else:
        raise ValueError("how must be 'mean' or 'owner'")
    return spread_to_aliases(keyed.groupBy("kx", "ky", "kz").agg(*aggs), n)


def spread_to_aliases(nodes: DataFrame, n: int) -> DataFrame:
    """Chart rows of a table that has one row per physical node key."""
    values = value_columns(nodes, ["kx", "ky", "kz"])
    exploded = nodes.select(F.explode(g.key_aliases(n)).alias("__a"), *values)
    return exploded.select(F.col("__a.face").alias("face"), F.col("__a.y").alias("y"),
                           F.col("__a.x").alias("x"), *values)


def alias_group_sizes(nodes: DataFrame, n: int) -> DataFrame:
    """How many physical nodes have one, two or three chart entries."""
    kx, ky, kz = g.node_key("face", "y", "x", n)
    sizes = nodes.groupBy(kx.alias("kx"), ky.alias("ky"), kz.alias("kz")).agg(
        F.count(F.lit(1)).alias("aliases"))
    return sizes.groupBy("aliases").agg(F.count(F.lit(1)).alias("nodes"))


# ----------------------------------------------------------------------------- cells
def _cells(field: DataFrame, extra: list[str], values: list[str], rows: int, cols: int,
           wrap: int | None, needed: DataFrame | None) -> DataFrame:
    def corner(dy, dx):
        cy, cx = F.col("y") - F.lit(dy), F.col("x") - F.lit(dx)
        cx = F.pmod(cx, F.lit(wrap)).cast("int") if wrap else cx
        # NULL outside: a range filter on the cell would be inferred for the points as well and
        # pushed below their projections with all geometry inlined.
        return F.when(cy.between(0, rows - 1) & cx.between(0, cols - 1), F.struct(
            cy.alias("cell_y"), cx.alias("cell_x"), F.lit(2 * dy + dx).alias("slot")))
    corners = F.array(*[corner(dy, dx) for dy in (0, 1) for dx in (0, 1)])
    e = field.select(*extra, *values, F.explode(corners).alias("__o")).where(F.col("__o").isNotNull())
    e = e.select(*extra, "__o.cell_y", "__o.cell_x", F.col("__o.slot").alias("__slot"), *values)
    if needed is not None:
        e = e.join(needed, [*extra, "cell_y", "cell_x"], "left_semi")
    return e.groupBy(*extra, "cell_y", "cell_x").agg(
        *[F.max(F.when(F.col("__slot") == s, F.col(v))).alias(f"__{v}_{s}")
          for v in values for s in range(4)])


def cube_cells(field: DataFrame, n: int, needed: DataFrame | None = None,
               extra: Sequence[str] = ()) -> DataFrame:
    """Cells of a cube field with their four corner values; ``needed`` limits them by semi join."""
    keys = [*extra, "face"]
    return _cells(field, keys, value_columns(field, [*keys, "y", "x"]), n, n, None, needed)


def lonlat_cells(field: DataFrame, h: int, needed: DataFrame | None = None,
                 extra: Sequence[str] = ()) -> DataFrame:
    extra = list(extra)
    return _cells(field, extra, value_columns(field, [*extra, "y", "x"]), h, 2 * h, 2 * h, needed)


def blend(v: str) -> Column:
    fy, fx, one = F.col("__fy"), F.col("__fx"), F.lit(1.0)
    return ((one - fy) * ((one - fx) * F.col(f"__{v}_0") + fx * F.col(f"__{v}_1"))
            + fy * ((one - fx) * F.col(f"__{v}_2") + fx * F.col(f"__{v}_3")))


def split_index(df: DataFrame, y, x, rows: int, cols: int) -> DataFrame:
    """Integer cell and fraction; the last row of nodes belongs to the last cell.

    Keys never become NULL: a missing coordinate falls in cell -1, which holds nothing.  Join
    keys that cannot be NULL also spare Catalyst from pushing null checks, with the whole
    coordinate expression inlined, below the projections.
    """
    def whole(c, count):
        return F.coalesce(F.least(F.floor(c), F.lit(count - 1)).cast("int"), F.lit(-1))
    df = df.withColumns({"cell_y": whole(y, rows), "cell_x": whole(x, cols)})
    return df.withColumns({"__fy": y - F.col("cell_y"), "__fx": x - F.col("cell_x")})


def _interpolate(points: DataFrame, cells_of, keys: list[str], values: list[str],
                 out: list[str], max_cells: int, prune: bool, spread_hot_keys: bool) -> DataFrame:
    points = pin(points, [*keys, "__fy", "__fx"])
    needed = points.select(*keys).distinct() if prune else None
    hit = keyed_lookup(points, cells_of(needed), keys, max_rows=max_cells,
                       spread_hot_keys=spread_hot_keys)
    hit = hit.withColumns({o: blend(v) for v, o in zip(values, out)})
    return hit.drop("cell_y", "cell_x", "__fy", "__fx",
                    *[f"__{v}_{s}" for v in values for s in range(4)])


def sample_cube(points: DataFrame, field: DataFrame, n: int, *, v=g.VEC,
                out: Sequence[str] | None = None, prune: bool = False,
                spread_hot_keys: bool = False) -> DataFrame:
    """Bilinear values of a cube field at directions.

    ``prune=True`` first reduces the field to the cells that the points touch (semi join), for
    regional requests against a global field.
    """
    values = value_columns(field, CUBE_KEY)
    kept = points.columns
    out = list(out or values)
    p = g.add_cube_coordinates(points, n, v, ("__face", "__cy", "__cx"))
    p = split_index(p.withColumnRenamed("__face", "__pf"), F.col("__cy"), F.col("__cx"), n, n)
    p = p.drop("__cy", "__cx")
    cells = lambda needed: cube_cells(
        field, n, None if needed is None else needed.withColumnRenamed("__pf", "face")
    ).withColumnRenamed("face", "__pf")
    done = _interpolate(p, cells, ["__pf", "cell_y", "cell_x"], values, out, 6 * n * n,
                        prune, spread_hot_keys)
    return done.select(*kept, *out)


def sample_cube_nearest(points: DataFrame, field: DataFrame, n: int, *, v=g.VEC,
                        spread_hot_keys: bool = False) -> DataFrame:
    """Value of the nearest node on the owning face."""
    values = value_columns(field, CUBE_KEY)
    p = g.add_cube_coordinates(points, n, v, ("__face", "__cy", "__cx"))
    p = p.withColumns({"__y": g.nearest_index("__cy"), "__x": g.nearest_index("__cx")})
    table = field.select(F.col("face").alias("__face"), F.col("y").alias("__y"),
                         F.col("x").alias("__x"), *values)
    p = pin(p, ["__face", "__y", "__x"])
    hit = keyed_lookup(p, table, ["__face", "__y", "__x"], max_rows=6 * (n + 1) ** 2,
                       spread_hot_keys=spread_hot_keys)
    return hit.select(*points.columns, *values)


def sample_lonlat(points: DataFrame, field: DataFrame, h: int, *, ny="ny", nx="nx",
                  out: Sequence[str] | None = None, prune: bool = False,
                  extra: Sequence[str] = (), max_fields: int = 1,
                  spread_hot_keys: bool = False) -> DataFrame:
    """Bilinear values of a node field at fractional node coordinates.

    Coordinates outside the lattice are folded first: a row beyond a pole continues on the
    opposite meridian, which is exact because a pole is one shared node.
    ``extra`` names key columns present on both sides (for example a band); at most
    ``max_fields`` of them exist.
    """
    values = value_columns(field, [*extra, "y", "x"])
    kept, out = points.columns, list(out or values)
    p = points.withColumns(dict(zip(("__y", "__x"), g.fold_lonlat(ny, nx, h))))
    p = split_index(p, F.col("__y"), F.col("__x"), h, 2 * h).drop("__y", "__x")
    done = _interpolate(p, lambda needed: lonlat_cells(field, h, needed, extra),
                        [*extra, "cell_y", "cell_x"], values, out, max_fields * 2 * h * h,
                        prune, spread_hot_keys)
    return done.select(*kept, *out)


def weighted_sums_lonlat(points: DataFrame, field: DataFrame, h: int, keys: Sequence[str], weight: str, *,
                         ny="ny", nx="nx") -> DataFrame:
    """Sums over the points of each key: ``weight``, and ``weight`` times the bilinear values of a node field.

    Corner weights of a key's points in one cell are added before the lookup, which then sees one row for each key and
    cell.  Points of a key that already lie in one task are merged there.
    """
    values, keys = value_columns(field, ["y", "x"]), list(keys)
    p = points.withColumns(dict(zip(("__y", "__x"), g.fold_lonlat(ny, nx, h))))
    p = pin(split_index(p, F.col("__y"), F.col("__x"), h, 2 * h).select(
        *keys, weight, "cell_y", "cell_x", "__fy", "__fx"), ["cell_y", "cell_x", "__fy", "__fx"])
    fy, fx, one = F.col("__fy"), F.col("__fx"), F.lit(1.0)
    corners = ((one - fy) * (one - fx), (one - fy) * fx, fy * (one - fx), fy * fx)
    merged = p.groupBy(*keys, "cell_y", "cell_x").agg(
        F.sum(weight).alias("__all"), *[F.sum(F.col(weight) * c).alias(f"__w_{k}") for k, c in enumerate(corners)])
    hit = keyed_lookup(merged, lonlat_cells(field, h), ["cell_y", "cell_x"], max_rows=2 * h * h)
    sums = [F.sum(sum((F.col(f"__w_{k}") * F.col(f"__{v}_{k}") for k in range(1, 4)), F.col("__w_0") * F.col(f"__{v}_0"))).alias(v)
            for v in values]
    return hit.groupBy(*keys).agg(F.sum("__all").alias(weight), *sums)


def gather_lonlat(points: DataFrame, field: DataFrame, h: int, *, y="y", x="x",
                  spread_hot_keys: bool = False) -> DataFrame:
    """Node values at integer node indices, which may lie beyond a pole or the date line."""
    values = value_columns(field, ["y", "x"])
    kept = points.columns
    p = points.withColumns({k: F.coalesce(c.cast("int"), F.lit(-1)) for k, c in
                            zip(("__gy", "__gx"), g.fold_lonlat(y, x, h))})
    table = field.select(F.col("y").alias("__gy"), F.col("x").alias("__gx"), *values)
    hit = keyed_lookup(p, table, ["__gy", "__gx"], max_rows=(h + 1) * 2 * h,
                       spread_hot_keys=spread_hot_keys)
    return hit.select(*kept, *values)


# ----------------------------------------------------------------------------- halos
def halo_nodes(nodes: DataFrame, n: int, radius: int, axes=("y", "x")) -> DataFrame:
    """Chart indices outside each face, up to ``radius`` away along the given axes.

    One range whose length is linear in ``n``.
    """
    side, up = n + 1, radius if "y" in axes else 0
    wide = side + (2 * radius if "x" in axes else 0)
    # One strip above and one below over the full width, then the columns beside the face.
    strip, beside = 2 * up * wide, side * (wide - side)
    i = F.col("id")
    k = F.pmod(i, F.lit(strip + beside)).cast("int")
    p = grids._ranged(nodes.sparkSession, 6 * (strip + beside)).select(
        F.floor(i / F.lit(strip + beside)).cast("int").alias("face"), k.alias("k"))
    line = F.floor(F.col("k") / F.lit(wide)).cast("int")
    left = F.lit((side - wide) // 2)
    rest = F.col("k") - F.lit(strip)
    per = max(1, wide - side)
    past = F.pmod(rest, F.lit(per))
    in_strip = F.col("k") < strip
    return p.select(
        "face",
        F.when(in_strip, F.when(line < up, line - F.lit(up)).otherwise(line - F.lit(up) + F.lit(side)))
        .otherwise(F.floor(rest / F.lit(per)).cast("int")).alias("y"),
        F.when(in_strip, left + F.pmod("k", F.lit(wide)))
        .otherwise(F.when(past < radius, past - F.lit(radius)).otherwise(past - F.lit(radius) + F.lit(side)))
        .alias("x"))


def read_chart(requests: DataFrame, field: DataFrame, n: int, nearest: bool = False,
               spread_hot_keys: bool = False) -> DataFrame:
    """Values at chart indices ``(face, y, x)`` that may be fractional or leave the face.

    Indices outside the face continue along the great circle of the chart axis and are read from
    the face that owns the point there.
    """
    p = g.add_direction(requests, n, normalize=False)
    inside = F.col("y").between(0, n) & F.col("x").between(0, n)
    p = g.add_cube_coordinates(p, n, out=("__of", "__oy", "__ox"))
    p = p.withColumns({"__pf": F.coalesce(F.when(inside, F.col("face")).otherwise(F.col("__of")), F.lit(-1)),
                       "__py": F.when(inside, F.col("y").cast("double")).otherwise(F.col("__oy")),
                       "__px": F.when(inside, F.col("x").cast("double")).otherwise(F.col("__ox"))})
    p = p.select(*requests.columns, "__pf", "__py", "__px")
    values = value_columns(field, CUBE_KEY)
    if nearest:
        p = p.withColumns({"__iy": g.nearest_index("__py"), "__ix": g.nearest_index("__px")})
        table = field.select(F.col("face").alias("__pf"), F.col("y").alias("__iy"),
                             F.col("x").alias("__ix"), *[F.col(v).alias(f"__v_{v}") for v in values])
        p = pin(p, ["__pf", "__iy", "__ix"])
        hit = keyed_lookup(p, table, ["__pf", "__iy", "__ix"], max_rows=6 * (n + 1) ** 2,
                           spread_hot_keys=spread_hot_keys)
        return hit.select(*requests.columns, *[F.col(f"__v_{v}").alias(v) for v in values])
    p = split_index(p, F.col("__py"), F.col("__px"), n, n).drop("__py", "__px")
    cells = cube_cells(field, n).withColumnRenamed("face", "__pf")
    done = _interpolate(p, lambda _: cells, ["__pf", "cell_y", "cell_x"], values, values,
                        6 * n * n, False, spread_hot_keys)
    return done.select(*requests.columns, *values)


def with_halo(field: DataFrame, n: int, radius: int, axes=("y", "x"),
              materialise: bool = True) -> DataFrame:
    """The field plus its cross-face halo rows.

    Only nodes near face edges can be read by a halo, so the join sees two linear-size sides.
    The field is used twice; ``materialise`` writes a derived one to the checkpoint folder first,
    so a chain of filters is not computed again at every level.  Not needed for stored tables.
    """
    field = cut_lineage(field) if materialise else field
    reach = 2 * radius + 2
    band = ((F.col("y") <= reach) | (F.col("y") >= n - reach)
            | (F.col("x") <= reach) | (F.col("x") >= n - reach))
    near = field if n <= 2 * reach else field.where(band)
    halo = read_chart(halo_nodes(field, n, radius, axes), near, n)
    return field.select(*CUBE_KEY, *value_columns(field, CUBE_KEY)).unionByName(halo)


# ----------------------------------------------------------------------------- resampling
def resize_cube(field: DataFrame, n_old: int, n_new: int) -> DataFrame:
    """Bilinear change of resolution on every chart, then shared nodes are identified.

    Chart indices stay inside their face, so no direction is needed.
    """
    values = value_columns(field, CUBE_KEY)
    return identify(at_scaled_nodes(grids.cube_nodes(field.sparkSession, n_new), field,
                                    n_old, n_new, values), n_new)


def at_scaled_nodes(nodes: DataFrame, field: DataFrame, n_old: int, n_new: int,
                    values: list[str], prune: bool = False) -> DataFrame:
    """Coarse field values at fine nodes: the fine index divided by the resolution ratio."""
    ratio = F.lit(n_old / n_new)
    kept = nodes.columns
    p = split_index(nodes, F.col("y") * ratio, F.col("x") * ratio, n_old, n_old)
    done = _interpolate(p, lambda needed: cube_cells(field, n_old, needed),
                        ["face", "cell_y", "cell_x"], values, values, 6 * n_old * n_old,
                        prune, False)
    return done.select(*kept, *values)


def resize_lonlat(field: DataFrame, h_old: int, h_new: int) -> DataFrame:
    ratio = F.lit(h_old / h_new)
    nodes = grids.lonlat_nodes(field.sparkSession, h_new).withColumns(
        {"ny": F.col("y") * ratio, "nx": F.col("x") * ratio})
    return sample_lonlat(nodes, field, h_old).drop("ny", "nx")


def add_node_direction(nodes: DataFrame, h: int) -> DataFrame:
    """Directions of longitude/latitude nodes; the poles are exactly plus and minus z."""
    from math import pi
    theta, lon = F.lit(pi) * F.col("y") / F.lit(h), F.lit(-pi) + F.lit(pi / h) * F.col("x")
    d = nodes.withColumns({"__t": theta, "__l": lon})
    pole = F.col("y").isin(0, h)
    return d.withColumns({
        "vx": F.when(pole, F.lit(0.0)).otherwise(F.sin("__t") * F.cos("__l")),
        "vy": F.when(pole, F.lit(0.0)).otherwise(F.sin("__t") * F.sin("__l")),
        "vz": F.when(F.col("y") == 0, F.lit(1.0)).when(F.col("y") == h, F.lit(-1.0))
        .otherwise(F.cos("__t"))}).drop("__t", "__l")


def cube_to_lonlat(field: DataFrame, n: int, h: int) -> DataFrame:
    nodes = add_node_direction(grids.lonlat_nodes(field.sparkSession, h), h)
    return sample_cube(nodes, field, n).drop(*g.VEC)


def lonlat_to_cube(field: DataFrame, h: int, n: int) -> DataFrame:
    """Point evaluation of a node field on every cube node."""
    nodes = g.add_direction(grids.cube_nodes(field.sparkSession, n), n)
    nodes = g.add_lonlat_node(nodes, h)
    return identify(sample_lonlat(nodes, field, h).drop(*g.VEC, "ny", "nx"), n)


def field_from_expression(spark, n: int, **columns: Column) -> DataFrame:
    """Cube field from user expressions over ``face, y, x, vx, vy, vz``; aliases identified."""
    nodes = g.add_direction(grids.cube_nodes(spark, n), n)
    return identify(nodes.select(*CUBE_KEY, *[c.alias(k) for k, c in columns.items()]), n)
