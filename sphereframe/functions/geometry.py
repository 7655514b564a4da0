"""Sphere geometry as native column expressions.

Directions live in three DOUBLE columns rather than one array, so every step stays inside
whole-stage code generation.  The ``add_*`` helpers chain small projections instead of building
one nested expression: Catalyst keeps a projection separate when its result is used many times,
so each angle, norm and dot product is evaluated once per row.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Outward normal, index-right and index-down axis of faces +x, +y, -x, -y, +z, -z.
NORMAL = [(1, 0, 0), (0, 1, 0), (-1, 0, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]
RIGHT = [(0, 1, 0), (-1, 0, 0), (0, -1, 0), (1, 0, 0), (0, 1, 0), (0, 1, 0)]
DOWN = [(0, 0, -1), (0, 0, -1), (0, 0, -1), (0, 0, -1), (1, 0, 0), (-1, 0, 0)]

QUARTER = math.pi / 4
VEC = ("vx", "vy", "vz")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _by_face(face: str, terms) -> str:
    """SQL CASE over the faces; a literal-array lookup would make every later value nullable."""
    *first, last = terms
    return (f"case {face} " + " ".join(f"when {f} then {t}" for f, t in enumerate(first))
            + f" else {last} end")


def _signed(axis, names) -> str:
    """The signed component that a unit axis selects."""
    (position,) = [k for k in range(3) if axis[k]]
    return names[position] if axis[position] > 0 else f"-{names[position]}"


def face_combination(face: str, along_normal: str, along_right: str, along_down: str) -> list[str]:
    """SQL text of the x, y and z components of a combination of a face's three axes."""
    frames = list(zip(NORMAL, RIGHT, DOWN))

    def component(frame, k):
        ((axis, name),) = [(a, t) for a, t in zip(frame, (along_normal, along_right, along_down)) if a[k]]
        return name if axis[k] > 0 else f"-{name}"
    return [_by_face(face, [component(f, k) for f in frames]) for k in range(3)]


def face_axis(face: str, axes, component: int) -> Column:
    return F.expr(_by_face(face, [f"{float(a[component])}D" for a in axes]))


def face_dot(face: str, axes, v=VEC) -> Column:
    """Dot product of a direction with the axis that belongs to ``face``."""
    return F.expr(_by_face(face, [_signed(a, v) for a in axes]))


def chart_angle(index, n) -> Column:
    return F.lit(QUARTER) * (F.lit(2.0) * _col(index) / F.lit(float(n)) - F.lit(1.0))


def nearest_index(value) -> Column:
    """Half-up nearest integer; differs from SQL ROUND for negative halves.

    A missing value gives -1, which is no node: the result is a join key and stays not NULL.
    """
    return F.coalesce(F.floor(_col(value) + F.lit(0.5)).cast("int"), F.lit(-1))


def clip(value, low, high) -> Column:
    """Limit a value to ``[low, high]``; NULL stays NULL (GREATEST and LEAST would skip it)."""
    value = _col(value)
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return F.when(value < low, low).when(value > high, high).otherwise(value)


def signed_sqrt(value) -> Column:
    value = _col(value)
    return F.signum(value) * F.sqrt(F.abs(value))


def signed_square(value) -> Column:
    value = _col(value)
    return F.signum(value) * value * value


def fold_lonlat(y, x, h: int) -> tuple[Column, Column]:
    """Bring any node index back on the sphere: rows reflect at a pole with a half turn."""
    y, x = _col(y), _col(x)
    turned = F.pmod(y, F.lit(2 * h))
    south = turned > h
    return (F.when(south, F.lit(2 * h) - turned).otherwise(turned),
            F.pmod(F.when(south, x + F.lit(h)).otherwise(x), F.lit(2 * h)))


def unwrap_east(west, east) -> Column:
    west, east = _col(west), _col(east)
    return F.when(east < west, east + F.lit(360.0)).otherwise(east)


def ground_spacing(radius: float, native_height: int) -> float:
    return math.pi * radius / native_height


def latitude_weight_pixels(row, h: int) -> Column:
    return F.cos(F.lit(math.pi) * ((_col(row) + F.lit(0.5)) / F.lit(float(h)) - F.lit(0.5)))


def latitude_weight_nodes(row, h: int) -> Column:
    return F.sin(F.lit(math.pi) * _col(row) / F.lit(float(h)))


def linear_overlap_weight(offset, size: int) -> Column:
    """Overlap confidence along one tile axis: 1 in the middle, 1e-3 at the rim."""
    mid = (size - 1) / 2
    slope = clip(F.abs(_col(offset) - F.lit(mid)) / F.lit(mid), 0.0, 1.0)
    return F.lit(1.0) - F.lit(1 - 1e-3) * slope


def tent_overlap_weight(offset, size: int) -> Column:
    distance = F.abs(F.lit(-1.0) + _col(offset) * F.lit(2.0 / (size - 1)))
    return F.greatest(F.lit(1e-3), F.lit(1.0) - distance)


OVERLAP_WEIGHTS = {"linear": linear_overlap_weight, "tent": tent_overlap_weight}


def node_key(face: str, y: str, x: str, n: int) -> tuple[Column, Column, Column]:
    """Integer lattice triple shared by all aliases of one physical cube node."""
    return tuple(F.expr(f"cast({c} as int)") for c in face_combination(
        face, str(n), f"(2 * {x} - {n})", f"(2 * {y} - {n})"))


def key_aliases(n: int, kx="kx", ky="ky", kz="kz") -> Column:
    """Array of every ``(face, y, x)`` that represents a physical node key.

    A narrow expression: one to three entries, no join against an alias table.
    """
    k = (kx, ky, kz)

    def along(axis):
        return _signed(axis, k)
    entries = ", ".join(
        f"if({along(NORMAL[f])} = {n}, named_struct('face', {f}, "
        f"'y', cast(({along(DOWN[f])} + {n}) / 2 as int), "
        f"'x', cast(({along(RIGHT[f])} + {n}) / 2 as int)), null)" for f in range(6))
    return F.expr(f"array_compact(array({entries}))")


def on_face_boundary(y, x, n: int) -> Column:
    return _col(y).isin(0, n) | _col(x).isin(0, n)


def add_direction(df: DataFrame, n: int, face="face", y="y", x="x", out=VEC,
                  normalize=True) -> DataFrame:
    """Direction of a (fractional or out-of-face) chart index.

    ``normalize=False`` gives the point on the unit cube instead of the unit sphere.
    """
    df = df.withColumns({"__a": F.expr(f"{QUARTER}D * (2D * {x} / {float(n)}D - 1D)"),
                         "__b": F.expr(f"{QUARTER}D * (2D * {y} / {float(n)}D - 1D)")})
    df = df.withColumns({f"__{c}{k}": F.expr(f"{fn}(__{k})") for k in "ab"
                         for c, fn in (("c", "cos"), ("s", "sin"))})
    df = df.withColumns({"__n": F.expr("__ca * __cb"), "__r": F.expr("__sa * __cb"), "__d": F.expr("__ca * __sb")})
    # Both extended angles at exactly 90 degrees leave nothing to scale; use the in-plane part.
    tiny = "__n * __n + __r * __r + __d * __d < 1e-24D"
    df = df.withColumns({"__r": F.expr(f"if({tiny}, __sa, __r)"), "__d": F.expr(f"if({tiny}, __sb, __d)"),
                         "__n": F.expr(f"if({tiny}, 0D, __n)")})
    df = df.withColumns({f"__q{k}": F.expr(c) for k, c in enumerate(
        face_combination(face, "__n", "__r", "__d"))})
    df = df.withColumn("__s", F.expr("sqrt(__q0 * __q0 + __q1 * __q1 + __q2 * __q2)" if normalize
                                     else "greatest(abs(__q0), abs(__q1), abs(__q2))"))
    df = df.withColumns({name: F.expr(f"__q{k} / __s") for k, name in enumerate(out)})
    return df.drop("__a", "__b", "__ca", "__sa", "__cb", "__sb", "__s", "__n", "__r", "__d",
                   *[f"__q{k}" for k in range(3)])


def add_lonlat_direction(df: DataFrame, lon="lon", lat="lat", out=VEC) -> DataFrame:
    df = df.withColumns({"__lo": F.radians(_col(lon)), "__la": F.radians(_col(lat))})
    df = df.withColumn("__cl", F.cos("__la"))
    return df.withColumns({out[0]: F.col("__cl") * F.cos("__lo"),
                           out[1]: F.col("__cl") * F.sin("__lo"),
                           out[2]: F.sin("__la")}).drop("__lo", "__la", "__cl")


def add_chart_indices(df: DataFrame, n: int, face="face", v=VEC, out=("cy", "cx")) -> DataFrame:
    """Fractional index of a direction on the chart of a given face (it must face it)."""
    df = df.withColumns({"__dn": face_dot(face, NORMAL, v), "__dr": face_dot(face, RIGHT, v),
                         "__dd": face_dot(face, DOWN, v)})
    return df.withColumns({name: F.expr(f"{float(n)}D * (1D + atan2({c}, __dn) / {QUARTER}D) / 2D")
                           for name, c in zip(out, ("__dd", "__dr"))}).drop("__dn", "__dr", "__dd")


def owning_face(v=VEC) -> Column:
    """Face of the largest absolute component; the first axis wins a tie, zero is positive."""
    x, y, z = v
    return F.expr(f"case when abs({x}) >= abs({y}) and abs({x}) >= abs({z}) then if({x} >= 0, 0, 2) "
                  f"when abs({y}) >= abs({z}) then if({y} >= 0, 1, 3) else if({z} >= 0, 4, 5) end")


def add_cube_coordinates(df: DataFrame, n: int, v=VEC, out=("face", "cy", "cx")) -> DataFrame:
    """Owning face and clipped fractional index of a direction."""
    df = df.withColumn(out[0], owning_face(v))
    df = add_chart_indices(df, n, out[0], v, (out[1], out[2]))
    return df.withColumns({c: clip(c, 0.0, float(n)) for c in out[1:]})


def add_area_weight(df: DataFrame, n: int, y="y", x="x", out="area") -> DataFrame:
    """Relative solid angle of one unit of chart index."""
    df = df.withColumns({"__ca": F.cos(chart_angle(x, n)), "__cb": F.cos(chart_angle(y, n)),
                         "__sb": F.sin(chart_angle(y, n))})
    return df.withColumn(out, F.expr("__ca * __cb / power(__cb * __cb + __ca * __ca * __sb * __sb, 1.5D)")
                         ).drop("__ca", "__cb", "__sb")


def add_lonlat_node(df: DataFrame, h: int, v=VEC, out=("ny", "nx")) -> DataFrame:
    """Fractional longitude/latitude node index of a direction of any length."""
    x, y, z = v
    df = df.withColumn("__z", F.expr(f"{z} / sqrt({x} * {x} + {y} * {y} + {z} * {z})"))
    return df.withColumns({
        out[0]: F.lit(float(h)) * (F.lit(0.5) - F.asin(clip("__z", -1.0, 1.0)) / F.lit(math.pi)),
        out[1]: F.expr(f"{float(h)}D * (atan2({y}, {x}) / {math.pi}D + 1D)")}).drop("__z")
