"""Comparison SQL for the registered queries, for any engine that reads the same tables."""
from __future__ import annotations

import math

from ..operators.distribution import smooth_waves
from .catalog import COEFFICIENTS, DRAFT, SEED
from .oracle_parts import (H, N, P, PH, TN, constrain, cube_coordinates, cube_direction, cube_lookup,
                           filter_lonlat, fold_x, fold_y, identify, key, lonlat_direction, lonlat_lookup,
                           lonlat_node, pmod, query, r, reduce_lonlat, sign_root)

SQL: dict[str, str] = {}
B = "CAST({} AS BIGINT)".format


# ----------------------------------------------------------------------------- projection
SQL["project_points_to_cube"] = query(
    ["dpoints", "dims"], f"SELECT point_id, {B('pf')} AS face, {r('cy')} AS cy, {r('cx')} AS cx FROM c",
    cube_coordinates("c", "dpoints", N))

SQL["points_per_face_tile"] = query(
    ["dpoints"], f"SELECT {B('pf')} AS face, {B('FLOOR(cy/32e0)')} AS \"by\", {B('FLOOR(cx/32e0)')} AS bx, COUNT(*) AS points "
    "FROM c GROUP BY 1, 2, 3", cube_coordinates("c", "dpoints", "256e0"))

AREA = ("COS({a})*COS({b})/POWER(COS({b})*COS({b})+COS({a})*COS({a})*SIN({b})*SIN({b}), 1.5e0)"
        .format(a="aa", b="bb"))
ANGLES = f"SELECT *, PI()/4*(2e0*x/{N}-1) AS aa, PI()/4*(2e0*y/{N}-1) AS bb FROM cube_raw"
SQL["cube_area_weight_by_face"] = query(
    ["cube_raw"], f"SELECT {B('face')} AS face, {r(f'SUM({AREA})')} AS area, {r(f'SUM({AREA}*v)/SUM({AREA})')} AS mean_v "
    "FROM g GROUP BY face", [("g", ANGLES)])

SQL["unique_node_count"] = query(
    ["cube_field_k"], "SELECT c AS aliases, COUNT(*) AS nodes FROM (SELECT COUNT(*) AS c FROM cube_field_k GROUP BY kx, ky, kz) "
    "GROUP BY c")

SQL["cube_node_directions"] = query(
    ["cube_raw"], f"SELECT {B('a.face')} AS face, {B('a.y')} AS y, {B('a.x')} AS x, {r('a.vx')} AS vx, {r('a.vy')} AS vy, {r('a.vz')} AS vz, "
    f"{r('b.vx')} AS ux, {r('b.vy')} AS uy, {r('b.vz')} AS uz FROM s a JOIN u b USING (face, y, x)",
    cube_direction("s", "cube_raw", N) + cube_direction("u", "cube_raw", N, unit=False))

SQL["expression_field"] = query(
    ["cube_nodes"], f"SELECT {B('face')} AS face, {B('y')} AS y, {B('x')} AS x, {r('vx*1000+vy*vz*907', 5)} AS v FROM s", cube_direction("s", "cube_nodes", N))
SQL["signed_root_round_trip"] = query(
    ["node_field"], f"SELECT y, x, {r(sign_root('v'))} AS root, {r('v')} AS square FROM node_field")

# ----------------------------------------------------------------------------- lookups
SQL["node_field_fold"] = query(
    ["node_field"], f"SELECT p.point_id, p.gy, p.gx, {r('f.v')} AS v FROM q p JOIN node_field f "
    f"ON f.y = {fold_y('p.gy', H)} AND f.x = {fold_x('p.gy', 'p.gx', H)}",
    [("q", f"SELECT event_id AS point_id, (event_id*31)%(4*{H})-{H} AS gy, (event_id*7)%(6*{H})-2*{H} AS gx FROM events")])

LL = ("ll", f"SELECT *, {lonlat_node(H)} FROM dpoints")
SQL["bilinear_points"] = query(["dpoints", "node_field"], f"SELECT point_id, {r('v_s')} AS v FROM s",
                               [LL] + lonlat_lookup("s", "ll", "node_field", H, ["v"]))
SQL["nearest_points"] = query(
    ["dpoints", "node_field"], f"SELECT p.point_id, {r('f.v')} AS v FROM p JOIN node_field f "
    f"ON f.y = {fold_y('p.iy', H)} AND f.x = {fold_x('p.iy', 'p.ix', H)}",
    [LL, ("p", f"SELECT point_id, {B('FLOOR(ny+0.5e0)')} AS iy, {B('FLOOR(nx+0.5e0)')} AS ix FROM ll")])

CC = cube_coordinates("c", "dpoints", N)
SQL["cube_bilinear_points"] = query(["dpoints", "cube_field"], f"SELECT point_id, {r('v_s')} AS v FROM s",
                                    CC + cube_lookup("s", "c", "cube_field", N, ["v"]))
SQL["cube_nearest_points"] = query(
    ["dpoints", "cube_field"], f"SELECT c.point_id, {r('f.v')} AS v FROM c JOIN cube_field f ON f.face = c.pf "
    "AND f.y = FLOOR(c.cy+0.5e0) AND f.x = FLOOR(c.cx+0.5e0)", CC)
SQL["cube_bilinear_hot_keys"] = SQL["cube_nearest_points"]


def chart_read(name, source, field, n, columns):
    """Rows (face, y, x) that may leave their face: direct or through the owning face."""
    inside = f"y BETWEEN 0 AND {n} AND x BETWEEN 0 AND {n}"
    return (cube_direction(f"{name}_d", source, n, unit=False)
            + [(f"{name}_o", f"SELECT *, y AS oy, x AS ox FROM {name}_d")]
            + cube_coordinates(f"{name}_c", f"{name}_o", n)
            + [(f"{name}_p", f"SELECT * EXCLUDE (pf, cy, cx), CASE WHEN {inside} THEN face ELSE pf END AS pf, "
                f"CASE WHEN {inside} THEN oy*1e0 ELSE cy END AS cy, CASE WHEN {inside} THEN ox*1e0 ELSE cx END AS cx FROM {name}_c")]
            + cube_lookup(name, f"{name}_p", field, n, columns))


SQL["cube_halo"] = query(
    ["cube_field"], f"SELECT {B('face')} AS face, {B('y')} AS y, {B('x')} AS x, {r('v_s')} AS v FROM s",
    [("e", f"SELECT f AS face, a-2 AS y, b-2 AS x FROM range(6) r(f), range({N}+5) s(a), range({N}+5) t(b)")]
    + chart_read("s", "e", "cube_field", N, ["v"]))

# ----------------------------------------------------------------------------- shared nodes, resampling
FYX = f"{B('face')} AS face, {B('y')} AS y, {B('x')} AS x"
SQL["cube_identify_mean"] = query(["cube_field"], f"SELECT {FYX}, {r('v')} AS v FROM cube_field")
SQL["cube_identify_owner"] = query(
    ["cube_field_k"], f"SELECT {FYX}, {r('v')} AS v FROM o",
    [("o", "SELECT face, y, x, FIRST_VALUE(v) OVER (PARTITION BY kx, ky, kz ORDER BY face, y, x) AS v FROM cube_field_k")])


def resized(name, field, n_old, n_new):
    """Fine nodes inside their own face, aliases averaged."""
    return ([(f"{name}_n", f"SELECT f AS face, a AS y, b AS x, f AS pf, a*1e0*{n_old}/({n_new}) AS cy, b*1e0*{n_old}/({n_new}) AS cx "
              f"FROM range(6) r(f), range(CAST({n_new} AS BIGINT)+1) s(a), range(CAST({n_new} AS BIGINT)+1) t(b)")]
            + cube_lookup(f"{name}_s", f"{name}_n", field, n_old, ["v"])
            + [(f"{name}_v", f"SELECT face, y, x, v_s AS v FROM {name}_s")]
            + identify(name, f"{name}_v", f"CAST({n_new} AS BIGINT)", ["v"]))


SQL["cube_bilinear_resample"] = query(["cube_field"], f"SELECT {FYX}, {r('v')} AS v FROM s",
                                      resized("s", "cube_field", N, f"(3*{N}/2)"))
SQL["lonlat_resample"] = query(
    ["node_field"], f"SELECT y, x, {r('v_s')} AS v FROM s",
    [("p", f"SELECT a AS y, b AS x, a*2e0/3 AS ny, b*2e0/3 AS nx FROM range(CAST(3*{H}/2 AS BIGINT)+1) s(a), range(3*{H}) t(b)")]
    + lonlat_lookup("s", "p", "node_field", H, ["v"]))
NODE_DIR = (f"SELECT y, x, CASE WHEN y IN (0, {H}) THEN 0 ELSE SIN(PI()*y/{H})*COS(-PI()+PI()*x/{H}) END AS vx, "
            f"CASE WHEN y IN (0, {H}) THEN 0 ELSE SIN(PI()*y/{H})*SIN(-PI()+PI()*x/{H}) END AS vy, "
            f"CASE WHEN y = 0 THEN 1 WHEN y = {H} THEN -1 ELSE COS(PI()*y/{H}) END AS vz FROM lonlat_nodes")
SQL["cube_to_lonlat"] = query(["lonlat_nodes", "cube_field"], f"SELECT y, x, {r('v_s')} AS v FROM s",
                              [("d", NODE_DIR)] + cube_coordinates("c", "d", N) + cube_lookup("s", "c", "cube_field", N, ["v"]))

# ----------------------------------------------------------------------------- regions and exports
DENSITY = "GREATEST(width*180e0/(CASE WHEN east<west THEN east+360 ELSE east END-west), height*180e0/(north-south))"
ERROR = f"CASE WHEN NOT (south < north AND north <= 90) THEN 'bounds_order' WHEN {DENSITY} > 40+1e-8 THEN 'exceeds_native_detail' END"
SQL["region_validate"] = query(["requests"], f"SELECT request_id, {ERROR} AS error FROM requests")
_M = "request_id % 7"
SQL["region_validate_codes"] = query(
    ["requests"], f"SELECT request_id, CASE WHEN {_M} = 0 THEN 'bounds_not_finite' WHEN {_M} = 1 THEN 'longitude_out_of_range' WHEN NOT (south < north AND north <= 90) THEN 'bounds_order' "
    f"WHEN {_M} = 2 THEN 'size_not_positive' WHEN {_M} = 3 THEN 'exceeds_native_detail' WHEN {DENSITY} > 40+1e-8 THEN 'exceeds_native_detail' END AS error FROM requests")
SQL["region_guide_height"] = query(
    ["requests"], f"SELECT request_id, {B('GREATEST(4, 4*CEIL(128*' + DENSITY + '/1024e0))')} AS guide_height FROM requests WHERE south < north")
ROOTED = ("f", f"SELECT face, y, x, SIGN(v)*POWER({sign_root('v')}, 2) AS v FROM cube_field")
SQL["region_query_multi"] = query(
    ["region_d", "cube_field"], f"SELECT request_id, row_i, col_i, {r('v_s')} AS v FROM s",
    [ROOTED] + cube_coordinates("c", "region_d", N) + cube_lookup("s", "c", "f", N, ["v"]))
SQL["region_query_stored"] = query(
    ["region_d", "cube_field"], f"SELECT request_id, row_i, col_i, {r('v_s', 3)} AS v FROM s",
    [("f", "SELECT face, y, x, CAST(CAST(v AS FLOAT) AS DOUBLE) AS v FROM cube_field")]
    + cube_coordinates("c", "region_d", N) + cube_lookup("s", "c", "f", N, ["v"]))
REGION_LL = [("rp", f"SELECT *, {lonlat_node(H)} FROM region_d")] + lonlat_lookup("s", "rp", "node_field", H, ["v"])
SQL["region_query_lonlat"] = query(
    ["region_d", "node_field"], f"SELECT request_id, row_i, col_i, {r('lon')} AS lon, {r('lat')} AS lat, {r('v_s')} AS v FROM s", REGION_LL)

NODE32 = ("f", "SELECT y, x, CAST(CAST(v AS FLOAT) AS DOUBLE) AS v FROM node_field")
SQL["region_query_lonlat_stored"] = query(
    ["region_d", "node_field"], f"SELECT request_id, row_i, col_i, {r('v_s', 3)} AS v FROM s",
    [NODE32, ("rp", f"SELECT *, {lonlat_node(H)} FROM region_d")] + lonlat_lookup("s", "rp", "f", H, ["v"]))

WIN = (f"SELECT i AS row_i, j AS col_i, i+{H}/2-4+0.5e0 AS ny, j+2*{H}-8+0.5e0 AS nx FROM range(8) a(i), range(16) b(j)")
SQL["export_window_dateline"] = query(
    ["node_field"], f"SELECT row_i, col_i, {r('v_s')} AS v, {r(f'-180+nx*180e0/{H}')} AS lon, {r(f'90-ny*180e0/{H}')} AS lat FROM s",
    [("p", WIN)] + lonlat_lookup("s", "p", "node_field", H, ["v"]))
SQL["export_global_half"] = query(
    ["node_field"], f"SELECT row_i, col_i, {r('v_s')} AS v FROM s",
    [("p", f"SELECT i AS row_i, j AS col_i, (i+0.5e0)*2 AS ny, (j+0.5e0)*2 AS nx FROM range(CAST({H}/2 AS BIGINT)) a(i), range({H}) b(j)")]
    + lonlat_lookup("s", "p", "node_field", H, ["v"]))
SQL["export_stored"] = query(
    ["node_field"], f"SELECT grid, row_i, col_i, {r('v_s', 3)} AS v, {r(f'-180+nx*180e0/{H}', 3)} AS lon, {r(f'90-ny*180e0/{H}', 3)} AS lat FROM s",
    [NODE32, ("p", f"SELECT 'window' AS grid, * FROM ({WIN}) UNION ALL SELECT 'global', i, j, (i+0.5e0)*2, (j+0.5e0)*2 "
              f"FROM range(CAST({H}/2 AS BIGINT)) a(i), range({H}) b(j)")] + lonlat_lookup("s", "p", "f", H, ["v"]))
_Z = " + ".join(f"((block_y >> {k}) & 1) * {2 ** (2 * k + 1)} + ((block_x >> {k}) & 1) * {2 ** (2 * k)}" for k in range(12))
SQL["block_damage"] = query(
    ["cube_field"], "SELECT 'all' AS \"read\", face, block_y, block_x FROM b UNION ALL SELECT 'fourth', face, block_y, block_x FROM b WHERE z % 4 = 0",
    [("k", f"SELECT DISTINCT CAST(face AS BIGINT) AS face, CAST(LEAST(FLOOR(y/8e0), CEIL({N}/8e0)-1) AS BIGINT) AS block_y, "
      f"CAST(LEAST(FLOOR(x/8e0), CEIL({N}/8e0)-1) AS BIGINT) AS block_x FROM cube_field"),
     ("b", f"SELECT *, {_Z} AS z FROM k WHERE (block_y*5 + block_x*3 + face) % 3 = 0 AND face % 2 = 1")])
SQL["export_saved"] = SQL["export_window_dateline"]
SQL["window_equals_global"] = query(
    ["node_field"], "SELECT COUNT(*) AS pixels, COUNT(*) FILTER (ROUND(s.v_s, 6) IS DISTINCT FROM ROUND(t.v_s, 6)) AS different FROM s "
    f"LEFT JOIN t ON t.row_i = s.row_i+{H}/2-4 AND t.col_i = (s.col_i+2*{H}-8) % (2*{H})",
    [("p", WIN), ("w", f"SELECT i AS row_i, j AS col_i, i+0.5e0 AS ny, j+0.5e0 AS nx FROM range({H}) a(i), range(2*{H}) b(j)")]
    + lonlat_lookup("s", "p", "node_field", H, ["v"]) + lonlat_lookup("t", "w", "node_field", H, ["v"]))
HALF_PX = (f"SELECT *, {lonlat_direction()} FROM (SELECT request_id, k AS row_i, j AS col_i, "
           "west+(j+0.5e0)*(CASE WHEN east<west THEN east+360 ELSE east END-west)/width AS lon, "
           "CASE WHEN k = 0 THEN north-0.5e0*(north-(south+north)/2) ELSE (south+north)/2-0.5e0*((south+north)/2-south) END AS lat "
           "FROM requests, range(4) b(j), range(2) c(k) WHERE south < north)")
SQL["sub_region_equals_region"] = query(
    ["region_d", "node_field", "requests"],
    "SELECT COUNT(*) AS different FROM s FULL JOIN t USING (request_id, row_i, col_i) "
    "WHERE ROUND(s.v_s, 6) IS DISTINCT FROM ROUND(t.v_s, 6)",
    REGION_LL + [("hp", HALF_PX), ("hq", f"SELECT *, {lonlat_node(H)} FROM hp")]
    + lonlat_lookup("t", "hq", "node_field", H, ["v"]))

# ----------------------------------------------------------------------------- rasters and guides
SQL["raster_contract"] = query(
    ["pixels"], "SELECT band, CAST(COUNT(*) AS BIGINT) AS pixels, CAST(COUNT(*)-COUNT(DISTINCT (row_i, col_i)) AS BIGINT) AS duplicates, "
    f"COUNT(*) FILTER (row_i NOT BETWEEN 0 AND {PH}-1 OR col_i NOT BETWEEN 0 AND 2*{PH}-1) AS outside, "
    "COUNT(*) FILTER (band IN ('precipitation', 'temperature_std') AND w < 0) AS negative, "
    "COUNT(*) FILTER (ABS(w) > 3.4028234663852886e38/4) AS too_large, COUNT(w) AS valid FROM "
    "(SELECT band, row_i, col_i, CASE WHEN band = 'temperature_std' THEN 100e0 ELSE 1e0 END*(2e0*v-120) AS w FROM wrong) GROUP BY band",
    [("wrong", f"SELECT 'heightmap' AS band, row_i, col_i, v FROM pixels UNION ALL SELECT 'precipitation', row_i-1, col_i, v FROM pixels "
               f"UNION ALL SELECT 'temperature_std', row_i, col_i//2, v*5e34 FROM pixels")])


def corner_nodes(name, source, columns):
    """Gather four pixels per inner node; poles average their pixel row."""
    w = f"(2*{PH})"
    cells = f"SELECT a AS y, b AS x FROM range({PH}+1) s(a), range(2*{PH}) t(b)"
    four = ", ".join(f"(COALESCE(a.{c},0)+COALESCE(b.{c},0)+COALESCE(c.{c},0)+COALESCE(d.{c},0))/4e0 AS {c}" for c in columns)
    joins = " ".join(f"LEFT JOIN {source} {k} ON {k}.row_i = n.y-{dy} AND {k}.col_i = {pmod(f'n.x-{dx}', w)}"
                     for k, dy, dx in (("a", 1, 0), ("b", 0, 0), ("c", 1, 1), ("d", 0, 1)))
    poles = ", ".join(f"COALESCE((SELECT SUM({c}) FROM {source} p WHERE p.row_i = CASE WHEN n.y = 0 THEN 0 ELSE {PH}-1 END), 0)/{w}*1e0 AS {c}"
                      for c in columns)
    return [(f"{name}_n", cells),
            (name, f"SELECT n.y, n.x, {four} FROM {name}_n n {joins} WHERE n.y NOT IN (0, {PH}) UNION ALL "
                   f"SELECT n.y, n.x, {poles} FROM {name}_n n WHERE n.y IN (0, {PH})")]


PREMULT = ("pm", "SELECT row_i, col_i, COALESCE(v, 0e0) AS value, CASE WHEN v IS NULL THEN 0e0 ELSE 1e0 END AS coverage FROM pixels")
CORNER = [PREMULT] + corner_nodes("cn", "pm", ["value", "coverage"])
SQL["raster_corner_mean"] = query(["pixels"], f"SELECT y, x, {r('value')} AS value, {r('coverage')} AS coverage FROM cn", CORNER)

PREMULT_ABS = ("pa", PREMULT[1].replace("COALESCE(v, 0e0)", "COALESCE(ABS(v), 0e0)"))
SQL["guide_from_files"] = query(
    ["pixels"], " UNION ALL ".join(f"SELECT '{band}' AS band, y, x, {r('value', 5)} AS value, {r('coverage', 5)} AS coverage FROM {k}"
                                   for band, k in (("heightmap", "cn"), ("precipitation", "pn"))),
    CORNER + [PREMULT_ABS] + corner_nodes("pn", "pa", ["value", "coverage"]))

GREY = "CASE WHEN bits = 16 THEN code/65535e0 ELSE code/255e0 END"
BLACK, WHITE = DRAFT["black_metres"], DRAFT["white_metres"]
DRAFT_PX = ("dp", f"SELECT row_i, col_i, ({BLACK}+({WHITE}-({BLACK}))*({GREY}))*alpha AS value, alpha AS coverage, "
                  "CASE WHEN code > 0 THEN alpha ELSE 0e0 END AS land FROM bright")
SQL["draft_corner_mean"] = query(
    ["bright"], f"SELECT y, x, {r('value')} AS value, {r('coverage')} AS coverage, {r('land')} AS land FROM cn",
    [DRAFT_PX] + corner_nodes("cn", "dp", ["value", "coverage", "land"]))
SQL["draft_legacy_mapping"] = query(
    ["bright"], f"SELECT row_i, col_i, {r(f'(CASE WHEN code = 0 THEN -2000e0 ELSE {WHITE}*({GREY}) END)*alpha')} AS value, {r('alpha')} AS coverage, "
    f"{r('CASE WHEN code > 0 THEN alpha ELSE 0e0 END')} AS land FROM bright")


def footprint(name, raster, columns):
    """64 samples under every cube node, weighted by solid angle, aliases averaged."""
    sub = ("SELECT n.face, n.y, n.x, n.y+(i+0.5e0)/8-0.5e0 AS sy, n.x+(j+0.5e0)/8-0.5e0 AS sx FROM cube_nodes n, range(8) a(i), range(8) b(j)")
    area = (f"SELECT *, COS(aa)*COS(bb)/POWER(COS(bb)*COS(bb)+COS(aa)*COS(aa)*SIN(bb)*SIN(bb), 1.5e0) AS w FROM "
            f"(SELECT *, PI()/4*(2e0*sx/{N}-1) AS aa, PI()/4*(2e0*sy/{N}-1) AS bb FROM {name}_u)")
    means = ", ".join(f"SUM(w*{c}_s)/SUM(w) AS {c}" for c in columns)
    return ([(f"{name}_u", sub), (f"{name}_w", f"SELECT * EXCLUDE (aa, bb) FROM ({area})")]
            + cube_direction(f"{name}_d", f"{name}_w", N, y="sy", x="sx", unit=False)
            + [(f"{name}_l", f"SELECT *, {lonlat_node(PH)} FROM {name}_d")]
            + lonlat_lookup(f"{name}_s", f"{name}_l", raster, PH, columns)
            + [(f"{name}_m", f"SELECT face, y, x, {means} FROM {name}_s GROUP BY face, y, x")]
            + identify(name, f"{name}_m", N, columns))


FOOT = CORNER + footprint("ft", "cn", ["value", "coverage"])
SQL["raster_to_cube"] = query(["pixels", "cube_nodes"], f"SELECT {FYX}, {r('value')} AS value, {r('coverage')} AS coverage FROM ft", FOOT)
MIX = "ft.value + (1-LEAST(1, GREATEST(0, ft.coverage)))*f.v"
SQL["guide_fill"] = query(
    ["pixels", "cube_nodes", "cube_field"], f"SELECT {FYX}, {r('heightmap')} AS heightmap FROM gi",
    FOOT + [("mx", f"SELECT f.face, f.y, f.x, {sign_root(f'({MIX})')} AS heightmap FROM cube_field f JOIN ft USING (face, y, x)")]
    + identify("gi", "mx", N, ["heightmap"]))
SQL["draft_fill"] = query(
    ["bright", "cube_nodes", "cube_field"], f"SELECT {FYX}, {r('heightmap')} AS heightmap FROM gi",
    [DRAFT_PX] + corner_nodes("cn", "dp", ["value", "coverage"]) + footprint("ft", "cn", ["value", "coverage"])
    + [("mx", f"SELECT f.face, f.y, f.x, {sign_root('(ft.value + (1-ft.coverage)*f.v)')} AS heightmap FROM cube_field f JOIN ft USING (face, y, x)")]
    + identify("gi", "mx", N, ["heightmap"]))

CA, CB, C1, C99 = (COEFFICIENTS[k] for k in ("a_temp_std", "b_temp_std", "temp_std_p1", "temp_std_p99"))
SQL["climate_finalise"] = query(
    ["climate_nodes"], f"SELECT y, x, {r('elev')} AS elev, {r('t')} AS temp, "
    f"{r(f'GREATEST((temp_std100-{C1})/({C99}-{C1})*({C99}-base)+base+({CA}*t+{CB}), 20)')} AS temp_std100, {r('precip')} AS precip, "
    f"{r('precip_cv*GREATEST(0, (185-0.04111e0*precip)/185)')} AS precip_cv FROM b",
    [("a", "SELECT * EXCLUDE (temp), LEAST(40, GREATEST(-10, temp+LEAST(-4e0, GREATEST(-9.8e0, -6.5e0+0.0015e0*precip))/1000*GREATEST(0, elev))) AS t0 FROM climate_nodes"),
     ("a2", "SELECT *, CASE WHEN t0 > 20 THEN t0 ELSE (t0-20)*1.25e0+20 END AS t FROM a"),
     ("b", f"SELECT *, GREATEST({C1}, -({CA}*t+{CB})) AS base FROM a2")])

SMOOTH = "(" + " + ".join(f"SIN({a!r}::DOUBLE*vx + {b!r}::DOUBLE*vy + {c!r}::DOUBLE*vz + {p!r}::DOUBLE)"
                          for a, b, c, p in smooth_waves(SEED)) + ")/SQRT(6e0)"
SQL["smooth_guide_at_points"] = query(["dpoints"], f"SELECT point_id, {r('f')} AS f, {r('2200*f-900')} AS elev FROM "
                                      f"(SELECT point_id, {SMOOTH} AS f FROM dpoints)")

SQL["smooth_guide_channels"] = query(
    ["dpoints"], f"SELECT point_id, {r('2200*f-900')} AS heightmap, {r('28-48*vz*vz')} AS temperature, {r('350+200*vz*vz')} AS temperature_std, "
    f"{r('1200+400*TANH(f)')} AS precipitation, {r('55+10*TANH(f)')} AS precipitation_cv FROM (SELECT *, {SMOOTH} AS f FROM dpoints)")
SQL["channel_rescale"] = query(
    ["climate_nodes"], f"SELECT y, x, {r('(temp-12.5e0)/4')} AS standard, {r('(precip-700)/35e0*-31.4e0+38.6e0')} AS rescaled, "
    f"{r('temp_std100-precip_cv')} AS rest, {r(f'PI()*6371e0/{H}')} AS spacing_km FROM climate_nodes")

# ----------------------------------------------------------------------------- tiles
SQL["tile_context_lonlat"] = query(
    ["node_field"], f"SELECT {B('ty')} AS ty, {B('tx')} AS tx, {r('SUM(v)', 4)} AS total, {r('MAX(v) FILTER (k = 0)', 4)} AS first, "
    f"{r('MAX(v) FILTER (k = 63)', 4)} AS last FROM (SELECT m.*, f.v FROM m JOIN node_field f USING (y, x)) GROUP BY ty, tx",
    [("o", f"SELECT -4+4*a AS ty, 4*b AS tx, k, -4+4*a+k//8 AS y0, 4*b+k%8 AS x0 FROM range(CAST({H}//4 AS BIGINT)+2) r(a), "
           f"range(CAST({H}//2 AS BIGINT)) s(b), range(64) t(k)"),
     ("m", f"SELECT ty, tx, k, {fold_y('y0', H)} AS y, {fold_x('y0', 'x0', H)} AS x FROM o")])
FTT = f"{B('face')} AS face, {B('ty')} AS ty, {B('tx')} AS tx"
PLAN = ("pl", f"SELECT f AS face, -4+4*a AS ty, -4+4*b AS tx FROM range(6) r(f), range({P}) s(a), range({P}) t(b)")
SQL["tile_plan"] = query(
    ["tiles"], f"SELECT {B('p.face')} AS face, {B('p.ty')} AS ty, {B('p.tx')} AS tx, COUNT(t.vec_id) AS predictions "
    "FROM pl p LEFT JOIN tiles t ON t.face=p.face AND t.ty=p.ty AND t.tx=p.tx GROUP BY 1, 2, 3", [PLAN])

EST_N = "4096e0"
EST = ([("s0", "SELECT request_id, west+3e-3 AS west, north-2e-3 AS north, CASE WHEN east<west THEN east+360 ELSE east END-3e-3 AS east, "
               "south+2e-3 AS south, width, height FROM requests WHERE south < north"),
        ("s1", f"SELECT *, LEAST(width, GREATEST(2, CEIL(RADIANS(east-west)*{EST_N}/64)+1)) AS nc, "
               f"LEAST(height, GREATEST(2, CEIL(RADIANS(north-south)*{EST_N}/64)+1)) AS nr FROM s0"),
        ("s2", "SELECT *, i AS ri, j AS ci FROM s1, range(2) a(i), range(4) b(j) WHERE i < nr AND j < nc"),
        ("s3", "SELECT request_id, west+(0.5e0+ci*(width-1)/(nc-1))*(east-west)/width AS lon, "
               "north-(0.5e0+ri*(height-1)/(nr-1))*(north-south)/height AS lat FROM s2"),
        ("s4", f"SELECT request_id, {lonlat_direction()} FROM s3")]
       + cube_coordinates("s5", "s4", EST_N)
       + [("s6", "SELECT request_id, pf AS face, cy+(a.i-1)*384 AS hy, cx+(b.j-1)*384 AS hx FROM s5, range(3) a(i), range(3) b(j)")]
       + cube_direction("s7", "s6", EST_N, y="hy", x="hx", unit=False)
       + [("s8", "SELECT request_id, vx, vy, vz FROM s7")] + cube_coordinates("s9", "s8", EST_N)
       + [("t0", "SELECT DISTINCT request_id, pf, FLOOR(cy/384e0)-i AS py, FLOOR(cx/384e0)-j AS px FROM s9, range(2) a(i), range(2) b(j)"),
          ("est", f"SELECT request_id, COUNT(*) AS tiles FROM t0 WHERE py*384 <= {EST_N} AND px*384 <= {EST_N} GROUP BY request_id")])
SQL["tile_cost_estimate"] = query(["requests"], "SELECT request_id, tiles FROM est", EST)
SQL["tile_cost_bitmap"] = SQL["tile_cost_estimate"]
SQL["tile_cost_sketch"] = query(["requests"], "SELECT request_id, TRUE AS within FROM est", EST)
SQL["tile_cost_stopped"] = query(
    ["requests"], "SELECT e.request_id, LEAST(e.tiles, 13) AS tiles, e.tiles > 12 AS exceeds, CAST(CASE WHEN COALESCE(f.tiles, 0) > 12 THEN 1 ELSE nr END AS BIGINT) AS sample_rows "
    "FROM est e JOIN s1 USING (request_id) LEFT JOIN top f USING (request_id)",
    EST + [("u4", f"SELECT request_id, {lonlat_direction()} FROM (SELECT request_id, west+(0.5e0+ci*(width-1)/(nc-1))*(east-west)/width AS lon, "
                  "north-0.5e0*(north-south)/height AS lat FROM s2 WHERE ri = 0)")]
    + cube_coordinates("u5", "u4", EST_N)
    + [("u6", "SELECT request_id, pf AS face, cy+(a.i-1)*384 AS hy, cx+(b.j-1)*384 AS hx FROM u5, range(3) a(i), range(3) b(j)")]
    + cube_direction("u7", "u6", EST_N, y="hy", x="hx", unit=False)
    + [("u8", "SELECT request_id, vx, vy, vz FROM u7")] + cube_coordinates("u9", "u8", EST_N)
    + [("tops", f"SELECT DISTINCT s9.request_id, s9.pf, FLOOR(s9.cy/384e0)-i AS py, FLOOR(s9.cx/384e0)-j AS px FROM u9 s9, range(2) a(i), range(2) b(j)"),
           ("top", f"SELECT request_id, COUNT(*) AS tiles FROM tops WHERE py*384 <= {EST_N} AND px*384 <= {EST_N} GROUP BY request_id")])
SQL["tile_cost_guard"] = query(
    ["requests"], "SELECT q.request_id, COALESCE(e.tiles, 0) AS tiles, CASE WHEN NOT (q.south < q.north) THEN 'bounds_order' WHEN e.tiles > 12 THEN 'too_many_tiles' END AS error "
    "FROM requests q LEFT JOIN est e USING (request_id)", EST)
SQL["tile_round_trip"] = "SELECT COUNT(*) AS tiles, COUNT(*) AS same FROM embeddings"

TENT = lambda k: f"GREATEST(1e-3, 1-ABS(-1+{k}*2e0/7))"
LINEAR = lambda k: f"(1-(1-1e-3)*LEAST(1, GREATEST(0, ABS({k}-3.5e0)/3.5e0)))"


def blended(name, cells, n, weight, shared):
    inside = f"y BETWEEN 0 AND {n} AND x BETWEEN 0 AND {n}"
    w = f"{weight('dy')}*{weight('dx')}"
    if shared:
        return [(f"{name}_k", f"SELECT *, {key(n)} FROM {cells} WHERE {inside}"),
                (f"{name}_g", f"SELECT kx, ky, kz, SUM({w}*v)/SUM({w}) AS v FROM {name}_k GROUP BY kx, ky, kz"),
                (name, f"SELECT DISTINCT k.face, k.y, k.x, g.v FROM {name}_k k JOIN {name}_g g USING (kx, ky, kz)")]
    return [(f"{name}_g", f"SELECT face, y, x, SUM({w}*v)/SUM({w}) AS v FROM {cells} WHERE {inside} GROUP BY face, y, x")] + identify(
        name, f"{name}_g", n, ["v"])


SQL["tile_blend_cube"] = query(["tile_cells"], f"SELECT {FYX}, {r('v')} AS \"values\" FROM b", blended("b", "tile_cells", TN, TENT, False))
SQL["tile_blend_shared"] = query(["tile_cells"], f"SELECT {FYX}, {r('v')} AS \"values\" FROM b", blended("b", "tile_cells", TN, LINEAR, True))
CH = f"(4*({P}-1))"
SQL["tile_blend_lonlat"] = query(
    ["tile_cells"], f"SELECT {B('y')} AS y, {B('x')} AS x, {r('v')} AS \"values\" FROM k",
    [("m", f"SELECT dy, dx, v, y, x+4+CASE WHEN face % 2 = 1 THEN {CH} ELSE 0 END AS x FROM tile_cells"),
     ("f", f"SELECT dy, dx, v, {fold_y('y', CH)} AS y, {fold_x('y', 'x', CH)} AS x FROM m"),
     ("g", f"SELECT y, x, SUM({TENT('dy')}*{TENT('dx')}*v)/SUM({TENT('dy')}*{TENT('dx')}) AS v FROM f GROUP BY y, x")]
    + constrain("k", "g", CH, ["v"]))
NEAR_T = cube_coordinates("c", "dpoints", TN) + [("nn", f"SELECT DISTINCT pf AS face, {B('FLOOR(cy+0.5e0)')} AS y, {B('FLOOR(cx+0.5e0)')} AS x FROM c")]
SQL["tile_blend_at_nodes"] = query(
    ["tile_cells", "dpoints"], f"SELECT {FYX}, {r('v')} AS \"values\" FROM b JOIN nn USING (face, y, x)",
    blended("b", "tile_cells", TN, LINEAR, True) + NEAR_T)
SQL["tile_dependencies"] = query(
    ["dpoints", "tiles"], "SELECT DISTINCT CAST(a.face AS BIGINT) AS face, CAST(p.ty AS BIGINT) AS ty, CAST(p.tx AS BIGINT) AS tx FROM nk k JOIN ak a USING (kx, ky, kz) "
    "JOIN pl p ON p.face = a.face AND a.y BETWEEN p.ty AND p.ty+7 AND a.x BETWEEN p.tx AND p.tx+7",
    cube_coordinates("c", "dpoints", TN)
    + [("nn", f"SELECT DISTINCT pf AS face, {B('FLOOR(cy+0.5e0)')} AS y, {B('FLOOR(cx+0.5e0)')} AS x FROM c"),
       ("nk", f"SELECT DISTINCT kx, ky, kz FROM (SELECT {key(TN)} FROM nn)"),
       ("an", f"SELECT f AS face, a AS y, b AS x FROM range(6) r(f), range({TN}+1) s(a), range({TN}+1) t(b)"),
       ("ak", f"SELECT *, {key(TN)} FROM an"), PLAN])
SQL["tile_missing"] = query(["tiles"], f"SELECT {FTT} FROM pl2 ANTI JOIN tiles USING (face, ty, tx)", [
    ("pl2", f"SELECT f AS face, -4+4*a AS ty, -4+4*b AS tx FROM range(6) r(f), range(CAST(2*{TN}//4 AS BIGINT)+2) s(a), range(CAST(2*{TN}//4 AS BIGINT)+2) t(b)")])


def context_cells(name, n, size, stride, read):
    """All cells of all tiles with their context value."""
    first = -((size - 1) // stride) * stride
    count = f"CAST(FLOOR(({n}-({first}))/{stride}) AS BIGINT)+1"
    cells = (f"SELECT f AS face, {first}+{stride}*a AS ty, {first}+{stride}*b AS tx, k // {size} AS dy, k % {size} AS dx, "
             f"{first}+{stride}*a + k // {size} AS y, {first}+{stride}*b + k % {size} AS x FROM range(6) r(f), range({count}) s(a), range({count}) t(b), range({size * size}) u(k)")
    return [(f"{name}_e", cells)] + read(name, f"{name}_e", n)


def nearest_read(name, source, n, field="cube_field", columns="f.v"):
    inside = f"y BETWEEN 0 AND {n} AND x BETWEEN 0 AND {n}"
    return (cube_direction(f"{name}_d", source, n, unit=False) + cube_coordinates(f"{name}_c", f"{name}_d", n)
            + [(name, f"SELECT q.* EXCLUDE (vx, vy, vz, pf, cy, cx), {columns} FROM {name}_c q JOIN {field} f ON "
                f"f.face = CASE WHEN q.{inside.replace('AND x', 'AND q.x')} THEN q.face ELSE q.pf END AND "
                f"f.y = CASE WHEN q.{inside.replace('AND x', 'AND q.x')} THEN q.y ELSE FLOOR(q.cy+0.5e0) END AND "
                f"f.x = CASE WHEN q.{inside.replace('AND x', 'AND q.x')} THEN q.x ELSE FLOOR(q.cx+0.5e0) END")])


STENCIL = (context_cells("cx0", N, 8, 4, nearest_read)
           + [("st", "SELECT a.face, a.ty, a.tx, a.dy, a.dx, a.y, a.x, 0.25e0*(a.v+b.v+c.v)/3 AS v FROM cx0 a "
               "JOIN cx0 b ON b.face=a.face AND b.ty=a.ty AND b.tx=a.tx AND b.dy=a.dy AND b.dx=(a.dx+7)%8 "
               "JOIN cx0 c ON c.face=a.face AND c.ty=a.ty AND c.tx=a.tx AND c.dx=a.dx AND c.dy=(a.dy+7)%8")])
SQL["tile_score_stencil"] = query(["cube_field"], f"SELECT {FYX}, {r('v')} AS \"values\" FROM b", STENCIL + blended("b", "st", N, LINEAR, True))
SQL["tile_score_blocks"] = SQL["tile_score_stencil"]
SQL["tile_score_columns"] = SQL["tile_score_stencil"]

CROP_CELLS = (f"SELECT f AS face, -8+8*a AS ty, -8+8*b AS tx, k, (-8+8*a)/4e0-1+k//4 AS y, (-8+8*b)/4e0-1+k%4 AS x "
              f"FROM range(6) r(f), range(CAST((4*{N}+8)/8 AS BIGINT)+1) s(a), range(CAST((4*{N}+8)/8 AS BIGINT)+1) t(b), range(16) u(k)")
SQL["tile_crop_context"] = query(["cube_field"], f"SELECT {FTT}, {B('k')} AS k, {r('v_s', 5)} AS v FROM s",
                                 [("e", CROP_CELLS)] + chart_read("s", "e", "cube_field", N, ["v"]))
REP_CELLS = (f"SELECT f AS face, -8+8*a AS ty, -8+8*b AS tx, k, -2+2*a+(k//16)//4 AS y, -2+2*b+(k%16)//4 AS x "
             f"FROM range(6) r(f), range(CAST((4*{N}+8)/8 AS BIGINT)+1) s(a), range(CAST((4*{N}+8)/8 AS BIGINT)+1) t(b), range(256) u(k)")
SQL["tile_repeat_context"] = query(["cube_field"], f"SELECT {FTT}, {B('k')} AS k, {r('v', 5)} AS v FROM s",
                                   [("e", REP_CELLS)] + nearest_read("s", "e", N))

# ----------------------------------------------------------------------------- filters
SQL["filter_gauss_lonlat"] = query(["node_field"], f"SELECT y, x, {r('v', 5)} AS v FROM k",
                                   filter_lonlat("g", "node_field", H) + constrain("k", "g", H, ["v"]))
LOW = f"({H}//4)"
RED = reduce_lonlat("g", "node_field", H, 4) + constrain("k", "g", LOW, ["v"])
SQL["filter_triangular_reduce"] = query(["node_field"], f"SELECT {B('y')} AS y, {B('x')} AS x, {r('v', 5)} AS v FROM k", RED)


def add_low(name, low):
    return ([(f"{name}_p", "SELECT y, x, v, y/4e0 AS ny, x/4e0 AS nx FROM node_field")] + lonlat_lookup(f"{name}_s", f"{name}_p", low, LOW, ["v"])
            + [(name, f"SELECT y, x, v+v_s AS v FROM {name}_s")])


SQL["laplacian_merge_lonlat"] = query(
    ["node_field"], f"SELECT y, x, {r('v', 5)} AS v FROM z",
    RED + add_low("pv", "k") + reduce_lonlat("rg", "pv", H, 4) + constrain("rk", "rg", LOW, ["v"])
    + filter_lonlat("bg", "rk", LOW) + constrain("bk", "bg", LOW, ["v"]) + add_low("fin", "bk") + constrain("z", "fin", H, ["v"]))


def cube_filter(name, field, n, weights, axis):
    """One filter pass over all faces: every tap is read on its own."""
    radius = len(weights) // 2
    table = "(VALUES " + ", ".join(f"({k - radius}, {w!r}::DOUBLE)" for k, w in enumerate(weights)) + ") w(o, wt)"
    y, x = ("ty+o", "tx") if axis == "y" else ("ty", "tx+o")
    taps = (f"SELECT face, ty, tx, wt, {y} AS y, {x} AS x FROM (SELECT f AS face, a AS ty, b AS tx FROM range(6) r(f), range({n}+1) s(a), range({n}+1) t(b)), {table}")
    return ([(f"{name}_t", taps)] + chart_read(f"{name}_r", f"{name}_t", field, n, ["v"])
            + [(f"{name}_g", f"SELECT face, ty AS y, tx AS x, SUM(wt*v_s) AS v FROM {name}_r GROUP BY face, ty, tx")]
            + identify(name, f"{name}_g", n, ["v"]))


GAUSS = [math.exp(-0.5 * (o / 5) ** 2) for o in range(-5, 6)]
GAUSS = [w / sum(GAUSS) for w in GAUSS]
TRI = [0.25, 0.5, 0.25]
SQL["filter_gauss_cube"] = query(["cube_field"], f"SELECT {FYX}, {r('v', 5)} AS v FROM b",
                                 cube_filter("a", "cube_field", N, GAUSS, "x") + cube_filter("b", "a", N, GAUSS, "y"))


def cube_reduce(name, field):
    return (cube_filter(f"{name}1", field, N, TRI, "x") + cube_filter(f"{name}2", f"{name}1", N, TRI, "y")
            + [(name, f"SELECT face, y//2 AS y, x//2 AS x, v FROM {name}2 WHERE y % 2 = 0 AND x % 2 = 0")])


SQL["filter_triangular_reduce_cube"] = query(["cube_field"], f"SELECT {FYX}, {r('v', 5)} AS v FROM a", cube_reduce("a", "cube_field"))
HALF = f"({N}//2)"


def add_low_cube(name, low):
    return ([(f"{name}_n", "SELECT face, y, x, v, face AS pf, y/2e0 AS cy, x/2e0 AS cx FROM cube_field")]
            + cube_lookup(f"{name}_s", f"{name}_n", low, HALF, ["v"]) + [(name, f"SELECT face, y, x, v+v_s AS v FROM {name}_s")])


SQL["laplacian_merge_cube"] = query(
    ["cube_field"], f"SELECT {FYX}, {r('v', 5)} AS v FROM z",
    cube_reduce("lo", "cube_field") + add_low_cube("pv", "lo") + cube_reduce("rd", "pv")
    + cube_filter("g1", "rd", HALF, GAUSS, "x") + cube_filter("g2", "g1", HALF, GAUSS, "y") + add_low_cube("fin", "g2") + identify("z", "fin", N, ["v"]))
SQL["pole_constraint"] = query(["climate_nodes"], f"SELECT y, x, {r('elev')} AS elev, {r('temp')} AS temp FROM k",
                               constrain("k", "climate_nodes", H, ["elev", "temp"]))

# ----------------------------------------------------------------------------- climate
LAND = "CASE WHEN elev > 0 THEN 1e0 ELSE 0e0 END"


def local_fit(name, source, part, lo_y, hi_y, lo_x, hi_x):
    """Direct 15 x 15 sums around every centre, then the regression."""
    keys = f"{part}, " if part else ""
    same = "a.face = b.face AND " if part else ""
    own = ", ".join(f"{k} AS {k}" for k in ())
    pick = "a.face, " if part else ""
    sums = ("SUM(l)/225e0 AS cov, SUM(l*b.temp)/225e0 AS st, SUM(l*b.elev)/225e0 AS se, SUM(l*b.elev*b.elev)/225e0 AS see, "
            "SUM(l*b.elev*b.temp)/225e0 AS sset")
    return [(f"{name}_l", f"SELECT *, {LAND} AS l FROM {source}"),
            (f"{name}_s", f"SELECT {pick}a.y, a.x, ANY_VALUE(a.temp) AS t0, ANY_VALUE(a.elev) AS e0, {sums.replace('SUM(l', 'SUM(b.l')} FROM {name}_l a JOIN {name}_l b "
                          f"ON {same}b.y BETWEEN a.y-7 AND a.y+7 AND b.x BETWEEN a.x-7 AND a.x+7 "
                          f"WHERE a.y BETWEEN {lo_y} AND {hi_y} AND a.x BETWEEN {lo_x} AND {hi_x} GROUP BY {pick}a.y, a.x"),
            (f"{name}_m", f"SELECT *, se/(cov+1e-6) AS me, st/(cov+1e-6) AS mt, see/(cov+1e-6) AS mee, sset/(cov+1e-6) AS met FROM {name}_s"),
            (f"{name}_v", f"SELECT *, mee-me*me AS va FROM {name}_m"),
            (f"{name}_b", f"SELECT *, LEAST(0, GREATEST(-0.012e0, CASE WHEN va < 1 OR cov < 0.02 THEN -0.0065e0 ELSE (met-me*mt)/(va+1e-6) END)) AS beta FROM {name}_v"),
            (name, f"SELECT {keys}y, x, t0-beta*e0 AS baseline, beta FROM {name}_b")]


SQL["local_lapse_rate"] = query(
    ["climate_nodes"], f"SELECT y, x, {r('baseline')} AS baseline, {r('beta')} AS beta FROM fit",
    [("src", "SELECT y, x, temp, GREATEST(elev, 0) AS elev FROM climate_nodes")] + local_fit("fit", "src", "", "7", f"{H}-7", "7", f"2*{H}-8"))

CLIM = ([("he", f"SELECT f AS face, a-7 AS y, b-7 AS x FROM range(6) r(f), range({N}+15) s(a), range({N}+15) t(b)")]
        + chart_read("hr", "he", "cube_climate", N, ["z", "temp"])
        + [("hs", "SELECT face, y, x, temp_s AS temp, POWER(GREATEST(z_s, 0), 2) AS elev FROM hr")]
        + local_fit("fit", "hs", "face", "0", N, "0", N)
        + [("cj", "SELECT c.face, c.y, c.x, f.baseline, c.temp_std100, c.precip, c.precip_cv, f.beta FROM cube_climate c JOIN fit f USING (face, y, x)")]
        + identify("cf", "cj", N, ["baseline", "temp_std100", "precip", "precip_cv", "beta"]))
SQL["climate_features_cube"] = query(
    ["cube_climate"], f"SELECT {FYX}, " + ", ".join(f"{r(c)} AS {c}" for c in ("baseline", "temp_std100", "precip", "precip_cv", "beta")) + " FROM cf", CLIM)
SQL["climate_stored"] = SQL["climate_features_cube"]
SQL["climate_at_points"] = query(
    ["cube_climate", "dpoints"], f"SELECT point_id, {r('baseline_s+beta_s*GREATEST(value, 0)')} AS temp, {r('temp_std100_s/100')} AS temp_std, "
    f"{r('precip_s')} AS precip, {r('precip_cv_s')} AS precip_cv, {r('beta_s')} AS beta FROM ps",
    CLIM + cube_coordinates("pc", "dpoints", N) + cube_lookup("ps", "pc", "cf", N, ["baseline", "temp_std100", "precip", "precip_cv", "beta"]))

# ----------------------------------------------------------------------------- distributions
QS = "[" + ", ".join(f"{1e-4 + (1 - 2e-4) * i / 63!r}::DOUBLE" for i in range(64)) + "]"


def quantiles(name, source, value):
    """64 interpolated quantiles, then the running repair of ties in order."""
    return [(f"{name}_q", f"SELECT quantile_cont({value}, {QS}) AS q FROM {source}"),
            (f"{name}_u", f"SELECT i, q[i+1] AS v FROM {name}_q, range(64) t(i)"),
            (f"{name}_d", f"SELECT COALESCE(MIN(d), 1e-10)*0.1e0 AS step FROM (SELECT v-LAG(v) OVER (ORDER BY i) AS d FROM {name}_u) WHERE d > 0"),
            (name, f"SELECT * FROM (WITH RECURSIVE fix(i, v) AS (SELECT 0::BIGINT, v FROM {name}_u WHERE i = 0 UNION ALL "
                   f"SELECT u.i, CASE WHEN u.v <= f.v THEN f.v+(SELECT step FROM {name}_d) ELSE u.v END FROM fix f JOIN {name}_u u ON u.i = f.i+1) SELECT i, v FROM fix)")]


SQL["quantile_table"] = query(["dims"], f"SELECT 'price' AS channel, i, {r('v', 4)} AS q FROM t", quantiles("t", "lineitem", "l_extendedprice"))
SQL["quantile_table_approximate"] = "SELECT 'price' AS channel, i, TRUE AS within FROM range(64) t(i)"
SQL["quantile_table_ties"] = query(["dims"], f"SELECT 'quantity' AS channel, i, {r('v', 4)} AS q FROM t", quantiles("t", "lineitem", "l_quantity"))
def mapped(name, part, source, target):
    """Segment join of one population against its two tables, clamped at both ends."""
    return [(f"{name}_g", f"SELECT a.v AS s0, b.v AS s1, c.v AS t0, d.v AS t1 FROM {source} a JOIN {source} b ON b.i = a.i+1 "
                          f"JOIN {target} c ON c.i = a.i JOIN {target} d ON d.i = a.i+1"),
            (name, f"SELECT f.y, f.x, CASE WHEN f.v <= (SELECT MIN(v) FROM {source}) THEN (SELECT MIN(v) FROM {target}) "
                   f"WHEN f.v >= (SELECT MAX(v) FROM {source}) THEN (SELECT MAX(v) FROM {target}) ELSE t0+(f.v-s0)*(t1-t0)/(s1-s0) END AS m "
                   f"FROM {part} f LEFT JOIN {name}_g g ON f.v >= g.s0 AND f.v < g.s1")]


SQL["quantile_map"] = query(
    ["node_field"], f"SELECT y, x, 'n' AS channel, {r('m', 4)} AS mapped FROM mn UNION ALL SELECT y, x, 's', {r('m', 4)} FROM ms",
    [("fn", f"SELECT * FROM node_field WHERE y < {H}//2"), ("fs", f"SELECT * FROM node_field WHERE y >= {H}//2")]
    + quantiles("sn", "fn", "v") + quantiles("ss", "fs", "v") + quantiles("tn", "orders", "o_totalprice")
    + quantiles("ts", "lineitem", "l_extendedprice") + mapped("mn", "fn", "sn", "tn") + mapped("ms", "fs", "ss", "ts"))


def uniform(*parts):
    text = " || ':' || ".join(parts)
    return f"((('0x' || SUBSTR(MD5({text}), 1, 12))::BIGINT)::DOUBLE + 0.5)/{2.0 ** 48!r}::DOUBLE"


SQL["drop_ocean"] = query(["node_field"], f"SELECT y, x, {r('v')} AS v FROM node_field WHERE v >= 0 OR {uniform(chr(39) + '0' + chr(39), 'CAST(y AS VARCHAR)', 'CAST(x AS VARCHAR)')} > 0.5")
_key = ["'42'", "'7'", "'0'", "CAST(kx AS VARCHAR)", "CAST(ky AS VARCHAR)", "CAST(kz AS VARCHAR)"]
_ang = math.atan(0.3)
SQL["seeded_gaussian_nodes"] = query(
    ["cube_field"], f"SELECT {FYX}, {r('g')} AS noise, {r(f'{math.cos(_ang)!r}::DOUBLE*(v/2500e0) + {math.sin(_ang)!r}::DOUBLE*g')} AS mixed FROM w",
    [("w", f"SELECT *, SQRT(-2*LN({uniform(*_key, chr(39) + 'u' + chr(39))}))*COS(2*PI()*({uniform(*_key, chr(39) + 'v' + chr(39))})) AS g FROM cube_field")])

# ----------------------------------------------------------------------------- reports
PHASE = [
    ("rw", f"SELECT y AS line, SQRT(AVG(d*d)) AS rms FROM (SELECT y, v-LAG(v) OVER (PARTITION BY y ORDER BY x) AS d FROM node_field) "
           f"WHERE y BETWEEN ({H}+1)//8 AND ({H}+1)-({H}+1)//8-1 GROUP BY y"),
    ("cl", f"SELECT x AS line, SQRT(AVG(d*d)) AS rms FROM (SELECT x, v-LAG(v) OVER (PARTITION BY x ORDER BY y) AS d FROM node_field) "
           f"WHERE x BETWEEN (2*{H})//8 AND 2*{H}-(2*{H})//8-1 GROUP BY x"),
    ("ph", "SELECT 'row' AS axis, line % 8 AS phase, AVG(rms) AS rms FROM rw GROUP BY 2 UNION ALL SELECT 'column', line % 8, AVG(rms) FROM cl GROUP BY 2")]
SQL["grid_phase_profile"] = query(["node_field"], f"SELECT axis, phase, {r('rms')} AS rms FROM ph", PHASE)
RATIO = "MAX(rms) FILTER (axis = '{0}')/GREATEST(MIN(rms) FILTER (axis = '{0}'), 1e-12)"
SQL["grid_phase_report"] = query(
    ["node_field"], f"SELECT {r(RATIO.format('row'))} AS row_phase_ratio, {r(RATIO.format('column'))} AS column_phase_ratio FROM ph", PHASE)

FACES = "(VALUES (0,1e0,0e0,0e0),(1,0e0,1e0,0e0),(2,-1e0,0e0,0e0),(3,0e0,-1e0,0e0),(4,0e0,0e0,1e0),(5,0e0,0e0,-1e0)) {0}(f, nx, ny, nz)"
STOPS = "(VALUES ('edge',1,1e0),('edge',-1,-1e0),('inner',5,1e0),('inner',3,-1e0),('outer',-3,1e0),('outer',-5,-1e0)) s(part, k, sign)"
EDGE = ([("fp", "SELECT a.f AS fa, b.f AS fb, a.nx+b.nx AS mx, a.ny+b.ny AS my, a.nz+b.nz AS mz, a.nx-b.nx AS tx, a.ny-b.ny AS ty, a.nz-b.nz AS tz, "
          "a.ny*b.nz-a.nz*b.ny AS lx, a.nz*b.nx-a.nx*b.nz AS ly, a.nx*b.ny-a.ny*b.nx AS lz FROM "
          + FACES.format("a") + ", " + FACES.format("b") + " WHERE a.f < b.f AND a.nx*b.nx+a.ny*b.ny+a.nz*b.nz = 0"),
         ("fq", "SELECT fa, fb, p, tx/SQRT(2e0) AS tx, ty/SQRT(2e0) AS ty, tz/SQRT(2e0) AS tz, mx+w*lx AS qx, my+w*ly AS qy, mz+w*lz AS qz FROM "
                "(SELECT *, -0.9e0+1.8e0*p/255 AS w FROM fp, range(256) r(p))"),
         ("fr", f"SELECT fa, fb, p, part, sign, qx/l*COS(k*1e0/{N})+tx*SIN(k*1e0/{N}) AS vx, qy/l*COS(k*1e0/{N})+ty*SIN(k*1e0/{N}) AS vy, "
                f"qz/l*COS(k*1e0/{N})+tz*SIN(k*1e0/{N}) AS vz FROM (SELECT *, SQRT(qx*qx+qy*qy+qz*qz) AS l FROM fq), {STOPS}")]
        + cube_coordinates("fc", "fr", N) + cube_lookup("fs", "fc", "cube_field", N, ["v"])
        + [("fd", "SELECT fa, fb, p, part, SUM(sign*v_s) AS d FROM fs GROUP BY fa, fb, p, part"),
           ("fe", "SELECT fa, fb, SQRT(AVG(d*d) FILTER (part = 'edge')) AS e, SQRT(AVG(d*d) FILTER (part <> 'edge')) AS n FROM fd GROUP BY fa, fb")])
SQL["edge_report"] = query(
    ["cube_field"], f"SELECT {B('fa')} AS face_a, {B('fb')} AS face_b, {r('e')} AS edge_rms, {r('n')} AS nearby_rms, {r('e/GREATEST(n, 1e-12)')} AS ratio FROM fe", EDGE)
SQL["shared_node_error"] = query(
    ["cube_field_k"], f"SELECT {r('MAX(ABS(v-o))')} AS shared_node_error FROM "
    "(SELECT v, FIRST_VALUE(v) OVER (PARTITION BY kx, ky, kz ORDER BY face, y, x) AS o FROM cube_field_k)")

RINGS = "(VALUES " + ", ".join(f"({s * d}::DOUBLE)" for d in (0, 45, 60, 75, 80, 85, 88) for s in ((1,) if d == 0 else (1, -1))) + ") r(deg)"
ANISO = ([("ap", f"SELECT deg, p, RADIANS(deg) AS la, -PI()+2*PI()*p/512 AS lo FROM {RINGS}, range(512) q(p)"),
          ("atn", "SELECT deg, p, la, lo, 'east' AS axis, -SIN(lo) AS tx, COS(lo) AS ty, 0e0 AS tz FROM ap UNION ALL "
                 "SELECT deg, p, la, lo, 'north', -SIN(la)*COS(lo), -SIN(la)*SIN(lo), COS(la) FROM ap"),
          ("av", f"SELECT deg, p, axis, sg, COS(la)*COS(lo)*COS(PI()/{H})+sg*tx*SIN(PI()/{H}) AS vx, COS(la)*SIN(lo)*COS(PI()/{H})+sg*ty*SIN(PI()/{H}) AS vy, "
                 f"SIN(la)*COS(PI()/{H})+sg*tz*SIN(PI()/{H}) AS vz FROM atn, (VALUES (1e0), (-1e0)) s(sg)"),
          ("an", f"SELECT *, {lonlat_node(H)} FROM av")]
         + lonlat_lookup("au", "an", "node_field", H, ["v"])
         + [("ad", "SELECT deg, axis, p, SUM(sg*v_s) AS d FROM au GROUP BY deg, axis, p"),
            ("ar", "SELECT deg, SQRT(AVG(d*d) FILTER (axis = 'east')) AS e, SQRT(AVG(d*d) FILTER (axis = 'north')) AS n FROM ad GROUP BY deg")])
SQL["polar_anisotropy"] = query(
    ["node_field"], f"SELECT deg AS latitude_degrees, {r('e')} AS east_west_rms, {r('n')} AS north_south_rms, {r('e/GREATEST(n, 1e-12)')} AS direction_ratio FROM ar", ANISO)

SQL["area_weighted_land_metrics"] = query(
    ["node_field"], f"SELECT {r('SUM(w*(a>0)::INT)/SUM(w)')} AS land_fraction, {r('SUM(w*(e>0)::INT)/SUM(w)')} AS guide_land_fraction, "
    f"{r('SUM(w*(a>0 AND e>0)::INT)/GREATEST(SUM(w*(a>0 OR e>0)::INT), 1e-12)')} AS land_iou, {r('SUM(w*((a>0)=(e>0))::INT)/SUM(w)')} AS agreement, "
    f"{r('SQRT(SUM(w*(a-e)*(a-e))/SUM(w))')} AS rmse, {r('SUM(w*a)/SUM(w)')} AS mean_elevation, "
    f"{r('SQRT(SUM(w*a*a)/SUM(w)-POWER(SUM(w*a)/SUM(w), 2))')} AS std_elevation, {r('MIN(a)')} AS low, {r('MAX(a)')} AS high FROM "
    f"(SELECT k.v AS a, f.v AS e, SIN(PI()*f.y/{H}) AS w FROM k JOIN node_field f USING (y, x) WHERE f.y < {H})",
    filter_lonlat("g", "node_field", H) + constrain("k", "g", H, ["v"]))

QH = f"({PH}//4)"
SQL["layout_compare"] = query(
    ["node_field", "bright"], f"SELECT {r('SUM(w*(v>0 AND m)::INT)/SUM(w*(v>0 OR m)::INT)')} AS land_iou, {r('SUM(w*((v>0)=m)::INT)/SUM(w)')} AS agreement, "
    f"{r('SUM(w*(v>0 AND m)::INT)/SUM(w*m::INT)')} AS painted_land_kept, {r('SUM(w*(v<0 AND NOT m)::INT)/GREATEST(SUM(w*(NOT m)::INT), 1e-12)')} AS painted_ocean_below_sea, "
    f"{r('CORR(v, hh) FILTER (m)')} AS land_height_correlation, {r('MIN(v)')} AS low, {r('MAX(v)')} AS high, "
    f"{r('MIN(v) FILTER (NOT m)')} AS ocean_low, {r('MAX(v) FILTER (NOT m)')} AS ocean_high, {r('STDDEV_POP(v) FILTER (NOT m)')} AS ocean_std FROM lj",
    [("pt", "SELECT row_i, col_i, CASE WHEN alpha > 0 THEN code % 256 ELSE 0 END AS code FROM bright"),
     ("bl", "SELECT row_i//4 AS row_i, col_i//4 AS col_i, AVG(CASE WHEN code > 0 THEN 1e0 ELSE 0e0 END) AS share, AVG(code)*4000/255e0 AS hh FROM pt GROUP BY 1, 2"),
     ("vp", f"SELECT i AS row_i, j AS col_i, (i+0.5e0)*{H}/{QH} AS ny, (j+0.5e0)*{H}/{QH} AS nx FROM range({QH}) a(i), range(2*{QH}) b(j)")]
    + lonlat_lookup("vs", "vp", "node_field", H, ["v"])
    + [("lj", f"SELECT v_s AS v, share >= 0.5 AS m, hh, COS(PI()*((vs.row_i+0.5e0)/{QH}-0.5e0)) AS w FROM vs JOIN bl USING (row_i, col_i)")])

SQL["stored_lonlat_tolerance"] = query(
    ["node_field"], "SELECT tolerance, COUNT(*) AS values, COUNT(*) FILTER (ABS(CAST(CAST(v AS FLOAT) AS DOUBLE)-v) <= a+b*ABS(v)) AS within "
    "FROM node_field, (VALUES ('float', 1e-8, 1e-6), ('none', 0e0, 0e0)) t(tolerance, a, b) GROUP BY tolerance")
SQL["field_error"] = query(
    ["climate_nodes", "node_field"], f"SELECT {r('SQRT(AVG(d*d))')} AS rmse, {r('MAX(ABS(d))')} AS max_absolute, {r('SQRT(AVG(d*d))/SQRT(AVG(e*e))')} AS relative_rmse "
    "FROM (SELECT k.elev-f.v AS d, f.v AS e FROM k JOIN node_field f USING (y, x))", constrain("k", "climate_nodes", H, ["elev"]))

PROBES = (f"(VALUES ('seam','col',0e0,1e0),('seam','col',2e0*{H},-1e0),('crossing','col',-1e-6,1e0),('crossing','col',1e-6,-1e0),('pole_n','row',0e0,1e0),"
          f"('pole_s','row',1e0*{H},1e0),('cap_n','row',1e-6,1e0),('cap_s','row',{H}-1e-6,1e0),('far_n','row',1e-4,1e0),('far_s','row',{H}-1e-4,1e0)) l(part, kind, c, sg)")
SPREAD = "MAX(v_s) FILTER (part = '{0}')-MIN(v_s) FILTER (part = '{0}')"
VERIFY = (PHASE + [("vp", f"SELECT i, part, sg, CASE WHEN kind = 'col' THEN i/128e0*{H} ELSE c END AS ny, CASE WHEN kind = 'col' THEN c ELSE i/128e0*2*{H} END AS nx FROM range(129) t(i), {PROBES}")]
          + lonlat_lookup("vs", "vp", "node_field", H, ["v"])
          + [("vd", "SELECT part, i, ABS(SUM(sg*v_s)) AS d FROM vs WHERE part IN ('seam', 'crossing') GROUP BY part, i"),
             ("g1", "SELECT MAX(d) FILTER (part = 'seam') AS dateline_error, MAX(d) FILTER (part = 'crossing') AS dateline_gap FROM vd"),
             ("g2", "SELECT " + ", ".join(f"{SPREAD.format(k)} AS {k}" for k in ("pole_n", "pole_s", "cap_n", "cap_s", "far_n", "far_s")) + " FROM vs"),
             ("bt", f"SELECT * FROM node_field WHERE y BETWEEN GREATEST(1, {H}//8) AND {H}-{H}//8-1"),
             ("g3", f"SELECT SQRT(AVG((a.v-b.v)*(a.v-b.v))) AS seam_edge_rms FROM bt a JOIN bt b ON a.y = b.y AND a.x = 0 AND b.x = 2*{H}-1"),
             ("g4", "SELECT SQRT(AVG(d*d)) AS ordinary_edge_rms FROM (SELECT v-LAG(v) OVER (PARTITION BY y ORDER BY x) AS d FROM bt)"),
             ("g5", "SELECT COUNT(*) AS nodes, COUNT(*) FILTER (v IS NULL OR ISNAN(v) OR ISINF(v)) AS not_finite, MIN(v) AS low, MAX(v) AS high FROM node_field"),
             ("g6", f"SELECT {RATIO.format('row')} AS row_phase_ratio, {RATIO.format('column')} AS column_phase_ratio FROM ph"),
             ("g7", "SELECT *, seam_edge_rms/GREATEST(ordinary_edge_rms, 1e-12) AS edge_ratio FROM g1, g2, g3, g4, g5, g6")])
_round = ("dateline_error", "dateline_gap", "pole_n", "pole_s", "cap_n", "cap_s", "far_n", "far_s", "seam_edge_rms", "ordinary_edge_rms",
          "low", "high", "row_phase_ratio", "column_phase_ratio", "edge_ratio")
SQL["verify_state_report"] = query(
    ["node_field"], "SELECT " + ", ".join(f"{r(c)} AS {c}" for c in _round) + ", nodes, not_finite, "
    f"(not_finite = 0 AND nodes = ({H}+1)*2*{H} AND dateline_error < 1e-8 AND GREATEST(pole_n, pole_s) < 1e-8 AND cap_n <= far_n*0.011+1e-5 AND cap_s <= far_s*0.011+1e-5) AS passed, "
    "edge_ratio > 5 AS seam_outlier, GREATEST(row_phase_ratio, column_phase_ratio) > 1.15 AS phase_warning FROM g7", VERIFY)

_stored_report = ", ".join(f"{r(c)} AS {c}" for c in (*_round, "polar_ratio_low", "polar_ratio_high"))
SQL["verify_stored_report"] = query(
    ["node_field"], f"SELECT {_stored_report}, nodes, not_finite, copy, copy = 'saved' AS checksum_matches, "
    f"(copy = 'saved' AND not_finite = 0 AND nodes = ({H}+1)*2*{H} AND dateline_error < 1e-8 AND GREATEST(pole_n, pole_s) < 1e-8 AND cap_n <= far_n*0.011+1e-5 AND cap_s <= far_s*0.011+1e-5) AS passed, "
    "edge_ratio > 5 AS seam_outlier, GREATEST(row_phase_ratio, column_phase_ratio) > 1.15 AS phase_warning FROM g7, "
    "(SELECT MIN(e/GREATEST(n, 1e-12)) AS polar_ratio_low, MAX(e/GREATEST(n, 1e-12)) AS polar_ratio_high FROM ar), (VALUES ('saved'), ('changed')) t(copy)", VERIFY + ANISO)

SQL["seam_vs_interior"] = query(
    ["node_field"], f"SELECT y, {r('MAX(ABS(d)) FILTER (x = 0)')} AS seam_step, {r('SQRT(AVG(d*d) FILTER (x > 0))')} AS inner_rms FROM "
    f"(SELECT a.y, a.x, a.v-b.v AS d FROM node_field a JOIN node_field b ON b.y = a.y AND b.x = (a.x+2*{H}-1) % (2*{H})) GROUP BY y")
SQL["row_spread"] = query(["climate_nodes"], f"SELECT y, {r('MAX(elev)-MIN(elev)')} AS spread FROM climate_nodes GROUP BY y")
DIFFS = ("df", "SELECT x AS i, v-LAG(v) OVER (PARTITION BY face, y ORDER BY x) AS d FROM cube_field UNION ALL "
               "SELECT y, v-LAG(v) OVER (PARTITION BY face, x ORDER BY y) FROM cube_field")
_at = lambda o: f"((i-({o})) % 4 = 0 AND i-({o}) >= 4 AND i-({o}) < {N}-8)"
SQL["tile_boundary_ratio"] = query(
    ["cube_field"], f"SELECT 4::BIGINT AS stride, {r('b')} AS boundary_rms, {r('s')} AS nearby_rms, {r('b/GREATEST(s, 1e-12)')} AS ratio FROM "
    f"(SELECT SQRT(AVG(d*d) FILTER ({_at(0)})) AS b, SQRT(SUM(d*d*({_at(8)}::INT+{_at(-8)}::INT))/SUM({_at(8)}::INT+{_at(-8)}::INT)) AS s FROM df WHERE d IS NOT NULL)", [DIFFS])
SQL["residual_stats"] = query(
    ["cube_field"], f"SELECT {r('STDDEV_POP(v)')} AS std, {r('MIN(v)')} AS low, {r('MAX(v)')} AS high, {r('SQRT(AVG(d*d))')} AS neighbour_rms FROM "
    "(SELECT v, v-LAG(v) OVER (PARTITION BY face, y ORDER BY x) AS d FROM cube_field)")
SQL["field_extremes"] = query(
    ["cube_raw"], f"SELECT {r('l.v')} AS low, {B('l.face')} AS low_face, {B('l.y')} AS low_y, {B('l.x')} AS low_x, {r('h.v')} AS high, {B('h.face')} AS high_face, "
    f"{B('h.y')} AS high_y, {B('h.x')} AS high_x FROM (SELECT * FROM cube_raw ORDER BY v, face, y, x LIMIT 1) l, (SELECT * FROM cube_raw ORDER BY v DESC, face, y, x LIMIT 1) h")
SQL["ocean_audit"] = query(
    ["node_field"], f"SELECT COUNT(*) FILTER (v < 0) AS underwater, {r(f'SUM(SIN(PI()*y/{H})) FILTER (v < 0)/SUM(SIN(PI()*y/{H}))')} AS area_share, "
    f"{r('MIN(v) FILTER (v < 0)')} AS deepest, {r('MAX(v) FILTER (v < 0)')} AS shallowest, COUNT(*) FILTER (v = 0) AS exactly_zero, "
    f"{r('SQRT(AVG(d*d) FILTER (v < 0 AND p < 0))')} AS neighbour_rms FROM (SELECT *, v-p AS d FROM (SELECT *, LAG(v) OVER (PARTITION BY y ORDER BY x) AS p FROM node_field))")

# ----------------------------------------------------------------------------- storage
SQL["field_checksum"] = query(
    ["node_field"], "SELECT COUNT(*) AS rows, CAST(SUM(('0x' || SUBSTR(MD5(CAST(y AS VARCHAR) || '|' || CAST(x AS VARCHAR) || '|' || "
    "CAST(CAST(ROUND(ROUND(v, 3)*1000) AS BIGINT) AS VARCHAR)), 1, 12))::BIGINT) AS VARCHAR) AS digest_sum FROM node_field")
SQL["manifest_compare"] = query(
    ["node_field", "cube_raw"], "SELECT * FROM (SELECT 'name' AS key, 'nodes' AS left_value, 'cube' AS right_value UNION ALL "
    "SELECT 'rows', (SELECT COUNT(*)::VARCHAR FROM node_field), (SELECT COUNT(*)::VARCHAR FROM cube_raw)) WHERE left_value IS DISTINCT FROM right_value")
_fourth = "ROUND((event_id % 50)/10e0, 1)"
SQL["weight_list_parse"] = (f"SELECT event_id, ok, CASE WHEN ok THEN {_fourth} + 0.0 END AS fourth FROM "
                            f"(SELECT event_id, value <= 60 AND {_fourth} BETWEEN 0.01 AND 4 AS ok FROM events)")
SQL["record_digest"] = "SELECT doc_id, SHA256(text) AS sha256 FROM documents"
SQL["stored_field_query"] = query(
    ["dpoints", "cube_field"], f"SELECT c.point_id, {r('CAST(f.v AS FLOAT)::DOUBLE', 2)} AS v FROM c JOIN cube_field f ON f.face = c.pf "
    "AND f.y = FLOOR(c.cy+0.5e0) AND f.x = FLOOR(c.cx+0.5e0)", CC)

# ----------------------------------------------------------------------------- streaming
SQL["stream_region_requests"] = query(
    ["region_d", "node_field"], f"SELECT request_id, row_i, col_i, {r('v_s')} AS v FROM s", REGION_LL)
SQL["stream_bad_requests"] = query(
    ["requests", "region_d", "node_field"], "SELECT request_id, 'bounds_order' AS error, 0::BIGINT AS pixels, 0e0 AS total FROM requests WHERE south >= north "
    f"UNION ALL SELECT request_id, NULL, COUNT(v_s), {r('SUM(v_s)', 4)} FROM s GROUP BY request_id", REGION_LL)
SQL["stream_served_blocks"] = SQL["stream_bad_requests"]
SQL["stream_batch_counts"] = query(
    ["requests"], "SELECT COUNT(*) AS requests, COUNT(*) FILTER (south >= north) AS errors, CAST(SUM(width*height) FILTER (south < north) AS BIGINT) AS pixels FROM requests")
SQL["stream_unique_requests"] = query(["requests"], "SELECT DISTINCT request_id, STRFTIME(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM requests")
SQL["observed_stages"] = query(
    ["node_field"], f"SELECT COUNT(*) AS nodes, {r('SUM(v)', 3)} AS total, COUNT(*) AS observed, COUNT(*) FILTER (y % 5 = 0) AS bad FROM node_field")
SQL["stream_progress"] = query(
    ["requests"], "SELECT STRFTIME(DATE_TRUNC('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, COUNT(*) AS requests, COUNT(*) FILTER (south >= north) AS errors FROM requests "
    "GROUP BY DATE_TRUNC('hour', ts)")
_near = [("rn", f"SELECT DISTINCT pf AS face, {B('FLOOR(cy+0.5e0)')} AS y, {B('FLOOR(cx+0.5e0)')} AS x FROM rc")]
SQL["stream_tile_store"] = query(
    ["cube_field", "region_d"], f"SELECT {FTT}, {r('SUM(4*v)', 4)} AS total FROM st JOIN need USING (face, ty, tx) GROUP BY face, ty, tx",
    STENCIL + cube_coordinates("rc", "region_d", N) + _near
    + [("nk", f"SELECT DISTINCT kx, ky, kz FROM (SELECT {key(N)} FROM rn)"),
       ("need", "SELECT DISTINCT s.face, s.ty, s.tx FROM nk JOIN cube_field f USING (kx, ky, kz) JOIN st s ON s.face = f.face AND s.y = f.y AND s.x = f.x")])

SQL["tile_run_counts"] = query(
    ["cube_field", "dpoints"], "SELECT run, used, reused, used-reused AS scored, used AS found FROM (SELECT 1::BIGINT AS run, a AS used, 0::BIGINT AS reused FROM k "
    "UNION ALL SELECT 2, b, a FROM k UNION ALL SELECT 3, b, b FROM k)",
    STENCIL + CC + [("rn", f"SELECT DISTINCT point_id % 2 AS odd, pf AS face, {B('FLOOR(cy+0.5e0)')} AS y, {B('FLOOR(cx+0.5e0)')} AS x FROM c"),
                    ("nk", f"SELECT DISTINCT odd, kx, ky, kz FROM (SELECT odd, {key(N)} FROM rn)"),
                    ("need", "SELECT DISTINCT odd, s.face, s.ty, s.tx FROM nk JOIN cube_field f USING (kx, ky, kz) JOIN st s ON s.face = f.face AND s.y = f.y AND s.x = f.x"),
                    ("k", "SELECT COUNT(DISTINCT (face, ty, tx)) FILTER (odd = 0) AS a, COUNT(DISTINCT (face, ty, tx)) AS b FROM need")])

# ----------------------------------------------------------------------------- further compositions
SQL["area_mean_pixels"] = query(
    ["node_field"], f"SELECT {r('SUM(w*v_s)/SUM(w)')} AS mean_v, {r('MIN(v_s)')} AS low, {r('MAX(v_s)')} AS high FROM "
    f"(SELECT v_s, COS(PI()*((i+0.5e0)/{H}-0.5e0)) AS w FROM s)",
    [("p", f"SELECT i, j, i+0.5e0 AS ny, j+0.5e0 AS nx FROM range({H}) a(i), range(2*{H}) b(j)")] + lonlat_lookup("s", "p", "node_field", H, ["v"]))
SQL["verify_region_report"] = query(
    ["region_d", "node_field"], "SELECT finite, copy, same AS checksum_matches, finite AND same AS passed FROM "
    "(SELECT COUNT(*) FILTER (v_s IS NULL OR ISNAN(v_s) OR ISINF(v_s)) = 0 AS finite FROM s), (VALUES ('saved', TRUE), ('changed', FALSE)) c(copy, same)", REGION_LL)
SQL["climate_export_window"] = query(
    ["node_field", "cube_climate"], f"SELECT row_i, col_i, {r('baseline_s+beta_s*GREATEST(elevation, 0)')} AS temp, {r('temp_std100_s/100')} AS temp_std, "
    f"{r('precip_s')} AS precip, {r('precip_cv_s')} AS precip_cv, {r('beta_s')} AS beta FROM ps",
    [("p", WIN)] + lonlat_lookup("wl", "p", "node_field", H, ["v"])
    + [("wd", f"SELECT row_i, col_i, v_s AS elevation, {lonlat_direction(f'(-180+nx*180e0/{H})', f'(90-ny*180e0/{H})')} FROM wl")]
    + CLIM + cube_coordinates("pc", "wd", N) + cube_lookup("ps", "pc", "cf", N, ["baseline", "temp_std100", "precip", "precip_cv", "beta"]))
PM2 = ("pm", "SELECT row_i, col_i, COALESCE(v, 0e0) AS value, COALESCE(ABS(v), 0e0) AS rain, CASE WHEN v IS NULL THEN 0e0 ELSE 1e0 END AS coverage FROM pixels")
GAP = "(1-LEAST(1, GREATEST(0, ft.coverage)))"
SQL["guide_partial_channels"] = query(
    ["pixels", "cube_nodes", "cube_climate"], f"SELECT {FYX}, " + ", ".join(
        f"{r(c, 5)} AS {c}" for c in ("heightmap", "temperature", "temperature_std", "precipitation", "precipitation_cv")) + " FROM gi",
    [PM2] + corner_nodes("cn", "pm", ["value", "rain", "coverage"]) + footprint("ft", "cn", ["value", "rain", "coverage"])
    + [("mx", f"SELECT f.face, f.y, f.x, {sign_root(f'(ft.value+{GAP}*SIGN(f.z)*f.z*f.z)')} AS heightmap, f.temp AS temperature, "
              f"f.temp_std100 AS temperature_std, ft.rain+{GAP}*f.precip AS precipitation, f.precip_cv AS precipitation_cv FROM cube_climate f JOIN ft USING (face, y, x)")]
    + identify("gi", "mx", N, ["heightmap", "temperature", "temperature_std", "precipitation", "precipitation_cv"]))
SQL["footprint_requested_nodes"] = query(
    ["pixels", "cube_nodes", "dpoints"], f"SELECT {FYX}, {r('value')} AS value, {r('coverage')} AS coverage FROM ft_m JOIN rn USING (face, y, x)",
    FOOT + cube_coordinates("c", "dpoints", N)
    + [("rn", f"SELECT DISTINCT pf AS face, {B('FLOOR(cy+0.5e0)')} AS y, {B('FLOOR(cx+0.5e0)')} AS x FROM c")])
_w = f"{LINEAR('dy')}*{LINEAR('dx')}"
SQL["tile_blend_channels"] = query(
    ["tile_cells", "tiles"], f"SELECT DISTINCT {B('k.face')} AS face, {B('k.y')} AS y, {B('k.x')} AS x, {r('g.a')} AS \"values\", {r('g.b')} AS scaled FROM k JOIN g USING (kx, ky, kz)",
    [("k", f"SELECT c.*, t.label, {key(TN, 'c.face')} FROM tile_cells c JOIN tiles t USING (vec_id) WHERE y BETWEEN 0 AND {TN} AND x BETWEEN 0 AND {TN}"),
     ("g", f"SELECT kx, ky, kz, SUM({_w}*v)/SUM({_w}) AS a, SUM({_w}*v*label)/SUM({_w}) AS b FROM k GROUP BY kx, ky, kz")])
TN2 = f"(2*{TN})"
PLAN2 = ("pl", f"SELECT f AS face, -4+4*a AS ty, -4+4*b AS tx FROM range(6) r(f), range(CAST({TN2}//4 AS BIGINT)+2) s(a), range(CAST({TN2}//4 AS BIGINT)+2) t(b)")
NEED = cube_coordinates("c", "dpoints", TN2) + [
    ("rn", f"SELECT DISTINCT pf AS face, {B('FLOOR(cy+0.5e0)')} AS y, {B('FLOOR(cx+0.5e0)')} AS x FROM c"),
    ("nk", f"SELECT DISTINCT kx, ky, kz FROM (SELECT {key(TN2)} FROM rn)"),
    ("an", f"SELECT f AS face, a AS y, b AS x FROM range(6) r(f), range(CAST({TN2} AS BIGINT)+1) s(a), range(CAST({TN2} AS BIGINT)+1) t(b)"),
    ("ak", f"SELECT *, {key(TN2)} FROM an"), PLAN2,
    ("need", "SELECT DISTINCT p.face, p.ty, p.tx FROM nk JOIN ak a USING (kx, ky, kz) JOIN pl p ON p.face = a.face "
             "AND a.y BETWEEN p.ty AND p.ty+7 AND a.x BETWEEN p.tx AND p.tx+7")]
SQL["tile_saved"] = query(
    ["dpoints", "tiles"], f"SELECT {B('t.face')} AS face, {B('t.ty')} AS ty, {B('t.tx')} AS tx, COUNT(*) AS copies FROM tiles t SEMI JOIN need n "
    "ON n.face = t.face AND n.ty = t.ty AND n.tx = t.tx GROUP BY 1, 2, 3",
    cube_coordinates("c", "dpoints", TN)
    + [("rn", f"SELECT DISTINCT pf AS face, {B('FLOOR(cy+0.5e0)')} AS y, {B('FLOOR(cx+0.5e0)')} AS x FROM c"),
       ("nk", f"SELECT DISTINCT kx, ky, kz FROM (SELECT {key(TN)} FROM rn)"),
       ("an", f"SELECT f AS face, a AS y, b AS x FROM range(6) r(f), range({TN}+1) s(a), range({TN}+1) t(b)"),
       ("ak", f"SELECT *, {key(TN)} FROM an"), PLAN,
       ("need", "SELECT DISTINCT p.face, p.ty, p.tx FROM nk JOIN ak a USING (kx, ky, kz) JOIN pl p ON p.face = a.face "
                "AND a.y BETWEEN p.ty AND p.ty+7 AND a.x BETWEEN p.tx AND p.tx+7")])
SQL["tile_accounting"] = query(
    ["dpoints", "tiles"], "SELECT COUNT(*) AS used, COUNT(t.face) AS reused, COUNT(*)-COUNT(t.face) AS scored FROM need n LEFT JOIN "
    "(SELECT DISTINCT face, ty, tx FROM tiles) t ON n.face = t.face AND n.ty = t.ty AND n.tx = t.tx", NEED)
SQL["points_clustered"] = query(
    ["dpoints"], f"SELECT point_id, {B('pf')} AS face, {B('FLOOR(cy/32e0)')} AS tile_y, {B('FLOOR(cx/32e0)')} AS tile_x FROM c",
    cube_coordinates("c", "dpoints", "256e0"))
SQL["point_groups"] = query(
    ["dpoints"], "SELECT face, tile_y, tile_x, chunk, COUNT(*) AS points, SHA256(STRING_AGG(CAST(point_id AS VARCHAR), ',' ORDER BY point_id)) AS ids_sha256 FROM "
    "(SELECT *, (ROW_NUMBER() OVER (PARTITION BY face, tile_y, tile_x ORDER BY point_id)-1)//50 AS chunk FROM k) GROUP BY ALL",
    cube_coordinates("c", "dpoints", "64e0")
    + [("k", f"SELECT point_id, {B('pf')} AS face, {B('FLOOR(cy/32e0)')} AS tile_y, {B('FLOOR(cx/32e0)')} AS tile_x FROM c")])
_lk = ["'42'", "'9'", "'2'", "CAST(y AS VARCHAR)", f"CAST(CASE WHEN y IN (0, {H}) THEN 0 ELSE x END AS VARCHAR)"]
SQL["seeded_gaussian_lonlat"] = query(
    ["node_field"], f"SELECT y, x, {r('g')} AS noise FROM w",
    [("w", f"SELECT y, x, SQRT(-2*LN({uniform(*_lk, chr(39) + 'u' + chr(39))}))*COS(2*PI()*({uniform(*_lk, chr(39) + 'v' + chr(39))})) AS g FROM node_field")])

_crop = (f"SELECT DISTINCT face, ty, tx, k, ty/4e0-1+k//4 AS y, tx/4e0-1+k%4 AS x FROM cx0, range(16) u(k)")
SQL["tile_score_channels"] = query(
    ["cube_climate"], f"SELECT {FYX}, {r('a')} AS temp, {r('b')} AS precip FROM (SELECT DISTINCT k.face, k.y, k.x, g.a, g.b FROM k JOIN g USING (kx, ky, kz))",
    context_cells("cx0", N, 8, 4, lambda name, source, n: nearest_read(name, source, n, "cube_climate", "f.temp, f.precip"))
    + [("ce", _crop)] + chart_read("cr", "ce", "cube_climate", N, ["temp"])
    + [("cm", "SELECT face, ty, tx, AVG(temp_s) AS m FROM cr GROUP BY face, ty, tx"),
       ("k", f"SELECT c.*, m, {key(N, 'c.face')} FROM cx0 c JOIN cm USING (face, ty, tx) WHERE y BETWEEN 0 AND {N} AND x BETWEEN 0 AND {N}"),
       ("g", f"SELECT kx, ky, kz, SUM({_w}*(temp-m))/SUM({_w}) AS a, SUM({_w}*0.5e0*precip)/SUM({_w}) AS b FROM k GROUP BY kx, ky, kz")])
