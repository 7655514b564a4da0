"""Building blocks of the comparison SQL: named common table expressions and formula text.

Written separately from the Spark expressions, in the other engine's dialect.
"""
from __future__ import annotations

H, N, PH, P, TN = ("(SELECT h FROM dims)", "(SELECT n FROM dims)", "(SELECT h FROM pdims)",
                   "(SELECT p FROM tdims)", "(SELECT n FROM tdims)")

PARTS: dict[str, tuple[list[str], str]] = {}


def part(name: str, needs: list[str], sql: str) -> str:
    PARTS[name] = (needs, sql)
    return name


def query(needs: list[str], body: str, extra: list[tuple[str, str]] = ()) -> str:
    """A full statement: needed parts in dependency order, then query-specific ones, then body."""
    order: list[str] = []

    def visit(name):
        for need in PARTS[name][0]:
            visit(need)
        if name not in order:
            order.append(name)
    for name in needs:
        visit(name)
    ctes = [f"{name} AS ({PARTS[name][1]})" for name in order] + [f"{k} AS ({v})" for k, v in extra]
    return "WITH " + ",\n".join(ctes) + "\n" + body


def pmod(a, b):
    return f"((({a}) % ({b})) + ({b})) % ({b})"


def fold_y(y, h):
    m = pmod(y, f"2*{h}")
    return f"CASE WHEN {m} > {h} THEN 2*{h} - {m} ELSE {m} END"


def fold_x(y, x, h):
    m = pmod(y, f"2*{h}")
    return f"CASE WHEN {m} > {h} THEN {pmod(f'({x}) + {h}', f'2*{h}')} ELSE {pmod(x, f'2*{h}')} END"


def r(expr, digits=6):
    return f"ROUND({expr}, {digits}) + 0.0"


def sign_root(v):
    return f"SIGN({v}) * SQRT(ABS({v}))"


def lonlat_lookup(name: str, source: str, field: str, h: str, columns: list[str],
                  ny="ny", nx="nx") -> list[tuple[str, str]]:
    """Four corner joins with folded indices."""
    idx = (f"SELECT *, CAST(FLOOR({ny}) AS BIGINT) AS iy, CAST(FLOOR({nx}) AS BIGINT) AS ix, "
           f"{ny} - FLOOR({ny}) AS fy, {nx} - FLOOR({nx}) AS fx FROM {source}")
    corners = {"a": ("iy", "ix"), "b": ("iy", "ix+1"), "c": ("iy+1", "ix"), "d": ("iy+1", "ix+1")}
    keys = ", ".join(f"{fold_y(y, h)} AS {k}y, {fold_x(y, x, h)} AS {k}x" for k, (y, x) in corners.items())
    joins = " ".join(f"LEFT JOIN {field} {k} ON {k}.y = q.{k}y AND {k}.x = q.{k}x" for k in corners)
    vals = ", ".join(f"(1-q.fy)*((1-q.fx)*a.{c} + q.fx*b.{c}) + q.fy*((1-q.fx)*c.{c} + q.fx*d.{c}) AS {c}_s"
                     for c in columns)
    return [(f"{name}_i", idx), (f"{name}_k", f"SELECT *, {keys} FROM {name}_i"),
            (name, f"SELECT q.*, {vals} FROM {name}_k q {joins}")]


def lonlat_direction(lon="lon", lat="lat"):
    return (f"COS(RADIANS({lat}))*COS(RADIANS({lon})) AS vx, COS(RADIANS({lat}))*SIN(RADIANS({lon})) AS vy, "
            f"SIN(RADIANS({lat})) AS vz")


FACE = ("CASE WHEN ABS(vx) >= ABS(vy) AND ABS(vx) >= ABS(vz) THEN CASE WHEN vx >= 0 THEN 0 ELSE 2 END "
        "WHEN ABS(vy) >= ABS(vz) THEN CASE WHEN vy >= 0 THEN 1 ELSE 3 END "
        "ELSE CASE WHEN vz >= 0 THEN 4 ELSE 5 END END")
DOT_N = "CASE {f} WHEN 0 THEN vx WHEN 1 THEN vy WHEN 2 THEN -vx WHEN 3 THEN -vy WHEN 4 THEN vz ELSE -vz END"
DOT_R = "CASE {f} WHEN 0 THEN vy WHEN 1 THEN -vx WHEN 2 THEN -vy WHEN 3 THEN vx WHEN 4 THEN vy ELSE vy END"
DOT_D = "CASE {f} WHEN 4 THEN vx WHEN 5 THEN -vx ELSE -vz END"


def cube_coordinates(name: str, source: str, n: str) -> list[tuple[str, str]]:
    """Owning face and clipped chart index for vx, vy, vz."""
    f = "pf"

    def index(dot):
        return f"LEAST({n}, GREATEST(0, {n}*(1 + ATAN2({dot.format(f=f)}, {DOT_N.format(f=f)})/(PI()/4))/2))"
    return [(f"{name}_f", f"SELECT *, {FACE} AS pf FROM {source}"),
            (name, f"SELECT *, {index(DOT_D)} AS cy, {index(DOT_R)} AS cx FROM {name}_f")]


def cube_direction(name: str, source: str, n: str, face="face", y="y", x="x", unit=True) -> list[tuple[str, str]]:
    """vx, vy, vz of chart indices; ``unit`` False scales to the cube surface."""
    ang = (f"SELECT *, PI()/4*(2e0*({x})/{n}-1) AS aa, PI()/4*(2e0*({y})/{n}-1) AS bb FROM {source}")
    p, q, s = "COS(aa)*COS(bb)", "SIN(aa)*COS(bb)", "COS(aa)*SIN(bb)"
    ux = f"CASE {face} WHEN 0 THEN {p} WHEN 1 THEN -({q}) WHEN 2 THEN -({p}) WHEN 3 THEN {q} WHEN 4 THEN {s} ELSE -({s}) END"
    uy = f"CASE {face} WHEN 0 THEN {q} WHEN 1 THEN {p} WHEN 2 THEN -({q}) WHEN 3 THEN -({p}) WHEN 4 THEN {q} ELSE {q} END"
    uz = f"CASE {face} WHEN 4 THEN {p} WHEN 5 THEN -({p}) ELSE -({s}) END"
    scale = "SQRT(ux*ux+uy*uy+uz*uz)" if unit else "GREATEST(ABS(ux), ABS(uy), ABS(uz))"
    return [(f"{name}_a", ang), (f"{name}_u", f"SELECT *, {ux} AS ux, {uy} AS uy, {uz} AS uz FROM {name}_a"),
            (name, f"SELECT * EXCLUDE (aa, bb, ux, uy, uz), ux/({scale}) AS vx, uy/({scale}) AS vy, "
                   f"uz/({scale}) AS vz FROM {name}_u")]


def cube_lookup(name: str, source: str, field: str, n: str, columns: list[str]) -> list[tuple[str, str]]:
    """Bilinear cube values for rows with pf, cy, cx."""
    idx = (f"SELECT *, CAST(FLOOR(cy) AS BIGINT) AS iy, CAST(FLOOR(cx) AS BIGINT) AS ix, "
           f"LEAST(CAST(FLOOR(cy) AS BIGINT)+1, {n}) AS jy, LEAST(CAST(FLOOR(cx) AS BIGINT)+1, {n}) AS jx, "
           f"cy-FLOOR(cy) AS fy, cx-FLOOR(cx) AS fx FROM {source}")
    joins = " ".join(f"LEFT JOIN {field} {k} ON {k}.face = q.pf AND {k}.y = q.{y} AND {k}.x = q.{x}"
                     for k, (y, x) in {"a": ("iy", "ix"), "b": ("iy", "jx"), "c": ("jy", "ix"),
                                       "d": ("jy", "jx")}.items())
    vals = ", ".join(f"(1-q.fy)*((1-q.fx)*a.{c} + q.fx*b.{c}) + q.fy*((1-q.fx)*c.{c} + q.fx*d.{c}) AS {c}_s"
                     for c in columns)
    return [(f"{name}_i", idx), (name, f"SELECT q.*, {vals} FROM {name}_i q {joins}")]


def lonlat_node(h: str):
    ln = "SQRT(vx*vx+vy*vy+vz*vz)"
    return (f"{h}*(0.5e0-ASIN(LEAST(1e0, GREATEST(-1e0, vz/({ln}))))/PI()) AS ny, "
            f"{h}*(ATAN2(vy, vx)/PI()+1e0) AS nx")


def key(n: str, face="face", y="y", x="x"):
    """kx, ky, kz text of the physical node of a chart entry."""
    a, b = f"(2*{x}-{n})", f"(2*{y}-{n})"
    return (f"CASE {face} WHEN 0 THEN {n} WHEN 1 THEN -{a} WHEN 2 THEN -{n} WHEN 3 THEN {a} WHEN 4 THEN {b} ELSE -{b} END AS kx, "
            f"CASE {face} WHEN 0 THEN {a} WHEN 1 THEN {n} WHEN 2 THEN -{a} WHEN 3 THEN -{n} WHEN 4 THEN {a} ELSE {a} END AS ky, "
            f"CASE {face} WHEN 4 THEN {n} WHEN 5 THEN -{n} ELSE -{b} END AS kz")


def identify(name: str, source: str, n: str, columns: list[str]) -> list[tuple[str, str]]:
    means = ", ".join(f"AVG({c}) OVER (PARTITION BY kx, ky, kz) AS {c}" for c in columns)
    return [(f"{name}_k", f"SELECT *, {key(n)} FROM {source}"),
            (name, f"SELECT face, y, x, {means} FROM {name}_k")]


def constrain(name: str, source: str, h: str, columns: list[str]) -> list[tuple[str, str]]:
    """Poles to their mean, rows next to them to mean and first harmonic."""
    ang = f"(PI()*x/{h})"
    sums = ", ".join(f"AVG({c}) AS m_{c}, SUM({c}*COS{ang})/{h} AS c_{c}, SUM({c}*SIN{ang})/{h} AS s_{c}" for c in columns)
    vals = ", ".join(f"CASE WHEN f.y IN (0, {h}) THEN m_{c} WHEN f.y IN (1, {h}-1) THEN "
                     f"m_{c} + c_{c}*COS(PI()*f.x/{h}) + s_{c}*SIN(PI()*f.x/{h}) ELSE f.{c} END AS {c}" for c in columns)
    return [(f"{name}_c", f"SELECT y, {sums} FROM {source} GROUP BY y"),
            (name, f"SELECT f.y, f.x, {vals} FROM {source} f JOIN {name}_c USING (y)")]


def gaussian_weight(o):
    total = "(SELECT SUM(EXP(-0.5e0*((k-5)/5e0)*((k-5)/5e0))) FROM range(11) t(k))"
    return f"EXP(-0.5e0*({o}/5e0)*({o}/5e0))/{total}"


def filter_lonlat(name: str, source: str, h: str) -> list[tuple[str, str]]:
    """11-tap filter by joins: columns wrap, rows fold."""
    return [
        (f"{name}_h", f"SELECT f.y, f.x, SUM({gaussian_weight('(t.k-5)')} * s.v) AS v FROM {source} f, range(11) t(k) "
                      f"JOIN {source} s ON s.y = f.y AND s.x = {pmod('f.x + t.k - 5', f'2*{h}')} GROUP BY f.y, f.x"),
        (f"{name}_t", f"SELECT f.y, f.x, t.k, {fold_y('f.y + t.k - 5', h)} AS sy, "
                      f"{fold_x('f.y + t.k - 5', 'f.x', h)} AS sx FROM {source} f, range(11) t(k)"),
        (name, f"SELECT t.y, t.x, SUM({gaussian_weight('(t.k-5)')} * s.v) AS v FROM {name}_t t "
               f"JOIN {name}_h s ON s.y = t.sy AND s.x = t.sx GROUP BY t.y, t.x")]


def reduce_lonlat(name: str, source: str, h: str, scale: int) -> list[tuple[str, str]]:
    """Triangular reduction by gathering all taps of each output."""
    s, span = scale, 2 * scale - 1
    w = lambda k: f"(1-ABS({k}-{s - 1})/{s}e0)/{s}e0"
    return [
        (f"{name}_g", f"SELECT a.i AS y, b.j AS x, p.k, q.k AS l, a.i*{s}+p.k-{s - 1} AS ty, b.j*{s}+q.k-{s - 1} AS tx "
                      f"FROM range(CAST({h}/{s} AS BIGINT)+1) a(i), range(CAST(2*{h}/{s} AS BIGINT)) b(j), "
                      f"range({span}) p(k), range({span}) q(k)"),
        (f"{name}_t", f"SELECT y, x, {w('k')}*{w('l')} AS w, {fold_y('ty', h)} AS sy, {fold_x('ty', 'tx', h)} AS sx FROM {name}_g"),
        (name, f"SELECT t.y, t.x, SUM(t.w*s.v) AS v FROM {name}_t t JOIN {source} s ON s.y=t.sy AND s.x=t.sx GROUP BY t.y, t.x")]


# ------------------------------------------------------------------------------- inputs
part("dims", [], "SELECT CAST(16*GREATEST(1, FLOOR(SQRT(COUNT(*)/15000e0))) AS BIGINT) AS h, "
                 "CAST(4*GREATEST(1, FLOOR(SQRT(COUNT(*)/210e0)/4)) AS BIGINT) AS n FROM lineitem")
part("pdims", [], "SELECT CAST(16*GREATEST(1, FLOOR(SQRT(COUNT(*)/3750e0))) AS BIGINT) AS h FROM orders")
part("tdims", [], "SELECT CAST(GREATEST(2, FLOOR(SQRT(COUNT(*)/6e0))) AS BIGINT) AS p, "
                  "CAST(4*(GREATEST(2, FLOOR(SQRT(COUNT(*)/6e0)))-2) AS BIGINT) AS n FROM embeddings")
part("points", [], "SELECT event_id AS point_id, -180e0+((event_id*7919)%36000)/100e0+3e-3 AS lon, "
                   "-90e0+((event_id*104729)%18000)/100e0+3e-3 AS lat, value FROM events")
part("dpoints", ["points"], f"SELECT *, {lonlat_direction()} FROM points")
part("items", ["dims"], f"""SELECT l_partkey % ({H}+1) AS y, (l_suppkey*31+l_linenumber+l_orderkey) % (2*{H}) AS x,
  (l_orderkey*31+l_partkey*7+l_suppkey*13+l_linenumber) % (6*({N}+1)*({N}+1)) AS cell,
  CAST(ROUND(l_extendedprice*100) AS BIGINT)-4000000 AS cents, CAST(ROUND(l_quantity) AS BIGINT) AS qty,
  CAST(ROUND(l_discount*100) AS BIGINT) AS disc, CAST(ROUND(l_tax*100) AS BIGINT) AS tax, l_linenumber AS ln FROM lineitem""")
part("node_field", ["items"], f"""SELECT y, x, CAST(SUM(cents) AS BIGINT)/(COUNT(*)*1007e0) AS v FROM items
  WHERE y NOT IN (0, {H}) GROUP BY y, x UNION ALL
  SELECT p.y, k.x, p.s/(p.c*1007e0) AS v FROM (SELECT y, CAST(SUM(cents) AS BIGINT) AS s, COUNT(*) AS c FROM items
  WHERE y IN (0, {H}) GROUP BY y) p, (SELECT DISTINCT x FROM items) k""")
CLIMATE = """CAST(SUM(cents) AS BIGINT)/(COUNT(*)*1007e0) AS elev, 30e0-CAST(SUM(qty) AS BIGINT)/(COUNT(*)*5e0) AS temp,
  300e0+CAST(SUM(disc) AS BIGINT)*10e0/COUNT(*) AS temp_std100, 400e0+CAST(SUM(tax) AS BIGINT)*200e0/COUNT(*) AS precip,
  40e0+CAST(SUM(ln) AS BIGINT)/(COUNT(*)*1e0) AS precip_cv"""
part("climate_nodes", ["items"], f"SELECT y, x, {CLIMATE} FROM items GROUP BY y, x")
part("cells", ["items"], f"""SELECT CAST(FLOOR(cell/(1e0*({N}+1)*({N}+1))) AS BIGINT) AS face,
  CAST(FLOOR(cell/(1e0*({N}+1))) AS BIGINT) % ({N}+1) AS y, cell % ({N}+1) AS x, * EXCLUDE (y, x) FROM items""")
part("cube_raw", ["cells"], "SELECT face, y, x, CAST(SUM(cents) AS BIGINT)/(COUNT(*)*1007e0) AS v FROM cells GROUP BY face, y, x")
part("cube_field_k", ["cube_raw"], f"SELECT *, {key(N)} FROM cube_raw")
part("cube_field", ["cube_field_k"], "SELECT face, y, x, AVG(v) OVER (PARTITION BY kx, ky, kz) AS v, kx, ky, kz FROM cube_field_k")
part("cube_climate_m", ["cells"], f"SELECT face, y, x, {CLIMATE} FROM cells GROUP BY face, y, x")
part("cube_climate_k", ["cube_climate_m"], f"SELECT * EXCLUDE (elev), {sign_root('elev')} AS z, {key(N)} FROM cube_climate_m")
part("cube_climate", ["cube_climate_k"], "SELECT face, y, x, " + ", ".join(
    f"AVG({c}) OVER (PARTITION BY kx, ky, kz) AS {c}" for c in ("z", "temp", "temp_std100", "precip", "precip_cv"))
    + " FROM cube_climate_k")
part("px", ["pdims"], f"""SELECT o_orderkey % {PH} AS row_i,
  (o_custkey*7+CAST(FLOOR(o_orderkey/(1e0*{PH})) AS BIGINT)) % (2*{PH}) AS col_i,
  CAST(SUM(CAST(ROUND(o_totalprice*100) AS BIGINT)) AS BIGINT) AS s, COUNT(*) AS c,
  COUNT(*) FILTER (o_orderstatus = 'P') AS open FROM orders GROUP BY 1, 2""")
part("pixels", ["px"], "SELECT row_i, col_i, CASE WHEN open > 0 THEN s/(c*5003e0)-4000e0 END AS v FROM px")
part("bright", ["px"], """SELECT row_i, col_i, CASE WHEN c % 2 = 0 THEN s % 65536 ELSE s % 256 END AS code,
  CASE WHEN c % 2 = 0 THEN 16 ELSE 8 END AS bits, CASE WHEN open > 0 THEN 1e0 ELSE 0e0 END AS alpha FROM px""")
part("tiles", ["tdims"], f"""SELECT vec_id % 6 AS face, -4+4*(slot // {P}) AS ty, -4+4*(slot % {P}) AS tx, tile, vec_id, label
  FROM (SELECT *, CAST(FLOOR(vec_id/6e0) AS BIGINT) % ({P}*{P}) AS slot, embedding AS tile FROM embeddings)""")
part("tile_cells", ["tiles"], """SELECT face, ty, tx, vec_id, k // 8 AS dy, k % 8 AS dx, ty + k // 8 AS y, tx + k % 8 AS x,
  CAST(tile[k+1] AS DOUBLE) AS v FROM tiles, range(64) t(k)""")
part("requests", [], """SELECT event_id AS request_id, ts, -180e0+((event_id*137)%360) AS west, -90e0+((event_id*53)%171) AS south,
  CASE WHEN (event_id*137)%360 > 340 THEN -180e0+((event_id*137)%360)-340e0 ELSE -180e0+((event_id*137)%360)+20e0 END AS east,
  -90e0+((event_id*53)%171)+CASE WHEN event_id%10=9 THEN -10e0 ELSE 10e0 END AS north, 4 AS width, 2 AS height FROM events""")
part("region_px", ["requests"], """SELECT request_id, ts, i AS row_i, j AS col_i,
  west+(j+0.5e0)*(CASE WHEN east<west THEN east+360 ELSE east END-west)/width AS lon, north-(i+0.5e0)*(north-south)/height AS lat
  FROM requests, range(2) a(i), range(4) b(j) WHERE south < north AND north <= 90""")
part("region_d", ["region_px"], f"SELECT *, {lonlat_direction()} FROM region_px")
part("cube_nodes", ["dims"], f"SELECT f AS face, a AS y, b AS x FROM range(6) r(f), range({N}+1) s(a), range({N}+1) t(b)")
part("lonlat_nodes", ["dims"], f"SELECT a AS y, b AS x FROM range({H}+1) s(a), range(2*{H}) t(b)")
