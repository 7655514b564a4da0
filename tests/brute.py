"""Dense per-point references for small grids, written with tangents and plain loops."""
import math

N = [(1, 0, 0), (0, 1, 0), (-1, 0, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]
R = [(0, 1, 0), (-1, 0, 0), (0, -1, 0), (1, 0, 0), (0, 1, 0), (0, 1, 0)]
D = [(0, 0, -1)] * 4 + [(1, 0, 0), (-1, 0, 0)]


def unit(v):
    s = math.sqrt(sum(c * c for c in v))
    return tuple(c / s for c in v)


def direction(f, y, x, n):
    """Inside a face: normal plus tangents of the two chart angles."""
    a, b = (math.tan(math.pi / 4 * (2 * i / n - 1)) for i in (x, y))
    return unit(tuple(N[f][k] + a * R[f][k] + b * D[f][k] for k in range(3)))


def great_circle(f, y, x, n):
    """Any index: rotate along the right axis, and the down axis, from the face centre."""
    a, b = (math.pi / 4 * (2 * i / n - 1) for i in (x, y))
    return unit(tuple(math.cos(a) * math.cos(b) * N[f][k] + math.sin(a) * math.cos(b) * R[f][k]
                      + math.cos(a) * math.sin(b) * D[f][k] for k in range(3)))


def owner(v):
    best = max(range(3), key=lambda k: (abs(v[k]), -k))
    return ((0, 2), (1, 3), (4, 5))[best][0 if v[best] >= 0 else 1]


def chart(v, n):
    f = owner(v)
    dot = lambda axis: sum(p * q for p, q in zip(v, axis))
    y, x = (n * (1 + math.atan2(dot(axis), dot(N[f])) / (math.pi / 4)) / 2 for axis in (D[f], R[f]))
    return f, min(max(y, 0), n), min(max(x, 0), n)


def bilinear(field, f, y, x, n):
    i, j = int(min(math.floor(y), n - 1)), int(min(math.floor(x), n - 1))
    p, q = y - i, x - j
    return ((1 - p) * ((1 - q) * field[f, i, j] + q * field[f, i, j + 1])
            + p * ((1 - q) * field[f, i + 1, j] + q * field[f, i + 1, j + 1]))


def sample(field, v, n):
    return bilinear(field, *chart(v, n), n)


def read(field, f, y, x, n):
    return bilinear(field, f, y, x, n) if 0 <= y <= n and 0 <= x <= n else sample(field, great_circle(f, y, x, n), n)


def groups(n):
    """Chart entries by rounded position on the cube surface."""
    out = {}
    for f in range(6):
        for y in range(n + 1):
            for x in range(n + 1):
                p = tuple(n * N[f][k] + (2 * x - n) * R[f][k] + (2 * y - n) * D[f][k] for k in range(3))
                out.setdefault(p, []).append((f, y, x))
    return out


def identify(field, n):
    out = dict(field)
    for members in groups(n).values():
        mean = sum(field[m] for m in members) / len(members)
        for m in members:
            out[m] = mean
    return out


def filter_axis(field, n, weights, axis):
    r = len(weights) // 2
    out = {}
    for f in range(6):
        for y in range(n + 1):
            for x in range(n + 1):
                out[f, y, x] = sum(w * (read(field, f, y + o, x, n) if axis == "y" else read(field, f, y, x + o, n))
                                   for o, w in zip(range(-r, r + 1), weights))
    return identify(out, n)


def fold(y, x, h):
    y %= 2 * h
    return (2 * h - y, (x + h) % (2 * h)) if y > h else (y, x % (2 * h))


def lonlat(field, y, x, h):
    i, j = math.floor(y), math.floor(x)
    p, q = y - i, x - j
    at = lambda a, b: field[fold(a, b, h)]
    return (1 - p) * ((1 - q) * at(i, j) + q * at(i, j + 1)) + p * ((1 - q) * at(i + 1, j) + q * at(i + 1, j + 1))
