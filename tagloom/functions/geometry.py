"""Polygons: Catalyst expressions where boxes are axis-aligned, numpy kernels for the rest."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def area(points: Column) -> Column:
    """Shoelace area of an array of [x, y]; 0.0 for fewer than three points."""
    n = F.size(points)
    following = F.concat(F.slice(points, F.lit(2), F.greatest(n - 1, F.lit(0))), F.slice(points, F.lit(1), F.least(n, F.lit(1))))
    crosses = F.zip_with(points, following, lambda p, q: p[0] * q[1] - q[0] * p[1])
    return F.when(n < 3, F.lit(0.0)).otherwise(F.abs(F.aggregate(crosses, F.lit(0.0), lambda a, x: a + x)) / 2)


def bounds(points: Column) -> tuple[Column, Column, Column, Column]:
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    return F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)


def centre(points: Column) -> tuple[Column, Column]:
    """The mean of the corners."""
    total = lambda k: F.aggregate(points, F.lit(0.0), lambda a, p: a + p[k])
    return total(0) / F.size(points), total(1) / F.size(points)


def principal_axis(points: Column) -> tuple[Column, Column]:
    """Direction in which the corners spread most, to +x, or to +y where it is vertical."""
    zero = F.struct(*[F.lit(0.0).alias(k) for k in ("x", "y", "xx", "yy", "xy")])

    def add(a: Column, p: Column) -> Column:
        x, y = p[0] - points[0][0], p[1] - points[0][1]
        return F.struct((a["x"] + x).alias("x"), (a["y"] + y).alias("y"), (a["xx"] + x * x).alias("xx"), (a["yy"] + y * y).alias("yy"), (a["xy"] + x * y).alias("xy"))

    turn = lambda s: 0.5 * F.atan2(2 * (s["xy"] - s["x"] * s["y"] / F.size(points)), s["xx"] - s["x"] * s["x"] / F.size(points) - (s["yy"] - s["y"] * s["y"] / F.size(points)))
    angle = F.aggregate(points, zero, add, turn)
    return F.cos(angle), F.sin(angle)


def crop_size(points: Column) -> Column:
    """Struct (w, h) of the crop of a box of four corners: the longer of each two opposite sides, cut to whole pixels."""
    side = lambda i, j: F.sqrt(F.pow(points[i][0] - points[j][0], 2) + F.pow(points[i][1] - points[j][1], 2))
    return F.struct(F.floor(F.greatest(side(0, 1), side(2, 3))).cast("int").alias("w"), F.floor(F.greatest(side(0, 3), side(1, 2))).cast("int").alias("h"))


def box_area(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return (x1 - x0) * (y1 - y0)


def box_intersection(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    width = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    height = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.when((width > 0) & (height > 0), width * height).otherwise(F.lit(0.0))


def box_iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    common = box_intersection(a, b)
    union = box_area(*a) + box_area(*b) - common
    return F.when(union > 0, common / union).otherwise(F.lit(0.0))


# Kernels on numpy arrays of shape (n, 2).


def np_area(p: np.ndarray) -> float:
    """Signed area, anticlockwise positive."""
    if len(p) < 3:
        return 0.0
    x, y = p[:, 0], p[:, 1]
    return float(np.dot(x, np.roll(y, -1)) - np.dot(np.roll(x, -1), y)) / 2


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull, anticlockwise, without points on its edges."""
    pts = sorted({(float(x), float(y)) for x, y in points})
    if len(pts) < 3:
        return np.array(pts, float).reshape(-1, 2)

    def half(seq: list[tuple[float, float]]) -> list[tuple[float, float]]:
        out: list[tuple[float, float]] = []
        for q in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(half(pts) + half(pts[::-1]), float)


def _turn(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Twice the signed area of triangles."""
    return (b[..., 0] - a[..., 0]) * (c[..., 1] - a[..., 1]) - (b[..., 1] - a[..., 1]) * (c[..., 0] - a[..., 0])


def crossings(p: np.ndarray) -> np.ndarray:
    """Of polygons of one size (k, n, 2): which have two edges that cross inside both."""
    n, out = p.shape[1], np.zeros(len(p), bool)
    for i in range(n):
        for j in range(i + 2, n - (i == 0)):
            a, b, c, d = p[:, i], p[:, i + 1], p[:, j], p[:, (j + 1) % n]
            out |= (np.sign(_turn(a, b, c)) * np.sign(_turn(a, b, d)) < 0) & (np.sign(_turn(c, d, a)) * np.sign(_turn(c, d, b)) < 0)
    return out


def simple_loops(p: np.ndarray) -> list[np.ndarray]:
    """The simple polygons that stand for one that may cross itself.

    It is cut where edges cross until no loop crosses itself; loops that turn like the whole are kept (where
    both ways enclose as much, those that turn like its uppermost corner).  A simple polygon stands for itself.
    """
    p, loops, todo = np.asarray(p, float).reshape(-1, 2), [], []
    todo.append(p)
    while todo:
        q = todo.pop()
        n, cut = len(q), None
        for i in range(n):
            for j in range(i + 2, n - (i == 0)):
                a, b, c, d = q[i], q[i + 1], q[j], q[(j + 1) % n]
                if _turn(a, b, c) * _turn(a, b, d) < 0 and _turn(c, d, a) * _turn(c, d, b) < 0:
                    t = _turn(c, d, a) / (_turn(c, d, a) - _turn(c, d, b))
                    cut = (i, j, a + t * (b - a))
                    break
            if cut:
                break
        if cut is None:
            loops.append(q)
            continue
        i, j, x = cut
        todo += [np.vstack([x, q[i + 1 : j + 1]]), np.vstack([q[: i + 1], x, q[j + 1 :]])]
    if len(loops) == 1:
        return loops
    whole = sum(map(np_area, loops))
    if abs(whole) <= 1e-9 * sum(abs(np_area(x)) for x in loops):
        top = int(np.lexsort((p[:, 0], p[:, 1]))[-1])
        whole = float(_turn(p[top - 1], p[top], p[(top + 1) % len(p)]))
    return [x for x in loops if np_area(x) * whole > 0]


def fans(points: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Signed triangles whose sum is each polygon: (triangles, signs, the polygon of each, areas of polygons).

    ``points`` are the polygons' corners end to end, ``at`` n + 1 offsets.  Simple polygons are fanned out from
    their first corner, others from that of each of their loops.
    """
    size = np.diff(at)
    bad = np.zeros(len(size), bool)
    for n in np.unique(size[size > 3]):
        rows = np.flatnonzero(size == n)
        bad[rows] = crossings(points[at[rows, None] + np.arange(n)])
    good = np.flatnonzero((size >= 3) & ~bad)
    count = size[good] - 2
    owner = np.repeat(good, count)
    step = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    first = at[owner]
    tri = np.stack([points[first], points[first + step + 1], points[first + step + 2]], axis=1) if len(owner) else np.empty((0, 3, 2))
    for k in np.flatnonzero(bad):
        for loop in simple_loops(points[at[k] : at[k + 1]]):
            more = np.stack([np.repeat(loop[:1], len(loop) - 2, axis=0), loop[1:-1], loop[2:]], axis=1)
            tri, owner = np.concatenate([tri, more]), np.concatenate([owner, np.full(len(more), k)])
    twice = _turn(tri[:, 0], tri[:, 1], tri[:, 2])
    total = np.bincount(owner, twice, minlength=len(size)) / 2
    sign = np.sign(twice) * np.sign(total)[owner]
    tri = np.where((twice < 0)[:, None, None], tri[:, ::-1], tri)
    return tri, sign, owner, np.abs(total)


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Areas common to pairs of anticlockwise triangles, clipped at one side of the other after the other."""
    n = len(a)
    poly, count = a, np.full(n, 3)
    for k in range(3):
        p, q = b[:, None, k], b[:, None, (k + 1) % 3]
        side = _turn(p, q, poly)
        slot = np.arange(poly.shape[1])
        live = slot < count[:, None]
        following = np.where(slot + 1 < count[:, None], slot + 1, 0)
        other, after = np.take_along_axis(side, following, 1), np.take_along_axis(poly, following[:, :, None], 1)
        cut = live & ((side >= 0) != (other >= 0))
        t = np.divide(side, side - other, out=np.zeros_like(side), where=cut)
        both = np.stack([poly, poly + t[:, :, None] * (after - poly)], axis=2).reshape(n, -1, 2)
        mask = np.stack([live & (side >= 0), cut], axis=2).reshape(n, -1)
        order = np.argsort(~mask, axis=1, kind="stable")[:, : poly.shape[1] + 1]
        count = mask.sum(axis=1)
        poly = np.take_along_axis(both, order[:, :, None], 1)
    poly = np.where((np.arange(poly.shape[1]) < count[:, None])[:, :, None], poly, poly[:, :1])
    x, y = poly[..., 0] - poly[:, :1, 0], poly[..., 1] - poly[:, :1, 1]
    return np.abs((x * np.roll(y, -1, axis=1) - np.roll(x, -1, axis=1) * y).sum(axis=1)) / 2


def overlaps(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], most: int = 100_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(common area, area of the first, area of the second) of pairs of polygons of any shape, given as in ``fans``.

    Exact: the common area of two polygons is the signed sum over their triangles' common areas.
    """
    ta, sa, oa, area_a = fans(*a)
    tb, sb, ob, area_b = fans(*b)
    pairs = len(area_a)
    by_a, by_b = np.argsort(oa, kind="stable"), np.argsort(ob, kind="stable")
    na, nb = np.bincount(oa, minlength=pairs), np.bincount(ob, minlength=pairs)
    fa, fb = np.cumsum(na) - na, np.cumsum(nb) - nb
    inter, total = np.zeros(pairs), na * nb
    begin = 0
    while begin < pairs:
        end = max(begin + 1, int(np.searchsorted(np.cumsum(total[begin:]), most, "right")) + begin)
        row = np.repeat(np.arange(begin, end), total[begin:end])
        nth = np.arange(len(row)) - np.repeat(np.cumsum(total[begin:end]) - total[begin:end], total[begin:end])
        i, j = by_a[fa[row] + nth // np.maximum(nb[row], 1)], by_b[fb[row] + nth % np.maximum(nb[row], 1)]
        if len(row):
            inter += np.bincount(row, _common(ta[i], tb[j]) * sa[i] * sb[j], minlength=pairs)
        begin = end
    inter[inter <= 1e-12 * np.minimum(area_a, area_b)] = 0.0
    return inter, area_a, area_b


def _one(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = np.asarray(p, float).reshape(-1, 2)
    return p, np.array([0, len(p)])


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Area common to two polygons of any shape."""
    return float(overlaps(_one(a), _one(b))[0][0])


def iou(a: np.ndarray, b: np.ndarray) -> float:
    common, area_a, area_b = (float(x[0]) for x in overlaps(_one(a), _one(b)))
    total = area_a + area_b - common
    return common / total if total > 0 else 0.0


def min_area_rect(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
    """(centre, unit direction of the long side, length, height) of the smallest rectangle around the points.

    The direction points to +x, or to +y where it is vertical; of a square's sides the one nearer to +x is the long one.
    """
    h = hull(np.asarray(points, float).reshape(-1, 2))
    if len(h) == 0:
        return np.zeros(2), np.array([1.0, 0.0]), 0.0, 0.0
    if len(h) == 1:
        return h[0], np.array([1.0, 0.0]), 0.0, 0.0
    best = None
    edges = np.roll(h, -1, axis=0) - h if len(h) > 2 else (h[1:] - h[:1])
    for e in edges:
        size = np.hypot(*e)
        if size == 0:
            continue
        u = e / size
        v = np.array([-u[1], u[0]])
        s, t = h @ u, h @ v
        w, ht = s.max() - s.min(), t.max() - t.min()
        if best is None or w * ht < best[0] - 1e-12:
            best = (w * ht, u, v, (s.max() + s.min()) / 2, (t.max() + t.min()) / 2, w, ht)
    _, u, v, cs, ct, w, ht = best
    centre = cs * u + ct * v
    if ht > w * (1 + 1e-9) or (abs(ht - w) <= 1e-9 * max(w, 1.0) and abs(v[0]) > abs(u[0]) + 1e-12):
        u, w, ht = v, ht, w
    if u[0] < -1e-9 or (abs(u[0]) <= 1e-9 and u[1] < 0):
        u = -u
    return centre, u, float(w), float(ht)
