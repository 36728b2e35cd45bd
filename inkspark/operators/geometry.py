"""Polygon geometry: column expressions where a formula does, numpy kernels over Arrow batches for the rest.

Points are array<struct<x double, y double>>, rings aren't closed.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINTS = "array<struct<x:double,y:double>>"
RECT = "struct<x:double,y:double,height:double,width:double,angle:double>"
BOX = f"struct<polygon:{POINTS},rotatedRectangle:{RECT},rectangle:struct<x:double,y:double,height:double,width:double>>"


def _point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def scale(points: Column, by: Column) -> Column:
    return F.transform(points, lambda p: _point(p["x"] * by, p["y"] * by))


def clamp(points: Column, height: Column, width: Column) -> Column:
    bound = lambda v, top: F.greatest(F.lit(0.0), F.least(v, top))
    return F.transform(points, lambda p: _point(bound(p["x"], width), bound(p["y"], height)))


def _edges(points: Column, term) -> Column:
    following = F.concat(F.slice(points, F.lit(2), F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))
    return F.aggregate(F.zip_with(points, following, term), F.lit(0.0), lambda a, b: a + b)


def perimeter(points: Column) -> Column:
    return _edges(points, lambda p, q: F.sqrt((q["x"] - p["x"]) * (q["x"] - p["x"]) + (q["y"] - p["y"]) * (q["y"] - p["y"])))


def area(points: Column) -> Column:
    return F.abs(_edges(points, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])) / 2


def offset_amount(points: Column, ratio: float = 1.5) -> Column:
    """By how much a dilation moves the edges out; null without perimeter."""
    return F.try_divide(area(points) * ratio, perimeter(points))


def clockwise_sum(points: Column) -> Column:
    """Positive for points in the order that the evaluation rejects."""
    return _edges(points, lambda p, q: (q["x"] - p["x"]) * (q["y"] + p["y"]))


def in_bounds(points: Column, width: Column, height: Column) -> Column:
    return F.forall(points, lambda p: p["x"].between(0, width) & p["y"].between(0, height))


def rounded(points: Column) -> Column:
    return F.transform(points, lambda p: F.struct(F.bround(p["x"]).cast("int").alias("x"), F.bround(p["y"]).cast("int").alias("y")))


def rect_corners(rect: Column) -> Column:
    """Top left, top right, bottom right, bottom left of a rotated rectangle."""
    c, s = F.cos(rect["angle"]), F.sin(rect["angle"])
    x, y, w, h = rect["x"], rect["y"], rect["width"], rect["height"]
    return F.array(_point(x, y), _point(x + w * c, y + w * s), _point(x + w * c - h * s, y + w * s + h * c), _point(x - h * s, y + h * c))


def bounds(points: Column) -> Column:
    """Axis-aligned rectangle around points."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x"), F.array_min(ys).alias("y"), (F.array_max(ys) - F.array_min(ys)).alias("height"), (F.array_max(xs) - F.array_min(xs)).alias("width"))


def aabb_corners(rect: Column) -> Column:
    x, y, w, h = rect["x"], rect["y"], rect["width"], rect["height"]
    return F.array(_point(x, y), _point(x + w, y), _point(x + w, y + h), _point(x, y + h))


def quad_from_ints(values: Column) -> Column:
    """Four points from eight numbers, truncated."""
    return F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.struct(F.get(values, 2 * i).cast("int").alias("x"), F.get(values, 2 * i + 1).cast("int").alias("y")))


def aabb_intersection(a: Column, b: Column) -> Column:
    w = F.least(a["x"] + a["width"], b["x"] + b["width"]) - F.greatest(a["x"], b["x"])
    h = F.least(a["y"] + a["height"], b["y"] + b["height"]) - F.greatest(a["y"], b["y"])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def aabb_iou(a: Column, b: Column) -> Column:
    inter = aabb_intersection(a, b)
    union = a["width"] * a["height"] + b["width"] * b["height"] - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def text_placement(points: Column) -> Column:
    """Centre, angle in degrees and font size of a text in a box's four corners."""
    mean = lambda c: F.aggregate(points, F.lit(0.0), lambda a, p: a + p[c]) / 4
    tl, tr, bl = points[0], points[1], points[3]
    return F.struct(
        mean("x").alias("cx"), mean("y").alias("cy"),
        F.degrees(F.atan2(tr["y"] - tl["y"], tr["x"] - tl["x"])).alias("angle"),
        F.hypot(bl["x"] - tl["x"], bl["y"] - tl["y"]).alias("font"),
    )


def font_fit(width: Column, height: Column, text: Column) -> Column:
    return F.least(width / (0.55 * F.length(text)), height)


def fit_to_view(width: Column, height: Column, view_width: Column, view_height: Column) -> Column:
    """struct<x, y, scale> that centres an image in a view, at 95 % of what fits and no larger than it is."""
    scale_by = F.least(view_width / width, view_height / height, F.lit(1.0)) * 0.95
    return F.when((view_width > 0) & (view_height > 0), F.struct(((view_width - width * scale_by) / 2).alias("x"), ((view_height - height * scale_by) / 2).alias("y"), scale_by.alias("scale"))).otherwise(
        F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(1.0).alias("scale"))
    )


def zoomed(view: Column, factor: Column, view_width: Column, view_height: Column) -> Column:
    """The view enlarged about its middle; its scale stays from 0.1 to 10."""
    old = F.when(view["scale"] > 0, view["scale"]).otherwise(1.0)
    new = F.greatest(F.lit(0.1), F.least(F.lit(10.0), old * factor))
    moved = lambda side, v: side / 2 - (side / 2 - v) * new / old
    return F.struct(moved(view_width, view["x"]).alias("x"), moved(view_height, view["y"]).alias("y"), new.alias("scale"))


# Kernels on arrays of shape (n, 2).


def hull(points: np.ndarray) -> np.ndarray | None:
    """Strict convex hull, beginning after the lowest point and running against its polar order; None below three corners."""
    if len(points) < 3:
        return None
    own = sorted(set(map(tuple, points.tolist())))

    def chain(seq):
        out: list[tuple[float, float]] = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    ring = chain(own) + chain(own[::-1])
    if len(ring) < 3:
        return None
    first = min(range(len(ring)), key=lambda i: (ring[i][1], ring[i][0]))
    return np.array((ring[first:] + ring[:first])[::-1])


def rectangle_of(corners: np.ndarray) -> dict[str, float]:
    """x, y, height, width and angle of four corners in ring order.

    With the ring turned so that each corner's next side lies clockwise of it (y points down), every corner can be the top left
    one of the same rectangle. Of the two long sides the upper begins there, of upright ones that which points down; of a
    square, the corner next to the origin does, then the upper, then the left one.
    """
    ring = corners if _signed(corners) >= 0 else corners[::-1]
    side = np.roll(ring, -1, 0) - ring
    length = np.hypot(side[:, 0], side[:, 1])
    gap = length[0] + length[2] - length[1] - length[3]
    if abs(gap) < 2e-6:
        keys = (ring[:, 0], ring[:, 1], np.round((ring**2).sum(1), 6))
    else:
        short = np.arange(4) % 2 == (gap > 0)
        keys = (-side[:, 1], np.round(2 * ring[:, 1] + side[:, 1], 6), short)
    i = int(np.lexsort(keys)[0])
    return {"x": float(ring[i, 0]), "y": float(ring[i, 1]), "height": float(length[(i + 1) % 4]), "width": float(length[i]), "angle": math.atan2(side[i, 1], side[i, 0])}


def min_area_rectangle(ring: np.ndarray) -> dict[str, float] | None:
    """The smallest rectangle with a side along a hull edge; the first of equals."""
    edges = np.roll(ring, -1, 0) - ring
    edges = edges[(edges != 0).any(1)]
    unit = edges / np.hypot(*edges.T)[:, None]
    normal = np.stack([-unit[:, 1], unit[:, 0]], 1)
    u, n = unit @ ring.T, normal @ ring.T
    size = (u.max(1) - u.min(1)) * (n.max(1) - n.min(1))
    size[size < 1e-8] = np.inf
    if not len(size) or np.isinf(size).all():
        return None
    i = int(np.argmin(size))
    ends = [(u[i].min(), n[i].max()), (u[i].max(), n[i].max()), (u[i].max(), n[i].min()), (u[i].min(), n[i].min())]
    return rectangle_of(np.array([a * unit[i] + b * normal[i] for a, b in ends]))


def clip_area(a: np.ndarray, b: np.ndarray) -> float:
    """Area of the intersection of two convex rings: one is cut along each edge of the other."""
    if _signed(b) < 0:
        b = b[::-1]
    ring = [tuple(p) for p in (a if _signed(a) >= 0 else a[::-1])]
    for p, q in zip(b, np.roll(b, -1, 0), strict=True):
        side = [(q[0] - p[0]) * (y - p[1]) - (q[1] - p[1]) * (x - p[0]) for x, y in ring]
        new = []
        for i, (point, s) in enumerate(zip(ring, side, strict=True)):
            after, t = ring[(i + 1) % len(ring)], side[(i + 1) % len(ring)]
            if s >= 0:
                new.append(point)
            if s * t < 0:
                new.append((point[0] + (after[0] - point[0]) * s / (s - t), point[1] + (after[1] - point[1]) * s / (s - t)))
        ring = new
        if len(ring) < 3:
            return 0.0
    return abs(_signed(np.array(ring)))


#: Corners of pairs that are clipped at once.
_CLIPPED = 1 << 17


def _ring_numbers(ends: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(ends) - 1), np.diff(ends))


def _shoelace(x: np.ndarray, y: np.ndarray, owner: np.ndarray, rings: int) -> np.ndarray:
    """Signed areas of rings whose corners stand in a row, each with its ring's number."""
    following = _following(owner)
    return np.bincount(owner, x * y[following] - x[following] * y, rings) / 2


def _following(owner: np.ndarray) -> np.ndarray:
    """Where the corner after each one stands in its ring."""
    turn = np.flatnonzero(owner[1:] != owner[:-1]) + 1
    at = np.arange(1, len(owner) + 1)
    if len(at):
        at[np.append(turn, len(at)) - 1] = np.append(0, turn)
    return at


def clockwise(points: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rings (corners from one end to the next) turned so that their signed areas aren't negative, and these areas."""
    owner = _ring_numbers(ends)
    size = _shoelace(*points.T, owner, len(ends) - 1)
    at = np.arange(len(points))
    back = size[owner] < 0
    at[back] = (ends[:-1] + ends[1:] - 1)[owner[back]] - at[back]
    return points[at], np.abs(size)


def convex(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether each of rings from `clockwise` surely is strictly convex: three or four corners, all turning the same way."""
    owner = _ring_numbers(ends)
    following = _following(owner)
    side = points[following] - points
    turn = side[:, 0] * side[following, 1] - side[:, 1] * side[following, 0]
    n = np.diff(ends)
    return (np.bincount(owner, turn > 0, len(n)) == n) & ((n == 3) | (n == 4))


def clip_areas(a: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_ends: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """`clip_area` of many pairs at once: of rings number i of a with rings number j of b, both from `clockwise`."""
    n, m = np.diff(a_ends)[i], np.diff(b_ends)[j]
    out = np.zeros(len(i))
    # pairs whose second rings have about as many edges go together
    order = np.argsort(np.frexp(m)[1], kind="stable")
    part = np.cumsum((n + m)[order]) // _CLIPPED
    edges = np.frexp(m[order])[1]
    cuts = np.flatnonzero((part[1:] != part[:-1]) | (edges[1:] != edges[:-1])) + 1
    for some in np.split(order, cuts):
        some = some[(n[some] > 2) & (m[some] > 2)]
        if len(some):
            out[some] = _clipped(a, a_ends[i[some]], n[some], b, b_ends[j[some]], m[some])
    return out


def _clipped(a: np.ndarray, a_first: np.ndarray, n: np.ndarray, b: np.ndarray, b_first: np.ndarray, m: np.ndarray) -> np.ndarray:
    owner = np.repeat(np.arange(len(n)), n)
    x, y = a[np.arange(len(owner)) + np.repeat(a_first - np.cumsum(n) + n, n)].T
    for edge in range(m.max()):
        # a ring with fewer edges has one from a corner to itself, which cuts nothing
        p = b[b_first + np.where(edge < m, edge, 0)]
        step = b[b_first + np.where(edge + 1 < m, edge + 1, 0)] - p
        side = step[owner, 0] * (y - p[owner, 1]) - step[owner, 1] * (x - p[owner, 0])
        following = _following(owner)
        after = side[following]
        keep, cross = side >= 0, side * after < 0
        if keep.all():
            continue
        made = keep.astype(np.int64) + cross
        to = np.cumsum(made) - made
        c = np.flatnonzero(cross)
        where, s, t, next_one = to[c] + keep[c], side[c], after[c], following[c]
        cut = []
        for v in (x, y):
            new = np.empty(made.sum())
            new[to[keep]] = v[keep]
            new[where] = v[c] + (v[next_one] - v[c]) * s / (s - t)
            cut.append(new)
        x, y = cut
        owner = np.repeat(owner, made)
    return np.abs(_shoelace(x, y, owner, len(n)))


def _signed(ring: np.ndarray) -> float:
    x, y = ring.T
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2)


def iou(a: np.ndarray, b: np.ndarray) -> float:
    inter = clip_area(a, b)
    union = abs(_signed(a)) + abs(_signed(b)) - inter
    return inter / union if union > 0 else 0.0


def simplify(points: np.ndarray, epsilon: float = 1.0) -> np.ndarray:
    """Drop, again and again, the inner point nearest to the line through its neighbours while it is within epsilon."""
    if len(points) <= 3:
        return points
    ring = [tuple(p) for p in points.tolist()]

    def off(i: int) -> float:
        (ax, ay), (px, py), (bx, by) = ring[i - 1], ring[i], ring[i + 1]
        base = math.hypot(bx - ax, by - ay)
        return math.hypot(px - ax, py - ay) if not base else abs((bx - ax) * (py - ay) - (by - ay) * (px - ax)) / base

    while len(ring) > 3:
        i = min(range(1, len(ring) - 1), key=off)
        if off(i) > epsilon:
            break
        del ring[i]
    return np.array(ring, np.float32).astype(float)


def dilated(points: np.ndarray, ratio: float = 1.5, arc: float = 0.25) -> np.ndarray | None:
    """A convex or nearly convex ring moved outwards by area * ratio / perimeter, with round corners, rounded to integers."""
    if len(points) < 3:
        return None
    around = float(np.hypot(*(np.roll(points, -1, 0) - points).T).sum())
    if around == 0:
        return None
    by = abs(_signed(points)) * ratio / around
    ring = points if _signed(points) >= 0 else points[::-1]
    steps = max(8, int(math.ceil(math.pi / max(1e-3, math.acos(max(-1.0, 1 - arc / max(by, arc)))))))
    out = []
    edges = np.roll(ring, -1, 0) - ring
    angles = np.arctan2(-edges[:, 0], edges[:, 1])
    for i, p in enumerate(ring):
        a, b = angles[i - 1], angles[i]
        turn = (b - a) % (2 * math.pi)
        if turn > math.pi:  # inward corner: the edges' offset lines meet
            mid = a + (turn - 2 * math.pi) / 2
            d = by / max(0.1, math.cos((turn - 2 * math.pi) / 2))
            out.append((p[0] + d * math.cos(mid), p[1] + d * math.sin(mid)))
            continue
        n = max(1, int(math.ceil(turn / (2 * math.pi) * steps)))
        out += [(p[0] + by * math.cos(a + turn * k / n), p[1] + by * math.sin(a + turn * k / n)) for k in range(n + 1)]
    made = np.rint(np.array(out))
    keep = (made != np.roll(made, 1, 0)).any(1)
    return made[keep] if keep.sum() >= 3 else None


def bounding_box(points: np.ndarray, scale_by: float, width: int, height: int, epsilon: float = 4.0, ratio: float = 1.5) -> dict | None:
    """The box of a traced boundary in the image it was found in, or None where a step has no result."""
    ring = dilated(simplify(points, epsilon) / scale_by, ratio)
    if ring is None:
        return None
    ring = np.clip(ring, 0, [width - 1, height - 1])
    corners = hull(ring)
    rect = None if corners is None else min_area_rectangle(corners)
    if rect is None:
        return None
    c, s = math.cos(rect["angle"]), math.sin(rect["angle"])
    xs = [rect["x"] + a * rect["width"] * c - b * rect["height"] * s for a, b in ((0, 0), (1, 0), (1, 1), (0, 1))]
    ys = [rect["y"] + a * rect["width"] * s + b * rect["height"] * c for a, b in ((0, 0), (1, 0), (1, 1), (0, 1))]
    flat = {"x": min(xs), "y": min(ys), "height": max(ys) - min(ys), "width": max(xs) - min(xs)}
    return {"polygon": [{"x": float(x), "y": float(y)} for x, y in ring], "rotatedRectangle": rect, "rectangle": flat}


def _doubles(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.DoubleType()) for n in names])


_POINT_LIST = T.ArrayType(_doubles("x", "y"))


def _array(points) -> np.ndarray:
    return np.array([(p["x"], p["y"]) for p in points], float).reshape(-1, 2)


@F.pandas_udf(_POINT_LIST)
def hull_udf(points: pd.Series) -> pd.Series:
    made = (hull(_array(p)) for p in points)
    return pd.Series([None if h is None else [{"x": x, "y": y} for x, y in h.tolist()] for h in made])


@F.pandas_udf(_doubles("x", "y", "height", "width", "angle"))
def min_rect_udf(points: pd.Series) -> pd.DataFrame:
    rows = []
    for p in points:
        ring = hull(_array(p))
        rows.append((min_area_rectangle(ring) if ring is not None else None) or dict.fromkeys(("x", "y", "height", "width", "angle")))
    return pd.DataFrame(rows, columns=["x", "y", "height", "width", "angle"]).astype(float)


@F.pandas_udf(T.DoubleType())
def intersection_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([clip_area(_array(p), _array(q)) for p, q in zip(a, b, strict=True)], dtype=float)


@F.pandas_udf(_POINT_LIST)
def simplify_udf(points: pd.Series, epsilon: pd.Series) -> pd.Series:
    return pd.Series([[{"x": x, "y": y} for x, y in simplify(_array(p), e).tolist()] for p, e in zip(points, epsilon, strict=True)])
