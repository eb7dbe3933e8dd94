"""Points, polygons, lines and grids as column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from visiontables.functions.boxes import Box, Obb, let, obb_corners

Points = Sequence[tuple[float, float]]


def map_points(pts: Column, fx, fy) -> Column:
    """Rewrite x and y of every point of an ``array<struct<x,y,..>>``."""
    return F.transform(pts, lambda p: p.withField("x", fx(p["x"])).withField("y", fy(p["y"])))


def _edges(polygon: Points):
    return list(zip(polygon, list(polygon[1:]) + [polygon[0]]))


def _on_edge(x: Column, y: Column, polygon: Points) -> Column:
    hit = F.lit(False)
    for (ax, ay), (bx, by) in _edges(polygon):
        cross = (x - ax) * (by - ay) - (y - ay) * (bx - ax)
        hit = hit | ((cross == 0) & x.between(min(ax, bx), max(ax, bx)) & y.between(min(ay, by), max(ay, by)))
    return hit


def point_in_polygon(x: Column, y: Column, polygon: Points, edge_inside: bool = False) -> Column:
    """Ray casting over a fixed polygon; points on an edge count as ``edge_inside`` says."""
    crossings = F.lit(0)
    for (ax, ay), (bx, by) in _edges(polygon):
        if ay == by:
            continue
        spans = (F.lit(float(ay)) > y) != (F.lit(float(by)) > y)
        at = (y - ay) * ((bx - ax) / (by - ay)) + ax
        crossings = crossings + (spans & (x < at)).cast("int")
    inside = crossings % 2 == 1
    on_edge = _on_edge(x, y, polygon)
    return (inside | on_edge) if edge_inside else (inside & ~on_edge)


def point_in_points(x: Column, y: Column, pts: Column, edge_inside: bool = False) -> Column:
    """Same test against a polygon held in an ``array<struct<x,y>>`` column."""
    n = F.size(pts)
    start = F.struct(F.lit(0).alias("n"), F.lit(False).alias("edge"))

    def step(acc, i):
        a, b = F.get(pts, i), F.get(pts, F.pmod(i + 1, n))
        ax, ay, bx, by = a["x"], a["y"], b["x"], b["y"]
        spans = (ay > y) != (by > y)
        crossed = spans & (x < ax + F.try_divide((y - ay) * (bx - ax), by - ay))
        cross = (x - ax) * (by - ay) - (y - ay) * (bx - ax)
        on = (cross == 0) & x.between(F.least(ax, bx), F.greatest(ax, bx)) & y.between(F.least(ay, by), F.greatest(ay, by))
        return F.struct((acc["n"] + F.coalesce(crossed, F.lit(False)).cast("int")).alias("n"), (acc["edge"] | on).alias("edge"))

    done = F.aggregate(F.sequence(F.lit(0), n - 1), start, step)
    inside = done["n"] % 2 == 1
    return (inside | done["edge"]) if edge_inside else (inside & ~done["edge"])


def segments_intersect(p: tuple[Column, Column], q: tuple[Column, Column], a: tuple, b: tuple) -> Column:
    """Do the closed segments pq and ab meet? Touching counts. a and b may be numbers or columns."""
    def side(u, v, w):
        return F.signum((v[0] - u[0]) * (w[1] - u[1]) - (v[1] - u[1]) * (w[0] - u[0]))

    a = tuple(c if isinstance(c, Column) else F.lit(float(c)) for c in a)
    b = tuple(c if isinstance(c, Column) else F.lit(float(c)) for c in b)
    d1, d2, d3, d4 = side(a, b, p), side(a, b, q), side(p, q, a), side(p, q, b)

    def within(u, v, w):
        return (w[0].between(F.least(u[0], v[0]), F.greatest(u[0], v[0]))
                & w[1].between(F.least(u[1], v[1]), F.greatest(u[1], v[1])))

    proper = (d1 * d2 < 0) & (d3 * d4 < 0)
    touch = (((d1 == 0) & within(a, b, p)) | ((d2 == 0) & within(a, b, q))
             | ((d3 == 0) & within(p, q, a)) | ((d4 == 0) & within(p, q, b)))
    return proper | touch


def convex_hull(pts: Column) -> Column:
    """Counter-clockwise hull of an ``array<struct<x,y>>`` by Andrew's sweep over the sorted distinct points."""
    points = F.array_sort(F.array_distinct(F.transform(pts, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))))

    def half(points):
        empty = F.slice(points, 1, 0)

        def push(hull, p):
            def cross(h):
                a, b = F.get(h, F.size(h) - 2), F.get(h, F.size(h) - 1)
                return (b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"])

            # drop tail points while they do not turn left; at most size(hull) pops, run as a fold
            trimmed = F.aggregate(
                hull, hull,
                lambda h, _: F.when((F.size(h) >= 2) & (cross(h) <= 0), F.slice(h, 1, F.size(h) - 1)).otherwise(h))
            return F.concat(trimmed, F.array(p))

        return F.aggregate(points, empty, push)

    def open_end(chain):
        return F.slice(chain, 1, F.size(chain) - 1)

    def both(ordered):
        joined = F.concat(let(half(ordered), open_end), let(half(F.reverse(ordered)), open_end))
        return F.when(F.size(ordered) <= 2, ordered).otherwise(joined)

    return let(points, both)


def polygon_area(pts: Column) -> Column:
    def measure(q):
        n = F.size(q)

        def step(acc, i):
            a, b = F.get(q, i), F.get(q, F.pmod(i + 1, n))
            return acc + a["x"] * b["y"] - b["x"] * a["y"]

        total = F.aggregate(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), F.lit(0.0), step)
        return F.when(n < 3, F.lit(0.0)).otherwise(F.abs(total) / 2)

    return let(pts, measure)


def clip_polygon(pts: Column, rect: Box) -> Column:
    """Cut a polygon (array of points) to a rectangle, one half plane after the other."""
    def cut(points, axis, bound, keep_less):
        n = F.size(points)
        sign = 1.0 if keep_less else -1.0

        def inside(p):
            return (bound - p[axis]) * sign >= 0

        def step(acc, i):
            a, b = F.get(points, i), F.get(points, F.pmod(i + 1, n))
            t = F.try_divide(bound - a[axis], b[axis] - a[axis])
            mid = F.struct((a["x"] + t * (b["x"] - a["x"])).alias("x"), (a["y"] + t * (b["y"] - a["y"])).alias("y"))
            kept = F.when(inside(a), F.array(a)).otherwise(F.slice(F.array(a), 1, 0))
            crossed = F.when(inside(a) != inside(b), F.array(mid)).otherwise(F.slice(F.array(mid), 1, 0))
            return F.concat(acc, kept, crossed)

        return F.when(n == 0, points).otherwise(
            F.aggregate(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), F.slice(points, 1, 0), step))

    sides = (("x", rect.x1, False), ("x", rect.x2, True), ("y", rect.y1, False), ("y", rect.y2, True))

    def through(q, left):
        if not left:
            return q
        return let(cut(q, *left[0]), lambda cut_q: through(cut_q, left[1:]))

    plain = F.transform(pts, lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y")))
    return let(plain, lambda q: through(q, list(sides)))


def _corners(pts: Column, n: int = 4) -> tuple[list[Column], list[Column]]:
    return [F.get(pts, F.lit(i))["x"].cast("double") for i in range(n)], [F.get(pts, F.lit(i))["y"].cast("double") for i in range(n)]


def quad_area(pts: Column) -> Column:
    """As ``polygon_area``; of four points without a fold, which runs as compiled code."""
    xs, ys = _corners(pts)
    total = F.lit(0.0)
    for i in range(4):
        j = (i + 1) % 4
        total = total + xs[i] * ys[j] - xs[j] * ys[i]
    return F.when(F.size(pts) == 4, F.abs(total) / 2).otherwise(polygon_area(pts))


def quad_box(pts: Column) -> Box:
    """As ``points_box``, one column a side; of up to four points without a fold."""
    xs, ys = _corners(pts)
    box = points_box(pts)
    few = F.size(pts) <= 4
    return Box(*[F.when(few, c).otherwise(box[n]) for c, n in zip((F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys)), ("x1", "y1", "x2", "y2"))])


def _edge_inside(ax: Column, ay: Column, bx: Column, by: Column, rect: Box) -> Column:
    """What the edge from a to b adds to the signed area of its polygon inside a rectangle: its height over the rectangle's y1 side,
    cut to 0 and the rectangle's height, added up over the part of the edge between x1 and x2."""
    within = lambda v, low, high: F.least(F.greatest(v, low), high)
    start, stop = within(ax, rect.x1, rect.x2), within(bx, rect.x1, rect.x2)
    slope = F.coalesce(F.try_divide(by - ay, bx - ax), F.lit(0.0))
    u, v = ay - rect.y1 + (start - ax) * slope, ay - rect.y1 + (stop - ax) * slope
    cu, cv = within(u, F.lit(0.0), rect.y2 - rect.y1), within(v, F.lit(0.0), rect.y2 - rect.y1)
    return (stop - start) * (cu + (cv - cu) * F.coalesce(F.try_divide((cv - cu) / 2 + (v - cv), v - u), F.lit(0.0)))


def quad_iof(pts: Column, rect: Box, eps: float = 1e-6) -> Column:
    """Share of a quadrilateral's area inside a rectangle; of four points without folds, of others by cutting the outline."""
    xs, ys = _corners(pts)
    area = quad_area(pts)
    inside = F.lit(0.0)
    for i in range(4):
        inside = inside + _edge_inside(xs[i], ys[i], xs[(i + 1) % 4], ys[(i + 1) % 4], rect)
    known = F.when(area.isNotNull(), F.abs(inside) / F.greatest(area, F.lit(eps)))
    return F.when(F.size(pts) == 4, known).otherwise(polygon_area(clip_polygon(pts, rect)) / F.greatest(polygon_area(pts), F.lit(eps)))


def obb_points(o: Obb) -> Column:
    return F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in obb_corners(o)])


def segment_box(pts: Column, w, h) -> Column:
    """Bounding box of the polygon points strictly inside the image; zeros when none is."""
    w = w if isinstance(w, Column) else F.lit(float(w))
    h = h if isinstance(h, Column) else F.lit(float(h))
    xs, ys = F.transform(pts, lambda p: p["x"]), F.transform(pts, lambda p: p["y"])
    outside = ((F.array_min(xs) < 0).cast("int") + (F.array_min(ys) < 0).cast("int")
               + (F.array_max(xs) > w).cast("int") + (F.array_max(ys) > h).cast("int"))
    pulled = map_points(pts, lambda x: F.least(F.greatest(x, F.lit(0.0)), w), lambda y: F.least(F.greatest(y, F.lit(0.0)), h))
    used = F.when(outside >= 3, pulled).otherwise(pts)
    kept = F.filter(used, lambda p: (p["x"] > 0) & (p["y"] > 0) & (p["x"] < w) & (p["y"] < h))
    return points_box(kept, empty=0.0)


def points_box(pts: Column, empty: float | None = None) -> Column:
    xs, ys = F.transform(pts, lambda p: p["x"]), F.transform(pts, lambda p: p["y"])
    parts = [F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)]
    if empty is not None:
        parts = [F.coalesce(c, F.lit(empty)) for c in parts]
    return F.struct(*[c.alias(n) for c, n in zip(parts, ("x1", "y1", "x2", "y2"))])


def resample_segment(pts: Column, n: int) -> Column:
    """Close a polygon and read it at ``n`` even positions; original vertices are kept when n is large enough.

    The vertices of a polygon with fewer points than ``n`` stay in the result: their positions replace the same
    number of even ones.
    """
    def read_all(closed):
        m = F.size(closed)
        even = n - F.when(m < n, m).otherwise(F.lit(0))
        last = (m - 1).cast("double")
        grid = F.transform(F.sequence(F.lit(0), even - 1), lambda i: F.when(
            even > 1, i.cast("double") / F.greatest(even - 1, F.lit(1))).otherwise(F.lit(0.0)) * last)
        knots = F.transform(F.sequence(F.lit(0), m - 1), lambda i: i.cast("double"))
        pos = F.when(m < n, F.array_sort(F.concat(grid, knots))).otherwise(grid)

        def read(q):
            i = F.least(F.floor(q).cast("int"), m - 2)
            a, b, t = F.get(closed, i), F.get(closed, i + 1), q - F.least(F.floor(q), m - 2)
            return F.struct((a["x"] + (b["x"] - a["x"]) * t).alias("x"), (a["y"] + (b["y"] - a["y"]) * t).alias("y"))

        return F.transform(pos, read)

    return F.when(F.size(pts) == n, pts).otherwise(let(F.concat(pts, F.slice(pts, 1, 1)), read_all))


# --- angles ------------------------------------------------------------------------------------------------------

def joint_angle(ax, ay, bx, by, cx, cy) -> Column:
    """Angle abc in degrees; NULL when an arm is shorter than 1e-6."""
    ux, uy, vx, vy = ax - bx, ay - by, cx - bx, cy - by
    nu, nv = F.sqrt(ux * ux + uy * uy), F.sqrt(vx * vx + vy * vy)
    cosine = F.least(F.greatest((ux * vx + uy * vy) / (nu * nv), F.lit(-1.0)), F.lit(1.0))
    return F.when((nu >= 1e-6) & (nv >= 1e-6), F.degrees(F.acos(cosine)))


def pose_angle(ax, ay, bx, by, cx, cy) -> Column:
    """Difference of the two arm directions at b, folded to 0..180 degrees."""
    d = F.abs((F.atan2(cy - by, cx - bx) - F.atan2(ay - by, ax - bx)) * (180.0 / math.pi))
    return F.when(d > 180.0, 360.0 - d).otherwise(d)


# --- grids and windows -------------------------------------------------------------------------------------------

def tile_starts(length: Column, size: int, gap: int) -> Column:
    """Start positions of tiles along one side; the last tile is pulled back inside."""
    step = size - gap
    n = F.when(length <= size, F.lit(1)).otherwise(F.ceil((length - size) / step + 1)).cast("int")
    starts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: (i * step).cast("bigint"))
    return F.transform(starts, lambda s: F.when((n > 1) & (s + size > length), length - size).otherwise(s).cast("bigint"))


def tile_windows(w: Column, h: Column, sizes=((256, 64),), min_rate: float = 0.6, eps: float = 0.01) -> Column:
    """Tiles of an image as ``array<struct<x1,y1,x2,y2>>``; poorly filled ones go unless none is filled enough."""
    def tiles_of(size, gap):
        xs, ys = tile_starts(w, size, gap), tile_starts(h, size, gap)
        return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(
            x.alias("x1"), y.alias("y1"), (x + size).alias("x2"), (y + size).alias("y2"),
            (F.least(x + size, w) - x).cast("double").alias("fw"), (F.least(y + size, h) - y).cast("double").alias("fh")))))

    parts = [tiles_of(size, gap) for size, gap in sizes]
    tiles = F.concat(*parts) if len(parts) > 1 else parts[0]
    rated = F.transform(tiles, lambda t: F.struct(
        t["x1"].alias("x1"), t["y1"].alias("y1"), t["x2"].alias("x2"), t["y2"].alias("y2"),
        (t["fw"] * t["fh"] / ((t["x2"] - t["x1"]) * (t["y2"] - t["y1"]))).alias("rate")))
    best = F.array_max(F.transform(rated, lambda t: t["rate"]))
    return F.filter(rated, lambda t: F.when(best > min_rate, t["rate"] > min_rate).otherwise(F.abs(t["rate"] - best) < eps))


def layered_crops(w: Column, h: Column, layers: int, overlap: float) -> Column:
    """The whole image, then per layer a grid of 2^layer crops a side that overlap."""
    names = ("x1", "y1", "x2", "y2")

    def item(layer, *sides):
        return F.struct(layer.cast("int").alias("layer"), *[c.cast("bigint").alias(n) for c, n in zip(sides, names)])

    def layer_crops(layer):
        n = F.pow(F.lit(2.0), layer)
        lap = F.floor(F.least(w, h) * overlap * (2 / n))
        cw, ch = F.ceil((lap * (n - 1) + w) / n), F.ceil((lap * (n - 1) + h) / n)
        size = F.struct(n.cast("int").alias("n"), (cw - lap).alias("sx"), (ch - lap).alias("sy"), cw.alias("cw"), ch.alias("ch"))

        def place(z):
            steps = F.sequence(F.lit(0), z["n"] - 1)
            return F.flatten(F.transform(steps, lambda i: F.transform(steps, lambda j: item(
                layer, z["sx"] * i, z["sy"] * j, F.least(z["sx"] * i + z["cw"], w), F.least(z["sy"] * j + z["ch"], h)))))

        return let(size, place)

    whole = F.array(item(F.lit(0), F.lit(0), F.lit(0), w, h))
    return F.concat(whole, F.flatten(F.transform(F.sequence(F.lit(1), F.lit(layers)), layer_crops)))


def point_grid(n: int) -> Column:
    """n x n even points of the unit square, row by row."""
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda i: F.struct(((i + 0.5) / n).alias("x"), ((j + 0.5) / n).alias("y")))))
