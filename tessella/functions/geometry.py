"""Geometry as column expressions over arrays of struct<x:double,y:double>. All of it stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.scalars import clamp

POINTS = "array<struct<x:double,y:double>>"


def let(value: Column, body) -> Column:
    """body(value) with the value named once, so that an expression that uses it often stays small."""
    return F.element_at(F.transform(F.array(value), body), 1)


def point(x, y) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.struct(lit(x).cast("double").alias("x"), lit(y).cast("double").alias("y"))


def box_ring(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Corners from the lower left against the clock, closed."""
    return F.array(point(x1, y1), point(x2, y1), point(x2, y2), point(x1, y2), point(x1, y1))


def _cross_sum(points: Column, weight=None) -> Column:
    """Sum over the sides p -> q of (p.x * q.y - q.x * p.y) * weight(p, q)."""
    n = F.size(points)
    at = lambda i: F.element_at(points, (i + 1).cast("int"))

    def term(p: Column, q: Column) -> Column:
        cross = p["x"] * q["y"] - q["x"] * p["y"]
        return cross if weight is None else weight(p, q) * cross

    return F.aggregate(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), F.lit(0.0), lambda s, i: s + term(at(i), at((i + 1) % n)))


def area(points: Column) -> Column:
    """Shoelace over an open or closed ring; 0 under 3 points."""
    return let(points, lambda r: F.when(F.size(r) >= 3, F.abs(_cross_sum(r)) * 0.5).otherwise(0.0))


def hull(points: Column) -> Column:
    xs, ys = points["x"], points["y"]
    return F.struct(F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"), F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"))


def vertex_mean(points: Column) -> Column:
    n = F.size(points)
    total = lambda k: F.aggregate(points, F.lit(0.0), lambda s, p: s + p[k])
    return F.when(n > 0, point(total("x") / n, total("y") / n))


def centroid(points: Column) -> Column:
    """Area centroid of a simple ring; null where the area is 0."""

    def of(r: Column) -> Column:
        sums = F.struct(_cross_sum(r).alias("a"), _cross_sum(r, lambda p, q: p["x"] + q["x"]).alias("x"), _cross_sum(r, lambda p, q: p["y"] + q["y"]).alias("y"))
        return let(F.when(F.size(r) >= 3, sums), lambda s: F.when(s["a"] != 0, point(s["x"] / (3 * s["a"]), s["y"] / (3 * s["a"]))))

    return let(points, of)


def largest(polygons: Column) -> Column:
    """The polygon of the largest area, the first of equals; null if none has an area."""
    best = F.array_max(F.transform(polygons, lambda p, i: F.struct(area(p).alias("area"), (-i).alias("order"))))
    return let(best, lambda b: F.when(b["area"] > 0, F.element_at(polygons, (1 - b["order"]).cast("int"))))


def closed(points: Column) -> Column:
    """A ring that ends where it starts; null under 3 points, and under 4 before closing, so that an
    open triangle gives none."""
    whole = lambda r: F.when(F.element_at(r, 1) == F.element_at(r, -1), r).otherwise(F.concat(r, F.slice(r, 1, 1)))
    return let(points, lambda r: F.when(F.size(r) >= 4, whole(r)))


def pairs(flat: Column) -> Column:
    """[x1, y1, x2, y2, ...] as points; an odd last value goes."""
    n = F.floor(F.size(flat) / 2).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: point(F.element_at(flat, 2 * i + 1), F.element_at(flat, 2 * i + 2)))).otherwise(F.array().cast(POINTS))


def to_map(px: Column, py: Column, xmin: Column, ymax: Column, cell_x: Column, cell_y: Column) -> Column:
    """Pixel to map: y turns round."""
    return point(xmin + px * cell_x, ymax - py * cell_y)


def to_unit(x: Column, y: Column, xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """Map to the unit square of a tile, y down, clamped; (0, 0) for a tile without extent."""
    w, h = xmax - xmin, ymax - ymin
    ok = (w > 0) & (h > 0)
    return F.when(ok, point(clamp((x - xmin) / F.when(ok, w), 0.0, 1.0), clamp((ymax - y) / F.when(ok, h), 0.0, 1.0))).otherwise(point(0.0, 0.0))


def unit_box(t: dict[str, Column], b: dict[str, Column]) -> Column:
    """(cx, cy, w, h) of a map box b in a tile t, both as xmin, ymin, xmax, ymax; null where nothing
    of it lies in the tile."""
    w, h = t["xmax"] - t["xmin"], t["ymax"] - t["ymin"]
    x1, x2 = clamp(b["xmin"], t["xmin"], t["xmax"]), clamp(b["xmax"], t["xmin"], t["xmax"])
    y1, y2 = clamp(b["ymin"], t["ymin"], t["ymax"]), clamp(b["ymax"], t["ymin"], t["ymax"])
    ok = (w > 0) & (h > 0) & (x2 > x1) & (y2 > y1)
    w, h = F.when(ok, w), F.when(ok, h)
    unit = lambda v: clamp(v, 0.0, 1.0)
    out = F.struct(unit(((x1 + x2) * 0.5 - t["xmin"]) / w).alias("cx"), unit((t["ymax"] - (y1 + y2) * 0.5) / h).alias("cy"), unit((x2 - x1) / w).alias("w"), unit((y2 - y1) / h).alias("h"))
    return F.when(ok & (out["w"] > 0) & (out["h"] > 0), out)


def unit_boxes(pairs: DataFrame) -> DataFrame:
    """Rows of a tile's box (xmin and so on) and another (r_xmin and so on) with cx, cy, w, h as
    unit_box() gives them; pairs without a common area go. In two steps, so that what an expression uses
    often is a filter's input and stays small."""
    c = F.col
    cut = pairs.withColumns({"_x1": F.greatest("r_xmin", "xmin"), "_y1": F.greatest("r_ymin", "ymin"), "_x2": F.least("r_xmax", "xmax"), "_y2": F.least("r_ymax", "ymax")}).where("_x2 > _x1 and _y2 > _y1")
    w, h = c("xmax") - c("xmin"), c("ymax") - c("ymin")
    sides = {"cx": ((c("_x1") + c("_x2")) * 0.5 - c("xmin")) / w, "cy": (c("ymax") - (c("_y1") + c("_y2")) * 0.5) / h, "w": (c("_x2") - c("_x1")) / w, "h": (c("_y2") - c("_y1")) / h}
    return cut.withColumns(sides).drop("_x1", "_y1", "_x2", "_y2")


def upright(points: Column) -> Column:
    """Whether a ring is the four corners of a box with some area against the clock, from its lower or
    its upper left one."""

    def of(ring: Column) -> Column:
        p = [F.get(ring, F.lit(i)) for i in range(4)]
        row = lambda a, b: p[a]["y"] == p[b]["y"]
        column = lambda a, b: p[a]["x"] == p[b]["x"]
        low_left = row(0, 1) & row(2, 3) & column(0, 3) & column(1, 2) & (p[0]["x"] < p[1]["x"]) & (p[0]["y"] < p[3]["y"])
        upper_left = column(0, 1) & column(2, 3) & row(0, 3) & row(1, 2) & (p[0]["x"] < p[3]["x"]) & (p[1]["y"] < p[0]["y"])
        return F.coalesce((F.size(ring) == 4) & (low_left | upper_left), F.lit(False))

    # A lambda also keeps this out of whole-stage code.
    return let(points, of)


def corners(cx: Column, cy: Column, w: Column, h: Column) -> Column:
    x1, y1, x2, y2 = cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2
    return F.array(point(x1, y1), point(x2, y1), point(x2, y2), point(x1, y2))


def clip(points: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """A ring cut to a box, side by side (Sutherland-Hodgman). One ring, so a non-convex ring that the
    box cuts in two keeps a seam of no area."""

    def side(ring: Column, axis: str, bound: Column, sign: int) -> Column:
        other = "y" if axis == "x" else "x"
        inside = lambda p: (p[axis] - bound) * sign >= 0

        def cut(p: Column, q: Column) -> Column:
            t = (bound - p[axis]) / (q[axis] - p[axis])
            along = p[other] + t * (q[other] - p[other])
            return point(bound, along) if axis == "x" else point(along, bound)

        n = F.size(ring)
        at = lambda i: F.element_at(ring, (i + 1).cast("int"))
        none = F.array().cast(POINTS)

        def step(i: Column) -> Column:
            p, q = at((i + n - 1) % n), at(i)
            return F.when(inside(p) & inside(q), F.array(q)).when(inside(p), F.array(cut(p, q))).when(inside(q), F.array(cut(p, q), q)).otherwise(none)

        return F.when(n > 0, F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), step))).otherwise(none)

    left = let(points, lambda r: side(r, "x", x1, 1))
    right = let(left, lambda r: side(r, "x", x2, -1))
    low = let(right, lambda r: side(r, "y", y1, 1))
    return let(low, lambda r: side(r, "y", y2, -1))


def remap(points: Column, x_off, y_off, scale_x, scale_y) -> Column:
    """Offset plus scale, clamped to the unit square: a mosaic cell, a crop window, a paste."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.transform(points, lambda p: point(clamp(lit(x_off) + p["x"] * lit(scale_x), 0.0, 1.0), clamp(lit(y_off) + p["y"] * lit(scale_y), 0.0, 1.0)))


def homography(points: Column, m: list[float]) -> Column:
    """A 3x3 matrix (rows first) over points, divided by the third coordinate (1e-8 at least) and clamped."""
    z = lambda p: F.greatest(m[6] * p["x"] + m[7] * p["y"] + m[8], F.lit(1e-8))
    return F.transform(points, lambda p: point(clamp((m[0] * p["x"] + m[1] * p["y"] + m[2]) / z(p), 0.0, 1.0), clamp((m[3] * p["x"] + m[4] * p["y"] + m[5]) / z(p), 0.0, 1.0)))


#: The exact variants of normalized points, in their order.
VARIANTS = {
    "rot90": lambda p: (1 - p["y"], p["x"]),
    "rot180": lambda p: (1 - p["x"], 1 - p["y"]),
    "rot270": lambda p: (p["y"], 1 - p["x"]),
    "fliph": lambda p: (1 - p["x"], p["y"]),
    "flipv": lambda p: (p["x"], 1 - p["y"]),
    "fliph_rot90": lambda p: (1 - p["y"], 1 - p["x"]),
    "fliph_rot270": lambda p: (p["y"], p["x"]),
}


def variant(points: Column, tag: str) -> Column:
    return F.transform(points, lambda p: point(*(clamp(v, 0.0, 1.0) for v in VARIANTS[tag](p))))
