"""Planar geometry as column expressions; points are structs (x, y), lines arrays of points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))


def between(a: Column, b: Column) -> Column:
    return distance(a["x"], a["y"], b["x"], b["y"])


def cosine(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Cosine of the angle between two vectors, clamped; null for a zero vector."""
    norm = F.sqrt(ax * ax + ay * ay) * F.sqrt(bx * bx + by * by)
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(ax * bx + ay * by, F.nullif(norm, F.lit(0.0)))))


def turn_degrees(a: Column, b: Column, c: Column) -> Column:
    """Change of direction on the way a, b, c; 0 where a piece has no length."""
    cos = cosine(b["x"] - a["x"], b["y"] - a["y"], c["x"] - b["x"], c["y"] - b["y"])
    return F.coalesce(F.degrees(F.acos(cos)), F.lit(0.0))


def turn_cost(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Angle between two directions, 1 for a right angle; 0 for a zero vector."""
    return F.coalesce(F.degrees(F.acos(cosine(ax, ay, bx, by))) / 90, F.lit(0.0))


def tulip(cost: Column, bins: int = 1024) -> Column:
    """A turn cost in whole units of an angular bin, so that sums of costs are exact."""
    return F.floor(cost * (bins // 2 + 1) * 0.5).cast("long")


def pieces(line: Column) -> Column:
    """Array of (a, b) of a line's straight pieces, those without length too."""
    n = F.size(line) - 1
    return F.when(n > 0, F.arrays_zip(F.slice(line, 1, n).alias("a"), F.slice(line, 2, n).alias("b")))


def line_length(line: Column) -> Column:
    return F.aggregate(F.coalesce(pieces(line), F.array()), F.lit(0.0), lambda s, p: s + between(p["a"], p["b"]))


def midpoint(line: Column) -> Column:
    """The point at half of a line's length."""
    return along(line, line_length(line) / 2)


def along(line: Column, metres: Column) -> Column:
    """The point so many metres from a line's start."""
    state = F.struct(F.lit(0.0).alias("at"), F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"))

    def step(s: Column, p: Column) -> Column:
        d = between(p["a"], p["b"])
        t = F.try_divide(metres - s["at"], F.nullif(d, F.lit(0.0)))
        here = s["x"].isNull() & (d > 0) & (s["at"] + d >= metres)
        return F.struct((s["at"] + d).alias("at"), F.when(here, p["a"]["x"] + t * (p["b"]["x"] - p["a"]["x"])).otherwise(s["x"]).alias("x"), F.when(here, p["a"]["y"] + t * (p["b"]["y"] - p["a"]["y"])).otherwise(s["y"]).alias("y"))

    return F.aggregate(pieces(line), state, step, lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y")))


def inside(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """Whether a point lies inside a ring, by the parity of crossings to its right."""
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True):
        if y1 != y2:
            at = (x2 - x1) * (y - y1) / (y2 - y1) + x1
            crossings = crossings + F.when(((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < at), 1).otherwise(0)
    return crossings % 2 == 1


def point_distance(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance of a point from a straight segment."""
    dx, dy = x2 - x1, y2 - y1
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide((px - x1) * dx + (py - y1) * dy, F.nullif(dx * dx + dy * dy, F.lit(0.0))), F.lit(0.0))))
    return distance(px, py, x1 + t * dx, y1 + t * dy)


def segment_distance(p: tuple[Column, ...], q: tuple[Column, ...]) -> Column:
    """Distance of two straight segments (x1, y1, x2, y2); 0 where they cross or touch."""

    def side(ax, ay, bx, by, cx, cy):
        return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)

    a, b = p, q
    cross = (side(*a, b[0], b[1]) * side(*a, b[2], b[3]) < 0) & (side(*b, a[0], a[1]) * side(*b, a[2], a[3]) < 0)
    ends = F.least(point_distance(a[0], a[1], *b), point_distance(a[2], a[3], *b), point_distance(b[0], b[1], *a), point_distance(b[2], b[3], *a))
    return F.when(cross, 0.0).otherwise(ends)


def deltas(line: Column, scale: int) -> Column:
    """A line as whole numbers: the first point, then differences, x and y in turn."""
    q = F.transform(line, lambda p: F.struct(F.round(p["x"] * scale).cast("long").alias("x"), F.round(p["y"] * scale).cast("long").alias("y")))
    n = F.size(line)
    more = F.zip_with(F.slice(q, 1, n - 1), F.slice(q, 2, n - 1), lambda a, b: F.array(b["x"] - a["x"], b["y"] - a["y"]))
    return F.flatten(F.concat(F.array(F.array(q[0]["x"], q[0]["y"])), more))


def from_deltas(numbers: Column, scale: int) -> Column:
    """The inverse of deltas."""
    pairs = F.transform(F.sequence(F.lit(0), (F.size(numbers) / 2 - 1).cast("int")), lambda i: F.struct(numbers[i * 2].alias("x"), numbers[i * 2 + 1].alias("y")))
    sums = F.transform(F.sequence(F.lit(1), F.size(pairs)), lambda n: F.aggregate(F.slice(pairs, 1, n), F.struct(F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y")), lambda s, p: F.struct((s["x"] + p["x"]).alias("x"), (s["y"] + p["y"]).alias("y"))))
    return F.transform(sums, lambda p: point(p["x"] / scale, p["y"] / scale))
