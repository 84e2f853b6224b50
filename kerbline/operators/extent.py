"""Polygons of an extent: hull, buffer, what of a polygon lies in a box or another convex polygon, checks of extents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g

Ring = list[tuple[float, float]]


def hull_of(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, counter-clockwise from the lowest x, then y; without points on its edges."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return p

    def chain(some: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for q in some:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(chain(p) + chain(p[::-1]))


def hull(points: DataFrame) -> DataFrame:
    """(pos, x, y): corners of the convex hull of points (x, y). Each task reduces its own points to their hull first."""

    def corners(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros((0, 2))
        for frame in frames:
            held = hull_of(np.concatenate([held, frame[["x", "y"]].to_numpy()]))
        yield pd.DataFrame(held, columns=["x", "y"])

    def last(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(hull_of(frame[["x", "y"]].to_numpy()), columns=["x", "y"]).rename_axis("pos").reset_index()

    some = points.where("x is not null and y is not null").select("x", "y").mapInPandas(corners, "x double, y double")
    return some.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(last, "pos long, x double, y double")  # the corners of each task's hull


def ring_distance(x: Column, y: Column, ring: Ring) -> Column:
    return F.least(*[g.point_distance(x, y, *(F.lit(float(v)) for v in (*a, *b))) for a, b in zip(ring, [*ring[1:], ring[0]], strict=True)])


def once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is worked out once a row: as what a generator yields, its expression isn't repeated wherever it is used."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def in_buffer(streets: DataFrame, ring: Ring, reach: float) -> DataFrame:
    """Streets whose middle lies in the ring or within reach of it."""
    m = g.midpoint(F.col("pts"))
    x, y = F.col("__m.x"), F.col("__m.y")
    return once(streets, "__m", m).where(g.inside(x, y, ring) | (ring_distance(x, y, ring) <= reach)).drop("__m")


def moved(streets: DataFrame, dx: float, dy: float) -> DataFrame:
    return streets.withColumn("pts", F.transform("pts", lambda p: g.point(p["x"] + dx, p["y"] + dy)))


def area(ring: Column) -> Column:
    """Of an array of points, either way round."""
    n = F.size(ring)
    return F.when(n > 2, F.abs(F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda s, i: s + ring[i]["x"] * ring[(i + 1) % n]["y"] - ring[(i + 1) % n]["x"] * ring[i]["y"])) / 2).otherwise(0.0)


def cut_at(ring: Column, axis: str, at: Column, above: bool) -> Column:
    """What of a convex ring lies on one side of an upright or level line: each corner on that side, and each crossing."""
    n, other = F.size(ring), "y" if axis == "x" else "x"
    side = lambda p: (p[axis] >= at) if above else (p[axis] <= at)

    def corner(i: Column) -> Column:
        p, q = ring[i], ring[(i + 1) % n]
        t = (at - p[axis]) / F.nullif(q[axis] - p[axis], F.lit(0.0))
        there = {axis: at.cast("double"), other: p[other] + t * (q[other] - p[other])}
        own = F.when(side(p), F.array(g.point(p["x"], p["y"]))).otherwise(F.array().cast("array<struct<x:double,y:double>>"))
        return F.when(side(p) != side(q), F.concat(own, F.array(g.point(there["x"], there["y"])))).otherwise(own)

    return F.when(n > 0, F.flatten(F.transform(F.sequence(F.lit(0), n - 1), corner))).otherwise(ring)


def within_box(rows: DataFrame, ring: Ring, box: tuple[str, str, str, str]) -> DataFrame:
    """Adds area, of what of a convex ring lies in each row's box (columns left, bottom, right, top). A column a side: the plan stays small."""
    out = once(rows, "__r", F.array(*[g.point(F.lit(float(x)), F.lit(float(y))) for x, y in ring]))
    for axis, column, above in (("x", box[0], True), ("y", box[1], True), ("x", box[2], False), ("y", box[3], False)):
        out = once(out, "__s", cut_at(F.col("__r"), axis, F.col(column), above)).drop("__r").withColumnRenamed("__s", "__r")
    return once(out, "area", area(F.col("__r"))).drop("__r")


def ring_area(ring: Ring) -> float:
    return abs(sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], *ring[:1]], strict=True))) / 2


def common(a: Ring, b: Ring) -> Ring:
    """What two convex rings have in common, a cut along each side of b."""
    if sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in zip(b, [*b[1:], *b[:1]], strict=True)) < 0:
        b = b[::-1]
    for (ax, ay), (bx, by) in zip(b, [*b[1:], *b[:1]], strict=True):
        left = [(bx - ax) * (y - ay) - (by - ay) * (x - ax) for x, y in a]
        out: Ring = []
        for i, (p, s) in enumerate(zip(a, left, strict=True)):
            q, t = a[(i + 1) % len(a)], left[(i + 1) % len(a)]
            if s >= 0:
                out.append(p)
            if (s >= 0) != (t >= 0):
                out.append((p[0] + s / (s - t) * (q[0] - p[0]), p[1] + s / (s - t) * (q[1] - p[1])))
        a = out
    return a


def refused(ring: Ring, core: Ring | None, least_km2: float = 0.3) -> str | None:
    """Why a convex extent isn't accepted: too small, or without half of the core; None if it is."""
    if (km2 := ring_area(ring) / 1e6) < least_km2:
        return f"area {km2:.2f} km2 below {least_km2} km2"
    if core and ring_area(common(ring, core)) < 0.5 * ring_area(core):
        return "without the core extent"
    return None
