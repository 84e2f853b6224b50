"""Cleaning of street networks: deduplication, stubs, parallels, straight pieces, interior, summary."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g


def with_length(streets: DataFrame) -> DataFrame:
    return streets.withColumn("length", g.line_length(F.col("pts")))


def deduplicate(streets: DataFrame, least: float = 0.01) -> DataFrame:
    """Streets longer than least metres; of those with the same junctions and length to 0.1 m, the first by id."""
    rows = with_length(streets).where(F.col("length") > least)
    key = Window.partitionBy(F.least("u", "v"), F.greatest("u", "v"), F.bround("length", 1)).orderBy("id")
    return rows.withColumn("__n", F.row_number().over(key)).where("__n = 1").drop("__n")


def renumbered(rows: DataFrame, id_col: str, new: str) -> DataFrame:
    """Adds dense numbers from 0 in the order of id_col: counts by range of ids first, so no task sorts all rows."""
    width = 1 << 16
    blocks = rows.groupBy(F.floor(F.col(id_col) / width).alias("__b")).agg(F.count("*").alias("__n"))
    before = blocks.select("__b", (F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))).alias("__before"))
    own = rows.withColumn("__b", F.floor(F.col(id_col) / width)).withColumn("__r", F.row_number().over(Window.partitionBy("__b").orderBy(id_col)))
    return own.join(before, "__b").withColumn(new, F.coalesce("__before", F.lit(0)) + F.col("__r") - 1).drop("__b", "__r", "__before")


def ends(streets: DataFrame) -> DataFrame:
    """Two rows a street: first piece's length and the turn after it, null where there are fewer than three points."""
    n = F.size("pts")
    two = []
    for side, at in (("start", (1, 2, 3)), ("end", (-1, -2, -3))):
        a, b, c = (F.get("pts", F.lit(k - 1) if k > 0 else n + k) for k in at)
        two.append(F.struct(F.lit(side).alias("side"), F.when(n >= 3, g.between(a, b)).alias("first"), F.when(n >= 3, g.turn_degrees(a, b, c)).alias("turn")))
    return streets.select("*", F.explode(F.array(*two)).alias("e")).select("id", "e.*")


def stub_stats(streets: DataFrame, max_length: float = 10.0, min_turn: float = 30.0) -> DataFrame:
    """One row: streets, pieces and ends, and how many ends are stubs (a short first piece, then a sharp turn)."""
    rows = with_length(streets).agg(F.count("*").alias("streets"), F.sum(F.size("pts") - 1).alias("pieces"), F.sum("length").alias("metres"))
    stub = (F.col("first") <= max_length) & (F.col("turn") >= min_turn)
    own = ends(streets).agg(F.count("*").alias("ends"), F.count(F.when(stub, 1)).alias("stub_ends"), F.coalesce(F.sum(F.when(stub, F.col("turn"))), F.lit(0.0)).alias("stub_turn"))
    return rows.crossJoin(F.broadcast(own)).select(  # one row each
        "streets", (F.col("metres") / 1000).alias("network_km"), "pieces", F.try_divide("pieces", "streets").alias("pieces_per_street"), F.try_divide("pieces", F.col("metres") / 1000).alias("pieces_per_km"),
        "stub_ends", F.try_divide("stub_ends", "ends").alias("stub_end_share"), F.try_divide("stub_turn", F.col("metres") / 1000).alias("stub_turn_deg_per_km"),
    )


def destub(streets: DataFrame, tolerance: float = 10.0) -> DataFrame:
    """Takes out the second point of a line of more than two whose first piece is short; then the same at its end."""
    pts, n = F.col("pts"), F.size("pts")
    first = F.when((n > 2) & (g.between(pts[0], pts[1]) <= tolerance), F.concat(F.slice(pts, 1, 1), F.slice(pts, F.lit(3), n - 2))).otherwise(pts)
    rows = streets.withColumn("pts", first)
    last = F.when((n > 2) & (g.between(F.element_at("pts", -1), F.element_at("pts", -2)) <= tolerance), F.concat(F.slice(pts, F.lit(1), n - 2), F.slice(pts, -1, 1))).otherwise(pts)
    return rows.withColumn("pts", last)


def hausdorff(a: np.ndarray, b: np.ndarray) -> float:
    """The larger of the farthest vertex of either line from the other."""

    def far(p: np.ndarray, q: np.ndarray) -> float:
        s, d = q[:-1], np.diff(q, axis=0)
        t = np.clip(((p[:, None] - s) * d).sum(2) / np.maximum((d * d).sum(1), 1e-300), 0, 1)
        return float(np.sqrt((((s + t[..., None] * d) - p[:, None]) ** 2).sum(2)).min(1).max())

    return max(far(a, b), far(b, a))


def merge_parallels(streets: DataFrame, tolerance: float = 5.0) -> DataFrame:
    """Of streets between the same two junctions, shortest first, drops those within tolerance of one kept."""
    rows = with_length(streets)
    several = Window.partitionBy(F.least("u", "v"), F.greatest("u", "v"))
    marked = rows.withColumn("__n", F.count("*").over(several))
    alone = marked.where((F.col("__n") == 1) | (F.col("u") == F.col("v"))).drop("__n")
    group = marked.where((F.col("__n") > 1) & (F.col("u") != F.col("v"))).drop("__n").withColumn("__a", F.least("u", "v")).withColumn("__b", F.greatest("u", "v"))

    def kept(frame: pd.DataFrame) -> pd.DataFrame:
        lines, keep = [], []
        for i, row in frame.sort_values(["length", "id"]).iterrows():
            line = np.array([[p["x"], p["y"]] for p in row["pts"]])
            if all(hausdorff(line, other) > tolerance for other in lines):
                lines.append(line)
                keep.append(i)
        return frame.loc[keep].drop(columns=["__a", "__b"])

    return alone.unionByName(group.groupBy("__a", "__b").applyInPandas(kept, rows.schema))


def explode_straight(streets: DataFrame) -> DataFrame:
    """(id, piece, x1, y1, x2, y2, length): straight pieces with their place in the line; those without length go."""
    rows = streets.select("id", F.posexplode(g.pieces(F.col("pts"))).alias("piece", "p"))
    rows = rows.select("id", F.col("piece").cast("long").alias("piece"), F.col("p.a.x").alias("x1"), F.col("p.a.y").alias("y1"), F.col("p.b.x").alias("x2"), F.col("p.b.y").alias("y2"))
    return rows.where("not (x1 = x2 and y1 = y2)").withColumn("length", g.distance(*(F.col(c) for c in ("x1", "y1", "x2", "y2"))))


def chords(streets: DataFrame, least: float = 0.01) -> DataFrame:
    a, b = F.element_at("pts", 1), F.element_at("pts", -1)
    rows = streets.select("id", a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2"))
    return rows.withColumn("length", g.distance(*(F.col(c) for c in ("x1", "y1", "x2", "y2")))).where(F.col("length") > least)


def with_interior(streets: DataFrame, ring: list[tuple[float, float]]) -> DataFrame:
    m = F.explode(F.array(g.midpoint(F.col("pts")))).alias("__m")  # from a generator, so that it is worked out once
    return streets.select("*", m).withColumn("interior", F.coalesce(g.inside(F.col("__m.x"), F.col("__m.y"), ring), F.lit(False))).drop("__m")


def ring_area(ring: list[tuple[float, float]]) -> float:
    return abs(sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True))) / 2


def summary(streets: DataFrame, area: float) -> DataFrame:
    """One row over streets with interior: counts, kilometres, density and median length."""
    rows = with_length(streets)
    own = F.when(F.col("interior"), F.col("length"))
    return rows.agg(
        F.count("*").alias("streets"), F.count(own).alias("interior_streets"), F.round(F.sum("length") / 1000, 1).alias("km"), F.round(F.sum(own) / 1000, 1).alias("interior_km"),
        F.round(F.sum(own) / 1000 / (area / 1e6), 1).alias("km_per_km2"), F.round(F.percentile(own, 0.5), 1).alias("median_m"),
    )


def simplify(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker: indices of the points kept."""
    keep, todo = {0, len(points) - 1}, [(0, len(points) - 1)]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < 2:
            continue
        a, d = points[lo], points[hi] - points[lo]
        p = points[lo + 1 : hi] - a
        t = np.clip((p @ d) / max(float(d @ d), 1e-300), 0, 1)
        far = np.sqrt(((p - t[:, None] * d) ** 2).sum(1))
        if far.max() > tolerance:
            k = lo + 1 + int(far.argmax())
            keep.add(k)
            todo += [(lo, k), (k, hi)]
    return np.array(sorted(keep))


def simplified(streets: DataFrame, tolerance: float) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for pts in frame["pts"]:
                xy = np.array([[p["x"], p["y"]] for p in pts])
                out.append([pts[k] for k in simplify(xy, tolerance)] if len(xy) > 2 else list(pts))
            yield frame.assign(pts=out)

    return streets.mapInPandas(run, streets.schema)


def consolidate(junctions: DataFrame, tolerance: float) -> DataFrame:
    """(id, cluster, x, y): junctions (id, x, y) within tolerance of each other, in chains too, become one at their centroid."""
    from .graph import components, near_pairs, prefixed, symmetric

    p = junctions.select("id", F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    apart = g.distance(*(F.col(c) for c in ("l_x1", "l_y1", "r_x1", "r_y1")))
    pairs = near_pairs(prefixed(p, "l_"), prefixed(p, "r_"), tolerance, 2 * tolerance, apart).where("l_id < r_id")
    of = components(junctions.select("id"), symmetric(pairs.select("l_id", "r_id")))
    rows = junctions.join(of, "id")
    centre = rows.groupBy("component").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    return rows.select("id", "component").join(centre, "component").select("id", F.col("component").alias("cluster"), F.col("cx").alias("x"), F.col("cy").alias("y"))


def rebuilt(streets: DataFrame, of: DataFrame) -> DataFrame:
    """Streets (id, u, v, pts) between the clusters of consolidate: those inside one cluster go, the others reach to its centroid."""
    at = lambda side: of.select(F.col("id").alias(side), F.col("cluster").alias(f"{side}c"), F.struct("x", "y").alias(f"{side}p"))
    rows = streets.join(at("u"), "u").join(at("v"), "v").where("uc <> vc")
    same = lambda p, q: g.between(p, q) <= 1e-6
    none = F.array().cast("array<struct<x:double,y:double>>")
    first = F.when(same(F.col("up"), F.element_at("pts", 1)), none).otherwise(F.array("up"))
    last = F.when(same(F.col("vp"), F.element_at("pts", -1)), none).otherwise(F.array("vp"))
    return rows.select("id", F.col("uc").alias("u"), F.col("vc").alias("v"), F.concat(first, "pts", last).alias("pts"))


#: Share of a segment at which it enters and leaves a box, by Liang and Barsky; null where it runs beside the box.
_EDGES = (("x1 - x2", "x1 - {0}"), ("x2 - x1", "{2} - x1"), ("y1 - y2", "y1 - {1}"), ("y2 - y1", "{3} - y1"))


def clip_share(box: tuple[float, float, float, float], enters: bool) -> str:
    """SQL for the share of (x1, y1, x2, y2) at which it enters (or leaves) a box, before both are compared."""
    parts = ["CAST(0 AS DOUBLE)" if enters else "CAST(1 AS DOUBLE)"]
    for p, q in _EDGES:
        q = q.format(*(f"CAST({v} AS DOUBLE)" for v in box))
        beside = f"WHEN {p} = 0 AND {q} < 0 THEN {'2' if enters else '-1'}"
        parts.append(f"CASE {beside} WHEN {p} {'<' if enters else '>'} 0 THEN ({q}) / ({p}) ELSE {'0' if enters else '1'} END")
    return f"{'greatest' if enters else 'least'}({', '.join(parts)})"


def clip(lines: DataFrame, box: tuple[float, float, float, float], least: float = 0.01) -> DataFrame:
    """What of straight lines (id, x1, y1, x2, y2) lies in a box (left, bottom, right, top), if longer than least."""
    rows = lines.select("id", "x1", "y1", "x2", "y2").withColumn("a", F.expr(clip_share(box, True))).withColumn("b", F.expr(clip_share(box, False))).where("a < b")
    at = lambda t, c: F.col(f"{c}1") + F.col(t) * (F.col(f"{c}2") - F.col(f"{c}1"))
    rows = rows.select("id", at("a", "x").alias("x1"), at("a", "y").alias("y1"), at("b", "x").alias("x2"), at("b", "y").alias("y2"))
    return rows.withColumn("length", g.distance(*(F.col(c) for c in ("x1", "y1", "x2", "y2")))).where(F.col("length") > least)
