"""Graphs of lines: shared junctions, turns between pieces, intersections, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..sources.shared import cut

XY = ("x1", "y1", "x2", "y2")


def adjacency(streets: DataFrame) -> DataFrame:
    """(src, dst), both ways, of streets that share a junction."""
    at = streets.select("id", F.explode(F.array_distinct(F.array("u", "v"))).alias("j"))
    return at.select(F.col("id").alias("src"), "j").join(at.select(F.col("id").alias("dst"), "j"), "j").where("src <> dst").select("src", "dst").distinct()


def symmetric(pairs: DataFrame) -> DataFrame:
    """(src, dst) both ways from a list of connections."""
    a, b = pairs.columns[:2]
    one = pairs.select(F.col(a).alias("src"), F.col(b).alias("dst"))
    return one.unionByName(pairs.select(F.col(b).alias("src"), F.col(a).alias("dst"))).where("src <> dst").distinct()


def turns(pieces: DataFrame, snap: float = 1e-6, bins: int = 1024) -> DataFrame:
    """(s, es, t, et, w, w_tulip): from end es of piece s into end et of piece t, with the turn's cost (1 for a right angle).

    pieces has seg, x1, y1, x2, y2; ends meet where they snap to one point.
    """
    key = lambda c: F.rint(F.col(c) / snap).cast("long")
    out = []
    for end, (x, y), (ox, oy) in ((0, ("x1", "y1"), ("x2", "y2")), (1, ("x2", "y2"), ("x1", "y1"))):
        out.append(pieces.select("seg", F.lit(end).alias("end"), key(x).alias("kx"), key(y).alias("ky"), (F.col(x) - F.col(ox)).alias("dx"), (F.col(y) - F.col(oy)).alias("dy")))
    ends = out[0].unionByName(out[1])
    a = ends.select(F.col("seg").alias("s"), F.col("end").alias("es"), "kx", "ky", F.col("dx").alias("ax"), F.col("dy").alias("ay"))
    b = ends.select(F.col("seg").alias("t"), F.col("end").alias("et"), "kx", "ky", (-F.col("dx")).alias("bx"), (-F.col("dy")).alias("by"))
    w = g.turn_cost(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    return a.join(b, ["kx", "ky"]).where("s <> t").select("s", "es", "t", "et", w.alias("w")).withColumn("w_tulip", g.tulip(F.col("w"), bins))


def cells(rows: DataFrame, size: float, prefix: str, margin: float = 0.0) -> DataFrame:
    """A row for each grid cell (cx, cy) that the box of a line, widened by margin, touches; its first cell as prefix + x0, y0."""
    x1, y1, x2, y2 = (F.col(prefix + c) for c in XY)
    cell = lambda v: F.floor(v / size)
    rows = rows.withColumn(prefix + "x0", cell(F.least(x1, x2) - margin)).withColumn(prefix + "y0", cell(F.least(y1, y2) - margin))
    rows = rows.withColumn("cx", F.explode(F.sequence(prefix + "x0", cell(F.greatest(x1, x2) + margin))))
    return rows.withColumn("cy", F.explode(F.sequence(prefix + "y0", cell(F.greatest(y1, y2) + margin))))


def near_pairs(left: DataFrame, right: DataFrame, reach: float, size: float, distance: Column) -> DataFrame:
    """Pairs of rows whose boxes lie within reach and for which distance <= reach; an equi-join on grid cells.

    left's columns begin with l_, right's with r_; both have x1, y1, x2, y2 and id after that. A pair that shares several
    cells is taken in the first of them, so nothing has to be made distinct. Neither side is broadcast: a plan's estimate
    doesn't know into how many cells a row goes.
    """
    a, b = cells(left, size, "l_", reach), cells(right, size, "r_")
    first = (F.col("cx") == F.greatest("l_x0", "r_x0")) & (F.col("cy") == F.greatest("l_y0", "r_y0"))
    pairs = a.join(b.hint("merge"), ["cx", "cy"]).where(first).drop("cx", "cy", "l_x0", "l_y0", "r_x0", "r_y0")
    for x in "xy":
        for one, other in ("lr", "rl"):
            pairs = pairs.where(F.least(f"{one}_{x}1", f"{one}_{x}2") - reach <= F.greatest(f"{other}_{x}1", f"{other}_{x}2"))
    return pairs.withColumn("distance", distance).where(F.col("distance") <= reach)


def prefixed(rows: DataFrame, prefix: str) -> DataFrame:
    return rows.select(*[F.col(c).alias(prefix + c) for c in rows.columns])


def intersections(lines: DataFrame, tolerance: float = 1e-6, size: float = 100.0) -> DataFrame:
    """(src, dst) both ways, of lines (id, x1, y1, x2, y2) that cross or come within tolerance."""
    own = lines.select("id", *XY)
    d = g.segment_distance(tuple(F.col(f"l_{c}") for c in XY), tuple(F.col(f"r_{c}") for c in XY))
    pairs = near_pairs(prefixed(own, "l_"), prefixed(own, "r_"), tolerance, size, d).where("l_id < r_id")
    return symmetric(pairs.select("l_id", "r_id"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): component is the smallest id reachable. Labels spread by joins; each round's labels also jump to
    the label of their label, so rounds grow with the logarithm of a path. Every round is a written table."""
    labels = cut(nodes.select("id", F.col("id").alias("component")), "labels")
    while True:
        near = edges.join(labels, edges["dst"] == labels["id"]).groupBy("src").agg(F.min("component").alias("low"))
        new = labels.join(near, labels["id"] == near["src"], "left").select("id", F.least("component", F.coalesce("low", "component")).alias("component"), F.col("component").alias("old"))
        new = cut(new, "labels")
        jump = new.select(F.col("id").alias("component"), F.col("component").alias("further"))
        new = cut(new.join(jump, "component").select("id", F.col("further").alias("component"), (F.col("further") != F.col("old")).alias("moved")), "labels")
        moved = new.where("moved").limit(1).count()
        labels = new.select("id", "component")
        if not moved:
            return labels
