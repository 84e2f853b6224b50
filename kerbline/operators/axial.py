"""Natural streets, straight lines generated along them, and weights between lines and streets."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..sources.shared import cut
from .graph import components
from .network import simplify


def end_directions(streets: DataFrame, probe: float = 15.0) -> DataFrame:
    """(id, end, kx, ky, dx, dy): at both ends the junction (to 0.01 m) and the direction into the street over probe metres."""

    reach = F.least(F.lit(probe), g.line_length(F.col("pts")) / 2)
    both = F.array(*[F.struct(F.lit(end).alias("end"), line[0].alias("a"), g.along(line, reach).alias("b")) for end, line in ((0, F.col("pts")), (1, F.reverse("pts")))])
    key = lambda c: F.rint(F.col(f"e.a.{c}") / 0.01).cast("long").alias(f"k{c}")
    rows = streets.select("id", F.explode(both).alias("e"))
    return rows.select("id", "e.end", key("x"), key("y"), *[F.coalesce(F.col(f"e.b.{c}") - F.col(f"e.a.{c}"), F.lit(0.0)).alias(f"d{c}") for c in "xy"])


def deflections(ends: DataFrame, angle_most: float = 30.0, junction: bool = False) -> DataFrame:
    """(a, ea, b, eb, deflection), and with junction also kx, ky: all pairs of ends of two streets that meet at a junction and deflect by so much at most."""
    x, y = (ends.select("kx", "ky", *[F.col(c).alias(f"{c}_{side}") for c in ("id", "end", "dx", "dy")]) for side in "ab")
    cos = g.cosine(F.col("dx_a"), F.col("dy_a"), F.col("dx_b"), F.col("dy_b"))
    pairs = x.join(y, ["kx", "ky"]).where("id_a < id_b").withColumn("deflection", 180 - F.degrees(F.acos(cos)))
    return pairs.where(F.col("deflection") <= angle_most).select(F.col("id_a").alias("a"), F.col("end_a").alias("ea"), F.col("id_b").alias("b"), F.col("end_b").alias("eb"), "deflection", *["kx", "ky"] * junction)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows of sorted batches, those with one first column together, also across batches."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and row[0] != held[0][0]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _in_batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 10_000) -> Iterator[pa.RecordBatch]:
    while some := list(islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), schema.types, strict=True)], schema=schema)


_LONG, _DOUBLE = pa.int64(), pa.float64()


def links(ends: DataFrame, angle_most: float = 30.0) -> DataFrame:
    """(a, ea, b, eb, deflection): at each junction street ends joined best first, each once, up to a deflection.

    A task reads its pairs in order, best first at each junction: junctions are many, and none is a frame of its own.
    """
    pairs = deflections(ends, angle_most, junction=True).withColumn("at", F.struct("kx", "ky")).drop("kx", "ky")
    schema = pa.schema([("a", _LONG), ("ea", pa.int32()), ("b", _LONG), ("eb", pa.int32()), ("deflection", _DOUBLE)])

    def greedy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            at, used = None, set()
            for batch in batches:
                for here, angle, a, ea, b, eb in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if here != at:
                        at, used = here, set()
                    if (a, ea) not in used and (b, eb) not in used:
                        used |= {(a, ea), (b, eb)}
                        yield a, ea, b, eb, angle

        return _in_batches(rows(), schema)

    order = ["at", "deflection", "a", "ea", "b", "eb"]
    return pairs.select(*order).repartition("at").sortWithinPartitions(*order).mapInArrow(greedy, "a long, ea int, b long, eb int, deflection double")


def strokes(streets: DataFrame, angle_most: float = 30.0, probe: float = 15.0) -> DataFrame:
    """(id, stroke_id, pos, forward): streets in a row by the links at their ends; a stroke is named by its smallest street."""
    joined = cut(links(end_directions(streets, probe), angle_most), "links")
    both = joined.select("a", "ea", "b", "eb").union(joined.select("b", "eb", "a", "ea"))
    of = components(streets.select("id"), both.select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct())
    beyond = lambda c, end: F.max(F.when(F.col("ea") == end, F.col(c)))  # noqa: E731  an end has one link at most
    around = both.groupBy(F.col("a").alias("id")).agg(*[beyond(c, end).alias(f"{c}{end}") for end in (0, 1) for c in ("b", "eb")])
    rows = of.join(around, "id", "left").select("component", "id", "b0", "eb0", "b1", "eb1")
    schema = pa.schema([("id", _LONG), ("stroke_id", _LONG), ("pos", _LONG), ("forward", pa.bool_())])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for group in _groups(batches):
                near = {(k, end): x for _, k, b0, e0, b1, e1 in group for end, x in ((0, (b0, e0)), (1, (b1, e1))) if x[0] is not None}
                # begin where the chain has an end, or in a ring anywhere
                at = next(((r[1], e) for r in group for e in (0, 1) if (r[1], e) not in near), (group[0][1], 0))
                pos, seen = 0, set()
                while at is not None and at[0] not in seen:
                    seen.add(at[0])
                    yield at[0], group[0][0], pos, at[1] == 0
                    pos, at = pos + 1, near.get((at[0], 1 - at[1]))

        return _in_batches(rows(), schema)

    return rows.repartition("component").sortWithinPartitions("component", "id").mapInArrow(walk, "id long, stroke_id long, pos long, forward boolean")


def axial_lines(streets: DataFrame, tolerance: float = 8.0, angle_most: float = 30.0, extend: float | None = None, probe: float = 15.0, least: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(lines, lineage): straight lines along each stroke, extended at both ends, and overlaps of streets with them in metres.

    Lines with the same ends to a millimetre are one.
    """
    further = tolerance + 1 if extend is None else extend
    rows = strokes(streets, angle_most, probe).join(streets.select("id", F.col("pts.x").alias("x"), F.col("pts.y").alias("y")), "id")
    rows = rows.select("stroke_id", "pos", "id", "forward", "x", "y").repartition("stroke_id").sortWithinPartitions("stroke_id", "pos")
    names = ["stroke_id", "s0", "s1", "x1", "y1", "x2", "y2"]
    schema = pa.schema([("id", _LONG), ("stroke_id", _LONG), *[(n, _DOUBLE) for n in names[1:]]])

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for group in _groups(batches):
                xy, at, stroke = [], 0.0, group[0][0]
                for _, _, k, forward, x, y in group:
                    line = np.column_stack([x, y])
                    line = line if forward else line[::-1]
                    n = float(np.sqrt((np.diff(line, axis=0) ** 2).sum(1)).sum())
                    yield k, stroke, at, at + n, None, None, None, None
                    at += n
                    xy.append(line if not xy else line[1:] if np.abs(line[0] - xy[-1][-1]).max() <= 0.01 else line)
                xy = np.concatenate(xy)
                along = np.concatenate([[0], np.cumsum(np.sqrt((np.diff(xy, axis=0) ** 2).sum(1)))])
                keep = simplify(xy, tolerance) if len(xy) > 2 else np.arange(len(xy))
                for i, j in zip(keep, keep[1:], strict=False):
                    d = xy[j] - xy[i]
                    n = float(np.sqrt(d @ d))
                    if n >= least:
                        d = d / n * further
                        yield None, stroke, along[i], along[j], *(xy[i] - d), *(xy[j] + d)

        return _in_batches(rows(), schema)

    # rows with a street's id are its place along the stroke, those without are lines
    both = cut(rows.mapInArrow(drawn, "id long, stroke_id long, " + ", ".join(f"{n} double" for n in names[1:])), "drawn")
    spans = both.where("id is not null").select("stroke_id", "id", F.col("s0").alias("c0"), F.col("s1").alias("c1"))
    q = lambda c: F.bround(c, 3)
    a, b = F.struct(q("x1"), q("y1")), F.struct(q("x2"), q("y2"))
    same = Window.partitionBy(F.least(a, b), F.greatest(a, b)).orderBy("stroke_id", "s0").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # a name that holds whatever machine draws the line
    raw = both.where("id is null").select(*names, F.xxhash64("stroke_id", "s0").alias("line")).withColumn("axial_id", F.first("line").over(same))
    lines = raw.where("line = axial_id").drop("line")
    return lines, lineage(raw.select("axial_id", "stroke_id", "s0", "s1"), spans)


def lineage(lines: DataFrame, spans: DataFrame) -> DataFrame:
    """(id, axial_id, overlap_m) of streets (stroke_id, id, c0, c1) and lines (axial_id, stroke_id, s0, s1) along strokes.

    A street without any overlap goes to the nearest line of its stroke, with its own length or a millimetre.
    """
    over = F.least("s1", "c1") - F.greatest("s0", "c0")
    pairs = spans.join(lines, "stroke_id").withColumn("over", over)
    some = pairs.where("over > 0").select("id", "axial_id", F.col("over").alias("overlap_m"))
    none = pairs.join(some.select("id").distinct(), "id", "left_anti")
    nearest = none.groupBy("id").agg(F.min_by("axial_id", F.struct(-F.col("over"), "axial_id")).alias("axial_id"), F.first(F.greatest(F.col("c1") - F.col("c0"), F.lit(1e-3))).alias("overlap_m"))
    return some.unionByName(nearest).groupBy("id", "axial_id").agg(F.sum("overlap_m").alias("overlap_m"))


def transfer(values: DataFrame, lineage_rows: DataFrame, spine: DataFrame, columns: list[str], strict: bool = False) -> DataFrame:
    """Overlap-weighted means of line values on streets. Unless strict, a null value counts as 0 and its weight stays."""
    rows = lineage_rows.join(values, "axial_id")
    out = []
    for c in columns:
        weight = F.when(F.col(c).isNotNull(), F.col("overlap_m")) if strict else F.col("overlap_m")
        total = F.sum(F.col(c) * F.col("overlap_m"))
        out.append(F.try_divide(total if strict else F.coalesce(total, F.lit(0.0)), F.sum(weight)).alias(c))
    return spine.select("id").join(rows.groupBy("id").agg(*out), "id", "left")
