"""Tables in and out: layers, line files, exports of an external engine, JSON and Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINES = "Ref long, x1 double, y1 double, x2 double, y2 double"


def read_layer(spark: SparkSession, folder: str, layer: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{layer}")


def write_layer(df: DataFrame, folder: str, layer: str, by: tuple[str, ...] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*by).parquet(f"{folder}/{layer}")


def read_lines(spark: SparkSession, path: str, least: float = 0.01) -> DataFrame:
    """(ref, x1, y1, x2, y2) of a line file, without lines of up to least metres."""
    rows = spark.read.csv(path, header=True, schema=LINES).withColumnRenamed("Ref", "ref")
    return rows.where(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) > least)


def write_lines(lines: DataFrame, path: str) -> None:
    """A line file with six decimals, from (ref, x1, y1, x2, y2)."""
    out = lines.select(F.col("ref").alias("Ref"), *[F.format_string("%.6f", c).alias(c) for c in ("x1", "y1", "x2", "y2")])
    out.write.mode("overwrite").csv(path, header=True)


def read_engine_map(spark: SparkSession, map_path: str, connections_path: str) -> tuple[DataFrame, DataFrame]:
    """Segments (ref, x1, y1, x2, y2, length) and turns (s, es, t, et, w) of an external engine's exports.

    Its for_back 0 leaves a segment at end 1, and dir 1 enters the next at end 0.
    """
    segments = spark.read.csv(map_path, header=True, inferSchema=True)
    segments = segments.select(F.col("Ref").cast("long").alias("ref"), *[F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2")], F.col("`Segment Length`").cast("double").alias("length"))
    links = spark.read.csv(connections_path, header=True, schema="refA long, refB long, ss_weight double, for_back int, dir int")
    known = segments.select("ref")
    links = links.join(known.withColumnRenamed("ref", "refA"), "refA", "left_semi").join(known.withColumnRenamed("ref", "refB"), "refB", "left_semi")
    turns = links.select(F.col("refA").alias("s"), F.when(F.col("for_back") == 0, 1).otherwise(0).alias("es"), F.col("refB").alias("t"), F.when(F.col("dir") == 1, 0).otherwise(1).alias("et"), F.col("ss_weight").alias("w"))
    return segments, turns


def engine_column(measure: str, radius: int | None, bins: int = 1024) -> str:
    """The name an external engine gives a segment measure."""
    return f"T{bins} {measure}" + (f" R{radius} metric" if radius is not None else "")


def undefined(column: str) -> F.Column:
    """An external engine's -1 as null."""
    return F.nullif(F.col(column), F.lit(-1))


def write_json(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def markdown(df: DataFrame, rows: int = 1000) -> str:
    """A small result as a Markdown table; one of more rows is refused."""
    found = df.limit(rows + 1).collect()
    if len(found) > rows:
        raise ValueError(f"more than {rows} rows")
    head = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(head + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in found])
