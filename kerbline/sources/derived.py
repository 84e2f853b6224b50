"""Deterministic street networks derived from the driver's tables: a jittered lattice with gaps, kinks, stubs and doubles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CITIES = {"customer": ("c_custkey", "c_acctbal >= 0", 100), "part": ("p_partkey", "p_size % 5 <> 0", 140)}


def streets(spark: SparkSession, sf_dir: str, table: str = "customer", doubled: bool = False) -> DataFrame:
    """(id, u, v, highway, pts): u and v are junctions. With doubled, every fiftieth street has a parallel copy.

    The lattice's width comes from the table's row count, a one-row subquery.
    """
    key, keep, step = CITIES[table]
    all_rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    one = all_rows.agg(F.count("*").alias("n")).select("n", F.ceil(F.sqrt(F.col("n") / 2)).cast("long").alias("w"))
    e = all_rows.where(keep).select(F.col(key).cast("long").alias("id")).crossJoin(F.broadcast(one))
    e = e.selectExpr("id", "n", "id % 2 AS o", "(id div 2) % w AS ux", "(id div 2) div w AS uy")
    e = e.selectExpr("*", "ux + 1 - o AS vx", "uy + o AS vy")
    x = lambda a, b: f"CAST({step} * {a} + ({a} * 37 + {b} * 61) % 41 - 20 AS DOUBLE)"
    y = lambda a, b: f"CAST({step} * {b} + ({a} * 53 + {b} * 29) % 41 - 20 AS DOUBLE)"
    e = e.selectExpr("id", "n", "o", "ux * 100000 + uy AS u", "vx * 100000 + vy AS v", f"{x('ux', 'uy')} AS x1", f"{y('ux', 'uy')} AS y1", f"{x('vx', 'vy')} AS x2", f"{y('vx', 'vy')} AS y2")
    kink = "named_struct('x', (x1 + x2) / 2 + IF(o = 1, {0}, 0D), 'y', (y1 + y2) / 2 + IF(o = 0, {0}, 0D))"
    pts = "filter(array(named_struct('x', x1, 'y', y1), {}, {}, named_struct('x', x2, 'y', y2)), p -> p IS NOT NULL)"
    stub = "IF(id % 7 = 0, named_struct('x', x1 + 3D, 'y', y1 - 4D), NULL)"
    bend = f"IF(id % 3 = 0, {kink.format('CAST((id * 31) % 25 - 12 AS DOUBLE)')}, NULL)"
    highway = "element_at(array('residential', 'primary', 'service', 'tertiary', 'footway'), CAST(id % 5 + 1 AS INT)) AS highway"
    out = e.selectExpr("id", "u", "v", highway, f"{pts.format(stub, bend)} AS pts")
    if doubled:
        out = out.unionByName(e.where("id % 50 = 0").selectExpr("id + n AS id", "u", "v", highway, f"{pts.format('NULL', kink.format('4D'))} AS pts"))
    return out


def base_sql(table: str = "customer", doubled: bool = True) -> str:
    """The same streets (without and with doubles) in DuckDB's SQL, as views streets and doubled after WITH."""
    key, keep, step = CITIES[table]
    x = lambda a, b: f"CAST({step} * {a} + ({a} * 37 + {b} * 61) % 41 - 20 AS DOUBLE)"
    y = lambda a, b: f"CAST({step} * {b} + ({a} * 53 + {b} * 29) % 41 - 20 AS DOUBLE)"
    return f"""WITH one AS (SELECT count(*) AS n, CAST(ceil(sqrt(count(*) / 2.0)) AS BIGINT) AS w FROM {table}),
e0 AS (SELECT CAST({key} AS BIGINT) AS id, n, w FROM {table}, one WHERE {keep}),
e1 AS (SELECT id, n, id % 2 AS o, (id // 2) % w AS ux, (id // 2) // w AS uy FROM e0),
e2 AS (SELECT *, ux + 1 - o AS vx, uy + o AS vy FROM e1),
e AS (SELECT id, n, o, ux * 100000 + uy AS u, vx * 100000 + vy AS v, {x('ux', 'uy')} AS x1, {y('ux', 'uy')} AS y1, {x('vx', 'vy')} AS x2, {y('vx', 'vy')} AS y2,
  (['residential', 'primary', 'service', 'tertiary', 'footway'])[id % 5 + 1] AS highway FROM e2),
k AS (SELECT *, CAST((id * 31) % 25 - 12 AS DOUBLE) AS off FROM e),
streets AS (SELECT id, u, v, highway, [{{'x': x1, 'y': y1}}]
  || CASE WHEN id % 7 = 0 THEN [{{'x': x1 + 3, 'y': y1 - 4}}] ELSE [] END
  || CASE WHEN id % 3 = 0 THEN [{{'x': (x1 + x2) / 2 + CASE WHEN o = 1 THEN off ELSE 0 END, 'y': (y1 + y2) / 2 + CASE WHEN o = 0 THEN off ELSE 0 END}}] ELSE [] END
  || [{{'x': x2, 'y': y2}}] AS pts FROM k),
doubled AS (SELECT * FROM streets UNION ALL SELECT id + n, u, v, highway, [{{'x': x1, 'y': y1}}, {{'x': (x1 + x2) / 2 + CASE WHEN o = 1 THEN 4 ELSE 0 END, 'y': (y1 + y2) / 2 + CASE WHEN o = 0 THEN 4 ELSE 0 END}}, {{'x': x2, 'y': y2}}] FROM k WHERE id % 50 = 0)
"""


def extent(spark: SparkSession, lines: DataFrame) -> list[tuple[float, float]]:
    """A convex octagon at 70 % of the extent of the lines' points: the interior's boundary."""
    p = lines.select(F.explode("pts").alias("p"))
    r = p.agg(F.min("p.x").alias("a"), F.max("p.x").alias("b"), F.min("p.y").alias("c"), F.max("p.y").alias("d")).first()
    return octagon(r.a, r.b, r.c, r.d)


def octagon(a: float, b: float, c: float, d: float) -> list[tuple[float, float]]:
    mx, my, hx, hy = (a + b) / 2, (c + d) / 2, 0.35 * (b - a), 0.35 * (d - c)
    return [(mx + hx * sx, my + hy * sy) for sx, sy in ((1, 0.5), (0.5, 1), (-0.5, 1), (-1, 0.5), (-1, -0.5), (-0.5, -1), (0.5, -1), (1, -0.5))]
