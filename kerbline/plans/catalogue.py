"""Registered queries over networks derived from the driver's tables, and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import formulas as f
from ..functions import geometry as g
from ..functions import ranking as rk
from ..operators import angular, axial, graph, matching, network, topology
from ..sources import derived
from ..sources.shared import cut

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

B = derived.base_sql()
LENGTH = "list_sum(list_transform(range(1, len(pts)), lambda i: sqrt((pts[i + 1].x - pts[i].x) * (pts[i + 1].x - pts[i].x) + (pts[i + 1].y - pts[i].y) * (pts[i + 1].y - pts[i].y))))"
PIECES = ", pieces AS (SELECT *, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS length FROM (SELECT id, i - 1 AS piece, pts[i].x AS x1, pts[i].y AS y1, pts[i + 1].x AS x2, pts[i + 1].y AS y2 FROM streets, unnest(range(1, len(pts))) t(i)) WHERE NOT (x1 = x2 AND y1 = y2))"
CHORDS = ", chords AS (SELECT *, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS length FROM (SELECT id, u, v, highway, pts[1].x AS x1, pts[1].y AS y1, pts[-1].x AS x2, pts[-1].y AS y2 FROM streets))"
ADJ = ", j AS (SELECT id, u AS j FROM streets UNION SELECT id, v FROM streets), adj AS MATERIALIZED (SELECT DISTINCT a.id AS src, b.id AS dst FROM j a JOIN j b ON a.j = b.j AND a.id <> b.id)"
DEG = ADJ + ", deg AS (SELECT src, count(*) AS deg FROM adj GROUP BY src)"
P3 = ADJ + """, l0 AS (SELECT id AS s, id AS v, 0 AS d, CAST(1 AS BIGINT) AS g FROM streets), l1 AS MATERIALIZED (SELECT src AS s, dst AS v, 1 AS d, CAST(1 AS BIGINT) AS g FROM adj),
l2 AS MATERIALIZED (SELECT l1.s, a.dst AS v, 2 AS d, CAST(sum(l1.g) AS BIGINT) AS g FROM l1 JOIN adj a ON l1.v = a.src WHERE a.dst <> l1.s AND NOT EXISTS (SELECT 1 FROM l1 z WHERE z.s = l1.s AND z.v = a.dst) GROUP BY ALL),
l3 AS MATERIALIZED (SELECT l2.s, a.dst AS v, 3 AS d, CAST(sum(l2.g) AS BIGINT) AS g FROM l2 JOIN adj a ON l2.v = a.src WHERE a.dst <> l2.s AND NOT EXISTS (SELECT 1 FROM l1 z WHERE z.s = l2.s AND z.v = a.dst) AND NOT EXISTS (SELECT 1 FROM l2 z WHERE z.s = l2.s AND z.v = a.dst) GROUP BY ALL),
p AS (SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3), prof AS (SELECT s AS id, count(*) AS k, CAST(sum(d) AS BIGINT) AS td, max(d) AS max_depth FROM p GROUP BY s)"""
CHOICE = """, ch AS (SELECT a.v AS id, sum(CAST(a.g * b.g AS DOUBLE) / t.g) AS choice FROM p a JOIN p b ON a.v = b.s JOIN p t ON t.s = a.s AND t.v = b.v
WHERE a.d > 0 AND b.d > 0 AND t.d = a.d + b.d GROUP BY a.v)"""
# connectivity, control and length of each street, as the rank queries compare them
MEASURES = DEG + f", con AS (SELECT a.src AS id, round(sum(1.0 / d.deg), 9) AS control FROM adj a JOIN deg d ON a.dst = d.src GROUP BY a.src), m AS (SELECT s.id, highway, round({LENGTH}, 6) AS length, CAST(coalesce(deg, 0) AS DOUBLE) AS connectivity, control FROM streets s LEFT JOIN deg ON deg.src = s.id LEFT JOIN con ON con.id = s.id)"


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return add


def _r(c: str, n: int = 6) -> F.Column:
    return F.round(F.col(c), n).alias(c)


def _streets(spark: SparkSession, d: str, **kw) -> DataFrame:
    return derived.streets(spark, d, **kw)


def _measures(spark: SparkSession, d: str) -> DataFrame:
    s = _streets(spark, d)
    e = cut(graph.adjacency(s), "adjacency")
    rows = network.with_length(s).select("id", "highway", _r("length"))
    rows = rows.join(topology.connectivity(s, e), "id").join(topology.control(s, e), "id")
    return cut(rows.select("id", "highway", "length", F.col("connectivity").cast("double").alias("connectivity"), _r("control", 9)), "measures")


@query(B + f"SELECT id, u, v, highway, CAST(len(pts) AS BIGINT) AS n_points, round({LENGTH}, 6) AS length FROM doubled")
def net_segments(spark, d):
    return network.with_length(_streets(spark, d, doubled=True)).select("id", "u", "v", "highway", F.size("pts").cast("long").alias("n_points"), _r("length"))


@query(B + f", l AS (SELECT id, u, v, {LENGTH} AS length FROM doubled), n AS (SELECT *, row_number() OVER (PARTITION BY least(u, v), greatest(u, v), round_even(length, 1) ORDER BY id) AS n FROM l WHERE length > 0.01) SELECT id, u, v, row_number() OVER (ORDER BY id) - 1 AS seg_id FROM n WHERE n = 1")
def net_dedup(spark, d):
    return network.renumbered(network.deduplicate(_streets(spark, d, doubled=True)), "id", "seg_id").select("id", "u", "v", "seg_id")


_TURN = "coalesce(degrees(acos(greatest(-1.0, least(1.0, ((bx - ax) * (cx - bx) + (b_y - ay) * (cy - b_y)) / nullif(sqrt((bx - ax) * (bx - ax) + (b_y - ay) * (b_y - ay)) * sqrt((cx - bx) * (cx - bx) + (cy - b_y) * (cy - b_y)), 0))))), 0)"


@query(B + f""", x AS (SELECT id, pts[1].x AS ax, pts[1].y AS ay, pts[2].x AS bx, pts[2].y AS b_y, pts[3].x AS cx, pts[3].y AS cy FROM streets WHERE len(pts) >= 3
  UNION ALL SELECT id, pts[-1].x, pts[-1].y, pts[-2].x, pts[-2].y, pts[-3].x, pts[-3].y FROM streets WHERE len(pts) >= 3),
t AS (SELECT {_TURN} AS turn FROM x WHERE sqrt((bx - ax) * (bx - ax) + (b_y - ay) * (b_y - ay)) <= 10), s AS (SELECT count(*) AS n, sum(turn) AS turn FROM t WHERE turn >= 30),
a AS (SELECT count(*) AS streets, CAST(sum(len(pts) - 1) AS BIGINT) AS pieces, sum({LENGTH}) / 1000 AS km FROM streets)
SELECT streets, round(km, 6) AS network_km, pieces, round(pieces / streets, 6) AS pieces_per_street, round(pieces / km, 6) AS pieces_per_km, n AS stub_ends, round(n / (2.0 * streets), 6) AS stub_end_share, round(coalesce(turn, 0) / km, 6) AS stub_turn_deg_per_km FROM a, s""")
def net_stub_stats(spark, d):
    rows = network.stub_stats(_streets(spark, d))
    return rows.select("streets", _r("network_km"), "pieces", _r("pieces_per_street"), _r("pieces_per_km"), "stub_ends", _r("stub_end_share"), _r("stub_turn_deg_per_km"))


_D = "sqrt((pts[{0}].x - pts[{1}].x) * (pts[{0}].x - pts[{1}].x) + (pts[{0}].y - pts[{1}].y) * (pts[{0}].y - pts[{1}].y)) <= 10"


@query(B + f", a AS (SELECT id, CASE WHEN len(pts) > 2 AND {_D.format(1, 2)} THEN [pts[1]] || pts[3:] ELSE pts END AS pts FROM streets), b AS (SELECT id, CASE WHEN len(pts) > 2 AND {_D.format(-1, -2)} THEN pts[:-3] || [pts[-1]] ELSE pts END AS pts FROM a) SELECT id, CAST(len(pts) AS BIGINT) AS n_points, round({LENGTH}, 6) AS length FROM b")
def net_destub(spark, d):
    return network.with_length(network.destub(_streets(spark, d))).select("id", F.size("pts").cast("long").alias("n_points"), _r("length"))


@query(B + PIECES + " SELECT id, piece, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2, round(length, 6) AS length FROM pieces")
def net_explode(spark, d):
    return network.explode_straight(_streets(spark, d)).select("id", "piece", *[_r(c) for c in ("x1", "y1", "x2", "y2", "length")])


@query(B + CHORDS + " SELECT id, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2, round(length, 6) AS length FROM chords WHERE length > 0.01")
def net_chord(spark, d):
    return network.chords(_streets(spark, d)).select("id", *[_r(c) for c in ("x1", "y1", "x2", "y2", "length")])


def _inside_sql() -> str:
    corner = [(1, 0.5), (0.5, 1), (-0.5, 1), (-1, 0.5), (-1, -0.5), (-0.5, -1), (0.5, -1), (1, -0.5)]
    terms = []
    for (a, b), (c, e) in zip(corner, [*corner[1:], corner[0]], strict=True):
        if b != e:
            terms.append(f"CASE WHEN ((my + hy * {b} > y) <> (my + hy * {e} > y)) AND x < ((mx + hx * {c}) - (mx + hx * {a})) * (y - (my + hy * {b})) / ((my + hy * {e}) - (my + hy * {b})) + (mx + hx * {a}) THEN 1 ELSE 0 END")
    return " + ".join(terms)


INTERIOR = PIECES + f""", ext AS (SELECT (min(least(x1, x2)) + max(greatest(x1, x2))) / 2 AS mx, (min(least(y1, y2)) + max(greatest(y1, y2))) / 2 AS my, CAST(0.35 AS DOUBLE) * (max(greatest(x1, x2)) - min(least(x1, x2))) AS hx, CAST(0.35 AS DOUBLE) * (max(greatest(y1, y2)) - min(least(y1, y2))) AS hy FROM pieces),
c AS (SELECT *, coalesce(sum(length) OVER (PARTITION BY id ORDER BY piece ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(length) OVER (PARTITION BY id) / 2 AS half FROM pieces),
mid AS (SELECT id, x1 + (half - before) / length * (x2 - x1) AS x, y1 + (half - before) / length * (y2 - y1) AS y FROM c WHERE before + length >= half QUALIFY row_number() OVER (PARTITION BY id ORDER BY piece) = 1),
inn AS (SELECT id, ({_inside_sql()}) % 2 = 1 AS interior FROM mid, ext)"""


def _interior(spark: SparkSession, d: str) -> tuple[DataFrame, list]:
    s = _streets(spark, d)
    ring = derived.extent(spark, s)
    return network.with_interior(s, ring), ring


@query(B + INTERIOR + " SELECT id, interior FROM inn")
def net_interior(spark, d):
    return _interior(spark, d)[0].select("id", "interior")


@query(B + INTERIOR + f""", l AS (SELECT s.id, interior, {LENGTH} AS length FROM streets s JOIN inn USING (id))
SELECT count(*) AS streets, count(*) FILTER (interior) AS interior_streets, round(sum(length) / 1000, 1) AS km, round(sum(length) FILTER (interior) / 1000, 1) AS interior_km,
  round(sum(length) FILTER (interior) / 1000 / (any_value(hx * hy) * 3.5 / 1e6), 1) AS km_per_km2, round(quantile_cont(length, 0.5) FILTER (interior), 1) AS median_m FROM l, ext""")
def net_summary(spark, d):
    s, ring = _interior(spark, d)
    return network.summary(s, network.ring_area(ring))


TURNS = PIECES + """, q AS (SELECT id * 8 + piece AS seg, length, x1, y1, x2, y2 FROM pieces),
en AS (SELECT seg, 0 AS e, CAST(round_even(x1 / 1e-6, 0) AS BIGINT) AS kx, CAST(round_even(y1 / 1e-6, 0) AS BIGINT) AS ky, x1 - x2 AS dx, y1 - y2 AS dy FROM q UNION ALL SELECT seg, 1, CAST(round_even(x2 / 1e-6, 0) AS BIGINT), CAST(round_even(y2 / 1e-6, 0) AS BIGINT), x2 - x1, y2 - y1 FROM q),
tw AS (SELECT a.seg AS s, a.e AS es, b.seg AS t, b.e AS et, degrees(acos(greatest(-1.0, least(1.0, (a.dx * -b.dx + a.dy * -b.dy) / (sqrt(a.dx * a.dx + a.dy * a.dy) * sqrt(b.dx * b.dx + b.dy * b.dy)))))) / 90 AS w FROM en a JOIN en b ON a.kx = b.kx AND a.ky = b.ky AND a.seg <> b.seg)"""


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    return cut(network.explode_straight(_streets(spark, d)).withColumn("seg", F.col("id") * 8 + F.col("piece")), "pieces")


@query(B + TURNS + " SELECT s, CAST(es AS INT) AS es, t, CAST(et AS INT) AS et, round(w, 6) AS w FROM tw")
def grf_turn_edges(spark, d):
    return graph.turns(_pieces(spark, d)).select("s", "es", "t", "et", _r("w"))


@query(B + TURNS + " SELECT CAST(floor(w * 513 * 0.5) AS BIGINT) AS w_tulip, count(*) AS n FROM tw GROUP BY 1")
def grf_tulip_bins(spark, d):
    return graph.turns(_pieces(spark, d)).groupBy("w_tulip").agg(F.count("*").alias("n"))


def _to_sql(p: str, q: str, a: str) -> str:
    t = f"greatest(0.0, least(1.0, (({p}) - {a}.x1) * ({a}.x2 - {a}.x1) + (({q}) - {a}.y1) * ({a}.y2 - {a}.y1)) / ({a}.length * {a}.length))"
    t = f"greatest(0.0, least(1.0, ((({p}) - {a}.x1) * ({a}.x2 - {a}.x1) + (({q}) - {a}.y1) * ({a}.y2 - {a}.y1)) / ({a}.length * {a}.length)))"
    return f"sqrt(pow(({p}) - ({a}.x1 + {t} * ({a}.x2 - {a}.x1)), 2) + pow(({q}) - ({a}.y1 + {t} * ({a}.y2 - {a}.y1)), 2))"


def _side_sql(a: str, p: str, q: str) -> str:
    return f"(({a}.x2 - {a}.x1) * ({q} - {a}.y1) - ({a}.y2 - {a}.y1) * ({p} - {a}.x1))"


_CROSS = f"({_side_sql('a', 'b.x1', 'b.y1')} * {_side_sql('a', 'b.x2', 'b.y2')} < 0 AND {_side_sql('b', 'a.x1', 'a.y1')} * {_side_sql('b', 'a.x2', 'a.y2')} < 0)"
_APART = f"least({_to_sql('a.x1', 'a.y1', 'b')}, {_to_sql('a.x2', 'a.y2', 'b')}, {_to_sql('b.x1', 'b.y1', 'a')}, {_to_sql('b.x2', 'b.y2', 'a')})"


@query(B + CHORDS + f", x AS (SELECT a.id AS i, b.id AS k FROM chords a JOIN chords b ON a.id < b.id AND abs(a.x1 - b.x1) < 500 AND abs(a.y1 - b.y1) < 500 WHERE {_CROSS} OR {_APART} <= 12) SELECT i AS src, k AS dst FROM x UNION ALL SELECT k, i FROM x")
def grf_axial_edges(spark, d):
    return graph.intersections(network.chords(_streets(spark, d)), tolerance=12.0)


@query(derived.base_sql("part").replace("WITH one", "WITH RECURSIVE one", 1) + ADJ + ", r(s, v) AS (SELECT id, id FROM streets UNION SELECT r.s, adj.dst FROM r JOIN adj ON r.v = adj.src) SELECT s AS id, min(v) AS component FROM r GROUP BY s")
def grf_components(spark, d):
    s = _streets(spark, d, table="part")
    return graph.components(s, cut(graph.adjacency(s), "adjacency"))


@query(B + DEG + " SELECT id, coalesce(deg, 0) AS connectivity FROM streets LEFT JOIN deg ON src = id")
def top_connectivity(spark, d):
    s = _streets(spark, d)
    return topology.connectivity(s, graph.adjacency(s))


@query(B + DEG + ", c AS (SELECT a.src, sum(1.0 / deg) AS c FROM adj a JOIN deg ON a.dst = deg.src GROUP BY a.src) SELECT id, round(c, 6) AS control FROM streets LEFT JOIN c ON src = id")
def top_control(spark, d):
    s = _streets(spark, d)
    return topology.control(s, graph.adjacency(s)).select("id", _r("control"))


CONTROLLABILITY = ", two AS (SELECT src, dst FROM adj UNION SELECT a.src, b.dst FROM adj a JOIN adj b ON a.dst = b.src WHERE a.src <> b.dst), cb AS (SELECT t.src AS id, any_value(deg) / count(*) AS controllability FROM two t JOIN deg USING (src) GROUP BY t.src)"


@query(B + DEG + CONTROLLABILITY + " SELECT id, round(controllability, 6) AS controllability FROM streets LEFT JOIN cb USING (id)")
def top_controllability(spark, d):
    s = _streets(spark, d)
    return topology.controllability(s, cut(graph.adjacency(s), "adjacency")).select("id", _r("controllability"))


def _reached(spark: SparkSession, d: str, radius: int = 3) -> DataFrame:
    s = _streets(spark, d)
    return cut(topology.paths(s, cut(graph.adjacency(s), "adjacency"), radius), "reached")


@query(B + P3 + " SELECT s AS root, v AS node, CAST(d AS INT) AS depth, g AS sigma FROM p")
def top_depth_r3(spark, d):
    return _reached(spark, d).select("root", "node", "depth", "sigma")


@query(B + P3 + " SELECT s AS root, CAST(d AS INT) AS depth, count(*) AS n FROM p GROUP BY ALL")
def top_levels_r3(spark, d):
    return _reached(spark, d).groupBy("root", "depth").agg(F.count("*").alias("n"))


_DV = "(2 * (k * (log2((k + 2) / 3.0) - 1) + 1) / ((k - 1.0) * (k - 2)))"
INTEGRATION = f""", i1 AS (SELECT *, CASE WHEN k > 1 THEN td / (k - 1.0) END AS md FROM prof), i2 AS (SELECT *, CASE WHEN k > 2 AND md > 1 THEN 2 * (md - 1) / (k - 2) END AS ra FROM i1),
integ AS (SELECT id, k, td, md AS mean_depth, ra, CASE WHEN ra IS NOT NULL THEN ra / {_DV} END AS rra, CASE WHEN ra IS NOT NULL THEN {_DV} / ra END AS integration_hh,
  CASE WHEN ra IS NOT NULL THEN 2 * (k - log2(k) - 1) / ((k - 1.0) * (k - 2)) / ra END AS integration_pv, CASE WHEN ra IS NOT NULL AND td - k + 1 > 1 THEN ln(0.5 * (k - 2)) / ln(td - k + 1) END AS integration_tekl FROM i2)"""
_INT = ("mean_depth", "ra", "rra", "integration_hh", "integration_pv", "integration_tekl")


@query(B + P3 + INTEGRATION + " SELECT id, k, td, " + ", ".join(f"round({c}, 6) AS {c}" for c in _INT) + " FROM integ")
def top_integration_r3(spark, d):
    return topology.integration(topology.profiles(_reached(spark, d))).select("id", "k", "td", *[_r(c) for c in _INT])


@query(B + P3 + CHOICE + " SELECT id, round(coalesce(choice, 0), 4) AS choice FROM prof LEFT JOIN ch USING (id)")
def top_choice_r3(spark, d):
    reached = _reached(spark, d)
    return topology.profiles(reached).select("id").join(topology.choice(reached, 3), "id", "left").select("id", F.round(F.coalesce("choice", F.lit(0.0)), 4).alias("choice"))


@query(B + P3 + CHOICE + " SELECT id, CASE WHEN k > 2 THEN round(coalesce(choice, 0) / ((k - 1.0) * (k - 2) / 2), 6) END AS choice_norm FROM prof LEFT JOIN ch USING (id)")
def top_choice_norm_r3(spark, d):
    reached = _reached(spark, d)
    rows = topology.profiles(reached).join(topology.choice(reached, 3), "id", "left")
    return rows.select("id", F.round(f.normalised_choice(F.coalesce("choice", F.lit(0.0)), F.col("k")), 6).alias("choice_norm"))


@query(B + P3 + INTEGRATION + CONTROLLABILITY.replace(", two", ", deg AS (SELECT src, count(*) AS deg FROM adj GROUP BY src), con AS (SELECT a.src AS id, sum(1.0 / deg) AS control FROM adj a JOIN deg ON a.dst = deg.src GROUP BY a.src), two", 1)
       + " SELECT s.id, highway, round(integration_hh, 6) AS integration_hh, coalesce(deg, 0) AS connectivity, round(control, 6) AS control, round(controllability, 6) AS controllability FROM streets s JOIN integ USING (id) LEFT JOIN deg ON deg.src = s.id LEFT JOIN con USING (id) LEFT JOIN cb USING (id)")
def flagship(spark, d):
    s = _streets(spark, d)
    e = cut(graph.adjacency(s), "adjacency")
    rows = s.select("id", "highway").join(topology.integration(topology.profiles(topology.paths(s, e, 3))).select("id", _r("integration_hh")), "id")
    for more in (topology.connectivity(s, e), topology.control(s, e).select("id", _r("control")), topology.controllability(s, e).select("id", _r("controllability"))):
        rows = rows.join(more, "id")
    return rows


# ranks and classes

_RANK = "(rank() OVER (PARTITION BY highway ORDER BY {0}) + (count(*) OVER (PARTITION BY highway, {0}) - 1) / 2.0)"
_PCT = "CASE WHEN {0} IS NOT NULL THEN (rank() OVER (PARTITION BY highway ORDER BY {0} NULLS LAST) + (count(*) OVER (PARTITION BY highway, {0}) - 1) / 2.0) / count({0}) OVER (PARTITION BY highway) END"
PCT = MEASURES + f", pc AS (SELECT id, highway, {_PCT.format('control')} AS pc, {_PCT.format('length')} AS pl FROM m)"


def _pcts(spark: SparkSession, d: str) -> DataFrame:
    return _measures(spark, d).select("id", "highway", rk.percent_rank("control", ["highway"]).alias("pc"), rk.percent_rank("length", ["highway"]).alias("pl"))


@query(B + PCT + " SELECT id, round(pc, 6) AS pct_control, round(pl, 6) AS pct_length FROM pc")
def rank_pct(spark, d):
    return _pcts(spark, d).select("id", F.round("pc", 6).alias("pct_control"), F.round("pl", 6).alias("pct_length"))


@query(B + PCT + " SELECT id, round(pc - pl, 6) AS divergence FROM pc")
def rank_divergence(spark, d):
    return _pcts(spark, d).select("id", F.round(F.col("pc") - F.col("pl"), 6).alias("divergence"))


PAIRS = ", pr AS (SELECT id, highway, 'control-length' AS step, control AS x, length AS y FROM m UNION ALL SELECT id, highway, 'connectivity-length', connectivity, length FROM m UNION ALL SELECT id, highway, 'connectivity-control', connectivity, control FROM m)"
RHO = PAIRS + ", rr AS (SELECT highway, step, " + ", ".join(f"rank() OVER (PARTITION BY highway, step ORDER BY {c}) + (count(*) OVER (PARTITION BY highway, step, {c}) - 1) / 2.0 AS r{c}" for c in "xy") + " FROM pr WHERE x IS NOT NULL AND y IS NOT NULL)"


def _pairs(rows: DataFrame) -> DataFrame:
    steps = [("control-length", "control", "length"), ("connectivity-length", "connectivity", "length"), ("connectivity-control", "connectivity", "control")]
    return rows.select("*", F.explode(F.array(*[F.struct(F.lit(s).alias("step"), F.col(x).alias("x"), F.col(y).alias("y")) for s, x, y in steps])).alias("p")).select("id", "highway", "p.*")


@query(B + MEASURES + RHO + " SELECT highway, step, count(*) AS n, CASE WHEN count(*) >= 3 AND var_pop(rx) > 0 AND var_pop(ry) > 0 THEN round(corr(rx, ry), 6) END AS spearman FROM rr GROUP BY ALL")
def rank_spearman(spark, d):
    return rk.spearman(_pairs(_measures(spark, d)), ["highway", "step"]).select("highway", "step", "n", _r("spearman"))


@query(B + MEASURES + PAIRS + """, o AS (SELECT highway, step, count(*) OVER w AS n, greatest(1, CAST(round_even(count(*) OVER w * 0.1, 0) AS BIGINT)) AS k, row_number() OVER (PARTITION BY highway, step ORDER BY x DESC, id) AS rx, row_number() OVER (PARTITION BY highway, step ORDER BY y DESC, id) AS ry FROM pr WHERE x IS NOT NULL AND y IS NOT NULL WINDOW w AS (PARTITION BY highway, step))
SELECT highway, step, n, k, round(count(*) FILTER (rx <= k AND ry <= k) / k, 6) AS top_overlap FROM o GROUP BY highway, step, n, k""")
def rank_top10(spark, d):
    return rk.top_overlap(_pairs(_measures(spark, d)), ["highway", "step"], "id").select("highway", "step", "n", "k", _r("top_overlap"))


@query(B + PCT + " SELECT id, coalesce(CAST(least(4, greatest(0, floor(pc * 5 - 1e-9))) AS BIGINT), -1) AS quintile FROM pc")
def cls_quintile(spark, d):
    return _pcts(spark, d).select("id", f.quintile(F.col("pc")).alias("quintile"))


_EDGES = " + ".join(f"CASE WHEN dv >= {e} THEN 1 ELSE 0 END" for e in f.DIVERGENCE)


@query(B + PCT + f", x AS (SELECT id, round(pc - pl, 6) AS dv FROM pc) SELECT id, CASE WHEN dv IS NOT NULL THEN CAST({_EDGES} AS BIGINT) END AS class FROM x")
def cls_divergence(spark, d):
    return _pcts(spark, d).select("id", f.classed(F.round(F.col("pc") - F.col("pl"), 6), f.DIVERGENCE).alias("class"))


_P99 = "coalesce(CAST(least(99, greatest(0, floor({0} * 100 - 1e-9))) AS BIGINT), -1)"


@query(B + PCT + f" SELECT id, {_P99.format('pc')} AS p_control, {_P99.format('pl')} AS p_length FROM pc")
def cls_percentile99(spark, d):
    return _pcts(spark, d).select("id", f.percentile99(F.col("pc")).alias("p_control"), f.percentile99(F.col("pl")).alias("p_length"))


@query(B + PCT + f", x AS (SELECT {_P99.format('pc')} AS a, {_P99.format('pl')} AS b FROM pc), y AS (SELECT CAST(a * 40 // 100 AS BIGINT) AS gx, CAST(b * 40 // 100 AS BIGINT) AS gy, count(*) AS n FROM x WHERE a >= 0 AND b >= 0 GROUP BY ALL) SELECT gx, gy, n, round(sqrt(n / max(n) OVER ()), 6) AS shade FROM y")
def cls_density_grid(spark, d):
    p = _pcts(spark, d).select(f.percentile99(F.col("pc")).alias("a"), f.percentile99(F.col("pl")).alias("b")).where("a >= 0 and b >= 0")
    n = p.groupBy(F.expr("a * 40 div 100").alias("gx"), F.expr("b * 40 div 100").alias("gy")).agg(F.count("*").alias("n"))
    most = n.agg(F.max("n").alias("most"))
    return n.crossJoin(F.broadcast(most)).select("gx", "gy", "n", F.round(F.sqrt(F.col("n") / F.col("most")), 6).alias("shade"))  # one row


# roll-ups, tiles, sets


@query(B + MEASURES + " SELECT highway, round(sum(control * length) / sum(length) FILTER (control IS NOT NULL), 6) AS control, round(sum(connectivity * length) / sum(length), 6) AS connectivity, count(*) AS n FROM m GROUP BY highway")
def roll_weighted_mean(spark, d):
    return _measures(spark, d).groupBy("highway").agg(F.round(rk.weighted_mean("control", "length"), 6).alias("control"), F.round(rk.weighted_mean("connectivity", "length"), 6).alias("connectivity"), F.count("*").alias("n"))


TILES = MEASURES + CHORDS + ", tl AS (SELECT m.*, CAST(floor((x1 + x2) / 2 / 500) AS BIGINT) AS ix, CAST(floor((y1 + y2) / 2 / 500) AS BIGINT) AS iy FROM m JOIN chords c USING (id))"


def _tiles(spark: SparkSession, d: str, size: float = 500.0) -> DataFrame:
    c = network.chords(_streets(spark, d)).select("id", F.floor((F.col("x1") + F.col("x2")) / 2 / size).alias("ix"), F.floor((F.col("y1") + F.col("y2")) / 2 / size).alias("iy"))
    return _measures(spark, d).join(c, "id")


@query(B + TILES.replace("m.*", "m.id, m.length, m.control, m.connectivity") + " SELECT ix, iy, count(*) AS n_segments, round(sum(length) / 1000 / 0.25, 6) AS network_km_per_km2, round(quantile_cont(length, 0.5), 6) AS median_segment_m FROM tl GROUP BY ALL HAVING count(*) >= 20")
def tile_stats(spark, d):
    return _tiles(spark, d).groupBy("ix", "iy").agg(F.count("*").alias("n_segments"), F.round(F.sum("length") / 1000 / 0.25, 6).alias("network_km_per_km2"), F.round(F.percentile("length", 0.5), 6).alias("median_segment_m")).where("n_segments >= 20")


TILE_RHO = TILES.replace("m.*", "m.id, m.length, m.control, m.connectivity") + ", tr AS (SELECT ix, iy, " + ", ".join(f"rank() OVER (PARTITION BY ix, iy ORDER BY {c}) + (count(*) OVER (PARTITION BY ix, iy, {c}) - 1) / 2.0 AS {a}" for c, a in (("control", "ra"), ("length", "rb"))) + " FROM tl WHERE control IS NOT NULL), rho AS (SELECT ix, iy, count(*) AS n, corr(ra, rb) AS rho FROM tr GROUP BY ALL HAVING count(*) >= 20 AND var_pop(ra) > 0 AND var_pop(rb) > 0)"


def _tile_rho(spark: SparkSession, d: str) -> DataFrame:
    pairs = _tiles(spark, d).select("ix", "iy", F.col("control").alias("x"), F.col("length").alias("y"))
    return rk.spearman(pairs, ["ix", "iy"], least=20).where("spearman is not null")


@query(B + TILE_RHO + " SELECT ix, iy, n, round(rho, 6) AS spearman FROM rho")
def tile_spearman(spark, d):
    return _tile_rho(spark, d).select("ix", "iy", "n", _r("spearman"))


@query(B + TILE_RHO + " SELECT count(*) AS tiles, round(quantile_cont(rho, 0.1), 6) AS rho_p10, round(quantile_cont(rho, 0.5), 6) AS rho_median, round(quantile_cont(rho, 0.9), 6) AS rho_p90 FROM rho")
def quant_tiles(spark, d):
    return _tile_rho(spark, d).agg(F.count("*").alias("tiles"), *[F.round(F.percentile("spearman", q), 6).alias(n) for q, n in ((0.1, "rho_p10"), (0.5, "rho_median"), (0.9, "rho_p90"))])


@query(B + MEASURES + " SELECT highway, count(*) FILTER (connectivity <= 3) AS low, count(*) FILTER (connectivity > 3 AND connectivity <= 5) AS middle, count(*) FILTER (connectivity > 5) AS high FROM m GROUP BY highway")
def pivot_runs(spark, d):
    c = F.col("connectivity")
    rows = _measures(spark, d).withColumn("class", F.when(c <= 3, "low").when(c <= 5, "middle").otherwise("high"))
    out = rows.groupBy("highway").pivot("class", ["low", "middle", "high"]).count()
    return out.select("highway", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("low", "middle", "high")])


@query(B + ADJ.replace("FROM streets", "FROM doubled") + CHORDS + f", x AS (SELECT a.id AS i, b.id AS k FROM chords a JOIN chords b ON a.id < b.id AND abs(a.x1 - b.x1) < 500 AND abs(a.y1 - b.y1) < 500 WHERE {_CROSS} OR {_APART} <= 12), y AS (SELECT i AS src, k AS dst FROM x UNION ALL SELECT k, i FROM x) (SELECT src, dst, 'geometric' AS side FROM (SELECT * FROM y EXCEPT SELECT src, dst FROM adj)) UNION ALL (SELECT src, dst, 'junction' FROM (SELECT src, dst FROM adj EXCEPT SELECT * FROM y))")
def set_edge_diff(spark, d):
    s = _streets(spark, d)
    a, b = cut(graph.intersections(network.chords(s), tolerance=12.0), "geometric"), cut(graph.adjacency(_streets(spark, d, doubled=True)), "junction")
    return a.join(b, ["src", "dst"], "left_anti").withColumn("side", F.lit("geometric")).unionByName(b.join(a, ["src", "dst"], "left_anti").withColumn("side", F.lit("junction")))


@query(B + MEASURES + ", o AS (SELECT id, greatest(1, round_even(count(*) OVER () * 0.1, 0)) AS k, row_number() OVER (ORDER BY control DESC NULLS LAST, id) AS rc, row_number() OVER (ORDER BY length DESC, id) AS rl FROM m) SELECT id FROM o WHERE rc <= k AND rl <= k")
def set_top_intersect(spark, d):
    rows = _measures(spark, d)
    k = max(1, round(rows.count() * 0.1))
    top = lambda c: rows.orderBy(F.col(c).desc_nulls_last(), "id").limit(k).select("id")  # noqa: E731  a top-k report
    return top("control").intersect(top("length"))


# derived measures, further classes, clipping and consolidation


@query(B + P3 + INTEGRATION + """, dg AS (SELECT src AS id, CAST(count(*) AS DOUBLE) AS c FROM adj GROUP BY src), x AS (SELECT c, integration_hh AS h FROM dg JOIN integ USING (id) WHERE integration_hh IS NOT NULL)
SELECT count(*) AS n, round(corr(c, h), 6) AS r, round(corr(c, h) * corr(c, h), 6) AS r2, round(corr(ln(greatest(c, 1)), h), 6) AS r_log FROM x""")
def der_intelligibility(spark, d):
    s = _streets(spark, d)
    e = cut(graph.adjacency(s), "adjacency")
    rows = topology.integration(topology.profiles(topology.paths(s, e, 3))).select("id", F.col("integration_hh").alias("h")).join(topology.connectivity(s, e), "id").where("h is not null")
    c = F.col("connectivity").cast("double")
    safe = lambda x: F.when((F.var_pop(x) > 0) & (F.var_pop("h") > 0), F.covar_pop(x, "h") / F.nullif(F.stddev_pop(x) * F.stddev_pop("h"), F.lit(0.0)))
    return rows.agg(F.count("*").alias("n"), safe(c).alias("r"), safe(F.ln(F.greatest(c, F.lit(1.0)))).alias("g")).select("n", _r("r"), F.round(F.col("r") * F.col("r"), 6).alias("r2"), F.round("g", 6).alias("r_log"))


@query(B + TILE_RHO + ", dn AS (SELECT ix, iy, count(*) / 0.25 AS density FROM tl GROUP BY ALL), z AS (SELECT rank() OVER (ORDER BY density) + (count(*) OVER (PARTITION BY density) - 1) / 2.0 AS a, rank() OVER (ORDER BY rho) + (count(*) OVER (PARTITION BY rho) - 1) / 2.0 AS b FROM (SELECT ix, iy, density, round(rho, 9) AS rho FROM rho JOIN dn USING (ix, iy))) SELECT count(*) AS n, CASE WHEN count(*) >= 3 AND var_pop(a) > 0 AND var_pop(b) > 0 THEN round(corr(a, b), 6) END AS corr_with_density FROM z")
def tile_density_corr(spark, d):
    n = _tiles(spark, d).groupBy("ix", "iy").agg((F.count("*") / 0.25).alias("x"))
    pairs = _tile_rho(spark, d).select("ix", "iy", F.round("spearman", 9).alias("y")).join(n, ["ix", "iy"]).withColumn("all", F.lit(1))
    return rk.spearman(pairs, ["all"]).select("n", F.round("spearman", 6).alias("corr_with_density"))


@query(B + TILE_RHO + " SELECT ix, iy, CAST((CASE WHEN rho >= 0.2 THEN 1 ELSE 0 END) + (CASE WHEN rho >= 0.4 THEN 1 ELSE 0 END) + (CASE WHEN rho >= 0.6 THEN 1 ELSE 0 END) + (CASE WHEN rho >= 0.8 THEN 1 ELSE 0 END) AS BIGINT) AS class FROM (SELECT ix, iy, round(rho, 9) AS rho FROM rho)")
def cls_tiles(spark, d):
    return _tile_rho(spark, d).select("ix", "iy", f.classed(F.round("spearman", 9), [0.2, 0.4, 0.6, 0.8]).alias("class"))


@query(B + MEASURES + ", b AS (SELECT CAST((CASE WHEN length > 60 THEN 1 ELSE 0 END) + (CASE WHEN length > 90 THEN 1 ELSE 0 END) + (CASE WHEN length > 120 THEN 1 ELSE 0 END) AS BIGINT) AS bin, length FROM m) SELECT bin, count(*) AS n, round(avg(length), 6) AS mean, round(stddev_samp(length), 6) AS std, round(min(length), 6) AS low, round(quantile_cont(length, 0.25), 6) AS q1, round(median(length), 6) AS q2, round(quantile_cont(length, 0.75), 6) AS q3, round(max(length), 6) AS high FROM b GROUP BY bin")
def cls_bins(spark, d):
    """Lengths by right-closed bins, described."""
    rows = _measures(spark, d).select(f.classed(F.col("length"), [60, 90, 120], right_closed=True).alias("bin"), "length")
    q = [F.round(F.percentile("length", v), 6).alias(n) for v, n in ((0.25, "q1"), (0.5, "q2"), (0.75, "q3"))]
    return rows.groupBy("bin").agg(F.count("*").alias("n"), F.round(F.avg("length"), 6).alias("mean"), F.round(F.stddev_samp("length"), 6).alias("std"), F.round(F.min("length"), 6).alias("low"), *q, F.round(F.max("length"), 6).alias("high"))


_BOX = (130.0, 90.0, 620.5, 555.25)


@query(B + CHORDS + f", ab AS (SELECT id, x1, y1, x2, y2, {network.clip_share(_BOX, True)} AS a, {network.clip_share(_BOX, False)} AS b FROM chords), cl AS (SELECT id, x1 + a * (x2 - x1) AS x1, y1 + a * (y2 - y1) AS y1, x1 + b * (x2 - x1) AS x2, y1 + b * (y2 - y1) AS y2 FROM ab WHERE a < b) SELECT id, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2 FROM cl WHERE sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) > 0.01")
def net_clip(spark, d):
    return network.clip(network.chords(_streets(spark, d)), _BOX).select("id", *[_r(c) for c in graph.XY])


@query(B.replace("WITH one", "WITH RECURSIVE one", 1) + """, jn AS (SELECT DISTINCT u AS id, pts[1].x AS x, pts[1].y AS y FROM streets UNION SELECT v, pts[-1].x, pts[-1].y FROM streets),
pr AS MATERIALIZED (SELECT a.id AS i, b.id AS k FROM jn a JOIN jn b ON a.id <> b.id AND abs(a.x - b.x) <= 72 AND abs(a.y - b.y) <= 72 WHERE sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) <= 72),
r(s, v) AS (SELECT id, id FROM jn UNION SELECT r.s, pr.k FROM r JOIN pr ON r.v = pr.i), c AS (SELECT s AS id, min(v) AS cluster FROM r GROUP BY s)
SELECT id, cluster, round(avg(x) OVER (PARTITION BY cluster), 6) AS x, round(avg(y) OVER (PARTITION BY cluster), 6) AS y FROM jn JOIN c USING (id)""")
def net_consolidate(spark, d):
    s = _streets(spark, d)
    a, b = F.element_at("pts", 1), F.element_at("pts", -1)
    ends = s.select(F.col("u").alias("id"), a["x"].alias("x"), a["y"].alias("y")).union(s.select("v", b["x"], b["y"])).distinct()
    return network.consolidate(cut(ends, "junctions"), 72.0).select("id", "cluster", _r("x"), _r("y"))


# matching

POINTS = ", pt AS (SELECT event_id, CAST((event_id * 7919) % (w * 100) AS DOUBLE) AS px, CAST((event_id * 104729) % (w * 100) AS DOUBLE) AS py FROM events, one)"
_ALL = CHORDS + POINTS + f", nn AS (SELECT event_id, c.id, round({_to_sql('px', 'py', 'c')}, 6) AS distance FROM pt, chords c)"
_NEAR = CHORDS + POINTS + f", nr AS (SELECT event_id, c.id, {_to_sql('px', 'py', 'c')} AS dist FROM pt JOIN chords c ON px >= least(c.x1, c.x2) - 60 AND px <= greatest(c.x1, c.x2) + 60 AND py >= least(c.y1, c.y2) - 60 AND py <= greatest(c.y1, c.y2) + 60), nn AS (SELECT event_id, id, round(dist, 6) AS distance FROM nr WHERE dist <= 60)"


def _points(spark: SparkSession, d: str) -> DataFrame:
    n = spark.read.parquet(f"{d}/customer.parquet").agg(F.ceil(F.sqrt(F.count("*") / 2)).cast("long").alias("w"))
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id").crossJoin(F.broadcast(n))  # one row
    return e.selectExpr("event_id", "CAST((event_id * 7919) % (w * 100) AS DOUBLE) AS x", "CAST((event_id * 104729) % (w * 100) AS DOUBLE) AS y")


def _near(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return cut(_points(spark, d), "points"), network.chords(_streets(spark, d)).select("id", *graph.XY)


@query(B + _ALL + " SELECT event_id, id, distance FROM nn QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY distance, id) = 1")
def match_nearest(spark, d):
    """Of every point the nearest street, however far."""
    return matching.nearest(*_near(spark, d), ["event_id"])


@query(B + _NEAR + " SELECT event_id, count(nn.id) AS n, round(avg(distance), 9) AS mean_distance FROM pt LEFT JOIN nn USING (event_id) GROUP BY event_id")
def match_dwithin(spark, d):
    """Streets within 60 m of every point; 0 where there are none."""
    points, lines = _near(spark, d)
    some = matching.near(points, lines, ["event_id"], 60.0).select("l_id.*", _r("distance"))
    own = some.groupBy("event_id").agg(F.count("*").alias("n"), F.round(F.avg("distance"), 9).alias("mean_distance"))
    return points.select("event_id").join(own, "event_id", "left").select("event_id", F.coalesce("n", F.lit(0)).alias("n"), "mean_distance")


# lineage: streets lie at 100 m steps along lattice rows and columns, lines of 200 m at steps of 260 m

LINEAGE = ", sp AS (SELECT id, o * 100000 + CASE WHEN o = 0 THEN u % 100000 ELSE u // 100000 END AS stroke_id, CAST(100 * (CASE WHEN o = 0 THEN u // 100000 ELSE u % 100000 END) + id % 7 AS DOUBLE) AS c0, CAST(100 * (CASE WHEN o = 0 THEN u // 100000 ELSE u % 100000 END) + id % 7 + 40 + id % 40 AS DOUBLE) AS c1 FROM e), ln AS (SELECT DISTINCT stroke_id * 1000 + CAST(floor(c0 / 260) AS BIGINT) AS axial_id, stroke_id, floor(c0 / 260) * 260 AS s0, floor(c0 / 260) * 260 + 200 AS s1 FROM sp), ov AS (SELECT id, axial_id, least(s1, c1) - greatest(s0, c0) AS o, c1 - c0 AS own FROM sp JOIN ln USING (stroke_id)), lg AS (SELECT id, axial_id, o AS overlap_m FROM ov WHERE o > 0 UNION ALL SELECT id, axial_id, greatest(own, 1e-3) FROM ov WHERE id NOT IN (SELECT id FROM ov WHERE o > 0) QUALIFY row_number() OVER (PARTITION BY id ORDER BY -o, axial_id) = 1)"


def _lineage(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = _streets(spark, d).selectExpr("id", "id % 2 AS o", "u div 100000 AS ux", "u % 100000 AS uy").selectExpr("id", "o * 100000 + IF(o = 0, uy, ux) AS stroke_id", "IF(o = 0, ux, uy) AS k")
    spans = e.selectExpr("id", "stroke_id", "CAST(100 * k + id % 7 AS DOUBLE) AS c0", "CAST(100 * k + id % 7 + 40 + id % 40 AS DOUBLE) AS c1")
    lines = spans.selectExpr("stroke_id", "floor(c0 / 260) AS n").distinct().selectExpr("stroke_id * 1000 + n AS axial_id", "stroke_id", "CAST(n * 260 AS DOUBLE) AS s0", "CAST(n * 260 + 200 AS DOUBLE) AS s1")
    return spans, axial.lineage(lines, spans)


@query(B + LINEAGE + " SELECT id, axial_id, round(overlap_m, 6) AS overlap_m FROM lg")
def lineage_overlap(spark, d):
    return _lineage(spark, d)[1].select("id", "axial_id", _r("overlap_m"))


@query(B + LINEAGE + ", va AS (SELECT axial_id, CASE WHEN axial_id % 5 = 0 THEN NULL ELSE CAST(axial_id % 97 AS DOUBLE) END AS value FROM ln) SELECT id, round(sum(coalesce(value, 0) * overlap_m) / sum(overlap_m), 6) AS plain, round(sum(value * overlap_m) / sum(overlap_m) FILTER (value IS NOT NULL), 6) AS strict FROM sp LEFT JOIN lg USING (id) LEFT JOIN va USING (axial_id) GROUP BY id")
def transfer_streets(spark, d):
    spans, rows = _lineage(spark, d)
    rows = cut(rows, "lineage")
    values = rows.select("axial_id").distinct().withColumn("value", F.when(F.col("axial_id") % 5 != 0, (F.col("axial_id") % 97).cast("double")))
    plain, strict = (axial.transfer(values, rows, spans, ["value"], s).withColumnRenamed("value", n) for s, n in ((False, "plain"), (True, "strict")))
    return plain.join(strict, "id").select("id", _r("plain"), _r("strict"))


@query(B + ", c AS (SELECT id, round_even(pts[1].x, 3) AS ax, round_even(pts[1].y, 3) AS ay, round_even(pts[-1].x, 3) AS bx, round_even(pts[-1].y, 3) AS b_y FROM doubled), k AS (SELECT id, least([ax, ay], [bx, b_y]) AS lo, greatest([ax, ay], [bx, b_y]) AS hi FROM c) SELECT id, min(id) OVER (PARTITION BY lo, hi) AS kept FROM k".replace("k AS (SELECT id, least", "kk AS (SELECT id, least").replace("FROM k", "FROM kk"))
def dedup_coincident(spark, d):
    c = network.chords(_streets(spark, d, doubled=True))
    q = lambda x: F.bround(x, 3)
    a, b = F.struct(q("x1"), q("y1")), F.struct(q("x2"), q("y2"))
    return c.select("id", F.min("id").over(Window.partitionBy(F.least(a, b), F.greatest(a, b))).alias("kept"))


@query(B + ", q AS (SELECT id, list_transform(pts, lambda p: {'x': CAST(round(p.x * 100) AS BIGINT), 'y': CAST(round(p.y * 100) AS BIGINT)}) AS q FROM streets) SELECT id, q[1].x || ',' || q[1].y || ',' || array_to_string(list_transform(range(2, len(q) + 1), lambda i: (q[i].x - q[i - 1].x) || ',' || (q[i].y - q[i - 1].y)), ',') AS line FROM q")
def export_delta(spark, d):
    return _streets(spark, d).select("id", F.array_join(g.deltas(F.col("pts"), 100).cast("array<string>"), ",").alias("line"))


@query(B + ", x AS (SELECT id, i AS pos, p.x, p.y FROM (SELECT id, unnest(pts) AS p, generate_subscripts(pts, 1) AS i FROM streets)) SELECT id, CAST(pos - 1 AS BIGINT) AS pos, round(round(x * 100) / 100, 2) AS x, round(round(y * 100) / 100, 2) AS y FROM x")
def import_delta(spark, d):
    back = _streets(spark, d).select("id", F.posexplode(g.from_deltas(g.deltas(F.col("pts"), 100), 100)).alias("pos", "p"))
    return back.select("id", F.col("pos").cast("long").alias("pos"), F.round("p.x", 2).alias("x"), F.round("p.y", 2).alias("y"))


# searches whose result depends on the order of settling; checked against brute force in the tests


def _angular(spark: SparkSession, d: str, radius: float | None, rule: str = "clean") -> DataFrame:
    p = _pieces(spark, d)
    return angular.analyse(p, cut(graph.turns(p), "turns"), radius, rule=rule)


@query()
def angular_r400(spark, d):
    return _angular(spark, d, 400.0)


@query()
def choice_legacy(spark, d):
    return _angular(spark, d, 400.0, "legacy").select("seg", "choice")


@query()
def metric_r400(spark, d):
    p = _pieces(spark, d)
    return angular.metric(p, cut(graph.turns(p), "turns"), 400.0)


@query()
def top_global(spark, d):
    s = _streets(spark, d)
    return topology.integration(topology.global_table(s, cut(graph.adjacency(s), "adjacency")))


@query()
def choice_random(spark, d):
    s = _streets(spark, d)
    return topology.global_table(s, cut(graph.adjacency(s), "adjacency"), 3, "random", seed=1).select("id", "choice")


@query()
def strokes(spark, d):
    return axial.strokes(_streets(spark, d))


@query()
def axial_lines(spark, d):
    return axial.axial_lines(_streets(spark, d))[0]


@query()
def axial_lineage(spark, d):
    return axial.axial_lines(_streets(spark, d))[1]


RADII = (400, 800, 1200, 2000)


def _ladder(spark: SparkSession, d: str, radii: tuple[int, ...] = RADII) -> DataFrame:
    """(id, radius, measure, value): junction measures as the mean of a street's two ends, piece measures rolled up to streets by length."""
    s = cut(network.with_length(_streets(spark, d)).select("id", "u", "v", "length"), "lengths")
    p = _pieces(spark, d)
    t = cut(graph.turns(p), "turns")

    def long(rows: DataFrame, keys: list[str], radius: int) -> DataFrame:
        names = [c for c in rows.columns if c[0] == "S"]
        each = F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).alias("value")) for c in names])).alias("x")
        return rows.select(*keys, F.lit(radius).alias("radius"), each).select(*keys, "radius", "x.*")

    out = None
    for r in radii:
        j = cut(angular.primal(s, float(r)).select("junction", "harmonic", "betweenness"), "junctions")
        u, v = (j.select(F.col("junction").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("harmonic", "betweenness")]) for side in ("u", "v"))
        zero = s.join(u, "u").join(v, "v").select("id", *[((F.col(f"{c}_u") + F.col(f"{c}_v")) / 2).alias(f"S0_{c}") for c in ("harmonic", "betweenness")])
        one = angular.metric(p, t, float(r)).select("seg", *[F.col(c).alias(f"S1_{c}") for c in ("harmonic", "hillier", "betweenness")])
        two = angular.metric(p, t, float(r), angular=True).select("seg", *[F.col(c).alias(f"S2_{c}") for c in ("hillier", "betweenness")])
        three = angular.analyse(p, t, float(r)).select("seg", *[F.col(c).alias(f"S3_{c}") for c in ("integration", "nain", "choice", "nach")])
        rows = p.select("seg", "id", "length").join(one, "seg").join(two, "seg").join(three, "seg")
        up = long(rows, ["id", "length"], r).groupBy("id", "radius", "measure").agg(rk.weighted_mean("value", "length").alias("value"))
        some = cut(up.unionByName(long(zero, ["id"], r)), "ladder")
        out = some if out is None else out.unionByName(some)
    return out


@query()
def ladder(spark, d):
    return _ladder(spark, d)


#: (family, step, a, b); apart from the steps end to end, a and b differ by one choice.
STEPS = [
    ("closeness", "representation: junction -> segment", "S0_harmonic", "S1_harmonic"),
    ("closeness", "closeness form: harmonic -> NC^2/TD", "S1_harmonic", "S1_hillier"),
    ("closeness", "cost: metric -> angular", "S1_hillier", "S2_hillier"),
    ("closeness", "engine", "S2_hillier", "S3_integration"),
    ("closeness", "normalisation: NC^2/TD -> NAIN", "S3_integration", "S3_nain"),
    ("closeness", "end to end: S1 harmonic vs NAIN", "S1_harmonic", "S3_nain"),
    ("betweenness", "representation: junction -> segment", "S0_betweenness", "S1_betweenness"),
    ("betweenness", "cost: metric -> angular", "S1_betweenness", "S2_betweenness"),
    ("betweenness", "engine", "S2_betweenness", "S3_choice"),
    ("betweenness", "normalisation: choice -> NACH", "S3_choice", "S3_nach"),
    ("betweenness", "end to end: S1 betweenness vs NACH", "S1_betweenness", "S3_nach"),
]


@query()
def agreement(spark, d):
    """Rank agreement of each step's two measures at each radius, over interior streets."""
    s = _streets(spark, d)
    core = network.with_interior(s, derived.extent(spark, s)).where("interior").select("id")
    long = _ladder(spark, d).join(core, "id", "left_semi")
    steps = spark.createDataFrame(STEPS, "family string, step string, a string, b string")
    x = long.select("id", "radius", F.col("measure").alias("a"), F.col("value").alias("x"))
    y = long.select("id", "radius", F.col("measure").alias("b"), F.col("value").alias("y"))
    pairs = cut(F.broadcast(steps).join(x, "a").join(y, ["id", "radius", "b"]), "pairs")
    keys = ["radius", "family", "step", "a", "b"]
    return rk.spearman(pairs, keys).join(rk.top_overlap(pairs, keys, "id").drop("n"), keys).orderBy("radius", F.desc("family"), "a", "b")


@query()
def nested_extents(spark, d):
    """Rank agreement of integration on the core when the network around it is cut closer."""
    s = _streets(spark, d)
    ring = derived.extent(spark, s)
    core = network.with_interior(s, ring).where("interior")

    def one(rows: DataFrame, name: str) -> DataFrame:
        rows = cut(rows.select("id", "u", "v"), "extent")
        return topology.integration(topology.profiles(topology.paths(rows, cut(graph.adjacency(rows), "adjacency"), 3))).select("id", F.col("integration_hh").alias(name))

    pairs = cut(core.select("id").join(one(s, "y"), "id").join(one(core, "x"), "id"), "runs").withColumn("run", F.lit("core"))
    change = pairs.groupBy("run").agg(F.percentile(F.abs(F.col("x") - F.col("y")) / F.greatest(F.abs("y"), F.lit(1e-12)), 0.5).alias("median_rel_change"))
    return rk.spearman(pairs, ["run"]).join(change, "run")
