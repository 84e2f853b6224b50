"""Hand-worked layouts: chain, star, ring, bends and junctions."""

import math
import random

import pytest

from kerbline.functions import geometry as g
from kerbline.operators import angular, axial, graph, network, topology

CHAIN = (5, [(0, 1), (1, 2), (2, 3), (3, 4)])
STAR = (5, [(0, k) for k in range(1, 5)])
RING = (6, [(k, (k + 1) % 6) for k in range(6)])


def frames(spark, layout):
    n, pairs = layout
    return spark.range(n), graph.symmetric(spark.createDataFrame(pairs, "a long, b long"))


def d(k):
    return 2 * (k * (math.log2((k + 2) / 3) - 1) + 1) / ((k - 1) * (k - 2))


def table(spark, layout, radius=10):
    return {r.id: r for r in topology.axial_table(*frames(spark, layout), radius).collect()}


def test_chain(spark):
    t = table(spark, CHAIN)
    assert [(t[k].td, t[k].mean_depth, t[k].choice, t[k].control, t[k].connectivity) for k in range(3)] == [(10, 2.5, 0, 0.5, 1), (7, 1.75, 6, 1.5, 2), (6, 1.5, 8, 1.0, 2)]
    assert [t[k].ra for k in range(3)] == pytest.approx([1, 0.5, 1 / 3])
    assert t[2].integration_hh == pytest.approx(d(5) * 3) and t[0].integration_hh == pytest.approx(t[4].integration_hh) and t[1].choice == t[3].choice


def test_star_hub_is_undefined(spark):
    t = table(spark, STAR)
    assert (t[0].td, t[0].mean_depth, t[0].ra, t[0].integration_hh, t[0].choice) == (4, 1, None, None, 12)
    assert (t[1].td, t[1].mean_depth, t[1].ra, t[1].choice) == (7, 1.75, 0.5, 0)


def test_ring_and_global_search(spark):
    nodes, edges = frames(spark, RING)
    t = {r.id: r for r in topology.global_table(nodes, edges).collect()}
    assert all((r.td, r.k, r.choice) == (9, 6, 4.0) for r in t.values())
    assert sum(r.choice for r in topology.global_table(nodes, edges, None, "random", seed=3).collect()) == 24


def test_choice_conserves_depth(spark):
    rng = random.Random(4)
    nodes, edges = frames(spark, (40, [(k, rng.randrange(k)) for k in range(1, 40)] + [(rng.randrange(40), rng.randrange(40)) for _ in range(25)]))
    split = {r.id: r for r in topology.global_table(nodes, edges).collect()}
    spent = sum(r.td - (r.k - 1) for r in split.values())
    assert sum(r.choice for r in split.values()) == pytest.approx(spent)
    assert sum(r.choice for r in topology.global_table(nodes, edges, None, "random").collect()) == spent
    joins = {r.id: r.choice for r in topology.choice(topology.paths(nodes, edges, 3), 3).collect()}
    near = {r.id: r.choice for r in topology.global_table(nodes, edges, 3).collect()}
    assert {k: v for k, v in near.items() if v} == pytest.approx(joins)


def pieces(spark, lines):
    rows = [(k, *map(float, x)) for k, x in enumerate(lines)]
    p = spark.createDataFrame(rows, "seg long, x1 double, y1 double, x2 double, y2 double").withColumn("length", g.distance(*map(g.F.col, graph.XY)))
    return p, graph.turns(p)


BEND = [(0, 0, 100, 0), (100, 0, 100, 100)]
BRANCH = [(0, 0, 100, 0), (100, 0, 200, 0), (200, 0, 300, 0), (200, 0, 270.7106781, 70.7106781)]
TEE = [(0, 0, 100, 0), (100, 0, 500, 0), (100, 0, 100, 50)]


def test_angular_layouts(spark):
    for tulip in (False, True):
        t = angular.analyse(*pieces(spark, BEND), tulip=tulip).collect()
        assert [(r.nc, r.td, r.integration) for r in t] == [(2, pytest.approx(1), pytest.approx(4))] * 2
    t = {r.seg: r for r in angular.analyse(*pieces(spark, BRANCH), tulip=False).collect()}
    assert [t[k].choice for k in range(4)] == [0, 4, 0, 0] and t[0].td == pytest.approx(0.5)
    assert t[1].nain == pytest.approx(t[1].nc**1.2 / (t[1].td + 2)) and t[1].nach == pytest.approx(math.log(5) / math.log(t[1].td + 3))
    nc = lambda r: {x.seg: x.nc for x in angular.analyse(*pieces(spark, TEE), radius=r).collect()}[0]
    assert (nc(100), nc(300)) == (2, 3)


def plain_search(lines, radius):
    """Least-angle trees by settling the best of all open states again and again."""
    length = [math.dist(x[:2], x[2:]) for x in lines]
    end = lambda k, e: tuple(round(c, 6) for c in lines[k][2 * e : 2 * e + 2])
    out = {}
    for root in range(len(lines)):
        opened, settled, tick = [(0.0, length[root] / 2, 0, (root, 0), None), (0.0, length[root] / 2, -1, (root, 1), None)], {}, -1
        while opened:
            best = min(opened)
            opened.remove(best)
            if best[3] in settled:
                continue
            settled[best[3]] = (best[0], best[4])
            k, e = best[3]
            for t in range(len(lines)):
                for et in (0, 1):
                    if t != k and end(t, et) == end(k, e) and (t, 1 - et) not in settled and best[1] + length[t] / 2 <= radius:
                        a = [lines[k][2 * e + c] - lines[k][2 * (1 - e) + c] for c in (0, 1)]
                        b = [lines[t][2 * (1 - et) + c] - lines[t][2 * et + c] for c in (0, 1)]
                        cos = sum(x * y for x, y in zip(a, b, strict=True)) / math.hypot(*a) / math.hypot(*b)
                        w = math.floor(math.degrees(math.acos(max(-1, min(1, cos)))) / 90 * 513 * 0.5)
                        tick -= 1
                        opened.append((best[0] + w, best[1] + length[t], tick, (t, 1 - et), (k, e)))
        out[root] = settled
    return out


def test_angular_equals_a_plain_search(spark):
    rng = random.Random(5)
    at = {(x, y): (100 * x + rng.uniform(-20, 20), 100 * y + rng.uniform(-20, 20)) for x in range(4) for y in range(4)}
    lines = [(*at[p], *at[q]) for p in at for q in ((p[0] + 1, p[1]), (p[0], p[1] + 1)) if q in at]
    for radius in (250.0, float("inf")):
        trees = plain_search(lines, radius)
        got = {r.seg: r for r in angular.analyse(*pieces(spark, lines), None if radius == float("inf") else radius).collect()}
        flow = [0] * len(lines)
        for root, tree in trees.items():
            best = {}
            for s, (depth, _) in tree.items():
                if s[0] not in best or depth < tree[best[s[0]]][0]:
                    best[s[0]] = s
            assert got[root].nc == len(best) and got[root].td == pytest.approx(sum(tree[s][0] for s in best.values()) / 256)
            for k, s in best.items():
                way = tree[s][1] if k != root else None
                while way is not None:
                    if way[0] != root:
                        flow[way[0]] += 1
                    way = tree[way][1]
        assert [got[k].choice for k in range(len(lines))] == flow


def lines_of(spark, *streets):
    rows = [(k, 2 * k, 2 * k + 1, [(float(x), float(y)) for x, y in pts]) for k, pts in enumerate(streets)]
    return spark.createDataFrame(rows, "id long, u long, v long, pts array<struct<x:double,y:double>>")


def test_axial_lines_follow_straight_streets(spark):
    s = lines_of(spark, [(0, 0), (100, 0)], [(100, 0), (300, 0)], [(100, -50), (100, 0)], [(100, 0), (100, 60)])
    lines, rows = axial.axial_lines(s, tolerance=5)
    assert lines.count() == 2
    assert {r.id: r.overlap_m for r in rows.collect()} == pytest.approx({0: 100, 1: 200, 2: 50, 3: 60})
    own = lines.withColumnRenamed("axial_id", "id").select("id", *graph.XY)
    assert graph.intersections(own).count() == 2
    values = rows.select("axial_id").distinct().withColumn("v", g.F.lit(7.0))
    assert [r.v for r in axial.transfer(values, rows, s, ["v"]).collect()] == [7.0] * 4


def test_lines_touch_cross_or_stand_alone(spark):
    rows = [(0, 0.0, 0.0, 10.0, 0.0), (1, 5.0, -5.0, 5.0, 5.0), (2, 10.0, 0.0, 10.0, 10.0), (3, 20.0, 20.0, 30.0, 20.0)]
    lines = spark.createDataFrame(rows, "id long, x1 double, y1 double, x2 double, y2 double")
    assert sorted((r.src, r.dst) for r in graph.intersections(lines).collect()) == [(0, 1), (0, 2), (1, 0), (2, 0)]


def test_parallels_and_simplification(spark):
    s = lines_of(spark, [(0, 0), (50, 4), (100, 0)], [(0, 0), (100, 0)], [(0, 0), (50, 40), (100, 0)]).selectExpr("id", "0L AS u", "1L AS v", "pts")
    assert sorted(r.id for r in network.merge_parallels(s, 5.0).collect()) == [1, 2]
    assert [len(r.pts) for r in network.simplified(s, 8.0).orderBy("id").collect()] == [2, 2, 3]


def test_junction_measures(spark):
    # a path 0 - 1 - 2 - 3, and a second way from 0 to 2 of the same length
    rows = [(0, 0, 1, 10.0), (1, 1, 2, 10.0), (2, 2, 3, 10.0), (3, 0, 4, 10.0), (4, 4, 2, 10.0)]
    s = spark.createDataFrame(rows, "id long, u long, v long, length double")
    got = {r.junction: r for r in angular.primal(s, 25.0).collect()}
    assert got[0].density == 3 and got[0].harmonic == pytest.approx(0.1 + 0.1 + 0.05)
    assert got[3].density == 3 and got[3].harmonic == pytest.approx(0.1 + 0.05 + 0.05)
    # 0-2 over 1 and 4 by halves, 1-4 over 0 and 2 by halves, 1-3 and 4-3 over 2; 0-3 lies beyond the radius
    assert {k: r.betweenness for k, r in got.items()} == pytest.approx({0: 0.5, 1: 0.5, 2: 2.5, 3: 0, 4: 0.5})


def test_agreement_has_every_step_and_radius(spark, monkeypatch):
    from kerbline.plans import catalogue
    from kerbline.sources import derived

    d = "/root/testdata/sf0.001"
    monkeypatch.setattr(catalogue._ladder, "__defaults__", ((400, 800),))
    long = catalogue._ladder(spark, d).collect()
    names = {r.measure for r in long}
    assert names == {x for _, _, a, b in catalogue.STEPS for x in (a, b)} and len(names) == 11
    got = catalogue.agreement(spark, d).collect()
    assert len(got) == 22 and {r.radius for r in got} == {400, 800}
    s = derived.streets(spark, d)
    inside = network.with_interior(s, derived.extent(spark, s)).where("interior").count()
    assert 0 < inside < s.count() and max(r.n for r in got) <= inside


def test_tiles_give_what_the_whole_network_gives(spark, monkeypatch):
    from kerbline.operators import angular, graph
    from kerbline.plans import catalogue

    p = catalogue._pieces(spark, "/root/testdata/sf0.001").cache()
    t = graph.turns(p).cache()
    lost = []
    monkeypatch.setattr(angular, "_roots", lambda *a: lost.append(a))  # nothing goes by the whole network
    for kw in ({"rule": "clean"}, {"rule": "legacy"}, {"tulip": False}):
        got = {r.seg: r for r in angular.analyse(p, t, 150.0, **kw).collect()}
        assert not lost
        want = angular.analyse(p.select("seg", "length"), t, 150.0, roots=p.select("seg"), **kw).collect()
        assert len(want) == len(got) > 100
        for w in want:
            assert all((x is None) == (y is None) and (x is None or abs(x - y) <= 1e-9 * max(1, abs(x))) for x, y in zip(w, got[w.seg], strict=True)), (w, got[w.seg])
