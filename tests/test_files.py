from kerbline.functions import geometry as g
from kerbline.functions import ranking as rk
from kerbline.operators import network
from kerbline.sources import files, shared


def test_line_files_and_layers(spark, tmp_path):
    rows = [(1, 0.1234567, 0.0, 10.0, 0.0), (2, 5.0, 5.0, 5.0, 5.001)]
    df = spark.createDataFrame(rows, "ref long, x1 double, y1 double, x2 double, y2 double")
    files.write_lines(df, f"{tmp_path}/lines")
    assert [tuple(r) for r in files.read_lines(spark, f"{tmp_path}/lines").collect()] == [(1, 0.123457, 0.0, 10.0, 0.0)]
    files.write_layer(df.withColumn("site", g.F.lit("a")), str(tmp_path), "lines2", ("site",))
    assert files.read_layer(spark, str(tmp_path), "lines2").where("site = 'a'").count() == 2
    files.write_json(df, f"{tmp_path}/json")
    assert spark.read.json(f"{tmp_path}/json").count() == 2
    assert files.markdown(df.select("ref")).splitlines() == ["| ref |", "|---|", "| 1 |", "| 2 |"]
    assert shared.fingerprint(df) == shared.fingerprint(df.orderBy("x2")) != shared.fingerprint(df.limit(1))


def test_engine_exports(spark, tmp_path):
    (tmp_path / "map.csv").write_text("Ref,x1,y1,x2,y2,Segment Length\n7,0,0,1,0,1\n9,1,0,1,1,1\n")
    (tmp_path / "links.csv").write_text("refA,refB,ss_weight,for_back,dir\n7,9,1.0,0,1\n9,7,1.0,1,-1\n7,8,1.0,0,1\n")
    segments, turns = files.read_engine_map(spark, str(tmp_path / "map.csv"), str(tmp_path / "links.csv"))
    assert segments.count() == 2
    assert sorted(tuple(r) for r in turns.select("s", "es", "t", "et", "w").collect()) == [(7, 1, 9, 0, 1.0), (9, 0, 7, 1, 1.0)]
    assert files.engine_column("Node Count", 400) == "T1024 Node Count R400 metric" and files.engine_column("Choice", None) == "T1024 Choice"


def test_ranks_with_ties_and_nulls(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "a", 1.0), (3, "a", 3.0), (4, "a", None)], "id long, k string, v double")
    got = {r.id: r.p for r in df.select("id", rk.percent_rank("v", ["k"]).alias("p")).collect()}
    assert got == {1: 0.5, 2: 0.5, 3: 1.0, 4: None}
    flat = spark.createDataFrame([(1, 2.0, 1.0), (1, 2.0, 5.0), (1, 2.0, 7.0)], "k long, x double, y double")
    assert [tuple(r) for r in rk.spearman(flat, ["k"]).collect()] == [(1, 3, None)]


def test_stubs_and_interior(spark):
    rows = [(0, 0, 1, [(0.0, 0.0), (3.0, -4.0), (100.0, 0.0)]), (1, 1, 2, [(100.0, 0.0), (200.0, 0.0)]), (2, 2, 3, [(0.0, 0.0), (5.0, 0.0), (10.0, 0.0)])]
    s = spark.createDataFrame(rows, "id long, u long, v long, pts array<struct<x:double,y:double>>")
    r = network.stub_stats(s).first()
    assert (r.streets, r.stub_ends, r.stub_end_share) == (3, 1, 1 / 6)
    assert [len(x.pts) for x in network.destub(s).orderBy("id").collect()] == [2, 2, 2]
    square = [(-10.0, -50.0), (120.0, -50.0), (120.0, 50.0), (-10.0, 50.0)]
    assert {x.id: x.interior for x in network.with_interior(s, square).collect()} == {0: True, 1: False, 2: True}
    assert network.ring_area(square) == 13_000
