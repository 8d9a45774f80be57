import pytest
from pyspark.sql import functions as F

from wayfare.operators.topology import vertex_subgraphs
from wayfare.sources import readers as R
from wayfare.sources import writers as W


def put(path, *lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def edges(g):
    return sorted((r.src, r.dst) for r in g.edges.collect())


def test_adjacency(spark, tmp_path):
    g = R.read_adjacency(spark, put(tmp_path / "a", "1 2 3", "2\t3 ", "", "4"))
    assert edges(g) == [(1, 2), (1, 3), (2, 3)] and sorted(r.id for r in g.vertices.collect()) == [1, 2, 3, 4]
    assert g.check() == []
    p = R.read_adjacency(spark, put(tmp_path / "b", "1 0 2 3", "2 1"), partitioned=True)
    assert edges(p) == [(1, 2), (1, 3)] and dict(p.vertices.select("id", "partition_id").collect()) == {1: 0, 2: 1, 3: None}


def test_json(spark, tmp_path):
    g = R.read_json(spark, put(tmp_path / "a", '[1,0,"a",[[2,10,"x"],[3,11,"y"]]]', '[2,1,"b",[]]'))
    assert sorted(map(tuple, g.edges.collect())) == [(1, 2, 10, "x"), (1, 3, 11, "y")]
    assert {r.id: r.value for r in g.vertices.collect()} == {1: "a", 2: "b", 3: None}


def test_full_info(spark, tmp_path):
    g = R.read_full_info(spark, put(tmp_path / "a", "0\t1 0 2 0 0 3 4294967296 1", "0 2 0"))
    assert edges(g) == [(1, 2), (1, 3)]
    assert {r.id: (r.partition_id, r.subgraph_id) for r in g.vertices.collect()} == {1: (0, 0), 2: (0, 0), 3: (1, 1 << 32)}


def test_key_values(spark, tmp_path):
    path = put(tmp_path / "a", "3", '[1,"country:string:US$nclass:string:7",[[2,10,"w:string:1"]]]', '[2,"country:string$nclass:string:a:b",[]]')
    g = R.read_key_values(spark, path, ["country", "nclass"])
    assert {r.id: (r.country, r.nclass, r.partition_id) for r in g.vertices.collect()} == {1: ("US", "7", 3), 2: (None, "a:b", 3)}
    assert g.edges.columns == ["src", "dst", "edge_id"]
    kept = R.read_key_values(spark, path, None, None, missing="n", single_subgraph=True)
    assert kept.vertices.where("id = 2").first().props == {"country": "n", "nclass": "a:b"} or kept.vertices.where("id = 2").first().props["nclass"] == "a:b"
    assert kept.edges.first().props == {"w": "1"} and kept.vertices.first().subgraph_id == 3 << 32
    t = R.read_key_values_tagged(spark, put(tmp_path / "b", '[1,"tag:String:a$:$url:String:http://b",[[2,10,"rel:String:x$:$rel2:String:y"]]]'), ["tag", "url"], ["rel", "rel2"])
    assert tuple(t.vertices.where("id = 1").select("tag", "url").first()) == ("a", "http://b")
    assert tuple(t.edges.select("rel", "rel2").first()) == ("x", "y")


def test_delimited_round_trip(spark, g0, tmp_path):
    sg = vertex_subgraphs(g0, 2).cache()
    W.write_lines(W.vertex_records(g0.__class__(g0.vertices.join(sg, "id"), g0.edges), ["c"]), str(tmp_path / "v"))
    W.write_lines(W.adjacency_records(g0, sg), str(tmp_path / "e"))
    back = R.read_delimited(spark, str(tmp_path / "v"), str(tmp_path / "e"), ["c"])
    assert {r.id: r.c for r in back.vertices.collect()} == {r.id: r.c or "n" for r in g0.vertices.collect()}
    assert edges(back) == edges(g0)
    line = next(r.value for r in W.adjacency_records(g0, sg).collect() if "#1@" in r.value)
    assert line.endswith("#1@2%3:3:2|")


def test_in_edge_files(spark, tmp_path):
    v = put(tmp_path / "v", "0#1@a^x|0#2@b*y|")
    g = R.read_delimited(spark, v, put(tmp_path / "o", "0#1@1%2|"), ["p", "q"], put(tmp_path / "i", "0#2@1%1|0#1@1%2|"))
    assert edges(g) == [(1, 2), (2, 1)] and {r.id: (r.p, r.q) for r in g.vertices.collect()} == {1: ("a", "x"), 2: ("b", "y")}
    f = R.read_property_files(spark, {"p": put(tmp_path / "p", "0#1@a|"), "q": put(tmp_path / "q", "0#1@x|0#2@y|")}, str(tmp_path / "o"))
    assert {r.id: (r.p, r.q) for r in f.vertices.collect()} == {1: ("a", "x"), 2: (None, "y")}


def test_lines_tables_index(spark, g0, tmp_path):
    W.write_lines(W.adjacency_lines(g0), str(tmp_path / "a"))
    assert edges(R.read_adjacency(spark, str(tmp_path / "a"))) == edges(g0)
    W.write_tables(g0, str(tmp_path / "t"))
    back = R.read_tables(spark, str(tmp_path / "t"))
    assert sorted(map(tuple, back.edges.collect())) == sorted(map(tuple, g0.edges.collect()))
    W.write_index(W.property_index(g0, ["c"]), str(tmp_path / "i"))
    assert spark.read.parquet(str(tmp_path / "i")).where("property = 'c' and value = 'n'").first().id == 5
    assert R.read_queries(spark, put(tmp_path / "q", "a", "", " b ")) == ["a", "b"]


def test_random_graph(spark):
    a, b = R.random_graph(spark, 50, 200, 4), R.random_graph(spark, 50, 200, 4)
    assert edges(a) == edges(b) and a.edges.count() == 200 and a.check() == []
    with pytest.raises(AssertionError):
        assert edges(a) == edges(R.random_graph(spark, 50, 200, 5))
    assert a.edges.agg(F.max("dst")).first()[0] < 50


def test_implicit_records(spark, tmp_path):
    vid, country, edges_path = put(tmp_path / "vid", "5|7|", "9|"), put(tmp_path / "country", "US||DE|"), put(tmp_path / "edges", "1%7:9|", "0%|", "0%5|")
    g = R.read_implicit(spark, {"vid": vid, "country": country}, edges_path)
    assert {r.id: r.country for r in g.vertices.collect()} == {5: "US", 7: "", 9: "DE"}
    assert edges(g) == [(5, 7), (5, 9), (9, 5)]


def test_malformed_lines(spark, tmp_path):
    path = put(tmp_path / "j", "3", '[1,0,"a",[]]', "{broken")
    assert [r.value for r in R.malformed(spark, path, "json").collect()] == ["{broken"]
    path = put(tmp_path / "d", "0#1@US|oops|0#2@DE|")
    assert [r.value for r in R.malformed(spark, path, "delimited").collect()] == ["oops"]
