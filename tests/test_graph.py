"""The hand-made graph's known results, and relations that must hold between queries."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from wayfare.operators import algorithms as A
from wayfare.operators import stats as S
from wayfare.operators import topology as T
from wayfare.operators.bfs import bfs_leaf_paths, bfs_tree, bfs_walks, with_properties
from wayfare.operators.engine import run, run_batch
from wayfare.operators.graph import PropertyGraph
from wayfare.operators.lookup import find_vertices, property_of, vertex_text
from wayfare.operators.paths import hop_counts, match, paths
from wayfare.operators.reach import shortest_walks
from wayfare.plans.cost import PRESETS, choose_side, choose_start, collect_stats, explain, histogram_stats, impossible, lookup_stats, path_costs, reach_costs
from wayfare.plans.query import parse_path, parse_predicate, parse_reach
from wayfare.sources.readers import random_graph


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def texts(df):
    return sorted(r.path for r in df.collect())


def test_lookup(g0):
    assert [r.id for r in find_vertices(g0, "c:string[US]").orderBy("id").collect()] == [1, 3]
    assert rows(find_vertices(g0, "c:string[n]")) == [(5,)]
    assert rows(find_vertices(g0, "vid:int[4]")) == [(4,)]
    assert rows(find_vertices(g0, "-i nothing:string[x]")) == []
    assert rows(find_vertices(g0, "c:string[IN]", max_roots=1)) == [(2,)]
    assert rows(vertex_text(find_vertices(g0, "c:string[DE]"))) == [("V:4",)]
    assert property_of(g0, "c:string[DE]").first().props == {"c": "DE"}


def test_paths(g0):
    assert texts(paths(g0, "c:string[US]@out?@c:string[IN]")) == ["V:1-->E:10-->V:2"]
    assert texts(paths(g0, "c:string[US]@out?r:string[b]@c:string[US]")) == ["V:1-->E:13-->V:3", "V:3-->E:12-->V:1"]
    assert texts(paths(g0, "c:string[US]@in?@c:string[IN]")) == ["V:3<--E:11<--V:2"]
    assert texts(paths(g0, "c:string[US]@in?r:string[a]@c:string[US]")) == ["V:3<--E:14<--V:1"]
    assert len(texts(paths(g0, "out?"))) == 8
    assert texts(paths(g0, "c:string[DE]")) == ["V:4"]


PATTERNS = ["c:string[US]@out?@out?r:string[a]@c:string[DE]", "out?@in?@out?", "c:string[n]@in?@in?@c:string[US]@out?", "c:string[IN]@out?@out?@out?"]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_start_changes_nothing(g0, pattern):
    q = parse_path(pattern)
    found = [texts(paths(g0, q, s)) for s in range(len(q.vertices))]
    assert all(f == found[0] for f in found)
    assert texts(run("path", g0, pattern)) == found[0]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_reversed_graph(g0, pattern):
    turned = pattern.replace("out?", "#").replace("in?", "out?").replace("#", "in?")
    ids = lambda g, p: rows(match(g, p))
    assert ids(g0, pattern) == ids(g0.reverse(), turned)


def test_paths_by_hand(spark):
    g = random_graph(spark, 12, 40, 3)
    edges = [tuple(r) for r in g.edges.select("src", "dst", "edge_id").collect()]
    want = sorted((a[0], a[2], a[1], b[2], b[0]) for a, b in itertools.product(edges, edges) if a[1] == b[1])
    assert rows(match(g, "out?@in?", 1)) == sorted(want, key=repr)


def test_undirected(g0):
    both = g0.symmetrize()
    assert both.edges.count() == 15  # the self-loop once
    assert texts(paths(both, "c:string[IN]@in?@c:string[US]", undirected=True)) == ["V:2-->E:10-->V:1", "V:2-->E:11-->V:3"]


def test_hop_counts(g0):
    assert rows(hop_counts(g0, "c:string[US]@out?@c:string[US]@out?@c:string[DE]")) == [(0, 2), (1, 3), (2, 2)]


def test_bfs(g0):
    assert rows(bfs_tree(g0, "c:string[DE]:2")) == [(4, 4, 17, 5, 1)]
    assert rows(bfs_tree(g0, "c:string[XX]:2")) == []
    assert rows(bfs_tree(g0, "c:string[DE]:0")) == []
    assert rows(bfs_walks(g0, "c:string[DE]:2")) == [(4, 4, 16, 4, 1), (4, 4, 16, 4, 2), (4, 4, 17, 5, 1), (4, 4, 17, 5, 2)]
    assert bfs_walks(g0, "c:string[US]:5").count() == bfs_walks(g0, "c:string[US]:5", counted=True).agg(F.sum("walks")).first()[0]
    leaves = rows(bfs_leaf_paths(g0, "c:string[US]:2"))
    assert [sum(r[0] == v for r in leaves) for v in (1, 3)] == [5, 5]
    assert rows(bfs_leaf_paths(g0, "c:string[DE]:3", pruned=True)) == [(4, "V:4-->E:17-->V:5")]
    assert rows(with_properties(g0, bfs_tree(g0, "c:string[IN]:1"), "dst", "c")) == [(2, 2, 11, 3, 1, "US")]


def test_walks_are_paths(g0):
    walks = bfs_walks(g0, "c:string[US]:3").where("depth = 3").count()
    assert walks == match(g0, "c:string[US]@out?@out?@out?").count()


def test_depths_are_distances(g0):
    tree = dict(bfs_tree(g0, "vid:int[1]:9").select("dst", "depth").collect())
    near = {r.id: r.distance for r in A.shortest_paths(g0, 1).collect()}
    assert near == {1: 0, **tree}


def test_reach(g0):
    for side in (0, 1):
        q = lambda d, a="IN", b="DE": rows(shortest_walks(g0, f"{d}@c:string[{a}]@c:string[{b}]//{side}"))  # noqa: B023, E731
        assert q(1) == []
        assert q(2) == q(3) == [(2, 4, 2, "V:2-->E:11-->V:3-->E:15-->V:4")]
        assert q(3, "DE", "DE") == [(4, 4, 1, "V:4-->E:16-->V:4")]
        assert q(2, "US", "US") == [(1, 3, 1, "V:1-->E:13-->V:3"), (1, 3, 1, "V:1-->E:14-->V:3"), (3, 1, 1, "V:3-->E:12-->V:1")]
        assert q(5, "n", "US") == []
    assert rows(run("reach", g0, "-ni 3@c:string[IN]@c:string[DE]")) == [(2, 4, 2, "V:2-->E:11-->V:3-->E:15-->V:4")]


def test_reach_by_hand(spark):
    g = random_graph(spark, 30, 60, 5)
    v = g.vertices.withColumn("k", (F.col("id") % 5).cast("string"))
    g = PropertyGraph(v, g.edges)
    edges = [tuple(r) for r in g.edges.select("src", "dst", "edge_id").collect()]
    walks = [((s,), ()) for s in range(0, 30, 5)]
    for depth in range(1, 6):
        walks = [((*vs, e[1]), (*es, e[2])) for vs, es in walks for e in edges if e[0] == vs[-1]]
        hits = [w for w in walks if w[0][-1] % 5 == 3]
        if hits:
            break
    want = sorted("V:%d" % vs[0] + "".join(f"-->E:{e}-->V:{x}" for e, x in zip(es, vs[1:])) for vs, es in hits)
    for side in (0, 1):
        assert texts(shortest_walks(g, "5@k:string[0]@k:string[3]", side)) == want


def test_batch(g0):
    a, b = run_batch("path", g0, "c:string[DE]@out?; c:string[US]@out?@c:string[IN]")
    assert a.count() == 2 and b.count() == 1
    assert run("vertex", g0, "c:string[DE]").first()[0] == "V:4"
    assert run("bfs", g0, "c:string[DE]:1").count() == 1
    with pytest.raises(ValueError):
        run("nothing", g0, "")


def test_statistics(g0):
    got = {r.value: (r.n, round(r.probability, 6), r.avg_out, r.avg_in) for r in S.vertex_statistics(g0, ["c"]).collect()}
    assert got == {"DE": (1, 0.166667, 2.0, 2.0), "IN": (2, 0.333333, 0.5, 0.5), "US": (2, 0.333333, 2.5, 2.0), "n": (1, 0.166667, 0.0, 1.0)}
    assert rows(S.edge_statistics(g0, ["r"]).select("value", "n")) == [("a", 5), ("b", 3)]
    assert tuple(S.graph_totals(g0).first()) == (6, 8, 0, 0)
    # odd to even or back: 10, 11, 15, 17
    assert S.graph_totals(g0, 2).first().remote_edges == 4
    assert tuple(S.edge_counts(g0).first()) == (8, 5)
    assert rows(S.degree_distribution(g0, parse_predicate("c:string[US]"))) == [(2, 1), (3, 1)]
    assert tuple(S.graph_stats(g0).first()) == (6, 8, 3, 3, 1, 2)
    assert S.in_edges(g0).count() == 7


def test_histogram(spark):
    f = spark.createDataFrame([("p", f"v{i:02d}", i % 7 + 1) for i in range(40)], "property string, value string, n bigint")
    total = sum(i % 7 + 1 for i in range(40))
    h = S.equi_depth_histogram(f, 5).orderBy("bin").collect()
    before, want = 0, {}
    for i in range(40):
        want.setdefault(before * 5 // total, []).append(i)
        before += i % 7 + 1
    assert [(r.bin, r["first"], r["last"], r["keys"], r.frequency) for r in h] == [(b, f"v{ks[0]:02d}", f"v{ks[-1]:02d}", len(ks), sum(k % 7 + 1 for k in ks)) for b, ks in sorted(want.items())]
    exact = S.equi_depth_histogram(f, total).collect()
    assert len(exact) == 40 and all(r["keys"] == 1 for r in exact)


def test_planner(g0):
    q = parse_path("c:string[US]@out?r:string[b]@c:string[DE]")
    stats = collect_stats(g0, q, 2)
    costs = path_costs(q, stats)
    assert len(costs) == 2 and None not in costs
    assert choose_start(q, stats) == costs.index(min(costs))
    assert choose_start(parse_path("c:string[US]@out?@c:string[DE]//0"), stats) == 0
    for preset in PRESETS:
        assert choose_start(q, stats, preset, preset.startswith("undirected")) in (0, 1)
    assert "<- start" in explain(q, stats)
    none = parse_path("c:string[XX]@out?")
    assert impossible(none, collect_stats(g0, none)) and run("path", g0, "c:string[XX]@out?").count() == 0
    r = parse_reach("3@c:string[US]@c:string[DE]")
    s = collect_stats(g0, r, 2)
    a, b = reach_costs(r, s)
    assert choose_side(r, s) == (0 if a < b else 1)
    v, e = S.vertex_statistics(g0, ["c"], 2), S.edge_statistics(g0, ["r"])
    stored = lookup_stats((6, 8, 4), v, e, q)
    assert stored.vertex == stats.vertex and stored.edge == stats.edge
    binned = histogram_stats((6, 8, 4), S.equi_depth_histogram(v, 1000), S.equi_depth_histogram(e, 100), q)
    assert path_costs(q, binned) == pytest.approx(costs)
    wild = parse_path("out?@c:string[DE]")
    assert choose_start(wild, collect_stats(g0, wild)) == 1


def test_topology(g0):
    got = {r.id: (r.partition_id, r.subgraph_id) for r in T.vertex_subgraphs(g0, 2).collect()}
    # odd: 1 and 3 by an edge, 5 alone; even: 2 and 4 have no edge or common neighbour there, 6 alone
    assert got[1] == got[3] == (1, 1 << 32) and got[5] == (1, 1 << 32 | 1)
    assert sorted(got[v] for v in (2, 4, 6)) == [(0, 0), (0, 1), (0, 2)]
    assert {r.subgraph_id for r in T.vertex_subgraphs(g0, 2, whole=True).collect()} == {0, 1 << 32}
    sg = T.vertex_subgraphs(g0, 2).cache()
    assert T.remote_edges(g0, sg).where("remote").count() == 4
    meta = {(r.src_subgraph, r.dst_subgraph): (r.local_vertices, r.remote_vertices) for r in T.metagraph(g0, sg).collect()}
    assert meta[1 << 32, got[2][1]] == (2, 1)
    assert T.within_subgraphs(g0, sg).edges.count() == 4


def test_common_neighbour_joins_a_subgraph(spark):
    v = spark.createDataFrame([(i,) for i in range(4)], "id bigint")
    e = spark.createDataFrame([(1, 0, 1), (3, 0, 2)], "src bigint, dst bigint, edge_id bigint")
    got = {r.id: r.subgraph_id for r in T.vertex_subgraphs(PropertyGraph(v, e), 2).collect()}
    assert got[1] == got[3] and got[0] != got[2]


def test_algorithms(g0, spark):
    assert rows(A.connected_components(g0)) == [(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (6, 6)]
    rank = {r.id: round(r["rank"], 6) for r in A.pagerank(g0, 5).collect()}
    assert rank == {1: 0.078995, 2: 0.04971, 3: 0.116092, 4: 0.147252, 5: 0.093257, 6: 0.025}
    assert A.triangle_count(g0).first()[0] == 1
    assert A.vertex_count(g0).first()[0] == 6 and A.edge_list(g0).count() == 8
    weighted = PropertyGraph(g0.vertices, g0.edges.withColumn("w", F.col("edge_id") - 9))
    assert {r.id: r.distance for r in A.shortest_paths(weighted, 1, "w").collect()} == {1: 0, 2: 1, 3: 3, 4: 9, 5: 17}


def test_components_of_a_long_chain(spark):
    n = 200
    e = spark.createDataFrame([(i * 7 % n, (i + 1) * 7 % n, i) for i in range(n - 1)], "src bigint, dst bigint, edge_id bigint")
    g = PropertyGraph(spark.range(n + 2), e)
    got = {r.id: r.component for r in A.connected_components(g).collect()}
    assert all(got[i] == 0 for i in range(n)) and got[n] == n


def test_triangles_by_hand(spark):
    g = random_graph(spark, 25, 120, 9)
    pairs = {tuple(sorted(r)) for r in g.edges.select("src", "dst").collect() if r.src != r.dst}
    want = sorted(t for t in itertools.combinations(range(25), 3) if all(p in pairs for p in itertools.combinations(t, 2)))
    assert sorted(map(tuple, A.triangles(g).collect())) == want


def test_pregel_and_centres(g0):
    least = A.pregel(g0, F.col("id"), F.col("state"), F.min, F.least("state", "message"))
    assert rows(least) == [(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (6, 6)]
    near = {r.id: (r.centre, r.distance) for r in A.k_centres(g0, 1, 1).collect()}
    assert near == {1: (1, 0), 2: (1, 1), 3: (1, 1), 4: (1, 2), 5: (1, 3)}
    assert A.k_centres(g0, 2, 5).where("distance = 0").count() == 2


def test_subgraphs_of_any_ids(spark):
    """Ids that leave no room for the partition take another key; the groups are those of plain union-find."""
    rng = random.Random(5)
    base = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    for shift in (0, -30, (1 << 62) - 40):
        ids = [i + shift for i in range(60)]
        pairs = [(a + shift, b + shift) for a, b in base]
        g = PropertyGraph(spark.createDataFrame([(i,) for i in ids], "id bigint"), spark.createDataFrame([(a, b, n) for n, (a, b) in enumerate(pairs)], "src bigint, dst bigint, edge_id bigint"))
        root = {(p, i): (p, i) for p in range(3) for i in ids}

        def find(x):
            while root[x] != x:  # noqa: B023
                x = root[x]  # noqa: B023
            return x

        for a, b in pairs:
            x, y = find((a % 3, a)), find((a % 3, b))
            root[max(x, y)] = min(x, y)
        want = {}
        for p in range(3):
            least = {}
            for i in ids:
                if i % 3 == p:
                    least.setdefault(find((p, i)), i)
            for n, k in enumerate(sorted(least, key=least.get)):
                want |= {i: (p, n | p << 32) for i in ids if i % 3 == p and find((p, i)) == k}
        got = {r.id: (r.partition_id, r.subgraph_id) for r in T.vertex_subgraphs(g, 3).collect()}
        assert got == want


def plain_centres(ids, edges, k, rounds, patience=2):
    """k-centres by plain loops: nearest centre (least on ties), then the member with most neighbours in its cluster."""
    near = {i: set() for i in ids}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    centres = sorted(ids)[:k]
    for _ in range(rounds):
        at = {c: (c, 0) for c in centres}
        front = set(centres)
        while front:
            reached = {}
            for v in front:
                for w in near[v]:
                    if w not in at:
                        reached[w] = min(reached.get(w, at[v][0]), at[v][0])
            depth = {at[v][1] for v in front}.pop() + 1
            at |= {w: (c, depth) for w, c in reached.items()}
            front = set(reached)
        count = {v: sum(w in at and at[w][0] == at[v][0] for w in near[v] | ({v} if v in near[v] else set())) for v in at}
        moved = []
        for c in centres:
            members = [v for v in at if at[v][0] == c and count[v]]
            moved.append(min(members, key=lambda v: (-count[v], v)) if members else c)
        if sum(a != b for a, b in zip(centres, moved)) < patience:
            break
        centres = sorted(set(moved))
    return at


@pytest.mark.parametrize("k,rounds", [(1, 3), (2, 1), (3, 4), (5, 6)])
def test_k_centres_against_plain_loops(spark, k, rounds):
    rng = random.Random(k)
    ids = list(range(40))
    edges = [(rng.randrange(30), rng.randrange(36)) for _ in range(60)]
    g = PropertyGraph(spark.createDataFrame([(i,) for i in ids], "id bigint"), spark.createDataFrame([(a, b, n) for n, (a, b) in enumerate(edges)], "src bigint, dst bigint, edge_id bigint"))
    got = {r.id: (r.centre, r.distance) for r in A.k_centres(g, k, rounds).collect()}
    assert got == plain_centres(ids, edges, k, rounds)


def test_numbers_compare_by_value(spark):
    from decimal import Decimal

    rows = [(1, 12345678.0, 0.5, 7, Decimal("1.50"), "x"), (2, 0.0001, 2.25, -3, Decimal("2.00"), "7"), (3, None, None, None, None, None)]
    v = spark.createDataFrame(rows, "id bigint, d double, f float, i int, m decimal(10,2), t string")
    g = PropertyGraph(v, spark.createDataFrame([(1, 2, 10**13)], "src bigint, dst bigint, edge_id bigint"))
    found = lambda text: sorted(r.id for r in find_vertices(g, text).collect())
    assert found("d:double[12345678]") == found("d:float[1.2345678e7]") == found("d:int[12345678]") == [1]
    assert found("d:double[0.0001]") == [2] and found("f:float[0.5]") == [1] and found("f:double[2.25]") == [2]
    assert found("i:int[007]") == found("i:double[7.0]") == [1] and found("i:float[7.5]") == [] and found("i:int[99999999999999999999]") == []
    assert found("m:double[1.5]") == [1] and found("m:float[1.505]") == [] and found("m:int[2]") == [2]
    assert found("t:int[7]") == [2] and found("d:string[n]") == [3]
    stats = collect_stats(g, parse_path("d:double[12345678]@out?@i:int[-3]"))
    assert stats.vertex[("d", "12345678.0")].out == 1 and stats.vertex[("i", "-3")].into == 1


def test_wide_edge_ids(spark, tmp_path):
    """Keys beyond 64-bit ids are an error without wide ids, and whole with them."""
    from wayfare.sources import readers as R
    from wayfare.sources.projection import edge_id

    big = spark.createDataFrame([(6 * 10**11, 2 * 10**10)], "a bigint, b bigint")
    assert str(big.select(edge_id(5, F.col("a"), F.col("b"), True)).first()[0]) == f"5{6 * 10**11:018d}{2 * 10**10:018d}"
    with pytest.raises(Exception, match="wide"):
        big.select(edge_id(5, F.col("a"), F.col("b"))).collect()
    (tmp_path / "a").write_text("10000000000000 1 2\n9000000000000000000 1\nbroken line\n")
    (tmp_path / "b").write_text("10000000000000 1 2\n9000000000000000000 1\n")
    g = R.read_adjacency(spark, str(tmp_path / "b"))
    assert sorted(int(r.edge_id) for r in g.edges.collect()) == [10**25, 10**25 + 1, 9 * 10**30]
    assert [r.value for r in R.malformed(spark, str(tmp_path / "a"), "adjacency").collect()] == ["broken line"]


def test_checks_and_views(g0, spark):
    assert g0.check() == []
    broken = PropertyGraph(g0.vertices.union(g0.vertices.limit(1)), g0.edges.union(g0.edges.limit(1)))
    assert len(broken.check()) == 2
    assert g0.simple().edges.count() == 7
    with pytest.raises(ValueError):
        PropertyGraph(g0.edges, g0.edges)
    bag = PropertyGraph(spark.sql("select 1L id, map('a', 'x') props"), spark.sql("select 1L src, 1L dst, 5L edge_id, map('b', 'y') props"))
    assert find_vertices(bag, "a:string[x]").count() == 1
    flat = bag.promote(["a"], ["b"])
    assert flat.vertices.columns == ["id", "a"] and match(flat, "a:string[x]@out?b:string[y]").count() == 1


def test_calibration(g0):
    from wayfare.plans.calibrate import calibrate, probes

    p = probes(g0, 1)
    assert set(p) == {"idle", "scan", "expand", "shuffle", "join"} and all(x >= 0 for x in p.values())
    c = calibrate(g0, 1)
    q = parse_path("c:string[US]@out?@c:string[DE]")
    assert choose_start(q, collect_stats(g0, q), c) in (0, 1)


def test_a_cap_with_work_left_raises(spark, g0):
    from wayfare.operators import algorithms as A
    from wayfare.operators.components import star_components

    with pytest.raises(RuntimeError):
        A.shortest_paths(g0, 1, max_rounds=2)
    assert A.shortest_paths(g0, 1, max_rounds=10).count() == 5
    with pytest.raises(RuntimeError):
        A.pregel(g0, F.col("id"), F.col("state"), F.min, F.least("state", "message"), max_rounds=1)
    with pytest.raises(RuntimeError):
        star_components(g0.edges.select(F.col("src").alias("a"), F.col("dst").alias("b")), max_steps=1)
