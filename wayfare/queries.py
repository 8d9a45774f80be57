"""The graph queries by name, and the same in SQL.

Queries run over whole tables. Their SQL is written against the tables, not against
anything here, so that the two can be compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import algorithms as A
from .operators import stats as S
from .operators import topology as T
from .operators.bfs import bfs_leaf_paths, bfs_tree, bfs_walks, with_properties
from .operators.engine import run
from .operators.graph import PropertyGraph
from .operators.lookup import find_by_index, find_vertices, property_of, vertex_text
from .operators.paths import hop_counts, paths
from .operators.reach import shortest_walks
from .plans.cost import choose_start, collect_stats, histogram_stats
from .plans.query import parse_path, parse_reach
from .plans.tables import shared_dir, written
from .sources import readers as R
from .sources import writers as W
from .sources.projection import dialogue_graph, sales_graph, trade_graph
from .sources.statistics import load_statistics, store_statistics
from .sources.writers import adjacency_records, property_index, vertex_records

PARTITIONS = 4
FLAGSHIP = "mktsegment:string[BUILDING]@out?label:string[PLACED]@orderpriority:string[1-URGENT]@out?label:string[CONTAINS]@brand:string[Brand#1]"
ONE_HOP = "mktsegment:string[MACHINERY]@out?label:string[PLACED]@orderstatus:string[F]"
BACK = "brand:string[Brand#1]@in?label:string[CONTAINS]@orderpriority:string[1-URGENT]@in?label:string[PLACED]@mktsegment:string[BUILDING]"
#: Roots of walks: customers 0 to 4 are reached by name, so that a query has one of them.
ROOT = "vid:int[3000000000003]"

# --------------------------------------------------------------------------- SQL of the graph

V = """v AS (
  SELECT 1000000000000 + r_regionkey::BIGINT AS id, 'region' AS kind, r_name AS name, NULL::VARCHAR AS mktsegment, NULL::VARCHAR AS orderpriority, NULL::VARCHAR AS orderstatus, NULL::VARCHAR AS brand, NULL::VARCHAR AS type FROM region
  UNION ALL SELECT 2000000000000 + n_nationkey, 'nation', n_name, NULL, NULL, NULL, NULL, NULL FROM nation
  UNION ALL SELECT 3000000000000 + c_custkey, 'customer', c_name, c_mktsegment, NULL, NULL, NULL, NULL FROM customer
  UNION ALL SELECT 4000000000000 + s_suppkey, 'supplier', s_name, NULL, NULL, NULL, NULL, NULL FROM supplier
  UNION ALL SELECT 5000000000000 + p_partkey, 'part', p_name, NULL, NULL, NULL, p_brand, p_type FROM part
  UNION ALL SELECT 6000000000000 + o_orderkey, 'order', NULL, NULL, o_orderpriority, o_orderstatus, NULL, NULL FROM orders)"""
E = """e AS (
  SELECT 2000000000000 + n_nationkey::BIGINT AS src, 1000000000000 + n_regionkey::BIGINT AS dst, 1000000000000000000 + n_nationkey::BIGINT * 100000000 + n_regionkey AS edge_id, 'IN_REGION' AS label, NULL::VARCHAR AS returnflag FROM nation
  UNION ALL SELECT 3000000000000 + c_custkey, 2000000000000 + c_nationkey, 2000000000000000000 + c_custkey * 100000000 + c_nationkey, 'FROM', NULL FROM customer
  UNION ALL SELECT 4000000000000 + s_suppkey, 2000000000000 + s_nationkey, 3000000000000000000 + s_suppkey * 100000000 + s_nationkey, 'FROM', NULL FROM supplier
  UNION ALL SELECT 3000000000000 + o_custkey, 6000000000000 + o_orderkey, 4000000000000000000 + o_custkey * 100000000 + o_orderkey, 'PLACED', NULL FROM orders
  UNION ALL SELECT 6000000000000 + l_orderkey, 5000000000000 + l_partkey, 5000000000000000000 + l_orderkey * 100000000 + l_partkey, 'CONTAINS', min(l_returnflag) FROM lineitem GROUP BY l_orderkey, l_partkey
  UNION ALL SELECT DISTINCT 4000000000000 + l_suppkey, 5000000000000 + l_partkey, 6000000000000000000 + l_suppkey * 100000000 + l_partkey, 'SUPPLIES', NULL FROM lineitem)"""
SHIPS = """s AS MATERIALIZED (SELECT src, dst, edge_id, label FROM e UNION ALL SELECT DISTINCT 6000000000000 + l_orderkey, 4000000000000 + l_suppkey, 7000000000000000000 + l_orderkey * 100000000 + l_suppkey, 'SHIPS_FROM' FROM lineitem)"""
TURNS = """cv AS (SELECT conv_id::BIGINT * 1000000 + turn::BIGINT AS id, min(role) AS role FROM conversations GROUP BY 1),
  ce AS (SELECT a.id AS src, b.id AS dst, a.id AS edge_id FROM cv a JOIN cv b ON b.id = a.id + 1 AND a.id // 1000000 = b.id // 1000000)"""
G = f"WITH RECURSIVE {V}, {E}"
#: Rounds of joins in which labels settle on the trade graph, whose components are wide and not deep.
ROUNDS = 10


def _bfs_sql(root: str, depth: int, edges: str = "e", vertices: str = "v") -> str:
    return f""", roots AS (SELECT id FROM {vertices} WHERE {root}),
  w(root, v, d) AS (SELECT id, id, 0 FROM roots UNION SELECT root, {edges}.dst, d + 1 FROM w JOIN {edges} ON w.v = {edges}.src WHERE d < {depth}),
  m AS (SELECT root, v, min(d) AS d FROM w GROUP BY 1, 2),
  t AS (SELECT m.root, {edges}.src, edge_id, {edges}.dst, m.d AS depth, row_number() OVER (PARTITION BY m.root, m.v ORDER BY {edges}.src, edge_id) AS rn
        FROM m JOIN {edges} ON {edges}.dst = m.v JOIN m p ON p.root = m.root AND p.v = {edges}.src AND p.d = m.d - 1 WHERE m.d > 0)"""


def _reach_sql(source: str, sink: str, depth: int, edges: str = "e") -> str:
    return f""", w(s, v, d, path) AS (SELECT id, id, 0, 'V:' || id FROM v WHERE {source}
    UNION ALL SELECT s, {edges}.dst, d + 1, path || '-->E:' || edge_id || '-->V:' || {edges}.dst FROM w JOIN {edges} ON {edges}.src = w.v WHERE d < {depth}),
  h AS (SELECT w.* FROM w JOIN v ON v.id = w.v WHERE d > 0 AND {sink})
  SELECT s AS source, v AS sink, d::INTEGER AS length, path FROM h WHERE d = (SELECT min(d) FROM h)"""


#: The flagship pattern over the tables themselves, each filtered first: (a) placed (b) contains (c).
FLAGSHIP_TABLES = """WITH a AS MATERIALIZED (SELECT c_custkey AS a FROM customer WHERE c_mktsegment = 'BUILDING'),
  b AS MATERIALIZED (SELECT o_orderkey AS b, o_custkey AS a FROM orders WHERE o_orderpriority = '1-URGENT'), c AS MATERIALIZED (SELECT p_partkey AS c FROM part WHERE p_brand = 'Brand#1'),
  x AS MATERIALIZED (SELECT a, b FROM b SEMI JOIN a USING (a)), y AS MATERIALIZED (SELECT DISTINCT l_orderkey AS b, l_partkey AS c FROM lineitem SEMI JOIN c ON l_partkey = c),
  m AS MATERIALIZED (SELECT 3000000000000 + a AS a, 6000000000000 + b AS b, 5000000000000 + c AS c, 4000000000000000000 + a * 100000000 + b AS x, 5000000000000000000 + b * 100000000 + c AS y FROM x JOIN y USING (b))"""
PATH3 = f"""{FLAGSHIP_TABLES} SELECT a AS start_vertex, c AS end_vertex, 'V:' || a || '-->E:' || x || '-->V:' || b || '-->E:' || y || '-->V:' || c AS path FROM m"""


def _least_labels(name: str, nodes: str, links: str, rounds: int = ROUNDS) -> str:
    """CTEs ``name``0 to ``name``<rounds> of (part, id, l): the least label that reaches a node along links (part, a, b), spread by one link in each round."""
    steps = [f"{name}0 AS MATERIALIZED ({nodes})"]
    for i in range(1, rounds + 1):
        steps.append(f"{name}{i} AS MATERIALIZED (SELECT part, id, min(l) AS l FROM (SELECT * FROM {name}{i - 1} UNION ALL SELECT k.part, k.b, n.l FROM {name}{i - 1} n JOIN {links} k ON k.part = n.part AND k.a = n.id) GROUP BY 1, 2)")
    return ", ".join(steps)


#: The trade graph by partition and subgraph: components of local vertices and proxies of remote sinks.
SUBGRAPHS = f"""{SHIPS}, u AS MATERIALIZED (SELECT src % {PARTITIONS} AS part, src AS a, dst AS b FROM s UNION SELECT src % {PARTITIONS}, dst, src FROM s),
  {_least_labels("near", f"SELECT id % {PARTITIONS} AS part, id, id AS l FROM v UNION SELECT part, b, b FROM u", "u")},
  label AS (SELECT part, id, l AS root FROM near{ROUNDS} WHERE id % {PARTITIONS} = part), least AS (SELECT part, root, min(id) AS least FROM label GROUP BY 1, 2),
  sg AS MATERIALIZED (SELECT id, part::INTEGER AS partition_id, (dense_rank() OVER (PARTITION BY part ORDER BY least) - 1) | (part::BIGINT << 32) AS subgraph_id FROM label JOIN least USING (part, root))"""
STATS = """d AS (SELECT id, coalesce(o, 0) AS o, coalesce(i, 0) AS i, coalesce(ro, 0) AS ro, coalesce(ri, 0) AS ri FROM v
    LEFT JOIN (SELECT src, count(*) AS o, sum((src % 4 <> dst % 4)::INT) AS ro FROM e GROUP BY 1) ON src = id
    LEFT JOIN (SELECT dst, count(*) AS i, sum((src % 4 <> dst % 4)::INT) AS ri FROM e GROUP BY 1) ON dst = id)"""


def _rank_sql(k: int) -> str:
    rounds = "".join(
        f""", r{i} AS MATERIALIZED (SELECT v.id, 0.15 / (SELECT count(*) FROM v) + 0.85 * coalesce(sum(p.r / o.n), 0) AS r
        FROM v LEFT JOIN s ON s.dst = v.id LEFT JOIN r{i - 1} p ON p.id = s.src LEFT JOIN o ON o.id = s.src GROUP BY v.id)"""
        for i in range(1, k + 1)
    )
    return f"""{G}, {SHIPS}, o AS (SELECT src AS id, count(*) AS n FROM s GROUP BY 1), r0 AS (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM v) AS r FROM v){rounds}
      SELECT id, round(r, 9) AS rank FROM r{k}"""


# --------------------------------------------------------------------------- queries

_REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def _query(name: str, sql: str):
    def add(f):
        _REGISTRY[name] = (f, sql)
        return f

    return add


def _simple(name: str, sql: str, make: Callable[[PropertyGraph], DataFrame], graph=trade_graph) -> None:
    _REGISTRY[name] = (lambda spark, sf, graph=graph: make(graph(spark, sf)), sql)


def ships_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    return trade_graph(spark, sf_dir, ships=True)


_simple("vertex_lookup", f"{G} SELECT 'V:' || id AS vertex FROM v WHERE mktsegment = 'BUILDING'", lambda g: vertex_text(find_vertices(g, "mktsegment:string[BUILDING]")))
_simple("vertex_lookup_missing", f"{G} SELECT 'V:' || id AS vertex FROM v WHERE coalesce(mktsegment, 'n') = 'n'", lambda g: vertex_text(find_vertices(g, "mktsegment:string[n]")))
_simple("vertex_lookup_top", f"{G} SELECT id FROM v WHERE kind = 'order' ORDER BY id LIMIT 4000", lambda g: find_vertices(g, "kind:string[order]", max_roots=4000))
_simple("vertex_properties", f"{G} SELECT id, name, brand FROM v WHERE kind = 'part'", lambda g: property_of(g, "kind:string[part]", "name", "brand"))
_simple(
    "path_1hop_out",
    f"""{G} SELECT a.id AS start_vertex, b.id AS end_vertex, 'V:' || a.id || '-->E:' || x.edge_id || '-->V:' || b.id AS path
    FROM v a JOIN e x ON x.src = a.id AND x.label = 'PLACED' JOIN v b ON b.id = x.dst AND b.orderstatus = 'F' WHERE a.mktsegment = 'MACHINERY'""",
    lambda g: paths(g, ONE_HOP),
)
_simple(
    "path_1hop_in",
    f"""{G} SELECT a.id AS start_vertex, b.id AS end_vertex, 'V:' || a.id || '<--E:' || x.edge_id || '<--V:' || b.id AS path
    FROM v a JOIN e x ON x.dst = a.id AND x.label = 'CONTAINS' JOIN v b ON b.id = x.src AND b.orderpriority = '2-HIGH' WHERE a.brand = 'Brand#2'""",
    lambda g: paths(g, "brand:string[Brand#2]@in?label:string[CONTAINS]@orderpriority:string[2-HIGH]"),
)
_simple("path_2hop_typed", PATH3, lambda g: paths(g, FLAGSHIP))
_simple(
    "path_wildcard_edge",
    f"""{G} SELECT a.id AS start_vertex, b.id AS end_vertex, 'V:' || a.id || '-->E:' || x.edge_id || '-->V:' || b.id AS path
    FROM v a JOIN e x ON x.src = a.id JOIN v b ON b.id = x.dst AND b.kind = 'part' WHERE a.kind = 'supplier'""",
    lambda g: paths(g, "kind:string[supplier]@out?@kind:string[part]"),
)
_simple(
    "path_implicit_vertex",
    f"""{G} SELECT a.id AS start_vertex, c.id AS end_vertex, 'V:' || a.id || '-->E:' || x.edge_id || '-->V:' || x.dst || '-->E:' || y.edge_id || '-->V:' || c.id AS path
    FROM v a JOIN e x ON x.src = a.id AND x.label = 'FROM' JOIN e y ON y.src = x.dst AND y.label = 'IN_REGION' JOIN v c ON c.id = y.dst AND c.kind = 'region' WHERE a.kind = 'supplier'""",
    lambda g: paths(g, "kind:string[supplier]@out?label:string[FROM]@out?label:string[IN_REGION]@kind:string[region]"),
)
_simple(
    "path_leading_edge",
    f"{G} SELECT src AS start_vertex, b.id AS end_vertex, 'V:' || src || '-->E:' || edge_id || '-->V:' || b.id AS path FROM e JOIN v b ON b.id = e.dst AND b.kind = 'nation' WHERE label = 'FROM'",
    lambda g: paths(g, "out?label:string[FROM]@kind:string[nation]"),
)
_simple(
    "path_edge_pred",
    f"""{G} SELECT a.id AS start_vertex, b.id AS end_vertex, 'V:' || a.id || '-->E:' || x.edge_id || '-->V:' || b.id AS path
    FROM v a JOIN e x ON x.src = a.id AND x.returnflag = 'R' JOIN v b ON b.id = x.dst AND b.brand = 'Brand#3' WHERE a.orderpriority = '5-LOW'""",
    lambda g: paths(g, "orderpriority:string[5-LOW]@out?returnflag:string[R]@brand:string[Brand#3]"),
)
_simple("path_fixed_start_mid", PATH3, lambda g: paths(g, FLAGSHIP + "//2"))
_simple("path_fixed_start_last", PATH3, lambda g: paths(g, FLAGSHIP + "//4"))
_simple("path_cost_based", PATH3, lambda g: run("path", g, FLAGSHIP))
_simple(
    "path_in_in",
    f"""{FLAGSHIP_TABLES} SELECT c AS start_vertex, a AS end_vertex, 'V:' || c || '<--E:' || y || '<--V:' || b || '<--E:' || x || '<--V:' || a AS path FROM m""",
    lambda g: run("path", g, BACK),
)


@_query("path_hist_based", PATH3)
def _path_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = trade_graph(spark, sf_dir)
    query = parse_path(FLAGSHIP)
    vertex = S.equi_depth_histogram(written(S.vertex_statistics(g, ["mktsegment", "orderpriority", "brand"]), "vertex-stats"), S.VERTEX_BINS)
    edge = S.equi_depth_histogram(written(S.edge_statistics(g, ["label"]), "edge-stats"), S.EDGE_BINS)
    t = S.graph_totals(g).first()
    stats = histogram_stats((t.vertices, t.edges, t.remote_edges), written(vertex, "vertex-bins"), written(edge, "edge-bins"), query)
    return paths(g, query, choose_start(query, stats))


_simple(
    "path_undirected",
    f"""{G}, ue AS (SELECT src, dst, edge_id FROM e WHERE label = 'FROM' UNION ALL SELECT dst, src, edge_id FROM e WHERE label = 'FROM')
    SELECT a.id AS start_vertex, c.id AS end_vertex, 'V:' || a.id || '-->E:' || x.edge_id || '-->V:' || b.id || '-->E:' || y.edge_id || '-->V:' || c.id AS path
    FROM v a JOIN ue x ON x.src = a.id JOIN v b ON b.id = x.dst AND b.kind = 'nation' JOIN ue y ON y.src = b.id JOIN v c ON c.id = y.dst AND c.kind = 'supplier' WHERE a.mktsegment = 'BUILDING'""",
    lambda g: paths(PropertyGraph(g.vertices, g.edges.where("label = 'FROM'")).symmetrize(), "mktsegment:string[BUILDING]@out?@kind:string[nation]@out?@kind:string[supplier]", undirected=True),
)
_simple(
    "path_hop_counts",
    f"""{G}, s0 AS (SELECT id FROM v WHERE mktsegment = 'BUILDING'), s1 AS (SELECT b.id FROM s0 JOIN e ON src = s0.id AND label = 'PLACED' JOIN v b ON b.id = dst AND b.orderpriority = '1-URGENT'),
    s2 AS (SELECT b.id FROM s1 JOIN e ON src = s1.id AND label = 'CONTAINS' JOIN v b ON b.id = dst AND b.brand = 'Brand#1')
    SELECT 0::BIGINT AS step, count(*) AS walks FROM s0 UNION ALL SELECT 1, count(*) FROM s1 UNION ALL SELECT 2, count(*) FROM s2""",
    lambda g: hop_counts(g, FLAGSHIP, 0),
)
_simple("bfs_tree", f"{G}{_bfs_sql("mktsegment = 'BUILDING'", 2)} SELECT root, src, edge_id, dst, depth::INTEGER AS depth FROM t WHERE rn = 1", lambda g: bfs_tree(g, "mktsegment:string[BUILDING]:2//0//163"))
_simple("bfs_by_vid", f"{G}{_bfs_sql('id = 3000000000003', 3)} SELECT root, src, edge_id, dst, depth::INTEGER AS depth FROM t WHERE rn = 1", lambda g: bfs_tree(g, ROOT + ":3"))
_simple(
    "bfs_revisit",
    f"""{G}, w(root, src, edge_id, v, d) AS (SELECT id, NULL::BIGINT, NULL::BIGINT, id, 0 FROM v WHERE kind = 'supplier'
    UNION ALL SELECT root, w.v, e.edge_id, e.dst, d + 1 FROM w JOIN e ON e.src = w.v WHERE d < 2) SELECT root, src, edge_id, v AS dst, d::INTEGER AS depth FROM w WHERE d > 0""",
    lambda g: bfs_walks(g, "kind:string[supplier]:2"),
)
_LEAF = """w(root, v, d, path) AS (SELECT id, id, 0, 'V:' || id FROM v WHERE mktsegment = 'FURNITURE'
    UNION ALL SELECT root, e.dst, d + 1, path || '-->E:' || e.edge_id || '-->V:' || e.dst FROM w JOIN e ON e.src = w.v WHERE d < 2)
    SELECT root, path FROM w WHERE d = 2 OR NOT EXISTS (SELECT 1 FROM e WHERE e.src = w.v)"""
_simple("bfs_leaf_paths", f"{G}, {_LEAF}", lambda g: bfs_leaf_paths(g, "mktsegment:string[FURNITURE]:2"))
_simple(
    "bfs_leaf_paths_pruned",
    f"""{G}{_bfs_sql('id = 3000000000003', 3)}, tr AS (SELECT * FROM t WHERE rn = 1),
    p(root, v, d, path) AS (SELECT id, id, 0, 'V:' || id FROM roots UNION ALL SELECT p.root, tr.dst, p.d + 1, path || '-->E:' || tr.edge_id || '-->V:' || tr.dst FROM p JOIN tr ON tr.root = p.root AND tr.src = p.v AND tr.depth = p.d + 1)
    SELECT root, path FROM p WHERE d = 3 OR NOT EXISTS (SELECT 1 FROM e WHERE e.src = p.v)""",
    lambda g: bfs_leaf_paths(g, ROOT + ":3", pruned=True),
)
_simple(
    "bfs_props",
    f"{G}{_bfs_sql("name = 'Customer#000000004'", 2)} SELECT root, src, edge_id, dst, depth::INTEGER AS depth, v.kind, v.name FROM t JOIN v ON v.id = t.dst WHERE rn = 1",
    lambda g: with_properties(g, bfs_tree(g, "name:string[Customer#000000004]:2"), "dst", "kind", "name"),
)
_simple("reach_fwd", f"{G}{_reach_sql("name = 'Customer#000000003'", "brand = 'Brand#4'", 3)}", lambda g: shortest_walks(g, "3@name:string[Customer#000000003]@brand:string[Brand#4]//0"))
_simple("reach_rev", f"{G}{_reach_sql("name = 'Customer#000000003'", "brand = 'Brand#4'", 3)}", lambda g: shortest_walks(g, "3@name:string[Customer#000000003]@brand:string[Brand#4]//1"))
_simple("reach_auto", f"{G}{_reach_sql("name = 'Customer#000000005'", "kind = 'region'", 4)}", lambda g: run("reach", g, "4@name:string[Customer#000000005]@kind:string[region]"))
_simple("reach_none", f"{G}{_reach_sql("name = 'Customer#000000003'", "kind = 'supplier'", 2)}", lambda g: shortest_walks(g, "2@name:string[Customer#000000003]@kind:string[supplier]"))
_simple(
    "vertex_pred_stats",
    f"""{G}, {STATS}, x AS (SELECT id, 'mktsegment' AS property, coalesce(mktsegment, 'n') AS value FROM v UNION ALL SELECT id, 'orderpriority', coalesce(orderpriority, 'n') FROM v)
    SELECT property, value, count(*) AS n, round(count(*) / (SELECT count(*) FROM v), 9) AS probability, round(sum(o) / count(*), 6) AS avg_out, round(sum(i) / count(*), 6) AS avg_in,
    round(sum(ro) / count(*), 6) AS avg_remote_out, round(sum(ri) / count(*), 6) AS avg_remote_in FROM x JOIN d USING (id) GROUP BY 1, 2""",
    lambda g: S.vertex_statistics(g, ["mktsegment", "orderpriority"], PARTITIONS).select("property", "value", "n", F.round("probability", 9).alias("probability"), *(F.round(c, 6).alias(c) for c in ("avg_out", "avg_in", "avg_remote_out", "avg_remote_in"))),
)
_simple(
    "edge_pred_stats",
    f"""{G}, x AS (SELECT 'label' AS property, label AS value FROM e UNION ALL SELECT 'returnflag', coalesce(returnflag, 'n') FROM e)
    SELECT property, value, count(*) AS n, round(count(*) / (SELECT count(*) FROM e), 9) AS probability FROM x GROUP BY 1, 2""",
    lambda g: S.edge_statistics(g, ["label", "returnflag"]).withColumn("probability", F.round("probability", 9)),
)
_simple(
    "graph_totals",
    f"""{G} SELECT (SELECT count(*) FROM v) AS vertices, (SELECT count(*) FROM e) AS edges, (SELECT count(*) FROM e WHERE src % 4 <> dst % 4) AS remote_edges,
    (SELECT count(*) FROM (SELECT DISTINCT src % 4, dst FROM e WHERE src % 4 <> dst % 4)) AS remote_vertices""",
    lambda g: S.graph_totals(g, PARTITIONS),
)
_simple(
    "equi_depth_hist",
    f"""{G}, f AS (SELECT 'name' AS property, coalesce(name, 'n') AS value, count(*) AS n FROM v GROUP BY 2 UNION ALL SELECT 'type', coalesce(type, 'n'), count(*) FROM v GROUP BY 2),
    c AS (SELECT *, (sum(n) OVER (PARTITION BY property ORDER BY value) - n)::BIGINT AS before, (sum(n) OVER (PARTITION BY property))::BIGINT AS total FROM f)
    SELECT property, (before * 100 // total)::INTEGER AS bin, min(value) AS first, max(value) AS last, count(*) AS keys, sum(n)::BIGINT AS frequency, round(sum(n) / count(*) / any_value(total), 9) AS probability FROM c GROUP BY 1, 2""",
    lambda g: S.equi_depth_histogram(S.vertex_statistics(g, ["name", "type"]).select("property", "value", "n"), 100).withColumn("probability", F.round("probability", 9)),
)
_simple(
    "degree_distribution",
    f"{G}, c AS (SELECT v.id, count(e.src) AS out_degree FROM v LEFT JOIN e ON e.src = v.id WHERE mktsegment = 'BUILDING' GROUP BY 1) SELECT out_degree, count(*) AS vertices FROM c GROUP BY 1",
    lambda g: S.degree_distribution(g, find_predicate("mktsegment:string[BUILDING]")),
)
_simple("edge_counts", f"{G} SELECT count(*) AS out_edges, count(DISTINCT dst) AS vertices_with_in_edges FROM e", S.edge_counts)
_simple("in_edges", f"{G} SELECT dst, src, min(edge_id) AS edge_id FROM e GROUP BY 1, 2", S.in_edges)


def find_predicate(text: str):
    from .plans.query import parse_predicate

    return parse_predicate(text)


def _subgraphs(g: PropertyGraph) -> DataFrame:
    return written(T.vertex_subgraphs(g, PARTITIONS), "subgraphs")


_simple("vertex_subgraph_map", f"{G}, {SUBGRAPHS} SELECT id, partition_id, subgraph_id FROM sg", lambda g: T.vertex_subgraphs(g, PARTITIONS), ships_graph)
_simple(
    "metagraph",
    f"""{G}, {SUBGRAPHS}, j AS MATERIALIZED (SELECT subgraph_id AS sa, dst FROM s JOIN sg ON id = src), k AS MATERIALIZED (SELECT sa, subgraph_id AS sb, dst FROM j JOIN sg ON id = dst), x AS (SELECT DISTINCT sa, sb, dst FROM k WHERE sa <> sb),
    l AS (SELECT subgraph_id, count(*) AS n FROM sg GROUP BY 1), r AS (SELECT sa, sb, count(*) AS m FROM x GROUP BY 1, 2)
    SELECT subgraph_id AS src_subgraph, sb AS dst_subgraph, n AS local_vertices, m AS remote_vertices FROM l JOIN r ON sa = subgraph_id""",
    lambda g: T.metagraph(g, _subgraphs(g)),
    ships_graph,
)
_simple(
    "remote_edges",
    f"""{G}, {SUBGRAPHS} SELECT src, dst, edge_id, a.subgraph_id AS src_subgraph, b.subgraph_id AS dst_subgraph, a.partition_id <> b.partition_id AS remote FROM s JOIN sg a ON a.id = src JOIN sg b ON b.id = dst""",
    lambda g: T.remote_edges(g, _subgraphs(g)),
    ships_graph,
)
_simple(
    "remote_degree",
    f"""{G}, {SHIPS}, x AS (SELECT src AS id, 1 AS o, 0 AS i, (src % {PARTITIONS} <> dst % {PARTITIONS})::INTEGER AS r FROM s UNION ALL SELECT dst, 0, 1, (src % {PARTITIONS} <> dst % {PARTITIONS})::INTEGER FROM s UNION ALL SELECT id, 0, 0, 0 FROM v)
    SELECT id, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree, sum(o * r)::BIGINT AS remote_out, sum(i * r)::BIGINT AS remote_in FROM x GROUP BY 1""",
    lambda g: S.degrees(g, PARTITIONS),
    ships_graph,
)
_simple(
    "bfs_subgraph",
    f"""{G}, {SUBGRAPHS}, se AS MATERIALIZED (SELECT src, dst, edge_id FROM s JOIN sg a ON a.id = src JOIN sg b ON b.id = dst WHERE a.subgraph_id = b.subgraph_id)
    {_bfs_sql("kind = 'customer'", 2, 'se', 'v')} SELECT root, src, edge_id, dst, depth::INTEGER AS depth FROM t WHERE rn = 1""",
    lambda g: bfs_tree(T.within_subgraphs(g, _subgraphs(g)), "kind:string[customer]:2"),
    ships_graph,
)
_simple(
    "vertex_export",
    f"{G}, {SUBGRAPHS} SELECT subgraph_id || '#' || id || '@' || kind || '$' || coalesce(name, 'n') || '|' AS value FROM sg JOIN v USING (id)",
    lambda g: vertex_records(PropertyGraph(g.vertices.join(_subgraphs(g), "id"), g.edges), ["kind", "name"]),
    ships_graph,
)
_simple(
    "adjacency_export",
    f"""{G}, {SUBGRAPHS}, x AS (SELECT a.id, a.subgraph_id, dst, coalesce(a.subgraph_id <> b.subgraph_id, false) AS away FROM sg a LEFT JOIN s ON src = a.id LEFT JOIN sg b ON b.id = dst)
    SELECT subgraph_id || '#' || id || '@' || count(dst) FILTER (NOT away) || '%' || coalesce(string_agg(dst::VARCHAR, ':' ORDER BY away, dst), '') || '|' AS value FROM x GROUP BY id, subgraph_id""",
    lambda g: adjacency_records(g, _subgraphs(g).select("id", "subgraph_id")),
    ships_graph,
)
_simple(
    "property_index",
    f"{G} SELECT 'kind' AS property, kind AS value, id FROM v UNION ALL SELECT 'brand', coalesce(brand, 'n'), id FROM v",
    lambda g: property_index(g, ["kind", "brand"]),
)
_simple(
    "connected_components",
    f"""{G}, {SHIPS}, u AS MATERIALIZED (SELECT 0 AS part, src AS a, dst AS b FROM s UNION SELECT 0, dst, src FROM s),
    {_least_labels("near", "SELECT 0 AS part, id, id AS l FROM v", "u")} SELECT id, l AS component FROM near{ROUNDS}""",
    A.connected_components,
    ships_graph,
)
_simple(
    "connected_components_chains",
    f"""{G}, {TURNS}, u AS (SELECT src AS a, dst AS b FROM ce UNION SELECT dst, src FROM ce),
    w(id, l) AS (SELECT id, id FROM cv UNION SELECT u.b, w.l FROM w JOIN u ON u.a = w.id) SELECT id, min(l) AS component FROM w GROUP BY 1""",
    A.connected_components,
    dialogue_graph,
)
_simple("pagerank", _rank_sql(5), lambda g: A.pagerank(g, 5).withColumn("rank", F.round("rank", 9)), ships_graph)
_simple(
    "sssp",
    f"{G}, w(v, d) AS (SELECT 3000000000003::BIGINT, 0::BIGINT UNION SELECT e.dst, d + 1 FROM w JOIN e ON e.src = w.v WHERE d < 20) SELECT v AS id, min(d) AS distance FROM w GROUP BY 1",
    lambda g: A.shortest_paths(g, 3_000_000_000_003),
)
_simple(
    "triangle_count",
    f"""{G}, {SHIPS}, u AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM s WHERE src <> dst)
    SELECT count(*) AS triangles FROM u x JOIN u y ON x.b = y.a JOIN u z ON z.a = x.a AND z.b = y.b""",
    A.triangle_count,
    ships_graph,
)
_simple("vertex_count", f"{G} SELECT count(*) AS vertices FROM v", A.vertex_count)
_simple("edge_list", f"{G} SELECT src, dst, edge_id FROM e", A.edge_list)
_simple(
    "graph_stats",
    f"""{G}, {STATS} SELECT count(*) AS vertices, sum(o)::BIGINT AS edges, max(o)::BIGINT AS max_out, max(i)::BIGINT AS max_in, count(*) FILTER (o + i = 0) AS isolated, count(*) FILTER (o = 0) AS sinks FROM d""",
    S.graph_stats,
)


@_query(
    "batch",
    f"""{G} SELECT 0::BIGINT AS query, a.id AS start_vertex, b.id AS end_vertex FROM v a JOIN e x ON x.src = a.id AND x.label = 'PLACED' JOIN v b ON b.id = x.dst AND b.orderstatus = 'F' WHERE a.mktsegment = 'MACHINERY'
    UNION ALL SELECT 1, a.id, b.id FROM v a JOIN e x ON x.src = a.id AND x.label = 'IN_REGION' JOIN v b ON b.id = x.dst WHERE a.kind = 'nation'""",
)
def _batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators.engine import run_batch

    g = trade_graph(spark, sf_dir)
    found = run_batch("path", g, f"{ONE_HOP};kind:string[nation]@out?label:string[IN_REGION]")
    rows = [f.select(F.lit(i).cast("bigint").alias("query"), "start_vertex", "end_vertex") for i, f in enumerate(found)]
    return rows[0].unionByName(rows[1])


@_query(
    "plan_stats",
    f"""{G}, {STATS}, x AS (SELECT 'mktsegment' AS property, mktsegment AS value, id FROM v WHERE mktsegment = 'BUILDING' UNION ALL SELECT 'orderpriority', orderpriority, id FROM v WHERE orderpriority = '1-URGENT' UNION ALL SELECT 'brand', brand, id FROM v WHERE brand = 'Brand#1')
    SELECT property, value, round(count(*) / (SELECT count(*) FROM v), 9) AS probability, round(sum(o) / count(*), 6) AS avg_out FROM x JOIN d USING (id) GROUP BY 1, 2""",
)
def _plan_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the planner asks the graph about the flagship pattern."""
    found = collect_stats(trade_graph(spark, sf_dir), parse_path(FLAGSHIP))
    rows = [(p, v, round(n.probability, 9), round(n.out, 6)) for (p, v), n in found.vertex.items()]
    return spark.createDataFrame(rows, "property string, value string, probability double, avg_out double")


# --------------------------------------------------------------------------- formats: written as text, read back


def _text(lines: DataFrame, name: str) -> str:
    path = shared_dir(lines.sparkSession, name)
    W.write_lines(lines, path)
    return path


def _edge_lists(g: PropertyGraph, edge) -> DataFrame:
    """Vertices with their edges as a list of ``edge`` texts, by edge id."""
    lists = g.edges.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("edge_id", edge.alias("t")))).alias("l"))
    rows = g.vertices.join(lists, F.col("id") == F.col("src"), "left")
    return rows.withColumn("list", F.coalesce(F.transform("l", lambda x: x["t"]), F.expr("cast(array() as array<string>)")))


@_query("read_adjacency", f"{G}, {SHIPS} SELECT src, dst, count(*) AS n FROM s GROUP BY 1, 2")
def _read_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = R.read_adjacency(spark, _text(W.adjacency_lines(ships_graph(spark, sf_dir)), "adjacency"))
    return g.edges.groupBy("src", "dst").agg(F.count("*").alias("n"))


@_query("read_partitioned_adjacency", f"{G}, {SHIPS} SELECT id, (id % 4)::INTEGER AS partition_id, count(src) AS out_degree FROM v LEFT JOIN s ON src = id GROUP BY 1")
def _read_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _edge_lists(ships_graph(spark, sf_dir), F.col("dst").cast("string"))
    line = F.concat_ws(" ", F.concat(F.array(F.col("id").cast("string"), (F.col("id") % PARTITIONS).cast("string")), F.col("list")))
    g = R.read_adjacency(spark, _text(rows.select(line.alias("value")), "partitioned"), partitioned=True)
    out = g.edges.groupBy("src").agg(F.count("*").alias("out_degree"))
    return g.vertices.join(out, F.col("id") == F.col("src"), "left").select("id", "partition_id", F.coalesce("out_degree", F.lit(0)).cast("bigint").alias("out_degree"))


@_query("read_json", f"{G}, {SHIPS} SELECT src, dst, edge_id, label AS value FROM s")
def _read_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    edge = F.concat(F.lit("["), F.col("dst").cast("string"), F.lit(","), F.col("edge_id").cast("string"), F.lit(',"'), F.col("label"), F.lit('"]'))
    rows = _edge_lists(ships_graph(spark, sf_dir), edge)
    line = F.concat(F.lit("["), F.col("id").cast("string"), F.lit(",0,"), F.to_json(F.array("kind")), F.lit(",["), F.concat_ws(",", "list"), F.lit("]]"))
    return R.read_json(spark, _text(rows.select(line.alias("value")), "json")).edges


@_query("read_full_info", f"{G}, {SHIPS} SELECT src, dst, (dst % 4)::INTEGER AS dst_partition_id FROM s")
def _read_full_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    edge = F.concat_ws(" ", F.col("dst").cast("string"), F.lit("7"), (F.col("dst") % PARTITIONS).cast("string"))
    rows = _edge_lists(ships_graph(spark, sf_dir), edge)
    line = F.concat(F.concat_ws(" ", (F.col("id") % PARTITIONS).cast("string"), F.col("id").cast("string"), F.lit("7")), F.lit(" "), F.concat_ws(" ", "list"))
    return R.read_full_info(spark, _text(rows.select(line.alias("value")), "full-info")).edges.select("src", "dst", "dst_partition_id")


@_query("read_key_values", f"{G} SELECT id, kind, coalesce(name, 'n') AS name FROM v")
def _read_key_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    edge = F.concat(F.lit("["), F.col("dst").cast("string"), F.lit(","), F.col("edge_id").cast("string"), F.lit(',"label:string:'), F.col("label"), F.lit('"]'))
    rows = _edge_lists(ships_graph(spark, sf_dir), edge)
    line = F.concat(F.lit("["), F.col("id").cast("string"), F.lit(',"kind:string:'), F.col("kind"), F.lit("$name:string:"), F.coalesce("name", F.lit("n")), F.lit('",['), F.concat_ws(",", "list"), F.lit("]]"))
    return R.read_key_values(spark, _text(rows.select(line.alias("value")), "key-values"), ["kind", "name"]).vertices.select("id", "kind", "name")


@_query("read_key_values_edges", f"{G}, {SHIPS} SELECT src, dst, edge_id, label FROM s")
def _read_key_values_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edge = F.concat(F.lit("["), F.col("dst").cast("string"), F.lit(","), F.col("edge_id").cast("string"), F.lit(',"label:String:'), F.col("label"), F.lit('$:$rank:String:1"]'))
    rows = _edge_lists(ships_graph(spark, sf_dir), edge)
    line = F.concat(F.lit("["), F.col("id").cast("string"), F.lit(',"kind:String:'), F.col("kind"), F.lit('",['), F.concat_ws(",", "list"), F.lit("]]"))
    return R.read_key_values_tagged(spark, _text(rows.select(line.alias("value")), "key-values"), ["kind"], ["label"]).edges


@_query("read_delimited", f"{G}, {SHIPS} SELECT src, dst, a.kind AS src_kind, b.kind AS dst_kind FROM s JOIN v a ON a.id = src JOIN v b ON b.id = dst")
def _read_delimited(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ships_graph(spark, sf_dir)
    sg = _subgraphs(g).select("id", "subgraph_id")
    vertices = _text(vertex_records(PropertyGraph(g.vertices.join(sg, "id"), g.edges), ["kind", "name"]), "vertices")
    back = R.read_delimited(spark, vertices, _text(adjacency_records(g, sg), "adjacency"), ["kind", "name"])
    kind = lambda c: back.vertices.select(F.col("id").alias(c), F.col("kind").alias(f"{c}_kind"))
    return back.edges.select("src", "dst").join(kind("src"), "src").join(kind("dst"), "dst").select("src", "dst", "src_kind", "dst_kind")


@_query("read_tables", f"{G} SELECT label, count(*) AS edges FROM e GROUP BY 1")
def _read_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "graph")
    W.write_tables(trade_graph(spark, sf_dir), path)
    return R.read_tables(spark, path).edges.groupBy("label").agg(F.count("*").alias("edges"))


_simple(
    "pregel",
    f"""{G}, {SHIPS}, u AS MATERIALIZED (SELECT DISTINCT 0 AS part, src AS a, dst AS b FROM s), {_least_labels("near", "SELECT 0 AS part, id, id AS l FROM v", "u")} SELECT id, l AS state FROM near{ROUNDS}""",
    lambda g: A.pregel(g, F.col("id"), F.col("state"), F.min, F.least("state", "message"), max_rounds=1000),
    ships_graph,
)
_simple(
    "pregel_chains",
    f"{G}, {TURNS}, w(id, l) AS (SELECT id, id FROM cv UNION SELECT ce.dst, w.l FROM w JOIN ce ON ce.src = w.id) SELECT id, min(l) AS state FROM w GROUP BY 1",
    lambda g: A.pregel(g, F.col("id"), F.col("state"), F.min, F.least("state", "message"), max_rounds=1000),
    dialogue_graph,
)
_simple(
    "pregel_to_all",
    f"{G} SELECT id, (SELECT max(id) FROM v) - id AS state FROM v",
    lambda g: A.pregel(g, F.col("id"), F.col("state"), F.max, F.greatest("state", "message"), along="all", finish=F.col("state") - F.col("id")),
)
_simple(
    "pregel_to_subgraphs",
    f"""{G}, {SUBGRAPHS}, j AS MATERIALIZED (SELECT subgraph_id AS sa, dst FROM s JOIN sg ON id = src), k AS MATERIALIZED (SELECT DISTINCT sa, subgraph_id AS sb FROM j JOIN sg ON id = dst),
    l AS (SELECT subgraph_id AS sa, min(id) AS l FROM sg GROUP BY 1), r AS MATERIALIZED (SELECT sb, min(l) AS l FROM k JOIN l USING (sa) WHERE sa <> sb GROUP BY 1)
    SELECT id, least(id, coalesce(l, id)) AS state FROM sg LEFT JOIN r ON sb = subgraph_id""",
    lambda g: A.pregel(g, F.col("id"), F.col("state"), F.min, F.least("state", "message"), 1, "subgraphs", _subgraphs(g), strict=False),
    ships_graph,
)
_simple(
    "undirected_view",
    f"{G} SELECT src, dst, edge_id FROM e UNION ALL SELECT dst, src, edge_id FROM e WHERE src <> dst",
    lambda g: g.symmetrize().edges.select("src", "dst", "edge_id"),
)
_simple(
    "remote_resolution",
    f"{G}, {SHIPS} SELECT src % 4 AS src_partition, dst % 4 AS dst_partition, count(*) AS edges FROM s GROUP BY 1, 2",
    lambda g: g.edges.groupBy(F.pmod("src", F.lit(PARTITIONS)).cast("bigint").alias("src_partition"), F.pmod("dst", F.lit(PARTITIONS)).cast("bigint").alias("dst_partition")).agg(F.count("*").alias("edges")),
    ships_graph,
)
# --------------------------------------------------------------------------- statistics and indexes: stored, then asked


def _stored_stats(g: PropertyGraph) -> str:
    path = shared_dir(g.vertices.sparkSession, "statistics")
    store_statistics(g, path, ["kind", "name", "mktsegment", "orderpriority", "brand"], ["label"])
    return path


@_query("stats_roundtrip", _REGISTRY["plan_stats"][1])
def _stats_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of the whole graph written, and the flagship pattern's literals looked up in what was written."""
    found = load_statistics(spark, _stored_stats(trade_graph(spark, sf_dir)), parse_path(FLAGSHIP))
    rows = [(p, v, round(n.probability, 9), round(n.out, 6)) for (p, v), n in found.vertex.items()]
    return spark.createDataFrame(rows, "property string, value string, probability double, avg_out double")


@_query("path_stored_stats", PATH3)
def _path_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = trade_graph(spark, sf_dir)
    return run("path", g, FLAGSHIP, stats=load_statistics(spark, _stored_stats(g), parse_path(FLAGSHIP)))


@_query("reach_hist_based", _REGISTRY["reach_auto"][1])
def _reach_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = trade_graph(spark, sf_dir)
    text = "4@name:string[Customer#000000005]@kind:string[region]"
    return run("reach", g, text, stats=load_statistics(spark, _stored_stats(g), parse_reach(text), histograms=True))


@_query("index_lookup", f"{G} SELECT id FROM v WHERE mktsegment = 'BUILDING' UNION ALL SELECT id FROM v WHERE brand = 'Brand#2'")
def _index_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "index")
    W.write_index(property_index(trade_graph(spark, sf_dir), ["mktsegment", "brand"]), path)
    return find_by_index(spark, path, "mktsegment:string[BUILDING]").unionByName(find_by_index(spark, path, "brand:string[Brand#2]"))


# --------------------------------------------------------------------------- numbers, weights, planned and undirected patterns

_LINES = "l AS (SELECT 6000000000000 + l_orderkey AS src, 5000000000000 + l_partkey AS dst, 5000000000000000000 + l_orderkey * 100000000 + l_partkey AS edge_id, max(l_quantity) AS quantity FROM lineitem GROUP BY l_orderkey, l_partkey)"
_simple("vertex_lookup_double", "SELECT 'V:' || 5000000000000 + p_partkey AS vertex FROM part WHERE p_retailprice = 900.9 UNION ALL SELECT 'V:' || 6000000000000 + o_orderkey FROM orders WHERE o_totalprice = 900.9", lambda g: vertex_text(find_vertices(g, "price:double[9.009e2]")), sales_graph)
_simple(
    "path_edge_double",
    f"WITH {_LINES} SELECT src AS start_vertex, dst AS end_vertex, 'V:' || src || '-->E:' || edge_id || '-->V:' || dst AS path FROM l JOIN part ON p_partkey = dst - 5000000000000 WHERE quantity = 18 AND p_size = 2",
    lambda g: paths(g, "out?quantity:float[18]@size:int[2]"),
    sales_graph,
)
_simple(
    "edges_wide",
    "SELECT DISTINCT '5' || lpad(l_orderkey::VARCHAR, 18, '0') || lpad(l_partkey::VARCHAR, 18, '0') AS edge_id, 6000000000000 + l_orderkey AS src FROM lineitem",
    lambda g: g.edges.where("label = 'CONTAINS'").select(F.col("edge_id").cast("string").alias("edge_id"), "src"),
    lambda spark, sf_dir: trade_graph(spark, sf_dir, wide=True),
)
_simple(
    "sssp_weighted",
    f"{G}, w(v, d) AS (SELECT 3000000000003::BIGINT, 0.0::DOUBLE UNION ALL SELECT e.dst, d + e.edge_id % 7 + 1 FROM w JOIN e ON e.src = w.v) SELECT v AS id, min(d) AS distance FROM w GROUP BY 1",
    lambda g: A.shortest_paths(PropertyGraph(g.vertices, g.edges.withColumn("w", (F.col("edge_id") % 7 + 1).cast("double"))), 3_000_000_000_003, "w"),
)
_simple(
    "path_undirected_planned",
    _REGISTRY["path_undirected"][1],
    lambda g: run("path", PropertyGraph(g.vertices, g.edges.where("label = 'FROM'")).symmetrize(), "mktsegment:string[BUILDING]@out?@kind:string[nation]@out?@kind:string[supplier]", undirected=True),
)
_simple(
    "path_in_any",
    f"{G} SELECT a.id AS start_vertex, x.src AS end_vertex, 'V:' || a.id || '<--E:' || x.edge_id || '<--V:' || x.src AS path FROM v a JOIN e x ON x.dst = a.id WHERE a.kind = 'nation'",
    lambda g: paths(g, "kind:string[nation]@in?"),
)
_simple(
    "bfs_leaf_props",
    f"""{G}, n AS (SELECT id, kind || ',' || coalesce(name, 'n') AS t FROM v),
    w(root, v, d, path) AS (SELECT v.id, v.id, 0, 'V:' || t FROM v JOIN n USING (id) WHERE mktsegment = 'FURNITURE'
    UNION ALL SELECT root, e.dst, d + 1, path || '-->E:' || e.edge_id || '-->V:' || t FROM w JOIN e ON e.src = w.v JOIN n ON n.id = e.dst WHERE d < 2)
    SELECT root, path FROM w WHERE d = 2 OR NOT EXISTS (SELECT 1 FROM e WHERE e.src = w.v)""",
    lambda g: bfs_leaf_paths(g, "mktsegment:string[FURNITURE]:2", properties=["kind", "name"]),
)


@_query("read_in_edges", f"{G}, {SHIPS} SELECT src, dst FROM s")
def _read_in_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjacency written by sink alone, and read as in-edges."""
    g = ships_graph(spark, sf_dir)
    sg = _subgraphs(g).select("id", "subgraph_id")
    vertices = _text(vertex_records(PropertyGraph(g.vertices.join(sg, "id"), g.edges), ["kind"]), "vertices")
    return R.read_delimited(spark, vertices, None, ["kind"], _text(adjacency_records(g.reverse(), sg), "in-edges")).edges.select("src", "dst")


@_query("read_property_files", f"{G} SELECT id, kind, coalesce(name, 'n') AS name FROM v")
def _read_property_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ships_graph(spark, sf_dir)
    sg = _subgraphs(g).select("id", "subgraph_id")
    placed = PropertyGraph(g.vertices.join(sg, "id"), g.edges)
    files = {p: _text(vertex_records(placed, [p]), f"property-{p}") for p in ("kind", "name")}
    return R.read_property_files(spark, files, _text(adjacency_records(g, sg), "adjacency")).vertices.select("id", "kind", "name")


@_query("read_implicit", f"{G}, {SHIPS} SELECT src, dst, kind AS src_kind FROM s JOIN v ON v.id = src")
def _read_implicit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each property and one for the edges, whose records belong together by their numbers alone."""
    g = ships_graph(spark, sf_dir)
    rows = written(_edge_lists(g, F.col("dst").cast("string")).select("id", "kind", F.concat(F.size("list").cast("string"), F.lit("%"), F.array_join("list", ":")).alias("sinks")), "records")
    put = lambda c: _text(rows.orderBy("id").select(F.concat(F.col(c).cast("string"), F.lit("|")).alias("value")), f"implicit-{c}")
    back = R.read_implicit(spark, {"vid": put("id"), "kind": put("kind")}, put("sinks"))
    kinds = back.vertices.select(F.col("id").alias("src"), F.col("kind").alias("src_kind"))
    return back.edges.select("src", "dst").join(kinds, "src")


_REGISTRY["k_centres"] = (lambda spark, sf: A.k_centres(ships_graph(spark, sf), 10, 5), None)  # rounds of moves: no SQL; tested against brute force on small graphs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in _REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _REGISTRY.items() if sql}
