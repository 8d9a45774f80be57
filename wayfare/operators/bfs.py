"""Breadth-first search from all roots at once, level by level.

The state of a level is a set of (root, vertex) rows. It is written after each level,
which cuts the plan, survives lost executors and tells whether anything is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.render import hop_text, start_text
from ..plans.query import BfsQuery, parse_bfs, without_access_flag
from ..plans.tables import sent, written
from .graph import PropertyGraph
from .lookup import find_vertices


def _query(query: BfsQuery | str) -> BfsQuery:
    return parse_bfs(without_access_flag(query)) if isinstance(query, str) else query


def _roots(graph: PropertyGraph, query: BfsQuery, max_roots: int | None) -> DataFrame:
    return find_vertices(graph, query.roots, max_roots).distinct()


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def bfs_tree(graph: PropertyGraph, query: BfsQuery | str, max_roots: int | None = None) -> DataFrame:
    """(root, src, edge_id, dst, depth): each vertex once for each root, at its least depth.

    Of several edges that reach a vertex first, the one of least (src, edge_id) stays.
    """
    query = _query(query)
    front = _roots(graph, query, max_roots).select(F.col("id").alias("root"), F.col("id").alias("v"))
    seen = written(front, "bfs-roots")
    front, levels = seen, []
    edges = graph.edges_where(None)
    n = known = seen.count()
    for depth in range(1, query.depth + 1):
        reached = edges.join(sent(front, n), F.col("v") == F.col("src"))
        first = reached.groupBy("root", "dst").agg(F.min(F.struct("src", "edge_id")).alias("by"))
        old = sent(seen.select(F.col("root").alias("_r"), F.col("v").alias("_v")), known)
        fresh = first.join(old, (F.col("root") == F.col("_r")) & (F.col("dst") == F.col("_v")), "left_anti")
        level = written(fresh.select("root", F.col("by.src").alias("src"), F.col("by.edge_id").alias("edge_id"), "dst", F.lit(depth).alias("depth")), "bfs-level")
        n = level.count()
        known += n
        if not n:
            break
        levels.append(level)
        front = level.select("root", F.col("dst").alias("v"))
        seen = seen.unionByName(front)
    if not levels:
        return front.sparkSession.createDataFrame([], "root bigint, src bigint, edge_id bigint, dst bigint, depth int")
    return _union(levels)


def bfs_walks(graph: PropertyGraph, query: BfsQuery | str, max_roots: int | None = None, counted: bool = False) -> DataFrame:
    """(root, src, edge_id, dst, depth): every edge on every walk of at most ``depth`` edges, as often as it occurs.

    A level holds each (root, vertex) once, with the number of walks that end there, so
    the state doesn't grow with the number of walks. ``counted`` returns that number
    (``walks``) instead of repeating rows.
    """
    query = _query(query)
    front = _roots(graph, query, max_roots).select(F.col("id").alias("root"), F.col("id").alias("v"), F.lit(1).cast("bigint").alias("walks"))
    edges = graph.edges_where(None)
    levels = []
    for depth in range(1, query.depth + 1):
        level = written(front.join(edges, F.col("v") == F.col("src")).select("root", "src", "edge_id", "dst", F.lit(depth).alias("depth"), "walks"), "walk-level")
        if level.isEmpty():
            break
        levels.append(level)
        front = level.groupBy("root", F.col("dst").alias("v")).agg(F.sum("walks").alias("walks"))
    if not levels:
        out = front.sparkSession.createDataFrame([], "root bigint, src bigint, edge_id bigint, dst bigint, depth int, walks bigint")
    else:
        out = _union(levels)
    if counted:
        return out
    return out.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("walks")))).drop("_i", "walks")


def bfs_leaf_paths(graph: PropertyGraph, query: BfsQuery | str, max_roots: int | None = None, pruned: bool = False, properties: list[str] | None = None) -> DataFrame:
    """(root, path): walks of exactly ``depth`` edges, and shorter ones that end where no edge leaves.

    ``pruned``: only walks along the BFS tree. ``properties``: vertices are shown by these,
    with commas in between, instead of their ids.
    """
    query = _query(query)
    edges = graph.edges_where(None)
    v = graph.vertices
    shown = v.select(F.col("id").alias("_id"), F.concat_ws(",", *(F.coalesce(graph.property(v, p), F.lit(graph.missing)) for p in properties)).alias("_shown")) if properties else None

    def named(frame: DataFrame) -> DataFrame:
        """The frame with ``_name``, what its vertex v is shown as; an unknown vertex by its id."""
        if shown is None:
            return frame.withColumn("_name", F.col("v").cast("string"))
        return frame.join(shown, F.col("v") == F.col("_id"), "left").withColumn("_name", F.coalesce("_shown", F.col("v").cast("string"))).drop("_id", "_shown")

    front = named(_roots(graph, query, max_roots).select(F.col("id").alias("root"), F.col("id").alias("v"))).select("root", "v", start_text(F.col("_name")).alias("path"))
    tree = bfs_tree(graph, query, max_roots) if pruned else None
    leaves = []
    for depth in range(query.depth + 1):
        if depth == query.depth:
            leaves.append(front)
            break
        front = written(front, "leaf-level")
        leaves.append(front.join(edges, F.col("v") == F.col("src"), "left_anti"))
        if pruned:
            hop = tree.where(F.col("depth") == depth + 1).select(F.col("root").alias("_r"), "src", "edge_id", "dst")
            front = front.join(hop, (F.col("v") == F.col("src")) & (F.col("root") == F.col("_r")))
        else:
            front = front.join(edges, F.col("v") == F.col("src"))
        front = named(front.select("root", F.col("dst").alias("v"), "edge_id", "path")).select("root", "v", F.concat("path", hop_text(F.col("edge_id"), F.col("_name"))).alias("path"))
    return _union(leaves).select("root", "path")


def with_properties(graph: PropertyGraph, found: DataFrame, vertex: str, *names: str) -> DataFrame:
    """``found`` with properties of the vertex in a column."""
    v = graph.vertices.select(F.col("id").alias("_id"), *(graph.property(graph.vertices, n).alias(n) for n in names))
    return found.join(v, F.col(vertex) == F.col("_id"), "left").drop("_id")
