"""Reachability: all shortest walks between two sets of vertices.

The search runs from one side, level by level, over (origin, vertex) states that are
kept at their least depth only. It ends at the first level in which an origin meets the
other set. The walks are then read backwards through the levels, so that only states on
a shortest walk are ever joined into paths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.render import hop_text, start_text
from ..plans.query import ReachQuery, parse_reach, without_access_flag
from ..plans.tables import sent, written
from .graph import PropertyGraph

_EMPTY = "source bigint, sink bigint, length int, path string"


def shortest_walks(graph: PropertyGraph, query: ReachQuery | str, side: int | None = None) -> DataFrame:
    """(source, sink, length, path): every walk of the least length (1 to depth) from a source to a sink.

    ``side`` (or the query's): 0 searches from the sources, 1 from the sinks; the result
    is the same.
    """
    query = parse_reach(without_access_flag(query)) if isinstance(query, str) else query
    side = side if side is not None else query.side or 0
    begin, end = (query.source, query.sink) if side == 0 else (query.sink, query.source)
    near, far = ("src", "dst") if side == 0 else ("dst", "src")
    edges = graph.edges_where(None).select(F.col(near).alias("near"), F.col(far).alias("far"), "edge_id")
    goal = graph.vertices_where(end).distinct()
    spark = graph.vertices.sparkSession

    level = written(graph.vertices_where(begin).distinct().select(F.col("id").alias("origin"), F.col("id").alias("v")), "reach-level")
    levels, seen, hits = [level], None, None
    n, known = level.count(), 0
    for _ in range(query.depth):
        reached = edges.join(sent(level, n), F.col("v") == F.col("near")).select("origin", F.col("far").alias("v")).distinct()
        if seen is not None:
            reached = reached.join(sent(seen, known), ["origin", "v"], "left_anti")
        # one table tells who is reached and who of them is a goal
        marked = reached.join(goal.select(F.col("id").alias("_goal")), F.col("v") == F.col("_goal"), "left").select("origin", "v", F.col("_goal").isNotNull().alias("hit"))
        marked = written(marked, "reach-level")
        row = marked.agg(F.count("*").alias("n"), F.max("hit").alias("hit")).first()
        n, known = row.n, known + row.n
        if not n:
            break
        level = marked.select("origin", "v")
        levels.append(level)
        if row.hit:
            hits = marked.where("hit").select("origin", "v")
            break
        seen = level if seen is None else seen.unionByName(level)
    if hits is None:
        return spark.createDataFrame([], _EMPTY)

    length = len(levels) - 1
    walks = hits.select("origin", "v", F.col("v").alias("last"), F.lit("").alias("text"))
    if side == 1:
        walks = walks.withColumn("text", start_text(F.col("v")))
    for i in range(length - 1, -1, -1):
        before = levels[i].select(F.col("origin").alias("_o"), F.col("v").alias("_v"))
        back = walks.join(edges, F.col("v") == F.col("far")).join(before, (F.col("origin") == F.col("_o")) & (F.col("near") == F.col("_v")), "left_semi")
        hop = hop_text(F.col("edge_id"), F.col("v" if side == 0 else "near"))
        text = F.concat(hop, F.col("text")) if side == 0 else F.concat(F.col("text"), hop)
        walks = back.select("origin", F.col("near").alias("v"), "last", text.alias("text"))
    source, sink = ("origin", "last") if side == 0 else ("last", "origin")
    path = F.concat(start_text(F.col("origin")), F.col("text")) if side == 0 else F.col("text")
    return walks.select(F.col(source).alias("source"), F.col(sink).alias("sink"), F.lit(length).alias("length"), path.alias("path"))
