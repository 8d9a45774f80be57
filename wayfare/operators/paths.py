"""Path patterns as joins.

A pattern of k edge steps is a chain of k joins that grows from a start vertex step to
the right, then to the left. Both halves hang off the same rows, so no many-to-many
join of halves is needed. Every step's own predicate is applied before its join: edges
and vertices are filtered where they are read. Matches are walks: vertices and edges
may repeat, and each distinct series of edges is one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.render import path_text
from ..plans.query import OUT, PathQuery, Predicate, parse_path
from .graph import PropertyGraph


def _arrive(graph: PropertyGraph, walks: DataFrame, column: str, predicate: Predicate | None) -> DataFrame:
    """Keep the walks whose vertex in ``column`` passes."""
    if predicate is None:
        return walks
    good = graph.vertices_where(predicate).select(F.col("id").alias("_ok"))
    return walks.join(good, F.col(column) == F.col("_ok"), "left_semi")


def _step(graph: PropertyGraph, walks: DataFrame, query: PathQuery, i: int, forward: bool, undirected: bool) -> DataFrame:
    """Walks extended over edge step i: from v<i> to v<i+1>, or back."""
    here, there = (f"v{i}", f"v{i + 1}") if forward else (f"v{i + 1}", f"v{i}")
    step = query.edges[i]
    along = forward == (undirected or step.direction == OUT)  # whether the edge is taken from src to dst
    edges = graph.edges_where(step.predicate)
    near, far = ("src", "dst") if along else ("dst", "src")
    hop = edges.select(F.col(near).alias("_near"), F.col("edge_id").alias(f"e{i + 1}"), F.col(far).alias(there))
    target = query.vertices[i + 1 if forward else i]
    # the next vertex's predicate thins the edges out before they meet the walks
    hop = _arrive(graph, hop, there, target)
    return walks.join(hop, F.col(here) == F.col("_near")).drop("_near")


def match(graph: PropertyGraph, query: PathQuery | str, start: int | None = None, undirected: bool = False) -> DataFrame:
    """All matches: columns v0, e1, v1, ... of ids.

    ``start`` (an index among the vertex steps) or the query's own start say where to
    begin; the result is the same for all. ``undirected``: every step follows edges
    from src to dst, for graphs that store both directions (see ``symmetrize``).
    """
    query = parse_path(query) if isinstance(query, str) else query
    s = start if start is not None else query.start or 0
    walks = graph.vertices_where(query.vertices[s]).select(F.col("id").alias(f"v{s}"))
    for i in range(s, len(query.edges)):
        walks = _step(graph, walks, query, i, True, undirected)
    for i in range(s - 1, -1, -1):
        walks = _step(graph, walks, query, i, False, undirected)
    names = ["v0"]
    for i in range(len(query.edges)):
        names += [f"e{i + 1}", f"v{i + 1}"]
    return walks.select(*names)


def render(matches: DataFrame, query: PathQuery | str, undirected: bool = False) -> DataFrame:
    """start_vertex, end_vertex and the path as text."""
    query = parse_path(query) if isinstance(query, str) else query
    n = len(query.edges)
    text = path_text([F.col(f"v{i}") for i in range(n + 1)], [F.col(f"e{i + 1}") for i in range(n)], [OUT if undirected else e.direction for e in query.edges])
    return matches.select(F.col("v0").alias("start_vertex"), F.col(f"v{n}").alias("end_vertex"), text.alias("path"))


def paths(graph: PropertyGraph, query: PathQuery | str, start: int | None = None, undirected: bool = False) -> DataFrame:
    return render(match(graph, query, start, undirected), query, undirected)


def hop_counts(graph: PropertyGraph, query: PathQuery | str, start: int | None = None, undirected: bool = False) -> DataFrame:
    """(step, walks): how many walks there are after each step, in the order they are taken.

    Step 0 is the start; each prefix of the chain is a plan of its own, whose equal
    exchanges Spark computes once.
    """
    query = parse_path(query) if isinstance(query, str) else query
    s = start if start is not None else query.start or 0
    walks = graph.vertices_where(query.vertices[s]).select(F.col("id").alias(f"v{s}"))
    chain = [walks]
    for i in [*range(s, len(query.edges))]:
        chain.append(_step(graph, chain[-1], query, i, True, undirected))
    for i in range(s - 1, -1, -1):
        chain.append(_step(graph, chain[-1], query, i, False, undirected))
    out = None
    for k, frame in enumerate(chain):
        row = frame.agg(F.count("*").alias("walks")).select(F.lit(k).cast("bigint").alias("step"), "walks")
        out = row if out is None else out.unionByName(row)
    return out
