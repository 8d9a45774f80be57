"""Running queries: one function for all kinds, with the planner in between."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..plans.cost import GraphStats, choose_side, choose_start, collect_stats, impossible
from ..plans.query import parse_batch, parse_path, parse_reach, without_access_flag
from .bfs import bfs_leaf_paths, bfs_tree, bfs_walks
from .graph import PropertyGraph
from .lookup import find_vertices, vertex_text
from .paths import paths
from .reach import shortest_walks

KINDS = ("vertex", "bfs", "bfs_walks", "bfs_leaf_paths", "reach", "path")


def run(kind: str, graph: PropertyGraph, text: str, stats: GraphStats | None = None, coefficients: str | None = None, undirected: bool = False) -> DataFrame:
    """The result of one query. Paths and reachability are planned by ``stats``, counted on the graph if not given."""
    if kind == "vertex":
        return vertex_text(find_vertices(graph, text))
    if kind == "bfs":
        return bfs_tree(graph, text)
    if kind == "bfs_walks":
        return bfs_walks(graph, text)
    if kind == "bfs_leaf_paths":
        return bfs_leaf_paths(graph, text)
    if kind == "reach":
        query = parse_reach(without_access_flag(text))
        known = stats or collect_stats(graph, query)
        return shortest_walks(graph, query, choose_side(query, known, coefficients or "calibrated"))
    if kind == "path":
        query = parse_path(without_access_flag(text))
        if query.start is not None:
            return paths(graph, query, undirected=undirected)
        known = stats or collect_stats(graph, query)
        found = paths(graph, query, choose_start(query, known, coefficients or "default", undirected), undirected)
        return found.limit(0) if impossible(query, known) else found  # a literal occurs nowhere
    raise ValueError(f"kind is one of {KINDS}")


def run_batch(kind: str, graph: PropertyGraph, text: str, **options) -> list[DataFrame]:
    """One result for each query of ``q1;q2;...``, over one graph."""
    return [run(kind, graph, q, **options) for q in parse_batch(text)]
