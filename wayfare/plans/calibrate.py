"""Measured cost coefficients: what scanning, expanding, shuffling and joining cost on this cluster.

Each probe runs over the graph itself and is divided by the rows it handles; the
coefficients are relative to the price of expanding one edge.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cost import Coefficients


def _seconds(df: DataFrame, repeats: int) -> float:
    best = float("inf")
    for _ in range(repeats):
        began = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        best = min(best, time.perf_counter() - began)
    return best


def probes(graph, repeats: int = 2) -> dict[str, float]:
    """Seconds a row: idle (a query over nothing), scan, expand, shuffle, join."""
    ids, edges = graph.vertices.select("id"), graph.edges.select("src", "dst")
    v, e = max(ids.count(), 1), max(edges.count(), 1)
    idle = _seconds(ids.limit(0), repeats)
    spent = lambda df, rows: max(_seconds(df, repeats) - idle, 0.0) / rows
    halves = edges.groupBy("src").agg(F.count("*").alias("n"))
    return {
        "idle": idle,
        "scan": spent(graph.vertices.where(F.col("id") % 7 == 3), v),
        "expand": spent(ids.join(edges, F.col("id") == F.col("src")), e),
        "shuffle": spent(edges.repartition(F.col("dst")), e),
        "join": spent(halves.alias("a").join(halves.alias("b"), "src"), v),
    }


def calibrate(graph, repeats: int = 2) -> Coefficients:
    """Coefficients for ``path_costs`` and ``reach_costs`` from the probes."""
    p = probes(graph, repeats)
    unit = max(p["expand"], 1e-12)
    return Coefficients(network=p["shuffle"] / unit, vertex=p["scan"] / unit, edge=1.0, join=p["join"] / unit, scan=p["scan"] / unit)
