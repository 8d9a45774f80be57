"""Statistics of a graph, counted once, stored as tables and loaded for planning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import stats as S
from ..operators.graph import PropertyGraph
from ..plans.cost import GraphStats, histogram_stats, lookup_stats
from ..plans.query import PathQuery, ReachQuery


def _store(table: DataFrame, path: str, *order: str) -> None:
    """Sorted by what lookups ask for, so that they read few row groups."""
    table.repartitionByRange(*(F.col(c) for c in order)).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)


def store_statistics(graph: PropertyGraph, path: str, vertex_properties: list[str], edge_properties: list[str], partitions: int = 1) -> None:
    """Totals, exact statistics of every value, and equi-depth histograms of them."""
    spark = graph.vertices.sparkSession
    S.graph_totals(graph, partitions).write.mode("overwrite").parquet(f"{path}/totals")
    for kind, names, counted, bins in (
        ("vertex", vertex_properties, lambda n: S.vertex_statistics(graph, n, partitions), S.VERTEX_BINS),
        ("edge", edge_properties, lambda n: S.edge_statistics(graph, n), S.EDGE_BINS),
    ):
        if names:
            _store(counted(names), f"{path}/{kind}", "property", "value")
            _store(S.equi_depth_histogram(spark.read.parquet(f"{path}/{kind}"), bins), f"{path}/{kind}_bins", "property", "bin")


def load_statistics(spark: SparkSession, path: str, query: PathQuery | ReachQuery, histograms: bool = False) -> GraphStats:
    """What stored statistics say of a query's literals: exactly, or by their bins."""
    t = spark.read.parquet(f"{path}/totals").first()
    end, look = ("_bins", histogram_stats) if histograms else ("", lookup_stats)
    vertex = spark.read.parquet(f"{path}/vertex{end}")
    edge = spark.read.parquet(f"{path}/edge{end}") if isinstance(query, PathQuery) and any(e.predicate for e in query.edges) else None
    return look((t.vertices, t.edges, t.remote_edges), vertex, edge, query)
