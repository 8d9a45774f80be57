"""Partitions, subgraphs (weakly connected components within a partition) and what crosses them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.prefix import sum_before
from .components import star_components
from .graph import PropertyGraph


def partition_of(vertex: Column, partitions: int) -> Column:
    return F.pmod(vertex, F.lit(partitions)).cast("int")


def subgraph_id(number: Column, partition: Column) -> Column:
    """``number | partition << 32``; the partition is ``id >> 32``."""
    return number.cast("bigint").bitwiseOR(F.shiftleft(partition.cast("bigint"), 32))


def vertex_subgraphs(graph: PropertyGraph, partitions: int, whole: bool = False) -> DataFrame:
    """(id, partition_id, subgraph_id): numbered from 0 in each partition, by least vertex id.

    Vertices of a partition are connected by its edges, also through a common neighbour
    in another partition. ``whole``: a partition is one subgraph.
    """
    own = graph.vertices.select("id", partition_of(F.col("id"), partitions).alias("partition_id"))
    if whole:
        return own.withColumn("subgraph_id", subgraph_id(F.lit(0), F.col("partition_id")))
    # a vertex stands for itself in its own partition; in others its proxy does, so the key has the partition too
    part = partition_of(F.col("src"), partitions)
    ends = graph.edges.agg(F.max(F.greatest("src", "dst")).alias("most"), F.min(F.least("src", "dst")).alias("least")).first()
    if ends.most is None or (ends.least >= 0 and ends.most < (1 << 62) // partitions):
        # as one number, where ids leave room for the partition
        key = lambda c: F.col(c) * F.lit(partitions).cast("bigint") + part
        split = lambda c: (F.pmod(F.col(c), F.lit(partitions)).cast("int"), F.expr(f"{c} div {partitions}"))
    else:
        key = lambda c: F.struct(part.alias("part"), F.col(c).alias("id"))
        split = lambda c: (F.col(f"{c}.part"), F.col(f"{c}.id"))
    linked = star_components(graph.edges.select(key("src").alias("a"), key("dst").alias("b")))
    (of, node), (_, root) = split("node"), split("root")
    local = linked.select(of.alias("part"), node.alias("node"), root.alias("root"))
    joined = own.join(local, (F.col("partition_id") == F.col("part")) & (F.col("id") == F.col("node")), "left")
    # the root may be a proxy of a lesser id, so groups are named by their least local vertex
    rooted = joined.select("id", "partition_id", F.coalesce("root", "id").alias("root"), F.col("root").isNull().alias("alone"))
    groups = rooted.groupBy("partition_id", "root", "alone").agg(F.min("id").alias("least"))
    # numbered over all partitions by ranges, and from 0 in each: a partition may hold any share of the groups
    before = sum_before(groups.withColumn("one", F.lit(1).cast("bigint")), "one", "partition_id", "least", out="before")
    firsts = before.groupBy("partition_id").agg(F.min("before").alias("first"))
    numbered = before.join(F.broadcast(firsts), "partition_id").select("partition_id", "root", "alone", (F.col("before") - F.col("first")).alias("number"))  # a row for each partition
    out = rooted.join(numbered, ["partition_id", "root", "alone"])
    return out.select("id", "partition_id", subgraph_id(F.col("number"), F.col("partition_id")).alias("subgraph_id"))


def remote_edges(graph: PropertyGraph, subgraphs: DataFrame) -> DataFrame:
    """Edges with src_subgraph and dst_subgraph, and whether they cross partitions (``remote``)."""
    side = lambda end: subgraphs.select(F.col("id").alias(f"_{end}"), F.col("subgraph_id").alias(f"{end}_subgraph"))
    e = graph.edges.select("src", "dst", "edge_id").join(side("src"), F.col("src") == F.col("_src")).join(side("dst"), F.col("dst") == F.col("_dst"), "left")
    crosses = F.shiftright("src_subgraph", 32) != F.shiftright("dst_subgraph", 32)
    return e.select("src", "dst", "edge_id", "src_subgraph", "dst_subgraph", F.coalesce(crosses, F.lit(True)).alias("remote"))


def metagraph(graph: PropertyGraph, subgraphs: DataFrame) -> DataFrame:
    """(src_subgraph, dst_subgraph, local_vertices, remote_vertices): distinct vertices that each subgraph's edges reach in another."""
    crossing = remote_edges(graph, subgraphs).where("src_subgraph <> dst_subgraph")
    links = crossing.select("src_subgraph", "dst_subgraph", "dst").distinct().groupBy("src_subgraph", "dst_subgraph").agg(F.count("*").alias("remote_vertices"))
    local = subgraphs.groupBy("subgraph_id").agg(F.count("*").alias("local_vertices"))
    return local.join(links, F.col("subgraph_id") == F.col("src_subgraph")).select("src_subgraph", "dst_subgraph", "local_vertices", "remote_vertices")


def within_subgraphs(graph: PropertyGraph, subgraphs: DataFrame) -> PropertyGraph:
    """The graph without edges that leave a subgraph."""
    return graph.within(subgraphs.select("id", F.col("subgraph_id").alias("group")))
