"""Writers of graph text formats and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import PropertyGraph


def vertex_records(graph: PropertyGraph, properties: list[str], subgraph: Column | None = None) -> DataFrame:
    """``subgraph#id@p1$p2|`` of each vertex."""
    sg = subgraph if subgraph is not None else F.col("subgraph_id") if "subgraph_id" in graph.vertices.columns else F.lit(0)
    values = F.concat_ws("$", *(F.coalesce(graph.property(graph.vertices, p), F.lit(graph.missing)) for p in properties))
    return graph.vertices.select(F.concat(sg.cast("string"), F.lit("#"), F.col("id").cast("string"), F.lit("@"), values, F.lit("|")).alias("value"))


def adjacency_records(graph: PropertyGraph, subgraphs: DataFrame) -> DataFrame:
    """``subgraph#id@locals%sink:sink|``: sinks of the same subgraph first, then the others, each by id.

    ``subgraphs`` has (id, subgraph_id). A vertex's sinks are one line, as the format asks.
    """
    side = lambda end: subgraphs.select(F.col("id").alias(f"_{end}"), F.col("subgraph_id").alias(f"_{end}_sg"))
    e = graph.edges.join(side("src"), F.col("src") == F.col("_src")).join(side("dst"), F.col("dst") == F.col("_dst"), "left")
    away = F.coalesce(F.col("_src_sg") != F.col("_dst_sg"), F.lit(True))
    lists = e.groupBy("src").agg(F.sort_array(F.collect_list(F.struct(away.alias("away"), "dst"))).alias("sinks"))
    all_of = subgraphs.select("id", "subgraph_id").join(lists, F.col("id") == F.col("src"), "left")
    sinks = F.coalesce("sinks", F.expr("cast(array() as array<struct<away:boolean,dst:bigint>>)"))
    local = F.size(F.filter(sinks, lambda s: ~s["away"]))
    text = F.array_join(F.transform(sinks, lambda s: s["dst"].cast("string")), ":")
    return all_of.select(F.concat(F.col("subgraph_id").cast("string"), F.lit("#"), F.col("id").cast("string"), F.lit("@"), local.cast("string"), F.lit("%"), text, F.lit("|")).alias("value"))


def adjacency_lines(graph: PropertyGraph) -> DataFrame:
    """``src sink sink ...`` by edge id."""
    lists = graph.edges.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("edge_id", "dst"))).alias("s"))
    rows = graph.vertices.select("id").join(lists, F.col("id") == F.col("src"), "left")
    sinks = F.transform(F.coalesce("s", F.expr("cast(array() as array<struct<edge_id:bigint,dst:bigint>>)")), lambda s: s["dst"].cast("string"))
    return rows.select(F.concat_ws(" ", F.concat(F.array(F.col("id").cast("string")), sinks)).alias("value"))


def property_index(graph: PropertyGraph, properties: list[str]) -> DataFrame:
    """Inverted index: (property, value, id), missing values as the missing token."""
    pairs = F.explode(F.array(*(F.struct(F.lit(p).alias("property"), F.coalesce(graph.property(graph.vertices, p), F.lit(graph.missing)).alias("value")) for p in properties)))
    extra = [c for c in ("subgraph_id",) if c in graph.vertices.columns]
    return graph.vertices.select("id", *extra, pairs.alias("p")).select("p.property", "p.value", "id", *extra)


def write_lines(lines: DataFrame, path: str) -> None:
    lines.select("value").write.mode("overwrite").text(path)


def write_index(index: DataFrame, path: str) -> None:
    """Sorted by value within files of one property, so that lookups read few row groups."""
    index.repartitionByRange("property", "value", "id").sortWithinPartitions("value", "id").write.mode("overwrite").partitionBy("property").parquet(path)


def write_tables(graph: PropertyGraph, path: str) -> None:
    """Parquet: vertices, and edges sorted by source within files, so that scans of a source skip row groups."""
    graph.vertices.write.mode("overwrite").parquet(f"{path}/vertices")
    graph.edges.repartitionByRange("src", "edge_id").sortWithinPartitions("src", "edge_id").write.mode("overwrite").parquet(f"{path}/edges")
