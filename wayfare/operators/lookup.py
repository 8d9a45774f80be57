"""Vertex lookup by property."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.query import Predicate, parse_predicate, split_outside, without_access_flag
from .graph import PropertyGraph


def find_vertices(graph: PropertyGraph, predicate: Predicate | str | None, max_roots: int | None = None) -> DataFrame:
    """Ids of the vertices that pass; with ``max_roots`` only the least of them."""
    if isinstance(predicate, str):
        predicate = parse_predicate(split_outside(without_access_flag(predicate), "@")[0])
    found = graph.vertices_where(predicate)
    return found if max_roots is None else found.orderBy("id").limit(max_roots)


def vertex_text(found: DataFrame) -> DataFrame:
    """``V:<id>`` lines."""
    return found.select(F.concat(F.lit("V:"), F.col("id").cast("string")).alias("vertex"))


def property_of(graph: PropertyGraph, predicate: Predicate | str | None, *names: str) -> DataFrame:
    """Ids and the named properties (all, as a map, without names) of the vertices that pass."""
    if isinstance(predicate, str):
        predicate = parse_predicate(predicate)
    c = graph.condition(graph.vertices, predicate)
    v = graph.vertices if c is None else graph.vertices.where(c)
    if names:
        return v.select("id", *(graph.property(v, n).alias(n) for n in names))
    own = [c for c in v.columns if c not in ("id", "props", "partition_id", "subgraph_id")]
    pairs = [x for n in own for x in (F.lit(n), F.col(f"`{n}`").cast("string"))]
    every = F.map_filter(F.create_map(*pairs), lambda k, x: x.isNotNull()) if pairs else F.expr("cast(map() as map<string,string>)")
    if "props" in v.columns:
        every = F.map_concat(every, F.coalesce("props", F.expr("cast(map() as map<string,string>)")))
    return v.select("id", every.alias("props"))


def find_by_index(spark: SparkSession, path: str, predicate: Predicate | str) -> DataFrame:
    """Ids of the vertices that pass, from an index that ``write_index`` wrote; no vertex table is read.

    The property names a folder of files that are sorted by value, so few row groups are read.
    """
    p = parse_predicate(predicate) if isinstance(predicate, str) else predicate
    return spark.read.option("inferSchema", "false").parquet(path).where((F.col("property").cast("string") == p.name) & (F.col("value") == p.text)).select("id")
