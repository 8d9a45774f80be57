"""Graph statistics: what the planner knows about properties and degrees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.prefix import sum_before
from ..plans.query import Predicate
from ..plans.tables import sent, written
from .graph import PropertyGraph
from .topology import partition_of

#: Bins of the equi-depth histograms; fixed values.
VERTEX_BINS, EDGE_BINS = 1000, 100
_SUMS = ("out_degree", "in_degree", "remote_out", "remote_in")


def degrees(graph: PropertyGraph, partitions: int = 1) -> DataFrame:
    """(id, out_degree, in_degree, remote_out, remote_in) of every vertex; remote edges cross partitions."""
    remote = (partition_of(F.col("src"), partitions) != partition_of(F.col("dst"), partitions)).cast("bigint")
    one = F.lit(1).cast("bigint")
    zero = F.lit(0).cast("bigint")
    out = graph.edges.select(F.col("src").alias("id"), one.alias("out_degree"), zero.alias("in_degree"), remote.alias("remote_out"), zero.alias("remote_in"))
    back = graph.edges.select(F.col("dst").alias("id"), zero.alias("out_degree"), one.alias("in_degree"), zero.alias("remote_out"), remote.alias("remote_in"))
    alone = graph.vertices.select("id", *(zero.alias(c) for c in _SUMS))
    # one aggregation instead of two and an outer join
    return out.unionByName(back).unionByName(alone).groupBy("id").agg(*(F.sum(c).alias(c) for c in _SUMS))


def literal_statistics(graph: PropertyGraph, vertex: list[Predicate], edge: list[Predicate], partitions: int = 1) -> tuple[tuple[int, int, int], list, list[int]]:
    """What a query's literals need: (vertices, edges, remote edges), (n, sums of degrees) of each vertex predicate, n of each edge predicate.

    Edges meet only the vertices that a predicate takes, not the degrees of all vertices;
    all counts come from one job, a row for each predicate.
    """
    one = lambda c: F.coalesce(c, F.lit(False)).cast("bigint")
    names = ("n", *_SUMS)
    zero = F.lit(0).cast("bigint")

    def row(frame: DataFrame, what: str, place: Column, *counts: Column) -> DataFrame:
        return frame.select(F.lit(what).alias("what"), place.cast("int").alias("place"), *(F.coalesce(c, zero).cast("bigint").alias(n) for c, n in zip([*counts, *[zero] * 5], names)))

    remote = partition_of(F.col("src"), partitions) != partition_of(F.col("dst"), partitions)
    kept = graph.edges
    takes = F.array(*(one(graph.condition(kept, p)) for p in edge)) if edge else F.array(zero)
    marked = kept.select("src", "dst", remote.alias("remote"), takes.alias("takes"))
    found = row(graph.vertices.agg(F.count("*").alias("n")), "vertices", F.lit(0), F.col("n"))
    every = marked.agg(F.count("*").alias("n"), F.sum(one(F.col("remote"))).alias("r"), F.array(*(F.sum(F.col("takes")[i]) for i in range(max(1, len(edge))))).alias("t"))
    found = found.unionByName(row(every, "edges", F.lit(0), F.col("n"), F.col("r")))
    found = found.unionByName(row(every.select(F.posexplode("t").alias("place", "n")), "edge", F.col("place"), F.col("n")))
    if vertex:
        v = graph.vertices
        hits = F.filter(F.array(*(F.when(graph.condition(v, p), F.lit(i)) for i, p in enumerate(vertex))), lambda x: x.isNotNull())
        chosen = written(v.select("id", F.explode(hits).alias("place")), "literals")
        side = sent(chosen, chosen.count())
        ends = F.explode(F.array(*(F.struct(F.col(a).alias("end"), F.lit(int(a == "src")).cast("bigint").alias("o")) for a in ("src", "dst"))))
        met = marked.select(ends.alias("e"), one(F.col("remote")).alias("r")).select("e.end", "e.o", "r").join(side, F.col("end") == F.col("id"))
        sums = met.groupBy("place").agg(F.sum("o").alias("o"), F.sum(1 - F.col("o")).alias("i"), F.sum(F.col("o") * F.col("r")).alias("ro"), F.sum((1 - F.col("o")) * F.col("r")).alias("ri"))
        found = found.unionByName(row(chosen.groupBy("place").agg(F.count("*").alias("n")), "vertex", F.col("place"), F.col("n")))
        found = found.unionByName(row(sums, "vertex", F.col("place"), zero, *(F.col(c) for c in ("o", "i", "ro", "ri"))))
    rows = found.collect()  # a few for each predicate
    add = lambda what, place, name: sum(getattr(r, name) for r in rows if r.what == what and r.place == place)
    totals = (add("vertices", 0, "n"), add("edges", 0, "n"), add("edges", 0, "out_degree"))
    return totals, [tuple(add("vertex", i, n) for n in names) for i in range(len(vertex))], [add("edge", i, "n") for i in range(len(edge))]


def vertex_statistics(graph: PropertyGraph, names: list[str], partitions: int = 1, values: dict[str, list[str]] | None = None) -> DataFrame:
    """(property, value, n, probability, avg_out, avg_in, avg_remote_out, avg_remote_in).

    ``values`` narrows to some values; then only their vertices are counted.
    """
    v = graph.vertices
    pairs = F.explode(F.array(*(F.struct(F.lit(n).alias("property"), F.coalesce(graph.property(v, n), F.lit(graph.missing)).alias("value")) for n in names)))
    long = v.select("id", pairs.alias("p")).select("id", "p.property", "p.value")
    if values is not None:
        wanted = [(F.col("property") == n) & F.col("value").isin(vs) for n, vs in values.items()]
        keep = wanted[0]
        for w in wanted[1:]:
            keep = keep | w
        long = long.where(keep)
    total = max(v.count(), 1)
    grouped = long.join(degrees(graph, partitions), "id").groupBy("property", "value").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in _SUMS))
    ratios = [(F.col(c) / F.col("n")).alias(f"avg_{c.replace('_degree', '')}") for c in _SUMS]
    return grouped.select("property", "value", "n", (F.col("n") / F.lit(total)).alias("probability"), *ratios)


def edge_statistics(graph: PropertyGraph, names: list[str], values: dict[str, list[str]] | None = None) -> DataFrame:
    """(property, value, n, probability) over the edges."""
    e = graph.edges
    pairs = F.explode(F.array(*(F.struct(F.lit(n).alias("property"), F.coalesce(graph.property(e, n), F.lit(graph.missing)).alias("value")) for n in names)))
    long = e.select(pairs.alias("p")).select("p.property", "p.value")
    if values is not None:
        keep = F.lit(False)
        for n, vs in values.items():
            keep = keep | ((F.col("property") == n) & F.col("value").isin(vs))
        long = long.where(keep)
    total = max(e.count(), 1)
    return long.groupBy("property", "value").agg(F.count("*").alias("n")).withColumn("probability", F.col("n") / F.lit(total))


def graph_totals(graph: PropertyGraph, partitions: int = 1) -> DataFrame:
    """One row: vertices, edges, remote_edges, and remote_vertices (distinct (partition, vertex) reached from outside)."""
    p = lambda c: partition_of(F.col(c), partitions)
    remote = p("src") != p("dst")
    names = ("vertices", "edges", "remote_edges", "remote_vertices")

    def row(frame: DataFrame, **counts) -> DataFrame:
        zero = F.lit(0).cast("bigint")
        return frame.agg(*(F.coalesce(counts[n], zero).alias(n) if n in counts else F.max(zero).alias(n) for n in names))

    v = row(graph.vertices, vertices=F.count("*"))
    e = row(graph.edges, edges=F.count("*"), remote_edges=F.sum(remote.cast("bigint")))
    proxies = row(graph.edges.where(remote).select(p("src").alias("p"), "dst").distinct(), remote_vertices=F.count("*"))
    return v.unionByName(e).unionByName(proxies).agg(*(F.sum(n).alias(n) for n in names))


def graph_stats(graph: PropertyGraph) -> DataFrame:
    """One row of degree aggregates."""
    d = degrees(graph)
    return d.agg(
        F.count("*").alias("vertices"), F.sum("out_degree").alias("edges"), F.max("out_degree").alias("max_out"), F.max("in_degree").alias("max_in"),
        F.sum((F.col("out_degree") + F.col("in_degree") == 0).cast("bigint")).alias("isolated"), F.sum((F.col("out_degree") == 0).cast("bigint")).alias("sinks"),
    )


def degree_distribution(graph: PropertyGraph, predicate=None) -> DataFrame:
    """(out_degree, vertices) over the vertices that pass."""
    out = graph.edges.groupBy("src").agg(F.count("*").alias("out_degree"))
    d = graph.vertices_where(predicate).join(out, F.col("id") == F.col("src"), "left").select(F.coalesce("out_degree", F.lit(0)).cast("bigint").alias("out_degree"))
    return d.groupBy("out_degree").agg(F.count("*").alias("vertices"))


def edge_counts(graph: PropertyGraph) -> DataFrame:
    """One row: out_edges, and vertices that have in-edges."""
    return graph.edges.select("dst").groupBy("dst").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("out_edges"), F.count("*").alias("vertices_with_in_edges"))


def in_edges(graph: PropertyGraph) -> DataFrame:
    """(dst, src, edge_id): reverse adjacency, one edge (the least) for each (dst, src)."""
    return graph.edges.groupBy("dst", "src").agg(F.min("edge_id").alias("edge_id"))


def equi_depth_histogram(frequencies: DataFrame, bins: int) -> DataFrame:
    """(property, bin, first, last, keys, frequency, probability) from (property, value, n).

    Values in order of their text; the bin of a value is floor(rows before it * bins /
    rows), so a value is never split and bins >= values is exact. The probability is that
    of any one value of the bin. Averages (``avg_*``) are kept, weighted by n.
    """
    totals = frequencies.groupBy("property").agg(F.sum("n").alias("_total"))
    before = sum_before(frequencies, "n", "property", "value", out="_all")
    # the sum before the property's own first value comes off again
    firsts = before.groupBy("property").agg(F.min("_all").alias("_base"))
    placed = before.join(F.broadcast(totals), "property").join(F.broadcast(firsts), "property")  # one row for each property
    placed = placed.withColumn("bin", F.floor((F.col("_all") - F.col("_base")) * bins / F.col("_total")).cast("int"))
    averages = [c for c in frequencies.columns if c.startswith("avg_")]
    grouped = placed.groupBy("property", "bin", "_total").agg(
        F.min("value").alias("first"), F.max("value").alias("last"), F.count("*").alias("keys"), F.sum("n").alias("frequency"), *((F.sum(F.col(a) * F.col("n")) / F.sum("n")).alias(a) for a in averages)
    )
    return grouped.select("property", "bin", "first", "last", "keys", "frequency", (F.col("frequency") / F.col("keys") / F.col("_total")).alias("probability"), *averages)
