"""Graph algorithms as rounds of joins and grouped aggregation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.tables import written
from .components import star_components
from .graph import PropertyGraph


def connected_components(graph: PropertyGraph) -> DataFrame:
    """(id, component): the least id that a vertex is connected with, whatever the edges' direction."""
    linked = star_components(graph.edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    return graph.vertices.select("id").join(linked, F.col("id") == F.col("node"), "left").select("id", F.coalesce("root", "id").alias("component"))


def pagerank(graph: PropertyGraph, iterations: int = 10, damping: float = 0.85, cut_every: int = 5) -> DataFrame:
    """(id, rank) after a fixed number of rounds; ranks start at 1/n, sinks keep nothing."""
    n = graph.vertices.count()
    base = (1 - damping) / max(n, 1)
    out = graph.edges.groupBy("src").agg(F.count("*").alias("_out"))
    links = written(graph.edges.join(out, "src").select("src", "dst", (F.lit(damping) / F.col("_out")).alias("share")), "pagerank-links")
    ids = graph.vertices.select("id")
    ranks = ids.withColumn("rank", F.lit(1.0 / max(n, 1)))
    for i in range(iterations):
        gave = ranks.join(links, F.col("id") == F.col("src")).select(F.col("dst").alias("id"), (F.col("rank") * F.col("share")).alias("got"))
        # one aggregation over the vertices and what they got, instead of an outer join
        ranks = gave.unionByName(ids.withColumn("got", F.lit(base))).groupBy("id").agg(F.sum("got").alias("rank"))
        if (i + 1) % cut_every == 0 and i + 1 < iterations:
            ranks = written(ranks, "pagerank")
    return ranks.join(ids, "id", "left_semi")


def shortest_paths(graph: PropertyGraph, source: int, weight: str | None = None, max_rounds: int = 1000) -> DataFrame:
    """(id, distance) of every vertex reached from ``source``; edges count 1, or their ``weight`` column (not negative)."""
    edges = graph.edges.select("src", "dst", (F.col(weight).cast("double") if weight else F.lit(1).cast("bigint")).alias("w"))
    zero = F.lit(0.0) if weight else F.lit(0).cast("bigint")
    found = written(graph.vertices.where(F.col("id") == F.lit(source)).select("id", zero.alias("distance")), "distances")
    front = found
    for _ in range(max_rounds):
        tried = front.join(edges, F.col("id") == F.col("src")).groupBy(F.col("dst").alias("id")).agg(F.min(F.col("distance") + F.col("w")).alias("distance"))
        known = found.select(F.col("id").alias("_id"), F.col("distance").alias("_known"))
        front = written(tried.join(known, F.col("id") == F.col("_id"), "left").where("_known is null or distance < _known").select("id", "distance"), "distances")
        if front.isEmpty():
            break
        found = found.unionByName(front)
        if weight:
            found = written(found.groupBy("id").agg(F.min("distance").alias("distance")), "distances")
    else:
        if not front.isEmpty():
            raise RuntimeError(f"shortest_paths: vertices are left after {max_rounds} rounds")
    return found


def triangles(graph: PropertyGraph) -> DataFrame:
    """(a, b, c) of every undirected triangle, once; self-loops and parallel edges don't count.

    Edges point from the vertex of lower degree to that of higher degree, so that a hub's
    many edges end at it and no vertex begins more than sqrt(2 * edges) of them.
    """
    pairs = graph.edges.where("src <> dst").select(F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y")).distinct()
    pairs = written(pairs, "pairs")
    degree = pairs.select(F.explode(F.array("x", "y")).alias("v")).groupBy("v").agg(F.count("*").alias("d"))
    both = pairs.join(degree.select(F.col("v").alias("x"), F.col("d").alias("dx")), "x").join(degree.select(F.col("v").alias("y"), F.col("d").alias("dy")), "y")
    x, y = (F.struct(F.col(f"d{c}").alias("degree"), F.col(c).alias("id")) for c in "xy")
    arcs = written(both.select(F.least(x, y)["id"].alias("low"), F.greatest(x, y)["id"].alias("high"), F.greatest(x, y).alias("rank")), "arcs")
    first, second = arcs.alias("p"), arcs.alias("q")
    wedges = first.join(second, (F.col("p.low") == F.col("q.low")) & (F.col("p.rank") < F.col("q.rank"))).select(F.col("p.low").alias("u"), F.col("p.high").alias("v"), F.col("q.high").alias("w"))
    closed = wedges.join(arcs, (F.col("v") == F.col("low")) & (F.col("w") == F.col("high")), "left_semi")
    s = F.array_sort(F.array("u", "v", "w"))
    return closed.select(s[0].alias("a"), s[1].alias("b"), s[2].alias("c"))


def triangle_count(graph: PropertyGraph) -> DataFrame:
    return triangles(graph).agg(F.count("*").alias("triangles"))


def vertex_count(graph: PropertyGraph) -> DataFrame:
    return graph.vertices.agg(F.count("*").alias("vertices"))


def edge_list(graph: PropertyGraph) -> DataFrame:
    return graph.edges.select("src", "dst", "edge_id")


def k_centres(graph: PropertyGraph, k: int, max_rounds: int = 75, patience: int = 2) -> DataFrame:
    """(id, centre, distance): vertices by their nearest of k centres, along edges of either direction.

    Centres begin as the k least ids; each round they move to the member with most
    neighbours in its cluster (least id on ties), until fewer than ``patience`` move.
    Ties in distance go to the least centre; vertices that no centre reaches are left out.
    """
    both = graph.symmetrize().edges.select("src", "dst").distinct()
    both = written(both, "both")
    centres = [r.id for r in graph.vertices.select("id").orderBy("id").limit(k).collect()]
    clusters = None
    for _ in range(max_rounds):
        spark = graph.vertices.sparkSession
        front = spark.createDataFrame([(c, c, 0) for c in centres], "id bigint, centre bigint, distance int")
        clusters = written(front, "clusters")
        depth = 0
        while not front.isEmpty():
            depth += 1
            near = front.join(both, F.col("id") == F.col("src")).groupBy(F.col("dst").alias("id")).agg(F.min("centre").alias("centre"))
            front = written(near.join(clusters.select("id"), "id", "left_anti").select("id", "centre", F.lit(depth).alias("distance")), "clusters")
            clusters = clusters.unionByName(front)
        inside = both.join(clusters.select(F.col("id").alias("src"), F.col("centre").alias("c1")), "src").join(clusters.select(F.col("id").alias("dst"), F.col("centre").alias("c2")), "dst").where("c1 = c2")
        inside = inside.groupBy(F.col("c1").alias("centre"), F.col("src").alias("id")).agg(F.count("*").alias("n"))
        best = {r.centre: r.best.id for r in inside.groupBy("centre").agg(F.max(F.struct("n", (-F.col("id")).alias("order"), "id")).alias("best")).collect()}  # k rows
        moved = [best.get(c, c) for c in centres]
        still = sum(a != b for a, b in zip(centres, moved)) < patience
        if still:
            break
        centres = sorted(set(moved))
    return clusters


def pregel(
    graph: PropertyGraph,
    initial: Column,
    message: Column,
    merge: Callable[[Column], Column],
    apply: Column,
    max_rounds: int = 20,
    along: str = "out",
    subgraphs: DataFrame | None = None,
    finish: Column | None = None,
    strict: bool = True,
) -> DataFrame:
    """(id, state): vertex programs as columns, until no vertex gets a message or changes.

    ``initial`` is over the vertices. Each round every active vertex sends ``message``
    (over ``state`` and the edge's columns; null sends nothing), the receiver's messages
    are merged by the aggregate ``merge``, and ``apply`` (over ``state`` and ``message``)
    gives its new state. Vertices whose state changes are active in the next round.

    ``along``: who gets a message. ``out``, ``in`` or ``both``: those at the other end of
    such an edge; ``all``: every vertex; ``subgraphs``: every vertex of each subgraph that
    an edge of the sender's subgraph leads to, with ``subgraphs`` as (id, subgraph_id).
    For the last two messages are over ``state`` alone, and are merged before they are
    sent, so ``merge`` has to be associative, like min, max and sum.

    ``finish`` (over ``id`` and ``state``) is applied to the settled states. ``strict``:
    it is an error if states still change after ``max_rounds``; else they are returned.
    """
    if along not in ("out", "in", "both", "all", "subgraphs"):
        raise ValueError("along is out, in, both, all or subgraphs")
    states = written(graph.vertices.select("id", initial.alias("state")), "pregel")
    edges = {"out": graph, "in": graph.reverse(), "both": graph.symmetrize()}.get(along, graph).edges
    if along == "subgraphs":
        groups = subgraphs.select("id", "subgraph_id")
        side = lambda end: groups.select(F.col("id").alias(f"_{end}"), F.col("subgraph_id").alias(f"{end}_group"))
        links = graph.edges.join(side("src"), F.col("src") == F.col("_src")).join(side("dst"), F.col("dst") == F.col("_dst"))
        links = written(links.where("src_group <> dst_group").select("src_group", "dst_group").distinct(), "pregel-links")

    def received(active: DataFrame) -> DataFrame:
        """(to, message) of the round."""
        if along == "all":
            one = active.select(message.alias("message")).where("message is not null").agg(merge(F.col("message")).alias("message")).where("message is not null")
            return states.select(F.col("id").alias("to")).join(F.broadcast(one), F.lit(True))  # one row
        if along == "subgraphs":
            own = active.join(groups, "id").select("subgraph_id", message.alias("message")).where("message is not null").groupBy("subgraph_id").agg(merge(F.col("message")).alias("message"))
            to = own.join(links, F.col("subgraph_id") == F.col("src_group")).groupBy("dst_group").agg(merge(F.col("message")).alias("message"))
            return groups.join(to, F.col("subgraph_id") == F.col("dst_group")).select(F.col("id").alias("to"), "message")
        sent = active.join(edges, F.col("id") == F.col("src")).select(F.col("dst").alias("to"), message.alias("message")).where("message is not null")
        return sent.groupBy("to").agg(merge(F.col("message")).alias("message"))

    active = states
    for _ in range(max_rounds):
        after = states.join(received(active), F.col("id") == F.col("to"), "left")
        after = after.select("id", F.when(F.col("to").isNull(), F.col("state")).otherwise(apply).alias("state"), F.col("state").alias("before"))
        after = written(after, "pregel")
        active = after.where(~F.col("state").eqNullSafe(F.col("before"))).select("id", "state")
        states = after.select("id", "state")
        if active.isEmpty():
            break
    else:
        if strict and not active.isEmpty():
            raise RuntimeError(f"pregel: states still change after {max_rounds} rounds")
    return states if finish is None else states.select("id", finish.alias("state"))
