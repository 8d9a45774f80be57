"""Where to start: cost models of path patterns and reachability, and their statistics.

The planner asks for the statistics of the literals in a query, nothing else, and works
on these few numbers. The start never changes a result, only how it is reached.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .query import OUT, PathQuery, Predicate, ReachQuery


@dataclass(frozen=True)
class Coefficients:
    """Weights of the cost terms. ``scan`` is the price of finding start vertices per vertex; None: one in all."""

    network: float = 0.116
    vertex: float = 1.0
    edge: float = 1.0
    join: float = 1.0
    scan: float | None = None
    wildcard_network: bool = False
    join_at_ends: bool = False


#: Calibrations of the cost model for different stores.
PRESETS = {
    "default": Coefficients(),
    "calibrated": Coefficients(network=0.006514, vertex=0.00217, edge=0.0, join=0.0000278, scan=0.000731),
    "fixed-start": Coefficients(network=49.57),
    "undirected": Coefficients(network=49.57, join=1.678451, scan=0.00808, wildcard_network=True),
    "undirected-columns": Coefficients(network=2.44, join=0.1, scan=0.0105, wildcard_network=True),
    "undirected-fixed": Coefficients(network=2.44, join=58.0, scan=0.0105, wildcard_network=True),
    "undirected-lists": Coefficients(network=0.0037, join=0.1, scan=0.0105, wildcard_network=True),
    "in-edges": Coefficients(network=0.01, join=0.0, scan=0.000808),
}


@dataclass
class Numbers:
    """What is known of one vertex predicate: its share and the mean degrees of its vertices."""

    probability: float
    out: float
    into: float
    remote_out: float = 0.0
    remote_into: float = 0.0

    def degree(self, outward: bool) -> tuple[float, float]:
        """(local, remote) mean degree."""
        return (self.out - self.remote_out, self.remote_out) if outward else (self.into - self.remote_into, self.remote_into)


@dataclass
class GraphStats:
    """Statistics of a query's literals; unknown literals are absent."""

    vertices: int
    edges: int
    remote_edges: int = 0
    vertex: dict[tuple[str, str], Numbers] = field(default_factory=dict)
    edge: dict[tuple[str, str], float] = field(default_factory=dict)
    exact: bool = True

    def anywhere(self) -> Numbers:
        v = max(self.vertices, 1)
        return Numbers(1.0, self.edges / v, self.edges / v, self.remote_edges / v, self.remote_edges / v)

    def of(self, predicate: Predicate | None) -> Numbers | None:
        return self.anywhere() if predicate is None else self.vertex.get((predicate.name, predicate.text))

    def share(self, predicate: Predicate | None) -> float | None:
        return 1.0 if predicate is None else self.edge.get((predicate.name, predicate.text))


def literals(query: PathQuery | ReachQuery) -> tuple[list[Predicate], list[Predicate]]:
    """Vertex and edge predicates of a query."""
    if isinstance(query, ReachQuery):
        return [query.source, query.sink], []
    return [p for p in query.vertices if p], [e.predicate for e in query.edges if e.predicate]


def collect_stats(graph, query: PathQuery | ReachQuery, partitions: int = 1) -> GraphStats:
    """Exact statistics of the query's literals, counted on the graph."""
    from ..operators import stats as S

    vertex, edge = (list(dict.fromkeys(ps)) for ps in literals(query))
    totals, of_vertices, of_edges = S.literal_statistics(graph, vertex, edge, partitions)
    found = GraphStats(*totals)
    for p, (n, *degrees) in zip(vertex, of_vertices):
        if n:
            found.vertex[p.name, p.text] = Numbers(n / max(totals[0], 1), *(d / n for d in degrees))
    for p, n in zip(edge, of_edges):
        if n:
            found.edge[p.name, p.text] = n / max(totals[1], 1)
    return found


def _is(p: Predicate):
    """Rows of a statistics table that a literal asks for: by text, and numbers by value."""
    same = F.col("value") == p.text
    if p.number is not None:
        same = same | (F.expr("try_cast(value as double)") == float(p.number))
    return (F.col("property") == p.name) & same


def lookup_stats(totals: tuple[int, int, int], vertex_stats: DataFrame, edge_stats: DataFrame | None, query: PathQuery | ReachQuery) -> GraphStats:
    """Statistics of the query's literals from stored tables (see ``vertex_statistics``)."""
    vertex, edge = (list(dict.fromkeys(ps)) for ps in literals(query))
    found = GraphStats(*totals)

    def rows(table: DataFrame, ps: list[Predicate]):
        asked = F.filter(F.array(*(F.when(_is(p), F.lit(i)) for i, p in enumerate(ps))), lambda x: x.isNotNull())
        return table.withColumn("_asked", F.explode(asked)).collect()  # one row for each literal

    if vertex:
        for r in rows(vertex_stats, vertex):
            p = vertex[r._asked]
            found.vertex[p.name, p.text] = Numbers(r.probability, r.avg_out, r.avg_in, r.avg_remote_out, r.avg_remote_in)
    if edge and edge_stats is not None:
        for r in rows(edge_stats, edge):
            p = edge[r._asked]
            found.edge[p.name, p.text] = r.probability
    return found


def histogram_stats(totals: tuple[int, int, int], vertex_bins: DataFrame, edge_bins: DataFrame | None, query: PathQuery | ReachQuery) -> GraphStats:
    """As ``lookup_stats``, from equi-depth histograms; literals outside every bin are unknown."""
    vertex, edge = literals(query)
    found = GraphStats(*totals, exact=False)

    def bins(table: DataFrame, p: Predicate):
        return table.where((F.col("property") == p.name) & (F.col("first") <= p.text) & (F.col("last") >= p.text)).first()

    for p in vertex:
        r = bins(vertex_bins, p)
        if r is not None:
            found.vertex[p.name, p.text] = Numbers(r.probability, r.avg_out, r.avg_in, r.avg_remote_out, r.avg_remote_in)
    for p in edge if edge_bins is not None else []:
        r = bins(edge_bins, p)
        if r is not None:
            found.edge[p.name, p.text] = r.probability
    return found


# --------------------------------------------------------------------------- path patterns


def _half(query: PathQuery, start: int, forward: bool, stats: GraphStats, c: Coefficients, undirected: bool) -> tuple[float, float] | None:
    """(cost, matches) of growing from a vertex step to one end; None where a literal is unknown."""
    scanned = matches = float(stats.vertices)
    cost, at = 0.0, start
    while True:
        numbers = stats.of(query.vertices[at])
        if numbers is None:
            return None
        matches *= numbers.probability
        if at == (len(query.edges) if forward else 0):
            return cost, matches
        step = query.edges[at if forward else at - 1]
        local, remote = numbers.degree(forward == (undirected or step.direction == OUT))
        share = stats.share(step.predicate)
        if share is None:
            return None
        matches *= (local + remote) * share
        edges = scanned * numbers.probability * (local + remote)
        arrived = edges * share
        crossing = c.network * scanned * numbers.probability * remote * share if step.predicate or c.wildcard_network else 0.0
        cost += c.edge * edges + c.vertex * arrived + crossing
        scanned = arrived
        at += 1 if forward else -1


def path_costs(query: PathQuery, stats: GraphStats, coefficients: Coefficients | str = "default", undirected: bool = False) -> list[float | None]:
    """The cost of each start vertex step; None where a literal is unknown."""
    c = PRESETS[coefficients] if isinstance(coefficients, str) else coefficients
    out: list[float | None] = []
    for s in range(len(query.vertices)):
        forward, back = _half(query, s, True, stats, c, undirected), _half(query, s, False, stats, c, undirected)
        if forward is None or back is None:
            out.append(None)
            continue
        inner = 0 < s < len(query.vertices) - 1
        join = c.join * forward[1] * back[1] if inner or c.join_at_ends else 0.0
        seek = 1.0 if c.scan is None else c.scan * stats.vertices
        if query.vertices[s] is None:
            seek = max(seek, float(stats.vertices))  # every vertex is a start
        out.append(forward[0] + back[0] + join + seek)
    return out


def choose_start(query: PathQuery, stats: GraphStats, coefficients: Coefficients | str = "default", undirected: bool = False) -> int:
    """The cheapest start vertex step, the first of equals; a start given in the query stands."""
    if query.start is not None:
        return query.start
    known = [(c, s) for s, c in enumerate(path_costs(query, stats, coefficients, undirected)) if c is not None]
    return min(known)[1] if known else 0


def impossible(query: PathQuery | ReachQuery, stats: GraphStats) -> bool:
    """Whether exact statistics show that a literal occurs nowhere."""
    if not stats.exact:
        return False
    vertex, edge = literals(query)
    ids = [p for p in vertex if p.name == "vid"]
    return any(stats.of(p) is None for p in vertex if p not in ids) or any(stats.share(p) is None for p in edge)


def explain(query: PathQuery, stats: GraphStats, coefficients: Coefficients | str = "default", undirected: bool = False) -> str:
    """One line for each start position (as in the query language: even numbers)."""
    costs = path_costs(query, stats, coefficients, undirected)
    best = choose_start(query, stats, coefficients, undirected)
    lines = [f"position {2 * s}: " + ("unknown literal" if c is None else f"cost {c:.6g}") + (" <- start" if s == best else "") for s, c in enumerate(costs)]
    return "\n".join(lines)


# --------------------------------------------------------------------------- reachability


def reach_costs(query: ReachQuery, stats: GraphStats, coefficients: Coefficients | str = "calibrated") -> tuple[float | None, float | None]:
    """The cost of the first step from the sources, and from the sinks."""
    c = PRESETS[coefficients] if isinstance(coefficients, str) else coefficients

    def side(p: Predicate, outward: bool) -> float | None:
        numbers = stats.of(p)
        if numbers is None:
            return None
        local, remote = numbers.degree(outward)
        return stats.vertices * numbers.probability * ((local + remote) * c.edge + c.network * remote) + (c.scan or 0.0) * stats.vertices

    return side(query.source, True), side(query.sink, False)


def choose_side(query: ReachQuery, stats: GraphStats, coefficients: Coefficients | str = "calibrated") -> int:
    """0: from the sources, 1: from the sinks; the cheaper, the sinks on a tie."""
    if query.side is not None:
        return query.side
    forward, back = reach_costs(query, stats, coefficients)
    if forward is None or back is None:
        return 0 if back is None else 1
    return 0 if forward < back else 1
