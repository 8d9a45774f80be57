"""Connected components by contraction along least neighbours.

Each round every node points to the least of itself and its neighbours. Pointers are
followed to their ends by doubling, which takes the logarithm of the longest way, and
edges are drawn anew between the ends; those within a component fall away. An end that
no other node shares has a lesser neighbour in the next round, so two rounds leave at
most half of the nodes, most often far fewer. Tables are written after each step, and those that nothing
reads again are removed. Neither a hub's edges nor the many that point to one end meet in
one task: small tables are sent whole, of large ones the rows of hot keys (``join_keyed``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import FEW_ROWS, forget, join_keyed, written


def _with_ends(rows: DataFrame, column: str, ends: DataFrame, few: bool) -> DataFrame:
    """``rows`` with ``column`` replaced by its end; ``ends`` has (node, up, n), n at least the rows of a node."""
    table = ends.select(F.col("node").alias(column), F.col("up").alias("_end"), F.col("n").alias("_n"))
    joined = rows.join(F.broadcast(table.drop("_n")), column) if few else join_keyed(rows, table, column, "_n").drop("_n")
    return joined.drop(column).withColumnRenamed("_end", column)


def _followed(pointers: DataFrame, few: bool, max_steps: int) -> DataFrame:
    """(node, up, n): pointers that lead to their ends."""
    for _ in range(max_steps):
        used = [pointers]
        if few:
            ahead = F.broadcast(pointers.select(F.col("node").alias("up"), F.col("up").alias("next")))
            joined = pointers.join(ahead, "up")
        else:
            counts = pointers.groupBy("up").agg(F.count("*").alias("_n"))
            ahead = written(counts.join(pointers.select(F.col("node").alias("up"), F.col("up").alias("next")), "up"), "pointers-ahead")
            used.append(ahead)
            joined = join_keyed(pointers, ahead, "up", "_n")
        longer = written(joined.select("node", F.col("next").alias("up"), "n", (F.col("next") != F.col("up")).alias("moved")), "pointers")
        moved = not longer.where("moved").isEmpty()
        forget(*used)
        pointers = longer
        if not moved:
            return pointers
    raise RuntimeError(f"pointers don't end after {max_steps} doublings")


def star_components(edges: DataFrame, max_steps: int = 100) -> DataFrame:
    """(a, b) edges between comparable ids of fixed width to (node, root): the least node of each component.

    Nodes without an edge to another node don't appear.
    """
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    labels = None
    for _ in range(max_steps):
        if edges.isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        pointers = written(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select(F.col("a").alias("node"), F.least("a", "m").alias("up"), "n"), "pointers")
        few = pointers.count() <= FEW_ROWS
        ends = _followed(pointers, few, max_steps)
        moved = _with_ends(_with_ends(edges, "a", ends, few), "b", ends, few).where("a <> b")
        left = written(moved.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
        if labels is None:
            labels = ends.select("node", F.col("up").alias("root"))
        else:
            step = ends.select(F.col("node").alias("root"), "up")
            if few:
                after = labels.join(F.broadcast(step), "root", "left")
            else:
                table = written(labels.groupBy("root").agg(F.count("*").alias("_n")).join(step, "root"), "label-steps")
                after = join_keyed(labels, table, "root", "_n", "left")
            labels = written(after.select("node", F.coalesce("up", "root").alias("root")), "labels")
        forget(edges)
        edges = left
    else:
        raise RuntimeError(f"star_components: edges are left after {max_steps} rounds")
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels
