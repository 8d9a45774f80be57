"""Paths as text: V:1-->E:10-->V:2, and V:2<--E:10<--V:1 against an edge's direction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.query import OUT


def start_text(vertex: Column) -> Column:
    return F.concat(F.lit("V:"), vertex.cast("string"))


def hop_text(edge: Column, vertex: Column, direction: str = OUT) -> Column:
    arrow = "-->" if direction == OUT else "<--"
    return F.concat(F.lit(f"{arrow}E:"), edge.cast("string"), F.lit(f"{arrow}V:"), vertex.cast("string"))


def path_text(vertices: list[Column], edges: list[Column], directions: list[str]) -> Column:
    hops = [hop_text(e, v, d) for e, v, d in zip(edges, vertices[1:], directions)]
    return F.concat(start_text(vertices[0]), *hops) if hops else start_text(vertices[0])
