"""The property graph: two DataFrames, and predicates over them."""

from __future__ import annotations

from dataclasses import dataclass, replace
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, DataType, DecimalType, DoubleType, FloatType, IntegerType, NumericType, ShortType

from ..plans.query import Predicate

#: What a missing property compares as.
MISSING = "n"


def _equals_number(column: Column, kind: DataType, number: Decimal) -> Column:
    """A numeric column against a number, by value and in the column's own type, so that it reaches the Parquet reader."""
    if isinstance(kind, (FloatType, DoubleType)):
        return column == F.lit(float(number)).cast(kind)
    if number != number.to_integral_value() and not isinstance(kind, DecimalType):
        return F.lit(False)
    if isinstance(kind, DecimalType):
        return column == F.lit(number)
    bits = {ByteType: 7, ShortType: 15, IntegerType: 31}.get(type(kind), 63)
    return column == F.lit(int(number)).cast(kind) if -(2**bits) <= number < 2**bits else F.lit(False)


@dataclass(frozen=True)
class PropertyGraph:
    """``vertices``: id, properties. ``edges``: src, dst, edge_id, properties; directed.

    A property is a column of its own, or an entry of a map column ``props``. Columns
    of their own are pruned and pushed down to the files; see ``promote``. A numeric
    column is compared with a literal of a numeric type by value, all else as text.
    """

    vertices: DataFrame
    edges: DataFrame
    missing: str = MISSING

    def __post_init__(self):
        for frame, names in ((self.vertices, ("id",)), (self.edges, ("src", "dst", "edge_id"))):
            lacking = [n for n in names if n not in frame.columns]
            if lacking:
                raise ValueError(f"columns {lacking} are missing")

    # ---- properties

    def property(self, frame: DataFrame, name: str) -> Column:
        """A property as text, null where it is missing."""
        if name in frame.columns:
            return F.col(f"`{name}`").cast("string")
        if "props" in frame.columns:
            return F.col("props")[name]
        return F.lit(None).cast("string")

    def condition(self, frame: DataFrame, predicate: Predicate | None) -> Column | None:
        """The predicate as a column, or None where everything passes. ``vid`` is a vertex's id."""
        if predicate is None:
            return None
        if predicate.name == "vid" and "id" in frame.columns and "vid" not in frame.columns:
            digits = predicate.text.strip()
            return F.col("id") == F.lit(int(digits)) if digits.lstrip("-").isdigit() else F.lit(False)
        if predicate.name in frame.columns and isinstance(frame.schema[predicate.name].dataType, NumericType) and predicate.number is not None:
            return _equals_number(F.col(f"`{predicate.name}`"), frame.schema[predicate.name].dataType, predicate.number)
        value = self.property(frame, predicate.name)
        # without coalesce where it can't matter: a bare comparison reaches the Parquet reader
        return F.coalesce(value, F.lit(self.missing)) == predicate.text if predicate.text == self.missing else value == predicate.text

    def vertices_where(self, predicate: Predicate | None) -> DataFrame:
        c = self.condition(self.vertices, predicate)
        return (self.vertices if c is None else self.vertices.where(c)).select("id")

    def edges_where(self, predicate: Predicate | None) -> DataFrame:
        c = self.condition(self.edges, predicate)
        return (self.edges if c is None else self.edges.where(c)).select("src", "dst", "edge_id")

    # ---- views

    def promote(self, vertex_properties: list[str] = (), edge_properties: list[str] = ()) -> PropertyGraph:
        """Entries of ``props`` as columns; the map itself goes, as it can't be read in part."""

        def of(frame: DataFrame, names) -> DataFrame:
            if "props" not in frame.columns:
                return frame
            return frame.select(*(c for c in frame.columns if c != "props"), *(F.col("props")[n].alias(n) for n in names if n not in frame.columns))

        return replace(self, vertices=of(self.vertices, vertex_properties), edges=of(self.edges, edge_properties))

    def reverse(self) -> PropertyGraph:
        other = {"src": "dst", "dst": "src"}
        return replace(self, edges=self.edges.select(*(F.col(f"`{other.get(c, c)}`").alias(c) for c in self.edges.columns)))

    def symmetrize(self) -> PropertyGraph:
        """Every edge in both directions, under its own id; self-loops once."""
        back = self.reverse().edges.where("src <> dst")
        return replace(self, edges=self.edges.unionByName(back))

    def simple(self) -> PropertyGraph:
        """One edge for each (src, dst): that of the least id."""
        first = self.edges.groupBy("src", "dst").agg(F.min_by(F.struct(*self.edges.columns), "edge_id").alias("e"))
        return replace(self, edges=first.select("e.*"))

    def within(self, groups: DataFrame) -> PropertyGraph:
        """Only edges whose ends have the same group, of (id, group)."""
        side = lambda end: groups.select(F.col("id").alias(f"_{end}"), F.col("group").alias(f"_{end}_group"))
        e = self.edges.join(side("src"), F.col("src") == F.col("_src")).join(side("dst"), F.col("dst") == F.col("_dst"))
        return replace(self, edges=e.where("_src_group = _dst_group").select(*self.edges.columns))

    def check(self) -> list[str]:
        """What is wrong with ids: repeated vertices, repeated edge ids, edges without a source vertex."""
        found = []
        for frame, key, what in ((self.vertices, "id", "vertex ids"), (self.edges, "edge_id", "edge ids")):
            if not frame.groupBy(key).count().where("count > 1").isEmpty():
                found.append(f"{what} repeat")
        if not self.edges.join(self.vertices, F.col("src") == F.col("id"), "left_anti").isEmpty():
            found.append("edges leave vertices that don't exist")
        return found
