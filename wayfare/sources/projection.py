"""A property graph over relational tables: orders, parts and who trades them.

Vertex ids are kind * 10^12 + key, edge ids number * 10^18 + a * 10^8 + b, where a and b
are the two keys; keys that don't fit are an error, never another edge's id. With
``wide`` edge ids are decimals of 38 digits, number * 10^36 + a * 10^18 + b, which hold
all keys. Kinds, properties and labels are literals of each branch of a union, so a query
that asks for one label or one kind reads only the tables behind it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import PropertyGraph

#: Numbers of vertex kinds and edge labels.
KINDS = {"region": 1, "nation": 2, "customer": 3, "supplier": 4, "part": 5, "order": 6}
PROPERTIES = ("kind", "name", "mktsegment", "orderpriority", "orderstatus", "brand", "type")


def vertex_id(kind: str, key: Column) -> Column:
    return F.lit(KINDS[kind] * 10**12).cast("bigint") + key.cast("bigint")


def edge_id(number: int, a: Column, b: Column, wide: bool = False) -> Column:
    a, b = a.cast("bigint"), b.cast("bigint")
    if wide:
        digits = lambda c: F.lpad(c.cast("string"), 18, "0")
        return F.concat(F.lit(str(number)), digits(a), digits(b)).cast("decimal(38,0)")
    packed = F.lit(number * 10**18).cast("bigint") + a * F.lit(10**8).cast("bigint") + b
    return F.when((a < 10**10) & (b < 10**8), packed).otherwise(F.raise_error(F.lit("keys are too large for edge ids of 64 bits: ask for wide ones")).cast("bigint"))


def trade_graph(spark: SparkSession, sf_dir: str, ships: bool = False, wide: bool = False) -> PropertyGraph:
    """The graph of region, nation, customer, supplier, part, order; with ``ships`` also orders to suppliers."""
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")

    def vertices(kind: str, table: DataFrame, key: str, **columns: str) -> DataFrame:
        given = {"kind": F.lit(kind), **{p: F.col(c).cast("string") for p, c in columns.items()}}
        return table.select(vertex_id(kind, F.col(key)).alias("id"), *(given.get(p, F.lit(None).cast("string")).alias(p) for p in PROPERTIES))

    every = [
        vertices("region", t("region"), "r_regionkey", name="r_name"),
        vertices("nation", t("nation"), "n_nationkey", name="n_name"),
        vertices("customer", t("customer"), "c_custkey", name="c_name", mktsegment="c_mktsegment"),
        vertices("supplier", t("supplier"), "s_suppkey", name="s_name"),
        vertices("part", t("part"), "p_partkey", name="p_name", brand="p_brand", type="p_type"),
        vertices("order", t("orders"), "o_orderkey", orderpriority="o_orderpriority", orderstatus="o_orderstatus"),
    ]

    def edges(number: int, label: str, table: DataFrame, source: str, a: str, target: str, b: str, returnflag: Column | None = None) -> DataFrame:
        return table.select(
            vertex_id(source, F.col(a)).alias("src"), vertex_id(target, F.col(b)).alias("dst"), edge_id(number, F.col(a), F.col(b), wide).alias("edge_id"),
            F.lit(label).alias("label"), (returnflag if returnflag is not None else F.lit(None).cast("string")).alias("returnflag"),
        )

    items = t("lineitem")
    contains = items.groupBy("l_orderkey", "l_partkey").agg(F.min("l_returnflag").alias("returnflag"))
    links = [
        edges(1, "IN_REGION", t("nation"), "nation", "n_nationkey", "region", "n_regionkey"),
        edges(2, "FROM", t("customer"), "customer", "c_custkey", "nation", "c_nationkey"),
        edges(3, "FROM", t("supplier"), "supplier", "s_suppkey", "nation", "s_nationkey"),
        edges(4, "PLACED", t("orders"), "customer", "o_custkey", "order", "o_orderkey"),
        edges(5, "CONTAINS", contains, "order", "l_orderkey", "part", "l_partkey", F.col("returnflag")),
        edges(6, "SUPPLIES", items.select("l_suppkey", "l_partkey").distinct(), "supplier", "l_suppkey", "part", "l_partkey"),
    ]
    if ships:
        links.append(edges(7, "SHIPS_FROM", items.select("l_orderkey", "l_suppkey").distinct(), "order", "l_orderkey", "supplier", "l_suppkey"))
    v, e = every[0], links[0]
    for part in every[1:]:
        v = v.unionByName(part)
    for part in links[1:]:
        e = e.unionByName(part)
    return PropertyGraph(v, e)


def sales_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Orders and parts with numbers as properties: prices and sizes of parts, total prices of orders, quantities of lines."""
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    none = F.lit(None)
    parts = t("part").select(vertex_id("part", F.col("p_partkey")).alias("id"), F.col("p_retailprice").alias("price"), F.col("p_size").cast("int").alias("size"))
    orders = t("orders").select(vertex_id("order", F.col("o_orderkey")).alias("id"), F.col("o_totalprice").alias("price"), none.cast("int").alias("size"))
    lines = t("lineitem").groupBy("l_orderkey", "l_partkey").agg(F.max("l_quantity").alias("quantity"))
    edges = lines.select(vertex_id("order", F.col("l_orderkey")).alias("src"), vertex_id("part", F.col("l_partkey")).alias("dst"), edge_id(5, F.col("l_orderkey"), F.col("l_partkey")).alias("edge_id"), "quantity")
    return PropertyGraph(parts.unionByName(orders), edges)


def dialogue_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Turns of conversations, each leading to the next: long thin paths."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("bigint").alias("c"), F.col("turn").cast("bigint").alias("t"), "role").distinct()
    at = lambda t: F.col("c") * 1_000_000 + t
    v = turns.groupBy("c", "t").agg(F.min("role").alias("role"))
    known = v.select(F.col("c").alias("_c"), (F.col("t") - 1).alias("_t"))
    e = v.join(known, (F.col("c") == F.col("_c")) & (F.col("t") == F.col("_t"))).select(at(F.col("t")).alias("src"), at(F.col("t") + 1).alias("dst"), at(F.col("t")).alias("edge_id"), F.lit("NEXT").alias("label"))
    return PropertyGraph(v.select(at(F.col("t")).alias("id"), "role"), e)
