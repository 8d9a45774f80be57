"""Readers of graph text formats, all as DataFrame expressions over lines.

Each gives a ``PropertyGraph``. Vertices that only occur as sinks get rows too. Edge ids
that a format lacks are decimals made of the line's source and the sink's place in it, so
they are the same however the file is split, and no two sources share one; a source has
one line (``PropertyGraph.check`` tells of ids that repeat). Lines that a format can't
have are left out; ``malformed`` returns them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.prefix import sum_before
from ..operators.graph import PropertyGraph

_IDS = "array<bigint>"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("value")).where("value <> ''")


def _numbers(value: Column) -> Column:
    return F.split(value, r"\s+").cast(_IDS)


def _with_sinks(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Vertices, and a bare row for each sink that has none."""
    sinks = edges.select(F.col("dst").alias("id")).distinct().join(vertices.select("id"), "id", "left_anti")
    return vertices.unionByName(sinks, allowMissingColumns=True)


def edge_number(source: Column, place: Column) -> Column:
    """An id for the edge at a place of its source's line: the source's digits and twelve of the place."""
    return F.concat(source.cast("string"), F.lpad(place.cast("string"), 12, "0")).cast("decimal(38,0)")


def malformed(spark: SparkSession, path: str, form: str) -> DataFrame:
    """Lines that a reader leaves out or can't read: ``form`` is json, adjacency or delimited."""
    lines = _lines(spark, path)
    if form == "json":
        return lines.where(F.from_json("value", "array<string>").isNull() & ~F.col("value").rlike(r"^\d+$"))
    if form == "adjacency":
        return lines.where(~F.col("value").rlike(r"^-?\d+(\s+-?\d+)*$"))
    if form == "delimited":
        return lines.select(F.explode(F.split("value", r"\|")).alias("value")).where("trim(value) <> ''").where(~F.col("value").rlike(r"^\s*-?\d+#-?\d+@"))
    raise ValueError("form is json, adjacency or delimited")


def read_adjacency(spark: SparkSession, path: str, partitioned: bool = False) -> PropertyGraph:
    """``src sink sink ...``, or ``src partition sink ...``."""
    rows = _lines(spark, path).select(_numbers(F.col("value")).alias("n"))
    first = 3 if partitioned else 2
    sinks = F.slice("n", first, F.greatest(F.size("n") - (first - 1), F.lit(0)))
    extra = [F.col("n")[1].cast("int").alias("partition_id")] if partitioned else []
    vertices = rows.select(F.col("n")[0].alias("id"), *extra).dropDuplicates(["id"])
    edges = rows.select(F.col("n")[0].alias("src"), F.posexplode(sinks).alias("place", "dst"))
    edges = edges.select("src", "dst", edge_number(F.col("src"), F.col("place")).alias("edge_id"))
    return PropertyGraph(_with_sinks(vertices, edges), edges)


_EDGE_ROWS = "array<array<string>>"


def _json_rows(lines: DataFrame) -> DataFrame:
    """Lines that are JSON arrays, as their elements' text."""
    return lines.select(F.from_json("value", "array<string>").alias("r")).where("r is not null")


def read_json(spark: SparkSession, path: str) -> PropertyGraph:
    """``[src, partition, value, [[sink, edge id, value], ...]]``; values as property ``value``."""
    rows = _json_rows(_lines(spark, path))
    rows = rows.select(F.col("r")[0].cast("bigint").alias("id"), F.col("r")[1].cast("int").alias("partition_id"), F.col("r")[2].alias("value"), F.from_json(F.col("r")[3], _EDGE_ROWS).alias("e"))
    edges = rows.select(F.col("id").alias("src"), F.explode("e").alias("e")).select("src", F.col("e")[0].cast("bigint").alias("dst"), F.col("e")[1].cast("bigint").alias("edge_id"), F.col("e")[2].alias("value"))
    return PropertyGraph(_with_sinks(rows.drop("e"), edges), edges)


def read_full_info(spark: SparkSession, path: str) -> PropertyGraph:
    """``partition vertex subgraph (sink sink-subgraph sink-partition)*``, with blanks or tabs."""
    rows = _lines(spark, path).select(_numbers(F.col("value")).alias("n"))
    vertices = rows.select(F.col("n")[1].alias("id"), F.col("n")[0].cast("int").alias("partition_id"), F.col("n")[2].alias("subgraph_id"))
    count = F.floor((F.size("n") - 3) / 3).cast("int")
    triples = F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(F.get("n", 3 + 3 * i).alias("dst"), F.get("n", 4 + 3 * i).alias("dst_subgraph_id"), F.get("n", 5 + 3 * i).cast("int").alias("dst_partition_id"))))
    edges = rows.select(F.col("n")[1].alias("src"), F.posexplode(triples).alias("place", "t"))
    edges = edges.select("src", "t.dst", edge_number(F.col("src"), F.col("place")).alias("edge_id"), "t.dst_subgraph_id", "t.dst_partition_id")
    sinks = edges.select(F.col("dst").alias("id"), F.col("dst_partition_id").alias("partition_id"), F.col("dst_subgraph_id").alias("subgraph_id")).dropDuplicates(["id"]).join(vertices.select("id"), "id", "left_anti")
    return PropertyGraph(vertices.unionByName(sinks), edges)


def _pairs(text: Column, between: str, inside: str, missing: str | None) -> Column:
    """``k<inside>v<between>k<inside>v`` as a map; a pair without a value has ``missing``, or is left out."""
    # the separators are plain text; what lies between key and value may be a type
    parts = F.filter(F.split(text, between), lambda p: p != "")
    pairs = F.transform(parts, lambda p: F.struct(F.regexp_extract(p, f"^(.*?)(?:{inside}|$)", 1).alias("k"), F.when(p.rlike(inside), F.regexp_replace(p, f"^.*?{inside}", "")).otherwise(F.lit(missing)).alias("v")))
    return F.map_from_entries(F.array_distinct(F.filter(pairs, lambda p: p["v"].isNotNull())))


def read_key_values(
    spark: SparkSession,
    path: str,
    properties: list[str] | None = None,
    edge_properties: list[str] | None = (),
    between: str = r"\$",
    inside: str = r":[A-Za-z]*:",
    missing: str | None = None,
    single_subgraph: bool = False,
) -> PropertyGraph:
    """``[vertex, "k:type:v$k:type:v", [[sink, edge id, "k:type:v$..."], ...]]``; a first line may name the partition.

    ``properties`` become columns and the rest is not kept; None keeps all, as a map
    ``props``. ``edge_properties`` likewise; empty (the default) keeps none. ``between``
    and ``inside`` are the patterns between pairs and between key and value; ``missing``
    stands for a value that a pair lacks. One file is one partition: with a line that is
    a bare number, its vertices have that ``partition_id``; ``single_subgraph`` makes the
    partition one subgraph.
    """
    lines = spark.read.text(path).select(F.trim("value").alias("value"), F.col("_metadata.file_path").alias("file")).where("value <> ''")
    heads = lines.where(F.col("value").rlike(r"^\d+$")).select("file", F.col("value").cast("int").alias("partition_id"))
    rows = lines.where(~F.col("value").rlike(r"^\d+$")).join(heads, "file", "left").select("partition_id", F.from_json("value", "array<string>").alias("r")).where("r is not null")
    rows = rows.select("partition_id", F.col("r")[0].cast("bigint").alias("id"), _pairs(F.col("r")[1], between, inside, missing).alias("props"), F.from_json(F.col("r")[2], _EDGE_ROWS).alias("e"))

    def kept(names) -> list[Column]:
        return [F.col("props")] if names is None else [F.col("props")[n].alias(n) for n in names]

    where = [F.col("partition_id")] + ([F.shiftleft(F.col("partition_id").cast("bigint"), 32).alias("subgraph_id")] if single_subgraph else [])
    vertices = rows.select("id", *where, *kept(properties))
    edges = rows.select(F.col("id").alias("src"), F.explode("e").alias("e")).select("src", F.col("e")[0].cast("bigint").alias("dst"), F.col("e")[1].cast("bigint").alias("edge_id"), _pairs(F.coalesce(F.col("e")[2], F.lit("")), between, inside, missing).alias("props"))
    edges = edges.select("src", "dst", "edge_id", *kept(edge_properties))
    return PropertyGraph(_with_sinks(vertices, edges), edges)


def read_key_values_tagged(spark: SparkSession, path: str, properties: list[str] | None = None, edge_properties: list[str] | None = None, **options) -> PropertyGraph:
    """Key values with the separators ``$:$`` and ``:String:``; edge properties are kept."""
    return read_key_values(spark, path, properties, edge_properties, between=r"\$:\$", inside=":String:", **options)


def read_delimited(spark: SparkSession, vertex_path: str, edge_path: str | None, properties: list[str], in_edge_path: str | None = None) -> PropertyGraph:
    r"""Delimited records: vertices ``subgraph#id@p1$p2|``, adjacency ``subgraph#id@locals%sink:sink|``.

    Later properties may be separated by ``^`` or ``*`` as well. ``in_edge_path`` has
    ``subgraph#id@locals%source:source|`` records; their edges join those of ``edge_path``.
    """
    def records(path: str, names: str) -> DataFrame:
        raw = spark.read.text(path).select(F.explode(F.split("value", r"\|")).alias("r")).where("trim(r) <> ''")
        return raw.select(*(F.regexp_extract("r", r"^\s*(-?\d+)#(-?\d+)@(.*)$", i + 1).alias(n) for i, n in enumerate(("subgraph_id", "id", names))))

    v = records(vertex_path, "values")
    parts = F.split("values", r"[$^*]")
    vertices = v.select(F.col("id").cast("bigint").alias("id"), F.shiftright(F.col("subgraph_id").cast("bigint"), 32).cast("int").alias("partition_id"), F.col("subgraph_id").cast("bigint").alias("subgraph_id"), *(F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(properties)))
    edges = None
    for path, near, far in ((edge_path, "src", "dst"), (in_edge_path, "dst", "src")):
        if path is None:
            continue
        e = records(path, "sinks").select(F.col("id").cast("bigint").alias(near), F.posexplode(F.filter(F.split(F.regexp_replace("sinks", r"^\d*%", ""), ":"), lambda x: x != "")).alias("place", far))
        e = e.select(near, F.col(far).cast("bigint").alias(far), "place")
        edges = e if edges is None else edges.unionByName(e.join(edges.select("src", "dst"), ["src", "dst"], "left_anti"))
    if edges is None:
        edges = spark.createDataFrame([], "src bigint, dst bigint, place int")
    edges = edges.select("src", "dst", edge_number(F.col("src"), F.col("place")).alias("edge_id"))
    return PropertyGraph(_with_sinks(vertices, edges), edges)


def read_property_files(spark: SparkSession, files: dict[str, str], edge_path: str) -> PropertyGraph:
    """One file of ``subgraph#id@value|`` records for each property, and one of adjacency records."""
    graph = None
    for name, path in files.items():
        part = read_delimited(spark, path, None, [name]).vertices
        graph = part if graph is None else graph.join(part.select("id", name), "id", "full_outer")
    edges = read_delimited(spark, next(iter(files.values())), edge_path, []).edges
    return PropertyGraph(_with_sinks(graph, edges), edges)


def _numbered(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(index, name): ``|``-terminated records in the order of files by name and of places in them, numbered from 0 by ranges."""
    lines = spark.read.text(path).select(F.regexp_replace("value", r"\|\s*$", "").alias("value"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"))
    records = lines.select("_file", "_block", "_line", F.posexplode(F.split("value", r"\|")).alias("_place", name)).withColumn("_one", F.lit(1).cast("bigint"))
    return sum_before(records, "_one", "_file", "_block", "_line", "_place", out="index").select("index", name)


def read_implicit(spark: SparkSession, files: dict[str, str], edge_path: str, id_name: str = "vid") -> PropertyGraph:
    """One file of ``value|`` records for each property, and one of ``locals%sink:sink|`` records.

    Records say nothing of whom they belong to: those of the same number in all files are
    one vertex, whose id is in the file ``id_name``.
    """
    ids = _numbered(spark, files[id_name], id_name).select("index", F.col(id_name).cast("bigint").alias("id"))
    rows = ids
    for name, path in files.items():
        if name != id_name:
            rows = rows.join(_numbered(spark, path, name), "index", "left")
    sinks = ids.join(_numbered(spark, edge_path, "sinks"), "index").select("id", F.posexplode(F.filter(F.split(F.regexp_replace("sinks", r"^\d*%", ""), ":"), lambda x: x != "")).alias("place", "dst"))
    edges = sinks.select(F.col("id").alias("src"), F.col("dst").cast("bigint").alias("dst"), edge_number(F.col("id"), F.col("place")).alias("edge_id"))
    return PropertyGraph(_with_sinks(rows.drop("index"), edges), edges)


def read_tables(spark: SparkSession, path: str) -> PropertyGraph:
    """A graph that ``write_tables`` wrote: Parquet, one column for each property."""
    return PropertyGraph(spark.read.parquet(f"{path}/vertices"), spark.read.parquet(f"{path}/edges"))


def read_queries(spark: SparkSession, path: str) -> list[str]:
    """One query a line; a batch is small and comes to the driver."""
    return [r.value.strip() for r in spark.read.text(path).collect() if r.value.strip()]


def random_graph(spark: SparkSession, vertices: int, edges: int, seed: int = 1) -> PropertyGraph:
    """Uniform random edges; the same for a seed, however it is partitioned."""
    at = lambda k: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), F.col("edge_id")), F.lit(vertices))
    e = spark.range(edges).select(F.col("id").alias("edge_id"))
    return PropertyGraph(spark.range(vertices), e.select(at(1).alias("src"), at(2).alias("dst"), "edge_id"))
