"""N-gram Jaccard join: MinHash bands find candidates, full shingle sets decide.

Texts become sets of word n-grams (five words; words are runs without ASCII white
space; a text of one to four words is one n-gram). Two texts are linked if the Jaccard
similarity of their sets is at least the threshold.

1. Equal texts form a class; one of them stands for it from here on.
2. MinHash signatures are cut into bands; the number of bands and rows gives the target
   recall at the threshold. The shuffle is on the band's hash: classes with the same
   hash are a bucket, and pairs are candidates only if they share a bucket.
3. Buckets are cut into blocks of bounded size, and each pair of blocks of a bucket is
   one unit of work, so a hot bucket is spread over many tasks. A unit counts the common
   n-grams of its pairs by matrix products and returns one row for each text: its number
   of links, and the least text it is connected with inside the unit. A pair counts in
   the first band that it shares and in no other; a bucket whose members all share an
   earlier one is left out before anything is shuffled. Pairs are never written out.
4. Components of what the units return are the near-duplicate classes.

Defined results: rows of null text have no links; equal texts are linked even if empty;
texts of any length are compared by all their n-grams; a similarity of exactly the
threshold is a link; ``n_links`` counts rows, copies included; rows with the same id and
different texts are separate; a class is named by its least id that isn't null; other
columns of any name are ignored, or kept by ``keep_one``; an empty table
gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import star_components
from ..plans.tables import fresh, join_keyed
from ._common import Words, fixed_binary, mix, slices, small, texts, written

N, THRESHOLD, RECALL = 5, 0.8, 0.9995
#: Largest part of a bucket that meets itself or another part in one task: texts, and n-grams.
BLOCK_TEXTS, BLOCK_GRAMS = 250, 250_000


def choose_bands(threshold: float, recall: float, max_hashes: int = 100) -> tuple[int, int]:
    """(bands, rows): most rows, thus fewest chance candidates, that reach the recall in ``max_hashes`` hashes."""
    for rows in range(10, 0, -1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows <= max_hashes:
            return bands, rows
    raise ValueError("recall can't be reached")


def _signatures(bands: int, rows: int, n: int):
    rng = np.random.default_rng(20)
    factors = rng.integers(1, 1 << 62, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    offsets = rng.integers(0, 1 << 62, bands * rows, dtype=np.uint64)
    schema = pa.schema([("doc_id", pa.int64()), ("node", pa.binary()), ("grams", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                h, row, runs = Words(part.column(2)).windows(n)
                some = np.flatnonzero(runs)
                starts = np.cumsum(runs)[some] - runs[some]
                keys = np.zeros((len(some), bands), np.uint64)
                if len(some):
                    for b in range(bands):
                        key = np.full(len(some), b + 1, np.uint64)
                        for k in range(b * rows, (b + 1) * rows):
                            x = h * factors[k]
                            x += offsets[k]
                            x ^= x >> np.uint64(32)
                            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(x, starts))
                        keys[:, b] = key
                counts = np.zeros(part.num_rows, np.int64)
                counts[some] = bands
                offs = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(keys.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(1).cast(pa.binary()), pa.array(runs.astype(np.int64)), lists], schema=schema)

    return run


def _gram_sets(n: int):
    """(node, text) to (node, n-grams as sorted distinct 64-bit hashes)."""
    schema = pa.schema([("node", pa.binary()), ("grams", pa.binary())])

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                h, row, _ = Words(part.column(1)).windows(n)
                order = np.lexsort((h, row))
                h, row = h[order], row[order]
                fresh_one = np.ones(len(h), bool)
                fresh_one[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
                h, row = h[fresh_one], row[fresh_one]
                cuts = np.searchsorted(row, np.arange(part.num_rows + 1))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.binary()), fixed_binary(h, cuts)], schema=schema)

    return run


def link_matrix(sets: list[np.ndarray], threshold: float, left: int | None = None) -> np.ndarray:
    """Which pairs of sets reach the threshold; with ``left``, only pairs of one of the first ``left`` and a later one."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.float64)
    owner = np.repeat(np.arange(m), sizes.astype(np.int64))
    values = np.concatenate(sets) if m else np.zeros(0, np.uint64)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    first = np.ones(len(values), bool)
    first[1:] = values[1:] != values[:-1]
    column = np.cumsum(first) - 1
    shared = np.bincount(column)[column] > 1 if len(column) else np.zeros(0, bool)  # n-grams of one text alone make no pair
    owner, column = owner[shared], column[shared]
    if len(column):
        column = np.cumsum(np.r_[0, np.diff(column) != 0])
    common = np.zeros((m, m), np.float32)
    step = 2048
    if len(column):
        for a in range(0, int(column[-1]) + 1, step):
            lo, hi = np.searchsorted(column, (a, a + step))
            x = np.zeros((m, min(step, int(column[-1]) + 1 - a)), np.float32)
            x[owner[lo:hi], column[lo:hi] - a] = 1
            common += x @ x.T
    links = common.astype(np.float64) * (1 + threshold) >= threshold * (sizes[:, None] + sizes[None, :]) - 1e-9
    links &= common > 0
    np.fill_diagonal(links, False)
    if left is not None:
        links[:left, :left] = False
        links[left:, left:] = False
    return links


def _least_connected(links: np.ndarray) -> np.ndarray:
    """Each row's least connected row."""
    label = np.arange(len(links))
    while True:
        new = label.copy()
        for i in np.flatnonzero(links.any(axis=1)):
            new[i] = min(new[i], new[links[i]].min())
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _verify(threshold: float):
    schema = pa.schema([("node", pa.binary()), ("least", pa.int64()), ("root_node", pa.binary()), ("root_least", pa.int64()), ("links", pa.int64())])

    def unit(rows: list[tuple]) -> pa.RecordBatch:
        key, a, b = rows[0][:3]
        # the first block's texts, then the second's, each by id
        rows.sort(key=lambda r: (r[3] != a, r[5] is None, r[5] or 0, r[4]))
        left = None if a == b else sum(r[3] == a for r in rows)
        links = link_matrix([np.frombuffer(r[8], np.uint64) for r in rows], threshold, left)
        keys = np.array([r[7] for r in rows], np.int64)
        band = (keys == key).argmax(axis=1)
        links &= band[:, None] == band[None, :]
        for k in range(int(band.max())):  # pairs that share an earlier band count there
            links &= (keys[:, k][:, None] != keys[:, k][None, :]) | (band <= k)[:, None]
        counts = links @ np.array([r[6] for r in rows], np.int64)
        label = _least_connected(links)
        hit = np.flatnonzero(counts)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([rows[i][4] for i in hit], pa.binary()), pa.array([rows[i][5] for i in hit], pa.int64()),
                pa.array([rows[label[i]][4] for i in hit], pa.binary()), pa.array([rows[label[i]][5] for i in hit], pa.int64()), pa.array(counts[hit]),
            ],
            schema=schema,
        )

    def run(batches):
        held: list[tuple] = []  # rows of the unit that the last batch ended in
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and row[:3] != held[0][:3]:
                    yield unit(held)
                    held = []
                held.append(row)
        if held:
            yield unit(held)

    return run


def _buckets(classes: DataFrame, bands: int) -> DataFrame:
    """(node, buckets): each class's buckets (key, parts) in which it may meet a class that it shares no earlier band with."""
    keys = classes.select("node", F.explode("bands").alias("key"))
    several = written(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "near-buckets")
    members = written(join_keyed(keys, several, "key", "n").select("node", "key", "n"), "near-members")
    full = members.join(classes.select("node", "bands", "grams"), "node")
    band = lambda i: F.col("bands")[i]
    stats = full.groupBy("key").agg(
        F.max("n").alias("n"), F.sum("grams").alias("grams"), F.min(F.array_position("bands", F.col("key"))).alias("place"), *(F.min(band(i)).alias(f"lo{i}") for i in range(bands - 1)), *(F.max(band(i)).alias(f"hi{i}") for i in range(bands - 1))
    )
    again = F.lit(False)
    for i in range(bands - 1):
        again = again | ((F.col("place") > i + 1) & (F.col(f"lo{i}") == F.col(f"hi{i}")))
    parts = F.greatest(F.ceil(F.col("n") / BLOCK_TEXTS), F.ceil(F.col("grams") / BLOCK_GRAMS)).cast("int")
    stats = written(stats.where(~again).select("key", "n", parts.alias("parts")), "near-parts")
    met = join_keyed(members.drop("n"), stats, "key", "n")
    return met.groupBy("node").agg(F.collect_list(F.struct("key", "parts")).alias("buckets"))  # at most one for each band


def near_classes(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per document: doc_id, node (MD5 of its text), class_id (least id of its near-duplicate class), n_links."""
    bands, rows = choose_bands(threshold, recall)
    text = F.col("text").cast("string")
    keyed = texts(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.unhex(F.md5(text)).alias("node"), text.alias("text"))
    signed = keyed.mapInArrow(_signatures(bands, rows, n), "doc_id bigint, node binary, grams bigint, bands array<bigint>")
    signed = written(signed, "near-signed", compact=False)
    classes = signed.where("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("least"), F.count("*").alias("weight"), F.first("grams").alias("grams"), F.first("bands").alias("bands")
    )
    classes = written(classes, "near-classes")
    needed = written(_buckets(classes, bands).join(classes.select("node", "least", "weight", "bands"), "node"), "near-needed")

    # the texts of the classes that meet others: of each its least row
    wanted = small(needed.select(F.col("node").alias("_node"), F.col("least").alias("_least")), 300_000)
    source = keyed.join(wanted, F.col("doc_id").eqNullSafe(F.col("_least")) & (F.col("node") == F.col("_node")), "left_semi").select("node", "text")
    sets = source.mapInArrow(_gram_sets(n), "node binary, grams binary").dropDuplicates(["node"])
    units = sets.join(needed, "node").select(F.explode("buckets").alias("k"), "node", "least", "weight", "bands", "grams")
    own = F.pmod(F.xxhash64("node"), F.col("k.parts")).cast("int")
    units = units.select(F.col("k.key").alias("key"), F.col("k.parts").alias("parts"), own.alias("own"), "node", "least", "weight", "bands", "grams")
    others = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(F.least(p, F.col("own")).alias("a"), F.greatest(p, F.col("own")).alias("b")))
    units = units.select("key", F.explode(others).alias("u"), "own", "node", "least", "weight", "bands", "grams")
    units = units.select("key", "u.a", "u.b", "own", "node", "least", "weight", "bands", "grams")
    units = units.repartition(F.col("key"), F.col("a"), F.col("b")).sortWithinPartitions("key", "a", "b")
    found = written(units.mapInArrow(_verify(threshold), "node binary, least bigint, root_node binary, root_least bigint, links bigint"), "near-found", compact=False)

    end = lambda least, node: F.struct(F.col(least).isNull().alias("none"), F.col(least).alias("least"), F.col(node).alias("node"))
    ends = star_components(found.select(end("least", "node").alias("a"), end("root_least", "root_node").alias("b")))
    ends = ends.select(F.col("node.node").alias("node"), F.col("root.least").alias("class_id"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    marks = links.join(ends, "node", "left").unionByName(classes.where("weight > 1").select("node", F.lit(None).cast("bigint").alias("class_id"), F.lit(0).cast("bigint").alias("links")), allowMissingColumns=True)
    marks = marks.groupBy("node").agg(F.max("class_id").alias("class_id"), F.max("links").alias("links")).join(classes.select("node", "least", "weight"), "node")
    # where the root has no id, the class has none
    linked = F.col("links") > 0
    marks = marks.select("node", F.when(linked, F.col("class_id")).otherwise(F.col("least")).alias("class_id"), (F.col("links") + F.col("weight") - 1).alias("n_links"), F.col("weight").alias("n"))
    marks = written(marks, "near-result")
    out = join_keyed(signed.select("doc_id", "node"), marks, "node", "n", "left")
    return out.select("doc_id", "node", F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))


def op3_minhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents, and each document's number of links."""
    return near_classes(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("node")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each near-duplicate class: the one of least id.

    Rows without an id or a text stay; of rows that repeat id and text one stays.
    """
    key, node = fresh(docs, "_id", "_node")
    classes = near_classes(docs)
    ids = written(classes.groupBy("doc_id", "node").agg(F.min("class_id").alias("class_id"), F.count("*").alias("n")), "near-ids")
    mark = lambda rows: rows.select(F.col("doc_id").alias(key), F.col("node").alias(node))
    same = (F.col("doc_id") == F.col(key)) & (F.unhex(F.md5(F.col("text").cast("string"))) == F.col(node))
    # of a class's rows of the least id, one text stays
    chosen = ids.where("class_id = doc_id").groupBy(F.col("class_id").alias("_class")).agg(F.min("node").alias("_chosen"))
    gone = ids.where("class_id <> doc_id").select("doc_id", "node").unionByName(
        ids.where("class_id = doc_id").join(chosen, (F.col("class_id") == F.col("_class")) & (F.col("node") != F.col("_chosen")), "left_semi").select("doc_id", "node")
    )
    gone = written(mark(gone), "near-gone")
    kept = docs.join(small(gone, 1_000_000), same, "left_anti")
    again = written(mark(ids.where("class_id = doc_id and n > 1")), "near-again")
    if again.isEmpty():
        return kept
    once = kept.join(small(again, 1_000_000), same, "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(small(again, 1_000_000), same, "left_anti").unionByName(once)
