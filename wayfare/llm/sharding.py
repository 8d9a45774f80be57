"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

1. Each partition of the input is a block. It permutes its rows by a seeded hash, where
   they are, and numbers them. Block p holds n_p rows; shard j takes s_j rows, where the
   s_j are at most one apart.
2. The matrix of counts block -> shard is drawn: one multivariate hypergeometric draw
   for each block, of n_p rows out of the room that the shards still have. The draws go
   down a tree: the blocks fall into ``FANOUT`` groups, each of them into ``FANOUT``
   groups again, and so on; a group's counts by shard are drawn out of its parent's. All
   groups of a level are drawn side by side, each in a row of its own.
3. The first M[p][0] rows of block p go to shard 0, the next M[p][1] to shard 1, and so
   on. That is the exchange, the only one of whole rows.
4. Each shard permutes what it got, which gives the slots.
5. ``write_shards`` writes the whole rows, a folder for each shard, in the order of the
   slots. The query ``op8_...`` shards whole documents and reads its digests from these.

All is SQL expressions and windows over bounded groups; no Python runs on the
executors. Blocks and slot ranges grow in number with the rows, so no task holds a
share of the table that more machines can't shorten.

Defined results: null texts have no bytes (size 1, CRC 0); texts of any length are rows
like others; repeated rows are separate rows and may part; ties of the hash are broken by
the row's place; other columns of any name are kept, but the columns ``shard`` and
``slot`` that the operator adds replace columns of these names; an empty table gives an
empty result; fewer rows than shards leave some shards empty.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.tables import _width, forget, fresh
from ._common import small, text_or_empty, texts, written
from ._exact import log_factorial, uniform

#: Rows and bytes of a slot range, on average, and children of a group of blocks.
ROWS_PER_RANGE, BYTES_PER_RANGE, FANOUT = 50_000, 32 << 20, 64
#: Attempts of one draw; each succeeds more often than not.
ATTEMPTS = 100


def _let(value: Column, body) -> Column:
    """``body(value)`` with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _draw(good: Column, total: Column, n: Column, seed: int, *keys: Column) -> Column:
    """How many of ``n`` draws without replacement from ``total`` hit one of ``good``.

    Ratio of uniforms under a hat around the mode (Stadlober's method), whose number of
    attempts doesn't depend on how wide the distribution is. The smaller of good and bad,
    and of drawn and left, is drawn for, and the result turned back.
    """
    d = lambda c: c.cast("double")
    lf = log_factorial
    bad = total - good
    one = F.struct(
        F.least(good, bad).alias("few"), F.greatest(good, bad).alias("many"), F.least(n, total - n).alias("m"), total.alias("total"), good.alias("good"), n.alias("n"),
        F.array(*(k.cast("bigint") for k in keys)).alias("keys"),
    )

    def shape(x: Column) -> Column:
        few, many, m, t = (x[k] for k in ("few", "many", "m", "total"))
        p = d(few) / d(t)
        sd = F.sqrt((d(t) - d(m)) * d(x["n"]) * p * (1 - p) / F.greatest(d(t) - 1, F.lit(1.0)) + 0.5)
        mode = F.floor((d(m) + 1) * (d(few) + 1) / (d(t) + 2)).cast("bigint")
        return F.struct(
            x.alias("x"), (d(m) * p + 0.5).alias("centre"), (2 * math.sqrt(2 / math.e) * sd + 3 - 2 * math.sqrt(3 / math.e)).alias("width"),
            (lf(mode) + lf(few - mode) + lf(m - mode) + lf(many - m + mode)).alias("peak"), F.least(d(F.least(m, few)) + 1, F.floor(d(m) * p + 0.5 + 16 * sd)).alias("end"), mode.alias("mode"),
        )

    def accepted(y: Column) -> Column:
        x = y["x"]

        def attempt(found: Column, i: Column) -> Column:
            def judge(point: Column) -> Column:
                z = F.floor(point["at"]).cast("bigint")
                inside = (point["at"] >= 0) & (point["at"] < y["end"])
                fall = y["peak"] - lf(z) - lf(x["few"] - z) - lf(x["m"] - z) - lf(x["many"] - x["m"] + z)
                return F.when(inside, F.when(2 * F.log(point["u"]) <= fall, z))

            u = uniform(seed, x["keys"], i, F.lit(1)) + 2.0**-54  # above 0
            v = uniform(seed, x["keys"], i, F.lit(2))
            point = F.struct(u.alias("u"), (y["centre"] + y["width"] * (v - 0.5) / u).alias("at"))
            return F.when(found.isNotNull(), found).otherwise(_let(point, judge))

        # that no attempt succeeds is less likely than that the machine fails: the mode then
        k = F.aggregate(F.sequence(F.lit(1), F.lit(ATTEMPTS)), F.lit(None).cast("bigint"), attempt, lambda s: F.coalesce(s, y["mode"]))
        return _let(k, lambda c: _let(F.when(x["good"] > x["total"] - x["good"], x["m"] - c).otherwise(c), lambda g: F.when(x["m"] < x["n"], x["good"] - g).otherwise(g)))

    low = F.greatest(F.lit(0).cast("bigint"), n + good - total)
    high = F.least(n, good)
    return F.when(high <= low, low).otherwise(_let(one, lambda x: _let(shape(x), accepted)))


def _divided(room: Column, children: Column, seed: int, level: int) -> Column:
    """A group's counts by shard dealt out to its children: array of (block, room)."""
    big = lambda v: F.lit(v).cast("bigint")
    no_cells = F.expr("cast(array() as array<struct<block:bigint,room:array<bigint>>>)")
    no_room = F.expr("cast(array() as array<bigint>)")

    def child(state: Column, b: Column) -> Column:
        begin = F.struct(b["n"].alias("left"), F.aggregate(state["room"], big(0), lambda s, r: s + r).alias("open"), no_room.alias("mine"), no_room.alias("rest"))

        def shard(s: Column, r: Column) -> Column:
            j = F.size(s["mine"]).cast("bigint")
            k = F.when(s["open"] <= r, s["left"]).otherwise(_draw(r, s["open"], s["left"], seed, F.lit(level), b["block"], j))
            return _let(k, lambda kk: F.struct((s["left"] - kk).alias("left"), (s["open"] - r).alias("open"), F.concat(s["mine"], F.array(kk)).alias("mine"), F.concat(s["rest"], F.array(r - kk)).alias("rest")))

        def put(s: Column) -> Column:
            cell = F.struct(b["block"].alias("block"), s["mine"].alias("room"))
            return F.struct(s["rest"].alias("room"), F.concat(state["cells"], F.array(cell)).alias("cells"))

        return _let(F.aggregate(state["room"], begin, shard), put)

    return F.aggregate(children, F.struct(room.alias("room"), no_cells.alias("cells")), child, lambda s: s["cells"])


def communication_matrix(blocks: DataFrame, n_shards: int, seed: int) -> DataFrame:
    """(block, n) to (block, counts): how many rows each block sends to each shard.

    Blocks are numbers from 0 on. ``FANOUT`` children of a group meet in one row, however
    many blocks there are; the levels grow with the logarithm of their number.
    """
    blocks = blocks.select(F.col("block").cast("bigint").alias("block"), F.col("n").cast("bigint").alias("n"))
    whole = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.max("block"), F.lit(0)).alias("last")).first()
    levels = 1
    while FANOUT**levels <= whole.last:
        levels += 1
    room = [whole.n // n_shards + (j < whole.n % n_shards) for j in range(n_shards)]
    groups = blocks.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("block"), F.array(*(F.lit(r).cast("bigint") for r in room)).alias("room"))
    for level in range(levels - 1, -1, -1):
        sized = blocks.groupBy(F.floor(F.col("block") / FANOUT**level).cast("bigint").alias("block")).agg(F.sum("n").alias("n"))
        children = sized.groupBy(F.floor(F.col("block") / FANOUT).cast("bigint").alias("parent")).agg(F.sort_array(F.collect_list(F.struct("block", "n"))).alias("children"))  # at most FANOUT
        dealt = groups.withColumnRenamed("block", "parent").join(children, "parent").select(F.inline(_divided(F.col("room"), F.col("children"), seed, level)))
        groups = written(dealt, "shard-matrix")
    return groups.select("block", F.col("room").alias("counts"))


def shuffle_into_shards(df: DataFrame, n_shards: int = 16, seed: int = 17) -> DataFrame:
    """``df`` with ``shard`` (0 to n_shards-1) and ``slot`` (gapless from 0 in each shard).

    Every assignment of rows to slots is as likely as any other, and the shards'
    sizes are at most one apart. The locally permuted rows are written once to the
    shared folder: a lost executor's tasks then read the same rows again.
    """
    return _placed(df, n_shards, seed)[0]


def write_shards(df: DataFrame, n_shards: int = 16, seed: int = 17) -> DataFrame:
    """As ``shuffle_into_shards``, written with all columns and read back: a folder ``shard=j`` for each shard, each file in the order of the slots."""
    placed, rows = _placed(df, n_shards, seed)
    shards = written(placed.sortWithinPartitions("shard", "slot"), "shards", compact=False, codec="zstd", by="shard")
    forget(rows)
    return shards


def _placed(df: DataFrame, n_shards: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """The rows with shard and slot, and the table of locally permuted rows that they are read from."""
    keep = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    at, order, block, counts, part, inner, start, taken = fresh(keep + ["shard", "slot"], "_at", "_order", "_block", "_counts", "_part", "_inner", "_start", "_taken")
    own = [F.col(f"`{c}`") for c in keep]
    # the local permutation: rows are sorted by hash within their partition, and numbered as they then stand
    hashed = df.select(*own, F.xxhash64(F.lit(seed), F.monotonically_increasing_id()).alias(order))
    rows = written(hashed.sortWithinPartitions(order).select(*own, F.monotonically_increasing_id().alias(at)), "shard-rows", compact=False, codec="zstd")
    here, rank = F.shiftright(F.col(at), 33), F.col(at).bitwiseAND(F.lit((1 << 33) - 1))
    width = _width(F.struct(*own, F.col(at)), rows.select(*own, at).schema)
    sizes = written(rows.groupBy(here.alias("block")).agg(F.count("*").alias("n"), F.sum(width).alias("bytes")), "shard-blocks")
    matrix = communication_matrix(sizes, n_shards, seed).withColumnsRenamed({"block": block, "counts": counts})

    # a block's first rows go to shard 0, and so on: the shard is how many of the running sums the rank has reached
    sent = rows.withColumn(block, here).join(small(matrix, 100_000), block)
    running = F.aggregate(F.col(counts), F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(0).alias("shard")), lambda s, c: F.struct((s["sum"] + c).alias("sum"), (s["shard"] + (s["sum"] + c <= rank).cast("int")).alias("shard")))
    total, weight = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    n_ranges = max(1, total // n_shards // ROWS_PER_RANGE, weight // n_shards // BYTES_PER_RANGE)
    draw = F.xxhash64(F.lit(seed + 2), F.col(at))
    share = F.shiftrightunsigned(draw, 11).cast("double") / float(1 << 53)
    sent = sent.select(*own, F.col(at), running["shard"].alias("shard"), F.least(F.lit(n_ranges - 1).cast("bigint"), F.floor(share * n_ranges).cast("bigint")).alias(part))

    # the second permutation: order by another hash, in ranges of it that windows can hold
    ranges = written(sent.groupBy("shard", part).agg(F.count("*").alias("n")), "shard-ranges")
    starts = ranges.select(F.col("shard").alias(taken), F.col(part).alias(block), (F.sum("n").over(Window.partitionBy("shard").orderBy(part)) - F.col("n")).alias(start))  # a row for each range of a shard
    turn = Window.partitionBy("shard", part).orderBy(F.shiftrightunsigned(draw, 11), at)
    placed = sent.withColumn(inner, F.row_number().over(turn) - 1).join(small(written(starts, "shard-starts"), 1_000_000), (F.col("shard") == F.col(taken)) & (F.col(part) == F.col(block)))
    return placed.select(*own, F.col("shard"), (F.col(start) + F.col(inner)).cast("bigint").alias("slot")), rows


def op8_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, whole, in shards 0 to 15 under the law ``rows``; sizes and checksums are those of the texts as they lie in the shards."""
    text = text_or_empty()
    shards = write_shards(texts(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return shards.select(
        "doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
