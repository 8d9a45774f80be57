import glob
import math
import random
import zlib

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import wayfare.llm.sharding as sharding
from wayfare.llm._exact import binomial_cdf, log_factorial
from wayfare.llm.sharding import _draw, communication_matrix, op8_hypergeometric_shards, shuffle_into_shards, write_shards


def big(v):
    return F.lit(v).cast("bigint")


def test_log_factorial(spark):
    ns = [0, 1, 5, 23, 24, 25, 1000, 10**7, 10**11]
    got = spark.createDataFrame([(n,) for n in ns], "n bigint").select("n", log_factorial(F.col("n")).alias("x")).collect()
    for r in got:
        assert r.x == pytest.approx(math.lgamma(r.n + 1), rel=1e-13, abs=1e-12)


def test_binomial(spark):
    cases = [(k, n) for n in (1, 10, 200, 3000) for k in (0, 1, 5, 9, 100) if k <= n]
    got = spark.createDataFrame(cases, "k bigint, n bigint").select("k", "n", binomial_cdf(F.col("k"), F.col("n"), 0.05).alias("p")).collect()
    for r in got:
        want = sum(math.comb(r.n, i) * 0.05**i * 0.95 ** (r.n - i) for i in range(r.k + 1)) if r.k < 0.05 * r.n else 1.0
        assert r.p == pytest.approx(want, rel=1e-9)


@pytest.mark.parametrize("good,total,n", [(3, 10, 4), (30, 100, 20), (5, 6, 5), (40, 50, 30), (50, 60, 45), (1, 2, 1), (4000, 9000, 700)])
def test_draws_follow_the_distribution(spark, good, total, n):
    size = 20_000
    drawn = spark.range(size).select(_draw(big(good), big(total), big(n), 3, F.col("id")).alias("k")).groupBy("k").count().collect()
    got = {r.k: r["count"] for r in drawn}
    chi, kinds = 0.0, 0
    for k in range(max(0, n + good - total), min(n, good) + 1):
        want = size * math.comb(good, k) * math.comb(total - good, n - k) / math.comb(total, n)
        if want > 5:
            chi += (got.get(k, 0) - want) ** 2 / want
            kinds += 1
    assert sum(got.values()) == size and set(got) <= set(range(max(0, n + good - total), min(n, good) + 1))
    assert chi < kinds + 6 * math.sqrt(2 * kinds) + 5


def test_large_draws(spark):
    """Mean and spread where the distribution is wide."""
    good, total, n = 3 * 10**10, 10**11, 10**9
    r = spark.range(2000).select(_draw(big(good), big(total), big(n), 5, F.col("id")).alias("k")).agg(F.avg("k").alias("m"), F.stddev("k").alias("s")).first()
    sd = math.sqrt(n * 0.3 * 0.7 * (1 - n / total))
    assert abs(r.m - n * 0.3) < 5 * sd / math.sqrt(2000) and r.s == pytest.approx(sd, rel=0.1)


def plain_matrix(sizes, n_shards, rng):
    """The matrix as cards: shuffle all rows' shards, deal them to the blocks in turn."""
    total = sum(sizes.values())
    cards = [j for j in range(n_shards) for _ in range(total // n_shards + (j < total % n_shards))]
    rng.shuffle(cards)
    out, a = {}, 0
    for b, n in sorted(sizes.items()):
        out[b] = [cards[a : a + n].count(j) for j in range(n_shards)]
        a += n
    return out


def test_matrix_against_a_plain_sampler(spark, monkeypatch):
    """Each cell's distribution over seeds is that of dealt cards, over two levels of the tree."""
    monkeypatch.setattr(sharding, "FANOUT", 3)
    sizes = {0: 4, 1: 0, 2: 7, 3: 3, 4: 5}
    frame = spark.createDataFrame(list(sizes.items()), "block bigint, n bigint").cache()
    rng = random.Random(1)
    rounds = 24
    mine = [{r.block: r.counts for r in communication_matrix(frame, 3, seed).collect()} for seed in range(rounds)]
    for m in mine:
        assert {b: sum(c) for b, c in m.items()} == sizes
        assert sorted(sum(c[j] for c in m.values()) for j in range(3)) == [6, 6, 7]
    plain = [plain_matrix(sizes, 3, rng) for _ in range(4000)]
    for b in (0, 2, 4):
        for j in range(3):
            mean = sum(p[b][j] for p in plain) / len(plain)
            sd = math.sqrt(sum((p[b][j] - mean) ** 2 for p in plain) / len(plain))
            got = [m[b][j] for m in mine]
            assert abs(sum(got) / rounds - mean) < 4.5 * sd / math.sqrt(rounds)
            spread = math.sqrt(sum((g - mean) ** 2 for g in got) / rounds)
            assert 0.6 * sd < spread < 1.5 * sd


def test_matrix_margins(spark):
    sizes = {0: 50, 1: 0, 2: 7, 3: 1000, 4: 1, 200: 30, 5000: 12}
    m = {r.block: r.counts for r in communication_matrix(spark.createDataFrame(list(sizes.items()), "block bigint, n bigint"), 7, 1).collect()}
    assert {b: sum(c) for b, c in m.items()} == sizes
    shards = [sum(c[j] for c in m.values()) for j in range(7)]
    assert sum(shards) == 1100 and max(shards) - min(shards) <= 1 and all(x >= 0 for c in m.values() for x in c)


def test_law(spark, tmp_path, awkward):
    awkward.write.parquet(f"{tmp_path}/documents.parquet")
    found = op8_hypergeometric_shards(spark, str(tmp_path))
    assert dict(found.dtypes) == {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"}
    rows = found.collect()
    assert len(rows) == awkward.count()
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - (min(map(len, by.values())) if len(by) == 16 else 0) <= 1
    null = next(r for r in rows if r.doc_id == 1)
    assert (null.size, null.text_crc32, null.law, null.grown_shard) == (1, 0, "rows", None)


def test_whole_documents_lie_in_the_shards(spark, tmp_path, awkward, monkeypatch):
    """The query moves all columns of all rows; its digests are those of the texts at their slots."""
    tables = {}
    write = sharding.written
    monkeypatch.setattr(sharding, "written", lambda df, name, *a, **k: tables.setdefault(name, write(df, name, *a, **k)))
    docs = awkward.unionByName(awkward.where("doc_id > 4")).cache()
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = {(r.shard, r.slot): r for r in op8_hypergeometric_shards(spark, str(tmp_path)).collect()}
    seen = []
    for folder in glob.glob(tables["shards"]._written_to.removeprefix("file://") + "/shard=*"):
        for file in glob.glob(f"{folder}/*.parquet"):
            rows = pq.ParquetFile(file).read().to_pylist()
            assert [r["slot"] for r in rows] == sorted(r["slot"] for r in rows)
            for r in rows:
                digest, raw = found.pop((int(folder.split("=")[1]), r.pop("slot"))), (r["text"] or "").encode()
                assert (digest.doc_id, digest.size, digest.text_crc32) == (r["doc_id"], len(raw) + 1, zlib.crc32(raw))
                seen.append(tuple(r[c] for c in docs.columns))
    assert not found and sorted(map(repr, seen)) == sorted(repr(tuple(r)) for r in docs.collect())


def test_ranges_hold_a_bounded_share_of_long_texts(spark, make, monkeypatch):
    """Few rows of long texts fall into several ranges too; the slots stay gapless."""
    monkeypatch.setattr(sharding, "BYTES_PER_RANGE", 20_000)
    tables = {}
    write = sharding.written
    monkeypatch.setattr(sharding, "written", lambda df, name, *a, **k: tables.setdefault(name, write(df, name, *a, **k)))
    got = write_shards(make([(i, "x" * 2000) for i in range(200)]), 4).select("shard", "slot").collect()
    assert sorted((r.shard, r.slot) for r in got) == [(j, k) for j in range(4) for k in range(50)]
    assert tables["shard-ranges"].count() == 4 * 5  # some 100 kB a shard


def test_shards_of_a_table_without_rows(spark, empty):
    got = write_shards(empty)
    assert got.count() == 0 and set(got.columns) == {*empty.columns, "shard", "slot"}


def test_uniform(spark):
    """Neighbours part: over seeds, a row's shard is spread evenly, and two rows meet as often as chance says."""
    df = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("clash").alias("shard"))
    counts, together = [0] * 4, 0
    for seed in range(30):
        got = {r.doc_id: r.shard for r in shuffle_into_shards(df, 4, seed * 10).select("doc_id", "shard").collect()}
        assert sorted(list(got.values()).count(j) for j in range(4)) == [10] * 4
        for i in range(8):
            counts[got[i]] += 1
            together += got[2 * i] == got[2 * i + 1]
    assert all(35 <= c <= 85 for c in counts) and 30 <= together <= 85  # 60 and 55 expected


def test_clashing_columns(spark):
    names = ["_at", "_order", "_block", "_counts", "_part", "_inner", "_start", "_taken", "_row", "n", "block", "counts"]
    df = spark.range(30).select("id", *(F.concat(F.lit(n), F.col("id").cast("string")).alias(n) for n in names), F.lit("old").alias("Slot"))
    got = shuffle_into_shards(df, 4)
    assert got.columns == ["id", *names, "shard", "slot"]
    for r in got.collect():
        assert all(r[n] == f"{n}{r.id}" for n in names) and r.slot in range(8)


def test_empty(spark, empty):
    assert shuffle_into_shards(empty.select("doc_id")).count() == 0
