"""Quality classifier with hierarchical empirical Bayes over hosts and paths.

1. Evidence. Each whole text gives a few measures of its form, and the shares of its
   words and word pairs by hash (``BINS`` of each, lower case); logistic regression,
   fitted on a bounded sample of labelled rows (``SAMPLE`` of each class, those whose ids
   hash lowest), turns them into the document's own probability of being good.
2. Sites. Grouped sums of those probabilities give each host and each path a mean.
   Host means scatter around the global mean, path means around their host's; the
   method of moments says how widely, and so how many documents a prior is worth. A
   site of few documents is drawn to the mean above it, a large one keeps its own.
3. A document's posterior adds its evidence and its path's posterior, as log odds, the
   path's taken without the document itself so that it doesn't count twice.

Defined results: a null or empty text is evidence of a text without words; rows without
a host have the global prior for a site; a null path is a path of its own; labels that
are null don't count, of repeated labels the best; without labels of both classes the
evidence is 0.5 for all; texts of any length are measured whole; a posterior of exactly
the cutoff is kept; repeated rows count as often as they occur; other columns of any name
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tables import fresh, join_keyed
from ._common import NO_WORD, Words, least_hashed, slices, texts, written

#: Labelled rows of each class that the classifier is fitted on, at most.
SAMPLE = 5000
_LINE = np.zeros(256, bool)
_LINE[[10, 13]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&<>"]] = True
_KINDS = {"symbols": _SYMBOL, "pipes": np.arange(256) == 124, "upper": (np.arange(256) >= 65) & (np.arange(256) <= 90), "digits": (np.arange(256) >= 48) & (np.arange(256) <= 57), "bangs": np.arange(256) == 33}
#: Hash bins of words, and of word pairs.
BINS = 256
FEATURES = ("log_words", "word_bytes", "distinct_words", "repeated_runs", "repeated_lines", *_KINDS, "short")


def _distinct(h: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """How many distinct values each row has."""
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return np.bincount(row[fresh], minlength=n)


def features(array: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text."""
    n = len(array)
    words = Words(array)
    size = words.count.astype(float)
    chars = np.diff(words.bounds).astype(float)
    runs, run_row, run_count = words.windows(3)
    lines = Words(array, _LINE)
    share = lambda a, b: a / np.maximum(b, 1)
    kept = np.diff(np.concatenate([[0], np.cumsum(words.end - words.start)])[np.append(words.first, len(words.hash))]).astype(float)
    columns = [
        np.log1p(size),
        share(kept, size),
        share(_distinct(words.hash, words.row, n), size),
        share(run_count - _distinct(runs, run_row, n), run_count),
        share(lines.count - _distinct(lines.hash, lines.row, n), lines.count),
    ]
    for kind in _KINDS.values():
        total = np.concatenate([[0], np.cumsum(kind[words.raw])])
        columns.append(share(np.diff(total[words.bounds]), chars))
    columns.append((size < 50).astype(float))
    return np.stack(columns, axis=1)


def hashed(array: pa.Array) -> np.ndarray:
    """Square roots of the shares of each text's words by hash bin, then of its word pairs; a row is of length 1 in each half."""
    n = len(array)
    words = Words(array, NO_WORD, lower=True)
    pairs, pair_row, pair_count = words.windows(2)
    halves = []
    for h, row, count in ((words.hash, words.row, words.count), (pairs, pair_row, pair_count)):
        cells = np.bincount(row * BINS + (h >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64), minlength=n * BINS).reshape(n, BINS)
        halves.append(np.sqrt(cells / np.maximum(count, 1)[:, None]))
    return np.concatenate(halves, axis=1)


def measured(array: pa.Array) -> np.ndarray:
    """FEATURES and hashed shares of each text."""
    return np.concatenate([features(array), hashed(array)], axis=1)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50, hashed_ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton's method: intercept and weights on standardised features, hashed ones held back more."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.c_[np.ones(len(x)), (x - mean) / scale]
    w = np.zeros(z.shape[1])
    form = np.arange(x.shape[1]) < len(FEATURES)
    penalty = len(x) * np.r_[0, np.where(form, ridge, hashed_ridge)] / 100 + 1e-9
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return np.r_[w[0] - (w[1:] * mean / scale).sum(), w[1:] / scale]


def evidence(docs: DataFrame, labels: DataFrame, *keep: Column) -> DataFrame:
    """The ``keep`` columns and ``evidence``, each document's own probability of being good."""
    known = labels.where("quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    picked = least_hashed(known, "doc_id", "quality", SAMPLE)
    picked = written(picked.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_quality")), "quality-sample")

    def measure(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("x", pa.binary())])
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(1), pa.array([x.tobytes() for x in measured(part.column(2)).astype(np.float32)], pa.binary())], schema=schema)

    docs = texts(docs)
    sample = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(picked), F.col("doc_id") == F.col("_id"))  # 2 * SAMPLE rows
    # repeated ids could bring more rows than the bound; one of each is enough
    got = sample.select("doc_id", F.col("_quality").alias("quality"), "text").mapInArrow(measure, "doc_id bigint, quality int, x binary").dropDuplicates(["doc_id"]).collect()  # 2 kB each
    got.sort(key=lambda r: r.doc_id)
    y = np.array([r.quality for r in got], float)
    width = len(FEATURES) + 2 * BINS
    weights = fit(np.frombuffer(b"".join(r.x for r in got), np.float32).reshape(-1, width).astype(float), y) if 0 < y.sum() < len(y) else np.zeros(width + 1)
    # the sample takes as many of each class as there are; the odds go back to those of all labels
    counts = dict(known.groupBy("quality").count().collect())
    if 0 < y.sum() < len(y):
        weights[0] += np.log(counts[1] / counts[0]) - np.log(y.sum() / (len(y) - y.sum()))

    kept = docs.select(*keep)
    (text,) = fresh(kept, "_text")
    narrow = docs.select(*keep, F.col("text").cast("string").alias(text))
    schema = kept.schema.add("evidence", "double")

    def score(batches):
        for batch in batches:
            for part in slices(batch, text):
                f = weights[0] + measured(part.column(part.num_columns - 1)) @ weights[1:]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(1 / (1 + np.exp(-np.clip(f, -30, 30))))], names=schema.names)

    return narrow.mapInArrow(score, schema)


def _prior_size(groups: DataFrame, centre: Column) -> float:
    """How many documents a group's prior is worth, from the scatter of group means around ``centre``."""
    mean = F.col("good") / F.col("n")
    r = groups.agg(
        F.sum("n").alias("n"), F.count("*").alias("groups"), F.sum(F.col("n") * F.col("n").cast("double")).alias("squares"), F.sum(F.col("n") * (mean - centre) ** 2).alias("between"), F.sum(F.col("square") - F.col("good") * mean).alias("within")
    ).first()
    if not r.n or r.groups < 2:
        return 1.0
    sigma2 = max(r.within / max(r.n - r.groups, 1), 1e-9)
    tau2 = (r.between - (r.groups - 1) * sigma2) / max(r.n - r.squares / r.n, 1)
    return float(np.clip(sigma2 / tau2, 1.0, 1e6)) if tau2 > 0 else 1e6


def site_posteriors(judged: DataFrame, *keep: str, strength: float = 1.0) -> DataFrame:
    """``keep`` columns with host_rate, path_rate and posterior, from (host, path, evidence)."""
    sums = [F.count("*").alias("n"), F.sum("evidence").alias("good"), F.sum(F.col("evidence") ** 2).alias("square")]
    paths = written(judged.where("host is not null").groupBy("host", "path").agg(*sums), "site-paths")
    hosts = written(paths.groupBy("host").agg(*(F.sum(c).alias(c) for c in ("n", "good", "square"))), "site-hosts")
    whole = judged.agg(F.count("*").alias("n"), F.sum("evidence").alias("good")).first()
    mu = float(np.clip(whole.good / whole.n, 1e-6, 1 - 1e-6)) if whole.n else 0.5
    k_host = _prior_size(hosts, F.lit(mu))
    host_mean = hosts.select("host", (F.col("good") / F.col("n")).alias("host_mean"))
    k_path = _prior_size(paths.join(host_mean, "host"), F.col("host_mean"))

    site = F.struct("host", "path").alias("_site")
    sites = paths.select("host", "path", F.col("n").alias("path_n"), F.col("good").alias("path_good")).join(hosts.select("host", F.col("n").alias("host_n"), F.col("good").alias("host_good")), "host")
    sites = written(sites.select(site, "path_n", "path_good", "host_n", "host_good"), "sites")
    joined = join_keyed(judged.withColumn("_site", site), sites, "_site", "path_n", "left", 200_000)
    host_rate = F.coalesce((k_host * mu + F.col("host_good") - F.col("evidence")) / (k_host + F.col("host_n") - 1), F.lit(mu))
    joined = joined.withColumn("host_rate", host_rate)
    path_rate = F.coalesce((k_path * F.col("host_rate") + F.col("path_good") - F.col("evidence")) / (k_path + F.col("path_n") - 1), F.lit(mu))
    joined = joined.withColumn("path_rate", F.least(F.greatest(path_rate, F.lit(1e-6)), F.lit(1 - 1e-6)))
    logit = lambda p: F.log(p / (1 - p))
    own = F.least(F.greatest(F.col("evidence"), F.lit(1e-12)), F.lit(1 - 1e-12))
    odds = logit(own) + strength * (logit(F.col("path_rate")) - float(np.log(mu / (1 - mu))))
    return joined.withColumn("posterior", 1 / (1 + F.exp(-odds))).select(*keep, "evidence", "host_rate", "path_rate", "posterior")


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, cutoff: float = 0.5) -> DataFrame:
    """doc_id, host, path, evidence, host_rate, path_rate, posterior, kept."""
    judged = written(evidence(docs, labels, F.col("doc_id"), host.alias("host"), path.alias("path")), "quality-judged", compact=False)
    return site_posteriors(judged, "doc_id", "host", "path").withColumn("kept", F.col("posterior") >= cutoff)


def op5_hierarchical_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; the source is the host, its section in a language the path."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classify(docs, labels, F.col("source"), F.concat_ws("/", F.col("source"), F.coalesce(F.col("lang"), F.lit("-"))))
