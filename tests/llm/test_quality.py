import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wayfare.llm.quality import FEATURES, classify, evidence, features, fit, hashed, op5_hierarchical_quality, site_posteriors


def test_features():
    x = features(pa.array(["a b a b a b", None, "", "A# |1!\nl\nl"]))
    f = dict(zip(FEATURES, x[0]))
    assert f["log_words"] == pytest.approx(np.log(7)) and f["distinct_words"] == pytest.approx(1 / 3) and f["repeated_runs"] == pytest.approx(0.5) and f["word_bytes"] == 1
    assert not x[1][1:-1].any() and (x[1] == x[2]).all()
    g = dict(zip(FEATURES, x[3]))
    assert g["repeated_lines"] == pytest.approx(1 / 3) and g["symbols"] == pytest.approx(1 / 10) and g["upper"] == pytest.approx(1 / 10)


def test_logistic_regression():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((2000, 2))
    y = (rng.random(2000) < 1 / (1 + np.exp(-(0.5 + 2 * x[:, 0] - x[:, 1])))).astype(float)
    w = fit(x, y)
    assert np.allclose(w, [0.5, 2, -1], atol=0.3)


def test_shrinkage(spark):
    """A large site keeps its own rate, a small one is drawn to the mean, and no document counts for itself."""
    rng = random.Random(3)
    rows = []
    for h in range(30):
        rate = rng.betavariate(4, 2)
        rows += [(len(rows) + i, f"h{h}", f"h{h}/a", float(rng.random() < rate) * 0.9 + 0.05) for i in range(60)]
    rows += [(10_000, "lone", "lone/a", 0.05), (10_001, None, "x", 0.5)]
    judged = spark.createDataFrame(rows, "doc_id bigint, host string, path string, evidence double").cache()
    got = {r.doc_id: r for r in site_posteriors(judged, "doc_id", "host").collect()}
    mean = np.mean([r[3] for r in rows])
    assert got[10_000].host_rate == pytest.approx(mean) and got[10_000].path_rate == pytest.approx(mean)
    assert got[10_001].posterior == pytest.approx(0.5, abs=1e-6)
    one = [r for r in rows if r[1] == "h0"]
    others = np.mean([r[3] for r in one[1:]])
    low, high = sorted((others, mean))
    assert low <= got[one[0][0]].host_rate <= high
    assert abs(got[one[0][0]].host_rate - others) < abs(mean - others)


def test_posteriors_by_plain_loops(spark):
    """Method of moments, shrinkage and posteriors written out, document by document."""
    rng = random.Random(8)
    rows = []
    for h in range(12):
        for p in range(rng.randint(1, 4)):
            rate = rng.betavariate(3, 2)
            rows += [(len(rows) + i, f"h{h}", f"h{h}/p{p}", min(0.99, max(0.01, rng.gauss(rate, 0.2)))) for i in range(rng.randint(1, 30))]
    rows += [(90_000, "h0", None, 0.3), (90_001, None, None, 0.7), (90_002, "h0", None, 0.4)]
    known = [r for r in rows if r[1] is not None]
    mu = sum(r[3] for r in rows) / len(rows)

    def worth(groups, centre):
        """How many documents a group's prior is worth."""
        n = sum(len(g) for g in groups.values())
        sigma2 = sum((x - sum(g) / len(g)) ** 2 for g in groups.values() for x in g) / (n - len(groups))
        between = sum(len(g) * (sum(g) / len(g) - centre(k)) ** 2 for k, g in groups.items())
        tau2 = (between - (len(groups) - 1) * sigma2) / (n - sum(len(g) ** 2 for g in groups.values()) / n)
        return min(max(sigma2 / tau2, 1.0), 1e6) if tau2 > 0 else 1e6

    hosts, paths = {}, {}
    for _, h, p, e in known:
        hosts.setdefault(h, []).append(e)
        paths.setdefault((h, p), []).append(e)
    k_host = worth(hosts, lambda _: mu)
    k_path = worth(paths, lambda k: sum(hosts[k[0]]) / len(hosts[k[0]]))
    logit = lambda x: np.log(x / (1 - x))
    got = {r.doc_id: r for r in site_posteriors(spark.createDataFrame(rows, "doc_id bigint, host string, path string, evidence double"), "doc_id").collect()}
    assert len(got) == len(rows)
    for d, h, p, e in rows:
        host = path = mu
        if h is not None:
            host = (k_host * mu + sum(hosts[h]) - e) / (k_host + len(hosts[h]) - 1)
            path = (k_path * host + sum(paths[h, p]) - e) / (k_path + len(paths[h, p]) - 1)
        want = 1 / (1 + np.exp(-(logit(e) + logit(path) - logit(mu))))
        assert (got[d].host_rate, got[d].path_rate, got[d].posterior) == pytest.approx((host, path, want), rel=1e-6)


def test_words_tell_where_form_does_not(spark, make):
    """Good and bad texts of the same form, told apart by their words alone."""
    rng = random.Random(6)
    good, bad, both = ([f"{a}{i:02d}" for i in range(40)] for a in ("ga", "ba", "xx"))
    rows, labels = [], []
    for i in range(400):
        own = good if i % 3 else bad
        rows.append((i, " ".join(rng.choice(own) if rng.random() < 0.3 else rng.choice(both) for _ in range(80)), "en", "s"))
        labels.append((i, int(i % 3 > 0), 0))
    learned = spark.createDataFrame([x for x in labels if x[0] % 2], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r.evidence for r in evidence(make(rows), learned, F.col("doc_id")).collect()}
    assert np.mean([(got[i] > 0.5) == bool(q) for i, q, _ in labels if i % 2 == 0]) > 0.95


def test_hashed_shares():
    x = hashed(pa.array(["A b a", None, "", "a"]))
    assert x.shape == (4, 512) and not x[1].any() and not x[2].any()
    assert sorted(x[0][x[0] > 0].round(6).tolist()) == pytest.approx(sorted([(2 / 3) ** 0.5, (1 / 3) ** 0.5, 0.5**0.5, 0.5**0.5]), abs=1e-6)


def test_classifier(spark, make, prose, awkward, empty, tmp_path):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(300):
        good = rng.random() > 0.3
        rows.append((100 + i, " ".join(w + ("" if good else rng.choice(("##", "$$"))) for w in prose(rng, 60).split()), "en", f"s{i % 3}"))
        labels.append((100 + i, int(good), 0))
    docs = make(rows).unionByName(awkward).withColumn("evidence", F.lit("clash"))
    half = spark.createDataFrame([x for x in labels if x[0] % 2] + [(101, None, 0), (7, 1, 0)], "doc_id bigint, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    half.write.parquet(f"{tmp_path}/labels.parquet")
    got = op5_hierarchical_quality(spark, str(tmp_path)).collect()
    assert len(got) == docs.count() and all(0 <= r.posterior <= 1 for r in got)
    kept = {r.doc_id: r.kept for r in got}
    held = [(i, q) for i, q, _ in labels if i % 2 == 0]
    assert np.mean([kept[i] == bool(q) for i, q in held]) > 0.97
    none = half.limit(0)
    assert {r.evidence for r in evidence(awkward, none, F.col("doc_id")).collect()} == {0.5}
    assert classify(empty, half, F.col("source"), F.col("lang")).count() == 0
