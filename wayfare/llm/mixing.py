"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic. Cell weights start at 1 and are
raked: scaled so that the weighted tokens of each source meet its target, then of each
language, then of each topic, again and again until all three hold. A document is
expected c * weight times in the mixture; c makes the expected tokens the ``budget``
share of all. Below 1 that is the probability of its being sampled; from 1 on it is
taken that many times, the fraction again by chance. So the shares of tokens meet the
targets even where small sources have to be repeated. ``prob`` is min(1, c * weight),
``weight`` is c * raked weight / probability, above 1 where documents are repeated.

Targets are shares of tokens by value. Those not given are tempered: the value's own
share to the power ``temperature``, scaled to add up to 1, which lifts small sources
without silencing large ones. Targets of values that don't occur are left out, and
values without a target get none of the tokens. Targets that no weights can meet
together are an error where they were given. Where all are tempered, ``warnings`` tells,
and the weights of the last sweep stand: topics meet their targets then.

Only cells are ever held together: a table in Spark, or on the driver where there are
no more than ``LOCAL_CELLS``; both rake alike.

Defined results: nulls of source, language or topic are values of their own; a null or
empty text has no tokens, is drawn by its cell's probability and changes no share; texts
of any length count whole; repeated rows are drawn alike, as the draw depends on the id;
a column ``topic`` of the table is used where there is one; other columns of any name are
kept by ``mix``; cells of equal weight are ordered by their names; an empty table gives
an empty result.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tables import forget, join_keyed
from ._common import text_or_empty, texts, written

DIMENSIONS = ("source", "lang", "topic")
#: Pattern and topic, the first that matches; without any, short texts are notes and others prose.
TOPICS = ((r"\| [^ |]+ \|", "table"), (r"[#*$%&]{3}", "markup"), (r"(?i)licen[cs]e|copyright|rights reserved", "legal"), (r"[a-z0-9]@[a-z0-9]|\+[0-9]", "contact"))
TEMPERATURE, BUDGET, SWEEPS, TOLERANCE, LOCAL_CELLS, SEED = 0.7, 0.7, 200, 1e-11, 200_000, 23


def topic(text: Column) -> Column:
    """A plain topic by the form of the text, where the table has no topics."""
    kind = F.when(text.rlike(TOPICS[0][0]), TOPICS[0][1])
    for pattern, name in TOPICS[1:]:
        kind = kind.when(text.rlike(pattern), name)
    return kind.when(F.length(text) < 400, "note").otherwise("prose")


def with_cells(docs: DataFrame) -> DataFrame:
    """``docs`` with _source, _lang, _topic and _tokens (words)."""
    text = text_or_empty()
    own = F.col("topic").cast("string") if "topic" in docs.columns else topic(text)
    return texts(docs).withColumns({"_source": F.col("source").cast("string"), "_lang": F.col("lang").cast("string"), "_topic": own, "_tokens": F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")})


def _targets(totals: dict, given: dict | None, temperature: float) -> dict:
    """Value to share of tokens."""
    want = {v: given.get(v, 0.0) if given is not None else float(t) ** temperature if t else 0.0 for v, t in totals.items()}
    whole = sum(want.values())
    return {v: w / whole if whole else 0.0 for v, w in want.items()}


def _settled(off: float, targets: dict | None) -> None:
    """Tell if the last sweep still scaled something by 1 +- ``off``."""
    if off < TOLERANCE * 1e3:
        return
    what = f"raking: after {SWEEPS} sweeps the shares still miss their targets by a factor of 1 +- {off:.3g}"
    if targets:
        raise ValueError(f"{what}; the targets can't hold together")
    warnings.warn(what, stacklevel=2)


def _local_weights(cells: list, targets: dict | None, temperature: float) -> np.ndarray:
    """Raked weight of each cell (source, lang, topic, tokens)."""
    tokens = np.array([c[3] for c in cells], float)
    weight = np.ones(len(cells))
    sides = []
    for d, name in enumerate(DIMENSIONS):
        values = sorted({c[d] for c in cells}, key=lambda v: (v is None, v or ""))
        place = {v: i for i, v in enumerate(values)}
        code = np.array([place[c[d]] for c in cells], int)
        totals = np.bincount(code, tokens, minlength=len(values))
        want = _targets(dict(zip(values, totals)), (targets or {}).get(name), temperature)
        sides.append((code, np.array([want[v] for v in values]) * tokens.sum()))
    off = 0.0
    for _ in range(SWEEPS):
        off = 0.0
        for code, want in sides:
            have = np.bincount(code, tokens * weight, minlength=len(want))
            factor = np.divide(want, have, out=np.ones_like(want), where=have > 0)
            off = max(off, float(np.abs(factor[(have > 0) & (want > 0)] - 1).max(initial=0.0)))
            weight *= factor[code]
        if off < TOLERANCE:
            break
    _settled(off, targets)
    return weight


def _raked_table(cells: DataFrame, targets: dict | None, temperature: float) -> DataFrame:
    """As ``_local_weights``, on a table of cells: one written table for each sweep."""
    whole = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    spark = cells.sparkSession
    wants = {}
    for name in DIMENSIONS:
        totals = cells.groupBy(F.col(name).alias("value")).agg(F.sum("tokens").alias("t"))
        given = (targets or {}).get(name)
        if given is None:
            raw = totals.select("value", F.when(F.col("t") > 0, F.pow(F.col("t").cast("double"), F.lit(temperature))).otherwise(0.0).alias("w"))
        else:
            raw = totals.join(spark.createDataFrame(list(given.items()), "value string, w double").withColumnRenamed("value", "v"), F.col("value").eqNullSafe(F.col("v")), "left").select("value", F.coalesce("w", F.lit(0.0)).alias("w"))
        raw = written(raw, "mix-targets")
        total = raw.agg(F.sum("w")).first()[0] or 0.0
        wants[name] = raw.select(F.col("value").alias("_v"), (F.col("w") * (whole / total if total else 0.0)).alias("want"))
    now = cells.withColumn("weight", F.lit(1.0))
    worst = None
    for _ in range(SWEEPS):
        off = []
        for name in DIMENSIONS:
            have = now.groupBy(F.col(name).alias("_g")).agg(F.sum(F.col("tokens") * F.col("weight")).alias("have"))
            factor = have.join(wants[name], F.col("_g").eqNullSafe(F.col("_v"))).select("_g", F.when(F.col("have") > 0, F.col("want") / F.col("have")).otherwise(1.0).alias("factor"), ((F.col("have") > 0) & (F.col("want") > 0)).alias("real"))
            now = now.join(factor, F.col(name).eqNullSafe(F.col("_g")))
            now = now.select(*DIMENSIONS, "tokens", "n", (F.col("weight") * F.col("factor")).alias("weight"), *off, F.when(F.col("real"), F.abs(F.col("factor") - 1)).otherwise(0.0).alias(f"off_{name}"))
            off.append(f"off_{name}")
        before, now = now, written(now, "mix-sweep")
        forget(before)
        worst = now.agg(F.max(F.greatest(*off))).first()[0]
        if worst is None or worst < TOLERANCE:
            break
    _settled(worst or 0.0, targets)
    return now.drop(*off)


def probabilities(docs: DataFrame, targets: dict | None = None, budget: float = BUDGET, temperature: float = TEMPERATURE, local_cells: int = LOCAL_CELLS) -> DataFrame:
    """(source, lang, topic, n, ratio, prob, weight) of each cell of ``docs`` (as from ``with_cells``); n documents."""
    spark = docs.sparkSession
    cells = docs.groupBy(*(F.col(f"_{d}").alias(d) for d in DIMENSIONS)).agg(F.sum("_tokens").alias("tokens"), F.count("*").alias("n"))
    cells = written(cells, "mix-cells")
    if cells.limit(local_cells + 1).count() <= local_cells:
        rows = sorted((tuple(r) for r in cells.collect()), key=lambda r: tuple((v is None, v or "") for v in r[:3]))
        weight = _local_weights(rows, targets, temperature)
        raked = spark.createDataFrame([(*r, float(w)) for r, w in zip(rows, weight)], "source string, lang string, topic string, tokens bigint, n bigint, weight double")
    else:
        raked = written(_raked_table(cells, targets, temperature), "mix-raked")
    whole = raked.agg(F.sum("tokens").alias("t"), F.sum(F.col("tokens") * F.col("weight")).alias("tw")).first()
    expected = (budget * whole.t / whole.tw if whole.tw else budget) * F.col("weight")
    prob = F.least(F.lit(1.0), expected)
    return written(raked.select(*DIMENSIONS, "n", F.col("weight").alias("ratio"), prob.alias("prob"), F.when(prob > 0, expected / prob).otherwise(0.0).alias("weight")), "mix-probabilities")


def _drawn(docs: DataFrame, cells: DataFrame, seed: int) -> DataFrame:
    """``docs`` (with cells) with _ratio, _prob, _weight, and _copies, how often the document is taken."""
    cell = lambda names: F.struct(*(F.col(c).alias(d) for c, d in zip(names, DIMENSIONS)))
    side = written(cells.select(cell(DIMENSIONS).alias("_cell"), "n", F.col("ratio").alias("_ratio"), F.col("prob").alias("_prob"), F.col("weight").alias("_weight")), "mix-side")
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string")).cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)
    joined = join_keyed(docs.withColumn("_cell", cell([f"_{d}" for d in DIMENSIONS])), side, "_cell", "n", "left", LOCAL_CELLS)
    expected = F.col("_prob") * F.col("_weight")
    copies = F.floor(expected) + (u < expected - F.floor(expected)).cast("bigint")
    return joined.withColumn("_copies", F.coalesce(copies, F.lit(0)).cast("bigint"))


def mix(docs: DataFrame, targets: dict | None = None, budget: float = BUDGET, temperature: float = TEMPERATURE, seed: int = SEED) -> DataFrame:
    """The documents drawn, with their own columns; a document that is taken several times is as many rows."""
    own = ["doc_id", "text", "source", "lang", *(["topic"] if "topic" in docs.columns else [])]
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), *own)  # the caller's names meet none of ours
    celled = with_cells(packed)
    drawn = _drawn(celled, probabilities(celled, targets, budget, temperature), seed).where("_copies > 0")
    return drawn.withColumn("_turn", F.explode(F.sequence(F.lit(1).cast("bigint"), "_copies"))).select("_row.*")


def mixture_sql(sweeps: int = 60) -> str:
    """``op2`` for DuckDB: as many sweeps as bring the cells to rest, one after the other."""
    topics = " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{name}'" for p, name in TOPICS)
    steps, last = [], "c"
    for i in range(sweeps):
        for d in DIMENSIONS:
            steps.append(f"{d}{i} AS MATERIALIZED (SELECT * REPLACE (weight * coalesce(want_{d} / nullif(sum(tokens * weight) OVER (PARTITION BY {d}), 0), 1) AS weight) FROM {last})")
            last = f"{d}{i}"
    shares = ", ".join(f"(SELECT sum(p) FROM (SELECT CASE WHEN sum(tokens) > 0 THEN pow(sum(tokens), {TEMPERATURE}) ELSE 0 END AS p FROM k GROUP BY {d})) AS all_{d}" for d in DIMENSIONS)
    wants = ", ".join(f"pow(sum(tokens) OVER (PARTITION BY {d}), {TEMPERATURE}) / all_{d} * (SELECT sum(tokens) FROM k) AS want_{d}" for d in DIMENSIONS)
    return f"""WITH a AS (SELECT doc_id, source, lang, coalesce(text, '') AS t FROM documents),
  d AS (SELECT doc_id, source, lang, CASE {topics} WHEN length(t) < 400 THEN 'note' ELSE 'prose' END AS topic, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens FROM a),
  k AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM d GROUP BY ALL),
  c AS MATERIALIZED (SELECT source, lang, topic, tokens, {wants}, 1.0::DOUBLE AS weight FROM k, (SELECT {shares})),
  {", ".join(steps)},
  x AS (SELECT {BUDGET} * sum(tokens) / sum(tokens * weight) AS c FROM {last}),
  p AS (SELECT source, lang, topic, weight AS ratio, c * weight AS e, least(1.0, c * weight) AS prob, CASE WHEN c * weight > 0 THEN c * weight / least(1.0, c * weight) ELSE 0 END AS weight FROM {last}, x)
  SELECT doc_id, d.source, d.lang, d.topic, n_tokens, round(ratio, 6) AS ratio, round(prob, 6) AS prob, round(weight, 6) AS weight,
    (floor(e) + (('0x' || substr(md5(concat_ws(':', '{SEED}', doc_id::VARCHAR)), 1, 13))::BIGINT / 4503599627370496.0 < e - floor(e))::INTEGER)::BIGINT AS copies, copies > 0 AS kept
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source AND d.lang IS NOT DISTINCT FROM p.lang AND d.topic = p.topic"""


def op2_raked_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's cell, raked ratio, probability, weight, and how often it is taken."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    celled = written(with_cells(docs.select("doc_id", "text", "source", "lang", *(["topic"] if "topic" in docs.columns else []))).select("doc_id", "_source", "_lang", "_topic", "_tokens"), "mix-celled", compact=False)
    drawn = _drawn(celled, probabilities(celled), SEED)
    r = lambda c: F.round(F.col(c), 6).alias(c[1:])
    return drawn.select(
        "doc_id", F.col("_source").alias("source"), F.col("_lang").alias("lang"), F.col("_topic").alias("topic"), F.col("_tokens").alias("n_tokens"), r("_ratio"), r("_prob"), r("_weight"),
        F.col("_copies").alias("copies"), (F.col("_copies") > 0).alias("kept"),
    )
