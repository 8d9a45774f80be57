"""Quality rules whose cutoffs carry a guarantee on false rejection.

Base measures come from array expressions on each text. A rule rejects a text if a
measure exceeds a cutoff. The cutoffs are learned from labelled documents, for each
stratum (language): going from the most lenient cutoff of a rule to stricter ones, a
cutoff is accepted while the exact binomial test rejects "this rule loses a share of
more than ``alpha / rules`` of the stratum's good documents that pass the base rules";
the first that fails ends the sequence. All accepted cutoffs hold at once, so the one
used may be picked on the same labels: it gains most rejected bad documents less
``price`` times the good ones lost, the more lenient on ties. Sequences are tested at
level ``delta / (strata * rules)``, so with probability 1 - delta no stratum loses a
share above ``alpha`` of its good documents that pass the base rules to all learned
rules together; what the base rules reject is fixed beforehand and outside the
guarantee. A stratum with too few labels gets no cutoff: it keeps everything that passes
the base rules.

Only DataFrame expressions run on the executors.

Defined results: a null or empty text has no words and fails the base rules; a null
stratum is a stratum; texts of any length are measured whole; of cutoffs with the same
gain the more lenient is used, a measure equal to a cutoff passes; labels of unknown or
repeated documents count once for each document row they match, labels of null quality
don't count; columns other than ``doc_id``, ``text`` and the stratum are ignored; an
empty table gives an empty result, an empty label table no cutoffs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import small, text_or_empty, texts, written
from ._exact import binomial_cdf

#: Each rule: a measure in [0, 1] and its cutoffs, most lenient first. Fixed beforehand, so that the tests hold.
RULES = ("symbol_share", "dup_line_share", "repeat_share", "shout_share", "pipe_share")
CUTOFFS = (0.9, 0.7, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03, 0.02)


def _let(value: Column, body) -> Column:
    """``body(value)`` with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeated_words(words: Column) -> Column:
    """Words inside a 3-word window that the text holds twice or more.

    The windows' hashes are sorted with their places; neighbours that are equal give
    the places of repeated windows, and sorted places p the number of words covered,
    the sum of min(3, next p - p). Texts without equal hashes skip the sort of places.
    """

    def of(w: Column) -> Column:
        one = F.transform(w, lambda x: F.xxhash64(x))
        return _let(one, lambda h: _let(F.zip_with(F.zip_with(h, F.slice(h, F.lit(2), F.size(h)), lambda a, b: F.struct(a, b)), F.slice(h, F.lit(3), F.size(h)), lambda ab, c: F.when(c.isNotNull(), F.xxhash64(ab, c))), count))

    def count(padded: Column) -> Column:
        # the last two windows lack words and are null
        return _let(F.slice(padded, F.lit(1), F.size(padded) - 2), lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("bigint")).otherwise(covered(g)))

    def covered(g: Column) -> Column:
        placed = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))

        def places(s: Column) -> Column:
            after = F.zip_with(s, F.slice(s, F.lit(2), F.size(s)), lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False)))  # equal to the next
            both = F.zip_with(s, after, lambda a, e: F.struct(a["p"].alias("p"), e.alias("e")))
            before = F.concat(F.array(F.lit(False)), after)
            kept = F.zip_with(both, F.slice(before, F.lit(1), F.size(s)), lambda a, e: F.when(a["e"] | e, a["p"]))
            return F.sort_array(F.array_compact(kept))

        def words_of(p: Column) -> Column:
            gaps = F.zip_with(p, F.slice(p, F.lit(2), F.size(p)), lambda a, b: F.coalesce(F.least(b - a, F.lit(3)), F.lit(3)))
            return F.aggregate(gaps, F.lit(0).cast("bigint"), lambda s, x: s + x)

        return _let(placed, lambda s: _let(places(s), words_of))

    return F.when(F.size(words) < 4, F.lit(0).cast("bigint")).otherwise(_let(words, of))


def measures(docs: DataFrame, *keep: str) -> DataFrame:
    """The base measures of every whole text, with the columns of ``keep``."""
    text = text_or_empty()
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0)
    removed = lambda chars: (F.length(text) - F.length(F.translate(text, chars, ""))).cast("bigint")
    upper = F.length(F.regexp_replace(text, r"\P{Lu}+", ""))
    letters = F.length(F.regexp_replace(text, r"\P{L}+", ""))
    out = texts(docs).select(
        *keep,
        F.size(words).cast("bigint").alias("n_words"),
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("bigint").alias("word_chars"),
        removed("#*$%&|<>").alias("n_symbols"),
        _let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("bigint")).alias("n_dup_lines"),
        F.size(lines).cast("bigint").alias("n_lines"),
        _repeated_words(words).alias("n_repeat_words"),
        removed("|").alias("n_pipes"),
        upper.cast("bigint").alias("n_upper"),
        letters.cast("bigint").alias("n_letters"),
    )
    share = lambda a, b: F.when(F.col(b) > 0, F.least(F.lit(1.0), F.col(a).cast("double") / F.col(b))).otherwise(F.lit(0.0))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumns(
        {
            "symbol_share": share("n_symbols", "word_chars"),
            "dup_line_share": share("n_dup_lines", "n_lines"),
            "repeat_share": share("n_repeat_words", "n_words"),
            "shout_share": share("n_upper", "n_letters"),
            "pipe_share": share("n_pipes", "n_words"),
            "base_failed": failed,
        }
    )


def cutoffs(measured: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05, stratum: str = "lang", price: float = 3.0) -> DataFrame:
    """(stratum, one cutoff for each rule or null): the best cutoffs with the guarantee.

    ``measured`` has ``doc_id``, the stratum and the measures. The counts behind the
    tests are one row for each stratum, rule and cutoff.
    """
    known = labels.where(F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.max("quality").alias("_quality"))
    held = measured.where(~F.col("base_failed")).join(known, F.col("doc_id") == F.col("_id"))
    good = F.col("_quality") == 1
    pairs = [(r, i, c) for r in RULES for i, c in enumerate(CUTOFFS)]
    count = lambda x: F.sum(x.cast("bigint"))
    counts = held.groupBy(F.col(stratum).alias("stratum")).agg(
        count(good).alias("n"),
        *(count(good & (F.col(r) > c)).alias(f"{r}_{i}") for r, i, c in pairs),
        *(count(~good & (F.col(r) > c)).alias(f"bad_{r}_{i}") for r, i, c in pairs),
    )
    counts = written(counts, "rule-counts")
    strata = max(1, counts.count())
    level = delta / (strata * len(RULES))
    tests = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(i).alias("i"), F.lit(c).alias("cutoff"), F.col(f"{r}_{i}").alias("lost"), F.col(f"bad_{r}_{i}").alias("bad")) for r, i, c in pairs))
    rows = counts.select("stratum", "n", F.inline(tests))
    rows = rows.withColumn("passed", binomial_cdf(F.col("lost"), F.col("n"), alpha / len(RULES)) <= level)
    end = F.coalesce(F.min(F.when(~F.col("passed"), F.col("i"))), F.lit(len(CUTOFFS)))
    gain = F.struct((F.col("bad") - price * F.col("lost")).alias("gain"), (-F.col("i")).alias("lenient"), F.col("cutoff"))
    best = rows.groupBy("stratum", "rule").agg(end.alias("end"), F.collect_list(gain).alias("all"))  # one entry for each cutoff
    best = best.withColumn("cutoff", F.array_max(F.filter("all", lambda x: -x["lenient"] < F.col("end")))["cutoff"])
    return best.groupBy("stratum").agg(*(F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"max_{r}") for r in RULES))


def apply_rules(docs: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05, stratum: str = "lang") -> DataFrame:
    """One row per document: base measures, ``base_failed``, ``kept`` and the first rule that rejects.

    The measures, narrow rows, are kept on disk: they serve the calibration and the
    verdicts.
    """
    measured = written(measures(docs, "doc_id", stratum), "rule-measures", compact=False)
    limits = written(cutoffs(measured, labels, alpha, delta, stratum), "rule-cutoffs")
    joined = measured.join(small(limits, 100_000), F.col(stratum).eqNullSafe(F.col("stratum")), "left")
    broken = F.coalesce(*(F.when(F.col(r) > F.col(f"max_{r}"), F.lit(r)) for r in RULES))
    return joined.withColumn("rule", broken).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def op10_risk_controlled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality verdicts on all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return apply_rules(docs, labels).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"
    )
