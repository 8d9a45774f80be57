"""Language identification with string kernels.

A text is the set of its byte n-grams of every length from 1 to ``LENGTHS`` (blended
spectrum), after lower-casing and with everything but letters as single spaces. The
kernel of two texts is the cosine of their presence vectors, |A & B| / sqrt(|A| |B|).

Training, on a bounded sample of labelled rows (``PER_LANGUAGE`` of each language and
``SAMPLE`` in all, those whose ids hash lowest; where there are more languages than that,
one row of each): ``LANDMARKS`` of the sample give the Nyström map, kernel ridge
regression on the mapped sample gives one weight vector for each language against the
rest, whatever the number of languages. As the kernel is a dot product of presence
vectors, landmarks and map multiply out to one matrix of n-grams by directions, and the
weights to one of directions by languages; scoring is the product of a batch's presence
matrix with the two (with their product, where there are fewer languages than directions).

N-grams are told apart by a hash to ``BINS`` bins; the sample and the texts to score use
the same bins.

A text's score is the share of the best language among exp(4 * f) of all languages'
values f. ``identified`` takes a text whose score is below ``LEAST_SCORE`` for one that no
learned language fits.

Defined results: null texts, and texts without a letter, are ``und`` with score 0; texts
of any length are scored whole; rows without a language don't train; if no language can
be learned all is ``und``; of languages with the same value the first by name is
predicted; repeated rows get the same prediction each; other columns of any name are
ignored, or kept where a function says so; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tables import fresh
from ._common import least_hashed, slices, texts, utf8, written

BINS = 1 << 15
LENGTHS = (1, 2, 3, 4)
#: Bounds of the training sample and the kernel matrix, whatever the input's size.
PER_LANGUAGE, SAMPLE, LANDMARKS = 400, 4000, 256
RIDGE = 1e-3

#: ASCII letters, and all bytes of other characters.
_LETTER = np.zeros(256, bool)
_LETTER[128:] = True
_LETTER[65:91] = _LETTER[97:123] = True
#: Characters outside ASCII that aren't letters become spaces before the bytes are taken.
_NO_LETTER = r"[^\p{L}\x00-\x7F]+"


def presence(array: pa.Array) -> np.ndarray:
    """A row for each text: which bins its n-grams fall into (uint8)."""
    n = len(array)
    raw, bounds = utf8(pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(array.cast(pa.string()), "")), _NO_LETTER, " "))
    out = np.zeros((n, BINS), np.uint8)
    if not len(raw):
        return out
    row = np.repeat(np.arange(n), np.diff(bounds))
    byte = np.where(_LETTER[raw], raw, np.uint8(32)).astype(np.uint32)
    # one space for a run of them; a text's edges count as spaces
    again = np.zeros(len(byte), bool)
    again[1:] = (byte[1:] == 32) & (byte[:-1] == 32) & (row[1:] == row[:-1])
    byte, row = byte[~again], row[~again]
    flat = out.reshape(-1)
    base = row.astype(np.int64) * BINS
    gram = np.zeros(len(byte), np.uint32)
    for k in range(max(LENGTHS)):
        gram = (gram[: len(byte) - k] << np.uint32(8)) | byte[k:] if k else byte.copy()
        inside = row[: len(byte) - k] == row[k:]
        if k + 1 in LENGTHS:
            h = (gram + np.uint32(0x9E3779B9 * (k + 1) & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(15)
            h *= np.uint32(0xC2B2AE35)
            h >>= np.uint32(32 - BINS.bit_length() + 1)
            flat[base[: len(byte) - k][inside] + h[inside]] = 1
    return out


def _rows(bits: np.ndarray) -> np.ndarray:
    """Packed presence rows as unit vectors."""
    x = np.unpackbits(bits, axis=1).astype(np.float32)
    x /= np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))
    return x


def fit(bits: np.ndarray, langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> tuple[list[str], list[np.ndarray]]:
    """Language names and the matrices (bins by directions by languages) from packed presence rows."""
    names = sorted(set(langs))
    place = {name: i for i, name in enumerate(names)}
    code = np.array([place[lang] for lang in langs])
    order = np.argsort(code, kind="stable")
    by_turn = np.argsort(np.concatenate([np.arange(c) for c in np.bincount(code)]), kind="stable")
    marks = _rows(bits[order[by_turn][:landmarks]])  # as many of each language as there are
    kernel = (marks @ marks.T).astype(np.float64)
    value, vector = np.linalg.eigh(kernel)
    good = value > value[-1] * 1e-6
    half = vector[:, good] / np.sqrt(value[good])  # kernel ** -1/2 on its range
    z = np.concatenate([(_rows(bits[a : a + 256]) @ marks.T).astype(np.float64) @ half for a in range(0, len(bits), 256)])
    # each language's rows are 1 and all others -1: their sum is twice the language's own less the whole
    own = np.zeros((len(names), z.shape[1]))
    np.add.at(own, code, z)
    weights = np.linalg.solve(z.T @ z + ridge * len(z) * np.eye(z.shape[1]), (2 * own - z.sum(axis=0)).T)
    if len(names) <= z.shape[1]:
        return names, [marks.T @ (half @ weights).astype(np.float32)]
    return names, [marks.T @ half.astype(np.float32), weights.astype(np.float32)]


def held_out() -> Column:
    """Documents whose CRC of the id, as text, leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame) -> tuple[list[str], list[np.ndarray]]:
    """Fit on at most PER_LANGUAGE rows of each language, and SAMPLE in all, that are not held out."""
    labelled = texts(docs.select("doc_id", F.col("lang").cast("string").alias("lang"), "text")).where(~held_out() & F.col("lang").isNotNull())
    rows = labelled.where(F.col("text").rlike(r"\p{L}"))
    chosen = written(least_hashed(rows.select("doc_id", "lang"), "doc_id", "lang", PER_LANGUAGE), "lang-hashed")
    # the first of every language, then the second of every language, and so on
    languages = chosen.where("n = 1").count()
    chosen = chosen.orderBy("n", "lang").limit(max(SAMPLE, languages)).select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang")).distinct()
    chosen = written(chosen, "lang-sample")
    sample = rows.join(F.broadcast(chosen), (F.col("doc_id") == F.col("_id")) & (F.col("lang") == F.col("_lang"))).select("doc_id", "lang", "text")  # SAMPLE rows, or one a language

    def pack(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("bits", pa.binary())])
        for batch in batches:
            for part in slices(batch, "text", 200_000):
                bits = np.packbits(presence(part.column(2)), axis=1)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(1).cast(pa.string()), pa.array([b.tobytes() for b in bits], pa.binary())], schema=schema)

    got = sample.mapInArrow(pack, "doc_id bigint, lang string, bits binary").collect()  # 4 kB each, a bounded number
    got.sort(key=lambda r: (r.lang, r.doc_id, r.bits))
    kept = {(r.lang, r.doc_id): r for r in reversed(got)}  # repeated ids may bring more rows than the bound
    got = [kept[k] for k in sorted(kept)]
    if not got:
        return [], [np.zeros((BINS, 0), np.float32)]
    return fit(np.frombuffer(b"".join(r.bits for r in got), np.uint8).reshape(len(got), -1), [r.lang for r in got])


#: A text fits its best language if the score is at least this: as much as that of all other languages together.
LEAST_SCORE = 0.5


def predict(docs: DataFrame, model: tuple[list[str], list[np.ndarray]], *keep: str, names: tuple[str, str, str] = ("lang_pred", "score", "fits")) -> DataFrame:
    """``keep`` columns, and under ``names`` the language, the score and whether the language fits, of every whole text.

    Only the text is looked at. Kept columns must not have one of the names.
    """
    spark = docs.sparkSession
    langs, matrices = model
    sent = spark.sparkContext.broadcast(matrices)  # BINS x 256 floats at most, and 256 floats for each language
    (text,) = fresh([*keep, *names], "_text")
    own = "text" if "text" in keep else text  # the text itself is kept, or only read
    narrow = texts(docs).select(*(F.col(f"`{c}`") for c in keep), *([] if own in keep else [F.col("text").cast("string").alias(own)]))
    schema = narrow.select(*(F.col(f"`{c}`") for c in keep)).schema.add(names[0], "string").add(names[1], "double").add(names[2], "boolean")
    drops = own not in keep

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(own)
            for part in slices(batch, own, 200_000):
                array = part.column(at)
                known = np.asarray(pc.fill_null(pc.match_substring_regex(array, r"\p{L}"), False))
                pred, score, fits = np.full(part.num_rows, "und", object), np.zeros(part.num_rows), np.zeros(part.num_rows, bool)
                for a in range(0, part.num_rows if langs else 0, 128):
                    x = presence(array[a : a + 128])
                    f = x.astype(np.float32)
                    for m in sent.value:
                        f = f @ m
                    f = f / np.sqrt(np.maximum(x.sum(axis=1, dtype=np.int64), 1))[:, None]
                    best = f.argmax(axis=1)
                    some = np.flatnonzero(known[a : a + 128])
                    pred[a + some] = np.array(langs, object)[best[some]]
                    top = f.max(axis=1)
                    share = 1 / np.exp(4 * (f - top[:, None])).sum(axis=1)
                    score[a + some] = share[some]
                    fits[a + some] = (share >= LEAST_SCORE)[some]
                columns = [c for i, c in enumerate(part.columns) if not (drops and i == at)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(pred, pa.string()), pa.array(score), pa.array(fits)], names=schema.names)

    return narrow.mapInArrow(run, schema)


def op9_string_kernel_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = predict(docs.select("doc_id", held_out().alias("held_out"), "text"), train(docs), "doc_id", "held_out")
    return out.select("doc_id", "held_out", "lang_pred", "score")


def identified(docs: DataFrame) -> DataFrame:
    """``docs`` with the predicted language as ``lang``, without the texts that no learned language fits.

    A given ``lang`` trains the model, and is replaced: what follows sees the prediction
    alone. Where no language can be learned all texts go.
    """
    pred, score, fits = fresh(docs, "_pred", "_score", "_fits")
    told = predict(docs, train(docs), *docs.columns, names=(pred, score, fits)).where(F.col(fits))
    return told.select(*(F.col(pred).alias(c) if c.lower() == "lang" else F.col(f"`{c}`") for c in docs.columns))
