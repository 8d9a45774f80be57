"""Helpers shared by the corpus operators: batches of texts and word hashing."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import join_keyed, shared_dir, small, written  # noqa: F401

def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def least_hashed(rows: DataFrame, key: str, group: str, most: int) -> DataFrame:
    """At most ``most`` rows of each group, those whose key hashes lowest, with their rank ``n`` in it.

    The groups are counted first; a threshold on the hash then leaves little more than
    ``most`` rows of each, so that ranking them takes no large group to one task; repeated
    rows are one.
    """
    sizes = written(rows.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("_size")), "sample-sizes")
    u = F.shiftrightunsigned(F.xxhash64(key), 11).cast("double") / float(1 << 53)
    near = join_keyed(rows, sizes, group, "_size", max_rows=100_000).where(u * F.col("_size") < 1.3 * most + 50)
    turn = Window.partitionBy(group).orderBy(F.xxhash64(key), key)
    return near.drop("_size").distinct().withColumn("n", F.row_number().over(turn)).where(F.col("n") <= most)


# --------------------------------------------------------------------------- batches

#: Session settings for tables of long texts: batches are bounded by what texts weigh, not by 4096 or 10,000 rows.
LONG_TEXTS = {"spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20, "spark.sql.parquet.columnarReaderBatchSize": 512}


def texts(docs: DataFrame) -> DataFrame:
    """``docs``, read and sent to Python in batches of bounded size; settings that are lower already stay."""
    conf = docs.sparkSession.conf
    for key, most in LONG_TEXTS.items():
        now = str(conf.get(key)).lower().rstrip("b")
        unit = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(now[-1:], 1)
        if int(now.rstrip("kmg")) * unit > most:
            conf.set(key, str(most))
    return docs


SLICE_BYTES = 2_000_000


def _return_freed_memory() -> None:
    """Let arrays of more than a megabyte go back to the machine once they are freed.

    The C library raises this bound to the largest array that it has seen freed, and
    keeps everything below it: workers that live through many stages would only grow.
    """
    set_option = getattr(ctypes.CDLL(None), "mallopt", None)
    if set_option is not None:
        for option in (-3, -1):  # the bound from which memory is mapped by itself, and the free top of the heap that is kept
            set_option(option, 1 << 20)


_return_freed_memory()


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES):
    """Cut a record batch into runs of rows whose texts hold about ``limit`` bytes.

    A longer text is a slice of its own, so memory follows the longest text.
    """
    i = batch.schema.get_field_index(column)
    array = batch.column(i)
    if not pa.types.is_string(array.type):
        batch = batch.set_column(i, column, array.cast(pa.string()))
        array = batch.column(i)
    n = batch.num_rows
    if n == 0:
        return
    lengths = np.asarray(pc.fill_null(pc.binary_length(array), 0)).astype(np.int64)
    group = (np.cumsum(lengths) - lengths) // limit
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), n]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string array and each row's bounds in them (null: empty)."""
    array = pc.fill_null(array, "")
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    n = len(array)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = array.buffers()
    bounds = np.frombuffer(offsets, np.int32, n + 1 + array.offset)[array.offset :].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


# --------------------------------------------------------------------------- words

#: Odd multiplier of the rolling hash; its inverse modulo 2**64 takes positions out again.
_P = 0x9E3779B97F4A7C15 | 1
_INV = pow(_P, -1, 1 << 64)
_POW = np.ones(1, np.uint64)
_IPOW = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _IPOW
    if len(_POW) < n:
        size = max(n, SLICE_BYTES + 1)
        steps = np.full(size, _P, np.uint64)
        steps[0] = 1
        _POW = np.multiply.accumulate(steps)
        steps[1:] = np.uint64(_INV)
        _IPOW = np.multiply.accumulate(steps)
    return _POW, _IPOW


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


#: ASCII white space: \x20 and \x09 to \x0D.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Everything of ASCII that is no letter or digit; bytes of other characters stay in words.
NO_WORD = np.ones(256, bool)
NO_WORD[128:] = False
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    NO_WORD[_a:_b] = False


class Words:
    """Words of a slice: byte bounds, 64-bit hashes, and each row's range of words."""

    def __init__(self, array: pa.Array, breaks: np.ndarray = SPACE, lower: bool = False):
        if lower:
            array = pc.utf8_lower(array)
        raw, bounds = utf8(array)
        self.raw, self.bounds = raw, bounds
        n = len(raw)
        inside = np.empty(n + 2, bool)
        inside[0] = inside[-1] = False
        np.logical_not(breaks[raw], out=inside[1:-1])
        starts = inside[1:-1] & ~inside[:-2]
        ends = inside[1:-1] & ~inside[2:]
        edge = bounds[1:-1]
        edge = edge[(edge > 0) & (edge < n)]
        starts[edge] |= inside[1:-1][edge]
        ends[edge - 1] |= inside[1:-1][edge - 1]
        self.start = np.flatnonzero(starts)
        self.end = np.flatnonzero(ends) + 1
        power, inverse = _powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * inverse[self.start])
        self.first = np.searchsorted(self.start, bounds[:-1])  # each row's first word
        self.count = np.append(self.first[1:], len(self.start)) - self.first
        self.row = np.repeat(np.arange(len(bounds) - 1), self.count)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash of each run of ``k`` words, its row, and each row's number of runs.

        A row with 1 to k-1 words has one run, made of all its words.
        """
        n = len(self.hash)
        h = np.zeros(n, np.uint64)
        length = np.minimum(self.count, k)[self.row]  # words in a run of this row
        place = np.arange(n) - self.first[self.row]
        for i in range(k):
            m = max(n - i, 0)
            h[:m] = np.where(length[:m] > i, h[:m] * np.uint64(0x2545F4914F6CDD1D) + self.hash[i:], h[:m])
        keep = place <= (self.count[self.row] - length)
        runs = np.where(self.count > 0, np.maximum(self.count - k, 0) + 1, 0)
        return mix(h[keep]), self.row[keep], runs


def fixed_binary(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """A binary array whose row i holds the bytes of values[cuts[i]:cuts[i + 1]]."""
    values = np.ascontiguousarray(values)
    offsets = (cuts * values.itemsize).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values)])
