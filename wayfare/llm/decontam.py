"""Benchmark decontamination by latent semantic retrieval and alignment checks.

1. Statistics: the number of documents each word (hashed to ``IDF_BINS`` bins) occurs in,
   over all documents, gives inverse document frequencies. Runs of words that the
   benchmark has too are left out, so that leaks don't make its words look common.
2. Latent space: TF-IDF rows of the passages of all documents, in the benchmark's
   vocabulary, plus the benchmark's own passages. Their products word by word (A'A, which
   is as large as the vocabulary squared, however many rows there are) are summed in one
   read and written by tiles of ``TILE`` words. A randomised SVD finds the ``RANK`` main
   directions: every pass multiplies the tiles with a thin matrix.
3. Candidates: every window of every document, in ``SCALES`` of words at steps of
   ``STEPS``, against all benchmark passages by cosine, in blocks. The dot product is
   taken in the latent space, the window's length in the space of all words; so it is at
   most the share of the window's length that lies in the benchmark's vocabulary, and
   windows where that share is too small are passed over without loss.
   Places where a text shares ``LEAST_WORDS`` words in a row with an item are candidates
   too, whatever their cosine, so that no verbatim copy is lost.
4. Checks: a candidate's words are aligned with the item by longest common subsequence.
   A hit covers ``COVERAGE`` of the item's words, or ``COVERAGE_WITH_ANSWER`` of them and
   the answer too, in one and the same place; the answer of an item is given, or else its last ``ANSWER_SHARE`` of words.

The corpus is read three times, however many items there are: for the document counts
(with the runs of all items left out), for the products of all blocks' vocabularies, and
for the search. Nothing is taken from a sample. The benchmark is small against the corpus: it is taken in blocks of
``ITEMS_PER_BLOCK`` items, and of about as many passages as the space has directions,
each with its own space, fitted on all documents. Directions that passages still lose
are added to the space, so that each keeps ``KEPT`` of its length. The search looks at
all spaces at once, a word is looked up once for all of them; spaces of more than
``SPACES_BYTES`` in all take another search for each such share. The driver holds the
items' words, vocabularies and runs, 24 bytes for each word of the benchmark.

Defined results: null and empty texts and items match nothing; an item of fewer than
``LEAST_WORDS`` words can't be told from chance inside a text, and matches a text that
has its words and no others; texts of any length are searched whole; of the places where
a text holds an item the one of most coverage is told, the first of equals; repeated rows
have their hits each, repeated items count once; other columns of any name are ignored,
or kept by ``keep_uncontaminated``; an empty benchmark or table gives an empty result.
Of scripts without spaces between words each character is a word.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tables import forget, fresh
from ._common import NO_WORD, Words, mix, slices, small, texts, utf8, written

IDF_BINS = 1 << 19
RANK, OVERSAMPLE, POWER_STEPS = 256, 16, 2
#: Share of its length that each passage keeps in the space.
KEPT = 0.99
#: Of ``sample_of``, which no space is fitted on.
SAMPLE_DOCS = 20_000
#: Words of a tile of A'A; it has a row for each of them.
TILE = 128
#: Pairs of words that a task expands at once, and sums that it holds before it sends them on.
PAIRS_AT_ONCE, SUMS_HELD = 1 << 19, 1 << 20
#: Weight of the benchmark's passages in the decomposition, against the documents'.
OWN = 4.0
ITEMS_PER_BLOCK = 1000
#: Spaces that one search sends to the executors.
SPACES_BYTES = 128 << 20
STEP, SCALES = 8, (10, 16, 24, 32, 40, 56, 80)
#: Steps of the windows of each scale.
STEPS = (2, 4, STEP, STEP, STEP, STEP, STEP)
#: A word in fewer than this share of the documents weighs hardly more than one in this share: leaks make benchmark words less rare than chance words.
RARE = 0.001
#: Words in more than this share of the documents say next to nothing of a passage; they keep the weight FLOOR.
COMMON, FLOOR = 0.05, 0.05
#: Words of a document's passage in the decomposition.
PASSAGE = 40
COSINE = 0.33
COVERAGE, COVERAGE_WITH_ANSWER, ANSWER_SHARE, LEAST_WORDS = 0.7, 0.5, 0.2, 5


def _bin(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - (IDF_BINS.bit_length() - 1))).astype(np.int64)


#: First bytes of characters that are written without spaces: each is taken as a word.
_FIRST = np.zeros(256, bool)
_FIRST[[0xE0, 0xE1, *range(0xE3, 0xEA), 0xEF, 0xF0]] = True
_UNSPACED = r"([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}])"


def words_of(array: pa.Array) -> Words:
    """Words in lower case; of scripts without spaces between words, characters."""
    if _FIRST[utf8(array)[0]].any():
        array = pc.replace_substring_regex(array, _UNSPACED, r" \1 ")
    return Words(array, NO_WORD, lower=True)


def document_frequencies(docs: DataFrame, leaks: np.ndarray | None = None) -> tuple[int, np.ndarray]:
    """Documents with words, and of these how many each bin's words occur in.

    ``leaks`` are sorted hashes of LEAST_WORDS words in a row; words inside such a run
    don't count. A benchmark's own runs are given here, or else an item that has leaked
    into many documents would make its words look common, and hide itself.
    """
    sent = docs.sparkSession.sparkContext.broadcast(leaks if leaks is not None else np.zeros(0, np.uint64))

    def count(batches):
        total = np.zeros(IDF_BINS, np.int32)
        n = 0
        for batch in batches:
            for part in slices(batch, "text"):
                words = words_of(part.column(0))
                free = np.ones(len(words.hash), bool)
                if len(sent.value):
                    starts, row, runs = words.windows(LEAST_WORDS)
                    hit = np.flatnonzero(_among(starts, sent.value))
                    at = words.first[row[hit]] + hit - (np.cumsum(runs) - runs)[row[hit]]
                    for i in range(LEAST_WORDS):
                        free[np.minimum(at + i, len(free) - 1)] = False
                pairs = (words.row * np.int64(IDF_BINS) + _bin(words.hash))[free]
                if part.num_rows * IDF_BINS < 1 << 32:  # half the width sorts faster
                    pairs = pairs.astype(np.uint32)
                pairs.sort()
                fresh_one = np.ones(len(pairs), bool)
                np.not_equal(pairs[1:], pairs[:-1], out=fresh_one[1:])
                np.add.at(total, pairs[fresh_one] % IDF_BINS, 1)
                n += int((words.count > 0).sum())
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1), pa.int32()), pa.array(np.append(total[some], n), pa.int64())], names=["bin", "n"])

    parts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "bin int, n bigint")
    found = parts.groupBy("bin").agg(F.sum("n").alias("n")).toArrow()  # at most IDF_BINS rows and one
    bins, counts = found["bin"].to_numpy(), found["n"].to_numpy()
    out = np.zeros(IDF_BINS)
    out[bins[bins >= 0]] = counts[bins >= 0]
    return int(counts[bins < 0].sum()), out


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values occur in a sorted array."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def runs_of(items: list[tuple]) -> np.ndarray:
    """Sorted hashes of the items' runs of LEAST_WORDS words."""
    return np.unique(words_of(pa.array([i[1] for i in items], pa.string())).windows(LEAST_WORDS)[0])


def _all_runs(items: DataFrame) -> np.ndarray:
    """As ``runs_of``, of a table."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([pa.array(words_of(part.column(0)).windows(LEAST_WORDS)[0].view(np.int64))], names=["h"])

    found = items.select("text").mapInArrow(run, "h bigint").distinct().toArrow()  # a number for each word of the benchmark
    return np.sort(found["h"].to_numpy().view(np.uint64))


def sample_of(docs: DataFrame, n_docs: int) -> DataFrame:
    """About ``SAMPLE_DOCS`` texts by hash, repeated rows apart, written. The operator itself takes no sample."""
    u = F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.monotonically_increasing_id()), 11).cast("double") / float(1 << 53)
    one = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return written(one.where(u < SAMPLE_DOCS / max(n_docs, 1)).select("text"), "latent-sample")


@dataclass
class Space:
    """What the executors need: bounded by the bins, and by a block's words and passages."""

    idf: np.ndarray  # by bin
    vocabulary: np.ndarray  # sorted hashes of the benchmark's words
    basis: np.ndarray  # words x rank
    passages: np.ndarray  # passages x rank, of length 1
    passage_item: np.ndarray
    passage_scale: np.ndarray
    items: list[tuple[int, np.ndarray, np.ndarray]]  # id, word hashes, answer's word hashes
    runs: np.ndarray = None  # sorted hashes of the items' LEAST_WORDS words in a row
    run_item: np.ndarray = None
    run_first: np.ndarray = None  # least and greatest place of the run in its item
    run_last: np.ndarray = None
    kept: np.ndarray = None  # by passage: its length in the space, and the length of what the space changes of it
    changed: np.ndarray = None
    lists: list = None  # by scale: where each word's entries begin, and each entry's passage (among the scale's) and weight

    @property
    def nbytes(self) -> int:
        """Bytes of what is sent for this space alone."""
        return sum(x.nbytes for x in (self.vocabulary, self.basis, self.passages, self.runs, self.run_item, self.run_first, self.run_last) if x is not None) + sum(16 * len(w) for _, w, _ in self.items) + sum(x.nbytes for l in self.lists or () for x in l)

    def weights(self, words: np.ndarray) -> np.ndarray:
        return self.idf[_bin(words)]

    def places(self, words: np.ndarray) -> np.ndarray:
        """Place in the vocabulary, or -1."""
        if not len(self.vocabulary):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == words, at, -1)


def _passages(words: np.ndarray) -> list[np.ndarray]:
    """An item's passages: itself, or overlapping parts that the largest window can hold."""
    most = SCALES[-1] - STEP
    if len(words) <= most:
        return [words]
    starts = [*range(0, len(words) - most, most // 2), len(words) - most]
    return [words[a : a + most] for a in starts]


def _tfidf(words: np.ndarray, space: Space) -> tuple[np.ndarray, np.ndarray]:
    """Vocabulary places and weights (summed over repeats), of length 1."""
    at = space.places(words)
    keep = at >= 0
    places, inverse = np.unique(at[keep], return_inverse=True)
    weight = np.bincount(inverse, space.weights(words)[keep], minlength=len(places))
    return places, weight / max(float(np.linalg.norm(weight)), 1e-9)


class _Sums:
    """Sums of products by cell of A'A's upper half: memory follows ``PAIRS_AT_ONCE`` and ``SUMS_HELD``."""

    def __init__(self):
        self.cells, self.sums, self.waiting, self.n_waiting = np.zeros(0, np.int64), np.zeros(0), [], 0

    def add(self, row: np.ndarray, word: np.ndarray, x: np.ndarray, n_words: int, base: int):
        """Take rows' entries, sorted by row and word, each word once a row; yield what is sent on."""
        n = len(row)
        end = np.searchsorted(row, row, "right")
        pairs = end - np.arange(n)  # an entry with itself and those after it in its row
        group = (np.cumsum(pairs) - pairs) // PAIRS_AT_ONCE
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), n]
        for a, b in zip(cuts, cuts[1:]):
            left = np.repeat(np.arange(a, b), pairs[a:b])
            right = left + np.arange(len(left)) - np.repeat(np.cumsum(pairs[a:b]) - pairs[a:b], pairs[a:b])
            self.waiting.append((base + word[left] * np.int64(n_words) + word[right], x[left] * x[right]))
            self.n_waiting += len(left)
            if self.n_waiting >= PAIRS_AT_ONCE:
                self._sum()
                if len(self.cells) >= SUMS_HELD:
                    yield from self.rest()

    def _sum(self):
        keys = np.concatenate([self.cells, *(k for k, _ in self.waiting)])
        values = np.concatenate([self.sums, *(v for _, v in self.waiting)])
        self.waiting, self.n_waiting = [], 0
        self.cells, which = np.unique(keys, return_inverse=True)
        self.sums = np.bincount(which, values, minlength=len(self.cells))

    def rest(self):
        self._sum()
        if len(self.cells):
            yield pa.RecordBatch.from_arrays([pa.array(self.cells), pa.array(self.sums)], names=["cell", "g"])
        self.cells, self.sums = np.zeros(0, np.int64), np.zeros(0)


def _tiles(sums: DataFrame, sizes: list[int]) -> DataFrame:
    """(cell, g) sums of tasks to A'A's tiles (block, tile, i, j, g), written; a block's cells come after those of the blocks before it.

    Cells are summed one by one, however many tasks there were; a tile holds ``TILE`` times a vocabulary at most.
    """
    ends = np.cumsum([n * n for n in sizes], dtype=np.int64)

    def place(batches):
        for batch in batches:
            cell, g = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            block = np.searchsorted(ends, cell, "right")
            n = np.array(sizes, np.int64)[block]
            i, j = np.divmod(cell - ends[block] + n * n, n)
            two = np.flatnonzero(i != j)  # the lower half is the upper one turned
            block, i, j, g = (np.concatenate([own, other[two]]) for own, other in ((block, block), (i, j), (j, i), (g, g)))
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), pa.array(i // TILE, pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(g, pa.float32())], names=["block", "tile", "i", "j", "g"])

    def gather(key, table):
        table = table.combine_chunks()
        one = [pa.array([table.column(c).to_numpy().tobytes()], pa.binary()) for c in ("i", "j", "g")]
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()), *one], names=["block", "tile", "i", "j", "g"])

    summed = sums.groupBy("cell").agg(F.sum("g").alias("g"))
    placed = summed.mapInArrow(place, "block int, tile int, i int, j int, g float")
    return written(placed.groupBy("block", "tile").applyInArrow(gather, "block int, tile int, i binary, j binary, g binary"), "latent-tiles")


def text_products(docs: DataFrame, vocabularies: list[np.ndarray], idf: np.ndarray) -> DataFrame:
    """Tiles of A'A for each vocabulary (block 0, 1, ...); A has a TF-IDF row of length 1 for each passage of all texts. One read."""
    every = np.unique(np.concatenate([np.zeros(0, np.uint64), *vocabularies]))
    some = np.zeros(IDF_BINS, bool)
    some[_bin(every)] = True
    local = [np.searchsorted(every, v) for v in vocabularies]
    sent = docs.sparkSession.sparkContext.broadcast((every, some, local, idf))

    def products(batches):
        every, some, local, idf = sent.value
        last = len(every)
        bases = np.concatenate([[0], np.cumsum([len(v) ** 2 for v in local])]).astype(np.int64)
        sums = _Sums()
        for batch in batches:
            for part in slices(batch, "text"):
                words = words_of(part.column(0))
                hit = np.flatnonzero(some[_bin(words.hash)])
                at = np.minimum(np.searchsorted(every, words.hash[hit]), max(last - 1, 0))
                known = every[at] == words.hash[hit] if last else np.zeros(len(hit), bool)
                hit, at = hit[known], at[known]
                row = words.row[hit]
                # a passage's number: those of the rows before it, and its place in its own row
                before = -(-words.count // PASSAGE)
                passage = (np.cumsum(before) - before)[row] + (hit - words.first[row]) // PASSAGE
                weight = idf[_bin(words.hash[hit])].astype(np.float64)
                for base, own in zip(bases, local):
                    place = np.minimum(np.searchsorted(own, at), max(len(own) - 1, 0))
                    mine = np.flatnonzero(own[place] == at) if len(own) else np.zeros(0, int)
                    if not len(mine):
                        continue
                    cell, which = np.unique(passage[mine] * np.int64(len(own)) + place[mine], return_inverse=True)
                    x = np.bincount(which, weight[mine], minlength=len(cell))
                    p, word = np.divmod(cell, len(own))
                    x /= np.sqrt(np.bincount(p, x * x))[p]
                    yield from sums.add(p, word, x, len(own), base)
        yield from sums.rest()

    read = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(products, "cell bigint, g double")
    return _tiles(read, [len(v) for v in vocabularies])


def row_products(rows: DataFrame, n_words: int) -> DataFrame:
    """As ``text_products`` of one vocabulary, of given rows (idx, w); each index once a row."""

    def products(batches):
        sums = _Sums()
        for batch in batches:
            for idx, w in zip(batch.column(0), batch.column(1)):
                i, x = np.asarray(idx.values), np.asarray(w.values)
                order = np.argsort(i)
                yield from sums.add(np.zeros(len(i), int), i[order].astype(np.int64), x[order], n_words, 0)
        yield from sums.rest()

    return _tiles(rows.mapInArrow(products, "cell bigint, g double"), [n_words])


def randomised_svd(rows: DataFrame, own: list[tuple[np.ndarray, np.ndarray]], n_words: int, rank: int = RANK) -> np.ndarray:
    """Main right singular directions of the distributed rows (idx, w) and the driver's own rows."""
    tiles = row_products(rows, n_words)
    basis = main_directions(tiles, own, n_words, rank)
    forget(tiles)
    return basis


def main_directions(tiles: DataFrame, own: list[tuple[np.ndarray, np.ndarray]], n_words: int, rank: int = RANK) -> np.ndarray:
    """Main right singular directions of distributed rows, of which A'A is given in tiles, and the driver's own rows.

    Subspace iteration: each pass returns (A'A) Q, a tile's words from each tile. The own
    rows weigh OWN times as much as all others together.
    """
    rank = min(rank, n_words)
    width = min(n_words, rank + OVERSAMPLE)
    rng = np.random.default_rng(7)
    q = np.linalg.qr(rng.standard_normal((n_words, width)))[0].astype(np.float32)
    spark = tiles.sparkSession

    def trace(batches):
        for batch in batches:
            i, j, g = (batch.column(c).to_pylist() for c in ("i", "j", "g"))
            parts = [np.frombuffer(z, np.float32)[np.frombuffer(x, np.int32) == np.frombuffer(y, np.int32)] for x, y, z in zip(i, j, g)]
            yield pa.RecordBatch.from_arrays([pa.array([float(p.sum(dtype=np.float64)) for p in parts], pa.float64())], names=["e"])

    energy = sum(r.e for r in tiles.mapInArrow(trace, "e double").collect())  # a number for each tile
    mine = sum(float((w * w).sum()) for _, w in own)
    scale = math.sqrt(OWN * energy / mine) if energy and mine else 1.0

    def product(q: np.ndarray) -> np.ndarray:
        sent = spark.sparkContext.broadcast(q)

        def part(batches):
            for batch in batches:
                for tile, i, j, g in zip(*(batch.column(c) for c in ("tile", "i", "j", "g"))):
                    first = tile.as_py() * TILE
                    dense = np.zeros((min(TILE, n_words - first), n_words), np.float32)
                    dense[np.frombuffer(i.as_buffer(), np.int32) - first, np.frombuffer(j.as_buffer(), np.int32)] = np.frombuffer(g.as_buffer(), np.float32)
                    yield pa.RecordBatch.from_arrays([pa.array([tile.as_py()], pa.int32()), pa.array([(dense @ sent.value).tobytes()], pa.binary())], names=["tile", "part"])

        out = np.zeros((n_words, width))
        for r in tiles.mapInArrow(part, "tile int, part binary").collect():  # one thin matrix
            out[r.tile * TILE : (r.tile + 1) * TILE] = np.frombuffer(r.part, np.float32).reshape(-1, width)
        for i, w in own:
            x = (w * scale).astype(np.float64)
            out[i] += x[:, None] * (x @ q[i])
        sent.unpersist()
        return out

    for _ in range(POWER_STEPS):
        q = np.linalg.qr(product(q))[0].astype(np.float32)
    small_gram = q.T.astype(np.float64) @ product(q)
    value, vector = np.linalg.eigh((small_gram + small_gram.T) / 2)
    order = np.argsort(value)[::-1][:rank]
    return (q.astype(np.float64) @ vector[:, order]).astype(np.float32)


def completed(basis: np.ndarray, own: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The basis with directions added until each of the own rows keeps ``KEPT`` of its length."""
    lost = []
    for i, x in own:
        rest = np.zeros(len(basis))
        rest[i] = x
        rest -= basis @ (x @ basis[i])
        if rest @ rest > 1 - KEPT**2:
            lost.append(rest)
    if not lost:
        return basis
    left, value, _ = np.linalg.svd(np.array(lost).T, full_matrices=False)
    return np.concatenate([basis, left[:, value > 1e-6].astype(np.float32)], axis=1)


def weights_of(n_docs: int, df: np.ndarray) -> np.ndarray:
    """Inverse document frequencies by bin."""
    idf = np.log1p(1 / (df / max(n_docs, 1) + RARE)) - math.log1p(1 / COMMON)
    return np.maximum(idf, FLOOR).astype(np.float32)


def _known(items: list[tuple[int, str, str | None]], idf: np.ndarray) -> tuple[list[tuple], np.ndarray]:
    """A block's items (id, word hashes, answer's word hashes) that are long enough, and the block's vocabulary."""
    own_words = words_of(pa.array([t for _, t, _ in items], pa.string()))
    answers = words_of(pa.array([a for *_, a in items], pa.string()))
    known = []
    for k, (item, *_) in enumerate(items):
        words = own_words.hash[own_words.first[k] : own_words.first[k] + own_words.count[k]]
        answer = answers.hash[answers.first[k] : answers.first[k] + answers.count[k]]
        if len(words) < LEAST_WORDS:
            continue
        known.append((item, words, answer if len(answer) else words[-max(1, round(ANSWER_SHARE * len(words))) :]))
    # words of weight FLOOR are left out, but for items that have hardly any others
    telling = [w[idf[_bin(w)] > FLOOR] for _, w, _ in known]
    vocabulary = np.unique(np.concatenate([t if len(np.unique(t)) > 2 else w for t, (_, w, _) in zip(telling, known)])) if known else np.zeros(0, np.uint64)
    return known, vocabulary


def build_space(docs: DataFrame, items: list[tuple[int, str, str | None]], idf: np.ndarray, rank: int = RANK, tiles: DataFrame | None = None) -> Space:
    """The latent space of one block of benchmark items (id, text, answer), fitted on all texts of ``docs``.

    ``tiles``: the block's own of ``text_products`` of the same texts, where the caller has them.
    """
    known, vocabulary = _known(items, idf)
    passages = [(p, k) for k, (_, words, _) in enumerate(known) for p in _passages(words)]
    owner = [k for _, k in passages]
    passages = [p for p, _ in passages]
    space = Space(idf, vocabulary, np.zeros((len(vocabulary), 1), np.float32), np.zeros((0, 1), np.float32), np.array(owner, int), np.zeros(0, int), known)
    if not known:
        return space
    own = [_tfidf(p, space) for p in passages]
    mine = text_products(docs, [vocabulary], idf) if tiles is None else tiles
    space.basis = completed(main_directions(mine, own, len(vocabulary), rank), own)
    forget(mine)
    latent = np.array([(x[:, None] * space.basis[i]).sum(axis=0) for i, x in own], np.float32)
    space.kept = np.linalg.norm(latent, axis=1)
    space.passages = latent / np.maximum(space.kept[:, None], 1e-9)
    space.changed = np.zeros(len(own), np.float32)
    for k, (i, x) in enumerate(own):
        back = space.basis @ latent[k]
        back[i] -= x.astype(np.float32)
        space.changed[k] = np.linalg.norm(back)
    sizes = np.array([len(p) for p in passages])
    _index_runs(space)
    space.passage_scale = np.searchsorted(np.array(SCALES) - STEPS, sizes).clip(0, len(SCALES) - 1)
    space.lists = []
    for scale in range(len(SCALES)):
        mine = [own[k] for k in np.flatnonzero(space.passage_scale == scale)]
        word = np.concatenate([np.zeros(0, int), *(i for i, _ in mine)])
        passage = np.repeat(np.arange(len(mine)), [len(i) for i, _ in mine])
        weight = np.concatenate([np.zeros(0), *(x for _, x in mine)])
        order = np.argsort(word, kind="stable")
        space.lists.append((np.searchsorted(word[order], np.arange(len(vocabulary) + 1)), passage[order], weight[order]))
    return space


def lcs(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    masks: dict[int, int] = {}
    for i, w in enumerate(a.tolist()):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b.tolist():
        u = row & masks.get(w, 0)
        row = (row + u | row - u) & full
    return len(a) - row.bit_count()


def candidates(words: Words, space: Space, cosine: float = COSINE, place: np.ndarray | None = None, weight: np.ndarray | None = None) -> list[tuple[int, int, int, int, float]]:
    """(row, passage, first word, end word, cosine) of every window that reaches the cosine.

    ``place`` and ``weight`` of the words, where the caller has them.
    """
    n = len(words.hash)
    if not n or not len(space.passages):
        return []
    place = space.places(words.hash) if place is None else place
    if not (place >= 0).any():
        return []
    weight = space.weights(words.hash).astype(np.float64) if weight is None else weight
    square = np.concatenate([[0], np.cumsum(weight**2)])
    inside = np.concatenate([[0], np.cumsum(np.where(place >= 0, weight**2, 0))])
    out = []
    stop = words.first + words.count
    for s, size in enumerate(SCALES):
        mine = np.flatnonzero(space.passage_scale == s)
        if not len(mine):
            continue
        steps = np.maximum(-(-(words.count - size) // STEPS[s]), 0) + 1
        steps[words.count == 0] = 0
        row = np.repeat(np.arange(len(steps)), steps)
        a = words.first[row] + STEPS[s] * (np.arange(len(row)) - np.repeat(np.cumsum(steps) - steps, steps))
        b = np.minimum(a + size, stop[row])
        norm = np.sqrt(square[b] - square[a])
        live = np.flatnonzero(np.sqrt(inside[b] - inside[a]) >= cosine * norm)
        begin, entry_passage, entry_weight = space.lists[s]
        for k in range(0, len(live), 1024):
            w = live[k : k + 1024]
            lengths = b[w] - a[w]
            at = np.repeat(a[w] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())  # the windows' words, one after the other
            owner = np.repeat(np.arange(len(w)), lengths)[place[at] >= 0]
            at = at[place[at] >= 0]
            # each window's words of the vocabulary once, their weights summed over repeats
            cell, again = np.unique(owner * len(space.vocabulary) + place[at], return_inverse=True)
            x = np.bincount(again, weight[at], minlength=len(cell))
            owner, word = np.divmod(cell, len(space.vocabulary))
            # the plain dot product over words that window and passage share; the latent one differs by what the space
            # changes of the passage at most, so pairs below the bound can't reach the cosine
            size_in = np.sqrt(np.bincount(owner, x * x, minlength=len(w)))
            count = begin[word + 1] - begin[word]
            of = np.repeat(np.arange(len(word)), count)
            entry = np.repeat(begin[word] - np.cumsum(count) + count, count) + np.arange(count.sum())
            plain = np.bincount(owner[of] * len(mine) + entry_passage[entry], x[of] * entry_weight[entry], minlength=len(w) * len(mine)).reshape(len(w), len(mine))
            bound = cosine * norm[w][:, None] * space.kept[mine][None, :] - size_in[:, None] * space.changed[mine][None, :] - 1e-3 * norm[w][:, None]
            i, p = np.nonzero(plain >= bound)
            if not len(i):
                continue
            some, which = np.unique(i, return_inverse=True)
            mark = np.full(len(w), -1)
            mark[some] = np.arange(len(some))
            own = mark[owner]
            x, word, own = x[own >= 0].astype(np.float32), word[own >= 0], own[own >= 0]
            latent = np.zeros((len(some), space.basis.shape[1]), np.float32)
            first = np.flatnonzero(np.diff(own, prepend=-1))
            if len(first):
                latent[own[first]] = np.add.reduceat(space.basis[word] * x[:, None], first, axis=0)
            similar = (latent[which] * space.passages[mine[p]]).sum(axis=1) / norm[w[i]]
            for j in np.flatnonzero(similar >= cosine):
                out.append((int(row[w[i[j]]]), int(mine[p[j]]), int(a[w[i[j]]]), int(b[w[i[j]]]), float(similar[j])))
    return out


def _runs_at(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hashes of the LEAST_WORDS words that begin at each place."""
    h = np.zeros(len(at), np.uint64)
    for i in range(LEAST_WORDS):
        h = h * np.uint64(0x2545F4914F6CDD1D) + words[at + i]
    return mix(h)


def _index_runs(space: Space) -> None:
    found: dict[tuple[int, int], list[int]] = {}
    for k, (_, own, _) in enumerate(space.items):
        for place, h in enumerate(_runs_at(own, np.arange(len(own) - LEAST_WORDS + 1)).tolist()):
            found.setdefault((h, k), [place, place])[1] = place
    keys = sorted(found)
    space.runs = np.array([h for h, _ in keys], np.uint64)
    space.run_item = np.array([k for _, k in keys], int)
    space.run_first, space.run_last = (np.array([found[k][i] for k in keys], int) for i in (0, 1))


def _cosine(words: np.ndarray, passages: np.ndarray, space: Space) -> float:
    """The greatest cosine of a window's words with the passages."""
    weight, place = space.weights(words).astype(np.float64), space.places(words)
    latent = (space.basis[place[place >= 0]] * weight[place >= 0][:, None]).sum(axis=0)
    return float((passages @ latent).max() / max(float(np.linalg.norm(weight)), 1e-9))


def checked(words: Words, space: Space, near: list[tuple]) -> list[tuple]:
    """(row, item, cosine, coverage, answered) of what passes the checks, of (row, item's place, first word, end word, cosine)."""
    spans: dict[tuple[int, int], list[list]] = {}
    for r, k, a, b, c in sorted(near, key=lambda x: x[:4]):
        regions = spans.setdefault((r, k), [])
        if regions and a <= regions[-1][1] + STEP:
            regions[-1][1] = max(regions[-1][1], b)
            regions[-1][2] = max((x for x in (regions[-1][2], c) if x is not None), default=None)
        else:
            regions.append([a, b, c])
    out = []
    for (r, k), regions in sorted(spans.items()):
        item, own, answer = space.items[k]
        best = None
        for a, b, c in regions:
            lo = max(words.first[r], a - len(own))
            hi = min(words.first[r] + words.count[r], b + len(own))
            text = words.hash[lo:hi]
            reach = max(2 * len(own), 16)
            # alignment within windows of twice the item's length, so that long texts don't align by chance
            for x in range(0, max(1, len(text) - reach + reach // 2), reach // 2):
                part = text[x : x + reach]
                coverage = lcs(own, part) / len(own)
                answered = lcs(answer, part) >= 0.8 * len(answer)
                # each window has to pass by itself: one of more coverage without the answer hides none that has it
                if (coverage >= COVERAGE or (answered and coverage >= COVERAGE_WITH_ANSWER)) and (best is None or coverage > best[1]):
                    best = (c, coverage, answered, a, b)
        if best:
            c, coverage, answered, a, b = best
            if c is None:
                c = _cosine(words.hash[a : min(b, a + len(own))], space.passages[space.passage_item == k], space)
            out.append((r, item, c, coverage, answered))
    return out


class Search:
    """Several blocks' spaces, and items that are too short for one; words are looked up once for all."""

    def __init__(self, spaces: list[Space], short: list[tuple[int, str]] = ()):
        self.spaces = spaces
        none = np.zeros(0, np.uint64)
        self.vocabulary = np.unique(np.concatenate([none, *(s.vocabulary for s in spaces)]))
        self.local = []
        for s in spaces:
            local = np.full(len(self.vocabulary) + 1, -1, np.int32)  # the last for words of no space
            local[np.searchsorted(self.vocabulary, s.vocabulary)] = np.arange(len(s.vocabulary))
            self.local.append(local)
        runs = np.concatenate([none, *(s.runs for s in spaces if s.runs is not None)])
        order = np.argsort(runs, kind="stable")
        column = lambda f: np.concatenate([np.zeros(0, int), *(f(i, s) for i, s in enumerate(spaces) if s.runs is not None)]).astype(int)[order]
        self.runs = runs[order]
        self.run_space = column(lambda i, s: np.full(len(s.runs), i))
        self.run_item, self.run_first, self.run_last = (column(lambda i, s, n=n: getattr(s, n)) for n in ("run_item", "run_first", "run_last"))
        self.run_size = column(lambda i, s: np.array([len(own) for _, own, _ in s.items], int)[s.run_item])
        self.run_words = np.zeros(IDF_BINS, bool)  # whether an item has a word in the bin
        for s in spaces:
            for _, own, _ in s.items:
                self.run_words[_bin(own)] = True
        words = words_of(pa.array([t for _, t in short], pa.string()))
        hashes, row, _ = words.windows(LEAST_WORDS)
        self.short: dict[int, list] = {}
        for h, r in zip(hashes.tolist(), row.tolist()):
            self.short.setdefault(h, []).append(short[r][0])

    def copies(self, words: Words) -> dict[int, list[tuple]]:
        """By space, (row, item, first word, end word, None) of where an item would stand, for each run of LEAST_WORDS words that it shares with a text."""
        n = len(words.hash) - LEAST_WORDS + 1
        if n < 1 or not len(self.runs):
            return {}
        known = self.run_words[_bin(words.hash)]
        whole = words.row[:n] == words.row[LEAST_WORDS - 1 :]
        for i in range(LEAST_WORDS):
            whole &= known[i : i + n]
        at = np.flatnonzero(whole)
        h = _runs_at(words.hash, at)
        low = np.searchsorted(self.runs, h, "left")
        count = np.searchsorted(self.runs, h, "right") - low
        place = np.repeat(at, count)
        entry = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
        row = words.row[place]
        a = np.maximum(place - self.run_last[entry], words.first[row])
        b = np.minimum(place - self.run_first[entry] + self.run_size[entry], words.first[row] + words.count[row])
        out: dict[int, list[tuple]] = {}
        for s, *hit in zip(self.run_space[entry].tolist(), row.tolist(), self.run_item[entry].tolist(), a.tolist(), b.tolist()):
            out.setdefault(s, []).append((*hit, None))
        return out

    def __call__(self, words: Words) -> list[tuple]:
        """(row, item, cosine, coverage, answered) of what passes the checks."""
        out = []
        if self.short:
            hashes, row, _ = words.windows(LEAST_WORDS)
            few = np.flatnonzero(words.count[row] < LEAST_WORDS)
            out += [(r, item, 1.0, 1.0, True) for h, r in zip(hashes[few].tolist(), row[few].tolist()) for item in self.short.get(h, ())]
        if not len(words.hash) or not self.spaces:
            return out
        weight = self.spaces[0].weights(words.hash).astype(np.float64)  # the same in all spaces
        last = len(self.vocabulary)
        at = np.minimum(np.searchsorted(self.vocabulary, words.hash), max(last - 1, 0))
        at = np.where(self.vocabulary[at] == words.hash, at, last) if last else at
        shared = self.copies(words)
        for i, space in enumerate(self.spaces):
            place = self.local[i][at]
            near = [(r, int(space.passage_item[p]), a, b, c) for r, p, a, b, c in candidates(words, space, place=place, weight=weight)]
            # shared runs go to the checks whatever their cosine; it is worked out there
            out += checked(words, space, near + shared.get(i, []))
        return out


def contamination(docs: DataFrame, benchmark: DataFrame, rank: int = RANK) -> DataFrame:
    """doc_id, text_md5, item_id, cosine, coverage, answered: what documents hold of the benchmark."""
    spark = texts(docs).sparkSession
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    items = benchmark.where("text is not null").select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"), answer.alias("answer")).distinct()

    def sizes(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                words = words_of(part.column(0))
                counts = [len(_passages(words.hash[a : a + n])) for a, n in zip(words.first, words.count)]
                yield pa.RecordBatch.from_arrays([pa.array(counts, pa.int64())], names=["n"])

    total = items.select("text").mapInArrow(sizes, "n bigint").agg(F.count("*"), F.sum("n")).first()
    n_blocks = max(1, -(-total[0] // ITEMS_PER_BLOCK), -(-(total[1] or 0) // rank))
    items = written(items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks))), "benchmark-blocks")
    n_docs, df = document_frequencies(docs, _all_runs(items))
    idf = weights_of(n_docs, df)
    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("text_md5", pa.binary()), ("item_id", pa.int64()), ("cosine", pa.float64()), ("coverage", pa.float64()), ("answered", pa.bool_())])

    def searched(search: Search) -> DataFrame:
        sent = spark.sparkContext.broadcast(search)

        def run(batches):
            import hashlib

            for batch in batches:
                for part in slices(batch, "text", 500_000):
                    words = words_of(part.column(1))
                    rows = [
                        (part.column(0)[r].as_py(), hashlib.md5(part.column(1)[r].as_py().encode()).digest(), item, c, cover, bool(ans))
                        for r, item, c, cover, ans in sent.value(words)
                    ]
                    columns = list(zip(*rows)) or [[]] * len(schema)
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        return keyed.mapInArrow(run, "doc_id bigint, text_md5 binary, item_id bigint, cosine double, coverage double, answered boolean")

    def block_of(k: int) -> list[tuple]:
        block = [(r.item_id, r.text, r.answer) for r in items.where(F.col("block") == k).collect()]
        return sorted(block, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2] or ""))

    tiles = text_products(docs, [_known(block_of(k), idf)[1] for k in range(n_blocks)], idf)
    found, spaces, short = None, [], []
    for k in range(n_blocks):
        block = block_of(k)
        spaces.append(build_space(docs, block, idf, rank, tiles.where(F.col("block") == k)))
        counts = words_of(pa.array([t for _, t, _ in block], pa.string())).count
        short += sorted({(i, t) for (i, t, _), n in zip(block, counts) if 0 < n < LEAST_WORDS}, key=str)
        if k == n_blocks - 1 or sum(s.nbytes for s in spaces) > SPACES_BYTES:
            part = searched(Search(spaces, short))
            found, spaces, short = part if found is None else found.unionByName(part), [], []
    forget(tiles)
    return found


def op6_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, benchmark item) that passes the checks."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    hits = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return hits.select("doc_id", "item_id", F.round("cosine", 4).alias("cosine"), F.round("coverage", 6).alias("coverage"), "answered")


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item."""
    key, node = fresh(docs, "_id", "_node")
    hits = written(contamination(docs, benchmark).select(F.col("doc_id").alias(key), F.col("text_md5").alias(node)).distinct(), "contaminated")
    same = F.col("doc_id").eqNullSafe(F.col(key)) & (F.unhex(F.md5(F.col("text").cast("string"))) == F.col(node))
    return docs.join(small(hits, 1_000_000), same, "left_anti")
