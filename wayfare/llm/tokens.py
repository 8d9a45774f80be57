"""Token-ID output: byte-level BPE ids in Simple-8b coded binary files.

File format, all little-endian, one file for each range of documents in order:

    magic  8 bytes   "WFS8B\\0\\0\\1"
    header 4 x int64 documents, ids, blocks, ids in a block
    index            int64 id of each document (0 where it has none)
                     int64 1 for each document that has an id, else 0
                     int64 end of each document's ids in the file
                     int64 first word of each block, and one end
    words            64-bit words

Ids are coded in blocks of ``BLOCK``; each block starts at a word of its own, so any
block decodes by itself and all blocks decode side by side. The low 4 bits of a word
are its selector, the other 60 bits hold values:

    selector 0      escape: one value that needs more than 60 bits is the whole next word
    selector 1      120 zeros
    selector 2..15  60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1 values of
                    1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60 bits

Coding is greedy, as the format's authors describe it: each word takes the selector
that packs most of the next values. Both directions work on all blocks of a file at
once with numpy; only the steps within a block follow each other.

Defined results: a null or empty text is the end id alone; texts of any length are
encoded whole; documents are in ascending order of id, null ids first, repeated ids in
the order of their texts' hashes; other columns of any name are ignored; an empty table
writes no file.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.prefix import sum_before
from ._common import Words, mix, shared_dir, slices, texts, utf8, written

MAGIC = b"WFS8B\0\0\1"
BLOCK = 1024
#: Selector: how many values, bits of each. These are fixed values of the format.
COUNTS = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([64, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])

# --------------------------------------------------------------------------- coding


_LIMITS = np.uint64(1) << BITS[1:].astype(np.uint64)
_SMALL = (np.searchsorted(_LIMITS, np.arange(1 << 16, dtype=np.uint64), side="right") + 1).astype(np.uint8)


def _needs(values: np.ndarray) -> np.ndarray:
    """The densest selector that can hold each value; 16 if only an escape can."""
    if not values.size or values.max() < 1 << 16:
        return _SMALL[values.astype(np.uint16)]
    return (np.searchsorted(_LIMITS, values, side="right") + 1).astype(np.uint8)


def encode(values: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """64-bit words, and the first word of each block with one end."""
    values = np.ascontiguousarray(values, np.uint64)
    n = len(values)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    blocks = -(-n // block)
    width = block + int(COUNTS.max())
    padded = np.zeros((blocks, width), np.uint64)  # zeros beyond a block's end fit everywhere
    flat = np.zeros(blocks * block, np.uint64)
    flat[:n] = values
    padded[:, :block] = flat.reshape(blocks, block)
    sizes = np.full(blocks, block)
    sizes[-1] = n - block * (blocks - 1)

    # the first selector, from the densest, whose bits hold the next values
    need = _needs(padded)
    chosen = np.zeros((blocks, block), np.uint8)
    for s in range(15, 0, -1):  # denser ones overwrite
        fits, have = need <= s, 1
        if fits[:, :block].any():
            while 2 * have <= COUNTS[s]:  # fits[i]: the `have` values from i on fit
                fits = fits[:, : fits.shape[1] - have] & fits[:, have:]
                have *= 2
            rest = int(COUNTS[s]) - have
            if rest:
                fits = fits[:, : fits.shape[1] - rest] & fits[:, rest:]
            chosen[fits[:, :block]] = s

    at = np.zeros(blocks, np.int64)
    live = np.arange(blocks)
    begins = np.zeros((blocks, block), bool)  # where words begin
    while len(live):
        here = at[live]
        begins[live, here] = True
        here = here + COUNTS[chosen[live, here]]
        at[live] = here
        live = live[here < sizes[live]]
    place = np.flatnonzero(begins)
    block_of, position = np.divmod(place, block)
    selector = chosen.reshape(-1)[place]
    out_at = np.cumsum(1 + (selector == 0)) - (1 + (selector == 0))
    words = np.zeros(int(out_at[-1]) + 1 + int(selector[-1] == 0), np.uint64)
    words[out_at] = selector
    source = block_of * width + position
    raw = padded.reshape(-1)
    for s in np.unique(selector):
        mine = np.flatnonzero(selector == s)
        if s == 0:
            words[out_at[mine] + 1] = raw[source[mine]]
        elif BITS[s]:
            word = words[out_at[mine]]
            for i in range(COUNTS[s]):
                word |= raw[source[mine] + i] << np.uint64(4 + i * BITS[s])
            words[out_at[mine]] = word
    firsts = np.append(out_at[np.searchsorted(block_of, np.arange(blocks))], len(words))
    return words, firsts.astype(np.int64)


def decode(words: np.ndarray, firsts: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
    """The ``n`` values of the given whole blocks (the last one may be shorter)."""
    if n == 0:
        return np.zeros(0, np.uint64)
    words = np.ascontiguousarray(words, np.uint64)
    selector = (words & np.uint64(15)).astype(np.int64)
    raw = np.zeros(len(words), bool)  # words that are escaped values, not selectors
    for i in np.flatnonzero(selector == 0):
        if not raw[i]:
            raw[i + 1] = True
    heads = np.flatnonzero(~raw)
    selector = selector[heads]
    counts = COUNTS[selector]
    blocks = len(firsts) - 1
    block_of = np.searchsorted(firsts, heads + firsts[0], side="right") - 1
    before = np.cumsum(counts) - counts
    first_head = np.searchsorted(block_of, np.arange(blocks))
    width = block + int(COUNTS.max())  # a block's last word may reach beyond its end
    target = before - before[first_head][block_of] + block_of * width  # where each word's values go
    out = np.zeros(blocks * width, np.uint64)
    for s in np.unique(selector):
        mine = np.flatnonzero(selector == s)
        if s == 0:
            out[target[mine]] = words[heads[mine] + 1]
        elif BITS[s]:
            source, to = words[heads[mine]] >> np.uint64(4), target[mine]
            mask = np.uint64((1 << int(BITS[s])) - 1)
            for i in range(COUNTS[s]):
                out[to + i] = (source >> np.uint64(i * int(BITS[s]))) & mask
    return out.reshape(blocks, width)[:, :block].reshape(-1)[:n]


# --------------------------------------------------------------------------- files


def pack(doc_ids: list, ends: np.ndarray, ids: np.ndarray) -> bytes:
    """A file's bytes; about a million ids are coded at once."""
    step = BLOCK * 1024
    coded = [encode(ids[i : i + step]) for i in range(0, len(ids), step)]
    sizes = np.cumsum([0, *(len(w) for w, _ in coded)])
    firsts = np.concatenate([*(f[:-1] + a for (_, f), a in zip(coded, sizes)), sizes[-1:]])
    words = np.concatenate([w for w, _ in coded]) if coded else np.zeros(0, np.uint64)
    known = np.array([d is not None for d in doc_ids], np.int64)
    keys = np.array([0 if d is None else d for d in doc_ids], np.int64)
    head = struct.pack("<4q", len(keys), len(ids), len(firsts) - 1, BLOCK)
    return MAGIC + head + keys.tobytes() + known.tobytes() + np.asarray(ends, np.int64).tobytes() + firsts.tobytes() + words.tobytes()


class TokenFile:
    """Reads documents' ids from a file's bytes, a run of blocks at a time."""

    def __init__(self, data):
        if bytes(data[:8]) != MAGIC:
            raise ValueError("not a token file")
        self.documents, self.ids, self.blocks, self.block = struct.unpack("<4q", bytes(data[8:40]))
        at = 40
        parts = []
        for n in (self.documents, self.documents, self.documents, self.blocks + 1):
            parts.append(np.frombuffer(data, np.int64, n, at))
            at += 8 * n
        keys, known, self.ends, self.firsts = parts
        self.doc_ids = [int(k) if v else None for k, v in zip(keys, known)]
        self.words = np.frombuffer(data, np.uint64, int(self.firsts[-1]), at)

    def range(self, a: int, b: int) -> np.ndarray:
        """Ids a to b of the file."""
        lo, hi = a // self.block, -(-b // self.block)
        firsts = self.firsts[lo : hi + 1]
        got = decode(self.words[firsts[0] : firsts[-1]], firsts, min(hi * self.block, self.ids) - lo * self.block, self.block)
        return got[a - lo * self.block : b - lo * self.block]

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """Documents in order; about a million ids are decoded at once."""
        starts = np.concatenate([[0], self.ends[:-1]]) if self.documents else np.zeros(0, np.int64)
        i = 0
        while i < self.documents:
            j = max(i + 1, int(np.searchsorted(self.ends, starts[i] + (1 << 20), side="right")))
            got = self.range(int(starts[i]), int(self.ends[j - 1]))
            for k in range(i, j):
                yield self.doc_ids[k], got[starts[k] - starts[i] : self.ends[k] - starts[i]]
            i = j


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else "file://" + os.path.abspath(path) if not path.startswith("file:") else "file://" + path[5:])


def write_file(path: str, data: bytes) -> None:
    """Whole or not at all: a temporary name of this attempt's own is renamed."""
    fs, name = _filesystem(path)
    fs.create_dir(os.path.dirname(name), recursive=True)
    temporary = f"{name}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(temporary) as out:
        out.write(data)
    fs.move(temporary, name)


def read_file(path: str):
    fs, name = _filesystem(path)
    with fs.open_input_stream(name) as f:
        return f.readall()


# --------------------------------------------------------------------------- tokens


_BLANK = np.zeros(256, bool)
_BLANK[32] = True
_ASCII_SPACE = np.zeros(256, bool)
_ASCII_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True


class Encoder:
    """Texts to ids with the tokenizers library, remembering what stood between spaces.

    In byte-level BPE a single space between two characters that are no white space
    always begins a new piece, so " word" gives the same ids wherever it stands. Texts in
    which a space begins, ends or follows other white space are encoded whole instead.

    Pieces are known by a 64-bit hash, and told apart by their length and first eight
    bytes too; where two differ under one hash, the texts at hand are encoded whole. The
    memory is two sorted tables, a large and a recent one, over one pool of ids.
    """

    #: Pieces that one worker remembers: about 50 bytes each. Beyond it starts with the recent ones.
    MOST = 2_500_000
    #: New pieces are encoded this many at a time, as one text.
    TOGETHER = 200

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)  # ids of tokens that begin with a space
        self.opens[[i for t, i in vocabulary.items() if t.startswith("\u0120")]] = True
        self.pool = np.zeros(1 << 16, "<u4")
        self.used = 0
        self.base, self.recent = self._empty(), self._empty()

    @staticmethod
    def _empty() -> tuple[np.ndarray, ...]:
        """Hash (sorted), check, start in the pool, number of ids."""
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _spaced(self, pieces: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of the pieces, each after a space, and how many ids each has; both in parts to be joined."""
        ids, sizes = [], []
        groups = [pieces[i : i + self.TOGETHER] for i in range(0, len(pieces), self.TOGETHER)]
        for some, got in zip(groups, self.whole([" " + " ".join(g) for g in groups])):
            starts = np.flatnonzero(self.opens[got])
            if len(starts) == len(some):  # one opening token for each piece, or else singly
                ids.append(got)
                sizes.append(np.diff(starts, append=len(got)))
            else:
                singly = self.whole([" " + p for p in some])
                ids += singly
                sizes.append(np.array([len(i) for i in singly]))
        return ids, sizes

    def _remember(self, keys: np.ndarray, checks: np.ndarray, opening: np.ndarray, pieces: list[str]) -> None:
        """Encode and add pieces; ``keys`` is sorted and new."""
        ids, sizes = self._spaced([p for p, o in zip(pieces, opening) if not o])
        alone = self.whole([p for p, o in zip(pieces, opening) if o])
        ids, size = np.concatenate([*ids, *alone]), np.concatenate([*sizes, [len(i) for i in alone]]).astype(np.int64)
        order = np.concatenate([np.flatnonzero(~opening), np.flatnonzero(opening)])
        start = np.empty_like(size)
        count = np.empty_like(size)
        start[order] = self.used + np.cumsum(size) - size
        count[order] = size
        total = self.used + len(ids)
        if total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(total, len(self.pool) // 2), "<u4")])
        self.pool[self.used : total] = ids
        self.used = total
        self.recent = self._merged(self.recent, (keys, checks, start, count))
        if len(self.recent[0]) > max(50_000, len(self.base[0]) // 8):
            self.base, self.recent = self._merged(self.base, self.recent), self._empty()

    def _forget(self) -> None:
        """Keep the recent table alone."""
        keys, checks, start, count = self.recent
        ids = np.concatenate([np.zeros(0, "<u4"), *(self.pool[a : a + b] for a, b in zip(start, count))])
        self.base, self.recent = self._empty(), (keys, checks, np.cumsum(count) - count, count)
        self.pool, self.used = np.concatenate([ids, np.zeros(1 << 16, "<u4")]), len(ids)

    @staticmethod
    def _merged(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        at = np.searchsorted(a[0], b[0])
        return tuple(np.insert(x, at, y) for x, y in zip(a, b))

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(found, check, start, size) of sorted keys."""
        found, check, start, size = np.zeros(len(keys), bool), np.zeros(len(keys), np.uint64), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        for table in (self.base, self.recent):
            if len(table[0]):
                at = np.minimum(np.searchsorted(table[0], keys), len(table[0]) - 1)
                hit = np.flatnonzero(table[0][at] == keys)
                found[hit] = True
                for out, column in zip((check, start, size), table[1:]):
                    out[hit] = column[at[hit]]
        return found, check, start, size

    def _odd(self, array: pa.Array) -> np.ndarray:
        """Rows in which a space begins, ends or follows other white space."""
        raw, bounds = utf8(array)
        back = np.concatenate([np.full(3, 32, np.uint8), raw])
        space = np.flatnonzero(raw == 32)
        one, two, three = back[space + 2], back[space + 1], back[space]
        odd = _ASCII_SPACE[one]
        odd |= (two == 0xC2) & ((one == 0x85) | (one == 0xA0))
        odd |= ((three == 0xE2) & ((two == 0x80) | (two == 0x81))) | ((three == 0xE1) & (two == 0x9A)) | ((three == 0xE3) & (two == 0x80))
        rows = np.searchsorted(bounds, space[odd], "right") - 1
        out = np.zeros(len(array), bool)
        out[rows] = True
        some = np.flatnonzero(np.diff(bounds))
        out[some] |= (raw[bounds[some]] == 32) | (raw[bounds[some + 1] - 1] == 32)
        return out

    def __call__(self, array: pa.Array) -> list[np.ndarray]:
        """Each text's ids."""
        odd = self._odd(array)
        direct = np.flatnonzero(odd)
        out: list = [None] * len(array)
        for i, ids in zip(direct, self.whole(array.take(pa.array(direct)).to_pylist())):
            out[i] = ids
        plain = np.flatnonzero(~odd)
        for i, ids in zip(plain, self._plain(array if len(plain) == len(array) else array.take(pa.array(plain)))):
            out[i] = ids
        return out

    def _plain(self, array: pa.Array) -> list[np.ndarray]:
        if len(self.base[0]) + len(self.recent[0]) > self.MOST:
            self._forget()
        words = Words(array, _BLANK)
        n = len(words.hash)
        if not n:
            return [np.zeros(0, "<u4")] * len(array)
        first = np.zeros(n, bool)
        first[words.first[words.count > 0]] = True  # not after a space
        key = np.where(first, mix(words.hash ^ np.uint64(0x5BD1E9955BD1E995)), words.hash)
        size = words.end - words.start
        padded = np.concatenate([words.raw, np.zeros(8, np.uint8)])
        check = np.zeros(n, np.uint64)
        for k in range(8):
            check |= np.where(size > k, padded[words.start + k], 0).astype(np.uint64) << np.uint64(8 * k)
        check = check * np.uint64(0x9E3779B97F4A7C15) + size.astype(np.uint64) * np.uint64(2) + first
        keys, index, inverse = np.unique(key, return_index=True, return_inverse=True)
        checks = check[index]
        found, had, start, count = self._find(keys)
        if (checks[inverse] != check).any() or (had[found] != checks[found]).any():
            return self.whole([t or "" for t in array.to_pylist()])
        new = np.flatnonzero(~found)
        if len(new):
            raw = words.raw.tobytes()
            at = index[new]
            pieces = [raw[a:b].decode() for a, b in zip(words.start[at].tolist(), words.end[at].tolist())]
            self._remember(keys[new], checks[new], first[at], pieces)
            _, _, start, count = self._find(keys)
        size = count[inverse]
        ends = np.cumsum(size)
        ids = self.pool[np.repeat(start[inverse] - (ends - size), size) + np.arange(ends[-1])]
        cuts = np.concatenate([[0], ends])[np.append(words.first, n)]
        return [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


#: Ids in a file, about; a partition of more documents writes several files. While it packs one a task holds it three times.
FILE_IDS = 16_000_000
#: Most tasks that read files back; of more files each task reads several.
READERS = 100_000


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 0) -> DataFrame:
    """Write the documents' ids in ascending doc_id order; the manifest, one row for each file.

    Manifest: part, file (in order within the part), path, documents, ids. Range
    partitions keep the order; their number follows the data, as Spark's settings say.
    """
    ordered = texts(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    tie = F.xxhash64("text")
    ordered = ordered.repartitionByRange(F.col("doc_id"), tie).sortWithinPartitions(F.col("doc_id"), tie)
    ordered = ordered.select("doc_id", "text", F.spark_partition_id().alias("part"))

    def write(batches):
        run = encoder(tokenizer)
        schema = pa.schema([("part", pa.int32()), ("file", pa.int32()), ("path", pa.string()), ("documents", pa.int64()), ("ids", pa.int64())])
        end = np.array([end_id], "<u4")
        doc_ids: list = []
        held: list[np.ndarray] = []
        total, number = 0, 0

        def flush(part):
            nonlocal total, number
            ends = np.cumsum([len(h) for h in held])[1::2]  # after each document's end id
            path = f"{folder}/part-{part:06d}-{number:04d}.s8b"
            ids = np.concatenate(held)
            held.clear()
            write_file(path, pack(doc_ids, ends, ids))
            row = pa.RecordBatch.from_pydict({"part": [part], "file": [number], "path": [path], "documents": [len(doc_ids)], "ids": [int(ends[-1])]}, schema=schema)
            doc_ids.clear()
            total, number = 0, number + 1
            return row

        part = None
        for batch in batches:
            for piece in slices(batch, "text"):
                part = piece.column(2)[0].as_py()
                doc_ids += piece.column(0).to_pylist()
                for ids in run(piece.column(1)):
                    held += (ids, end)
                    total += len(ids) + 1
                if total >= FILE_IDS:
                    yield flush(part)
        if doc_ids:
            yield flush(part)

    return ordered.mapInArrow(write, "part int, file int, path string, documents bigint, ids bigint")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Read the files of a manifest (a written table) back: doc_id, start, n_tokens, ids_crc32.

    The manifest stays a table: where files start is summed up by ranges, and each task
    reads as many files as any other.
    """
    placed = sum_before(manifest, "ids", "part", "file", out="start").select("part", "file", "path", "start")
    readers = max(1, min(manifest.count(), READERS))
    frame = placed.repartitionByRange(readers, "part", "file").select("path", "start")

    def read(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
        for batch in batches:
            for path, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = TokenFile(read_file(path))
                doc_ids, counts, crcs = [], [], []
                for d, ids in found:
                    doc_ids.append(d)
                    counts.append(len(ids))
                    crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
                starts = at + np.cumsum(counts) - counts
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(crcs, pa.int64())], schema=schema)

    return frame.mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def tokens_roundtrip(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write ``docs`` as token files in the shared folder and describe what they hold."""
    return read_tokens(written(write_tokens(docs, tokenizer, shared_dir(docs.sparkSession, "tokens"), end_id), "token-manifest", compact=False))


def op4_simple8b_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens_roundtrip(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
