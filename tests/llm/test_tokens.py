import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from wayfare.llm.tokens import BLOCK, Encoder, TokenFile, decode, encode, pack, tokens_roundtrip, write_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.just(0), st.integers(0, 7), st.integers(0, 50_000), st.integers(0, 2**64 - 1)), max_size=600), st.sampled_from((4, 100, BLOCK)))
def test_coding(values, block):
    v = np.array(values, np.uint64)
    words, firsts = encode(v, block)
    assert (decode(words, firsts, len(v), block) == v).all()


def test_coding_is_dense_and_blocks_stand_alone():
    v = np.zeros(BLOCK * 3, np.uint64)
    words, firsts = encode(v)
    assert len(words) == 3 * -(-BLOCK // 120)
    rng = np.random.default_rng(1)
    v = rng.integers(0, 50_000, BLOCK * 5 + 17).astype(np.uint64)
    f = TokenFile(pack([7, None], np.array([100, len(v)]), v))
    for a, b in ((0, 5), (1000, 1100), (BLOCK * 5, len(v)), (3, len(v))):
        assert (f.range(a, b) == v[a:b]).all()
    assert [(d, len(x)) for d, x in f] == [(7, 100), (None, len(v) - 100)]
    with pytest.raises(ValueError):
        TokenFile(b"something else" * 10)


TEXTS = ["", "a", " lead", "end ", "a  b", "x.\n y", "x\n  y ", "tab\t x", "é  <|endoftext|> b", "a <|endoftext|>b", "I'm  it's\n\n\nfoo   bar", " ", "  ", "\n \n", "a  b c", "à b", "— x", "the cat the cat's", "a\x1c b", "日本 語　 x"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab '.,\n\té—  ç1", max_size=30), min_size=1, max_size=8))
def test_encoder_equals_the_library(texts):
    e = _encoder()
    assert [x.tolist() for x in e(pa.array(texts))] == [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


_ENCODER = []


def _encoder():
    if not _ENCODER:
        _ENCODER.append(Encoder(PATH))
    return _ENCODER[0]


def test_encoder_forgets():
    e = Encoder(PATH)
    e.MOST = 5
    t = Tokenizer.from_file(PATH)
    for _ in range(3):
        for text in TEXTS + ["word%d other%d more" % (i, i) for i in range(30)]:
            assert e(pa.array([text]))[0].tolist() == t.encode(text, add_special_tokens=False).ids


def test_round_trip(make, awkward, empty, spark):
    docs = awkward.unionByName(make([(100 + i, t) for i, t in enumerate(TEXTS)]))
    t = Tokenizer.from_file(PATH)
    got = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in tokens_roundtrip(docs, PATH).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((r.doc_id for r in docs.select("doc_id").collect()), key=lambda d: (d is not None, d or 0))
    at = 0
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, []).append(r.text or "")
    for doc_id, start, n, crc in got:
        assert start == at
        at += n
        ids = [[*t.encode(x, add_special_tokens=False).ids, 0] for x in texts[doc_id]]
        assert (n, crc) in [(len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for i in ids]
    assert tokens_roundtrip(empty, PATH).count() == 0
    assert write_tokens(empty, PATH, "/nowhere").collect() == []
