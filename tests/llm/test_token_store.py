import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from marshgrid.llm import token_store as K

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.just(0), st.just(1), st.integers(0, 60000), st.integers(0, 2 ** 64 - 1)), max_size=3000))
def test_pack_round_trip(ids):
    ids = np.array(ids, dtype=np.uint64)
    words, first = K.pack(ids)
    assert (K.unpack(words, first, len(ids)) == ids).all()
    # Every block can be decoded without the others.
    for b in range(len(first)):
        end = first[b + 1] if b + 1 < len(first) else len(words)
        own = ids[b * K.BLOCK:(b + 1) * K.BLOCK]
        assert (K.unpack(words[first[b]:end], np.zeros(1, np.int64), len(own)) == own).all()


@pytest.mark.parametrize("width", range(1, 64))
def test_word_holds_what_its_selector_says(width):
    ids = np.full(K.BLOCK, (1 << width) - 1, dtype=np.uint64)
    s = int(np.searchsorted(K.WIDTHS, width))
    expected = 2 * K.BLOCK if s == K.ESCAPE else -(-K.BLOCK // K.COUNTS[s])
    words, first = K.pack(ids)
    assert (K.unpack(words, first, len(ids)) == ids).all() and len(words) <= expected + 16


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab ,.\n\t　\xa0\x1cé'日1", max_size=30), min_size=1, max_size=5))
def test_words_apart_equal_whole_texts(texts):
    got = [np.frombuffer(x, "<u4").tolist() for x in K.Encoder(PATH).encode(texts)]
    assert got == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]


def test_files(spark, odd_docs, no_docs):
    rows = sorted(K.read_tokens(K.write_tokens(odd_docs, PATH)).collect(), key=lambda r: r.start)
    texts = sorted(((r.doc_id is not None, r.doc_id or 0, len(r.text or ""), r.text or "") for r in odd_docs.collect()))
    at = 0
    for r, (_, i, _, text) in zip(rows, texts, strict=True):
        ids = LIBRARY.encode(text, add_special_tokens=False).ids + [0]
        assert (r.doc_id or 0, r.start, r.n_tokens, list(r.ids)) == (i, at, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    assert K.read_tokens(K.write_tokens(no_docs, PATH)).count() == 0
