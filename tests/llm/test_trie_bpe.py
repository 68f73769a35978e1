import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from matchgrid.llm import trie_bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def same(texts, library):
    c = trie_bpe.codec(PATH)
    for text, ids in zip(texts, c.encode(texts), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, text
        assert c.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_odd_texts(odd, library):
    same([r.text or "" for r in odd.collect()], library)


def test_documents(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in trie_bpe.op4_trie_bpe(spark, sf).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        g = got[r.doc_id]
        assert g.n_tokens == len(ids)
        assert g.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert g.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    t = Tokenizer.from_file(PATH) if not hasattr(test_any_text, "t") else test_any_text.t
    test_any_text.t = t
    same([text], t)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("aeinrst'", max_size=12), max_size=12))
def test_mergeable_words(words):
    t = Tokenizer.from_file(PATH) if not hasattr(test_mergeable_words, "t") else test_mergeable_words.t
    test_mergeable_words.t = t
    same([" ".join(words)], t)


def test_small_caches(monkeypatch, library, spark, sf):
    monkeypatch.setattr(trie_bpe, "MAX_PIECES", 50)
    monkeypatch.setattr(trie_bpe, "MAX_PAIRS", 200)
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(30).collect()]
    same(texts, library)
    for t in texts[:10]:
        same([t], library)


def test_whole_operator(spark, odd, none, library):
    got = trie_bpe.encode(odd, PATH).collect()
    assert len(got) == odd.count()
    assert sorted(r.decoded for r in got) == sorted(library.decode(library.encode(r.text or "", add_special_tokens=False).ids, skip_special_tokens=False) for r in odd.collect())
    assert trie_bpe.encode(none, PATH).count() == 0 and trie_bpe.digests(none.select("doc_id", "text"), PATH).count() == 0
