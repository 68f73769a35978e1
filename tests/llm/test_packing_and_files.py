import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from matchgrid.llm import packing, storage, token_files, tokens


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def test_ids_equal_the_library(library, odd):
    ids = tokens.byte_encoder(tokens.default_path())
    for r in odd.collect():
        assert ids(r.text).tolist() == library(r.text)


def test_packing_works_on_slices_of_batches(spark, odd, monkeypatch):
    assert [b.num_rows for b in packing._slices(iter([pa.record_batch({"x": range(packing.ROWS * 2 + 5)})]))] == [packing.ROWS, packing.ROWS, 5]
    rows = lambda df: sorted(df.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, str(r.source), r.start, r.offset, r.sequence_id))
    want = rows(packing.pack(odd, tokens.default_path()).drop("ids"))
    monkeypatch.setattr(packing, "ROWS", 2)
    assert rows(packing.pack(odd, tokens.default_path(), with_ids=False)) == want


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_ids_equal_the_library_on_any_text(text):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")) if not hasattr(test_ids_equal_the_library_on_any_text, "t") else test_ids_equal_the_library_on_any_text.t
    test_ids_equal_the_library_on_any_text.t = t
    assert tokens.byte_encoder(tokens.default_path())(text).tolist() == t.encode(text, add_special_tokens=False).ids


@given(st.integers(1, 32), st.lists(st.integers(0, 2**32 - 1), max_size=70))
def test_packing_bits_round_trip(width, ids):
    ids = np.array(ids, np.uint32) & np.uint32((1 << width) - 1)
    data = token_files.pack(ids, width)
    assert len(data) == -(-len(ids) * width // 8)
    assert token_files.unpack(data, len(ids), width).tolist() == ids.tolist()


def test_shard_random_access():
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 50257, n).astype(np.uint32) for n in (0, 1, 5, 10000, 3)]
    for width in (16, 17):
        shard = token_files.Shard(token_files.encode_shard([3, None, 5, -6, 7], docs, width, block=64))
        assert shard.doc_ids == [3, None, 5, -6, 7]
        flat = np.concatenate(docs)
        assert all(shard.document(k).tolist() == d.tolist() for k, d in enumerate(docs))
        assert shard.read(100, 1000).tolist() == flat[100:1000].tolist()


def check_files(spark, df, library):
    path = storage.new_path(spark, "test-files")
    manifest = token_files.write_files(df, path, tokens.default_path())
    got = token_files.read_files(spark, path, manifest).collect()
    rows = df.collect()
    assert len(got) == len(rows)
    want = sorted((r.doc_id, len(library(r.text)) + 1, crc(library(r.text) + [2])) for r in rows if r.doc_id is not None)
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in got if r.doc_id is not None) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    in_order = [r.doc_id for r in sorted(got, key=lambda r: r.start) if r.doc_id is not None]
    assert in_order == sorted(in_order)


def test_files(spark, sf, odd, library, monkeypatch):
    check_files(spark, odd, library)
    monkeypatch.setattr(token_files, "SHARD_IDS", 5000)
    check_files(spark, spark.read.parquet(f"{sf}/documents.parquet"), library)


def test_files_of_an_empty_table(spark, none):
    path = storage.new_path(spark, "test-files")
    assert token_files.write_files(none, path, tokens.default_path()).isEmpty()


def check_pieces(df, got, library):
    rows = df.collect()
    texts = defaultdict(list)
    for r in rows:
        texts[r.doc_id].append(library(r.text) + [1])
    cover, sequences = defaultdict(list), defaultdict(list)
    for p in got:
        assert p.length > 0 and p.ids_crc32 == zlib.crc32(p.ids)
        cover[p.doc_id].append((p.start, p.start + p.length, p.doc_tokens))
        assert any(len(t) == p.doc_tokens and crc(t[p.start : p.start + p.length]) == p.ids_crc32 for t in texts[p.doc_id])
        sequences[p.sequence_id].append((p.offset, p.length))
    for k, ts in texts.items():
        assert sum(b - a for a, b, _ in cover[k]) == sum(map(len, ts))
        if len(ts) == 1:
            at = 0
            for a, b, _ in sorted(cover[k]):
                assert a == at
                at = b
    assert sorted(sequences) == list(range(len(sequences)))
    for k, ps in sequences.items():
        at = 0
        for a, n in sorted(ps):
            assert a == at
            at += n
        assert at == 2048 or k == len(sequences) - 1
        assert at <= 2048


def test_pack(spark, sf, odd, library):
    check_pieces(odd, packing.pack(odd, tokens.default_path()).collect(), library)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = packing.pack(docs, tokens.default_path()).collect()
    check_pieces(docs, got, library)
    total, by_window = defaultdict(int), defaultdict(lambda: defaultdict(int))
    for p in got:
        total[p.source] += p.length
        by_window[p.sequence_id // packing.WINDOW][p.source] += p.length
    n = sum(total.values())
    for k in range(len(by_window) - 1):  # all but the last hold the target share, to the tokens that rounding needs
        size = packing.WINDOW * packing.SEQUENCE
        assert max(abs(by_window[k][s] - size * t / n) for s, t in total.items()) < 2


def test_pack_past_the_bound(spark, library):
    assert packing.MAX_QUEUES < 5000
    rows = [(k, f"text {k}", f"small {k}") for k in range(5000)] + [(5000 + k, "long " * 8000, "big") for k in range(20)] + [(6000, "a few words", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = packing.pack(docs, tokens.default_path()).collect()
    check_pieces(docs, got, library)
    assert {(p.doc_id, p.source) for p in got} == {(k, s) for k, _, s in rows}
    size, total = packing.WINDOW * packing.SEQUENCE, sum(p.length for p in got)
    big = sum(p.length for p in got if p.source == "big")
    in_first = sum(p.length for p in got if p.source == "big" and p.sequence_id < packing.WINDOW)
    assert total > size and abs(in_first - size * big / total) < 2
    got = packing.pack(docs, tokens.default_path(), {"big": 1.0, "small 7": 0.01}).collect()
    check_pieces(docs, got, library)
    first = [p for p in got if p.sequence_id < packing.WINDOW]
    assert sum(p.length for p in first if p.source == "big") > 0.98 * size
    assert {p.doc_id for p in first if p.source == "small 7"} == {7}


def test_pack_nothing(none):
    assert packing.pack(none, tokens.default_path()).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 20000), min_size=1, max_size=6), st.booleans())
def test_schedule_serves_all(totals, own):
    totals = np.array(totals)
    targets = np.arange(len(totals), dtype=float) if own else None
    phases = packing.schedule(totals, targets, window=256, cycle=8)
    served, at = np.zeros(len(totals), np.int64), 0
    for first, n, takes, before in phases:
        assert first == at and (before == served).all() and (takes >= 0).all()
        at += n * int(takes.sum())
        served += n * takes.sum(axis=0)
        assert (takes.sum(axis=1) == 256).all() or at == totals.sum()
    assert (served == totals).all()


def test_deficits_stay_below_one_and_end_at_zero():
    per = np.array([1, 5, 100, 918])
    takes = packing.drr(per, 8)
    assert (takes.sum(axis=1) == 128).all() and (takes.sum(axis=0) == per).all()
    ideal = np.arange(1, 9)[:, None] * per / 8
    assert np.abs(np.cumsum(takes, axis=0) - ideal).max() <= 1.0
