import re
import zlib

import public_tokenizers
from pyspark.sql import functions as F
from test_ngram_join import brute
from tokenizers import Tokenizer

import corpus_pipeline
from matchgrid.llm import secrets, storage
from matchgrid.llm import toxicity as tox


def steps(spark, docs, sf):
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(storage.written(stage(spark, out[-1], sf), "test-stage"))
    return out


def test_each_stage_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    d0, d1, d2, d3, d4, pieces = steps(spark, docs, sf)
    rows = [{r.doc_id: r for r in d.collect()} for d in (d0, d1, d2, d3, d4)]
    assert all(d.columns == docs.columns and d.schema == docs.schema for d in (d1, d2, d3, d4))
    model = tox.learn(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    a = model.matcher()
    assert set(rows[1]) == {k for k, r in rows[0].items() if model.score(model.feature(a, r.text)) < 0.5}
    first = {}
    for k in sorted(rows[1]):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", rows[1][k].text or ""), k)
    assert set(rows[2]) == set(first.values()) and all(rows[2][k] == rows[1][k] for k in rows[2])
    assert set(rows[3]) == {d for d, _, c in brute([(k, r.text) for k, r in rows[2].items()]) if c == d}
    assert set(rows[4]) == set(rows[3])
    assert all(rows[4][k].text == secrets.redact_text(r.text) and rows[4][k].n_chars == len(rows[4][k].text) for k, r in rows[3].items())
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = {k: t.encode(r.text or "", add_special_tokens=False).ids + [1] for k, r in rows[4].items()}
    got = pieces.collect()
    assert sum(p.length for p in got) == sum(map(len, tokens.values()))
    import numpy as np

    assert all(p.ids_crc32 == zlib.crc32(np.array(tokens[p.doc_id][p.start : p.start + p.length], "<u4").tobytes()) for p in got)
    first = corpus_pipeline.run(spark, sf)
    second = corpus_pipeline.run(spark, sf)
    assert first.count() == second.count() == len(got)  # runs do not take each other's tables


def test_odd_rows(spark, sf, odd, none):
    clash = odd.withColumn("_toxicity", F.lit("mine")).withColumn("_redacted", F.lit("own")).withColumn("_gone", F.lit(1))
    assert {(r._toxicity, r._redacted, r._gone) for r in steps(spark, clash, sf)[4].collect()} == {("mine", "own", 1)}
    for docs, n in ((odd, [12, 9, 8, 8]), (none, [0, 0, 0, 0])):
        out = steps(spark, docs, sf)
        assert [d.count() for d in out[1:5]] == n
        assert all(d.columns == docs.columns for d in out[:5])
