import random

import pytest

from matchgrid.llm import toxicity
from matchgrid.llm.toxicity import Model


def test_folding():
    assert toxicity.words_of("ІD1OT! Ｃl0wn $tupid") == ["idiot", "clown", "stupid"]
    assert toxicity.words_of("an idiot savant! b@d! a|| x!y cash$") == ["an", "idiot", "savant", "bad", "a", "xiy", "cash"]
    assert toxicity.words_of(None) == []


def brute(model, text):
    """Longest entry at each word's start, unless an exception phrase covers it."""
    ws = toxicity.words_of(text)
    covered = {k + j for p in model.exceptions for k in range(len(ws)) if ws[k : k + len(p.split())] == p.split() for j in range(len(p.split()))}
    total = 0.0
    for k, w in enumerate(ws):
        found = [e for e in model.entries if (w + " ").startswith(e)]
        if found and k not in covered:
            total += model.entries[max(found, key=len)]
    return total


def test_matching_equals_brute_force():
    rng = random.Random(3)
    model = Model({"idio": 2.0, "idiot": 3.0, "clown": 1.5, "clo": 0.25, "fi ": 0.5}, ("clown fish", "an idiot", "idiot savant"), 0.0, 1.0)
    a = model.matcher()
    for _ in range(300):
        text = " ".join(rng.choice(["idiot", "idiom", "clown", "fish", "an", "clock", "1DIOT", "x", "(an", "fish.", "fi", "savant!"]) for _ in range(rng.randrange(9)))
        total = brute(model, text)
        x = model.feature(a, text)
        assert (x == toxicity.NO_HIT) == (total == 0)
        if total:
            import math

            assert x == pytest.approx(math.log1p(total) - 0.25 * math.log1p(toxicity.fold(text).count(" ")))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    out = toxicity.op10_toxicity(spark, sf)
    assert out.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    held = out.where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    assert (held.predicted == held.toxic).mean() > 0.95
    assert ((held.score >= 0.5) == (held.predicted == 1)).all() and held.score.between(0, 1).all()


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (4, 0), (5, None), (None, 1), (99, 1)], "doc_id long, toxic int")
    for docs in (odd, none):
        model = toxicity.learn(docs.select("doc_id", "text"), labels)
        out = toxicity.scores(docs, model)
        assert out.columns == [*docs.columns, "score"] and out.count() == docs.count()
        assert out.where("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.learn(odd.select("doc_id", "text"), labels.where("false")).entries == {}
