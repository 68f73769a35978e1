import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from matchgrid.llm import katz
from matchgrid.llm.katz import K

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def discounts(counts):
    n = Counter(counts)
    common = (K + 1) * n[K + 1] / n[1] if n[1] else 1.0
    out = {}
    for r in range(1, K + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if n[r] and common < 1 else 0
        out[r] = d if 0 < d < 1 else 1 - 0.5 / r
    return out


class Brute:
    """The model from dictionaries, of any order."""

    def __init__(self, texts, order=2):
        self.uni, self.counts = Counter(), {n: defaultdict(Counter) for n in range(2, order + 1)}
        for ws in texts:
            self.uni.update(ws)
            for n, at in self.counts.items():
                for h, w in histories(ws, n):
                    at[h][w] += 1
        self.order, self.n = order, sum(self.uni.values())
        self.d = {1: discounts(self.uni.values())} | {n: discounts([c for x in at.values() for c in x.values()]) for n, at in self.counts.items()}
        left = sum((1 - self.d[1].get(c, 1)) * c for c in self.uni.values())
        self.size, self.rest = (self.n, left) if left > 1e-9 else (self.n + 1, 1)
        self.plain = left <= 1e-9

    def p(self, w, h):
        if not h:
            c = self.uni[w]
            return (c if self.plain else c * self.d[1].get(c, 1)) / self.size if c else self.rest / self.size
        n = len(h) + 1
        seen, d = self.counts[n].get(h), self.d[n]
        if not seen:
            return self.p(w, h[1:])
        total = sum(seen.values())
        left = sum((1 - d.get(c, 1)) * c for c in seen.values())
        plain = left <= 1e-9
        size, left = (total + 1, 1) if plain else (total, left)
        if w in seen:
            c = seen[w]
            return (c if plain else c * d.get(c, 1)) / size
        return left / size / (1 - sum(self.p(x, h[1:]) for x in seen)) * self.p(w, h[1:])


def histories(ws, n):
    full = ["\n"] * (n - 1) + ws
    return [(tuple(full[k : k + n - 1]), w) for k, w in enumerate(ws)]


def words(text):
    return [*WORD.findall((text or "").translate(LOWER)), "\n"]


def check(df, got, order=2):
    rows = df.select("doc_id", "text").collect()
    held = lambda k: k is None or zlib.crc32(str(k).encode()) % 7 == 2
    model = Brute([words(r.text) for r in rows if not held(r.doc_id)], order)
    want = []
    for r in rows:
        ws = words(r.text)
        base = sum(math.log10((model.uni[w] + 1) / (model.n + len(model.uni) + 1)) for w in ws)
        score = sum(math.log10(model.p(w, h)) for h, w in histories(ws, order))
        want.append((str(r.doc_id), held(r.doc_id), len(ws), sum(model.uni[w] > 0 for w in ws), model.n, base, score))
    have = [(str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got.collect()]
    assert len(have) == len(want)
    for a, b in zip(sorted(have), sorted(want), strict=True):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], rel=1e-9)
    return model


@pytest.mark.parametrize("order", [2, 3])
def test_equals_brute_force(spark, sf, order):
    df = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 1500")
    trained, got = katz.train_and_score(df, order=order)
    model = check(df, got, order)
    for h in [*list(model.counts[order])[:: 500 * order], ("\n",) * (order - 1), ("no such word",) * (order - 1)]:
        assert sum(model.p(w, h) for w in model.uni) + model.p("no such word either", h) == pytest.approx(1, abs=1e-9)
    # The tables hold what was learned: discounted counts, and weights with which every history sums to one.
    names = {r.number: r.word or "\n" for r in trained.words().collect()}
    assert {r.word or "\n": pytest.approx(r.probability) for r in trained.words().collect()} == {w: model.p(w, ()) for w in model.uni}
    found = defaultdict(dict)
    for r in trained.grams(2).collect():
        found[(names[r.history],)][names[r.next]] = (r.discounted, r.size, r.alpha)
    assert {h: set(x) for h, x in found.items()} == {h: set(x) for h, x in model.counts[2].items()}
    for h, x in list(found.items())[::37]:
        for w, (c, size, alpha) in x.items():
            assert c / size == pytest.approx(model.p(w, h))
            assert alpha == pytest.approx(model.p("no such word", h) / model.p("no such word", ()))
    assert trained.grams(order).count() == sum(len(x) for x in model.counts[order].values())


def test_many_blocks_and_hot_histories(spark, sf, monkeypatch):
    monkeypatch.setattr(katz, "BLOCK_TOKENS", 2000)
    df = spark.read.parquet(f"{sf}/documents.parquet").limit(60).repartition(3)
    hot = spark.range(300).selectExpr("id + 1000 as doc_id", "concat('the w', id % 50, ' the x') as text")
    both = df.select("doc_id", "text").unionByName(hot)
    for order in (2, 3):
        check(both, katz.train_and_score(both, order=order)[1], order)


def test_blocks_and_buckets_are_not_shuffled_again(spark, sf):
    _, got = katz.train_and_score(spark.read.parquet(f"{sf}/documents.parquet"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Bucketed: true") == 3 and "hashpartitioning(bucket" not in plan


def test_odd_rows(spark, odd, none):
    check(odd, katz.train_and_score(odd)[1])
    assert katz.train_and_score(none)[1].count() == 0
    held = odd.where("doc_id is null")
    (row,) = katz.train_and_score(held)[1].collect()
    assert (row.train_tokens, row.n_known, row.base_score, row.score) == (0, 0, 0, 0)


def test_packs():
    from matchgrid.llm.packs import pack, unpack

    arrays = [np.array([], np.uint64), np.array([1, 2**40], np.uint64), np.array([0.5, -1.0]), np.arange(300, dtype=np.uint32)]
    out = unpack(pack(*arrays, b"a\nb"))
    assert all((a == b).all() for a, b in zip(arrays, out)) and out[-1].tobytes() == b"a\nb"
