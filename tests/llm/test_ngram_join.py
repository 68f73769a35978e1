import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from matchgrid.llm import ngram_join
from matchgrid.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(s), least.get(find(i), d)) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def planted(seed):
    """Random texts, edited copies of them in chains, a passage that many share, short texts and exact copies."""
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    passage = rng.choices(vocab, k=60)
    texts = []
    for _ in range(30):
        t = rng.choices(vocab, k=rng.choice([3, 5, 6, 8, 9, 12, 30, 120, 500]))
        texts.append(t)
        for _ in range(rng.randrange(6)):
            t = list(t)
            for _ in range(max(1, len(t) // 60)):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            texts.append(t)
            if rng.random() < 0.3:
                texts.append([x.upper() for x in t])
    texts += [passage + rng.choices(vocab, k=8) for _ in range(25)]
    texts += [rng.choices(vocab, k=10) + passage for _ in range(25)]
    rng.shuffle(texts)
    return [(k, " \n".join(t)) for k, t in enumerate(texts)]


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CHUNK", 8)
    monkeypatch.setattr(ngram_join, "TILE_BITS", 3)
    for seed, boundary in ((1, None), (2, 12), (3, 40)):  # with 12 and 40 both halves have documents
        rows = planted(seed)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        got = ngram_join.join(df, boundary=boundary).collect()
        assert sorted((tuple(r) for r in got), key=str) == brute(rows)
        assert any(r.component_id != r.doc_id for r in got)


def test_common_lines_make_cost_choose_both_halves(spark, monkeypatch):
    """Short texts made of the same few lines: their rarest shingles have long lists, so small sets enumerate subsets."""
    rng = random.Random(8)
    vocab = [f"w{k}" for k in range(900)]
    lines = [rng.choices(vocab, k=6) for _ in range(6)]
    rows = [(k, " ".join(w for x in rng.choices(lines, k=3) for w in x)) for k in range(400)]
    rows += [(1000 + k, " ".join(rng.choices(vocab, k=80))) for k in range(60)]
    rows += [(2000 + k, rows[k][1].rsplit(" ", 1)[0] + " other") for k in range(0, 460, 5)]
    monkeypatch.setattr(ngram_join, "MET", 1.0)
    chosen = []
    choose = ngram_join.choose_boundary
    monkeypatch.setattr(ngram_join, "choose_boundary", lambda sizes: chosen.append(choose(sizes)) or chosen[-1])
    got = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)
    assert 14 <= chosen[0] < 76


def test_spread_lists_keep_every_pair(monkeypatch):
    monkeypatch.setattr(ngram_join, "CHUNK", 4)
    key = np.random.default_rng(3).integers(0, 2**63, 40).astype(np.uint64)
    rank = np.full(40, int(np.ceil(ngram_join.STEPS * np.log2(40))), np.uint8)
    at, sig = ngram_join.spread(np.full(40, 7, np.uint64), rank, key)
    lists = {}
    for a, s in zip(at.tolist(), sig.tolist()):
        lists.setdefault(s, set()).add(a)
    assert {(x, y) for m in lists.values() for x in m for y in m if x < y} == {(x, y) for y in range(40) for x in range(y)}
    assert max(map(len, lists.values())) < 20


def test_odd_rows(spark, odd, none):
    got = sorted((tuple(r) for r in ngram_join.join(odd).collect()), key=str)
    assert got == brute([(r.doc_id, r.text) for r in odd.collect()])
    assert ngram_join.join(none).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**6), st.integers(4, 60), st.integers(0, 6), st.sampled_from([0, 10, 30, 100]))
def test_linked_sets_share_a_signature(seed, n, edits, boundary):
    rng = np.random.default_rng(seed)
    sketch = rng.integers(0, 4, ngram_join.SKETCH // 64).astype(np.uint8)
    sketch = np.tile(sketch, 64)
    a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
    b = np.unique(np.concatenate([a[: len(a) - edits // 2], rng.integers(0, 2**63, edits - edits // 2).astype(np.uint64)]))
    both = len(np.intersect1d(a, b))
    if 100 * both >= 80 * (len(a) + len(b) - both) and len(a) and len(b) and not np.array_equal(a, b):
        (sa, ga, _), (sb, gb, _) = (ngram_join.signatures(x, sketch, boundary) for x in (a, b))
        size, met = np.array([len(a), len(b)]), []
        for s in np.intersect1d(sa, sb):
            gone = np.array([ga[sa == s].min(), gb[sb == s].min()])
            met.append(bool(ngram_join.possible(size, gone, np.array([0]), np.array([1]))[0]))
        assert any(met)
        maps = np.frombuffer(ngram_join.parity_map(a) + ngram_join.parity_map(b), np.uint64).reshape(2, -1)
        assert len(ngram_join._passing(np.array([len(a), len(b)]), maps, np.array([0]), np.array([1])))


def test_boundary():
    assert ngram_join.choose_boundary([(10, 1.0, 1000.0), (5000, 1.0, 0.0)]) == 12
    assert ngram_join.choose_boundary([(100, 1.0, 0.0)]) == 0


def test_components(spark):
    rng = random.Random(5)
    chain = [(k, k + 1) for k in range(0, 300)] + [(1000 + rng.randrange(200), 1000 + rng.randrange(200)) for _ in range(150)] + [(5000, 5000 + k) for k in range(1, 80)]
    rng.shuffle(chain)
    got = {r.y: r.x for r in components(spark.createDataFrame(chain, "a long, b long").repartition(7)).collect()}
    root = {}
    from matchgrid.llm.components import forest, roots

    for a, b in chain:
        forest(root, a, b)
    assert got == {a: r for a, r in roots(root) if a != r}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_node_with_parents_in_two_partitions(spark):
    one, two = (spark.createDataFrame([e], "a long, b long").coalesce(1) for e in ((5, 1), (5, 2)))
    assert sorted((r.y, r.x) for r in components(one.unionByName(two)).collect()) == [(2, 1), (5, 1)]


def test_product_of_matrices_equals_single_intersections():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 9000).astype(np.uint64)
    sets = {k: np.unique(np.concatenate([rng.choice(base, 8000, replace=False), rng.integers(0, 2**63, 500).astype(np.uint64)])) for k in range(12)}
    sets[50] = sets[3][:-20]
    ids = sorted(sets)
    a, b = (np.array(x) for x in zip(*[(p, q) for p in ids for q in ids if p < q] * 8))
    one = [100 * (m := len(np.intersect1d(sets[p], sets[q]))) >= 80 * (len(sets[p]) + len(sets[q]) - m) for p, q in zip(a, b)]
    assert len(a) >= 8 * len(ids) and ngram_join.linked(sets, a, b).tolist() == one and any(one) and not all(one)


def test_pairs_in_range():
    rng = np.random.default_rng(6)
    n = rng.integers(4, 60, 300)
    at = np.flatnonzero(rng.random(300) < 0.7)
    got = sorted(tuple(sorted(p)) for a, b in ngram_join._pairs_in_range(n, at) for p in zip(a.tolist(), b.tolist()))
    assert got == sorted((x, y) for x in at.tolist() for y in at.tolist() if x < y and 100 * min(n[x], n[y]) >= 80 * max(n[x], n[y]))


def test_a_large_group_of_near_copies(spark):
    """Copies that share most lists but do not all link: chains and strangers."""
    rng = random.Random(9)
    vocab = [f"w{k}" for k in range(3000)]
    base = rng.choices(vocab, k=150)
    rows = []
    for k in range(90):
        t = list(base)
        for _ in range(rng.choice([1, 4, 9])):
            t[rng.randrange(len(t))] = rng.choice(vocab)
        rows.append((k, " ".join(t)))
    got = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)
    assert len({r.component_id for r in got}) > 1
