import itertools

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from matchgrid.llm import lattice_join


def brute(rows):
    """rows: (id, vector or None, label). (id, n_links, component, kept) of each."""
    fine = [label is not None and v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, label in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = rows[i], rows[j]
        if fine[i] and fine[j] and a[2] == b[2] and len(a[1]) == len(b[1]):
            x, y = np.array(a[1], float), np.array(b[1], float)
            if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for k, r in enumerate(rows):
        least[find(k)] = min(least.get(find(k), r[0]), r[0])
    return sorted((r[0], links[k], least[find(k)], r[0] == least[find(k)]) for k, r in enumerate(rows))


def planted(rng, dim, n=60):
    base = rng.normal(size=(n, dim))
    out = [b.astype(np.float32) for b in base]
    for b in base[:12]:
        for _ in range(rng.integers(1, 25)):
            d = rng.normal(size=dim)
            d -= d @ b / (b @ b) * b
            c = rng.uniform(0.975, 1.0)
            out.append((c * b / np.linalg.norm(b) + np.sqrt(1 - c * c) * d / np.linalg.norm(d)).astype(np.float32))
    out += out[:9] + out[:5]
    return out


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lattice_join, "CHUNK", 6)
    rng = np.random.default_rng(11)
    rows = [(k, [float(x) for x in v], int(rng.integers(3))) for k, v in enumerate([*planted(rng, 64), *planted(rng, 5, 20)])]
    rows += [(5000, None, 1), (5001, [0.0] * 64, 1), (5002, [float("nan")] * 64, 1), (5003, [None] * 64, 1), (5004, rows[0][1], None), (5005, [], 1), (5006, [float("inf")] * 64, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    got = sorted(tuple(r) for r in lattice_join.join(df).collect())
    assert got == brute(rows)
    assert lattice_join.join(df.where("false")).count() == 0


def test_recall_of_pairs_at_the_threshold():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    d = rng.normal(size=x.shape)
    d -= (d * x).sum(axis=1)[:, None] * x
    y = 0.98 * x + np.sqrt(1 - 0.98**2) * d / np.linalg.norm(d, axis=1)[:, None]
    label = np.zeros(4000, np.int64)
    a, b = lattice_join.cells(x, label), lattice_join.cells(y, label)
    met = (a == b[:, :, :1]).any(axis=(1, 2)) | (b == a[:, :, :1]).any(axis=(1, 2))
    assert met.mean() >= 0.999


@settings(max_examples=50, deadline=None)
@given(st.lists(st.floats(-3, 3), min_size=8, max_size=8))
def test_decoding_finds_the_nearest_point(x):
    x = np.array(x)
    found = lattice_join.nearest_e8(x[None])[0]
    twice = np.rint(2 * found).astype(int)
    assert len(set(twice % 2)) == 1 and found.sum() % 2 == 0
    others = found + np.concatenate([lattice_join.neighbours(), np.zeros((1, 8))])
    assert ((x - found) ** 2).sum() <= ((x - others) ** 2).sum(axis=1).min() + 1e-9
    assert len(lattice_join.neighbours()) == 240
