"""Embedding near-dedup by lattice hashing.

Each of TABLES tables projects a vector at random onto BLOCKS times eight dimensions and decodes each eight, scaled and
shifted, to the nearest point of the E8 lattice; the points together are the vector's cell. A vector lives in its own cell and
probes the PROBES neighbouring cells that its residuals point to. Two vectors meet if one's cell is among the other's cells in
some table; pairs that meet are verified by cosine in double precision. At the scale chosen, one table finds 80 % of the pairs
at cosine 0.98 exactly, seven miss about one in a hundred thousand, fewer of closer pairs; of unrelated vectors of 64 components
a table brings together about six in a hundred thousand pairs.

Vectors that are equal, with equal labels, are one class, known by a 128-bit hash, so copies are never expanded. Cells that
hold one class only are dropped before any vector is sent; cells with many classes are dealt out as pairs of chunks. Verified pairs are not written: a task adds up, for each class, the vectors that it is
linked with, counting a pair only in the least key that both share, and keeps a spanning forest of the links.

Defined results: vectors that are null, zero, empty, or hold null or non-finite components, and vectors whose label is
null, link with nothing; vectors of different lengths never link; repeated rows are vectors of one class, each other's
links; a null vec_id takes part (component_id is the least id that is not null); an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchgrid.llm import storage
from matchgrid.llm.components import components, forest, roots
from matchgrid.llm.ngram_join import _mixed, _pairs_of_lists

LEAST = 0.98
TABLES, BLOCKS, PROBES, SCALE, SEED = 7, 2, 3, 0.7, 20240607
#: Classes in a chunk of a long cell, (class, cell) rows in a bucket.
CHUNK, BUCKET_ROWS = 512, 20_000


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """The nearest integer points with an even sum: round, and where the sum is odd round the worst the other way."""
    r = np.rint(x)
    odd = np.flatnonzero(r.sum(axis=1) % 2)
    d = x[odd] - r[odd]
    k = np.abs(d).argmax(axis=1)
    r[odd, k] += np.where(d[np.arange(len(odd)), k] >= 0, 1.0, -1.0)
    return r


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest points of E8, which is D8 and D8 shifted by one half."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


@cache
def neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1, -1), repeat=2):
            v = [0.0] * 8
            v[i], v[j] = a, b
            out.append(v)
    out += [list(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


@cache
def _table(dim: int, t: int) -> tuple[np.ndarray, np.ndarray]:
    """Projection (orthonormal columns where dim allows it) and shift of a table. In each block a vector has, in the mean, the
    length it has itself, over SCALE."""
    rng = np.random.default_rng([SEED, dim, t])
    g = rng.normal(size=(dim, 8 * BLOCKS))
    g = np.linalg.qr(g)[0] * math.sqrt(dim / 8) if dim >= 8 * BLOCKS else g / math.sqrt(8)
    return g / SCALE, rng.random(8 * BLOCKS)


def _projected(unit: np.ndarray) -> np.ndarray:
    """All tables' projections side by side, on a grid of 2 ** -30, on which all that follows is exact. Sums go over the
    components in their order, whatever rows stand together, so a vector has the same cells in every task."""
    n, dim = unit.shape
    g = np.concatenate([_table(dim, t)[0] for t in range(TABLES)], axis=1)
    shift = np.concatenate([_table(dim, t)[1] for t in range(TABLES)])
    out = np.empty((n, g.shape[1]))
    for k in range(0, n, 512):
        part = np.zeros((len(unit[k : k + 512]), g.shape[1])) + shift
        for j in range(dim):
            part += unit[k : k + 512, j : j + 1] * g[j]
        out[k : k + 512] = np.rint(part * 2.0**30) / 2.0**30
    return out


#: A table's cells by what each block does: 0 is its own lattice point, k the k-th nearest of the neighbours.
_MOVES = np.array(list(itertools.product(range(PROBES + 1), repeat=BLOCKS)))


def cells(unit: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Keys (rows x TABLES x (1 + PROBES), uint64) of unit vectors; the first of each table is the vector's own cell, the others
    the cells that are cheapest to reach by moving the blocks to neighbouring points."""
    n, dim = unit.shape
    out = np.empty((n, TABLES, 1 + PROBES), np.uint64)
    near = neighbours()
    projected = _projected(unit)
    for t in range(TABLES):
        x = projected[:, 8 * BLOCKS * t : 8 * BLOCKS * (t + 1)]
        hashes, costs = np.empty((n, BLOCKS, 1 + PROBES), np.uint64), np.zeros((n, BLOCKS, 1 + PROBES))
        for b in range(BLOCKS):
            y = x[:, 8 * b : 8 * b + 8]
            own = nearest_e8(y)
            towards = (y - own) @ near.T
            closest = np.argpartition(-towards, PROBES, axis=1)[:, :PROBES]
            gain = np.take_along_axis(towards, closest, 1)
            order = np.lexsort((closest, -gain), axis=1)
            closest, gain = np.take_along_axis(closest, order, 1), np.take_along_axis(gain, order, 1)
            costs[:, b, 1:] = 2 - 2 * gain  # neighbours have the squared length two
            points = np.concatenate([own[:, None, :], own[:, None, :] + near[closest]], axis=1)
            h = np.full((n, 1 + PROBES), (b + 1) & 0xFFFFFFFF, np.uint64)
            for k in range(8):
                h = _mixed(h * np.uint64(3) + np.rint(2 * points[:, :, k]).astype(np.int64).view(np.uint64))
            hashes[:, b] = h
        seed = _mixed(np.full(n, (dim * TABLES + t) & 0xFFFFFFFF, np.uint64) + label.astype(np.int64).view(np.uint64))
        key, cost = np.repeat(seed[:, None], len(_MOVES), 1), np.zeros((n, len(_MOVES)))
        for b in range(BLOCKS):
            key = _mixed(key * np.uint64(5) + hashes[:, b][:, _MOVES[:, b]])
            cost += costs[:, b][:, _MOVES[:, b]]
        cost[:, 0] = -1  # the vector's own cell stays first
        out[:, t] = np.take_along_axis(key, np.argsort(cost, axis=1, kind="stable")[:, : 1 + PROBES], 1)
    return out


def _doubles(values: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(values.flatten().to_numpy(zero_copy_only=False), float).reshape(-1, dim)


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def join(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", tag: str = "") -> DataFrame:
    """vec_id, n_links, component_id, kept, one row per row of df."""
    v = F.col("vec")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).alias("vec"))
    fine = (
        F.col("label").isNotNull()
        & v.isNotNull()
        & (F.size(v) > 0)
        & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
        & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))
    )
    rows = rows.withColumn("fine", F.coalesce(fine, F.lit(False)))
    good = rows.where("fine").select("id", "label", "vec", F.xxhash64("label", "vec").alias("h1"), F.xxhash64(F.lit(1), "vec", "label").alias("h2"))
    classes = good.groupBy("h1", "h2").agg(F.first("label").alias("label"), F.first("vec").alias("vec"), F.min("id").alias("min_id"), F.count("*").alias("copies"))
    classes = storage.written(classes.withColumn("cid", F.monotonically_increasing_id()).withColumn("dim", F.size("vec")), "vectors", tag=tag)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(3).to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                keys = cells(_units(_doubles(part.column(2), int(dim))), part.column(1).to_numpy()).view(np.int64)
                each = TABLES * (1 + PROBES)
                flat = pa.array(keys.reshape(-1))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, each), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["cid", "keys"])

    placed = classes.select("cid", "label", "vec", "dim").mapInArrow(place, "cid long, keys array<long>")
    placed = storage.written(placed, "cells", tag=tag)
    narrow = placed.select("cid", F.posexplode("keys").alias("pos", "key")).withColumn("home", F.col("pos") % (1 + PROBES) == 0)
    size = narrow.groupBy("key").agg(F.count("*").alias("size"), F.max(F.col("home")).alias("any")).where("size > 1 and any")
    narrow = narrow.join(size, "key")
    parts = F.ceil(F.col("size") / CHUNK).cast("int")
    narrow = narrow.withColumn("chunk", F.pmod(F.xxhash64("cid"), parts).cast("int"))
    units = narrow.select(
        "cid", "key", "home", "chunk", F.explode(F.transform(F.sequence(F.lit(0), parts - 1), lambda o: F.struct(F.least(o, F.col("chunk")).alias("i"), F.greatest(o, F.col("chunk")).alias("j")))).alias("ij")
    )
    buckets = max(8, math.ceil((placed.count() * TABLES * (1 + PROBES)) / BUCKET_ROWS))
    units = units.select("cid", "key", "home", "chunk", "ij.i", "ij.j", F.pmod(F.xxhash64("key", "ij"), F.lit(buckets)).cast("int").alias("bucket"))
    full = units.join(classes.select("cid", "label", "vec", "copies", "dim"), "cid")

    def meet(table: pa.Table) -> pa.Table:
        links: dict[int, int] = {}
        trees: dict[int, int] = {}
        dims = table.column("dim").to_numpy()
        for dim in np.unique(dims):
            part = table.filter(pa.array(dims == dim)).combine_chunks()
            key, i, j, chunk, cid, home, copies = (part.column(c).to_numpy() for c in ("key", "i", "j", "chunk", "cid", "home", "copies"))
            order = np.lexsort((cid, j, i, key))
            key, i, j, chunk, cid, home, copies = (x[order] for x in (key, i, j, chunk, cid, home, copies))
            unit = _units(_doubles(part.column("vec").combine_chunks(), int(dim)))[order]
            label = part.column("label").to_numpy()[order]
            first = np.flatnonzero(np.concatenate([[True], (np.diff(key) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)]))
            length = np.diff(np.concatenate([first, [len(key)]]))
            who, row, at = np.unique(cid, return_index=True, return_inverse=True)
            keys, known = np.empty((len(who), TABLES, 1 + PROBES), np.int64), np.zeros(len(who), bool)
            for x, y in _gathered(_linked(first, length, unit, home, chunk, i == j), 50_000):
                p, q = at[x], at[y]
                new = np.unique(np.concatenate([p, q]))
                new = new[~known[new]]
                keys[new], known[new] = cells(unit[row[new]], label[row[new]]).view(np.int64), True
                own_p, own_q, top = keys[p][:, :, 0], keys[q][:, :, 0], np.iinfo(np.int64).max
                least = np.minimum(
                    np.where((keys[p] == own_q[:, :, None]).any(axis=2), own_q, top).min(axis=1), np.where((keys[q] == own_p[:, :, None]).any(axis=2), own_p, top).min(axis=1)
                )
                mine = least == key[x]
                p, q = p[mine], q[mine]
                n = np.bincount(np.concatenate([p, q]), weights=np.concatenate([copies[y[mine]], copies[x[mine]]]), minlength=len(who)).astype(np.int64)
                for c in np.flatnonzero(n).tolist():
                    links[int(who[c])] = links.get(int(who[c]), 0) + int(n[c])
                for c, d in zip(who[p].tolist(), who[q].tolist(), strict=True):
                    forest(trees, c, d)
        root = dict(roots(trees))
        ids = list(links)
        return pa.table({"cid": pa.array(ids, pa.int64()), "n": pa.array([links[c] for c in ids], pa.int64()), "root": pa.array([root.get(c, c) for c in ids], pa.int64())})

    found = storage.written(full.groupBy("bucket").applyInArrow(meet, "cid long, n long, root long"), "vector-links", tag=tag)
    sums = found.groupBy("cid").agg(F.sum("n").alias("n"))
    comps = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")), tag)
    labelled = classes.join(sums, "cid", "left").join(comps.select(F.col("y").alias("cid"), F.col("x").alias("comp")), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    least = labelled.groupBy("comp").agg(F.min("min_id").alias("component"))
    by_class = labelled.join(least, "comp").select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("links"), "component")
    linked = good.select("id", "h1", "h2").join(by_class, ["h1", "h2"]).select("id", "links", "component")
    alone = rows.where("not fine").select("id", F.lit(0).cast("long").alias("links"), F.col("id").alias("component"))
    out = linked.unionByName(alone)
    return out.select(F.col("id").alias("vec_id"), F.col("links").alias("n_links"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def _linked(first: np.ndarray, length: np.ndarray, unit: np.ndarray, home: np.ndarray, chunk: np.ndarray, same: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs in a cell whose cosine is enough: short cells together, long ones by a product of matrices."""
    short = length <= 48
    for a, b in _pairs_of_lists(first[short & (length > 1)], length[short & (length > 1)]):
        keep = (home[a] | home[b]) & (same[a] | (chunk[a] != chunk[b]))
        a, b = a[keep], b[keep]
        for k in range(0, len(a), 20_000):
            x, y = a[k : k + 20_000], b[k : k + 20_000]
            ok = np.einsum("ij,ij->i", unit[x], unit[y]) >= LEAST
            if ok.any():
                yield x[ok], y[ok]
    for s, m in zip(first[~short].tolist(), length[~short].tolist(), strict=True):
        at = slice(s, s + m)
        ok = np.triu(unit[at] @ unit[at].T >= LEAST, 1)
        ok &= home[at][:, None] | home[at][None, :]
        if not same[s]:
            ok &= chunk[at][:, None] != chunk[at][None, :]
        x, y = np.nonzero(ok)
        if len(x):
            yield x + s, y + s


def _gathered(pairs: Iterator[tuple[np.ndarray, np.ndarray]], size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same pairs in pieces of about the size, none of them much longer."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0
    for a, b in pairs:
        for k in range(0, len(a), size):
            held.append((a[k : k + size], b[k : k + size]))
            n += len(held[-1][0])
            if n >= size:
                yield np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held])
                held, n = [], 0
    if held:
        yield np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held])


def op5_lattice_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS e,
         label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
         AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS fine FROM embeddings),
l AS (SELECT a.r AS a, b.r AS b FROM v a JOIN v b ON a.label = b.label AND a.fine AND b.fine AND a.r <> b.r AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT r AS a, r AS b FROM v UNION SELECT x.a, l.b FROM reach x JOIN l ON l.a = x.b),
c AS (SELECT x.a AS r, min(v.vec_id) AS component_id FROM reach x JOIN v ON v.r = x.b GROUP BY 1),
n AS (SELECT a AS r, count(*) AS n_links FROM l GROUP BY 1)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c USING (r) LEFT JOIN n USING (r)
"""
