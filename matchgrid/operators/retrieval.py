"""Query-gallery retrieval: exact distances by blocks, ranking protocols, query expansion and re-ranking.

Distances come from products of blocks of queries and blocks of gallery rows, a task for each two blocks. Where only
the nearest are needed, each task keeps its own k nearest, so that k rows a query and block are shuffled rather than
the whole gallery. Ties go to the smaller gallery id everywhere.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchgrid.functions.shared import kept as kept_rows
from matchgrid.functions.vectors import decimals, dot
from matchgrid.operators.pairs import paired, products, vectors
from matchgrid.operators.sampling import running

BLOCK = 1024


def _blocks(df: DataFrame, key: str, vector: str, side: int, cut: int) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(cut)).cast("int").alias("block"), F.lit(side).alias("side"))


def distances(queries: DataFrame, gallery: DataFrame, key: str = "crop_id", vector: str = "embedding", metric: str = "cosine", nearest: int | None = None) -> DataFrame:
    """qid, gid, dist for all pairs, or for the nearest (by dist, gid) of each query. Distances have nine decimals.

    metric: cosine (1 - cos) or euclidean (squared). The two sides are cut into blocks of about BLOCK rows. Null keys and
    vectors, ragged and non-finite vectors are errors; rows that share a key each count; an empty side gives no rows.
    """
    if metric not in ("cosine", "euclidean"):
        raise ValueError(f"unknown metric {metric!r}")
    nq, ng = (max(1, -(-df.count() // BLOCK)) for df in (queries, gallery))
    q, g = _blocks(queries, key, vector, 0, nq), _blocks(gallery, key, vector, 1, ng)
    q = q.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(ng - 1)))).select("id", "v", "side", F.col("block").alias("i"), F.col("other").alias("j"))
    g = g.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(nq - 1)))).select("id", "v", "side", F.col("other").alias("i"), F.col("block").alias("j"))

    def run(table: pa.Table) -> pa.Table:
        v = vectors(table, "v", "id")
        side, ids = table.column("side").to_numpy(), table.column("id").to_numpy()
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        b = b[np.argsort(ids[b], kind="stable")]
        if not len(a) or not len(b):
            return pa.table({"qid": pa.array([], pa.int64()), "gid": pa.array([], pa.int64()), "dist": pa.array([], pa.float64())})
        d = products(v[a], v[b], metric)
        if nearest is not None and nearest < len(b):
            order = np.argsort(d, axis=1, kind="stable")[:, :nearest]
        else:
            order = np.broadcast_to(np.arange(len(b)), d.shape)
        return pa.table({"qid": pa.array(np.repeat(ids[a], order.shape[1])), "gid": pa.array(ids[b][order].ravel()), "dist": pa.array(np.take_along_axis(d, order, axis=1).ravel())})

    out = q.unionByName(g).groupBy("i", "j").applyInArrow(run, "qid long, gid long, dist double")
    return out if nearest is None else _first(out, nearest)


#: Gallery rows that one task holds as a panel, and distances it holds at once; rows whose encodings one task makes.
PANEL, CELLS, ENCODED = 1 << 18, 1 << 21, 1 << 14


def _panels(queries: DataFrame, gallery: DataFrame, each: Callable[..., pa.Table], schema: str, key: str = "crop_id", vector: str = "embedding", named: bool = False, metric: str = "cosine") -> DataFrame:
    """What each(qids, gids, d, match, kept) makes of distances of some queries to a panel of the gallery, rows by gid.

    match: both have an identity, the same; kept: not the query's own identity under its own camera (as in labelled). Queries are
    cut into two blocks a core, so that the gallery is copied so often and no more; no row for a pair leaves a task. named: each
    also takes the panel's identities, as numbers from 0 on, null being one.
    """
    spark = queries.sparkSession
    nq, ng = max(1, queries.count()), max(1, gallery.count())
    ni, nj = max(-(-nq // PANEL), min(nq, 2 * spark.sparkContext.defaultParallelism)), -(-ng // PANEL)
    label = lambda df: [F.col("object_id").cast("long").alias("pid"), F.col("camid").cast("long").alias("cam")]
    cut = lambda n: F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(n)).cast("int")
    rows = lambda df, side, i, j: df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), *label(df), F.lit(side).alias("side"), i.alias("i"), j.alias("j"))
    everywhere = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    both = rows(queries, 0, cut(ni), everywhere(nj)).unionByName(rows(gallery, 1, everywhere(ni), cut(nj)))

    def run(table: pa.Table) -> pa.Table:
        v = vectors(table, "v", "id")
        side, ids = table.column("side").to_numpy(), table.column("id").to_numpy()
        names = {c: (table.column(c).fill_null(0).to_numpy(), table.column(c).is_valid().to_numpy()) for c in ("pid", "cam")}
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        b = b[np.argsort(ids[b], kind="stable")]
        more = (np.unique(np.stack([names["pid"][0][b], names["pid"][1][b]]), axis=1, return_inverse=True)[1].ravel(),) if named else ()
        out, step = [each(ids[:0], ids[b], np.empty((0, len(b))), np.empty((0, len(b)), bool), np.empty((0, len(b)), bool), *more)], max(1, CELLS // max(1, len(b)))
        x, y = v[a], v[b]
        for k in range(0, len(a) if len(b) else 0, step):
            at = a[k : k + step]
            known, equal = {}, {}
            for c, (value, valid) in names.items():
                known[c] = valid[at][:, None] & valid[b][None, :]
                equal[c] = value[at][:, None] == value[b][None, :]
            kept = (known["pid"] & ~equal["pid"]) | (known["cam"] & ~equal["cam"])
            out.append(each(ids[at], ids[b], products(x[k : k + step], y, metric), known["pid"] & equal["pid"], kept, *more))
        return pa.concat_tables(out)

    return both.groupBy("i", "j").applyInArrow(run, schema)


def query_profiles(queries: DataFrame, gallery: DataFrame, items: DataFrame) -> DataFrame:
    """As per_query of all labelled distances: n_match, first, ap and inp of each query with a match. A task ranks its queries'
    whole lists; a gallery of more than PANEL rows, which no task holds, goes by rows of pairs instead."""
    if gallery.count() > PANEL:
        return per_query(labelled(distances(queries, gallery), items))

    def each(qids, gids, d, match, kept):
        out = []
        for k, q in enumerate(qids):
            at = np.flatnonzero(kept[k])
            hit = match[k][at][np.argsort(d[k][at], kind="stable")]
            rank = np.flatnonzero(hit) + 1
            if len(rank):
                precision = np.floor(np.arange(1, len(rank) + 1) / rank * 1e12 + 0.5).astype(np.int64)
                out.append((q, len(rank), rank[0], int(precision.sum()) / len(rank) / 1e12, len(rank) / rank[-1]))
        cols = list(zip(*out)) or [()] * 5
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("qid", "n_match", "first", "ap", "inp"), cols, (pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.float64()))})

    return _panels(queries, gallery, each, "qid long, n_match long, first int, ap double, inp double")


def sweep_candidates(queries: DataFrame, gallery: DataFrame, seen: int) -> DataFrame:
    """qid, gid, dist, match of the kept pairs that decide a sweep in which only each query's `seen` nearest have a distance of
    their own: those, the nearest of the rest with all that rounding could make equal to it, the rest's smallest gid (at blend one
    all are equal), and a match, if there is one. The other pairs can be no blend's nearest. No row for every pair."""

    def each(qids, gids, d, match, kept):
        out = []
        for k in range(len(qids)):
            order = np.argsort(d[k], kind="stable")
            top, rest = order[:seen], order[seen:]
            top, rest = top[kept[k][top]], rest[kept[k][rest]]
            take = [top]
            if len(rest):
                # Blends below one scale distances by 0.01 at least, and are compared at nine decimals.
                take += [rest[d[k][rest] <= d[k][rest[0]] + 2e-7], rest[gids[rest] == gids[rest].min()]]
                take.append(rest[match[k][rest]][:1])
            out.append(np.stack([np.full(len(t := np.unique(np.concatenate(take))), k), t]))
        q, g = np.concatenate(out, axis=1).astype(int) if out else np.empty((2, 0), int)
        return pa.table({"qid": pa.array(qids[q]), "gid": pa.array(gids[g]), "dist": pa.array(d[q, g]), "match": pa.array(match[q, g])})

    return _panels(queries, gallery, each, "qid long, gid long, dist double, match boolean")


#: Ranges of distances that the first pass of tpr_at_exact counts in.
RANGES = 20_000


def tpr_at_exact(queries: DataFrame, gallery: DataFrame, items: DataFrame, targets: Sequence[float]) -> DataFrame:
    """tpr_at of the roc of all labelled distances. Ranges of distances are counted where the distances are; then only pairs of
    the ranges around each target become rows, and more of them until no point outside could be nearer."""
    spark, scale = queries.sparkSession, RANGES / 2
    place = lambda d: np.clip(np.floor(d * scale), 0, RANGES).astype(np.int64)

    def count(qids, gids, d, match, kept):
        n = np.bincount((place(d[kept]) * 2 + match[kept]).ravel(), minlength=2 * (RANGES + 1)).reshape(-1, 2)
        at = np.flatnonzero(n.any(axis=1))
        return pa.table({"bin": pa.array(at), "p": pa.array(n[at, 0]), "n": pa.array(n[at, 1])})

    found = _panels(queries, gallery, count, "bin long, p long, n long").groupBy("bin").agg(F.sum("p").alias("p"), F.sum("n").alias("n")).collect()  # a row a range
    p, n = np.zeros(RANGES + 1, np.int64), np.zeros(RANGES + 1, np.int64)
    for r in found:
        p[r.bin], n[r.bin] = r.p, r.n
    if not p.sum() or not n.sum() or items.where("object_id is null").limit(1).count():
        return tpr_at(roc(labelled(distances(queries, gallery), items)), targets)
    above = lambda x: x[::-1].cumsum()[::-1] - x  # noqa: E731, in the ranges above
    p_above, n_above, pt, nt = above(p), above(n), int(p.sum()), int(n.sum())
    held, done, wide = np.flatnonzero(n), {}, 2
    while len(done) < len(targets):
        spans = {}
        for t in targets:
            if t not in done:
                at = len(held) - 1 - int(np.searchsorted((n_above + n)[held][::-1] / nt, t))
                lo, hi = max(0, at - wide), at + wide
                spans[t] = (int(held[lo]) if lo else 0, int(held[hi]) if hi < len(held) else RANGES)
        wanted = np.zeros(RANGES + 1, bool)
        for lo, hi in spans.values():
            wanted[lo : hi + 1] = True

        def pick(qids, gids, d, match, kept, wanted=wanted):
            q, g = np.nonzero(kept & wanted[place(d)])
            b = place(d[q, g])
            return pa.table({"bin": pa.array(b), "dist": pa.array(d[q, g]), "match": pa.array(match[q, g])})

        rows = kept_rows(_panels(queries, gallery, pick, "bin long, dist double, match boolean").groupBy("bin", "dist").agg(F.sum((~F.col("match")).cast("long")).alias("p"), F.sum(F.col("match").cast("long")).alias("n")), "roc")
        for t, (lo, hi) in spans.items():
            points = running(rows.where(F.col("bin").between(lo, hi)), [F.desc("dist")], ["p", "n"])
            after = points.select((F.col("pos") - 1).alias("pos"), F.col("p").alias("p2"), F.col("n").alias("n2"))
            both = points.join(after, "pos", "left")
            bottom = not (p[:lo].any() or n[:lo].any())
            corner = (F.col("pos") == 0) if not (p[hi + 1 :].any() or n[hi + 1 :].any()) else F.lit(False)
            corner = F.coalesce(corner | (F.col("p") != F.col("p2")) | (F.col("n") != F.col("n2")), F.lit(bottom))
            curve = both.where(corner).select("dist", ((F.col("cum_p") + int(p_above[hi])) / pt).alias("tpr"), ((F.col("cum_n") + int(n_above[hi])) / nt).alias("fpr"))
            start = spark.createDataFrame([(None, 0.0, 0.0)], "dist double, tpr double, fpr double")
            order = F.struct(F.abs(F.col("fpr") - t).alias("d"), (-F.coalesce("dist", F.lit(float("inf")))).alias("far"), "tpr")
            best = curve.unionByName(start).agg(F.min(order).alias("m")).select("m.*").first()
            over, under = hi == RANGES or t - n_above[hi] / nt > best.d, bottom or (n_above[lo] + n[lo]) / nt - t >= best.d
            if over and under:
                done[t] = best.tpr
        wide *= 4
    return spark.createDataFrame([(float(t), float(done[t])) for t in targets], "target double, tpr double")


def _first(dist: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("qid").orderBy("dist", "gid")
    return dist.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def labelled(dist: DataFrame, items: DataFrame, key: str = "crop_id") -> DataFrame:
    """Adds match (same identity) and drops the query's own identity under its own camera."""
    side = lambda a: items.select(F.col(key).alias(f"{a}id"), F.col("object_id").alias(f"{a}_pid"), F.col("camid").alias(f"{a}_cam"))
    both = dist.join(side("q"), "qid").join(side("g"), "gid")
    same = F.col("q_pid") == F.col("g_pid")
    return both.where(~(same & (F.col("q_cam") == F.col("g_cam")))).withColumn("match", same)


def ranked(pairs: DataFrame) -> DataFrame:
    """rank of each row in its query's list, and the number of matches up to it."""
    w = Window.partitionBy("qid").orderBy("dist", "gid")
    return pairs.withColumn("rank", F.row_number().over(w)).withColumn("hits", F.sum(F.col("match").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def per_query(pairs: DataFrame) -> DataFrame:
    """n_match, first (rank of the first match), ap and inp of each query with a match.

    The sums of precisions are over whole multiples of 1e-12.
    """
    r = ranked(pairs).where("match")
    precision = F.round(F.col("hits") / F.col("rank") * 1e12).cast("long")
    out = r.groupBy("qid").agg(F.count("*").alias("n_match"), F.min("rank").alias("first"), F.max("rank").alias("last"), F.sum(precision).alias("s"))
    return out.select("qid", "n_match", "first", (F.col("s") / F.col("n_match") / 1e12).alias("ap"), (F.col("n_match") / F.col("last")).alias("inp"))


def cmc(queries: DataFrame, ranks: int) -> DataFrame:
    """Share of queries whose first match is at rank r or before, for r from 1 to ranks."""
    grid = queries.sparkSession.range(1, ranks + 1).select(F.col("id").alias("rank"))
    total = queries.agg(F.count("*").alias("n"))
    hit = queries.groupBy(F.col("first").cast("long").alias("rank")).agg(F.count("*").alias("k"))
    w = Window.orderBy("rank")
    return grid.join(hit, "rank", "left").crossJoin(F.broadcast(total)).select("rank", (F.sum(F.coalesce("k", F.lit(0))).over(w) / F.col("n")).alias("cmc"))


def summary(queries: DataFrame) -> DataFrame:
    """map, minp, rank1, rank5, rank10 in per cent, and metric, the mean of map and rank1."""
    whole = lambda c: F.sum(F.round(F.col(c) * 1e12).cast("long")) / F.count("*") / 1e12 * 100
    at = lambda k: F.sum(F.when(F.col("first") <= k, 1).otherwise(0)) / F.count("*") * 100
    s = queries.agg(whole("ap").alias("map"), whole("inp").alias("minp"), at(1).alias("rank1"), at(5).alias("rank5"), at(10).alias("rank10"))
    return s.withColumn("metric", (F.col("map") + F.col("rank1")) / 2)


def single_shot(pairs: DataFrame, repeats: int, seed: int = 0) -> DataFrame:
    """Each repeat keeps one gallery row of each identity, chosen by a hash; the first match's rank by query and repeat."""
    rep = pairs.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    pick = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("qid"), F.col("repeat"), F.col("gid")))
    one = rep.withColumn("p", F.row_number().over(Window.partitionBy("qid", "repeat", "g_pid").orderBy(pick))).where("p = 1")
    w = Window.partitionBy("qid", "repeat").orderBy("dist", "gid")
    return one.withColumn("rank", F.row_number().over(w)).where("match").groupBy("qid", "repeat").agg(F.min("rank").alias("first"))


_SHIFTS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_SINES = [int(abs(math.sin(k + 1)) * 2**32) for k in range(64)]


class Heads:
    """First 32 bits of md5(prefix + id) for many ids at once, as numbers in the order of the digests' hex form. The ids' digits lie
    in columns by their length, so a prefix changes only few words of them. Prefix and id must fit into 55 bytes."""

    def __init__(self, ids: np.ndarray):
        text = np.array([str(x).encode() for x in ids.tolist()], "S20")
        sizes = np.char.str_len(text) if len(text) else np.empty(0, int)
        digits = text.view(np.uint8).reshape(len(text), 20)
        self.n, self.groups = len(text), [(int(n), np.flatnonzero(sizes == n)) for n in np.unique(sizes)]
        self.digits, self.words = {n: digits[at, :n] for n, at in self.groups}, {}

    def _tail(self, n: int, shift: int) -> list[np.ndarray]:
        """The words that hold n digits and the closing bit, when they begin `shift` bytes into a word."""
        if (n, shift) not in self.words:
            rows = self.digits[n]
            padded = np.zeros((len(rows), -(-(shift + n + 1) // 4) * 4), np.uint8)
            padded[:, shift : shift + n], padded[:, shift + n] = rows, 0x80
            self.words[n, shift] = [np.ascontiguousarray(w) for w in padded.view("<u4").T]
        return self.words[n, shift]

    def __call__(self, prefix: bytes) -> np.ndarray:
        out, p = np.empty(self.n, np.uint32), len(prefix)
        for n, at in self.groups:
            head = np.frombuffer(prefix.ljust(64, b"\0"), "<u4")
            words: list = [np.uint32(x) for x in head]
            for k, w in enumerate(self._tail(n, p % 4)):
                words[p // 4 + k] = w | words[p // 4 + k]
            words[14] = np.uint32(8 * (p + n))
            out[at] = _md5_head(words, len(at))
        return out


def _md5_head(words: list, n: int) -> np.ndarray:
    """The first word of the digest of one block of sixteen words (numbers or arrays of n), big end first."""
    start = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
    a, b, c, d = (np.full(n, x, np.uint32) for x in start)
    f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for k in range(61):  # the first word is not touched by the last three
        turn = k // 16
        if turn == 0:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
            g = k
        elif turn == 1:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
            g = (5 * k + 1) % 16
        elif turn == 2:
            np.bitwise_xor(b, c, out=f)
            f ^= d
            g = (3 * k + 5) % 16
        else:
            np.bitwise_not(d, out=f)
            f |= b
            f ^= c
            g = 7 * k % 16
        w, by = words[g], _SHIFTS[turn][k % 4]
        f += a
        if isinstance(w, np.ndarray):
            f += w
            f += np.uint32(_SINES[k])
        else:
            f += np.uint32((int(w) + _SINES[k]) % 2**32)
        np.right_shift(f, np.uint32(32 - by), out=t)
        f <<= np.uint32(by)
        f |= t
        f += b
        a, b, c, d, f = d, f, b, c, a
    # After 61 steps the newest value, b, is the first word but for its start.
    b += np.uint32(start[0])
    return b.byteswap()


def single_shot_ranks(queries: DataFrame, gallery: DataFrame, items: DataFrame, repeats: int, seed: int = 0) -> DataFrame:
    """As single_shot of all labelled distances: a task draws and ranks its queries' lists. A gallery of more than PANEL rows, which
    no task holds, goes by rows of pairs instead."""
    if gallery.count() > PANEL:
        return single_shot(labelled(distances(queries, gallery), items), repeats, seed)
    if len(f"{seed}|{repeats}||") > 15:
        raise ValueError("seed and repeats have too many digits")

    def each(qids, gids, d, match, kept, pid):
        order = np.argsort(pid, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(pid[order]) > 0]) if len(pid) else np.empty(0, int)
        of, heads, out = pid[order], Heads(gids[order]) if len(qids) else None, []
        for k, q in enumerate(qids.tolist()):
            hit = np.flatnonzero(match[k])
            hit = hit[kept[k][hit]]
            if not len(hit):
                continue
            keep, far = kept[k][order], d[k][order]
            for r in range(repeats):
                prefix = f"{seed}|{q}|{r}|"
                h = heads(prefix.encode()).astype(np.int64)
                h[~keep] = 1 << 32
                least = np.minimum.reduceat(h, starts)
                at = np.flatnonzero((h == least[of]) & keep)
                group = of[at]
                if len(group) > 1 and (group[1:] == group[:-1]).any():  # 32 bits are not enough
                    full = [(g, hashlib.md5(f"{prefix}{gids[order[x]]}".encode()).hexdigest(), x) for g, x in zip(group.tolist(), at.tolist())]
                    best = {}
                    for g, digest, x in full:
                        best[g] = min(best.get(g, (digest, x)), (digest, x))
                    at = np.array([x for _, x in best.values()])
                mine = at[of[at] == pid[hit[0]]][0]
                ahead = (far[at] < far[mine]) | ((far[at] == far[mine]) & (gids[order[at]] < gids[order[mine]]))
                out.append((q, r, 1 + int(ahead.sum())))
        cols = list(zip(*out)) or [()] * 3
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("qid", "repeat", "first"), cols, (pa.int64(), pa.int32(), pa.int32()))})

    return _panels(queries, gallery, each, "qid long, repeat int, first int", named=True)


def roc(pairs: DataFrame) -> DataFrame:
    """dist, tpr, fpr by falling distance: of the pairs of different identities, the positive class whose score is the
    distance, and of the matches, the shares at or above it. Points on a straight line between their neighbours are left out,
    and the curve starts at a null distance with no pair. Sums are made by ranges of distances, none in a single task."""
    g = pairs.groupBy("dist").agg(F.sum((~F.col("match")).cast("long")).alias("p"), F.sum(F.col("match").cast("long")).alias("n"))
    total = g.agg(F.sum("p").alias("pt"), F.sum("n").alias("nt"), F.count("*").alias("points"))
    points = running(g, [F.desc("dist")], ["p", "n"])
    after = points.select((F.col("pos") - 1).alias("pos"), F.col("p").alias("p2"), F.col("n").alias("n2"))
    both = points.join(after, "pos", "left").crossJoin(F.broadcast(total))
    kept = both.where((F.col("pos") == 0) | (F.col("pos") == F.col("points") - 1) | (F.col("p") != F.col("p2")) | (F.col("n") != F.col("n2")))
    curve = kept.select("dist", (F.col("cum_p") / F.col("pt")).alias("tpr"), (F.col("cum_n") / F.col("nt")).alias("fpr"))
    return curve.unionByName(total.where("points > 0").select(F.lit(None).cast("double").alias("dist"), F.lit(0.0).alias("tpr"), F.lit(0.0).alias("fpr")))


def tpr_at(curve: DataFrame, targets: Sequence[float]) -> DataFrame:
    """The tpr where fpr is nearest to each target; of equally near, at the larger distance, the curve's start first."""
    goal = curve.sparkSession.createDataFrame([(float(t),) for t in targets], "target double")
    order = F.struct(F.abs(F.col("fpr") - F.col("target")).alias("d"), (-F.coalesce("dist", F.lit(float("inf")))).alias("far"), "tpr")
    near = curve.crossJoin(F.broadcast(goal)).groupBy("target").agg(F.min(order).alias("m"))
    return near.select("target", "m.tpr")


def expand_queries(items: DataFrame, k: int, alpha: float, key: str = "crop_id", vector: str = "embedding", times: int = 1) -> DataFrame:
    """Each vector replaced by the mean of its k nearest (itself among them) weighted by similarity to the power alpha,
    at unit length; as often as said, each time among the vectors that the last time gave. A negative similarity under a
    fractional power counts as nothing."""
    for _ in range(times - 1):
        items = expand_queries(items, k, alpha, key, vector)
    near = distances(items, items, key, vector, nearest=k).withColumn("sim", 1 - F.col("dist"))
    weight = F.when((F.col("sim") < 0) & F.lit(alpha != int(alpha)), 0.0).otherwise(F.pow("sim", F.lit(float(alpha))))
    v = items.select(F.col(key).alias("gid"), F.col(vector).alias("v"))
    parts = near.withColumn("w", weight).join(v, "gid").select("qid", "w", F.posexplode("v").alias("pos", "x"))
    means = parts.groupBy("qid", "pos").agg((F.sum(F.col("w") * F.col("x").cast("double")) / F.lit(k)).alias("x"))
    arrays = means.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s.x).alias("v"))
    n = F.greatest(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)), F.lit(1e-12))
    return arrays.withColumn("n", n).select(F.col("qid").alias(key), F.transform("v", lambda x: x / F.col("n")).alias(vector))


def reciprocal(near: DataFrame, k: int) -> DataFrame:
    """i, j: each is among the other's k nearest."""
    top = near.where(F.col("rank") <= k).select(F.col("qid").alias("i"), F.col("gid").alias("j"))
    back = top.select(F.col("j").alias("i"), F.col("i").alias("j"))
    return top.join(back, ["i", "j"], "left_semi")


def encode(near: DataFrame, measured: Callable[[DataFrame], DataFrame], k_full: int, k_half: int, k2: int) -> DataFrame:
    """i, j, v: k-reciprocal encodings from ranked neighbours (qid, gid, rank), expanded by the neighbours' own, with the
    softmax of the opposite of the distance as weights, averaged over the k2 nearest.

    measured: adds dist to rows of i, j. Only pairs that are in an encoding are measured, not all.
    """
    full, half = reciprocal(near, k_full), reciprocal(near, k_half)
    half = half.withColumnRenamed("i", "c").withColumnRenamed("j", "x")
    half_size = half.groupBy("c").agg(F.count("*").alias("m"))
    common = full.withColumnRenamed("j", "c").join(half, "c").join(full.select("i", F.col("j").alias("x")), ["i", "x"]).groupBy("i", "c").agg(F.count("*").alias("both"))
    taken = common.join(half_size, "c").where(F.col("both") * 3 > F.col("m") * 2)
    grown = full.unionByName(taken.join(half, "c").select("i", F.col("x").alias("j"))).distinct()
    d = measured(grown)
    least = d.groupBy("i").agg(F.min("dist").alias("least"))
    e = d.join(least, "i").withColumn("e", F.exp(F.col("least") - F.col("dist")))
    total = e.groupBy("i").agg(F.sum("e").alias("total"))
    v = e.join(total, "i").select("i", "j", (F.col("e") / F.col("total")).alias("v"))
    if k2 == 1:
        return v
    mine = near.where(F.col("rank") <= k2).select(F.col("qid").alias("i"), F.col("gid").alias("k"))
    return mine.join(v.select(F.col("i").alias("k"), "j", "v"), "k").groupBy("i", "j").agg((F.sum("v") / F.lit(k2)).alias("v"))


def encodings(items: DataFrame, k1: int, k2: int, key: str = "crop_id", vector: str = "embedding") -> DataFrame:
    """i, j, v: encodings over squared distances."""

    def measured(pairs: DataFrame) -> DataFrame:
        v = lambda at, to: items.select(F.col(key).cast("long").alias(at), F.col(vector).alias(to))
        return pairs.join(v("i", "x"), "i").join(v("j", "y"), "j").select("i", "j", decimals(dot("x", "x") + dot("y", "y") - 2 * dot("x", "y"), 9).alias("dist"))

    return encode(distances(items, items, key, vector, metric="euclidean", nearest=max(k1, k2)), measured, k1, round(k1 / 2), k2)


def overlap(encoded: DataFrame, queries: DataFrame) -> DataFrame:
    """qid, gid, dist: Jaccard distances of encodings, of the rows in queries (i) to all that share a neighbour."""
    left = encoded.join(queries, "i", "left_semi").select(F.col("i").alias("qid"), "j", F.col("v").alias("a"))
    right = encoded.select(F.col("i").alias("gid"), "j", F.col("v").alias("b"))
    low = left.join(right, "j").groupBy("qid", "gid").agg(F.sum(F.least("a", "b")).alias("m"))
    return low.select("qid", "gid", F.greatest(F.lit(0.0), 1 - F.col("m") / (2 - F.col("m"))).alias("dist"))


def jaccard(items: DataFrame, queries: Column, k1: int = 20, k2: int = 6, key: str = "crop_id", vector: str = "embedding") -> DataFrame:
    """qid, gid, dist: Jaccard distance of encodings for the items that satisfy the condition `queries` against all;
    pairs without a common neighbour, whose distance is 1, have no row."""
    return overlap(encodings(items, k1, k2, key, vector), items.where(queries).select(F.col(key).alias("i")))


def rerank_given(dist: DataFrame, queries: DataFrame, k1: int = 20, k2: int = 6, weight: float = 0.3) -> DataFrame:
    """qid, gid, dist: re-ranking of given distances of all items to all (qid, gid, dist), for the rows in queries (qid).

    Distances are squared and divided by the largest of their row, lists have k1 + 1 and round(k1 / 2) + 1 places, and the
    result is the Jaccard distance times 1 - weight plus the scaled distance times weight. Rows without a positive distance
    keep distance zero.
    """
    top = dist.groupBy("qid").agg(F.max(F.col("dist") * F.col("dist")).alias("top"))
    scaled = dist.join(top, "qid").select("qid", "gid", F.when(F.col("top") > 0, F.col("dist") * F.col("dist") / F.col("top")).otherwise(0.0).alias("dist"))
    measured = lambda pairs: pairs.join(scaled.select(F.col("qid").alias("i"), F.col("gid").alias("j"), "dist"), ["i", "j"])
    encoded = encode(_first(scaled, max(k1 + 1, k2)), measured, k1 + 1, round(k1 / 2) + 1, k2)
    return blend(scaled.join(queries, "qid", "left_semi"), overlap(encoded, queries.select(F.col("qid").alias("i"))), weight)


def _held(items: DataFrame, key: str) -> bool:
    """Whether a task can hold the items, each with a key of its own."""
    n = items.agg(F.count("*").alias("n"), F.countDistinct(key).alias("keys")).first()
    return n.n <= PANEL and n.n == n.keys


def _nearest(d: np.ndarray, k: int) -> np.ndarray:
    """The columns of each row's k least, of equal ones the first."""
    if k >= d.shape[1] or not len(d):
        return np.argsort(d, axis=1, kind="stable")[:, :k]
    row, col = np.nonzero(d <= np.partition(d, k - 1, axis=1)[:, k - 1 : k])
    order = np.lexsort((d[row, col], row))
    first = np.searchsorted(row, np.arange(len(d)))
    return col[order][first[:, None] + np.arange(k)]


def _scaled(d: np.ndarray, top: np.ndarray) -> np.ndarray:
    """Squares divided by their row's largest; rows without a positive one keep zero."""
    top = np.broadcast_to(top[:, None], d.shape) if d.ndim > 1 else top
    return np.divide(d * d, top, out=np.zeros_like(d), where=top > 0)


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Where each list of a column begins, the end of the last after them, and the values one after another."""
    flat = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return flat.offsets.to_numpy() - flat.offsets[0].as_py(), flat.flatten().to_numpy(zero_copy_only=False)


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places from each start on, as many as its size, one span after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def _grown(near: np.ndarray, rows: np.ndarray, k_full: int, k_half: int) -> tuple[np.ndarray, np.ndarray]:
    """i, j in order: k-reciprocal neighbours j of the rows i, expanded by the neighbours' own. near: positions of the nearest of
    all items."""
    n, step = len(near), 1024
    half = np.empty((n, near[:, :k_half].shape[1]), bool)
    for k in range(0, n, step):
        half[k : k + step] = (near[near[k : k + step, :k_half], :k_half] == np.arange(k, min(n, k + step))[:, None, None]).any(axis=2)
    out = [np.empty(0, np.int64)]
    for k in range(0, len(rows), step):
        i = rows[k : k + step].astype(np.int64)
        full = near[i, :k_full]
        mutual = (near[full, :k_full] == i[:, None, None]).any(axis=2)
        theirs, known = near[full, :k_half], half[full]
        both = (theirs[..., None] == np.where(mutual, full, -1)[:, None, None, :]).any(axis=3) & known
        taken = mutual & (both.sum(axis=2) * 3 > known.sum(axis=2) * 2)
        at, more = np.nonzero(mutual)[0], np.nonzero(taken[:, :, None] & known)
        out.append(np.unique(np.concatenate([i[at] * n + full[mutual], i[more[0]] * n + theirs[more]])))
    pairs = np.concatenate(out)
    return pairs // n, pairs % n


def _averaged(first: np.ndarray, starts: np.ndarray, j: np.ndarray, v: np.ndarray, rows: np.ndarray, k2: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, j, v: encodings of the rows, each the mean over its k2 first; row counts from 0 on. starts, j, v: lists of all items."""
    out, n = [], len(starts) - 1
    for k in range(0, len(rows), 1 << 12):
        of = first[rows[k : k + (1 << 12)]]
        sizes = np.diff(starts)[of]
        at = _spans(starts[of].ravel(), sizes.ravel())
        pairs, back = np.unique(np.repeat(np.arange(k, k + len(of)), sizes.sum(axis=1)) * n + j[at], return_inverse=True)
        out.append(((pairs // n).astype(np.int32), (pairs % n).astype(np.int32), np.bincount(back.ravel(), v[at], len(pairs)) / k2))
    return tuple(np.concatenate(c) for c in zip(*out))


def _rerank(items: DataFrame, queries: DataFrame, gallery: DataFrame, k_full: int, k_half: int, k2: int, weight: float, metric: str, scaled: bool, places: int | None, rank: bool, key: str, vector: str) -> DataFrame:
    """qid, gid, dist and, if rank, the place in order of dist and gid: the Jaccard distances of encodings times 1 - weight plus
    the distances times weight, rounded to places, for rows of queries and gallery, both among the items.

    Three times tasks hold a block of rows and all items: they find each row's nearest, then its encoding, and at last
    a query's distances to the whole gallery, which leave the task as rows of the result. The last tasks get encodings before they are
    averaged, and average themselves. No pair is shuffled."""
    spark = items.sparkSession
    n = items.count()
    none = F.lit(None).cast("long")
    plain = items.select(key, vector, none.alias("object_id"), none.alias("camid"))
    lists = lambda values: pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(values.ravel()))

    def nearest(qids, gids, d, match, kept):
        top = (d * d).max(axis=1, initial=0.0)
        near = gids[_nearest(_scaled(d, top) if scaled else d, max(k_full, k2))]
        return pa.table({"id": pa.array(qids), "top": pa.array(top), "near": lists(near)})

    near = kept_rows(_panels(plain, plain, nearest, "id long, top double, near array<long>", key, vector, metric=metric), "nearest")
    cut = lambda m: F.pmod(F.xxhash64("id"), F.lit(m)).cast("int")
    everywhere = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("i")
    v = lambda df: df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))
    blocks = max(1, -(-n // ENCODED))
    copies = v(items).join(near, "id").withColumn("block", cut(blocks)).select("*", everywhere(blocks)).withColumn("mine", F.col("block") == F.col("i")).drop("block")

    def encoded(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        x, ids, top = vectors(table, "v", "id"), table.column("id").to_numpy(), table.column("top").to_numpy()
        near = np.searchsorted(ids, _lists(table.column("near"))[1]).astype(np.int32).reshape(len(ids), -1)
        rows = np.flatnonzero(table.column("mine").to_numpy())
        i, j = _grown(near, rows, k_full, k_half)
        d = paired(x, i, j, metric)
        d = _scaled(d, top[i]) if scaled else d
        starts = np.searchsorted(i, np.append(rows, len(ids)))
        some = np.diff(starts) > 0
        spread = lambda f, a: np.repeat(f.reduceat(a, starts[:-1][some]) if some.any() else a, np.diff(starts)[some])
        e = np.exp(spread(np.minimum, d) - d)
        of = pa.array(starts.astype(np.int32))
        first = near[rows, :k2] if k2 > 1 else rows[:, None]
        return pa.table({"id": pa.array(ids[rows]), "top": pa.array(top[rows]), "first": lists(ids[first]), "j": pa.ListArray.from_arrays(of, pa.array(ids[j])), "w": pa.ListArray.from_arrays(of, pa.array(e / spread(np.add, e)))})

    codes = copies.groupBy("i").applyInArrow(encoded, "id long, top double, first array<long>, j array<long>, w array<double>")
    nq = queries.count()
    tasks = max(1, min(nq, spark.sparkContext.defaultParallelism))
    side = lambda df, s, i: df.select("*", F.lit(s).alias("side"), i)
    parts = side(v(queries), 0, cut(tasks).alias("i"))
    for more in (side(v(gallery), 1, everywhere(tasks)), side(codes, 2, everywhere(tasks))):
        parts = parts.unionByName(more, allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        q, g, c = (table.filter(pa.array(table.column("side").to_numpy() == s)).sort_by("id") for s in range(3))
        del table
        if not len(q) or not len(g):
            return
        x, y = vectors(q, "v", "id"), vectors(g, "v", "id")
        qids, gids, ids = (t.column("id").to_numpy() for t in (q, g, c))
        known = pa.array(ids)
        if not all(pc.all(pc.is_in(t.column("id"), known)).as_py() for t in (q, g)):
            raise ValueError("a row of the queries or the gallery is not among the items")
        at, to = np.searchsorted(ids, qids), np.searchsorted(ids, gids)
        top, first = c.column("top").to_numpy()[at], np.searchsorted(ids, _lists(c.column("first"))[1]).reshape(len(ids), -1)
        starts, j = _lists(c.column("j"))
        codes = first, starts, np.searchsorted(ids, j), _lists(c.column("w"))[1]
        del q, g, c, j
        row, j, w = _averaged(*codes, to, k2)
        order = np.argsort(j, kind="stable")
        row, w, begin = row[order], w[order], np.searchsorted(j[order], np.arange(len(ids) + 1))  # by neighbour
        del order, j
        q_row, q_j, q_w = _averaged(*codes, at, k2)
        q_begin = np.searchsorted(q_row, np.arange(len(qids) + 1))
        rows, step = [], max(1, CELLS // len(gids))
        for k in range(0, len(qids), step):
            d = products(x[k : k + step], y, metric)
            d = _scaled(d, top[k : k + step]) if scaled else d
            for p, dist in enumerate(d, k):
                mine = slice(q_begin[p], q_begin[p + 1])
                sizes = begin[q_j[mine] + 1] - begin[q_j[mine]]
                s = _spans(begin[q_j[mine]], sizes)
                low = np.bincount(row[s], np.minimum(np.repeat(q_w[mine], sizes), w[s]), len(gids))
                dist = np.maximum(0.0, 1 - low / (2 - low)) * (1 - weight) + dist * weight
                if places is not None:
                    dist *= 10.0**places
                    whole = np.floor(dist)
                    dist = (whole + (dist - whole >= 0.5)) / 10.0**places
                order = np.argsort(dist, kind="stable") if rank else slice(None)
                rows.append((np.full(len(gids), qids[p]), gids[order], dist[order], *([np.arange(1, len(gids) + 1, dtype=np.int32)] if rank else [])))
                if len(rows) * len(gids) >= 1 << 17 or p + 1 == len(qids):
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(col)) for col in zip(*rows)], ["qid", "gid", "dist", "rank"][: 3 + rank])
                    rows = []

    return parts.groupBy("i").applyInArrow(run, "qid long, gid long, dist double" + ", rank int" * rank)


def rerank_ranked(items: DataFrame, queries: DataFrame, gallery: DataFrame, k1: int = 20, k2: int = 6, weight: float = 0.3, places: int = 7, key: str = "crop_id", vector: str = "embedding") -> DataFrame:
    """qid, gid, dist, rank: squared distances blended with their Jaccard distances (as blend and jaccard), rounded to places, for
    rows of queries and gallery, both among the items; rank is the place in a query's list by dist and gid. Tasks rank whole
    lists, and only the result has a row for a pair. More than PANEL items, and items that share a key, go by rows of pairs."""
    if not _held(items, key):
        ids = lambda df, to: df.select(F.col(key).cast("long").alias(to))
        b = blend(distances(queries, gallery, key, vector, "euclidean"), overlap(encodings(items, k1, k2, key, vector), ids(queries, "i").distinct()), weight)
        return b.withColumn("dist", decimals(F.col("dist"), places)).withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("dist", "gid")))
    return _rerank(items, queries, gallery, k1, round(k1 / 2), k2, weight, "euclidean", False, places, True, key, vector)


def rerank_cosine(items: DataFrame, queries: DataFrame, gallery: DataFrame, k1: int = 20, k2: int = 6, weight: float = 0.3, key: str = "crop_id", vector: str = "embedding", places: int | None = None) -> DataFrame:
    """As rerank_given of the cosine distances of all items to all, for rows of queries and gallery, both among the items, rounded
    to places, if given. Only the result has a row for a pair. More than PANEL items, and items that share a key, go by rows of all
    pairs."""
    if not _held(items, key):
        ids = lambda df, to: df.select(F.col(key).alias(to))
        out = rerank_given(distances(items, items, key, vector), ids(queries, "qid"), k1, k2, weight).join(ids(gallery, "gid"), "gid", "left_semi")
        return out.select("qid", "gid", "dist" if places is None else decimals(F.col("dist"), places).alias("dist"))
    return _rerank(items, queries, gallery, k1 + 1, round(k1 / 2) + 1, k2, weight, "cosine", True, places, False, key, vector)


def self_recall(items: DataFrame, ks: Sequence[int], key: str = "crop_id", label: str = "object_id") -> DataFrame:
    """k, recall in per cent: items whose k nearest others hold one of their own label. A row is not its own neighbour; an
    item of a label that no other has counts as a miss."""
    near = distances(items, items, key, nearest=max(ks) + 1).where("qid <> gid")
    w = Window.partitionBy("qid").orderBy("dist", "gid")
    near = near.withColumn("rank", F.row_number().over(w))
    name = lambda a: items.select(F.col(key).alias(f"{a}id"), F.col(label).alias(f"{a}_label"))
    hit = near.join(name("q"), "qid").join(name("g"), "gid").groupBy("qid").agg(F.min(F.when(F.col("q_label") == F.col("g_label"), F.col("rank"))).alias("first"))
    found = hit.agg(F.count("*").alias("n"), *(F.sum(F.when(F.col("first") <= k, 1).otherwise(0)).alias(f"k{k}") for k in ks))
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), (F.col(f"k{k}") / F.col("n") * 100).alias("recall")) for k in ks))).alias("e")
    return found.select(each).select("e.k", F.round("e.recall", 2).alias("recall"))


#: The ridge of the reconstruction, and the distance of pairs that are not reconstructed.
RIDGE, UNSEEN = 0.001, 100.0


def reconstruction(near: DataFrame, queries: DataFrame, gallery: DataFrame, ridge: float = RIDGE) -> DataFrame:
    """qid, gid, patch_dist for the pairs in near: how far each query patch lies from its ridge reconstruction out of the
    gallery row's patches, summed with the query's patch weights.

    queries: qid, patches (array of vectors), weights; gallery: gid, patches. A pair is one row with both sides' patches, so a
    task holds a batch of pairs whatever the row's popularity. Null, empty or ragged patches are errors.
    """
    pairs = near.select("qid", "gid").join(queries.select("qid", F.col("patches").alias("q"), F.col("weights").alias("w")), "qid").join(gallery.select("gid", F.col("patches").alias("g")), "gid")

    def solve(batches):
        for b in batches:
            out = np.empty(b.num_rows)
            for k, (q, g, w) in enumerate(zip(b.column("q").to_pylist(), b.column("g").to_pylist(), b.column("w").to_pylist())):
                if not q or not g or w is None or len(w) != len(q):
                    raise ValueError("a row has no patches, or not a weight for each")
                q, g = np.array(q, float).T, np.array(g, float).T
                rest = g @ np.linalg.solve(g.T @ g + ridge * np.eye(g.shape[1]), g.T @ q) - q
                out[k] = np.sqrt((rest * rest).sum(axis=0)) @ np.array(w, float)
            yield pa.RecordBatch.from_arrays([b.column("qid"), b.column("gid"), pa.array(out)], ["qid", "gid", "patch_dist"])

    return pairs.mapInArrow(solve, "qid long, gid long, patch_dist double")


def sweep(pairs: DataFrame, steps: int = 101) -> DataFrame:
    """step, blend, rank1 in per cent, chosen: (1 - blend) * dist + blend * patch_dist for blends from 0 to 1.

    pairs: qid, gid, dist, patch_dist, match. Only the nearest row matters, so each blend is one minimum by query, combined
    before the shuffle; pairs are not multiplied. Queries without a match are left out; of equal blends the first is chosen.
    """
    nearest = lambda k: F.min(F.struct(F.round((1 - F.lit(0.01 * k)) * F.col("dist") + F.lit(0.01 * k) * F.col("patch_dist"), 9).alias("d"), "gid", "match"))
    best = pairs.groupBy("qid").agg(F.max("match").alias("any"), *(nearest(k).alias(f"b{k}") for k in range(steps))).where("any")
    total = best.agg(F.count("*").alias("n"), *(F.sum(F.col(f"b{k}.match").cast("int")).alias(f"h{k}") for k in range(steps)))
    each = total.select(F.explode(F.array(*(F.struct(F.lit(k).alias("step"), (F.col(f"h{k}") / F.col("n") * 100).alias("rank1")) for k in range(steps)))).alias("e"))
    top = each.agg(F.max(F.struct("e.rank1", (-F.col("e.step")).alias("s"))).alias("t"))
    return each.crossJoin(F.broadcast(top)).select("e.step", (F.col("e.step") * 0.01).alias("blend"), "e.rank1", (F.col("e.step") == -F.col("t.s")).alias("chosen"))


def blend(dist: DataFrame, jaccard_dist: DataFrame, weight: float) -> DataFrame:
    """jaccard * (1 - weight) + dist * weight; pairs without a Jaccard row count as 1."""
    j = jaccard_dist.select("qid", "gid", F.col("dist").alias("jd"))
    return dist.join(j, ["qid", "gid"], "left").select("qid", "gid", (F.coalesce("jd", F.lit(1.0)) * (1 - weight) + F.col("dist") * weight).alias("dist"))
