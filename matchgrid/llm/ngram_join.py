"""N-gram Jaccard join, size-aware: subsets for small sets, inverted lists for large ones.

A document is the set of its five-word shingles, as 64-bit hashes. Documents with equal sets are one class; classes
are joined, and copies are never expanded. Shingles have one global order, rarest first by a frequency sketch of fixed
size (any order is exact; this one keeps common passages out of the prefixes). Sets that reach the threshold share
ceil(0.8 n) shingles, so

  small sets (size up to the boundary) among themselves share two shingles of their (n - ceil(0.8 n) + 2)-prefixes:
  each small set enumerates the 2-subsets of that prefix, and only sets with an equal subset meet;
  a large set shares one shingle of the (n - ceil(0.8 n) + 1)-prefix with any partner: those prefixes' inverted lists
  are scanned, and small sets that are large enough for a large partner are in them too.

The boundary is the size at which the sum of both costs, signatures written and list entries met, is least; the costs
are taken from a bounded sample of COST_SAMPLE documents, and the result does not depend on them.

Every step's volume follows the input, not the square of a group:

  lists    a shingle that the sketch calls frequent has a list for each pair of chunks of its sets, so no list is long.
           Of each list only sets stay that some partner in it may link with, by size and by the shingle's place in both
           prefixes. Equal lists of any buckets are one list.
  stars    each list's sets are compared with one pivot per range of sizes. Those that link are contracted.
  the rest what lists connect lies in one region. Where a region's lists name at least all of its pairs, as those of a group of
           near copies do, its sets are compared by pairs of tiles, without the pure tiles of its largest component among
           themselves; other regions go by their lists. Only sets of different components are compared.

Pairs pass two filters that lose nothing, sizes and an upper bound of the overlap from 1024-bit parity maps of the sets, and are
verified on whole sets, by pairs of tiles, so that a set is sent once to each. No component is split. The operator returns
components only: pairs inside one component are not all compared, so links are neither listed nor counted.

Defined results: null or empty text, or text without words, has the empty set and links with nothing; with fewer than
five words the whole sequence is the one shingle; repeated rows are rows of one class; rows with a null doc_id take
part (component_id is the least id that is not null, or null); an empty table gives an empty result; other columns are
ignored. keep_one() keeps df's own columns, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchgrid.llm import storage
from matchgrid.llm.components import components, forest, roots
from matchgrid.llm.packs import pack, unpack

WORDS = 5
#: The least Jaccard similarity, as a percentage.
LEAST = 80
#: Counters of the frequency sketch and bits of the filter of needed documents: what every task is sent, 4 MB and 2 MB.
SKETCH, SLICES = 1 << 22, 64
FILTER = 1 << 24
MAP_BITS = 1024
#: Steps of a frequency's rank by which it doubles, payloads that one group merges.
STEPS, FAN = 8, 64
#: Documents whose prefixes estimate the costs, bytes of text for a bucket of lists, signatures that a task sends at once,
#: sets in a chunk of a frequent shingle's list, sets in a tile as a power of two, rows of tiles in a bucket.
COST_SAMPLE = 2000
#: What it costs to compare two sets of a list, where to write a signature costs one.
MET = 0.02
BUCKET_BYTES = 32_000_000
SENT = 1_500_000
CHUNK = 8192
TILE_BITS, TILE_ROWS = 8, 4000
_KNOWN_WORDS = 400_000

_U = np.uint64
_MULT = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _MULT[3]
    h = (h ^ (h >> _U(29))) * _MULT[1]
    return h ^ (h >> _U(32))


class Shingler:
    """Texts to sorted arrays of distinct shingle hashes."""

    def __init__(self, words: int = WORDS):
        self.words, self.known = words, {}

    def __call__(self, text: str | None) -> np.ndarray:
        found = (text or "").encode().lower().split()
        if not found:
            return np.empty(0, np.uint64)
        known = self.known
        if len(known) > _KNOWN_WORDS:
            known.clear()
        for w in set(found).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
        k = min(self.words, len(h))
        out = np.full(len(h) - k + 1, k, np.uint64)
        for i in range(k):
            out = _mixed(out * _MULT[0] + h[i : len(h) - k + 1 + i])
        return np.unique(out)


def class_key(s: np.ndarray) -> tuple[int | None, int | None]:
    if not len(s):
        return None, None
    d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def parity_map(s: np.ndarray) -> bytes:
    """Bit j: whether an odd number of the set's elements hash to j. Maps differ in no more bits than sets in elements."""
    bits = np.bincount((s >> _U(7)) & _U(MAP_BITS - 1), minlength=MAP_BITS) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def needed(n: int | np.ndarray) -> int | np.ndarray:
    """The least overlap of a set of size n with any partner."""
    return -(-LEAST * n // 100)


def prefix(s: np.ndarray, sketch: np.ndarray, extra: int) -> np.ndarray:
    """The first n - needed(n) + extra elements in the global order: by sketched frequency, then by hash."""
    n = len(s)
    rank = sketch[s & _U(SKETCH - 1)]
    return s[np.lexsort((s, rank))[: min(n, n - needed(n) + extra)]]


def signatures(s: np.ndarray, sketch: np.ndarray, boundary: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes that any two linked, different sets have one of in common; of each, how many of the set's elements cannot
    be in common if it is the pair's first one, and the rank of its frequency."""
    n = len(s)
    sigs, gone, rank = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.uint8)]
    if 4 <= n <= boundary:  # below four elements only equal sets reach the threshold
        p = prefix(s, sketch, 2)
        i, j = np.triu_indices(len(p), 1)
        sigs.append(_mixed(p[i] * _MULT[0] + p[j]))
        gone.append(j - 1)
        rank.append(sketch[p[i] & _U(SKETCH - 1)])  # the rarer one is first
    if n >= 4 and 100 * n >= LEAST * (boundary + 1):
        p = prefix(s, sketch, 1)
        sigs.append(_mixed(p ^ _MULT[4]))
        gone.append(np.arange(len(p)))
        rank.append(sketch[p & _U(SKETCH - 1)])
    return np.concatenate(sigs), np.concatenate(gone), np.concatenate(rank)


def frequency(rank: np.ndarray) -> np.ndarray:
    """The largest number of sets that a rank of the sketch stands for."""
    return np.exp2((np.asarray(rank, float) + 0.5) / STEPS)


def spread(sig: np.ndarray, rank: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, signature): where a list may be longer than CHUNK, its sets are dealt out in chunks and each pair of chunks
    has a list of its own."""
    parts = np.maximum(1, np.ceil(frequency(np.arange(256)) / CHUNK)).astype(np.int64)[rank]
    copies = np.maximum(parts - 1, 1)
    at = np.repeat(np.arange(len(sig)), copies)
    other = (np.arange(len(at)) - np.repeat(np.cumsum(copies) - copies, copies)).astype(np.uint64)
    p = parts[at].astype(np.uint64)
    own = _mixed(key[at]) % p
    other = other + (other >= own)
    lo, hi = np.minimum(own, other), np.maximum(own, other)
    return at, np.where(p > 1, _mixed(sig[at] + (lo * p + hi + _U(1)) * _MULT[2]), sig[at])


def possible(n: np.ndarray, gone: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs can link if their first common signature is the one they meet by."""
    return (100 + LEAST) * np.minimum(n[a] - gone[a], n[b] - gone[b]) >= LEAST * (n[a] + n[b])


def choose_boundary(sizes: list[tuple[int, float, float]]) -> int:
    """sizes: (size, weight, other sets met in an inverted list of its prefix). The boundary with the least total cost."""
    ladder = sorted({0, *(n * 100 // LEAST for n, _, _ in sizes)})  # where sets of size n stop being in both
    p = lambda n, extra: n - needed(n) + extra

    def cost(x: int) -> float:
        subsets = sum(f * p(n, 2) * (p(n, 2) - 1) / 2 for n, f, _ in sizes if 4 <= n <= x)
        scans = sum(f * p(n, 1) * (1 + MET * met) for n, f, met in sizes if n >= 4 and 100 * n >= LEAST * (x + 1))
        return subsets + scans

    return min(ladder, key=cost)


def _merge_sketch(payloads: list[bytes], last: bool) -> np.ndarray:
    total = sum(unpack(p)[0].astype(np.int64) for p in payloads)
    return np.minimum(255, np.ceil(STEPS * np.log2(np.maximum(1, total)))).astype(np.uint8) if last else total.astype(np.uint64)


def _merge_bits(payloads: list[bytes], last: bool) -> np.ndarray:
    return np.bitwise_or.reduce([unpack(p)[0] for p in payloads])


ROW = "kind string, doc_id long, n long, k1 long, k2 long, map binary, slice int, payload binary"
_ROW = pa.schema(
    [("kind", pa.string()), ("doc_id", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("map", pa.binary()), ("slice", pa.int32()), ("payload", pa.binary())]
)


def read_sets(docs: DataFrame) -> DataFrame:
    """kind doc: a row's set size, class key and parity map; kind sketch: a task's counts of shingles, with the task as doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, counts = Shingler(), np.zeros(SKETCH, np.uint32)
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = shingles(text.as_py())
                if len(s):
                    counts[s & _U(SKETCH - 1)] += 1  # two shingles of a set in one counter count once: an estimate either way
                rows.append(("doc", key, len(s), *class_key(s), parity_map(s) if len(s) else None, None, None))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ROW, strict=True)], schema=_ROW)
        task = TaskContext.get().partitionId()
        parts = [("sketch", task, None, None, None, None, k, pack(x)) for k, x in enumerate(np.split(counts, SLICES)) if x.any()]
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*parts, strict=True), _ROW, strict=True)], schema=_ROW)

    return docs.mapInArrow(run, ROW)


def _collect_slices(parts: DataFrame, merge, size: int, kind: type) -> np.ndarray:
    """Slices of each task (task, slice, payload), merged FAN tasks at a time, as one array of a fixed size."""

    def step(last: bool):
        def run(table: pa.Table) -> pa.Table:
            merged = merge(table.column("payload").to_pylist(), last)
            return pa.table({"task": table.column("task").slice(0, 1), "slice": table.column("slice").slice(0, 1), "payload": pa.array([pack(merged)], pa.binary())})

        return run

    tasks = (parts.agg(F.max("task").alias("n")).first().n or 0) + 1
    while tasks > 1:
        tasks = -(-tasks // FAN)
        parts = parts.withColumn("task", F.floor(F.col("task") / FAN).cast("long")).groupBy("task", "slice").applyInArrow(step(False), "task long, slice int, payload binary")
    out = np.zeros(size, kind)
    for r in parts.groupBy("slice").applyInArrow(step(True), "task long, slice int, payload binary").collect():  # SLICES rows at most
        part = unpack(r.payload)[0]
        out[r.slice * (size // SLICES) : r.slice * (size // SLICES) + len(part)] = part
    return out


def _costs(docs: DataFrame, sketch: np.ndarray, classes: DataFrame) -> list[tuple[int, float, float]]:
    """(size, weight, other sets met) of a bounded sample of the documents. Copies of a set are one class: they weigh as one,
    and do not meet one another."""
    sample = docs.orderBy(F.xxhash64("id"), F.xxhash64("text")).limit(COST_SAMPLE)
    noise = float(np.median(sketch))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, out, keys = Shingler(), [], []
        for batch in batches:
            for text in batch.column(1):
                s = shingles(text.as_py())
                if len(s) >= 4:
                    keys.append(class_key(s))
                    met = np.maximum(frequency(sketch[prefix(s, sketch, 1) & _U(SKETCH - 1)]) - frequency(noise), 0.0)
                    out.append((len(s), float(met.mean())))
        columns = [pa.array([k for k, _ in keys], pa.int64()), pa.array([k for _, k in keys], pa.int64()), pa.array([n for n, _ in out], pa.int64()), pa.array([m for _, m in out], pa.float64())]
        yield pa.RecordBatch.from_arrays(columns, ["k1", "k2", "n", "met"])

    rows = sample.mapInArrow(run, "k1 long, k2 long, n long, met double").join(classes.select("k1", "k2", "copies"), ["k1", "k2"])
    return [(r.n, 1 / r.copies, max(0.0, r.met - r.copies + 1)) for r in rows.select("n", "met", "copies").collect()]  # COST_SAMPLE rows at most


LISTS = "h1 long, h2 long, size int, k1 long, k binary, n binary"


def find_lists(docs: DataFrame, sketch: np.ndarray, boundary: int, buckets: int) -> DataFrame:
    """Lists of at least two classes (keys and sizes, by size; k1: the first key) that have a signature in common and may
    link. Lists with the same classes are one. h1 and h2 are a digest of the classes."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler()
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        keys: dict[tuple[int, int], int] = {}
        held = 0

        def close() -> pa.RecordBatch:
            sig, gone, rank = (np.concatenate(x) for x in zip(*(f[:3] for f in found), strict=True))
            doc = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
            k = np.array([x for x, _ in keys], np.int64).view(np.uint64)
            n = np.array([f[3] for f in found], np.uint64)
            at, sig = spread(sig, rank, k[doc])
            doc, gone = doc[at], gone[at]
            bucket = (sig >> _U(24)) % _U(buckets)
            order = np.lexsort((sig, bucket))
            rows = []
            for s, e in _runs(bucket[order]):
                mine = order[s:e]
                own, place = np.unique(doc[mine], return_inverse=True)
                rows.append((int(bucket[mine[0]]), pack(np.diff(sig[mine], prepend=_U(0)), place.astype(np.uint32), gone[mine].astype(np.uint32), k[own], n[own])))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "payload"])

        for batch in batches:
            for text in batch.column(1):
                s = shingles(text.as_py())
                key = class_key(s)
                if len(s) < 4 or key in keys:
                    continue
                keys[key] = len(keys)
                found.append((*signatures(s, sketch, boundary), len(s)))
                held += len(found[-1][0])
                if held > SENT:
                    yield close()
                    found, keys, held = [], {}, 0
        if held:
            yield close()

    def meet(table: pa.Table) -> pa.Table:
        parts = [unpack(p) for p in table.column("payload").to_pylist()]
        sig = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts])
        gone = np.concatenate([p[2] for p in parts]).astype(np.int64)
        k = np.concatenate([p[3].astype(np.uint64)[p[1]] for p in parts])
        n = np.concatenate([p[4].astype(np.int64)[p[1]] for p in parts])
        del parts
        order = np.lexsort((k, n, sig))
        sig, k, n, gone = sig[order], k[order], n[order], gone[order]
        fresh = np.concatenate([[True], (np.diff(sig) != 0) | (np.diff(k) != 0)])
        sig, k, n, gone = sig[fresh], k[fresh], n[fresh], gone[fresh]
        first = _starts(sig)
        length = np.diff(np.concatenate([first, [len(sig)]]))
        keep = np.zeros(len(sig), bool)
        for a, b in _pairs_of_lists(first[(length > 1) & (length <= 64)], length[(length > 1) & (length <= 64)]):
            ok = possible(n, gone, a, b)
            keep[a[ok]] = keep[b[ok]] = True
        for s, m in zip(first[length > 64].tolist(), length[length > 64].tolist(), strict=True):
            for a, b in _pairs_in_range(n, np.arange(s, s + m)):
                ok = possible(n, gone, a, b)
                keep[a[ok]] = keep[b[ok]] = True
        sig, k, n = sig[keep], k[keep], n[keep].astype(np.uint32)
        out: dict[bytes, tuple] = {}
        for s, e in _runs(sig):
            content = k[s:e].tobytes()
            digest = hashlib.blake2b(content, digest_size=16).digest()
            if digest not in out:
                out[digest] = (e - s, int(k[s : s + 1].view(np.int64)[0]), content, n[s:e].tobytes())
        h = np.frombuffer(b"".join(out), np.int64).reshape(-1, 2)
        return pa.table(
            {
                "h1": pa.array(h[:, 0]),
                "h2": pa.array(h[:, 1]),
                "size": pa.array([v[0] for v in out.values()], pa.int32()),
                "k1": pa.array([v[1] for v in out.values()], pa.int64()),
                "k": pa.array([v[2] for v in out.values()], pa.binary()),
                "n": pa.array([v[3] for v in out.values()], pa.binary()),
            }
        )

    sent = docs.mapInArrow(send, "bucket long, payload binary")
    return sent.groupBy("bucket").applyInArrow(meet, LISTS).dropDuplicates(["h1", "h2"])


def _starts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.empty(0, np.int64)


def _runs(x: np.ndarray) -> list[tuple[int, int]]:
    """Where runs of equal values begin and end."""
    at = _starts(x).tolist()
    return list(zip(at, [*at[1:], len(x)][: len(at)], strict=True))


def find_stars(lists: DataFrame) -> DataFrame:
    """a, b, near: each set of a list with the pivot of its range of sizes (near), and pivots with one another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: set[tuple[int, int, bool]] = set()
            for kb, nb in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                k, n = np.frombuffer(kb, np.int64).tolist(), np.frombuffer(nb, np.uint32).tolist()
                pivot = 0
                for m in range(1, len(k)):
                    near = LEAST * n[m] <= 100 * n[pivot]
                    out.add((k[pivot], k[m], near))
                    if not near:
                        pivot = m
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.bool_())], ["a", "b", "near"])

    return lists.select("k", "n").mapInArrow(run, "a long, b long, near boolean").distinct()


def _passing(n: np.ndarray, maps: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs pass the size filter and the parity bound on the overlap."""
    na, nb = n[a], n[b]
    ok = (100 * np.minimum(na, nb) >= LEAST * np.maximum(na, nb)).nonzero()[0]
    for k in range(0, len(ok), 100_000):
        at = ok[k : k + 100_000]
        apart = np.bitwise_count(maps[a[at]] ^ maps[b[at]]).sum(axis=1).astype(np.int64)
        # overlap <= (na + nb - apart) / 2, union >= (na + nb + apart) / 2
        ok[k : k + 100_000] = np.where(100 * (na[at] + nb[at] - apart) >= LEAST * (na[at] + nb[at] + apart), at, -1)
    return ok[ok >= 0]


def _pairs_of_lists(first: np.ndarray, length: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of places within each run (first, length), a bounded number at a time."""
    for size in np.unique(length):
        starts = first[length == size]
        i, j = np.triu_indices(int(size), 1)
        step = max(1, 400_000 // max(1, len(i)))
        for k in range(0, len(starts), step):
            s = starts[k : k + step, None]
            yield (s + i).ravel(), (s + j).ravel()


def _pairs_in_range(n: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of the places `at` whose sizes are close enough, a bounded number at a time."""
    at = at[np.argsort(n[at], kind="stable")]
    size = n[at]
    ends = np.searchsorted(size, size * 100 // LEAST, side="right")
    count = ends - np.arange(len(at)) - 1
    start = 0
    while start < len(at):
        stop = max(start + 1, int(np.searchsorted(np.cumsum(count[start:]), 400_000, side="right")) + start)
        c = count[start:stop]
        i = np.repeat(np.arange(start, stop), c)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c)
        yield at[i], at[j]
        start = stop


PLACED = "k1", "k2", "cid", "n", "map", "min_id", "label", "comp", "tile"


def _numbered(members: DataFrame, tag: str) -> DataFrame:
    """With a tile of 2**TILE_BITS classes each: those of a region lie together, and of these those of a component."""
    rows = members.repartitionByRange("label", "comp", "cid").sortWithinPartitions("label", "comp", "cid")
    rows = rows.withColumn("tile", F.shiftright(F.monotonically_increasing_id(), TILE_BITS))
    return storage.written(rows.select(*PLACED), "tiles", tag=tag)


def place(stars: DataFrame, classes: DataFrame, tag: str) -> DataFrame:
    """The classes that are in lists, with their region (label: the least key that lists connect them with)."""
    label = components(stars.select("a", "b"), tag).select(F.col("y").alias("k1"), F.col("x").alias("label"))
    used = stars.select(F.explode(F.array("a", "b")).alias("k1")).distinct().join(label, "k1", "left")
    used = classes.join(used.withColumn("label", F.coalesce("label", "k1")), "k1")
    return _numbered(used.withColumn("comp", F.col("cid")), tag)


def star_pairs(stars: DataFrame, placed: DataFrame) -> DataFrame:
    """Pairs of pivots and members that pass the filters, by tiles."""
    side = lambda k: placed.select(F.col("k1").alias(k), *(F.col(c).alias(f"{c}_{k}") for c in ("cid", "tile", "n", "map")))
    rows = stars.where("near").select("a", "b").join(side("a"), "a").join(side("b"), "b").drop("a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if m := batch.num_rows:
                x = {c: batch.column(c).to_pylist() if c.startswith("map") else batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
                maps = np.frombuffer(b"".join(x["map_a"] + x["map_b"]), np.uint64).reshape(2 * m, -1)
                ok = _passing(np.concatenate([x["n_a"], x["n_b"]]), maps, np.arange(m), np.arange(m, 2 * m))
                ok = ok[x["cid_a"][ok] != x["cid_b"][ok]]
                yield from _tiles(x["tile_a"][ok], x["tile_b"][ok], x["cid_a"][ok], x["cid_b"][ok]).to_batches()

    return rows.mapInArrow(run, TILES)


def _compare(group: np.ndarray, members: pa.Table, cross: bool = False) -> pa.Table:
    """Tiles of the pairs of classes that are in one group, but not in one component, and pass the filters.
    cross: only pairs of different tiles."""
    cid, comp, n, tile = (members.column(c).to_numpy() for c in ("cid", "comp", "n", "tile"))
    maps = np.frombuffer(b"".join(members.column("map").to_pylist()), np.uint64).reshape(len(cid), -1)
    order = np.lexsort((cid, n, group))
    group, cid, comp, n, tile, maps = (x[order] for x in (group, cid, comp, n, tile, maps))
    first = _starts(group)
    length = np.diff(np.concatenate([first, [len(group)]]))
    who, code = np.unique(cid, return_inverse=True)
    home = np.empty(len(who), np.int64)
    home[code] = tile
    found: list[np.ndarray] = [np.empty(0, np.int64)]
    held = 0

    def put(a: np.ndarray, b: np.ndarray) -> None:
        nonlocal found, held
        ok = (comp[a] != comp[b]) & ((tile[a] != tile[b]) | (not cross))
        a, b = a[ok], b[ok]
        ok = _passing(n, maps, a, b)
        x, y = code[a[ok]], code[b[ok]]
        found.append(np.unique(np.minimum(x, y) * len(who) + np.maximum(x, y)))
        held += len(found[-1])
        if held > 4_000_000:
            found, held = [np.unique(np.concatenate(found))], 0

    for a, b in _pairs_of_lists(first[(length > 1) & (length <= 64)], length[(length > 1) & (length <= 64)]):
        put(a, b)
    for s, m in zip(first[length > 64].tolist(), length[length > 64].tolist(), strict=True):
        for a, b in _pairs_in_range(n, np.arange(s, s + m)):
            put(a, b)
    x, y = np.divmod(np.unique(np.concatenate(found)), max(1, len(who)))
    return _tiles(home[x], home[y], who[x], who[y])


def rest_pairs(lists: DataFrame, placed: DataFrame, comps: DataFrame, buckets: int, tag: str) -> tuple[DataFrame, DataFrame]:
    """(pairs by tiles, the classes in tiles): all pairs that lists name, of different components, that pass the filters."""
    found = comps.select(F.col("y").alias("cid"), F.col("x").alias("comp"))
    members = placed.drop("tile", "comp").join(found, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    sizes = members.groupBy("label", "comp").agg(F.count("*").alias("m"))
    order = F.struct("m", "comp")
    regions = sizes.groupBy("label").agg(F.sum("m").alias("m"), F.count("*").alias("comps"), F.max(order).getField("comp").alias("main"))
    regions = regions.where("comps > 1 and m > 2").select("label", "m", "main")  # of two, the star has compared the pair
    named = lists.select("h1", "h2", "size", "k", "k1").join(placed.select("k1", "label").distinct(), "k1").drop("k1")
    pairs = named.groupBy("label").agg(F.sum(F.col("size").cast("long") * (F.col("size") - 1)).alias("named"))
    regions = storage.written(regions.join(pairs, "label").withColumn("dense", F.expr("named >= m * (m - 1)")), "regions", tag=tag)
    members = _numbered(members.join(regions.select("label"), "label"), tag)

    # Dense regions: pairs of tiles, but not of tiles that hold the same one component.
    tiles = members.join(regions.where("dense").select("label", "main"), "label").groupBy("label", "tile").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.first("main").alias("main"))
    left = tiles.where("lo <> hi or lo <> main").select("label", F.col("tile").alias("t"), F.col("lo").alias("tlo"), F.col("hi").alias("thi"))
    both = left.join(tiles, "label").where("not (tlo = thi and lo = hi and tlo = lo)")
    both = both.select("label", F.least("t", "tile").alias("ti"), F.greatest("t", "tile").alias("tj")).distinct()
    ends = F.when(F.col("ti") == F.col("tj"), F.array("ti")).otherwise(F.array("ti", "tj"))
    rows = both.withColumn("tile", F.explode(ends)).join(members.select("label", "tile", "cid", "comp", "n", "map"), ["label", "tile"])

    def by_tiles(table: pa.Table) -> pa.Table:
        return _compare(table.column("label").to_numpy(), table, table.column("ti")[0].as_py() != table.column("tj")[0].as_py())

    dense = rows.groupBy("ti", "tj").applyInArrow(by_tiles, TILES)

    # Other regions: list by list.
    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = [np.frombuffer(x, np.int64) for x in batch.column(2).to_pylist()]
            each = [len(x) for x in k]
            h1, h2 = (np.repeat(batch.column(c).to_numpy(), each) for c in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), pa.array(np.concatenate(k) if k else [], pa.int64())], ["h1", "h2", "k1"])

    sparse = named.join(regions.where("not dense").select("label"), "label").select("h1", "h2", "k").mapInArrow(entries, "h1 long, h2 long, k1 long")
    sparse = sparse.join(members.select("k1", "cid", "comp", "n", "map", "tile"), "k1")
    sparse = sparse.withColumn("bucket", F.pmod("h1", F.lit(buckets)).cast("int"))

    def by_lists(table: pa.Table) -> pa.Table:
        both = np.column_stack([table.column("h1").to_numpy(), table.column("h2").to_numpy()])
        return _compare(np.unique(both, axis=0, return_inverse=True)[1].ravel(), table)

    return dense.unionByName(sparse.groupBy("bucket").applyInArrow(by_lists, TILES)), members


TILES = "ti long, tj long, pairs binary"


def merged(pairs: DataFrame, tag: str) -> DataFrame:
    """Of each pair of tiles one row with its pairs, and one for each class in them."""

    def merge(table: pa.Table) -> pa.Table:
        ti, tj = table.column("ti")[0].as_py(), table.column("tj")[0].as_py()
        both = [np.column_stack(unpack(p)).astype(np.int64) for p in table.column("pairs").to_pylist()]
        both = np.unique(np.concatenate(both), axis=0)
        ids = np.unique(both)
        m = len(ids) + 1
        return pa.table(
            {
                "ti": pa.array([ti] * m, pa.int64()),
                "tj": pa.array([tj] * m, pa.int64()),
                "cid": pa.array([None, *ids.tolist()], pa.int64()),
                "pairs": pa.array([pack(both[:, 0].astype(np.uint64), both[:, 1].astype(np.uint64)), *[None] * len(ids)], pa.binary()),
            }
        )

    return storage.written(pairs.groupBy("ti", "tj").applyInArrow(merge, "ti long, tj long, cid long, pairs binary"), "pairs", tag=tag)


def _tiles(ti: np.ndarray, tj: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.Table:
    """Pairs as one value for each pair of tiles, the lesser tile first."""
    swap = ti > tj
    ti, tj, a, b = np.where(swap, tj, ti), np.where(swap, ti, tj), np.where(swap, b, a), np.where(swap, a, b)
    order = np.lexsort((tj, ti))
    ti, tj, a, b = ti[order], tj[order], a[order].astype(np.uint64), b[order].astype(np.uint64)
    cuts = np.flatnonzero(np.concatenate([[True], (np.diff(ti) != 0) | (np.diff(tj) != 0)])) if len(ti) else np.empty(0, np.int64)
    ends = np.concatenate([cuts[1:], [len(ti)]]).astype(np.int64) if len(ti) else cuts
    return pa.table(
        {
            "ti": pa.array(ti[cuts], pa.int64()),
            "tj": pa.array(tj[cuts], pa.int64()),
            "pairs": pa.array([pack(a[s:e], b[s:e]) for s, e in zip(cuts.tolist(), ends.tolist(), strict=True)], pa.binary()),
        }
    )


def linked(sets: dict[int, np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of sets reach the threshold: one by one, or many pairs of few sets by a product of matrices."""
    ids = np.unique(np.concatenate([a, b]))
    size = np.array([len(sets[k]) for k in ids.tolist()])
    x, y = np.searchsorted(ids, a), np.searchsorted(ids, b)
    if len(a) < 8 * len(ids):
        both = np.array([len(np.intersect1d(sets[p], sets[q], assume_unique=True)) for p, q in zip(a.tolist(), b.tolist(), strict=True)])
    else:
        token, column, often = np.unique(np.concatenate([sets[k] for k in ids.tolist()]), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(ids)), size)
        shared = often[column] > 1
        rank = np.cumsum(often > 1) - 1
        row, column, width = row[shared], rank[column[shared]], int((often > 1).sum())
        product = np.zeros((len(ids), len(ids)), np.float32)  # counts below 2**24 are exact
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        for k in range(0, width, 8192):
            s, e = np.searchsorted(column, [k, k + 8192])
            m = np.zeros((len(ids), min(8192, width - k)), np.float32)
            m[row[s:e], column[s:e] - k] = 1
            product += m @ m.T
        both = product[x, y].astype(np.int64)
    return 100 * both >= LEAST * (size[x] + size[y] - both)


def _bits_of(keys: np.ndarray) -> list[np.ndarray]:
    h = _mixed(keys.astype(np.int64).view(np.uint64) + _MULT[2])
    return [(h & _U(FILTER - 1)).astype(np.int64), ((h >> _U(32)) & _U(FILTER - 1)).astype(np.int64)]


def verify(tiles: DataFrame, placed: DataFrame, docs: DataFrame, tag: str) -> DataFrame:
    """a, b: a spanning forest, task by task, of the pairs whose sets reach the threshold. Whole sets are read again,
    for the documents in pairs only, and each is sent once to every pair of tiles that needs it."""
    wanted = tiles.where("cid is not null").select("cid").distinct().join(placed.select("cid", "k1", "k2", "min_id"), "cid")
    wanted = storage.written(wanted, "wanted", tag=tag)

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(FILTER // 8, np.uint8)
        for batch in batches:
            keys = batch.column(0).drop_null().to_numpy(zero_copy_only=False)
            for at in _bits_of(keys):
                np.bitwise_or.at(out, at >> 3, (1 << (at & 7)).astype(np.uint8))
        task = TaskContext.get().partitionId()
        parts = [(task, k, pack(x)) for k, x in enumerate(np.split(out, SLICES)) if x.any()]
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], pa.int64()), pa.array([p[1] for p in parts], pa.int32()), pa.array([p[2] for p in parts], pa.binary())], ["task", "slice", "payload"])

    if wanted.count() <= FILTER // 8:
        wanted_bits = _collect_slices(wanted.select("min_id").mapInArrow(bits, "task long, slice int, payload binary"), _merge_bits, FILTER // 8, np.uint8)
    else:  # more than the filter can tell apart: the same documents by a join
        wanted_bits = np.full(FILTER // 8, 255, np.uint8)
        docs = docs.join(wanted.select(F.col("min_id").alias("id")).distinct(), "id", "left_semi").unionByName(docs.where("id is null"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, seen = Shingler(), set()
        for batch in batches:
            ids = batch.column(0)
            keys = ids.fill_null(0).to_numpy(zero_copy_only=False)
            x, y = _bits_of(keys)
            hit = ((wanted_bits[x >> 3] >> (x & 7)) & (wanted_bits[y >> 3] >> (y & 7)) & 1).astype(bool) | ids.is_null().to_numpy(zero_copy_only=False)
            out: list[tuple] = []
            for k in np.flatnonzero(hit).tolist():
                s = shingles(batch.column(1)[k].as_py())
                key = class_key(s)
                if len(s) and key not in seen:
                    seen.add(key)
                    out.append((*key, s.tobytes()))
                if len(out) >= 500:
                    yield _sets(out)
                    out = []
            if out:
                yield _sets(out)

    def _sets(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.binary())], ["k1", "k2", "set"])

    found = docs.mapInArrow(sets, "k1 long, k2 long, set binary").join(wanted.select("cid", "k1", "k2"), ["k1", "k2"]).select("cid", "set")
    found = storage.written(found, "sets", tag=tag)
    buckets = max(8, math.ceil(tiles.count() / TILE_ROWS))
    rows = tiles.where("cid is not null").select("ti", "tj", "cid").join(found, "cid").select("ti", "tj", "cid", "set", F.lit(None).cast("binary").alias("pairs"))
    rows = rows.unionByName(tiles.where("pairs is not null").select("ti", "tj", "cid", F.lit(None).cast("binary").alias("set"), "pairs"))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("ti", "tj"), F.lit(buckets)).cast("int"))

    def compare(table: pa.Table) -> pa.Table:
        sets_of: dict[int, np.ndarray] = {}
        for key, value in zip(table.column("cid").to_pylist(), table.column("set").to_pylist(), strict=True):
            if value is not None and key not in sets_of:
                sets_of[key] = np.frombuffer(value, np.uint64)
        trees: dict[int, int] = {}
        for payload in table.column("pairs").to_pylist():
            if payload is not None:
                a, b = (x.astype(np.int64) for x in unpack(payload))
                ok = linked(sets_of, a, b)
                for p, q in zip(a[ok].tolist(), b[ok].tolist(), strict=True):
                    forest(trees, p, q)
        out = [(x, y) for x, y in roots(trees) if x != y]
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return storage.written(rows.groupBy("bucket").applyInArrow(compare, "a long, b long"), "links", tag=tag)


def join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tag: str = "", boundary: int | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, one row per row of df. boundary: the largest size of a small set, by cost if None."""
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    buckets = max(8, math.ceil(storage.text_bytes(docs, "text") / BUCKET_BYTES))
    read = storage.written(read_sets(docs), "sets-read", "kind", tag=tag)
    rows = read.where("kind = 'doc'").select("doc_id", "n", "k1", "k2", "map")
    sketch = _collect_slices(read.where("kind = 'sketch'").select(F.col("doc_id").alias("task"), "slice", "payload"), _merge_sketch, SKETCH, np.uint8)
    classes = rows.where("n > 0").groupBy("k1", "k2").agg(F.first("n").alias("n"), F.min("doc_id").alias("min_id"), F.first("map").alias("map"), F.count("*").alias("copies"))
    classes = storage.written(classes.withColumn("cid", F.monotonically_increasing_id()), "classes", tag=tag)
    if boundary is None:
        boundary = choose_boundary(_costs(docs, sketch, classes))
    lists = storage.written(find_lists(docs, sketch, boundary, buckets), "lists", tag=tag)

    stars = storage.written(find_stars(lists), "stars", tag=tag)
    placed = place(stars, classes, tag)
    links = verify(merged(star_pairs(stars, placed), tag), placed, docs, tag)
    pairs, members = rest_pairs(lists, placed, components(links, tag), buckets, tag)
    more = verify(merged(pairs, tag), members, docs, tag)
    comps = components(links.unionByName(more), tag)

    labelled = classes.select("k1", "k2", "cid", "min_id").join(comps.select(F.col("y").alias("cid"), F.col("x").alias("root")), "cid", "left")
    labelled = labelled.withColumn("root", F.coalesce("root", "cid"))
    least = labelled.groupBy("root").agg(F.min("min_id").alias("component_id"))
    by_class = labelled.join(least, "root").select("k1", "k2", "component_id")
    out = rows.select("doc_id", "n", "k1", "k2").join(by_class, ["k1", "k2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tag: str = "") -> DataFrame:
    """The rows of df, with df's own columns, without those whose component has a smaller id.

    Rows with a null id stay. An id that several texts share goes only if all of them would go.
    """
    found = join(df, id_col, text_col, tag)
    kept = found.where("doc_id = component_id").select("doc_id")
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    gone = storage.written(gone.join(kept, F.col("_gone") == F.col("doc_id"), "left_anti"), "gone", tag=tag)
    rows = df.select(F.struct(*df.columns).alias("row"))  # apart from df's own names
    return rows.join(gone, F.col("row")[id_col].cast("long") == F.col("_gone"), "left_anti").select("row.*")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
e AS (SELECT doc_id, unnest(s) AS g FROM s),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * n >= 80 * (len(x.s) + len(y.s) - n)),
both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, x.b FROM reach r JOIN both_ways x ON x.a = r.b)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(r.b) AS component_id FROM s JOIN reach r ON r.a = s.doc_id GROUP BY ALL
"""
