"""Mixture-controlled packing: deficit round-robin over source queues.

Every source is a queue, its documents' tokens one after the other. A window is WINDOW sequences. In every window each
queue may serve its target share of the window's tokens: its deficit counter grows by the share and falls by what it
serves, and what rounding leaves over goes to the queues with the largest deficits, so that deficits stay below one
token and are carried from window to window. The schedule depends only on the queues' totals, so it is computed once
as a short list of phases (a phase ends when a queue runs dry and its share passes to the others); inside a phase the
schedule repeats with a cycle, whose deficits end at zero. A document's place then follows by arithmetic from the
tokens before it in its queue, which are a prefix sum over tasks: deficits carry across partitions without any task
seeing the tokens of another.

With more than MAX_QUEUES sources those with the most tokens (exact totals) and all that have a target keep queues of
their own; the small rest shares SHARED queues by hash, where a source's share is not controlled by itself. That bounds
what the driver holds; every piece names its true source.

All windows but the last are full; only the very last sequence is padded.

Defined results: null text counts as empty (its end id remains); null sources are one queue; repeated rows are packed
each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import ctypes
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchgrid.llm import storage, tokens

SEQUENCE = 2048
#: Sequences in a window, the unit whose mixture is controlled.
WINDOW = 64
#: Windows in a cycle, after which all deficits are zero again.
CYCLE = 16
#: Queues, besides those of sources with a target; with more sources the small ones share SHARED of them.
MAX_QUEUES = 4096
SHARED = 1024
END_ID = 1
#: Documents that a task turns into ids, or cuts, at once: Spark's batches are of 10,000 rows, each beside its ids.
ROWS = 512


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of ROWS, of which a task holds one beside the batch. Workers are used again, so what earlier tasks
    of any kind left free in them goes back to the system before and after."""
    _trim()
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS):
            yield batch.slice(k, ROWS)
    _trim()


def _trim() -> None:
    """Give free memory of this process back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def _shares(weights: np.ndarray, total: int) -> np.ndarray:
    """Integers in proportion to the weights whose sum is total (largest remainders, ties to the first)."""
    exact = weights / weights.sum() * total
    out = np.floor(exact).astype(np.int64)
    out[np.argsort(-(exact - out), kind="stable")[: total - int(out.sum())]] += 1
    return out


def drr(per_cycle: np.ndarray, windows: int) -> np.ndarray:
    """Tokens that each queue serves in each window of a cycle, windows x queues; every row has the same sum."""
    size, quantum = int(per_cycle.sum()) // windows, per_cycle / windows
    deficit, out = np.zeros(len(per_cycle)), np.zeros((windows, len(per_cycle)), np.int64)
    served = np.zeros(len(per_cycle), np.int64)
    for k in range(windows):
        deficit = quantum * (k + 1) - served
        take = np.minimum(np.maximum(np.floor(deficit + 1e-9), 0).astype(np.int64), per_cycle - served)
        while (left := size - int(take.sum())) > 0:
            rest = np.where(per_cycle - served - take > 0, deficit - take, -np.inf)
            order = np.argsort(-rest, kind="stable")[: min(left, int(np.isfinite(rest).sum()))]
            take[order] += 1
        while (over := int(take.sum()) - size) > 0:
            rest = np.where(take > 0, deficit - take, np.inf)
            take[np.argsort(rest, kind="stable")[: min(over, int(np.isfinite(rest).sum()))]] -= 1
        out[k] = take
        served += take
    return out


def schedule(totals: np.ndarray, targets: np.ndarray | None = None, window: int = WINDOW * SEQUENCE, cycle: int = CYCLE) -> list[tuple]:
    """Phases (first token, cycles, takes windows x queues, tokens before in each queue) that serve every token.

    targets: weights of the queues; None takes the totals, so that all queues run dry together.
    """
    totals = np.asarray(totals, np.int64)
    weights = np.asarray(totals if targets is None else targets, float)
    left, at, phases = totals.copy(), 0, []
    while left.any():
        live = left > 0
        w = np.where(live, weights, 0.0)
        if not w.sum() > 0:
            w = np.where(live, left, 0).astype(float)
        for windows in sorted({cycle, max(1, cycle // 4), 1}, reverse=True):
            per = _shares(w, window * windows)
            n = int(np.min(left[per > 0] // per[per > 0]))
            if n:
                takes = drr(per, windows)
                break
        else:  # some queue ends inside the next window: what is left of it, and more from the others
            n, takes = 1, _last(left, w, window)[None, :]
        phases.append((at, n, takes, totals - left))
        at += n * int(takes.sum())
        left = left - n * takes.sum(axis=0)
    return phases


def _last(left: np.ndarray, weights: np.ndarray, window: int) -> np.ndarray:
    """One window's takes when some queue holds less than its share."""
    take, want = np.zeros_like(left), min(window, int(left.sum()))
    while (short := want - int(take.sum())) > 0:
        open_ = left > take
        w = np.where(open_, weights, 0.0)
        w = w if w.sum() > 0 else open_.astype(float)
        take = np.minimum(left, take + _shares(w, short))
    return take


class Placer:
    """Where a queue's tokens lie: cuts a document into pieces (start, length, global position)."""

    def __init__(self, phases: list[tuple]):
        self.phases = []
        for at, n, takes, before in phases:
            inside = np.cumsum(takes, axis=1) - takes  # place in its window
            prefix = np.vstack([np.zeros(takes.shape[1], np.int64), np.cumsum(takes, axis=0)])
            starts = np.concatenate([[0], np.cumsum(takes.sum(axis=1))])  # first token of each window of the cycle
            self.phases.append((at, n, takes, before, inside, prefix, starts))

    def pieces(self, queue: int, first: int, length: int) -> Iterator[tuple[int, int, int]]:
        """first: tokens before the document in its queue."""
        x, end = first, first + length
        for at, n, takes, before, inside, prefix, starts in self.phases:
            per = int(prefix[-1, queue])
            stop = int(before[queue]) + n * per
            while x < min(end, stop):
                c, r = divmod(x - int(before[queue]), per)
                k = int(np.searchsorted(prefix[:, queue], r, side="right")) - 1
                into = r - int(prefix[k, queue])
                m = min(int(takes[k, queue]) - into, end - x)
                position = at + c * int(starts[-1]) + int(starts[k]) + int(inside[k, queue]) + into
                while m:
                    cut = min(m, SEQUENCE - position % SEQUENCE)
                    yield x - first, cut, position
                    x, m, position = x + cut, m - cut, position + cut


def _own_queues(parts: DataFrame, targets: dict[str, float] | None) -> list[str | None]:
    """The sources that have a queue of their own, in order: all, or those with the most tokens and those with a target."""
    totals = parts.groupBy("s").agg(F.sum("tokens").alias("tokens"))
    most = [r.s for r in totals.orderBy(F.desc("tokens"), "s").limit(MAX_QUEUES + 1).collect()]
    if len(most) > MAX_QUEUES:
        most = most[: MAX_QUEUES - SHARED]
        if targets:
            named = F.broadcast(parts.sparkSession.createDataFrame([(x,) for x in targets], "name string"))
            most += [r.s for r in totals.join(named, F.col("s").eqNullSafe(F.col("name")), "left_semi").collect()]
    return sorted(set(most), key=lambda x: (x is None, x))


def pack(
    df: DataFrame, vocabulary_path: str, targets: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", tag: str = "", with_ids: bool = True
) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source, and unless told otherwise ids (binary,
    uint32 little-endian)."""
    spark = df.sparkSession

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, task, before, row = tokens.byte_encoder(vocabulary_path), TaskContext.get().partitionId(), {}, 0
        for batch in _slices(batches):
            keys, sources = batch.column(0), batch.column(2).to_pylist()
            out = {"task": [], "row": [], "source": sources, "id": keys, "before": [], "n": [], "ids": []}
            for name, text in zip(sources, batch.column(1), strict=True):
                ids = np.append(ids_of(text.as_py()), np.uint32(END_ID))
                out["task"].append(task)
                out["row"].append(row)
                out["before"].append(before.get(name, 0))
                out["n"].append(len(ids))
                out["ids"].append(ids.astype("<u4").tobytes())
                before[name] = before.get(name, 0) + len(ids)
                row += 1
            yield pa.RecordBatch.from_pydict(out, schema)

    schema = pa.schema([("task", pa.int64()), ("row", pa.int64()), ("source", pa.string()), ("id", pa.int64()), ("before", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])
    rows = df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"), F.col(source_col).cast("string"))
    done = storage.written(rows.mapInArrow(tokenise, "task long, row long, source string, id long, before long, n long, ids binary"), "packing-ids", tag=tag)

    parts = storage.written(done.groupBy(F.col("task").alias("t"), F.col("source").alias("s")).agg(F.sum("n").alias("tokens")), "packing-parts", tag=tag)
    own = _own_queues(parts, targets)
    number = spark.createDataFrame(list(enumerate(own)), "q long, name string")  # bounded by MAX_QUEUES and the caller's targets
    shared = F.lit(len(own)) + F.pmod(F.xxhash64("s"), F.lit(SHARED))
    parts = parts.join(F.broadcast(number), F.col("s").eqNullSafe(F.col("name")), "left").select("t", "s", "tokens", F.coalesce("q", shared).alias("q"))
    # A queue's order is by task, and by source inside a task.
    w = Window.partitionBy("q").orderBy("t", "s").rowsBetween(Window.unboundedPreceding, -1)
    # As a table its size is known when the join is planned: Spark broadcasts it only below its threshold.
    parts = storage.written(parts.withColumn("ahead", F.coalesce(F.sum("tokens").over(w), F.lit(0))), "packing-starts", tag=tag)
    sums = sorted(parts.groupBy("q").agg(F.sum("tokens").alias("n")).collect())  # as many rows as there are queues
    goal = None if targets is None else np.array([targets.get(own[r.q], 0.0) if r.q < len(own) else 0.0 for r in sums], float)
    phases, place = schedule(np.array([r.n for r in sums], np.int64), goal), {r.q: k for k, r in enumerate(sums)}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        placer = Placer(phases)
        for batch in _slices(batches):
            out: list[list] = [[] for _ in out_schema]
            for key, name, queue, first, ids in zip(*(batch.column(k).to_pylist() for k in range(4)), batch.column(4), strict=True):
                data = ids.as_buffer()
                n = len(data) // 4
                for start, length, position in placer.pieces(place[queue], first, n):
                    piece = bytes(data[4 * start : 4 * (start + length)])
                    row = (key, start, length, zlib.crc32(piece), n, position // SEQUENCE, position % SEQUENCE, name, piece)
                    for to, v in zip(out, row[: len(out)], strict=True):
                        to.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(out, out_schema, strict=True)], schema=out_schema)

    long = pa.int64()
    out_schema = pa.schema(
        [("doc_id", long), ("start", long), ("length", long), ("ids_crc32", long), ("doc_tokens", long), ("sequence_id", long), ("offset", long), ("source", pa.string()), *[("ids", pa.binary())] * with_ids]
    )
    result = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string" + ", ids binary" * with_ids
    if not sums:
        return spark.createDataFrame([], result)
    placed = done.join(parts, (F.col("task") == F.col("t")) & F.col("source").eqNullSafe(F.col("s")))
    placed = placed.select("id", "source", "q", (F.col("ahead") + F.col("before")).alias("first"), "ids")
    return placed.mapInArrow(cut, result)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, tokens.default_path(), with_ids=False)
