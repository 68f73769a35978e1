"""Katz backoff scoring: Good-Turing discounted n-gram counts with exactly normalised backoff weights.

P(w | h) is the discounted relative frequency where the n-gram was seen in training, else alpha(h) * P(w | h'), with h'
the history without its first token, and P(w | h') where h was never followed by anything. P(w) is discounted in the same
way; what is left goes to the class of unknown words. alpha(h) is the mass that h's discounts leave, over the mass that the
lower order gives to what never followed h, both summed over h's own continuations, so that every history's distribution
sums to one. The order is a parameter; each order's probabilities are made from those of the order below, token by token.

Texts are cut into words once, into blocks of about BLOCK_TOKENS tokens. Blocks and buckets of n-grams exchange messages:

  blocks -> buckets of words:    distinct words with their counts in training texts
  buckets -> blocks:             the words' numbers and counts in the whole corpus
  and for each order from two
  blocks -> buckets of n-grams:  distinct n-grams with their counts in training texts and their lower-order probabilities
  buckets:                       a table of counts, from which the order's discounts follow, then the model's table: of each
                                 n-gram the discounted count, of each history the size and the backoff weight
  model's tables -> blocks:      what the table says of each n-gram that a block asks for

The tables lie in the shared folder, partitioned by kind and bucketed, so that a block's texts or a bucket's counts are
never shuffled again. A history with more than its share of all tokens is dealt over many buckets by the next word; its sums
are added up by a join. Every task holds one block or one bucket, whatever the size of the corpus or the frequency of a word.
From order three a history is known by a 64-bit hash of its words' numbers.

Defined results: null text counts as empty (one token, the end); a null doc_id is held out and never learned from;
repeated rows are learned from and scored each; with no training text every event has the probability of an unknown
word, one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchgrid.llm import storage
from matchgrid.llm.packs import pack, unpack

#: Tokens of a block, bytes of text for a bucket, counts up to which Good-Turing discounts apply.
BLOCK_TOKENS = 2_000_000
BUCKET_BYTES = 8_000_000
K = 5
#: Tokens of the longest n-gram.
ORDER = 2
#: The end of a text, which is also the history of its first token. No word is empty.
END = b""

_U = np.uint64
_MIX, _MIX2 = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _MIX
    h = (h ^ (h >> _U(29))) * _MIX2
    return h ^ (h >> _U(32))


def _starts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.empty(0, np.int64)


def _runs(x: np.ndarray) -> list[tuple[int, int]]:
    at = _starts(x).tolist()
    return list(zip(at, [*at[1:], len(x)][: len(at)], strict=True))


@dataclass
class Level:
    """Counts of one order: the sum, the number of types, and how many types were seen 1 to K + 1 times."""

    total: int
    types: int
    seen: np.ndarray

    def discounts(self) -> np.ndarray:
        """d[c] for counts c of 0 to K (d[0] unused); counts above K keep their value.

        Where the Good-Turing ratio is not usable, as no type has a needed count or it is not inside (0, 1), half a
        count is taken off instead.
        """
        n = np.concatenate([[0.0], self.seen.astype(float)])
        common = (K + 1) * n[K + 1] / n[1] if n[1] else 1.0
        out = np.ones(K + 1)
        for r in range(1, K + 1):
            d = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if n[r] and common < 1 else 0.0
            out[r] = d if 0 < d < 1 else 1 - 0.5 / r
        return out


class Unigram:
    """P(w) as a function of w's count."""

    def __init__(self, level: Level):
        self.d, self.n, self.v = level.discounts(), level.total, level.types
        mass = float((self.d[1:] * np.arange(1, K + 1) * level.seen[:K]).sum()) + (self.n - float((np.arange(1, K + 1) * level.seen[:K]).sum()))
        self.spare = self.n - mass > 1e-9 * max(1, self.n)
        self.unknown = (self.n - mass) / self.n if self.n and self.spare else 1 / (self.n + 1)

    def p(self, c: np.ndarray) -> np.ndarray:
        c = np.asarray(c, float)
        if self.spare:
            known = np.where(c > K, c, c * self.d[np.minimum(c, K).astype(int)])
            known = known / max(1, self.n)
        else:
            known = c / (self.n + 1)
        return np.where(c > 0, known, self.unknown)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((np.asarray(c, float) + 1) / (self.n + (self.v + 1)))


def weights(total: np.ndarray, seen: np.ndarray, seen_lower: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(size, alpha, plain) of histories. total: tokens that followed; seen: how many types followed 1 to K times (rows x K);
    seen_lower: the sum of the lower order over the types that followed. P is a discounted count over size, or alpha times
    the lower order; size is zero where nothing followed. plain: no type is discounted, so one count is added for the rest."""
    total = total.astype(float)
    spare = (seen * (np.arange(1, K + 1) * (1 - d[1:]))).sum(axis=1)  # counts that the discounts leave
    plain = spare <= 1e-9
    size = np.where(plain, total + 1, total)
    alpha = np.where(plain, 1.0, spare) / np.maximum(size, 1) / np.maximum(1 - seen_lower, 1e-300)
    return np.where(total == 0, 0.0, size), np.where(total == 0, 1.0, alpha), plain


def discounted(c: np.ndarray, plain: np.ndarray, d: np.ndarray) -> np.ndarray:
    return np.where(plain | (c > K), c, c * d[np.minimum(c, K).astype(int)]).astype(float)


def _message(kind: str, block: int, bucket: int, payload: bytes, history: int = 0, sums: list[float] | None = None) -> tuple:
    return kind, block, bucket, history, sums, payload


MESSAGE = "kind string, block long, bucket long, history long, sums array<double>, payload binary"
_SCHEMA = pa.schema(
    [("kind", pa.string()), ("block", pa.int64()), ("bucket", pa.int64()), ("history", pa.int64()), ("sums", pa.list_(pa.float64())), ("payload", pa.binary())]
)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)


def _table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([_batch(rows)] if rows else [], _SCHEMA)


def _is_held(key: int | None, of: int, rest: int) -> bool:
    return key is None or zlib.crc32(str(key).encode()) % of == rest


def make_blocks(df: DataFrame, buckets: int, of: int, rest: int) -> DataFrame:
    """kind doc: a block's texts as numbers of its own words; kind voc: its distinct words by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seq = TaskContext.get().partitionId(), count()
        number: dict[bytes, int] = defaultdict()
        number.default_factory = number.__len__
        keys: list[int | None] = []
        ids: list[np.ndarray] = []
        size = 0

        def close() -> Iterator[pa.RecordBatch]:
            block = (task << 24) | next(seq)
            n = np.array([len(x) for x in ids], np.uint32)
            held = np.array([_is_held(k, of, rest) for k in keys], np.uint8)
            flat = np.concatenate(ids)
            train = np.bincount(flat[np.repeat(held == 0, n)], minlength=len(number)).astype(np.uint32)
            sign = np.array(keys, object)
            null = np.array([k is None for k in keys], np.uint8)
            signed = np.array([0 if k is None else k for k in sign], np.int64)
            yield _batch([_message("doc", block, 0, pack(flat, n, held, signed.view(np.uint64), null, np.array([len(number)], np.uint64)))])
            words = list(number)
            bucket = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int64, len(words))
            order = np.argsort(bucket, kind="stable")
            out = []
            for start, stop in _runs(bucket[order]):
                at = order[start:stop]
                out.append(_message("voc", block, int(bucket[at[0]]), pack(b"\n".join([words[k] for k in at]), train[at], at.astype(np.uint32))))
            yield _batch(out)

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = (text.as_py() or "").encode().lower().split()
                ids.append(np.fromiter(map(number.__getitem__, [*found, END]), np.uint32, len(found) + 1))
                keys.append(key)
                size += len(found) + 1
                if size >= BLOCK_TOKENS:
                    yield from close()
                    number.clear()
                    keys, ids, size = [], [], 0
        if keys:
            yield from close()

    return df.mapInArrow(run, MESSAGE)


def _levels(table: DataFrame) -> Level:
    """Sums over the buckets' rows of kind stat."""
    sums = table.where("kind = 'stat'").agg(*(F.sum(F.col("sums")[j]).alias(f"s{j}") for j in range(K + 3))).first()
    s = [x or 0 for x in sums]
    return Level(int(s[0]), int(s[1]), np.array(s[2:], np.int64))


def _stat(counts: np.ndarray) -> list[float]:
    seen = np.bincount(np.minimum(counts, K + 2).astype(np.int64), minlength=K + 3)[1 : K + 2]
    return [float(counts.sum()), float((counts > 0).sum()), *(float(x) for x in seen)]


def count_words(voc: DataFrame, buckets: int) -> DataFrame:
    """Rows of kind uni (the model's words and counts), re1 (answers to blocks) and stat."""

    def run(table: pa.Table) -> pa.Table:
        number: dict[bytes, int] = defaultdict()
        number.default_factory = number.__len__
        got, bucket = [], table.column("bucket")[0].as_py()
        for block, payload in sorted(zip(table.column("block").to_pylist(), table.column("payload").to_pylist(), strict=True)):
            text, train, local = unpack(payload)
            words = text.tobytes().split(b"\n")
            got.append((block, np.fromiter(map(number.__getitem__, words), np.int64, len(words)), train, local))
        counts = np.zeros(len(number), np.int64)
        for _, at, train, _ in got:
            counts[at] += train
        out = [_message("re1", block, bucket, pack(local, at.astype(np.uint64) * np.uint64(buckets) + np.uint64(bucket), counts[at].astype(np.uint64))) for block, at, _, local in got]
        known = np.flatnonzero(counts)
        names = list(number)
        out.append(_message("uni", 0, bucket, pack(b"\n".join([names[k] for k in known]), known.astype(np.uint64), counts[known].astype(np.uint64))))
        out.append(_message("stat", 0, bucket, b"", sums=_stat(counts)))
        return _table(out)

    return voc.groupBy("bucket").applyInArrow(run, MESSAGE)


class _Block:
    """A block's texts as n-grams of growing order, each token's n-gram a number. Before each text stand ends."""

    def __init__(self, doc: bytes, words: list[bytes], unigram: Unigram, buckets: int, often: int):
        flat, self.n, held, keys, null, (types,) = unpack(doc)
        self.buckets, self.often, self.order = buckets, often, 1
        self.keys = [None if x else int(k) for k, x in zip(keys.astype(np.uint64).view(np.int64), null, strict=True)]
        self.n, self.held = self.n.astype(np.int64), held == 1
        self.gid, self.count = np.zeros(int(types), np.uint64), np.zeros(int(types), np.int64)
        for p in words:
            local, gid, c = unpack(p)
            self.gid[local], self.count[local] = gid, c
        starts = np.cumsum(self.n + 1) - self.n - 1
        self.real = np.ones(len(flat) + len(self.n), bool)
        self.real[starts] = False
        self.word = np.full(len(self.real), flat[self.n[0] - 1], np.uint32)
        self.word[self.real] = flat
        self.before = np.arange(-1, len(self.real) - 1)
        self.before[starts] = starts
        self.train = self.real & np.repeat(~self.held, self.n + 1)
        self.entry, self.key, self.total, self.p = self.word, self.gid, self.count, unigram.p(self.count)

    def grow(self) -> None:
        """Names the n-grams of the next order, and sorts them by bucket, history and word."""
        types = np.uint64(len(self.gid))
        pairs, entry = np.unique(self.entry[self.before].astype(np.uint64) * types + self.word, return_inverse=True)
        history, word = (x.astype(np.int64) for x in np.divmod(pairs, types))
        self.suffix = np.empty(len(pairs), np.int64)
        self.suffix[entry] = self.entry
        self.entry, self.order = entry.astype(np.int32), self.order + 1
        self.history, self.next = self.key[history], self.gid[word]
        self.hot = self.total[history] > self.often
        self.key = _mixed(self.history * _MIX2 + self.next)
        bucket = (_mixed(self.history ^ np.where(self.hot, (self.next + _U(1)) * _MIX2, _U(0))) % _U(self.buckets)).astype(np.int64)
        self.sorted = np.lexsort((self.next, self.history, bucket))
        self.cuts = {int(bucket[self.sorted[s]]): (s, e) for s, e in _runs(bucket[self.sorted])}

    def asks(self) -> Iterator[tuple[int, bytes]]:
        train = np.bincount(self.entry[self.train], minlength=len(self.suffix))
        for b, (s, e) in self.cuts.items():
            at = self.sorted[s:e]
            lower = self.suffix[at][train[at] > 0]
            lower = self.count[lower] if self.order == 2 else self.p[lower]
            yield b, pack(np.diff(self.history[at], prepend=_U(0)), self.next[at], train[at].astype(np.uint64), lower.astype(np.uint64) if self.order == 2 else lower, self.hot[at].astype(np.uint8))

    def take(self, answers: dict[int, bytes]) -> None:
        """Probabilities of the order's n-grams, from what the model's table says and those of the order below."""
        count, size, alpha = (np.zeros(len(self.suffix)) for _ in range(3))
        for b, (s, e) in self.cuts.items():
            at = self.sorted[s:e]
            c, *of_history = unpack(answers[b])
            first = _starts(self.history[at])
            count[at] = c
            size[at], alpha[at] = (np.repeat(x, np.diff(np.concatenate([first, [len(at)]]))) for x in of_history)
        lower = self.p[self.suffix]
        self.total, self.p = count, np.where(size == 0, lower, np.where(count > 0, count / np.maximum(size, 1), alpha * lower))


def _block_of(doc: pa.Table, answers: pa.Table, unigram: Unigram, buckets: int, often: int) -> _Block:
    """The block with all that has been answered, at its last order."""
    rows = list(zip(*(answers.column(c).to_pylist() for c in ("kind", "bucket", "payload")), strict=True))
    block = _Block(doc.column("payload")[0].as_py(), [p for k, _, p in rows if k == "re1"], unigram, buckets, often)
    for order in sorted({int(k[2:]) for k, _, _ in rows} - {1}):
        block.grow()
        block.take({b: p for k, b, p in rows if k == f"re{order}"})
    return block


def send_grams(blocks: DataFrame, answers: DataFrame, unigram: Unigram, buckets: int, often: int) -> DataFrame:
    def run(doc: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(doc):
            return _table([])
        x, block = _block_of(doc, answers, unigram, buckets, often), doc.column("block")[0].as_py()
        x.grow()
        return _table([_message("ask", block, b, p) for b, p in x.asks()])

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, MESSAGE)


def count_grams(sent: DataFrame, unigram: Unigram) -> DataFrame:
    """Rows of kind count (a bucket's n-grams), ask (which of them a block asks for), hot (partial sums) and stat."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        rows = sorted(zip(table.column("block").to_pylist(), table.column("payload").to_pylist(), strict=True))
        hs, ws, ts, ls, hots, sizes = [], [], [], [], [], []
        for _, payload in rows:
            step, w, t, low, hot = unpack(payload)
            lower = np.zeros(len(w))
            lower[t > 0] = unigram.p(low) if low.dtype.kind == "u" else low
            for to, v in zip((hs, ws, ts, ls, hots), (np.cumsum(step, dtype=np.uint64), w.astype(np.uint64), t.astype(np.int64), lower, hot), strict=True):
                to.append(v)
            sizes.append(len(w))
        h, w, t, low, hot = (np.concatenate(v) for v in (hs, ws, ts, ls, hots))
        del hs, ws, ts, ls, hots
        order = np.lexsort((w, h))
        first = np.concatenate([[True], (np.diff(h[order]) != 0) | (np.diff(w[order]) != 0)])
        starts = np.flatnonzero(first)
        group = np.empty(len(h), np.int64)
        group[order] = np.cumsum(first) - 1
        total, lower = np.add.reduceat(t[order], starts), np.maximum.reduceat(low[order], starts)
        uh, uw = h[order][starts], w[order][starts]
        at = _starts(uh)
        is_hot = np.maximum.reduceat(hot[order][starts], at) > 0
        seen_lower = np.add.reduceat(np.where(total > 0, lower, 0.0), at)
        out, start = [], 0
        for (block, _), size in zip(rows, sizes, strict=True):
            out.append(_message("ask", block, bucket, pack(np.diff(group[start : start + size], prepend=0).astype(np.uint64))))
            start += size
        sums = _sums(total, at)
        out += [_message("hot", 0, bucket, b"", int(uh[at[k]].astype(np.int64)), [*(float(v) for v in sums[k]), float(seen_lower[k])]) for k in np.flatnonzero(is_hot)]
        out.append(_message("count", 0, bucket, pack(np.diff(uh[at], prepend=_U(0)), np.diff(at, append=len(uh)).astype(np.uint64), uw, total.astype(np.uint64), seen_lower)))
        out.append(_message("stat", 0, bucket, b"", sums=_stat(total)))
        return _table(out)

    return sent.groupBy("bucket").applyInArrow(run, MESSAGE)


def _sums(total: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of each history, whose n-grams begin at `at`: the tokens that followed, and the types that did 1 to K times."""
    return np.column_stack([np.add.reduceat(total, at)] + [np.add.reduceat((total == r).astype(np.int64), at) for r in range(1, K + 1)])


def weigh(counts: DataFrame, d: np.ndarray) -> DataFrame:
    """The model's rows, one a bucket: histories with their sizes and backoff weights, n-grams with their discounted counts."""
    hot = counts.where("kind = 'hot'").select("bucket", "history", "sums")
    whole = hot.groupBy("history").agg(*(F.sum(F.col("sums")[j]).alias(f"s{j}") for j in range(K + 2)))
    hot = hot.select(F.col("bucket").alias("of"), F.col("history").alias("whose")).join(whole, F.col("whose") == whole["history"])

    def run(table: pa.Table, hot: pa.Table) -> pa.Table:
        if not len(table):
            return _table([])
        step, length, w, total, seen_lower = unpack(table.column("payload")[0].as_py())
        history, length, total = np.cumsum(step, dtype=np.uint64), length.astype(np.int64), total.astype(np.int64)
        sums, seen_lower = _sums(total, np.cumsum(length) - length), seen_lower.copy()
        if len(hot):  # histories of many buckets
            at = np.searchsorted(history, hot.column("whose").to_numpy().view(np.uint64))
            for j in range(K + 1):
                sums[at, j] = hot.column(f"s{j}").to_numpy()
            seen_lower[at] = hot.column(f"s{K + 1}").to_numpy()
        size, alpha, plain = weights(sums[:, 0], sums[:, 1:], seen_lower, d)
        return _table([_message("model", 0, table.column("bucket")[0].as_py(), pack(step, length.astype(np.uint64), w, discounted(total, np.repeat(plain, length), d), size, alpha))])

    return counts.where("kind = 'count'").groupBy("bucket").cogroup(hot.groupBy("of")).applyInArrow(run, MESSAGE)


def look_up(model: DataFrame, counts: DataFrame, order: int) -> DataFrame:
    """What the model's table says of the n-grams that blocks ask for: messages to the blocks."""

    def run(table: pa.Table, asks: pa.Table) -> pa.Table:
        if not len(table):
            return _table([])
        bucket = table.column("bucket")[0].as_py()
        _, length, _, count, size, alpha = unpack(table.column("payload")[0].as_py())
        history = np.repeat(np.arange(len(length)), length.astype(np.int64))
        out = []
        for block, payload in zip(asks.column("block").to_pylist(), asks.column("payload").to_pylist(), strict=True):
            at = np.cumsum(unpack(payload)[0], dtype=np.int64)
            of = history[at]
            of = of[_starts(of)]
            out.append(_message(f"re{order}", block, bucket, pack(count[at], size[of], alpha[of])))
        return _table(out)

    asks = counts.where("kind = 'ask'").select(F.col("bucket").alias("of"), "block", "payload")
    return model.select("bucket", "payload").groupBy("bucket").cogroup(asks.groupBy("of")).applyInArrow(run, MESSAGE)


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def score_blocks(blocks: DataFrame, answers: DataFrame, unigram: Unigram, buckets: int, often: int) -> DataFrame:
    def run(doc: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(doc):
            return _SCORES.empty_table()
        x = _block_of(doc, answers, unigram, buckets, often)
        starts = np.cumsum(x.n) - x.n
        c = x.count[x.word[x.real]]
        each = {
            "doc_id": pa.array(x.keys, pa.int64()),
            "held_out": pa.array(x.held),
            "n_tokens": pa.array(x.n),
            "n_known": pa.array(np.add.reduceat((c > 0).astype(np.int64), starts)),
            "train_tokens": pa.array(np.full(len(x.n), unigram.n, np.int64)),
            "base_score": pa.array(np.add.reduceat(unigram.base(c), starts)),
            "score": pa.array(np.add.reduceat(np.log10(x.p)[x.entry[x.real]], starts)),
        }
        return pa.table(each, schema=_SCORES)

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, SCORES)


def _word_rows(words: DataFrame, unigram: Unigram) -> DataFrame:
    """Order one of the model: words, their numbers and their probabilities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for bucket, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                names, known, c = unpack(payload)
                out.append(_message("model", 0, bucket, pack(names.tobytes(), known, unigram.p(c))))
            if out:
                yield _batch(out)

    return words.where("kind = 'uni'").select("bucket", "payload").mapInArrow(run, MESSAGE)


@dataclass
class Model:
    """A trained model: a table for each order, one row a bucket, and the counts' levels."""

    tables: dict[int, DataFrame]
    levels: dict[int, Level]
    buckets: int

    def words(self) -> DataFrame:
        """word, number, probability."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for bucket, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    names, known, p = unpack(payload)
                    names = names.tobytes().decode("utf-8", "replace").split("\n") if len(known) else []
                    number = known.astype(np.int64) * buckets + bucket
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(number), pa.array(p)], ["word", "number", "probability"])

        buckets = self.buckets
        return self.tables[1].select("bucket", "payload").mapInArrow(run, "word string, number long, probability double")

    def grams(self, order: int) -> DataFrame:
        """history, next (a word's number), discounted (count), size and alpha of the history."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for payload in batch.column(0).to_pylist():
                    step, length, w, count, size, alpha = unpack(payload)
                    each, seen = length.astype(np.int64), count > 0
                    columns = [np.repeat(np.cumsum(step, dtype=np.uint64), each).view(np.int64), w.astype(np.int64), count, np.repeat(size, each), np.repeat(alpha, each)]
                    yield pa.RecordBatch.from_arrays([pa.array(x[seen]) for x in columns], ["history", "next", "discounted", "size", "alpha"])

        return self.tables[order].select("payload").mapInArrow(run, "history long, next long, discounted double, size double, alpha double")


def train_and_score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_of: int = 7, held_rest: int = 2, tag: str = "", order: int = ORDER) -> tuple[Model, DataFrame]:
    """Learns from the texts whose crc32(id as text) mod held_of is not held_rest; scores all."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    buckets = max(8, math.ceil(storage.text_bytes(rows, "text") / BUCKET_BYTES))

    def of_kind(table: DataFrame, *kinds: str) -> DataFrame:
        return table.where(F.col("kind").isin(*kinds))

    blocks = storage.bucketed(make_blocks(rows, buckets, held_of, held_rest), "katz-blocks", "block", "kind", tag=tag)
    words = storage.written(count_words(of_kind(blocks, "voc"), buckets), "katz-words", "kind", tag=tag)
    level = _levels(words)
    unigram = Unigram(level)
    model = Model({1: storage.written(_word_rows(words, unigram), "katz-model-1", "kind", tag=tag)}, {1: level}, buckets)
    often = max(1000, level.total // (8 * buckets))
    docs, answers = of_kind(blocks, "doc").select("block", "payload"), of_kind(words, "re1")
    for n in range(2, order + 1):
        counts = storage.bucketed(count_grams(send_grams(docs, answers, unigram, buckets, often), unigram), f"katz-counts-{n}", "bucket", "kind", tag=tag)
        model.levels[n] = _levels(counts)
        model.tables[n] = storage.bucketed(weigh(counts, model.levels[n].discounts()), f"katz-model-{n}", "bucket", "kind", tag=tag)
        answers = answers.unionByName(look_up(model.tables[n], counts, n))
    return model, score_blocks(docs, answers, unigram, buckets, often)


def op1_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return train_and_score(spark.read.parquet(f"{sf_dir}/documents.parquet"))[1]
