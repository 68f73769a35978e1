"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text, normalised by length, with exceptions.

Folding is per character: letters in lower case, homoglyphs (Cyrillic, Greek, full-width, accented look-alikes of the
lexicon's alphabet are left alone unless they are confusable) to their Latin letter, digits and signs that stand for
letters to those letters, everything else that is no letter to a space. Signs at a word's end are punctuation. Lexicon
entries start at a word's start; those of fewer than SHORTEST letters are whole words, others may be stems. A phrase on
the exception list cancels the hits inside it.

The lexicon, its weights (smoothed log-odds of documents), the exceptions and the two coefficients that turn the
length-normalised sum into a probability are learned from labelled documents. The fit uses at most SAMPLE of them,
those with the smallest hash of doc_id; a label without a document, and a null label, is not used, and of documents that
share an id the least text is. An entry needs SHARE of the toxic ones, so the lexicon is bounded by the length of their texts.

Defined results: null text counts as empty; empty texts have a score, that of a text without hits; repeated rows are
scored each; a row with a null doc_id is held out; with no labelled row, or only one label, the lexicon is empty and the score is the smoothed share of
label 1; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import bisect
import itertools
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most labelled documents that the fit reads.
SAMPLE = 20_000
#: Least length of a stem, longest stem, least share of toxic documents and least log-odds of an entry.
SHORTEST, LONGEST_STEM, SHARE, ODDS = 4, 8, 0.01, 3.0

#: Characters that look like Latin letters, and digits and signs used for letters.
HOMOGLYPHS = dict(zip("авеԁкмнорсѕтухіјɡԛԝьαβγδεικνορτυχω", "abedkmhopcstyxijgqwbabydeikvoptuxw", strict=True))
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i"}


class _Folding(dict):
    """A table for str.translate that decides characters as they come."""

    def __missing__(self, code: int) -> int:
        c = chr(code)
        low = c.lower()
        if len(low) != 1:
            low = low[0]
        if 0xFF01 <= ord(low) <= 0xFF5E:  # full-width forms
            low = chr(ord(low) - 0xFEE0).lower()
        low = HOMOGLYPHS.get(low, low)
        low = SUBSTITUTES.get(low, low)
        self[code] = out = ord(low) if low.isalpha() else 32
        return out


_FOLDING = _Folding()
#: Signs that end a word are punctuation rather than letters.
_ENDS = re.compile(r"[!$|@]+(?![\w!$|@])")


def fold(text: str | None) -> str:
    return f" {_ENDS.sub(' ', text or '').translate(_FOLDING)} "


def words_of(text: str | None) -> list[str]:
    return fold(text).split()


def stems(word: str) -> Iterator[str]:
    """Entries that the word may come under: itself, marked as whole if it is short, and its beginnings."""
    yield word if len(word) >= SHORTEST else word + " "
    yield from (word[:n] for n in range(SHORTEST, min(LONGEST_STEM, len(word) - 1) + 1))


@dataclass
class Model:
    """Entries with weights, exception phrases, and score = 1 / (1 + exp(-(bias + slope * x)))."""

    entries: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    bias: float = 0.0
    slope: float = 0.0

    def matcher(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for entry, weight in self.entries.items():
            a.add_word(" " + entry, (len(entry), weight))
        for phrase in self.exceptions:
            a.add_word(f" {phrase} ", (len(phrase) + 1, None))
        a.make_automaton()
        return a

    def feature(self, automaton, text: str | None) -> float:
        """Sum of the weights of hits, of which each word's longest counts, over a root of the length, on a log scale."""
        folded = fold(text)
        hits: dict[int, tuple[int, float]] = {}
        cleared: list[tuple[int, int]] = []
        if len(automaton):
            for end, (n, weight) in automaton.iter(folded):
                start = end - n
                if weight is None:
                    cleared.append((start, end))
                elif hits.get(start, (0, 0.0))[0] < n:
                    hits[start] = n, weight
        if cleared:  # in the order of their ends
            ends = [b for _, b in cleared]
            least = list(itertools.accumulate((a for a, _ in reversed(cleared)), min))[::-1]  # the first start from here on
            hits = {s: x for s, x in hits.items() if (k := bisect.bisect_right(ends, s)) == len(ends) or least[k] > s}
        total = sum(w for _, w in hits.values())
        return math.log1p(max(total, 0.0)) - 0.25 * math.log1p(folded.count(" ")) if total > 0 else NO_HIT

    def score(self, x: float) -> float:
        return 1.0 / (1.0 + math.exp(-min(50.0, max(-50.0, self.bias + self.slope * x))))


#: The feature of a text without hits: below any text with one.
NO_HIT = -4.0


def in_training(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 != 0, F.lit(False))


def learn(documents: DataFrame, labels: DataFrame, train: Column | None = None) -> Model:
    """documents: doc_id, text. labels: doc_id, toxic. train: a condition on labels, default the rows of the contract."""
    train = in_training(F.col("doc_id")) if train is None else train
    usable = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int").alias("_toxic")).where(train & F.col("_toxic").isNotNull() & F.col("doc_id").isNotNull())
    sample = usable.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "_toxic").limit(SAMPLE)
    texts = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(sample), "doc_id")
    texts = texts.groupBy("doc_id", "_toxic").agg(F.min("text").alias("text"))  # SAMPLE rows at most
    n = {r._toxic: r.n for r in texts.groupBy("_toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        p = (n1 + 0.5) / (n1 + n0 + 1)
        return Model(bias=math.log(p / (1 - p)))

    def count_stems(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[tuple[str, int]] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                ws, first = words_of(text), {}
                for k, w in enumerate(ws):
                    if len(w) > 1 and w not in first:
                        first[w] = zlib.crc32(" ".join(ws[max(0, k - 1) : k] + ws[k + 1 : k + 2]).encode())
                found.update({s: c for w, c in reversed(first.items()) for s in stems(w)}.items())
                if len(found) > 500_000:
                    yield _columns(stem=(pa.string(), [s for s, _ in found]), context=(pa.int64(), [c for _, c in found]), n=(pa.int64(), list(found.values())))
                    found.clear()
        yield _columns(stem=(pa.string(), [s for s, _ in found]), context=(pa.int64(), [c for _, c in found]), n=(pa.int64(), list(found.values())))

    # A word that copies of one passage repeat has few contexts; a word that marks toxic texts has many.
    least = max(6, math.ceil(SHARE * n1))
    toxic = texts.where("_toxic = 1").select("text").mapInArrow(count_stems, "stem string, context long, n long")
    toxic = toxic.groupBy("stem", "context").agg(F.sum("n").alias("n")).groupBy("stem").agg(F.sum("n").alias("n"), F.count("*").alias("contexts"))
    positive = {r.stem: r.n for r in toxic.where(F.col("contexts") >= least).select("stem", "n").collect()}  # bounded by SAMPLE and SHARE

    def count_known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found.update({s for w in set(words_of(text)) if len(w) > 1 for s in stems(w) if s in positive})
        yield _columns(stem=(pa.string(), list(found)), n=(pa.int64(), list(found.values())))

    clean = texts.where("_toxic = 0").select("text").mapInArrow(count_known, "stem string, n long").groupBy("stem").agg(F.sum("n").alias("n"))
    negative = {r.stem: r.n for r in clean.collect()}  # as many rows as candidates at most
    odds = {s: math.log((a + 0.5) / (n1 + 1)) - math.log((negative.get(s, 0) + 0.5) / (n0 + 1)) for s, a in positive.items()}
    entries: dict[str, float] = {}
    for s in sorted(odds, key=lambda s: (len(s), s)):  # a longer entry only where it says more than the stem it starts with
        known = max((entries[s[:k]] for k in range(SHORTEST, len(s)) if s[:k] in entries), default=-math.inf)
        if odds[s] >= ODDS and odds[s] > known + 0.5:
            entries[s] = odds[s]
    model = Model(entries)

    def count_phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[tuple[str, int]] = Counter()
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ws = words_of(text)
                at = [k for k, w in enumerate(ws) if any(s in entries for s in stems(w))]
                near = {" ".join(ws[a : a + 2]) for k in at for a in (k - 1, k) if a >= 0 and a + 2 <= len(ws)}
                found.update((p, int(label)) for p in near)
        yield _columns(phrase=(pa.string(), [p for p, _ in found]), toxic=(pa.int64(), [t for _, t in found]), n=(pa.int64(), list(found.values())))

    phrases = texts.select("text", "_toxic").mapInArrow(count_phrases, "phrase string, toxic long, n long").groupBy("phrase")
    phrases = phrases.agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("b"))
    harmless = phrases.where((F.col("b") >= 3) & ((F.col("a") + 0.5) / (n1 + 1) < 0.25 * (F.col("b") + 0.5) / (n0 + 1)))
    model.exceptions = tuple(sorted(r.phrase for r in harmless.collect()))  # each holds an entry of the bounded lexicon

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = model.matcher()
        for batch in batches:
            yield _columns(x=(pa.float64(), [model.feature(a, t) for t in batch.column(0).to_pylist()]), y=(pa.int64(), batch.column(1).to_pylist()))

    xy = texts.select("text", "_toxic").mapInArrow(features, "x double, y long").toPandas()  # SAMPLE rows at most
    model.bias, model.slope = _logistic(xy["x"].to_numpy(float), xy["y"].to_numpy(float))
    return model


def _columns(**columns: tuple[pa.DataType, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for t, v in columns.values()], list(columns))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Bias and slope of a logistic fit by Newton steps, with a small ridge."""
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    a, w = np.column_stack([np.ones_like(x), x]), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -50, 50)))
        g = a.T @ (p - y) + ridge * w
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(2)
        step = np.linalg.solve(h, g)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def score_of(model: Model, text: Column) -> Column:
    """The score of a whole text."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        a = model.matcher()
        for texts in batches:
            yield pd.Series([model.score(model.feature(a, t if isinstance(t, str) else "")) for t in texts], dtype=float)

    return score(text.cast("string"))


def scores(df: DataFrame, model: Model, text_col: str = "text", to: str = "score") -> DataFrame:
    """df with the score of each row's whole text, which takes the place of a column of the name `to`."""
    return df.withColumn(to, score_of(model, F.col(text_col)))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = scores(docs, model)
    return out.select("doc_id", (~in_training(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
