"""Secret scan: pattern spans, and sliding-window Shannon entropy per character class over candidate strings.

Pattern spans (assign, access, hex) are leftmost and non-overlapping per kind. The entropy kind looks at every maximal
run of key-like characters, or what pattern spans leave of it: parts of at least a window. For each class that the run's characters fall into, a window slides over the
run; the window's symbol counts change by one in and one out, and the sum of c*log2(c) with them, so that each step is
O(1). Windows at or above the class's threshold are joined to spans. The allow-list then suppresses spans that are
known to be harmless as a whole: words without digits, plain numbers, what begins as a placeholder or holds filling, and
versions of UUID shape.

Spans are in code points, end exclusive. Defined results: null text counts as empty (no spans); whole texts are
scanned whatever their length; repeated rows and null ids are kept; an empty table gives an empty result; other
columns are not touched.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "entropy")


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


KEYWORDS = "|".join(_either(w) for w in ("password", "passwd", "secret", "token")) + "|" + _either("api") + "_?" + _either("key")
ASSIGN = re.compile(rf"({KEYWORDS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")

WINDOW = 20
RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{WINDOW},}}")
#: Character classes, the first that holds the whole window counts: pattern of members, least bits a symbol.
CLASSES = (("hex", frozenset("0123456789abcdefABCDEF"), 3.0), ("base64", None, 3.9))
#: Harmless whole spans.
ALLOW = tuple(
    re.compile(p)
    for p in (
        r"[A-Za-z/_+=-]+",  # words and paths: no digit
        r"[0-9+/_=-]+",  # numbers: no letter
        r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",  # UUID
        r"(?i)(example|placeholder|changeme|dummy|sample).*",
        r"(?i).*(x{8}|0{8}|1234567890|abcdefghij).*",  # filling
    )
)

_CLOG = [0.0] + [c * math.log2(c) for c in range(1, WINDOW + 2)]


def high_windows(run: str, window: int = WINDOW) -> list[tuple[int, int]]:
    """Spans of the run that windows of at least their class's entropy cover, joined where they touch."""
    hexes = CLASSES[0][1]
    log_n, counts, total, odd = math.log2(window), {}, 0.0, 0
    spans: list[list[int]] = []
    for k, c in enumerate(run):
        n = counts.get(c, 0)
        total += _CLOG[n + 1] - _CLOG[n]
        counts[c] = n + 1
        odd += c not in hexes
        if k >= window:
            old = run[k - window]
            n = counts[old]
            total += _CLOG[n - 1] - _CLOG[n]
            counts[old] = n - 1
            odd -= old not in hexes
        if k >= window - 1:
            need = CLASSES[1][2] if odd else CLASSES[0][2]
            if log_n - total / window >= need - 1e-9:
                start = k - window + 1
                if spans and start <= spans[-1][1]:
                    spans[-1][1] = k + 1
                else:
                    spans.append([start, k + 1])
    return [(a, b) for a, b in spans]


def allowed(span: str) -> bool:
    return any(p.fullmatch(span) for p in ALLOW)


def scan_text(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end), ascending."""
    if not text:
        return []
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    base, at = sorted(out), 0
    covered: list[list[int]] = []
    for a, _, b in base:
        if covered and a <= covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], b)
        else:
            covered.append([a, b])
    for m in RUN.finditer(text):
        start, end = m.span()
        while at < len(covered) and covered[at][1] <= start:
            at += 1
        k = at
        while start < end:  # the parts of the run between base spans
            a, b = covered[k] if k < len(covered) else (end, end)
            part = text[start : min(a, end)]
            if len(part) >= WINDOW:
                out += [(start + x, 3, start + y) for x, y in high_windows(part) if not allowed(part[x:y])]
            start, k = max(min(a, end), b), k + 1
    return sorted(out)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redact_text(text: str | None) -> str | None:
    """The text with each span, overlapping ones as one, replaced by [SECRET]."""
    spans = scan_text(text)
    if not spans:
        return text
    out, at, end = [], 0, 0
    for a, _, b in spans:
        if a >= end:
            out += [text[end:a], "[SECRET]"]
        end = max(end, b)
        at = end
    return "".join([*out, text[at:]])


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per span: doc_id, kind, start, end, found (the text of the span)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                t = text.as_py()
                for a, k, b in scan_text(t):
                    for to, v in zip(out, (key, KINDS[k], a, b, t[a:b]), strict=True):
                        to.append(v)
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], ["doc_id", "kind", "start", "end", "found"])

    rows = df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return rows.mapInArrow(run, "doc_id long, kind string, start long, end long, found string")


def redact(df: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """df with secrets replaced in text_col, and chars_col recounted where the text changed. All rows stay."""

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(redact_text, na_action="ignore")

    both = df.select(F.struct(*df.columns).alias("row"), clean(F.col(text_col)).alias("text"))  # apart from df's own names
    changed = ~F.col("row")[text_col].eqNullSafe(F.col("text"))

    def column(name: str):
        if name == text_col:
            return F.col("text").alias(name)
        if name == chars_col:
            return F.when(changed, F.length("text")).otherwise(F.col("row")[name]).cast(df.schema[name].dataType).alias(name)
        return F.col("row")[name].alias(name)

    return both.select(*map(column, df.columns))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan_text(t.as_py()) for t in batch.column(1)]
            count = lambda k: pa.array([sum(x[1] == k for x in s) for s in found], pa.int64())  # noqa: B023, E731
            base = [hashlib.sha256(_joined([x for x in s if x[1] < 3]).encode()).hexdigest() for s in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), count(0), count(1), count(2), pa.array(base), pa.array([_joined(s) for s in found]), count(3)],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_entropy"],
            )

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return docs.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_entropy long")
