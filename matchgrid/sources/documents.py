"""Bounded result tables as Markdown: tables, and a report of several with a line on each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def _cell(v) -> str:
    if v is None or v != v:
        return "–"
    if isinstance(v, bool):
        return "yes" if v else "no"
    return f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")


def markdown(df: DataFrame, *order: str, percent: Sequence[str] = (), most: int = 10_000) -> str:
    """A result table in Markdown, in the given order; of more rows than `most` is an error, not a shorter table. Columns in
    percent are shares. Unknown values are a dash."""
    rows = (df.orderBy(*order) if order else df).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: not a result table")
    cell = lambda c, v: f"{v * 100:.2f} %" if c in percent and v is not None and v == v else _cell(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(cell(c, r[c]) for c in df.columns) + " |" for r in rows)]) + "\n"


def report(title: str, sections: Sequence[tuple[str, str, str]]) -> str:
    """sections: heading, a line of text or none, a table in Markdown."""
    parts = [f"# {title}\n"]
    for heading, text, table in sections:
        parts.append(f"## {heading}\n\n" + (f"{text}\n\n" if text else "") + table)
    return "\n".join(parts)


def metric_lines(latest: DataFrame, iteration: int, total: int | None = None) -> str:
    """One line for a console from the last values of each metric (name, value)."""
    of = f"/{total}" if total is not None else ""
    return f"iter {iteration}{of}  " + "  ".join(f"{r['name']}: {_cell(r.value)}" for r in latest.select("name", "value").orderBy("name").collect())
