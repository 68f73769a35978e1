"""Plug points: encoders, evaluators, loaders and hooks, each under a name."""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Any, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Encoder(Protocol):
    """Built once in each task. encode gets what preprocess returned for a batch's inputs, and gives a vector for each."""

    def preprocess(self, inputs: Sequence[Any]) -> Any: ...

    def encode(self, batch: Any) -> np.ndarray: ...

    def describe(self) -> dict[str, Any]: ...


class Registry:
    """Named values; a second value under a name is an error, and so is a name that is not there."""

    def __init__(self, kind: str) -> None:
        self.kind, self.found = kind, {}

    def register(self, name: str) -> Callable[[Any], Any]:
        def put(value: Any) -> Any:
            if name in self.found:
                raise ValueError(f"{self.kind} {name!r} is registered twice")
            self.found[name] = value
            return value

        return put

    def get(self, name: str) -> Any:
        """The value; a name of the form module:name is imported."""
        if name not in self.found and ":" in name:
            module, _, attribute = name.partition(":")
            return getattr(importlib.import_module(module), attribute)
        if name not in self.found:
            raise KeyError(f"unknown {self.kind} {name!r}; known: {sorted(self.found)}")
        return self.found[name]


ENCODERS, EVALUATORS, LOADERS = Registry("encoder"), Registry("evaluator"), Registry("loader")


def export(rows: DataFrame, encoder: str, key: str, column: str, **options: Any) -> DataFrame:
    """key, embedding: the rows' inputs through a registered encoder, or one named module:name, in Arrow batches. A null input has
    a null vector; vectors that are not finite are an error."""
    make = ENCODERS.get(encoder)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make(**options)
        for f in frames:
            known = f[column].notna().to_numpy()
            vectors: list[Any] = [None] * len(f)
            if known.any():
                out = np.asarray(model.encode(model.preprocess(f[column][known].tolist())), float)
                if len(out) != known.sum() or not np.isfinite(out).all():
                    raise ValueError(f"encoder {encoder!r} gave {len(out)} vectors for {known.sum()} inputs, or some that are not finite")
                for at, v in zip(np.flatnonzero(known), out, strict=True):
                    vectors[at] = v.tolist()
            yield pd.DataFrame({key: f[key], "embedding": vectors})

    schema = f"{rows.select(key).schema[0].simpleString().replace(':', ' ')}, embedding array<double>"
    return rows.select(key, column).mapInPandas(run, schema)


@ENCODERS.register("signs")
class Signs:
    """One where an input's component is above zero, else zero."""

    def preprocess(self, inputs: Sequence[Any]) -> np.ndarray:
        return np.stack([np.asarray(x, float) for x in inputs])

    def encode(self, batch: np.ndarray) -> np.ndarray:
        return (batch > 0).astype(float)

    def describe(self) -> dict[str, Any]:
        return {"name": "signs"}


class Evaluator:
    """Gathers tables, then evaluates them all at once: nothing is computed before evaluate. A subclass gives result."""

    def __init__(self) -> None:
        self.reset()

    def reset(self) -> None:
        self.rows: DataFrame | None = None

    def process(self, rows: DataFrame) -> None:
        self.rows = rows if self.rows is None else self.rows.unionByName(rows)

    def evaluate(self) -> DataFrame:
        if self.rows is None:
            raise ValueError("nothing was processed")
        return self.result(self.rows)

    def result(self, rows: DataFrame) -> DataFrame:
        raise TypeError("a subclass gives result")


def evaluate_all(named: Mapping[str, DataFrame]) -> DataFrame:
    """evaluator, metric, value: one-row results of several evaluators as one table."""
    out = None
    for name, df in named.items():
        each = F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(f"`{c}`").cast("double").alias("value")) for c in df.columns))).alias("e")
        part = df.select(F.lit(name).alias("evaluator"), each).select("evaluator", "e.metric", "e.value")
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no evaluator was named")
    return out


def load(spark: SparkSession, name: str, **options: Any) -> DataFrame:
    """The items of a registered loader."""
    return LOADERS.get(name)(spark, **options)


class Hooks:
    """What a run calls around itself and around each of its steps; all do nothing unless overridden."""

    def before_run(self) -> None:
        """Before the first step."""

    def before_step(self, step: int, name: str) -> None:
        """Before each step."""

    def after_step(self, step: int, name: str, result: Any) -> None:
        """After each step, with what it returned."""

    def after_run(self) -> None:
        """After the last step, also where a step failed."""


class Every(Hooks):
    """Calls a function after every n-th step, and after the last."""

    def __init__(self, n: int, call: Callable[[int, Any], None]) -> None:
        self.n, self.call, self.last = n, call, None

    def after_step(self, step: int, name: str, result: Any) -> None:
        self.last = None
        if (step + 1) % self.n == 0:
            self.call(step, result)
        else:
            self.last = (step, result)

    def after_run(self) -> None:
        if self.last is not None:
            self.call(*self.last)


def run_steps(steps: Sequence[tuple[str, Callable[[], Any]]], hooks: Sequence[Hooks] = ()) -> dict[str, Any]:
    """The steps' results by name, in order, with hooks around them."""
    out = {}
    for h in hooks:
        h.before_run()
    try:
        for k, (name, step) in enumerate(steps):
            for h in hooks:
                h.before_step(k, name)
            out[name] = step()
            for h in hooks:
                h.after_step(k, name, out[name])
    finally:
        for h in hooks:
            h.after_run()
    return out
