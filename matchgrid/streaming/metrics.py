"""Metric events (name, iteration, value): buffers, smoothing, running bests and rate limits, batch and streaming.

Batch forms are windows by name. Streaming forms keep one bounded state a name; the same events in the same order give
the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CAPACITY = 1_000_000


def _last(window: int):
    return Window.partitionBy("name").orderBy("iteration").rowsBetween(-(window - 1), 0)


def history(events: DataFrame, window: int) -> DataFrame:
    """Median and mean of the last `window` values, and the mean of all values so far, at each event. Means are of
    values in whole millionths."""
    m = F.round(F.col("value") * 1_000_000).cast("long")
    all_ = Window.partitionBy("name").orderBy("iteration").rowsBetween(Window.unboundedPreceding, 0)
    w = _last(window)
    return events.select(
        "name",
        "iteration",
        "value",
        (F.sum(m).over(w) / F.count("*").over(w) / 1e6).alias("avg"),
        (F.sum(m).over(all_) / F.count("*").over(all_) / 1e6).alias("global_avg"),
        F.collect_list("value").over(w).alias("_values"),
    ).select("name", "iteration", "value", _middle(F.array_sort("_values")).alias("median"), "avg", "global_avg")


def _middle(v):
    n = F.size(v)
    lower, upper = F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int")
    return (F.get(v, lower) + F.get(v, upper)) / 2


def latest(events: DataFrame) -> DataFrame:
    """The last value of each name."""
    return events.groupBy("name").agg(F.max("iteration").alias("iteration"), F.max_by("value", "iteration").alias("value"))


def conflicting_hints(events: DataFrame) -> DataFrame:
    """Names that were written with different smoothing hints."""
    return events.groupBy("name").agg(F.countDistinct("hint").alias("hints")).where("hints > 1")


def scoped(events: DataFrame, scope: str) -> DataFrame:
    return events.withColumn("name", F.concat(F.lit(scope.rstrip("/") + "/"), F.col("name")))


def histogram(events: DataFrame, bins: int) -> DataFrame:
    """name, bin, n over equal bins between each name's least and greatest value, the last closed."""
    r = events.groupBy("name").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(bins - 1), F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins))).otherwise(0)
    return events.join(r, "name").groupBy("name", at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def histogram_sums(events: DataFrame, bins: int) -> DataFrame:
    """As histogram, with the sum and the sum of squares of each bin's values, in whole millionths."""
    r = events.groupBy("name").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(bins - 1), F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins))).otherwise(0)
    m = F.round(F.col("value") * 1_000_000).cast("decimal(19,0)")
    by = events.join(r, "name").groupBy("name", at.cast("int").alias("bin")).agg(F.count("*").alias("n"), F.sum(m).alias("s"), F.sum(m * m).alias("q"))
    return by.select("name", "bin", "n", (F.col("s").cast("double") / 1e6).alias("sum"), (F.col("q").cast("double") / 1e12).alias("sum_squares"))


def eta(events: DataFrame, total: DataFrame, last: int) -> DataFrame:
    """name, iteration, eta: the median of the last durations times the iterations that are left. total: one row."""
    w = Window.partitionBy("name").orderBy("iteration").rowsBetween(1 - last, 0)
    return events.crossJoin(F.broadcast(total)).select("name", "iteration", "value", "total", F.collect_list("value").over(w).alias("_values")).select("name", "iteration", (_middle(F.array_sort("_values")) * (F.col("total") - F.col("iteration") - 1)).alias("eta"))


def running_best(events: DataFrame, start: float = -1.0) -> DataFrame:
    """Events whose value is above all values before them, and above start."""
    before = Window.partitionBy("name").orderBy("iteration").rowsBetween(Window.unboundedPreceding, -1)
    best = F.greatest(F.coalesce(F.max("value").over(before), F.lit(start)), F.lit(start))
    return events.withColumn("best", best).where(F.col("value") > F.col("best")).drop("best")


def first_n(events: DataFrame, key: str, n: int) -> DataFrame:
    """The first n events of each key."""
    return events.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("iteration"))).where(F.col("_r") <= n).drop("_r")


def every_n(events: DataFrame, key: str, n: int) -> DataFrame:
    """The first and then every n-th event of each key."""
    return events.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("iteration"))).where(F.pmod(F.col("_r") - 1, F.lit(n)) == 0).drop("_r")


def throughput(events: DataFrame, warm_up: int) -> DataFrame:
    """Mean value of each name after its first warm_up events, in whole millionths."""
    w = Window.partitionBy("name").orderBy("iteration")
    rest = events.withColumn("_r", F.row_number().over(w)).where(F.col("_r") > warm_up)
    return rest.groupBy("name").agg((F.sum(F.round(F.col("value") * 1_000_000).cast("long")) / F.count("*") / 1e6).alias("avg"), F.count("*").alias("n"))


def last_k(events: DataFrame, key: str, k: int) -> DataFrame:
    """What a circular queue of k places holds of each key after all events."""
    return events.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("iteration")))).where(F.col("_r") <= k).drop("_r")


def sessions(events: DataFrame, key: str, gap: str) -> DataFrame:
    """Start, end and size of runs of events without a longer gap. Works on streams that carry a watermark on ts."""
    return events.groupBy(key, F.session_window("ts", gap)).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


HISTORY = "name string, iteration long, value double, median double, avg double, global_avg double"
HISTORY_STATE = "values array<double>, total double, count long"


def history_stream(events: DataFrame, window: int) -> DataFrame:
    """history() on a stream: one row per event, state of `window` values and two sums for each name."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        values, total, count = ([], 0.0, 0) if not state.exists else (list(state.get[0]), state.get[1], state.get[2])
        rows = pd.concat(list(batches)).sort_values("iteration", kind="stable")
        out = []
        for iteration, value in zip(rows["iteration"], rows["value"]):
            values = [*values, value][-window:]
            total, count = total + round(value * 1_000_000), count + 1
            inner = sorted(values)
            median = (inner[(len(inner) - 1) // 2] + inner[len(inner) // 2]) / 2
            out.append((key[0], iteration, value, median, sum(round(v * 1_000_000) for v in values) / len(values) / 1e6, total / count / 1e6))
        state.update((values, total, count))
        yield pd.DataFrame(out, columns=["name", "iteration", "value", "median", "avg", "global_avg"])

    return events.groupBy("name").applyInPandasWithState(update, HISTORY, HISTORY_STATE, "append", "NoTimeout")


def throttle_stream(events: DataFrame, seconds: float) -> DataFrame:
    """At most one event of each name in `seconds`, from the first on."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else float("-inf")
        out = []
        for iteration, at in pd.concat(list(batches)).sort_values("iteration", kind="stable")[["iteration", "seconds"]].itertuples(index=False):
            if at - last >= seconds:
                out.append((key[0], iteration, at))
                last = at
        state.update((last,))
        yield pd.DataFrame(out, columns=["name", "iteration", "seconds"])

    return events.groupBy("name").applyInPandasWithState(update, "name string, iteration long, seconds double", "last double", "append", "NoTimeout")


def append_newer(events: DataFrame, path: str) -> DataFrame:
    """Append events whose iteration is later than what the JSON-lines sink at path already holds; returns them."""
    spark = events.sparkSession
    try:
        done = spark.read.schema("name string, iteration long, value double").json(path).agg(F.max("iteration")).first()[0]
    except Exception as e:  # the sink does not exist yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        done = None
    fresh = events if done is None else events.where(F.col("iteration") > done)
    fresh.select("name", "iteration", "value").write.mode("append").json(path)
    return fresh
