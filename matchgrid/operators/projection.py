"""Pair verification by folds after a principal-component projection that is learned on the other folds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    if column.null_count or len(set(lengths.tolist())) > 1 or column.flatten().null_count:
        raise ValueError("vectors must not be null, hold nulls or differ in length")
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(len(column), -1)


def fold_moments(pairs: DataFrame) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """Of each fold the number of its vectors (both of a pair), their sum and their sum of outer products.

    Tasks add up their own rows, and sums of tasks are added up in two steps. What the driver gets is a matrix of the
    vectors' length for each fold, whatever the number of pairs.
    """

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            fold = batch.column(0).to_numpy()
            x = np.stack([_matrix(batch.column(1)), _matrix(batch.column(2))]) if len(fold) else None
            for f in np.unique(fold):
                v = x[:, fold == f].reshape(-1, x.shape[2])
                old = found.get(int(f), [0, 0.0, 0.0])
                found[int(f)] = [old[0] + len(v), old[1] + v.sum(axis=0), old[2] + v.T @ v]
        yield _packed(found)

    def _packed(found: dict[int, list]) -> pa.RecordBatch:
        rows = [(f, n, s.tolist(), g.reshape(-1).tolist()) for f, (n, s, g) in found.items()]
        fields = [pa.field("fold", pa.int64()), pa.field("n", pa.int64()), pa.field("s", pa.list_(pa.float64())), pa.field("g", pa.list_(pa.float64()))]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(fields)], schema=pa.schema(fields))

    schema = "fold long, n long, s array<double>, g array<double>"

    def add(table: pa.Table) -> pa.Table:
        s, g = _matrix(table.column("s")), _matrix(table.column("g"))
        f = table.column("fold")[0].as_py()
        return pa.Table.from_batches([_packed({f: [sum(table.column("n").to_pylist()), s.sum(axis=0), g.sum(axis=0)]})])

    tasks = pairs.select("fold", "a", "b").mapInArrow(one, schema).withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(64)))
    few = tasks.groupBy("fold", "_part").applyInArrow(add, schema).groupBy("fold").applyInArrow(add, schema)
    return {r.fold: (r.n, np.array(r.s), np.array(r.g).reshape(len(r.s), -1)) for r in few.collect()}


def projections(moments: dict[int, tuple[int, np.ndarray, np.ndarray]], components: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each fold the mean and the first components of the other folds' vectors."""
    out = {}
    for f in moments:
        n, s, g = (sum(m[k] for h, m in moments.items() if h != f) for k in range(3))
        if np.ndim(s) == 0 or n < 2:
            raise ValueError("a projection needs at least two folds")
        mean = s / n
        values, vectors = np.linalg.eigh(g / n - np.outer(mean, mean))
        if components > len(values):
            raise ValueError(f"{components} components of vectors of length {len(values)}")
        out[f] = mean, vectors[:, np.argsort(-values, kind="stable")[:components]]
    return out


def fold_verification_projected(pairs: DataFrame, components: int, steps: int = 400, width: float = 0.01) -> DataFrame:
    """pairs: fold, same, a, b (vectors of one length). For each fold: the first threshold with the best accuracy on the others,
    and its accuracy, TPR and FPR on the fold, of squared distances between unit vectors after the fold's own projection, which
    is learned on the others. Same means a distance below the threshold, strictly.

    Tasks count pairs by (projection, fold, step, same): no row for a pair leaves them. Null folds are an error of the vectors'
    kind; an empty table gives an empty result.
    """
    learned = projections(fold_moments(pairs), components) if pairs.head(1) else {}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, int] = {}
        for batch in batches:
            fold, same = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            a, b = _matrix(batch.column(2)), _matrix(batch.column(3))
            for f, (mean, w) in learned.items():
                p, q = (a - mean) @ w, (b - mean) @ w
                p, q = (x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-300) for x in (p, q))
                dist = ((p - q) ** 2).sum(axis=1)
                k = np.minimum(np.searchsorted(np.arange(steps) * width, dist, side="right"), steps)
                keys, n = np.unique(np.stack([fold, k, same]), axis=1, return_counts=True)
                for (h, j, s), m in zip(keys.T.tolist(), n.tolist(), strict=True):
                    found[f, h, j, s] = found.get((f, h, j, s), 0) + m
        rows = list(found.items())
        yield pa.RecordBatch.from_arrays([pa.array([r[0][c] for r in rows], pa.int64()) for c in range(4)] + [pa.array([r[1] for r in rows], pa.int64())], ["model", "fold", "k", "same", "n"])

    schema = "model long, fold long, k long, same long, n long"
    h = pairs.select("fold", "same", "a", "b").mapInArrow(count, schema).groupBy("model", "k", (F.col("fold") == F.col("model")).alias("own"))
    by = h.agg(F.sum(F.when(F.col("same") == 1, F.col("n")).otherwise(0)).alias("s"), F.sum(F.when(F.col("same") == 0, F.col("n")).otherwise(0)).alias("d"))
    wide = by.groupBy("model", "k").agg(*(F.sum(F.when(F.col("own") == o, F.col(c)).otherwise(0)).alias(f"{c}{int(o)}") for o in (True, False) for c in ("s", "d")))
    total = wide.groupBy("model").agg(*(F.sum(c).alias(f"all_{c}") for c in ("s1", "d1", "s0", "d0")))
    grid = total.crossJoin(F.broadcast(pairs.sparkSession.range(steps).withColumnRenamed("id", "k"))).join(wide, ["model", "k"], "left").fillna(0, ["s1", "d1", "s0", "d0"])
    w = Window.partitionBy("model").orderBy("k")
    cum = grid.withColumns({f"c_{c}": F.sum(c).over(w) for c in ("s1", "d1", "s0", "d0")})
    right = lambda o: F.col(f"c_s{o}") + F.col(f"all_d{o}") - F.col(f"c_d{o}")
    ranked = cum.withColumn("r", F.row_number().over(Window.partitionBy("model").orderBy(F.desc(right(0)), "k"))).where("r = 1")
    share = lambda x, y: F.when(y > 0, x / y)
    return ranked.select(
        F.col("model").alias("fold"), (F.col("k") * F.lit(width)).alias("threshold"), share(right(1), F.col("all_s1") + F.col("all_d1")).alias("acc"),
        share(F.col("c_s1"), F.col("all_s1")).alias("tpr"), share(F.col("c_d1"), F.col("all_d1")).alias("fpr"),
    )
