"""Connected components of an edge list, by alternating small and large stars, entirely distributed.

Each round first replaces the edges of every partition by a spanning forest, then lets each node hook its neighbours
to the least one it knows. The number of rounds is logarithmic in the components' diameters; a round's edges are at
most those of the round before. Lineage is cut after each round by a table in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchgrid.llm import storage


def forest(edges: dict[int, int], a: int, b: int) -> None:
    """Union of a's and b's trees in a parent table; the least node is the root."""
    while (p := edges.get(a, a)) != a:
        edges[a] = edges.get(p, p)
        a = p
    while (p := edges.get(b, b)) != b:
        edges[b] = edges.get(p, p)
        b = p
    if a != b:
        edges[max(a, b)] = min(a, b)


def roots(edges: dict[int, int]) -> Iterator[tuple[int, int]]:
    for a in edges:
        r = a
        while (p := edges.get(r, r)) != r:
            r = p
        yield a, r


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    edges: dict[int, int] = {}
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest(edges, a, b)
    found = list(roots(edges))
    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["y", "x"])


def _settled(stars: DataFrame) -> bool:
    """Whether every node hangs on one node only, and none on a node that hangs itself."""
    twice = stars.groupBy("y").agg(F.count("*").alias("n")).where("n > 1")
    return twice.isEmpty() and stars.join(stars.select(F.col("y").alias("x")).distinct(), "x", "left_semi").isEmpty()


def components(edges: DataFrame, tag: str = "") -> DataFrame:
    """edges: a, b (long). Returns y, x: each node that is not its component's least, and that least node."""
    edges = edges.select(F.greatest("a", "b").alias("y"), F.least("a", "b").alias("x")).where("y <> x").mapInArrow(_local, "y long, x long").distinct()
    stars = storage.written(edges, "edges", tag=tag)
    while not _settled(stars):
        least = stars.groupBy("y").agg(F.min("x").alias("m"))
        small = stars.join(least, "y").select(F.explode(F.array(F.struct("y", "m"), F.struct(F.col("x").alias("y"), "m"))).alias("e"))
        small = small.select("e.y", F.col("e.m").alias("x")).where("y <> x").distinct()
        both = small.select(F.col("y").alias("u"), F.col("x").alias("v")).unionByName(small.select(F.col("x").alias("u"), F.col("y").alias("v")))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("y"), F.col("m").alias("x")).distinct()
        stars = storage.written(large.mapInArrow(_local, "y long, x long").distinct(), "edges", tag=tag)
    return stars
