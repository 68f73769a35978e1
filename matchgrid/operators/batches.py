"""Batches, channels, probes and orders: what feeds an encoder, and what comes back from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchgrid.functions.shared import kept
from matchgrid.operators.evaluators import SCALE, whole
from matchgrid.operators.sampling import draw


def collated(rows: DataFrame, position: str, size: int, *columns: str) -> DataFrame:
    """batch, n and each column as an array in the order of positions; the last batch may be short."""
    one = F.struct(position, *columns)
    each = rows.groupBy(F.floor(F.col(position) / size).alias("batch")).agg(F.array_sort(F.collect_list(one)).alias("_rows"))  # size rows
    return each.select("batch", F.size("_rows").cast("long").alias("n"), *(F.col("_rows").getField(c).alias(c) for c in columns))


def channel_statistics(rows: DataFrame, batch: str, vector: str) -> DataFrame:
    """channel, mean, var: means and unbiased variances of each channel in each batch, averaged over batches. Components count in
    whole millionths, so that results do not depend on the order of tasks. Batches of one row have no variance and do not count;
    null vectors and components are left out."""
    x = rows.select(F.col(batch).alias("b"), F.posexplode(vector).alias("channel", "x")).withColumn("m", F.round(F.col("x").cast("double") * 1_000_000).cast("long")).where("m is not null")
    by = x.groupBy("b", "channel").agg(F.count("*").alias("n"), F.sum("m").alias("s"), F.sum(F.col("m").cast("decimal(19,0)") * F.col("m").cast("decimal(19,0)")).alias("q")).where("n > 1")
    n, s = F.col("n").cast("double"), F.col("s").cast("double")
    by = by.select("channel", (s / n / 1e6).alias("mean"), ((F.col("q").cast("double") - s * s / n) / (n - 1) / 1e12).alias("var"))
    average = lambda c: (F.sum(whole(F.col(c))).cast("double") / F.count("*") / float(SCALE)).alias(c)
    return by.groupBy("channel").agg(average("mean"), average("var"))


def pair_probe(rows: DataFrame, n: int, unit: str, track: str, key: str, seed: int = 0) -> DataFrame:
    """unit, x, y, z: of each unit two drawn tracks with at least two rows; x and y are drawn from the one, z from the other. The
    first n units that have two such tracks count. A track's rows are never collected."""
    sizes = rows.groupBy(unit, track).agg(F.count("*").alias("_n")).where("_n > 1")
    w = Window.partitionBy(unit).orderBy(draw(seed, unit, track), track)
    two = sizes.withColumn("_k", F.row_number().over(w)).where("_k <= 2").select(unit, track, "_k")
    r = Window.partitionBy(unit, track).orderBy(draw(seed + 1, key), key)
    picked = rows.join(two, [unit, track]).withColumn("_r", F.row_number().over(r)).where("_r <= 2")
    one = lambda k, place: F.max(F.when((F.col("_k") == k) & (F.col("_r") == place), F.col(key)))
    found = picked.groupBy(unit).agg(one(1, 1).alias("x"), one(1, 2).alias("y"), one(2, 1).alias("z")).where("z is not null")
    return found.orderBy(unit).limit(n)


def released(results: DataFrame, sequence: str, arrived: str) -> DataFrame:
    """Adds released: when a result leaves a buffer that gives results out in sequence, which is when the last of those before it
    and itself has arrived. Ranges of the sequence are looked at side by side, then shifted by the ranges before them."""
    rows = kept(results.repartitionByRange(F.col(sequence)).withColumn("_part", F.spark_partition_id()), "released")
    parts = rows.groupBy("_part").agg(F.max(arrived).alias("_top"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    starts = parts.select("_part", F.max("_top").over(before).alias("_before"))
    w = Window.partitionBy("_part").orderBy(sequence).rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(starts, "_part").withColumn("released", F.greatest("_before", F.max(arrived).over(w))).drop("_part", "_before")


def padded_size(pad: Column, size: Column) -> Column:
    """What is left of a side without its padding; null where the padding is negative or leaves less than two."""
    left = size - 2 * pad
    return F.when((pad >= 0) & (left >= 2), left)


def dense(cells: DataFrame, by: list[str], cell: str, n: int, *values: str) -> DataFrame:
    """Every group with all n cells, those without rows as zeros."""
    grid = cells.select(*by).distinct().crossJoin(F.broadcast(cells.sparkSession.range(n).withColumnRenamed("id", cell)))
    return grid.join(cells.select(*by, cell, *values), [*by, cell], "left").fillna(0, list(values))
