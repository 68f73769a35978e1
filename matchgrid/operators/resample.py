"""Bootstrap over units, with multiplicities as a table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fewer units than this give no interval.
MIN_UNITS = 5


def multinomial(spark: SparkSession, units: list[int], resamples: int, seed: int) -> DataFrame:
    """b, unit, n: draws of as many units as there are, with replacement, of a seeded generator."""
    v = len(units)
    counts = np.random.default_rng(seed).multinomial(v, np.full(v, 1.0 / v), size=resamples)
    return spark.createDataFrame([(b, u, int(counts[b, k])) for b in range(resamples) for k, u in enumerate(units) if counts[b, k]], "b long, unit long, n long")


def hashed(units: DataFrame, resamples: int, seed: int = 0) -> DataFrame:
    """The same from a hash: draw j of resample b takes the unit at position hash(b, j) modulo the number of units. Without
    units there are no draws."""
    from pyspark.sql import Window

    units = units.select("unit").distinct()
    v = units.count()
    if not v:
        return units.sparkSession.createDataFrame([], "b long, unit long, n long")
    at = units.withColumn("at", (F.row_number().over(Window.orderBy("unit")) - 1).cast("long"))
    draws = units.sparkSession.range(resamples).select(F.col("id").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(v - 1))).alias("j"))
    pick = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), "b", "j")), 1, 8), 16, 10).cast("long") % v
    return draws.withColumn("at", pick).join(at, "at").groupBy("b", "unit").agg(F.count("*").alias("n"))


def interval(values: DataFrame, column: str, level: float = 0.95, *by: str, units: DataFrame | None = None) -> DataFrame:
    """Percentile interval of a resampled statistic, linear between values; null values are left out. units: those that were
    drawn from; fewer than MIN_UNITS give no interval."""
    lo = (1 - level) / 2
    if units is not None:
        enough = units.select("unit").distinct().agg((F.count("*") >= MIN_UNITS).alias("enough"))
        values = values.crossJoin(F.broadcast(enough)).withColumn(column, F.when(F.col("enough"), F.col(column)))
    return values.groupBy(*by).agg(F.percentile(column, lo).alias("lo"), F.percentile(column, 1 - lo).alias("hi"))


def pooled(counts: DataFrame, boot: DataFrame, numerator: str, denominator: str) -> DataFrame:
    """b, value: a pooled ratio of each resample."""
    x = counts.join(boot, "unit").groupBy("b").agg(F.sum(F.col(numerator) * F.col("n")).alias("x"), F.sum(F.col(denominator) * F.col("n")).alias("y"))
    return x.select("b", F.when(F.col("y") > 0, F.col("x") / F.col("y")).alias("value"))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """b, value: second minus first, of the same resamples."""
    return a.withColumnRenamed("value", "first").join(b.withColumnRenamed("value", "second"), "b").select("b", (F.col("second") - F.col("first")).alias("value"))


def excludes_zero(lo: Column, hi: Column) -> Column:
    return (lo > 0) | (hi < 0)
