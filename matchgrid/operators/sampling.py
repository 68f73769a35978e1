"""Splits, folds and samplers. A draw is an order by md5 of a seed and the key, so it is the same on every cluster."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchgrid.functions.shared import kept


def draw(seed: int, *keys: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)))


def numbered(df: DataFrame, *order: Column, to: str = "pos") -> DataFrame:
    """Positions from zero in a total order, without sorting everything in one task: range-partitioned, then shifted by
    what the partitions before hold. The partitions are written before they are counted, as their bounds are drawn."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    rows = rows.withColumn("_part", F.shiftright("_id", 33)).withColumn("_in", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
    rows = kept(rows.drop("_id"), "numbered")
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return rows.join(starts, "_part").withColumn(to, F.col("_start") + F.col("_in")).drop("_part", "_in", "_start")


def running(df: DataFrame, order: Sequence[Column], columns: Sequence[str]) -> DataFrame:
    """Running sums cum_<column> and positions from zero in a total order: sums inside range partitions, shifted by those of
    the partitions before. The partitions are written before they are summed, as their bounds are drawn."""
    rows = kept(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "running")
    parts = rows.groupBy("_part").agg(F.count("*").alias("_rows"), *(F.sum(c).alias(f"_sum_{c}") for c in columns))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    starts = parts.select("_part", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("_rows", *(f"_sum_{c}" for c in columns))))
    w = Window.partitionBy("_part").orderBy(*order)
    rows = rows.join(starts, "_part").withColumn("pos", F.col("_rows") + F.row_number().over(w) - 1)
    rows = rows.withColumns({f"cum_{c}": F.col(f"_sum_{c}") + F.sum(c).over(w) for c in columns})
    return rows.drop("_part", "_rows", *(f"_sum_{c}" for c in columns))


def contiguous_shards(df: DataFrame, order: Sequence[Column], shards: int) -> DataFrame:
    """Exact contiguous shards of ceil(n / shards) rows."""
    n = df.count()
    return numbered(df, *order).withColumn("shard", F.floor(F.col("pos") / F.lit(max(1, -(-n // shards)))))


def contiguous_folds(df: DataFrame, order: Sequence[Column], folds: int) -> DataFrame:
    """fold: contiguous blocks of the order; where the rows do not divide evenly, the first blocks have one more."""
    n = df.count()
    small, more = divmod(n, folds)
    cut = more * (small + 1)
    pos = F.col("pos")
    fold = F.when(pos < cut, F.floor(pos / (small + 1))).otherwise(more + F.floor((pos - cut) / max(1, small)))
    return numbered(df, *order).withColumn("fold", fold.cast("long")).drop("pos")


def strided_stream(df: DataFrame, key: str, seed: int, rank: int, world: int) -> DataFrame:
    """The rank-th of every `world` rows of one epoch's shuffled order."""
    return numbered(df, draw(seed, key), F.col(key)).where(F.pmod("pos", F.lit(world)) == rank)


def identity_batches(items: DataFrame, pid: str, key: str, per_id: int, seed: int = 0) -> DataFrame:
    """Groups of per_id items of one identity; an identity with fewer repeats its items in order."""
    w = Window.partitionBy(pid).orderBy(draw(seed, key), key)
    ranked = items.withColumn("r", F.row_number().over(w) - 1).withColumn("size", F.count("*").over(Window.partitionBy(pid)))
    full = ranked.where(F.col("r") < F.greatest(F.floor(F.col("size") / per_id) * per_id, F.lit(per_id)))
    times = F.when(F.col("size") >= per_id, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(per_id - 1)))
    slots = full.withColumn("k", F.explode(times)).withColumn("slot", F.col("r") + F.col("k") * F.col("size")).where((F.col("size") >= per_id) | (F.col("slot") < per_id))
    return slots.select(pid, key, F.floor(F.col("slot") / per_id).alias("batch"), F.pmod("slot", F.lit(per_id)).cast("long").alias("place"))


def balanced_batches(items: DataFrame, pid: str, cam: str, key: str, per_id: int, seed: int = 0) -> DataFrame:
    """For each identity an anchor and per_id - 1 more: items of other cameras first, then others of its own camera,
    then the anchor again."""
    w = Window.partitionBy(pid).orderBy(draw(seed, key), key)
    anchors = items.withColumn("r", F.row_number().over(w)).where("r = 1").select(pid, F.col(cam).alias("anchor_cam"), F.col(key).alias("anchor"))
    rest = items.join(anchors, pid).where(F.col(key) != F.col("anchor"))
    order = Window.partitionBy(pid).orderBy((F.col(cam) == F.col("anchor_cam")).cast("int"), draw(seed + 1, key), key)
    rest = rest.withColumn("place", F.row_number().over(order)).where(F.col("place") < per_id).select(pid, key, "place")
    have = anchors.join(rest.groupBy(pid).agg(F.count("*").alias("n")), pid, "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("int"))
    again = F.filter(F.sequence(F.lit(0), F.lit(per_id - 1)), lambda k: (k == 0) | (k > F.col("n")))
    return rest.unionByName(have.select(pid, F.col("anchor").alias(key), F.explode(again).alias("place")))


def imbalance_weights(items: DataFrame, label: str) -> DataFrame:
    """Weight of one item of each class: one over the class's size."""
    return items.groupBy(label).agg(F.count("*").alias("n")).withColumn("weight", 1 / F.col("n"))


def class_centres(classes: DataFrame, positives: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """All classes that occur, filled up with drawn others to n, relabelled by their order."""
    marked = classes.join(positives.select(key).distinct().withColumn("p", F.lit(0)), key, "left").withColumn("p", F.coalesce("p", F.lit(1)))
    k = marked.where("p = 0").count()
    top = marked.orderBy("p", draw(seed, key), key).limit(max(n, k))
    return top.select(key, (F.col("p") == 0).alias("positive"), (F.row_number().over(Window.orderBy(key)) - 1).cast("long").alias("new_label"))


def site_split(units: DataFrame, n_validation: int, n_test: int, seed: int = 0) -> DataFrame:
    """unit, site, part: whole sites, in drawn order, to validation until it holds n_validation units; a site that would
    take it above one and a half times that is passed over. The first n_test other units are the test.

    Sites are few: their sizes, one row a site, are decided on the driver.
    """
    sizes = sorted(units.groupBy("site").agg(F.count("*").alias("n"), F.first(draw(seed, "site")).alias("d")).collect(), key=lambda r: (r.d, str(r.site)))
    taken, n = [], 0
    for r in sizes:
        if n >= n_validation:
            break
        if n + r.n <= 1.5 * n_validation:
            taken.append(r.site)
            n += r.n
    spark = units.sparkSession
    chosen = spark.createDataFrame([(s,) for s in taken], units.select("site").schema)
    validation = units.join(F.broadcast(chosen), "site", "left_semi").select("unit", "site", F.lit("validation").alias("part"))
    rest = units.join(F.broadcast(chosen), "site", "left_anti").orderBy(draw(seed, "unit"), "unit").limit(n_test)
    return validation.unionByName(rest.select("unit", "site", F.lit("test").alias("part")))
