"""Stored tables: templates and accumulated cells by unit, manifests, result tables, pair sets and indexed records."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchgrid.functions.shared import scratch
from matchgrid.operators.sampling import numbered

# Units


def write_units(rows: DataFrame, path: str, *by: str) -> None:
    """A table with a folder for each value of the columns. A reader sees all of it or nothing: files appear when the job commits."""
    rows.repartition(*by, F.pmod(F.xxhash64(*rows.columns[:1]), F.lit(16))).write.partitionBy(*by).parquet(path)


def read_units(spark: SparkSession, path: str, **only: Any) -> DataFrame:
    """The table, of the folders named by column=value alone; other folders are not opened. A column that is not there is an error."""
    rows = spark.read.parquet(path)
    for column, value in only.items():
        rows = rows.where(F.col(column).isin(*value) if isinstance(value, (list, tuple, set)) else F.col(column) == F.lit(value))
    return rows


def placed(rows: DataFrame, unit: str, *order) -> DataFrame:
    """Adds place: a row's number in its unit, from zero. No unit is one task's load."""
    n = numbered(rows, F.col(unit), *order)
    first = n.groupBy(unit).agg(F.min("pos").alias("_first"))
    return n.join(first, unit).withColumn("place", F.col("pos") - F.col("_first")).drop("pos", "_first")


def alignment(records: DataFrame, templates: DataFrame, vector: str = "embedding") -> DataFrame:
    """unit, missing, extra, moved, nonfinite, aligned for each unit. records: unit, uid, place; templates: unit, uid, place and a
    vector. missing: records without a vector; extra: vectors without a record; moved: those that both have at another place;
    nonfinite: vectors that are null, empty or hold null or non-finite components.

    Null units or uids match nothing and count as missing or extra under a null unit. Repeated uids meet each other.
    """
    v = F.col(vector)
    fine = F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    r = records.select("unit", "uid", F.col("place").alias("_r"))
    t = templates.select("unit", "uid", F.col("place").alias("_t"), (~fine).alias("_bad"))
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    both = r.join(t, ["unit", "uid"], "full").groupBy("unit").agg(
        n(F.col("_t").isNull()).alias("missing"), n(F.col("_r").isNull()).alias("extra"), n(F.col("_r") != F.col("_t")).alias("moved"), n(F.col("_bad")).alias("nonfinite")
    )
    return both.withColumn("aligned", F.col("missing") + F.col("extra") + F.col("moved") + F.col("nonfinite") == 0)


def check_aligned(records: DataFrame, templates: DataFrame, vector: str = "embedding") -> DataFrame:
    """templates, or an error that names units whose vectors are not those of the records in the records' order."""
    if bad := alignment(records, templates, vector).where("not aligned").orderBy("unit").limit(5).collect():
        raise ValueError(f"templates do not match the records: {[r.asDict() for r in bad]}")
    return templates


# Small files


def _file(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, whole or not at all: written beside its place and then renamed, in place of one that is there."""
    where, fs = _file(spark, path)
    beside, _ = _file(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(beside)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(where):
        fs.delete(where, False)
    if not fs.rename(beside, where):
        fs.delete(beside, False)
        raise OSError(f"cannot write {path}")


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def write_manifest(spark: SparkSession, path: str, value: Any) -> None:
    """A JSON file with sorted keys. Values that JSON does not have, such as NaN, are an error."""
    write_text(spark, path, json.dumps(value, indent=1, sort_keys=True, allow_nan=False, ensure_ascii=False) + "\n")


def read_manifest(spark: SparkSession, path: str) -> Any:
    """A manifest, or settings."""
    return json.loads(read_text(spark, path))


def write_tables(tables: dict[str, DataFrame], folder: str, kind: str = "parquet") -> None:
    """A result set: a folder for each table, as parquet, or as CSV with a header; of bounded result tables, one file each."""
    for name, df in tables.items():
        if kind == "csv":
            df.coalesce(1).write.option("header", True).csv(f"{folder}/{name}")
        else:
            df.write.format(kind).save(f"{folder}/{name}")


# Sets and catalogs


def runs(files: DataFrame, methods: Sequence[tuple[str, Sequence[str]]], version: str, needs: Sequence[str] = ("summary.json", "per_site.csv"), column: str = "path") -> DataFrame:
    """method, folder: of each method the first of its folders, version and ending, that holds all files needed. files: paths
    below one root. Methods without one are left out."""
    spark = files.sparkSession
    named = [(m, k, version + ending) for m, endings in methods for k, ending in enumerate(endings)]
    asked = spark.createDataFrame(named, "method string, k int, folder string")
    parts = F.split(F.col(column), "/")
    have = files.select(F.element_at(parts, 1).alias("folder"), F.element_at(parts, -1).alias("file")).where(F.col("file").isin(*needs))
    full = have.groupBy("folder").agg(F.countDistinct("file").alias("n")).where(F.col("n") == len(set(needs)))
    return full.join(F.broadcast(asked), "folder").groupBy("method").agg(F.min_by("folder", "k").alias("folder"))


def pair_set(images: DataFrame, flags: DataFrame) -> DataFrame:
    """pair, a, b, same: images (pos, image) stand two by two, flags (pair, same) say which pairs are of one identity. A pair
    without both images or without a flag is left out."""
    two = images.groupBy(F.floor(F.col("pos") / 2).alias("pair")).agg(
        F.max(F.when(F.pmod("pos", F.lit(2)) == 0, F.col("image"))).alias("a"), F.max(F.when(F.pmod("pos", F.lit(2)) == 1, F.col("image"))).alias("b")
    )
    return two.where("a is not null and b is not null").join(flags, "pair").select("pair", "a", "b", "same")


def indexed_records(records: DataFrame) -> DataFrame:
    """idx, target, classes from records (idx, label array). Record 0 is a header (first index behind the samples, and behind that the
    last class's): samples are the records below the former, classes the difference. A label is its array's first element."""
    header = records.where("idx = 0").select(F.get("label", 0).alias("_end"), (F.get("label", 1) - F.get("label", 0)).alias("classes"))  # one row
    rows = records.where("idx > 0").crossJoin(F.broadcast(header)).where("idx < _end")
    return rows.select("idx", F.get("label", 0).cast("long").alias("target"), F.col("classes").cast("long").alias("classes"))
