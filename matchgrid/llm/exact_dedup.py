"""Exact dedup with a heavy-hitter split, in DataFrame functions only.

A Misra-Gries sketch (Spark's approx_top_k, a frequent-items sketch of that family) over the digests names the few
that may be frequent. Their exact counts and winners are verified in one pass that combines map-side, and the winners,
SKETCH_TOP rows at most, are broadcast: rows of frequent digests are decided where they are read and never shuffled.
The other digests, none of which can be frequent, take an ordinary shuffle.

Defined results: null text counts as empty; null doc_id sorts last, so it wins only among nulls; of rows that repeat
both id and text one stays; an empty table gives an empty result; other columns, whatever their names, are untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchgrid.llm import storage

#: Entries that the sketch tracks: digests above about 3.5 / SKETCH_ITEMS of all rows are always found.
SKETCH_ITEMS = 16384
#: Entries taken from the sketch, the bound of what is broadcast.
SKETCH_TOP = 2048

SPACE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Each run of white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def frequent(digests: DataFrame, column: str) -> DataFrame:
    """At most SKETCH_TOP candidates, each with its exact number of rows and its first row by (null last, id, row)."""
    found = digests.agg(F.expr(f"approx_top_k({column}, {SKETCH_TOP}, {SKETCH_ITEMS})").alias("top"))
    found = found.select(F.explode("top").alias("t")).where("t.count > 1").select(F.col("t.item").alias(column))
    order = F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("id"), F.col("_row").alias("row"))
    return digests.join(F.broadcast(found), column).groupBy(column).agg(F.count("*").alias("_n"), F.min(order).alias("_first"))


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tag: str = "") -> DataFrame:
    """One row per row of df: doc_id, keep_id, group_size, kept, text_sha256."""
    digests = df.select(F.col(id_col).alias("_id"), F.sha2(F.encode(normalised(F.col(text_col)), "UTF-8"), 256).alias("_digest"))
    digests = storage.written(digests.withColumn("_row", F.monotonically_increasing_id()), "digests", tag=tag)
    heavy = frequent(digests, "_digest")
    both = digests.join(F.broadcast(heavy), "_digest", "left")
    split = both.where("_n is not null"), both.where("_n is null").drop("_n", "_first")
    order = F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("id"), F.col("_row").alias("row"))
    w = Window.partitionBy("_digest")
    light = split[1].withColumns({"_n": F.count("*").over(w), "_first": F.min(order).over(w)})
    return (
        split[0]
        .unionByName(light)
        .select(
            F.col("_id").alias("doc_id"),
            F.col("_first.id").alias("keep_id"),
            F.col("_n").alias("group_size"),
            (F.col("_row") == F.col("_first.row")).alias("kept"),
            F.col("_digest").alias("text_sha256"),
        )
    )


def drop_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tag: str = "") -> DataFrame:
    """The rows of df whose text has no earlier equal, with df's own columns.

    Rows of frequent digests are dropped where they are read, but for one candidate per digest and task; only
    candidates and rows of other digests are shuffled.
    """
    inner = df.select(
        F.struct(*df.columns).alias("_all"),
        F.col(id_col).alias("_id"),
        F.sha2(F.encode(normalised(F.col(text_col)), "UTF-8"), 256).alias("_digest"),
    )
    keys = storage.written(inner.select("_id", "_digest").withColumn("_row", F.lit(0)), "digests", tag=tag)
    heavy = frequent(keys, "_digest").select("_digest", F.col("_first.id").alias("_keep"))
    both = inner.join(F.broadcast(heavy.withColumn("_heavy", F.lit(True))), "_digest", "left")
    both = both.where(F.col("_heavy").isNull() | F.col("_id").eqNullSafe(F.col("_keep")))
    w = Window.partitionBy("_digest").orderBy(F.col("_id").asc_nulls_last())
    first = both.withColumn("_rank", F.row_number().over(w)).where("_rank = 1")
    return first.select("_all.*")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, h AS text_sha256
FROM d WINDOW w AS (PARTITION BY h)
"""
