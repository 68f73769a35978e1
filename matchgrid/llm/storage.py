"""Shared storage for intermediate results: the folder named by spark.checkpoint.dir.

Lineage is cut with Parquet tables in that folder, which every executor can read again, so that a lost executor
costs only its running tasks. Nothing is kept in a machine-local folder or as a local checkpoint.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders written by this driver, by tag, until clean() removes them.
_written: dict[str, list[str]] = {}
#: Tables in the session's catalog, over such folders.
_tables: dict[str, list[str]] = {}
#: Our own folder, by application, where the cluster names none.
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset, a folder of our own in local mode, where all tasks run on
    this machine; on a cluster that is an error."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        found = _own.get(sc.applicationId)
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="matchgrid-")
        sc.setCheckpointDir(found)
        _own[sc.applicationId] = found
    # Qualified, so that code outside the JVM sees the same file system as Spark's readers and writers.
    where = sc._jvm.org.apache.hadoop.fs.Path(str(found))
    uri = str(where.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(where).toUri().toString()).rstrip("/")
    return "file://" + uri.removeprefix("file:") if uri.startswith("file:/") and not uri.startswith("file://") else uri


def new_path(spark: SparkSession, name: str, tag: str = "") -> str:
    path = f"{shared_dir(spark)}/matchgrid/{name}-{uuid.uuid4().hex}"
    _written.setdefault(tag, []).append(path)
    return path


def written(df: DataFrame, name: str, *partition_by: str, tag: str = "") -> DataFrame:
    """The same rows, written as a table in the shared folder and read back."""
    spark = df.sparkSession
    path = new_path(spark, name, tag)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, by: str, *partition_by: str, tag: str = "") -> DataFrame:
    """The same rows, written as a table bucketed by a column, whose groups later operators find without a shuffle."""
    spark = df.sparkSession
    path, table = new_path(spark, name, tag), f"matchgrid_{uuid.uuid4().hex}"
    _tables.setdefault(tag, []).append(table)
    writer = df.write.format("parquet").option("compression", "zstd").option("path", path)
    writer = writer.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), by)
    (writer.partitionBy(*partition_by) if partition_by else writer).saveAsTable(table)
    return spark.table(table)


def new_tag() -> str:
    return uuid.uuid4().hex


def clean(spark: SparkSession, tag: str = "") -> None:
    """Delete what was written under the tag, by default what queries outside a pipeline wrote. For the caller, when no
    result that reads those tables is still needed: results are lazy, so no operator calls it for itself."""
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    for table in _tables.pop(tag, []):
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    for path in _written.pop(tag, []):
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(jsc.hadoopConfiguration()).delete(where, True)


def text_bytes(df: DataFrame, column: str) -> int:
    """Bytes of a text column over all rows, to choose numbers of buckets from."""
    return df.agg(F.sum(F.octet_length(column).cast("long")).alias("n")).first().n or 0
