"""Items (subset, path, pid, camid) from file names and list files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Patterns of identity and camera in file names, by the layout's name.
PATTERNS = {
    "pid_cam": r"([-\d]+)_c(\d)",
    "pid_cam3": r"([\d]+)_c(\d\d\d)",
    "scene": r"p([-\d]+)_s(\d)",
    "pid_any": r"([-\d]+)_(\d*)",
}
JUNK = (-1, 0)


def from_names(paths: DataFrame, layout: str, subset: str, prefix: str = "", drop: Sequence[int] = (-1,), column: str = "path") -> DataFrame:
    """Identity and camera by the layout's pattern; identities in drop are left out. Training identities get a prefix
    and become strings of their own data set; cameras start at zero."""
    p = PATTERNS[layout]
    name = F.element_at(F.split(F.col(column), "/"), -1)
    pid, cam = F.regexp_extract(name, p, 1), F.regexp_extract(name, p, 2)
    rows = paths.select(F.lit(subset).alias("subset"), F.col(column).alias("path"), pid.try_cast("int").alias("n"), cam.try_cast("int").alias("c"))
    rows = rows.where(F.col("n").isNotNull() & ~F.col("n").isin(*drop)) if drop else rows.where("n is not null")
    tag = lambda c: F.concat(F.lit(prefix), c.cast("string"))
    return rows.select("subset", "path", tag(F.col("n")).alias("pid"), tag(F.col("c") - 1).alias("camid"))


def from_list(spark: SparkSession, path: str, separator: str = " ", fields: Sequence[str] = ("path", "pid")) -> DataFrame:
    """A text file with fields between separators."""
    parts = F.split(F.col("value"), F.lit("[" + separator + "]"))
    return spark.read.text(path).where(F.trim("value") != "").select(*(F.trim(F.get(parts, k)).alias(f) for k, f in enumerate(fields)))


def from_folders(paths: DataFrame, column: str = "path") -> DataFrame:
    """The class is the name of the folder."""
    return paths.select(F.col(column).alias("path"), F.element_at(F.split(F.col(column), "/"), -2).alias("label"))


def with_camera(items: DataFrame, cameras: DataFrame, key: str = "img_id") -> DataFrame:
    """Cameras looked up by image id."""
    return items.join(cameras.select(key, "camid"), key)


def relabel(items: DataFrame, column: str, to: str, by: Column | None = None) -> DataFrame:
    """Distinct values as numbers from zero, in their order. Only the distinct values are ranked."""
    from pyspark.sql import Window

    values = items.select(column).distinct()
    values = values.withColumn(to, (F.dense_rank().over(Window.orderBy(by if by is not None else F.col(column))) - 1).cast("long"))
    return items.join(values, column)
