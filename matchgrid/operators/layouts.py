"""Items from paths and split lists, names and settings: the tables that a data set's layout gives."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from matchgrid.operators.sampling import numbered


def split_path(paths: DataFrame, pid: tuple[int, str, int], cam: tuple[int, str, int] | None = None, column: str = "path", prefix: str = "") -> DataFrame:
    """path, pid, camid: each from a level of the path counted from its end (-1: the file's name without its ending), cut at a
    separator, by the number of the part. Rows without that level or part have nulls."""
    level = lambda at: F.regexp_replace(F.try_element_at(F.split(F.col(column), "/"), F.lit(at)), r"\.[^.]*$", "")
    part = lambda spec: F.get(F.split(level(spec[0]), F.concat(F.lit("["), F.lit(spec[1]), F.lit("]"))), spec[2])
    return paths.select(F.col(column).alias("path"), F.concat(F.lit(prefix), part(pid)).alias("pid"), (part(cam) if cam else F.lit("0")).alias("camid"))


def split_lists(documents: DataFrame, column: str = "document", names: Sequence[str] = ("train", "query", "gallery")) -> DataFrame:
    """split, subset, place, path, pid, camid from JSON split documents: an array of objects with a list of [path, pid, camid]
    for each subset. Null and empty lists give no rows; a text that is no such document is an error."""
    one = ", ".join(f"{n}: ARRAY<ARRAY<STRING>>" for n in names)
    d = documents.select(F.from_json(F.col(column), f"ARRAY<STRUCT<{one}>>", {"mode": "FAILFAST"}).alias("d")).select(F.posexplode("d").alias("split", "s"))
    subsets = F.explode(F.array(*(F.struct(F.lit(n).alias("subset"), F.col(f"s.{n}").alias("items")) for n in names))).alias("e")
    rows = d.select("split", subsets).select("split", "e.subset", F.posexplode("e.items").alias("place", "i"))
    return rows.select("split", "subset", "place", F.get("i", 0).alias("path"), F.get("i", 1).cast("long").alias("pid"), F.get("i", 2).cast("long").alias("camid"))


def offset_identities(train: DataFrame, test: DataFrame, column: str = "pid") -> DataFrame:
    """test with its identities moved behind those of train: the number of distinct training identities is added."""
    n = train.agg(F.countDistinct(column).alias("_n"))  # one row
    return test.crossJoin(F.broadcast(n)).withColumn(column, F.col(column) + F.col("_n")).drop("_n")


def slug(name: Column) -> Column:
    """A name that is safe as a folder's: letters, digits, dot, dash and underscore stay, runs of others are one underscore."""
    return F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "_")


def slugs(names: DataFrame, column: str, *order: str) -> DataFrame:
    """Adds slug: the second and later rows of one slug, in the given order, have _2, _3 and so on behind it."""
    w = Window.partitionBy(slug(F.col(column))).orderBy(*order)
    k = F.row_number().over(w)
    return names.withColumn("slug", F.concat(slug(F.col(column)), F.when(k > 1, F.concat(F.lit("_"), k.cast("string"))).otherwise("")))


def flatten(rows: DataFrame, separator: str = "/") -> DataFrame:
    """Nested structs as columns named by their path. Two paths of one name are an error."""

    def leaves(schema: StructType, at: str, name: str) -> list[tuple[str, str]]:
        out = []
        for f in schema.fields:
            here, called = (f"{at}.`{f.name}`" if at else f"`{f.name}`"), (f"{name}{separator}{f.name}" if name else f.name)
            out += leaves(f.dataType, here, called) if isinstance(f.dataType, StructType) else [(here, called)]
        return out

    found = leaves(rows.schema, "", "")
    if len({n for _, n in found}) < len(found):
        raise ValueError("two nested columns have one name")
    return rows.select(*(F.col(at).alias(name) for at, name in found))


def object_index(rows: DataFrame, unit: str, label: str, order: str) -> DataFrame:
    """Adds object_index: a unit's objects numbered from zero by their first row, and grouped: whether the object's rows stand
    together in the order."""
    w = Window.partitionBy(unit).orderBy(order)
    rows = rows.withColumn("_at", F.row_number().over(w))
    o = rows.groupBy(unit, label).agg(F.min("_at").alias("_first"), (F.max("_at") - F.min("_at") + 1 == F.count("*")).alias("grouped"))
    o = o.withColumn("object_index", (F.row_number().over(Window.partitionBy(unit).orderBy("_first")) - 1).cast("long")).drop("_first")
    return rows.join(o, [unit, label]).drop("_at")


def neutral(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns as unknown, of their own types."""
    types = {f.name: f.dataType for f in rows.schema}
    return rows.withColumns({c: F.lit(None).cast(types[c]) for c in columns})


def interleave(rows: DataFrame, position: str, batch: int, workers: int) -> DataFrame:
    """Adds place: inside each whole batch, the rows that go to worker 0 first, then worker 1; a last short batch is left out.
    The batch must divide evenly."""
    if batch % workers:
        raise ValueError(f"a batch of {batch} does not divide by {workers}")
    n = rows.count() // batch * batch
    r = F.pmod(F.col(position), F.lit(batch))
    return rows.where(F.col(position) < n).withColumn("place", (F.col(position) - r + F.pmod(r, F.lit(workers)) * (batch // workers) + F.floor(r / workers)).cast("long"))


def identity_draws(groups: DataFrame, pid: str, batch: str, per_batch: int, draw: Column) -> DataFrame:
    """Adds round and step to rows of identity batches: round r holds the r-th group of each identity that has one, in drawn
    order, and is cut into steps of per_batch identities. A step never holds an identity twice; what is left of a round is
    left out."""
    one = groups.select(pid, batch).distinct()
    n = numbered(one, F.col(batch), draw, F.col(pid))
    starts = n.groupBy(batch).agg(F.min("pos").alias("_start"), F.count("*").alias("_size"))
    n = n.join(starts, batch).withColumn("step", F.floor((F.col("pos") - F.col("_start")) / per_batch)).where((F.col("step") + 1) * per_batch <= F.col("_size"))
    return groups.join(n.select(pid, batch, "step"), [pid, batch]).withColumnRenamed(batch, "round")


def camera_weights(items: DataFrame, pid: str = "pid", cam: str = "camid") -> DataFrame:
    """camid, pid, weight: an identity's chance under a camera, its items of all cameras counted once for each of its items of
    this one, over the camera's total."""
    both = items.groupBy(cam, pid).agg(F.count("*").alias("here"))
    size = items.groupBy(pid).agg(F.count("*").alias("all"))
    w = both.join(size, pid).withColumn("w", F.col("here") * F.col("all"))
    total = w.groupBy(cam).agg(F.sum("w").alias("total"))
    return w.join(total, cam).select(cam, pid, (F.col("w") / F.col("total")).alias("weight"))


def camera_draw(weights: DataFrame, n: int, seed: int, pid: str = "pid", cam: str = "camid") -> DataFrame:
    """n identities of each camera without replacement, by chance of their weights: those with the least -ln(u) / weight,
    where u comes from a hash. The n least are kept before rows of a camera meet, so no camera is one task's load."""
    u = (F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(cam).cast("string"), F.col(pid).cast("string"))), 1, 12), 16, 10).cast("double") + 1) / float(1 << 48)
    keyed = weights.withColumn("key", -F.log(u) / F.col("weight")).withColumn("_salt", F.pmod(F.xxhash64(pid), F.lit(64)))
    first = keyed.withColumn("_r", F.row_number().over(Window.partitionBy(cam, "_salt").orderBy("key", pid))).where(F.col("_r") <= n)
    return first.withColumn("place", F.row_number().over(Window.partitionBy(cam).orderBy("key", pid))).where(F.col("place") <= n).select(cam, pid, "place")
