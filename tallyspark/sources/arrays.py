"""Numeric arrays in JSON, and a side store that keeps the arrays of cached responses apart from their small fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The parts of a tagged array in JSON; a fixed value of the format.
TAGGED = "`__numpy__` boolean, data array<double>, dtype string"


def array_from_json(text: str | Column) -> Column:
    """array<double> of a tagged one-dimensional array, or of a plain JSON list; null for anything else."""
    c = F.col(text) if isinstance(text, str) else text
    tagged = F.from_json(c, TAGGED)
    return F.coalesce(F.when(tagged["__numpy__"], tagged["data"]), F.from_json(c, "array<double>"))


def array_to_json(values: str | Column, dtype: str = "float64") -> Column:
    """The tagged JSON of an array; null of null."""
    c = F.col(values) if isinstance(values, str) else values
    made = F.to_json(F.struct(F.lit(True).alias("__numpy__"), F.transform(c, lambda x: x.cast("double")).alias("data"), F.lit(dtype).alias("dtype")))
    return F.when(c.isNotNull(), made)


def write_side_store(cache: DataFrame, folder: str, key: list[str], arrays: list[str], mode: str = "errorifexists") -> None:
    """Write ``cache`` as two tables: entries without ``arrays``, and (key, name, values) of every array that is there.

    A scan of the entries reads no array; arrays are partitioned by name, so one kind is read without the others.
    """
    cache.drop(*arrays).write.mode(mode).parquet(f"{folder}/entries")
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("name"), F.transform(a, lambda x: x.cast("double")).alias("values")) for a in arrays]))
    cache.select(*key, each.alias("x")).select(*key, "x.*").where("values is not null").write.mode(mode).partitionBy("name").parquet(f"{folder}/arrays")


def read_side_store(spark: SparkSession, folder: str, key: list[str], arrays: list[str] = ()) -> DataFrame:
    """The entries, with those ``arrays`` asked for beside them (null where an entry has none)."""
    out = spark.read.parquet(f"{folder}/entries")
    if not arrays:
        return out
    held = spark.read.parquet(f"{folder}/arrays").where(F.col("name").isin(*arrays))
    wide = held.groupBy(*key).agg(*[F.max(F.when(F.col("name") == a, F.col("values"))).alias(a) for a in arrays])
    same = [F.col(f"__e.{k}").eqNullSafe(F.col(f"__a.{k}")) for k in key]
    joined = out.alias("__e").join(wide.alias("__a"), same, "left")
    return joined.select("__e.*", *[F.col(f"__a.{a}") for a in arrays])
