"""Scans along an order within each key, by segments: a key of any number of rows is cut into ranges that are scanned by themselves and then joined up."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import kept


def segmented(rows: DataFrame, key: str, order: str, parts: int | None = None) -> DataFrame:
    """The rows with __p, so that (key, __p) are ranges of ``order`` within a key: __p grows with the order, and holds about one in ``parts`` of all rows.

    Spark samples the bounds, so a key with many rows is cut into many ranges and small keys share one.
    Rows of equal key and order stay together. The ranges are kept: every later pass sees the same.
    """
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return kept(rows.repartitionByRange(parts, key, order).withColumn("__p", F.spark_partition_id()))


def _earlier(key: str) -> Window:
    """The ranges of a key before one: rows of a table that has one for each range."""
    return Window.partitionBy(key).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)


def _joined(ranged: DataFrame, ranges: DataFrame, key: str) -> DataFrame:
    r = ranges.withColumnsRenamed({key: "__k", "__p": "__q"})
    return ranged.join(r, ranged[key].eqNullSafe(r["__k"]) & (ranged["__p"] == r["__q"])).drop("__k", "__q")


def numbered(rows: DataFrame, key: str, order: str, ties: tuple[str, ...] = (), parts: int | None = None) -> DataFrame:
    """The rows with ``position``: each row's place in its key by ``order``, then ``ties``, from 1. Null keys are one key; null orders come first."""
    ranged = segmented(rows, key, order, parts)
    sizes = ranged.groupBy(key, "__p").agg(F.count(F.lit(1)).alias("__m"))
    before = sizes.select(key, "__p", F.coalesce(F.sum("__m").over(_earlier(key)), F.lit(0)).alias("__o"))
    at = F.row_number().over(Window.partitionBy(key, "__p").orderBy(order, *ties))
    return _joined(ranged.withColumn("__at", at), before, key).select(*[F.col(f"`{c}`") for c in rows.columns], (F.col("__at") + F.col("__o")).alias("position"))


def runs(rows: DataFrame, key: str, order: str, flag: str, parts: int | None = None) -> DataFrame:
    """The rows with ``run``: how many rows in a row, up to and with this one, have ``flag`` set (0 where it isn't; null counts as unset).

    A range knows its rows and the place of its last unset one. What a range inherits is what lies between the last unset row of any range before it
    and its own beginning, which one window over the ranges tells; it counts for the rows before the range's first unset one.
    """
    ranged = segmented(rows.withColumn("__f", F.coalesce(F.col(flag).cast("int"), F.lit(0)) != 0), key, order, parts)
    here = Window.partitionBy(key, "__p").orderBy(order, "__f")
    local = ranged.withColumn("__at", F.row_number().over(here))
    local = local.withColumn("__unset", F.max(F.when(~F.col("__f"), F.col("__at"))).over(here.rowsBetween(Window.unboundedPreceding, 0)))
    ends = local.groupBy(key, "__p").agg(F.count(F.lit(1)).alias("__m"), F.max("__unset").alias("__last"))
    ends = ends.withColumn("__o", F.coalesce(F.sum("__m").over(_earlier(key)), F.lit(0)))
    ends = ends.select(key, "__p", (F.col("__o") - F.coalesce(F.max(F.col("__o") + F.col("__last")).over(_earlier(key)), F.lit(0))).alias("__carry"))
    run = F.col("__at") - F.coalesce("__unset", F.lit(0)) + F.when(F.col("__unset").isNull(), F.col("__carry")).otherwise(0)
    return _joined(local, ends, key).select(*[F.col(f"`{c}`") for c in rows.columns], F.when(F.col("__f"), run).otherwise(0).cast("bigint").alias("run"))
