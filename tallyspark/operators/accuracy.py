"""Scoring predictions against gold, and what is counted of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import normalise
from .effects import bucketed


def score(predictions: DataFrame, gold: DataFrame, key: str = "scenario_id", predicted: str = "predicted", gold_col: str = "gold") -> DataFrame:
    """Predictions that have a gold row, with ``correct`` 0 or 1; labels compare normalised, a null prediction is wrong."""
    joined = predictions.join(gold.select(key, gold_col), key)
    return joined.withColumn("correct", F.coalesce((normalise(predicted) == normalise(gold_col)) & F.col(predicted).isNotNull(), F.lit(False)).cast("int"))


def scored_predictions(predictions: DataFrame, gold: DataFrame) -> DataFrame:
    """Successful predictions with both labels in lower case; gold by scenario, else the payload's own.

    ``predictions``: scenario_id, model_id, success, emotion, gold_emotion (may be null).
    """
    g = gold.select("scenario_id", F.lower(F.trim("gold")).alias("known"))
    j = predictions.where("success and emotion is not null").join(g, "scenario_id", "left")
    out = j.select("model_id", "scenario_id", F.lower("emotion").alias("predicted"), F.lower(F.coalesce("known", "gold_emotion")).alias("gold"))
    return out.where("predicted <> '' and gold <> ''")


def accuracy_sets(scored: DataFrame, sets: tuple[str, ...] = ("model_id", "subtype", "power_relation")) -> DataFrame:
    """Accuracy over everything and by each column, in one pass; ``gset`` tells which column holds.

    Rows are counted by all columns first, so what the grouping sets multiply is the few cells, not the rows.
    """
    cells = scored.groupBy(*sets).agg(F.count("*").alias("__n"), F.sum("correct").alias("__k"))
    grouped = cells.groupingSets([[F.col(c)] for c in sets] + [[]], *[F.col(c) for c in sets])
    out = grouped.agg(F.grouping_id(*sets).alias("gset"), F.coalesce(F.sum("__n"), F.lit(0)).alias("total"), F.sum("__k").alias("n_correct"))
    return out.select("gset", *sets, "total", "n_correct", F.try_divide("n_correct", "total").alias("accuracy"))


def accuracy_by(scored: DataFrame, *by: str) -> DataFrame:
    return scored.groupBy(*[F.coalesce(F.col(c), F.lit("unknown")).alias(c) for c in by]).agg(F.count("*").alias("total"), F.sum("correct").alias("n_correct"), F.avg("correct").alias("accuracy"))


def confusion(scored: DataFrame, labels: tuple[str, ...] | None = None) -> DataFrame:
    """(gold, predicted, n, gold_total, gold_accuracy, all_predictions) of pairs within ``labels``; all rows count in the last."""
    every = scored.groupBy("gold", "predicted").agg(F.count("*").alias("n"))
    every = every.withColumn("all_predictions", F.sum("n").over(Window.partitionBy()))  # over the few label pairs
    if labels is not None:
        every = every.where(F.col("gold").isin(*labels) & F.col("predicted").isin(*labels))
    w = Window.partitionBy("gold")
    right = F.sum(F.when(F.col("gold") == F.col("predicted"), F.col("n")).otherwise(0)).over(w)
    return every.select("gold", "predicted", "n", F.sum("n").over(w).alias("gold_total"), (right / F.sum("n").over(w)).alias("gold_accuracy"), "all_predictions")


def confusion_all(scored: DataFrame) -> DataFrame:
    """Every pair; null labels are ``unknown``."""
    return scored.groupBy(F.coalesce("gold", F.lit("unknown")).alias("gold"), F.coalesce("predicted", F.lit("unknown")).alias("predicted")).agg(F.count("*").alias("n"))


def confusion_percent(counts: DataFrame) -> DataFrame:
    """Share of each gold row in percent; an empty row divides by one."""
    total = F.sum("n").over(Window.partitionBy("gold"))
    return counts.select("gold", "predicted", (F.col("n") * 100.0 / F.when(total == 0, 1).otherwise(total)).alias("pct"))


def label_distribution(scored: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """(dimension, value, n) of each column, in one pass."""
    cells = scored.groupBy(*columns).agg(F.count("*").alias("__n"))
    sets = cells.groupingSets([[F.col(c)] for c in columns], *[F.col(c) for c in columns]).agg(F.grouping_id(*columns).alias("gid"), F.sum("__n").alias("n"))
    full = (1 << len(columns)) - 1
    which = F.coalesce(*[F.when(F.col("gid") == full - (1 << (len(columns) - 1 - i)), F.lit(c)) for i, c in enumerate(columns)])
    return sets.select(which.alias("dimension"), F.coalesce(*columns).alias("value"), "n")


def top_models(scored: DataFrame, k: int = 5) -> DataFrame:
    """The k models of highest accuracy; ties by name."""
    return accuracy_by(scored, "model_id").orderBy(F.desc("accuracy"), "model_id").limit(k)


def zip_join(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str]) -> DataFrame:
    """Positional join of two tables, as long as the shorter.

    Each order must be total and start with a number. A position is the rank in a bucket of that
    number plus the sizes of the buckets before it, so no task sees a whole table.
    """
    a, b = _numbered(left, left_order), _numbered(right, right_order)
    return a.join(b.withColumnRenamed("position", "p2"), F.col("position") == F.col("p2")).drop("p2")


def _numbered(df: DataFrame, order: list[str]) -> DataFrame:
    ranged = bucketed(df, order[0])
    sizes = ranged.groupBy("__b").agg(F.count("*").alias("__m"))
    before = sizes.select(F.col("__b").alias("__p"), F.coalesce(F.sum("__m").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__o"))
    at = F.row_number().over(Window.partitionBy("__b").orderBy(*order))
    return ranged.withColumn("__at", at).join(F.broadcast(before), F.col("__b") == F.col("__p")).withColumn("position", F.col("__at") + F.col("__o")).select(*df.columns, "position")
