"""The standing analysis as named stages over a folder of tables: validation, accuracy, agreement, and a report of its metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import accuracy, agreement, efficiency, quality, worklist
from ..sources import bindings as B
from .stages import Registry, Stage, stale


def sources(spark: SparkSession, tables: str) -> dict[str, DataFrame]:
    """The views of a folder of tables that the stages require."""
    return {"responses": B.responses(spark, tables), "predictions": B.predictions(spark, tables), "ratings": B.ratings(spark, tables)}


def registry() -> Registry:
    """Stages in order; each reads what those before it produced, and ``sources``."""
    made = Registry()
    made.register(Stage("validate", lambda s, have: {"errors": quality.validate(have["responses"])}, ("responses",), ("errors",)))
    made.register(Stage("plan", lambda s, have: {"retries": quality.retry_plan(have["errors"])}, ("errors",), ("retries",)))
    made.register(Stage("score", lambda s, have: {"scored": have["predictions"]}, ("predictions",), ("scored",)))
    made.register(Stage("accuracy", lambda s, have: {"by_group": accuracy.accuracy_sets(have["scored"]), "confusion": accuracy.confusion(have["scored"])}, ("scored",), ("by_group", "confusion")))
    made.register(Stage("agreement", lambda s, have: {"kappa": agreement.fleiss_kappa(have["ratings"])}, ("ratings",), ("kappa",)))
    made.register(Stage("report", lambda s, have: {"metrics": efficiency.all_metrics(have["scored"])}, ("scored",), ("metrics",)))
    return made


def status(spark: SparkSession, folder: str, tables: str | None = None) -> list[tuple[str, str]]:
    """(stage, done, stale, partial or open) of every stage, by the outputs in ``folder`` and, if given, the tables they should be made from."""
    return list(stale(spark, registry(), sources(spark, tables) if tables else {}, folder).items())


def estimate(spark: SparkSession, tables: str, variants: int = 0, extra: int = 0, per_call: float = 0.0008) -> DataFrame:
    """(plan, calls, cost) of asking every model of the tables about every scenario again."""
    sizes = B.responses(spark, tables).agg(F.countDistinct("model_id").alias("models"), F.countDistinct("scenario_id").alias("scenarios"))
    return worklist.cost_estimate(sizes.select(F.lit("all").alias("plan"), "models", "scenarios", F.lit(variants).alias("variants"), F.lit(extra).alias("extra")), per_call)
