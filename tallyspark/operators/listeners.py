"""Literal and pragmatic listener baselines over the label set."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.labels import EMOTIONS, power_relation, valence
from .agreement import cohen_kappa

# Likelihood of a positive, negative and neutral utterance under each label
LIKELIHOOD = {
    "joy": (0.9, 0.1, 0.3),
    "trust": (0.7, 0.2, 0.5),
    "fear": (0.1, 0.8, 0.3),
    "surprise": (0.5, 0.5, 0.4),
    "sadness": (0.1, 0.9, 0.3),
    "disgust": (0.05, 0.9, 0.2),
    "anger": (0.1, 0.85, 0.2),
    "anticipation": (0.6, 0.3, 0.5),
}
# Factors on the uniform prior by power relation
PRIOR = {
    "lower_to_higher": {"sadness": 1.5, "fear": 1.5, "anger": 0.7, "trust": 1.3},
    "higher_to_lower": {"anger": 1.2, "disgust": 1.2},
    "peer": {},
}


def likelihoods(spark: SparkSession) -> DataFrame:
    """(valence, emotion, ord, l0): 24 rows, normalised by valence."""
    rows = [(v, e, i, LIKELIHOOD[e][k]) for k, v in enumerate(("positive", "negative", "neutral")) for i, e in enumerate(EMOTIONS)]
    df = spark.createDataFrame(rows, "valence string, emotion string, ord int, l double")
    return df.select("valence", "emotion", "ord", (F.col("l") / F.sum("l").over(Window.partitionBy("valence"))).alias("l0"))


def priors(spark: SparkSession) -> DataFrame:
    """(power_relation, emotion, prior): 24 rows, normalised by power relation."""
    rows = [(r, e, f.get(e, 1.0) / len(EMOTIONS)) for r, f in PRIOR.items() for e in EMOTIONS]
    df = spark.createDataFrame(rows, "power_relation string, emotion string, p double")
    return df.select("power_relation", "emotion", (F.col("p") / F.sum("p").over(Window.partitionBy("power_relation"))).alias("prior"))


def literal(utterances: DataFrame) -> DataFrame:
    """(scenario_id, emotion, ord, l0) of every utterance."""
    return utterances.select("scenario_id", valence("utterance").alias("valence")).join(F.broadcast(likelihoods(utterances.sparkSession)), "valence").select("scenario_id", "emotion", "ord", "l0")


def pragmatic_table(spark: SparkSession, alpha: float = 1.0) -> DataFrame:
    """(valence, power_relation, emotion, ord, l0, l1): 72 rows; l1 is l0**alpha times the prior, uniform if all vanish."""
    j = likelihoods(spark).join(priors(spark), "emotion").withColumn("u", F.pow("l0", F.lit(alpha)) * F.col("prior"))
    total = F.sum("u").over(Window.partitionBy("valence", "power_relation"))
    return j.select("valence", "power_relation", "emotion", "ord", "l0", F.when(total > 0, F.col("u") / total).otherwise(1.0 / len(EMOTIONS)).alias("l1"))


def pragmatic(utterances: DataFrame, alpha: float = 1.0, vocabulary: str = "rsa") -> DataFrame:
    """(scenario_id, power_relation, emotion, ord, l0, l1) of every utterance; no window over the rows, the table is constant."""
    u = utterances.select("scenario_id", valence("utterance").alias("valence"), power_relation("speaker_role", "listener_role", vocabulary).alias("power_relation"))
    return u.join(F.broadcast(pragmatic_table(utterances.sparkSession, alpha)), ["valence", "power_relation"]).select("scenario_id", "power_relation", "emotion", "ord", "l0", "l1")


def listener_labels(utterances: DataFrame, alpha: float = 1.0) -> DataFrame:
    """(scenario_id, l0_label, l1_label): most likely labels, the first in label order of equals."""
    t = pragmatic_table(utterances.sparkSession, alpha).groupBy("valence", "power_relation").agg(F.max(F.struct("l0", (-F.col("ord")).alias("o"), "emotion"))["emotion"].alias("l0_label"), F.max(F.struct("l1", (-F.col("ord")).alias("o"), "emotion"))["emotion"].alias("l1_label"))
    u = utterances.select("scenario_id", valence("utterance").alias("valence"), power_relation("speaker_role", "listener_role", "rsa").alias("power_relation"))
    return u.join(F.broadcast(t), ["valence", "power_relation"]).select("scenario_id", "l0_label", "l1_label")


def alignment(predictions: DataFrame, utterances: DataFrame) -> DataFrame:
    """One row: kappa and mean agreement of predicted labels with each listener. A missing label is ``unknown``."""
    j = predictions.select("scenario_id", F.coalesce("emotion", F.lit("unknown")).alias("emotion")).join(listener_labels(utterances), "scenario_id")
    k = [cohen_kappa(j, "emotion", c).select(F.col("n").alias(f"n{i}"), F.col("kappa").alias(f"l{i}_kappa"), F.col("p_observed").alias(f"l{i}_agreement")) for i, c in enumerate(("l0_label", "l1_label"))]
    return k[0].join(F.broadcast(k[1])).select(F.col("n0").alias("n"), "l0_kappa", "l0_agreement", "l1_kappa", "l1_agreement")
