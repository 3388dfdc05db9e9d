"""Agreement among raters and between two labellings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import kappa_band


def _counts(ratings: DataFrame) -> DataFrame:
    """One row a subject: raters, most of one label, distinct labels. Blank labels don't count."""
    per = ratings.where("cat is not null and cat <> ''").groupBy("subject", "cat").agg(F.count("*").alias("n"))
    return per.groupBy("subject").agg(F.sum("n").alias("raters"), F.max("n").alias("most"), F.count("*").alias("labels"), F.sum(F.col("n") * F.col("n")).alias("squares"))


def agreement_rate(ratings: DataFrame) -> DataFrame:
    """Share of subjects with two or more labels whose most common label has at least half of them."""
    c = _counts(ratings).where("raters >= 2")
    return c.agg(F.count("*").alias("subjects"), F.sum((F.col("most") >= 0.5 * F.col("raters")).cast("int")).alias("agreeing"), F.avg((F.col("most") >= 0.5 * F.col("raters")).cast("int")).alias("agreement_rate"))


def agreement_class(ratings: DataFrame) -> DataFrame:
    """full, partial or none for each subject, and 100, 50 or 0."""
    c = _counts(ratings)
    kind = F.when(F.col("most") == F.col("raters"), "full").when(F.col("most") > 1, "partial").otherwise("none")
    return c.select("subject", kind.alias("agreement"), F.when(kind == "full", 100).when(kind == "partial", 50).otherwise(0).alias("percent"))


def majority_vote(ratings: DataFrame) -> DataFrame:
    """The most common label of each subject; of equals the first in alphabetical order (our choice)."""
    per = ratings.where("cat is not null and cat <> ''").groupBy("subject", "cat").agg(F.count("*").alias("n"))
    best = per.groupBy("subject").agg(F.min(F.struct((-F.col("n")).alias("m"), "cat")).alias("b"))
    return best.select("subject", F.col("b.cat").alias("label"), (-F.col("b.m")).alias("votes"))


def fleiss_kappa(ratings: DataFrame) -> DataFrame:
    """One row: subjects, raters, p_observed, p_expected, kappa, interpretation.

    The number of raters is that of the first subject by id, as every subject should have the same.
    """
    per = ratings.groupBy("subject", "cat").agg(F.count("*").alias("n"))
    subj = per.groupBy("subject").agg(F.sum("n").alias("r"), F.sum(F.col("n") * F.col("n")).alias("sq"))
    first = subj.agg(F.min_by("r", "subject").alias("raters"))
    obs = subj.join(F.broadcast(first)).agg(F.count("*").alias("subjects"), F.first("raters").alias("raters"), F.avg((F.col("sq") - F.col("raters")) / (F.col("raters") * (F.col("raters") - 1))).alias("p_observed"))
    share = per.groupBy("cat").agg(F.sum("n").alias("m"))
    share = share.select((F.col("m") / F.sum("m").over(Window.partitionBy())).alias("p")).agg(F.sum(F.col("p") * F.col("p")).alias("p_expected"))
    kappa = F.when(F.col("p_expected") == 1, 1.0).otherwise((F.col("p_observed") - F.col("p_expected")) / F.nullif(1 - F.col("p_expected"), F.lit(0.0)))
    return obs.join(F.broadcast(share)).withColumn("kappa", kappa).withColumn("interpretation", kappa_band("kappa"))


def simple_kappa(classes: DataFrame, by: str, n_labels: int = 8) -> DataFrame:
    """Chance-corrected agreement by stratum and overall, chance 1 / n_labels.

    ``classes``: ``by``, agreement. A stratum counts partial agreement half; the overall
    row counts full agreement only. Strata without rows don't appear.
    """
    pe = 1.0 / n_labels
    n = lambda kind: F.sum((F.col("agreement") == kind).cast("int"))
    sets = classes.groupingSets([[F.col(by)], []], F.col(by)).agg(F.grouping_id(by).alias("overall"), F.count("*").alias("total"), n("full").alias("full"), n("partial").alias("partial"))
    po = F.when(F.col("overall") == 1, F.col("full") / F.col("total")).otherwise((F.col("full") + 0.5 * F.col("partial")) / F.col("total"))
    return sets.where("total > 0").select("overall", by, "total", "full", "partial", ((po - pe) / (1 - pe)).alias("kappa"))


def kappa_extremes(kappas: DataFrame, by: str) -> DataFrame:
    k = kappas.where("overall = 0")
    return k.agg(F.min("kappa").alias("min_kappa"), F.max("kappa").alias("max_kappa"), F.min(F.struct("kappa", by))[by].alias("lowest"), F.max(F.struct("kappa", by))[by].alias("highest"))


def cohen_kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, p_observed, p_expected, kappa of two labellings; 0 if empty, and 1 or 0 if chance is certain."""
    cells = pairs.groupBy(F.col(a).alias("x"), F.col(b).alias("y")).agg(F.count("*").alias("n"))
    total = cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("x") == F.col("y"), F.col("n")).otherwise(0)), F.lit(0)).alias("same"))
    left, right = cells.groupBy("x").agg(F.sum("n").alias("nx")), cells.groupBy("y").agg(F.sum("n").alias("ny"))
    chance = left.join(right, F.col("x") == F.col("y")).agg(F.coalesce(F.sum(F.col("nx").cast("double") * F.col("ny")), F.lit(0.0)).alias("e"))
    t = total.join(F.broadcast(chance))
    po, pe = F.try_divide(F.col("same").cast("double"), F.col("n")), F.try_divide(F.col("e"), F.col("n").cast("double") * F.col("n"))
    kappa = F.when(F.col("n") == 0, 0.0).when(pe == 1, F.when(po == 1, 1.0).otherwise(0.0)).otherwise((po - pe) / F.nullif(1 - pe, F.lit(0.0)))
    return t.select("n", F.coalesce(po, F.lit(0.0)).alias("p_observed"), F.coalesce(pe, F.lit(0.0)).alias("p_expected"), kappa.alias("kappa"))
