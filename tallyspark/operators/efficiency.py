"""Efficiency, anchoring, calibration and power-stratified metrics."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import kept
from .effects import gap_of
from .resampling import binary_bootstrap, difference_bootstraps


def efficiency_ratio(scored: DataFrame, human: float = 0.82, human_ci: tuple[float, float] = (0.78, 0.86)) -> DataFrame:
    """One row: model accuracy against a given human accuracy; the ratio is 0 if that is 0."""
    t = scored.agg(F.count("*").alias("n"), F.avg("correct").alias("model_accuracy"))
    ratio = F.col("model_accuracy") / human if human else F.lit(0.0)
    return t.select("n", "model_accuracy", F.lit(human).alias("human_accuracy"), F.lit(human_ci[0]).alias("human_lower"), F.lit(human_ci[1]).alias("human_upper"), ratio.alias("ratio"))


def efficiency_interval(scored: DataFrame, human: float = 0.82, draws: int = 1000) -> DataFrame:
    """The ratio with a bootstrap interval of the accuracy, scaled by the human point value."""
    b = binary_bootstrap(scored, [], "correct", draws)
    f = (lambda c: F.col(c) / human) if human else (lambda c: F.lit(0.0))
    return b.select("n", f("mean").alias("ratio"), f("ci_lower").alias("ci_lower"), f("ci_upper").alias("ci_upper"))


def anchoring(original: DataFrame, recombined: DataFrame, key: str = "key", label: str = "label") -> DataFrame:
    """One row: share of labels that change when the context does (sensitivity), and one minus it (anchoring)."""
    j = original.select(key, F.col(label).alias("a")).join(recombined.select(key, F.col(label).alias("b")), key)
    s = F.avg((~F.col("a").eqNullSafe(F.col("b"))).cast("double"))
    return j.agg(F.count("*").alias("n"), s.alias("sensitivity"), (1 - s).alias("anchoring"))


def calibration_bins(n: int) -> list[float]:
    """Upper edges of equal bins as n steps of 1/n give them in doubles."""
    return [i * (1.0 / n) if i < n else 1.0 for i in range(n + 1)]


def _bin(conf: Column, n_bins: int) -> Column:
    return sum(((conf > F.lit(e)).cast("int") for e in calibration_bins(n_bins)), F.lit(0)) - 1


def calibration(scored: DataFrame, n_bins: int = 10) -> DataFrame:
    """One row a filled bin (lo, hi]: n, accuracy, mean confidence, gap. A missing confidence is 1; 0 is in no bin."""
    conf = F.coalesce(F.col("confidence"), F.lit(1.0))
    b = _bin(conf, n_bins)
    x = scored.select("correct", conf.alias("conf"), b.alias("bin")).where((F.col("conf") > 0) & (F.col("conf") <= 1))
    return x.groupBy("bin").agg(F.count("*").alias("n"), F.avg("correct").alias("accuracy"), F.avg("conf").alias("mean_confidence")).withColumn("gap", F.abs(F.col("accuracy") - F.col("mean_confidence")))


def expected_calibration_error(scored: DataFrame, n_bins: int = 10) -> DataFrame:
    """One row: n (all rows, those in no bin too) and the weighted mean gap of the bins."""
    total = scored.agg(F.count("*").alias("n"))
    s = calibration(scored, n_bins).agg(F.coalesce(F.sum(F.col("n") * F.col("gap")), F.lit(0.0)).alias("s"))
    return total.join(F.broadcast(s)).select("n", F.coalesce(F.try_divide("s", "n"), F.lit(0.0)).alias("ece"))


def power_stratified(scored: DataFrame, n: str | None = None) -> DataFrame:
    """Accuracy overall, by power and by power x subtype, in one pass; rows of unknown power are dropped. A row stands for ``n`` equal ones, if that is named."""
    known = scored.where(F.col("power_relation").isin("peer", "higher_to_lower", "lower_to_higher"))
    many = F.lit(1).cast("long") if n is None else F.col(n)
    cells = known.groupBy("power_relation", "subtype").agg(F.sum(many).alias("__n"), F.sum(F.col("correct") * many).alias("__k"))
    g = cells.groupingSets([["power_relation"], ["power_relation", "subtype"], []], "power_relation", "subtype")
    out = g.agg(F.grouping_id("power_relation", "subtype").alias("gset"), F.coalesce(F.sum("__n"), F.lit(0)).alias("n"), F.sum("__k").alias("__k"))
    return out.select("gset", "power_relation", "subtype", "n", F.try_divide("__k", "n").alias("accuracy"))


def power_comparisons(scored: DataFrame) -> DataFrame:
    """Difference of accuracy, d and intervals for the three ordered pairs of power relations."""
    pairs = combinations(("peer", "higher_to_lower", "lower_to_higher"), 2)
    return difference_bootstraps(scored, "power_relation", "correct", list(pairs))


def relative_layers(layers: DataFrame) -> DataFrame:
    """Peak layer of each model (highest accuracy, of equals the first) and where it lies between first and last."""
    w = Window.partitionBy("model_id")
    x = layers.withColumn("__last", F.max("layer").over(w))
    best = x.groupBy("model_id").agg(F.max(F.struct("accuracy", (-F.col("layer")).alias("l"), "__last")).alias("b"))
    return best.select("model_id", (-F.col("b.l")).alias("peak_layer"), F.col("b.accuracy").alias("accuracy"), F.coalesce(F.try_divide(-F.col("b.l").cast("double"), F.col("b.__last")), F.lit(0.0)).alias("position"))


def all_metrics(scored: DataFrame, human: float = 0.82, n_bins: int = 10) -> DataFrame:
    """(metric, value, n): efficiency ratio, calibration error, power gap with d, and accuracy by power and subtype, in one long table."""
    row = lambda df, metric, value, n="n": df.select(F.lit(metric).alias("metric"), F.col(value).alias("value"), F.col(n).alias("n"))
    conf = F.coalesce(F.col("confidence"), F.lit(1.0))
    # every metric is one of these counts, for which the rows are read once; a confidence in no bin has none
    held = F.when((conf > 0) & (conf <= 1), _bin(conf, n_bins)).alias("bin")
    x = scored.select("power_relation", "subtype", "correct", held, F.col("correct").alias("hit"), conf.alias("conf"))
    sets = x.groupingSets([["power_relation", "subtype", "correct"], ["bin"]], "power_relation", "subtype", "correct", "bin")
    both = kept(sets.agg(F.grouping("bin").alias("whole"), F.count("*").alias("n"), F.avg("hit").alias("accuracy"), F.avg("conf").alias("mean_confidence")))
    cells, bins = both.where("whole = 1"), both.where("whole = 0 and bin is not null")
    hits, told = F.col("correct") * F.col("n"), F.when(F.col("correct").isNotNull(), F.col("n"))
    mean = lambda k, n: F.try_divide(F.sum(k).cast("double"), F.sum(n))
    total = cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), mean(hits, told).alias("accuracy"))
    ratio = total.select("n", (F.col("accuracy") / human if human else F.lit(0.0)).alias("ratio"))
    off = bins.agg(F.coalesce(F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("mean_confidence"))), F.lit(0.0)).alias("off"))
    error = total.join(F.broadcast(off)).select("n", F.coalesce(F.try_divide("off", "n"), F.lit(0.0)).alias("ece"))
    two = []
    for g, power in (("a", "peer"), ("b", "lower_to_higher")):
        here = F.col("power_relation") == power
        k, n, squares = F.when(here, hits), F.when(here, told), F.when(here, F.col("correct") * hits)
        two += [F.coalesce(F.sum(n), F.lit(0)).alias(f"n_{g}"), mean(k, n).alias(f"m_{g}"), (mean(squares, n) - mean(k, n) * mean(k, n)).alias(f"vp_{g}")]
    gap = gap_of(cells.agg(*two)).withColumn("n", F.col("n_a") + F.col("n_b"))
    named = power_stratified(cells, "n").select(F.concat_ws("/", F.lit("accuracy"), F.coalesce("power_relation", F.lit("all")), "subtype").alias("metric"), F.col("accuracy").alias("value"), "n")
    out = row(ratio, "efficiency_ratio", "ratio").unionByName(row(error, "ece", "ece"))
    return out.unionByName(row(gap, "power_gap", "gap")).unionByName(row(gap, "power_gap_d", "d")).unionByName(named)


def quadrant(by_subtype_accuracy: DataFrame, classes: DataFrame) -> DataFrame:
    """Human agreement against model accuracy by scenario's subtype, in percent; 50 where a subtype has no accuracy."""
    j = classes.join(by_subtype_accuracy.select("subtype", (F.col("accuracy") * 100).alias("acc")), "subtype", "left")
    acc = F.coalesce("acc", F.lit(50.0))
    name = F.concat(F.when(F.col("percent") >= 50, "easy for humans").otherwise("hard for humans"), F.when(acc >= 50, ", easy for models").otherwise(", hard for models"))
    return j.groupBy("subtype", name.alias("quadrant")).agg(F.count("*").alias("n"))
