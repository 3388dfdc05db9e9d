"""Hypothesis tests: statistics as aggregates; p-values only on the aggregated rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tails
from ..session import kept
from . import sequence


def with_p(stats: DataFrame, statistic: str = "chi2", df: str = "df") -> DataFrame:
    """Adds p_value of a chi-square statistic; 1 where there is no statistic or no degree of freedom."""
    return stats.withColumn("p_value", F.coalesce(tails.chi2_p(statistic, df), F.lit(1.0)))


def chi2_contingency(rows: DataFrame, a: str, b: str, n: str | None = None) -> DataFrame:
    """One row: n, df, chi2, v. Yates' correction holds where df is 1; cells without rows count. A row stands for ``n`` equal ones, if that is named."""
    cells = rows.groupBy(F.col(a).alias("x"), F.col(b).alias("y")).agg((F.count("*") if n is None else F.sum(n)).alias("o"))
    left, right = cells.groupBy("x").agg(F.sum("o").alias("nx")), cells.groupBy("y").agg(F.sum("o").alias("ny"))
    shape = left.agg(F.count("*").alias("r"), F.sum("nx").alias("n")).join(F.broadcast(right.agg(F.count("*").alias("c"))))
    # the grid of margins is categories x categories, never rows x rows
    grid = left.join(right).join(cells, ["x", "y"], "left").join(F.broadcast(shape))
    df = (F.col("r") - 1) * (F.col("c") - 1)
    e = F.col("nx").cast("double") * F.col("ny") / F.col("n")
    gap = F.abs(F.coalesce("o", F.lit(0)) - e)
    gap = F.when(df == 1, gap - F.least(F.lit(0.5), gap)).otherwise(gap)
    out = grid.agg(F.first("n").alias("n"), F.first(df).alias("df"), F.sum(gap * gap / e).alias("chi2"), F.first(F.least("r", "c") - 1).alias("k"))
    return out.select("n", "df", "chi2", F.when(F.col("k") == 0, 0.0).otherwise(F.sqrt(F.try_divide(F.col("chi2"), F.col("n") * F.col("k")))).alias("v"))


def chi2_fit(counts: DataFrame, observed: str = "observed", expected: str | None = None, rescale: bool = False) -> DataFrame:
    """One row: n, df, chi2, v of categories against expected counts (uniform if none are named).

    With ``rescale``, expected counts are brought to the observed total and v divides by df.
    """
    w = Window.partitionBy()  # over categories
    e = F.avg(observed).over(w) if expected is None else F.col(expected).cast("double")
    x = counts.select(F.col(observed).cast("double").alias("o"), e.alias("e"))
    if rescale:
        x = x.select("o", (F.col("e") * F.sum("o").over(w) / F.sum("e").over(w)).alias("e"))
    out = x.agg(F.sum("o").alias("n"), (F.count("*") - 1).alias("df"), F.sum((F.col("o") - F.col("e")) * (F.col("o") - F.col("e")) / F.col("e")).alias("chi2"))
    return out.select("n", "df", "chi2", F.sqrt(F.try_divide(F.col("chi2"), F.col("n") * (F.col("df") if rescale else F.lit(1)))).alias("v"))


def chi2_bonferroni(counts: DataFrame, expected: str, n_comparisons: int, alpha: float = 0.05) -> DataFrame:
    out = chi2_fit(counts, "observed", expected, rescale=True)
    return out.withColumn("alpha_corrected", F.lit(alpha / n_comparisons))


def bias_test(scored: DataFrame, label: str, n_labels: int, n: str | None = None) -> DataFrame:
    """Whether wrong predictions fall on ``label`` more than one time in n_labels - 1.

    Wrong rows whose gold is the label itself count only in total_wrong. A row stands for ``n`` equal ones, if that is named.
    """
    many = F.lit(1).cast("long") if n is None else F.col(n)
    wrong = scored.where("correct = 0")
    k = n_labels - 1
    agg = wrong.agg(F.coalesce(F.sum(many), F.lit(0)).alias("total_wrong"), F.sum((F.col("gold") != label).cast("int") * many).alias("n"), F.sum(((F.col("gold") != label) & (F.col("predicted") == label)).cast("int") * many).alias("hits"))
    o1, n = F.col("hits").cast("double"), F.col("n").cast("double")
    e1, e2 = n / k, n * (k - 1) / k
    chi = F.try_divide((o1 - e1) * (o1 - e1), e1) + F.try_divide((n - o1 - e2) * (n - o1 - e2), e2)
    out = agg.select("total_wrong", "n", "hits", e1.alias("expected_hits"), chi.alias("chi2"))
    return out.withColumn("v", F.sqrt(F.try_divide(F.col("chi2"), F.col("n")))).withColumn("error", F.when(F.coalesce("n", F.lit(0)) == 0, "no misclassified rows"))


def bias_by_gold(scored: DataFrame, label: str) -> DataFrame:
    wrong = scored.where((F.col("correct") == 0) & (F.col("gold") != label))
    hit = (F.col("predicted") == label).cast("int")
    return wrong.groupBy("gold").agg(F.count("*").alias("wrong"), F.sum(hit).alias("hits"), F.avg(hit).alias("rate"))


def group_difference(scored: DataFrame, by: str) -> DataFrame:
    """One row: groups, chi = sum (correct - expected)^2 / expected on correct counts, and the crude p of it.

    p = max(0.001, 1 - min(chi / (10 df), 0.999)); it is no chi-square p. Null with
    fewer than two groups or thirty rows.
    """
    per = scored.groupBy(by).agg(F.count("*").alias("n"), F.sum("correct").alias("k"))
    w = Window.partitionBy()
    e = F.col("n") * F.sum("k").over(w) / F.sum("n").over(w)
    out = per.select("n", "k", e.alias("e")).agg(F.count("*").alias("groups"), F.sum("n").alias("total"), F.sum(F.try_divide((F.col("k") - F.col("e")) * (F.col("k") - F.col("e")), F.col("e"))).alias("chi"))
    fine = (F.col("groups") >= 2) & (F.col("total") >= 30)
    p = F.greatest(F.lit(0.001), 1 - F.least(F.try_divide(F.col("chi"), 10.0 * (F.col("groups") - 1)), F.lit(0.999)))
    return out.select("groups", "total", F.when(fine, F.col("chi")).alias("chi"), F.when(fine, p).alias("p_crude"))


def mcnemar(pairs: DataFrame, before: str, after: str) -> DataFrame:
    """One row: b (lost), c (gained), chi2 with continuity correction, improvement; chi2 is 0 without discordant pairs."""
    x = pairs.agg(F.count("*").alias("n"), F.sum(((F.col(before) == 1) & (F.col(after) == 0)).cast("int")).alias("b"), F.sum(((F.col(before) == 0) & (F.col(after) == 1)).cast("int")).alias("c"), (F.avg(after) - F.avg(before)).alias("improvement"))
    gap = F.abs(F.col("b") - F.col("c")) - 1
    return x.select("n", "b", "c", F.coalesce(F.try_divide((gap * gap).cast("double"), F.col("b") + F.col("c")), F.lit(0.0)).alias("chi2"), "improvement")


def bonferroni(p_values: DataFrame, alpha: float = 0.05, p: str = "p") -> DataFrame:
    m = F.count("*").over(Window.partitionBy())
    return p_values.withColumn("p_adjusted", F.least(F.col(p) * m, F.lit(1.0))).withColumn("significant", F.col(p) < F.lit(alpha) / m)


def benjamini_hochberg(p_values: DataFrame, alpha: float = 0.05, p: str = "p", tie: str = "id") -> DataFrame:
    """p * m / rank, cumulated downwards from the largest p, at most 1.

    Tests are cut into ranges of (p, tie), each ranked by itself from what the ranges before it hold; the least of a range
    is carried down to those before it. Within a range the running minimum goes from the largest p, so each row is seen once.
    """
    ranged = sequence.segmented(p_values, p, tie)
    sizes = ranged.groupBy(F.col("__p").alias("__q")).agg(F.count(F.lit(1)).alias("__k"))
    before = Window.orderBy("__q").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    sizes = sizes.select("__q", F.coalesce(F.sum("__k").over(before), F.lit(0)).alias("__o"), F.sum("__k").over(Window.partitionBy()).alias("__m"))
    up = Window.partitionBy("__p").orderBy(p, tie)
    ranked = ranged.join(F.broadcast(sizes), F.col("__p") == F.col("__q")).drop("__q").withColumn("rank", (F.row_number().over(up) + F.col("__o")).cast("int"))
    ranked = ranked.withColumn("__raw", F.col(p) * F.col("__m") / F.col("rank"))
    after = Window.orderBy(F.desc("__q")).rowsBetween(Window.unboundedPreceding, -1)
    least = ranked.groupBy(F.col("__p").alias("__q")).agg(F.min("__raw").alias("__least")).select("__q", F.min("__least").over(after).alias("__after"))
    down = F.min("__raw").over(Window.partitionBy("__p").orderBy(F.desc("rank")).rowsBetween(Window.unboundedPreceding, 0))
    out = ranked.join(F.broadcast(least), F.col("__p") == F.col("__q")).withColumn("p_adjusted", F.least(down, "__after", F.lit(1.0)))
    return out.withColumn("significant", F.col("p_adjusted") < alpha).select(*[F.col(f"`{c}`") for c in p_values.columns], "rank", "p_adjusted", "significant")


def _correlation(x: str, y: str) -> Column:
    """Pearson's correlation; null where a side is constant."""
    return F.try_divide(F.regr_sxy(y, x), F.sqrt(F.regr_sxx(y, x) * F.regr_syy(y, x)))


def correlations(pairs: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """One row: n, pearson, spearman (ranks average over ties). Null under three rows and where a side is constant.

    Ranks come from value histograms: distinct values and running counts, not a sort of all rows in one task.
    """
    pairs = kept(pairs.select(x, y))  # read for both ranks and their correlation
    ranks = [_average_ranks(pairs, c) for c in (x, y)]
    ranked = pairs.select(x, y).join(ranks[0], x).join(ranks[1], y)
    out = ranked.agg(F.count("*").alias("n"), _correlation(x, y).alias("pearson"), _correlation(f"rank_{x}", f"rank_{y}").alias("spearman"))
    return out.select("n", *[F.when(F.col("n") >= 3, F.col(c)).alias(c) for c in ("pearson", "spearman")])


def _average_ranks(rows: DataFrame, c: str) -> DataFrame:
    from .effects import running_counts

    h = running_counts(rows.groupBy(c).agg(F.count("*").alias("n")), c, ["n"])
    return h.select(c, (F.col("before_n") + (F.col("n") + 1) / 2.0).alias(f"rank_{c}"))


def with_correlation_p(row: DataFrame) -> DataFrame:
    return row.withColumn("pearson_p", tails.correlation_p("pearson", "n")).withColumn("spearman_p", tails.correlation_p("spearman", "n"))


def with_slope_p(row: DataFrame) -> DataFrame:
    """Adds p_value of a regression's slope being other than 0; null under three rows, 0 of points on a line that rises or falls."""
    t = F.try_divide("slope", "stderr")
    p = F.when(F.col("stderr") == 0, F.when(F.col("slope") == 0, F.lit(1.0)).otherwise(0.0)).otherwise(tails.t_p(t, F.col("n") - 2))
    return row.withColumn("p_value", p)


def linear_regression(pairs: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """One row: n, slope, intercept, r, stderr of the slope. Null under two rows."""
    out = pairs.agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), _correlation(x, y).alias("r"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"))
    se = F.sqrt(F.try_divide((1 - F.col("r") * F.col("r")) * F.col("syy"), (F.col("n") - 2) * F.col("sxx")))
    return out.select("n", *[F.when(F.col("n") >= 2, F.col(c)).alias(c) for c in ("slope", "intercept", "r")], F.when(F.col("n") > 2, se).alias("stderr"))


def permutation_binary(groups: DataFrame, group: str, value: str, first: str, second: str, rounds: int = 10_000, seed: int = 42) -> DataFrame:
    """Permutation test of the difference of means of 0/1 values; p without the +1.

    Under permutation the ones of the first group are hypergeometric, so only
    four counts leave Spark's aggregation.
    """
    counts = groups.where(F.col(group).isin(first, second)).agg(*[F.sum(((F.col(group) == g) & ok).cast("int")).alias(n) for g, ok, n in ((first, F.lit(True), "na"), (second, F.lit(True), "nb"), (first, F.col(value) == 1, "ka"), (second, F.col(value) == 1, "kb"))])

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.fillna(0).itertuples():
                na, nb, ka, kb = (int(v) for v in (r.na, r.nb, r.ka, r.kb))
                if not na or not nb:
                    out.append((na, nb, None, None))
                    continue
                rng = np.random.Generator(np.random.PCG64(seed))
                k = rng.hypergeometric(ka + kb, na + nb - ka - kb, na, rounds)
                diff = k / na - (ka + kb - k) / nb
                seen = ka / na - kb / nb
                out.append((na, nb, seen, float(np.mean(np.abs(diff) >= abs(seen) - 1e-15))))
            yield pd.DataFrame(out, columns=["n_a", "n_b", "difference", "p_value"])

    return counts.mapInPandas(run, "n_a long, n_b long, difference double, p_value double")
