"""Effect sizes from aggregates and value histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import kept


def _two(rows: DataFrame, group: str, value: str, a: str, b: str) -> DataFrame:
    x, y = F.when(F.col(group) == a, F.col(value)), F.when(F.col(group) == b, F.col(value))
    return rows.where(F.col(group).isin(a, b)).agg(*[f(v).alias(f"{n}_{g}") for g, v in (("a", x), ("b", y)) for n, f in (("n", F.count), ("m", F.avg), ("vs", F.var_samp), ("vp", F.var_pop), ("sd", F.stddev_samp))])


def cohens_d(rows: DataFrame, group: str, value: str, a: str, b: str, pooled: bool = True) -> DataFrame:
    """One row: d over the pooled sample deviation, or over that of the first group; null where that is zero."""
    t = _two(rows, group, value, a, b)
    s = F.sqrt(F.try_divide((F.col("n_a") - 1) * F.col("vs_a") + (F.col("n_b") - 1) * F.col("vs_b"), F.col("n_a") + F.col("n_b") - 2)) if pooled else F.col("sd_a")
    return t.select("n_a", "n_b", F.try_divide(F.col("m_a") - F.col("m_b"), s).alias("d"))


def cohens_d_safe(rows: DataFrame, group: str, value: str, a: str, b: str) -> DataFrame:
    """As cohens_d, but 0 for an empty group or no deviation."""
    return cohens_d(rows, group, value, a, b).withColumn("d", F.coalesce("d", F.lit(0.0)))


def power_gap(scored: DataFrame) -> DataFrame:
    """Peer against lower_to_higher accuracy: gap, fixed interval of 0.05, and d over population variances weighted by n - 1.

    higher_to_lower rows are left out, as in the definition this follows.
    """
    return gap_of(_two(scored, "power_relation", "correct", "peer", "lower_to_higher"))


def gap_of(t: DataFrame) -> DataFrame:
    """``power_gap`` of two groups' sizes, means and population variances (n_a, m_a, vp_a, n_b, m_b, vp_b)."""
    s = F.sqrt(F.try_divide((F.col("n_a") - 1) * F.col("vp_a") + (F.col("n_b") - 1) * F.col("vp_b"), F.col("n_a") + F.col("n_b") - 2))
    gap = F.coalesce("m_a", F.lit(0.0)) - F.coalesce("m_b", F.lit(0.0))
    d = F.coalesce(F.try_divide(gap, s), F.lit(0.0))
    return t.select("n_a", "n_b", gap.alias("gap"), (gap - 0.05).alias("ci_lower"), (gap + 0.05).alias("ci_upper"), d.alias("d"), (d - 0.2).alias("d_lower"), (d + 0.2).alias("d_upper"))


def bucketed(df: DataFrame, value: str, buckets: int = 200) -> DataFrame:
    """Adds __b: which of the table's own quantiles a numeric value lies above, so that buckets are in order of it."""
    at = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    bounds = df.agg(F.array_distinct(F.percentile_approx(F.col(value).cast("double"), at, F.lit(10_000))).alias("__bounds"))
    placed = df.join(F.broadcast(bounds)).withColumn("__b", F.lit(0))  # one row
    step = 1 << (buckets.bit_length() - 1)
    while step:  # bounds below the value, by halving
        placed = placed.withColumn("__b", F.col("__b") + F.when(F.get("__bounds", F.col("__b") + (step - 1)) < F.col(value), step).otherwise(0))
        step >>= 1
    return placed.drop("__bounds")


def running_counts(hist: DataFrame, value: str, counts: list[str]) -> DataFrame:
    """Adds before_<c>: the sum of c over smaller values, of a histogram with one row a value.

    Each bucket of values sums within itself and adds what the buckets before it hold. The
    histogram is read for its bounds, sizes and rows, so it is computed once and kept.
    """
    hist = kept(hist)
    ranged = bucketed(hist, value)
    inside = Window.partitionBy("__b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    per = ranged.groupBy("__b").agg(*[F.sum(c).alias(f"__t_{c}") for c in counts])
    earlier = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select(F.col("__b").alias("__p"), *[F.coalesce(F.sum(f"__t_{c}").over(earlier), F.lit(0)).alias(f"__o_{c}") for c in counts])
    out = ranged.join(F.broadcast(offsets), F.col("__b") == F.col("__p"))  # one row for each bucket
    return out.select(*hist.columns, *[(F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"__o_{c}")).alias(f"before_{c}") for c in counts])


def cliffs_delta(rows: DataFrame, group: str, value: str, a: str, b: str) -> DataFrame:
    """One row: (#a>b - #a<b) / (n_a n_b) by a histogram of values; no pair is formed."""
    hist = rows.where(F.col(group).isin(a, b)).groupBy(value).agg(F.sum((F.col(group) == a).cast("long")).alias("na"), F.sum((F.col(group) == b).cast("long")).alias("nb"))
    c = running_counts(hist, value, ["nb"])
    t = c.agg(F.sum("na").alias("n_a"), F.sum("nb").alias("n_b"), F.sum(F.col("na").cast("double") * (2 * F.col("before_nb") + F.col("nb"))).alias("s"))
    return t.select("n_a", "n_b", F.try_divide(F.col("s") - F.col("n_a").cast("double") * F.col("n_b"), F.col("n_a").cast("double") * F.col("n_b")).alias("delta"))


def paired_d(pairs: DataFrame, before: str, after: str) -> DataFrame:
    """One row: mean difference over its sample deviation; 0 without deviation."""
    diff = F.col(before) - F.col(after)
    t = pairs.agg(F.count("*").alias("n"), F.avg(diff).alias("mean_diff"), F.stddev_samp(diff).alias("sd"))
    return t.select("n", "mean_diff", F.coalesce(F.try_divide(F.col("mean_diff"), F.col("sd")), F.lit(0.0)).alias("d"))
