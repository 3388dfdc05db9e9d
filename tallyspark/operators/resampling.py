"""Bootstrap intervals: literal by hash at small sizes, and from sufficient counts at any size."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import kept
from . import sequence


def hash_pick(seed, draw, i, n) -> Column:
    """A number below n from the md5 of seed|draw|i; the same in every engine."""
    text = F.concat_ws("|", *[x if isinstance(x, Column) else F.lit(str(x)) for x in (seed, draw, i)])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % n


#: Picks that one task draws.
PICKS = 2_000_000
STATISTICS = {"mean": F.avg, "median": F.median, "std": F.stddev_pop}


def _medians(rows: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """(by, name): the median of each group, by counts of its values and running sums over them, which spill; no group is held in memory."""
    counts = rows.groupBy(*by, value).agg(F.count(value).alias("__c"))  # 0 of nulls
    w = Window.partitionBy(*by)
    upto = F.sum("__c").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.withColumns({"__upto": upto, "__n": F.sum("__c").over(w)})
    at = lambda rank: F.min(F.when(F.col("__upto") > rank, F.col(value)))
    return placed.groupBy(*by).agg(((at(F.floor((F.col("__n") - 1) / 2)) + at(F.floor(F.col("__n") / 2))) / 2).alias(name))


def hash_bootstrap(rows: DataFrame, group: str, value: str, key: str, draws: int = 100, seed: int = 42, statistic: str = "mean") -> DataFrame:
    """(group, draw, boot_mean): mean, median or std of literal resamples chosen by hash; for parity checks.

    Rows of a group are numbered by ``key``, which must be unique in it. Groups of any size are cut into ranges to be numbered; the
    picks, draws x rows of them, meet the values in hash joins of partitions: neither is broadcast.
    """
    placed = kept(sequence.numbered(rows.select(group, key, F.col(value).cast("double").alias("v")), group, key).select(group, "v", (F.col("position") - 1).cast("bigint").alias("i")))
    sizes = placed.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    # few rows become many picks, so tasks are counted by picks
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-placed.count() * draws // PICKS))
    picks = placed.select(group, "i").join(sizes, group).repartition(tasks).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).select(group, "draw", hash_pick(seed, F.col("draw"), F.col("i"), F.col("n")).alias("pick"))
    values = placed.select(F.col(group).alias("__g"), F.col("i").alias("j"), "v").hint("shuffle_hash")
    drawn = picks.join(values, (F.col(group) == F.col("__g")) & (F.col("pick") == F.col("j"))).select(group, "draw", "v")
    if statistic == "median":
        return _medians(drawn, [group, "draw"], "v", "boot_mean")
    return drawn.groupBy(group, "draw").agg(STATISTICS[statistic]("v").alias("boot_mean"))


def hash_permutation(rows: DataFrame, group: str, value: str, key: str, a: str, b: str, rounds: int = 100, seed: int = 42, statistic: str = "mean") -> DataFrame:
    """One row: difference of the two groups' statistic and the share of relabellings that reach it (no +1).

    In each round the rows with the smallest md5 of seed|round|key form the first group, in its size. Rows
    are multiplied by rounds, so this form is for small tables; 0/1 values have
    ``hypothesis.permutation_binary``, and means of any numbers ``relabelled_means``.
    """
    f = STATISTICS[statistic]
    x = rows.where(F.col(group).isin(a, b)).select((F.col(group) == a).alias("__a"), F.col(value).cast("double").alias("v"), F.col(key).cast("string").alias("k"))
    sizes = x.agg(F.sum(F.col("__a").cast("int")).alias("na"), F.count("*").alias("n"))
    seen = x.agg((f(F.when(F.col("__a"), F.col("v"))) - f(F.when(~F.col("__a"), F.col("v")))).alias("difference"))
    each = x.join(F.broadcast(sizes)).withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    at = F.row_number().over(Window.partitionBy("round").orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), "round", "k")), "k"))
    first = at <= F.col("na")
    perm = each.withColumn("first", first).groupBy("round").agg((f(F.when(F.col("first"), F.col("v"))) - f(F.when(~F.col("first"), F.col("v")))).alias("d"))
    out = perm.join(F.broadcast(seen)).agg(F.first("difference").alias("difference"), F.avg((F.abs("d") >= F.abs("difference") - 1e-12).cast("int")).alias("p_value"))
    return out


def _generator(seed: int, h: int) -> np.random.Generator:
    """Random numbers that depend on the seed and one hash alone."""
    return np.random.Generator(np.random.PCG64([seed, h & ((1 << 64) - 1)]))


def relabelled_means(rows: DataFrame, group: str, value: str, a: str, b: str, rounds: int = 1000, seed: int = 42) -> DataFrame:
    """One row: n_a, n_b, difference of means, p by random relabelling at any size.

    Each row joins the first group with chance n_a / n in each round. Equal values are counted
    first, so of m rows of a value a binomial number joins it, drawn from the seed and
    the value alone: order and partitioning of the rows don't matter. Only sums by round are shuffled then.
    """
    x = rows.where(F.col(group).isin(a, b)).select((F.col(group) == a).alias("a"), (F.col(value).cast("double") + F.lit(0.0)).alias("v")).where("v is not null")
    held = x.groupBy("v").agg(F.count("*").alias("m"), F.sum(F.col("a").cast("long")).alias("ma"))
    t = held.agg(F.sum("m").alias("n"), F.sum("ma").alias("na"), F.try_divide(F.sum(F.col("v") * F.col("ma")), F.sum("ma")).alias("mean_a"), F.try_divide(F.sum(F.col("v") * (F.col("m") - F.col("ma"))), F.sum(F.col("m") - F.col("ma"))).alias("mean_b"))
    share = t.select(F.try_divide(F.col("na").cast("double"), F.col("n")).alias("p"))

    def run(frames):
        s = np.zeros((4, rounds))
        for pdf in frames:
            for v, m, h, p in zip(pdf["v"].tolist(), pdf["m"].tolist(), pdf["h"].tolist(), pdf["p"].tolist()):
                first = _generator(seed, h).binomial(m, p, rounds)
                s += np.stack([first * v, first, (m - first) * v, m - first])
        yield pd.DataFrame({"round": np.arange(rounds), "sa": s[0], "na": s[1], "sb": s[2], "nb": s[3]})

    drawn = held.join(F.broadcast(share)).select("v", "m", F.xxhash64("v").alias("h"), "p").mapInPandas(run, "round long, sa double, na double, sb double, nb double")
    sums = drawn.groupBy("round").agg(*[F.sum(c).alias(c) for c in ("sa", "na", "sb", "nb")])
    d = sums.select((F.try_divide("sa", "na") - F.try_divide("sb", "nb")).alias("d"))
    seen = t.select(F.col("na").alias("n_a"), (F.col("n") - F.col("na")).alias("n_b"), (F.col("mean_a") - F.col("mean_b")).alias("difference"))
    return d.join(F.broadcast(seen)).groupBy("n_a", "n_b", "difference").agg(F.avg((F.abs("d") >= F.abs("difference")).cast("int")).alias("p_value"))


def interval(boot: DataFrame, group: str, alpha: float = 0.05, kind: str = "index") -> DataFrame:
    """(group, ci_lower, ci_upper) of boot_mean by group.

    ``index``: sorted values at int(alpha/2 N) and int((1 - alpha/2) N); ``percentile``: linear between neighbours.
    """
    if kind == "percentile":
        return boot.groupBy(group).agg(F.percentile("boot_mean", F.lit(alpha / 2)).alias("ci_lower"), F.percentile("boot_mean", F.lit(1 - alpha / 2)).alias("ci_upper"))
    s = F.array_sort(F.collect_list("boot_mean"))  # as many as draws
    at = lambda q: F.element_at(s, (F.least(F.floor(F.lit(q) * F.size(s)), F.size(s) - 1) + 1).cast("int"))
    return boot.groupBy(group).agg(at(alpha / 2).alias("ci_lower"), at(1 - alpha / 2).alias("ci_upper"))


def _bounds(x: np.ndarray, alpha: float, kind: str) -> tuple[float, float]:
    if kind == "percentile":
        return float(np.percentile(x, 50 * alpha)), float(np.percentile(x, 100 - 50 * alpha))
    x = np.sort(x)
    return float(x[int(alpha / 2 * len(x))]), float(x[min(len(x) - 1, int((1 - alpha / 2) * len(x)))])


def binary_bootstrap(rows: DataFrame, by: list[str], value: str, draws: int = 1000, alpha: float = 0.05, seed: int = 42, kind: str = "index") -> DataFrame:
    """Interval of the mean of 0/1 values by group, from (n, k) alone.

    A resample's number of ones is binomial, so the cost doesn't depend on the rows.
    Under two rows the interval is (0, 1).
    """
    counts = rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.col(value).cast("long")).alias("k"))
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by)

    def run(batches):
        for pdf in batches:
            lo, hi = [], []
            for i, (n, k) in enumerate(zip(pdf["n"], pdf["k"])):
                if n < 2:
                    a, b = 0.0, 1.0
                else:
                    rng = np.random.Generator(np.random.PCG64([seed, int(n), int(k)]))
                    a, b = _bounds(rng.binomial(n, k / n, draws) / n, alpha, kind)
                lo.append(a)
                hi.append(b)
            yield pdf.assign(mean=pdf["k"] / pdf["n"], ci_lower=lo, ci_upper=hi)[[*by, "n", "mean", "ci_lower", "ci_upper"]]

    return counts.mapInPandas(run, f"{kinds}{', ' if by else ''}n long, mean double, ci_lower double, ci_upper double")


def difference_bootstrap(rows: DataFrame, group: str, value: str, a: str, b: str, draws: int = 1000, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """One row: difference of two 0/1 means and d, each with an interval from independent resamples of (n, k)."""
    return difference_bootstraps(rows, group, value, [(a, b)], draws, alpha, seed).drop("first", "second")


def difference_bootstraps(rows: DataFrame, group: str, value: str, pairs: list[tuple[str, str]], draws: int = 1000, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """``difference_bootstrap`` of several pairs of groups, (first, second, ...), from one count of (n, k) by group."""
    names = sorted({g for pair in pairs for g in pair})
    counts = rows.where(F.col(group).isin(*names)).agg(*[F.count_if(F.col(group) == g).alias(f"n{i}") for i, g in enumerate(names)], *[F.count_if((F.col(group) == g) & (F.col(value) == 1)).alias(f"k{i}") for i, g in enumerate(names)])
    of = lambda c, g: F.col(f"{c}{names.index(g)}")
    each = F.array(*[F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), of("n", a).alias("na"), of("n", b).alias("nb"), of("k", a).alias("ka"), of("k", b).alias("kb")) for a, b in pairs])
    counts = counts.select(F.explode(each).alias("x")).select("x.*")

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                na, nb, ka, kb = (int(v) for v in (r.na, r.nb, r.ka, r.kb))
                if na < 2 or nb < 2:
                    gap = (ka / na if na else 0.0) - (kb / nb if nb else 0.0)
                    out.append((r.first, r.second, na, nb, gap, gap, gap, 0.0, -0.2, 0.2))
                    continue
                rng = np.random.Generator(np.random.PCG64(seed))
                p, q = np.r_[ka, rng.binomial(na, ka / na, draws)] / na, np.r_[kb, rng.binomial(nb, kb / nb, draws)] / nb
                gap = p - q
                s = np.sqrt((na * p * (1 - p) + nb * q * (1 - q)) / (na + nb - 2))
                d = np.divide(gap, s, out=np.zeros_like(gap), where=s > 0)
                out.append((r.first, r.second, na, nb, gap[0], *_bounds(gap[1:], alpha, "index"), d[0], *_bounds(d[1:], alpha, "index")))
            yield pd.DataFrame(out, columns=["first", "second", "n_a", "n_b", "difference", "ci_lower", "ci_upper", "d", "d_lower", "d_upper"])

    return counts.mapInPandas(run, "first string, second string, n_a long, n_b long, difference double, ci_lower double, ci_upper double, d double, d_lower double, d_upper double")


def paired_bootstrap(pairs: DataFrame, before: str, after: str, draws: int = 10_000, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """One row: mean difference of paired 0/1 values with p and interval, and paired d with interval.

    Differences are -1, 0 or 1, so a resample is multinomial in three counts.
    """
    diff = F.col(after) - F.col(before)
    counts = pairs.agg(*[F.coalesce(F.sum((diff == v).cast("long")), F.lit(0)).alias(n) for v, n in ((-1, "down"), (0, "same"), (1, "up"))])

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                k = np.array([r.down, r.same, r.up], float)
                n = int(k.sum())
                if n < 2:
                    out.append((n, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0))
                    continue
                m = np.vstack([k, np.random.Generator(np.random.PCG64(seed)).multinomial(n, k / n, draws)])
                mean = (m[:, 2] - m[:, 0]) / n
                sd = np.sqrt(np.maximum((m[:, 2] + m[:, 0] - n * mean**2) / (n - 1), 0))
                d = np.divide(mean, sd, out=np.zeros_like(mean), where=sd > 0)
                p = float(np.mean(np.abs(mean[1:] - mean[1:].mean()) >= abs(mean[0])))
                out.append((n, mean[0], p, *_bounds(mean[1:], alpha, "percentile"), d[0], *_bounds(d[1:], alpha, "index")))
            yield pd.DataFrame(out, columns=["n", "difference", "p_value", "ci_lower", "ci_upper", "d", "d_lower", "d_upper"])

    return counts.mapInPandas(run, "n long, difference double, p_value double, ci_lower double, ci_upper double, d double, d_lower double, d_upper double")


def numeric_bootstrap(rows: DataFrame, by: list[str], value: str, draws: int = 1000, alpha: float = 0.05, seed: int = 42, held: int = 500) -> DataFrame:
    """Interval of the mean of any numbers by group, by Poisson weights.

    Equal values of a group are counted first; the weights of m of them sum to a Poisson
    number of mean m, drawn from the seed, the group and the value alone, so order and partitioning of
    the rows don't matter. Each value adds to every draw's sums within its task, which
    holds the sums of at most ``held`` groups at once: what is shuffled is draws x groups for each task, never draws x rows.
    """
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by)

    def run(batches):
        sums: dict = {}

        def out():
            for key, s in sums.items():
                yield pd.DataFrame({**{c: pd.Series([k] * draws) for c, k in zip(by, key)}, "draw": np.arange(draws), "s": s[0], "w": s[1]})
            sums.clear()

        for pdf in batches:
            keys = zip(*[pdf[c].tolist() for c in by]) if by else [()] * len(pdf)
            for key, v, m, h in zip(keys, pdf["v"].tolist(), pdf["m"].tolist(), pdf["h"].tolist()):
                if key not in sums and len(sums) >= held:
                    yield from out()
                s = sums.setdefault(key, np.zeros((2, draws)))
                w = _generator(seed, h).poisson(m, draws)
                s[0] += w * v
                s[1] += w
        yield from out()

    counts = rows.select(*by, (F.col(value).cast("double") + F.lit(0.0)).alias("v")).where("v is not null").groupBy(*by, "v").agg(F.count("*").alias("m"))
    part = counts.withColumn("h", F.xxhash64(*by, "v")).mapInPandas(run, f"{kinds}{', ' if by else ''}draw long, s double, w double")
    boot = part.groupBy(*by, "draw").agg((F.sum("s") / F.nullif(F.sum("w"), F.lit(0.0))).alias("boot_mean"))
    return boot.groupBy(*by).agg(F.percentile("boot_mean", F.lit(alpha / 2)).alias("ci_lower"), F.percentile("boot_mean", F.lit(1 - alpha / 2)).alias("ci_upper"))
