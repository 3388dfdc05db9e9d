"""Resampling and relabelling down a tree of value counts: exact in the sizes, for means, deviations and medians, at any number of rows.

Equal values are counted once. A resample of n rows is then a multinomial draw over the counts, a relabelling a multivariate hypergeometric one, and
both can be drawn by halves: how many of a node's rows fall into its left half is one binomial (hypergeometric) number. A median
needs only the halves on its way down; sums need all of them. No row is ever copied, and a draw depends on the seed, the values and
their counts alone, not on order or partitions.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from ..session import kept

#: Bits of a value's key that a level of the tree tells apart; different values of a node from which they are its children themselves.
DIGIT, LEAF = 10, 1024
#: NumPy draws hypergeometric numbers up to so many rows; beyond, their normal limit is used.
EXACT = 10**9
STATISTICS = ("mean", "std", "median")
_ALL = (1 << 64) - 1


def _keys(v: np.ndarray) -> np.ndarray:
    """Integers in the order of doubles."""
    bits = v.view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)


def _values(keys: np.ndarray) -> np.ndarray:
    return np.where(keys < 0, keys ^ np.int64(0x7FFFFFFFFFFFFFFF), keys).view(np.float64)


def _weight(n: str | None) -> Column:
    return F.lit(1).cast("long") if n is None else F.col(n)


def value_counts(rows: DataFrame, group: Column, value: str, first: Column, n: str | None = None) -> DataFrame:
    """(g, key, m, ma): rows of each value and how many of them are ``first``. Null values are left out, -0.0 is 0.0, NaN the largest value.

    A row stands for ``n`` equal ones, if that is named.
    """
    x = rows.select(group.alias("g"), (F.col(value).cast("double") + F.lit(0.0)).alias("v"), _weight(n).alias("n"), first.cast("long").alias("f")).where("v is not null")
    counts = x.groupBy("g", "v").agg(F.sum("n").alias("m"), F.sum(F.col("f") * F.col("n")).alias("ma"))
    schema = StructType([counts.schema["g"]]).add("key", LongType()).add("m", LongType()).add("ma", LongType())

    def run(batches: Iterable[pa.RecordBatch]):
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array(_keys(b.column(1).to_numpy(zero_copy_only=False))), b.column(2), b.column(3)], names=["g", "key", "m", "ma"])

    return counts.mapInArrow(run, schema)


def _half(rng: np.random.Generator, take: np.ndarray, left: int, right: int, replace: bool) -> np.ndarray:
    """How many of ``take`` rows of a node fall into its left half, which has ``left`` of its rows."""
    total = left + right
    if replace:
        return rng.binomial(take, left / total)
    if total < EXACT:
        return rng.hypergeometric(left, right, take)
    mean = take * (left / total)
    spread = np.sqrt(mean * (right / total) * ((total - take) / (total - 1)))
    return np.clip(np.rint(rng.normal(mean, spread)).astype(np.int64), np.maximum(0, take - right), np.minimum(left, take))


def _down(m: np.ndarray, ma: np.ndarray, draw: np.ndarray, side: np.ndarray, rank: np.ndarray, take: np.ndarray, seeds: list[int], replace: bool):
    """(child, states, rank, take) for each child of a node that states reach: by their rank, or all of them where rank is -1.

    Draw 0 is the data itself: its rows fall as they are.
    """
    below, below_a = np.r_[0, np.cumsum(m)], np.r_[0, np.cumsum(ma)]
    stack = [(0, len(m), np.arange(len(draw)), rank, take)]
    while stack:
        lo, hi, at, r, t = stack.pop()
        if hi - lo == 1:
            yield lo, at, r, t
            continue
        mid = (lo + hi) // 2
        left, right = int(below[mid] - below[lo]), int(below[hi] - below[mid])
        # the ranks of one draw see the same halves
        each, first, back = np.unique(draw[at], return_index=True, return_inverse=True)
        x = _half(np.random.Generator(np.random.PCG64([*seeds, lo, hi])), t[first], left, right, replace)
        x = np.where(each == 0, below_a[mid] - below_a[lo], x)[back]
        here = np.where(side[at] == 0, x, left - x)
        go = (r < here) & (r >= 0)
        for into, pick, r2, t2 in (((lo, mid), go | (r < 0), r, x), ((mid, hi), ~go, np.where(r < 0, r, r - here), t - x)):
            if pick.any():
                stack.append((*into, at[pick], r2[pick], t2[pick]))


def _tree(counts: DataFrame, states: DataFrame, seed: int, replace: bool) -> DataFrame:
    """(g, draw, side, s0, s1, s2) from states (g, h, c, node, draw, side, rank, take), one row of arrays for each node reached.

    Of a rank, s1 is its value. Else s0, s1, s2 are sums over a node's values of the rows taken, times (value - c) to the power of 0, 1, 2.
    A level tells apart the next digits of the values' keys, or the values where a node has few. It reads what lies in the nodes that states have reached.
    """
    kind = counts.schema["g"]
    rest = StructType.fromDDL("h bigint, c double, leaf boolean, node bigint, draw array<int>, side array<int>, rank array<bigint>, take array<bigint>, s0 array<double>, s1 array<double>, s2 array<double>")
    schema = StructType([kind, *rest.fields])

    def run(level: int):
        def step(batches: Iterable[pa.RecordBatch]):
            for b in batches:
                out = {n: [] for n in schema.names}
                for i in range(b.num_rows):
                    row = {n: b.column(n)[i].as_py() for n in b.schema.names}
                    keys, m, ma, draw, side, rank, take = (np.array(row[n], np.int64) for n in ("kids", "m", "ma", "draw", "side", "rank", "take"))
                    v = _values(keys) - row["c"] if row["leaf"] else None
                    sums = np.zeros((3, len(draw)))
                    found = _down(m, ma, draw, side, rank, take, [seed, row["h"] & _ALL, level, row["node"] & _ALL], replace)
                    for child, at, r, t in found:
                        if row["leaf"]:
                            ranked, s = r >= 0, t * v[child]
                            sums[0, at] += t
                            sums[1, at] = np.where(ranked, v[child] + row["c"], sums[1, at] + s)
                            sums[2, at] += s * v[child]
                        else:
                            for n, x in (("g", row["g"]), ("h", row["h"]), ("c", row["c"]), ("leaf", False), ("node", int(keys[child])), ("draw", draw[at]), ("side", side[at]), ("rank", r), ("take", t), *((s, []) for s in ("s0", "s1", "s2"))):
                                out[n].append(x)
                    if row["leaf"]:
                        for n, x in (("g", row["g"]), ("h", row["h"]), ("c", row["c"]), ("leaf", True), ("node", row["node"]), ("draw", draw), ("side", side), ("rank", []), ("take", []), *zip(("s0", "s1", "s2"), sums)):
                            out[n].append(x)
                types = {"g": b.schema.field("g").type, "h": pa.int64(), "c": pa.float64(), "leaf": pa.bool_(), "node": pa.int64(), "draw": pa.list_(pa.int32()), "side": pa.list_(pa.int32()), "rank": pa.list_(pa.int64()), "take": pa.list_(pa.int64()), **{s: pa.list_(pa.float64()) for s in ("s0", "s1", "s2")}}
                yield pa.record_batch([pa.array(out[n], types[n]) for n in schema.names], names=schema.names)

        return step

    done, level = [], 0
    while True:
        node = F.lit(0).cast("bigint") if level == 0 else F.shiftright("key", 64 - DIGIT * level)
        inside = counts.withColumn("node", node).join(states.select("g", "node"), ["g", "node"], "left_semi")
        sizes = inside.groupBy("g", "node").agg((F.count(F.lit(1)) <= LEAF).alias("leaf"))
        child = F.when(F.col("leaf"), F.col("key")).otherwise(F.shiftright("key", max(0, 64 - DIGIT * (level + 1))))
        kids = inside.join(sizes, ["g", "node"]).groupBy("g", "node", "leaf", child.alias("kid")).agg(F.sum("m").alias("m"), F.sum("ma").alias("ma"))
        kids = kids.groupBy("g", "node", "leaf").agg(F.array_sort(F.collect_list(F.struct("kid", "m", "ma"))).alias("k"))
        met = states.join(kids, ["g", "node"]).select("g", "h", "c", "node", "leaf", F.col("k.kid").alias("kids"), "k.m", "k.ma", "draw", "side", "rank", "take")
        out = kept(met.mapInArrow(run(level), schema))
        done.append(out.where("leaf"))
        states = out.where("not leaf").select("g", "h", "c", "node", "draw", "side", "rank", "take")
        if states.isEmpty():
            break
        level += 1
    every = done[0]
    for d in done[1:]:
        every = every.unionByName(d)
    return every.select("g", F.explode(F.arrays_zip("draw", "side", "s0", "s1", "s2")).alias("x")).select("g", "x.*")


def _start(totals: DataFrame, statistic: str, draws: int, relabel: bool) -> DataFrame:
    """States at the root of each group of totals (g, c, n, na): the two middle ranks of each side of each draw, or each draw once."""
    numbers = F.sequence(F.lit(0), F.lit(draws))
    state = lambda side, rank: lambda d: F.struct(d.alias("draw"), F.lit(side).alias("side"), rank.cast("bigint").alias("rank"), F.col("na").alias("take"))
    if statistic == "median":
        sides = [(0, F.col("na"))] + ([(1, F.col("n") - F.col("na"))] if relabel else [])
        parts = [F.transform(numbers, state(s, rank)) for s, n in sides for rank in (F.floor((n - 1) / 2), F.floor(n / 2))]
    else:
        parts = [F.transform(numbers, state(0, F.lit(-1)))]
    s = totals.select("g", F.xxhash64("g").alias("h"), "c", F.lit(0).cast("bigint").alias("node"), F.concat(*parts).alias("s"))
    return s.select("g", "h", "c", "node", "s.draw", "s.side", "s.rank", "s.take")


def _group(by: list[str]) -> Column:
    return F.struct(*by) if by else F.struct(F.lit(0).alias("__one"))


def _checked(statistic: str) -> None:
    if statistic not in STATISTICS:
        raise ValueError(f"statistic is one of {STATISTICS}")


def _centre(key_sum: Column, n: Column) -> Column:
    return F.coalesce(F.try_divide(key_sum, n), F.lit(0.0))


def resampled(rows: DataFrame, by: list[str], value: str, statistic: str = "mean", draws: int = 1000, seed: int = 42, n: str | None = None) -> DataFrame:
    """(by, draw, boot_mean): mean, median or population deviation of ``draws`` resamples of each group; draw 0 is the data itself.

    Null values are left out; a group without others gives no rows. A row stands for ``n`` equal ones, if that is named.
    """
    _checked(statistic)
    counts = kept(value_counts(rows, _group(by), value, F.lit(True), n))
    means = rows.select(_group(by).alias("g"), F.col(value).cast("double").alias("v"), _weight(n).alias("n")).where("v is not null").groupBy("g").agg((F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("c"))
    totals = counts.groupBy("g").agg(F.sum("m").alias("n"), F.sum("ma").alias("na")).join(means, "g")
    leaves = _tree(counts, _start(totals, statistic, draws, False), seed, True)
    if statistic == "median":
        found = leaves.groupBy("g", "draw").agg(F.avg("s1").alias("boot_mean"))
    else:
        sums = leaves.groupBy("g", "draw").agg(*[F.sum(s).alias(s) for s in ("s0", "s1", "s2")]).join(means, "g")
        m = F.try_divide("s1", "s0")
        found = sums.select("g", "draw", (F.col("c") + m if statistic == "mean" else F.sqrt(F.greatest(F.try_divide("s2", "s0") - m * m, F.lit(0.0)))).alias("boot_mean"))
    return found.select(*[F.col(f"g.{c}").alias(c) for c in by], "draw", "boot_mean")


def value_interval(rows: DataFrame, by: list[str], value: str, statistic: str = "mean", draws: int = 1000, alpha: float = 0.05, seed: int = 42, n: str | None = None) -> DataFrame:
    """(by, estimate, ci_lower, ci_upper): the statistic of each group and its percentile interval."""
    boot = resampled(rows, by, value, statistic, draws, seed, n)
    drawn = F.when(F.col("draw") > 0, F.col("boot_mean"))
    return boot.groupBy(*by).agg(F.max(F.when(F.col("draw") == 0, F.col("boot_mean"))).alias("estimate"), F.percentile(drawn, F.lit(alpha / 2)).alias("ci_lower"), F.percentile(drawn, F.lit(1 - alpha / 2)).alias("ci_upper"))


def relabelled(rows: DataFrame, group: str, value: str, a: str, b: str, statistic: str = "mean", rounds: int = 1000, seed: int = 42, n: str | None = None) -> DataFrame:
    """One row: n_a, n_b, difference of the two groups' statistic, and p: the share of ``rounds`` relabellings, each of exactly n_a rows, that reach it.

    Null values are left out. A group without values gives a null difference and p. A row stands for ``n`` equal ones, if that is named.
    """
    _checked(statistic)
    two = rows.where(F.col(group).isin(a, b))
    counts = kept(value_counts(two, _group([]), value, F.col(group) == a, n))
    v, many = F.col(value).cast("double"), _weight(n)
    whole = two.where(v.isNotNull()).agg(_centre(F.sum(v * many), F.sum(many)).alias("c"))
    totals = counts.groupBy("g").agg(F.sum("m").alias("n"), F.sum("ma").alias("na")).join(F.broadcast(whole))
    usable = totals.where("na > 0 and na < n")
    leaves = _tree(counts, _start(usable, statistic, rounds, True), seed, False)
    if statistic == "median":
        sides = leaves.groupBy("draw").agg(F.avg(F.when(F.col("side") == 0, F.col("s1"))).alias("x"), F.avg(F.when(F.col("side") == 1, F.col("s1"))).alias("y"))
    else:
        # what the first group doesn't take is the second's
        powers = two.where(v.isNotNull()).join(F.broadcast(whole)).agg(F.sum(many).alias("t0"), F.sum((v - F.col("c")) * many).alias("t1"), F.sum((v - F.col("c")) * (v - F.col("c")) * many).alias("t2"))
        sums = leaves.groupBy("draw").agg(*[F.sum(s).alias(s) for s in ("s0", "s1", "s2")]).join(F.broadcast(powers))

        def of(n, s, q):
            mean = F.try_divide(s, n)
            return mean if statistic == "mean" else F.sqrt(F.greatest(F.try_divide(q, n) - mean * mean, F.lit(0.0)))

        first, second = of(F.col("s0"), F.col("s1"), F.col("s2")), of(F.col("t0") - F.col("s0"), F.col("t1") - F.col("s1"), F.col("t2") - F.col("s2"))
        sides = sums.select("draw", first.alias("x"), second.alias("y"))
    d = kept(sides.select("draw", (F.col("x") - F.col("y")).alias("d")))
    seen = d.where("draw = 0").select(F.col("d").alias("difference"))
    reached = d.where("draw > 0").join(F.broadcast(seen)).agg(F.max("difference").alias("difference"), F.avg((F.abs("d") >= F.abs("difference") - 1e-12).cast("int")).alias("p_value"))
    sizes = totals.agg(F.coalesce(F.max("na"), F.lit(0)).alias("n_a"), F.coalesce(F.max(F.col("n") - F.col("na")), F.lit(0)).alias("n_b"))
    return sizes.join(F.broadcast(reached))
