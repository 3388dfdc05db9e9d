"""Embedding near-duplicates by a forest of random-projection trees with spill overlap."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written
from .components import connected_components, local_roots

#: Least trees, rows a leaf should hold, least spill as a share of a projection's deviation, rows the splits are fitted on, rows of a block of an oversized leaf.
TREES, LEAF, SPILL, SAMPLE, BLOCK = 6, 400, 0.16, 40_000, 1000
#: Directions tried for a node, rows of it whose pairs are looked at, links that tell a cut's loss, and the most of them it may lose.
TRIES, LOOK, TELLING, LOSS = 4, 512, 30, 0.03
#: Share of links among a node's pairs from which it stays whole rather than lose more; share of links just at the bound that all trees may miss.
DENSE, MISSED = 0.01, 0.001


def grow(sample: np.ndarray, depth: int, seed: int, spill: float = SPILL, least: float = 0.95) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """One tree as levels of (directions, cuts, half-widths); node i has children 2i and 2i + 1.

    A node's direction is random; rows within its half-width of the cut go
    both ways. The cut is the one nearest to the median with at most a fifth of the rows that near
    that loses at most LOSS of the links (``_cut``). Where no cut of TRIES directions does and
    the node is dense in links, or more than a third are near any cut, it stays whole, at
    whatever depth: a dense group is compared in full. The rows given here only place the cuts.
    """
    return _grown(sample, depth, seed, spill, least)[0]


def _grown(sample: np.ndarray, depth: int, seed: int, spill: float = SPILL, least: float = 0.95) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], np.ndarray]:
    """A tree, and for each row of the sample the chance that a link just at the bound stays in one leaf."""
    rng = np.random.Generator(np.random.PCG64(seed))
    dim, levels, kept = sample.shape[1], [], np.ones(len(sample))
    step = float(np.sqrt(max(2 - 2 * least, 1e-12) / dim))  # deviation of a projected difference of such a link
    at, rows = np.zeros(len(sample), np.int64), np.arange(len(sample))
    for level in range(depth):
        d = rng.standard_normal((1 << level, TRIES, dim)).astype(np.float32)
        d /= np.linalg.norm(d, axis=2, keepdims=True)
        mid, wide, chosen = np.full(1 << level, np.inf, np.float32), np.zeros(1 << level, np.float32), d[:, 0].copy()
        order = np.argsort(at, kind="stable")
        ends = np.searchsorted(at[order], np.arange((1 << level) + 1))
        x = np.zeros(len(rows), np.float32)
        for node in range(1 << level):
            own = order[ends[node] : ends[node + 1]]
            if len(own) < 2:
                continue
            v = sample[rows[own]]
            look = rng.permutation(len(own))[:LOOK]
            i, j = np.nonzero(np.triu(v[look] @ v[look].T >= least, 1))
            share, best = len(i) / (len(look) * (len(look) - 1) / 2), (2.0, np.inf, 0.0, 0)
            for k in range(TRIES):
                p = v @ d[node, k]
                lost, cut, w = _cut(p, spill, step, p[look[i]], p[look[j]])
                if lost < best[0]:
                    best = (lost, cut, w, k)
                if lost <= LOSS:
                    break
            lost, cut, w, k = best
            chosen[node] = d[node, k]
            if lost <= LOSS or (lost <= 1 and share < DENSE):
                mid[node], wide[node], x[own] = cut, w, v @ d[node, k]
                kept[rows[own]] *= 1 - lost
        levels.append((chosen, mid, wide))
        at, rows = _down(x, at, rows, mid, np.zeros_like(wide))
    return levels, kept


def _cut(x: np.ndarray, spill: float, step: float, a: np.ndarray, b: np.ndarray, most: float = 0.35) -> tuple[float, float, float]:
    """(lost, cut, half-width) of a node's projections; lost is 2 where more than ``most`` are near any cut.

    ``lost`` is the share of links that the cut parts: as expected of links just at the bound, whose projected
    difference has the deviation ``step``, and as seen on the links a-b if these are enough to tell.
    """
    w, places = max(spill * float(x.std()), step / 2), np.linspace(0.2, 0.8, 25)
    x = np.sort(x)
    at = np.quantile(x, places)

    def share(w):
        return (np.searchsorted(x, at + w, "right") - np.searchsorted(x, at - w)) / len(x)

    near = share(w)
    if near.min() > most:
        w *= 0.95 * most / near.min()
        near = share(w)
    t = max(2 * w / step, 1e-9)
    tail = math.erfc(t / math.sqrt(2)) / 2
    lost = np.minimum(1.0, near / t * 2 * (math.exp(-t * t / 2) / math.sqrt(2 * math.pi) - t * tail))
    if len(a) >= TELLING:
        low, high = np.minimum(a, b), np.maximum(a, b)
        lost = np.maximum(lost, [np.mean((low <= c - w) & (high > c + w)) for c in at])
    middle = np.argsort(np.abs(np.arange(25) - 12), kind="stable")
    best = next((i for i in middle if near[i] <= 0.2 and lost[i] <= LOSS), None)
    if best is None:
        allowed = middle[near[middle] <= most]
        if not len(allowed):
            return 2.0, np.inf, 0.0
        best = allowed[np.argmin(lost[allowed])]
    return float(lost[best]), float(at[best]), w


def _forest(sample: np.ndarray, depth: int, trees: int, least: float) -> list:
    """``trees`` trees, or as many more as leave at most MISSED of the links just at the bound to none."""
    first, kept = _grown(sample, depth, 97, least=least)
    while np.mean((1 - kept) ** trees) > MISSED:
        trees += 1
    return [first, *(grow(sample, depth, 97 + t, least=least) for t in range(1, trees))]


def _down(x, at, rows, mid, wide):
    left, right = x <= mid[at] + wide[at], x > mid[at] - wide[at]
    return np.r_[2 * at[left], 2 * at[right] + 1], np.r_[rows[left], rows[right]]


def leaves(v: np.ndarray, tree) -> tuple[np.ndarray, np.ndarray]:
    """(leaf, row) of every leaf each row reaches."""
    at, rows = np.zeros(len(v), np.int64), np.arange(len(v))
    for d, mid, wide in tree:
        x = np.einsum("ij,ij->i", v[rows], d[at])
        at, rows = _down(x, at, rows, mid, wide)
    return at, rows


def _distinct(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """One row for each usable distinct vector: rep (its own number), low (smallest id), n (rows), v (doubles)."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    norm = F.aggregate(x, F.lit(0.0), lambda a, c: a + c * c)
    usable = vectors.select(F.col(id_col).alias("id"), F.when(F.col(vector_col).isNotNull() & ~F.coalesce(bad, F.lit(True)), x).alias("v"), norm.alias("sq")).where("v is not null and id is not null and sq > 0")
    return usable.select("id", F.transform("v", lambda c: c + F.lit(0.0)).alias("v")).groupBy("v").agg(F.min("id").alias("low"), F.count("*").alias("n")).withColumn("rep", F.monotonically_increasing_id())


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.95, trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE) -> DataFrame:
    """One row for each input row: id, n_links, component_id, kept.

    Equal vectors are one until the end. Each distinct vector goes down every
    tree; within a leaf all pairs are compared exactly in doubles. A pair is
    counted in the first leaf that both share, so n_links needs no list of
    pairs: each vector carries its leaves. Leaves of more than BLOCK rows are
    compared as pairs of blocks. Splits are placed on at most ``sample`` vectors
    chosen by hash; the rows of all trees are indexed. There are at least ``trees`` trees, and more as
    depth asks. Pairs that no leaf joins are missed (recall is measured in the tests).

    Vectors that are null, empty, zero or hold null or non-finite components link with
    nothing; vectors link only with vectors of their length; a null id links with
    nothing and names nothing. Each row counts as a vector, whether it repeats an id, a vector or both;
    rows of one id have the links of their own vectors, and kept is true where the row's id is the component's.
    Other columns are not read and may have any name. An empty table gives no rows.
    """
    distinct = written(_distinct(vectors, id_col, vector_col), "distinct-vectors")
    dims = [r[0] for r in distinct.select(F.size("v").alias("d")).distinct().collect()]
    keyed = distinct.select("rep", "n", "v", F.size("v").alias("dim"))
    links = None
    for dim in sorted(dims):
        own = keyed.where(F.col("dim") == dim)
        part = _links(own, dim, least, trees, leaf, sample)
        links = part if links is None else links.unionByName(part)
    out = vectors.select(F.col(id_col).alias("id"), F.transform(F.col(vector_col), lambda c: c.cast("double") + F.lit(0.0)).alias("v"))
    if links is None:
        return out.select(F.col("id").alias(id_col), F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    links = written(links, "vector-links")
    count = links.where("kind = 0").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("others"))
    roots = connected_components(links.where("kind = 1").select(F.col("a").alias("u"), F.col("b").alias("v")))
    known = distinct.join(count, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.withColumn("root", F.coalesce("root", "rep"))
    known = known.join(known.groupBy("root").agg(F.min("low").alias("component_id")), "root")
    known = known.select(F.col("v").alias("w"), (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id")
    joined = out.join(known, (F.col("v") == F.col("w")) & F.col("id").isNotNull(), "left")
    component = F.coalesce("component_id", "id")
    return joined.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def _links(own: DataFrame, dim: int, least: float, trees: int, leaf: int, sample: int) -> DataFrame:
    """kind 0: (a, b) of vector a and the rows it links to in a block; kind 1: edges a-b that join what is linked."""
    n = own.count()
    share = min(1.0, sample / max(n, 1))
    fitted = own.where(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < int(share * (1 << 30))).select("v").limit(2 * sample).toPandas() if n > leaf else None
    depth = max(0, int(np.ceil(np.log2(max(n, 1) / leaf)))) if n > leaf else 0
    depth = min(depth, int(np.log2(max(2, len(fitted) / 16)))) if fitted is not None and len(fitted) else 0
    forest = _forest(_unit(np.stack(fitted["v"].to_list())).astype(np.float32), depth, trees, least) if depth else [[]]
    forest_b = own.sparkSession.sparkContext.broadcast(forest)

    def place(batches):
        forest_ = forest_b.value
        for batch in batches:
            if not batch.num_rows:
                continue
            u = _unit(np.asarray(batch.column(2).flatten()).reshape(batch.num_rows, dim))
            f = u.astype(np.float32)
            pairs = [leaves(f, tree) for tree in forest_]
            leaf_ = np.concatenate([a + (t << depth) for t, (a, _) in enumerate(pairs)])
            row = np.concatenate([r for _, r in pairs])
            order = np.lexsort((leaf_, row))
            leaf_, row = leaf_[order].astype(np.int32), row[order]
            ends = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * dim), batch.num_rows, [None, pa.py_buffer(np.ascontiguousarray(u))]).cast(pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(leaf_))], names=["rep", "n", "u", "leaves"])

    placed = written(own.select("rep", "n", "v").mapInArrow(place, "rep bigint, n bigint, u binary, leaves array<int>"), "placed-vectors")
    each = placed.select("*", F.explode("leaves").alias("leaf"))
    large = placed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count().where(F.col("count") > BLOCK).select("leaf", F.ceil(F.col("count") / BLOCK).alias("nb"))
    each = each.join(F.broadcast(large), "leaf", "left").withColumn("nb", F.coalesce("nb", F.lit(1)))  # at most one row for each leaf of the forest
    each = each.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("nb"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("nb") - 1)))
    each = each.select("leaf", F.least("own", "other").alias("b1"), F.greatest("own", "other").alias("b2"), (F.col("own") <= F.col("other")).alias("left"), (F.col("own") >= F.col("other")).alias("right"), "rep", "n", "u", "leaves")

    def compare(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep", kind="stable")
        rep, n_ = pdf["rep"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
        u = np.frombuffer(b"".join(pdf["u"]), np.float64).reshape(len(pdf), dim)
        a, b = np.flatnonzero(pdf["left"].to_numpy(bool)), np.flatnonzero(pdf["right"].to_numpy(bool))
        near = u[a] @ u[b].T >= least - 1e-12
        i, j = np.nonzero(near)
        i, j = a[i], b[j]
        keep = i < j if key[1] == key[2] else i != j
        i, j = i[keep], j[keep]
        if not len(i):
            return pd.DataFrame({"kind": [], "a": [], "b": []})
        cos = np.einsum("ij,ij->i", u[i], u[j])
        ok = cos >= least
        i, j = i[ok], j[ok]
        # a pair counts here only if the two share no smaller leaf
        used = np.unique(np.r_[i, j])
        earlier = [x[x < key[0]] for x in (np.asarray(pdf["leaves"].iloc[k]) for k in used)]
        names, flat = np.unique(np.concatenate(earlier), return_inverse=True) if sum(map(len, earlier)) else (np.empty(0), np.empty(0, int))
        if len(names):
            member = np.zeros((len(used), len(names)), np.float32)
            member[np.repeat(np.arange(len(used)), [len(x) for x in earlier]), flat] = 1
            at = np.searchsorted(used, np.arange(len(pdf)))
            fresh = np.empty(len(i), bool)
            for s in range(0, len(i), 1 << 16):
                fresh[s : s + (1 << 16)] = ~(member[at[i[s : s + (1 << 16)]]] * member[at[j[s : s + (1 << 16)]]]).any(axis=1)
        else:
            fresh = np.ones(len(i), bool)
        counts = np.zeros(len(pdf), np.int64)
        np.add.at(counts, i[fresh], n_[j[fresh]])
        np.add.at(counts, j[fresh], n_[i[fresh]])
        root = local_roots(len(pdf), i, j)
        moved, some = np.flatnonzero(root != np.arange(len(pdf))), np.flatnonzero(counts)
        return pd.DataFrame({"kind": np.r_[np.zeros(len(some), np.int32), np.ones(len(moved), np.int32)], "a": np.r_[rep[some], rep[moved]], "b": np.r_[counts[some], rep[root[moved]]]})

    return each.groupBy("leaf", "b1", "b2").applyInPandas(compare, "kind int, a bigint, b bigint")


def op1_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::double) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM v
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM p a JOIN p b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE a.n > 0 AND b.n > 0
    AND list_sum(list_transform(list_zip(a.v, b.v), lambda x: x[1] * x[2])) / (a.n * b.n) >= 0.95
), reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), low AS (SELECT a, min(b) AS m FROM reach GROUP BY a),
deg AS (SELECT a, count(DISTINCT b) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(deg.n, 0)::bigint AS n_links, least(e.vec_id, coalesce(low.m, e.vec_id)) AS component_id,
       least(e.vec_id, coalesce(low.m, e.vec_id)) = e.vec_id AS kept
FROM embeddings e LEFT JOIN low ON low.a = e.vec_id LEFT JOIN deg ON deg.a = e.vec_id
"""
