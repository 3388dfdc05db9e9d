"""Exact inner-product search by vector-approximation files.

The approximation file holds, for each different vector, one byte a component: its cell among
2**BITS of equal width over the component's range in all vectors. Blocks of queries scan blocks
of the file for bounds of each score; only candidates whose upper bound reaches the k-th
lower bound go on, first of a block, then of all blocks. Exact vectors are read for these alone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

BITS = 8
#: Candidates and queries of a block, and queries whose bounds are in memory at once.
CANDIDATES, QUERIES, AT_ONCE = 32_768, 16_384, 64


def whole_vector(column: str, scale: int = 1024) -> Column:
    """floor(scale * x) of each component as bigint; null if the vector is null, empty or holds null, NaN or infinity."""
    x = F.transform(F.col(column), lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(F.col(column).isNotNull() & (F.size(column) > 0) & ~F.coalesce(bad, F.lit(True)), F.transform(x, lambda v: F.floor(v * float(scale)).cast("bigint")))


def cells(v: np.ndarray, lo: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Cell numbers of vectors: each component's range from ``lo`` in cells of ``width``."""
    return np.floor((v - lo) / width).clip(0, (1 << BITS) - 1).astype(np.uint8)


def bounds(code: np.ndarray, lo: np.ndarray, width: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) bound of the score of each query with each cell, widened by what doubles may err."""
    low = lo + code * width
    high = low + width
    plus, minus = np.maximum(q, 0), np.minimum(q, 0)
    slack = 1 + 1e-11 * (np.abs(q) @ np.maximum(np.abs(lo), np.abs(lo + width * (1 << BITS))))[:, None]
    return plus @ low.T + minus @ high.T - slack, plus @ high.T + minus @ low.T + slack


def _ranges(vectors: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(lo, width) of the components of vectors of each length."""

    def run(batches):
        seen: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = np.array(x, float)
                seen[dim] = np.stack([np.minimum(seen[dim][0], x), np.maximum(seen[dim][1], x)]) if dim in seen else np.stack([x, x])
        for dim, x in seen.items():
            yield pa.record_batch([pa.array([dim] * dim, pa.int32()), pa.array(range(dim), pa.int32()), pa.array(x[0]), pa.array(x[1])], names=["dim", "at", "lo", "hi"])

    got = vectors.select("dim", "v").mapInArrow(run, "dim int, at int, lo double, hi double").groupBy("dim", "at").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).toPandas()
    out = {}
    for dim, g in got.sort_values("at").groupby("dim"):
        lo, hi = g["lo"].to_numpy(), g["hi"].to_numpy()
        out[int(dim)] = lo, np.maximum((hi - lo) / (1 << BITS) * (1 + 1e-9), 1e-3)
    return out


def scores(a: list, b: list) -> list[int]:
    """Inner products of pairs of integer vectors; beyond 64 bits the nearest number that fits."""
    x, y = np.array(a, np.int64), np.array(b, np.int64)
    if np.abs(x.astype(float)).max(initial=0) * np.abs(y.astype(float)).max(initial=0) * x.shape[1] < 2**62:
        return (x * y).sum(axis=1).tolist()
    return [max(-(1 << 63), min((1 << 63) - 1, sum(int(i) * int(j) for i, j in zip(p, q)))) for p, q in zip(a, b)]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query.

    Both tables hold an id and a vector. A candidate with the query's own id
    doesn't count, nor do vectors that are null, empty or hold null or
    non-finite components, nor rows of null id; vectors of another length than the query are no
    candidates. Repeated rows of a query are one query, and the different vectors of a
    repeated query id share one ranking; repeated rows of a candidate
    each count. Ties go to smaller ids. Scores are exact; whole components and scores beyond 64 bits
    are the nearest number that fits. Other columns are not read. Fewer candidates than k give fewer rows, an empty table none.
    """
    order = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("id"))
    usable = lambda df: df.select(F.col(id_col).alias("id"), whole_vector(vector_col).alias("v")).where("v is not null and id is not null").withColumn("dim", F.size("v"))
    # of equal vectors the smallest ids suffice: k besides the query's own, which may repeat
    cands = usable(vectors).withColumn("at", order("v", "id")).where(F.col("at") <= k).withColumn("at", order("v")).where(F.col("at") <= 2 * k)
    cands = cands.groupBy("v", "dim").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    cands = written(cands.withColumn("cand", F.monotonically_increasing_id()), "candidate-vectors")
    # vectors that may be the query's alone: so many more must be sure
    own = cands.select(F.explode("ids").alias("id"), "cand").distinct().groupBy("id").agg(F.count("*").alias("own"))
    asks = usable(queries).dropDuplicates(["id", "v"]).join(own, "id", "left").withColumn("need", F.coalesce("own", F.lit(0)) + k).drop("own")
    asks = written(asks.withColumn("query", F.monotonically_increasing_id()), "query-vectors")
    n, m, ranges = cands.count(), asks.count(), _ranges(cands)
    blocks, asked = max(1, -(-n // CANDIDATES)), max(1, -(-m // QUERIES))

    def code(batches):
        for batch in batches:
            found = [cells(np.array(x, float), *ranges[d]).tobytes() for d, x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(found, pa.binary())], names=["cand", "dim", "code"])

    file = cands.select("cand", "dim", "v").mapInArrow(code, "cand bigint, dim int, code binary")
    block = lambda key, many: F.pmod(F.xxhash64(key), F.lit(many)).cast("int")
    every = lambda many: F.explode(F.sequence(F.lit(0), F.lit(many - 1)))
    left = file.withColumn("block", block("cand", blocks)).withColumn("ask", every(asked))
    right = asks.select("query", "need", "dim", "v", block("query", asked).alias("ask")).withColumn("block", every(blocks))

    def scan(c: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(c) and len(q):
            lo, width = ranges[int(c["dim"].iloc[0])]
            name = c["cand"].to_numpy(np.int64)
            codes, asking = np.frombuffer(b"".join(c["code"]), np.uint8).reshape(len(c), -1), np.stack(q["v"].to_list()).astype(float)
            for at in range(0, len(q), AT_ONCE):
                lower, upper = bounds(codes, lo, width, asking[at : at + AT_ONCE])
                for i, (query, need) in enumerate(zip(q["query"].iloc[at : at + AT_ONCE], q["need"].iloc[at : at + AT_ONCE])):
                    sure = np.partition(lower[i], len(name) - need)[len(name) - need] if len(name) >= need else -np.inf
                    near = np.flatnonzero(upper[i] >= sure)
                    found.append(np.stack([np.full(len(near), float(query)), near, lower[i, near], upper[i, near]]))
        if not found:
            return pd.DataFrame({"query": [], "cand": [], "lower": [], "upper": []}).astype({"query": "int64", "cand": "int64"})
        at, near, lower, upper = np.concatenate(found, axis=1)
        return pd.DataFrame({"query": at.astype(np.int64), "cand": name[near.astype(np.int64)], "lower": lower, "upper": upper})

    keys = ["block", "ask", "dim"]
    near = written(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(scan, "query bigint, cand bigint, lower double, upper double"), "near-cells")
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("lower")))
    sure = near.join(asks.select("query", "need"), "query").withColumn("at", best).where(F.col("at") == F.col("need")).select("query", F.col("lower").alias("sure"))
    near = near.join(sure, "query", "left").where(F.col("upper") >= F.coalesce("sure", "upper")).select("query", "cand")

    def read(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
                out: list = [None] * len(a)
                for dim in set(map(len, a)):
                    own = [i for i in range(len(a)) if len(a[i]) == dim]
                    for i, x in zip(own, scores([a[i] for i in own], [b[i] for i in own])):
                        out[i] = x
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(out, pa.int64())], names=["query_id", "ids", "score"])

    kind = vectors.schema[id_col].dataType.simpleString()
    pairs = near.join(asks.select("query", F.col("id").alias("query_id"), F.col("v").alias("q")), "query").join(cands.select("cand", "v", "ids"), "cand").select("query_id", "ids", "q", "v")
    exact = pairs.mapInArrow(read, f"query_id {queries.schema[id_col].dataType.simpleString()}, ids array<{kind}>, score bigint")
    exact = exact.select("query_id", F.explode("ids").alias("vec_id"), "score").where("vec_id <> query_id")
    last = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return exact.withColumn("rank", last).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_vafile_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(vectors, vectors.where("vec_id % 100 = 0"))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 100 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::int AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
