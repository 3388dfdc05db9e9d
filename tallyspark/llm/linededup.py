"""Line dedup by a log-template tree: lines that recur across documents up to variable fields are dropped."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, pieces, raw_texts, written

#: Leading tokens that lead down the tree, least share of equal tokens within a template, documents that make a template recur.
LEAD, SIMILAR, MIN_DOCS = 4, 0.8, 10
#: Words of a line from which its exact repeats go from the second document on.
LONG = 50
#: Templates of one leaf that one task clusters; a larger leaf takes several rounds of so many.
LEAF = 4000
_DIGIT, _DIGITS = re.compile(rb"[0-9]"), re.compile(rb"[0-9]+")
_VARIABLE = b"<*>"


def parse(line: bytes, lead: int = LEAD) -> tuple[int, int, int, bytes] | None:
    """(template, leaf, tokens, signature) of a line, or None if it has no word.

    Runs of digits are variable, the other characters of their token are not. A line
    without a token free of digits (numeric rows, paragraphs without spaces) has
    nothing constant to go by: its template is the line itself, and it has no
    signature. The leaf is the token count and the leading tokens; the signature holds 31
    bits of each token, and whether it had a digit in its lowest bit (two tokens that differ look equal once in 2**31).
    """
    tokens = line.split()
    if not tokens:
        return None
    h, n = xxhash.xxh64_intdigest, len(tokens)
    variable = [bool(_DIGIT.search(t)) for t in tokens] if _DIGIT.search(line) else [False] * n
    exact = all(variable)
    if not exact and any(variable):
        tokens = [_DIGITS.sub(_VARIABLE, t) if v else t for t, v in zip(tokens, variable)]
    whole = h(b" ".join(tokens))
    leaf = h(b" ".join(tokens[:lead]), n)
    # with so few tokens no second line can be similar enough and still differ
    sig = b"" if exact or (n - 1) / n < SIMILAR else np.array([h(t) & 0xFFFFFFFE | v for t, v in zip(tokens, variable)], np.uint32).tobytes()
    return whole - (1 << 64) if whole >> 63 else whole, leaf - (1 << 64) if leaf >> 63 else leaf, n, sig


def keys(line: bytes) -> list[tuple[int, int, int, bytes, bool]]:
    """What a line is counted by: its template as ``parse`` gives it, and of a long line the line itself; the last field tells which."""
    x = parse(line)
    if x is None:
        return []
    if x[2] < LONG:
        return [(*x, False)]
    exact = xxhash.xxh64_intdigest(b" ".join(line.split()), LONG)
    exact = exact - (1 << 64) if exact >> 63 else exact
    return [(*x, False), (exact, exact, x[2], b"", True)]


def _tag(id_col: str, text_col: str) -> Column:
    """0, or where the id is null a hash of the text, so that rows without id are told apart and never gathered as one group."""
    return F.when(F.col(id_col).isNull(), F.xxhash64(F.col(text_col).cast("string"))).otherwise(F.lit(0).cast("bigint"))


def _templates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches):
        for batch in pieces(batches):
            ids = batch.select(["id", "tag"])
            rows, tmpl, leaf, size, sigs, exact = [], [], [], [], [], []
            for i, t in enumerate(raw_texts(batch.column(2))):
                seen = set()
                for line in t.split(b"\n"):
                    for x in keys(line):
                        if x[0] not in seen:
                            seen.add(x[0])
                            rows.append(i)
                            tmpl.append(x[0])
                            leaf.append(x[1])
                            size.append(x[2])
                            sigs.append(x[3])
                            exact.append(x[4])
                if len(rows) > 20_000:
                    yield out(ids, rows, tmpl, leaf, size, sigs, exact)
                    rows, tmpl, leaf, size, sigs, exact = [], [], [], [], [], []
            yield out(ids, rows, tmpl, leaf, size, sigs, exact)

    def out(ids, rows, tmpl, leaf, size, sigs, exact):
        return pa.record_batch([*ids.take(pa.array(rows, pa.int64())).columns, pa.array(tmpl, pa.int64()), pa.array(leaf, pa.int64()), pa.array(size, pa.int32()), pa.array(sigs, pa.binary()), pa.array(exact, pa.bool_())], names=["id", "tag", "tmpl", "leaf", "n", "sig", "exact"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), _tag(id_col, text_col).alias("tag"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, f"id {kind}, tag bigint, tmpl bigint, leaf bigint, n int, sig binary, exact boolean")


def _sigs(x) -> np.ndarray:
    return np.frombuffer(b"".join(x), np.uint32).reshape(len(x), -1)


def _similar(head: np.ndarray, sig: np.ndarray) -> np.ndarray:
    """Which signatures equal ``head`` in enough tokens, one of them constant."""
    equal = sig == head
    return (equal.mean(axis=1) >= SIMILAR) & equal[:, head & 1 == 0].any(axis=1)


def _cluster(pdf: pd.DataFrame) -> pd.DataFrame:
    """Name each template of some leaves after the first (by hash) that names itself and is similar to it."""
    pdf = pdf.sort_values(["leaf", "tmpl"], kind="stable").reset_index(drop=True)
    name = pdf["tmpl"].to_numpy(np.int64).copy()
    leaf = pdf["leaf"].to_numpy(np.int64)
    cuts = np.flatnonzero(np.diff(leaf)) + 1
    for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(leaf)]):
        if hi - lo < 2:
            continue
        sig, left = _sigs(pdf["sig"].iloc[lo:hi]), np.arange(hi - lo)
        while len(left) > 1:
            same = _similar(sig[left[0]], sig[left[1:]])
            name[lo + left[1:][same]] = name[lo + left[0]]
            left = left[1:][~same]
    return pd.DataFrame({"tmpl": pdf["tmpl"], "name": name})


def _assign(rest: pd.DataFrame, heads: pd.DataFrame) -> pd.DataFrame:
    """The first of ``heads`` (by hash) that each template of one leaf is similar to; null if none is."""
    name = pd.array([pd.NA] * len(rest), "Int64")
    if len(rest) and len(heads):
        heads = heads.sort_values("head", kind="stable")
        sig, left = _sigs(rest["sig"]), np.arange(len(rest))
        for tmpl, head in zip(heads["head"].tolist(), _sigs(heads["sig2"])):
            same = _similar(head, sig[left])
            name[left[same]] = tmpl
            left = left[~same]
            if not len(left):
                break
    return rest[["tmpl", "leaf", "sig"]].assign(name=name)


def _named(leaves: DataFrame) -> DataFrame:
    """(tmpl, name) of the templates of leaves (tmpl, leaf, sig, m): in order of hash, a template joins the first one before it
    that names itself and is similar, or names itself.

    The rule is one for leaves of any size. A leaf of up to LEAF templates is done in one task; of a larger one, the first LEAF
    are, all others are held against those that name themselves, in tasks of so many, and what joins none goes to the next round.
    """
    clustered = lambda df, groups: df.withColumn("g", F.pmod(F.xxhash64("leaf"), F.lit(groups))).groupBy("g").applyInPandas(lambda pdf: _cluster(pdf), "tmpl bigint, name bigint")
    small = leaves.where(F.col("m") <= LEAF).select("tmpl", "leaf", "sig")
    out = written(clustered(small, max(1, leaves.count() // 20_000)), "line-clusters")
    open_ = leaves.where(F.col("m") > LEAF).select("tmpl", "leaf", "sig")
    while left := open_.count():
        ranked = open_.withColumn("at", F.row_number().over(Window.partitionBy("leaf").orderBy("tmpl"))).where(F.col("at") <= LEAF).drop("at")
        now = written(clustered(ranked, max(1, left // LEAF)), "large-leaf-clusters")
        out = out.unionByName(now)
        rest = open_.join(now.select("tmpl"), "tmpl", "left_anti")
        heads = open_.join(now.where("tmpl = name").select("tmpl"), "tmpl", "left_semi")
        tasks = rest.groupBy("leaf").agg(F.ceil(F.count("*") / LEAF).alias("tasks"))
        dealt = rest.join(tasks, "leaf").withColumn("task", F.pmod(F.xxhash64("tmpl"), F.col("tasks"))).drop("tasks")
        heads = heads.join(tasks, "leaf").withColumn("task", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tasks") - 1)))
        heads = heads.select(F.col("leaf").alias("leaf2"), F.col("task").alias("task2"), F.col("tmpl").alias("head"), F.col("sig").alias("sig2"))
        tried = dealt.groupBy("leaf", "task").cogroup(heads.groupBy("leaf2", "task2")).applyInPandas(lambda a, b: _assign(a, b), "tmpl bigint, leaf bigint, sig binary, name bigint")
        tried = written(tried, "large-leaf-rest")
        out = out.unionByName(tried.where("name is not null").select("tmpl", "name"))
        open_ = tried.where("name is null").select("tmpl", "leaf", "sig")
    return out


def recurring(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """(id, tag, tmpl, first) of every document and each of its templates that recurs; rows of null id by ``_tag``.

    A cluster recurs in ``min_docs`` different ids, a long line itself in two.
    ``first`` is the smallest id that holds the cluster; its lines stay.
    """
    rows = written(_templates(docs, id_col, text_col), "line-templates")
    per = rows.groupBy("tmpl").agg(F.count("*").alias("docs"), F.min("id").alias("first"), F.min("leaf").alias("leaf"), F.max(F.length("sig") > 0).alias("signed"), F.max("exact").alias("exact"))
    per = written(per, "templates")
    # only leaves that hold several templates can generalise; signatures, most of the bytes, are moved once, and go on from here for those alone
    shared = per.where("signed").groupBy("leaf").agg(F.count("*").alias("m")).where("m > 1")
    sigs = rows.where(F.length("sig") > 0).groupBy("tmpl").agg(F.first("sig").alias("sig"))
    leaves = written(per.where("signed").select("tmpl", "leaf").join(shared, "leaf").join(sigs, "tmpl").select("tmpl", "leaf", "sig", "m"), "shared-leaves")
    merged = _named(leaves).where("tmpl <> name")
    per = per.select("tmpl", "docs", "first", "exact").join(merged, "tmpl", "left").withColumn("name", F.coalesce("name", "tmpl"))
    need = F.when(F.col("exact"), F.lit(min(2, min_docs))).otherwise(F.lit(min_docs))
    # a document may hold several templates of a cluster, or rows share an id: the sum only rules clusters out
    total = per.groupBy("name").agg(F.sum("docs").alias("most"), F.min("first").alias("first"), F.first(need).alias("need")).where("most >= need")
    hits = written(rows.select("id", "tag", "tmpl").join(per.select("tmpl", "name").join(total.drop("most"), "name"), "tmpl"), "recurring-lines")
    held = hits.select("name", "need", "id").distinct().groupBy("name", "need").agg(F.count("*").alias("ids")).where("ids >= need").select("name")
    return hits.join(held, "name").select("id", "tag", "tmpl", "first")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """Every input row, columns unchanged but the text, which loses its recurring lines; and n_lines, n_dropped.

    A line goes if its template is in at least ``min_docs`` different documents and this
    is not the smallest id among them; a line of LONG words or more goes as well if two
    documents hold just that line (up to white space). Lines without a word stay. Null text
    stays null, with 0 lines. Rows that share an id are one document here and count
    once, as do those with a null id, of which each row still loses its own lines by its own text's templates. A null id is never the first. An
    empty table gives no rows. Other columns keep their names whatever they are.
    """
    gone = recurring(docs, id_col, text_col, min_docs).where(~F.col("id").eqNullSafe(F.col("first"))).groupBy(F.col("id").alias("__id"), F.col("tag").alias("__tag")).agg(F.collect_set("tmpl").alias("__gone"))
    names = [f"__{i}" for i in range(len(docs.columns))]
    id_, text = names[docs.columns.index(id_col)], names[docs.columns.index(text_col)]
    tagged = docs.toDF(*names).withColumn("__own", _tag(id_, text))
    wide = tagged.join(gone, F.col(id_).eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__tag")), "left").drop("__id", "__own", "__tag")
    others = [n for n in names if n != text]

    def run(batches):
        for batch in pieces(batches):
            texts, out, lines, lost = batch.column(len(others)), [], [], []
            for t, null, gone in zip(raw_texts(texts), texts.is_null().to_pylist(), batch.column(len(others) + 1).to_pylist()):
                parts = [] if null else t.split(b"\n")
                kept = parts
                if gone:
                    gone = set(gone)
                    kept = [p for p in parts if not any(x[0] in gone for x in keys(p))]
                out.append(None if null else b"\n".join(kept).decode("utf-8", "replace"))
                lines.append(len(parts))
                lost.append(len(parts) - len(kept))
            yield pa.record_batch([*batch.columns[: len(others)], pa.array(out, pa.string()), pa.array(lines, pa.int64()), pa.array(lost, pa.int64())], names=[*others, text, "n_lines", "n_dropped"])

    kinds = {n: f.dataType.simpleString() for n, f in zip(names, docs.schema)}
    schema = ", ".join(f"`{n}` {kinds[n]}" for n in others) + f", `{text}` string, n_lines bigint, n_dropped bigint"
    done = wide.select(*others, F.col(text).cast("string").alias(text), "__gone").mapInArrow(run, schema)
    return done.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)], F.col("n_lines"), F.col("n_dropped"))


def op10_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 (of the kept lines; null text: of nothing) of every document."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("kept_sha256"))
