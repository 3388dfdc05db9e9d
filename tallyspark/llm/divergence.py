"""Source divergence audit: how far each source's use of words is from every other source's, and from its language's."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, pieces, raw_texts, written

#: A term is a run of ASCII letters, of which A-Z are lower-cased, and of bytes beyond ASCII; all other bytes part terms.
TERM = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
#: Bytes of text whose terms are counted together before they are passed on; the sums don't depend on it.
COUNTED = 8 << 20
#: Documents that keep a term; ranks of terms that are listed.
MIN_DOCS, TOP = 3, 200
_STEP = 1000


def _share(count: Column, of: Column) -> Column:
    """1 + floor(10^9 * (count + 1) / of) in 64-bit integers: three digits at a time, so exact while ``of`` is under 9 * 10^15."""
    rest, digits = count + 1, F.lit(0).cast("bigint")
    for _ in range(3):
        # count + 1 may equal ``of``, so the first digit runs to 1000
        digits = digits * _STEP + _div(rest * _STEP, of)
        rest = rest * _STEP % of
    return 1 + digits


def _div(a: Column, b: Column) -> Column:
    """Integer quotient of two non-negative bigint columns."""
    return F.call_function("div", a, b)


def _term(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); shares are at most 10^9 + 1, so the square fits 64 bits."""
    return _div((p - q) * (p - q), q)


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term, and documents that hold it, summed in each task before they are shuffled."""

    def run(batches: Iterable[pa.RecordBatch]):
        groups, texts, held = [], [], 0
        for batch in pieces(batches):
            for lang, source, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), raw_texts(batch.column(2))):
                groups.append((lang, source))
                texts.append(raw.translate(TERM))
                held += len(raw)
                if held > COUNTED:
                    yield _counted(groups, texts)
                    groups, texts, held = [], [], 0
        if groups:
            yield _counted(groups, texts)

    kept = docs.select(_known(lang_col).alias("lang"), _known(source_col).alias("source"), F.col(text_col).cast("string").alias("t"))
    counted = kept.mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _counted(groups: list[tuple[str, str]], texts: list[bytes]) -> pa.RecordBatch:
    """Each group's terms in some documents, with their occurrences and the documents that hold them."""
    words = pc.ascii_split_whitespace(pa.array(texts, pa.large_binary()).cast(pa.large_string(), safe=False))
    doc = np.repeat(np.arange(len(texts)), np.diff(words.offsets.to_numpy()))
    coded = words.flatten().dictionary_encode()
    code, doc = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), doc.astype(np.int64)
    filled = np.asarray(pc.binary_length(coded.dictionary)) > 0  # the splitter leaves empty words at the ends
    code, doc = code[filled[code]], doc[filled[code]]
    v = max(1, len(coded.dictionary))
    numbers = {g: i for i, g in enumerate(dict.fromkeys(groups))}
    group = np.array([numbers[g] for g in groups], np.int64)
    in_doc, n = np.unique(doc * v + code, return_counts=True)
    keys, at, docs = np.unique(group[in_doc // v] * v + in_doc % v, return_inverse=True, return_counts=True)
    names, g = list(numbers), pa.array(keys // v)
    columns = [pa.array([x[i] for x in names], pa.string()).take(g) for i in (0, 1)]
    columns += [coded.dictionary.cast(pa.string(), safe=False).take(pa.array(keys % v)), pa.array(np.bincount(at, n, len(keys)).astype(np.int64)), pa.array(docs.astype(np.int64))]
    return pa.record_batch(columns, names=["lang", "source", "term", "n", "docs"])


def _known(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def _ranked(df: DataFrame) -> DataFrame:
    """Ranks by value within (lang, source, part); ties by the bytes of the item, as Spark compares strings."""
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    return df.withColumn("rank", F.row_number().over(by))


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank).

    Part ``pair``: for each source of a language and each other one (item), the sum over the language's kept terms of
    floor((p - q)^2 / q), p and q the smoothed shares (parts of 10^9) of the term in the two. Part ``term``: the ``top`` kept terms that the
    source uses more than its language does. All in integers.

    Each kept term is one wide row: its counts in an array by the language's numbered sources, without those that lack it. What two
    sources without a term add to a pair doesn't depend on the term, and where one has it, on its count there alone: those sums
    come from counts of counts. A wide row emits only pairs of sources that both have the term, as differences from that, and partial
    aggregation sums them before the shuffle, which carries one row for each pair and task. Ranks of terms are cut before their shuffle as well.

    Null text, language or source count as ''. A row is a document, repeated rows and ids as well. A source without any kept term, or with only
    empty documents, still gets its pairs; a language without kept terms gives pairs of value 0. One source alone gives no pairs.
    Very long texts are counted whole. An empty table gives no rows. Other columns are not read and may have any name.
    """
    counts = written(term_counts(docs, text_col, lang_col, source_col), "divergence-counts")
    # every group that occurs, numbered within its language
    groups = docs.select(_known(lang_col).alias("lang"), _known(source_col).alias("source")).distinct()
    groups = written(groups.withColumn("i", F.row_number().over(Window.partitionBy("lang").orderBy("source"))), "divergence-groups")
    cell = F.struct("i", "n")
    # dealt by a number of partitions that small tables keep too: few rows here become many pairs
    dealt = counts.join(groups, ["lang", "source"]).repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "lang", "term")
    wide = dealt.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(cell).alias("cells"))
    wide = written(wide.where(F.col("docs") >= min_docs).select("lang", "term", "total", "cells"), "divergence-wide")

    terms = wide.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n"))
    sizes = wide.select("lang", F.explode("cells").alias("c")).groupBy("lang", "c.i").agg(F.sum("c.n").alias("size"))
    sized = groups.join(sizes, ["lang", "i"], "left").join(terms, "lang", "left")
    sized = sized.select("lang", "source", "i", F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("lang_n", F.lit(0)).alias("lang_n"))
    # of a source: all its counts plus the number of terms, and the share of a term it lacks
    sized = sized.withColumn("of", F.col("size") + F.col("v")).withColumn("p0", F.when(F.col("v") > 0, _share(F.lit(0).cast("bigint"), F.greatest("of", F.lit(1)))))
    langs = sized.groupBy("lang", "v", "lang_n").agg(F.array_sort(F.collect_list(F.struct("i", "source", "of", "p0"))).alias("sources"))
    langs = written(langs, "divergence-langs")

    of = lambda i: F.element_at("sources", i)
    # both sources of a pair have the term: numbers, shares and shares of an absent term side by side, so that picking one copies nothing
    by_cell = lambda f: F.transform("cells", f)
    vectors = wide.join(langs, "lang").select("lang", by_cell(lambda c: c["i"]).alias("is"), by_cell(lambda c: _share(c["n"], of(c["i"])["of"])).alias("ps"), by_cell(lambda c: of(c["i"])["p0"]).alias("p0s"))
    vectors = vectors.select("lang", "is", "ps", "p0s", F.posexplode_outer("is").alias("k", "a")).select("lang", "is", "ps", "p0s", "a", F.get("ps", F.col("k")).alias("p"), F.get("p0s", F.col("k")).alias("p0"))
    both = vectors.select("lang", "is", "ps", "p0s", "a", "p", "p0", F.posexplode_outer(F.transform("ps", lambda q: _term(F.col("p"), q))).alias("at", "f"))
    q, q0 = F.get("ps", F.col("at")), F.get("p0s", F.col("at"))
    beyond = F.col("f") - _term(F.col("p"), q0) - _term(F.col("p0"), q) + _term(F.col("p0"), q0)
    both = both.select("lang", "a", F.get("is", F.col("at")).alias("b"), beyond.alias("f")).where("a <> b").groupBy("lang", "a", "b").agg(F.sum("f").alias("f"))
    # one of them has it: this depends on its count there alone, so equal counts are taken together
    ones = wide.select("lang", F.explode("cells").alias("c")).groupBy("lang", "c.i", "c.n").agg(F.count("*").alias("terms")).join(langs, "lang")
    ones = ones.select("lang", "terms", of(F.col("i")).alias("a"), _share(F.col("n"), of(F.col("i"))["of"]).alias("p"), F.explode("sources").alias("b")).where("a.i <> b.i")
    f0 = lambda a, b: _term(F.col(f"{a}.p0"), F.col(f"{b}.p0"))
    forth = F.struct(F.col("a.i").alias("a"), F.col("b.i").alias("b"), (F.col("terms") * (_term(F.col("p"), F.col("b.p0")) - f0("a", "b"))).alias("f"))
    back = F.struct(F.col("b.i").alias("a"), F.col("a.i").alias("b"), (F.col("terms") * (_term(F.col("b.p0"), F.col("p")) - f0("b", "a"))).alias("f"))
    ones = ones.select("lang", F.explode(F.array(forth, back)).alias("x")).groupBy("lang", "x.a", "x.b").agg(F.sum("x.f").alias("f"))
    sums = both.unionByName(ones).groupBy("lang", "a", "b").agg(F.sum("f").alias("f"))
    base = langs.select("lang", "v", "sources", F.explode("sources").alias("a")).select("lang", "v", "a", F.explode("sources").alias("b")).where("a.i <> b.i")
    base = base.select("lang", "v", F.col("a.source").alias("source"), F.col("b.source").alias("item"), f0("a", "b").alias("f0"), F.col("a.i").alias("a"), F.col("b.i").alias("b"))
    pairs = base.join(sums, ["lang", "a", "b"], "left")
    none = F.lit(0).cast("bigint")
    value = F.coalesce(F.col("v") * F.col("f0"), none) + F.coalesce("f", none)
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value"))

    cells = wide.join(langs, "lang").select("lang", "term", "sources", F.col("lang_n").alias("ln"), "v", "total", F.explode("cells").alias("c"))
    own = F.element_at("sources", F.col("c.i"))
    cells = cells.where("c.n > 0").select("lang", own["source"].alias("source"), F.col("term").alias("item"), _share(F.col("c.n"), own["of"]).alias("p"), _share(F.col("total"), F.col("ln") + F.col("v")).alias("q"))
    found = cells.where("p > q").select("lang", "source", F.lit("term").alias("part"), "item", _term(F.col("p"), F.col("q")).alias("value"))
    return _ranked(pairs).unionByName(_ranked(found).where(F.col("rank") <= top))


ORACLE = """
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
groups AS (SELECT DISTINCT lang, source FROM docs),
each AS (SELECT d, lang, source, unnest(w) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS total FROM each GROUP BY lang, term HAVING count(DISTINCT d) >= 3),
counts AS (SELECT lang, source, term, count(*) AS n FROM each SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
langs AS (SELECT lang, count(*) AS v, sum(total)::HUGEINT AS ln FROM kept GROUP BY lang),
sizes AS (SELECT g.lang, g.source, coalesce(sum(n), 0)::HUGEINT AS size FROM groups g LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source GROUP BY g.lang, g.source),
shares AS (
  SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n,
         (1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (s.size + l.v))::HUGEINT AS p,
         (1 + (1000000000::HUGEINT * (k.total + 1)) // (l.ln + l.v))::HUGEINT AS lp
  FROM sizes s JOIN langs l ON l.lang = s.lang JOIN kept k ON k.lang = s.lang LEFT JOIN counts c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (((p - lp) * (p - lp)) // lp)::BIGINT AS value FROM shares WHERE n > 0 AND p > lp),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(documents(spark, sf_dir))
