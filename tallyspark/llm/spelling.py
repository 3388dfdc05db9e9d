"""Spelling variants: words at distance one, found by joining prefix-partitioned tries with themselves by active nodes."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents, pieces, raw_texts, written

#: Letters of a word, once A-Z are lower-cased; code points and occurrences it needs.
LETTERS, LEAST_LENGTH, LEAST_COUNT = r"[a-zÀ-ÿ]", 6, 5
#: Words that a task counts before it passes them on; the sums don't depend on it.
COUNTED = 200_000
#: A near word is a word's form if it occurs so many times as often.
FORM_TIMES = 5
#: Words of one trie; a larger group is split by longer prefixes.
GROUP = 2000


def near_pairs(words: list[str]) -> Iterator[tuple[int, int]]:
    """Index pairs (i < j) of different ``words`` that are one inserted, deleted or replaced character apart.

    A trie of the words is joined with itself: every node carries its active nodes, those whose path is at most one edit
    from its own. A child's follow from its parent's: the edit may be spent on the parent's own branches, or a node
    already one edit away follows the same letter. Active sets hold the branches along one path only, never all nodes.
    """
    children: list[dict[str, int]] = [{}]
    end = [-1]
    for i, word in enumerate(words):
        node = 0
        for letter in word:
            nxt = children[node].get(letter)
            if nxt is None:
                nxt = children[node][letter] = len(children)
                children.append({})
                end.append(-1)
            node = nxt
        end[node] = i
    stack = [(0, set(children[0].values()))]  # a node, and its active nodes at distance one
    while stack:
        node, active = stack.pop()
        i = end[node]
        if i >= 0:
            for other in active:
                if end[other] > i:
                    yield i, end[other]
        branches = children[node]
        for letter, child in branches.items():
            nxt = {children[a][letter] for a in active if letter in children[a]}
            nxt.add(node)  # the letter is deleted
            nxt.update(branches.values())  # replaced
            nxt.update(children[child].values())  # another one follows
            nxt.discard(child)
            stack.append((child, nxt))


def _sides(m: int, same: int, levels: int) -> str:
    """The sides, level by level, of the groups that a pair meets in: its longer word has ``m`` letters, the first ``same`` are equal."""
    out = []
    for _ in range(levels):
        h = m // 2
        if same >= h:
            out.append("p")
            m, same = m - h, same - h
        else:
            out.append("s")
            m = h
    return "".join(out)


def _common(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def keyed(words: DataFrame) -> DataFrame:
    """Four rows a word: the groups in which it meets every word at distance one.

    Take a pair whose longer word has m letters and which agree in the first e. If e is at least m // 2, both begin with the
    same m // 2 letters; otherwise both end with the same m - m // 2. So a word joins the group of its first and of its last half, once as the
    longer word (m its length) and once as the shorter (m one more). Which of the groups a pair counts in is decided by m and e alone.
    """
    m = F.explode(F.array(F.length("word"), F.length("word") + 1)).alias("m")
    return _split(words.select("word", "n", m).select("word", "n", "m", F.col("m").alias("left"), F.lit("").alias("sides"), F.lit("").alias("key"), F.col("word").alias("rest")))


def _split(rows: DataFrame) -> DataFrame:
    """Each row in the groups of the first and of the last half of what is left of its word."""
    h, size = F.floor(F.col("left") / 2).cast("int"), F.length("rest")
    tail = F.col("left") - h
    step = lambda side, part, rest, left: F.struct(
        F.concat("sides", F.lit(side)).alias("sides"), F.concat_ws("|", "key", F.col("m").cast("string"), F.lit(side), part).alias("key"), rest.alias("rest"), left.alias("left")
    )
    first = step("p", F.substring("rest", F.lit(1), h), F.substring("rest", h + 1, size), F.col("left") - h)
    last = step("s", F.substring("rest", size - tail + 1, tail), F.substring("rest", F.lit(1), size - tail), h)
    return rows.select("word", "n", "m", F.explode(F.array(first, last)).alias("x")).select("word", "n", "m", "x.left", "x.sides", "x.key", "x.rest")


def _groups(batches: Iterable[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of each key, from rows that come sorted by key; a group of one row is left out."""
    open_: list[tuple] = []
    for batch in batches:
        rows = zip(*(c.to_pylist() for c in batch.columns))
        for key, same in groupby(rows, itemgetter(0)):
            if open_ and open_[0][0] != key:
                if len(open_) > 1:
                    yield open_
                open_ = []
            open_ += same
    if len(open_) > 1:
        yield open_


def _joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, out = ["a", "na", "b", "nb"], []

    def batch():
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.string(), pa.int64()))], names=names)

    for rows in _groups(batches):
        m, sides = rows[0][1], rows[0][2]
        for i, j in near_pairs([r[3] for r in rows]):
            a, b = rows[i], rows[j]
            # a pair counts in one group only
            if max(len(a[4]), len(b[4])) == m and _sides(m, _common(a[4], b[4]), len(sides)) == sides:
                out.append((a[4], a[5], b[4], b[5]))
        if len(out) > 20_000:
            yield batch()
            out = []
    if out:
        yield batch()


def near_words(words: DataFrame, group: int = GROUP) -> DataFrame:
    """(a, na, b, nb): every pair of different words at distance one, once, with their counts. ``words``: word, n; words differ and aren't null.

    Groups are counted before any word is sent to them. A group of more than ``group`` words is split again by the halves of what its words
    don't share, until it fits or one letter is left, of which there are few: so no task holds more than a trie of that size, however many words begin alike.
    """
    rows, parts = keyed(words), []
    while True:
        sizes = rows.where("left > 1").groupBy("key").count()
        full = written(sizes.where(F.col("count") > group).select("key"), "spelling-full")
        if full.isEmpty():
            parts.append(rows)
            break
        parts.append(rows.join(full, "key", "left_anti"))
        rows = written(_split(rows.join(full, "key", "left_semi")), "spelling-split")
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    dealt = every.select("key", "m", "sides", "rest", "word", "n").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(_joined, "a string, na bigint, b string, nb bigint")


def word_counts(docs: DataFrame, spoil: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of words long and frequent enough.

    With ``spoil``, a run whose CRC-32 with its document's id is a multiple of it loses one letter: misspellings at known places.
    Each task sums its counts before they are shuffled.
    """
    runs_of = re.compile(LETTERS + "{%d,}" % LEAST_LENGTH).findall

    def run(batches: Iterable[pa.RecordBatch]):
        counts: Counter[str] = Counter()

        def out():
            done = pa.record_batch([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()
            return done

        for batch in pieces(batches):
            for doc, raw in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1))):
                runs = runs_of(raw.lower().decode("utf-8", "replace"))  # lower() of bytes leaves all but A-Z
                if spoil:
                    own, begun = Counter(runs), zlib.crc32(f"{doc}:".encode())
                    for r, k in [*own.items()]:
                        h = zlib.crc32(r.encode(), begun)
                        if h % spoil == 0:
                            at = h % len(r)
                            counts[r] -= k
                            if len(r) > LEAST_LENGTH:
                                counts[r[:at] + r[at + 1 :]] += k
                counts.update(runs)
                if len(counts) > COUNTED:
                    yield out()
        if counts:
            yield out()

    kept = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).cast("string").alias("t"))
    counts = kept.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= LEAST_COUNT)


def _first_roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): each round doubles how far a word looks, and forms occur ever more often, so there are few rounds."""
    roots = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = cut(roots.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        roots = step.select("word", "root")
        if step.where("moved").isEmpty():
            return roots


def variants(words: DataFrame, times: int = FORM_TIMES, group: int = GROUP) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of (word, n).

    The form is the near word of largest n (ties: the smallest word) if that is at least ``times`` the word's n. A form occurs
    more often than its word, so forms never go round; the root is the last of the chain, or the word itself.
    """
    words = written(words, "spelling-words")
    near = near_words(words, group)
    both: Column = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("na").alias("n"), F.col("b").alias("near"), F.col("nb").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("nb").alias("n"), F.col("a").alias("near"), F.col("na").alias("near_n"))))
    near = near.select(both.alias("x")).select("x.*")
    alone = words.select("word", "n", F.lit(None).cast("string").alias("near"), F.lit(None).cast("bigint").alias("near_n"))
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("k"), F.col("near").alias("near"))))
    got = alone.unionByName(near).groupBy("word", "n").agg(F.count("near").alias("n_near"), best.alias("best"))
    is_form = -F.col("best.k") >= times * F.col("n")
    got = written(got.select("word", "n", "n_near", F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.k")).alias("form_n")), "spelling-forms")
    roots = _first_roots(got.where("form is not null"))
    return got.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, spoil: int | None = None, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``variants`` of the words of documents.

    Null and empty texts have no words; a null id counts as an empty one where words are spoiled. Repeated rows count again. Very
    long texts are read whole, and words may be of any length. Words of equal count are told apart by code points. An empty table gives no rows.
    Other columns are not read and may have any name.
    """
    return variants(word_counts(docs, spoil, id_col, text_col), **how)


ORACLE = """
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
runs AS (
  SELECT doc_id, run, count(*) AS k
  FROM (SELECT coalesce(doc_id::VARCHAR, '') AS doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{00C0}-\\x{00FF}]{6,}')) AS run FROM documents)
  GROUP BY doc_id, run),
bytes AS (
  SELECT doc_id, run, k, flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [192 + ord(c)::BIGINT // 64, 128 + ord(c)::BIGINT % 64] END)) AS b
  FROM runs),
hashed AS (
  SELECT run, k, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1])), 4294967295::BIGINT) AS h
  FROM bytes, crc_table),
words AS (
  SELECT CASE WHEN h % 199 = 0 THEN substring(run, 1, (h % length(run))::INT) || substring(run, (h % length(run))::INT + 2) ELSE run END AS word, sum(k)::BIGINT AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= 6 AND n >= 5),
cuts AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
keys AS (SELECT DISTINCT word, n, i, substring(word, 1, i::INT - 1) || substring(word, i::INT + 1) AS cut FROM cuts),
pairs AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM keys a JOIN keys b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM keys a JOIN words b ON a.cut = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM keys a JOIN words b ON a.cut = b.word),
best AS (
  SELECT word, n, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM pairs GROUP BY word, n),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN near_n >= 5 * w.n THEN near END AS form, CASE WHEN near_n >= 5 * w.n THEN near_n END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word),
chain AS (
  SELECT word, word AS root, 0 AS d FROM forms
  UNION ALL SELECT c.word, f.form, d + 1 FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL),
roots AS (SELECT word, arg_max(root, d) AS root FROM chain GROUP BY word)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM forms f JOIN roots r ON r.word = f.word
"""


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(documents(spark, sf_dir), spoil=199)
