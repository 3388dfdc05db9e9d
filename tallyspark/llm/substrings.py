"""Substring dedup by prefix-partitioned suffix subtrees.

A suffix here is a run of ``window`` words, the depth at which a repeat counts.
Suffixes are partitioned by a prefix of variable length: of the stretches of
PREFIX words within a suffix's window, the one least in a fixed order (rare stretches
first, by counts over all documents) begins a longer suffix, and that suffix's
first words name the group. Neighbouring suffixes mostly share that stretch,
so they travel as one piece of text, each word about thrice, and nothing but the words
themselves is compared. Groups have the size of a task's memory: a prefix that too many
suffixes share is lengthened by the next word, then by the next, until they fit (where the
window ends, by the words before the stretch). Only suffixes equal in all their window can't
be told apart by any prefix; of these a chunk of CHUNK suffixes sends those of one document.

A group builds the subtree of its suffixes from the top: at each depth suffixes
are split by their next words, and a branch that holds a single suffix is a leaf and
is left. What is still branching at depth ``window`` is a deep internal node; the
documents below it share those words, and all but those in its smallest
document are repeats. Neighbouring ones join into maximal repeats.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, mixed, pieces, planes, raw_texts, unplanes, written

WINDOW, PREFIX = 13, 4
#: Hashed bins in which prefixes are counted; suffixes of a group and of a task's chunk.
BINS, GROUP, CHUNK = 1 << 16, 500_000, 600_000
_ODD = np.random.Generator(np.random.PCG64(13)).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _runs(w: np.ndarray, length: int) -> np.ndarray:
    """A hash of each run of ``length`` of the hashes ``w``."""
    n = len(w) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(length):
        total += w[j : j + n] * _ODD[j]
    return mixed(total)


def numbered(words: bytes) -> tuple[np.ndarray, pa.Array]:
    """(number of each word, the different words) of words that each end in one space."""
    raw = np.frombuffer(words, np.uint8)
    at = np.flatnonzero(raw == 32)
    if not len(at):
        return np.empty(0, np.int32), pa.array([], pa.binary())
    ends = np.r_[0, at + 1].astype(np.int32)  # each word with its space
    coded = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(words)]).dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary


def spelled(numbers: np.ndarray, known: pa.Array) -> bytes:
    """The words of some numbers, each with its space."""
    got = known.take(pa.array(numbers))
    return got.buffers()[2].to_pybytes()[: int(np.frombuffer(got.buffers()[1], np.int32)[len(got)])]


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _known_hashes(known: pa.Array) -> np.ndarray:
    """Hashes of words that each end in a space, without it, as they were counted."""
    return _word_hashes([x[:-1] for x in known.to_pylist()])


def _prefix_counts(rows: DataFrame, window: int, prefix: int) -> tuple[np.ndarray, int]:
    """How many prefixes of all documents fall into each bin, and how many suffixes there are."""

    def count(batches):
        total, n = np.zeros(BINS + 1, np.int64), 0
        for batch in pieces(batches):
            found = []
            for t in raw_texts(batch.column(2)):
                words = t.split()
                if len(words) >= window:
                    found.append(_runs(_word_hashes(words), prefix) & np.uint64(BINS - 1))
                    n += len(words) - window + 1
            if found:
                total[:-1] += np.bincount(np.concatenate(found).astype(np.int64), minlength=BINS)
        total[-1] = n
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["bin", "n"])

    got = rows.mapInArrow(count, "bin int, n bigint").groupBy("bin").agg(F.sum("n").alias("n")).toPandas()  # at most BINS + 1 rows
    table = np.zeros(BINS + 1, np.int64)
    table[got["bin"].to_numpy()] = got["n"].to_numpy()
    return table[:-1], int(table[-1])


def anchors(w: np.ndarray, rank: np.ndarray, window: int, prefix: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of the least prefix, its hash) of each window of the word hashes ``w``: by rank of its bin, then by hash, then the first."""
    h = _runs(w, prefix)
    order = (rank[(h & np.uint64(BINS - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(32)) | (h >> np.uint64(32))
    n = len(w) - window + 1
    best, at = order[:n].copy(), np.arange(n)
    for j in range(1, window - prefix + 1):
        x = order[j : j + n]
        less = x < best
        best[less] = x[less]
        at[less] = np.flatnonzero(less) + j
    return at, h[at]


def prefixes(w: np.ndarray, start: np.ndarray, at: np.ndarray, key: np.ndarray, window: int, prefix: int, length: int) -> np.ndarray:
    """Keys of prefixes one word longer than ``key``: of suffixes ``start`` of the word hashes ``w`` with the stretch at ``at``.

    The words of a prefix are those from the stretch to the window's end, then those before it from the nearest on; ``length`` counts the new one.
    """
    after = start + window - at  # words from the stretch to the window's end
    word = np.where(length <= after, at + length - 1, at - (length - after))
    return mixed(key * _ODD[length] + w[word])


def _bin(key: np.ndarray, bins: int) -> np.ndarray:
    return (mixed(key + np.uint64(1)) & np.uint64(bins - 1)).astype(np.int64)


def lengthened(w: np.ndarray, start: np.ndarray, at: np.ndarray, key: np.ndarray, window: int, prefix: int, crowded: dict[int, np.ndarray], bins: int) -> np.ndarray:
    """The keys of suffixes after every prefix in a crowded bin has grown until it is in one that isn't, or is the whole window."""
    key, live = key.copy(), np.arange(len(key))
    for length in range(prefix + 1, window + 1):
        over = crowded.get(length - 1)
        if over is None or not len(live):
            break
        live = live[np.isin(_bin(key[live], bins), over)]
        key[live] = prefixes(w, start[live], at[live], key[live], window, prefix, length)
    return key


def _crowded(rows: DataFrame, chunks, rank: np.ndarray, counts: np.ndarray, window: int, prefix: int, bins: int, fit: int) -> dict[int, np.ndarray]:
    """The bins of prefixes of each length, from ``prefix`` words on, that more than ``fit`` suffixes share.

    A stretch in n places is in n * (window - prefix + 1) windows at most, so where no bin of ``counts`` allows a crowd, nothing is read.
    A first pass counts the shortest prefixes, and a second, if some are crowded, all longer ones of the suffixes there. As only one
    document of a chunk sends equal suffixes, a chunk counts equal windows once. What comes to the driver are crowded bins, at most suffixes / fit a length.
    """
    able = counts * (window - prefix + 1) > fit
    crowded: dict[int, np.ndarray] = {}

    def counted(first: bool):
        def run(batches):
            for parts in chunks(batches):
                keys: dict[int, list] = {}
                flat, known = numbered(b" ".join([b" ".join(p[2]) for p in parts]) + b" ")
                hashes = _known_hashes(known)[flat]
                ends = np.cumsum([len(p[2]) for p in parts])
                del parts
                # texts without a stretch that may be crowded have nothing to count; a stretch over two texts only lets one in
                seen = np.r_[0, np.cumsum(able[(_runs(hashes, prefix) & np.uint64(BINS - 1)).astype(np.int64)])]
                for lo, hi in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist()):
                    if seen[hi - prefix + 1] == seen[lo]:
                        continue
                    w = hashes[lo:hi]
                    at, key = anchors(w, rank, window, prefix)
                    start = np.flatnonzero(able[(key & np.uint64(BINS - 1)).astype(np.int64)])
                    at, key = at[start], key[start]
                    if not first:
                        some = np.isin(_bin(key, bins), crowded[prefix])
                        start, at, key = start[some], at[some], key[some]
                    if not len(start):
                        continue
                    found = [key]
                    for length in range(prefix + 1, window + 1):
                        found.append(prefixes(w, start, at, found[-1], window, prefix, length))
                    for length, x in zip(range(prefix, window), found[:1] if first else found[:-1]):
                        keys.setdefault(length, []).append(np.stack([_bin(x, bins), found[-1].view(np.int64)]))
                for length, x in keys.items():
                    each = np.unique(np.concatenate(x, axis=1), axis=1)[0]
                    at, n = np.unique(each, return_counts=True)
                    yield pa.record_batch([pa.array(np.full(len(at), length, np.int32)), pa.array(at), pa.array(n)], names=["length", "bin", "n"])

        return rows.mapInArrow(run, "length int, bin bigint, n bigint").groupBy("length", "bin").agg(F.sum("n").alias("n")).where(F.col("n") > fit).toPandas()

    for first in (True, False):
        if able.any() and window > prefix and (first or crowded):
            crowded |= {int(k): np.sort(g["bin"].to_numpy(np.int64)) for k, g in counted(first).groupby("length")}
    return crowded


def subtree(words: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """The deep internal node each suffix is below, or -1: suffixes ``starts`` of word numbers ``words``, two or more to a node.

    Nodes are split by one word after the other (the first two at once); a suffix alone on its branch is left.
    """
    words = words.astype(np.int64)
    size = int(words.max(initial=0)) + 1
    left, node = np.arange(len(starts)), words[starts]
    for depth in range(1, window):
        key = node * size + words[starts[left] + depth]
        order = np.argsort(key, kind="stable")
        new = np.r_[True, np.diff(key[order]) != 0]
        number = np.cumsum(new) - 1
        many = np.bincount(number)[number] > 1
        left, number = left[order[many]], number[many]
        node = np.cumsum(np.r_[True, np.diff(number) != 0]) - 1 if len(number) else number
        if not len(left):
            break
    out = np.full(len(starts), -1, np.int64)
    out[left] = node
    return out


def suffix_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(chunk, g, ids, ends, a, b): for each chunk of documents its own table (g below zero), and the suffixes it sends to each group ``g``.

    ``b`` of a group's row holds the number of each piece's first suffix in the chunk (as differences), then how many suffixes each piece has.
    """
    prefix = min(PREFIX, window)
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("tag"), F.col(text_col).cast("string").alias("t"))
    counts, whole = _prefix_counts(rows, window, prefix)
    groups = max(1, -(-whole // GROUP))
    rank = np.floor(np.log2(np.maximum(counts, 1)) * 4).astype(np.uint8)  # what is about as rare is taken by hash
    most = CHUNK

    def chunks(batches):
        parts, n = [], 0
        for batch in pieces(batches):
            for i, tag, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), raw_texts(batch.column(2))):
                words = t.split()
                if len(words) >= window:
                    parts.append((i, tag, words))
                    n += len(words) - window + 1
                if n >= most:
                    yield parts
                    parts, n = [], 0
        if parts:
            yield parts

    bins = max(BINS, 1 << (16 * groups - 1).bit_length())
    crowded = _crowded(rows, chunks, rank, counts, window, prefix, bins, GROUP // 4)

    def spread(batches):
        for c, parts in enumerate(chunks(batches)):
            name = (TaskContext.get().partitionId() << 24) + c
            parts.sort(key=lambda x: x[:2])
            ids, tags = np.array([p[0] for p in parts], np.int64), np.array([p[1] for p in parts], np.int64)
            sizes = np.array([len(p[2]) - window + 1 for p in parts], np.int64)
            ends = np.cumsum(sizes)
            long = np.array([len(p[2]) for p in parts], np.int64)
            flat, known = numbered(b" ".join([b" ".join(p[2]) for p in parts]) + b" ")
            del parts
            hashes = _known_hashes(known)
            first = np.cumsum(long) - long
            doc = np.repeat(np.arange(len(ids)), sizes)
            starts = np.arange(len(doc)) - np.repeat(ends - sizes, sizes) + first[doc]
            # what this chunk can decide alone: a suffix that also starts in a smaller id of the chunk
            node = subtree(flat, starts, window)
            twice = np.flatnonzero(node >= 0)
            low = np.full(int(node.max(initial=-1)) + 1, np.iinfo(np.int64).max)
            np.minimum.at(low, node[twice], ids[doc[twice]])
            gone = np.zeros(len(doc), bool)
            gone[twice] = ids[doc[twice]] > low[node[twice]]
            yield record(name, -1 - name, planes(ids), planes(ends.astype(np.uint32)), planes(tags), planes(np.flatnonzero(gone).astype(np.uint32)))
            found = []
            for f, n in zip(first, long):
                w = hashes[flat[f : f + n]]
                at, key = anchors(w, rank, window, prefix)
                found.append((at + f, lengthened(w, np.arange(len(at)), at, key, window, prefix, crowded, bins) if crowded else key))
            at, key = (np.concatenate(x) for x in zip(*found))
            sent = np.flatnonzero(~gone)
            if not len(sent):
                continue
            # pieces: runs of suffixes one after the other that share a stretch and a prefix
            new = np.r_[True, (np.diff(sent) != 1) | (np.diff(at[sent]) != 0) | (key[sent][1:] != key[sent][:-1]) | (np.diff(doc[sent]) != 0)]
            head = np.flatnonzero(new)
            many = np.diff(np.r_[head, len(sent)])
            head = sent[head]
            group = (mixed(key[head] + np.uint64(1)) % np.uint64(groups)).astype(np.int64)
            by = np.argsort(group, kind="stable")
            edges = np.flatnonzero(np.r_[True, np.diff(group[by]) != 0, True])
            for i, j in zip(edges[:-1].tolist(), edges[1:].tolist()):
                own = by[i:j]
                size = many[own] + window - 1
                text = spelled(flat[np.repeat(starts[head[own]] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))], known)
                held = np.unique(doc[head[own]])  # the table of a record names only the documents it holds, so records stay in proportion
                yield record(name, int(group[own[0]]), planes(ids[held]), planes(ends[held].astype(np.uint32)), zstandard.compress(text, 1), planes(np.r_[np.diff(head[own], prepend=0).astype(np.int32), many[own].astype(np.int32)]))

    def record(name, g, ids, ends, a, b):
        return pa.record_batch([pa.array([name], pa.int64()), pa.array([g], pa.int64()), *[pa.array([x], pa.binary()) for x in (ids, ends, a, b)]], names=["chunk", "g", "ids", "ends", "a", "b"])

    return rows.mapInArrow(spread, "chunk bigint, g bigint, ids binary, ends binary, a binary, b binary")


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, tag, spans array<int>): the word spans [start, end) that windows of smaller ids cover, by document.

    ``tag`` is xxhash64 of the text, which tells apart rows that share an id.
    """

    def nodes(key, pdf):
        """Deep internal nodes of one group's subtree: what lies below them but in their smallest id goes."""
        if key[0] < 0:  # a chunk's own table passes
            return pd.DataFrame({"chunk": pdf["chunk"], "ids": pdf["ids"], "ends": pdf["ends"], "tags": pdf["a"], "gone": pdf["b"]})
        starts, who, at, low, base = [], [], [], [], 0
        for j, (ids, ends, b) in enumerate(zip(pdf["ids"], pdf["ends"], pdf["b"])):
            head, many = np.split(unplanes(b, np.int32).astype(np.int64), 2)
            head = np.cumsum(head)
            long = many + window - 1
            step = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
            starts.append(base + np.repeat(np.cumsum(long) - long, many) + step)
            base += int(long.sum())
            idx = np.repeat(head, many) + step
            who.append(np.full(len(idx), j, np.int32))
            at.append(idx)
            low.append(unplanes(ids, np.int64)[np.searchsorted(unplanes(ends, np.uint32), idx, "right")])
        flat, _ = numbered(b"".join(map(zstandard.decompress, pdf["a"])))
        starts, who, at, low = map(np.concatenate, (starts, who, at, low))
        node = subtree(flat, starts, window)
        twice = np.flatnonzero(node >= 0)
        least = np.full(int(node.max(initial=-1)) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, node[twice], low[twice])
        gone = twice[low[twice] > least[node[twice]]]
        who, at = who[gone], at[gone]
        names, out = pdf["chunk"].to_numpy(), []
        order = np.lexsort((at, who))
        edges = np.flatnonzero(np.r_[True, np.diff(who[order]) != 0, True]) if len(order) else []
        for i, j in zip(edges[:-1], edges[1:]):
            out.append((int(names[who[order[i]]]), None, None, None, planes(at[order[i:j]].astype(np.uint32))))
        return pd.DataFrame(out, columns=["chunk", "ids", "ends", "tags", "gone"])

    def spans(pdf):
        own = pdf[pdf["ids"].notna()].iloc[0]
        ids, ends, tags = unplanes(own["ids"], np.int64), unplanes(own["ends"], np.uint32), unplanes(own["tags"], np.int64)
        mark = np.zeros(int(ends[-1]) + 1, np.int8)
        for blob in pdf["gone"]:
            mark[unplanes(blob, np.uint32)] = 1
        out = []
        for k, (lo, hi) in enumerate(zip(np.r_[0, ends[:-1]].astype(np.int64), ends.astype(np.int64))):
            at = np.flatnonzero(mark[lo:hi])
            if len(at):
                cut = np.flatnonzero(np.diff(at) > window)
                out.append((int(ids[k]), int(tags[k]), np.ravel(np.column_stack([at[np.r_[0, cut + 1]], at[np.r_[cut, len(at) - 1]] + window])).tolist()))
        return pd.DataFrame(out, columns=["id", "tag", "spans"])

    found = suffix_groups(docs, id_col, text_col, window).groupBy("g").applyInPandas(nodes, "chunk bigint, ids binary, ends binary, tags binary, gone binary")
    found = written(found, "substring-nodes")
    return found.groupBy("chunk").applyInPandas(spans, "id bigint, tag bigint, spans array<int>")


def _kept(text: bytes, spans) -> tuple[list[bytes], int]:
    words = text.split()
    if not spans:
        return words, len(words)
    keep = np.ones(len(words), bool)
    for a, b in zip(spans[::2], spans[1::2]):
        keep[a:b] = False
    return [words[i] for i in np.flatnonzero(keep).tolist()], len(words)


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row for each input row: id, text (kept words, one space between), n_words, n_removed, kept_sha256.

    A word goes if a window over it also starts in a row of smaller id. Null
    text has no words; fewer words than the window are never covered. A null id is
    neither smaller nor larger than any, so its row stays whole and removes
    nothing. Rows that share an id don't remove each other's words. Very long texts
    are taken whole: a text is held by one task, as its row is. Bytes that aren't UTF-8 are
    compared as they are and replaced in the returned text. An empty
    table gives no rows; other columns are not read and may have any name.
    """
    # rows equal in id and text are equal in spans: one of each suffices
    found = repeats(docs, id_col, text_col, window).groupBy("id", "tag").agg(F.first("spans").alias("spans"))
    left = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    joined = left.withColumn("tag", F.xxhash64("t")).join(found, ["id", "tag"], "left").select("id", "t", "spans")

    def run(batches):
        for batch in pieces(batches):
            out, n, gone, sha = [], [], [], []
            for t, s in zip(raw_texts(batch.column(1)), batch.column(2).to_pylist()):
                words, all_ = _kept(t, s)
                out.append(b" ".join(words))
                n.append(all_)
                gone.append(all_ - len(words))
                sha.append(hashlib.sha256(out[-1]).hexdigest())
            yield pa.record_batch([batch.column(0), pa.array([x.decode("utf-8", "replace") for x in out], pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], names=["id", "text", "n_words", "n_removed", "kept_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = joined.mapInArrow(run, f"id {kind}, text string, n_words bigint, n_removed bigint, kept_sha256 string")
    return out.withColumnRenamed("id", id_col)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(documents(spark, sf_dir)).drop("text")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), p AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13
), g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM p),
m AS (SELECT s, min(doc_id) AS low FROM g GROUP BY s),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM g JOIN m USING (s) WHERE low < doc_id),
t AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
k AS (
  SELECT t.doc_id, count(c.i) AS gone, string_agg(word, ' ' ORDER BY t.i) FILTER (c.i IS NULL) AS s
  FROM t LEFT JOIN c ON t.doc_id = c.doc_id AND t.i = c.i GROUP BY t.doc_id
)
SELECT d.doc_id, len(w)::bigint AS n_words, coalesce(gone, 0)::bigint AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
