"""SimHash near-duplicates: fingerprints linked within a Hamming radius by sharded BK-trees.

64-bit fingerprints within a few bits are linked without loss (``links``).
Texts of similarity 0.8 differ in more bits than any choice of bits survives, so
their 256-bit fingerprints are searched in shards of texts that share one of their
least shingles, and each pair found there is held against the shingles themselves
(``similar_documents``).
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, mixed, pieces, raw_texts, written
from .components import connected_components, local_roots

SEED = 42
#: Rows a task's group of shards holds; shards of more fingerprints than BLOCK are cut into pairs of blocks.
GROUP, BLOCK = 40_000, 512
#: Words of a wide fingerprint, and the most bits in which two may differ: texts whose sets of shingles have a similarity of 0.8
#: differ in 39 of 256 bits, give or take 6; the shingles decide between pairs. Sets of up to SHORT shingles spread more (four and
#: five shingles: 48, give or take 6), so they are searched within SHORT_RADIUS.
WIDE, WIDE_RADIUS, SHORT, SHORT_RADIUS = 4, 70, 80, 90
#: Shards of a text: its KEYS least shingles that are in at most COMMON texts, looked for among its LOOKED least ones. Two texts of
#: similarity 0.8 share none of sixteen with a chance of 0.2 ** 16, and not at all if they have few shingles.
KEYS, LOOKED, COMMON = 16, 48, 512
#: Keys of a text in the first round, and shingles a task holds when it compares sets.
FIRST, HELD = 2, 1 << 21


def _shingle_hashes(text: bytes, shingle_words: int):
    """Arrays of the hashes of a text's shingles, at most 65,536 at a time; none if it has no word."""
    words = text.lower().split()  # bytes: A-Z only, and exactly the white space 0x09-0x0D and 0x20
    n = len(words)
    if not n:
        return
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle_words, n)
    digest = xxhash.xxh64_intdigest
    total = n - k + 1
    a, b = starts[:total].tolist(), ends[k - 1 :].tolist()
    for at in range(0, total, 1 << 16):
        yield np.array([digest(joined[i:j], SEED) for i, j in zip(a[at : at + (1 << 16)], b[at : at + (1 << 16)])], np.uint64)


def _bit_counts(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprint(text: bytes, shingle_words: int = 4) -> int:
    """The SimHash of one text, repeats included, as an unsigned number; zero if it has no word."""
    counts, total = np.zeros(64, np.int64), 0
    for h in _shingle_hashes(text, shingle_words):
        counts += _bit_counts(h)
        total += len(h)
    return int(sum(1 << j for j in np.flatnonzero(counts * 2 > total).tolist()))


def _set(text: bytes, shingle_words: int) -> np.ndarray:
    """The set of hashes of a text's shingles, ascending."""
    return np.unique(np.concatenate([np.empty(0, np.uint64), *_shingle_hashes(text, shingle_words)]))


def wide_fingerprint(h: np.ndarray) -> np.ndarray:
    """A SimHash of 64 * WIDE bits of a set of hashes, as WIDE unsigned numbers; zeros if it is empty."""
    out = np.zeros(WIDE, np.uint64)
    for i in range(WIDE if len(h) else 0):
        counts = _bit_counts(mixed((h ^ np.uint64(i * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)))
        out[i : i + 1] = np.packbits(counts * 2 > len(h), bitorder="little").view(np.uint64)
    return out


def least_shingles(h: np.ndarray) -> np.ndarray:
    """The LOOKED least of a set, in an order drawn by hash; numbers of 63 bits."""
    x = mixed(h * np.uint64(0x94D049BB133111EB)) >> np.uint64(1)
    return np.sort(np.partition(x, LOOKED)[:LOOKED] if len(x) > LOOKED else x).view(np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 4) -> DataFrame:
    """(id, fp bigint) of every row; null text counts as empty and gets 0."""

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t, shingle_words) for t in raw_texts(batch.column(1))], np.uint64).view(np.int64)
            yield pa.record_batch([batch.column(0), pa.array(fps, pa.int64())], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, f"id {kind}, fp bigint")


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which fingerprints differ, row by row; one number each, or several in columns."""
    d = np.bitwise_count(a ^ b)
    return d.astype(np.int64) if d.ndim == 1 else d.sum(axis=1, dtype=np.int64)


class BKTrees:
    """One BK-tree for each group of distinct fingerprints, built and searched level by level with NumPy.

    ``group`` is ascending. The first fingerprint of a group is its root; a
    node's children are keyed by their integer distance to it.
    """

    def __init__(self, group: np.ndarray, fp: np.ndarray):
        self.group, self.fp = group, fp
        self.bits = 64 if fp.ndim == 1 else 64 * fp.shape[1]
        self.groups, first = np.unique(group, return_index=True)
        self.first = first
        at = first[np.searchsorted(self.groups, group)]
        active = np.flatnonzero(at != np.arange(len(fp)))
        keys, nodes = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        while len(active):
            d = _distance(fp[active], fp[at[active]])
            key, where, back = np.unique(at[active] * (self.bits + 1) + d, return_index=True, return_inverse=True)
            child = active[where]
            keys.append(key)
            nodes.append(child)
            at[active] = child[back]
            active = active[at[active] != active]
        key, node = np.concatenate(keys), np.concatenate(nodes)
        order = np.argsort(key, kind="stable")
        self.key, self.node = key[order], node[order]

    def within(self, group: np.ndarray, fp: np.ndarray, radius: int | np.ndarray, chunk: int = 4096):
        """Yield (query index, node index) arrays of all pairs at most ``radius`` bits apart, which may be a number for each query."""
        radii = np.broadcast_to(radius, len(fp))
        known = np.searchsorted(self.groups, group)
        ok = (known < len(self.groups)) & (self.groups[np.minimum(known, len(self.groups) - 1)] == group)
        queries = np.flatnonzero(ok)
        for i in range(0, len(queries), chunk):
            q = queries[i : i + chunk]
            node = self.first[known[q]]
            while len(q):
                d = _distance(fp[q], self.fp[node])
                r = radii[q]
                near = d <= r
                if near.any():
                    yield q[near], node[near]
                at = node * (self.bits + 1)
                lo = np.searchsorted(self.key, at + np.maximum(d - r, 0))
                hi = np.searchsorted(self.key, at + np.minimum(d + r, self.bits), "right")
                n = hi - lo
                total = int(n.sum())
                q = np.repeat(q, n)
                step = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
                node = self.node[np.repeat(lo, n) + step]


def _plan(n: int, radius: int) -> tuple[int, int]:
    """(blocks, kept): the fewest keys a fingerprint needs for shards of about 64 among ``n`` spread fingerprints."""
    for keep in range(1, 9):
        blocks = radius + keep
        if n >> (64 * keep // blocks) <= 64:
            break
    return blocks, keep


def _shards(fps: DataFrame, n: int, radius: int) -> DataFrame:
    blocks, keep = _plan(n, radius)
    edges = [64 * i // blocks for i in range(blocks + 1)]
    part = [F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << (b - a)) - 1)) if b - a < 64 else F.col("fp") for a, b in zip(edges, edges[1:])]
    keys = [F.xxhash64(F.lit(i), *[part[j] for j in kept]) for i, kept in enumerate(combinations(range(blocks), keep))]
    return fps.select("fp", F.explode(F.array(*keys)).alias("shard"))


def links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """Edges (u, v) that join all distinct fingerprints ``fp`` within ``radius`` bits; a forest, not all pairs.

    Two fingerprints within r bits agree on at least k of r + k blocks, so each
    goes to one shard for every choice of k blocks, k growing with the number
    of fingerprints. A shard holds its own BK-tree and its own queries, so no
    tree is broadcast. A shard larger than BLOCK is cut into all pairs of its
    blocks: a tree of one block, searched with the other.
    """
    n = fps.count()
    return _linked(_shards(fps, n, radius), "fp", max(1, -(-n * 5 // GROUP)), radius)


def _linked(rows: DataFrame, node: str, groups: int, radius: int) -> DataFrame:
    """Edges (u, v) that join rows of one ``shard`` whose fingerprints ``node`` are within the radius."""
    large = rows.groupBy("shard").agg(F.count("*").alias("m")).where(F.col("m") > BLOCK).select("shard", F.ceil(F.col("m") / BLOCK).alias("nb"))
    rows = rows.join(large, "shard", "left").withColumn("nb", F.coalesce("nb", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64(node, F.lit("block")), F.col("nb"))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    rows = rows.select(F.xxhash64("shard", F.least("own", "other"), F.greatest("own", "other")).alias("tree"), node, (F.col("own") <= F.col("other")).alias("in_tree"), (F.col("own") >= F.col("other")).alias("asks"))

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tree", node], kind="stable")
        tree, fp = pdf["tree"].to_numpy(np.int64), pdf[node].to_numpy(np.int64).view(np.uint64)
        values, ids = np.unique(pdf[node].to_numpy(np.int64), return_inverse=True)
        nodes, asks = np.flatnonzero(pdf["in_tree"].to_numpy(bool)), np.flatnonzero(pdf["asks"].to_numpy(bool))
        root = np.arange(len(values))
        if len(nodes):
            for q, v in BKTrees(tree[nodes], fp[nodes]).within(tree[asks], fp[asks], radius):
                a, b = root[ids[asks[q]]], root[ids[nodes[v]]]
                differ = a != b
                if differ.any():
                    root = local_roots(len(values), a[differ], b[differ])[root]
        moved = np.flatnonzero(root != np.arange(len(values)))
        return pd.DataFrame({"u": values[moved], "v": values[root[moved]]})

    return rows.withColumn("g", F.pmod("tree", F.lit(groups))).groupBy("g").applyInPandas(lambda pdf: search(pdf), "u bigint, v bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 4, radius: int = 4) -> DataFrame:
    """One row for each input row: id, fingerprint (16 hex digits), component_id (smallest id reachable).

    Null or empty texts have fingerprint zero and link like any other. Rows
    that repeat an id are all kept. Rows with a null id are linked too but never
    name a component unless all of its ids are null (then it is null).
    An empty table gives no rows. Very long texts are hashed whole, in parts. Only id and text are read; other columns never clash.
    """
    own = written(fingerprints(docs, id_col, text_col, shingle_words), "fingerprints")
    per = written(own.groupBy("fp").agg(F.min("id").alias("low")), "distinct-fingerprints")
    out = _with_component(own, per, "fp", links(per.select("fp"), radius))
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _with_component(own: DataFrame, per: DataFrame, key: str, edges: DataFrame) -> DataFrame:
    """``own`` with component_id, the smallest ``low`` of the distinct fingerprints ``per`` that the edges join."""
    roots = connected_components(edges).select(F.col("node").alias(key), "root")
    per = per.join(roots, key, "left").withColumn("root", F.coalesce("root", key))
    lowest = per.groupBy("root").agg(F.min("low").alias("component_id"))
    return own.join(per.join(lowest, "root").select(key, "component_id"), key)


_WORDS = [f"f{i}" for i in range(WIDE)]


def _wide(docs: DataFrame, id_col: str, text_col: str, shingle_words: int, sets: bool) -> DataFrame:
    """(id, a, b) of every row, 128 bits that name its set of shingles; and the set if asked, else its size n, fingerprint and least shingles."""

    def run(batches):
        for batch in pieces(batches, 200):
            found = [_set(t, shingle_words) for t in raw_texts(batch.column(1))]
            names = np.frombuffer(b"".join(xxhash.xxh3_128_digest(h.tobytes()) for h in found), np.int64).reshape(-1, 2)
            out = [batch.column(0), *(pa.array(np.ascontiguousarray(names[:, i])) for i in (0, 1))]
            if sets:
                yield pa.record_batch([*out, pa.array([h.tobytes() for h in found], pa.binary())], names=["id", "a", "b", "shingles"])
                continue
            fps = np.array([wide_fingerprint(h) for h in found], np.uint64).reshape(-1, WIDE).view(np.int64)
            out += [pa.array([len(h) for h in found], pa.int64()), *(pa.array(np.ascontiguousarray(fps[:, i])) for i in range(WIDE)), pa.array([least_shingles(h) for h in found], pa.list_(pa.int64()))]
            yield pa.record_batch(out, names=["id", "a", "b", "n", *_WORDS, "least"])

    kind = f"id {docs.schema[id_col].dataType.simpleString()}, a bigint, b bigint, "
    kind += "shingles binary" if sets else "n bigint, " + ", ".join(f"{w} bigint" for w in _WORDS) + ", least array<bigint>"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, kind)


def _keys(per: DataFrame) -> DataFrame:
    """(node, keys): the shards of each distinct set that shares a least shingle with another.

    Shingles of one text are no key. In one order of all shingles - those of more than COMMON texts last,
    otherwise as ``least_shingles`` has them - a text takes its first KEYS; one with fewer uncommon
    ones (a member of a large family) takes its KEYS least of all as well.
    """
    each = per.select("node", F.explode("least").alias("key"))
    shared = each.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key", (F.col("m") > COMMON).alias("hot"))
    x = each.join(shared, "key").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("key", "hot"))).alias("x"))  # LOOKED at most
    rare = F.transform(F.filter("x", lambda k: ~k["hot"]), lambda k: k["key"])
    least = F.transform(F.slice("x", 1, KEYS), lambda k: k["key"])
    return x.select("node", F.array_sort(F.when(F.size(rare) >= KEYS, F.slice(rare, 1, KEYS)).otherwise(F.array_union(rare, least))).alias("keys"))


def _pairs(pdf: pd.DataFrame, radius: int, similarity: float):
    """Yield row numbers (a, b) of pairs that a BK-tree of ``pdf`` finds within the radius of the asking set's size: of unlike label, of sizes that allow
    the similarity, and whose least common key is the shard's, so that no other shard looks at them."""
    tree, fp = pdf["tree"].to_numpy(np.int64), np.ascontiguousarray(pdf[_WORDS].to_numpy(np.int64)).view(np.uint64)
    label, key, n = pdf["label"].to_numpy(np.int64), pdf["key"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
    nodes, asks = np.flatnonzero(pdf["in_tree"].to_numpy(bool)), np.flatnonzero(pdf["asks"].to_numpy(bool))
    if not len(nodes):
        return
    wide = 2 * KEYS
    keys = np.full((len(pdf), wide), -1, np.int64)
    for i, k in enumerate(pdf["keys"]):
        keys[i, : len(k)] = k
    earlier = (keys >= 0) & (keys < key[:, None])
    radii = np.where(n[asks] <= SHORT, max(radius, SHORT_RADIUS), radius)
    for q, v in BKTrees(tree[nodes], fp[nodes]).within(tree[asks], fp[asks], radii):
        a, b = asks[q], nodes[v]
        low, high = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
        ok = (label[a] != label[b]) & (low >= similarity * high)
        a, b = a[ok], b[ok]
        for at in range(0, len(a), 2048):
            i, j = a[at : at + 2048], b[at : at + 2048]
            both = (keys[i][:, :, None] == keys[j][:, None, :]).any(axis=2)
            fresh = ~(both & earlier[i]).any(axis=1)
            if fresh.any():
                yield i[fresh], j[fresh]


def _alike(rows: DataFrame, light: DataFrame, fetch, similarity: float, radius: int, name: str) -> DataFrame:
    """Edges (u, v) between nodes of one tree that are really alike: forests of what each tree holds.

    ``rows``: tree, key, node, label, in_tree, asks. First the fingerprints tell which rows have a
    partner within the radius; only these get their sets of shingles (``fetch``), which then decide. Pairs
    are told apart by the trees' own order, and those already joined aren't looked at, so a tight group costs one comparison a member.
    """
    cols = ["tree", "key", "node", "label", "in_tree", "asks"]
    full = rows.join(light, "node")
    groups = max(1, -(-rows.count() // GROUP))

    def flag(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tree", "node"], kind="stable").reset_index(drop=True)
        near = np.zeros(len(pdf), bool)
        for a, b in _pairs(pdf, radius, similarity):
            near[a] = near[b] = True
        return pdf.loc[near, [*cols, "n"]]

    kinds = {f.name: f.dataType.simpleString() for f in full.schema}
    near = full.withColumn("g", F.pmod("tree", F.lit(groups))).groupBy("g").applyInPandas(flag, ", ".join(f"{c} {kinds[c]}" for c in [*cols, "n"]))
    near = written(near, f"{name}-near")
    size = near.agg(F.sum("n")).first()[0]
    if not size:
        return near.select(F.col("node").alias("u"), F.col("node").alias("v"))
    sets = fetch(near.select("node").distinct())
    parts = max(1, -(-size // HELD))

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tree", "node"], kind="stable").reset_index(drop=True)
        held = [np.frombuffer(x, np.uint64) for x in pdf["shingles"]]
        node, up = pdf["node"].to_numpy(np.int64), {}

        def top(x):
            while (y := up.get(x, x)) != x:
                up[x] = x = up.get(y, y)
            return x

        for label, x in zip(pdf["label"].tolist(), node.tolist()):  # what is joined already
            up.setdefault(x, top(-1 - label))
        found = []
        for a, b in _pairs(pdf, radius, similarity):
            for i, j in zip(a.tolist(), b.tolist()):
                x, y = top(int(node[i])), top(int(node[j]))
                if x == y:
                    continue
                both = len(np.intersect1d(held[i], held[j], assume_unique=True))
                if both >= similarity * (len(held[i]) + len(held[j]) - both):
                    up[x] = y
                    found.append((node[i], node[j]))
        return pd.DataFrame(found, columns=["u", "v"]).astype("int64")

    whole = near.drop("n").join(light, "node").join(sets, "node").withColumn("g", F.pmod("tree", F.lit(parts)))
    return whole.groupBy("g").applyInPandas(verify, "u bigint, v bigint")


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, similarity: float = 0.8, radius: int = WIDE_RADIUS) -> DataFrame:
    """One row for each input row: id, component_id, linking texts whose sets of shingles are ``similarity`` alike or more.

    Texts of equal sets are one node. A node goes to the shards of its keys (``_keys``). The first round compares
    the members of its least keys' shards in blocks, each with the shard's least node as well, so that large families of near copies
    mostly join at a cost in proportion. The second takes every shard that still holds several groups, and compares all its
    nodes outside its largest group with all the others. In both, BK-trees over wide fingerprints find the
    pairs within ``radius`` bits, or SHORT_RADIUS where the asking set has at most SHORT shingles (a partner of a set of 64 or fewer
    has no more than that), and the sets of shingles decide on each of them. At 0.8 a pair of long texts lies beyond the radius
    or shares no key with a chance of about 3 in 10 million; one with a set of 64 or fewer, of any size, with less than one in a billion (for
    four and five shingles, which spread most, binomial sums give 2 in 10 billion).

    Null texts count as empty; texts without a word are one group; texts of under ``shingle_words`` words are
    alike if equal. Very long texts are taken whole. Repeated rows, repeated and null ids, empty tables and other columns are as in ``near_duplicates``.
    """
    own = written(_wide(docs, id_col, text_col, shingle_words, False), "wide-fingerprints")
    per = own.groupBy("a", "b").agg(F.min("id").alias("low"), F.first("n").alias("n"), *[F.first(w).alias(w) for w in _WORDS], F.first("least").alias("least"))
    per = written(per.withColumn("node", F.monotonically_increasing_id()), "distinct-wide-fingerprints")
    light = written(_keys(per).join(per.select("node", "n", *_WORDS), "node"), "shingle-keys")

    def fetch(nodes: DataFrame) -> DataFrame:
        """(node, shingles) of some nodes, from the text of their smallest id."""
        asked = per.join(nodes, "node", "left_semi").select("node", "a", "b", "low")
        some = docs.select(id_col, text_col).join(asked.select("low").distinct(), F.col(id_col).eqNullSafe(F.col("low")), "left_semi")
        return asked.drop("low").join(_wide(some, id_col, text_col, shingle_words, True).drop("id"), ["a", "b"]).groupBy("node").agg(F.any_value("shingles").alias("shingles"))

    each = light.select("node", F.explode(F.slice("keys", 1, FIRST)).alias("key"))
    shards = each.groupBy("key").agg(F.count("*").alias("m"), F.min("node").alias("least")).where("m > 1").withColumn("nb", F.ceil(F.col("m") / BLOCK))
    block = lambda x: F.xxhash64("key", x)
    members = each.join(shards.select("key", "nb"), "key").select(block(F.pmod(F.xxhash64("node"), F.col("nb"))).alias("tree"), "key", "node", F.col("node").alias("label"), F.lit(True).alias("in_tree"), F.lit(True).alias("asks"))
    firsts = shards.where("nb > 1").select("key", F.col("least").alias("node"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("nb") - 1)).alias("at"))
    firsts = firsts.select(block(F.col("at")).alias("tree"), "key", "node", F.col("node").alias("label"), F.lit(True).alias("in_tree"), F.lit(False).alias("asks"))
    one = written(_alike(members.unionByName(firsts), light, fetch, similarity, radius, "first-round"), "first-links")

    roots = connected_components(one)
    each = light.join(roots, "node", "left").select("node", F.explode("keys").alias("key"), F.coalesce("root", "node").alias("label"))
    each = written(each, "labelled-keys")
    count = each.groupBy("key", "label").agg(F.count("*").alias("m"))
    open_ = count.groupBy("key").agg(F.sum("m").alias("m"), F.count("*").alias("labels"), F.max_by("label", "m").alias("most")).where("labels > 1").select("key", "most", F.ceil(F.col("m") / BLOCK).alias("nb"))
    left = each.join(open_, "key")
    here = left.select(block(F.pmod(F.xxhash64("node"), F.col("nb"))).alias("tree"), "key", "node", "label", F.lit(True).alias("in_tree"), F.lit(False).alias("asks"))
    there = left.where("label <> most").withColumn("at", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("nb") - 1)))
    there = there.select(block(F.col("at")).alias("tree"), "key", "node", "label", F.lit(False).alias("in_tree"), F.lit(True).alias("asks"))
    two = _alike(here.unionByName(there), light, fetch, similarity, radius, "second-round")
    edges = written(one.unionByName(two), "all-links")
    return _with_component(own.select("id", "a", "b").join(per.select("a", "b", "node"), ["a", "b"]), per.select("node", "low"), "node", edges).select(F.col("id").alias(id_col), "component_id")


def op2_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), shingle_words=4, radius=4)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", find=near_duplicates, **how) -> DataFrame:
    """The rows that are the first of their group: one row for each component that ``find`` gives, columns unchanged.

    Of rows that repeat the smallest id of a component, one stays (the first by
    text). Rows of a component without any id are one group as well.
    """
    groups = find(docs, id_col, text_col, **how).where(F.col(id_col).eqNullSafe(F.col("component_id")))
    keep = groups.select(F.col(id_col).alias("__id")).groupBy("__id").agg(F.count("*").alias("__n"))
    kept = docs.join(keep, docs[id_col].eqNullSafe(F.col("__id")))
    single = kept.where("__n = 1").select(*[docs[c] for c in docs.columns])
    first = F.min_by(F.struct(*[docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns)]), F.struct(docs[text_col]))
    several = kept.where("__n > 1").groupBy("__id").agg(first.alias("r")).select(*[F.col(f"r.c{i}").alias(c) for i, c in enumerate(docs.columns)])
    return single.unionByName(several)
