"""Text operators against brute force, on rows with nulls, empties, repeats and long texts."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyspark.llm import bpe, langid, linededup, mixing, mixlm, simhash, substrings

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, t string, fp long"


def corpus(seed=1, n=150):
    """Random texts with copies, near copies, shared passages, repeated lines and odd rows."""
    rng = random.Random(seed)
    words = [a + b for a in "ka lo mi ren sta vo the of".split() for b in ("", "ne", "ri", "to", "sel")]
    texts, passage = [], " ".join(rng.choice(words) for _ in range(30))
    for i in range(n):
        t = "\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(3, 40))) for _ in range(rng.randint(1, 5)))
        if i % 7 == 0:
            t += "\n" + passage + "\n" + t[:20]
        if i % 3 == 0:
            t += f"\nposted by user {rng.randint(1, 10**6)} on day {rng.randint(1, 99)} of the year"
        if i % 5 == 0 and texts:
            t = texts[rng.randrange(len(texts))]
        if i % 11 == 0 and texts:
            t = texts[-1].replace(" ", "  ", 1) + " extra"
        texts.append(t)
    rows = [(i, t, ("en", "de")[i % 2], f"s{i % 5}" if i % 13 else None, len(t)) for i, t in enumerate(texts)]
    rows += [(1000, None, "en", "s0", None), (1001, "", None, None, 0), (1002, " \t\n", "de", "s1", 3), (None, texts[0], "en", "s2", 5), (7, texts[7], "de", "s2", 1), (7, "other text under the same id", "en", "s0", 2)]
    rows += [(1003, " ".join(words[i % 40] for i in range(30_000)), "en", "s3", 9), (1004, "ÄÖ\x1cé x y 漢字 🙂\x0b\x00z don't  'll", "en", "s3", 1)]
    return [r + ("clash", "clash", 3) for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute_fp(t, k=4):
    w = words_of(lower(t))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for j in range(64):
            counts[j] += h >> j & 1
    return sum(1 << j for j in range(64) if counts[j] * 2 > len(shingles))


class TestSimHash:
    def test_brute_force(self, docs):
        rows = docs.collect()
        fps = [brute_fp(r.text) for r in rows]
        parent = list(range(len(rows)))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for i in range(len(rows)):
            for j in range(i):
                if (fps[i] ^ fps[j]).bit_count() <= 4:
                    parent[find(i)] = find(j)
        groups = defaultdict(list)
        for i, r in enumerate(rows):
            groups[find(i)].append(r.doc_id)
        least = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
        want = Counter((r.doc_id, f"{fps[i]:016x}", least[find(i)]) for i, r in enumerate(rows))
        got = Counter(tuple(r) for r in simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id").collect())
        assert got == want

    @pytest.mark.parametrize("block", [512, 8])
    def test_large_groups_of_near_copies(self, spark, block, monkeypatch):
        """Blocks of a shard meet in pairs and lose no link."""
        monkeypatch.setattr(simhash, "BLOCK", block)
        rng = np.random.default_rng(3)
        base = rng.integers(0, 1 << 63, 3, dtype=np.int64)
        fps = set()
        for b in base.tolist():
            for _ in range(60):
                fps.add(b ^ sum(1 << int(x) for x in rng.integers(0, 63, 2)))
        fps = sorted(fps | set(rng.integers(0, 1 << 63, 50, dtype=np.int64).tolist()))
        df = spark.createDataFrame([(x,) for x in fps], "fp long").repartition(3)
        from tallyspark.llm.components import connected_components

        roots = {r.node: r.root for r in connected_components(simhash.links(df, 4)).collect()}
        n = len(fps)
        label = list(range(n))
        changed = True
        near = [(i, j) for i in range(n) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
        while changed:
            changed = False
            for i, j in near:
                m = min(label[i], label[j])
                if label[i] != m or label[j] != m:
                    label[i] = label[j] = m
                    changed = True
        assert {x: roots.get(x, x) for x in fps} == {x: fps[label[i]] for i, x in enumerate(fps)}

    def test_more_blocks(self):
        """The plan takes more blocks as fingerprints grow."""
        assert simhash._plan(100, 4) == (5, 1)
        assert simhash._plan(10**7, 4)[1] > 1

    def test_empty(self, empty):
        assert simhash.near_duplicates(empty).count() == 0

    def test_one_of_each(self, docs):
        kept = simhash.one_of_each(docs)
        assert kept.columns == docs.columns
        ids = {r.component_id for r in simhash.near_duplicates(docs).collect()}
        assert Counter(r.doc_id for r in kept.collect()) == Counter(ids)

    @pytest.mark.parametrize("common, block", [(512, 512), (4, 3)])
    def test_similarity(self, spark, common, block, monkeypatch):
        """Groups are those that pairs of similarity 0.8 join, no more and no fewer; texts without words form one group."""
        monkeypatch.setattr(simhash, "COMMON", common)
        monkeypatch.setattr(simhash, "BLOCK", block)
        rng = np.random.default_rng(5)
        texts = [None, "", " \t ", "one", "One", "one two"]
        for _ in range(12):
            words = [f"w{x}" for x in rng.integers(0, 5000, 150)]
            texts += [" ".join(words), " ".join(words)]
            for changed in (1, 2, 3, 3, 4, 6, 9, 15):
                copy = list(words)
                for at in rng.integers(0, len(copy), changed):
                    copy[at] = f"x{rng.integers(0, 5000)}"
                texts.append(" ".join(copy))

        def shingles(t):
            w = words_of(lower(t or ""))
            k = min(5, len(w))
            return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()

        sets = [shingles(t) for t in texts]
        label = list(range(len(texts)))
        for i in range(len(texts)):
            for j in range(i):
                both = len(sets[i] & sets[j])
                if sets[i] == sets[j] or both and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                    old, new = max(label[i], label[j]), min(label[i], label[j])
                    label = [new if x == old else x for x in label]
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
        got = {r.doc_id: r.component_id for r in simhash.similar_documents(df).collect()}
        assert got == dict(enumerate(label))
        assert {r.doc_id for r in simhash.one_of_each(df, find=simhash.similar_documents).collect()} == set(got.values())

    def test_short_texts(self, spark):
        """10,000 pairs of 5 to 20 words, one changed at an end, at a similarity of 0.8 or more: none is lost."""
        rng = np.random.default_rng(12)
        rows, like = [], []
        for pair in range(10_000):
            n = int(rng.integers(8, 21))
            words = [f"{pair}w{x}" for x in rng.integers(0, 10**6, n + 1)]
            rows += [(2 * pair, " ".join(words[:n])), (2 * pair + 1, " ".join(words))]
            like.append(n - 4 >= 0.8 * (n - 3))
        got = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
        assert sum(like) == 10_000
        assert [p for p in range(10_000) if got[2 * p + 1] != 2 * p] == []

    def test_similarity_of_nothing(self, empty):
        assert simhash.similar_documents(empty).count() == 0


class TestByteBPE:
    def test_like_the_library(self, docs, empty):
        import public_tokenizers as P
        import tiktoken

        path = P.path("byte_bpe_multi_50k.tiktoken")
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
        rows = {(r.id, bytes(r.decoded)): list(r.ids) for r in bpe.encoded(docs, path, P.PATTERN).collect()}
        for r in docs.collect():
            assert rows[r.doc_id, (r.text or "").encode()] == enc.encode_ordinary(r.text or "")
        assert bpe.digests(empty, path, P.PATTERN).count() == 0

    def test_white_space_and_scripts(self):
        import public_tokenizers as P
        import tiktoken

        path = P.path("byte_bpe_multi_50k.tiktoken")
        ranks = bpe.read_ranks(path)
        enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
        coder = bpe.ByteBPE(bpe.serialise_model(ranks), P.PATTERN)
        rng = random.Random(4)
        pool = [chr(c) for c in list(range(0, 0x300)) + [0x1680, 0x2000, 0x200B, 0x2028, 0x3000, 0x4E00, 0x0E01, 0x1F600, 0xFEFF, 0xAC00]]
        for _ in range(400):
            t = "".join(rng.choice(pool) for _ in range(40))
            ids = np.frombuffer(b"".join(coder.packed(t)), "<u4")
            assert ids.tolist() == enc.encode_ordinary(t)
            assert coder.decode(ids) == t.encode()

    def test_memory_starts_afresh(self, monkeypatch):
        import public_tokenizers as P

        monkeypatch.setattr(bpe, "REMEMBERED", 3)
        coder = bpe.ByteBPE(bpe.serialise_model(bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))), P.PATTERN)
        for t in ("one two three four", "one five two six", "one two"):
            assert coder.decode(np.frombuffer(b"".join(coder.packed(t)), "<u4")) == t.encode()


class TestMix:
    def test_totals(self, docs):
        out = mixing.mix(docs).collect()
        assert len(out) == docs.count()
        size = lambda t: len(words_of(t))
        by, taken, target, largest = Counter(), Counter(), {}, Counter()
        for r in docs.collect():
            by[r.source] += size(r.text)
            largest[r.source] = max(largest[r.source], size(r.text))
        assert Counter((r.doc_id, r["size"]) for r in out) == Counter((r.doc_id, size(r.text)) for r in docs.collect())
        found = mixing.mix(docs.withColumn("doc_id", F.struct("doc_id", "source")), id_col="doc_id").collect()
        for r in found:
            s = r.doc_id.source
            taken[s] += r.taken
            target[s] = r.target
            assert r.source_size == by[s] and 0 <= r.taken <= 2 * r["size"]
        assert math.isclose(sum(target.values()), 1.5 * sum(by.values()), rel_tol=1e-9)
        for s in by:
            assert abs(taken[s] - target[s]) <= largest[s] * 2 + 1
            assert target[s] <= 2 * by[s] + 1e-6

    def test_water_level(self, spark):
        """Targets by a plain loop of resharing."""
        sizes = {"a": 10, "b": 1000, "c": 500, "d": 40, None: 300}
        got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()}
        order = sorted(sizes, key=lambda s: (s is None, s or ""))
        w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
        left, full, want = 1.5 * sum(sizes.values()), set(), {}
        while True:
            rest = [s for s in order if s not in full]
            share = {s: (left - sum(2 * sizes[x] for x in full)) * w[s] / sum(w[x] for x in rest) for s in rest}
            over = [s for s in rest if share[s] > 2 * sizes[s]]
            if not over:
                want = share | {s: 2 * sizes[s] for s in full}
                break
            full |= set(over)
        for s in sizes:
            assert math.isclose(got[s], want[s], rel_tol=1e-9), s

    def test_unbiased_and_stable(self, spark):
        """Over many seeds (ids), a unit is taken as often as its mass says."""
        rows = [(i, "s", 1 + i % 9, 1, 0.3) for i in range(4000)]
        u = spark.createDataFrame(rows, "id long, source string, size long, rows long, x double")
        a = {r.id: r.copies for r in mixing.unit_copies(u).collect()}
        b = {r.id: r.copies for r in mixing.unit_copies(u.repartition(7)).collect()}
        assert a == b and set(a.values()) <= {0, 1}
        words = sum(a[i] * (1 + i % 9) for i in a)
        assert abs(words - 0.3 * sum(r[2] for r in rows)) <= 9
        for k in range(9):
            own = [a[i] for i in a if i % 9 == k]
            assert abs(np.mean(own) - 0.3) < 0.11

    @pytest.mark.parametrize("same", [True, False])
    def test_repeated_ids(self, spark, same):
        """A repeated row that holds a third of its source's words is not rounded as a whole, nor are other texts under one id."""
        rows = [(i, f"a b c d e {i}", "s") for i in range(200)] + [(999, f"a b c d e {'f' if same else chr(97 + i)}", "s") for i in range(101)]
        df = spark.createDataFrame(rows, "doc_id long, text string, source string")
        out = mixing.mix(df, share=0.5).collect()
        assert len(out) == len(rows) and {r.copies for r in out} == {0, 1}
        assert abs(sum(r.taken for r in out) - 0.5 * 6 * len(rows)) <= 6
        if same:
            assert sum(r.copies for r in out if r.doc_id == 999) in (50, 51)
        docs = mixing.mixed_documents(df, share=0.5)
        assert docs.columns == df.columns and docs.count() == sum(r.copies for r in out)

    def test_empty(self, empty, docs):
        assert mixing.mix(empty).count() == 0
        out = mixing.mixed_documents(docs)
        assert out.columns == docs.columns
        assert out.count() == mixing.mix(docs).agg(F.sum("copies")).first()[0]


class TestSubstrings:
    def brute(self, rows):
        low = {}
        for r in rows:
            w = words_of(r.text)
            for k in range(len(w) - 12):
                if r.doc_id is not None:
                    key = tuple(w[k : k + 13])
                    low[key] = min(low.get(key, r.doc_id), r.doc_id)
        out = Counter()
        for r in rows:
            w = words_of(r.text)
            gone = [False] * len(w)
            for k in range(len(w) - 12):
                if r.doc_id is not None and low[tuple(w[k : k + 13])] < r.doc_id:
                    gone[k : k + 13] = [True] * 13
            kept = " ".join(x for x, g in zip(w, gone) if not g)
            out[(r.doc_id, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())] += 1
        return out

    @pytest.mark.parametrize("sizes", [None, (300, 200)])
    def test_brute_force(self, docs, sizes, monkeypatch):
        if sizes:  # many groups and chunks
            monkeypatch.setattr(substrings, "GROUP", sizes[0])
            monkeypatch.setattr(substrings, "CHUNK", sizes[1])
        got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.dedup_substrings(docs).collect())
        assert got == self.brute(docs.collect())
        assert sum(k[2] for k in got) > 0

    def test_words_decide(self, docs, monkeypatch):
        """Hashes only deal suffixes out: where all are alike, the result is the same."""
        monkeypatch.setattr(substrings, "_word_hashes", lambda words: np.zeros(len(words), np.uint64))
        monkeypatch.setattr(substrings, "CHUNK", 500)
        got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.dedup_substrings(docs).collect())
        assert got == self.brute(docs.collect())

    def test_prefixes_grow(self, spark, monkeypatch):
        """A passage in every document: groups stay within twice their size, which four-word prefixes alone exceed; and results are right."""
        rng = np.random.default_rng(8)
        passage = " ".join(f"p{x}" for x in rng.integers(0, 5000, 60))
        rows = []
        for i in range(900):
            own = [f"w{x}" for x in rng.integers(0, 5000, 40)]
            at = int(rng.integers(0, 40))
            rows.append((i, " ".join([*own[:at], passage, *own[at:]])))
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        monkeypatch.setattr(substrings, "GROUP", 600)
        monkeypatch.setattr(substrings, "CHUNK", 1500)  # some 50 chunks, each of which sends the passage once

        def largest():
            sizes = Counter()
            for r in substrings.suffix_groups(df).where("g >= 0").select("g", "b").collect():
                sizes[r.g] += int(np.split(substrings.unplanes(r.b, np.int32), 2)[1].sum())
            return max(sizes.values())

        assert largest() <= 2 * 600
        got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.dedup_substrings(df).collect())
        assert got == self.brute(df.collect())
        monkeypatch.setattr(substrings, "_crowded", lambda *_: {})
        fixed = largest()
        assert fixed > 800, fixed

    def test_prefixes_are_of_the_window(self):
        """Equal windows have equal keys wherever they stand, at every length."""
        rng = np.random.default_rng(4)
        w = rng.integers(0, 1 << 62, 40).astype(np.uint64)
        twice = np.r_[w, rng.integers(0, 1 << 62, 9).astype(np.uint64), w]
        at, key = substrings.anchors(twice, np.zeros(substrings.BINS, np.uint8), 13, 4)
        for over in (4, 7, 12):
            bins = {n: np.arange(16) for n in range(4, over + 1)}
            got = substrings.lengthened(twice, np.arange(len(at)), at, key, 13, 4, bins, 16)
            assert (got[:28] == got[49:77]).all() and len(set(got[:28].tolist())) >= len(set(key[:28].tolist()))
        assert len(set(got.tolist())) == len(got) - 28

    def test_subtree(self):
        rng = np.random.default_rng(3)
        words = np.r_[rng.integers(0, 3, 400), rng.integers(0, 50, 100)].astype(np.int32)
        starts = np.arange(len(words) - 5)
        node = substrings.subtree(words, starts, 5)
        keys = [tuple(words[i : i + 5]) for i in starts]
        many = Counter(keys)
        assert [n >= 0 for n in node] == [many[k] > 1 for k in keys]
        assert len({(n, k) for n, k in zip(node, keys) if n >= 0}) == len({n for n in node if n >= 0}) == sum(v > 1 for v in many.values())

    def test_other_windows_and_odd_rows(self, spark):
        rows = [(1, "a b c d e f"), (2, "x b c d y"), (2, "x b c d y"), (None, "a b c d e f"), (3, None), (4, ""), (5, " c\td\ne ")]
        df = spark.createDataFrame([(*r, "id", 0) for r in rows], "doc_id long, text string, tag string, spans int")
        got = Counter((r.doc_id, r.n_words, r.n_removed) for r in substrings.dedup_substrings(df, window=3).collect())
        assert got == Counter([(1, 6, 0), (2, 5, 3), (2, 5, 3), (None, 6, 0), (3, 0, 0), (4, 0, 0), (5, 3, 3)])

    def test_empty(self, empty):
        assert substrings.dedup_substrings(empty).count() == 0


class TestLanguage:
    def texts(self):
        rng = random.Random(8)
        parts = {"en": "the of ing tion ly er and", "de": "der sch ung keit ein lich und", "fr": "eau les ment que oui tre aux"}
        make = lambda lang, n: " ".join("".join(rng.choice(parts[lang].split()) for _ in range(rng.randint(1, 3))) for _ in range(n))
        rows = [(i, make(lang, rng.randint(5, 80)), lang) for i in range(240) for lang in [("en", "de", "fr")[i % 3]]]
        mixed = [(900 + i, make("en", 150) + " " + make("de", 150), None) for i in range(4)]
        odd = [(950, None, "en"), (951, "", "de"), (952, "123 !? ²", "en"), (None, make("fr", 30), "fr"), (953, make("fr", 10), None)]
        return rows + mixed + odd

    def test_held_out_and_mixtures(self, spark):
        rows = self.texts()
        out = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)).collect()
        assert len(out) == len(rows)
        want = {r[0]: r[2] for r in rows}
        for r in out:
            held = r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 4 == 2
            assert r.held_out == held and 0 <= r.score <= 1
            if r.doc_id in (950, 951, 952):
                assert (r.lang_pred, r.score) == ("und", 0.0)
            elif r.doc_id is not None and r.doc_id < 240:
                assert r.lang_pred == want[r.doc_id]
            elif r.doc_id is not None and 900 <= r.doc_id < 904:
                assert set(r.languages) == {"en", "de"} and 0.4 < r.score < 0.6

    def test_long_texts_are_one(self):
        """The trigrams of a text of several pieces are those of the whole, in order."""
        text = bytes(np.random.default_rng(1).integers(97, 123, 2_000_003, np.uint8))
        got = np.concatenate(list(langid._bins(text)))
        a = np.frombuffer(b" " + text + b" ", np.uint8).astype(np.uint32)
        want = ((a[:-2] * np.uint32(0x9E3779B1) ^ a[1:-1] * np.uint32(0x85EBCA6B) ^ a[2:] * np.uint32(0xC2B2AE35)) * np.uint32(0x27D4EB2F)) >> np.uint32(16)
        assert np.array_equal(got, want) and [len(x) % langid.RUN for x in langid._bins(text)][:-1] == [0, 0]
        assert sum(map(len, langid._bins(b""))) == 0 and sum(map(len, langid._bins(b"a"))) == 1

    def test_nothing_learned(self, spark, empty):
        df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
        assert [tuple(r)[2:4] for r in langid.identify(df).collect()] == [("und", 0.0)]
        assert langid.identify(empty).count() == 0

    def test_kept(self, docs):
        kept = langid.known_language(docs)
        assert kept.columns == docs.columns
        assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in kept.collect()} == {1000, 1001, 1002}


class TestLines:
    def test_templates(self, docs):
        out = {(r.doc_id, r.n_chars): r for r in linededup.dedup_lines(docs).collect()}
        rows = docs.collect()
        assert len(out) == len({(r.doc_id, r.n_chars) for r in rows})
        line = re.compile(r"posted by user \d+ on day \d+ of the year$", re.M)
        posted = [r.doc_id for r in rows if r.text and r.doc_id is not None and line.search(r.text)]
        assert len(set(posted)) >= linededup.MIN_DOCS
        for r in rows:
            got = out[r.doc_id, r.n_chars]
            if r.text is None:
                assert got.text is None and got.n_lines == 0
                continue
            assert bool(line.search(got.text)) == bool(line.search(r.text) and r.doc_id == min(posted))
            assert got.n_lines - got.n_dropped == len(got.text.split("\n")) or not got.text
            assert set(got.text.split("\n")) <= set(r.text.split("\n")) | {""}

    def test_exact_counts(self, spark):
        """Lines in fewer documents than the bound stay; of the others the first stays."""
        rows = [(i, f"only here {'x' * i}\ncommon line that returns\n" + ("rare line here\n" if i < 9 else "")) for i in range(12)]
        out = {r.doc_id: r for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        for i, t in rows:
            assert out[i].text == (t if i == 0 else t.replace("common line that returns\n", ""))

    def test_lines_without_a_constant_token(self, spark):
        """Unspaced script with a digit, numeric rows and URLs go only as the same line; digits inside a token are variable."""
        numerals = "一二三四五六七八九十甲乙"
        rows = []
        for i, c in enumerate(numerals):
            own = [f"这是第{i}篇{c}的文章，内容各不相同。", f"{i} {i * 7} {i * 13}", f"2024-01-{i + 10}", f"https://example.org/{c}/{i}", f"{i} {i} {i} {i} {c}", "3 5 8"]
            rows.append((i, "\n".join([*own, f"Page-{i}/12 of this book"])))
        out = {r.doc_id: r for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        for i, t in rows:
            assert out[i].text == (t if i == 0 else "\n".join(t.split("\n")[:5]))

    def test_documents_are_counted_once(self, spark):
        """Several templates of a cluster in one document, or rows that share an id, are one document."""
        word = "amber birch cedar dune ember frost grove haze iris jade".split()
        lines = [f"one two three four five six seven eight nine {w}" for w in word]
        rows = [(1, "\n".join(lines[:5])), (2, "\n".join(lines[5:]))] + [(3, "the same words under one id")] * 12
        out = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sorted((r.doc_id, r.text) for r in out) == sorted(rows)
        many = [(i, "\n".join(lines[:2])) for i in range(10)]
        out = linededup.dedup_lines(spark.createDataFrame(many, "doc_id long, text string")).collect()
        assert {r.doc_id: r.n_dropped for r in out} == {i: 2 * (i > 0) for i in range(10)}

    def test_long_lines(self, spark):
        """A long line goes from the second document on, with its digits as they are; shorter or varied ones don't."""
        passage = " ".join(f"word{chr(97 + i % 26)} and" for i in range(30))
        rows = [(1, passage + " in 1999\nshort line"), (2, "own\n" + passage + "  in 1999\nshort line"), (3, passage + " in 2001"), (4, " ".join(passage.split()[:49])), (5, " ".join(passage.split()[:49]))]
        out = {r.doc_id: r.text for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert out == dict(rows) | {2: "own\nshort line"}

    def test_half_without_id(self, spark):
        """Rows without id count as one document, and each loses its own lines; none gathers the others' templates."""
        rows = [(i if i % 2 else None, f"{chr(97 + i % 26) * (1 + i // 26)} alone here\ncommon line that returns\n" + "".join(f"row {chr(97 + j)} of {chr(97 + i % 26) * (1 + i // 26)}\n" for j in range(5))) for i in range(400)]
        rows += [(None, rows[0][1]), (None, None)]
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        first = min(i for i, _ in rows if i is not None)
        want = Counter((i, t if i == first or t is None else t.replace("common line that returns\n", "")) for i, t in rows)
        assert Counter((r.doc_id, r.text) for r in linededup.dedup_lines(df).collect()) == want
        gone = linededup.recurring(df).where("id is null").groupBy("tag").count()
        assert {r["count"] for r in gone.collect()} <= {1, 2}

    @pytest.mark.parametrize("leaf", [4000, 5])
    def test_brute_force(self, spark, leaf, monkeypatch):
        """All outputs against the rule in plain loops, with leaves of any size."""
        monkeypatch.setattr(linededup, "LEAF", leaf)
        rng = random.Random(11)
        word = "amber birch cedar dune ember frost grove haze iris jade".split()
        make = lambda: f"seen the old gate {' '.join(rng.choice(word) for _ in range(rng.choice([2, 6, 6])))} {rng.randint(0, 9)} x{rng.randint(0, 3)}"
        pool = [make() for _ in range(150)] + [" ".join(rng.choice(word) for _ in range(55)) for _ in range(3)]
        rows = [(rng.choice([i, i, None]) if i % 9 == 0 else i // 2, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 8))) if i % 13 else None) for i in range(160)]
        parsed = {x: linededup.parse(x.encode()) for _, t in rows if t is not None for x in t.split("\n") if x.split()}
        names, heads = {}, defaultdict(list)
        for tmpl, lf, n, sig in sorted({p for p in parsed.values()}):
            sig_ = np.frombuffer(sig, np.uint32)
            same = next((h for h, s in heads[lf] if len(sig_) and np.mean(s == sig_) >= 0.8 and ((s == sig_) & (s & 1 == 0)).any()), None)
            names[tmpl] = tmpl if same is None else same
            if same is None:
                heads[lf].append((tmpl, sig_))
        assert len(set(names.values())) < len(names) and (leaf > 5 or max(map(len, heads.values())) > 5)
        ids, exact = defaultdict(set), defaultdict(set)
        for i, t in rows:
            for x in t.split("\n") if t is not None else ():
                if x.split():
                    ids[names[parsed[x][0]]].add(i)
                    if len(x.split()) >= linededup.LONG:
                        exact[x].add(i)
        first = lambda s: min((i for i in s if i is not None), default=None)
        goes = lambda s, i, least: len(s) >= least and i != first(s) or len(s) >= least and i is None and first(s) is not None
        want = Counter()
        for i, t in rows:
            lines = t.split("\n") if t is not None else []
            kept = [x for x in lines if not x.split() or not (goes(ids[names[parsed[x][0]]], i, linededup.MIN_DOCS) or x in exact and goes(exact[x], i, 2))]
            want[i, None if t is None else "\n".join(kept), len(lines), len(lines) - len(kept)] += 1
        df = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, tmpl string, leaf string")
        assert Counter((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in linededup.dedup_lines(df).collect()) == want

    def test_empty(self, empty):
        assert linededup.dedup_lines(empty).count() == 0


class TestScores:
    def test_base_and_model(self, docs):
        out = mixlm.score_texts(docs).collect()
        toks = lambda t: words_of(lower(t)) + ["<end>"]
        train = Counter()
        rows = docs.collect()
        held = lambda i: i is None or zlib.crc32(str(i).encode()) % 10 == 0
        for r in rows:
            if not held(r.doc_id):
                train.update(toks(r.text))
        n, v = sum(train.values()), len(train)
        want = Counter()
        for r in rows:
            t = toks(r.text)
            base = sum(math.log10((train[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t)
            want[(r.doc_id, held(r.doc_id), len(t), sum(train[x] > 0 for x in t), n, round(base, 5))] += 1
        assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in out) == want
        assert all(r.score < 0 and math.isfinite(r.score) for r in out)

    @pytest.mark.parametrize("head", [100_000, 3])
    def test_score_by_hand(self, docs, head, monkeypatch):
        """Token after token and segment after segment in plain loops; which tokens are broadcast changes nothing."""
        monkeypatch.setattr(mixlm, "HEAD", head)
        monkeypatch.setattr(mixlm, "SEGMENT", 4)
        rows = docs.collect()
        held = lambda i: i is None or zlib.crc32(str(i).encode()) % 10 == 0
        toks = [mixlm.tokens((r.text or "").encode()) for r in rows]
        vocab = mixlm.vocabulary(docs, "doc_id", "text")
        n = sum(len(t) for t, r in zip(toks, rows) if not held(r.doc_id))
        p = {bytes(r.token): 10**r.lp for r in mixlm.scored_vocabulary(vocab, n).collect()}
        cut = lambda t: int(mixlm.mixed(np.array([xxhash.xxh3_64_intdigest(t) ^ 77], np.uint64))[0]) % 4 == 0
        texts = []
        for t in toks:
            parts = [[]]
            for i, x in enumerate(t):
                parts[-1].append(x)
                if cut(x) and i < len(t) - 1:
                    parts.append([])
            texts.append([tuple(x) for x in parts])
        pairs = lambda s: list(zip([None, *s], s))
        one, two = Counter(), Counter()
        for s, r in zip(texts, rows):
            if not held(r.doc_id):
                one.update(s)
                two.update(pairs(s))
        want = Counter()
        for t, s, r in zip(toks, texts, rows):
            lp, seen, follow, tried, right, guesses = [], Counter(), Counter(), Counter(), mixlm.RIGHT[0], mixlm.RIGHT[1]
            for i, x in enumerate(t):
                last = t[i - 1] if i else None
                w2 = min(right / guesses, mixlm.SURE) if tried[last] else 0
                w1 = mixlm.OWN * i / (i + mixlm.HALF)
                q = w1 * seen[x] / max(i, 1) + (1 - w1) * p[x]
                lp.append(math.log10(w2 * follow[last, x] / max(tried[last], 1) + (1 - w2) * q))
                right += follow[last, x] > 0
                guesses += tried[last] > 0
                seen[x] += 1
                follow[last, x] += 1
                tried[last] += 1
            mine, mine2 = (Counter(), Counter()) if held(r.doc_id) else (Counter(s), Counter(pairs(s)))
            whole = sum(one.values()) - sum(mine.values())
            score, at, known = 0.0, 0, mixlm.KNOWN[0]
            for k, x in enumerate(s):
                c, before = one[x] - mine[x], one[s[k - 1]] - mine[s[k - 1]] if k else 0
                draw = c / max(whole, 1)
                if before > 0:
                    draw = mixlm.AFTER * (two[s[k - 1], x] - mine2[s[k - 1], x]) / before + (1 - mixlm.AFTER) * draw
                rate = known / (k + mixlm.KNOWN[1])
                score += math.log10(rate * draw + (1 - rate) * 10 ** sum(lp[at : at + len(x)]))
                at, known = at + len(x), known + (c > 0)
            want[r.doc_id, round(score, 4)] += 1
        assert Counter((r.doc_id, round(r.score, 4)) for r in mixlm.score_texts(docs).collect()) == want

    @pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
    def test_better_than_its_base(self, spark, sf):
        out = mixlm.score_texts(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")).where("held_out")
        base, score, n = out.agg(F.sum("base_score"), F.sum("score"), F.sum("n_tokens")).first()
        assert score / n > base / n + 0.1

    def test_mixer_learns_from_all_tokens(self, spark, monkeypatch):
        """Counts and the map are of every bit of every training occurrence, and each shard gives weights."""
        rows = [(i, f"word{i} other{i % 7} same same") for i in range(300)]
        seen = {}
        draw, average = mixlm.Mixer.draw_map, mixlm.Mixer.average
        monkeypatch.setattr(mixlm, "SHARD", 50)
        monkeypatch.setattr(mixlm.Mixer, "draw_map", lambda m, ones, all_: (seen.update(ones=ones.sum(), all=all_.sum()), draw(m, ones, all_))[1])
        monkeypatch.setattr(mixlm.Mixer, "average", lambda m, mixers: (seen.update(mixers=len(mixers)), average(m, mixers))[1])
        vocab = mixlm.vocabulary(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
        train = Counter(x for i, t in rows if zlib.crc32(str(i).encode()) % 10 for x in mixlm.tokens(t.encode()))
        mixlm.scored_vocabulary(vocab, sum(train.values()))
        closed = {x: x if x == mixlm.END else x + b" " for x in train}
        assert seen == {"ones": sum(c * sum(b.bit_count() for b in closed[x]) for x, c in train.items()), "all": sum(8 * c * len(closed[x]) for x, c in train.items()), "mixers": -(-len(train) // 50)}

    def test_prefixes(self):
        """A prefix stands for all tokens that share it: its bits are those of bits_of, in any order of tokens."""
        for toks in (sorted([b"the", b"then", b"there", b"a", b"the", mixlm.END, b"\x01x", b"x" * 300]), [b"b", b"ab", b"b", b"abc", b"ab\x01"]):
            a, contexts, token, number = mixlm.prefixes(toks)
            slots, bits, of = mixlm.bits_of(toks)
            own, own_bits = mixlm._slots(a, contexts)
            at = (number[:, None] * 8 + np.arange(8)).ravel()
            assert (own[at] == slots).all() and (own_bits[at] == bits).all() and (np.repeat(token, 8) == of).all()
        assert len(mixlm.prefixes([b"the", b"then"])[0]) == 6

    def test_tables_without_own(self):
        """What a slot's table gives for a bit is what its counts give without one occurrence of that bit."""
        rng = np.random.default_rng(4)
        n = (rng.integers(0, 300, (2, int(mixlm.BASES[-1]))) * (rng.random((2, int(mixlm.BASES[-1]))) < 0.7)).astype(np.float32)
        packed, seen = mixlm._without_own((n.view(np.uint32) >> 16).astype(np.uint16))
        n = ((n.view(np.uint32) >> 16) << 16).view(np.float32)
        slots, bit, _ = mixlm.bits_of([b"the", b"then", b"x" * 300])
        x, level = mixlm._others(packed, slots, bit)
        n0, n1 = np.maximum(n[0][slots] - (bit == 0)[:, None], 0), np.maximum(n[1][slots] - (bit == 1)[:, None], 0)
        assert (level == mixlm._level(n0 + n1)).all() and np.abs(x - mixlm._stretched(n0, n1)).max() < 0.5 / 300 + 1e-5
        assert (seen[slots[:, -1] - mixlm.BASES[-2]] == np.maximum(n[:, slots[:, -1]].sum(axis=0), 1)).all()

    def test_history_sums_to_one(self):
        """What a text has shown and the rest share one at every place."""
        which = np.array([0, 1, 0, 1, 2, 0, 1, 1, 3])
        for i in range(len(which)):
            own, rest = zip(*[[x[-1] for x in mixlm.history(np.r_[7, 7, which[:i], t], np.array([2, i + 1]))] for t in range(5)])
            assert math.isclose(sum(own) + rest[0], 1) and len(set(rest)) == 1

    def test_learns(self, spark):
        """Held-out texts of the corpus are likelier than shuffled letters."""
        rng = random.Random(2)
        make = lambda: " ".join(rng.choice("alpha beta gamma delta epsilon".split()) for _ in range(50))
        rows = [(i, make()) for i in range(200)] + [(1000 + i, "".join(rng.sample("abcdegmhlpnsto " * 20, 200))) for i in range(40)]
        out = mixlm.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").collect()
        known = [r.bits_per_byte for r in out if r.doc_id < 1000]
        odd = [r.bits_per_byte for r in out if r.doc_id >= 1000]
        assert known and max(known) < 1.0 and (not odd or min(odd) > 2 * max(known))

    def test_sums_to_one(self):
        """After any prefix the 256 next bytes share one, so all tokens together do."""
        m = mixlm.Mixer()
        m.map = (np.arange(8 * 57) % 57 - 28) / 2
        n = np.random.default_rng(2).integers(0, 50, (2, int(mixlm.BASES[-1]))).astype(np.float32)
        for prefix in (b"", b"th", b"longer-prefix"):
            toks = [prefix + bytes([a]) for a in range(256)]
            slots, bit, of = mixlm.bits_of(toks)
            m_ = m.log2(mixlm._stretched(n[0][slots], n[1][slots]), mixlm._level(n.sum(axis=0)[slots]), bit)
            at = np.arange(len(of)) - np.searchsorted(of, of)
            here = (at >= 8 * len(prefix)) & (at < 8 * len(prefix) + 8)
            assert math.isclose((2 ** np.bincount(of[here], m_[here])).sum(), 1, rel_tol=1e-6)

    def test_empty(self, empty, spark):
        assert mixlm.score_texts(empty).count() == 0
        one = mixlm.score_texts(spark.createDataFrame([(None, None)], "doc_id long, text string")).collect()
        assert one[0].n_tokens == 1 and one[0].train_tokens == 0 and one[0].bits_per_byte is None
