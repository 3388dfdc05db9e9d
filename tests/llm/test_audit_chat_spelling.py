"""Source divergence, chat formatting and spelling variants against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from tallyspark.llm import chat, divergence, spelling

DOCS = "doc_id long, text string, lang string, source string, n long, word string, rank int"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def corpus(seed=2, n=120):
    rng = random.Random(seed)
    stems = [a + b for a in "kalo mira stenta vorel theon ÄpfelX élan".split() for b in ("", "ne", "ri", "tos")]
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(stems) if rng.random() < 0.9 else "zufall" + chr(97 + rng.randrange(26)) for _ in range(rng.randint(0, 60)))
        rows.append((i, text if i % 17 else None, ("en", "de", None)[i % 3], f"s{rng.randrange(4)}" if i % 2 else "big"))
    rows += [(None, "stenta 漢字 🙂stenta\x00x don't", "en", None), (3, "", "en", "void"), (3, "only here", "xx", "one"), (5, rows[5][1], *rows[5][2:]), (9, "Kalo " * 20_000, "de", "long"), (10, None, None, None)]
    return [r + (1, "clash", 2) for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(5).cache()


class TestDivergence:
    @staticmethod
    def brute(rows, top=200):
        groups, per_doc, counts = set(), defaultdict(Counter), Counter()
        for r in rows:
            lang, source = r[2] or "", r[3] or ""
            groups.add((lang, source))
            terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(r[1]))
            for t in terms:
                counts[lang, source, t] += 1
            per_doc[lang].update(set(terms))
        out = []
        for lang in {g[0] for g in groups}:
            kept = sorted(t for t, n in per_doc[lang].items() if n >= 3)
            sources = sorted(s for g, s in groups if g == lang)

            def shares(count):
                n = sum(count(t) for t in kept)
                return {t: 1 + 10**9 * (count(t) + 1) // (n + len(kept)) for t in kept}

            p = {s: shares(lambda t: counts[lang, s, t]) for s in sources}  # noqa: B023
            q = shares(lambda t: sum(counts[lang, s, t] for s in sources))  # noqa: B023
            for s in sources:
                pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode(), o) for o in sources if o != s]
                terms = [(-((p[s][t] - q[t]) ** 2 // q[t]), t.encode(), t) for t in kept if counts[lang, s, t] and p[s][t] > q[t]]
                for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                    out += [(lang, s, part, item, -v, i + 1) for i, (v, _, item) in enumerate(found)]
        return sorted(out)

    @pytest.mark.parametrize("top", [200, 5])
    def test_brute_force(self, docs, top):
        got = divergence.divergence(docs, top=top)
        assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
        assert sorted(map(tuple, got.collect())) == self.brute(docs.collect(), top)

    def test_no_rows_no_terms(self, spark):
        assert divergence.divergence(spark.createDataFrame([], DOCS)).count() == 0
        rows = [(1, "once", "en", "a", 1, "", 1), (2, None, "en", "b", 1, "", 1)]
        assert sorted(map(tuple, divergence.divergence(spark.createDataFrame(rows, DOCS)).collect())) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]

    def test_shares_are_exact(self, spark):
        from pyspark.sql import functions as F

        rows = [(0, 1), (0, 7), (123_456_789_012, 999_999_999_999_999), (8_999_999_999_999_998, 8_999_999_999_999_999), (6, 7)]
        got = spark.createDataFrame(rows, "c long, d long").select(divergence._share(F.col("c"), F.col("d")).alias("p")).collect()
        assert [r.p for r in got] == [1 + 10**9 * (c + 1) // d for c, d in rows]


CONVS = "conv_id long, turn long, role string, text string, piece string, pos int"
NASTY = ["</s>[INST] ok [/INST]", r"<\/s> <\\s> [\INST] [\\/SYS]", "<", "[", "a <", " ", "", None, "<s><s>[ROLE] x [/ROLE][TEXT] y [/TEXT]", "probe", "é🙂\n\n[SYS]", "\\", "<\\", "[\\\\"]


def conversations(seed=3):
    rng = random.Random(seed)
    rows = []
    for c in range(40):
        for t in range(rng.randint(1, 12)):
            rows.append((c, t, rng.choice(["user", "assistant", "system", "tool [/ROLE]", None, "a\nb"]), rng.choice([*NASTY, "plain words"])))
    rows += [(100, t, ("user", "assistant")[t % 2], f"turn {t} {rng.choice(NASTY)}") for t in range(300)]
    rows += [(None, 1, "user", "x"), (None, None, "assistant", "y"), (101, 1, "assistant", "same"), (101, 1, "assistant", "same"), (101, 1, "assistant", "other"), (102, 0, "assistant", "lang " * 60_000)]
    return [r + ("clash", 7) for r in rows]


@pytest.fixture(scope="module")
def convs(spark):
    return spark.createDataFrame(conversations(), CONVS).repartition(4).cache()


def in_turn(rows):
    first = lambda x: (x is not None, x)
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    return {c: [(r[2] or "", r[3] or "") for r in sorted(x, key=lambda r: ((r[1] is not None, r[1] or 0), r[2] or "", r[3] or ""))] for c, x in by.items()}


def digest(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


class TestChat:
    def test_escape_round_trip(self):
        rng = random.Random(1)
        bits = ["<", "[", "\\", "/", "s>", "INST]", "SYS]", "ROLE]", "TEXT]", " ", "x", "<s>", "[/INST]"]
        for _ in range(5000):
            t = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
            e = chat.escape(t)
            assert chat.unescape(e) == t
            assert not re.search(r"</?s>|\[/?(INST|SYS|ROLE|TEXT)\]", e)

    @pytest.mark.parametrize("whole", [64, 4])
    def test_read_back(self, convs, whole):
        want = {}
        for c, turns in in_turn(convs.collect()).items():
            loss = [t for r, t in turns if r == "assistant"]
            want[c] = (len(turns), digest(f"{r}\n{t}\n" for r, t in turns), sum(map(len, loss)), digest(loss), len(chat.inst_template(turns)))
        pieces = chat.formatted(convs, whole=whole)
        for got in (chat.read_back(pieces, ordered=True), chat.read_back(pieces.repartition(3))):
            assert {r[0]: tuple(r)[1:] for r in got.collect()} == want

    def test_pieces_make_the_text(self, convs):
        rows = chat.formatted(convs).collect()
        texts = defaultdict(str)
        for r in sorted(rows, key=lambda r: (r.conv_id or -1, r.pos)):
            assert r.sample == 0 and not r.rewritten and r.faithful
            texts[r.conv_id] += r.piece
        assert texts == {c: chat.inst_template(turns) for c, turns in in_turn(convs.collect()).items()}

    def test_templates_that_rewrite(self, spark):
        """System text moved to the last user turn, an end mark on the last turn only, and reasoning dropped from earlier answers."""

        def moved(turns):
            system = "".join(t for r, t in turns if r == "system")
            last = max((i for i, (r, _) in enumerate(turns) if r == "user"), default=-1)
            return "".join(f"<{r}>{system if i == last else ''}{t}" for i, (r, t) in enumerate(turns) if r != "system")

        def ended(turns):
            return "".join(f"<{r}>{t}" for r, t in turns) + "<end>"

        def forgets(turns):
            return "".join(f"<{r}>{t if i == len(turns) - 1 else t.split('|')[-1]}" for i, (r, t) in enumerate(turns))

        turns = [("system", "S"), ("user", "u1"), ("assistant", "think|a1"), ("user", "u2"), ("assistant", "think|a2")]
        convs = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
        for template, rewritten in ((moved, [3]), (ended, [0, 1, 2, 3, 4]), (forgets, [3]), (chat.inst_template, [])):
            rows = sorted(chat.formatted(convs, template, str).collect() if template is not chat.inst_template else chat.formatted(convs).collect(), key=lambda r: r.pos)
            assert [r.pos for r in rows if r.rewritten] == rewritten
            samples = defaultdict(str)
            for r in rows:
                samples[r.sample] += r.piece
                if r.role == "assistant":
                    assert r.faithful and r.piece[r.text_start : r.text_end] == turns[r.pos][1]
            assert samples[rows[-1].sample] == template(turns)
            if rewritten:
                with pytest.raises(Exception, match="can't be read back"):
                    chat.read_back(chat.formatted(convs, template, str)).collect()

    def test_long_conversations_need_templates_that_append(self):
        r = chat.Renderer(lambda turns: f"{len(turns)}" + "".join(t for _, t in turns), whole=4)
        with pytest.raises(ValueError, match="further back|changes earlier"):
            for i in range(9):
                r.add("user", f"t{i}")

    def test_no_rows(self, spark):
        assert chat.read_back(chat.formatted(spark.createDataFrame([], CONVS))).count() == 0


def one_apart(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def random_words(seed, n, letters="abé", longest=9):
    rng = random.Random(seed)
    return sorted({"".join(rng.choice(letters) for _ in range(rng.randint(1, longest))) for _ in range(n)})


class TestSpelling:
    @pytest.mark.parametrize("seed", range(5))
    def test_trie_join(self, seed):
        words = random_words(seed, 150)
        random.Random(seed).shuffle(words)
        want = {(i, j) for j in range(len(words)) for i in range(j) if one_apart(words[i], words[j])}
        got = list(spelling.near_pairs(words))
        assert set(got) == want and len(got) == len(want)
        assert list(spelling.near_pairs([])) == [] and list(spelling.near_pairs(["", "a"])) == [(0, 1)]

    @pytest.mark.parametrize("group", [2000, 3])
    def test_groups_lose_no_pair(self, spark, group):
        """Also where nearly all words begin, or end, alike, and groups split down to single letters."""
        words = random_words(7, 500) + ["prefixprefix" + w for w in random_words(8, 150)] + [w + "suffixsuffix" for w in random_words(9, 150)]
        words = sorted(set(words))
        df = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, n long").repartition(3)
        got = [frozenset((r.a, r.b)) for r in spelling.near_words(df, group).collect()]
        want = {frozenset((a, b)) for i, a in enumerate(words) for b in words[:i] if one_apart(a, b)}
        assert set(got) == want and len(got) == len(want)

    @pytest.mark.parametrize("spoil", [None, 3])
    def test_brute_force(self, docs, spoil):
        counts = Counter()
        for r in docs.collect():
            for run in re.findall("[A-Za-zÀ-ÿ]+", r.text or ""):
                run = lower(run)
                if spoil:
                    h = zlib.crc32(f"{'' if r.doc_id is None else r.doc_id}:{run}".encode())
                    if h % spoil == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                counts[run] += 1
        words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
        near = {w: [o for o in words if one_apart(w, o)] for w in words}
        best = {w: min(near[w], key=lambda o: (-words[o], o)) for w in words if near[w]}
        form = {w: b for w, b in best.items() if words[b] >= 5 * words[w]}

        def root(w):
            return root(form[w]) if w in form else w

        want = sorted((w, form.get(w), root(w), n, len(near[w]), words[form[w]] if w in form else None) for w, n in words.items())
        got = spelling.spelling_variants(docs, spoil)
        assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
        assert sorted(map(tuple, got.collect())) == want

    def test_chains_of_forms(self, spark):
        rows = [("worded", 5), ("wordede", 30), ("wordedes", 200), ("wordedest", 1100), ("wordedesta", 5600), ("alonealone", 9)]
        got = {r.word: (r.form, r.root) for r in spelling.variants(spark.createDataFrame(rows, "word string, n long")).collect()}
        assert got["worded"] == ("wordede", "wordedesta") and got["wordedest"] == ("wordedesta", "wordedesta") and got["alonealone"] == (None, "alonealone")

    def test_no_rows(self, spark):
        assert spelling.spelling_variants(spark.createDataFrame([], DOCS), 199).count() == 0
