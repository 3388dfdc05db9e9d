"""Vector and page operators against brute force and planted structure."""

import math
import random
import time

import numpy as np
import pytest

from tallyspark.llm import embeddings, vafile, wrappers


def vectors(seed=5, n=1500, dim=24):
    rng = np.random.default_rng(seed)
    v = rng.standard_normal((n, dim))
    for i in range(0, n, 5):  # near copies at cosines about the bound
        v[i + 1] = v[i] + rng.standard_normal(dim) * rng.uniform(0.1, 0.45)
    v[10:40] = v[10] * rng.uniform(0.5, 2, (30, 1))  # same direction
    rows = [(i, x.astype(np.float32).tolist(), 0) for i, x in enumerate(v)]
    rows += [(5000 + i, rows[3][1], 1) for i in range(60)]  # exact copies
    rows += [(6000, None, 0), (6001, [], 0), (6002, [0.0] * dim, 0), (6003, [float("nan")] * dim, 0), (6004, [None] + [1.0] * (dim - 1), 0), (6005, [float("inf")] * dim, 0), (6006, [1.0, 2.0], 0), (6007, [2.0, 4.0], 0), (6100, [1e-30] * dim, 0)]
    return rows


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(vectors(), "vec_id long, embedding array<float>, label int").repartition(4).cache()


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v)


class TestForest:
    @pytest.mark.parametrize("leaf,block", [(5000, 1000), (100, 1000), (100, 40)])
    def test_links(self, table, leaf, block, monkeypatch):
        monkeypatch.setattr(embeddings, "BLOCK", block)
        rows = [r for r in table.collect()]
        out = {r.vec_id: r for r in embeddings.near_duplicates(table, leaf=leaf).collect()}
        assert len(out) == len(rows)
        good = [r for r in rows if usable(r.embedding) and any(r.embedding)]
        n = {r.vec_id: 0 for r in rows}
        parent = {r.vec_id: r.vec_id for r in rows}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for dim in {len(r.embedding) for r in good}:
            own = [r for r in good if len(r.embedding) == dim]
            u = np.array([r.embedding for r in own], float)
            u /= np.linalg.norm(u, axis=1, keepdims=True)
            for i, j in np.argwhere(u @ u.T >= 0.95):
                if i != j:
                    n[own[i].vec_id] += 1
                    a, b = find(own[i].vec_id), find(own[j].vec_id)
                    parent[max(a, b)] = min(a, b)
        found = sum(r.n_links for r in out.values())
        assert found >= 0.98 * sum(n.values())
        assert all(out[i].n_links <= n[i] for i in n)
        if leaf == 5000:
            assert {i: out[i].n_links for i in n} == n
            assert {i: out[i].component_id for i in n} == {i: find(i) for i in n}
        assert all(r.kept == (r.component_id == r.vec_id) for r in out.values())
        for i in (6000, 6001, 6002, 6003, 6004, 6005):
            assert (out[i].n_links, out[i].component_id, out[i].kept) == (0, i, True)

    def test_dense_group(self, spark):
        """A tight group of a third of all vectors is neither cut through nor multiplied."""
        rng = np.random.default_rng(4)
        v = rng.standard_normal((2400, 24))
        v[:800] = v[0] + 0.15 * rng.standard_normal((800, 24))
        u = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
        for seed in range(3):
            _, row = embeddings.leaves(u, embeddings.grow(u, 5, seed))
            assert np.bincount(row).max() <= 16 and len(row) < 4 * len(u)
        df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(4)
        found = sum(r.n_links for r in embeddings.near_duplicates(df, leaf=100).collect())
        w = v / np.linalg.norm(v, axis=1, keepdims=True)
        assert found >= 0.98 * ((w @ w.T >= 0.95).sum() - len(w))

    def test_dense_group_at_depth(self):
        """Many levels neither lose links of a group of a third of all vectors nor cut it up; more depth asks for more trees."""
        rng, n = np.random.default_rng(4), 24_000
        v = rng.standard_normal((n, 64))
        v[: n // 3] = v[0] + 0.2 * rng.standard_normal((n // 3, 64))
        u = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
        order = rng.permutation(n)
        i, j = rng.integers(0, n // 3, (2, 6000))
        linked = (i != j) & ((u[i] * u[j]).sum(axis=1) >= 0.95)
        i, j = i[linked], j[linked]
        hit = np.zeros(len(i), bool)
        for t in range(6):
            leaf, row = embeddings.leaves(u, embeddings.grow(u[order], 8, 97 + t))
            of = {}
            for x, r in zip(leaf.tolist(), row.tolist()):
                of.setdefault(r, set()).add(x)
            hit |= np.array([bool(of[a] & of[b]) for a, b in zip(i.tolist(), j.tolist())])
        assert len(i) > 2000 and hit.mean() >= 0.99

    def test_empty(self, spark):
        df = spark.createDataFrame([], "vec_id long, embedding array<float>")
        assert embeddings.near_duplicates(df).count() == 0
        df = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
        assert [tuple(r) for r in embeddings.near_duplicates(df).collect()] == [(1, 0, 1, True)]


class TestVAFile:
    @pytest.mark.parametrize("blocks", [None, (100, 7)])
    def test_brute_force(self, table, blocks, monkeypatch):
        if blocks:
            monkeypatch.setattr(vafile, "CANDIDATES", blocks[0])
            monkeypatch.setattr(vafile, "QUERIES", blocks[1])
        rows = [(r.vec_id, [math.floor(1024 * x) for x in r.embedding]) for r in table.collect() if usable(r.embedding)]
        want = set()
        for q, v in rows:
            if q % 100:
                continue
            s = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q and len(w) == len(v))[:10]
            want |= {(q, k + 1, i, -x) for k, (x, i) in enumerate(s)}
        got = vafile.top_k(table, table.where("vec_id % 100 = 0"))
        assert {tuple(r) for r in got.collect()} == want

    def test_ties_and_empty(self, spark):
        df = spark.createDataFrame([(i, [1.0, 0.5]) for i in range(0, 30)], "vec_id long, embedding array<double>")
        got = [tuple(r)[:3] for r in vafile.top_k(df, df.where("vec_id = 0")).orderBy("rank").collect()]
        assert got == [(0, k, k) for k in range(1, 11)]
        assert vafile.top_k(df.limit(0), df.limit(0)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{{}}</style><script>var a="</p><p>x";</script></head><body class="has-sidebar">
<header><h2>Site name</h2></header><nav><ul><li><a href="/a">Home {i}</a></li><li><a href="/b">About</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><div id="main-wrap"><{tag} class="post"><h1>Title {i}</h1><!-- hidden <p>no</p> -->
<p>First  paragraph {w}&nbsp;&lt;b&gt; with <b>bold<br>and</b> <a href="x">link</a>.<p>Second {w}<ul><li>one {i}<li>two</ul>
<div class="ad">Buy now {w}</div><form>Name <input name=a> <select><option>x</select></form><div>Third {w} &#8364; &amp</div></{tag}>
<aside>Related {w}</aside></div><section id="comments"><p>Reader {w} says hi</p></section>
<div class="site-footer">Imprint {i}</div><footer>&copy; us</footer></body></html>"""
WANT = "Title {i}\n\nFirst paragraph {w} <b> with bold and link.\n\nSecond {w}\n\none {i}\n\ntwo\n\nThird {w} € &"


class TestRepeatedIds:
    def test_links_of_repeated_ids(self, spark):
        rows = [(1, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (2, [1.0, 0.01, 0.0]), (3, [0.0, 1.0, 0.0]), (None, [1.0, 0.0, 0.0]), (4, [1.0, 0.0, 0.0, 0.0]), (5, None), (6, [0.0, 0.0, 0.0]), (7, [float("nan"), 1.0, 0.0])]
        df = spark.createDataFrame([(*r, 0, 0) for r in rows], "vec_id long, embedding array<double>, rep int, leaf int")
        got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df).collect()), key=str)
        want = [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True), (None, 0, None, True)]
        assert got == sorted(want, key=str)

    def test_search_with_repeated_ids_and_huge_numbers(self, spark):
        rng = np.random.default_rng(3)
        rows = [(int(i % 40), [float(x) for x in rng.integers(-3, 4, 3)]) for i in range(200)] + [(7, [1.0, 1.0, 1.0])] * 30 + [(50, [1e200, 0.0, 1.0]), (51, [2.0**45, 1.0, -1.0]), (52, [1.0, 2.0]), (53, [2.0, 3.0]), (54, None), (55, [None, 1.0, 1.0])]
        df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, cand int").repartition(3)
        got = [(r.query_id, r.rank, r.vec_id, r.score) for r in vafile.top_k(df, df.where("vec_id % 10 = 0 or vec_id > 49"), 5).collect()]
        whole = lambda x: max(-(1 << 63), min((1 << 63) - 1, math.floor(1024 * x)))
        good = [(i, [whole(x) for x in v]) for i, v in rows if v is not None and None not in v]
        want, asked = [], {(i, tuple(v)) for i, v in good if i % 10 == 0 or i > 49}
        for q in {i for i, _ in asked}:
            own = [(-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(v, w)))), j) for i, v in asked if i == q for j, w in good if j != q and len(v) == len(w)]
            want += [(q, k + 1, j, -s) for k, (s, j) in enumerate(sorted(own)[:5])]
        assert sorted(got) == sorted(want)


class TestWrappers:
    @pytest.mark.parametrize("tag", ["article", "div"])
    def test_planted(self, spark, tag):
        rng = random.Random(1)
        rows, want = [], {}
        for i in range(60):
            w = " ".join(rng.choice("lorem ipsum dolor sit amet consetetur".split()) + str(rng.random())[2:5] for _ in range(rng.randint(5, 60)))
            rows.append((i, f"https://h{i % 3}.example/{i}", PAGE.format(i=i, w=w, tag=tag), "clash", "clash"))
            want[i] = WANT.format(i=i, w=w)
        rows += [(100, None, None, "", ""), (101, "https://h0.example/x", "", "", ""), (102, "no url", "<p>Only & text", "", ""), (103, "https://h1.example/y", "plain words", "", ""), (0, rows[0][1], rows[0][2], "", "")]
        want |= {100: "", 101: "", 102: "Only & text", 103: "plain words"}
        df = spark.createDataFrame(rows, "page_id long, url string, html string, host string, wrapper string").repartition(3)
        out = wrappers.main_text(df).collect()
        assert len(out) == len(rows)
        for r in out:
            assert r.text == want[r.page_id], r.page_id
            assert r.n_chars == len(r.text)

    def test_constant_slots_outside_an_article(self, spark):
        """Unnamed boxes that are the same on all pages of a host are template."""
        rng = random.Random(3)
        page = "<html><body><div><p>Welcome to the daily place</p></div><div><h1>T{i}</h1><p>{w}</p><p>{v}</p></div><div><p>Call us any time</p></div></body></html>"
        rows = [(i, "http://h.example/", page.format(i=i, w="w" * 20 + str(rng.random()), v="v" * 200 + str(rng.random()))) for i in range(30)]
        out = wrappers.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
        assert all(r.text.startswith(f"T{r.page_id}\n\nwww") and "Welcome" not in r.text and "Call" not in r.text for r in out)

    def test_deep_long_and_broken_pages(self, spark):
        """No page stops the job or takes more than time in proportion; text stays whatever its depth."""
        deep = "<div>" * 100_000 + "<p>far down</p>" + "</div>" * 100_000 + "<p>after</p>"
        rows = [(1, "http://deep.example/", deep), (2, "http://quotes.example/", '<p>start</p>' + '<a "' * 1_250_000), (3, "http://wide.example/", "<div>a</div><p>b</p>" * 50_000)]
        rows += [(4, "http://one.example/", "<p>only &lt; page<p>a < b"), (5, "http://cdata.example/", "<![CDATA[" * 100_000 + "<p>x</p>"), (6, "http://raw.example/", "<p>seen</p><script>" + "</script" * 100_000)]
        rows += [(7, "http://wide.example/", "<p>b</p><div>a</div>" * 40_000), (8, "http://tag.example/", '<p title="a > b">in <b title=">">bold</b></p>')]
        began = time.monotonic()
        out = {r.page_id: r.text for r in wrappers.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
        assert time.monotonic() - began < 120
        assert out[1] == "far down\n\nafter" and out[2].startswith("start\n\n<a") and len(out[2]) > 4_000_000
        assert out[3].split() == ["a", "b"] * 50_000 and out[7].split() == ["b", "a"] * 40_000
        assert out[4] == "only < page\n\na < b" and out[5].endswith("x") and out[6] == "seen" and out[8] == "in bold"

    @pytest.mark.parametrize("pages", [1, 30])
    def test_names_that_articles_have(self, spark, pages):
        """Parts of longer names never count; doubtful whole names don't where a host's pages tell."""
        rng = random.Random(4)
        page = '<html><body><nav>x</nav><article><h1>T{i}</h1><div class="popular-science"><p>one {w}</p></div><p class="search-results">two {w}</p><section id="legal"><p>three {w}</p></section><div class="social-history">four {w}</div><div class="share-buttons">Share</div></article><div class="search">find {w}</div></body></html>'
        rows = [(i, "http://h.example/", page.format(i=i, w=str(rng.random()))) for i in range(pages)]
        for r in wrappers.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
            words = [b.split()[0] for b in r.text.split("\n\n")]
            assert words == [f"T{r.page_id}", "one", "two", *["three"] * (pages > 1), "four"]

    def test_constant_box_in_an_article_of_many_shapes(self, spark, monkeypatch):
        """The same box on all pages is template inside an article too, also where each page has a shape of its own and parts are merged in steps."""
        monkeypatch.setattr(wrappers, "MERGED", 4)
        rng = random.Random(5)
        rows = []
        for i in range(40):
            own = "".join(f"<{rng.choice(['ul', 'div', 'blockquote', 'pre'])}>part {rng.random()}</{'x'}>" for _ in range(rng.randint(1, 6)))
            rows.append((i, "http://h.example/", f"<main><h1>T{i}</h1><section><p>Join our club today</p></section><p>body {rng.random()}</p>{own}</main>"))
        out = wrappers.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
        assert all("Join" not in r.text and r.text.startswith(f"T{r.page_id}\n\nbody") and r.text.count("part") == dict((x[0], x[2].count("part")) for x in rows)[r.page_id] for r in out)

    @pytest.mark.parametrize("tag", ["article", "div"])
    def test_recurring_headings_of_articles(self, spark, tag):
        """Headings that all articles of a host share stay where text follows them; a box of a heading and the same words goes."""
        rng = random.Random(6)
        box = "<section><h2>Newsletter</h2><p>Join our club today</p></section>"
        page = "<html><body><{tag}><h1>T{i}</h1><h2>Summary</h2><p>one {a}</p><div><h3>Results</h3></div><div><p>two {b}</p></div>{box}<h2>Sources</h2><p>Printed by the press</p></{tag}></body></html>"
        rows = [(i, "http://h.example/", page.format(tag=tag, i=i, a="a" * 90 + str(rng.random()), b="b" * 90 + str(rng.random()), box=box)) for i in range(40)]
        for r in wrappers.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
            blocks = r.text.split("\n\n")
            assert [blocks[i] for i in (0, 1, 3)] == [f"T{r.page_id}", "Summary", "Results"] and blocks[2].startswith("one") and blocks[4].startswith("two") and len(blocks) == 5

    def test_simple_tree_matching(self):
        a = ["x", [["p", []], ["q", []], ["p", []]]]
        b = ["x", [["q", []], ["p", []]]]
        assert wrappers._match(a, b, {}) == (3, [(1, 0), (2, 1)])

    def test_empty(self, spark):
        assert wrappers.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
