"""Main-text extraction from web pages by wrapper induction over the pages of a host.

A page's blocks form a tree in which runs of equal siblings are one node. The
trees of a host's pages are aligned by simple tree matching into one template
whose nodes gather, over all pages, how much text they hold and how many different
texts. Nodes that are constant beside the content are template; the smallest
node that holds nearly all varying text is the content slot. Extraction aligns a page
to its host's template and reads the slot. Elements, roles and names that mark a menu,
header, footer, notice, advert, form or comment are never content; names that an article may
bear as well ("legal", "search") count only outside the slot, or where the host has
too few pages to tell.

Pages are read as browsers do: an unclosed script or comment swallows the rest. Elements nested
deeper than DEEP levels are siblings at that level; after a quote that is never closed, tags end at
the next bracket. So time is in proportion to the page, and no text is left out for its depth or length.
"""

from __future__ import annotations

import html as entities
import json
import math
import re
from bisect import bisect_left
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, raw_texts, written

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"([^\s=\"'<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
# Element kinds of HTML
_RAW = frozenset("script style noscript template iframe svg math object canvas video audio textarea title select xmp noembed noframes".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("html head body address article aside blockquote center details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup li main menu nav ol p pre section summary table tbody thead tfoot tr td th caption ul".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tbody", "thead", "tr", "td", "th"}}
_WALLS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}}
# Elements, roles and names that mark what isn't the article
_BAD_TAGS = frozenset("head nav aside footer form menu dialog button".split())
_BAD_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_BAD_NAMES = frozenset(
    "ad ads adbox adsense advert adverts advertisement advertising sponsored nav navbar navigation breadcrumb breadcrumbs pagination pager sidebar "
    "cookie cookies consent gdpr popup modal overlay newsletter signup login paywall share sharing social comment comments commentlist disqus respond "
    "related recommended recommendations footer colophon masthead topbar toolbar".split()
)
_UNSURE_NAMES = frozenset(
    "sponsor promo promotion banner menu toc skip aside widget widgets rail notice notices alert subscribe subscription reply replies discussion reviews "
    "foot copyright legal disclaimer header form search popular trending donate donation".split()
)
# Parts of a name that say nothing of what is in it
_LAYOUT = frozenset(
    "site page main article post entry content body wrap wrapper container inner outer box area block section panel bar list lists item items unit slot group row col column "
    "left right top bottom primary secondary global local sticky fixed button buttons btn link links icon icons text title js id new old small large mobile desktop".split()
)
_GOOD_TAGS = frozenset(("article", "main"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_SPLIT = re.compile(r"[-_\s]+|(?<=[a-z])(?=[A-Z])")
#: Share of the varying text that the content slot holds; a slot is constant below this share of the content's different texts.
HOLDS, CONSTANT, ENOUGH = 0.9, 0.1, 10
#: Levels of a tree, pairs of siblings up to which matching weighs all of them, numbers of a sketch of different texts, trees of a host that one task merges.
DEEP, WEIGHED, SKETCH, MERGED = 150, 250_000, 16, 200
#: A node on fewer than one in RARE of a host's pages is left out of its template.
RARE = 500


class Node:
    __slots__ = ("tag", "label", "bad", "kids", "sign")

    def __init__(self, tag: str, label: str, bad: int):
        self.tag, self.label, self.bad, self.kids = tag, label, bad, []


@lru_cache(maxsize=20_000)
def _kind(tag: str, attributes: str) -> tuple[str, int]:
    """(label, whether the mark-up says it isn't article: 2 surely, 1 by a name that articles have too) of an element."""
    found = {}
    for m in _ATTRIBUTE.finditer(attributes):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    classes = sorted(c for c in found.get("class", "").split())
    bad = 2 * (tag in _BAD_TAGS or found.get("role", "").lower() in _BAD_ROLES or "hidden" in found or found.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none", found.get("style", ""))))
    for name in [*classes, *found.get("id", "").split()]:
        parts = {p.lower() for p in _SPLIT.split(name) if p and not p.isdigit()}
        if tag not in ("html", "body", *_GOOD_TAGS) and parts <= _LAYOUT | _BAD_NAMES | _UNSURE_NAMES:
            bad = max(bad, 2 * bool(parts & _BAD_NAMES), int(bool(parts & _UNSURE_NAMES)))
    return tag + "".join("." + re.sub(r"\d+", "", c) for c in classes), bad


def parse(text: str) -> Node:
    """Block tree of a page: kids are blocks and (text, in a link) pairs; inline mark-up is transparent."""
    root = Node("", "", 0)
    stack, at, link = [root], 0, 0
    last, quoted, cdata, look = text.rfind(">"), True, True, 0

    def put(piece: str):
        if piece:
            stack[-1].kids.append((entities.unescape(piece) if "&" in piece else piece, link > 0))

    while (i := text.find("<", look)) >= 0:
        m, end = None, -1
        if text.startswith("<!--", i):
            end = text.find("-->", i + 4) + 3
            end = end if end > 2 else len(text)
        elif cdata and text.startswith("<![CDATA[", i):
            end = text.find("]]>", i) + 3
            cdata = end > 2
        if end < 3 and i < last:
            if text[i + 1] in "!?":
                end = text.index(">", i) + 1
            else:
                m = (_TAG if quoted else _PLAIN_TAG).match(text, i)
                if m is None and quoted and (m := _PLAIN_TAG.match(text, i)):
                    quoted = False
        if m is None and end < 3:
            look = i + 1  # a bracket that is text
            continue
        put(text[at:i])
        at = look = m.end() if m else end
        tag = m[2].lower() if m else ""
        if not tag:
            continue
        if m[1]:
            if tag in _BLOCK:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        del stack[k:]
                        link = 0
                        break
            elif tag == "a":
                link = 0
        elif tag in _RAW:
            if not m[3].endswith("/"):  # only its own end tag ends raw text
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(text, at)
                end = text.find(">", end.end()) + 1 if end else 0
                at = look = end or len(text)
        elif tag in ("br", "hr"):
            put(" ")
        elif tag in _BLOCK:
            for k in range(len(stack) - 1, 0, -1):  # implied end tags
                if stack[k].tag == "p" and tag not in ("html", "head", "body") or stack[k].tag in _CLOSES.get(tag, ()):
                    del stack[k:]
                elif stack[k].tag in _WALLS.get(tag, ()) or tag not in _CLOSES:
                    break
            if tag == "body" and len(stack) > 1 and stack[-1].tag == "head":
                stack.pop()
            link = 0
            label, bad = _kind(tag, m[3])
            if tag == "header":  # an article's own heading is content
                bad = 0 if any(n.tag in _GOOD_TAGS for n in stack) else 2
            if len(stack) > DEEP:
                bad = max(bad, stack.pop().bad)
            node = Node(tag, label, bad)
            stack[-1].kids.append(node)
            stack.append(node)
        elif tag == "a":
            link = 1
    put(text[at:])
    _sign(root)
    return root


def _sign(node: Node) -> str:
    """Label and structure of a block in one hash, runs of equal kids once."""
    parts: list[str] = []
    for k in node.kids:
        if isinstance(k, Node) and ((sign := _sign(k)) != (parts[-1] if parts else None)):
            parts.append(sign)
    node.sign = xxhash.xxh3_64_hexdigest(f"{node.label}({','.join(parts)})")
    return node.sign


class Slot:
    """A node of a page's tree, or several siblings of equal structure in a row."""

    __slots__ = ("label", "members", "kids")

    def __init__(self, label: str, members: list[Node]):
        self.label, self.members, self.kids = label, members, []
        runs: dict[tuple[str, int], list[Node]] = {}
        for m in members:
            seen: dict[str, int] = {}
            last = None
            for kid in m.kids:
                if isinstance(kid, Node):
                    if kid.sign != last:
                        seen[kid.label] = seen.get(kid.label, 0) + 1
                        last = kid.sign
                    runs.setdefault((kid.label, seen[kid.label]), []).append(kid)
        self.kids = [Slot(name, nodes) for (name, _), nodes in runs.items()]

    def shape(self) -> list:
        return [self.label, [k.shape() for k in self.kids]]

    def walk(self):
        yield self
        for k in self.kids:
            yield from k.walk()


def _match(a: list, b: list, memo: dict) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching of two [label, kids] trees of equal labels: (size, matched kids)."""
    key = (id(a), id(b))
    if key in memo:
        return memo[key]
    x, y = a[1], b[1]
    if len(x) * len(y) > WEIGHED:  # very many siblings: each takes the next of its label
        places: dict[str, list[int]] = {}
        for i, p in enumerate(x):
            places.setdefault(p[0], []).append(i)
        size, pairs, after = 1, [], 0
        for j, q in enumerate(y):
            found = places.get(q[0], [])
            i = bisect_left(found, after)
            if i < len(found):
                pairs.append((found[i], j))
                size += _match(x[found[i]], q, memo)[0]
                after = found[i] + 1
        memo[key] = (size, pairs)
        return memo[key]
    w = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, p in enumerate(x):
        for j, q in enumerate(y):
            own = _match(p, q, memo)[0] if p[0] == q[0] else 0
            w[i + 1][j + 1] = max(w[i][j + 1], w[i + 1][j], w[i][j] + own)
    pairs, i, j = [], len(x), len(y)
    while i and j:
        if w[i][j] == w[i - 1][j]:
            i -= 1
        elif w[i][j] == w[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((i, j))
    memo[key] = (w[-1][-1] + 1, pairs[::-1])
    return memo[key]


def _join(template: list, page: list) -> None:
    """Merge a page tree into a template; trees are [label, kids, [pages, chars, link chars, bad, *sketch of texts]]."""
    memo: dict = {}

    def merge(t, p):
        pairs = _match(t, p, memo)[1]
        for k in range(3):
            t[2][k] += p[2][k]
        t[2][3] = max(t[2][3], p[2][3])
        t[2][4:] = [min(a, b) for a, b in zip(t[2][4:], p[2][4:])]
        of = {j: i for i, j in pairs}
        kids, last = list(t[1]), 0
        out = []
        for j, q in enumerate(p[1]):
            if j in of:
                out += kids[last : of[j] + 1]
                last = of[j] + 1
                merge(kids[of[j]], q)
            else:
                out.append(q)
        t[1] = out + kids[last:]

    merge(template, page)


#: Values of a sketch's numbers; this one where no text fell.
NONE = 1 << 28


def different(sketch: list[int]) -> float:
    """About how many different texts a sketch has seen: the least hashes in SKETCH classes."""
    empty = sketch.count(NONE)
    if empty:
        return SKETCH * math.log(SKETCH / empty)
    return max(SKETCH * math.log(SKETCH), SKETCH * (1 / (sum(sketch) / len(sketch) / NONE + 1e-12) - 1))


def induce(template: list) -> list:
    """[label, kids, flag] of a template: 1 on the slots that hold content, 2 where enough pages show that and names in doubt don't count.

    Constant nodes are template, but for headings of kept text.
    """
    pages = template[2][0]

    def varying(t, bad, good):
        good = good or t[0].split(".")[0] in _GOOD_TAGS
        bad = bad or t[2][3] > (1 if good else 0)
        own = 0 if bad else max(0, t[2][1] - t[2][2])
        t.append(own + sum(varying(k, bad, good) for k in t[1]))
        return t[3]

    whole = varying(template, False, False)
    path = [template]
    while True:
        best = max(path[-1][1], key=lambda k: k[3], default=None)
        if best is None or not whole or best[3] < HOLDS * whole or best[2][3] > 1:
            break
        path.append(best)
    good = [n for n in path if n[0].split(".")[0] in _GOOD_TAGS]
    # an article is taken whole; elsewhere headings beside the slot belong to it
    root = good[-1] if good else path[-1] if len(path[-1][1]) > 1 or len(path) < 2 else path[-2]
    most = max((different(n[2][4:]) for n in _nodes(root) if n[2][1]), default=0)

    kind = 1 + (pages >= ENOUGH)

    def flags(t, inside):
        """The flagged node; whether kept text lies in it, any text, and text in headings only."""
        inside = inside or t is root
        constant = most >= ENOUGH and t[2][0] >= ENOUGH and t[2][1] and different(t[2][4:]) <= CONSTANT * most
        kept = inside and not constant
        kids = [flags(k, inside) for k in t[1] if k[2][0] * RARE >= pages]
        # a heading that recurs on a host's pages belongs to the article if kept text follows it before the next heading
        follows = False
        for flagged, holds, _, heading in reversed(kids):
            if heading and inside and follows:
                _keep(flagged, kind)
            follows = not heading and (follows or holds)
        own, texts = bool(t[2][1]), [k for k in kids if k[2]]
        heading = t[0].split(".")[0] in HEADINGS or not own and bool(texts) and all(k[3] for k in texts)
        return [t[0], [k[0] for k in kids], int(kept) * kind], bool(kept and own) or any(k[1] for k in kids), own or bool(texts), heading

    return flags(template, False)[0]


def _keep(flagged: list, kind: int) -> None:
    flagged[2] = kind
    for k in flagged[1]:
        _keep(k, kind)


def _nodes(t):
    yield t
    for k in t[1]:
        yield from _nodes(k)


def _blocks(node: Node, keep, out: list[str]) -> None:
    kept = keep(node)
    if node.bad == 2 or node.bad and kept < 2:
        return
    text: list[str] = []

    def flush():
        block = " ".join("".join(text).split())
        if block and kept:
            out.append(block)
        text.clear()

    for kid in node.kids:
        if isinstance(kid, Node):
            flush()
            _blocks(kid, keep, out)
        else:
            text.append(kid[0])
    flush()


def extract(page: str, wrapper: list | None, align=None) -> str:
    """The page's content blocks, two newlines between."""
    root = parse(page)
    chosen: dict[int, int] = {}
    if wrapper is not None:
        top = Slot("", [root])
        flags = align(top.shape())
        for slot, flag in zip(top.walk(), flags):
            chosen.update((id(m), flag) for m in slot.members)
    out: list[str] = []
    if any(chosen.values()):
        _blocks(root, lambda n: chosen.get(id(n), 0), out)
    if not out:  # nothing where the host's content usually is: all that its mark-up leaves
        _blocks(root, lambda n: 1, out)
    return "\n\n".join(out)


def _aligned(wrapper: list, shape: list) -> list[int]:
    """For each node of a page's shape, in order: whether it is content, by alignment to the wrapper."""
    memo: dict = {}
    flags: list[int] = []

    def go(s, w, inherited):
        flag = w[2] if w is not None else inherited
        flags.append(flag)
        of = {j: i for i, j in _match(w, s, memo)[1]} if w is not None else {}
        for j, k in enumerate(s[1]):
            go(k, w[1][of[j]] if j in of else None, flag)

    go(shape, wrapper, 0)
    return flags


def _summaries(pages: DataFrame, html_col: str) -> DataFrame:
    """(host, key, shape, nodes) of every page: the shape of its tree, a hash of it, and (chars, links, texts, bad) of each node."""

    def run(batches):
        for batch in pieces(batches, 200):
            keys, shapes, nodes = [], [], []
            for raw in raw_texts(batch.column(1)):
                top = Slot("", [parse(raw.decode("utf-8", "replace"))])
                found = []
                for slot in top.walk():
                    parts = [k for m in slot.members for k in m.kids if not isinstance(k, Node)]
                    text = "".join(k[0] for k in parts)
                    found.append((len(text.strip()), sum(len(k[0]) for k in parts if k[1]), xxhash.xxh64_intdigest(text.encode("utf-8", "replace")) >> 32, min(m.bad for m in slot.members)))
                shapes.append(json.dumps(top.shape(), separators=(",", ":")))
                keys.append(xxhash.xxh3_128_digest(shapes[-1]))
                nodes.append([dict(zip(("chars", "links", "texts", "bad"), x)) for x in found])
            kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("chars", "links", "texts", "bad")]))
            yield pa.record_batch([batch.column(0), pa.array(keys, pa.binary()), pa.array(shapes, pa.string()), pa.array(nodes, kind)], names=["host", "key", "shape", "nodes"])

    node = "array<struct<chars:bigint,links:bigint,texts:bigint,bad:bigint>>"
    return pages.select("host", F.col(html_col).cast("string").alias("t")).mapInArrow(run, f"host string, key binary, shape string, nodes {node}")


def _host(url_col: str):
    """Lower-case host of a URL; the empty string if there is none, so such pages form one group."""
    return F.coalesce(F.lower(F.regexp_extract(F.col(url_col).cast("string"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, wrapper JSON) induced from all pages of each host.

    Text statistics are summed by (host, shape, node) before any tree is
    matched; trees of one shape are one tree, and different texts are counted by sketches that
    merge. At most about MERGED trees of a host meet in one task, then the templates of such parts, and so on until one is left.
    """
    seen = _summaries(pages.withColumn("host", _host(url_col)), html_col)
    seen = written(seen, "page-trees")
    each = seen.select("host", "key", F.posexplode("nodes").alias("k", "x")).select("host", "key", "k", "x.*")
    least = [F.coalesce(F.min(F.when(F.col("texts") % SKETCH == i, F.floor(F.col("texts") / SKETCH))), F.lit(NONE)).cast("long").alias(f"t{i}") for i in range(SKETCH)]
    stats = each.groupBy("host", "key", "k").agg(F.count("*").alias("pages"), F.sum("chars").alias("chars"), F.sum("links").alias("links"), F.max("bad").alias("bad"), *least)
    stats = stats.select("host", "key", "k", F.array("pages", "chars", "links", "bad", *[f"t{i}" for i in range(SKETCH)]).alias("own"))
    stats = stats.groupBy("host", "key").agg(F.array_sort(F.collect_list(F.struct("k", "own"))).alias("nodes"))
    shapes = written(stats.join(seen.groupBy("host", "key").agg(F.any_value("shape").alias("shape")), ["host", "key"]), "page-shapes")

    def with_stats(shape: str, nodes) -> list:
        rows = iter(nodes)

        def go(s):
            own = [int(x) for x in next(rows)["own"]]
            return [s[0], [go(k) for k in s[1]], own]

        return go(json.loads(shape))

    def fold(pdf: pd.DataFrame, tree) -> list[tuple]:
        out = []
        for (host, part), g in pdf.groupby(["host", "part"], sort=False):
            trees = sorted(map(tree, g.itertuples()), key=lambda t: (-t[2][0], json.dumps(t)))
            for t in trees[1:]:
                _join(trees[0], t)
            out.append((host, int(part), json.dumps(trees[0], separators=(",", ":"))))
        return out

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(fold(pdf, lambda r: with_stats(r.shape, r.nodes)), columns=["host", "part", "tree"])

    def further(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(fold(pdf, lambda r: json.loads(r.tree)), columns=["host", "part", "tree"])

    def last(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [(r.host, json.dumps(induce(json.loads(r.tree)), separators=(",", ":"))) for r in pdf.itertuples()]
        return pd.DataFrame(out, columns=["host", "wrapper"])

    def dealt(df: DataFrame, trees: int, each: int):
        return df.withColumn("g", F.pmod(F.xxhash64("host", "part"), F.lit(max(1, trees // each)))).groupBy("g")

    per = shapes.groupBy("host").agg(F.ceil(F.count("*") / MERGED).alias("parts"))
    parts, trees = per.agg(F.coalesce(F.max("parts"), F.lit(1)), F.coalesce(F.sum("parts"), F.lit(0))).first()
    found = dealt(shapes.join(per, "host").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts"))), shapes.count(), 2000).applyInPandas(first, "host string, part bigint, tree string")
    while parts > 1:
        found = written(found, "page-templates")
        found = dealt(found.withColumn("part", F.floor(F.col("part") / MERGED)), trees, 200).applyInPandas(further, "host string, part bigint, tree string")
        parts = -(-parts // MERGED)
    return dealt(found, trees, 200).applyInPandas(last, "host string, wrapper string")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each input row: id, url, text, n_chars.

    Null or empty html gives the empty text and 0. Pages without a host in their
    URL (or without a URL) share one template. Repeated pages, repeated and null ids each count and each give
    a row. A page is read whole by one task, however long. Bytes that aren't UTF-8 are read as
    replacement characters. An empty table gives no rows. Other columns are not read and may have any name.
    """
    own = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    known = written(wrappers(own, "url", "html"), "wrappers")
    joined = own.withColumn("host", _host("url")).join(known, "host", "left").select("id", "url", "html", "wrapper")

    def run(batches):
        loaded: dict[str, list] = {}
        aligned: dict[tuple[str, str], list[int]] = {}
        for batch in pieces(batches):
            texts = []
            for raw, w in zip(raw_texts(batch.column(2)), batch.column(3).to_pylist()):
                if not raw:
                    texts.append("")
                    continue
                if w is not None and w not in loaded:
                    if len(loaded) > 5000:
                        loaded.clear()
                        aligned.clear()
                    loaded[w] = json.loads(w)

                def align(shape, w=w):
                    key = (w, xxhash.xxh3_128_hexdigest(json.dumps(shape)))
                    if key not in aligned:
                        if len(aligned) > 20_000:
                            aligned.clear()
                        aligned[key] = _aligned(loaded[w], shape)
                    return aligned[key]

                texts.append(extract(raw.decode("utf-8", "replace"), loaded.get(w) if w is not None else None, align))
            # decoded references may name half of a surrogate pair, which no string can hold
            texts = [t.encode("utf-8", "replace").decode() for t in texts]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["id", "url", "text", "n_chars"])

    kinds = {c: own.schema[c].dataType.simpleString() for c in ("id", "url")}
    out = joined.mapInArrow(run, f"id {kinds['id']}, url {kinds['url']}, text string, n_chars bigint")
    return out.withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)


def op3_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
