"""Main text of HTML pages by a site style tree.

Every page is parsed once into its elements and the blocks of text that stand in them; only what no browser shows (scripts,
styles, comments, the head) is left out there. The pages of a host are merged into one style tree, whose nodes are the paths
of tags, classes and identifiers from the root. Over the host's distinct pages each node has two entropies, both scaled to
0..1: of its content (the text directly inside) and of its presentation (the sequence of what it holds). Both are drawn
towards 1 by ``DOUBT`` pages that are taken for all different, so that small hosts remove little by them.

From these every page takes the composite importance of its branches, bottom-up: a leaf has that of its content; an element
with l parts has (1 - g^l) times that of its presentation and g^l times the mean of its parts' (g: ``SHARE``). A branch in
which nothing reaches ``LEAST`` goes, from its root down. Next goes what the markup itself declares to be no content (menus,
headers, footers, sidebars, notices, adverts, forms, reader comments), which entropy can't tell where it differs from page
to page. What is left is narrowed to the articles, if they hold ``MAIN`` of it or more, or else to a main element, or else
to the largest element that is called content, under the same condition.

A class declares by a whole token (``sidebar``, ``ad-slot``, ``site-footer``), not by one that says otherwise
(``has-sidebar``, ``ad-free``, ``comments-enabled``), and the only article of a page is never dropped for the class of what
stands around it, unless that is a place of comments or adverts.

Nodes are aggregated over (host, node, value) with partial sums, so a host with a third of all pages is no hot key, and pages
learn their nodes' entropies by a salted join on the node. Parsing is linear in the page, whatever is nested, unclosed or
quoted. Defined cases: a null or empty html, or one of markup only, has empty text; a null url is a host of its own; repeated
pages count once in the tree and are returned each; importance alone never empties a page; an unclosed comment or script
runs to the end, an unclosed tag is text; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import html as entities
import json
import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloop.llm.common import materialise, prepare
from graphloop.llm.url_filter import parts

LEAST, SHARE, DOUBT, MAIN, SALTS = 0.25, 0.9, 1.0, 0.25, 32

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"""[>"']""")
_COMMENT_END = re.compile(r"--!?>")
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_DIGITS = re.compile(r"[0-9]+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr keygen basefont frame".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre section select summary table tbody td template tfoot th thead tr ul caption search".split()
)
_UNSEEN = frozenset("head noscript template select datalist svg canvas object audio video map".split())
_IN_HEAD = frozenset("base link meta title style script noscript template".split())
_NO_CONTENT = frozenset("nav footer aside form button dialog menu search input fieldset".split())
_CLOSES_P = _BLOCK - {"option", "optgroup", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "html", "head", "body"}
#: An open element of the first kind ends where one of its group begins, if none of the bounds stands between.
_SIBLINGS = {"li": (("li",), ("ul", "ol", "menu")), "dd": (("dd", "dt"), ("dl",)), "dt": (("dd", "dt"), ("dl",)), "option": (("option",), ("select",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tbody": (("tbody", "thead", "tr", "td", "th"), ("table",)), "tfoot": (("tbody", "thead", "tr", "td", "th"), ("table",))}
_STRONG = frozenset("ad ads advert adverts advertisement advertisements advertising adsense adslot sponsor sponsored sponsors comment comments commentlist disqus cookie cookies consent gdpr".split())
_WEAK = frozenset("banner promo promos promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs notice notices notification popup modal overlay newsletter subscribe subscription signup login share sharing sharer social related recommended recommendations respond replies footer header masthead widget widgets toolbar pagination pager copyright skip hidden search aside toc".split())
_BODY = frozenset("content main article post entry story body page wrapper container layout text".split())
#: Words that turn a token's meaning: it tells of a page that has or lacks such a part, and isn't one.
_TURNS = frozenset("has have no non not without with free enabled disabled off on is open closed show hide theme layout count".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: What an element is: declared no content by tag or role, by a strong or a weak class; an article, a main, or called content.
HARD, STRONG, WEAK, ARTICLE, MAIN_ELEMENT, CONTENT = 1, 2, 4, 8, 16, 32


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(raw)}


def _kind(tag: str, a: dict[str, str], in_article: bool) -> int:
    """What tag and attributes say an element is, as a sum of the kinds above."""
    role = a.get("role", "").lower()
    if tag in _NO_CONTENT or tag == "header" and not in_article:
        return HARD
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or role in _ROLES or "display:none" in a.get("style", "").replace(" ", "").lower():
        return HARD
    if tag in ("html", "body"):
        return 0
    is_main = MAIN_ELEMENT if tag == "main" or role == "main" else 0
    own = ARTICLE if tag == "article" or a.get("itemprop") == "articleBody" else is_main
    tokens = [[w.lower() for w in _WORD.findall(t)] for t in f"{a.get('class', '')} {a.get('id', '')}".split()]
    said = {w for t in tokens if not _TURNS.intersection(t) for w in t}
    if said & _STRONG and not is_main:
        return STRONG
    if own:
        return own
    if said & _BODY:
        return CONTENT
    return WEAK if said & (_WEAK - {"header"} if in_article else _WEAK) else 0


class _Paths:
    """Identifiers of nodes from their parent's and their own signature, kept in a bounded table."""

    def __init__(self):
        self.known: dict[tuple[int, str], int] = {}

    def of(self, parent: int, signature: str) -> int:
        from xxhash import xxh64_intdigest

        key = (parent, signature)
        found = self.known.get(key)
        if found is None:
            if len(self.known) > 100_000:
                self.known.clear()
            found = self.known[key] = xxh64_intdigest(f"{parent}/{signature}".encode("utf-8", "surrogatepass"))
        return found


_PATHS = _Paths()


class _Page:
    """Elements in the order of their start tags: parent, node and kind; blocks of text (element, text, inline marks)."""

    def __init__(self, page: str):
        self.parent, self.node, self.kind, self.signature = [-1], [0], [0], [""]
        self.blocks: list[tuple[int, str, str]] = []
        # The open elements: tag, element, whether text is seen there, whether in an article.
        self._stack: list[tuple[str, int, bool, bool]] = [("", 0, True, False)]
        self._at: dict[str, list[int]] = {}  # places in the stack by tag
        self._block_at, self._bar_at = [0], [0]  # places of blocks, and of those that aren't a paragraph
        self._pieces: list[str] = []
        self._marks: list[str] = []
        self._read(page)

    def _close_block(self) -> None:
        if self._pieces:
            text = "".join(self._pieces)
            text = " ".join((entities.unescape(text) if "&" in text else text).split())
            if text:
                self.blocks.append((self._stack[self._block_at[-1]][1], text, " ".join(self._marks)))
        self._pieces, self._marks = [], []

    def _pop_to(self, k: int) -> None:
        if self._block_at[-1] >= k:
            self._close_block()
        while len(self._stack) > k:
            place = len(self._stack) - 1
            self._at[self._stack.pop()[0]].pop()
            for at in (self._block_at, self._bar_at):
                if at[-1] == place:
                    at.pop()

    def _last(self, tag: str) -> int:
        at = self._at.get(tag)
        return at[-1] if at else -1

    def _push(self, tag: str, a: dict[str, str], raw: bool = False) -> None:
        _, element, seen, in_article = self._stack[-1]
        place = len(self._stack)
        kind = _kind(tag, a, in_article)
        if raw or tag in _UNSEEN:
            seen = False
        if tag in _BLOCK:
            signature = f"{tag}.{' '.join(sorted(set(_DIGITS.sub('0', a.get('class', '')).split())))}#{_DIGITS.sub('0', a.get('id', ''))}" if a else tag
            if seen:
                self.parent.append(element)
                self.node.append(_PATHS.of(self.node[element], signature))
                self.kind.append(kind)
                self.signature.append(signature)
                element = len(self.parent) - 1
            self._block_at.append(place)
            if tag != "p":
                self._bar_at.append(place)
        elif kind & (HARD | STRONG | WEAK):
            seen = False
        elif seen:
            self._marks.append(tag)
        self._stack.append((tag, element, seen, in_article or bool(kind & ARTICLE)))
        self._at.setdefault(tag, []).append(place)

    def _end(self, tag: str) -> None:
        k = self._last(tag)
        if k > 0 and (tag in _BLOCK or k > self._bar_at[-1]):  # an inline end tag doesn't reach past a block
            self._pop_to(k)

    def _start(self, tag: str, raw: str) -> None:
        if self._stack[-1][0] == "head" and tag not in _IN_HEAD:
            self._pop_to(len(self._stack) - 1)
        if tag == "br":
            self._pieces.append(" ")
            return
        if tag in _CLOSES_P and self._last("p") > self._bar_at[-1]:
            self._pop_to(self._last("p"))
        if tag in _SIBLINGS:
            ends, bounds = _SIBLINGS[tag]
            bound = max(map(self._last, bounds))
            first = min((at[k] for e in ends if (at := self._at.get(e)) and (k := bisect_right(at, bound)) < len(at)), default=0)
            if first:
                self._pop_to(first)
        if tag in _BLOCK:
            self._close_block()
        if tag not in _VOID:
            self._push(tag, _attributes(raw) if raw.strip() else {}, raw=tag in _RAW)

    def _tag_end(self, s: str, at: int) -> int:
        """The place of the ``>`` that ends a tag, outside of quoted values; -1 without one."""
        start = at
        while m := _STOP.search(s, at):
            k = m.start()
            if s[k] == ">":
                return k
            at = k + 1
            if s[k] not in self._unclosed and s[start:k].rstrip()[-1:] == "=":
                start = at
                close = s.find(s[k], at)
                if close < 0:
                    self._unclosed.add(s[k])  # no quote of this kind further on
                else:
                    at = start = close + 1
        return -1

    def _read(self, s: str) -> None:
        at, size, last, self._unclosed = 0, len(s), s.rfind(">"), set()
        while at < size:
            k = s.find("<", at)
            if k < 0 or k > last and not s.startswith("<!", k):
                if self._stack[-1][2]:
                    self._pieces.append(s[at:])
                break
            if k > at and self._stack[-1][2]:
                self._pieces.append(s[at:k])
            mark = s[k + 1 : k + 2]
            if s.startswith("<!--", k):
                m = _COMMENT_END.search(s, k + 2 if s.startswith((">", "->"), k + 4) else k + 4)
                at = m.end() if m else size
            elif s.startswith("<![CDATA[", k):
                end = s.find("]]>", k)
                if self._stack[-1][2]:
                    self._pieces.append(entities.escape(s[k + 9 : end if end >= 0 else size]))
                at = end + 3 if end >= 0 else size
            elif name := _NAME.match(s, k + 1 + (mark == "/")):
                end = self._tag_end(s, name.end())
                if end < 0:
                    end = s.find(">", name.end())
                tag = name[0].lower()
                at = end + 1
                if mark == "/":
                    self._end(tag)
                    continue
                self._start(tag, s[name.end() : end])
                if tag in _RAW:
                    m = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(s, at)
                    at = m.start() if m else size
            elif mark in ("!", "/", "?"):
                end = s.find(">", k)
                at = end + 1 if end >= 0 else size
            else:
                if self._stack[-1][2]:
                    self._pieces.append("<")
                at = k + 1
        self._close_block()


def parse_page(page: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, str]], list[tuple[int, str, str]]]:
    """(parent, node, kind) of the elements that hold text, with the root first; (element, text) of the blocks; and the
    page's nodes in the tree: (node, direct text, presentation), of all its elements of one path together."""
    p = _Page(page or "")
    holds = [False] * len(p.parent)
    holds[0] = True
    for e, _, _ in p.blocks:
        while not holds[e]:
            holds[e] = True
            e = p.parent[e]
    place = {e: k for k, e in enumerate(e for e, h in enumerate(holds) if h)}
    inside: list[list[str]] = [[] for _ in p.parent]
    own: list[list[str]] = [[] for _ in p.parent]
    for e in place:
        if e:
            inside[p.parent[e]].append(p.signature[e])
    for e, text, marks in p.blocks:
        own[e].append(text)
        inside[e].append(f"={marks}")
    merged: dict[int, tuple[list[str], list[str]]] = {}
    for e in place:
        text, style = merged.setdefault(p.node[e], ([], []))
        text += own[e]
        style.append("|".join(inside[e]))
    elements = [(place.get(p.parent[e], -1), p.node[e], p.kind[e]) for e in place]
    return elements, [(place[e], text) for e, text, _ in p.blocks], [(n, "\n".join(t), "\n".join(s)) for n, (t, s) in merged.items()]


def branches(elements: list[tuple[int, int, int]], blocks: list[tuple[int, str]], known: dict[int, tuple[float, float]]) -> list[float]:
    """The greatest composite importance in the branch of each element. known: (content, presentation) entropies by node."""
    direct = [False] * len(elements)
    for e, _ in blocks:
        direct[e] = True
    total, count = [0.0] * len(elements), [0] * len(elements)
    most = [0.0] * len(elements)
    for e in range(len(elements) - 1, -1, -1):  # children come after their parents
        parent, node, _ = elements[e]
        content, style = known.get(node, (1.0, 1.0))
        n = count[e]
        if direct[e]:
            total[e] += content
        mean = total[e] / (n + direct[e]) if n + direct[e] else 1.0
        importance = (1 - SHARE**n) * style + SHARE**n * mean if n else mean
        most[e] = max(most[e], importance)
        if parent >= 0:
            total[parent] += importance
            count[parent] += 1
            most[parent] = max(most[parent], most[e])
    return most


def select(elements: list[tuple[int, int, int]], blocks: list[tuple[int, str]], known: dict[int, tuple[float, float]], least: float = LEAST) -> list[str]:
    """The texts of the blocks that stay, in order."""
    n = len(elements)
    if not blocks:
        return []
    mass = [0] * n
    for e, text in blocks:
        mass[e] += text.count(" ") + 1

    def gather(own: list[int]) -> list[int]:
        whole = own[:]
        for e in range(n - 1, 0, -1):
            whole[elements[e][0]] += whole[e]
        return whole

    def below(marked: list[bool]) -> list[bool]:
        for e in range(1, n):
            marked[e] = marked[e] or marked[elements[e][0]]
        return marked

    low = below([m < least for m in branches(elements, blocks, known)]) if known else [False] * n
    if all(low[e] for e, _ in blocks):
        low = [False] * n
    firm = below([bool(k & (HARD | STRONG)) for _, _, k in elements])
    loose = below([bool(k & WEAK) for _, _, k in elements])
    # A weak class doesn't count around the only articles of a page.
    articles = [e for e in range(n) if elements[e][2] & (ARTICLE | MAIN_ELEMENT) and not firm[e] and not low[e]]
    whole = gather(mass)
    if not any(whole[e] and not loose[e] for e in articles):
        spared = [False] * n
        for e in articles:
            while e > 0 and not spared[e]:
                spared[e] = True
                e = elements[e][0]
        loose = below([bool(k & WEAK) and not spared[e] for e, (_, _, k) in enumerate(elements)])
    gone = [a or b or c for a, b, c in zip(low, firm, loose, strict=True)]
    left = gather([0 if gone[e] else m for e, m in enumerate(mass)])

    def topmost(kind: int) -> list[int]:
        within = below([bool(k & kind) for _, _, k in elements])
        return [e for e in range(1, n) if elements[e][2] & kind and not gone[e] and not within[elements[e][0]]]

    chosen = None
    for scope in (topmost(ARTICLE), topmost(MAIN_ELEMENT), sorted(topmost(CONTENT), key=lambda e: -left[e])[:1]):
        held = sum(left[e] for e in scope)
        if held and held >= MAIN * left[0]:
            inside = [False] * n
            for e in scope:
                inside[e] = True
            chosen = below(inside)
            break
    return [t for e, t in blocks if not gone[e] and (chosen is None or chosen[e])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _pack(elements: list[tuple[int, int, int]], blocks: list[tuple[int, str]]) -> bytes:
    """A page for ``_text``, without the texts that go whatever the tree says: of these ``select`` needs the places alone."""
    import zstandard

    firm: list[bool] = []
    for parent, _, k in elements:  # parents come before their children
        firm.append(bool(k & (HARD | STRONG)) or parent >= 0 and firm[parent])
    held = [(e, "" if firm[e] else text) for e, text in blocks]
    return zstandard.compress(json.dumps([[(p, _signed(n), k) for p, n, k in elements], held]).encode(), 3)


def _text(blob: bytes, known: dict[int, tuple[float, float]], least: float) -> str:
    import zstandard

    elements, blocks = json.loads(zstandard.decompress(blob))
    return "\n".join(select(elements, blocks, known, least))


def _own(pages: DataFrame, ident: str, url: str, html: str, made) -> DataFrame:
    """``ident``, ``url``, row (a hash of all three columns), host, and what ``made`` gives for the html."""
    host, row = F.xxhash64(parts(F.col(url))[0]).alias("host"), F.xxhash64(ident, url, html).alias("row")
    got = pages.select(F.col(ident), F.col(url), row, host, made(F.coalesce(F.col(html), F.lit(""))).alias("_p"))
    return got.select(ident, url, "row", "host", "_p.*")


def parse(pages: DataFrame, ident: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Parsed pages: ``ident``, ``url``, row, host, page (digest) and nodes."""
    prepare(pages.sparkSession)

    @F.pandas_udf("page long, nodes array<struct<node:long,content:long,style:long>>")
    def parsed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh64_intdigest

        def digest(text: str) -> int:
            return _signed(xxh64_intdigest(text.encode("utf-8", "surrogatepass")))

        for texts in batches:
            rows = []
            for t in texts:
                own = [{"node": _signed(n), "content": digest(c) if c else None, "style": digest(s)} for n, c, s in parse_page(t)[2]]
                rows.append((digest(repr(own)), own))
            yield pd.DataFrame(rows, columns=["page", "nodes"])

    return _own(pages, ident, url, html, parsed)


def packed(pages: DataFrame, ident: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``ident``, ``url``, row, host and blob (packed elements and blocks)."""
    prepare(pages.sparkSession)

    @F.pandas_udf("blob binary")
    def pack(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame({"blob": [_pack(*parse_page(t)[:2]) for t in texts]}, dtype=object)

    return _own(pages, ident, url, html, pack)


def style_tree(parsed: DataFrame, doubt: float = DOUBT) -> DataFrame:
    """The style tree of every host: (host, node, pages, content, style), both entropies scaled and drawn towards 1.

    A node without direct text on any page has a content of 1.
    """
    nodes = parsed.select("host", "page", F.explode("nodes").alias("n")).select("host", "page", "n.*").distinct()
    kinds = F.explode(F.array(F.struct(F.lit(True).alias("c"), F.col("content").alias("v")), F.struct(F.lit(False).alias("c"), F.col("style").alias("v"))))
    each = nodes.select("host", "node", kinds.alias("k")).filter("k.v is not null").groupBy("host", "node", "k.c", "k.v").agg(F.count("*").alias("n"))
    of = lambda c, x: F.sum(F.when(F.col("c") == F.lit(c), x))
    own = F.col("n") * F.log("n")
    sums = each.groupBy("host", "node").agg(of(True, F.col("n")).alias("nc"), of(True, own).alias("sc"), of(False, F.col("n")).alias("pages"), of(False, own).alias("ss"))

    def scaled(n: str, s: str):
        x = F.when(F.col(n) > 1, (F.log(n) - F.col(s) / F.col(n)) / F.log(n)).otherwise(1.0)
        return F.round((F.col(n) * x + doubt) / (F.col(n) + doubt), 6)

    return sums.select("host", "node", "pages", F.coalesce(scaled("nc", "sc"), F.lit(1.0)).alias("content"), scaled("pages", "ss").alias("style"))


def extract(pages: DataFrame, ident: str = "page_id", url: str = "url", html: str = "html", least: float = LEAST, doubt: float = DOUBT) -> DataFrame:
    """Rows of ``ident``, ``url``, text and n_chars."""
    # Pages are parsed twice: what the tree needs is small and kept, their texts are only dealt to what the tree says of them.
    parsed = materialise(parse(pages, ident, url, html).drop(ident, url), "pages")
    told = style_tree(parsed, doubt).filter((F.col("content") < 1) | (F.col("style") < 1)).drop("pages")
    # A node of a large host is dealt over SALTS tasks by the page; the tree's nodes are repeated for each.
    salted = told.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    nodes = parsed.select("row", "host", F.explode("nodes.node").alias("node"), F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int").alias("salt"))
    known = nodes.join(salted, ["host", "node", "salt"]).groupBy(F.col("row").alias("_row")).agg(F.collect_set(F.struct("node", "content", "style")).alias("known"))

    @F.pandas_udf("string")
    def text(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for blobs, trees in batches:
            out = []
            for blob, tree in zip(blobs, trees, strict=True):
                entropies = {} if tree is None else {x["node"]: (x["content"], x["style"]) for x in tree}
                out.append(_text(blob, entropies, least))
            yield pd.Series(out, dtype=object)

    whole = packed(pages, ident, url, html).join(known, F.col("row") == F.col("_row"), "left")
    return whole.select(F.col(ident), F.col(url), text("blob", "known").alias("text")).withColumn("n_chars", F.length("text").cast("long"))
