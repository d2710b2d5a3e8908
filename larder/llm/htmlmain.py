"""Main text of pages by site style trees.

The pages of a host are merged into one tree: a node is an element by its chain of tags, each with its first class or
else id. A node's presentation on a page is the sequence of its children's tags, its content the
blocks of text right in it. Over the m distinct pages of the host that have a node,

* a text on c of them has the importance 1 - ln c / ln m: 0 on all pages, 1 on one,
* the node's content has the mean importance of its texts, each weighed by its length and its pages, and
* its presentation has its entropy to the base m: 0 where all pages lay it out alike.

On each page importance is composed upwards: a node takes ``PRESENTATION`` of its own presentation and the rest of its
content and children, weighed by their length. A branch whose composite importance is below the threshold goes with all that
it holds, unless some part of it has an importance of ``MEANINGFUL`` or more; a text of low importance goes wherever it
stands. Inside of article and main elements only what is on practically all pages is low. Nodes of fewer than
``LEAST_PAGES`` pages tell nothing and count as content.

Entropy can't tell an advert whose words are new on every page. So the tree keeps the structure of its nodes too: a box that on
most of its pages stands beside their article or main element and holds less than ``ASIDE`` of their text goes (not where it has the
page's only h1), and so does one of which ``LINKED`` or more is links, unless it holds half of the text. All elements are evidence, furniture included.

Names decide what statistics leave open: on hosts with few pages, and for boxes inside of an article. Elements that HTML itself sets
apart (nav, footer, aside, form and the like), and those with a class or id that is made of nothing but words for furniture and for boxes
(``site-header``, ``topnav``, but not ``no-sidebar``), count as removed branches, unless they wrap the page's main element, or most of its text
where it has none; so do boxes of at least ``LEAST_LINKS`` links and little else outside of main elements.

Only boilerplate leaves the statistics: rows of a host's low texts and of its nodes without important texts or beside the main
element. All sums are combined before the shuffle. Few rows are broadcast; otherwise each page's own nodes and texts meet them by (host, key), so
no row holds a whole host, and a very common host is dealt in parts.

Defined results: a null or empty html, or one without text, is empty text; a null or hostless url is a site of its own without statistics;
pages of a host with the same main text (repeated rows, mirrored copies) count once in the statistics, and each has its row; an empty
table gives an empty one; other columns are ignored. Very long pages are parsed whole, in memory and time that grow with their length.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import bound_batches, cut, stored

#: Importance below which a text or a branch goes, and either inside of article elements, and the pages a node needs for statistics.
LEAST, LEAST_BRANCH, LEAST_INSIDE, LEAST_PAGES = 0.08, 0.2, 0.005, 5
#: Share of the presentation in a node's importance; importance of a part that keeps its branch.
PRESENTATION, MEANINGFUL = 0.1, 0.5
#: Share of a page's text from which an element that names say is furniture is rather its wrapper: forms and headers, other elements.
WRAPS, WRAPS_NAMED = 0.5, 0.8
#: Low texts and nodes (about 24 bytes each) up to which they are broadcast, counted first; parts of a host beyond.
BROADCAST_ROWS, HOST_PARTS, COPY_PARTS = 300_000, 32, 8
#: Share of its pages' text below which a box beside their main element goes; share of links from which a box goes, and the links it needs without statistics.
ASIDE, LINKED, LEAST_LINKS = 0.35, 0.6, 3

# HTML elements by their part in a page, and words of classes and ids.
_NEVER = {"script", "style", "noscript", "template", "iframe", "svg", "math", "object", "embed", "canvas", "audio", "video", "head", "title", "nav", "footer", "aside", "select", "button", "textarea", "input", "label", "dialog", "menu", "datalist", "option"}
#: Those of them that are part of the tree all the same.
_APART = {"nav", "footer", "aside"}
_BOXED = {"div", "section", "header", "form", "fieldset", "ul", "ol", "nav", "footer", "aside"}
_WRAPPERS = {"form", "fieldset", "header"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"}
_MAIN = {"article", "main"}
_CLOSES_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
_PEERS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_FURNITURE = {"nav", "navbar", "navigation", "menu", "header", "masthead", "topbar", "footer", "sidebar", "aside", "ad", "ads", "advert", "advertisement", "adverts", "banner", "promo", "promotion", "sponsor", "sponsored", "notice", "notices", "cookie", "cookies", "consent", "gdpr", "alert", "respond", "reply", "replies", "disqus", "form", "search", "login", "signup", "newsletter", "subscribe", "share", "sharing", "social", "related", "recommended", "breadcrumb", "breadcrumbs", "pagination", "pager", "popup", "modal", "overlay", "toolbar", "disclaimer", "copyright", "recent", "skip", "bio"}
_COMMENTS = {"comment", "comments"}
_BOXES = {"site", "global", "top", "bottom", "left", "right", "upper", "lower", "primary", "secondary", "box", "wrap", "wrapper", "container", "area", "list", "bar", "block", "section", "slot", "unit", "item", "inner", "outer", "widget", "links", "text", "thread", "reader", "user", "body", "div", "id", "widgets", "buttons", "button", "icons", "link", "by", "google", "x"}
#: Words of the page's own parts: furniture with any of the words above but header.
_PARTS = {"post", "posts", "content", "main", "author", "page", "article", "entry"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}

_RAW = re.compile(r"(?is)<!--.*?(?:-->|\Z)|<!\[CDATA\[|\]\]>|<(script|style|noscript|template|iframe|svg|textarea|title)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>")
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
_NAMED = re.compile(r"""(?i)(?:^|[\s/"'])(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+)|(?=[\s/>]|$))""")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])").findall
_UNSEEN = re.compile(r"(?i)(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)").search
_GLUED = re.compile("(?:" + "|".join(sorted(_FURNITURE | _COMMENTS | _BOXES - {"x", "by", "id"} | {"bygoogle"}, key=len, reverse=True)) + ")").findall

#: What names say of an element: content, furniture unless it wraps the page, never content.
CONTENT, FURNITURE, NEVER = 0, 1, 2


def _hash(*parts: object) -> int:
    return xxhash.xxh3_64_intdigest("\0".join(map(str, parts)).encode("utf-8", "replace")) - 2**63


def named(value: str) -> int:
    """What a class or id says of its element: each of its names is taken whole."""
    says, known = CONTENT, _FURNITURE | _COMMENTS | _BOXES | _PARTS
    for name in value.split():
        words = set()
        for word in map(str.lower, _WORDS(name)):
            glued = [] if word in known else _GLUED(word)
            words |= {word} if "".join(glued) != word else {*glued} - {"bygoogle"}
        if words and words <= known and words & (_FURNITURE | _COMMENTS) and not ("header" in words and words & _PARTS):
            says = max(says, NEVER if words & _COMMENTS else FURNITURE)
    return says


class Node:
    """An element of a page with what the tree knows it by, its blocks of text and its children."""

    __slots__ = ("blocks", "children", "gone", "inside", "key", "length", "linked", "links", "main", "own_linked", "own_links", "parent", "says", "shape", "tag", "titled", "unseen")

    def __init__(self, tag: str, key: int, parent: Node | None, says: int, inside: bool) -> None:
        self.tag, self.key, self.parent, self.says, self.inside = tag, key, parent, says, inside
        self.blocks: list[tuple[int, str]] = []
        self.children: list[Node] = []
        self.shape: list[str] = []
        self.length, self.main, self.gone, self.unseen, self.titled = 0, inside, False, False, tag == "h1"
        self.linked = self.links = self.own_linked = self.own_links = 0


def parse(page: str) -> list[Node]:
    """The elements of a page in their order, the root first, with what names say of them. Blocks are numbered."""
    page = _RAW.sub(" ", page)
    root = at = Node("", 0, None, CONTENT, False)
    nodes, run, count, place, linked = [root], [], 0, 0, False

    def flush() -> None:
        nonlocal count
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            run.clear()
            if text:
                at.blocks.append((count, text))
                count += 1

    def close(last: Node) -> None:
        nonlocal at
        flush()
        at = last.parent

    for tag in _TAG.finditer(page):
        if tag.start() > place:
            run.append(page[place : tag.start()])
            if linked:
                at.own_linked += len(run[-1].strip())
        place = tag.end()
        name, rest = tag[2].lower(), tag[3]
        if name in ("br", "wbr"):
            run.append(" " if name == "br" else "")
            continue
        if name in _INLINE:
            if name == "a":
                linked = not tag[1]
                at.own_links += linked
            continue
        if tag[1]:
            linked = False
            last = at
            while last.parent and last.tag != name:
                last = last.parent
            if last.parent:
                close(last)
            continue
        if name in _CLOSES_P or name in _PEERS:
            peers, last = _PEERS.get(name, {"p"}), at
            while last.parent and last.tag not in peers and last.tag == "p":
                last = last.parent
            if last.parent and last.tag in peers:
                close(last)
        flush()
        given = {k.lower(): (v or "").strip("\"'") for k, v in _NAMED.findall(rest)} if rest else {}
        main = name in _MAIN or given.get("role") == "main"
        says, unseen = CONTENT, "hidden" in given or given.get("aria-hidden") == "true" or bool(_UNSEEN(given.get("style", "")))
        if name in _NEVER or unseen:
            says = NEVER
        elif name not in ("html", "body"):
            says = named(f"{given.get('class', '')} {given.get('id', '')}") if given else CONTENT
            if name in ("form", "fieldset") or name == "header" and not at.inside or given.get("role") in _ROLES:
                says = max(says, FURNITURE)
        if says != NEVER and (name == "main" or given.get("role") == "main"):
            says = CONTENT
        # Comments and teasers are often article elements too.
        main, says = main and says == CONTENT and at.says != NEVER, NEVER if at.says == NEVER else says
        mark = (given.get("class") or given.get("id") or "").split()
        at.shape.append(name)
        if name not in _VOID and not rest.rstrip().endswith("/"):
            child = Node(name, _hash(at.key, name, *mark[:1]), at, says, at.inside or main)
            child.main, child.unseen = main, at.unseen or unseen or name in _NEVER - _APART
            at.children.append(child)
            nodes.append(child)
            at = child
    run.append(page[place:])
    flush()
    for node in reversed(nodes):
        node.gone = node.unseen
    _measure(nodes)
    return nodes


def _measure(nodes: list[Node]) -> None:
    """Count text and links of what is not gone, and see what wraps a main element or holds a title."""
    for node in reversed(nodes):
        if node.gone:
            node.length = node.linked = node.links = 0
            node.main = node.titled = False
        else:
            node.length = sum(len(t) for _, t in node.blocks) + sum(c.length for c in node.children)
            node.linked = min(node.length, node.own_linked + sum(c.linked for c in node.children))
            node.links = node.own_links + sum(c.links for c in node.children)
            node.main = node.main and node.length > 0 or any(c.main for c in node.children)
            node.titled = node.titled or any(c.titled for c in node.children)


def _beside(node: Node, root: Node, titled: bool) -> bool:
    """Whether a box stands beside the page's main element and is not where its only title is."""
    return root.main and not node.inside and not node.main and node.tag in _BOXED and (titled or not node.titled)


def remove_named(nodes: list[Node], aside: frozenset[int] | set[int] = frozenset()) -> None:
    """Mark as gone the nodes ``aside`` and what names or links say is furniture, and all it holds; count the text of what is left."""
    root, titled = nodes[0], any(n.inside and n.titled for n in nodes)
    for node in nodes[1:]:
        boxed = node.key in aside and not node.main and (_beside(node, root, titled) or node.length < root.length * WRAPS and node.linked >= node.length * LINKED)
        node.gone = node.parent.gone or node.gone or node.says == NEVER or boxed
    _measure(nodes)
    whole, has_main = root.length, root.main
    for node in nodes[1:]:
        if node.gone or node.parent.gone:
            node.gone = True
        elif node.says == FURNITURE:
            wraps = node.main if has_main else node.length > whole * (WRAPS if node.tag in _WRAPPERS else WRAPS_NAMED)
            node.gone = not wraps or node.tag in _MAIN
        elif node.links >= LEAST_LINKS and node.linked >= node.length * LINKED and node.tag in _BOXED:
            node.gone = not node.inside and not node.main and node.length < whole * WRAPS
    _measure(nodes)


def main_text(page: str | None, low: frozenset[int] | set[int] = frozenset(), known: dict[int, tuple[float | None, float, bool]] | None = None) -> str:
    """The main text of a page, given the low texts of its host, and of nodes: content (None without texts) and presentation importance, and whether they stand aside."""
    nodes, known = parse(page or ""), known or {}
    remove_named(nodes, {k for k, v in known.items() if v[2]})
    composite: dict[Node, float] = {}
    best: dict[Node, float] = {}
    for node in reversed(nodes):
        if node.gone or not node.length:
            continue
        content, presentation, _ = known.get(node.key, (1.0, None, False))
        own = sum(len(t) for _, t in node.blocks)
        inner = [c for c in node.children if c.length]
        mean = (own * (1.0 if content is None else content) + sum(c.length * composite[c] for c in inner)) / node.length
        composite[node] = mean if presentation is None or not inner else PRESENTATION * presentation + (1 - PRESENTATION) * mean
        best[node] = max([composite[node], *([content] if own and content is not None else []), *[best[c] for c in inner]])
    out: list[tuple[int, str]] = []
    for node in nodes:
        if node in composite and not (node.parent and node.parent.gone):
            node.gone = composite[node] < (LEAST_INSIDE if node.inside else LEAST_BRANCH) and best[node] < MEANINGFUL
            if not node.gone:
                out += [(i, t) for i, t in node.blocks if not low or _hash(node.key, "t", t) not in low]
        else:
            node.gone = True
    return "\n\n".join(t for _, t in sorted(out))


_OBSERVED = pa.schema([("host", pa.string()), ("page", pa.int64()), ("node", pa.int64()), ("kind", pa.int32()), ("feature", pa.int64()), ("inside", pa.bool_()), ("size", pa.int64()), ("linked", pa.int64()), ("whole", pa.int64()), ("beside", pa.int64())])


def _observed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each page with the digest of its main text: its nodes (with their text, their links, the page's text and whether they stand beside the main element), the texts of each, and the child tags of each."""
    for batch in batches:
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            every = parse(page or "")
            root, titled = every[0], any(n.inside and n.titled for n in every)
            nodes, whole, of = [n for n in every if n.length], root.length, {}
            seen = {(n.key, kind, feature, n.inside, size, 0, 0, 0) for n in nodes for kind, feature, size in ((2, _hash("s", *n.shape), 1), *((1, _hash(n.key, "t", t), len(t)) for _, t in n.blocks))}
            for n in nodes:
                inside, size, linked, beside = of.get(n.key, (False, 0, 0, 1))
                of[n.key] = (inside or n.inside, size + n.length, linked + n.linked, min(beside, int(_beside(n, root, titled))))
            seen |= {(key, 0, 0, inside, size, linked, whole, beside) for key, (inside, size, linked, beside) in of.items()}
            remove_named(every)
            inner = [t for n in every if n.length and n.inside for _, t in n.blocks]
            digest = _hash("page", *(inner or [t for n in every if n.length for _, t in n.blocks]))
            columns = list(zip(*seen, strict=True)) if seen else [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([[host] * len(seen), [digest] * len(seen), *columns], _OBSERVED, strict=True)], schema=_OBSERVED)


def site_trees(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The trees of the hosts of ``pages`` (host, html): (host, node, m, content, presentation, inside, aside), and (host, node, feature, c) of texts on several pages."""
    seen = pages.where("host <> ''").select("host", "html").mapInArrow(_observed, "host string, page long, node long, kind int, feature long, inside boolean, size long, linked long, whole long, beside long")
    # Copies of a page are one page.
    measures = ("size", "linked", "whole")
    seen = seen.groupBy("host", "node", "kind", "feature", "page").agg(F.max("inside").alias("inside"), F.min("beside").alias("beside"), *[F.max(c).alias(c) for c in measures])
    # A text has one length; what a node holds is summed over its pages.
    counts = seen.groupBy("host", "node", "kind", "feature").agg(F.count("*").alias("c"), F.max("inside").alias("inside"), F.max("size").alias("size"), *[F.sum(c).alias(f"{c}s") for c in (*measures, "beside")])
    counts = stored(counts, "html-counts")
    c, of = F.col("c").cast("double"), lambda kind, x: F.sum(F.when(F.col("kind") == kind, x))
    weigh = {0: F.lit(0), 1: F.col("size"), 2: F.lit(1)}
    sums = counts.groupBy("host", "node").agg(
        of(0, F.col("c")).alias("m"),
        F.max("inside").alias("inside"),
        *[of(0, F.col(f"{k}s")).alias(k) for k in (*measures, "beside")],
        *[of(k, x * weigh[k]).alias(f"{n}{k}") for k in (1, 2) for n, x in (("n", c), ("l", c * F.log(c)))],
    )
    sums = sums.where(F.col("m") >= LEAST_PAGES)
    base = F.log(F.col("m").cast("double"))
    beside = (2 * F.col("beside") >= F.col("m")) & (F.col("size") < ASIDE * F.col("whole"))
    links = ~F.col("inside") & (F.col("linked") >= LINKED * F.col("size")) & (F.col("size") < WRAPS * F.col("whole"))
    nodes = sums.select("host", "node", "m", (1 - F.col("l1") / (F.col("n1") * base)).alias("content"), ((F.log("n2") - F.col("l2") / F.col("n2")) / base).alias("presentation"), "inside", (beside | links).alias("aside"))
    return nodes, counts.where("kind = 1 and c > 1").select("host", "node", "feature", "c")


def low_importance(pages: DataFrame) -> DataFrame:
    """(host, key, node): the hashes of low texts (node is null), and nodes without important texts or aside, as struct<content, presentation, aside>."""
    nodes, texts = site_trees(pages)
    least = F.when(F.col("inside"), F.lit(LEAST_INSIDE)).otherwise(F.lit(LEAST))
    texts = texts.where(F.col("c") >= LEAST_PAGES**(1 - LEAST)).join(nodes, ["host", "node"]).where(1 - F.log(F.col("c").cast("double")) / F.log(F.col("m").cast("double")) < least)
    low = nodes.where(F.col("content").isNull() | (F.col("content") < LEAST_BRANCH) | F.col("aside"))
    return texts.select("host", F.col("feature").alias("key"), F.lit(None).cast("struct<content:double,presentation:double,aside:boolean>").alias("node")).distinct().union(low.select("host", F.col("node").alias("key"), F.struct("content", "presentation", "aside")))


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, page, key) of the nodes and texts of each page."""
    for batch in batches:
        for host, page, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            nodes = [n for n in parse(text or "") if n.length]
            keys = {n.key for n in nodes} | {_hash(n.key, "t", t) for n in nodes for _, t in n.blocks}
            yield pa.RecordBatch.from_arrays([pa.array([host] * len(keys), pa.string()), pa.array([page] * len(keys), pa.int64()), pa.array(list(keys), pa.int64())], ["host", "page", "key"])


def with_low(pages: DataFrame, low: DataFrame) -> DataFrame:
    """``pages`` (host, html, page_id, url) with ``found``: what ``low_importance`` says of their nodes and texts, or of their whole host where that is little."""
    one = F.collect_list(F.struct("key", "node")).alias("found")
    if low.count() <= BROADCAST_ROWS:
        return pages.join(F.broadcast(low.groupBy("host").agg(one)), "host", "left")
    # A very common host or a page with many copies is dealt in parts; rows found for another page of the host would change nothing.
    pages = pages.withColumn("page", F.xxhash64("html")).withColumn("copy", F.pmod(F.xxhash64("page_id", "url"), F.lit(COPY_PARTS)).cast("int"))
    dealt = lambda df, name, n: df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    wanted = pages.where("host <> ''").select("host", "page", "html").mapInArrow(_keys, "host string, page long, key long").distinct().withColumn("part", F.pmod(F.hash("page"), F.lit(HOST_PARTS)))
    found = wanted.join(dealt(low, "part", HOST_PARTS), ["host", "key", "part"]).groupBy("host", "page").agg(one)
    return pages.join(dealt(found, "copy", COPY_PARTS), ["host", "page", "copy"], "left")


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = []
        for page, found in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            low = frozenset(f["key"] for f in found or () if f["node"] is None)
            text.append(main_text(page, low, {f["key"]: (f["node"]["content"], f["node"]["presentation"], f["node"]["aside"]) for f in found or () if f["node"]}))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])


def host_of(url: str = "url") -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for every row of ``pages`` (page_id, url, html)."""
    bound_batches(pages.sparkSession)
    pages = pages.select("page_id", "url", "html", host_of().alias("host"))
    joined = with_low(pages, cut(low_importance(pages))).select("page_id", "url", "html", "found")
    return joined.mapInArrow(_extracted, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
