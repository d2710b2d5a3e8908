"""Pages as sources: JSON-LD by SQL functions, microdata and page markup by one Arrow step.

The markup step is the only Python on the way from a page to a recipe: it builds a tolerant tree
(void elements, raw text, a block start closes an open paragraph) and returns one struct for a page.
A null or empty page gives null or empty fields.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from larder.functions.text import absolute_url, let
from larder.sources.encodings import decode, natural_key, sanitize, unescape

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}

# Where a recipe may stand on a page, and what is removed from it.
SCOPES = (".recipe", ".recipe-card", ".wprm-recipe-container", "[data-recipe]")
NOISE = ("nav", "footer", "aside", "script", "style", "form", ".comments", ".sidebar", ".share", ".newsletter")

_TOKEN = re.compile(r"(?is)<!--.*?-->|<(script|style)\b([^>]*)>(.*?)</\1\s*>|<(/?)([a-z][a-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>")
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")


class Node:
    """An element of a page, or with tag "" a text."""

    __slots__ = ("attrs", "children", "tag", "text")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, text: str = "") -> None:
        self.tag, self.attrs, self.children, self.text = tag, attrs or {}, [], text

    def walk(self) -> Iterator[Node]:
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo.extend(reversed(node.children))

    def content(self) -> str:
        return " ".join("".join(n.text if not n.tag else (" " if n.tag == "br" or n.tag in BLOCKS or n.tag == "li" else "") for n in self.walk()).split())

    def matches(self, selector: str) -> bool:
        """One of .class, [attribute] or a tag."""
        if selector[0] == ".":
            return selector[1:] in self.attrs.get("class", "").split()
        return selector[1:-1] in self.attrs if selector[0] == "[" else self.tag == selector


def tree(page: str) -> Node:
    root = Node("#root")
    stack, at = [root], 0

    def text(upto: int) -> None:
        if upto > at:
            stack[-1].children.append(Node("", text=unescape(page[at:upto])))

    for m in _TOKEN.finditer(page):
        text(m.start())
        at = m.end()
        if m[1]:
            raw = Node(m[1].lower(), _attributes(m[2]))
            raw.children.append(Node("#raw", text=m[3]))
            stack[-1].children.append(raw)
        elif m[5]:
            name = m[5].lower()
            if m[4]:
                depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == name), 0)
                if depth:
                    del stack[depth:]
                continue
            closes = {"li": "li", "dt": "dt", "dd": "dd"}.get(name, "p" if name in BLOCKS else "")
            if closes:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == closes:
                        del stack[i:]
                        break
                    if stack[i].tag in BLOCKS:
                        break
            node = Node(name, _attributes(m[6]))
            stack[-1].children.append(node)
            if name not in VOID:
                stack.append(node)
    text(len(page))
    return root


def _attributes(text: str) -> dict[str, str]:
    return {k.lower(): unescape((v or "").strip("\"'")) for k, v in _ATTR.findall(text or "")}


def _drop_noise(nodes: list[Node]) -> None:
    """Take furniture out of all nodes, in place and without recursion, as pages may be nested very deep."""
    tags, classes = {s for s in NOISE if s[0] != "."}, {s[1:] for s in NOISE if s[0] == "."}
    for node in nodes:
        node.children = [c for c in node.children if c.tag not in tags and classes.isdisjoint(c.attrs.get("class", "").split())]


def _lengths(root: Node) -> dict[Node, int]:
    """How much text each node holds, counted once from the leaves up."""
    order = list(root.walk())
    found: dict[Node, int] = dict.fromkeys(order, 0)
    for node in reversed(order):
        found[node] = len(" ".join(node.text.split())) if not node.tag else sum(found[c] for c in node.children)
    return found


def _value(node: Node) -> str:
    return sanitize(node.attrs.get("content") or node.attrs.get("src") or node.attrs.get("datetime") or node.content())


def _properties(scope: Node) -> list[tuple[str, Node, bool]]:
    """(name, node, whether a nested item) of the properties of an item; what lies in a nested item belongs to that one."""
    found, todo = [], list(reversed(scope.children))
    while todo:
        node = todo.pop()
        names = node.attrs.get("itemprop", "").split()
        inner = "itemscope" in node.attrs
        found += [(name, node, inner) for name in names]
        if not inner:
            todo.extend(reversed(node.children))
    return found


# Properties of a recipe that are texts, those of its nutrition, and where an item's address stands.
MICRODATA = ("name", "description", "recipeYield", "prepTime", "cookTime", "totalTime")
NUTRITION = ("calories", "fatContent", "carbohydrateContent", "proteinContent")
ADDRESSES = ("url", "contentUrl")
_LABELS = ("zutaten", "ingredients")
_HEADINGS = ("h2", "h3", "h4", "h5")


def microdata_item(scope: Node) -> dict:
    """The fields of a recipe item, those of nested items (image, author, nutrition) included."""
    of: dict[str, list[str]] = {}
    images, authors, nutrition = [], [], {}
    for name, node, inner in _properties(scope):
        if name == "image":
            nested = [_value(n) for k, n, _ in _properties(node) if k in ADDRESSES]
            images += [v for v in nested or [_value(node)] if v]
        elif inner and name == "author":
            authors += [v for v in (_value(n) for k, n, _ in _properties(node) if k == "name") if v] or [v for v in (_value(node),) if v]
        elif inner and name == "nutrition":
            nutrition |= {k: v for k, n, _ in _properties(node) if k in NUTRITION and (v := _value(n))}
        elif v := _value(node):
            of.setdefault(name, []).append(v)
    nutrition |= {k: of[k][0] for k in NUTRITION if k in of and k not in nutrition}
    return {k: of.get(k, [None])[0] for k in MICRODATA} | {"image": images[0] if images else None, "images": images, "authors": authors or of.get("author", []), "nutrition": nutrition, "ingredients": of.get("recipeIngredient") or of.get("ingredients", []), "instructions": of.get("recipeInstructions", [])}


def _opens_group(node: Node, text: str) -> bool:
    """Whether an ingredient node is the heading of a group: by its tag, in capitals, or with a colon at its end."""
    return node.tag in _HEADINGS or text.endswith(":") or (3 <= len(text) <= 31 and text.upper() == text and all(c.isalpha() or c in " -" for c in text))


def grouped_ingredients(marked: list[Node]) -> tuple[list[str], list[dict]]:
    """Ingredients before any heading, and the groups that headings open, each with the lines that follow it; labels of the whole list are left out."""
    loose: list[str] = []
    groups: dict[str, list[str]] = {}
    name = None
    for node in marked:
        text = sanitize(node.content())
        if not text or text.lower().rstrip(":") in _LABELS:
            continue
        if _opens_group(node, text):
            name = text.rstrip(":")
            groups.setdefault(name, [])
        else:
            (loose if name is None else groups[name]).append(text)
    return loose, [{"name": n, "items": items} for n, items in groups.items() if items]


def _is_recipe(node: dict) -> bool:
    kinds = node.get("@type")
    return any("recipe" in str(k).lower() for k in (kinds if isinstance(kinds, list) else [kinds])) or "recipeIngredient" in node or "recipeInstructions" in node


def _clean(value: object, key: str = "") -> object:
    """JSON with every text sanitised, those of ingredients and steps line by line; addresses only lose entities."""
    if isinstance(value, dict):
        return {k: _clean(v, k) for k, v in value.items()}
    if isinstance(value, list):
        return [_clean(v, key) for v in value]
    if not isinstance(value, str):
        return value
    if key in ("url", "@id", "contentUrl", "thumbnailUrl", "image", "sameAs"):
        return unescape(value).strip()
    if key in ("recipeIngredient", "recipeInstructions", "text"):
        return "\n".join(sanitize(line) for line in re.split(r"\r?\n", unescape(value))).strip()
    return sanitize(value)


def _json(text: str) -> object:
    """JSON as it is, else without comments, else with line breaks in it as blanks; None if none parses."""
    text = re.sub(r"<!--|-->", "", text).strip()
    bare = re.sub(r"(?m)(?<!:)//.*$", "", re.sub(r"(?s)/\*.*?\*/", "", text))
    for form in (text, bare, re.sub(r"[\r\n]+", " ", bare)):
        try:
            return json.loads(form)
        except (ValueError, RecursionError):
            continue
    return None


def recipe_nodes(root: Node) -> list[str]:
    """The recipe nodes of a page's JSON-LD as cleaned JSON, level by level, however deep they are nested."""
    out = []
    for script in (n for n in root.walk() if n.tag == "script" and n.attrs.get("type", "").strip().lower() == "application/ld+json"):
        level = [_json("".join(c.text for c in script.children))]
        while level:
            inner = []
            for node in level:
                if isinstance(node, list):
                    inner += node
                elif isinstance(node, dict):
                    if _is_recipe(node):
                        out.append(json.dumps(_clean(node), ensure_ascii=False))
                    inner += [node[k] for k in NESTED if isinstance(node.get(k), dict | list)]
            level = inner
    return out


#: What a page record may have, and of which kind; each is made only where it is asked for.
_TEXT, _TEXTS = pa.string(), pa.list_(pa.string())
_KINDS = {
    **dict.fromkeys(("title", "description", "og_image", "servings", "canonical"), _TEXT), **dict.fromkeys(("list_items", "paragraphs", "ingredients", "instructions", "recipes"), _TEXTS),
    "groups": pa.list_(pa.struct([("name", _TEXT), ("items", _TEXTS)])),
    "microdata": pa.struct([*[(k, _TEXT) for k in (*MICRODATA, "image")], *[(k, _TEXTS) for k in ("images", "authors", "ingredients", "instructions")], ("nutrition", pa.map_(_TEXT, _TEXT))]),
}


def page_record(page: str | None, li_override: bool = True, wanted: tuple[str, ...] = tuple(_KINDS)) -> dict:
    """The wanted fields of a page: of its markup, of its best microdata recipe, and its JSON-LD recipes.

    With ``li_override`` the list items of a scope that has a list stand for its ingredients, and there are no groups then.
    """
    root = tree(page or "")
    every = list(root.walk())
    first = lambda values: next((v for v in values if v), None)
    meta = lambda key: first(n.attrs.get("content") for n in every if n.tag == "meta" and key in (n.attrs.get("property"), n.attrs.get("name")))
    out: dict[str, object] = {}
    if "recipes" in wanted:
        out["recipes"] = recipe_nodes(root)
    if "og_image" in wanted:
        out["og_image"] = meta("og:image")
    if "canonical" in wanted:
        out["canonical"] = first(n.attrs.get("href") for n in every if n.tag == "link" and "canonical" in n.attrs.get("rel", "").split()) or meta("og:url")
    if "microdata" in wanted:
        best: dict[str, object] = {}
        for scope in (n for n in every if "itemscope" in n.attrs and n.attrs.get("itemtype", "").rstrip("/").endswith("schema.org/Recipe")):
            one = microdata_item(scope)
            if sum(bool(v) for v in one.values()) > sum(bool(v) for v in best.values()):
                best = one
        out["microdata"] = {k: best.get(k) for k in (*MICRODATA, "image")} | {k: best.get(k) or [] for k in ("images", "authors", "ingredients", "instructions")} | {"nutrition": list((best.get("nutrition") or {}).items())}
    if not {"title", "description", "servings", "list_items", "paragraphs", "ingredients", "instructions", "groups"} & set(wanted):
        return out
    _drop_noise(every)
    held = _lengths(root)
    scopes = [n for n in held if n.tag and any(n.matches(s) for s in SCOPES)] or [n for n in held if n.tag == "body"] or [root]
    nodes = list(max(scopes, key=held.__getitem__).walk())
    text_of = lambda *tags: (t for t in (sanitize(n.content()) for n in nodes if n.tag in tags) if t)
    if "title" in wanted:
        out["title"] = first(text_of("h1")) or first(text_of("h2"))
    if "description" in wanted:
        out["description"] = first(text_of("p"))
    if "paragraphs" in wanted:
        out["paragraphs"] = list(text_of("p"))
    if "list_items" in wanted:
        out["list_items"] = list(text_of("li"))
    if "servings" in wanted:
        said = lambda n: "servings" in n.attrs.get("class", "") or re.search(r"(?i)serv(?:es|ings)", "".join(c.text for c in n.children if not c.tag))
        out["servings"] = first(m[0] for n in nodes if n.tag and said(n) and (m := re.search(r"\d+", n.content())))
    if {"ingredients", "groups"} & set(wanted):
        names = lambda n: "ingredient" in n.attrs.get("class", "").lower() or "recipeingredient" in n.attrs.get("itemprop", "").lower()
        inside: dict[Node, bool] = {}
        for n in reversed(nodes):
            inside[n] = any(inside[c] or (c.tag and names(c)) for c in n.children)
        # The innermost ones: what holds others is their container.
        loose, groups = grouped_ingredients([n for n in nodes if n.tag and names(n) and not inside[n]])
        listed = any(n.tag in ("ul", "ol") for n in nodes)
        if (li_override and listed) or not (loose or groups):
            loose, groups = [t for t in text_of("li") if t.lower().rstrip(":") not in _LABELS], []
        out["ingredients"], out["groups"] = [*loose, *(i for g in groups for i in g["items"])], groups
    if "instructions" in wanted:
        ordered = next((n for n in nodes if n.tag == "ol"), None)
        out["instructions"] = [sanitize(n.content()) for n in ordered.walk() if n.tag == "li"] if ordered else [t for t in text_of("p") if re.match(r"(?i)(?:schritt|step|\d+\.)", t)]
    return out


def markup(page: Column, *wanted: str, li_override: bool = True) -> Column:
    """The struct of ``page_record`` of a page column, with the wanted fields only (all without any)."""
    fields = wanted or tuple(_KINDS)
    record = pa.struct([(k, _KINDS[k]) for k in fields])

    @F.arrow_udf(from_arrow_type(record))
    def run(column: pa.Array) -> pa.Array:
        rows = (page_record(p, li_override, fields) for p in column.to_pylist())
        return pa.array([{k: r[k] for k in fields} for r in rows], record)

    return run(page)


# Properties of a node under which other nodes stand.
NESTED = ("@graph", "mainEntity", "mainEntityOfPage", "itemListElement", "item", "hasPart", "subjectOf", "about")


def json_ld_blocks(page: Column) -> Column:
    """The texts of a page's JSON-LD scripts, without comments around them."""
    found = F.regexp_extract_all(page, F.lit(r"""(?is)<script[^>]*type\s*=\s*["']application/ld\+json["'][^>]*>(.*?)</script>"""), F.lit(1))
    return F.transform(found, lambda b: F.trim(F.regexp_replace(b, r"(?s)<!--|-->", "")))


def tolerant_json(text: Column) -> Column:
    """A variant of JSON text: as it is, else without comments, else with line breaks inside it as blanks; null if none parses."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?s)/\*.*?\*/", ""), r"(?m)(?<!:)//.*$", "")
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(bare), F.try_parse_json(F.regexp_replace(bare, r"[\r\n]+", " ")))


def _inner(node: Column) -> Column:
    """The nodes right inside of a variant: the items of a list, and what stands under its nesting properties."""
    none = F.array().cast("array<variant>")
    listed = lambda v: F.try_variant_get(v, "$", "array<variant>")
    # One read of the whole object; most nodes have none of the properties.
    under = let(F.try_variant_get(node, "$", "map<string,variant>"), lambda m: F.filter(F.array(*[F.try_element_at(m, F.lit(k)) for k in NESTED]), lambda v: v.isNotNull()))
    return F.coalesce(listed(node), F.flatten(F.transform(under, lambda v: F.coalesce(listed(v), F.array(v)))), none)


def nested_nodes(root: Column, depth: int = 5) -> Column:
    """A variant and all nodes in it down to a depth, level by level."""
    def level(found: Column, left: int) -> Column:
        if not left:
            return found
        return let(F.flatten(F.transform(found, _inner)), lambda inner: F.concat(found, F.when(F.size(inner) > 0, level(inner, left - 1)).otherwise(inner)))

    return let(F.array(root), lambda found: level(found, depth))


def json_ld_recipes(pages: DataFrame, key: str = "page_id", page: str = "html") -> DataFrame:
    """(key, pos, node): the recipe nodes of each page's JSON-LD, wherever they are nested."""
    blocks = pages.select(key, F.posexplode(json_ld_blocks(F.col(page))).alias("block", "text")).select(key, "block", tolerant_json(F.col("text")).alias("v"))
    each = blocks.where("v is not null").select(key, "block", F.posexplode(nested_nodes(F.col("v"))).alias("i", "node"))
    kind = F.lower(F.coalesce(F.try_variant_get("node", "$['@type']", "string"), F.lit("")))
    listed = F.try_variant_get("node", "$.recipeIngredient", "variant").isNotNull() | F.try_variant_get("node", "$.recipeInstructions", "variant").isNotNull()
    return each.where(kind.contains("recipe") | listed).select(key, (F.col("block") * 10_000 + F.col("i")).alias("pos"), "node")


def canonical_url(page: Column, url: Column) -> Column:
    """Link canonical, else og:url, else the page's own address; relative ones made absolute."""
    link = F.regexp_extract(page, r"""(?is)<link[^>]*rel\s*=\s*["']canonical["'][^>]*href\s*=\s*["']([^"']+)["']""", 1)
    og = F.regexp_extract(page, r"""(?is)<meta[^>]*property\s*=\s*["']og:url["'][^>]*content\s*=\s*["']([^"']+)["']""", 1)
    return absolute_url(F.coalesce(F.nullif(link, F.lit("")), F.nullif(og, F.lit("")), url), url)


def line_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, idx, line): the non-empty trimmed lines of text files, in order."""
    whole = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.txt").select(F.col("_metadata.file_name").alias("file"), F.filter(F.transform(F.split("value", r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "").alias("lines"))
    return whole.select("file", F.posexplode("lines").alias("idx", "line"))


def fixture_pages(spark: SparkSession, path: str) -> DataFrame:
    """(file, place, html) of html, JSON-LD and text files in any character set; JSON-LD is put into a page, lines of text into a list. ``place`` sorts files as people do."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.lower("path").rlike(r"\.(html?|jsonld|txt)$"))
    files = files.select("path", decode(F.col("content")).alias("text"))
    text = F.col("text")
    lines = F.transform(F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(x)), lambda x: x != ""), lambda x: F.concat(F.lit("<li>"), F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</li>")))
    listed = F.concat(F.lit("<html><body><ul>"), F.array_join(lines, ""), F.lit("</ul></body></html>"))
    page = F.when(F.lower("path").endswith(".txt"), listed).when(F.lower("path").endswith(".jsonld"), F.concat(F.lit('<html><head><script type="application/ld+json">'), text, F.lit("</script></head><body></body></html>"))).otherwise(text)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), natural_key(F.col("path")).alias("place"), page.alias("html"))


def labelled_cases(spark: SparkSession, path: str) -> DataFrame:
    """(file, idx, line, low, high, unit, item, note, asserts) of files with a list of cases or {cases: list}; ``asserts`` names the keys that a case has, null ones included."""
    whole = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.expected.json").select(F.col("_metadata.file_name").alias("file"), F.try_parse_json("value").alias("v"))
    cases = F.coalesce(F.try_variant_get("v", "$.cases", "array<variant>"), F.try_variant_get("v", "$", "array<variant>"))
    each = whole.select("file", F.posexplode(cases).alias("idx", "c"))
    get = lambda k, t: F.try_variant_get("c", f"$.{k}", t)
    return each.select("file", "idx", get("line", "string").alias("line"), F.coalesce(get("qty", "double"), get("min_qty", "double")).alias("low"), get("max_qty", "double").alias("high"), get("unit", "string").alias("unit"), get("item", "string").alias("item"), get("note", "string").alias("note"), F.map_keys(F.try_variant_get("c", "$", "map<string,variant>")).alias("asserts"))
