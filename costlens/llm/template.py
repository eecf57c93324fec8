"""Main text of web pages by deducing each host's page template.

Equivalence-class deduction (Arasu and Garcia-Molina, "Extracting structured
data from web pages", 2003) over the pages of one host:

* a token is a tag or a text node, told apart by its role: the path of open
  structural tags with the words of class and id that stand on ``SUPPORT`` of
  the host's pages, and for containers their place among equal siblings.  Its
  occurrence vector is the number of times it occurs on each page of the host;
  copies of one page count once;
* tokens with equal vectors form a class.  A class is frequent if it occurs on
  ``SUPPORT`` of the host's pages and on ``LEAST_PAGES`` of them (on fewer
  pages equal vectors are chance), and valid if it has a tag and its tags nest,
  that is the parent path of each tag belongs to a valid class too.  A text that
  repeats with no element of its vector is data.  The valid classes, nested by
  path, are the template;
* the text between an element's template tokens is its slot.  A slot is
  constant if all its text is of valid classes; one repeated line among varying
  ones is a value of its slot, so it stays.  Else its data decides: a slot is
  prose if less than half of the data is link text, and it is a heading's or
  holds ``SHARE`` of such data of the host;
* the article lies in the smallest container of all prose slots, whatever else
  varies outside.  Where elements are named as the article (``article``, else
  ``main``, else by class or id) they are taken instead, the outermost where
  they nest, each where they do not.  Constant slots are cut inside either, slots
  of links only inside the first.  Menus, headers, footers, sidebars, notices,
  adverts, forms, scripts, styles and reader comments are cut by element or by
  name too; everything else is kept.

A page with an ``article`` or ``main`` of its own is read by it.  A page whose
host has no frequent class (a single page, say), that lacks the host's element
or would be left without text is read by the same rules with its own elements.

Vectors are compared by an order-free hash sum that each task pre-aggregates,
so a host with a third of all pages sends one row per token and task.

Defined cases: a null or empty html gives an empty text; a null or odd url
belongs to the host ``''``; unclosed and stray tags are tolerated (a block
ends an open paragraph, a closing tag ends what it encloses); null and
repeated ids keep their rows; pages of any length are read whole; columns other
than those named are not read, so their names cannot clash; an empty table gives
an empty result.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import importable, written

#: Share of a host's pages, and number of them, on which a template token stands.
SUPPORT, LEAST_PAGES = 0.5, 4
#: Share of a host's data text from which a slot is prose.
SHARE = 0.05

# HTML element kinds and the names that mark page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span "
                   "strike strong sub sup time tt u var wbr img".split())
DROPPED = frozenset("aside button canvas dialog fieldset footer form head iframe menu nav noscript object script select style svg "
                    "template textarea title".split())
RAW = frozenset("script style textarea title".split())
FURNITURE = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie "
                      "cookies disqus dropdown footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices "
                      "pager pagination popup promo promoted recommended related respond share sharing sidebar skip social sponsor "
                      "sponsored subscribe toolbar widget".split())
CONTENT = frozenset("article articlebody body content entry main post story text".split())
ROLES = frozenset("banner navigation complementary contentinfo search form dialog alert menu menubar toolbar".split())
ENDS_PARAGRAPH = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr "
                           "main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
            "th": {"td", "th"}, "option": {"option"}}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("div section table td".split())  # told apart by their place among equal siblings
BLOCKS = HEADINGS | frozenset("blockquote dd dl dt figcaption figure li ol p pre ul".split())  # parts of an article, never the whole
SCOPES = frozenset("ul ol dl table select".split())

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
SPACE = re.compile(r"\s+")


@lru_cache(maxsize=4096)
def _named(tag: str, attributes: str) -> tuple[str, list[str], frozenset[str], str]:
    """Element name, the names in its class and id, their words, and its role."""
    found = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attributes)} if attributes else {}
    names = f"{found.get('class', '')} {found.get('id', '')}".lower()
    words = frozenset(w for w in re.split(r"[^a-z]+", names) if w)
    hidden = "hidden" in attributes.lower().split() or found.get("aria-hidden") == "true"
    return tag, sorted(set(names.split())), words, "hidden" if hidden else found.get("role", "").lower()


def names(html: str) -> set[str]:
    """The names in the classes and ids of a page."""
    return {w for m in TAG.finditer(html) if m[3] for w in _named(m[2].lower(), m[3])[1]}


def nodes(html: str, kept: frozenset[str] | None = None) -> Iterator[tuple[str, int, str, object]]:
    """Walk a page: ``("open" | "close", depth, path, (tag, words, role))``, ``("text", depth, path, text)``, ``("break", ..)``,
    ``("link", depth, path, whether one opens)``.

    Paths name structural elements only, with those of their classes and ids that are ``kept`` (None: all)
    and the place of a container among equal siblings; inline elements do not deepen them.
    """
    stack: list[tuple[str, str, dict]] = []  # tag, path, children by label
    top: dict[str, int] = {}

    def path() -> str:
        return stack[-1][1] if stack else ""

    def pop_to(i: int):
        while len(stack) > i:
            tag, where, _ = stack.pop()
            yield "close", len(stack), where, tag

    at, n = 0, len(html)
    while at < n:
        m = TAG.search(html, at)
        if m is None or m.start() > at:
            yield "text", len(stack), path(), html[at:m.start() if m else n]
        if m is None:
            break
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                yield "text", len(stack), path(), entities.escape(m[0][9:].removesuffix("]]>"))
            continue
        tag = m[2].lower()
        if tag == "a":
            yield "link", len(stack), path(), not m[1]
        if m[1]:
            if tag in INLINE:
                continue
            i = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if i is not None:
                yield from pop_to(i)
            elif tag == "p":
                yield "break", len(stack), path(), None
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                yield "break", len(stack), path(), None
            continue
        if tag in INLINE:
            continue
        if tag in ENDS_PARAGRAPH and stack and stack[-1][0] == "p":
            yield from pop_to(len(stack) - 1)
        if tag in SIBLINGS:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in SCOPES:
                    break
                if stack[i][0] in SIBLINGS[tag]:
                    yield from pop_to(i)
                    break
        named = _named(tag, m[3])
        label = tag + "".join(f".{w}" for w in named[1] if kept is None or w in kept)
        if tag in CONTAINERS:
            siblings = stack[-1][2] if stack else top
            siblings[label] = place = siblings.get(label, 0) + 1
            label += f"[{place}]" if place > 1 else ""
        where = f"{path()}/{label}"
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
            at = end.end() if end else n
            continue
        if m[3].rstrip().endswith("/") and tag in ("path", "use", "g"):
            continue
        stack.append((tag, where, {}))
        yield "open", len(stack), where, (tag, named[2], named[3])
    yield from pop_to(0)


def _rank(tag: str, words: frozenset[str], role: str) -> int:
    """How clearly an element is named as the article: 3 ``article``, 2 ``main``, 1 by class or id."""
    if tag == "article":
        return 3
    if tag == "main" or role == "main":
        return 2
    return 1 if words & CONTENT and not words & FURNITURE and tag != "body" else 0


def _furniture(tag: str, words: frozenset[str], role: str, inside: bool) -> bool:
    """Whether an element is cut; a ``header`` inside the article belongs to it."""
    if tag in DROPPED or role in ROLES or role == "hidden" or (tag == "header" and not inside):
        return True
    return bool(words & FURNITURE) and not words & CONTENT


def _clean(text: str) -> str:
    return SPACE.sub(" ", entities.unescape(text)).strip()


def _token(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\0".join(parts).encode("utf-8", "surrogatepass"), 7) - (1 << 63)


def _shown(html: str, kept: frozenset[str] | None = None) -> Iterator[tuple[str, int, str, object, bool, int]]:
    """``nodes`` with whether furniture is open and the rank of an opened element (0 in furniture)."""
    cut = None  # depth of the furniture that is open
    ranks: list[int] = []
    for kind, depth, path, value in nodes(html, kept):
        rank = 0
        if kind == "open":
            if cut is None and _furniture(*value, any(r >= 2 for r in ranks)):
                cut = depth
            rank = _rank(*value) if cut is None else 0
            ranks.append(rank)
        elif kind == "close":
            ranks.pop()
            if cut is not None and depth < cut:
                cut = None
        yield kind, depth, path, value, cut is not None, rank


def page_tokens(html: str, kept: frozenset[str] | None = None) -> dict[int, list]:
    """Tokens of one page: id -> [path of a tag or None, parent path, count, rank, characters of text inside, of these in links].

    The page itself is the tag of path ``""``; text in furniture has no characters.
    """
    root = ["", "", 1, 0, 0, 0]
    link = None  # depth of the open link; it ends with the element around it
    found: dict[int, list] = {_token("tag", ""): root}
    spans: list[list] = [root]
    for kind, depth, path, value, cut, rank in _shown(html, kept):
        if kind == "link":
            link = depth if value else None
        elif kind == "open":
            entry = found.setdefault(_token("tag", path), [path, path.rpartition("/")[0], 0, 0, 0, 0])
            entry[2] += 1
            entry[3] = 0 if cut else max(entry[3], rank)
            spans.append(entry)
        elif kind == "close":
            spans.pop()
            link = None if link is not None and depth < link else link
        elif kind == "text" and (text := _clean(value)):
            entry = found.setdefault(_token("text", path, text), [None, path, 0, 0, 0, 0])
            entry[2] += 1
            if not cut:
                for s in (entry, *{id(s): s for s in spans}.values()):
                    s[4] += len(text)
                    s[5] += len(text) if link is not None else 0
    return found


def _emit_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [(h, key, w) for h, key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) for w in names(text)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.int64()),
             pa.array([f[2] for f in found], pa.string())], ["host", "page", "name"])


def _emit_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        host, page, token, path, parent, count, rank, chars, links = ([] for _ in range(9))
        for h, key, text, kept in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for t, (p, up, n, r, c, a) in page_tokens(text, frozenset(kept or ())).items():
                for out, value in zip((host, page, token, path, parent, count, rank, chars, links), (h, key, t, p, up, n, r, c, a), strict=True):
                    out.append(value)
        yield pa.RecordBatch.from_arrays(
            [pa.array(host, pa.string()), pa.array(page, pa.int64()), pa.array(token, pa.int64()), pa.array(path, pa.string()),
             pa.array(parent, pa.string()), pa.array(count, pa.int32()), pa.array(rank, pa.int32()), pa.array(chars, pa.int64()),
             pa.array(links, pa.int64())], ["host", "page", "token", "path", "parent", "count", "rank", "chars", "links"])


def _host():
    return F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))


def _contents(pages: DataFrame) -> DataFrame:
    """``(host, page, html)``; copies of one page share ``page``."""
    html = F.coalesce("html", F.lit(""))
    return pages.select(_host().alias("host"), F.xxhash64(html).alias("page"), html.alias("html"))


def frequent_names(pages: DataFrame) -> DataFrame:
    """``(host, pages, kept)``: different pages of every host, and the class and id names on ``SUPPORT`` of them (a written table)."""
    importable(pages.sparkSession)
    rows = _contents(pages)
    sizes = rows.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    found = rows.mapInArrow(_emit_names, "host string, page bigint, name string").distinct().groupBy("host", "name")
    kept = (found.agg(F.count("*").alias("support")).join(sizes, "host").where(F.col("support") >= F.greatest(F.lit(2), F.col("pages") * SUPPORT))
            .groupBy("host").agg(F.collect_set("name").alias("kept")))
    return written(sizes.join(kept, "host", "left"), "names")


def frequent_tokens(pages: DataFrame, hosts: DataFrame | None = None) -> DataFrame:
    """Tokens of the frequent classes with a tag of every host (a written table); ``hosts`` are its ``frequent_names``.

    ``(host, token, path, parent, class, support, rank, chars, links)``; ``path`` is null for a text node.
    """
    importable(pages.sparkSession)
    hosts = frequent_names(pages) if hosts is None else hosts
    # A host with fewer different pages has no template.
    hosts = hosts.where(F.col("pages") >= LEAST_PAGES)
    rows = _contents(pages).join(hosts, "host").select("host", "page", "html", "kept")
    sizes = hosts.select("host", "pages")
    # Stands for the vector: a sum over pages of a hash of (page, count).
    vector = F.sum(F.pmod(F.xxhash64("page", "count"), F.lit(1 << 40)).cast("decimal(20,0)"))
    tokens = (rows.mapInArrow(_emit_tokens, "host string, page bigint, token bigint, path string, parent string, "
                              "count int, rank int, chars bigint, links bigint")
              .groupBy("host", "token", "page").agg(*[F.first(c).alias(c) for c in ("path", "parent", "count", "rank", "chars", "links")])
              .groupBy("host", "token").agg(
                  vector.alias("vector"), F.count("*").alias("support"), F.first("path").alias("path"), F.first("parent").alias("parent"),
                  F.min("rank").alias("rank"), F.sum("chars").alias("chars"), F.sum("links").alias("links")))
    tokens = tokens.join(sizes, "host").where(F.col("support") >= F.greatest(F.lit(LEAST_PAGES), F.col("pages") * SUPPORT))
    tokens = written(tokens.withColumn("class", F.xxhash64("vector", "support")).drop("vector", "pages"), "tokens")
    tagged = tokens.where("path is not null").select("host", "class").distinct()
    return written(tokens.join(tagged, ["host", "class"], "left_semi"), "template-tokens")


def _elements(frequent: DataFrame) -> DataFrame:
    """``template`` and the page itself, of path ``""``, with the characters of each element's own slot."""
    tags = frequent.where("path is not null")
    texts = frequent.where("path is null")
    parents = tags.select("host", F.col("path").alias("parent"), F.lit(True).alias("known"))
    nested = tags.join(parents, ["host", "parent"], "left").where(F.col("known") | (F.col("parent") == ""))
    inner = (nested.where("path != ''").groupBy("host", F.col("parent").alias("path"))
             .agg(F.sum("chars").alias("inner"), F.sum("links").alias("inner_links")))
    fixed = texts.groupBy("host", F.col("parent").alias("path")).agg(F.sum("chars").alias("fixed"), F.sum("links").alias("fixed_links"))

    def less(whole: str, *parts: str):
        return F.col(whole) - sum((F.coalesce(F.col(p), F.lit(0)) for p in parts), F.lit(0))

    return nested.join(inner, ["host", "path"], "left").join(fixed, ["host", "path"], "left").select(
        "host", "path", "parent", "class", "rank", F.coalesce("fixed", F.lit(0)).alias("fixed_chars"),
        less("chars", "inner", "fixed").alias("data_chars"), less("links", "inner_links", "fixed_links").alias("link_chars"))


def template(frequent: DataFrame) -> DataFrame:
    """``(host, path, parent, class, rank, fixed_chars, data_chars, link_chars)``: the nested template elements of every host.

    An element is nested if its parent is a template element too; the root has none.  Of the text in an
    element's slot (itself and parts that are no template, over all pages) ``fixed_chars`` is of valid
    classes, ``data_chars`` is not, and ``link_chars`` of the latter is in links.
    """
    return _elements(frequent).where("path != ''")


def _above(path: str):
    """The paths of an element and of all around it, the page first."""
    steps = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.concat_ws("/", F.slice(steps, F.lit(1), i)))


def slots(frequent: DataFrame) -> DataFrame:
    """``(host, slot, cut)``: the paths of each host's article elements, and of the slots to cut in them.

    A host without template has no row; without named elements or data text its ``slot`` is null.
    """
    elements = _elements(frequent)
    tag = F.regexp_extract("path", r"/([^/.\[]*)[^/]*$", 1)
    linked = 2 * F.col("link_chars") >= F.col("data_chars")
    sizes = elements.groupBy("host").agg(F.max("rank").alias("top"), F.sum(F.when(~linked, F.col("data_chars"))).alias("data"))
    elements = written(elements.join(sizes, "host").withColumn("tag", tag).withColumn(
        "prose", (F.col("data_chars") > 0) & ~linked & (F.col("tag").isin(*HEADINGS) | (F.col("data_chars") >= SHARE * F.col("data")))), "template")
    named = elements.where("rank = top and top > 0").groupBy("host").agg(F.collect_set("path").alias("named"))
    # The container of all prose: each prose slot counts for every element around it.
    held = (elements.where("prose").select("host", F.explode(_above("path")).alias("path"))
            .groupBy("host", "path").agg(F.count("*").alias("held")))
    whole = held.where("path = ''").select("host", F.col("held").alias("all"))
    depth = F.length(F.regexp_replace("path", "[^/]", ""))
    around = (held.join(whole, "host").where(F.col("held") == F.col("all")).where(~tag.isin(*BLOCKS))
              .groupBy("host").agg(F.max(F.struct(depth, "path"))["path"].alias("around")))
    # Bounded by the elements of one page template.
    constant = (F.col("data_chars") == 0) & (F.col("fixed_chars") > 0)
    menu = (F.col("top") == 0) & linked & (F.col("data_chars") > 0)
    cut = elements.groupBy("host").agg(F.collect_set(F.when(constant | menu, F.col("path"))).alias("cut"))
    return (cut.join(named, "host", "left").join(around, "host", "left")
            .select("host", F.coalesce("named", F.when(F.col("around").isNotNull(), F.array("around"))).alias("slot"), "cut"))


def _own_slot(html: str) -> tuple[str, int]:
    """Rank of a page's best named elements, or without one the smallest common ancestor of its text."""
    tags = [e for e in page_tokens(html).values() if e[0] is not None]
    rank, most = max(t[3] for t in tags), max(t[4] for t in tags)
    return max((t[0] for t in tags if t[4] == most > 0), key=lambda p: p.count("/"), default=""), rank


def extract(html: str, slot: frozenset[str] = frozenset(), rank: int = 0, without: frozenset[str] = frozenset(),
            kept: frozenset[str] | None = None) -> str | None:
    """Text of the elements of a path in ``slot`` or of rank ``rank`` but for the slots ``without``, a line per block.

    None where the page has no such element.
    """
    blocks: list[str] = []
    parts: list[str] = []
    seen = "" in slot  # the page as a whole
    inside = 0 if seen else None

    def flush() -> None:
        text = _clean("".join(parts))
        parts.clear()
        if text:
            blocks.append(text)

    for kind, depth, path, value, cut, named in _shown(html, kept):
        if kind == "open":
            if inside is None and not cut and (path in slot or rank and named == rank):
                inside, seen = depth, True
            flush()
        elif kind == "close":
            flush()
            if inside is not None and depth < inside:
                inside = None
        elif kind == "break":
            flush()
        elif kind == "text" and inside is not None and not cut and path not in without:
            parts.append(value)
    flush()
    return "\n".join(blocks) if seen else None


def main_text(html: str | None, slot: frozenset[str], without: frozenset[str] = frozenset(), kept: frozenset[str] | None = None) -> str:
    if not html:
        return ""
    lower = html.lower()
    text = extract(html, rank=3, without=without, kept=kept) if "<article" in lower else None
    if not text and ("<main" in lower or "role" in lower):
        text = extract(html, rank=2, without=without, kept=kept)
    if not text and slot and "" not in slot:
        text = extract(html, slot, without=without, kept=kept)
    if not text:
        path, rank = _own_slot(html)
        if rank:
            text = extract(html, rank=rank)
        elif "" in slot:
            text = extract(html, slot, without=without, kept=kept)
        text = text or extract(html, frozenset([path]))
    return text or ""


def _extracting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h, frozenset(s or ()), frozenset(f or ()), frozenset(k or ())) for h, s, f, k in
                 zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            ["page_id", "url", "text", "n_chars"])


def extracted(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every page row."""
    importable(pages.sparkSession)
    hosts = frequent_names(pages)
    found = written(hosts.join(slots(frequent_tokens(pages, hosts)), "host", "left"), "slots")
    rows = pages.select("page_id", "url", "html", _host().alias("host"))
    rows = rows.join(found, "host", "left").select("page_id", "url", "html", "slot", "cut", "kept")
    kind = pages.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(_extracting, f"page_id {kind}, url string, text string, n_chars bigint")
