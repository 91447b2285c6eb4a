"""Main text of web pages by deduction of each host's template from equivalence classes of tokens.

A token is a tag with its path of open elements, or a run of text at such a path. Tokens that occur equally often on every page
of a host (the same occurrence vector) form a class; a class that is on most pages of the host and whose tokens nest is
part of the template. The template's elements have slots; the way into the slots that hold the words that vary ends at the
host's main container (see main_container). Names that mark menus, adverts and the like decide inside the container, and
where a host has too few pages for a template. A page's text
is what its main container holds, less such elements inside it and less the template's own text: what stands there once on
every page of the host that is not empty, if nothing else of its block varies. Members of a class are known by their whole paths, so those that occur once a
page nest as their paths do, and the order of siblings decides nothing. A page without the container falls back to its own
article, main or all its text outside such elements.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, slices

#: A class belongs to the template if it is on this share of the host's pages; fewer pages than LEAST deduce nothing.
SUPPORT, LEAST = 0.5, 3
#: A slot with this share of the words that vary on a host holds some of the main text.
SLOT = 0.05
#: Templates may be broadcast up to this size, and join by host beyond it.
BROADCAST_BYTES = 8 << 20

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}, "body": {"head"}}
SCOPE = frozenset("html body table td th ul ol dl article section div main aside nav header footer form".split())

# What is not main text, by element and by words in class, id and role.
CHROME = frozenset("nav header footer aside form script style noscript template iframe svg canvas button select input textarea dialog menu title head object embed audio video map".split())
CHROME_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert|adverts|advertisement|advertising|banner|breadcrumb|breadcrumbs|comment|comments|cookie|cookies|consent|disqus|footer|foot|header|masthead|menu|menubar|nav|navbar|navigation|newsletter|notice|notices|pagination|pager|popup|modal|promo|promotion|related|recommended|reply|replies|respond|share|sharing|sidebar|side|skip|social|sponsor|sponsored|subscribe|subscription|toolbar|widget)(?:$|[\s_-])",
    re.I,
)
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert dialog".split())

#: Characters of a path, beyond which deeper elements share their ancestor's: unclosed tags would add up to the square of the page.
MOST_PATH = 4096
_WRAPS = re.compile(r"<(?:article|main|h1)(?=[\s/>])", re.I)
_FORM_ENDS = re.compile(r"</form(?=[\s/>])", re.I)
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


@dataclass
class Element:
    name: str
    label: str  # name and classes, as a step of a path
    chrome: bool
    path: str
    parent: Element | None
    told: bool = False  # within an article or main


def _wraps(page: str, at: int) -> bool:
    """Whether the form that opens here holds the page rather than fields: an article, main or h1, or most of the page."""
    end = _FORM_ENDS.search(page, at)
    stop = end.start() if end else len(page)
    return 2 * (stop - at) > len(page) or _WRAPS.search(page, at, stop) is not None


def _element(name: str, attrs: str, parent: Element | None, page: str, at: int) -> Element:
    label, chrome = name, name in CHROME
    if name == "form" and _wraps(page, at):
        chrome = False
    elif name == "header" and parent is not None and parent.told:  # an article's own header has its headline
        chrome = False
    if attrs:
        a = {k.lower(): html.unescape(x or y or z or "") for k, x, y, z in _ATTR.findall(attrs)}
        if a.get("class"):
            label += "." + ".".join(a["class"].split())
        named = f"{a.get('class', '')} {a.get('id', '')}"
        chrome = chrome or (name not in ("html", "body", "article", "main") and bool(CHROME_WORDS.search(named))) or a.get("role", "").lower() in CHROME_ROLES or "hidden" in a or a.get("aria-hidden") == "true"
    path = label if parent is None else parent.path if len(parent.path) > MOST_PATH else f"{parent.path}/{label}"
    return Element(name, label, chrome or (parent is not None and parent.chrome), path, parent, name in ("article", "main") or (parent is not None and parent.told))


def bare(name: str, attributes: str | None, parent: Element | None, page: str, at: int) -> Element:
    """An element of which nothing but its name is asked."""
    return Element(name, "", False, "", parent)


def events(page: str, element=None) -> Iterator[tuple[str, Element, str]]:
    """("open" | "break" | "text", element, text) in page order; missing end tags are implied as browsers do. `element` makes one."""
    element = element or _element
    root = Element("", "", False, "", None)
    stack = [root]
    at, n = 0, len(page)

    def pop_to(k: int) -> None:
        del stack[k:]

    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            if at < n:
                yield "text", stack[-1], page[at:]
            return
        if m.start() > at:
            yield "text", stack[-1], page[at : m.start()]
        at = m.end()
        close, name = m.group(1), m.group(2)
        if close:
            close = close.lower()
            if close in ("p", "br"):
                yield "break", stack[-1], close
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == close:
                    if close not in INLINE:
                        yield "break", stack[k], close
                    pop_to(k)
                    break
                if close in INLINE and stack[k].name not in INLINE and stack[k].name != "p":
                    break
        elif name:
            name = name.lower()
            if name in CLOSES_P:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].name == "p":
                        yield "break", stack[k], "p"
                        pop_to(k)
                        break
                    if stack[k].name in SCOPE:
                        break
            if name in CLOSED_BY:
                stop = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}}.get(name, {"table", "select", "html"})
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].name in CLOSED_BY[name]:
                        pop_to(k)
                        if name not in ("tr", "tbody", "tfoot", "td", "th"):
                            break
                    elif stack[k].name in stop:
                        break
            if name not in INLINE:
                yield "break", stack[-1], name
            e = element(name, m.group(3), stack[-1] if stack[-1] is not root else None, page, at)
            yield "open", e, name
            if name in RAW:
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
                if name in ("textarea", "title"):
                    yield "text", e, page[at : end.start() if end else n]
                at = end.end() if end else n
            elif name not in VOID and not (m.group(3) or "").endswith("/") or name in ("p", "div", "article", "section"):
                if name not in VOID:
                    stack.append(e)


def _words(text: str) -> str:
    return " ".join(html.unescape(text).split())


def tokens(page: str) -> tuple[dict[tuple[str, str], int], dict[str, int]]:
    """Counts of (path, "" or text), and words of text by the path of each element that holds it."""
    count: dict[tuple[str, str], int] = {}
    volume: dict[str, int] = {}
    for kind, e, text in events(page):
        if kind == "open":
            count[e.path, ""] = count.get((e.path, ""), 0) + 1
        elif kind == "text" and (t := _words(text)) and e.path and not e.chrome:
            count[e.path, t] = count.get((e.path, t), 0) + 1
            x: Element | None = e
            while x is not None:
                volume[x.path] = volume.get(x.path, 0) + t.count(" ") + 1
                x = x.parent
    return count, volume


def main_container(words: dict[str, int]) -> str:
    """The main container of a host: words maps template paths that occur once a page to the words that vary inside them.

    The paths nest, and so do the slots. An article or main that holds most words goes before others, the deepest that holds
    as many as the outermost such. Else the way leads from the outermost slot into the one slot inside it that counts, as long
    as there is just one and little else stands beside: a slot counts with SLOT of all words or with a heading of the first
    level. So a host's menus, adverts and footers stay outside by their volume, whatever they are called, and slots that
    share the text stay together.
    """
    whole = max(words.values(), default=0)
    if not whole:
        return ""
    named = [p for p, w in words.items() if w >= 0.6 * whole and re.match(r"(article|main)\b", p.rsplit("/", 1)[-1])]
    if named:
        most = max(words[p] for p in named)
        return max((p for p in named if words[p] == most), key=lambda p: (p.count("/"), p))
    inside: dict[str, list[str]] = {}
    headed: set[str] = set()
    for p in words:
        up = p
        while up := up.rpartition("/")[0]:
            if up in words:
                inside.setdefault(up, []).append(p)
                break
        if re.match(r"h1\b", p.rsplit("/", 1)[-1]):
            headed.update(p[:k] for k in range(len(p) + 1) if k == len(p) or p[k] == "/")
    at = min((p for p, w in words.items() if w == whole), key=lambda p: (p.count("/"), p))
    while True:
        slots = inside.get(at, [])
        count = [p for p in slots if words[p] >= SLOT * whole or p in headed]
        if len(count) != 1 or words[at] - sum(words[p] for p in slots) >= SLOT * whole:
            return at
        at = count[0]


def _token(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1 if text else 0


def _at(path: str, token: int) -> int:
    """One number for a token at its path."""
    return xxhash.xxh64_intdigest(f"{token} {path}".encode("utf-8", "surrogatepass")) >> 1


def extract(page: str | None, container: str = "", fixed: frozenset[int] = frozenset()) -> str:
    """The main text of one page, given its host's container path ("": none known) and the template's own text inside it."""
    if not page:
        return ""
    def within(e: Element | None, test) -> bool:
        while e is not None:
            if test(e):
                return True
            e = e.parent
        return False

    varies: set[int] = set()
    blocks: list[tuple[Element, list[str]]] = [(Element("", "", False, "", None), [])]
    for kind, e, text in events(page):
        if kind == "text":
            if not e.chrome:
                if fixed and (t := _words(text)) and not (_at(e.path, _token(t)) in fixed and within(e, lambda x: x.path == container)):
                    varies.add(id(_block(e)))
                if blocks[-1][0] is not e and _block(blocks[-1][0]) is not _block(e):
                    blocks.append((e, []))
                blocks[-1][1].append(html.unescape(text))
                blocks[-1] = (e, blocks[-1][1])
        elif kind == "break":
            blocks.append((e, []))
    # a block goes as a whole or not at all: words between those that vary are part of its text
    made = [(e, t) for e, x in blocks if (not fixed or id(_block(e)) in varies) and (t := " ".join("".join(x).split()))]
    if not made:
        return ""

    for test in ((lambda e: e.path == container) if container else None, lambda e: e.name == "article", lambda e: e.name == "main"):
        if test:
            got = [t for e, t in made if within(e, test)]
            if got:
                return " ".join(got)
    return " ".join(t for _, t in made)


def _block(e: Element) -> Element:
    while e.name in INLINE and e.parent is not None:
        e = e.parent
    return e


def host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def containers(pages: DataFrame) -> DataFrame:
    """(host, container, fixed) for each host with a template; fixed: the template's own text in it. pages: host, key (one number a page), html.

    Each task sums its pages' tokens by host, so a host with a third of all pages comes to the shuffle as a few sums.
    The occurrence vector is known by two sums, over pages, of a hash of (page, count), which do not depend on order.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, str, int], list[int]] = {}

        def flush() -> pa.RecordBatch:
            keys, values = list(sums), list(sums.values())
            cols = [pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys]), pa.array([k[2] for k in keys], pa.int64()), *(pa.array([v[i] for v in values], pa.int64()) for i in range(6))]
            sums.clear()
            return pa.RecordBatch.from_arrays(cols, ["host", "path", "token", "pages", "total", "v1", "v2", "place", "words"])

        for batch in batches:
            for part in slices(batch, "html", 16 << 20) if batch.num_rows else []:
                for h, key, page in zip(*(part.column(c).to_pylist() for c in ("host", "key", "html")), strict=True):
                    found, volume = tokens(page or "")
                    s = sums.setdefault((h, "", 0), [0] * 6)
                    s[0] += 1
                    for place, ((path, text), n) in enumerate(found.items()):
                        token = _token(text)
                        v = xxhash.xxh64_intdigest(f"{key}:{n}")
                        s = sums.setdefault((h, path, token), [0] * 6)
                        s[0] += 1
                        s[1] += n
                        s[2] += v & 0xFFFFFFFF
                        s[3] += v >> 32
                        s[4] += place
                        s[5] += n * (text.count(" ") + 1) if text else volume.get(path, 0)
                    if len(sums) > 200_000:
                        yield flush()
        if sums:
            yield flush()

    schema = "host string, path string, token long, pages long, total long, v1 long, v2 long, place long, words long"
    sums = pages.mapInArrow(count, schema).groupBy("host", "path", "token").agg(*[F.sum(c).alias(c) for c in ("pages", "total", "v1", "v2", "place", "words")])
    sizes = sums.where("path = '' and token = 0").select(F.col("host").alias("h"), F.col("pages").alias("n"))
    frequent = sums.where("path <> ''").join(sizes, F.col("host") == F.col("h")).where((F.col("n") >= LEAST) & (F.col("pages") >= SUPPORT * F.col("n")))

    def deduce(key: tuple, t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        classes: dict[tuple, list[dict]] = {}
        for r in rows:
            classes.setdefault((r["pages"], r["total"], r["v1"], r["v2"]), []).append(r)
        varying = {r["path"]: r["words"] for r in rows if r["token"] == 0}
        template: list[str] = []
        own: list[tuple[str, int]] = []
        every = max((r["pages"] for r in rows if r["token"] == 0), default=0)
        for (on, total, _, _), members in classes.items():
            if on == total and len(members) > 1:  # once on each of its pages, with others: a valid class
                for r in members:
                    p = r["path"]
                    if r["token"] == 0:
                        template.append(p)
                        continue
                    if on == every:
                        own.append((p, r["token"]))
                    while p:  # what the template says itself does not vary
                        if p in varying:
                            varying[p] -= r["words"]
                        p = p.rpartition("/")[0]
        container = main_container({p: varying[p] for p in template})
        fixed = sorted(_at(p, t) for p, t in own if p == container or p.startswith(container + "/"))
        return pa.table({"host": [key[0].as_py()], "container": [container], "fixed": pa.array([fixed], pa.list_(pa.int64()))})

    return frequent.groupBy("host").applyInArrow(deduce, "host string, container string, fixed array<long>").where("container <> ''")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """For each row of pages: page_id, url, text (the main text, empty if none).

    Null html counts as empty; a null url, or one without a host, joins the pages of the empty host. Other columns are
    ignored; rows are kept one for one; an empty table gives no rows. Character references are decoded, white space in a
    block becomes one space, blocks are joined in page order by one space.
    """
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    base = base.withColumn("host", host(F.col("url")))
    known = cut(containers(base.select("host", F.xxhash64("page_id", "url").alias("key"), "html")))
    size = known.agg(F.sum(F.length("host") + F.length("container") + 8 * F.size("fixed") + 64)).first()[0] or 0
    joined = base.join(F.broadcast(known) if size <= BROADCAST_BYTES else known, "host", "left")
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html", 16 << 20) if batch.num_rows else []:
                texts = [extract(page, c or "", frozenset(f or ())) for page, c, f in zip(*(part.column(k).to_pylist() for k in ("html", "container", "fixed")), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return joined.select("page_id", "url", "html", "container", "fixed").mapInArrow(run, f"page_id {kind}, url string, text string")
