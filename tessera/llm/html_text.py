"""Main text of web pages: structural rules and removal of site templates counted per host."""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, durable, small_enough

# Elements of HTML by the part they play.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROP = frozenset("script style noscript template iframe object embed svg annotation annotation-xml canvas audio video map head title nav header footer aside form button select option textarea input label fieldset dialog menu noembed noframes xmp".split())
NEVER = frozenset("script style noscript template iframe object embed svg annotation annotation-xml canvas audio video map head title select option textarea button noembed noframes xmp".split())
BLOCK = frozenset("address article blockquote body br caption center dd details div dl dt figcaption figure h1 h2 h3 h4 h5 h6 hgroup hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: An opening tag of these ends an open paragraph.
ENDS_P = BLOCK - {"br"} | {"nav", "header", "footer", "aside", "form", "fieldset", "menu"}
#: Words in class, id or role that mark what isn't the article. They are looked for in whole names between white space,
#: of which they are a part between hyphens or low lines.
SIDE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|"
    r"nav\w*|menu\w*|breadcrumbs?|sidebar\w*|side|footer|header|masthead|topbar|toolbar|share|sharing|social|related|recommend\w*|comments?|"
    r"commentlist|disqus|respond|reply|replies|widget\w*|pagination|pager|skip|search|login|signup|contentinfo|complementary|navigation)(?:$|[\s_-])",
    re.I,
)
#: Names that begin so say how a page looks, not what an element is.
STATE = ("no-", "no_", "has-", "has_", "with-", "with_", "without-", "without_", "is-", "is_", "hide-", "show-", "search-result", "search_result")
#: Share of a page's text from which an element is the page, whatever its name says.
MOST = 0.5
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>")
#: Name and value of an attribute. Values are consumed whole, so that nothing inside them counts as a name.
_ATTR = re.compile(r"([^\s/>=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")


class Node:
    """An element: its name, whether rules drop it, its children (nodes and texts), the text that rules leave in it."""

    __slots__ = ("name", "dropped", "children", "size", "holds")

    def __init__(self, name: str, dropped: bool):
        self.name, self.dropped, self.children = name, dropped, []
        self.size, self.holds = 0, False


def parse(page: str) -> Node:
    """A lenient tree of a page: unclosed paragraphs and list items end where the next begins, stray ends are ignored."""
    root = Node("#root", False)
    stack, at, size, find = [root], 0, len(page), page.find
    while at < size:
        lt = find("<", at)
        if lt != at:
            stack[-1].children.append(page[at:] if lt < 0 else page[at:lt])
            if lt < 0:
                break
            at = lt
        after = page[at + 1 : at + 2]
        if after in ("!", "?"):
            end = find("-->", at + 4) if page.startswith("<!--", at) else find(">", at)
            if end < 0:
                break
            at = end + (3 if page.startswith("<!--", at) else 1)
            continue
        m = _TAG.match(page, at)
        if m is None:
            if after == "" or after == "/" or after.isalpha() and after.isascii():
                if find(">", at) < 0:
                    break  # a tag that the page's end cuts off
            stack[-1].children.append("<")
            at += 1
            continue
        at = m.end()
        name = m.group(2)
        name = name.lower()
        if m.group(1):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == name:
                    del stack[i:]
                    break
            else:
                if name == "br":
                    stack[-1].children.append(Node("br", False))
            continue
        if name in ENDS_P or name in ("li", "dd", "dt", "tr", "td", "th", "option"):
            _close_implied(stack, name)
        attrs = m.group(3)
        node = Node(name, name in DROP or bool(attrs) and _is_side(name, attrs))
        stack[-1].children.append(node)
        if name in VOID or attrs.endswith("/"):
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        stack.append(node)
    return root


def _close_implied(stack: list[Node], name: str) -> None:
    same = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}.get(name, ())
    stop = {"li": ("ul", "ol", "menu"), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}.get(name, ("dl", "select"))
    for i in range(len(stack) - 1, 0, -1):
        own = stack[i].name
        if own in same or own == "p" and name in ENDS_P:
            del stack[i:]
            return
        if own in stop and same or own in BLOCK or own in ENDS_P:
            return


def _is_side(name: str, attrs: str) -> bool:
    if name in ("html", "body", "main"):
        return False
    seen = set()
    for key, *values in _ATTR.findall(attrs):
        key, value = key.lower(), next((v for v in values if v), "")
        if key in seen:
            continue  # the first of a name counts
        seen.add(key)
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return True
        if key in ("class", "id", "role") and any(SIDE.search(x) for x in value.split() if not x.lower().startswith(STATE)):
            return True
    return False


def settle(root: Node) -> None:
    """Measure the text of every element, and take back wrong drops.

    Where no article or main element is left, a dropped element that holds one, or most of the page's text, wraps the
    page and is kept after all. A header inside an article is the article's own. What never holds text for readers, and
    navigation, stay dropped.
    """
    order: list[tuple[Node, bool]] = []
    todo, free = [(root, False, False)], []
    while todo:
        n, inside, gone = todo.pop()
        if n.name == "header" and inside:
            n.dropped = False
        order.append((n, inside))
        gone = gone or n.dropped
        if n.name in ("article", "main") and not gone:
            free.append(n)
        inside = inside or n.name == "article"
        todo.extend((c, inside, gone) for c in n.children if isinstance(c, Node))
    for n, _ in reversed(order):  # children before their parents; dropped ones count for now
        n.size = sum(len(c.strip()) if isinstance(c, str) else 0 if c.name in NEVER else c.size for c in n.children)
        n.holds = any(isinstance(c, Node) and (c.holds or c.name in ("article", "main") and not c.dropped and c.size > 0) for c in n.children)
    whole = root.size
    for n, inside in order if not any(n.size for n in free) else ():
        if n.dropped and n.name not in NEVER and n.name != "nav" and not inside and (n.holds or n.size > MOST * whole):
            n.dropped = False
    for n, _ in reversed(order):
        n.size = 0 if n.dropped else sum(len(c.strip()) if isinstance(c, str) else c.size for c in n.children)


def main_nodes(root: Node) -> list[Node]:
    """The outermost articles that no rule drops, else the main elements, if they hold most of the text; else the page."""
    settle(root)
    for wanted in ("article", "main"):
        found, todo = [], [root]
        while todo:
            n = todo.pop()
            if n.dropped:
                continue
            if n.name == wanted:
                found.append(n)
            else:
                todo.extend(c for c in reversed(n.children) if isinstance(c, Node))
        if found and sum(n.size for n in found) >= MOST * root.size:
            return found
    return [root]


def blocks(root: Node, hashed: bool = True) -> list[tuple[str, tuple[int, ...]]]:
    """Text of each block of the main text in page order, and the hashes of the block subtrees that hold it.

    A subtree's hash covers its element's name and the texts of its blocks.
    """
    out: list[tuple[str, list[str]]] = []
    hashes: dict[int, int] = {}
    text: list[str] = []
    path: list[Node] = []

    def flush() -> None:
        if text:
            s = "".join(text)
            text.clear()
            s = " ".join((html.unescape(s) if "&" in s else s).split())
            if s:
                out.append((s, list(path)))
                if hashed:
                    for p in path:
                        seen[id(p)].append(s)

    # an explicit stack: pages nest as deep as they like
    seen: dict[int, list[str]] = {}
    for top in main_nodes(root):
        todo: list[tuple[str, Node | str]] = [("open", top)]
        while todo:
            what, n = todo.pop()
            if isinstance(n, str):
                text.append(n)
                continue
            if what == "close":
                flush()
                own = path.pop()
                if hashed and (parts := seen.pop(id(own))):
                    digest = hashlib.blake2b("\n".join((own.name, *parts)).encode("utf-8", "surrogatepass"), digest_size=8).digest()
                    hashes[id(own)] = int.from_bytes(digest, "big", signed=True)
                continue
            if n.dropped:
                if n.name in BLOCK or n.name in ENDS_P:
                    flush()
                continue
            if n.name in ("br", "hr"):
                flush()
                continue
            if n.name in BLOCK or n is top:
                flush()
                path.append(n)
                seen[id(n)] = []
                todo.append(("close", n))
            todo.extend(("open", c) for c in reversed(n.children))
        flush()
    return [(s, tuple(hashes.get(id(n), 0) for n in p)) for s, p in out]


def host(url: Column) -> Column:
    """Host of a URL in lower case, without port and user; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def sections(url: Column) -> Column:
    """array<long>: the path folders of a URL, outermost first, each as a hash of the path so far."""
    parts = F.split(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)", 1), "/")
    return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda _, i: F.xxhash64(F.array_join(F.slice(parts, F.lit(1), i + 1), "/")))


def within(section: int, subtree: int) -> int:
    """One number for a subtree inside a section."""
    return ((subtree * 0x9E3779B97F4A7C15 + section) & 0xFFFFFFFFFFFFFFFF) - (1 << 63)


def site_templates(pages: DataFrame, url_col: str = "url", html_col: str = "html", min_pages: int = 12, share: float = 0.5) -> DataFrame:
    """(host, subtree): hashes of block subtrees that at least min_pages pages and a `share` of a host's pages have.

    The same holds for each section, the pages below one path folder of the host; a subtree of a section is the number
    `within` gives. Each page counts a subtree once in the host and in each of its sections. Counts are partial sums before they are shuffled, so that a host with a third of
    all pages is no hot key. Pages without a host have no templates; rows that repeat a page count each; null html has
    no subtrees; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hosts, within_, hashes = [], [], []
            for h, page, folders in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                own = {x for _, p in blocks(parse(page.as_py() or "")) for x in p if x}
                hosts += [h] * ((len(own) + 1) * (len(folders) + 1))
                within_ += [0] * (len(own) + 1)
                hashes += [0, *own]  # 0 counts the pages
                for f in folders:
                    within_ += [f] * (len(own) + 1)
                    hashes += [0, *(within(f, x) for x in own)]
            yield pa.RecordBatch.from_arrays([pa.array(hosts, type=pa.string()), pa.array(within_, type=pa.int64()), pa.array(hashes, type=pa.int64())], names=["host", "section", "subtree"])

    counted = pages.select(host(F.col(url_col)).alias("host"), F.col(html_col).alias("_html"), sections(F.col(url_col)).alias("_sections")).filter("host <> ''")
    counted = counted.mapInArrow(run, "host string, section long, subtree long")
    counted = durable(counted.groupBy("host", "section", "subtree").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages))
    size = counted.filter("subtree = 0").select("host", "section", F.col("n").alias("pages"))
    return durable(counted.filter("subtree <> 0").join(size, ["host", "section"]).filter(F.col("n") >= F.col("pages") * share).select("host", "subtree").distinct())


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = 12, share: float = 0.5) -> DataFrame:
    """(id_col, url_col, text) per row of pages: the article's blocks joined by newlines, empty if there are none.

    Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments go by element and by
    class, id or role (but never an element that holds an article or most of the page's text, nor an article's own
    header); the articles are the main text if they hold most of what is left; then goes every block inside a subtree that site_templates finds on the page's host or in one of its sections. Character
    references are decoded, white space inside a block is one space. Null html counts as empty; broken and cut-off
    markup is read as far as it goes; null ids and urls and repeated rows pass through; an empty table gives an empty
    one; other columns are ignored, whatever their names.
    """
    spark = pages.sparkSession
    known = site_templates(pages, url_col, html_col, min_pages, share)
    src = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), host(F.col(url_col)).alias("_host"), F.col(html_col).alias("_html"), sections(F.col(url_col)).alias("_sections"))
    if small_enough(known, BROADCAST_ROWS):
        shared = spark.sparkContext.broadcast({(r["host"], r["subtree"]) for r in known.toLocalIterator()})
        src = src.withColumn("_cut", F.lit(None).cast("array<long>"))
    else:  # more hosts than executors can hold: each page meets its host's templates by a join
        shared = spark.sparkContext.broadcast(None)
        by_host = known.groupBy("host").agg(F.collect_list("subtree").alias("_cut")).withColumnRenamed("host", "_host")
        src = src.join(by_host, "_host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        hosts = {h for h, _ in table} if table is not None else None
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part, texts = b.slice(at, 500), []
                for h, page, folders, cut in zip(part.column("_host").to_pylist(), part.column("_html"), part.column("_sections").to_pylist(), part.column("_cut"), strict=True):
                    cut = set(cut.as_py() or ())
                    known_ = (lambda x, h=h: (h, x) in table) if table is not None else cut.__contains__
                    gone = lambda x, known_=known_, folders=folders: known_(x) or any(known_(within(f, x)) for f in folders)
                    found = blocks(parse(page.as_py() or ""), hashed=h in hosts if hosts is not None else bool(cut))
                    texts.append("\n".join(s for s, p in found if not any(map(gone, p))))
                yield pa.RecordBatch.from_arrays([part.column("_id"), part.column("_url"), pa.array(texts, type=pa.string())], names=[id_col, url_col, "text"])

    ordered = src.select("_id", "_url", "_host", "_html", "_sections", "_cut")
    schema = pages.select(F.col(id_col), F.col(url_col), F.lit("").alias("text")).schema
    return ordered.mapInArrow(run, schema)
