"""Operator 10: HTML extraction with site template removal.

Every page becomes a tree of elements. All its subtrees that hold text and are no running text of the article are hashed
(tag, attributes, words): menus, headers, footers and side boxes too. Spark counts on how many differing pages of a host
each hash stands; what recurs on many pages of a host is its template and is cut out of the tree first. Only for what
then is left do tags, roles and class names decide: the articles are found, elements that are never main text go, and
the rest is written as one line per block.
"""

from __future__ import annotations

import html
import re

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from smishlake.llm.common import map_rows, sized, store, table, unused

#: A subtree is template when it stands on at least so many differing pages of a host, however many pages the host has.
LEAST_PAGES = 5

# HTML facts (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav noframes ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: A start tag of the key closes an open element of the values first.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
CLOSES_P = BLOCKS - {"body", "html", "frameset", "option", "optgroup", "td", "th", "tr", "tbody", "thead", "tfoot", "li", "dd", "dt", "legend"} | {"li", "dd", "dt"}
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math".split())
NEVER = frozenset("head nav header footer aside form script style noscript template iframe object embed svg math button select textarea input title dialog menu canvas audio video".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist".split())
_NOISE = re.compile(
    r"(?<![a-z])(?:ads?|adv|advert\w*|adsense|adbox|banner|sponsor\w*|promo\w*|nav\w*|menus?|breadcrumbs?|sidebar\w*|side-bar|footer|header|masthead|cookies?|consent|gdpr|notices?|popup|modal|overlay|newsletter|subscri\w+|signup|sign-up|login|comments?|commentlist|disqus|replies|respond|discussion|related|recommend\w*|share|sharing|social\w*|widget\w*|pagination|pager|toolbar|tags?|skip-link|hidden|alert)(?![a-z])"
)
_MARKUP = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z])")
_NAME = re.compile(r"[^\s/>]*")
_VALUE = re.compile(r"[^>=]*")
_BARE = re.compile(r"[^\s>]*")
_ATTR = re.compile(r"([^\s\"'=/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_SPACE = re.compile(r"[ \t\n\r\f\v\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_RAW_END = {t: re.compile(f"</{t}", re.I | re.A) for t in RAW}
#: Boxes inside an article that may be template; its headings, paragraphs and list items never are.
BOXES = frozenset("div section ul ol table figure aside nav header footer form".split())


class Node:
    __slots__ = ("tag", "attrs", "kids", "hash", "chars", "parent")

    def __init__(self, tag: str, attrs: str, parent: Node | None = None):
        self.tag, self.attrs, self.kids, self.hash, self.chars, self.parent = tag, attrs, [], 0, 0, parent


class _Scanner:
    """Finds where things end in a page, and remembers what does not come any more, so that no stretch is read twice."""

    def __init__(self, page: str):
        self.page, self.missing = page, set()

    def find(self, what: str, at: int) -> int:
        if what in self.missing:
            return -1
        got = self.page.find(what, at)
        if got < 0:
            self.missing.add(what)
        return got

    def tag_end(self, at: int) -> int:
        """Where the > of a tag stands whose name ends here; quotes count after an equals sign. -1: the page ends first."""
        page = self.page
        while True:
            at = _VALUE.match(page, at).end()
            if at >= len(page):
                return -1
            if page[at] == ">":
                return at
            at += 1
            while at < len(page) and page[at].isspace():
                at += 1
            quote = page[at : at + 1]
            close = self.find(quote, at + 1) if quote in ('"', "'") else -1
            at = close + 1 if close >= 0 else _BARE.match(page, at).end()


def parse(page: str) -> Node:
    """Tree of a page: kids are nodes and raw strings. Unclosed and misnested tags are mended as browsers mostly do.

    Time grows with the length of the page, also where tags or quotes stay open or elements nest thousands deep.
    """
    root = Node("#root", "")
    stack, blocks, opened = [root], [0], {}  # open elements, places of open blocks among them, places by tag
    scan, at = _Scanner(page), 0

    def close(i: int) -> None:
        for n in stack[i:]:
            opened[n.tag].pop()
        del stack[i:]
        while blocks[-1] >= i:
            blocks.pop()

    while at < len(page):
        m = _MARKUP.search(page, at)
        if m is None:
            stack[-1].kids.append(page[at:])
            break
        if m.start() > at:
            stack[-1].kids.append(page[at : m.start()])
        kind = m[0]
        if kind == "<!--":
            end = scan.find("-->", m.end())
            if end < 0:
                break
            at = end + 3
            continue
        if kind in ("<!", "<?"):
            end = scan.find(">", m.end())
            if end < 0:
                break
            at = end + 1
            continue
        if scan.find(">", m.end()) < 0:  # no tag can end any more: what follows is text
            stack[-1].kids.append(page[m.start() :])
            break
        name = _NAME.match(page, m.end() - 1)
        tag, end = name[0].lower(), scan.tag_end(name.end())
        if end < 0:
            break
        attrs, at = page[name.end() : end], end + 1
        if kind == "</" or kind.startswith("</"):
            places = opened.get(tag)
            # an end tag of a phrase does not close the block around it
            if places and (tag in BLOCKS or blocks[-1] <= places[-1]):
                close(places[-1])
            continue
        if tag in CLOSES_P or tag in CLOSES:
            ends = CLOSES.get(tag, frozenset())
            for i in reversed(blocks):
                t = stack[i].tag
                if t in ends or (t == "p" and tag in CLOSES_P):
                    close(i)
                    break
                if t != "p":
                    break
        node = Node(tag, attrs, stack[-1])
        stack[-1].kids.append(node)
        if tag in RAW:
            got = _RAW_END[tag].search(page, at)
            if got is None:
                node.kids.append(page[at:])
                break
            node.kids.append(page[at : got.start()])
            end = scan.find(">", got.end())
            at = end + 1 if end >= 0 else len(page)
        elif tag not in VOID and not attrs.endswith("/"):
            opened.setdefault(tag, []).append(len(stack))
            if tag in BLOCKS:
                blocks.append(len(stack))
            stack.append(node)
    return root


def attributes(node: Node) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(node.attrs)} if node.attrs else {}


def noise(node: Node) -> bool:
    """Whether an element is never main text, by its tag, role or class."""
    if node.tag in NEVER:
        return True
    if not node.attrs or node.tag in ("body", "html", "article", "main"):
        return False
    a = attributes(node)
    if a.get("role", "").lower() in ROLES or a.get("aria-hidden") == "true" or "hidden" in node.attrs.lower().split():
        return True
    return bool(_NOISE.search(f"{a.get('class', '')} {a.get('id', '')}".lower().replace("_", "-")))


def measure(root: Node) -> None:
    """Hash and text length of every subtree, from the leaves up."""
    order, todo = [], [root]
    while todo:
        n = todo.pop()
        order.append(n)
        todo += [k for k in n.kids if isinstance(k, Node)]
    for n in reversed(order):
        parts = [n.tag, " ".join(n.attrs.split())]
        for k in n.kids:
            if isinstance(k, Node):
                parts.append(str(k.hash))
                n.chars += k.chars
            else:
                words = " ".join(k.split())
                parts.append(words)
                n.chars += len(words)
        n.hash = xxhash.xxh3_64_intdigest("\0".join(parts).encode("utf-8", "surrogatepass")) - (1 << 63)


def regions(root: Node, template: frozenset = frozenset()) -> list[Node]:
    """The elements that hold the main text, in page order: all articles that lie in no other one and in no noise, else
    all main elements (or role main), else the body. What is template is not looked into."""
    articles, mains, bodies, todo = [], [], [], [(root, False)]
    while todo:
        n, inside = todo.pop()
        role = attributes(n).get("role", "").lower() if n.attrs else ""
        if n.tag == "article" or role == "article":
            articles.append(n)
            continue
        if n.tag == "main" or role == "main":
            if not inside:
                mains.append(n)
            inside = True
        elif n.tag == "body":
            bodies.append(n)
        todo += [(k, inside) for k in reversed(n.kids) if isinstance(k, Node) and k.hash not in template and not noise(k)]
    return articles or mains or bodies[:1] or [root]


def candidates(root: Node, main: list[Node]) -> list[int]:
    """Hashes of subtrees with text that may be template: all blocks outside the article; inside, boxes only."""
    free = main[0].tag not in ("#root", "body")
    holds, ours = set(), {id(n) for n in main}
    for n in main:
        while n is not None and id(n) not in holds:
            holds.add(id(n))
            n = n.parent
    out, todo = set(), [(root, False)]
    while todo:
        n, inside = todo.pop()
        inside = inside or free and id(n) in ours
        if n.chars and id(n) not in holds and n.tag in (BOXES if inside else BLOCKS):
            out.add(n.hash)
        todo += [(k, inside) for k in n.kids if isinstance(k, Node) and k.tag not in RAW]
    return sorted(out)


def main_text(root: Node, template: frozenset = frozenset()) -> str:
    """Blocks of the articles in page order, one line each, without what is template."""
    lines: list[str] = []
    open_: list[str] = []

    def close() -> None:
        if open_:
            text = _SPACE.sub(" ", html.unescape("".join(open_))).strip()
            if text:
                lines.append(text)
            open_.clear()

    main = regions(root, template)
    ours = {id(n) for n in main}
    todo: list = [x for n in reversed(main) for x in (None, n)]
    while todo:
        n = todo.pop()
        if n is None:
            close()
        elif isinstance(n, str):
            open_.append(n)
        elif n.tag == "br":
            open_.append(" ")
        elif id(n) in ours or (n.hash not in template and not noise(n)):
            if n.tag in BLOCKS:
                close()
                todo.append(None)
            todo += reversed(n.kids)
    close()
    return "\n".join(lines)


def host_of(url: str | None) -> str:
    return re.sub(r"^[a-z][a-z0-9+.-]*://", "", (url or "").lower()).split("/")[0].split("?")[0].split("#")[0].split("@")[-1]


def site_hash(host: str, subtree: int) -> int:
    return xxhash.xxh3_64_intdigest(f"{host}\0{subtree}".encode("utf-8", "surrogatepass")) - (1 << 63)


def templates(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_key, hashes: for each url and html the subtrees of that page that recur on its host.

    Pages of a host whose main text is the same count once. A task sums its own pages before the shuffle; a host with a
    third of all pages is summed by hash of host and subtree, not in one group. A page's list is no longer than its own
    subtrees.
    """
    def hashes(keys: list, urls: list, pages: list) -> tuple:
        found, sites, own = [], [], []
        for u, p in zip(urls, pages, strict=True):
            root = parse(p or "")
            measure(root)
            main, host = regions(root), host_of(u)
            got = candidates(root, main)
            found.append(got)
            sites.append([site_hash(host, h) for h in got])
            own.append(xxhash.xxh3_64_intdigest(repr([n.hash for n in main]).encode()) - (1 << 63))
        return keys, own, found, sites

    rows = pages.select(page_key(url_col, html_col).alias("page_key"), url_col, html_col)
    seen = store(map_rows(rows, hashes, "page_key binary, page long, hashes array<long>, sites array<long>", "page_key", url_col, html_col), "page-subtrees")
    often = seen.select("page", F.explode("sites").alias("site")).distinct().groupBy("site").agg(F.count(F.lit(1)).alias("n"))
    often = store(often.filter(F.col("n") >= LEAST_PAGES).select("site"), "often-subtrees")
    each = seen.select("page_key", F.explode(F.arrays_zip("sites", "hashes")).alias("x")).select("page_key", F.col("x.sites").alias("site"), F.col("x.hashes").alias("hash"))
    return each.join(sized(often), "site").groupBy("page_key").agg(F.sort_array(F.collect_set("hash")).alias("hashes"))


def page_key(url_col: str, html_col: str) -> Column:
    return F.unhex(F.md5(F.concat(F.coalesce(url_col, F.lit("")), F.lit("\n"), F.coalesce(html_col, F.lit("")))))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id_col, url_col, text, n_chars for every page.

    Null or empty html and pages without main text give an empty text; a null url belongs to a host of its own. Several
    articles of a page are all kept, in page order. Repeated rows give repeated rows; other columns are ignored.
    """
    known = store(templates(pages, url_col, html_col), "site-templates")
    most = known.agg(F.max(F.size("hashes"))).first()[0] or 0
    key = unused("page_key", pages)
    rows = pages.select(id_col, url_col, html_col, page_key(url_col, html_col).alias(key))
    rows = rows.join(sized(known.withColumnsRenamed({"page_key": key, "hashes": f"{key}_hashes"}), row_bytes=64 + 8 * most), key, "left")
    kind = pages.schema[id_col].dataType.simpleString()

    def run(ids: list, urls: list, texts: list, hashes) -> tuple:
        out = []
        for i, t in enumerate(texts):
            root = parse(t or "")
            measure(root)
            out.append(main_text(root, frozenset(hashes[i].as_py() or ())))
        return ids, urls, out, [len(t) for t in out]

    return map_rows(rows, run, f"{id_col} {kind}, {url_col} string, text string, n_chars long", id_col, url_col, html_col, f"{key}_hashes")


def op10_site_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
