"""Main text of web pages by templates deduced from all pages of a host.

A token is a container's opening or closing tag with the path to it, or a block of text in its
container. Tokens of a host that occur equally often on the same pages form a class; Spark finds
classes by summing a hash of (page, occurrences) per token, so no vector is ever gathered. Classes
on enough pages, whose tokens keep one order and which nest on a page, are its template. The text
between template tokens fills slots, and slots of the article are the page's main text.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slipway.llm.common import bounded_batches, cut, read_table

#: Share of a host's pages, and least number of pages, that a class needs.
SUPPORT, LEAST_PAGES = 0.6, 4
#: A container around the main one belongs to it if it adds no more than this share of text.
AROUND = 0.25

# Fixed values of HTML and of common page markup.
CONTAINERS = frozenset(
    "html head body div section article main nav header footer aside form ul ol dl table blockquote figure details "
    "dialog fieldset menu center".split()
)
LEAVES = frozenset(
    "p h1 h2 h3 h4 h5 h6 li dt dd tr td th thead tbody tfoot caption pre address hr figcaption summary legend option "
    "title hgroup".split()
)
SKIPPED = frozenset("script style noscript template svg iframe object canvas audio video select button textarea title".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ASIDE_TAGS = frozenset("head nav header footer aside form menu dialog".split())
ASIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr "
    "notice notices alert popup modal overlay newsletter subscribe signup login search share sharing social nav navbar "
    "navigation menu breadcrumb breadcrumbs pagination pager sidebar widget widgets related recommended header masthead "
    "footer copyright comment comments disqus respond replies reply".split()
)
HEAD_NAMES = frozenset("header masthead banner".split())
#: Containers that belong to the text around them.
WITHIN_TEXT = frozenset("ul ol dl table blockquote figure details center fieldset".split())
MAIN_TAGS = frozenset("article main".split())
MAIN_NAMES = frozenset("articlebody main".split())

_MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*+(?:>|\Z))""",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.IGNORECASE)
_NAME = re.compile("[a-z]+")


@dataclass(frozen=True, eq=False)
class Node:
    """A container: a hash of the path to it and what its markup says of it."""

    path: int
    tag: str
    aside: bool
    named: bool
    head: bool
    main: bool
    parent: Node | None

    def within(self, path: int) -> bool:
        return any(node.path == path for node in _up(self))


def _node(tag: str, attributes: str, parent: Node | None) -> Node:
    told = {name.lower(): value.strip("\"'").lower() for name, value in _ATTRIBUTE.findall(attributes)}
    label = tag + "".join(f"[{name}={re.sub('[0-9]+', '0', told[name])}]" for name in sorted(told))
    names = set(_NAME.findall(f"{told.get('class', '')} {told.get('id', '')}"))
    roles = set(_NAME.findall(f"{told.get('role', '')} {told.get('itemprop', '')}"))
    main = tag in MAIN_TAGS or bool(roles & MAIN_NAMES)
    return Node(
        path=xxhash.xxh64_intdigest(f"{parent.path if parent else 0}>{label}".encode("utf-8", "surrogatepass")),
        tag=tag,
        aside=tag in ASIDE_TAGS or bool(roles & {"navigation", "banner", "contentinfo", "complementary", "search"}),
        named=not main and tag not in ("html", "body") and bool(names & ASIDE_NAMES),
        head=tag == "header" or bool(names & HEAD_NAMES),
        main=main,
        parent=parent,
    )


ROOT = Node(0, "", False, False, False, False, None)


def tokens(html: str) -> list[tuple[str, Node, str]]:
    """(kind, container, text) in page order; kind is open, close, text or heading.

    Blocks end at every tag but inline ones, a line break is white space, character
    references are decoded and white space runs become one space. Tags may be left open.
    """
    found: list[tuple[str, Node, str]] = []
    pieces: list[str] = []
    node, place, leaf = ROOT, 0, ""

    def flush() -> None:
        text = " ".join(unescape("".join(pieces)).split())
        pieces.clear()
        if text:
            found.append(("heading" if leaf in HEADINGS else "text", node, text))

    while True:
        match = _MARKUP.search(html, place)
        if match is None:
            pieces.append(html[place:])
            break
        pieces.append(html[place : match.start()])
        place = match.end()
        if match[2] is None:
            continue
        closing, tag = bool(match[1]), match[2].lower()
        if tag in SKIPPED and not closing:
            end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.IGNORECASE).search(html, place)
            place = end.end() if end else len(html)
            pieces.append(" ")
        elif tag in CONTAINERS:
            flush()
            leaf = ""
            if not closing:
                node = _node(tag, match[3], node if node is not ROOT else None)
                found.append(("open", node, ""))
            else:
                opened = node
                while opened is not None and opened.tag != tag:
                    opened = opened.parent
                if opened is not None and opened is not ROOT:
                    found.append(("close", opened, ""))
                    node = opened.parent or ROOT
        elif tag in LEAVES:
            flush()
            leaf = "" if closing else tag
        elif tag == "br":
            pieces.append(" ")
    flush()
    return found


def _token(kind: str, node: Node, text: str) -> int:
    value = xxhash.xxh64_intdigest(f"{kind}\0{node.path}\0{text}".encode("utf-8", "surrogatepass"))
    return value - (1 << 64) if value >> 63 else value


def _page_tokens(html: str) -> list[tuple[int, int, int]]:
    """(token, occurrences, place of the first) of one page."""
    counts: Counter[int] = Counter()
    first: dict[int, int] = {}
    for place, entry in enumerate(tokens(html)):
        token = _token(*entry)
        counts[token] += 1
        first.setdefault(token, place)
    return [(token, count, first[token]) for token, count in counts.items()]


def _emitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["host", "page", "token", "occurrences", "place"]
    for batch in batches:
        hosts, pages = batch.column("host").to_pylist(), batch.column("page").to_pylist()
        rows = [
            (host, page, *entry)
            for host, page, html in zip(hosts, pages, batch.column("html").to_pylist())
            for entry in _page_tokens(html)
        ]
        columns = list(zip(*rows)) or [[]] * len(names)
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))


def _hosted(pages: DataFrame) -> DataFrame:
    return pages.select(
        F.col("page_id"),
        F.col("url"),
        F.coalesce("html", F.lit("")).alias("html"),
        host_of(F.col("url")).alias("host"),
        F.xxhash64("page_id", "url", "html").alias("page"),
    )


def templates(pages: DataFrame, *, support: float = SUPPORT, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(host, classes): per host the classes of its template, each its support and its tokens in order.

    ``pages``: page_id, url, html. A class is a set of tokens with the same occurrences on
    the same pages, at least two tokens on ``support`` of the host's pages and on
    ``least_pages``. A page has few tokens, and so, however many pages a host has, its template
    has at most that number divided by ``support``.
    """
    bounded_batches(pages.sparkSession)
    emitted = _hosted(pages).select("host", "page", "html").mapInArrow(
        _emitted, "host string, page long, token long, occurrences long, place long"
    )
    vector = F.xxhash64("page", "occurrences").cast("decimal(20,0)")
    by_token = emitted.groupBy("host", "token").agg(
        F.count("*").alias("pages"), F.sum("place").alias("places"), F.sum(vector).alias("vector")
    )
    totals = _hosted(pages).groupBy("host").agg(F.count("*").alias("total"))
    frequent = by_token.filter(F.col("pages") >= least_pages).join(totals, "host").filter(F.col("pages") >= support * F.col("total"))
    classes = frequent.groupBy("host", "vector", "pages").agg(
        F.sort_array(F.collect_list(F.struct(F.col("places"), F.col("token")))).alias("members")
    )
    return classes.filter(F.size("members") > 1).groupBy("host").agg(
        F.collect_list(F.struct("pages", F.col("members.token").alias("tokens"))).alias("classes")
    )


def _nested(page: list[tuple[str, Node, str]], classes: list[dict]) -> set[int]:
    """Tokens of the classes that are valid on this page: in their order, and nesting in others.

    The more frequent class wins where two overlap without nesting.
    """
    first: dict[int, int] = {}
    for place, entry in enumerate(page):
        first.setdefault(_token(*entry), place)
    valid: set[int] = set()
    spans: list[list[int]] = []
    for one in sorted(classes, key=lambda c: (-c["pages"], -len(c["tokens"]), c["tokens"])):
        places = [first.get(token) for token in one["tokens"]]
        if None in places or places != sorted(places):
            continue
        if all(_fits(places, other) for other in spans):
            spans.append(places)
            valid.update(one["tokens"])
    return valid


def _fits(inner: list[int], outer: list[int]) -> bool:
    """Whether one class lies within a single gap of the other, or beside it."""
    gaps = {sum(place > other for other in outer) for place in inner}
    back = {sum(place > other for other in inner) for place in outer}
    return len(gaps) == 1 or len(back) == 1


def main_text(html: str, classes: list[dict] | None) -> str:
    """The article's blocks in page order, joined by an empty line.

    Slots inside containers that the markup calls article or main form the article; without
    any, the container whose slots hold most text does, with what little stands around it.
    Containers for menus, forms,
    notices, adverts and comments are left out wherever they are, but not those that only their
    class or id calls so and that are wrappers; headings of an article's
    own header are not. A text of the template is left out unless it stands in the article
    itself; there, only a container that holds nothing but template is.
    """
    page = tokens(html)
    fixed = _nested(page, classes or [])
    is_fixed = [_token(*entry) in fixed for entry in page]
    blocks = [(kind, node, text, const) for (kind, node, text), const in zip(page, is_fixed) if kind in ("text", "heading")]

    wrappers = _wrappers(page, [(kind, node, text) for kind, node, text, const in blocks if not const])

    def cleared(node: Node, kind: str, roof: Node | None) -> bool:
        """No container from here up to ``roof`` is set aside."""
        while node is not None and node is not roof:
            if (node.aside or node.named and id(node) not in wrappers) and not (node.head and kind == "heading" and roof is not None):
                return False
            node = node.parent
        return True

    def article(node: Node) -> Node | None:
        """The outermost container called main that is not itself set aside."""
        top = None
        while node is not None:
            if node.main and cleared(node, "", None):
                top = node
            node = node.parent
        return top

    roofs = {id(node): article(node) for _, node, _, _ in blocks}
    if any(roofs.values()):
        free = defaultdict(bool)
        for _, node, _, const in blocks:
            free[id(node)] |= not const
        # The article proper where a page has both: an article inside a main part.
        inner = [node for _, node, _, _ in blocks if roofs[id(node)] is not None and any(n.tag == "article" for n in _up(node))]
        kept = [
            text
            for kind, node, text, const in blocks
            if (roof := roofs[id(node)]) is not None
            and cleared(node, kind, roof)
            and (not inner or any(n.tag == "article" for n in _up(node)))
            and (not const or free[id(node)] or node.main)
        ]
        return "\n\n".join(kept)
    own: Counter[int] = Counter()
    whole: Counter[int] = Counter()
    parts: dict[int, Node] = {}
    open_blocks = [(node, text) for kind, node, text, const in blocks if not const and cleared(node, kind, None)]
    for node, text in open_blocks:
        part = node
        while part.tag in WITHIN_TEXT and part.parent is not None:
            part = part.parent
        own[part.path] += len(text)
        parts.setdefault(part.path, part)
        for path in {other.path for other in _up(node)}:
            whole[path] += len(text)
    if not own:
        return ""
    best = parts[max(own, key=own.__getitem__)]
    while (around := best.parent) is not None and around.tag not in ("body", "html"):
        if whole[around.path] > (1 + AROUND) * whole[best.path]:
            break
        best = around
    return "\n\n".join(text for node, text in open_blocks if node.within(best.path))


def _wrappers(page: list[tuple[str, Node, str]], slots: list[tuple[str, Node, str]]) -> set[int]:
    """Containers with a name for what is set aside that hold what the page is about.

    Outside an article that is every article, else every main part, or over half of the text in
    slots; inside one, where comments may be longer than the rest, all its text but headings.
    """
    opened = [node for kind, node, _ in page if kind == "open"]
    named = [node for node in opened if node.named]
    if not named:
        return set()

    def clear(node: Node) -> bool:
        return not any(other.aside for other in _up(node))

    def article_of(node: Node) -> Node | None:
        return next((other for other in _up(node.parent) if other.main and other.tag != "main"), None)

    mains = [node for node in opened if node.main and clear(node)]
    mains = [n for n in mains if n.tag != "main" and article_of(n) is None] or [n for n in mains if n.tag == "main"]
    held: Counter[int] = Counter(id(other) for node in mains for other in _up(node.parent))
    chars: Counter[int] = Counter()
    texts: Counter[int] = Counter()
    total = 0
    for kind, node, text in slots:
        if clear(node):
            total += len(text)
            for other in _up(node):
                chars[id(other)] += len(text)
                texts[id(other)] += kind == "text"
    found = set()
    for node in named:
        article = article_of(node)
        if article is not None:
            if 0 < texts[id(node)] == texts[id(article)]:
                found.add(id(node))
        elif 2 * chars[id(node)] > total or mains and held[id(node)] == len(mains):
            found.add(id(node))
    return found


def _up(node: Node | None) -> Iterator[Node]:
    while node is not None:
        yield node
        node = node.parent


def extract(pages: DataFrame, *, support: float = SUPPORT, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(page_id, url, text) per row of ``pages`` (page_id, url, html).

    A null html counts as empty and gives an empty text. Pages whose url is null or names
    no host are one host without a name. Repeated rows come out repeated; other columns are
    ignored. Templates are a written table, one row per host, joined to the pages by host:
    as a broadcast where its size is under the session's limit, else as a join that may be
    skewed by a large host, whose pages adaptive execution then splits.
    """
    spark = pages.sparkSession
    found = cut(templates(pages, support=support, least_pages=least_pages), "templates")

    @F.arrow_udf("string")
    def text_of_page(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for html, classes in batches:
            yield pa.array([main_text(page, known) for page, known in zip(html.to_pylist(), classes.to_pylist())], pa.string())

    bounded_batches(spark)
    rows = _hosted(pages).drop("page").join(found, "host", "left")
    return rows.select("page_id", "url", text_of_page("html", "classes").alias("text"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(read_table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
