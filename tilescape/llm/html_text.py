"""Main text of web pages by consensus on host paths.

Text belongs to a container: the outermost article or main element, else the nearest div, section, cell or body.
A page votes for the narrowest tag-class path at and beneath which its text outside of links and boilerplate stands,
with numbers in classes generalised; Spark counts the votes of each host, and of the host's winning paths the one that
holds most of a page's text decides what is extracted: every block at or beneath it. A page that has no text in any
of them uses its own path.

Defined results: a null or empty html, or one without text, gives an empty text; a null url votes for the empty
host; ties between paths go to the first in code point order; repeated rows are extracted alike; extra columns
are ignored; an empty table gives an empty result. Unclosed tags are closed where HTML implies it; of elements whose
content is not text, scripts, styles, titles and text areas without an end tag run to the end of the page, others to
the next block. Paths are numbered nodes of a tree, so that time and memory grow with a page's length alone,
however deep it is nested.
"""

from __future__ import annotations

import html as html_codec
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilescape.llm.common import Scratch, bound_batches, texts

_TAG = re.compile(r"<!--.*?(?:--!?>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*+)>|<[!?][^>]*>", re.DOTALL)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|itemprop)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/]|$)", re.IGNORECASE)

BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is not text of the page.
RAW = frozenset("script style noscript template iframe svg math object video audio canvas textarea title xmp noembed noframes".split())
#: Those that nothing but their own end tag ends.
SWALLOWING = frozenset("script style textarea title".split())
#: Elements that are never part of the main text.
BOILERPLATE_TAGS = frozenset("aside button dialog footer form head header menu nav option select".split())
#: Words of a class, an id or a role that mark boilerplate.
BOILERPLATE_WORDS = frozenset("ad ads advert advertisement advertising adverts alert banner bottombar breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disqus disclaimer footer form gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promoted recommended related replies reply respond search share sharing sidebar sidebars signup skip social sponsor sponsored subscribe tags toolbar topbar widget widgets".split())
#: Words after a marking word of a compound name that leave it the head: share-buttons, but not share-price.
PLACE_WORDS = frozenset("area bar block bottom box button buttons icon icons inner item items left link links list posts primary right secondary section top".split())
#: Names that begin so tell what a layout has, not what the element is.
STATE_WORDS = frozenset("has hide is no show with without".split())
#: Visitors' words, which may well be longer than the page's own.
DISCUSSION_WORDS = frozenset("comment comments disqus replies reply respond".split())
#: Marks of a word that hold this share of the page's text are no marks.
UNMARKING_SHARE = 0.9
CONTAINERS = frozenset("article main div section td body blockquote".split())
#: An open element of the key closes when one of the values starts.
IMPLIED_END = {"p": BLOCKS - {"html", "body"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot", "thead"}, "td": {"td", "th", "tr", "tbody"}, "th": {"td", "th", "tr", "tbody"}, "option": {"option"}, "head": {"body"}}
#: An element that keeps what is open outside of it open.
SCOPES = {"p": frozenset({"table", "td", "th", "button"}), "li": frozenset({"ul", "ol", "menu", "dir"}), "dt": frozenset({"dl"}), "dd": frozenset({"dl"}), "tr": frozenset({"table"}), "td": frozenset({"table"}), "th": frozenset({"table"}), "option": frozenset({"select"}), "head": frozenset()}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Share of a host's voting pages that a path needs to be one of its winning paths; the path with most votes always is.
WINNING_SHARE = 0.2
#: A page's path narrows to a child that holds this share of its text, but never past text of its own.
NARROWING_SHARE = 0.95
#: Bytes of hosts and their winning paths that are broadcast; longer lists meet the pages by a shuffle.
BROADCAST_BYTES = 32 << 20
_BLOCK_TAG = re.compile(rf"</?(?:{'|'.join(sorted(BLOCKS))})(?![A-Za-z0-9:-])", re.IGNORECASE)


@dataclass(slots=True)
class Element:
    tag: str
    path: int
    boilerplate: bool
    container: int  # generalised path of the container that text in here belongs to
    pinned: bool  # within an article or main element
    in_header: bool = False
    marks: tuple[tuple[int, str], ...] = ()  # (number, word) of the marked elements around and of this one
    pin: int = 0  # number of the article or main element around, 0 for none


@dataclass
class Page:
    """Blocks of text in page order: (text, number of the container's path, characters in links, within an article or
    main element). A path is a node of a tree: its parent, which has a smaller number, and its last step; 0 is the root."""

    blocks: list[tuple[str, int, int, bool]] = field(default_factory=list)
    parents: list[int] = field(default_factory=lambda: [0])
    steps: list[str] = field(default_factory=lambda: [""])
    numbers: dict[tuple[int, str], int] = field(default_factory=dict)

    def child(self, parent: int, step: str) -> int:
        found = self.numbers.setdefault((parent, step), len(self.steps))
        if found == len(self.steps):
            self.parents.append(parent)
            self.steps.append(step)
        return found

    def name(self, path: int) -> str:
        out = []
        while path:
            out.append(self.steps[path])
            path = self.parents[path]
        return "".join(f"/{x}" for x in reversed(out))

    def find(self, name: str) -> int | None:
        at: int | None = 0
        for step in name.split("/")[1:]:
            at = self.numbers.get((at, step))
            if at is None:
                return None
        return at

    def weights(self, pinned: bool = False) -> list[int]:
        """Text outside of links right in every path, of articles and main elements alone if ``pinned``."""
        found = [0] * len(self.steps)
        for text, path, linked, within in self.blocks:
            if (within or not pinned) and len(text) > 2 * linked:
                found[path] += len(text) - 2 * linked
        return found

    def beneath(self, own: list[int]) -> list[int]:
        """The sums of every path and all beneath it."""
        sums = list(own)
        for path in range(len(sums) - 1, 0, -1):
            sums[self.parents[path]] += sums[path]
        return sums

    def best(self) -> tuple[str, int] | None:
        """The narrowest path that holds the page's text outside of links, and that amount. Where articles and main
        elements hold half of the text, it is the path that holds theirs."""
        held, pinned = self.weights(), self.weights(pinned=True)
        if not any(held):
            return None
        if 2 * sum(pinned) >= sum(held):
            held = pinned
        sums = self.beneath(held)
        children: dict[int, list[int]] = defaultdict(list)
        for path in range(1, len(sums)):
            if sums[path]:
                children[self.parents[path]].append(path)
        at = 0
        while not held[at]:
            top = min(children[at], key=lambda x: (-sums[x], self.steps[x]))
            if sums[top] < NARROWING_SHARE * sums[0]:
                break
            at = top
        return self.name(at), sums[0]

    def text(self, winners: list[str]) -> str:
        sums, places = self.beneath(self.weights()), [self.find(w) for w in winners]
        amounts = [(w, at, sums[at]) for w, at in zip(winners, places, strict=True) if at is not None]
        most = max((n for _, _, n in amounts), default=0)
        if most:
            # of nested winners that hold as much the narrower one, then the one with more votes
            chosen = max(((w, at) for w, at, n in amounts if n >= NARROWING_SHARE * most), key=lambda x: x[0].count("/"))[1]
        elif own := self.best():
            chosen = self.find(own[0])
        else:
            there = [0] * len(sums)
            for _, path, _, _ in self.blocks:
                there[path] += 1
            there = self.beneath(there)
            chosen = next((at for _, at, _ in amounts if there[at]), None)
        if chosen is None:
            return ""
        inside = [False] * len(sums)
        for path in range(len(sums)):
            inside[path] = path == chosen or (path > 0 and inside[self.parents[path]])
        return "\n\n".join(t for t, path, _, _ in self.blocks if inside[path])


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html_codec.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(raw)} if raw.strip() else {}


def generalised(tag: str, attributes: dict[str, str]) -> str:
    # a slash in a class is no step of the path
    classes = sorted({re.sub(r"[0-9]+", "#", c.lower()).replace("/", "\\") for c in attributes.get("class", "").split()})
    return ".".join([tag, *classes])


def _hidden(attributes: dict[str, str]) -> bool:
    return attributes.get("aria-hidden", "").lower() == "true" or "hidden" in attributes


def _head(name: str) -> str:
    """The word that says what a compound name is the name of; empty if it tells of a state."""
    words = re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower())
    if len(words) > 1 and words[0] in STATE_WORDS:
        return ""
    while len(words) > 1 and words[-1] in PLACE_WORDS:
        words.pop()
    return words[-1] if words else ""


def _mark(tag: str, attributes: dict[str, str], in_article: bool) -> str:
    """The word that marks an element as boilerplate, or an empty text."""
    if tag in ("html", "body", "main") or tag in HEADINGS:
        return ""
    classes = attributes.get("class", "").split()
    names = [*classes, attributes.get("role", "")]
    if not (in_article and (tag == "section" or "section" in classes)):
        names.append(attributes.get("id", ""))
    if tag == "article":  # its classes often hold its subjects: category-search
        return next((n.lower() for n in names if n.lower() in BOILERPLATE_WORDS), "")
    return next((w for w in map(_head, names) if w in BOILERPLATE_WORDS), "")


def _unmarked(blocks: list[tuple], pins: dict[int, tuple]) -> list[tuple]:
    """The blocks outside of marked elements. A mark is void if it is of or around the page's only articles and main
    elements, or if those of its word hold nearly all of the text in them (in a page without any: of all text)."""
    if not any(b[4] for b in blocks):
        return blocks
    void: set[tuple[int, str]] = set()
    sizes: dict[int, int] = defaultdict(int)
    for b in blocks:
        if b[5]:
            sizes[b[5]] += len(b[0])
    if sizes and all(pins[p] for p in sizes):
        void.update(pins[max(sizes, key=lambda p: (sizes[p], -p))])
    base = [b for b in blocks if b[3]] or blocks
    total = sum(len(b[0]) for b in base)
    of: dict[str, int] = defaultdict(int)
    for b in base:
        for word in {w for n, w in b[4] if (n, w) not in void}:
            of[word] += len(b[0])
    words = {w for w, n in of.items() if n >= (1 if w in DISCUSSION_WORDS else UNMARKING_SHARE) * total}
    return [b for b in blocks if all(m in void or m[1] in words for m in b[4])]


def parse(source: str | None) -> Page:
    page = Page()
    if not source:
        return page
    stack = [Element("", 0, False, 0, False)]
    places: dict[str, list[int]] = defaultdict(list)  # where in the stack the open elements of a tag are
    endless: set[str] = set()  # tags without any more end tags
    held: list[str] = []
    linked = 0
    blocks: list[tuple] = []  # those of Page, the marks around and the article or main element
    pins: dict[int, tuple] = {}  # the marks around and of every article and main element
    number = 0

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join(html_codec.unescape("".join(held)).split())
            top = stack[-1]
            if text and not top.boilerplate:
                blocks.append((text, top.container, min(linked, len(text)), top.pinned, top.marks, top.pin))
            held.clear()
        linked = 0

    def push(element: Element) -> None:
        places[element.tag].append(len(stack))
        stack.append(element)

    def close(at: int) -> None:
        for e in reversed(stack[at:]):
            places[e.tag].pop()
        del stack[at:]

    last, n = 0, len(source)
    while last < n:
        m = _TAG.search(source, last)
        data = source[last : m.start() if m else n]
        if data:
            held.append(data)
            if places["a"] and not stack[-1].boilerplate:
                linked += len(data)
        if not m:
            break
        last = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if places[tag]:
                at = places[tag][-1]
                if any(e.tag in BLOCKS for e in stack[at:]):
                    flush()
                close(at)
            continue
        if tag in RAW:
            if not m[3].rstrip().endswith("/") or tag in SWALLOWING:
                end = None if tag in endless else re.compile(rf"</{tag}\b[^>]*>", re.IGNORECASE).search(source, last)
                if end:
                    last = end.end()
                else:
                    endless.add(tag)
                    block = None if tag in SWALLOWING else _BLOCK_TAG.search(source, last)
                    last = block.start() if block else n
            continue
        if tag == "br":
            held.append(" ")
            continue
        if tag in BLOCKS:
            flush()
        for open_tag, starters in IMPLIED_END.items():
            if tag in starters and places[open_tag]:
                at = places[open_tag][-1]
                if all(places[s][-1] < at for s in SCOPES[open_tag] if places[s]):
                    flush()
                    close(at)
        if tag in VOID:
            continue
        up = stack[-1]
        if tag not in BLOCKS and tag not in BOILERPLATE_TAGS and not m[3].strip():
            push(Element(tag, up.path, up.boilerplate, up.container, up.pinned, up.in_header, up.marks, up.pin))
            continue
        attributes = _attributes(m[3])
        in_article = up.pinned and not up.boilerplate
        # the header of an article holds its heading; a page's header is boilerplate
        inner_header = tag == "header" and in_article
        boilerplate = up.boilerplate or (tag in BOILERPLATE_TAGS and not inner_header) or (tag not in ("html", "body") and not inner_header and _hidden(attributes))
        if up.in_header and not up.boilerplate:
            boilerplate = boilerplate or (tag in BLOCKS and tag not in HEADINGS and tag not in ("div", "hgroup"))
        path, container, pinned = up.path, up.container, up.pinned
        marks, pin = up.marks, up.pin
        if not boilerplate and not inner_header and (word := _mark(tag, attributes, in_article)):
            number += 1
            # one mark a word is enough, but for those outside of the article, which it may make void
            if all(w != word for _, w in (marks[len(pins[pin]) :] if pin else marks)):
                marks = (*marks, (number, word))
        if tag in BLOCKS:
            path = page.child(up.path, generalised(tag, attributes))
            main = tag in ("article", "main") or attributes.get("role", "").lower() in ("main", "article") or attributes.get("itemprop", "").lower() == "articlebody"
            if main and not pinned:
                container, pinned = path, True
                pin = len(pins) + 1
                pins[pin] = marks
            elif tag in CONTAINERS and not pinned and tag != "blockquote":
                container = path
        push(Element(tag, path, boilerplate, container, pinned, up.in_header or inner_header, marks, pin))
    flush()
    page.blocks = [b[:4] for b in _unmarked(blocks, pins)]
    return page


def host_column(url: str = "url"):
    """Lower-case host: after the first ://, up to /, ?, # or the end; empty without it."""
    at = F.instr(F.col(url), "://")
    rest = F.expr(f"substring({url}, instr({url}, '://') + 3)")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.when(at > 0, F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), upper, lower)), F.lit(""))


def _vote(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        rows = [(h, b[0]) for h, t in zip(batch.column("host").to_pylist(), texts(batch, "html"), strict=True) if (b := parse(t).best())]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], names=["host", "path"])


def consensus(pages: DataFrame) -> DataFrame:
    """host, winners: the host's winning paths, most votes first, from pages with host and html."""
    counted = pages.select("host", "html").mapInArrow(_vote, "host string, path string").groupBy("host", "path").agg(F.count("*").alias("votes"))
    ranked = counted.withColumn("all", F.sum("votes").over(Window.partitionBy("host"))).withColumn("r", F.row_number().over(Window.partitionBy("host").orderBy(F.desc("votes"), "path")))
    won = ranked.where((F.col("r") == 1) | (F.col("votes") >= WINNING_SHARE * F.col("all")))
    return won.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "path"))), lambda x: x["path"]).alias("winners"))


def _extract(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        out = [parse(t).text(w or []) for t, w in zip(texts(batch, "html"), batch.column("winners").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages`` (page_id, url, html)."""
    bound_batches(spark, 256)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).withColumn("host", host_column())
    winners = Scratch(spark, "host_paths").table(consensus(pages), "winners")
    # a list of hosts grows with the crawl: below the bound it is broadcast, above it the pages meet it by host
    size = winners.agg(F.sum(F.octet_length("host") + F.aggregate("winners", F.lit(0), lambda n, w: n + F.octet_length(w)) + 64).alias("n")).first()["n"] or 0
    side = F.broadcast(winners) if size <= BROADCAST_BYTES else winners
    joined = pages.join(side, "host", "left").select("page_id", "url", "html", "winners")
    return joined.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
