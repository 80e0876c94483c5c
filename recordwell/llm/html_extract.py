"""Main text of web pages by consensus paths of a host.

Each page's containers are scored by the text they hold and how little else; the best ones vote
for their generalised path (tags and first classes, digits folded) among the pages of the
host. Then every page is extracted again from the elements on the host's winning path, or
from its own best container where the page has no such element or no text there.

Defined results: a null or empty html, or one without main text, gives an empty text; a null URL,
or one without ://, belongs to the host ''. Repeated rows vote as often as they come and get equal
texts. Equal votes go to the least path. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..deploy import ship
from .shared import sized, written
from .url_trust import host_of

#: Characters of text that a worker holds before it hands a batch on.
FLUSH = 8 << 20

#: How HTML elements are treated.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("article blockquote body div main section td".split())
RAW = frozenset("iframe noembed noframes noscript script style textarea title xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ASIDE = frozenset("aside button canvas datalist dialog footer form head header menu nav object select svg template".split())
ASIDE_WORDS = frozenset("ad ads advert advertisement advertising adverts alert banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted recommended related respond share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split())
#: In one name with such words an aside word says what stands beside: has-sidebar, layout-with-menu.
BESIDE_WORDS = frozenset("has layout no with without".split())
ASIDE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu navigation search".split())
CONTENT_WORDS = frozenset("article articlebody body content entry main post story text".split())
CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table"))}

_start = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*))")
#: The rest of a tag whose quotes are closed before any other tag begins.
_plain = re.compile(r"""[^<>"']*+(?:(?:"[^"<>]*+"|'[^'<>]*+')[^<>"']*+)*+>""")
_mark = re.compile("""[>"']""")
_attribute = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_words = re.compile(r"[a-z]+")
_digits = re.compile(r"\d+")
_ends = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


class Element:
    """An open or closed element; `block` and `container` are the nearest such ones, itself included."""

    __slots__ = ("tag", "parent", "depth", "aside", "inside", "headed", "block", "container", "above", "name", "content", "good", "raw")

    def __init__(self, tag: str, parent: Element | None, attributes: str):
        self.tag, self.parent, self.content, self.good, self.raw = tag, parent, False, 0, 0
        found = {k.lower(): a or b or c for k, a, b, c in _attribute.findall(attributes)} if attributes else {}
        classes = found.get("class", "").lower()
        self.depth = parent.depth + 1 if parent else 0
        self.inside = bool(parent) and (parent.inside or parent.tag in ("article", "main"))
        self.headed = tag == "header" or bool(parent) and parent.headed
        self.aside = bool(parent and parent.aside) or self._is_aside(tag, classes, found)
        self.block = self if tag in BLOCKS or not parent else parent.block
        self.above = parent.container if parent else None
        self.container = self if tag in CONTAINERS else self.above
        self.name = tag
        if tag in CONTAINERS:
            if first := classes.split()[:1]:
                self.name = f"{tag}.{_digits.sub('N', first[0]).replace('>', '')}"
            self.content = not CONTENT_WORDS.isdisjoint(_words.findall(f"{classes} {found.get('id', '')} {found.get('itemprop', '')}".lower()))

    def path(self) -> str:
        """The names of the containers from the body down."""
        names, at = [], self.container
        while at.above:
            names.append(at.name)
            at = at.above
        return "".join(f">{n}" for n in reversed(names))

    @property
    def main(self) -> bool:
        """Whether text right within it is main text; a header within the article keeps its headings only."""
        return not self.aside and (self.tag in HEADINGS or not self.headed)

    def _is_aside(self, tag: str, classes: str, found: dict[str, str]) -> bool:
        if tag in ("html", "body", "main"):
            return False
        names = [set(_words.findall(n)) for n in (*classes.split(), *found.get("id", "").lower().split())]
        if tag == "article":
            return any(not n.isdisjoint(("comment", "comments")) for n in names)
        if tag in ASIDE and not (tag == "header" and self.inside):
            return True
        if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower():
            return True
        if found.get("role", "").lower() in ASIDE_ROLES:
            return True
        return any(self._names_aside(n, self.inside) for n in names)

    @staticmethod
    def _names_aside(words: set[str], inside: bool) -> bool:
        """Whether one class name or id speaks of an aside; an article's own header is none."""
        hit = words & ASIDE_WORDS
        if hit <= {"header", "masthead"} and (inside or not words.isdisjoint(("article", "entry", "post", "story"))):
            return False
        return bool(hit) and words.isdisjoint(BESIDE_WORDS)


class Tags:
    """The tags of a page, one after the other, in time linear in the page.

    A tag ends at the first `>` outside quotes; where a quote is never closed, at the first one. Places from which a search ran into
    such a quote are remembered, so no stretch is searched twice in vain.
    """

    def __init__(self, html: str):
        self.html, self.last = html, html.rfind(">")
        self.quotes = {q: html.rfind(q) for q in "\"'"}
        self.dead: set[int] = set()

    def end(self, at: int) -> int:
        """The place of the `>` that ends a tag whose name ends at `at`; there is one behind it."""
        if m := _plain.match(self.html, at):
            return m.end() - 1
        passed, place = [], at
        while place not in self.dead and (m := _mark.search(self.html, place)):
            if m[0] == ">":
                return m.start()
            passed.append(place)
            if m.start() >= self.quotes[m[0]]:
                break
            place = self.html.index(m[0], m.end()) + 1
        self.dead.update(passed)
        return self.html.index(">", at)

    def after(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """(start, end, whether it ends an element, name, attributes) of the next tag; comments and declarations have no name."""
        while m := _start.search(self.html, at):
            start, at = m.start(), m.end()
            if m[0] == "<!--":
                end = self.html.find("-->", at)
                return start, len(self.html) if end < 0 else end + 3, False, "", ""
            if at <= self.last:
                end = self.end(at) if m[2] else self.html.index(">", at)
                return start, end + 1, bool(m[1]), (m[2] or "").lower(), self.html[at:end]
            at = start + 1
        return None


def blocks(html: str) -> list[tuple[Element, str, int]]:
    """The page's blocks in order: innermost open element that is a block, text, characters of it within links."""
    root = Element("body", None, "")
    stack, out, held, links = [root], [], [], 0
    standing: defaultdict[str, list[int]] = defaultdict(list)  # the depths of the open elements of each tag

    def flush() -> None:
        nonlocal links
        if held:
            text = " ".join("".join(held).split())
            if text:
                out.append((stack[-1].block, text, min(links, len(text))))
            held.clear()
            links = 0

    def add(text: str) -> None:
        nonlocal links
        if text:
            text = unescape(text) if "&" in text else text
            held.append(text)
            if standing.get("a"):
                links += len(text)

    def close(k: int) -> None:
        for e in stack[k:]:
            standing[e.tag].pop()
        del stack[k:]

    def nearest(names: tuple[str, ...]) -> int:
        return max((standing[n][-1] for n in names if standing.get(n)), default=0)

    at, end, tags = 0, len(html), Tags(html)
    while at < end:
        m = tags.after(at)
        if not m:
            rest = html[at:]
            cut = rest.rfind("<")
            add(rest[:cut] if cut >= 0 and re.match(r"<[a-zA-Z/!?]", rest[cut:]) else rest)
            break
        start, until, ends, tag, attributes = m
        add(html[at:start])
        at = until
        if not tag:
            continue
        if ends:
            block = tag in BLOCKS
            if block:
                flush()
            least = 1 if block else max(1, stack[-1].block.depth + 1)  # no inline end reaches beyond its block
            if (k := nearest((tag,))) >= least:
                close(k)
            continue
        if tag in RAW:
            ended = _ends[tag].search(html, at)
            at = html.index(">", ended.end()) + 1 if ended and ended.end() <= tags.last else end
            continue
        if tag in ("html", "body"):
            flush()
            continue
        if tag == "br":
            held.append(" ")
        if tag in BLOCKS:
            flush()
            if stack[-1].block.tag == "p":  # an open paragraph ends here
                close(stack[-1].block.depth)
        if tag in CLOSES:
            names, bounds = CLOSES[tag]
            if (k := nearest(tuple(names.split()))) > nearest(bounds):
                close(k)
        if tag in VOID or attributes.endswith("/") and tag not in BLOCKS:
            continue
        standing[tag].append(len(stack))
        stack.append(Element(tag, stack[-1], attributes))
    flush()
    return out


def containers(page: list[tuple[Element, str, int]]) -> list[Element]:
    """The containers that hold text, each after those that it stands in."""
    seen: dict[int, Element] = {}
    for at, _, _ in page:
        c = at.container
        while c and id(c) not in seen:
            seen[id(c)] = c
            c = c.above
    return sorted(seen.values(), key=lambda c: c.depth)


def scored(page: list[tuple[Element, str, int]]) -> list[tuple[float, Element]]:
    """Containers, best first, the outer of equals first: the square of their main text over all that they hold."""
    for at, text, links in page:
        at.container.good += max(0, len(text) - 2 * links) if at.main else 0
        at.container.raw += len(text)
    found = containers(page)
    for c in reversed(found):
        if c.above:
            c.above.good += c.good
            c.above.raw += c.raw
    bonus = {"article": 2.0, "main": 1.3, "body": 0.9}
    rated = [(e.good**2 / (e.raw + 1) * bonus.get(e.tag, 1.0) * (1.1 if e.content else 1.0), e) for e in found if e.good]
    return sorted(rated, key=lambda x: -x[0])


def text_within(page: list[tuple[Element, str, int]], roots: list[Element]) -> str:
    within = {id(r) for r in roots}
    for c in containers(page):
        if c.above and id(c.above) in within:
            within.add(id(c))
    return "\n\n".join(text for at, text, _ in page if at.main and id(at.container) in within)


def on_path(page: list[tuple[Element, str, int]], path: str) -> list[Element]:
    """The containers whose path is `path`."""
    names = path.split(">")[1:]
    matched: dict[int, int] = {}  # how many of the names lead to a container
    out = []
    for c in containers(page):
        if c.above is None:
            matched[id(c)] = 0
        elif (k := matched.get(id(c.above), -1)) >= 0 and k < len(names) and names[k] == c.name:
            matched[id(c)] = k + 1
        if matched.get(id(c)) == len(names):
            out.append(c)
    return out


def main_text(html: str | None, path: str | None = None) -> str:
    """The page's text from the elements on `path`, else from its best container, else all of it but the asides."""
    page = blocks(html or "")
    if path is not None and (text := text_within(page, on_path(page, path))):
        return text
    best = scored(page)
    return text_within(page, [best[0][1]]) if best else "\n\n".join(text for at, text, _ in page if at.main)


def votes(html: str | None, most: int = 3) -> list[tuple[str, float]]:
    """The paths a page votes for: its best containers, by their share of the best one's score."""
    best = scored(blocks(html or ""))[:most]
    return list({e.path(): s / best[0][0] for s, e in reversed(best)}.items())


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, path): each host's winner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: dict[tuple[str, str], float] = {}
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for path, vote in votes(html.as_py()):
                    total[host, path] = total.get((host, path), 0.0) + round(vote, 3)
            keys = list(total)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([round(1000 * total[k]) for k in keys], pa.int64())], ["host", "path", "vote"])

    cast = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(run, "host string, path string, vote long")
    tally = cast.groupBy("host", "path").agg(F.sum("vote").alias("vote"))
    return tally.groupBy("host").agg(F.min_by("path", F.struct(-F.col("vote"), F.col("path"))).alias("path"))


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each page."""
    ship(pages.sparkSession)
    winners = sized(written(host_paths(pages), "host-paths"))  # voted once, then counted and joined
    asked = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host")).join(winners, "host", "left").select("page_id", "url", "path", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, texts, size = 0, [], 0
            for k, (path, html) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3), strict=True), 1):
                texts.append(main_text(html.as_py(), path))
                size += len(texts[-1])
                if size >= FLUSH or k == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, k - low), batch.column(1).slice(low, k - low), pa.array(texts, pa.string())], ["page_id", "url", "text"])
                    low, texts, size = k, [], 0

    kind = asked.schema["page_id"].dataType.simpleString()
    return asked.mapInArrow(run, f"page_id {kind}, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
