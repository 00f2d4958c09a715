"""HTML extraction by equivalence-class template deduction.

Pages of one host share templates. Each page is cut into tokens: elements, told apart by
their path from the root, and text blocks with their element. The occurrence vector of a
token says how often it occurs on each page of the host; tokens with equal vectors form an
equivalence class, and classes of several tokens on several pages are valid. Elements of
valid classes that occur once a page nest, by their paths, into the host's templates; what
lies between them are slots. From the root down, the slots that hold the text which varies
from page to page lead to the article's; text that recurs and slots full of links are left
out. Only pages of hosts with too few pages for recurrence, or in which no article slot is
met, are judged by their own markup.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import blake2b
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changefold.llm.common import broadcast_if_small, saved

#: A class needs so many tokens, on so many pages and on this share of the host's pages (which
#: bounds a template by the length of 50 pages). Text recurs if it is on so many pages and on this
#: share of those that have its element, more than a group of near copies is likely to hold.
MIN_TOKENS, MIN_PAGES, PAGE_SHARE, TEXT_PAGES, TEXT_SHARE = 2, 3, 0.02, 4, 0.8
#: A slot is one of the article's if it holds this share of the largest slot's text; a slot
#: with this share of its text in links is a menu.
SLOT_SHARE, LINK_SHARE = 0.1, 0.7
#: Bytes of templates, and hosts whose page counts, that may be broadcast.
MOST_BYTES, MOST_HOSTS = 64 << 20, 1_000_000
#: Elements without class are told apart by their place among equals, up to this one.
PLACES = 8

QUOTED = r"(?:\"[^\"]*\"(?=[\s/>])|'[^']*'(?=[\s/>])|[^'\">])*"
RAW = "script|style|noscript|template|textarea|title|iframe|svg|select|canvas|audio|video|annotation|annotation-xml"
# a tag whose quotes don't close ends at the first ">"
MARKUP = re.compile(
    rf"<!--.*?(?:-->|$)|<({RAW})\b(?:{QUOTED}|[^>]*)>.*?(?:</\1\s*>|$)"
    rf"|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)({QUOTED}(?=>)|[^>]*)(?:>|$)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
#: Tags inside a block of text.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Opening one of these closes an open one of the same group.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
#: Elements that lay out a page, and so are told apart by place if they have no class.
LAYOUT = frozenset("div section table tbody tr td center main article header".split())
OUTSIDE_TAGS = frozenset("nav footer aside form menu dialog button fieldset head".split())
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar status toolbar tablist".split())
#: Names of classes and ids, for pages that no template covers.
OUTSIDE_NAMES = frozenset(
    "nav navbar navigation menu menus submenu footer foot sidebar sidebars aside rail ad ads adv advert adverts advertisement advertisements advertising adbox adsense adslot sponsor sponsored promo promos promotion banner "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login search searchbox comment comments commentlist comments-area disqus respond reply replies "
    "share sharing social related recommended breadcrumb breadcrumbs pagination pager pagenav widget widgets toolbar skip form masthead topbar".split()
)
#: Names that only as a whole tell an element outside.
OUTSIDE_WHOLE = frozenset("comment-list comment-section comments-section comment-form comment-respond comments-wrapper related-posts related-articles related-links social-links social-share share-buttons share-links cookie-bar nav-links menu-item footer-widgets footer-links footer-inner widget-area ad-slot ad-container ad-wrapper ad-unit".split())
#: A name that begins so tells what the element has, not what it is.
WRAPPERS = frozenset("with without has no is not hide show".split())
CONTENT_NAMES = frozenset("content article main post entry story".split())
#: Outside even if its name has a word of CONTENT_NAMES or it holds an article.
NEVER = frozenset("comment comments commentlist comments-area comment-list comment-section comments-section comments-wrapper ad ads".split())

#: Kinds of tokens.
PAGE, ELEMENT, TITLE, ROOT, TEXT = range(5)


class Element(NamedTuple):
    """An element of a page: the key of its path, its parent's place in the page's list, its
    tag, its role (main, or the tag), its kind, and what tells that it never holds the article:
    strong signs are its tag, role or state, weak ones its class or id."""

    key: int
    parent: int
    tag: str
    role: str
    kind: int
    sign: str
    strong: bool


class Block(NamedTuple):
    """A run of text between tags that are not inline."""

    element: int
    text: str
    links: int


def _attributes(text: str) -> dict[str, str]:
    return {k.lower(): unescape(v.strip("\"'")) for k, v in ATTRIBUTE.findall(text)}


def _outside(tag: str, attributes: dict[str, str], in_article: bool) -> tuple[str, bool]:
    """What tells that an element never holds the article, empty if nothing does, and whether
    that is more than a name. Of class and id, a whole name or its last word counts."""
    if tag in OUTSIDE_TAGS or attributes.get("role", "").lower() in OUTSIDE_ROLES:
        return tag, True
    if "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return "hidden", True
    if tag == "header":
        return ("", False) if in_article else (tag, False)
    if tag in ("html", "body", "article", "main") or tag in INLINE:
        return "", False
    words: set[str] = set()
    found: set[str] = set()
    for name in (y for k in ("class", "id") for y in attributes.get(k, "").lower().split()):
        parts = [x for x in re.split(r"[^a-z0-9]+", name) if x]
        words.update(parts)
        if name in OUTSIDE_WHOLE:
            found.add(name)
        elif parts and parts[0] not in WRAPPERS:
            found |= {name, parts[-1]}
    never, found_outside = found & NEVER, found & (OUTSIDE_NAMES | OUTSIDE_WHOLE)
    if never:
        return min(never), True
    if found_outside and not words & CONTENT_NAMES:
        return min(found_outside), False
    return ("header", False) if "header" in found and not words & CONTENT_NAMES and not in_article else ("", False)


@lru_cache(maxsize=1 << 16)
def _key(parent: int, label: str) -> int:
    """64 bits of a digest of a path, built from its parent's."""
    return int.from_bytes(blake2b(b"%d/%s" % (parent, label.encode("utf-8", "replace")), digest_size=8).digest(), "big", signed=True)


def _mark(element: int, text: str) -> int:
    """The token of a text block: 64 bits of a digest of its element's path and its text."""
    return int.from_bytes(blake2b(b"%d=%s" % (element, text.encode("utf-8", "replace")), digest_size=8).digest(), "big", signed=True)


class Page:
    """Elements that are not inline and text blocks of a page, in order."""

    def __init__(self, html: str | None):
        self.elements: list[Element] = [Element(0, -1, "", "", ROOT, "", False)]
        self.blocks: list[Block] = []
        stack = [0]
        places: list[Counter] = [Counter()]
        pending: list[str] = []
        in_article = [False]
        links, link_depth = 0, 0
        html = html or ""

        def flush() -> None:
            nonlocal links
            text = " ".join(unescape("".join(pending)).split())
            pending.clear()
            if text:
                self.blocks.append(Block(stack[-1], text, min(links, len(text))))
            links = 0

        def leave(depth: int) -> None:
            nonlocal link_depth
            del stack[depth:], places[depth:], in_article[depth:]
            if link_depth > depth:
                link_depth = 0

        at = 0
        for m in MARKUP.finditer(html):
            if m.start() > at:
                pending.append(html[at : m.start()])
                if link_depth:
                    links += m.start() - at
            at = m.end()
            tag = (m[3] or "").lower()
            if not tag:
                continue
            if tag == "a":
                link_depth = 0 if m[2] else len(stack)
            if tag in INLINE and not m[2] and tag not in VOID:
                attributes = _attributes(m[4]) if m[4] and m[4].strip() else {}
                if not ("hidden" in attributes or attributes.get("aria-hidden") == "true"):
                    continue
            elif tag in INLINE:
                if tag == "br":
                    pending.append(" ")
                if not any(self.elements[x].tag == tag for x in stack[1:]):
                    continue
            flush()
            if m[2]:
                for k in range(len(stack) - 1, 0, -1):
                    if self.elements[stack[k]].tag == tag:
                        leave(k)
                        break
                continue
            while len(stack) > 1 and self.elements[stack[-1]].tag in CLOSES.get(tag, ()):
                leave(len(stack) - 1)
            top = self.elements[stack[-1]].tag
            if (top == "p" and tag not in INLINE) or (top == "head" and tag == "body"):
                leave(len(stack) - 1)  # a block ends an open paragraph
            attributes = _attributes(m[4]) if m[4] else {}
            parent = stack[-1]
            label = ".".join([tag, *sorted(attributes.get("class", "").split())])
            if label in LAYOUT:
                places[-1][label] += 1
                label = f"{label}[{min(places[-1][label], PLACES)}]"
            sign, strong = _outside(tag, attributes, in_article[-1])
            kind = TITLE if tag == "h1" else ROOT if tag in ("html", "body") else ELEMENT
            role = "main" if attributes.get("role") == "main" else tag
            self.elements.append(Element(_key(self.elements[parent].key, label), parent, tag, role, kind, sign, strong))
            if tag in VOID or m[4].rstrip().endswith("/"):
                continue
            stack.append(len(self.elements) - 1)
            places.append(Counter())
            in_article.append(in_article[-1] or role in ("article", "main"))
        pending.append(html[at:] if not html[at:].lstrip().startswith("<") else "")
        flush()

    def tokens(self) -> dict[int, tuple]:
        """Per token: (parent's token, kind, sign, times, characters of text in it, those of
        them in links, place). Elements that can't hold text are left out."""
        chars, links = [0] * len(self.elements), [0] * len(self.elements)
        for b in self.blocks:
            chars[b.element] += len(b.text)
            links[b.element] += b.links
        for i in range(len(self.elements) - 1, 0, -1):
            chars[self.elements[i].parent] += chars[i]
            links[self.elements[i].parent] += links[i]
        found: dict[int, tuple] = {}

        def add(token: int, parent: int, kind: int, sign: int, n: int, linked: int, place: int) -> None:
            old = found.get(token)
            found[token] = (parent, kind, sign, 1, n, linked, place) if old is None else (parent, kind, max(sign, old[2]), old[3] + 1, old[4] + n, old[5] + linked, old[6])

        for i, e in enumerate(self.elements[1:], 1):
            if e.tag not in VOID:
                add(e.key, self.elements[e.parent].key, e.kind, 1 + e.strong if e.sign else 0, chars[i], links[i], i)
        for b in self.blocks:
            parent = self.elements[b.element].key
            add(_mark(parent, b.text), parent, TEXT, 0, len(b.text), b.links, b.element)
        return found

    def fingerprint(self) -> int:
        """A fingerprint of elements and texts in order; the address and what is no token don't count."""
        whole = ",".join([*(str(e.key) for e in self.elements), *(f"{b.element}={b.text}" for b in self.blocks)])
        return int.from_bytes(blake2b(whole.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)

    def slots(self, content: frozenset[int], template: frozenset[int], menus: frozenset[int]) -> str:
        """The text in the article's slots, without elements inside that are outside by strong
        signs (by weak ones too, where the slot is the whole body or most of their text is links),
        and without what recurs around what varies.

        Recurring text between two varying blocks of a slot is the article's, as headings are. Before
        the first and after the last one it goes, unless it is in elements like those that vary and makes up most of the text in these: then
        the host's pages are near copies.
        """
        # of each element: its slot, whether that is the whole body, and whether it stays
        state = [(0, False, True)]
        for i, e in enumerate(self.elements[1:], 1):
            slot, whole, stays = state[e.parent]
            if e.key in content:
                slot, whole, stays = slot or i, e.kind == ROOT, True
            elif slot and stays:
                stays = not (e.sign and (e.strong or whole or e.key in menus))
            state.append((slot, whole, stays))
        slots: dict[int, list[Block]] = {}
        for b in self.blocks:
            slot, _, stays = state[b.element]
            if slot and stays:
                slots.setdefault(slot, []).append(b)
        kept: list[Block] = []
        for blocks in slots.values():
            varies = [_mark(self.elements[b.element].key, b.text) not in template for b in blocks]
            if not any(varies):
                continue
            first, last = varies.index(True), len(varies) - 1 - varies[::-1].index(True)
            like = {self.elements[b.element].key for b, v in zip(blocks, varies, strict=True) if v}
            alike = [(len(b.text), v) for b, v in zip(blocks, varies, strict=True) if self.elements[b.element].key in like]
            copies = 2 * sum(n for n, v in alike if not v) > sum(n for n, _ in alike)
            kept += [b for k, b in enumerate(blocks) if first <= k <= last or (copies and self.elements[b.element].key in like)]
        return "\n\n".join(b.text for b in kept)

    def text(self) -> str:
        """The article as the page's own markup tells it."""
        elements = self.elements
        role = {kind: [i for i, e in enumerate(elements) if e.role == kind] for kind in ("article", "main")}

        def down(start: bool, step: Callable[[bool, int], bool]) -> list[bool]:
            """A value for each element, from its parent's."""
            out = [start]
            for i in range(1, len(elements)):
                out.append(step(out[elements[i].parent], i))
            return out

        def signs_around(starts: list[int]) -> set[int]:
            """The elements around that tell themselves outside."""
            found, seen = set(), set()
            for i in starts:
                while i > 0 and i not in seen:
                    seen.add(i)
                    if elements[i].sign:
                        found.add(i)
                    i = elements[i].parent
            return found

        # What holds the main element is not outside, unless hidden; what holds an article is
        # not if no other article is left, and then the text beside that article stays as well.
        open_ = down(True, lambda up, i: up and elements[i].sign not in NEVER | {"hidden"})
        held = signs_around([i for i in role["main"] if open_[i]])
        free = down(True, lambda up, i: up and (not elements[i].sign or i in held))
        beside: set[int] = set()
        if not any(free[i] for kind in role for i in role[kind]):
            beside = signs_around([i for i in role["article"] if open_[i]])
            free = down(True, lambda up, i: up and (not elements[i].sign or i in held or i in beside))
        loose = down(False, lambda up, i: up or i in beside)
        article, main = (down(False, lambda up, i, k=kind: up or elements[i].role == k) for kind in role)
        inside = [b for b in self.blocks if free[b.element]]
        whole = sum(len(b.text) for b in inside)
        for part in ([b for b in inside if article[b.element] and not loose[b.element]], [b for b in inside if main[b.element]]):
            # a teaser beside the story doesn't stand for it
            if part and 3 * sum(len(b.text) for b in part) >= whole:
                inside = part
                break
        return "\n\n".join(b.text for b in inside)


def host_of(url: Column) -> Column:
    """Lower-cased host of an address, empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


TOKENS = pa.schema([
    ("host", pa.string()), ("page", pa.int64()), ("token", pa.int64()), ("parent", pa.int64()), ("kind", pa.int8()), ("sign", pa.int8()),
    ("times", pa.int32()), ("chars", pa.int32()), ("links", pa.int32()), ("place", pa.int32()),
])


def page_tokens(pages: DataFrame) -> DataFrame:
    """The tokens of each page, and one of kind PAGE for the page itself, with a fingerprint
    of the page."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                rows: list[tuple] = []
                for host, html in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    page = Page(html)
                    mark = page.fingerprint()
                    rows.append((host, mark, 0, 0, PAGE, 0, 1, 0, 0, 0))
                    rows += [(host, mark, token, *cells) for token, cells in page.tokens().items()]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), TOKENS, strict=True)], schema=TOKENS)

    schema = "host string, page long, token long, parent long, kind tinyint, sign tinyint, times int, chars int, links int, place int"
    return pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(convert, schema)


def deduce(rows: list[dict]) -> tuple[list[int], list[int], list[int]]:
    """(content, template, menus) of a host from its tokens of valid support.

    ``content``: elements that hold the article, and titles beside them. ``template``: texts
    that recur. ``menus``: elements most of whose text is in links.
    """
    sizes = Counter((r["vector"], r["support"]) for r in rows)
    tokens = {r["token"]: r for r in rows if sizes[(r["vector"], r["support"])] >= MIN_TOKENS}
    elements = {t: r for t, r in tokens.items() if r["kind"] != TEXT}
    support = {r["token"]: r["support"] for r in rows}
    texts = [r for r in tokens.values() if r["kind"] == TEXT and r["support"] >= TEXT_PAGES]
    fixed = [r for r in texts if r["support"] >= TEXT_SHARE * support.get(r["parent"], r["support"])]
    # characters of recurring text below each element, added up from the last to the first
    recurs: Counter = Counter()
    for r in fixed:
        recurs[r["parent"]] += r["chars"] - r["links"]
    varies: dict[int, int] = {}
    for t, r in sorted(elements.items(), key=lambda x: -x[1]["place"]):
        recurs[r["parent"]] += recurs[t]
        varies[t] = r["chars"] - r["links"] - recurs[t]
    mean = {t: max(0, varies[t]) / elements[t]["support"] for t in elements}
    menus = {t for t, r in elements.items() if r["chars"] and r["links"] >= LINK_SHARE * r["chars"]}
    # the nested template: elements that occur once a page, in page order
    nested: dict[int, list[int]] = {}
    for t, r in sorted(elements.items(), key=lambda x: (x[1]["place"], x[0])):
        if r["most"] == 1 and t not in menus:
            nested.setdefault(r["parent"], []).append(t)
    content: list[int] = []
    titles: list[int] = []
    tried = [0]
    while tried:
        at = tried.pop()
        inner = nested.get(at, [])
        own = (mean[at] if at in mean else 0) - sum(mean[t] for t in inner)
        largest = max([own, *(mean[t] for t in inner)])
        parts = [t for t in inner if mean[t] > 0 and mean[t] >= SLOT_SHARE * largest]
        parts = [t for t in parts if not elements[t]["sign"]] or parts
        whole = at == 0 or elements[at]["kind"] == ROOT
        together = len({(elements[t]["vector"], elements[t]["support"]) for t in parts}) == 1
        if at in elements and mean[at] > 0 and ((own > 0 and own >= SLOT_SHARE * largest) or (len(parts) > 1 and together and not whole)):
            content.append(at)
            continue
        titles += [t for t in inner if elements[t]["kind"] == TITLE and t not in parts and mean[t] > 0]
        tried += parts
    return content + titles if content else [], [r["token"] for r in fixed], sorted(menus - set(content))


def templates(pages: DataFrame) -> DataFrame:
    """(host, content, template, menus): the templates of each host, as ``deduce`` gives them.

    Copies of a page count once, whatever their addresses: their tokens are equal rows, so
    that the pages themselves need no shuffle. An occurrence vector is held as its support and
    the exclusive or of hashes of (page, times), which sums up before the shuffle. The pages
    of a host never meet in one task; what does are its tokens of valid support, which
    PAGE_SHARE bounds by the length of a few pages.
    """
    tokens = page_tokens(pages.select("url", "html")).distinct()
    sums = {c: F.sum(F.col(c).cast("long")).alias(c) for c in ("chars", "links")}
    vectors = tokens.groupBy("host", "token").agg(
        F.count("*").alias("support"), F.bit_xor(F.xxhash64("page", "times")).alias("vector"), F.max("times").alias("most"),
        *[F.max(c).alias(c) for c in ("parent", "kind", "sign")], *sums.values(), F.min("place").alias("place"),
    )
    vectors = saved(vectors.filter(F.col("support") >= MIN_PAGES), "html-vectors")
    size = vectors.filter(F.col("kind") == PAGE).select(F.col("host").alias("_host"), F.col("support").alias("pages"))
    size = broadcast_if_small(saved(size, "html-hosts"), MOST_HOSTS)
    vectors = vectors.filter(F.col("kind") != PAGE).join(size, F.col("host") == F.col("_host"))
    vectors = vectors.filter(F.col("support") >= PAGE_SHARE * F.col("pages")).drop("_host", "pages")
    names = [c for c in vectors.columns if c != "host"]
    hosts = vectors.groupBy("host").agg(F.collect_list(F.struct(*names)).alias("tokens"))

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = pa.list_(pa.int64())
        for batch in batches:
            found = [deduce(rows) for rows in batch.column(1).to_pylist()]
            columns = [pa.array([f[k] for f in found], many) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["host", "content", "template", "menus"])

    schema = "host string, content array<long>, template array<long>, menus array<long>"
    return hosts.mapInArrow(convert, schema).filter(F.size("content") > 0)


def extract_pages(pages: DataFrame) -> DataFrame:
    """The main text of every page: page_id, url, text, n_chars (its code points).

    One row per input row. Null and empty html give an empty text; a null url has an empty
    host of its own; pages of hosts with less than MIN_PAGES distinct pages, and pages that
    have none of their host's article slots, are judged by their own markup; copies of a page
    give the same text; extra columns are left out. Character references are decoded, white
    space inside a block becomes one space, blocks are joined by two line feeds.
    """

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                texts = []
                for html, *sets in zip(*(c.to_pylist() for c in part.columns[2:]), strict=True):
                    page = Page(html)
                    text = page.slots(*map(frozenset, sets)) if sets[0] else ""
                    texts.append((text or page.text()).encode("utf-8", "replace").decode())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:2], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"],
                )

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host_of(F.col("url")).alias("_h"))
    deduced = saved(templates(pages), "html-templates")
    cells = F.size("content") + F.size("template") + F.size("menus") + 8
    if (deduced.agg(F.sum(cells)).collect()[0][0] or 0) * 8 <= MOST_BYTES:
        deduced = F.broadcast(deduced)
    # beyond that the join is a plain shuffle, in which Spark splits the pages of a hot host
    rows = rows.join(deduced, F.col("_h") == F.col("host"), "left")
    return rows.select("page_id", "url", "html", "content", "template", "menus").mapInArrow(convert, "page_id long, url string, text string, n_chars long")
