"""Main-text extraction by the maximum-scoring subsequence.

A page is a sequence of tags and text blocks.  Every word scores by its
block's context, every tag costs; one linear scan finds the contiguous region
of the largest sum.  Scores are learned from labelled pages: a bounded sample
(``SAMPLE_PAGES`` different pages at most, by smallest hash, the shorter ones of
``SAMPLE_HTML_BYTES`` first) of pages whose markup names their article (one
``article`` or ``main`` element) -- words and tags inside are content, the
others are not; what stands in furniture teaches nothing, since it is left out by
what it is (a link in a menu says nothing of a link in a paragraph).  Without
labelled pages every word scores 1.

The region is completed to whole ``article`` or ``main`` elements at both ends,
and within it blocks inside menus, headers, footers, sidebars, notices, adverts,
forms and comments are left out.  A form, or an element named like a widget, that
holds more than half of the page's words is the page and no furniture.

Blocks: character references are decoded, white space becomes one space,
inline markup (``b``, ``a``, ...) does not part words.

The tokenizer is linear in the page, however malformed: no position is looked at
again for a ``<`` that failed for the same reason before.

Defined results: null or empty html, or a page without content words, gives an
empty text; repeated rows are extracted each; an empty table gives an empty
result; a character reference without a character is U+FFFD.
"""

from __future__ import annotations

import html as htmllib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logvigil.llm.textkit import parts

SAMPLE_PAGES = 400
SAMPLE_HTML_BYTES = 1 << 16

# ---- fixed values: HTML's element kinds and usual names of page furniture
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data dfn em font i ins del kbd label mark q "
                   "s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|noscript|template|textarea|title|iframe"
#: elements whose inside is not the page's text (nor counts as tags), and the start tags that end
#: those whose end tag is missing
EMBEDDED = frozenset("head svg select object canvas".split())
HEAD_TAGS = frozenset("head base link meta basefont bgsound".split())
FLOW = frozenset("address article aside blockquote body center details div dl fieldset figure footer form "
                 "h1 h2 h3 h4 h5 h6 header li main menu nav ol p pre section table ul".split())
FURNITURE = frozenset("nav footer aside form dialog menu button fieldset".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert".split())
FURNITURE_NAMES = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie "
    "cookies disqus footer header masthead menu modal nav navbar navigation newsletter notice notices "
    "popup promo related replies share sharing sidebar social sponsor sponsored subscribe toolbar "
    "widget".split())
SITE_WORDS = frozenset("site main global primary secondary top bottom".split())
APART = frozenset("nav aside footer menu dialog".split())  # an article in one is a teaser or the like
#: furniture that may turn out to be the page itself, by what it holds
WEAK_TAGS = frozenset("form fieldset button".split())
WEAK_NAMES = frozenset("widget related notice notices banner promo social header masthead popup modal sponsor "
                       "sponsored".split())
LINK_BLOCKS = frozenset("li div td ul body".split())  # a link there is likely one of a list of them
# ----

NO, WEAK, LOOSE, FIRM = range(4)  # furniture: not, maybe, by a name or the like, by an element of APART

MAX_TAG_COST, LINK_COST, TAG_COST = 0.5, 1.0, 0.1

TAG_NAME = re.compile(r"[A-Za-z][^\s/>\"'<=]*+")
RAW_TAGS = frozenset(RAW.split("|"))
RAW_END = {t: re.compile(rf"</{t}\s*+>", re.I) for t in RAW_TAGS}
SPECIAL = re.compile(r"[>\"']")
ANGLE = re.compile("[<>]")
LONG_NUMBER = re.compile(r"&#(0*+)([0-9]*+);?")


class _Scanner:
    """Tokens of a page: (start, end, kind, tag, attributes); kind "start", "end",
    "raw" (an element of raw text, whole) or "skip" (comments and the like).

    Looking for a tag's ``>`` outside quotes from many places must not take
    quadratic time: the next quote or ``>`` is kept from search to search, and a
    quote from which no ``>`` is reached is remembered."""

    def __init__(self, page: str):
        self.page = page
        self.special = (0, -1)        # searched from, found at
        self.no_end: set[int] = set()
        self.last_gt = page.rfind(">")
        self.last_comment_end = page.rfind("-->")

    def _next_special(self, at: int) -> int:
        """Place of the next quote or >, or the page's length."""
        lo, hi = self.special
        if not lo <= at <= hi:
            m = SPECIAL.search(self.page, at)
            self.special = (at, m.start() if m else len(self.page))
        return self.special[1]

    def _tag_end(self, at: int) -> int:
        """Place of the > that ends a tag whose attributes start at ``at``, or -1."""
        page, seen = self.page, []
        while True:
            j = self._next_special(at)
            if j == len(page) or j in self.no_end:
                break
            if page[j] == ">":
                return j
            seen.append(j)
            close = page.find(page[j], j + 1)
            if close < 0:
                break
            at = close + 1
        self.no_end.update(seen)
        return -1

    def tokens(self) -> Iterator[tuple[int, int, str, str, str]]:
        page, at = self.page, 0
        while True:
            i = page.find("<", at)
            if i < 0 or i > self.last_gt and not page.startswith("<!--", i):
                return
            if page.startswith("<!--", i):
                end = page.find("-->", i + 4) + 3 if i + 4 <= self.last_comment_end else len(page)
                yield i, end, "skip", "", ""
                at = end
                continue
            closing = page.startswith("/", i + 1)
            m = TAG_NAME.match(page, i + 1 + closing)
            if m is None:
                if page[i + 1:i + 2] in ("!", "?", "/"):
                    end = page.find(">", i) + 1
                    yield i, end, "skip", "", ""
                    at = end
                else:
                    at = i + 1
                continue
            j = self._tag_end(m.end())
            if j < 0:
                near = ANGLE.search(page, m.end())
                if near and near[0] == ">":  # quotes that do not close: a tag nevertheless
                    yield i, near.end(), "skip", "", ""
                    at = near.end()
                else:
                    at = i + 1
                continue
            tag = m[0].lower()
            if tag in RAW_TAGS and not closing:
                end = RAW_END[tag].search(page, j + 1)
                at = end.end() if end else len(page)
                yield i, at, "raw", tag, ""
                continue
            yield i, j + 1, "end" if closing else "start", tag, page[m.end():j]
            at = j + 1


def decode(text: str) -> str:
    """Character references; numbers beyond any character are U+FFFD."""
    def short(m: re.Match) -> str:
        if len(m[0]) <= 12:
            return m[0]
        return f"&#{m[2] or 0};" if len(m[2]) <= 8 else "\ufffd"

    return htmllib.unescape(LONG_NUMBER.sub(short, text) if "&#" in text else text)


ATTR = re.compile(r"([^\s\"'>/=][^\s>/=]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NO_ELEMENT = ("", "", NO, 0, False, None)
NAME_PARTS = re.compile(r"[A-Za-z]+")


def _named(token: str) -> str:
    """The name of furniture that a class or id holds, or '': by its first word
    ('ad-slot', not 'has-sidebar' or 'page-header-fixed'), which a word of
    SITE_WORDS may precede."""
    words = NAME_PARTS.findall(token[:80])
    if words and words[0] in FURNITURE_NAMES:
        return words[0]
    return words[1] if len(words) == 2 and words[0] in SITE_WORDS and words[1] in FURNITURE_NAMES else ""


def _names(attrs: str) -> tuple[str, bool, bool]:
    """(first class, whether the attributes name page furniture, whether only
    weakly so)."""
    if not attrs.strip("/ "):
        return "", False, False
    own: dict[str, str] = {}
    for m in ATTR.finditer(attrs):
        own.setdefault(m[1].lower(), next((v for v in m.groups()[1:] if v is not None), ""))
    words = own.get("class", "").lower().split()
    firm = "hidden" in own or own.get("aria-hidden", "").strip().lower() == "true" \
        or own.get("role", "").strip().lower() in FURNITURE_ROLES - {"form"}
    names = {n for n in map(_named, words + own.get("id", "").lower().split()) if n}
    if own.get("role", "").strip().lower() == "form":
        names.add("widget")
    return words[0] if words else "", bool(firm or names), not firm and names <= WEAK_NAMES


class _Items(list):
    """Items in page order: ("tag", name, context, in furniture) and ("text",
    context, text, number of the article element or 0, in furniture)."""

    articles = 0
    #: words of each weak furniture element by its start, and of the page
    held: dict[int, int]
    words = 0


def parse(page: str) -> list[tuple]:
    """The items of a page.  What is said of the elements around it does not
    make a main furniture; nor an article, if all of the page's articles would
    be; nor, without any, a form or the like around most of the page's words."""
    items = _parse(page, False, frozenset())
    inside = [it[4] for it in items if it[0] == "text" and it[3]]
    if all(inside) and "<article" in page.lower():
        return _parse(page, True, frozenset())
    if inside:
        return items
    whole = frozenset(i for i, n in items.held.items() if 2 * n > items.words)
    return _parse(page, False, whole) if whole else items


def _parse(page: str, keep_articles: bool, whole: frozenset) -> _Items:
    items = _Items()
    items.held = {}
    # tag, context, furniture, article, embedded, weak (start, words before) or None
    stack: list[tuple] = []
    open_: Counter = Counter()     # open elements by tag
    embedded_at: list[int] = []    # places of embedded elements in the stack
    foreign = 0                    # open foreignobject elements within one
    text_parts: list[str] = []
    counted = 0                    # words so far, but for those surely in furniture

    def cut(to: int) -> None:
        nonlocal foreign
        for e in stack[to:]:
            open_[e[0]] -= 1
            foreign -= e[0] == "foreignobject" and e[4]
            if e[5] is not None:
                items.held[e[5][0]] = counted - e[5][1]
        del stack[to:]
        while embedded_at and embedded_at[-1] >= to:
            embedded_at.pop()

    def flush() -> None:
        nonlocal counted
        text = " ".join(decode("".join(text_parts)).split())
        text_parts.clear()
        if text and stack and stack[-1][0] == "head":
            cut(len(stack) - 1)
        top = stack[-1] if stack else NO_ELEMENT
        if text and not top[4]:
            if top[2] < LOOSE:
                counted += len(text.split())
            items.append(("text", top[1], text, top[3], top[2] > NO))

    def tag_item(tag: str) -> None:
        top = stack[-1] if stack else NO_ELEMENT
        items.append(("tag", tag, top[0], top[2] > NO))

    at = 0
    for begin, end, kind, tag, attrs in _Scanner(page).tokens():
        text_parts.append(page[at:begin])
        at = end
        if kind in ("raw", "skip"):
            if kind == "raw":
                text_parts.append(" ")
            continue
        if embedded_at and kind == "start":
            first = embedded_at[0]
            if stack[first][0] == "head" and tag not in HEAD_TAGS \
                    or stack[first][0] in ("svg", "select") and tag in FLOW and not foreign:
                flush()
                cut(first)
        counts = not embedded_at
        if tag in INLINE:
            if counts:
                tag_item(tag)
            continue
        if tag == "br":
            text_parts.append(" ")
            if counts:
                tag_item(tag)
            continue
        flush()
        if tag in EMBEDDED:
            counts = False
        if counts:
            tag_item(tag)
        if kind == "end":
            if open_[tag] > 0:
                cut(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag))
            continue
        if tag in VOID or attrs.rstrip().endswith("/"):
            continue
        if tag == "p" and stack and stack[-1][0] == "p" or tag == "li" and stack and stack[-1][0] == "li":
            cut(len(stack) - 1)  # their end tags are optional
        first_class, named, weakly = _names(attrs)
        top = stack[-1] if stack else NO_ELEMENT
        article = top[3]
        if not article and tag in ("article", "main"):
            items.articles += 1
            article = items.articles
        out, embedded = top[2], top[4] or tag in EMBEDDED
        if not top[3] and (tag == "main" or tag == "article" and keep_articles and out < FIRM):
            out, embedded = NO, False
        weak = None
        # a header belongs to the article if it stands in one
        if tag in FURNITURE or tag == "header" and not top[3] \
                or named and tag not in ("article", "main", "body", "html"):
            if (tag in WEAK_TAGS or tag not in FURNITURE and tag != "header") and (not named or weakly):
                weak = (begin, counted)
            if weak is None or begin not in whole:
                out = max(out, FIRM if tag in APART else LOOSE if weak is None else WEAK)
        if embedded and not embedded_at:
            embedded_at.append(len(stack))
        foreign += tag == "foreignobject" and embedded
        open_[tag] += 1
        stack.append((tag, f"{tag}.{first_class}" if first_class else tag, out, article, embedded, weak))
    text_parts.append(page[at:])
    flush()
    cut(0)
    items.words = counted
    return items


def learn(pages: list[str]) -> dict | None:
    """Word scores by context and tag costs by (context, tag): bounded log-odds
    of standing in the article, from what is no furniture."""
    words = {True: Counter(), False: Counter()}
    tags = {True: Counter(), False: Counter()}
    used = 0
    for page in pages:
        if len(re.findall(r"<(?:article|main)\b", page, re.I)) != 1:
            continue
        items, inside = parse(page), False
        used += 1
        for it in items:
            if it[0] == "text":
                inside = bool(it[3])
                if not it[4]:
                    words[inside][it[1]] += len(it[2].split())
            elif it[1] not in ("article", "main") and not it[3]:
                tags[inside][it[2], it[1]] += 1
    if not used:
        return None

    def odds(c, name):
        return math.log((c[True][name] + 1) / (c[False][name] + 1))

    return {"words": {n: max(-3.0, min(3.0, odds(words, n))) for n in {*words[True], *words[False]}},
            "tags": {n: -max(0.02, min(MAX_TAG_COST, -odds(tags, n))) for n in {*tags[True], *tags[False]}}}


def tag_score(model: dict | None, tag: str, context: str) -> float:
    """What a tag costs; one not seen in its context costs by a prior."""
    known = model["tags"].get((context, tag)) if model else None
    if known is not None:
        return known
    return -LINK_COST if tag == "a" and context in LINK_BLOCKS else -TAG_COST


def best_region(scores: list[float]) -> tuple[int, int]:
    """[start, end) of the contiguous run of the largest sum (the first and
    longest of equals), empty if no sum is positive."""
    best, region, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best or (total == best and region[0] == start and best > 0):
            best, region = total, (start, i + 1)
    return region


def whole_articles(items: list[tuple], a: int, b: int) -> tuple[int, int]:
    """The region with the articles at its ends made whole."""
    touched = [it[3] for it in items[a:b] if it[0] == "text" and it[3] and not it[4]]
    if not touched:
        return a, b
    low, high = touched[0], touched[-1]
    at = [i for i, it in enumerate(items) if it[0] == "text" and it[3] in (low, high)]
    return min(a, at[0]), max(b, at[-1] + 1)


def extract(page: str | None, model: dict | None) -> str:
    items = parse(page or "")
    words = model["words"] if model else {}
    scores = []
    for it in items:
        if it[0] == "tag":
            scores.append(tag_score(model, it[1], it[2]))
        elif it[4]:  # furniture is never content: its words cost
            scores.append(-0.1 * len(it[2].split()))
        else:
            scores.append(words.get(it[1], 1.0) * len(it[2].split()))
    a, b = whole_articles(items, *best_region(scores))
    return " ".join(it[2] for it in items[a:b] if it[0] == "text" and not it[4])


def fit(pages: DataFrame, key: str = "page_id", html: str = "html",
        sample_pages: int = SAMPLE_PAGES) -> dict | None:
    """Learn from a bounded sample: equal pages count once, however often they
    or their key repeat, and each task keeps its own smallest draws, so no more
    than ``sample_pages`` texts reach the driver; where pages are longer than
    ``SAMPLE_HTML_BYTES``, their first bytes are read."""
    h = F.col(html).cast("string")
    drawn = pages.where(h.isNotNull()).select(
        (F.octet_length(h) > SAMPLE_HTML_BYTES).alias("_long"), F.xxhash64(h, F.lit("draw")).alias("_u"), h.alias("_h"))
    # hashes first, so that only the sample's own pages are read on
    wanted = drawn.select("_long", "_u").distinct().orderBy("_long", "_u").limit(sample_pages).collect()
    if not wanted:
        return None
    rows = drawn.where(F.col("_u").isin([r["_u"] for r in wanted])) \
        .groupBy("_long", "_u").agg(F.first(F.substring("_h", 1, SAMPLE_HTML_BYTES)).alias("_h"))
    return learn([r["_h"] for r in rows.orderBy("_long", "_u").collect()])


def extract_pages(pages: DataFrame, model: dict | None, key: str = "page_id", url: str = "url",
                  html: str = "html") -> DataFrame:
    """Rows (key, url, text, n_chars)."""
    shared = pages.sparkSession.sparkContext.broadcast(model)
    src = pages.select(F.col(key), F.col(url), F.col(html).cast("string").alias("_page_html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in parts(batches):
            texts = [extract(p, m) for p in b.column("_page_html").to_pylist()]
            yield pa.RecordBatch.from_pydict({
                key: b.column(key), url: b.column(url), "text": pa.array(texts, pa.string()),
                "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:2])
    return src.mapInArrow(run, kinds + ", text string, n_chars long")
