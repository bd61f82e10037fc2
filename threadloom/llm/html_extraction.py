r"""Main text of web pages by the maximum-scoring run of tokens.

A page is a row of tokens: words, which score positive, and tags, which score negative. One scan finds
the contiguous region with the greatest sum; its text, without what is marked as something other than the
article inside it, is the result. Weights come from labelled pages: those that mark their own
article (``article``, ``main``, ``role=main``, ``itemprop=articleBody``) say of each of their tokens whether it is content. With
in and out the smoothed counts of a kind of token there, words of a kind weigh ``(in - out) / (in + out)`` and a
tag ``-TAG * out / (in + out)``; the marks themselves are no features, so the weights also serve pages without any. Words of menus and the like
(by element, ARIA role, class or id) weigh nothing, since they are left out anyway; the tags around them keep regions apart. Where a page marks its
article, words outside the mark weigh -1 and tags inside cost next to nothing.

Elements that are not the article: ``nav``, ``aside``, ``footer``, ``form``, ``dialog``, ``menu``, ``header`` (except headings of an article's own
header), hidden ones, ARIA landmarks for these, and a word of ``NOT_ARTICLE`` in class or id, which covers adverts,
notices, sidebars and reader comments. If all marked articles lie in such elements (a page wrapped in a form, a menu never closed), the elements around them count no longer.

Block elements separate blocks; ``br`` is white space, other inline elements nothing. Unclosed tags, comments and scripts reach to the end, as in browsers;
a ``<`` that begins no tag is text. Character references are decoded as HTML5 says (also without semicolon), white space by Unicode.

Defined cases: null and empty pages give an empty text, as do pages without words; very long pages are read whole in one pass, with memory for one page;
repeated rows give repeated results; ties between regions go to the first; an empty table gives an empty result; without labelled pages the
smoothing alone sets the weights; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bound_batches

#: Pages that weights are learned from, about; the others are read once only.
LABELLED_PAGES = 2000
#: The most that a tag costs.
TAG = 3.25
_SCALE = 1_000_000

# Names of HTML elements and words of class names.
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title iframe noembed noframes xmp".split())
#: Never text of a page.
NO_TEXT = RAW | set("head noscript template svg canvas audio video object select datalist button".split())
NOT_MAIN = set("nav aside footer form dialog menu search header".split())
HEADINGS = {f"h{k}" for k in range(1, 7)}
ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist".split())
NOT_ARTICLE = set(
    "ad ads advert adverts advertisement advertisements advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr header "
    "login masthead menu menubar modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promoted promotion recommendations recommended related "
    "replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar trackback trackbacks widget widgets".split()
)
_WITHOUT = {"has", "with", "no", "not", "is", "without"}
_PLAIN_TEXT = HEADINGS | set("p br b i em strong u s small span blockquote pre code sub sup mark cite q abbr time".split())
_KNOWN = BLOCK | VOID | RAW | NO_TEXT | _PLAIN_TEXT | {"a"}
#: An end tag that may be left out: a new element of these names ends the open one, within these.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*+)>""")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_PART = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+")
_MARKUP = re.compile(r"<(?=[a-zA-Z!?/])")


def lex(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes): text, open and end tags; comments and the insides of raw elements are left out."""
    at, end = 0, len(page)
    while at < end:
        found = _MARKUP.search(page, at)
        if found is None:
            yield "text", page[at:], ""
            return
        lt = found.start()
        if lt > at:
            yield "text", page[at:lt], ""
        if page.startswith("<!--", lt):
            if page.startswith((">", "->"), lt + 4):
                at = page.index(">", lt) + 1
                continue
            close = page.find("-->", lt + 4)
            at = end if close < 0 else close + 3
            continue
        tag = _TAG.match(page, lt)
        if tag is None:
            after = page[lt + 2 : lt + 3] if page.startswith("</", lt) else page[lt + 1 : lt + 2]
            if after.isascii() and after.isalpha():
                return  # a tag that never ends
            close = page.find(">", lt)
            at = end if close < 0 else close + 1
            continue
        name = tag[2].lower()
        at = tag.end()
        yield ("end" if tag[1] else "open"), name, tag[3]
        if not tag[1] and name in RAW:
            close = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            at = end if close is None else close.start()


def _attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), html.unescape(next(filter(None, values), "")))
    return found


def _named_otherwise(value: str) -> bool:
    """Whether a class or id names something other than an article."""
    for token in value.split():
        parts = [p.lower() for p in _PART.findall(token)]
        if parts and parts[0] not in _WITHOUT and not NOT_ARTICLE.isdisjoint(parts):
            return True
    return False


@dataclass
class _Element:
    name: str
    parent: int
    #: Why its text is not the article's: "" (it is), "none" (never text), "other" (by name, role, class or id).
    out: str = ""
    mark: bool = False
    in_article: bool = False


@dataclass
class Page:
    """A page's tokens: (element, tag name or "", text or "", words); the elements that they lie in."""

    tokens: list[tuple[int, str, str, int]] = field(default_factory=list)
    elements: list[_Element] = field(default_factory=lambda: [_Element("", -1)])

    def _judged(self, name: str, attributes: str, parent: int) -> _Element:
        made = _Element(name, parent, in_article=self.elements[parent].in_article)
        if name in NO_TEXT:
            made.out = "none"
            return made
        a = _attributes(attributes) if attributes else {}
        role = a.get("role", "").lower()
        if name in ("article", "main") or role == "main" or "articlebody" in a.get("itemprop", "").lower():
            made.mark = made.in_article = True
            if name == "article" and _named_otherwise(f"{a.get('class', '')} {a.get('id', '')}"):
                made.out, made.mark = "other", False
        elif name not in ("html", "body"):
            hidden = "hidden" in a or a.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", a.get("style", ""), re.I)
            if hidden or name in NOT_MAIN or role in ROLES or _named_otherwise(f"{a.get('class', '')} {a.get('id', '')}"):
                made.out = "other"
        return made

    def resolve(self) -> tuple[list[bool], list[bool]]:
        """Of each element: whether its own text is left out, and whether it lies in a mark that counts."""
        elements = self.elements
        out = [False] * len(elements)

        def spread() -> list[bool]:
            for i, e in enumerate(elements):
                inside = e.parent >= 0 and out[e.parent]
                heading = e.name in HEADINGS and inside and self._in_own_header(i)
                out[i] = e.out != "" or (inside and not heading)
            return out

        spread()
        marks = [i for i, e in enumerate(elements) if e.mark]
        if marks and all(out[i] for i in marks):
            freed: set[int] = set()
            for i in marks:
                at = elements[i].parent
                while at > 0 and at not in freed:
                    freed.add(at)
                    if elements[at].out == "other":
                        elements[at].out = ""
                    at = elements[at].parent
            spread()
        inside = [False] * len(elements)
        for i, e in enumerate(elements):
            inside[i] = (e.mark and not out[i]) or (e.parent >= 0 and inside[e.parent])
        return out, inside

    def _in_own_header(self, i: int) -> bool:
        """Whether a heading is left out only for the header element of its article, directly around it or its groups."""
        at = self.elements[i].parent
        while at > 0 and self.elements[at].name in ("hgroup", "div") and self.elements[at].out == "":
            at = self.elements[at].parent
        e = self.elements[at]
        return e.name == "header" and e.in_article


def parse(page: str) -> Page:
    """Tokens of a page in order, each with the innermost element around it; one pass, missing end tags as in browsers."""
    made = Page()
    stack = [0]
    places: dict[str, list[int]] = {}

    def close(depth: int) -> None:
        while len(stack) > depth:
            places[made.elements[stack.pop()].name].pop()

    for kind, value, attributes in lex(page):
        if kind == "text":
            made.tokens.append((stack[-1], "", value, len(value.split())))
            continue
        if kind == "open":
            if value in BLOCK and places.get("p") and places["p"][-1] == len(stack) - 1:
                close(len(stack) - 1)
            if value in _ENDS:
                ended, within = _ENDS[value]
                last = max((places[n][-1] for n in ended if places.get(n)), default=-1)
                if last > max((places[n][-1] for n in within if places.get(n)), default=-1):
                    close(last)
            made.tokens.append((stack[-1], value, "", 0))
            if value not in VOID:
                made.elements.append(made._judged(value, attributes, stack[-1]))
                places.setdefault(value, []).append(len(stack))
                stack.append(len(made.elements) - 1)
        else:
            if places.get(value):
                close(places[value][-1])
            made.tokens.append((stack[-1], value, "", 0))
    return made


def _kind(tag: str) -> str:
    return tag if tag in _KNOWN else "other"


def kinds(page: Page, out: list[bool]) -> list[tuple[str, bool]]:
    """The kind of every token (a tag's name, or ``#word``, ``#link``, ``#out``) and whether its words count."""
    links = [False] * len(page.elements)
    for i, e in enumerate(page.elements):
        links[i] = e.name == "a" or (e.parent >= 0 and links[e.parent])
    return [(_kind(tag), False) if tag else ("#out" if out[el] else "#link" if links[el] else "#word", True) for el, tag, _, _ in page.tokens]


def _smoothing(kind: str) -> tuple[float, float]:
    """Counts in and out of the content that a kind of token has before any page is seen."""
    if kind == "#word" or kind in _PLAIN_TEXT:
        return 45.0, 5.0
    if kind in ("li", "td", "th", "figure", "figcaption", "a"):
        return 25.0, 25.0
    return 15.0, 35.0


@dataclass(frozen=True)
class Weights:
    """Scores of words by kind (positive for plain ones) and of tags (negative)."""

    counts: dict[str, tuple[int, int]] = field(default_factory=dict)

    def of(self, kind: str) -> float:
        if kind == "#out":
            return 0.0
        seen, missed = self.counts.get(kind, (0, 0))
        a, b = _smoothing(kind)
        inside, outside = a + seen, b + missed
        if kind == "#word":
            return max((inside - outside) / (inside + outside), 0.01)
        if kind == "#link":
            return (inside - outside) / (inside + outside)
        return -TAG * outside / (inside + outside)


def label(page: str) -> Counter:
    """Of a page that marks its article: how many tokens of each kind lie inside and outside of it, keyed (kind, inside)."""
    parsed = parse(page)
    out, inside = parsed.resolve()
    if not any(inside):
        return Counter()
    found: Counter = Counter()
    for (kind, is_text), (el, tag, _, n) in zip(kinds(parsed, out), parsed.tokens, strict=True):
        if not (tag and tag in ("article", "main")):
            found[kind, inside[el]] += n if is_text else 1
    return found


def region(scores: list[float]) -> tuple[int, int]:
    """First and last index (exclusive) of the first contiguous run with the greatest sum; empty if none is positive."""
    best, total, start, found = 0.0, 0.0, 0, (0, 0)
    for i, s in enumerate(scores):
        if total <= 0.0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, found = total, (start, i + 1)
    return found


def main_text(page: str | None, weights: Weights) -> str:
    """The main text of one page, a block a line."""
    if not page:
        return ""
    parsed = parse(page)
    out, inside = parsed.resolve()
    marked = any(inside)
    weigh: dict[str, float] = {}
    scores = []
    for (kind, is_text), (el, _, _, n) in zip(kinds(parsed, out), parsed.tokens, strict=True):
        if marked and inside[el]:
            scores.append((0.0 if kind == "#out" else float(n)) if is_text else -1e-9)
        elif marked and is_text:
            scores.append(-float(n))
        else:
            if kind not in weigh:
                weigh[kind] = weights.of(kind)
            scores.append(weigh[kind] * n if is_text else weigh[kind])
    first, last = region(scores)
    blocks: list[str] = []
    parts: list[str] = []

    def end_block() -> None:
        if words := " ".join("".join(parts).split()):
            blocks.append(words)
        parts.clear()

    for el, tag, text, _ in parsed.tokens[first:last]:
        if tag in BLOCK:
            end_block()
        elif tag == "br":
            parts.append(" ")
        elif not tag and not out[el] and (inside[el] or not marked):
            parts.append(html.unescape(text))
    end_block()
    return "\n".join(blocks)


def fit(pages: DataFrame, about: int = LABELLED_PAGES) -> Weights:
    """Weights from a sample of about so many pages, by a hash of page_id and url; only counts of kinds reach the driver."""
    total = pages.count()
    share = min(_SCALE, max(1, about * _SCALE // max(total, 1)))
    sample = pages.filter(F.pmod(F.xxhash64("page_id", "url"), F.lit(_SCALE)) < share).select("html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for value in batch.column(0):
                found.update(label(value.as_py() or ""))
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.string()), pa.array([i for _, i in found], pa.bool_()), pa.array(list(found.values()), pa.int64())], names=["kind", "inside", "n"])

    rows = sample.mapInArrow(run, "kind string, inside boolean, n long").groupBy("kind").agg(*(F.sum(F.when(c, F.col("n")).otherwise(0)) for c in (F.col("inside"), ~F.col("inside")))).collect()
    return Weights({r[0]: (r[1], r[2]) for r in rows})


def extract(pages: DataFrame, weights: Weights) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    bound_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut in range(0, batch.num_rows, 256):
                part = batch.slice(cut, 256)
                texts = [main_text(value.as_py(), weights) for value in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
