"""Main text of web pages by two-pass block rules (operator 9).

One linear scan over the whole HTML cuts it into blocks: block tags end a block,
tags inside a line don't. Each block keeps its text, how much of it is link
text, and what encloses it.

Pass 1 weighs each block by itself. Long blocks gain by stop words (LOW and HIGH
shares of their words) and lose by having none; link text loses. What encloses a
block is a feature among these: an article adds a point, standing outside the
article of a page that marks one takes two, and menus, headers, footers,
sidebars, adverts, notices, forms and comments are boilerplate whatever they
hold. Two points are good text, a negative sum is boilerplate, and everything
between, short blocks above all, stays undecided. Where no long block of a page
has the LOW share of listed stop words, its language isn't listed, and length
stands in for them.

Pass 2 gives each undecided block the label of its nearest decided neighbours:
the side on which both agree, else the nearer one (ties: good). A heading takes
the label of the first decided block after it. Inside an article only the
blocks decided there by their words count as neighbours, as its edge is further
away than any of them; where there is none the article's own label, good, is the
nearest.

An article that is itself a comment, or that a marked element encloses, is
doubtful: a layout wrapper looks the same as a list of comments. It counts if
it is longer than all the good text less doubtful than it, and never takes
points from text outside it. Likewise class words that layouts use, too, count
for nothing on a page where they would leave no good text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit
from .runtime import mapped, table

GOOD, BAD, OPEN = 1, -1, 0
SHORT_WORDS, LINKS, SOME_LINKS, STOP_LOW, STOP_HIGH = 10, 0.4, 0.2, 0.12, 0.25

# Tags by what they do to blocks.
_DROPPED = frozenset("script style noscript template svg math iframe object canvas head select option button textarea".split())
_HEAD = frozenset("html head title meta link base style script noscript template".split())  # what a head holds; anything else ends it
_RAW = frozenset("script style textarea title noscript iframe template".split())
_OUTSIDE = frozenset("nav header footer aside form dialog menu".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_ARTICLE = frozenset(("article", "main"))
# Words of class, id and role names that mark what isn't article text.
_MARKED = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert|adverts|advertisement|advertising|sponsor|sponsored|promo|promoted|nav|navbar|navigation|menu|breadcrumb|breadcrumbs|sidebar|footer|masthead|cookie|cookies|consent|gdpr|notice|notices|popup|modal|subscribe|newsletter|comment|comments|respond|disqus|replies|related|recommended|login|signup|pagination|pager|complementary|contentinfo)(?=$|[\s_-])", re.I)
# Words of the same kind that layouts use for wrappers of the whole page, too.
_WEAK = re.compile(r"(?:^|[\s_-])(?:alert|banner|header|search|share|sharing|side|skip|social|widget)(?=$|[\s_-])", re.I)
# Frequent function words of the four languages.
STOP_WORDS = frozenset("a an and are as at be by for from he in is it of on or she that the this to was were which with you i not have has had but they we his her its will would there their been if so no der die das und ist in den von zu mit sich des auf für nicht ein eine als auch es an werden aus er hat dass sie nach bei um am im dem einer le la les des de du et est un une que qui en pour dans sur au pas par avec ce il elle ne se plus son sa aux el los las y que en un una por con no su para es al lo como más del se".split())

_OPEN = re.compile(r"<(?:(!--)|[!?]|(/?)([a-zA-Z][^\s/>]*))")
_STOPS = re.compile(r"[>\"']")
_MARKS = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
# Names that say what a wrapper has or lacks ("has-sidebar"), and an article's name that is a mark as a whole ("comment", "comment-12").
_WITH = re.compile(r"(?:^|[_-])(?:has|with|no|without)[_-]", re.I)
_WHOLE = re.compile(r"(?:[^\s_-]+)(?:-\d+)?")
_SPACE = re.compile(r"[\s ]+")
_END = {n: re.compile(rf"<(/?){n}(?=[\s/>])", re.I) for n in _RAW}
_RAW_END = {n: re.compile(rf"</{n}\s*>", re.I) for n in _RAW}
# Elements that end, without an end tag, where one of these begins.
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th", "tr"), "th": ("td", "th", "tr"), "tr": ("tr",), "p": ("div", "ul", "ol", "table", "section", "article", "aside", "nav", "header", "footer", "form", "blockquote", "pre", "hr", "main", "figure", "dl")}


class Block:
    __slots__ = ("parts", "linked", "outside", "weak", "article", "heading", "label", "text", "doubt", "which")

    def __init__(self, outside: bool = False, weak: bool = False, article: bool = False, heading: bool = False, doubt: int = 0, which: int = 0):
        self.parts: list[str] = []
        self.linked = 0
        self.outside, self.weak, self.article, self.heading = outside, weak, article, heading
        self.doubt, self.which = doubt, which  # marks on and around its article, and that article's number
        self.label = OPEN
        self.text = ""


def _names(attributes: str) -> list[str]:
    return [w for x in _MARKS.findall(attributes) for w in (x[0] or x[1] or x[2]).split() if not _WITH.search(w)]


def _marked(attributes: str) -> int:
    """2 for a name that marks what isn't article text, 1 for one that a layout may have as well, else 0."""
    names = _names(attributes)
    return 2 if any(_MARKED.search(w) for w in names) else int(any(_WEAK.search(w) for w in names))


def _comment(attributes: str) -> bool:
    """Whether an article's own name says that it is none; words within a name ("comments-open") don't."""
    return any(_WHOLE.fullmatch(w) and (_MARKED.search(w) or _WEAK.search(w)) for w in _names(attributes))


def tags(page: str, skip: list[int]) -> Iterator[tuple[int, int, str, bool, str]]:
    """Begin, end, name (empty for comments and declarations), whether it closes, and attributes of each tag in order.

    A quote opens a value only after `=`, and only if it is closed where a value
    may end; else the tag ends at the next `>`. A tag that nothing ends takes the
    rest of the page. The scan goes on at skip[0] if that is further. Linear: what
    is looked for ahead is remembered until the scan has passed it.
    """
    ahead: dict[str, int] = {}

    def find(what: str, at: int) -> int:
        """The next place, or the page's length."""
        if ahead.get(what, -1) < at:
            k = page.find(what, at)
            ahead[what] = len(page) if k < 0 else k
        return ahead[what]

    at = 0
    while m := _OPEN.search(page, max(at, skip[0])):
        begin, at = m.span()
        if m[3] is None:
            at = min(len(page), find("-->", at) + 3 if m[1] else find(">", at) + 1)
            yield begin, at, "", False, ""
            continue
        values = at
        while True:
            k = _STOPS.search(page, at)
            if k is None or page[k.start()] == ">":
                stop = at = len(page) if k is None else k.start()
                break
            q, before = k.start(), k.start()
            while before > at and page[before - 1].isspace():
                before -= 1
            at = q + 1
            if before > values and page[before - 1] == "=":
                close = find(page[q], at)
                if close < len(page) and (close + 1 == len(page) or page[close + 1] in " \t\r\n\f/>"):
                    at = close + 1
                else:
                    stop = at = find(">", at)
                    break
        at = min(len(page), at + 1)
        yield begin, at, m[3].lower(), bool(m[2]), page[values:stop]


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order, those without text left out."""
    out: list[Block] = []
    stack: list[tuple] = []  # open block tags: name, and what holds inside them
    opened: dict[str, int] = {}  # how many of a name are on the stack
    none = ("", False, False, 0, 0, 0, 0, False)  # outside, article, doubt, number of the article, marks and weak marks since, in an <article>
    articles = 0
    outside = weak = article = heading = False
    doubt = which = 0
    links = 0
    dropped: list[tuple[str, int]] = []  # open elements without text of the page, and how many block tags were open before each
    now = Block()
    at = 0

    def close():
        nonlocal now
        text = _SPACE.sub(" ", "".join(now.parts)).strip()
        if text:
            now.text = text
            out.append(now)
        now = Block(outside, weak, article, heading, doubt, which)

    def pop(k: int):
        for entry in stack[k:]:
            opened[entry[0]] -= 1
        del stack[k:]

    skip = [0]
    for begin, end, name, closing, attributes in chain(tags(page, skip), [(len(page), len(page), "", False, "")]):
        raw = page[at:begin]
        if dropped and dropped[-1][0] == "head" and raw.strip():
            dropped.pop()
        if raw and not dropped:
            text = html.unescape(raw) if "&" in raw else raw
            now.parts.append(text)
            if links:
                now.linked += len("".join(text.split()))
        at = end
        if not name:
            continue
        alone = attributes.endswith("/")
        if alone and name in _RAW and not closing:
            # HTML knows no such raw element: if its end tag is what comes next of that name, it holds what is between
            after = _END[name].search(page, at)
            alone = not (after and after[1])
        if dropped and dropped[-1][0] == "head" and not closing and name not in _HEAD:
            dropped.pop()
        if name in _RAW and not closing and not alone:
            stop = _RAW_END[name].search(page, at)
            at = skip[0] = stop.end() if stop else len(page)
            now.parts.append(" ")
            continue
        if name in _DROPPED:
            # an end tag ends all inside it; an option, select or button ends with the next of its kind
            if closing or name in ("select", "button") or (name == "option" and dropped and dropped[-1][0] == name):
                for k in range(len(dropped) - 1, -1, -1):
                    if dropped[k][0] == name:
                        del dropped[k:]
                        break
            if not closing and not alone:
                dropped.append((name, len(stack)))
            continue
        if name in _INLINE:
            if name == "a":
                links = max(0, links + (-1 if closing else 1))
            elif name == "br":
                now.parts.append(" ")
            if name in ("a", "br") or closing or not attributes or not _marked(attributes):
                continue
        if name == "body":
            dropped.clear()
        links = 0
        if closing:
            if opened.get(name):
                k = next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name)
                pop(k)
                while dropped and dropped[-1][1] > k:  # left open in what ends here
                    dropped.pop()
        elif name not in _VOID and not alone:
            if stack and (name in _ENDS.get(stack[-1][0], ()) or (stack[-1][0] in ("p", *_HEADINGS) and name in ("p", "li", *_HEADINGS))):
                pop(len(stack) - 1)
            _, hard, inside, doubt, which, marks, hints, deep = stack[-1] if stack else none
            mark = _marked(attributes) if attributes and name not in ("html", "body") else 0
            if name in _ARTICLE:
                own = name == "article" and bool(attributes) and _comment(attributes)
                if not deep and not (own and marks + hints):  # marks around it are in doubt; a marked list's marked article isn't
                    doubt, marks, hints = doubt + marks + hints + own, 0, 0
                    articles += 1
                    which = articles
                inside, deep = True, deep or name == "article"
            elif name in _OUTSIDE and not (name == "header" and inside):
                hard = True
            elif mark:
                marks, hints = marks + (mark == 2), hints + (mark == 1)
            stack.append((name, hard, inside, doubt, which, marks, hints, deep))
            opened[name] = opened.get(name, 0) + 1
        _, hard, article, doubt, which, marks, hints, _ = stack[-1] if stack else none
        weak = not hard and not marks and hints > 0
        outside = hard or marks > 0 or weak
        heading = bool(stack) and stack[-1][0] in _HEADINGS
        close()
    close()
    return out


def _says(found: list[Block]) -> bool:
    """Whether the page marks its article beyond doubt."""
    return any(b.article and not b.outside and not b.doubt for b in found)


def _settle(found: list[Block]) -> None:
    """Doubtful articles, the least doubtful first, stay if the longest is longer than the good text so far; else they are boilerplate."""
    for doubt in sorted({b.doubt for b in found if b.article and not b.outside and b.doubt}):
        kept = sum(len(b.text) for b in found if b.label == GOOD and (not b.article or b.doubt < doubt))
        sizes: dict[int, int] = {}
        for b in found:
            if b.article and not b.outside and b.doubt == doubt and b.label != BAD:
                sizes[b.which] = sizes.get(b.which, 0) + len(b.text)
        if max(sizes.values(), default=0) <= kept:
            for b in found:
                if b.article and b.doubt == doubt:
                    b.outside, b.label = True, BAD


def _stops(words: list[str]) -> int:
    return sum(w.strip(".,;:!?\"'()*#%&$").lower() in STOP_WORDS for w in words)


def _weigh(found: list[Block], marked: bool) -> None:
    """Points of each block's own words, its links, and where it stands."""
    own = [b.text.split() for b in found]
    stops = [_stops(w) for w in own]
    listed = any(s >= STOP_LOW * len(w) for b, w, s in zip(found, own, stops, strict=True) if not b.outside and len(w) > SHORT_WORDS)
    for b, words, stop in zip(found, own, stops, strict=True):
        share = b.linked / max(1, sum(map(len, words)))
        points = b.article - 2 * (marked and not b.article)
        if len(words) > SHORT_WORDS and not b.heading:
            points += 2 if not listed or stop >= STOP_HIGH * len(words) else 1 if stop >= STOP_LOW * len(words) else -1
        points -= 3 if share > LINKS else share > SOME_LINKS
        b.label = BAD if b.outside or points < 0 else GOOD if points >= 2 else OPEN


def first_pass(found: list[Block]) -> None:
    """Label what a block's own words, its links and what encloses it decide."""
    _weigh(found, False)
    if any(b.weak for b in found) and not any(b.label == GOOD for b in found):
        for b in found:
            if b.weak:  # a layout's name, as nothing else is left
                b.outside = b.weak = False
        _weigh(found, False)
    _settle(found)
    if _says(found):  # the page says where its text is
        _weigh(found, True)


def second_pass(found: list[Block]) -> None:
    """Undecided blocks inherit: a heading from what follows, any other from its nearest decided neighbours.

    With decided blocks on one side only that side counts; with none at all the
    undecided blocks are the text.
    """

    def nearest(order, counts) -> dict[int, tuple[int, int]]:
        out, label, distance, which = {}, OPEN, 0, None
        for i in order:
            b = found[i]
            if (b.article, b.which) != which:  # an article's edge: its blocks are one step further away, and don't look out at all
                label, distance, which = (label, distance + 1, (b.article, b.which)) if counts is None else (OPEN, 0, (b.article, b.which))
            if b.label and (counts is None or counts(b)):
                label, distance = b.label, 0
            else:
                distance += 1
            out[i] = (label, distance)
        return out

    up, down = range(len(found)), range(len(found) - 1, -1, -1)
    by_words = lambda b: b.article and not b.outside
    near = {False: (nearest(up, None), nearest(down, None)), True: (nearest(up, by_words), nearest(down, by_words))}
    labels = []
    for i, b in enumerate(found):
        label = b.label
        if label == OPEN:
            before, after = near[b.article]
            (x, d), (y, e) = before[i], after[i]
            x, y = x or y, y or x
            if x == y:
                label = x or GOOD
            else:
                label = y if b.heading or e < d else x if d < e else GOOD
        labels.append(label)
    for b, label in zip(found, labels, strict=True):
        b.label = label


def main_text(page: str | None) -> str:
    """The blocks that are labelled good, joined by two line feeds; empty for a null or empty page, or one without text."""
    if not page:
        return ""
    found = blocks(page)
    first_pass(found)
    second_pass(found)
    return "\n\n".join(b.text for b in found if b.label == GOOD)


def _run(extract: Callable[[str | None], str]):
    def run(batches):
        for whole in batches:
            for b in textkit.slices(whole, "html"):
                texts = [extract(t) for t in b.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, ...) -> a row each: page_id, url, text, n_chars.

    Null and empty pages have an empty text. Repeated rows are kept as rows, null
    ids and addresses stay null, other columns aren't read, an empty table gives
    no rows. Very long pages are read whole. One pass, no shuffle.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return mapped(pages, _run(main_text), "page_id long, url string, text string, n_chars long")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
