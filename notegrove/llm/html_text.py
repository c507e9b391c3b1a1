"""Main text of web pages by the distribution of text over lines of blocks."""

from __future__ import annotations

import html as entities
import itertools
import re
from bisect import bisect
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import added, table, without

_OPEN = re.compile(r"<(?:(/?)([a-zA-Z][^\s>/]*+)([^<>\"']*+)(>)?|[!?])")
_STOP = re.compile(r"[>\"']")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
#: Elements whose content is no markup, elements that are no part of an article, inline and void elements.
_RAW = {"script", "style", "noscript", "template", "svg", "textarea", "title", "iframe"}
_OUTSIDE = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "head"}
_INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "label", "picture", "source"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Elements whose end may be left out; the next of the same set at their level, or the end of what holds them, ends them.
_LOOSE = {"p": "p", "li": "li", "dt": "dl", "dd": "dl", "tr": "tr", "td": "td", "th": "td", "thead": "tb", "tbody": "tb", "tfoot": "tb", "option": "op", "optgroup": "og", "rp": "r", "rt": "r"}
#: Words of class, id or role that tell what a region is: these alone or among each other and those of company, and those only in the company given or alone. A name with any other word in it (share-price, banner-history) tells nothing.
_SAYS = set("ad ads advert advertisement advertising adverts sponsor sponsored promo nav navbar navigation menu sidebar footer masthead cookie cookies consent breadcrumb breadcrumbs comment comments disqus respond newsletter subscribe popup pagination pager toolbar share sharing social contentinfo complementary banner".split())
_SAYS_ALONE = set("header notice related search modal login widget alert signup links recommended teaser".split())
_COMPANY = set("site page global top main box bar form posts articles links list container wrapper inner left right block area section".split())
_FILLER = set("a and by with us on-page slot slots unit units zone btn btns button buttons primary secondary tertiary item items wrap outer body content label title heading text header footer panel overlay icon icons count counts bottom rail col column row group holder region mobile desktop sticky fixed small large full wide js ui module component reader readers user users reply replies thread author meta media policy settings dialog mini mega sub dropdown toggle trail number numbers first last prev next follow buttonbar feed stream google dfp leaderboard skyscraper rectangle native display".split())
#: The part of its text that a line weighs outside of the page's article, and the length from which a line's say in the page's level is more than half.
BESIDE, SAY = 0.05, 80


class Token(NamedTuple):
    """A tag or what stands for one: where it starts and ends, its element ('' for comments and the like), whether it ends it, and its attributes."""

    start: int
    end: int
    name: str
    closing: bool
    attributes: str


def tokens(page: str) -> Iterator[Token]:
    """The tags of ``page`` in order; elements without markup in them are one token with their content. The time is linear in the page.

    A quote that nothing closes is a character like others, and so is a ``<`` that no ``>`` follows.
    """
    at, quotes, low = 0, {'"': True, "'": True}, None
    last = page.rfind(">")
    while (m := _OPEN.search(page, at)) and m.start() <= last:
        start, name = m.start(), (m[2] or "").lower()
        if not name:
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                end = len(page) if end < 0 else end + 3
            elif page.startswith("<![CDATA[", start):
                end = page.find("]]>", start)
                end = len(page) if end < 0 else end + 3
            else:
                end = page.find(">", start) + 1
            yield Token(start, end, "", False, "")
            at = end
            continue
        if m[4]:
            end, attributes = m.end(), m[3]
        else:
            k = m.end()
            while True:
                s = _STOP.search(page, k)
                if s is None:  # nothing ends this tag, nor any after it
                    return
                if s[0] == ">":
                    break
                k = s.end()
                if quotes[s[0]]:
                    close = page.find(s[0], k)
                    if close < 0:
                        quotes[s[0]] = False
                    else:
                        k = close + 1
            end, attributes = s.end(), page[m.start(3) : s.start()]
        if name in _RAW and not m[1] and not attributes.endswith("/"):
            low = low if low is not None else page.lower()
            close = low.find(f"</{name}", end) if len(low) == len(page) else page.find(f"</{name}", end)
            stop = page.find(">", close) if close >= 0 else -1
            yield Token(start, len(page) if stop < 0 else stop + 1, "", False, "")
            at = len(page) if stop < 0 else stop + 1
            continue
        yield Token(start, end, name, bool(m[1]), attributes)
        at = end


def _against(name: str, attributes: str) -> bool:
    """Whether an element, or what it is called, speaks against its being part of an article."""
    if name in _OUTSIDE:
        return True
    if not attributes or name in ("body", "html", "article", "main") or name in _INLINE - {"a", "span"}:
        return False
    for m in _NAMES.finditer(attributes):
        for word in next(filter(None, m.groups()), "").split():
            parts = {x.lower() for x in _PARTS.findall(word) if not x.isdigit()}
            if (parts & _SAYS and not parts - _SAYS - _SAYS_ALONE - _COMPANY - _FILLER) or (parts & _SAYS_ALONE and not parts - _SAYS_ALONE - _COMPANY - _SAYS):
                return True
    return False


def regions(found: list[Token]) -> tuple[dict[int, int], list[int]]:
    """For starts of elements (by their place in ``found``) the place of the token that ends them, if one does; and before each token a
    number for the names of the elements around it."""
    open_: list[tuple[str, int, int]] = []
    until: dict[int, int] = {}
    held: Counter = Counter()
    around, now = [], 0

    def shut(k: int, match: bool = False) -> None:
        nonlocal now
        name, i, now = open_.pop()
        held[name] -= 1
        if name in _LOOSE:
            held["any " + _LOOSE[name]] -= 1
        if match or name in _LOOSE:
            until[i] = k

    for k, t in enumerate(found):
        around.append(now)
        name = t.name
        if not name or name in _VOID or t.attributes.endswith("/"):
            continue
        if t.closing:
            if held[name]:
                while open_[-1][0] != name:
                    shut(k)
                shut(k, True)
            continue
        inline = name in _INLINE
        if inline and not _against(name, t.attributes):
            continue
        if not inline:
            for kind in ("p", _LOOSE.get(name, "p")):
                if held["any " + kind]:
                    depth = len(open_) - 1
                    while depth >= 0 and open_[depth][0] in _INLINE:
                        depth -= 1
                    if depth >= 0 and _LOOSE.get(open_[depth][0]) == kind:
                        while len(open_) > depth:
                            shut(k)
        open_.append((name, k, now))
        held[name] += 1
        if name in _LOOSE:
            held["any " + _LOOSE[name]] += 1
        if not inline:
            now = hash((now, name))
    while open_:
        shut(len(found))
    return until, around


class Line(NamedTuple):
    """A line of a page without its markup: its text ('' for a blank one), weight, whether names speak against it, whether it lies in an article, and the number of the elements around it."""

    text: str
    weight: float
    named: bool
    article: bool
    around: int


def lines(page: str) -> list[Line]:
    """The lines of a page: text between block tags, and a blank line for each block tag after the first between two texts.

    A line weighs as much as its text is long, less what is links, and a small part of that outside of a page's article; nothing where names speak against it. What holds
    the article or nearly all text can call itself anything, and a header in an article is the article's own. The edges of articles are wide gaps, and gaps inside of them are none.
    """
    found = list(tokens(page))
    until, around = regions(found)
    bodies = sorted(i for i in until if found[i].name in ("article", "main"))
    before = [0]  # text before each token
    for t, u in zip(found, [None, *found]):
        before.append(before[-1] + t.start - (u.end if u else 0))
    before.append(before[-1] + len(page) - (found[-1].end if found else 0))
    out: list[Line] = []
    parts: list[str] = []
    ends: list[tuple[int, bool, bool]] = []  # regions that matter: where they end, whether named, whether articles
    named = articles = linked = gap = 0
    wide = link = False

    def flush(blanks: int, k: int) -> None:
        nonlocal linked, gap, wide
        text = " ".join(entities.unescape("".join(parts)).split())
        parts.clear()
        if text:
            if out:
                out.extend([Line("", 0.0, False, articles > 0 and not wide, 0)] * (200 if wide else min(200, gap - 1)))
            weight = 0.0 if named else len(text) * (1 - min(1.0, linked / len(text))) ** 2 * (1.0 if articles or not bodies else BESIDE)
            out.append(Line(text, weight, named > 0, articles > 0, around[k] if k < len(around) else 0))
            gap, wide = 0, False
        gap += blanks
        linked = 0

    def leave() -> None:
        nonlocal named, articles, wide
        _, a, b = ends.pop()
        named -= a
        articles -= b
        wide |= b and not articles

    at = 0
    for k, t in enumerate(found):
        piece = page[at : t.start]
        parts.append(piece)
        linked += len(" ".join(piece.split())) if link else 0
        at = t.end
        while ends and ends[-1][0] <= k:
            flush(0, k)
            leave()
        if not t.name:
            continue
        if t.name == "a":
            link = not t.closing
        if t.name == "br":
            parts.append(" ")
        if t.name not in _INLINE:
            flush(1, k)
            link = False
        if k in until:
            body, against = t.name in ("article", "main"), _against(t.name, t.attributes)
            if against and t.name == "header" and articles and not _against("div", t.attributes):
                against = False  # an article's own header is part of it
            if against and t.name not in _OUTSIDE:
                inside = bisect(bodies, k) < bisect(bodies, until[k]) if bodies else before[until[k] + 1] - before[k + 1] > 0.9 * before[-1]
                against = not inside
            if against or body:
                flush(0, k)
                ends.append((until[k], against, body))
                named += against
                wide |= body and not articles
                articles += body
    parts.append(page[at:])
    while ends and ends[-1][0] < len(found):
        leave()
    flush(0, len(found))
    return out


def kept(found: list[Line], window: int = 3, surge: float = 0.35, dive: float = 0.02) -> list[bool]:
    """Which lines lie between a surge and a dive of the window sums, and aren't named as something else.

    The sum of a line is that of the weights of ``window`` lines from it on. The page's level is the mean of these sums at lines with text, in which short lines
    have little say. A dive is where a sum falls under ``dive`` times ``surge`` of the level; a stretch between dives
    is kept if its sums surge to ``surge`` of the level, and its lines also if they lie between surges, among the same elements.
    """
    n = len(found)
    total = list(itertools.accumulate((x.weight for x in found), initial=0.0))
    sums = [total[min(n, k + window)] - total[k] for k in range(n)]
    if not total[-1]:  # nothing but links and names: all that isn't named is alike
        return [bool(x.text) and not x.named for x in found]
    say = [x.weight / (x.weight + SAY) for x in found]
    level = sum(a * s for a, s in zip(say, sums)) / sum(say)
    stretch, peaks, held = [-1] * n, [], False
    for k, x in enumerate(found):
        on = sums[k] > dive * surge * level or x.article
        if on and not (held and x.article == found[k - 1].article):
            peaks.append(0.0)
        held = on
        if on:
            stretch[k] = len(peaks) - 1
            peaks[-1] = max(peaks[-1], sums[k])
    good = [s >= 0 and peaks[s] >= surge * level for s in stretch]
    surged = [k for k, x in enumerate(found) if good[k] and x.text and not x.named]
    same = {found[k].around for k in surged}
    return [bool(x.text) and not x.named and (good[k] or bool(surged) and surged[0] < k < surged[-1] and x.around in same) for k, x in enumerate(found)]


def main_text(page: str | None, window: int = 3, surge: float = 0.35) -> str:
    """The main text of one page: its lines between surge and dive points (see ``lines`` and ``kept``), joined by newlines.

    White space inside a line is one space and character references are decoded. Null, empty and textless pages give the empty text. Malformed tags cost no more than others.
    """
    found = lines(page or "")
    return "\n".join(x.text for x, k in zip(found, kept(found, window, surge)) if k)


def extracted(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with ``text`` (string), see ``main_text``. A column ``text`` of the input is replaced."""
    pages = without(pages, ["text"])
    at = pages.columns.index(html_col)

    def run(batches):
        for b in batches:
            texts = pa.array([main_text(x) for x in b.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, texts], names=[*b.schema.names, "text"])

    return pages.mapInArrow(run, added(pages.schema, ("text", T.StringType())))


def op8_html_extraction(spark, sf_dir: str) -> DataFrame:
    found = extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
