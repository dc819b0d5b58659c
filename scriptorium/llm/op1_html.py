"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block of the page. Text of containers that
never hold an article (menus, footers, forms, adverts ...) counts as length 0, as do lines
that are mostly links, and short calls and notices outside article elements; edges of containers leave empty lines,
as their markup did. The sums of text lengths over sliding windows of lines then surge
where the article begins and dive where it ends. Article and main elements are a weight on
their lines, and class names evidence that the text of an element may outweigh.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from scriptorium.llm.common import table

# Element names of HTML and usual names of page parts.
_RAW = frozenset("script style noscript template iframe object svg math canvas textarea title select head".split())
_SKIP = frozenset("nav header footer aside form button menu dialog".split())
_MAIN = frozenset("article main".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Parts that hold an article only by mistake; they stay out however much text they have.
_NEVER = frozenset("nav footer aside button menu dialog".split())
_BOXES = frozenset("div td form".split())
_PARTS = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|sidebar\w*|widget\w*|footer\w*|header|masthead|cookies?|consent|gdpr|notice\w*|disclaimer|comments?|commentlist|disqus\w*|respond|replies|reply|share|sharing|social|related|recommend\w*|newsletter|subscribe\w*|popup|modal|overlay|login|signup|search\w*|pagination|pager|toolbar|copyright|legal|hidden)(?:$|[\s_-])",
    re.I,
)
#: Words that an article's own sections may have in their class; there the text decides.
_WEAK = re.compile(r"(?:^|[\s_-])(?:disclaimer|reply|share|sharing|social|related|recommend\w*|subscribe\w*|login|signup|search\w*|copyright|legal|notice\w*(?=[_-]))(?=$|[\s_-])", re.I)
#: Lines that ask for something or state rights, where no longer than CALL characters.
_CALLS = re.compile(r"\W*(?:©|\(c\)|copyright\b|all rights reserved|subscribe\b|sign up\b|log in\b|share this\b|follow us\b|we use cookies|this (?:site|website) uses cookies|accept (?:all )?cookies|skip to (?:main )?content|advertisement\b)", re.I)
_CALL = 120
#: Elements in whose running text a button is a word like others.
_FLOW = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt td th blockquote figcaption summary caption".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A line from which on text reads as prose.
_PROSE = 80
_HEADER = re.compile(r"(?<![^\s_-])header(?![^\s_-])", re.I)
_OWN_HEADER = re.compile(r"(?:^|\s)(?:entry|post|article|story|content)[_-]header(?:$|\s)", re.I)
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())

_MARK = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][A-Za-z0-9:-]*)", re.S)
_REST = re.compile(r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>", re.S)
_NAMED = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WHITE = re.compile(r"\s+")
#: Empty lines at the edge of a page part, and of an article or main element.
_EDGE = 3
#: What a line in an article or main element weighs.
_MARKED = 1000
#: What other lines weigh on a page with such an element.
_BESIDE = 0.25


def _part(name: str, attributes: str, main: bool) -> tuple[bool, bool]:
    """Whether an element is a page part that never belongs to the article, and whether its text may still show otherwise.

    ``main``: it lies in an article. An article's own header holds its title; sections of
    an article may be called "related work" or "legal", so there such words alone are weak.
    """
    named = _NAMED.findall(attributes) if attributes else []
    if name in _SKIP:
        return name != "header" or not (main or any(k.lower() == "class" and _OWN_HEADER.search(a or b or c) for k, a, b, c in named)), False
    if name in ("body", "html", "article", "main"):
        return False, False
    weak = False
    for key, a, b, c in named:
        value, key = a or b or c, key.lower()
        if key in ("class", "id"):
            value = _HEADER.sub("", value) if main else _OWN_HEADER.sub(" ", value)
            if main and _WEAK.search(value):
                weak, value = True, _WEAK.sub(" ", value)
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "role" and value.lower() in _ROLES) or (key in ("class", "id") and _PARTS.search(value)):
            return True, False
    return weak, weak


class _Elements:
    """A page's block elements and page parts, parents before children; 0 is the page itself."""

    def __init__(self) -> None:
        self.name, self.parent, self.part, self.main, self.weak = [""], [0], [False], [False], [False]

    def add(self, name: str, parent: int, attributes: str) -> int:
        main = self.main[parent]
        self.name.append(name)
        self.parent.append(parent)
        part, weak = _part(name, attributes, main)
        self.part.append(part)
        self.weak.append(weak)
        self.main.append(main or name in _MAIN)
        return len(self.name) - 1

    def sums(self, lines: list[tuple[str, int, int]], counts) -> list[int]:
        """For each element, the lengths of the lines in it whose element ``counts``."""
        out = [0] * len(self.name)
        for _, n, e in lines:
            if counts(e):
                out[e] += n
        for e in range(len(out) - 1, 0, -1):
            out[self.parent[e]] += out[e]
        return out

    def outermost_parts(self) -> list[int]:
        """For each element, the outermost page part around it (0: none)."""
        out = [0] * len(self.name)
        for e in range(1, len(out)):
            out[e] = out[self.parent[e]] or (e if self.part[e] else 0)
        return out


def lines_of(page: str) -> tuple[list[tuple[str, int, int]], _Elements]:
    """Lines of a page (text, its length without links, its element) and the elements.

    Elements left open end with the page or with an element around them; a closing tag
    without an opening one does nothing.
    """
    out: list[tuple[str, int, int]] = []
    text: list[str] = []
    linked = 0
    plain = False  # the line has text outside of buttons
    elements = _Elements()
    stack = [0]
    opened: dict[str, int] = {}  # how many of a name are on the stack
    in_link = in_button = False

    def flush() -> None:
        nonlocal linked, plain
        if text and plain:
            line = _WHITE.sub(" ", html.unescape("".join(text))).strip()
            if line:
                out.append((line, max(1, len(line) - min(linked, len(line))), stack[-1]))
        text.clear()
        linked, plain = 0, False

    def enter(name: str, attributes: str) -> None:
        stack.append(elements.add(name, stack[-1], attributes))
        opened[name] = opened.get(name, 0) + 1

    def leave(name: str) -> None:
        while True:
            was = elements.name[stack.pop()]
            opened[was] -= 1
            if was == name:
                break

    # a quote that never closes is found once; from there on a tag ends at the next >
    at, quotes, open_ends = 0, True, set()
    for m in _MARK.finditer(page):
        if m.start() < at:
            continue
        end, attributes = m.end(), ""
        if m[2]:
            rest = _REST.match(page, m.end()) if quotes else None
            quotes = rest is not None
            end = rest.end() if rest else page.find(">", m.end()) + 1
            if not end:
                break  # no tag after this
            attributes = page[m.end() : end - 1]
        if m.start() > at:
            piece = page[at : m.start()]
            text.append(piece)
            linked += len(piece) * in_link
            plain = plain or not in_button
        at = end
        name = (m[2] or "").lower()
        if not name:
            continue
        closing = bool(m[1])
        if name in _RAW and not closing:
            if not attributes.endswith("/") and name not in open_ends:
                stop = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                if stop is None:
                    open_ends.add(name)
                at = stop.end() if stop else at if name == "head" else len(page)
            continue
        if name == "br" or name == "wbr":
            text.append(" " if name == "br" else "")
            continue
        if name == "a":
            in_link = not closing
            continue
        if name == "button" and (in_button if closing else elements.name[stack[-1]] in _FLOW):
            in_button = not closing
            continue
        if name not in _BLOCK:
            if not closing and name not in _VOID and not attributes.endswith("/") and _part(name, attributes, elements.main[stack[-1]])[0]:
                flush()
                enter(name, attributes)
            elif closing and opened.get(name):
                flush()
                leave(name)
            continue
        flush()
        if name in _VOID:
            continue
        if not closing:
            if name == "p" and elements.name[stack[-1]] == "p":
                leave("p")
            enter(name, attributes)
        elif opened.get(name):
            leave(name)
            in_link = in_button = False
    if at < len(page):
        text.append(page[at:])
        plain = plain or not in_button
    flush()
    return out, elements


def _weigh_names(lines: list[tuple[str, int, int]], elements: _Elements, share: float) -> None:
    """Evidence of the text against, or for, what names say.

    A section of an article with a weak name is a page part only if a fifth of its text is
    links, or no line of it is prose. An article element with less than ``share`` of the
    longest one's text, and a line that is a link alone, is a teaser, and a page part.
    """
    whole = elements.sums([(t, len(t), e) for t, _, e in lines], lambda e: True)
    if any(elements.weak):
        links = elements.sums([(t, len(t) - n, e) for t, n, e in lines], lambda e: True)
        longest = [0] * len(whole)
        for t, _, e in lines:
            longest[e] = max(longest[e], len(t))
        for e in range(len(longest) - 1, 0, -1):
            longest[elements.parent[e]] = max(longest[elements.parent[e]], longest[e])
            if elements.weak[e] and 5 * links[e] < whole[e] and longest[e] >= _PROSE:
                elements.part[e] = False
    articles = [e for e in range(1, len(whole)) if elements.name[e] == "article"]
    if len(articles) > 1:
        first = max(articles, key=lambda e: whole[e])
        led = elements.sums([(t, 2 * n <= len(t), e) for t, n, e in lines], lambda e: True)
        around, within = {first}, [False] * len(whole)
        while min(around):
            around.add(elements.parent[min(around)])
        for e in range(1, len(whole)):
            within[e] = e == first or within[elements.parent[e]]
        for e in articles:
            if whole[e] < share * whole[first] and led[e] and not within[e] and e not in around:
                elements.part[e] = True


def _settle(lines: list[tuple[str, int, int]], elements: _Elements) -> tuple[list[int], bool]:
    """For each element, the page part that keeps it out (0: none), and whether an article or main element has text.

    A part that holds the only article or main element is none; nor, on a page without
    one, is a part that holds most of the page's text. The outermost are opened first,
    so that comments in article elements of their own stay out beside the article.
    """
    marked = elements.sums(lines, lambda e: elements.main[e])
    held, least = (marked, 0) if marked[0] else (elements.sums(lines, lambda e: True), None)
    if least is None:
        least = held[0] / 2
    # for each element, how many parts around it would have to be opened; None where one of them stays shut
    depth: list[int | None] = [0] * len(held)
    for e in range(1, len(held)):
        above = depth[elements.parent[e]]
        wide = held[e] > least and (marked[0] or elements.name[e] not in _NEVER)
        depth[e] = above if above is None or not elements.part[e] else above + 1 if wide else None
    levels = [depth[e] for _, _, e in lines if elements.main[e] and depth[e] is not None]
    most = min(levels, default=len(depth))
    for e, d in enumerate(depth):
        if d is not None and d <= most:
            elements.part[e] = False
    return elements.outermost_parts(), bool(levels)


def _weights(lines: list[tuple[str, int, int]], elements: _Elements, off: list[int], marked: bool, share: float) -> list[float]:
    """What a line of each element weighs.

    Lines in an article or main element weigh most, and others then so little that, with
    the usual share, they stand only where no candidate of the page is longer. On other
    pages the smallest box of several lines with all but ``share`` of the text takes the
    article's place; if that is the page itself, lines in no box of their own do.
    """
    if marked:
        return [float(_MARKED) if m else _BESIDE for m in elements.main]
    held = elements.sums(lines, lambda e: not off[e])
    several = elements.sums([(line, 1, e) for line, _, e in lines], lambda e: not off[e])
    boxes = [e for e in range(1, len(held)) if elements.name[e] in _BOXES and several[e] > 1]
    near = max((e for e in boxes if held[e] >= (1 - share) * held[0]), default=0)
    inside = [not near] + [False] * (len(held) - 1)
    for e in range(1, len(held)):
        above = inside[elements.parent[e]]
        inside[e] = e == near or (above and (near > 0 or elements.name[e] not in _BOXES))
    return [float(_MARKED) if x else 1.0 for x in inside]


def candidates(sizes: list[int], window: int) -> list[tuple[int, int]]:
    """Runs of lines from a surge (the sum over the next ``window`` lines leaves 0) to a dive (it falls to 0)."""
    spans, start, inside = [], 0, False
    run = sum(sizes[:window])
    for i in range(len(sizes)):  # run: the sum over lines i to i + window - 1
        if not inside and run > 0:
            start, inside = i, True
        elif inside and run == 0:
            spans.append((start, i))
            inside = False
        run += (sizes[i + window] if i + window < len(sizes) else 0) - sizes[i]
    return [*spans, (start, len(sizes))] if inside else spans


def surge(sizes: list[int], window: int, start: int, stop: int, rise: float) -> int:
    """The first line from ``start`` on whose window reaches ``rise`` times the highest window of all; ``start`` if none does."""
    sums, run = [], sum(sizes[:window])
    for i in range(len(sizes)):
        sums.append(run)
        run += (sizes[i + window] if i + window < len(sizes) else 0) - sizes[i]
    least = rise * max(sums, default=0)
    return next((i for i in range(start, stop) if sums[i] >= least), start)


def _edges(lines: list[tuple[str, int, float, int, bool]], start: int, stop: int, marked: bool, window: int, rise: float) -> tuple[int, int]:
    """Where the text begins and ends, from the first surge and the last dive.

    Windows reach over lines without text of their own. In an article, fewer than
    ``window`` of those at its edge belong to it (a paragraph that is one link), more are
    lists of links. Elsewhere the text begins with
    a main heading, if one stands before the end of the first window that reaches
    ``rise`` of the highest, or else with that window.
    """
    sizes = [n for _, n, _, _, _ in lines]
    kept = range(start, stop)
    first = next(i for i in kept if sizes[i])
    last = next(i for i in reversed(kept) if sizes[i])
    if marked:
        for step in (-1, 1):
            spot = edge = first if step < 0 else last
            while 0 <= edge + step < len(lines) and lines[edge + step][3] == 1 and not sizes[edge + step]:
                edge += step
            if abs(edge - spot) < window:
                first, last = min(first, edge), max(last, edge)
        return first, last + 1
    begin = surge(sizes, window, first, last + 1, rise)
    title = next((i for i in range(first, min(begin + window, last + 1)) if lines[i][4]), None)
    return (title if title is not None else next(i for i in range(begin, last + 1) if sizes[i])), last + 1


def _is_call(line: str) -> bool:
    return len(line) <= _CALL and _CALLS.match(line) is not None


def main_text(page: str | None, window: int = 3, share: float = 0.25, rise: float = 0.25) -> str:
    """The article's blocks, joined by newlines.

    The sum of lengths over ``window`` lines surges from 0 where a text begins and dives
    to 0 where it ends; what lies between is one candidate. Lines of page parts, lines of
    which half is links, and calls outside article elements have no length, unless the page
    has no others. A
    candidate stands if its weighted length is at least ``share`` of the longest
    candidate's length. The text goes from the first surge to the last dive of those that
    stand (see ``_edges``), without page parts. Elements named as reader comments are page
    parts wherever they stand. Null and empty pages, and pages without text, give the
    empty string.
    """
    if not page:
        return ""
    found, elements = lines_of(page)
    _weigh_names(found, elements, share)
    off, marked = _settle(found, elements)
    weight = _weights(found, elements, off, marked, share)
    sized = [(line, n if 2 * n > len(line) and (elements.main[e] or not _is_call(line)) or elements.name[e] in _HEADINGS else 0, e) for line, n, e in found]
    if not any(n and not off[e] for _, n, e in sized):
        sized = found
    lines: list[tuple[str, int, float, int, bool]] = []  # text, length, weight, 1 if no page part, whether a main heading
    before = None  # kind of the line before: a page part, marked or not
    for line, n, e in sized:
        if off[e] and elements.main[elements.parent[off[e]]]:
            continue  # a part of the article ends no candidate
        kind = (bool(off[e]), elements.main[e] and not off[e])
        if before is not None and kind != before:
            lines += [("", 0, 0.0, 2, False)] * _EDGE
        before = kind
        lines.append((line, 0 if off[e] else n, weight[e], 0 if off[e] else 1, elements.name[e] == "h1"))
    sizes = [n for _, n, _, _, _ in lines]
    spans = candidates(sizes, window)
    least = share * max((sum(sizes[a:b]) for a, b in spans), default=0)
    stand = [(a, b) for a, b in spans if sum(x[1] * x[2] for x in lines[a:b]) >= least]
    if not stand:
        return ""
    first, last = _edges(lines, stand[0][0], stand[-1][1], marked, window, rise)
    return "\n".join(line for line, _, _, kept, _ in lines[first:last] if kept == 1)


def extract_main_text(pages: DataFrame, window: int = 3, share: float = 0.25, rise: float = 0.25) -> DataFrame:
    """page_id, url, text and n_chars for every row of ``pages``, one pass and no shuffle.

    Null or empty html gives an empty text; ids and urls pass through, null or repeated;
    no rows give no rows; other columns are ignored.
    """

    def run(batches):
        for batch in batches:
            texts = [main_text(x.as_py(), window, share, rise) for x in batch.column("html")]
            yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))
