"""Main text of web pages by line-block distribution."""

from __future__ import annotations

import html
import itertools
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)(?:>|\Z)", re.S)
HINTS = re.compile(r"(?i)(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
RAW = {"script", "style", "noscript", "template", "textarea", "title", "svg", "iframe"}
#: Elements that are stripped with what they hold; a header inside article or main is the article's own.
APART = {"nav", "footer", "aside", "form", "menu", "button", "select", "dialog", "header"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
#: Elements whose tags leave an empty line, as they do in a page laid out by hand.
SECTIONS = {"html", "body", "div", "section", "article", "main", "center", "td", "th"}
MAIN = {"article", "main"}
CELLS = {"td", "th"}
#: A start tag that ends an open element of these names, if none of the second set was opened in between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
ENDS |= dict.fromkeys(("p", "div", "ul", "ol", "dl", "table", "article", "section", "main", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6", "hr", *(APART - {"button", "select"})), ({"p"}, {"button", "td", "th", "li"}))
#: Names of class, id and role by which a page marks adverts, notices, menus and readers' comments.
APART_WORDS = set(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navigation navbar menu sidebar footer header masthead "
    "cookie cookies consent notice notices popup modal newsletter subscribe signup related share sharing social comment comments reply replies "
    "breadcrumb breadcrumbs pagination pager widget login search contentinfo complementary disclaimer toolbar".split()
)
#: Words that such a name may have besides; with any other word it is another name (``ad-hoc``, ``lunch-menu``).
BESIDE_WORDS = set("site page main top bottom left right box bar section list area wrapper container block inner global primary secondary posts articles links link buttons reader readers user form slot unit".split())
#: First lines that tell what a block without such a name is.
LABELS = set(
    "advertisement advert sponsored anzeige werbung publicité publicidad anuncio "
    "comments comment responses replies discussion kommentare commentaires comentarios".split()
) | {"reader comments", "readers comments", "leave a comment", "leave a reply", "related articles", "related posts", "sponsored content"}
SPACE = re.compile(r"\s+")
HEADINGS = {"h1", "h2"}


def named_apart(attrs: str) -> bool:
    """Whether a class, id or role is a name of APART_WORDS, or made of them and BESIDE_WORDS alone."""
    for m in HINTS.finditer(attrs) if "=" in attrs else ():
        for name in (m[1] or m[2] or m[3] or "").lower().split():
            words = set(re.split(r"[^a-z0-9]+", name)) - {""}
            if words & APART_WORDS and words <= APART_WORDS | BESIDE_WORDS:
                return True
    return False


def labelled(line: str) -> bool:
    """Whether a block's first line is a label of comments, adverts and the like, a number beside it or not."""
    return len(line) < 40 and SPACE.sub(" ", re.sub(r"[\W\d_]+", " ", line.lower().replace("'", "").replace("\u2019", ""))).strip() in LABELS


class Line(NamedTuple):
    """A line of a page: its text, characters outside links, whether it is a heading, empty lines before it, and where it is."""

    text: str
    plain: int
    heading: bool
    gap: int
    block: int  # innermost block that may be apart, or -1
    home: int  # innermost article or main, or -1
    section: int  # innermost section, 0 for none


class Layout:
    """The lines that a page's text falls into once its markup is stripped.

    ``blocks`` has for each section and each element that its class, id or role
    marks [the block around it, whether it holds the article or its heading,
    whether it is marked as apart, whether it has a line, whether it or one
    around it was marked when it began]. ``homes`` has (name, the home around
    it) of each article and main, ``sections`` (depth, the section around it).
    """

    def __init__(self, page: str, hints: bool = True) -> None:
        self.lines: list[Line] = []
        self.blocks: list[list] = []
        self.homes: list[tuple[str, int]] = []
        self.sections: list[tuple[int, int]] = [(0, 0)]
        self._hints = hints
        self._parts: list[str] = []
        self._plain = self._gap = self._links = 0
        self._open: list[tuple[str, int, bool, int, int, bool]] = []  # name, block, stripped, home, innermost section, whether that is its own
        self._counts: Counter[str] = Counter()  # open elements by name
        self._stripped = self._data = 0
        self._heading = False
        at, end = 0, len(page)
        while at < end:
            m = MARKUP.search(page, at)
            if m is None:
                self._take(page[at:])
                break
            self._take(page[at : m.start()])
            at = m.end()
            if m[2] is None:
                continue
            name = m[2].lower()
            if m[1]:
                self._end(name)
            elif name in RAW:
                if name not in INLINE:
                    self._close()
                if not m[3].rstrip().endswith("/"):
                    stop = re.compile(rf"</{re.escape(name)}(?:[\s/][^>]*)?(?:>|\Z)", re.I).search(page, at)
                    at = stop.end() if stop else end
            else:
                self._start(name, m[3])
        self._close()

    def apart(self) -> list[bool]:
        """For each block whether it or one around it is apart; those that hold the article are not."""
        out: list[bool] = []
        for around, holds, marked, _, _ in self.blocks:
            out.append(marked and not holds or around >= 0 and out[around])
        return out

    def _at(self) -> tuple[int, int, int]:
        return (self._open[-1][1], self._open[-1][3], self._open[-1][4]) if self._open else (-1, -1, 0)

    def _take(self, text: str) -> None:
        if text and not self._stripped:
            self._parts.append(text := html.unescape(text))
            self._plain += 0 if self._links else len(text.strip())

    def _close(self) -> None:
        if text := SPACE.sub(" ", "".join(self._parts)).strip():
            block, home, section = self._at()
            if block >= 0 and not self.blocks[block][3] and self._hints and labelled(text):
                self.blocks[block][2] = self.blocks[block][4] = True
            at = block
            while at >= 0 and not self.blocks[at][3]:
                self.blocks[at][3] = True
                at = self.blocks[at][0]
            self.lines.append(Line(text, self._plain, self._heading, self._gap, block, home, section))
            self._gap = 0
        self._parts.clear()
        self._plain = 0

    def _marked(self, block: int) -> bool:
        return block >= 0 and self.blocks[block][4]

    def _start(self, name: str, attrs: str) -> None:
        if name == "a":
            self._links = 1
        if name in INLINE:
            return
        self._close()
        ended, limits = ENDS.get(name, ((), ()))
        for k in range(len(self._open) - 1, -1, -1) if any(map(self._counts.get, ended)) else ():
            if self._open[k][0] in ended:
                self._leave(k)
            elif self._open[k][0] in limits or self._open[k][0] in SECTIONS:
                break
        if name in VOID:
            return
        block, home, within = self._at()
        stripped = name in APART and not (name == "header" and home >= 0)
        section = name in SECTIONS and not (name in CELLS and self._data)
        if name in MAIN or name == "h1":
            around = block
            while around >= 0 and not self.blocks[around][1]:  # what holds the article is no block apart from it
                around, self.blocks[around][1] = self.blocks[around][0], True
        if name in MAIN:
            self.homes.append((name, home))
            home = len(self.homes) - 1
        elif name not in ("html", "body") and not stripped:
            marked = self._hints and named_apart(attrs)
            if marked or section:
                self.blocks.append([block, False, marked, False, marked or self._marked(block)])
                block = len(self.blocks) - 1
        self._data += name in ("caption", "thead", "th")  # until its table ends, cells are no places of the layout
        if section:
            self.sections.append((self.sections[within][0] + 1, within))
            within = len(self.sections) - 1
        self._open.append((name, block, stripped, home, within, section))
        self._counts[name] += 1
        self._stripped += stripped
        self._heading = name in HEADINGS
        if section and not self._stripped and not self._marked(block):
            self._gap += 1

    def _end(self, name: str) -> None:
        if name == "a":
            self._links = 0
        if name in INLINE:
            return
        self._close()
        for k in range(len(self._open) - 1, -1, -1) if self._counts[name] else ():
            if self._open[k][0] == name:
                return self._leave(k)

    def _leave(self, k: int) -> None:
        """End the k-th open element and those in it."""
        self._close()
        for name, block, stripped, _, _, section in reversed(self._open[k:]):
            if section and not self._stripped and not self._marked(block):
                self._gap += 1
            self._stripped -= stripped
            self._counts[name] -= 1
            if name == "table":
                self._data = 0
        del self._open[k:]
        self._heading = False
        self._links = 0


def in_homes(homes: list[tuple[str, int]], chosen: set[int]) -> list[bool]:
    """For each article and main whether it is chosen or lies in a chosen one; an article within an article, as readers' comments are, is apart from it."""
    out: list[bool] = []
    for k, (name, around) in enumerate(homes):
        nested = name == "article" and around >= 0 and homes[around][0] == "article"
        out.append(k in chosen or around >= 0 and out[around] and not nested)
    return out


def meeting(sections: list[tuple[int, int]], a: int, b: int) -> int:
    """The innermost section around both."""
    while a != b:
        if sections[a][0] >= sections[b][0]:
            a = sections[a][1]
        else:
            b = sections[b][1]
    return a


def main_text(page: str, window: int = 2, surge: float = 150.0, heading: float = 200.0, hints: bool = True) -> str:
    """Text of the lines between surge and dive points, joined by one space.

    A line weighs its length outside links, headings ``heading`` more. Weights
    are summed over windows of so many lines, the empty ones that the tags of
    sections leave included. The text surges where a sum passes the threshold
    (at most half of the page's largest sum); around that place all lines
    belong to it up to where the sums dive to nothing, links and short lines
    included.

    Where the text surges within an article or main element, there is no dive
    before that element's ends: all its lines are kept, however short and
    however laid out, and of the lines outside only a main heading that surges.
    Elsewhere lines between two surging places of one parent belong to them.

    Blocks that their class, id or role, or a first line such as
    ``Advertisement``, marks as apart weigh nothing and have no line, unless
    they hold the article or its heading.
    """
    layout = Layout(page, hints)
    apart = layout.apart()
    rows: list[Line | None] = []  # the page's lines with its empty ones (as many as can matter)
    gap = 0
    for line in layout.lines:
        gap += line.gap
        if line.block >= 0 and apart[line.block]:
            continue
        rows += [None] * min(gap, window)
        rows.append(line)
        gap = 0
    weights = [line.plain + heading * line.heading if line else 0.0 for line in rows]
    runs: list[tuple[float, list[Line]]] = []
    inside = False
    for k, line in enumerate(rows):
        if line is None and all(x is None for x in rows[max(0, k + 1 - window) : k + 1]):
            inside = False  # a whole window is empty: the sums dive
        if line is not None:
            if not inside:
                runs.append((0.0, []))
            inside = True
            most, kept = runs[-1]
            kept.append(line)
            runs[-1] = (max(most, sum(weights[max(0, k + 1 - window) : k + 1])), kept)
    least = min(surge, max((most for most, _ in runs), default=0.0) / 2)
    surging = [k for k, (most, _) in enumerate(runs) if most >= least]
    found = set()  # homes with as much text in a surging run, or the most of it
    for k in surging:
        held: Counter[int] = Counter()
        for line in runs[k][1]:
            held[line.home] += line.plain + heading * line.heading
        found |= {home for home, n in held.items() if home >= 0 and (n >= least or n == max(held.values()))}
    around = in_homes(layout.homes, found)
    if chosen := {h for h in found if not (layout.homes[h][1] >= 0 and around[layout.homes[h][1]])}:
        whole = in_homes(layout.homes, chosen)
        kept = {k for k in surging if all(x.home < 0 and x.heading for x in runs[k][1])}
        return " ".join(x.text for k, (_, lines) in enumerate(runs) for x in lines if k in kept or x.home >= 0 and whole[x.home])
    parent = {k: layout.sections[meeting(layout.sections, runs[k][1][0].section, runs[k][1][-1].section)][1] for k in surging}
    kept = set(surging)
    for i, j in itertools.pairwise(surging):
        if parent[i] == parent[j]:
            kept |= set(range(i, j))
    return " ".join(x.text for k, (_, lines) in enumerate(runs) if k in kept for x in lines)


def extract_html(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of every page, from its whole html.

    Returns page_id, url, text and n_chars (code points), one row per input
    row. Null and empty html give an empty text, and so do pages without any
    block of text. Unclosed markup ends with the page. Texts may be of any
    length; each page is handled alone, in time proportional to its length.
    """
    picked = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py() or "") for x in batch.column("html")]
            sizes = [len(t) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(sizes, pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = dict(picked.dtypes)
    return picked.mapInArrow(extract, f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars long")
