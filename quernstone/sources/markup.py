"""HTML read once per page: tables with spans and nesting, page metadata, and clean text with a veto on removals.

A page becomes a flat list of elements in document order, each with the stretch of text pieces that it holds, so any element's
text is a slice and every question about it a search in sorted positions: the work is linear in the page (times a logarithm), however deep
elements nest. Spark deals the pages; each function below turns batches of (id, html) into batches of rows.

Defined results: null html is an empty page; tags that are never closed end with their parent; end tags without a start are ignored; rows, cells, list items and paragraphs
end where the next one begins; malformed JSON is no evidence; pages may be of any length and depth.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Which elements hold no text, which words in an id or class mark page furniture, what no removal may take, and pages that are no articles.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
STRIPPED = {"script", "style", "noscript", "iframe", "form", "button", "svg", "template", "link", "meta"}
FURNITURE = [
    "nav", "navbar", "menu", "breadcrumb", "advert", "ad", "ads", "ad-slot", "promo", "sponsor", "cookie", "consent", "gdpr", "share", "social", "newsletter", "subscribe", "signup", "sign-in", "login",
    "paywall", "related", "recommend", "read-more", "most-read", "most-popular", "trending", "comment", "comments", "footer", "copyright", "sidebar", "widget", "search", "masthead", "site-header",
]
ARCHIVE_IDS = ("wm-ipp", "donato", "wm-capinfo")
KEPT_WORDS = [
    "conservative", "labour", "liberal democrat", "lib dem", "libdem", "green party", "reform", "ukip", "independent", "resident", "candidate", "council", "election", "vote",
    "ballot", "ward", "division", r"\bmp\b", "minister", "campaign",
]
NO_ARTICLE = [
    "just a moment", "one moment", "checking your browser", "access denied", "attention required", "verify you are human", "verify you are a human", "page not found", "error 403", "error 404",
    "search result", "no results found", "to continue reading",
]
CONTENT = ("h1", "h2", "h3", "h4", "p", "blockquote", "li", "figcaption")
PROSE = 280
SHORT_BODY, MOST_REMOVED = 300, 0.98
DATE_PROPERTIES, DATE_NAMES = ("article:published_time", "og:article:published_time"), ("parsely-pub-date", "date", "article.published")

_furniture = re.compile(r"(?:^|[-_ ])(?:" + "|".join(map(re.escape, FURNITURE)) + r")(?:$|[-_ ])", re.I)
_kept, _no_article, _sentence = re.compile("|".join(KEPT_WORDS), re.I), re.compile("|".join(NO_ARTICLE), re.I), re.compile(r"[.!?]\s+\w")
_quote = re.compile("[\"“‘]")

#: a start tag -> the open elements that it ends, and those that shield them
ENDS = {
    "p": ({"p"}, {"table", "td", "th", "li", "div", "article", "section", "blockquote", "figure"}), "li": ({"li"}, {"ul", "ol", "table"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"}),
    **{t: ({"p"}, {"table", "td", "th"}) for t in ("div", "ul", "ol", "table", "h1", "h2", "h3", "h4", "section", "article", "blockquote", "figure")},
}


@dataclass
class Element:
    tag: str
    attrs: dict[str, str]
    parent: int
    first: int  # its text pieces are first <= i < last, its descendants the elements up to ``end``
    last: int = 0
    end: int = 0


_name, _space, _bare, _value = re.compile(r"[^\s/>]+"), re.compile(r"[\s/]*"), re.compile(r"[^\s/>=]+|="), re.compile(r"[^\s>]*")
RAW = {t: re.compile(f"</{t}(?=[\\s/>]|$)", re.I) for t in ("script", "style", "title", "textarea", "noscript", "iframe")}


Decode = Callable[[str], str]


def named_entities(names: dict[str, str]) -> Decode:
    """Decodes these entities only, exactly as they are written, one after another; every other one stays as text."""

    def decode(text: str) -> str:
        for entity, character in names.items():
            text = text.replace(entity, character)
        return text

    return decode


def tokens(html: str, decode: Decode = unescape) -> Iterator[tuple[str, str, dict[str, str]]]:
    """("text", piece, {}), ("start", tag, attributes) and ("end", tag, {}) in one pass. A quote that is never closed ends with the value's
    last character before a blank or ``>``; that there is no further quote is found once, so no page makes the scan go back."""
    i, size, missing = 0, len(html), set()

    def attributes(i: int) -> tuple[dict[str, str], int]:
        out: dict[str, str] = {}
        while True:
            i = _space.match(html, i).end()
            if i >= size or html[i] == ">":
                return out, i + 1
            name = _bare.match(html, i)
            i = _space.match(html, name.end()).end() if name.end() < size and html[name.end()].isspace() else name.end()
            value = ""
            if i < size and html[i] == "=" and name[0] != "=":
                i = _space.match(html, i + 1).end() if i + 1 < size and html[i + 1].isspace() else i + 1
                quote = html[i : i + 1]
                end = html.find(quote, i + 1) if quote in ('"', "'") and quote not in missing else -1
                if end >= 0:
                    value, i = html[i + 1 : end], end + 1
                else:
                    if quote in ('"', "'"):
                        missing.add(quote)
                    found = _value.match(html, i)
                    value, i = found[0].strip("\"'"), found.end()
            out.setdefault(name[0].lower(), decode(value))

    while i < size:
        at = html.find("<", i)
        if at < 0:
            at = size
        if at > i:
            yield "text", decode(html[i:at]), {}
        if at >= size:
            return
        after = html[at + 1 : at + 2]
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4)
            i = size if end < 0 else end + 3
        elif after in ("!", "?") or after == "/" and not html[at + 2 : at + 3].isalpha():
            end = html.find(">", at)
            i = size if end < 0 else end + 1
        elif after == "/":
            name = _name.match(html, at + 2)
            end = html.find(">", name.end())
            i = size if end < 0 else end + 1
            yield "end", name[0].lower(), {}
        elif after.isalpha():
            name = _name.match(html, at + 1)
            attrs, i = attributes(name.end())
            tag = name[0].lower()
            yield "start", tag, attrs
            if tag in RAW:
                close = RAW[tag].search(html, i)
                end = close.start() if close else size
                if end > i:
                    yield "text", html[i:end] if tag in ("script", "style") else decode(html[i:end]), {}
                i = end
        else:
            yield "text", "<", {}
            i = at + 1


@dataclass
class Page:
    elements: list[Element] = field(default_factory=list)
    pieces: list[tuple[int, str]] = field(default_factory=list)  # (element, text)
    open: list[int] = field(default_factory=list)
    count: dict[str, int] = field(default_factory=dict)  # open elements by tag

    @staticmethod
    def of(html: str | None, decode: Decode = unescape) -> Page:
        page = Page()
        for kind, what, attrs in tokens(html or "", decode):
            if kind == "text":
                page.add_text(what)
            elif kind == "start":
                page.start(what, attrs)
            else:
                page.stop(what)
        page._shut(0)
        return page

    def _shut(self, depth: int) -> None:
        for i in self.open[depth:]:
            self.elements[i].last, self.elements[i].end = len(self.pieces), len(self.elements)
            self.count[self.elements[i].tag] -= 1
        del self.open[depth:]

    def start(self, tag: str, attrs: dict[str, str]) -> None:
        ended, shields = ENDS.get(tag, ((), ()))
        for depth in range(len(self.open) - 1, max(-1, len(self.open) - 64), -1):  # what ends stands near the top
            name = self.elements[self.open[depth]].tag
            if name in shields:
                break
            if name in ended:
                self._shut(depth)
        self.elements.append(Element(tag, attrs, self.open[-1] if self.open else -1, len(self.pieces), len(self.pieces), len(self.elements) + 1))
        if tag not in VOID:
            self.open.append(len(self.elements) - 1)
            self.count[tag] = self.count.get(tag, 0) + 1

    def stop(self, tag: str) -> None:
        shields = ENDS.get(tag, ((), ()))[1] if tag in ("p", "li", "tr", "td", "th") else ()
        if not self.count.get(tag):
            return
        for depth in range(len(self.open) - 1, -1, -1):
            name = self.elements[self.open[depth]].tag
            if name == tag:
                return self._shut(depth)
            if name in shields and name != tag:
                return

    def add_text(self, data: str) -> None:
        if data.strip():
            self.pieces.append((self.open[-1] if self.open else -1, data))

    def text(self, e: Element, gone: list[bool] | None = None) -> str:
        """The element's text, its pieces joined by blanks; ``gone`` pieces are left out."""
        return " ".join(self.pieces[i][1].strip() for i in range(e.first, e.last) if gone is None or not gone[i])

    def nearest(self, i: int, tags: set[str]) -> int:
        """The closest ancestor of element ``i`` with one of the tags, or -1."""
        i = self.elements[i].parent
        while i >= 0 and self.elements[i].tag not in tags:
            i = self.elements[i].parent
        return i


def _spans(value: str | None, most: int) -> int:
    return min(most, max(1, int(value))) if value and value.strip().isdigit() else 1


def tables(html: str | None) -> list[tuple[int, int, list[str]]]:
    """(table, row, cells) of every table, nested ones too, in document order. A cell with rowspan or colspan (at most 1,000) stands in each
    place that it covers, within the table's rows; the text of a nested table is also text of the cell that holds it."""
    page = Page.of(html)
    blank = re.compile(r"\s+")
    number: dict[int, int] = {}
    rows: dict[int, list[list[int]]] = {}
    owner: list[int] = []  # nearest table of every element, itself included
    for i, e in enumerate(page.elements):
        owner.append(i if e.tag == "table" else owner[e.parent] if e.parent >= 0 else -1)
        if e.tag == "table":
            number[i] = len(number)
            rows[i] = []
        elif owner[i] >= 0 and e.tag == "tr":
            rows[owner[i]].append([])
        elif owner[i] >= 0 and e.tag in ("td", "th"):
            if not rows[owner[i]]:
                rows[owner[i]].append([])
            rows[owner[i]][-1].append(i)
    out = []
    for t, lines in rows.items():
        waiting: dict[int, tuple[int, str]] = {}  # column -> (rows still covered, text)
        for k, cells in enumerate(lines):
            line: list[str] = []

            def covered(line=line, waiting=waiting):
                while (at := len(line)) in waiting:
                    left, text = waiting.pop(at)
                    line.append(text)
                    if left > 1:
                        waiting[at] = (left - 1, text)

            for i in cells:
                covered()
                e = page.elements[i]
                text = blank.sub(" ", page.text(e)).strip()
                down = _spans(e.attrs.get("rowspan"), len(lines) - k)
                for _ in range(_spans(e.attrs.get("colspan"), 1000)):
                    if down > 1:
                        waiting[len(line)] = (down - 1, text)
                    line.append(text)
            covered()
            out.append((number[t], k, line))
    return sorted(out, key=lambda r: r[:2])


#: Bytes that str.strip() takes away, those that make a cell's text differ from its slice of the page, bytes of pages that are read at once, and the characters of tags in
#: remembered shapes.
_BLANK = np.zeros(256, bool)
_BLANK[[*range(9, 14), *range(28, 33)]] = True
_ODD = _BLANK.copy()
_ODD[32], _ODD[128:] = False, True
_AT_ONCE, _REMEMBERED = 2_000_000, 4_000_000

Places = list[tuple[int, int, list[list[int]]]]


def _stands_alone(tag: str) -> bool:
    """Whether ``tag`` is one start or end tag that ends with its last character, whatever follows, and whose content is read as any other's."""
    rest = "z\"'"
    found = list(tokens(tag + rest))
    return len(found) == 2 and found[0][0] != "text" and found[0][1] not in RAW and found[1] == ("text", rest, {})


def _upto(marks: np.ndarray) -> np.ndarray:
    """How many of the bytes before each place are marked."""
    return np.concatenate([np.zeros(1, np.int32), np.cumsum(marks, dtype=np.int32)])


def _slices(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """The texts at begin <= byte < end."""
    size = end - begin
    offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])
    flat = data[np.arange(offsets[-1]) + np.repeat(begin - offsets[:-1], size)]
    return pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])


class Shapes:
    """``tables`` for many pages. Pages of one shape (the same tags in the same order, text in the same gaps between them) have their cells in the same gaps, so one
    page of each shape that several pages have is parsed, with the gaps' numbers for texts, and all their cells are cut out of the pages' bytes together. A page whose
    shape no other has, or with entities, comments, scripts, or ``<`` or ``>`` outside of tags, is parsed by itself."""

    def __init__(self) -> None:
        self.known: dict[tuple, Places | None] = {}
        self.held = 0

    def places(self, tags: tuple[str, ...], filled: np.ndarray) -> Places | None:
        """(table, row, gaps of each cell) of pages with these tags and texts in the ``filled`` gaps; None if the tags do not tell."""
        key = (tags, filled.tobytes())
        if key not in self.known:
            size = sum(map(len, tags))
            if self.held + size > _REMEMBERED:
                self.known, self.held = {}, 0
            texts = [f" {k} " if full else "" for k, full in enumerate(filled)]
            rows = tables(texts[0] + "".join(t + x for t, x in zip(tags, texts[1:], strict=True))) if all(map(_stands_alone, set(tags))) else None
            self.known[key] = None if rows is None else [(t, r, [[int(k) for k in c.split()] for c in cells]) for t, r, cells in rows]
            self.held += size
        return self.known[key]

    def read(self, pages: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
        """(number of the page, table_no, row_no, cells) of all rows, in batches, by page, table and row."""
        pages = pages.cast(pa.large_string()).fill_null("")
        cut = np.frombuffer(pages.buffers()[1], np.int64)[pages.offset : pages.offset + len(pages) + 1]
        at = 0
        while at < len(pages):
            upto = max(at + 1, int(np.searchsorted(cut, cut[at] + _AT_ONCE, "right")) - 1)
            page, *rest = self._read(pages[at:upto])
            yield page + at, *rest
            at = upto

    def _read(self, pages: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        alone, parts = np.ones(len(pages), bool), []
        for at, part in self._alike(pages) if len(pages) > 1 else ():
            alone[at] = False
            parts.append(part)
        rows = [(int(k), *r) for k in np.flatnonzero(alone) for r in tables(pages[int(k)].as_py())]
        parts.append((*(np.array([r[i] for r in rows], np.int64) for i in range(3)), pa.array([r[3] for r in rows], pa.list_(pa.large_string()))))
        page, table, row = (np.concatenate([p[i] for p in parts]) for i in range(3))
        order = np.argsort(page, kind="stable")
        return page[order], table[order], row[order], pa.concat_arrays([p[3] for p in parts]).take(pa.array(order))

    def _alike(self, pages: pa.Array) -> Iterator[tuple[np.ndarray, tuple]]:
        """For each shape that several pages have: these pages, and their rows."""
        cut = np.frombuffer(pages.buffers()[1], np.int64)[pages.offset : pages.offset + len(pages) + 1]
        data = np.frombuffer(pages.buffers()[2] or b"", np.uint8)[cut[0] : cut[-1]]
        cut = cut - cut[0]
        less, more = np.flatnonzero(data == ord("<")), np.flatnonzero(data == ord(">"))
        first, last = np.searchsorted(less, cut), np.searchsorted(more, cut)
        count = np.diff(first)
        plain = (count > 0) & (count == np.diff(last)) & (np.diff(np.searchsorted(np.flatnonzero(data == ord("&")), cut)) == 0)
        space, blank = data == ord(" "), _BLANK[data]
        odd = _ODD[data]
        odd[1:] |= space[1:] & space[:-1]
        solid, high, odd = _upto(~blank & (data < 128)), _upto(data >= 128), _upto(odd)
        ink = np.flatnonzero(~blank)
        for size in np.unique(count[plain]).tolist():
            at = np.flatnonzero(plain & (count == size))
            a, b = less[first[at][:, None] + np.arange(size)], more[last[at][:, None] + np.arange(size)]
            turns = (a < b).all(axis=1) & (b[:, :-1] < a[:, 1:]).all(axis=1)
            at, a, b = at[turns], a[turns], b[turns] + 1
            begin, end = np.hstack([cut[at][:, None], b]), np.hstack([a, cut[at + 1][:, None]])
            filled = solid[end] > solid[begin]
            told = ~((high[end] > high[begin]) & ~filled).any(axis=1)  # such a gap may be blank or not
            tags = _slices(data, a.ravel(), b.ravel()).dictionary_encode()
            shape = np.hstack([tags.indices.to_numpy().reshape(a.shape), filled]).astype(np.int32)
            kinds: dict[bytes, list[int]] = {}
            for k in np.flatnonzero(told).tolist():
                kinds.setdefault(shape[k].tobytes(), []).append(k)
            for same in kinds.values():
                if len(same) > 1:
                    places = self.places(tuple(tags.dictionary.take(pa.array(shape[same[0], :size])).to_pylist()), filled[same[0]])
                    if places is not None:
                        yield at[same], _cut_out(data, ink, odd, at[same], places, begin[same], end[same])


def _cut_out(data: np.ndarray, ink: np.ndarray, odd: np.ndarray, at: np.ndarray, places: Places, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """The rows of pages ``at``, their cells at ``places`` among the gaps begin <= byte < end (a row per page). ``ink``: bytes that are not blank."""
    cells = [c for _, _, line in places for c in line]
    gap = np.array([c[0] if len(c) == 1 else -1 for c in cells], np.int64)
    a, b = begin[:, gap].ravel(), end[:, gap].ravel()
    single = np.tile(gap >= 0, len(at))
    a, b = np.where(single, ink[np.minimum(np.searchsorted(ink, a), len(ink) - 1)], 0), np.where(single, ink[np.searchsorted(ink, b) - 1] + 1, 0)
    text = _slices(data, a, b)
    written = np.flatnonzero((odd[b] > odd[a]) | np.tile(np.array([len(c) > 1 for c in cells], bool), len(at)))
    if len(written):
        texts, blank = text.to_numpy(zero_copy_only=False), re.compile(r"\s+")
        for k in written.tolist():
            p, c = divmod(k, len(cells))
            texts[k] = blank.sub(" ", " ".join(data[begin[p, g] : end[p, g]].tobytes().decode().strip() for g in cells[c])).strip()
        text = pa.array(texts, pa.large_string())
    bounds = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.tile(np.array([len(line) for _, _, line in places], np.int64), len(at)))])
    table, row = (np.tile(np.array([x[i] for x in places], np.int64), len(at)) for i in (0, 1))
    return np.repeat(at, len(places)), table, row, pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), text)


def metadata(html: str | None, decode: Decode = unescape) -> list[tuple[str, str, str]]:
    """(field, value, found_in): all titles, authors, dates and languages that a page states, in document order by kind of place.
    ``decode`` turns entities into characters: all that HTML knows, also those cut off before their semicolon, unless told otherwise."""
    page = Page.of(html, decode)
    own = [(e, page.text(e)) for e in page.elements if e.tag in ("script", "title")]
    out: list[tuple[str, str, str]] = []
    for e, text in own:
        if e.tag == "script" and e.attrs.get("type", "").strip().lower() == "application/ld+json":
            try:
                found = json.loads(text)
            except (ValueError, RecursionError):
                continue
            for top in found if isinstance(found, list) else [found]:
                graph = top.get("@graph") if isinstance(top, dict) else None
                for node in graph if isinstance(graph, list) else [top]:
                    if isinstance(node, dict):
                        author = node.get("author")
                        names = [a.get("name") if isinstance(a, dict) else a for a in (author if isinstance(author, list) else [author])]
                        stated = [("title", node.get("headline")), ("published", node.get("datePublished")), *[("author", n) for n in names]]
                        out += [(k, str(v), "json_ld") for k, v in stated if v]
    for e in page.elements:
        value = e.attrs.get("content", "").strip()
        prop, name = e.attrs.get("property", "").strip().lower(), e.attrs.get("name", "").strip().lower()
        if e.tag == "meta" and value:
            if prop == "og:title" or prop in DATE_PROPERTIES:
                out.append(("title" if prop == "og:title" else "published", value, "open_graph"))
            if name in DATE_NAMES or name == "author":
                out.append(("author" if name == "author" else "published", value, "meta"))
        if e.tag == "time" and e.attrs.get("datetime"):
            out.append(("published", e.attrs["datetime"], "time"))
        if e.tag == "html" and e.attrs.get("lang"):
            out.append(("language", e.attrs["lang"], "html"))
    return out + [("title", text, "title") for e, text in own if e.tag == "title" and text]


def _match(page: Page, i: int, steps: list[tuple[str, str | None]]) -> bool:
    """Whether element ``i`` is what the path of (tag, class or None) steps selects, the last step being itself."""
    fits = lambda e, s: e.tag == s[0] and (s[1] is None or s[1] in e.attrs.get("class", "").split())
    if not fits(page.elements[i], steps[-1]):
        return False
    at, rest = page.elements[i].parent, list(steps[:-1])
    while rest and at >= 0:
        if fits(page.elements[at], rest[-1]):
            rest.pop()
        at = page.elements[at].parent
    return not rest


def selector(path: str) -> list[tuple[str, str | None]]:
    """``main article`` or ``div.entry`` as steps."""
    return [(s.split(".")[0], s.split(".")[1] if "." in s else None) for s in path.split()]


@dataclass
class Cleaned:
    title: str
    body: str
    captions: list[str]
    selector: str
    status: str
    warnings: list[str]
    kept: list[str]  # why and what: blocks that look like furniture and stay
    removed_ratio: float


def clean(html: str | None, own_selectors: tuple[str, ...] = ()) -> Cleaned:
    """The page's article text. Blocks whose id or class says furniture go, unless their text holds a quotation, a word of KEPT_WORDS or several
    sentences: those stay and are reported. The body is what the first selector with text selects, own ones before article, main and body."""
    page = Page.of(html)
    texts = [(e, page.text(e)) for e in page.elements if e.tag in ("title", "h1")]
    hidden = [False] * len(page.pieces)
    upto = 0
    for e in page.elements:
        if e.first < upto:  # within one that is hidden
            continue
        if e.tag in STRIPPED or e.tag not in ("html", "body") and e.attrs.get("id", "").startswith(ARCHIVE_IDS):
            hidden[e.first : e.last] = [True] * (e.last - e.first)
            upto = e.last
    stated = next((e.attrs.get("content", "") for e in page.elements if e.tag == "meta" and e.attrs.get("property") == "og:title"), "")
    title = (stated or next((t for e, t in texts if e.tag == "h1"), "") or next((t for e, t in texts if e.tag == "title"), "")).strip()
    starts, parts, at = [], [], 0
    for (_, piece), off in zip(page.pieces, hidden, strict=True):
        starts.append(at)
        if not off:
            parts.append(piece.strip())
            at += len(parts[-1]) + 1
    visible = " ".join(parts)
    starts.append(at)
    if _no_article.search(f"{title} {visible[:400]}"):
        return Cleaned(title, "", [], "", "review_required", ["non_article_page"], [], 1.0)
    found = {kind: [m.start() for m in pattern.finditer(visible)] for kind, pattern in (("contains_quotation", _quote), ("kept_word", _kept), ("several_sentences", _sentence))}

    def veto(a: int, b: int) -> str | None:
        inside = lambda kind: (k := bisect_left(found[kind], a)) < len(found[kind]) and found[kind][k] < b
        return next((kind for kind in found if inside(kind) and (kind != "several_sentences" or b - a > PROSE)), None)

    gone, kept, upto = hidden, [], 0
    for e in page.elements:
        if e.first < upto or not _furniture.search(f"{e.attrs.get('id', '')} {e.attrs.get('class', '')}"):
            continue
        why = veto(starts[e.first], starts[e.last])
        if why:
            kept.append(f"{why}: {visible[starts[e.first] : starts[e.last]].strip()[:160]}")
        else:
            gone[e.first : e.last] = [True] * (e.last - e.first)
            upto = max(upto, e.last)  # what stands within has gone too
    left = [0]
    for off in gone:
        left.append(left[-1] + (not off))
    used, root = "none", None
    for path in (*own_selectors, "article", "main", "body"):
        steps = selector(path)
        root = next((e for i, e in enumerate(page.elements) if left[e.last] > left[e.first] and _match(page, i, steps)), None)
        if root is not None:
            used = f"{'own' if path in own_selectors else 'generic'}:{path}"
            break
    paragraphs, captions, done = [], [], 0
    if root is not None:
        for e in page.elements:
            if e.tag in CONTENT and root.first <= e.first and e.last <= root.last and e.first >= done and left[e.last] > left[e.first]:
                paragraphs.append(page.text(e, gone))
                captions += [paragraphs[-1]] if e.tag == "figcaption" else []
                done = e.last
    body = "\n\n".join(paragraphs)
    ratio = 1 - len(body) / len(visible) if visible else 1.0
    warnings = ["empty_extraction"] if not body else ["very_short_body"] if len(body) < SHORT_BODY else []
    warnings += ["extreme_removed_ratio"] * (ratio > MOST_REMOVED and bool(body)) + ["uncertain_blocks_kept"] * bool(kept)
    status = "review_required" if not body else "cleaned_with_warnings" if warnings else "cleaned"
    return Cleaned(title, body, captions, used, status, warnings, kept, round(ratio, 4))


# over DataFrames


def _rows_by_page(pages: DataFrame, id_: str, html: str, read: Callable[[str | None], list[tuple]], columns: str) -> DataFrame:
    """(id, columns) of what ``read`` finds in each page. Columns go to the tasks under made-up names, so any name will do."""
    kind = pages.schema[id_].dataType.simpleString()
    slim = pages.select(F.col(f"`{id_}`").alias("id_"), F.col(f"`{html}`").alias("html_"))
    names = [c.split(" ")[0] for c in columns.split(", ")]
    types = {"int": pa.int32(), "string": pa.string(), "double": pa.float64(), "array<string>": pa.list_(pa.string())}
    arrow = [types[c.split(" ", 1)[1]] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows = [], []
            for k, page in enumerate(b.column(1)):
                found = read(page.as_py())
                at += [k] * len(found)
                rows += found
            parts = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *[pa.array(p, t) for p, t in zip(parts, arrow, strict=True)]], names=["id_", *names])

    return slim.mapInArrow(run, f"id_ {kind}, {columns}").withColumnRenamed("id_", id_)


def table_rows(pages: DataFrame, id_: str, html: str) -> DataFrame:
    """(id, table_no, row_no, cells) of every table row, see ``tables`` and ``Shapes``."""
    kind = pages.schema[id_].dataType.simpleString()
    slim = pages.select(F.col(f"`{id_}`").alias("id_"), F.col(f"`{html}`").alias("html_"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = Shapes()
        for b in batches:
            for page, table, row, cells in shapes.read(b.column(1)):
                found = [b.column(0).take(pa.array(page)), pa.array(table, pa.int32()), pa.array(row, pa.int32()), cells.cast(pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(found, names=["id_", "table_no", "row_no", "cells"])

    return slim.mapInArrow(run, f"id_ {kind}, table_no int, row_no int, cells array<string>").withColumnRenamed("id_", id_)


def evidence(pages: DataFrame, id_: str, html: str, decode: Decode = unescape) -> DataFrame:
    """(id, field, value, found_in): see ``metadata``."""
    return _rows_by_page(pages, id_, html, lambda text: metadata(text, decode), "field string, value string, found_in string")


def cleaned(pages: DataFrame, id_: str, html: str, own_selectors: tuple[str, ...] = ()) -> DataFrame:
    """One row per page: see ``clean``."""

    def one(text: str | None) -> list[tuple]:
        c = clean(text, own_selectors)
        return [(c.title, c.body, c.captions, c.selector, c.status, c.warnings, c.kept, c.removed_ratio)]

    columns = "title string, body string, captions array<string>, selector string, status string, warnings array<string>, kept array<string>, removed_ratio double"
    return _rows_by_page(pages, id_, html, one, columns)
