"""Main text of web pages by line-block distribution."""

from __future__ import annotations

import html
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from .common import map_rows

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)"
    r"|<(?P<end2>/?)(?P<name2>[A-Za-z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_RAW = {"script", "style", "textarea", "xmp", "noframes"}
_DROP = {"head", "nav", "header", "footer", "aside", "form", "noscript", "template", "iframe", "object", "embed", "svg", "canvas", "math", "audio", "video", "button", "select", "dialog", "menu", "map", "title"}
_BLOCK = {
    "address", "article", "blockquote", "body", "caption", "center", "dd", "details", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "hr",
    "html", "legend", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul",
}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_SPACED = {"br", "td", "th", "wbr"}
_VOID = {"area", "base", "br", "col", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr", "embed"}
_MARKED = {"article", "main"}
_CLUTTER = {
    "ad", "ads", "adbox", "adslot", "adsense", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "masthead", "header", "footer", "nav", "navbar",
    "navigation", "menu", "menubar", "breadcrumb", "breadcrumbs", "sidebar", "widget", "widgets", "cookie", "cookies", "consent", "gdpr", "notice", "notification", "popup", "modal", "overlay", "newsletter",
    "subscribe", "subscription", "signup", "login", "search", "share", "sharing", "social", "related", "recommended", "comment", "comments", "commentlist", "respond", "replies", "disqus", "pagination", "pager",
    "toolbar", "copyright", "form", "aside",
}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar", "tablist", "status"}
#: Elements that hold paragraphs.
_CONTAINERS = {"article", "body", "center", "div", "main", "section", "td"}
_NAME = re.compile(r"[-_:]+|(?<=[a-z])(?=[A-Z])")


@dataclass
class Line:
    text: str
    linked: int
    mark: int = 0  # the number of the outermost element around it that markup names as the article
    heading: bool = False
    place: int = 0  # the number of the innermost open container
    paragraph: bool = False


def _clutter(name: str, attrs: str) -> bool:
    """Whether class, id, role or visibility say that an element is no content."""
    if not attrs or name in ("html", "body", "main"):
        return False
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id"):
            for word in value.split():
                parts = [p.lower() for p in _NAME.split(word) if p]
                if parts and parts[0] not in ("has", "with", "no") and (parts[0] in _CLUTTER or parts[-1] in _CLUTTER):
                    return True
        elif key == "role" and value.lower() in _ROLES:
            return True
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
    return False


def _marks(name: str, attrs: str) -> bool:
    return name in _MARKED or bool(attrs) and bool(re.search(r"""(?:role\s*=\s*["']?main\b|itemprop\s*=\s*["']?articleBody\b)""", attrs, re.I))


def strip_markup(page: str, gap: int = 3) -> list[Line]:
    """A page's text as lines, one a block; ``gap`` empty lines stand where an element was removed."""
    lines: list[Line] = []
    parts: list[str] = []
    state = {"linked": 0, "block": ""}
    open_marks: list[str] = []
    n_marks = 0
    skip: list | None = None  # [name, depth, len(lines), named by class only]
    in_link, at, size = 0, 0, len(page)
    inside: list[tuple[str, int]] = []  # open containers
    n_containers = 0

    def flush() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            lines.append(Line(text, state["linked"], n_marks if open_marks else 0, state["block"] in _HEADINGS, inside[-1][1] if inside else 0, state["block"] == "p"))
        parts.clear()
        state["linked"] = 0

    def removed() -> None:
        flush()
        lines.extend(Line("", 0, n_marks if open_marks else 0) for _ in range(gap))

    while at < size:
        m = _TOKEN.search(page, at)
        text = page[at : m.start() if m else size]
        if text and skip is None:
            parts.append(text)
            if in_link:
                state["linked"] += len(text)
        if m is None:
            break
        at = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        closing, attrs = bool(m["end"] or m["end2"]), m["attrs"] or m["attrs2"] or ""
        if not closing and name in _RAW:
            if not attrs.endswith("/"):
                end = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else size
            continue
        if skip is not None:
            if skip[2] and not closing and name in _MARKED and not _clutter(name, attrs):
                skip = None  # it only wraps the article, whatever its class says
            elif name == skip[0] and (closing or name not in ("p", "li")):
                skip[1] += -1 if closing else 1
                if skip[1] == 0:
                    skip = None
                continue
            elif name == skip[0] or skip[0] == "p" and name in _BLOCK or skip[0] == "head" and name == "body" or closing and name in _MARKED and open_marks:
                skip = None
            else:
                continue
        if closing:
            if name in _BLOCK:
                flush()
                state["block"] = ""
                if name in _CONTAINERS and any(x == name for x, _ in inside):
                    while inside.pop()[0] != name:
                        pass
            elif name in _SPACED:
                parts.append(" ")
            if name == "a":
                in_link = max(0, in_link - 1)
            if name in open_marks:
                while open_marks.pop() != name:
                    pass
            continue
        if name not in _VOID and (name in _DROP or _clutter(name, attrs)):
            if attrs.endswith("/") and name not in _BLOCK:
                continue
            removed()
            skip = [name, 1, name not in _DROP and not open_marks]
            continue
        if name in _BLOCK:
            flush()
            state["block"] = name
        elif name in _SPACED:
            parts.append(" ")
        if name in _CONTAINERS:
            n_containers += 1
            inside.append((name, n_containers))
        if name == "a":
            in_link += 1
        if name not in _VOID and _marks(name, attrs):
            n_marks += not open_marks
            open_marks.append(name)
    flush()
    return lines


def surges(lines: Sequence[Line], sizes: Sequence[int], window: int, least: int) -> list[int]:
    """The lines between surge and dive points.

    Text surges at a line where the block of ``window`` lines exceeds ``least``,
    past short lines without which it still does (but for headings), and dives
    where it becomes empty.
    """
    blocks = [sum(sizes[i : i + window]) for i in range(len(sizes))]
    taken, i = [], 0
    while i < len(lines):
        lead = sizes[i] < least and not lines[i].heading and sum(sizes[i + 1 : i + window]) > least
        if not sizes[i] or blocks[i] <= least or lead:
            i += 1
            continue
        while i < len(lines) and blocks[i] > 0:
            if sizes[i]:
                taken.append(i)
            i += 1
    return taken


def main_lines(lines: list[Line], window: int = 3, surge: int = 86) -> list[str]:
    """The lines of the main text, which surge and dive points of the line-block distribution locate.

    A block is ``window`` successive lines; its size is their length without
    linked text, and a line that is all links counts as empty.  If no block
    is large, any text surges.  Of what surges, the text goes on:

    * Where markup names an article, to the ends of the article that it lies in;
      articles without a surge, such as teasers, are left out unless none has one.
    * Else over what has text outside links between its first and last line, on both sides over
      the short lines of the same container up to the next removed element, and over all
      paragraphs (p), linked ones included, of the innermost containers that hold a paragraph found.
    """
    marked = any(x.mark and x.text for x in lines)
    sizes = [len(x.text) if x.mark else max(0, len(x.text) - x.linked) for x in lines]
    for least in (surge, 0):
        if marked:
            found = {m for m in {x.mark for x in lines} - {0} if surges(*zip(*((x, n) for x, n in zip(lines, sizes) if x.mark == m)), window, least)}
            taken = [i for i, x in enumerate(lines) if x.text and x.mark in found]
        else:
            taken = surges(lines, sizes, window, least)
        if taken and least and not marked:
            first, last = taken[0], taken[-1]
            while first > 0 and sizes[first - 1] and lines[first - 1].place == lines[taken[0]].place:
                first -= 1
            while last + 1 < len(lines) and sizes[last + 1] and lines[last + 1].place == lines[taken[-1]].place:
                last += 1
            places = {lines[i].place for i in taken if lines[i].paragraph}
            taken = [i for i, x in enumerate(lines) if sizes[i] and first <= i <= last or x.text and x.paragraph and x.place in places]
        if taken:
            return [lines[i].text for i in taken]
    return []


def main_text(page: str | None, window: int = 3, surge: int = 86) -> str:
    """A page's main blocks, joined by empty lines ("" for null or empty pages)."""
    return "\n\n".join(main_lines(strip_markup(page, window), window, surge)) if page else ""


def extract_main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", window: int = 3, surge: int = 86) -> DataFrame:
    """``page_id, url, text, n_chars`` for each row of ``pages``.

    Null or empty html gives an empty text; null ids and urls stay null;
    repeated rows are extracted each; pages of any length are read whole, and
    truncated ones give what they hold.  Other columns, whatever their names,
    play no part; an empty table gives no rows.  A page is one row's work,
    without a shuffle.
    """

    def run(columns: list) -> list:
        texts = [main_text(page, window, surge) for page in columns[2]]
        return [columns[0], columns[1], texts, [len(t) for t in texts]]

    kind = dict(pages.dtypes)[id_col]
    return map_rows(pages.select(id_col, url_col, html_col), run, f"page_id {kind}, url string, text string, n_chars long")
