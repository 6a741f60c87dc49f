"""Main text of web pages by scoring the tree of blocks."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import small_batches

_TAG_NAME = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_VALUE_OR_END = re.compile(r">|=\s*+([\"'])")
#: So many unclosed quotes are searched to the end of a page; after that quotes in tags mean nothing.
_LOST_QUOTES = 8
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "noscript", "textarea", "template", "title")}
_NAMES = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr".split())
#: Elements that are never part of an article's text.
_OUTSIDE = frozenset(
    "head script style noscript template textarea nav header footer aside iframe object svg math canvas select button "
    "menu dialog audio video map fieldset input".split())
#: Words of a class, id or role that mark such parts, whole or as the start of a longer word.
_OUTSIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promoted promotion banner cookie cookies consent "
    "gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login sidebar aside rail menu nav navbar "
    "navigation breadcrumb breadcrumbs pagination pager footer header masthead topbar toolbar comment comments commentlist disqus reply replies respond "
    "share sharing social related recommended recommendations widget widgets search contentinfo complementary dialog form".split())
_WORD = re.compile(r"[a-z]+")
#: A word behind one of these in a compound says what a part has or lacks, not what it is.
_ABOUT = frozenset("no not has have with without".split())
_KEPT = frozenset(("html", "body", "article", "main"))
#: Words that say where or how a part stands, not what it is about.
_PLACE_WORDS = frozenset(
    "area bar body block bottom box col column container content group inner item items left list outer panel part rail right row section site "
    "page slot thread top unit wrap wrapper zone the my user main global primary secondary".split())
#: Of the marking words, those that also mark in a compound with place words, however much text the part holds.
_PLAIN_WORDS = _OUTSIDE_WORDS - frozenset("alert dialog form notice notices promotion related respond search social".split())
_CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody"), "body": ("head",),
}
_STOPS = frozenset(("ul", "ol", "dl", "table", "article", "section", "div", "main", "body"))
_TAG_POINTS = {"article": 25.0, "main": 15.0}


class Page:
    """The block tree of one page. Node 0 is the page itself.

    With ``markers``, forms and elements marked by class, id or role are left out, but for those that hold the main or first
    heading and over half of the page's text: they are wrappers of the article. A mark that is only a word of a compound
    is a hint: it halves the part's score, and leaves the part out only if it is poor in text or rich in links.
    """

    def __init__(self, source: str, markers: bool = True):
        self.tag, self.parent, self.outside, self.marked = ["#page"], [0], [False], [0]
        self.open: list[int] = [0]
        self.depths: dict[str, list[int]] = {}
        self.stops: list[int] = []
        self.blocks: list[tuple[int, str, int]] = []
        self._read(source)
        if markers:
            self._leave_out()
        else:
            self.marked = [0] * len(self.tag)

    def _sums(self) -> tuple[list[int], list[int]]:
        """Characters and characters of links inside each node, summed once from the last node to the first."""
        chars, linked = [0] * len(self.tag), [0] * len(self.tag)
        for node, text, links in self.blocks:
            chars[node] += len(text)
            linked[node] += links
        for n in range(len(self.tag) - 1, 0, -1):
            chars[self.parent[n]] += chars[n]
            linked[self.parent[n]] += linked[n]
        return chars, linked

    def _leave_out(self) -> None:
        chars, linked = self._sums()
        heads = [tag in ("h1", "main") and not out for tag, out in zip(self.tag, self.outside)]
        for n in range(len(self.tag) - 1, 0, -1):
            heads[self.parent[n]] |= heads[n]
        for n in range(1, len(self.tag)):
            wraps = heads[n] and 2 * chars[n] > chars[0]
            rich = chars[n] >= 80 and 4 * linked[n] < chars[n]
            gone = (self.marked[n] == 2 and not wraps) or (self.marked[n] == 1 and not (wraps or rich))
            self.outside[n] = self.outside[n] or self.outside[self.parent[n]] or gone
        self.blocks = [x for x in self.blocks if not self.outside[x[0]]]

    def _flush(self, node: int, pieces: list[str], linked: int) -> None:
        if pieces and not self.outside[node]:
            text = "".join(pieces)
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            if text:
                self.blocks.append((node, text, min(linked, len(text))))
        pieces.clear()

    @staticmethod
    def _tag_end(source: str, at: int, lost: int) -> tuple[int, int]:
        """Place behind the tag whose attributes begin at ``at`` (-1: the page ends in it), and the unclosed quotes met so far."""
        here = at
        while lost < _LOST_QUOTES:
            found = _VALUE_OR_END.search(source, here)
            if found and not found.group(1):
                return found.end(), lost
            close = source.find(found.group(1), found.end()) if found else -1
            if close < 0:
                lost += 1
                break
            here = close + 1
        return source.find(">", at) + 1 or -1, lost

    def _read(self, source: str) -> None:
        """One pass over the page: every tag is read once, whatever is missing in it."""
        pieces: list[str] = []
        linked, at, end, links, lost, last = 0, 0, len(source), 0, 0, source.rfind(">")
        here = 0
        while here < end:
            start = source.find("<", here)
            name, stop, closing = None, -1, ""
            if start < 0:
                start = stop = end
            elif source.startswith("<!--", start):
                stop = source.find("-->", start + 4) + 3
                stop = end if stop == 2 else stop
            elif source.startswith(("<!", "<?"), start):
                stop = source.find(">", start) + 1 if start < last else end
            elif found := _TAG_NAME.match(source, start + 1):
                closing, name = found.groups()
                stop, lost = self._tag_end(source, found.end(), lost) if start < last else (-1, lost)
                rest = source[found.end(): stop - 1] if stop > 0 else ""
                stop = end if stop < 0 else stop
                name = name.lower() if rest or stop < end or source[end - 1] == ">" else None
            else:
                here = start + 1
                continue
            text = source[at:start]
            if text:
                pieces.append(text)
                if links:
                    linked += len(text.strip())
            at = here = stop
            if name is None:
                continue
            if name in _INLINE:
                if name == "br":
                    pieces.append(" ")
                elif name == "a":
                    links = 0 if closing else 1
                continue
            self._flush(self.open[-1], pieces, linked)
            linked = links = 0
            if closing:
                self._close(name)
                continue
            if not (name in _VOID):
                self._open(name, rest)
            if name in _RAW_END:
                found = _RAW_END[name].search(source, at)
                at = here = found.end() if found else end
                self._close(name)
        if at < end:
            pieces.append(source[at:])
        self._flush(self.open[-1], pieces, linked)

    def _cut(self, depth: int) -> None:
        """Close all open nodes from ``depth`` on."""
        while len(self.open) > depth:
            name = self.tag[self.open.pop()]
            self.depths[name].pop()
            if name in _STOPS:
                self.stops.pop()

    def _close(self, name: str) -> None:
        depths = self.depths.get(name)
        if depths and (name != "p" or not self.stops or depths[-1] > self.stops[-1]):
            self._cut(depths[-1])

    def _open(self, name: str, rest: str) -> None:
        if self.tag[self.open[-1]] == "p":
            self._cut(len(self.open) - 1)
        for other in _CLOSES.get(name, ()):
            depths = self.depths.get(other)
            if depths and (not self.stops or depths[-1] >= self.stops[-1]):
                self._cut(depths[-1])
        parent, node = self.open[-1], len(self.tag)
        self.tag.append(name)
        self.parent.append(parent)
        named = bool(rest) and name not in _KEPT
        self.outside.append(self.outside[parent] or name in _OUTSIDE or (named and _HIDDEN.search(rest) is not None))
        self.marked.append(2 if name == "form" else _marked(rest) if named else 0)
        self.depths.setdefault(name, []).append(len(self.open))
        if name in _STOPS:
            self.stops.append(len(self.open))
        self.open.append(node)

    def main_text(self) -> list[str]:
        """The blocks of the best container and its siblings, but those of links, in page order.

        A block gives 1 point, 1 for each comma and up to 3 for its length, less its share of link text, to its container.
        A container passes half of its points to its parent; inside an article or main element, all. A hint halves a score.
        """
        if not self.blocks:
            return []
        count = len(self.tag)
        points, (chars, linked) = [0.0] * count, self._sums()
        for node, text, links in self.blocks:
            points[self._container(node)] += (1 + text.count(",") + min(len(text) / 100, 3.0)) * (1 - links / len(text))
        within = [False] * count
        for n in range(1, count):
            within[n] = within[self.parent[n]] or self.tag[self.parent[n]] in _TAG_POINTS
        for n in range(count - 1, 0, -1):
            points[self.parent[n]] += points[n] * (1.0 if within[n] and self.tag[n] not in _TAG_POINTS else 0.5)
        score = [
            (points[n] + _TAG_POINTS.get(self.tag[n], 0.0)) * (1 - linked[n] / chars[n]) * (0.5 if self.marked[n] else 1.0)
            if chars[n] and points[n] else 0.0 for n in range(count)
        ]
        best = max(range(count), key=lambda n: (score[n], -n))
        keep = {best}
        if best:
            for n in range(1, count):
                if n != best and self.parent[n] == self.parent[best] and not self.outside[n] and chars[n]:
                    density = linked[n] / chars[n]
                    if score[n] >= max(10.0, 0.2 * score[best]) or self.tag[n] == self.tag[best] == "p" or density < 0.25:
                        keep.add(n)
        inside = [n in keep for n in range(count)]
        for n in range(1, count):
            inside[n] = inside[n] or inside[self.parent[n]]
        return [text for node, text, _ in self.blocks if inside[node]]

    def _container(self, node: int) -> int:
        return self.parent[node] if self.tag[node] in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "li", "td", "dd", "dt") else node


def _marked(rest: str) -> int:
    """2 if a class, id or role marks a part that is not the article's, 1 if a word of a compound hints at one, else 0."""
    mark = 0
    for _, value in _NAMES.findall(rest):
        for name in value.lower().split():
            words = _WORD.findall(name)
            found = [w for i, w in enumerate(words) if w in _OUTSIDE_WORDS and (not i or words[i - 1] not in _ABOUT)]
            if not found:
                continue
            if len(words) == 1 or (not _PLAIN_WORDS.isdisjoint(found) and all(w in _PLACE_WORDS or w in _OUTSIDE_WORDS for w in words)):
                return 2
            mark = 1
    return mark


def main_text(source: str | None) -> str:
    """The main text of one page; a page without text gives the empty string.

    A page of which markers and forms leave nothing is read again without regard to them.
    """
    return "\n\n".join(Page(source).main_text() or Page(source, markers=False).main_text()) if source else ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page.

    pages: page_id, url, html; other columns are not read. Null or empty html gives an empty text; repeated rows each
    give theirs; broken markup, unclosed tags and cut character references are read as browsers do, and what follows a tag
    in which the page ends is no text. The whole page is read once, whatever its markup, in time that grows with its length. No shuffle; a task holds one small batch of pages.
    """
    small_batches(pages.sparkSession, 256)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"),
    ).mapInArrow(run, "page_id long, url string, text string, n_chars long")
