"""Main text of web pages from streamed parser events.

The standard library's parser gives events; block tags cut them into lines, each
with its text and the number of tags met in it. The text-to-tag ratios of the
lines are smoothed by a Gaussian and clustered by a threshold (a share of their
spread): lines above it are content. An article or main element is a hint: every
outermost one that holds content is kept with all it holds, nested ones in page order, as
short paragraphs are lines of a content region; one that began inside of a menu, a sidebar
or the like only where no other holds content. Where more content lies outside of them,
and where there are none, the region from the first to the last content line is taken as well.

Menus, headers, footers, sidebars, scripts and styles never make lines: their elements and
roles are a fixed list. Class words and forms are marks. A marked element whose name
says nothing but its mark (a sidebar, a notice, an advert, reader comments) is left out, unless
it holds most of the page's text; a mark beside other words, on a paragraph, or a header or notice
inside an article lowers the ratio only. Headings cannot be marked. An element
that is never closed ends with the element around it, or where an article begins.
Outside of articles a region is extended from its content lines to the headings and short lines that
adjoin them.

White space inside a line becomes one space, lines are joined by one space.
Defined cases: null and empty pages give the empty text; ids and urls (null, repeated)
are carried along; broken markup is read as far as it goes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.llm.common import columns, documents, texts_of

SIGMA, RADIUS = 1.5, 4
#: Lines whose smoothed ratio reaches this share of the ratios' standard deviation are content.
THRESHOLD = 0.5

# Fixed lists of element names and class words.
_BLOCKS = set(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
_DROPPED = set(
    "script style noscript template head title nav header footer aside button select option textarea input label fieldset iframe object embed "
    "svg canvas map menu dialog audio video".split()
)
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_OWN_END = {"p", "li", "dt", "dd", "tr", "td", "th", "option", "thead", "tbody", "tfoot"}
_INLINE = set("a abbr b bdi bdo big cite code del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var".split())
_CONTAINERS = {"article", "main"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "menu", "menubar", "alert", "dialog"}
_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner\w*|cookies?\w*|consent|notices?|alerts?|sidebars?|side|aside|menus?|nav\w*|breadcrumbs?|footer|"
    r"header|masthead|toolbar|comments?|commentlist|respond|responses?|replies|reply|disqus|discussions?|talkback|guestbook|share\w*|sharing|social|related|recommend\w*|newsletter|subscribe\w*|signup|login|popup|"
    r"modal|overlay|pagination|pager|widgets?|skip|hidden)(?:$|[\s_-])",
    re.I,
)
_COMMENTS = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|respond|responses?|replies|reply|disqus|discussions?|talkback|guestbook)(?:$|[\s_-])", re.I)
# What a line of rights begins with.
_RIGHTS = re.compile(r"(?:\u00a9|\(c\)|copyright\b)", re.I)
# Words that say what an element is part of, not what it is about.
_NEUTRAL = re.compile(
    r"(?:site|page|post|posts|entry|main|article|articles|area|box|block|list|section|container|wrap|wrapper|inner|outer|content|left|right|top|bottom|primary|secondary|"
    r"links?|icons?|buttons?|btn|bar|items?|form|panel|group|row|col|column|global|text|js|the|user|reader|story|stories|thread|policy|\d+)?",
    re.I,
)
# Names that an article's own parts may have.
_ARTICLE_PART = re.compile(r"(?:^|[\s_-])(?:header|notices?|alerts?|banner\w*|masthead|side)(?:$|[\s_-])", re.I)
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_PARAGRAPHS = {"p", "li", "dd", "dt", "td", "th", "pre", "blockquote", "caption", "figcaption"}
#: Kinds of marks, what a weak one leaves of a line's ratio, and the share of the text from which an element is the page itself.
WEAK, STRONG, COMMENTS = 0, 1, 2
WEIGHT = 0.5
WRAPPER, COMMENT_WRAPPER = 0.5, 0.9
# A layout that has a sidebar is no sidebar.
_ABOUT = re.compile(r"(?:has|with|without|no|is|show|hide)[_-]", re.I)
_NOT_SHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _names(attrs: dict) -> list[str]:
    """The class words and the id of an element, without those that tell of its layout."""
    return [n for n in f"{attrs.get('class') or ''} {attrs.get('id') or ''}".split() if not _ABOUT.match(n)]


class _Mark:
    """A marked element that is open, and the one around it; lines point to the innermost, so a line costs the same at any depth."""

    __slots__ = ("around", "comments", "counts", "depth", "first_strong", "free", "in_container", "kind", "last_strong", "some", "weak")

    def __init__(self, depth: int, kind: int, around: _Mark | None):
        self.depth, self.kind, self.around = depth, kind, around
        self.some = kind == COMMENTS or (around is not None and around.some)  # reader comments here or around
        self.free = self.counts = 0  # text outside of reader comments, and all text
        self.in_container = False

    def judge(self, wrapper: bool) -> None:
        """What the marks from here outwards do, once the one around is judged; a wrapper's own mark does nothing."""
        o = self.around
        self.comments = (o is not None and o.comments) or (self.kind == COMMENTS and not wrapper)
        self.weak = (o is not None and o.weak) or (self.kind == WEAK and not wrapper)
        self.first_strong = o.first_strong if o is not None else None
        self.last_strong = o.last_strong if o is not None else None
        if self.kind == STRONG and not wrapper:
            self.last_strong = self.depth
            self.first_strong = self.depth if self.first_strong is None else self.first_strong


class _Line(NamedTuple):
    container: int  # the outermost one
    depth: int  # of that container
    text: str
    tags: int
    mark: _Mark | None  # the innermost
    linked: int  # characters in links
    heading: bool
    parent: int  # the element around the line's own block


def _mark(tag: str, attrs: dict, in_container: bool) -> int | None:
    """The kind of mark that an element's name gives it."""
    if tag in _HEADINGS or tag in ("html", "body"):
        return None
    names = _names(attrs)
    if any(_COMMENTS.search(n) for n in names) and (tag in _CONTAINERS or any(_pure(n) for n in names if _COMMENTS.search(n))):
        return COMMENTS if tag not in _PARAGRAPHS or not in_container else WEAK
    if tag in _CONTAINERS:
        return None
    marked = [n for n in names if _WORDS.search(n)]
    if tag == "form" or (attrs.get("role") or "").lower() == "form":
        return STRONG
    if not marked:
        return None
    pure = [n for n in marked if _pure(n) and not (in_container and _ARTICLE_PART.search(n))]
    return STRONG if pure and tag not in _PARAGRAPHS else WEAK


def _pure(name: str) -> bool:
    """Nothing in the name but marks and words of layout."""
    return all(_NEUTRAL.fullmatch(w) or _WORDS.search(w) for w in re.split(r"[_-]", name)) and not name.lower().endswith("policy")


class _Lines(HTMLParser):
    """Cuts a page into lines."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[_Line] = []
        self._open: list[str] = []
        self._ids: list[int] = []  # of the open elements
        self._n_ids = 0
        self._blocks: list[int] = []  # depths of the open blocks
        self._solid: list[int] = []  # depths of the open elements that are not inline
        self._where: dict[str, list[int]] = {}  # depths of the open elements of a name
        self._marks: list[_Mark] = []
        self.marks: list[_Mark] = []  # all of them, outer ones first
        self._last: tuple[str, dict[str, int]] = ("", {})
        self._linked = 0
        self._containers: list[tuple[int, int]] = []  # (depth, number)
        self._n_containers = 0
        self.released: set[int] = set()  # containers that began inside of a dropped element
        self._dropped_at: int | None = None  # depth of the dropped element
        self._in_comments = False
        self._text: list[str] = []
        self._tags = 0

    def _cut(self) -> None:
        text = " ".join("".join(self._text).split())
        if text:
            depth, container = self._containers[0] if self._containers else (-1, 0)
            own = self._blocks[-1] if self._blocks else -1
            heading = own >= 0 and self._open[own] in _HEADINGS
            mark = self._marks[-1] if self._marks else None
            self.lines.append(_Line(container, depth, text, self._tags, mark, min(self._linked, len(text)), heading, self._ids[own - 1] if own > 0 else 0))
            self._tags = 0
        self._text, self._linked = [], 0

    def _drops(self, tag: str, attrs: dict) -> bool:
        if tag in _DROPPED:
            return True
        return bool(
            ("hidden" in attrs)
            or attrs.get("aria-hidden") == "true"
            or (attrs.get("role") or "").lower() in _ROLES
            or _NOT_SHOWN.search(attrs.get("style") or "")
            or (tag in _INLINE and _mark(tag, attrs, bool(self._containers)) in (STRONG, COMMENTS))
        )

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self._tags += 1
        if tag in _BLOCKS:
            self._cut()
        if tag in _OWN_END and tag in self._open[-1:]:
            self._close(len(self._open) - 1)
        if tag in _VOID:
            return
        found, released = dict(attrs), False
        if self._dropped_at is not None and tag in _CONTAINERS and not self._in_comments and not self._drops(tag, found):
            self._dropped_at, released = None, True  # what was left open before the article
        mark = None if self._dropped_at is not None or tag in _INLINE else _mark(tag, found, bool(self._containers))
        if mark is not None:
            self._cut()
        self._where.setdefault(tag, []).append(len(self._open))
        if tag in _BLOCKS:
            self._blocks.append(len(self._open))
        if tag not in _INLINE:
            self._solid.append(len(self._open))
        self._open.append(tag)
        self._n_ids += 1
        self._ids.append(self._n_ids)
        if self._dropped_at is None:
            if self._drops(tag, found):
                self._dropped_at = len(self._open) - 1
                self._in_comments = any(_COMMENTS.search(n) for n in _names(found))
                return
            if mark is not None:
                self._marks.append(_Mark(len(self._open) - 1, mark, self._marks[-1] if self._marks else None))
                self.marks.append(self._marks[-1])
            if tag in _CONTAINERS and mark is None:
                self._n_containers += 1
                self._containers.append((len(self._open) - 1, self._n_containers))
                if released:
                    self.released.add(self._n_containers)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self._tags += 1
        if tag in _BLOCKS:
            self._cut()

    def _close(self, depth: int) -> None:
        """Closes all elements from ``depth`` on."""
        self._cut_if_block(depth)
        for t in self._open[depth:]:
            self._where[t].pop()
        del self._open[depth:], self._ids[depth:]
        for depths in (self._blocks, self._solid):
            while depths and depths[-1] >= depth:
                depths.pop()
        while self._marks and self._marks[-1].depth >= depth:
            self._marks.pop()
        while self._containers and self._containers[-1][0] >= depth:
            self._containers.pop()
        if self._dropped_at is not None and self._dropped_at >= depth:
            self._dropped_at, self._in_comments = None, False

    def _cut_if_block(self, depth: int) -> None:
        if (self._blocks and self._blocks[-1] >= depth) or (self._marks and self._marks[-1].depth >= depth):
            self._cut()

    def handle_endtag(self, tag: str) -> None:
        self._tags += 1
        if self._where.get(tag):
            depth = self._where[tag][-1]
            # An inline end tag does not close blocks that were opened inside of it.
            if tag not in _INLINE or not self._solid or self._solid[-1] < depth:
                self._close(depth)
        elif tag in _BLOCKS:
            self._cut()

    def handle_data(self, data: str) -> None:
        if self._dropped_at is None:
            self._text.append(data)
            if self._where.get("a"):
                self._linked += len(data.strip())

    def _ends(self, at: int, end: str) -> bool:
        """True if ``end`` comes after ``at``. The parser looks for the end of every tag and comment anew; its last
        place in the text, found once, tells when none is left: then the rest of the page belongs to it."""
        if self._last[0] is not self.rawdata:
            self._last = (self.rawdata, {})
        last = self._last[1]
        if end not in last:
            last[end] = self.rawdata.rfind(end)
        return last[end] >= at

    def parse_starttag(self, i: int) -> int:
        return super().parse_starttag(i) if self._ends(i, ">") else len(self.rawdata)

    def parse_endtag(self, i: int) -> int:
        return super().parse_endtag(i) if self._ends(i, ">") else len(self.rawdata)

    def parse_pi(self, i: int) -> int:
        return super().parse_pi(i) if self._ends(i, ">") else len(self.rawdata)

    def parse_comment(self, i: int, report: bool = True) -> int:
        return super().parse_comment(i, report) if self._ends(i, "-->") else len(self.rawdata)

    def parse_html_declaration(self, i: int) -> int:
        if self.rawdata.startswith("<!--", i):
            return self.parse_comment(i)
        if not self._ends(i, ">"):
            return len(self.rawdata)
        if self.rawdata.startswith("<![", i) and not self._ends(i, "]]>"):
            return self.rawdata.find(">", i) + 1  # a section that never ends is a comment up to the next mark
        return super().parse_html_declaration(i)

    def close(self) -> None:
        super().close()
        self._cut()


def smoothed(ratios: np.ndarray) -> np.ndarray:
    """Gaussian smoothing over neighbouring lines; the ends count what they have."""
    x = np.arange(-RADIUS, RADIUS + 1)
    kernel = np.exp(-(x**2) / (2 * SIGMA**2))
    weight = np.convolve(np.ones(len(ratios)), kernel, mode="full")[RADIUS : RADIUS + len(ratios)]
    return np.convolve(ratios, kernel, mode="full")[RADIUS : RADIUS + len(ratios)] / weight


def unmarked(lines: list[_Line], marks: list[_Mark]) -> tuple[list[_Line], np.ndarray, set[int]]:
    """The lines that no mark leaves out, their weights, and the containers that began inside of a mark.

    An element that holds most of the text, and where there are containers one of them, is a wrapper: its mark counts for nothing.
    ``marks`` are in the order in which they were opened; texts are summed up the other way round, each mark once.
    """
    whole = {True: 0, False: 0}
    for r in lines:
        n = len(r.text) - r.linked
        comments = r.mark is not None and r.mark.some
        whole[comments] += n
        if r.mark is not None:
            r.mark.counts += n
            r.mark.free += 0 if comments else n
            r.mark.in_container |= bool(r.container)
    for m in reversed(marks):
        if m.around is not None:
            m.around.counts += m.counts
            m.around.free += m.free
            m.around.in_container |= m.in_container
    contained = any(r.container for r in lines)
    text = {COMMENTS: COMMENT_WRAPPER * sum(whole.values()), STRONG: WRAPPER * whole[False], WEAK: WRAPPER * whole[False]}
    for m in marks:
        held = m.counts if m.kind == COMMENTS else m.free
        m.judge(wrapper=(m.in_container or not contained) and held >= text[m.kind] > 0)

    def dropped(r: _Line) -> bool:
        return r.mark is not None and (r.mark.comments or (r.mark.last_strong is not None and r.mark.last_strong >= r.depth))

    rows = [r for r in lines if not dropped(r)] or [r for r in lines if r.mark is None or not r.mark.comments]
    weight = np.array([WEIGHT if r.mark is not None and r.mark.weak else 1.0 for r in rows])
    before = {r.container for r in rows if r.mark is not None and r.mark.first_strong is not None and r.mark.first_strong < r.depth}
    return rows, weight, before


def extended(lines: list[_Line], first: int, last: int) -> tuple[int, int]:
    """The region grown over the headings and the lines of the same parent that adjoin it, up to a list of links."""

    def adjoins(k: int, edge: int) -> bool:
        r = lines[k]
        return 2 * r.linked < len(r.text) and not _RIGHTS.match(r.text) and (r.heading or r.parent == lines[edge].parent)

    while first and adjoins(first - 1, first):
        first -= 1
    while last + 1 < len(lines) and adjoins(last + 1, last) and not lines[last + 1].heading:
        last += 1
    return first, last


def main_text(html: str) -> str:
    """The article of one page."""
    parser = _Lines()
    parser.feed(html)
    parser.close()
    lines, weight, released = unmarked(parser.lines, parser.marks)
    if not lines:
        return ""
    plain = np.array([len(r.text) / max(1, r.tags) for r in lines], dtype=np.float64) * weight
    ratio = smoothed(plain)
    least = THRESHOLD * ratio.std()
    content = ratio >= least
    # Smoothing also lifts the neighbours of a region; its ends are lines that pass by themselves.
    core = content & (plain >= least)
    inside = np.array([r.container for r in lines])
    size = np.array([len(r.text) for r in lines])
    holding = set(inside[core].tolist()) - {0} or {max(set(inside.tolist()) - {0}, key=lambda c: size[inside == c].sum(), default=0)}
    holding = holding - parser.released - released or holding
    keep = np.isin(inside, list(holding - {0}))
    if size[core & (inside == 0)].sum() > size[core & keep].sum() or not keep.any():
        at = [k for k in np.nonzero(core)[0].tolist() if not _RIGHTS.match(lines[k].text)]
        region = np.arange(len(lines))
        keep &= (core & keep).any()
        first, last = extended(lines, at[0], at[-1]) if at else (0, len(lines))
        keep |= (region >= first) & (region <= last)
    chosen = [r.text for r, k in zip(lines, keep.tolist(), strict=True) if k]
    return " ".join(chosen)


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` per page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h) if h else "" for h in texts_of(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = columns(pages, page_id=id_col, url=url_col, html=html_col).select(F.col("page_id").cast("bigint"), "url", "html")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(documents(spark, sf_dir, "pages"))
