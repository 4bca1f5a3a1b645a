"""Main text of web pages: parser events become lines, text-to-tag ratios are smoothed and clustered by a threshold."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from venuelake.llm.common import small_batches

#: HTML's elements that end a line of text, that hold no content, and those whose content is never an article's.
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noframes noscript ol optgroup option p pre search section select summary table tbody td template textarea tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OUTSIDE = frozenset("nav footer aside form menu dialog script style noscript template iframe object svg math canvas select button textarea head title audio video map frameset noframes datalist search".split())
#: Words of class, id and role attributes that mark menus, notices, adverts, sidebars and comments.
OUTSIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox banner banners breadcrumb breadcrumbs comment comments commentlist consent contentinfo cookie cookies copyright disqus footer header masthead menu menubar modal nav navbar navigation navigator newsletter notice notices overlay pager pagination popup popups promo promoted promotion related replies reply respond share sharing sidebar sidebars sidenav signup skyscraper social sponsor sponsored subscribe subscription tags toolbar topbar widget widgets complementary search discussion reactions gdpr alert login hidden".split()
)
#: Words of an article's own parts: with one of them, "header" is its heading.
INSIDE_WORDS = frozenset("article articlebody post entry story main maincontent".split())
#: Of the words above, those that name an article's own matters as well. Inside an article they cut an element only where
#: nothing but them and words of layout make up a class or id; else the ratio of each of its lines decides.
DOUBTFUL_WORDS = frozenset("ad ads alert copyright discussion footer header hidden login overlay promotion reactions related replies reply respond search share sharing signup social subscribe subscription tags".split())
LAYOUT_WORDS = frozenset("area articles bar block bottom box button buttons container content field form icons inline inner item items left link links list main outer panel post posts right row section slot top unit wrap wrapper".split())
#: Elements of running text: a doubtful word alone does not cut them inside an article.
RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt span em strong b i".split())
#: An article or main element inside these still is the page's content: they are often left open, or wrap the whole page.
WEAK = frozenset("nav header form menu".split())
#: Width of the Gaussian, in lines.
SIGMA = 1.0
#: A line belongs to the content if its smoothed ratio reaches this part of the spread of the page's ratios, or of their
#: mean if that is less: what a single line of mean ratio between empty ones keeps after smoothing lies above it.
THRESHOLD = 0.5
MEAN_SHARE = 0.35
#: Elements that make a region of a page; others only shape its lines.
CONTAINERS = frozenset("article aside center details div fieldset main section".split())
_WORDS = re.compile(r"[A-Za-z]+")
_SPACE = re.compile(r"\s+")
#: Elements whose end tag may be left out: a block inside or after them closes them.
_CLOSED_BY_BLOCK = frozenset(("p",))
_SIBLINGS = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}


def _words(value: str) -> set[str]:
    return {w.lower() for w in _WORDS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value))}


def _names(attrs: list[tuple[str, str | None]]) -> list[set[str]]:
    """The words of each class, id and role."""
    return [_words(token) for name, value in attrs if name in ("class", "id", "role") and value for token in value.split()]


def _only_outside(attrs: list[tuple[str, str | None]]) -> bool:
    """Whether some class, id or role is made of words of the outside and of layout alone."""
    return any(words & OUTSIDE_WORDS and words <= OUTSIDE_WORDS | LAYOUT_WORDS | INSIDE_WORDS for words in _names(attrs))


def _doubtful(attrs: list[tuple[str, str | None]]) -> bool:
    return any(words & DOUBTFUL_WORDS for words in _names(attrs))


def _marked(tag: str, attrs: list[tuple[str, str | None]], inside: bool = False) -> bool:
    """Whether attributes put an element outside the content; `inside`: it stands in an article."""
    found: set[str] = set()
    for name, value in attrs:
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if name == "style" and value and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if name in ("class", "id", "role") and value:
            found.update(_words(value))
    bad = found & OUTSIDE_WORDS
    if inside and bad and bad <= DOUBTFUL_WORDS and (tag in RUNNING or not _only_outside(attrs)):
        return False
    if found & INSIDE_WORDS:
        bad = set() if tag in ("article", "main") and not {"comment", "related"} & bad else bad - {"header", "footer", "share", "tags"} if tag in ("article", "main") else bad - {"header"}
    return bool(bad)


class _Lines(HTMLParser):
    """Collects lines: (text, number of tags, in a content element, outside the content).

    For each line, `regions` has the number of its container and `linked` whether all its text is of links; `parents` has
    the container around each and `homes` the innermost article or main element, the page itself being 0. `doubted` says
    whether a doubtful word stands on an element around the line, `heads` whether it is a main heading.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, bool, bool]] = []
        self.parts: list[str] = []
        self.tags = 0
        self.regions: list[int] = []
        self.linked: list[bool] = []
        self.parents: list[int] = [0]
        self.homes: list[int] = [0]
        self.region, self.in_link, self.plain = 0, False, False
        self.doubted: list[bool] = []
        self.heads: list[bool] = []
        self.stack: list[tuple[str, int, bool, bool]] = []  # (tag, outside: 1 only by a weak element, 2 else; inside an article or main; doubted)

    def _state(self) -> tuple[int, bool, bool]:
        return self.stack[-1][1:] if self.stack else (0, False, False)

    def end_line(self) -> None:
        text = _SPACE.sub(" ", "".join(self.parts)).strip()
        outside, inside, doubted = self._state()
        if text or self.tags:
            self.lines.append((text, self.tags, inside, outside > 0))
            self.doubted.append(doubted)
            self.heads.append(any(tag == "h1" for tag, *_ in self.stack))
            self.regions.append(self.region)
            self.linked.append(not self.plain)
        self.parts, self.tags, self.plain = [], 0, False

    def _close(self, depth: int) -> None:
        self.end_line()
        for tag, *_ in self.stack[depth:]:
            if tag in CONTAINERS:
                self.region = self.parents[self.region]
        del self.stack[depth:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self.end_line()
            if tag not in VOID:
                if self.stack and self.stack[-1][0] in _CLOSED_BY_BLOCK:
                    self.stack.pop()
                for k in range(len(self.stack) - 1, -1, -1):
                    if self.stack[k][0] in _SIBLINGS.get(tag, ()):
                        self._close(k)
                        break
                    if self.stack[k][0] in ("ul", "ol", "dl", "table", "select", "menu", "tbody", "div", "section", "article"):
                        break
        self.tags += 1
        self.in_link = tag == "a" or self.in_link and tag not in CONTAINERS  # a link left open ends with its region
        if tag in VOID:
            return
        outside, inside, doubted = self._state()
        own = 0
        if tag not in ("html", "body", "main") and attrs and _marked(tag, attrs, inside):
            own = 2
        elif tag in OUTSIDE or (tag == "header" and not inside):  # inside an article, a header is its heading
            own = 1 if tag in WEAK else 2
        content = tag in ("article", "main") or ("role", "main") in attrs
        off = 0 if content and not own and outside < 2 else max(outside, own)
        unsure = doubted or bool(inside and not off and attrs and tag not in ("article", "main") and _doubtful(attrs))
        if tag in BLOCKS or off != outside or unsure != doubted:
            if off != outside or unsure != doubted:
                self.end_line()
            self.stack.append((tag, off, inside or (content and not off), unsure))
            if tag in CONTAINERS:
                self.parents.append(self.region)
                self.homes.append(len(self.parents) - 1 if content else self.homes[self.region])
                self.region = len(self.parents) - 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCKS:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        self.in_link = self.in_link and tag != "a"
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                self._close(k)
                return
        if tag in BLOCKS:
            self.end_line()

    def handle_data(self, data: str) -> None:
        self.parts.append(data)
        self.plain = self.plain or not self.in_link and not data.isspace()


def _parsed(html: str) -> _Lines:
    parser = _Lines()
    parser.feed(html)
    if "<" in parser.rawdata:
        parser.rawdata = parser.rawdata[: parser.rawdata.index("<")]
    parser.close()
    parser.end_line()
    return parser


def text_lines(html: str) -> list[tuple[str, int, bool, bool]]:
    """The lines of a page. Text behind an unfinished tag at the end is left out, as it is markup."""
    return _parsed(html).lines


def _between(regions: list[int], keep: np.ndarray) -> np.ndarray:
    """The kept lines and all lines between two of them of the same container: what stands there lies in it, at any depth."""
    first: dict[int, int] = {}
    last: dict[int, int] = {}
    for i in np.flatnonzero(keep).tolist():
        first.setdefault(regions[i], i)
        last[regions[i]] = i
    opened = np.zeros(len(keep) + 1, np.int64)
    for c, i in first.items():
        opened[i] += 1
        opened[last[c] + 1] -= 1
    return np.cumsum(opened[:-1]) > 0


def _own_headings(page: _Lines, marked: bool) -> np.ndarray:
    """The main headings that stand just before an article, in the same container, where the article has none itself."""
    found = np.zeros(len(page.lines), bool)
    if not marked:
        return found
    waiting: list[int] = []
    for i, (text, _, inside, outside) in enumerate(page.lines):
        if not text or outside:
            continue
        if not inside:
            waiting = [*waiting, i] if page.heads[i] else []
            continue
        article = page.homes[page.regions[i]]
        if waiting and not any(page.heads[k] and page.homes[page.regions[k]] == article for k in range(i, len(page.lines))):
            found[[k for k in waiting if page.regions[k] == page.parents[article]]] = True
        waiting = []
    return found


def _whole_regions(page: _Lines, usable: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """The kept lines and the short lines that stand in one region with them.

    Usable lines between kept lines of one container belong to it, and so do lines beside kept lines in a container of the
    page or anywhere in an article, unless they are links only. Then a container of one line is taken for its line, as
    where each paragraph has its own, and lines between kept ones belong to these again unless they are links only.
    """
    regions, plain = page.regions, ~np.array(page.linked, bool)
    kept = {regions[i] for i in np.flatnonzero(keep).tolist()}
    held, homes = kept - {0}, {page.homes[r] for r in kept} - {0}
    keep = usable & (_between(regions, keep) | plain & np.array([r in held or page.homes[r] in homes for r in regions], bool))
    under = [0] * len(page.parents)
    for i in np.flatnonzero(usable).tolist():
        under[regions[i]] += 1
    for c in range(len(under) - 1, 0, -1):  # a container's number is above that of the one around it
        under[page.parents[c]] += under[c]
    place = list(range(len(under)))
    for c in range(1, len(under)):
        if under[c] < 2:
            place[c] = place[page.parents[c]]
    return usable & (keep | plain & _between([place[r] for r in regions], keep))


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing over neighbouring lines; the kernel is renormalised at both ends."""
    radius = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    full = np.convolve(ratios, kernel)[radius : radius + len(ratios)]
    return full / np.convolve(np.ones(len(ratios)), kernel)[radius : radius + len(ratios)]


def main_text(html: str | None, sigma: float = SIGMA, threshold: float = THRESHOLD) -> str:
    """The lines of the content regions, joined by one space.

    A line's ratio is its text's length to its tags. The parser's events weigh it first: outside the content (menus, notices,
    forms, comments and so on), and outside the article where the page marks one, it is 0. Smoothed by a Gaussian over the
    neighbouring lines, the ratios are clustered by a threshold; a region (an article, a container of the page) with lines
    above it is content, with the headings, lists, dialogue or verse that stand in it, and one without is not: so teasers
    beside an article go, marked as articles or not. A class word that also names matters of articles cuts nothing inside
    one: lines under it stay if their own smoothed ratio reaches the threshold and they are not links only. The heading just
    before an article that has none belongs to it. A null or empty page, and one without usable lines, has no text.
    """
    if not html:
        return ""
    page = _parsed(html)
    lines = page.lines
    marked = any(inside and text and not outside for text, _, inside, outside in lines)
    usable = np.array([bool(text) and not outside and (inside or not marked) for text, _, inside, outside in lines], bool)
    headings = _own_headings(page, marked)
    if not usable.any():
        return ""
    ratios = np.where(usable, [len(text) / max(tags, 1) for text, tags, *_ in lines], 0.0)
    smooth = smoothed(ratios, sigma)
    keep = usable & (smooth >= min(threshold * smooth.std(), MEAN_SHARE * ratios[usable].mean()))
    unsure = np.array(page.doubted, bool) & ~(keep & ~np.array(page.linked, bool))
    keep = _whole_regions(page, usable & ~unsure, keep & ~unsure)
    if keep.any():
        keep |= headings
    return " ".join(line[0] for line, k in zip(lines, keep, strict=True) if k)


def extract(html: Column) -> Column:
    """Main text of an HTML column; null gives an empty text."""

    def texts(pages: pa.Array) -> pa.Array:
        return pa.array([main_text(p) for p in pages.to_pylist()], pa.string())

    return F.arrow_udf(texts, "string")(html)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) for every row, repeated rows included, without a shuffle; an empty table gives an empty
    result, a page without content (or null) an empty text. Other columns are ignored."""
    small_batches(pages.sparkSession)
    out = pages.select(F.col(id_col), F.col(url_col), extract(F.col(html_col)).alias("text"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
