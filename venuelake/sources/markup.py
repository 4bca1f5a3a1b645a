"""Pages as a table of nodes: a tree that tolerates broken markup, parsed once a page, for readers that are DataFrame code."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterable, Iterator
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser
from itertools import accumulate, islice
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEXT = "#text"
#: Elements without content, those that break lines, and those whose text is not shown.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote br caption dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol option p picture pre section table td th tr ul".split())
UNSEEN = frozenset("script style template noscript head".split())
#: What an opening tag closes: (tags closed, tags beyond which nothing is closed).
_LIST, _TABLE = frozenset(("ul", "ol", "menu")), frozenset(("table",))
_CELL = frozenset(("td", "th"))
IMPLIED = {
    **{tag: (frozenset(("p",)), frozenset(("td", "th", "table", "li", "dd", "button", "caption"))) for tag in BLOCKS - {"br", "option", "picture", "td", "th", "tr", "caption"}},
    "li": (frozenset(("li",)), _LIST | _TABLE),
    **{tag: (frozenset(("dt", "dd")), frozenset(("dl",)) | _TABLE) for tag in ("dt", "dd")},
    **{tag: (_CELL, _TABLE | {"tr"}) for tag in _CELL},
    "tr": (_CELL | {"tr"}, _TABLE),
    **{tag: (_CELL | {"tr", "thead", "tbody", "tfoot"}, _TABLE) for tag in ("thead", "tbody", "tfoot")},
    "option": (frozenset(("option",)), frozenset(("select", "datalist"))),
}
#: Elements that an end tag of a row, cell or list item does not reach beyond.
_WALLS = frozenset("table ul ol dl body html".split())
_ITEMS = frozenset("li td th tr dt dd".split())


#: Elements whose content the standard parser reads in another way, so pages with them are left to it.
_OPAQUE = re.compile(rf"(?i)<(?:{'|'.join({*HTMLParser.CDATA_CONTENT_ELEMENTS, *(getattr(HTMLParser, 'RCDATA_CONTENT_ELEMENTS', None) or ()), 'plaintext'})})")
#: What stands between the brackets of a tag of plain shape: (slash, name, attributes).
_PLAIN = re.compile(r"""(/?)([A-Za-z][A-Za-z0-9]*)((?:[ \t\n]+[A-Za-z][-A-Za-z0-9_]*(?:=(?:"[^"<>&]*"|'[^'<>&]*'|[^ \t\n"'<>=`&/]+))?)*)[ \t\n]*""")
_BRACKETS = re.compile("<([^<>]*)>")
_ATTRIBUTE = re.compile(r"""([A-Za-z][-A-Za-z0-9_]*)(?:=(?:"([^"]*)"|'([^']*)'|([^ \t\n]+)))?""")
_WIDE = re.compile(r"[ \t\n\x0b\f\r]{2,}|[\t\n\x0b\f\r]")  # white space that is not one space


#: What an opening tag says: its attributes' names and values, the first of each name, whether they hide it, its class and its id.
_Own = tuple[list[str], list[str], bool, str | None, str | None]


def _own(attrs: Iterable[tuple[str, str | None]]) -> _Own:
    own: dict[str, str] = {}
    for name, value in attrs:
        own.setdefault(name, value or "")
    return list(own), list(own.values()), "hidden" in own or own.get("aria-hidden") == "true", own.get("class"), own.get("id")


@lru_cache(4096)
def _tag(written: str) -> tuple[str | None, _Own | None]:
    """A tag of plain shape: its kind (the name, after a slash for an end tag, before an exclamation mark if it hides) and what an
    opening one says; no kind for any other."""
    shape = _PLAIN.fullmatch(written)
    if shape is None or shape[1] and shape[3]:
        return None, None
    name = shape[2].lower()
    if shape[1]:
        return sys.intern(f"/{name}"), None
    own = _own((k.lower(), a or b or c) for k, a, b, c in _ATTRIBUTE.findall(shape[3]))
    return sys.intern(f"{name}!" if own[2] else name), own


class _Form(NamedTuple):
    """Rows of a page as columns, and the paths of all rows in one: what opening tags and texts say is named by their place
    among these, so pages of one template have one form."""

    node: tuple[int, ...]
    last: tuple[int, ...]
    tag: tuple[str, ...]
    opening: tuple[int | None, ...]  # the opening tag, None for a text
    first: tuple[int, ...]  # the first of the pieces of text
    end: tuple[int, ...]  # and the one after
    line: tuple[int, ...]
    hidden: tuple[bool, ...]
    depth: tuple[int, ...]
    around_node: tuple[int, ...]
    around_tag: tuple[str, ...]
    around_opening: tuple[int, ...]
    pieces: tuple[tuple[int, bool], ...]  # texts, and whether each begins another line


class _Tree(HTMLParser):
    """Numbers the nodes of a page in document order; the page itself is 0 and no row. Where tags are asked, only elements of
    these become rows, with the visible text inside. Rows name what opening tags and texts say by their place among these, so
    pages of one template share their rows."""

    def __init__(self, asked: frozenset[str] | None = None) -> None:
        super().__init__(convert_charrefs=True)
        self.asked = asked
        self.owns: list[_Own] = []
        self.texts: list[str] = []
        self.rows: list[list] = []  # as the columns of the form, and the path
        self.count = self.opening = self.saying = 0
        self.opened: list[tuple[int, str, int]] = []  # (node, tag, opening tag) of the elements with content
        self.stack: list[tuple[str, bool, tuple, list | None]] = []  # (tag, hidden, path with itself, row)
        self.path: tuple = ()  # the open elements, by their place in `opened`
        self.line = 0
        self.text: tuple | None = None  # (line, path) of the last node, if it is a text
        self.pieces: list[tuple[int, bool]] = []  # texts, visible ones where tags are asked, and whether each begins another line there
        self.piece_line = 0

    def _close(self, depth: int) -> None:
        for tag, _, _, row in self.stack[depth:]:
            if row is not None:
                row[1], row[5] = self.count, len(self.pieces)
            self.line += tag in BLOCKS
        del self.stack[depth:]
        self.path = self.stack[-1][2] if self.stack else ()

    def _find(self, tags: frozenset[str], walls: frozenset[str]) -> int | None:
        """The outermost of the open elements of these tags within the walls."""
        found = None
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] in tags:
                found = k
            elif self.stack[k][0] in walls:
                break
        return found

    def open(self, tag: str, hides: bool) -> None:
        if tag in IMPLIED:
            depth = self._find(*IMPLIED[tag])
            if depth is not None:
                self._close(depth)
        self.line += tag in BLOCKS
        hidden = tag in UNSEEN or hides or bool(self.stack) and self.stack[-1][1]
        self.count += 1
        self.text, row, at = None, None, len(self.pieces)
        if self.asked is None or tag in self.asked:
            row = [self.count, self.count, tag, self.opening, at, at, self.line, hidden, self.path]
            self.rows.append(row)
        if tag not in VOID:
            self.path = (*self.path, len(self.opened))
            self.opened.append((self.count, tag, self.opening))
            self.stack.append((tag, hidden, self.path, row))
        self.opening += 1

    def say(self) -> None:
        hidden = bool(self.stack) and self.stack[-1][1]
        more = self.text is not None and self.text[0] == self.line and self.text[1] is self.path
        if not more:
            self.count += 1
            self.text = (self.line, self.path)
        if self.asked is None:
            if more:
                self.rows[-1][5] += 1
            else:
                at = len(self.pieces)
                self.rows.append([self.count, self.count, TEXT, None, at, at + 1, self.line, hidden, self.path])
            self.pieces.append((self.saying, False))
        elif not hidden:
            self.pieces.append((self.saying, self.piece_line != self.line))
            self.piece_line = self.line
        self.saying += 1

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.owns.append(_own(attrs))
        self.open(tag, self.owns[-1][2])

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if self.stack and self.stack[-1][0] == tag and tag not in VOID:
            self._close(len(self.stack) - 1)

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                self._close(k)
                return
            if tag in _ITEMS and self.stack[k][0] in _WALLS:
                return

    def handle_data(self, data: str) -> None:
        self.texts.append(data)
        self.say()

    def form(self) -> _Form:
        self._close(0)
        *columns, paths = zip(*self.rows) if self.rows else ((),) * 9
        around = [self.opened[i] for path in paths for i in path]
        return _Form(*columns, tuple(map(len, paths)), *(zip(*around) if around else ((),) * 3), tuple(self.pieces))


@lru_cache(1024)
def _form(kinds: tuple[str, ...], says: tuple[bool, ...], asked: frozenset[str] | None) -> _Form:
    """The form of a page from the kinds of its tags and where texts stand: before the first tag, and after each."""
    tree = _Tree(asked)
    for kind, said in zip(("", *kinds), says):
        if kind.startswith("/"):
            tree.handle_endtag(kind[1:])
        elif kind:
            tree.open(kind.rstrip("!"), kind.endswith("!"))
        if said:
            tree.say()
    return tree.form()


#: Tags of the longest page whose form is kept, and characters of the longest tag that is kept.
_KEPT_TAGS, _KEPT_CHARACTERS = 2_000, 200


def _cut(html: str) -> tuple[tuple[str, ...], list[_Own], list[str]] | None:
    """(kinds of tags, what opening tags say, texts) of a page that consists of tags of plain shape and texts."""
    cut = _BRACKETS.split(html)
    if html.count("<") != len(cut) // 2 or _OPAQUE.search(html):
        return None
    tags = [_tag(w) if len(w) < _KEPT_CHARACTERS else _tag.__wrapped__(w) for w in cut[1::2]]
    kinds = tuple([kind for kind, _ in tags])
    return None if None in kinds else (kinds, [own for _, own in tags if own], cut[::2])


def _read(html: str, asked: frozenset[str] | None) -> tuple[_Form, list[_Own], list[str]]:
    """The form of a page, and what its opening tags and texts say. A page of plain shape is cut, any other is fed."""
    cut = _cut(html)
    if cut is None:
        tree = _Tree(asked)
        tree.feed(html)
        if "<" in tree.rawdata:  # an unfinished tag at the end is markup
            tree.rawdata = tree.rawdata[: tree.rawdata.index("<")]
        tree.close()
        return tree.form(), tree.owns, tree.texts
    kinds, owns, said = cut
    form = _form if len(kinds) <= _KEPT_TAGS else _form.__wrapped__
    return form(kinds, tuple(map(bool, said)), asked), owns, [unescape(t) if "&" in t else t for t in said if t]


class _Rows:
    """Columns of the rows of pages, as Arrow takes them."""

    def __init__(self, asked: frozenset[str] | None) -> None:
        self.asked = asked
        self.keys, self.node, self.last, self.tag, self.text, self.line, self.hidden = ([] for _ in range(7))
        self.own, self.name, self.value = [], [], []  # where a row's attributes begin, None for a text
        self.depth, self.around_node, self.around_tag, self.around_class, self.around_id = ([] for _ in range(5))

    def add(self, key: object, html: str) -> None:
        form, owns, texts = _read(html, self.asked)
        self.keys += [key] * len(form.node)
        self.node += form.node
        self.last += form.last
        self.tag += form.tag
        self.line += form.line
        self.hidden += form.hidden
        self.depth += form.depth
        self.around_node += form.around_node
        self.around_tag += form.around_tag
        self.around_class += [owns[k][3] for k in form.around_opening]
        self.around_id += [owns[k][4] for k in form.around_opening]
        for k in form.opening:
            self.own.append(None if k is None else len(self.name))
            if k is not None:
                self.name += owns[k][0]
                self.value += owns[k][1]
        shown = [f" {texts[k]}" if breaks else texts[k] for k, breaks in form.pieces]
        if self.asked is None:
            self.text += ["".join(shown[a:b]) if k is None else None for k, a, b in zip(form.opening, form.first, form.end)]
        else:
            self.text += [_WIDE.sub(" ", "".join(shown[a:b])).strip(" ") if a < b else "" for a, b in zip(form.first, form.end)]

    def batch(self, kind: pa.DataType, names: list[str]) -> pa.RecordBatch:
        own = pa.array([*self.own, len(self.name)], pa.int32())
        begins = pa.array(accumulate(self.depth, initial=0), pa.int32())
        around = [pa.array(self.around_node, pa.int32()), *(pa.array(c, pa.string()) for c in (self.around_tag, self.around_class, self.around_id))]
        columns = [
            pa.array(self.keys, kind), pa.array(self.node, pa.int32()), pa.array(self.last, pa.int32()), pa.array(self.tag, pa.string()), pa.MapArray.from_arrays(own, pa.array(self.name, pa.string()), pa.array(self.value, pa.string())),
            pa.array(self.text, pa.string()), pa.array(self.line, pa.int32()), pa.array(self.hidden, pa.bool_()), pa.ListArray.from_arrays(begins, pa.StructArray.from_arrays(around, ["node", "tag", "class", "id"])),
        ]
        return pa.record_batch(columns, names=names)


def tree(html: str, asked: frozenset[str] | None = None) -> list[tuple]:
    """The nodes of a page: (node, last, tag, attributes, text, line, hidden, path); with tags asked, the elements of these, and
    the visible text of each in place of a text."""
    rows = _Rows(asked)
    rows.add(None, html)
    path = iter(zip(rows.around_node, rows.around_tag, rows.around_class, rows.around_id))
    own = iter(zip(rows.name, rows.value))
    ends = [next((k for k in rows.own[i + 1 :] if k is not None), len(rows.name)) for i in range(len(rows.own))]
    attributes = [None if k is None else list(islice(own, end - k)) for k, end in zip(rows.own, ends)]
    return list(zip(rows.node, rows.last, rows.tag, attributes, rows.text, rows.line, rows.hidden, [list(islice(path, d)) for d in rows.depth]))


_PATH = "path array<struct<node:int,tag:string,class:string,id:string>>"
_NODE = f"node int, last int, tag string, attributes map<string,string>, text string, line int, hidden boolean, {_PATH}"
_ELEMENT = f"node int, last int, tag string, attributes map<string,string>, content string, line int, hidden boolean, {_PATH}"
#: Nodes, and characters of pages, that travel in one batch, or those of one page if it has more.
_BATCH, _CHARACTERS = 5_000, 4 << 20


def _parsed(pages: DataFrame, id_col: str, html_col: str, asked: frozenset[str] | None) -> DataFrame:
    fields = _NODE if asked is None else _ELEMENT
    names = ["id", "node", "last", "tag", "attributes", "text" if asked is None else "content", "line", "hidden", "path"]

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, kind = _Rows(asked), 0, None
        for batch in batches:
            kind = batch.schema.field(0).type
            for key, html in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                page = html.as_py() or ""
                rows.add(key, page)
                size += len(page)
                if rows.keys and (len(rows.keys) >= _BATCH or size >= _CHARACTERS):
                    yield rows.batch(kind, names)
                    rows, size = _Rows(asked), 0
        if rows.keys:
            yield rows.batch(kind, names)

    pages = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html"))
    return pages.mapInArrow(parsed, f"id {dict(pages.dtypes)['id']}, {fields}")


def nodes(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, node, last, tag, attributes, text, line, hidden, path): a row for each element and each text of the pages.

    Nodes count from 1 in document order; an element holds the nodes after it up to `last`. path has the elements around a
    node, outermost first, with their classes and ids. line counts the breaks that blocks make, so texts of one line run on;
    hidden tells script, style, head and what is marked as not shown. Missing end tags are implied as browsers do. The first of
    repeated attributes counts. A null or empty page has no nodes; other columns are ignored.
    """
    return _parsed(pages, id_col, html_col, None)


def elements(pages: DataFrame, id_col: str, html_col: str, tags: Iterable[str]) -> DataFrame:
    """The elements of these tags in the table of nodes, with `content`, the visible text inside, in place of `text`. Texts meet
    while a page is parsed, so a reader of some elements moves these alone."""
    return _parsed(pages, id_col, html_col, frozenset(tags))


def closest(*tags: str) -> Column:
    """The number of the nearest element of these tags around a node, or null."""
    around = F.filter("path", lambda a: a["tag"].isin(*tags))
    return F.try_element_at(around, F.lit(-1))["node"]


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _joined(pieces: Column) -> Column:
    """Texts (node, line, text) in order, a space where the line breaks."""
    ordered = F.array_sort(pieces)
    return squeezed(F.array_join(F.transform(ordered, lambda x, i: F.concat(F.when((i > 0) & (F.get(ordered, i - 1)["line"] != x["line"]), " ").otherwise(""), x["text"])), ""))


def shown_lines(tree_nodes: DataFrame) -> DataFrame:
    """(id, line, node, text): the visible text of a page line by line, blocks and breaks ending lines; empty lines go."""
    shown = tree_nodes.filter((F.col("tag") == TEXT) & ~F.col("hidden"))
    found = shown.groupBy("id", "line").agg(F.min("node").alias("node"), F.collect_list(F.struct("node", "line", "text")).alias("pieces"))
    return found.select("id", "line", "node", _joined(F.col("pieces")).alias("text")).filter("text <> ''")


def with_text(tree_nodes: DataFrame, chosen: Column, tags: tuple[str, ...]) -> DataFrame:
    """The elements that `chosen` takes, all of `tags`, with `content`: the visible text inside, '' if none. Each text goes to
    those of the elements around it that have one of the tags, so the work is texts times such elements. A table of elements has
    its contents already."""
    if "content" in tree_nodes.columns:
        return tree_nodes.filter(F.col("tag").isin(*tags) & chosen)
    shown = tree_nodes.filter((F.col("tag") == TEXT) & ~F.col("hidden"))
    inside = shown.select("id", F.explode(F.filter("path", lambda a: a["tag"].isin(*tags))["node"]).alias("owner"), F.struct("node", "line", "text").alias("piece"))
    texts = inside.groupBy("id", F.col("owner").alias("node")).agg(_joined(F.collect_list("piece")).alias("content"))
    return tree_nodes.filter(F.col("tag").isin(*tags) & chosen).join(texts, ["id", "node"], "left").withColumn("content", F.coalesce("content", F.lit("")))
