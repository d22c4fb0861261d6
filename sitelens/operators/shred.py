"""Page shredding: one Arrow hop turns raw HTML into arrays Catalyst can work on.

Per page the hop returns ``nodes`` (elements in document order), ``texts`` (text
pieces, each element pointing at its range), optionally a well-formed copy
``xhtml`` and ``shred_error``. ``NodeNeeds`` is worked out from the field specs at
plan time, so only the elements, attributes and texts that some selector can use
leave Python; everything after the hop is built from Spark expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from html.parser import HTMLParser
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.operators.matching import Frame, Matcher, PageTree

ROWS_PER_OUTPUT_BATCH = 200
# In a numbered copy each element begins with ``<?n MARKk?>``, k being its place in nodes.
NUMBER, MARK = "n", "\ue000"

SHRED_DDL = (
    "nodes ARRAY<STRUCT<pos:INT, last:INT, hits:ARRAY<STRING>, tag:STRING, "
    "attrs:MAP<STRING,STRING>, t0:INT, t1:INT, raw:STRING>>, "
    "texts ARRAY<STRING>, xhtml STRING, shred_error STRING"
)


@dataclass(frozen=True)
class NodeNeeds:
    """Which parts of a page the field expressions will touch."""

    tags: frozenset = frozenset()  # elements kept by name
    having: frozenset = frozenset()  # elements kept because they carry an attribute
    attrs: frozenset = frozenset()  # attribute values to return
    selectors: frozenset = frozenset()  # CSS selectors to match; what they match is kept
    everything: bool = False  # keep all elements
    text: bool = False
    xhtml: bool = False
    numbered: bool = False  # keep all elements, and write their numbers into ``xhtml``

    def __or__(self, other: NodeNeeds) -> NodeNeeds:
        return NodeNeeds(
            self.tags | other.tags,
            self.having | other.having,
            self.attrs | other.attrs,
            self.selectors | other.selectors,
            self.everything or other.everything,
            self.text or other.text,
            self.xhtml or other.xhtml,
            self.numbered or other.numbered,
        )

    @property
    def any_nodes(self) -> bool:
        return bool(self.tags or self.having or self.selectors or self.everything or self.numbered)

    @property
    def needs_shred(self) -> bool:
        return self.any_nodes or self.xhtml


# Fixed values of the HTML language.
VOID_TAGS = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
OWN_TEXT_TAGS = frozenset("script style template rt rp".split())
HEAD_TAGS = frozenset("base link meta script style title noscript template".split())
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav "
    "ol p pre section summary table ul".split()
)
_TABLE_PARTS = frozenset("table template".split())
# Start tag -> (open elements it ends, elements the search does not look beyond).
IMPLIED_ENDS = {
    "li": (frozenset(["li"]), frozenset("ul ol menu".split())),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "option": (frozenset(["option"]), frozenset("select datalist optgroup".split())),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
    "tr": (frozenset(["tr", "td", "th"]), _TABLE_PARTS | {"tbody", "thead", "tfoot"}),
    "td": (frozenset(["td", "th"]), _TABLE_PARTS | {"tr"}),
    "th": (frozenset(["td", "th"]), _TABLE_PARTS | {"tr"}),
    "tbody": (frozenset(["tbody", "thead", "tfoot", "tr", "td", "th"]), _TABLE_PARTS),
    "thead": (frozenset(["tbody", "thead", "tfoot", "tr", "td", "th"]), _TABLE_PARTS),
    "tfoot": (frozenset(["tbody", "thead", "tfoot", "tr", "td", "th"]), _TABLE_PARTS),
}
_PARAGRAPH_SCOPE = frozenset("button td th caption table object template body html".split())
# A stray end tag never closes an open element of a higher rank.
END_RANK = {
    "div": 150, "td": 160, "th": 160, "tr": 170, "thead": 180, "tbody": 180,
    "tfoot": 180, "table": 190, "head": 200, "body": 200, "html": 220,
}
_XML_NAME = re.compile(r"[A-Za-z_][\w.\-]*(:[A-Za-z_][\w.\-]*)?$", re.ASCII)
_NOT_XML = re.compile("[^\t\n\r\x20-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]")


class _Columns:
    """Flat child arrays of one output batch."""

    def __init__(self) -> None:
        self.pos, self.last, self.hits, self.tag = [], [], [], []
        self.t0, self.t1, self.raw = [], [], []
        self.attr_offsets, self.attr_keys, self.attr_values = [0], [], []
        self.node_offsets, self.text_offsets, self.texts = [0], [0], []
        self.xhtml, self.errors = [], []

    def end_page(self, xhtml: str | None, error: str | None) -> None:
        self.node_offsets.append(len(self.pos))
        self.text_offsets.append(len(self.texts))
        self.xhtml.append(xhtml)
        self.errors.append(error)

    def arrays(self) -> list[pa.Array]:
        ints = lambda values: pa.array(values, pa.int32())
        node = pa.StructArray.from_arrays(
            [
                ints(self.pos), ints(self.last), pa.array(self.hits, pa.list_(pa.string())),
                pa.array(self.tag, pa.string()),
                pa.MapArray.from_arrays(
                    ints(self.attr_offsets),
                    pa.array(self.attr_keys, pa.string()),
                    pa.array(self.attr_values, pa.string()),
                ),
                ints(self.t0), ints(self.t1), pa.array(self.raw, pa.string()),
            ],
            ["pos", "last", "hits", "tag", "attrs", "t0", "t1", "raw"],
        )
        return [
            pa.ListArray.from_arrays(ints(self.node_offsets), node),
            pa.ListArray.from_arrays(ints(self.text_offsets), pa.array(self.texts, pa.string())),
            pa.array(self.xhtml, pa.string()),
            pa.array(self.errors, pa.string()),
        ]


class _PageReader(HTMLParser):
    """Writes one page after another into the flat columns."""

    def __init__(self, needs: NodeNeeds) -> None:
        super().__init__(convert_charrefs=True)
        self.needs = needs
        self.matcher = Matcher(needs.selectors) if needs.selectors else None
        self.keep_all = needs.everything or needs.numbered
        self.out = _Columns()

    def read(self, html: str | None) -> None:
        """Append one page. What cannot be parsed ends the page there: all that was
        read before stays, and the error is reported with it."""
        out = self.out
        self.reset()
        self.first_node, self.first_text = len(out.pos), len(out.texts)
        self.stack: list[tuple[str, int, bool, Frame | None]] = []  # tag, kept node or -1, in xhtml
        self.outside = Frame() if self.matcher else None
        self.tree = PageTree() if self.matcher and self.matcher.ahead else None
        self.branch: list[int] = []  # the open elements in the tree
        self.kept: list[int] = []  # positions of the open kept elements
        self.open_raw: list[tuple[int, list[str]]] = []
        self.buffer: list[str] = []
        self.space = False
        self.xml: list[str] = []
        self.seen = set()
        error = None
        try:
            if html:
                self.feed(html)
                self.close()
        except Exception as problem:  # one bad page must not stop the job
            error = f"{type(problem).__name__}: {problem}"
        self._flush()
        while self.stack:
            self._pop()
        if self.tree:
            for element, selector in self.tree.settle(self.matcher.ahead):
                if self.tree.kept[element] >= 0:
                    out.hits[self.tree.kept[element]].append(selector)
        xhtml = "".join(self.xml) if self.needs.xhtml else None
        out.end_page(xhtml or None, error)

    # -- structure ---------------------------------------------------------

    def _push(self, tag: str, attrs: Sequence[tuple[str, str | None]]) -> None:
        needs, out = self.needs, self.out
        position = -1
        frame, hits, late = None, [], []
        parent = self.stack[-1][3] if self.stack else self.outside
        if self.matcher:
            values: dict[str, str] = {}
            for name, value in attrs:
                value = value or ""
                values.setdefault(name, " ".join(value.split()) if name == "class" else value)
            frame, hits, late = self.matcher.enter(parent, tag, values)
        keep = self.keep_all or tag in needs.tags or bool(hits or late)
        if not keep and self.tree is not None:
            keep = self.matcher.may_match(tag, values)
        if not keep and needs.having:
            keep = any(name in needs.having for name, _ in attrs)
        if keep:
            index = len(out.pos)
            position = index - self.first_node
            out.pos.append(position)
            out.last.append(position)
            out.hits.append(hits)
            if late:
                parent.waiting.extend((index, x) for x in late)
            out.tag.append(tag)
            wanted = {}
            for name, value in attrs:
                if (needs.everything or name in needs.attrs) and name not in wanted:
                    value = value or ""
                    wanted[name] = " ".join(value.split()) if name == "class" else value
            out.attr_keys.extend(wanted.keys())
            out.attr_values.extend(wanted.values())
            out.attr_offsets.append(len(out.attr_keys))
            texts = len(out.texts) - self.first_text
            out.t0.append(texts)
            out.t1.append(texts)
            out.raw.append(None)
        if self.tree is not None:
            above = self.branch[-1] if self.branch else -1
            self.branch.append(self.tree.add(tag, values, above, self.first_node + position if keep else -1))
        in_xml = False
        if needs.xhtml and _XML_NAME.match(tag):
            in_xml = True
            unique = {n: v for n, v in reversed(attrs) if _XML_NAME.match(n) and n != "xmlns"}
            self.xml.append(
                "<" + tag
                + "".join(f" {n}={quoteattr(_NOT_XML.sub('', v or ''))}" for n, v in unique.items())
                + ">"
            )
            if needs.numbered:
                self.xml.append(f"<?{NUMBER} {MARK}{position}?>")
        self.stack.append((tag, position, in_xml, frame))
        if position >= 0:
            self.kept.append(position)
        if tag in OWN_TEXT_TAGS:
            self.open_raw.append((position, []))

    def _pop(self) -> None:
        tag, position, in_xml, frame = self.stack.pop()
        out = self.out
        if self.branch:
            self.branch.pop()
        if frame and frame.waiting:
            for node, selector in self.matcher.settled(frame):
                out.hits[node].append(selector)
        if tag in OWN_TEXT_TAGS:
            owner, pieces = self.open_raw.pop()
            if owner >= 0:
                out.raw[self.first_node + owner] = " ".join(pieces)
        if position >= 0:
            self.kept.pop()
            out.last[self.first_node + position] = len(out.pos) - self.first_node - 1
            out.t1[self.first_node + position] = len(out.texts) - self.first_text
        if in_xml:
            self.xml.append(f"</{tag}>")

    def _end_open(self, closes: frozenset, scope: frozenset) -> None:
        target = -1
        for depth in range(len(self.stack) - 1, -1, -1):
            tag = self.stack[depth][0]
            if tag in scope:
                break
            if tag in closes:
                target = depth
        if target >= 0:
            while len(self.stack) > target:
                self._pop()

    def _imply_structure(self, tag: str) -> None:
        seen = self.seen
        if "html" not in seen:
            seen.add("html")
            self._push("html", ())
        if tag in ("head", "body", "frameset"):
            if tag != "head":
                self._end_open(frozenset(["head"]), frozenset())
            return
        if "body" in seen or "frameset" in seen:
            return
        if tag in HEAD_TAGS:
            if "head" not in seen:
                seen.add("head")
                self._push("head", ())
            return
        self._end_open(frozenset(["head"]), frozenset())
        seen.add("body")
        self._push("body", ())

    # -- parser events -----------------------------------------------------

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._flush()
        if tag == "html":
            if "html" not in self.seen:
                self.seen.add("html")
                self._push(tag, attrs)
            return
        self._imply_structure(tag)
        if tag in ("head", "body", "frameset"):
            if tag in self.seen:
                return
            self.seen.add(tag)
        if tag in ENDS_PARAGRAPH:
            self._end_open(frozenset(["p"]), _PARAGRAPH_SCOPE)
        rule = IMPLIED_ENDS.get(tag)
        if rule:
            self._end_open(*rule)
        self._push(tag, attrs)
        if tag in VOID_TAGS:
            self._pop()

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self._flush()
        if tag in ("html", "body"):
            return
        rank = END_RANK.get(tag, 100)
        for depth in range(len(self.stack) - 1, -1, -1):
            open_tag = self.stack[depth][0]
            if open_tag == tag:
                while len(self.stack) > depth:
                    self._pop()
                return
            if END_RANK.get(open_tag, 100) > rank:
                return

    def handle_data(self, data: str) -> None:
        self.buffer.append(data)

    def handle_comment(self, data: str) -> None:
        self._flush()

    handle_decl = handle_pi = unknown_decl = handle_comment

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """``<![...`` of unknown kind is a comment up to the next ``>``."""
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:
            return self.parse_bogus_comment(i)

    def _flush(self) -> None:
        if not self.buffer:
            return
        data = "".join(self.buffer)
        self.buffer.clear()
        words = data.split()
        if words and not self.open_raw and "body" not in self.seen and not self._in_head_text():
            self._imply_structure("#text")
        if self.needs.xhtml and self.stack:
            self.xml.append(escape(_NOT_XML.sub("", data)))
        if self.open_raw:
            if words:
                self._fill()
                self.open_raw[-1][1].append(" ".join(words))
            return
        if words:
            self._fill()
        if not words:
            self.space = True
            return
        if self.needs.text and self.kept:
            glue = " " if self.space or data[0].isspace() else ""
            self.out.texts.append(glue + " ".join(words))
        self.space = data[-1].isspace()

    def _fill(self) -> None:
        """The open element has text."""
        if self.branch:
            self.tree.filled[self.branch[-1]] = True

    def _in_head_text(self) -> bool:
        return bool(self.stack) and self.stack[-1][0] in HEAD_TAGS


def shred(
    pages: DataFrame, needs: NodeNeeds, keep: Sequence[str], html: str = "html"
) -> DataFrame:
    """Add ``nodes, texts, xhtml, shred_error`` to the ``keep`` columns of ``pages``.

    Filter and project before calling: neither moves through the Python hop. The
    HTML itself does not come back unless it is listed in ``keep``.
    """
    source = pages.select(F.col(html).alias("__html"), *keep)
    kept_ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[1:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _PageReader(needs)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_PER_OUTPUT_BATCH):
                piece = batch.slice(start, ROWS_PER_OUTPUT_BATCH)
                reader.out = _Columns()
                for value in piece.column(0):
                    reader.read(value.as_py())
                yield pa.RecordBatch.from_arrays(
                    piece.columns[1:] + reader.out.arrays(),
                    piece.schema.names[1:] + ["nodes", "texts", "xhtml", "shred_error"],
                )

    return source.mapInArrow(run, f"{kept_ddl}, {SHRED_DDL}" if kept_ddl else SHRED_DDL)
