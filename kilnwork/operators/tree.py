"""HTML into trees of rows, and queries over them.

A node is a row (doc_id, path, tag, attrs, text); path holds the ordinals from the root down, so that its order is document order,
its length the depth, and an ancestor is a prefix. The root has the empty path and tag `#document`, texts have tag `#text`. Parsing is the
only Python; a document over a limit is one row of the error table and has no nodes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilnwork.functions.text import class_tokens


@dataclass(frozen=True)
class Limits:
    input_bytes: int = 4_000_000
    depth: int = 128
    nodes: int = 100_000
    attributes: int = 32
    text_chars: int = 2_000_000
    recoveries: int = 500


class LimitExceeded(ValueError):
    """Its text is the error code."""


# Elements without content, and which open elements a start tag closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr menu nav ol p pre section table ul".split())
CLOSED_BY = {"p": CLOSES_P, "li": {"li"}, "tr": {"tr"}, "th": {"th", "td", "tr"}, "td": {"th", "td", "tr"}}
_SCOPES = {"li": {"ul", "ol"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}}


class Rows(HTMLParser):
    """Collects a document's nodes: parallel lists of parent, ordinal among its siblings, tag, attributes and text."""

    def __init__(self, limits: Limits, strict: bool = True):
        super().__init__(convert_charrefs=True)
        self.limits, self.strict = limits, strict
        self.parent, self.place, self.tag, self.attrs, self.text = [-1], [0], ["#document"], [{}], [""]
        self.children, self.last_child, self.open, self.chars = [0], [-1], [0], 0

    def _add(self, tag: str, attrs: dict, text: str) -> int:
        if len(self.tag) >= self.limits.nodes:
            raise LimitExceeded("max-nodes-exceeded")
        up, own = self.open[-1], len(self.tag)
        for column, value in ((self.parent, up), (self.place, self.children[up]), (self.tag, tag), (self.attrs, attrs), (self.text, text), (self.children, 0), (self.last_child, -1)):
            column.append(value)
        self.children[up] += 1
        self.last_child[up] = own
        return own

    def _ends_at(self, incoming: str) -> int | None:
        """The place in the stack of the nearest open element that this start tag closes; with strict off, a list or table around it shields what lies outside."""
        for at in range(len(self.open) - 1, 0, -1):
            held = self.tag[self.open[at]]
            if incoming in CLOSED_BY.get(held, ()):
                return at
            if not self.strict and held in _SCOPES.get(incoming, ()):
                return None
        return None

    def handle_starttag(self, tag, attrs):
        if len(attrs) > self.limits.attributes:
            raise LimitExceeded("max-attributes-exceeded")
        at = self._ends_at(tag)
        if at is not None:
            del self.open[at:]
        if len(self.open) > self.limits.depth:
            raise LimitExceeded("max-depth-exceeded")
        own = self._add(tag, {k.lower(): v or "" for k, v in attrs}, "")
        if tag not in VOID:
            self.open.append(own)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        held = [self.tag[k] for k in self.open]
        if tag in held[1:]:
            del self.open[len(held) - 1 - held[::-1].index(tag) :]

    def handle_data(self, data):
        self.chars += len(data)
        if self.chars > self.limits.text_chars:
            raise LimitExceeded("max-text-chars-exceeded")
        last = self.last_child[self.open[-1]]
        if last >= 0 and self.tag[last] == "#text":
            self.text[last] += data
        elif data:
            self._add("#text", {}, data)

    def paths(self) -> list[tuple[int, ...]]:
        out: list[tuple[int, ...]] = []
        for up, at in zip(self.parent, self.place, strict=True):
            out.append(() if up < 0 else (*out[up], at))
        return out


def parsed(html: str, limits: Limits = Limits(), strict: bool = True) -> Rows:
    if len(html.encode("utf-8", "replace")) > limits.input_bytes:
        raise LimitExceeded("max-input-bytes-exceeded")
    rows = Rows(limits, strict)
    rows.feed(html)
    rows.close()
    return rows


_NODES = "doc_id long, path array<int>, tag string, attrs map<string, string>, text string, error string"


def source_nodes(pages: DataFrame, limits: Limits = Limits(), strict: bool = True) -> DataFrame:
    """Nodes of (doc_id, html); a document over a limit gives one row with its error code and no path. A null html counts as empty."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.list_(pa.int32()), pa.string(), pa.map_(pa.string(), pa.string()), pa.string(), pa.string())
        names = ["doc_id", "path", "tag", "attrs", "text", "error"]
        for batch in batches:
            for doc_id, html in zip(batch.column("doc_id").to_pylist(), batch.column("html").to_pylist(), strict=True):
                try:
                    rows = parsed(html or "", limits, strict)
                    n = len(rows.tag)
                    columns = ([doc_id] * n, rows.paths(), rows.tag, [list(x.items()) for x in rows.attrs], rows.text, [None] * n)
                except LimitExceeded as error:
                    columns = ([doc_id], [None], [None], [None], [None], [str(error)])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return pages.select("doc_id", "html").mapInArrow(scan, _NODES)


def has_class(name: str) -> Column:
    return F.array_contains(class_tokens(F.coalesce(F.col("attrs")["class"], F.lit(""))), name)


def first_with_class(nodes: DataFrame, name: str) -> DataFrame:
    """Each document's first node, in document order, that has the class."""
    return nodes.filter(has_class(name)).groupBy("doc_id").agg(F.min(F.struct("path", "tag")).alias("_n")).select("doc_id", "_n.path", "_n.tag")


def islands(nodes: DataFrame, name: str) -> DataFrame:
    """(doc_id, path, error): the only node with the class, or `missing-<name>` or `ambiguous-<name>`."""
    found = nodes.groupBy("doc_id").agg(F.count_if(has_class(name) & (F.col("tag") != "#text")).alias("n"), F.min(F.when(has_class(name) & (F.col("tag") != "#text"), F.col("path"))).alias("path"))
    return found.select("doc_id", F.when(F.col("n") == 1, F.col("path")).alias("path"), F.when(F.col("n") == 0, f"missing-{name}").when(F.col("n") > 1, f"ambiguous-{name}").alias("error"))


def below(path: Column, top: Column) -> Column:
    """Whether a path is that of the node `top` or of one below it."""
    return F.slice(path, F.lit(1), F.size(top)) == top


def text_content(nodes: DataFrame, tops: DataFrame) -> DataFrame:
    """The text below each node of (doc_id, top), in document order."""
    rows = nodes.join(tops, "doc_id").filter(below(F.col("path"), F.col("top")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "text"))), lambda x: x["text"]), "")
    return rows.groupBy("doc_id", "top").agg(text.alias("text"))


def totals(nodes: DataFrame) -> DataFrame:
    """Nodes, characters and depth of each document."""
    return nodes.filter("error IS NULL").groupBy("doc_id").agg(F.count("*").alias("nodes"), F.sum(F.length("text")).alias("chars"), F.max(F.size("path")).alias("depth"))
