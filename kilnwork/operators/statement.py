"""Problem statements: from a page's tree to a typed tree (the IR), as rows (doc_id, path, kind, attrs, text).

Attribute values are strings: level `1`, ordered and header `true` or `false`. The mapping runs over a parsed page in one pass,
writing rows while it goes down; what a page cannot be mapped for is its error code, and what is left out a diagnostic.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame

from kilnwork.operators.tree import LimitExceeded, Limits, Rows, parsed

# Roles by class, in the order that they are looked for; kinds by element; what is dropped; the schemes that links may have.
ROLES = {
    "title": "title", "time-limit": "time_limit", "memory-limit": "memory_limit", "input-file": "input_channel", "output-file": "output_channel", "problem-description": "body", "statement-body": "body",
    "input-specification": "input_specification", "output-specification": "output_specification", "sample-tests": "samples", "note": "note", "interaction": "interaction", "scoring": "scoring", "custom-section": "custom",
}
BLOCKS = {
    "p": "paragraph", "ol": "list", "ul": "list", "li": "list_item", "blockquote": "blockquote", "table": "table", "thead": "table_head", "tbody": "table_body", "tr": "table_row", "th": "table_cell", "td": "table_cell",
    "div": "container", "section": "container",
}
INLINES = {"a": "link", "strong": "strong", "b": "strong", "em": "emphasis", "i": "emphasis", "code": "inline_code", "sub": "subscript", "sup": "superscript"}
DANGEROUS = frozenset("embed form iframe object script style".split())
SCHEMES = frozenset(["", "http", "https", "mailto"])
_HEADER_ROLES = frozenset("title time_limit memory_limit input_channel output_channel".split())
_BLANKS = re.compile(r"[\t\n\f\r ]+")


class MappingError(ValueError):
    """Its text is the error code."""


def resolved(base: str, url: str, with_host: bool = False, empty: bool = False) -> str | None:
    """The absolute form of a URL, null if its scheme is not let through (or, with_host, it names no web host). An empty one counts only with `empty`."""
    if not url and not empty:
        return None
    try:
        full = urljoin(base, url)
        parts = urlsplit(full)
    except ValueError:
        return None
    web = parts.scheme.lower() in ("http", "https") and parts.netloc
    return full if (web if with_host else parts.scheme.lower() in SCHEMES) else None


class Writer:
    """Rows of an IR in document order: node() writes one, and what is written inside it lies below it."""

    def __init__(self, limits: Limits):
        self.limits, self.rows, self.diagnostics = limits, [], []
        self._at: list[int] = []
        self._next = [0]
        self.rows.append(((), "document", {}, None))

    @contextmanager
    def node(self, kind: str, attrs: dict | None = None, text: str | None = None):
        if len(self.rows) >= self.limits.nodes:
            raise MappingError("max-nodes-exceeded")
        self._at.append(self._next[-1])
        self._next[-1] += 1
        self._next.append(0)
        self.rows.append((tuple(self._at), kind, attrs or {}, text))
        yield
        self._at.pop()
        self._next.pop()

    def leaf(self, kind: str, attrs: dict | None = None, text: str | None = None) -> None:
        with self.node(kind, attrs, text):
            pass

    def warn(self, code: str, message: str) -> None:
        self.diagnostics.append({"severity": "warning", "code": code, "message": message, "path": None})


class Page:
    """A parsed page with children and classes at hand."""

    def __init__(self, rows: Rows):
        self.tag, self.attrs, self.text = rows.tag, rows.attrs, rows.text
        self.kids: list[list[int]] = [[] for _ in rows.tag]
        for k, up in enumerate(rows.parent):
            if up >= 0:
                self.kids[up].append(k)
        self.classes = [frozenset(a.get("class", "").split()) for a in rows.attrs]

    def walk(self, k: int) -> Iterator[int]:
        todo = [k]
        while todo:
            yield (at := todo.pop())
            todo += reversed(self.kids[at])

    def whole_text(self, k: int) -> str:
        return "".join(self.text[n] for n in self.walk(k))

    def blank(self, k: int) -> bool:
        return self.tag[k] == "#text" and not self.text[k].strip()

    def lines(self, k: int) -> str:
        """The text of a preformatted element: br is a line feed, and an example's line ends with one."""
        if self.tag[k] in ("#text", "br"):
            return "\n" if self.tag[k] == "br" else self.text[k]
        out = "".join(map(self.lines, self.kids[k]))
        return out + "\n" if "test-example-line" in self.classes[k] and out[-1:] != "\n" else out


class Statement:
    def __init__(self, page: Page, url: str, limits: Limits):
        self.page, self.url, self.out = page, url, Writer(limits)

    def island(self) -> None:
        page = self.page
        tops = [k for k in page.walk(0) if "problem-statement" in page.classes[k]]
        if len(tops) != 1:
            raise MappingError("ambiguous-problem-statement" if tops else "missing-problem-statement")
        body = False
        for k in page.kids[tops[0]]:
            if page.blank(k):
                continue
            role = self.role(k)
            if "header" in page.classes[k]:
                for h in page.kids[k]:
                    if not page.blank(h) and not page.classes[h] & {"input-standard", "output-standard"} and self.role(h) in _HEADER_ROLES:
                        self.part(h, self.role(h))
            elif role == "samples":
                self.samples(k)
            elif role is None and page.tag[k] in DANGEROUS:
                self.out.warn("dropped-dangerous-subtree", page.tag[k])
            else:
                self.part(k, role or ("custom" if body else "body"))
                body |= role in (None, "body")

    def role(self, k: int) -> str | None:
        return next((r for c, r in ROLES.items() if c in self.page.classes[k]), None)

    def part(self, k: int, role: str) -> None:
        page, attrs = self.page, {"role": role}
        if role == "custom":
            titled = next((n for n in page.walk(k) if "section-title" in page.classes[n]), None)
            title = "" if titled is None else _BLANKS.sub(" ", page.whole_text(titled)).strip()
            attrs |= {"title": title} if title else {}
        kind = "heading" if role == "title" else "container" if role in _HEADER_ROLES else "section"
        with self.out.node(kind, attrs | ({"level": "1"} if role == "title" else {})):
            for c in page.kids[k]:
                tail = None
                if role in ("time_limit", "memory_limit") and "property-title" in page.classes[c]:
                    label = _BLANKS.sub(" ", page.whole_text(c)).strip()
                    tail = ":" if label and label[-1] not in ":：" else None
                self.plain(c, tail)

    def samples(self, k: int) -> None:
        page, given = self.page, None
        with self.out.node("section", {"role": "samples"}):
            for c in (c for c in page.kids[k] if not page.blank(c)):
                own = page.classes[c]
                if given is not None:
                    if "output" not in own:
                        raise MappingError("invalid-sample-pair")
                    self.sample(given, c)
                    given = None
                elif "section-title" in own:
                    self.plain(c)
                elif "sample-test" in own:
                    self.wrapped(c)
                elif "input" in own:
                    given = c
                elif "output" in own:
                    raise MappingError("unpaired-sample-output")
                else:
                    self.plain(c)
            if given is not None:
                raise MappingError("unpaired-sample-input")

    def wrapped(self, k: int) -> None:
        """Samples in a wrapper: inputs and outputs must take turns; br and blanks do not count."""
        page = self.page
        parts = [c for c in page.kids[k] if not page.blank(c) and page.tag[c] != "br"]
        sides = ["input" if "input" in page.classes[c] else "output" if "output" in page.classes[c] else "other" for c in parts]
        for n, (c, side) in enumerate(zip(parts, sides, strict=True)):
            if side != ("input", "output")[n % 2]:
                raise MappingError("invalid-sample-pair")
            if n % 2:
                self.sample(parts[n - 1], c)
        if len(parts) % 2:
            raise MappingError("invalid-sample-pair")

    def sample(self, given: int, wanted: int) -> None:
        with self.out.node("section", {"role": "sample"}):
            for k, role in ((given, "sample_input"), (wanted, "sample_output")):
                with self.out.node("section", {"role": role}):
                    for c in self.page.kids[k]:
                        if "title" in self.page.classes[c]:
                            self.inside(c, "heading", {"level": "3"})
                        else:
                            self.plain(c)

    def inside(self, k: int, kind: str, attrs: dict | None = None, tail: str | None = None) -> None:
        with self.out.node(kind, attrs):
            for c in self.page.kids[k]:
                self.plain(c)
            if tail:
                self.out.leaf("text", text=tail)

    def alone(self, kind: str, attrs: dict | None = None, text: str | None = None, tail: str | None = None) -> None:
        with self.out.node(kind, attrs, text):
            if tail:
                self.out.leaf("text", text=tail)

    def plain(self, k: int, tail: str | None = None) -> None:
        """One element or text by the general rules; tail: a text to close it with."""
        page, tag, own = self.page, self.page.tag[k], self.page.classes[k]
        if tag == "#text":
            if page.text[k].strip():
                self.out.leaf("text", text=_BLANKS.sub(" ", page.text[k]))
        elif tag in DANGEROUS:
            self.out.warn("dropped-dangerous-subtree", tag)
        elif tag == "pre":
            self.alone("code_block", text=page.lines(k), tail=tail)
        elif own & {"tex-span", "tex-display"}:
            self.alone("math_inline" if "tex-span" in own else "math_block", text=page.whole_text(k), tail=tail)
        elif own & {"section-title", "title"}:
            self.inside(k, "heading", {"level": "2"}, tail)
        elif re.fullmatch("h[1-6]", tag):
            self.inside(k, "heading", {"level": tag[1]}, tail)
        elif tag in ("hr", "br"):
            self.alone("horizontal_rule" if tag == "hr" else "line_break", tail=tail)
        elif tag == "img":
            alt, src = page.attrs[k].get("alt", ""), resolved(self.url, page.attrs[k].get("src", ""), with_host=True)
            if src is None:
                self.out.warn("unsupported-image-source", "Replaced unsupported image source")
            self.alone("missing_asset" if src is None else "image", {"alt": alt} if src is None else {"src": src, "alt": alt}, tail=tail)
        elif tag in INLINES:
            attrs = {}
            if tag == "a" and page.attrs[k].get("href"):
                href = resolved(self.url, page.attrs[k]["href"])
                if href is None:
                    self.out.warn("unsupported-link-url", "Dropped unsupported link URL")
                else:
                    attrs["href"] = href
            self.inside(k, INLINES[tag], attrs, tail)
        else:
            attrs = {"ordered": str(tag == "ol").lower()} if tag in ("ol", "ul") else {"header": str(tag == "th").lower()} if tag in ("th", "td") else {}
            self.inside(k, BLOCKS.get(tag, "container"), attrs, tail)


IR = "doc_id long, path array<int>, kind string, attrs map<string, string>, text string, error string, diagnostics array<struct<severity: string, code: string, message: string, path: string>>"
_DIAGNOSTIC = pa.struct([(n, pa.string()) for n in ("severity", "code", "message", "path")])
IR_TYPES = (pa.int64(), pa.list_(pa.int32()), pa.string(), pa.map_(pa.string(), pa.string()), pa.string(), pa.string(), pa.list_(_DIAGNOSTIC))
IR_NAMES = ["doc_id", "path", "kind", "attrs", "text", "error", "diagnostics"]


def ir_batch(doc_id: object, writer: Writer | None, error: str | None) -> pa.RecordBatch:
    """A document's rows; its diagnostics are on the root's. A document with an error is one row without a path."""
    rows = [(None, None, None, None)] if writer is None else writer.rows
    n = len(rows)
    columns = ([doc_id] * n, [None if r[0] is None else list(r[0]) for r in rows], [r[1] for r in rows], [None if r[2] is None else list(r[2].items()) for r in rows], [r[3] for r in rows], [error] * n, [writer.diagnostics if writer else None] + [None] * (n - 1))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, IR_TYPES, strict=True)], IR_NAMES)


def statement_nodes(pages: DataFrame, limits: Limits = Limits(), strict: bool = True) -> DataFrame:
    """The IR of (doc_id, url, html) statement pages, or their error codes."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, url, html in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "url", "html")), strict=True):
                try:
                    own = Statement(Page(parsed(html or "", limits, strict)), url or "", limits)
                    own.island()
                    yield ir_batch(doc_id, own.out, None)
                except (LimitExceeded, MappingError) as error:
                    yield ir_batch(doc_id, None, str(error))

    return pages.select("doc_id", "url", "html").mapInArrow(scan, IR)
