"""IR trees: validation, and rendering to HTML with native columns.

Every node gives an opening token at its path and a closing one at its path followed by CLOSE, so that a document's HTML is the
concatenation of its tokens by key. Children of nodes that render by themselves are left out: a running maximum of such nodes'
closing keys tells whether a node lies inside one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kilnwork.functions import text as T
from kilnwork.functions import urls
from kilnwork.operators.once import once

CLOSE = 2147483647
MAX_NODES, MAX_DEPTH = 50_000, 64

# The kinds of nodes, and the element and class that each statement role is written with.
BLOCK_KINDS = (
    "document", "section", "problem_section", "heading", "paragraph", "list", "list_item", "quote", "blockquote", "code_block", "math_block", "table", "table_head", "table_body", "table_row", "table_cell", "spoiler", "tutorial_slot",
    "image", "attachment", "horizontal_rule", "line_break", "missing_asset", "container",
)
INLINE_KINDS = ("text", "strong", "emphasis", "inline_code", "math_inline", "link", "subscript", "superscript")
ROLE_ELEMENTS = {
    "body": ("section", "cf-statement-body"), "input_specification": ("section", "cf-input-specification"), "output_specification": ("section", "cf-output-specification"), "samples": ("section", "cf-samples"),
    "sample": ("section", "cf-sample"), "sample_input": ("section", "cf-sample-input"), "sample_output": ("section", "cf-sample-output"), "note": ("section", "cf-note"), "interaction": ("section", "cf-interaction"),
    "scoring": ("section", "cf-scoring"), "custom": ("section", "cf-custom-section"), "time_limit": ("div", "cf-time-limit"), "memory_limit": ("div", "cf-memory-limit"), "input_channel": ("div", "cf-input-channel"), "output_channel": ("div", "cf-output-channel"),
}
MISSING = '<span class="img-missing">Image unavailable</span>'
_WRAPPED = {"section": "section", "paragraph": "p", "list_item": "li", "blockquote": "blockquote", "quote": "blockquote", "table": "table", "table_head": "thead", "table_body": "tbody", "table_row": "tr", "strong": "strong", "emphasis": "em", "inline_code": "code", "subscript": "sub", "superscript": "sup"}
_ALONE = ("code_block", "math_inline", "math_block", "text", "image", "horizontal_rule", "line_break", "missing_asset")


def _attr(name: str) -> Column:
    return F.col("attrs")[name]


def _label(path: Column) -> Column:
    return F.array_join(F.concat(F.array(F.lit("document")), F.transform(path, lambda x: x.cast("string"))), "/")


def violations(nodes: DataFrame, content_kind: Column, ready: bool = True) -> DataFrame:
    """(doc_id, code, message, path) of every rule that a tree breaks; titles of spoilers are not looked at. Below a node that is too deep, or from the 50,001st on, nothing else is told."""
    kind, title = F.col("kind"), F.exists("path", lambda x: x < 0)
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("path"))
    rows = nodes.filter(F.col("path").isNotNull() & ~title).withColumns({"_n": rank, "_kind": content_kind, "_depth": F.size("path")})
    within = (F.col("_n") <= MAX_NODES) & (F.col("_depth") <= MAX_DEPTH)
    level = F.coalesce(_attr("level"), F.lit("None"))
    local = lambda name, what: F.coalesce(urls.asset_fits(urls.route_name(_attr(name), F.col("_kind")), F.col("_kind"), what), F.lit(False))
    tell = lambda test, code, message: F.when(test, F.struct(F.lit(code).alias("code"), message.alias("message")))
    pdf = F.coalesce(_attr("mediaType") == "application/pdf", F.lit(False))
    rules = [
        tell(F.col("_n") == MAX_NODES + 1, "node-limit-exceeded", F.col("_n").cast("string")), tell((F.col("_n") <= MAX_NODES) & (F.col("_depth") == MAX_DEPTH + 1), "depth-limit-exceeded", F.col("_depth").cast("string")),
        tell(within & ~kind.isin(*BLOCK_KINDS, *INLINE_KINDS), "unknown-node-kind", kind), tell(within & (kind == "heading") & ~level.isin(*"123456"), "invalid-heading-level", level),
        tell(within & (kind == "attachment") & (F.col("_kind") != "statement"), "invalid-attachment-content-kind", F.col("_kind")), tell(within & (kind == "attachment") & (F.col("_kind") == "statement") & ~pdf, "invalid-attachment-media-type", F.coalesce(_attr("mediaType"), F.lit(""))),
    ]
    if ready:
        rules += [
            tell(within & (kind == "tutorial_slot"), "unresolved-tutorial-slot", F.coalesce(_attr("problemCode"), F.lit(""))), tell(within & (kind == "image") & ~local("src", "image"), "remote-image-in-ready-document", F.coalesce(_attr("src"), F.lit(""))),
            tell(within & (kind == "attachment") & (F.col("_kind") == "statement") & pdf & ~local("href", "attachment"), "remote-attachment-in-ready-document", F.coalesce(_attr("href"), F.lit(""))),
        ]
    out = rows.withColumn("_v", F.explode(F.array_compact(F.array(*rules))))
    return out.select("doc_id", "_v.code", "_v.message", _label(F.col("path")).alias("path"))


def _tokens(statement: Column) -> tuple[Column, Column, Column]:
    """Opening text, closing text and error of a node."""
    kind, role, text = F.col("kind"), _attr("role"), F.coalesce("text", F.lit(""))
    level = _attr("level")
    body = T.escaped(T.math_normal(text))
    wrap = F.create_map(*[F.lit(x) for kv in _WRAPPED.items() for x in kv])
    element = F.create_map(*[F.lit(x) for r, (e, _) in ROLE_ELEMENTS.items() for x in (r, e)])
    style = F.create_map(*[F.lit(x) for r, (_, c) in ROLE_ELEMENTS.items() for x in (r, c)])
    src, href = urls.image(_attr("src"), F.when(statement, "statement").otherwise("editorial")), urls.link(_attr("href"))
    pdf = urls.attachment(_attr("href"))
    language = F.coalesce(_attr("language"), T.code_language(text))
    tag = F.try_element_at(wrap, kind)
    said = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    error = (
        F.when(role.isNotNull() & ~statement, "invalid-content-role").when((role == "title") & (kind != "heading"), "invalid-statement-role-node").when((role == "title") & ~F.coalesce(level == "1", F.lit(False)), "invalid-heading-level")
        .when(role.isNotNull() & (role != "title") & F.try_element_at(element, role).isNull(), "unknown-statement-role").when((kind == "heading") & ~F.coalesce(level.isin(*"123456"), F.lit(False)), "invalid-heading-level")
        .when(kind == "tutorial_slot", "unresolved-tutorial-slot").when((kind == "attachment") & (~statement | ~F.coalesce(_attr("mediaType") == "application/pdf", F.lit(False))), "invalid-attachment").when((kind == "attachment") & pdf.isNull(), "unsafe-attachment-url")
    )
    opening = (
        F.when(role == "title", F.lit('<h1 class="cf-statement-title">')).when(role.isNotNull(), said("<", F.try_element_at(element, role), ' class="', F.try_element_at(style, role), '">')).when(tag.isNotNull(), said("<", tag, ">"))
        .when(kind == "heading", said("<h", level, ">")).when(kind == "problem_section", said('<section data-problem-code="', T.escaped(F.coalesce(_attr("problemCode"), F.lit(""))), '">'))
        .when(kind == "list", F.when(_attr("ordered") == "true", "<ol>").otherwise("<ul>")).when(kind == "table_cell", F.when(_attr("header") == "true", "<th>").otherwise("<td>"))
        .when(kind == "code_block", said(F.when(language.isin(*T.LANGUAGES), said('<pre><code class="language-', language, '">')).otherwise("<pre><code>"), T.escaped(text), "</code></pre>"))
        .when(kind == "math_inline", said('<span class="cf-math-inline">', body, "</span>")).when(kind == "math_block", said('<div class="cf-math-block">', body, "</div>")).when(kind == "spoiler", '<details class="cf-spoiler"><summary>')
        .when(kind == "image", F.when(src.isNull(), MISSING).otherwise(said('<img src="', T.escaped(src), '" alt="', T.escaped(F.coalesce(_attr("alt"), F.lit(""))), '">')))
        .when(kind == "attachment", said('<a class="cf-attachment" href="', T.escaped(pdf), '" target="_blank" rel="noopener noreferrer" type="application/pdf">', F.when(F.col("_children") == 0, T.escaped(F.coalesce(_attr("label"), F.lit("Open PDF")))).otherwise("")))
        .when(kind == "horizontal_rule", "<hr>").when(kind == "line_break", "<br>").when(kind == "missing_asset", MISSING).when(kind == "text", body)
        .when((kind == "link") & href.isNotNull(), said('<a href="', T.escaped(href), '"', F.when(href.rlike("^(?i)https?:"), ' target="_blank" rel="noopener noreferrer"').otherwise(""), ">"))
        .otherwise("")
    )
    closing = (
        F.when(role == "title", F.lit("</h1>")).when(role.isNotNull(), said("</", F.try_element_at(element, role), ">")).when(tag.isNotNull(), said("</", tag, ">")).when(kind == "heading", said("</h", level, ">")).when(kind == "problem_section", "</section>")
        .when(kind == "list", F.when(_attr("ordered") == "true", "</ol>").otherwise("</ul>")).when(kind == "table_cell", F.when(_attr("header") == "true", "</th>").otherwise("</td>")).when(kind == "spoiler", "</details>").when(kind == "attachment", "</a>")
        .when((kind == "link") & href.isNotNull(), "</a>").otherwise("")
    )
    return opening, closing, error


def rendered(nodes: DataFrame, content_kind: Column, validate: bool = True) -> DataFrame:
    """(doc_id, html, error): one row a document; html is null where a node cannot be rendered, with the first error in document order.

    The nodes are computed once, and the rendering and the violations are read from that.
    """
    statement, nodes = content_kind == "statement", once(nodes)
    known = nodes.filter("path IS NOT NULL").withColumn("path", F.col("path").cast("array<int>"))
    end = F.concat("path", F.array(F.lit(CLOSE)))
    order = Window.partitionBy("doc_id").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    held = F.max(F.when(F.col("kind").isin(*_ALONE) & _attr("role").isNull(), end)).over(order)
    shown = known.withColumn("_held", held).filter(F.col("_held").isNull() | (F.col("_held") < F.col("path"))).drop("_held")
    parent = F.slice("path", F.lit(1), F.greatest(F.size("path") - 1, F.lit(0)))
    counts = shown.filter((F.size("path") > 0) & (F.element_at("path", -1) >= 0)).groupBy("doc_id", parent.alias("path")).agg(F.count("*").alias("_children"), F.min(F.struct("path", "kind")).alias("_first"))
    shown = shown.join(counts, ["doc_id", "path"], "left").withColumn("_children", F.coalesce("_children", F.lit(0)))
    opening, closing, error = _tokens(statement)
    tokens = F.array(F.struct(F.col("path").alias("key"), opening.alias("token")), F.struct(end.alias("key"), closing.alias("token")))
    summary = F.array(F.struct(F.concat("path", F.array(F.lit(-1), F.lit(CLOSE))).alias("key"), F.lit("</summary>").alias("token")))
    shown = shown.withColumns({"_error": error, "_tokens": F.when((F.col("kind") == "spoiler") & _attr("role").isNull(), F.concat(tokens, summary)).otherwise(tokens)})
    # a limit's label ends with a colon: its own or one put behind it
    limit = _attr("role").isin("time_limit", "memory_limit") & (F.col("_children") > 1) & (F.col("_first.kind") == "container")
    labels = shown.filter(limit).select("doc_id", F.col("_first.path").alias("top"))
    inner = known.select("doc_id", F.col("path").alias("_p"), "text").join(labels, "doc_id").filter(F.slice("_p", F.lit(1), F.size("top")) == F.col("top"))
    said = F.rtrim(F.regexp_replace(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_p", "text"))), lambda x: F.coalesce(x["text"], F.lit(""))), ""), r"(?U)\s+$", ""))
    colons = inner.groupBy("doc_id", "top").agg(said.alias("said")).filter((F.col("said") != "") & ~F.col("said").rlike("[:：]$"))
    extra = colons.select("doc_id", F.concat("top", F.array(F.lit(CLOSE), F.lit(0))).alias("key"), F.lit(":").alias("token"), F.lit(None).cast("string").alias("_error"))
    told = shown.select("doc_id", F.explode("_tokens").alias("_t"), "_error").select("doc_id", "_t.key", "_t.token", "_error").unionByName(extra)
    html = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", "token"))), lambda x: x["token"]), "")
    out = told.groupBy("doc_id").agg(html.alias("html"), F.min(F.when(F.col("_error").isNotNull(), F.struct("key", "_error"))).alias("_e")).select("doc_id", "html", F.col("_e._error").alias("error"))
    if validate:
        bad = violations(nodes, content_kind).groupBy("doc_id").agg(F.min(F.struct("path", "code")).alias("_v")).select("doc_id", F.col("_v.code").alias("_code"))
        out = out.join(bad, "doc_id", "left").withColumn("error", F.coalesce("_code", "error")).drop("_code")
    out = out.withColumn("html", F.when(F.col("error").isNull(), F.col("html")))
    if "error" in nodes.columns:
        out = out.unionByName(nodes.filter("path IS NULL").select("doc_id", F.lit(None).cast("string").alias("html"), "error"))
    return out
