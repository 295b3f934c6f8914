"""Queries over literal pages and trees whose answers are written out in SQL: what DuckDB cannot parse it can still be compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilnwork.operators import editorial, render, statement, tree

_URL = "https://example.org/contest/17/problem/A"


def _post(body: str) -> str:
    return f'<p>before</p><div class="ttypography">{body}</div><p>after</p>'


_POSTS = {
    1: _post("<table><tr><td>a<tr><td>b</table><p>c</p>"),
    2: _post('<div class="spoiler">x<div class="spoiler-title">a<b class="spoiler-title">b</b></div><i class="spoiler-title">c</i></div>'),
    3: _post("<p>a<script>x</script></p></section>"),
    4: _post("a") + _post("b"),
    5: _post('<div class="problemTutorial"></div>'),
    6: _post("<p><b>a</b> <i>b</i> \n c</p> \n <center><p>d</p></center><pre>x  <b>y</b>\n</pre>"),
    7: _post('<div class="spoiler"><b class="spoiler-title">Show <i>it</i></b><div class="spoiler-content"><p>inside</p></div></div>'),
    8: "<p>no island</p>",
}


def _pages(spark: SparkSession, pages: dict[int, str]) -> DataFrame:
    return spark.createDataFrame([(k, _URL, v) for k, v in pages.items()], "doc_id long, url string, html string")


def _path() -> F.Column:
    return F.when(F.col("path").isNotNull(), F.concat_ws("/", F.transform("path", lambda x: x.cast("string"))))


def t6_ir_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes with a text, and errors, of literal editorial pages."""
    nodes = editorial.editorial_nodes(_pages(spark, _POSTS)).filter("error IS NOT NULL OR text IS NOT NULL")
    return nodes.select("doc_id", _path().alias("place"), "kind", "text", "error")


def t6_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was recovered from on literal editorial pages."""
    nodes = editorial.editorial_nodes(_pages(spark, _POSTS)).filter("size(path) = 0")
    return nodes.select("doc_id", F.array_join(F.transform("diagnostics", lambda x: x["code"]), ",").alias("codes"))


def t11_known_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule that a literal tree breaks."""
    rows = [
        ([], "document", {}), ([0], "heading", {"level": "9"}), ([1], "wrong", {}), ([2], "image", {"src": "https://x.org/a.png"}),
        ([3], "attachment", {"mediaType": "text/html"}), ([4], "tutorial_slot", {"problemCode": "1A"}),
    ]
    nodes = spark.createDataFrame([(1, p, k, a, None) for p, k, a in rows], "doc_id long, path array<int>, kind string, attrs map<string,string>, text string")
    return render.violations(nodes, F.lit("statement")).select("code", F.col("path").alias("place"))


def t13_known_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The HTML of literal editorial pages."""
    pages = {k: _POSTS[k] for k in (1, 6, 7)}
    return render.rendered(editorial.editorial_nodes(_pages(spark, pages)), F.lit("editorial")).select("doc_id", "html", "error")


def t4_known_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with no, one and two statement islands."""
    island = '<div class="problem-statement"><p>x</p></div>'
    nodes = tree.source_nodes(_pages(spark, {1: "<p>x</p>", 2: f"<p>y</p>{island}", 3: island * 2}))
    return tree.islands(nodes, "problem-statement").select("doc_id", _path().alias("place"), "error")


def a13_known_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text below the first paragraph of literal pages."""
    nodes = tree.source_nodes(_pages(spark, {1: "<p>a<b>b</b>c</p>d", 2: "<div>x</div><p>&lt;<i>y</i></p>"}))
    tops = nodes.filter("tag = 'p'").select("doc_id", F.col("path").alias("top"))
    return tree.text_content(nodes, tops).select("doc_id", "text")


def t5_known_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of literal statement pages, and how many nodes the others have."""
    samples = lambda *kinds: '<div class="problem-statement"><div class="sample-tests">' + "".join(f'<div class="{k}"><pre>1</pre></div>' for k in kinds) + "</div></div>"
    pages = {1: samples("input", "output"), 2: samples("input"), 3: samples("output"), 4: samples("input", "input"), 5: "<p>x</p>"}
    return statement.statement_nodes(_pages(spark, pages)).filter("error IS NOT NULL OR attrs['role'] IN ('sample_input', 'sample_output')").select("doc_id", F.col("attrs")["role"].alias("role"), "error")


SQL = {
    "t6_ir_nodes": """SELECT * REPLACE (doc_id::BIGINT AS doc_id) FROM (VALUES
        (1, '0/0/0/0', 'text', 'a', NULL), (1, '0/1/0/0', 'text', 'b', NULL), (1, '1/0', 'text', 'c', NULL),
        (2, '0/-1/0', 'text', 'b', NULL), (2, '0/-1/1', 'text', 'a', NULL), (2, '0/-1/2', 'text', 'c', NULL), (2, '0/0', 'text', 'x', NULL),
        (3, '0/0', 'text', 'a', NULL), (4, '0', 'text', 'a', NULL), (5, NULL, NULL, NULL, 'missing-required-attribute: problemcode'),
        (6, '0/0/0', 'text', 'a', NULL), (6, '0/1', 'text', ' ', NULL), (6, '0/2/0', 'text', 'b', NULL), (6, '0/3', 'text', ' c', NULL),
        (6, '1/0', 'text', 'd', NULL), (6, '2', 'code_block', 'x  y' || chr(10), NULL),
        (7, '0/-1/0', 'text', 'Show ', NULL), (7, '0/-1/1/0', 'text', 'it', NULL), (7, '0/0/0', 'text', 'inside', NULL)
        ) t(doc_id, place, kind, text, error)""",
    "t6_diagnostics": """SELECT * REPLACE (doc_id::BIGINT AS doc_id) FROM (VALUES (1, 'unexpected-end-tag'), (2, ''), (3, 'dropped-dangerous-subtree'), (4, ''), (6, ''), (7, ''), (8, '')) t(doc_id, codes)""",
    "t11_known_violations": """SELECT * FROM (VALUES ('invalid-heading-level', 'document/0'), ('unknown-node-kind', 'document/1'), ('remote-image-in-ready-document', 'document/2'),
        ('invalid-attachment-media-type', 'document/3'), ('unresolved-tutorial-slot', 'document/4')) t(code, place)""",
    "t13_known_html": """SELECT doc_id::BIGINT AS doc_id, html, NULL::VARCHAR AS error FROM (VALUES
        (1, '<table><tr><td>a</td></tr><tr><td>b</td></tr></table><p>c</p>'),
        (6, '<p><strong>a</strong> <em>b</em> c</p><p>d</p><pre><code>x  y' || chr(10) || '</code></pre>'),
        (7, '<details class="cf-spoiler"><summary>Show <em>it</em></summary><p>inside</p></details>')) t(doc_id, html)""",
    "t4_known_islands": """SELECT * REPLACE (doc_id::BIGINT AS doc_id) FROM (VALUES (1, NULL, 'missing-problem-statement'), (2, '1', NULL), (3, NULL, 'ambiguous-problem-statement')) t(doc_id, place, error)""",
    "a13_known_texts": """SELECT * REPLACE (doc_id::BIGINT AS doc_id) FROM (VALUES (1, 'abc'), (2, '<y')) t(doc_id, text)""",
    "t5_known_pages": """SELECT * REPLACE (doc_id::BIGINT AS doc_id) FROM (VALUES (1, 'sample_input', NULL), (1, 'sample_output', NULL), (2, NULL, 'unpaired-sample-input'), (3, NULL, 'unpaired-sample-output'),
        (4, NULL, 'invalid-sample-pair'), (5, NULL, 'missing-problem-statement')) t(doc_id, role, error)""",
}
QUERIES = {name: globals()[name] for name in SQL}
