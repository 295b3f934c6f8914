"""Trees, statements, editorials, composition and rendering on literal pages."""

import pytest
from pyspark.sql import functions as F

from kilnwork.operators import editorial, render, statement, tree
from kilnwork.operators.tree import Limits

URL = "https://example.org/contest/17/problem/A"


def page(body):
    return f'<html><body><div class="problem-statement">{body}</div></body></html>'


def frame(spark, *htmls):
    return spark.createDataFrame([(k, URL, h) for k, h in enumerate(htmls)], "doc_id long, url string, html string")


def ir(spark, *htmls, mapper=statement.statement_nodes):
    out = {}
    for r in mapper(frame(spark, *htmls)).orderBy("doc_id", "path").collect():
        out.setdefault(r.doc_id, []).append(r)
    return [out[k] for k in range(len(htmls))]


def html_of(spark, *htmls, mapper=statement.statement_nodes, kind="statement"):
    rows = render.rendered(mapper(frame(spark, *htmls)), F.lit(kind)).orderBy("doc_id").collect()
    return [r.error or r.html for r in rows]


# trees


def shape(html, **kw):
    rows = tree.parsed(html, **kw)
    return [(p, t) for p, t in zip(rows.paths(), rows.tag, strict=True) if t != "#document"]


def test_tree_of_unclosed_elements():
    assert shape("<p>a<p>b<br>c") == [((0,), "p"), ((0, 0), "#text"), ((1,), "p"), ((1, 0), "#text"), ((1, 1), "br"), ((1, 2), "#text")]
    assert shape("<i>a</b>b</i>c") == [((0,), "i"), ((0, 0), "#text"), ((1,), "#text")]


def test_nested_lists_with_and_without_shields():
    nested = "<ol><li>first<ul><li>nested</li></ul></li></ol>"
    assert ((0, 1), "li") in shape(nested)
    assert ((0, 0, 1, 0), "li") in shape(nested, strict=False)


def test_limits_are_errors_of_the_row(spark):
    deep, many = "<b>" * 140, "<br>" * 30
    rows = tree.source_nodes(frame(spark, deep, many, None, "<a " + " ".join(f"a{k}=1" for k in range(40)) + ">"), Limits(nodes=20)).filter("error IS NOT NULL").collect()
    assert {r.doc_id: r.error for r in rows} == {0: "max-nodes-exceeded", 1: "max-nodes-exceeded", 3: "max-attributes-exceeded"}
    rows = tree.source_nodes(frame(spark, deep, "é" * 10), Limits(input_bytes=500, depth=100)).filter("error IS NOT NULL").collect()
    assert [r.error for r in rows] == ["max-depth-exceeded"]


def test_queries_over_trees(spark):
    nodes = tree.source_nodes(frame(spark, '<div>x<p class="a b">one <b>two</b></p><p class="b">three</p></div>', "<p>none</p>")).cache()
    assert [(r.doc_id, r.path) for r in tree.first_with_class(nodes, "b").collect()] == [(0, [0, 1])]
    assert {(r.doc_id, r.error) for r in tree.islands(nodes, "b").collect()} == {(0, "ambiguous-b"), (1, "missing-b")}
    assert {(r.doc_id, r.error) for r in tree.islands(nodes, "a").collect()} == {(0, None), (1, "missing-a")}
    tops = spark.createDataFrame([(0, [0, 1])], "doc_id long, top array<int>")
    assert [r.text for r in tree.text_content(nodes, tops).collect()] == ["one two"]
    assert {(r.doc_id, r.nodes, r.depth) for r in tree.totals(nodes).collect()} == {(0, 9, 4), (1, 3, 2)}


# statements


def test_statement_roles(spark):
    body = """<div class="header"><div class="title">A. Sum</div><div class="time-limit"><div class="property-title">time limit</div>1 second</div><div class="input-file input-standard">stdin</div></div>
      <div><p>Add <span class="tex-span">a</span>.</p></div><div class="input-specification"><div class="section-title">Input</div>x</div><div class="extra"><div class="section-title"> More  here </div></div><script>bad()</script>"""
    (rows,) = ir(spark, page(body))
    roles = [(r.kind, r.attrs["role"]) for r in rows if "role" in r.attrs]
    assert roles == [("heading", "title"), ("container", "time_limit"), ("section", "body"), ("section", "input_specification"), ("section", "custom")]
    assert next(r.attrs["title"] for r in rows if r.attrs.get("role") == "custom") == "More here"
    assert [(d.code, d.message) for d in rows[0].diagnostics] == [("dropped-dangerous-subtree", "script")]
    (html,) = html_of(spark, page(body))
    assert html.startswith('<h1 class="cf-statement-title">A. Sum</h1><div class="cf-time-limit">time limit:1 second</div><section class="cf-statement-body"><p>Add <span class="cf-math-inline">a</span>.</p></section>')


def samples(inner):
    return page(f'<div class="sample-tests">{inner}</div>')


def test_sample_pairs(spark):
    given, wanted = '<div class="input"><div class="title">Input</div><pre>1<br>2</pre></div>', '<div class="output"><pre><div class="test-example-line">x</div><div class="test-example-line">y</div></pre></div>'
    wrap = lambda x: samples(f'<div class="sample-test">{x}</div>')
    out = ir(spark, samples(given + " \n" + wanted), samples(given), samples(wanted), samples(given + "<p>x</p>" + wanted), wrap(given + "<br>" + wanted), wrap(given + given), wrap(wanted), wrap(""), wrap(given))
    assert [r[0].error for r in out] == [None, "unpaired-sample-input", "unpaired-sample-output", "invalid-sample-pair", None, "invalid-sample-pair", "invalid-sample-pair", None, "invalid-sample-pair"]
    assert [r.text for r in out[0] if r.kind == "code_block"] == ["1\n2", "x\ny\n"]
    assert [r.attrs["level"] for r in out[0] if r.kind == "heading"] == ["3"]


def test_exactly_one_island(spark):
    assert [r[0].error for r in ir(spark, "<p>x</p>", page("a") + page("b"))] == ["missing-problem-statement", "ambiguous-problem-statement"]


def test_unsafe_urls_in_statements(spark):
    (rows,) = ir(spark, page('<p><a href="javascript:x()">a</a><a href="/b">b</a><img src="data:x" alt="q"><img src="i.png"></p>'))
    assert [r.attrs.get("href") for r in rows if r.kind == "link"] == [None, "https://example.org/b"]
    assert [(r.kind, r.attrs.get("src")) for r in rows if r.kind in ("image", "missing_asset")] == [("missing_asset", None), ("image", "https://example.org/contest/17/problem/i.png")]
    assert [d.code for d in rows[0].diagnostics] == ["unsupported-link-url", "unsupported-image-source"]


# editorials


def post(body):
    return f'<p>before</p><div class="ttypography">{body}</div><p>after</p>'


def test_editorial_whitespace_and_unknown_tags(spark):
    (html,) = html_of(spark, post("<p><b>a</b> <i>b</i> \n c</p> \n <center><p>d</p></center><pre>x  <b>y</b>\n</pre>"), mapper=editorial.editorial_nodes, kind="editorial")
    assert html == "<p><strong>a</strong> <em>b</em> c</p><p>d</p><pre><code>x  y\n</code></pre>"


def test_spoiler_titles(spark):
    (html,) = html_of(spark, post('<div class="spoiler"><b class="spoiler-title">Show <i>it</i></b><div class="spoiler-content"><p>inside</p></div></div>'), mapper=editorial.editorial_nodes, kind="editorial")
    assert html == '<details class="cf-spoiler"><summary>Show <em>it</em></summary><p>inside</p></details>'


def test_editorial_recoveries(spark):
    first, second, third = ir(spark, post("<p>a<script>x</script></p></section>"), post("a") + post("b"), post('<div class="problemTutorial"></div>'), mapper=editorial.editorial_nodes)
    assert [d.code for d in first[0].diagnostics] == ["dropped-dangerous-subtree"] and [r.text for r in first if r.text] == ["a"]
    assert [r.text for r in second if r.text] == ["a"]
    assert third[0].error == "missing-required-attribute: problemcode"


def test_editorial_rows_that_end_early(spark):
    """The parser closes one element for a start tag; the closing rules close the row, too, and the row's own end tag is then one too many."""
    (rows,) = ir(spark, post("<table><tr><td>a<tr><td>b</table><p>c</p>"), mapper=editorial.editorial_nodes)
    assert [(r.path, r.kind, r.text) for r in rows if r.kind in ("table_row", "table_cell", "text")] == [
        ([0, 0], "table_row", None), ([0, 0, 0], "table_cell", None), ([0, 0, 0, 0], "text", "a"), ([0, 1], "table_row", None), ([0, 1, 0], "table_cell", None), ([0, 1, 0, 0], "text", "b"), ([1, 0], "text", "c"),
    ]
    assert [d.code for d in rows[0].diagnostics] == ["unexpected-end-tag"]


def test_spoiler_titles_in_titles(spark):
    (rows,) = ir(spark, post('<div class="spoiler">x<div class="spoiler-title">a<b class="spoiler-title">b</b></div><i class="spoiler-title">c</i></div>'), mapper=editorial.editorial_nodes)
    assert [(r.path, r.text) for r in rows if r.kind == "text"] == [([0, -1, 0], "b"), ([0, -1, 1], "a"), ([0, -1, 2], "c"), ([0, 0], "x")]


def test_editorial_limit_of_recoveries():
    from kilnwork.operators.statement import MappingError

    html = post("<script></script>" * 3)
    assert len(editorial.blog(html, "", Limits(recoveries=3))[1]) == 3
    with pytest.raises(MappingError, match="max-recoveries-exceeded"):
        editorial.blog(html, "", Limits(recoveries=2))


FRAGMENT = '<h3><a href="https://example.org/contest/17/problem/{0}">17{0}</a></h3><div class="ttypography"><p>Solve {0}.</p></div>'


def composition(spark, body, fragments, missing=()):
    base = editorial.editorial_nodes(frame(spark, post(body)))
    parts = editorial.tutorial_nodes(spark.createDataFrame([(0, c, h) for c, h in fragments], "doc_id long, code string, html string"))
    absent = spark.createDataFrame([(0, c) for c in missing], "doc_id long, code string")
    out = render.rendered(editorial.composed(base, parts, absent), F.lit("editorial")).collect()
    assert len(out) == 1
    return out[0].error or out[0].html


def slot(code):
    return f'<div class="problemTutorial" problemcode="{code}"></div>'


def test_composition(spark):
    a, b = ("17A", FRAGMENT.format("A")), ("17B", FRAGMENT.format("B"))
    link = '<a href="/contest/17/problem/A">A</a>'
    whole = '<section data-problem-code="17A"><h3><a href="https://example.org/contest/17/problem/A" target="_blank" rel="noopener noreferrer">17A</a></h3><p>Solve A.</p></section>'
    assert composition(spark, f"<p>x</p>{slot('17A')}", [a]) == f"<p>x</p>{whole}"
    headed = composition(spark, f"<h2>{link}</h2><div>{slot('17A')}</div>", [a])
    assert headed.endswith('<section data-problem-code="17A"><p>Solve A.</p></section>')  # the heading is there already
    assert composition(spark, f"<h2>{link}</h2><h2>Other</h2>{slot('17A')}", [a]).endswith(whole)  # its rule has ended
    assert composition(spark, f"<p>x</p>{slot('17A')}{slot('17B')}", [a], ["17B"]) == f"<p>x</p>{whole}"
    assert composition(spark, slot("17A"), [a, b]) == "unexpected-tutorial-code:17B"
    assert composition(spark, slot("17A") * 2, [a]) == "duplicate-tutorial-slot:17A"
    assert composition(spark, slot("17A"), []) == "unresolved-tutorial-slot"


def test_composition_of_all_documents(spark, tmp_path):
    from kilnwork.plans.lifecycle import t8_compose_all

    spark.range(12).withColumnRenamed("id", "doc_id").write.parquet(f"{tmp_path}/documents.parquet")
    items = [0, 1, 2, 3, 40]
    spark.createDataFrame([(i, f"text {i}") for i in items], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = {}
    for i in range(12):
        filled = i in items and i % 2 == 0
        want[i] = (None if filled or i % 3 == 0 else "unresolved-tutorial-slot", filled)
    rows = t8_compose_all(spark, str(tmp_path)).collect()
    assert len(rows) == 12 and {r.doc_id: (r.error, r.has_section) for r in rows} == want


@pytest.mark.parametrize(
    ("html", "error"),
    [("<p>x</p>", "missing-tutorial-heading"), ("<h3>t</h3>", "missing-tutorial-body"), ('<h3>t</h3><div class="ttypography">x</div>', "missing-problem-heading-link"), ('<h3><a href="/x">t</a></h3><div class="ttypography">x</div>', "invalid-problem-heading-link"), (FRAGMENT.format("B"), "problem-code-mismatch:17B:17A")],
)
def test_fragment_errors(html, error):
    with pytest.raises(ValueError, match=error):
        editorial.tutorial_section(html, "17A", "https://example.org", Limits())


# rendering


def test_render_is_the_same_at_any_partitioning(spark):
    nodes = statement.statement_nodes(frame(spark, *[page(f"<p>{k} <b>x</b></p><ol><li>a<li>b</ol>") for k in range(12)]))
    one = {tuple(r) for r in render.rendered(nodes.coalesce(1), F.lit("statement")).collect()}
    many = {tuple(r) for r in render.rendered(nodes.repartition(7, "path"), F.lit("statement")).collect()}
    assert one == many and len(one) == 12


def test_violations(spark):
    rows = [([], "document", {}), ([0], "heading", {"level": "9"}), ([1], "wrong", {}), ([2], "image", {"src": "https://x.org/a.png"}), ([3], "attachment", {"mediaType": "text/html"}), ([4], "tutorial_slot", {"problemCode": "1A"})]
    nodes = spark.createDataFrame([(1, p, k, a, None) for p, k, a in rows], "doc_id long, path array<int>, kind string, attrs map<string,string>, text string")
    got = {(r.code, r.path) for r in render.violations(nodes, F.lit("statement")).collect()}
    assert got == {("invalid-heading-level", "document/0"), ("unknown-node-kind", "document/1"), ("remote-image-in-ready-document", "document/2"), ("invalid-attachment-media-type", "document/3"), ("unresolved-tutorial-slot", "document/4")}
    assert render.violations(nodes, F.lit("editorial"), ready=False).filter("code = 'invalid-attachment-content-kind'").count() == 1


# JSON


def test_json_round_trip(spark):
    import json

    from kilnwork.operators import encode

    pages = [post('<h2>T "q" é</h2><ol><li>a<li>b</ol><div class="spoiler"><b class="spoiler-title">Show <i>it</i></b><div class="spoiler-content"><p>x</p></div></div><table><tr><th>h<td>d</table><hr><div class="spoiler"></div><pre>a\n\tb</pre>'), post("")]
    nodes = editorial.editorial_nodes(frame(spark, *pages)).cache()
    trees = encode.tree_json(nodes).cache()
    texts = {r.doc_id: r.json for r in trees.collect()}
    for t in texts.values():
        value = json.loads(t)
        assert json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":")) == t
    first = json.loads(texts[0])
    assert first["children"][0] == {"attrs": {"level": 2}, "children": [{"kind": "text", "text": 'T "q" é'}], "kind": "heading"}
    assert first["children"][2]["attrs"]["title"][1]["kind"] == "emphasis" and first["children"][1]["attrs"] == {"ordered": True}
    assert texts[1] == '{"kind":"document"}'
    key = lambda r: (r.doc_id, tuple(r.path), r.kind, tuple(sorted(r.attrs.items())), r.text)
    assert sorted(map(key, encode.decoded(trees).collect())) == sorted(map(key, nodes.collect()))
    bad = spark.createDataFrame([(1, '{"kind": "document"}'), (2, '{"kind":"a","kind":"b"}'), (3, "{")], "doc_id long, json string")
    assert {r.error for r in encode.decoded(bad).collect()} == {"invalid-canonical-json"}
    envelope = spark.createDataFrame([(1, "17A", "17", "A", URL, "html", None, ["x.png"])], "doc_id long, problem_code string, contest_id string, index string, source_url string, source_kind string, diagnostics array<struct<severity:string,code:string,message:string,path:string>>, assets array<string>")
    text = encode.statement_json(trees, envelope).first().json
    assert json.dumps(json.loads(text), ensure_ascii=False, sort_keys=True, separators=(",", ":")) == text and json.loads(text)["schema"] == 2
