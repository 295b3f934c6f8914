"""Registered queries of the scalar functions, the tree operators and the renderer, over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilnwork.functions import binary, text, urls
from kilnwork.operators import render, statement, tree
from kilnwork.plans.relational import read


def f1_whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", F.md5(text.collapsed(F.col("html")).cast("binary")).alias("collapsed_md5"))


def f3_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(text.math_normal(F.col("text")).cast("binary")).alias("math_md5"))


def f4_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", F.md5(text.escaped(F.col("html")).cast("binary")).alias("escaped_md5"))


_CODE = {
    1: "#include <cstdio>\nint main() { printf(\"%d\", 1); }", 2: "#include <bits/stdc++.h>\nusing namespace std;", 3: "fn main() { let mut x = 1; println!(\"{}\", x); }", 4: "fun main() { }", 5: "package main\nfunc main() {}",
    6: "using System;\nclass P { static void Main() {} }", 7: "import java.util.*;\nclass A { }", 8: "def f(x):\n    return x", 9: "for i in range(3): print(i)\nimport sys", 10: "const f = (x) => x;", 11: "plain words", 12: "   ", 13: "operation Solve (q : Qubit) : Unit {",
}


def f5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literal snippets, and the documents, which hold no code."""
    snippets = spark.createDataFrame([(-k, v) for k, v in _CODE.items()], "doc_id long, text string")
    rows = snippets.unionByName(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", text.code_language(F.col("text")).alias("language"))


def f7_link_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", urls.link(F.col("url")).alias("link"), urls.link(F.substring_index("url", ":", -1)).alias("rest"))


def f14_url_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page URLs read as sources: host and path shape."""
    url = F.concat(F.lit("https://example.org/contest/"), F.col("page_id").cast("string"), F.when(F.col("page_id") % 3 == 0, "/problem/A1").when(F.col("page_id") % 3 == 1, "/problem/B?x=1").otherwise("/other"))
    found = urls.source_identity(url, ("example.org",))
    return read(spark, sf_dir, "pages").select("page_id", found["contest_id"].alias("contest_id"), found["index"].alias("index"))


def f15_code_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.concat(F.col("p_partkey").cast("string"), F.regexp_replace("p_brand", "[^A-Za-z0-9]", ""))
    parts = urls.problem_code_parts(code)
    return read(spark, sf_dir, "part").select("p_partkey", parts["contest_id"].alias("contest_id"), parts["index"].alias("index"))


def f18_asset_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' digests with extensions as asset names of statements."""
    ext = F.element_at(F.array(*map(F.lit, ("png", "pdf", "exe", "jpeg"))), (F.col("doc_id") % 4 + 1).cast("int"))
    d = read(spark, sf_dir, "documents").select("doc_id", F.concat(binary.digest(F.col("text").cast("binary")), F.lit("."), ext).alias("name"))
    route = F.concat(F.lit("/statement-assets/"), F.col("name"))
    kind = F.lit("statement")
    return d.select("doc_id", urls.asset_digest(F.col("name")).alias("digest"), urls.image(route, kind).alias("image"), urls.attachment(route).alias("attachment"))


def f21_magic_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.element_at(F.array(*[F.lit(x) for x in ("89504E470D0A1A0A", "FFD8FF00", "474946383961", "52494646000000005745425000", "255044462D", "00")]), (F.col("doc_id") % 6 + 1).cast("int"))
    payload = F.concat(F.unhex(head), F.col("text").cast("binary"))
    return read(spark, sf_dir, "documents").select("doc_id", binary.extension(payload).alias("extension"))


def f24_media_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.concat(F.lit(" Image/"), F.col("o_orderpriority"), F.lit(" ; q=1;x"))
    return read(spark, sf_dir, "orders").select("o_orderkey", text.media_type(value).alias("media_type"))


def f25_canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event properties in canonical form, and with a repeated key, which is none."""
    e = read(spark, sf_dir, "events")
    return e.select("event_id", text.canonical_json(F.col("props")).alias("canonical"), text.canonical_json(F.concat(F.lit('{"a":1,"a":'), F.col("event_id").cast("string"), F.lit("}"))).alias("repeated"))


def f27_tag_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", F.md5(text.without_tags(F.col("html")).cast("binary")).alias("plain_md5"))


def q1_valid_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    return part.select("p_partkey", text.valid_reference(F.col("p_partkey").cast("string"), F.substring("p_brand", 1, F.col("p_size") % 5)).alias("valid"), text.safe_component(F.col("p_name")).alias("safe"), text.valid_problem_code(F.concat(F.col("p_partkey").cast("string"), F.lit("A"))).alias("code"))


def q5_page_recognised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, and literal error pages: an error is told in the title or first heading, of something that does not exist."""
    errors = spark.createDataFrame([(-1, "<title>404 Not Found</title><p>x"), (-2, "<h1>The contest does not exist</h1>"), (-3, "<p>not found</p>"), (-4, "")], "page_id long, html string")
    rows = read(spark, sf_dir, "pages").select("page_id", "html").unionByName(errors)
    heads = F.lower(F.concat_ws(" ", F.regexp_extract_all("html", F.lit(r"(?is)<(title|h1)[^>]*>(.*?)</\1>"), 2)))
    bad = heads.rlike("not found|access denied") | (F.contains(heads, F.lit("does not exist")) & heads.rlike("contest|problem|page"))
    return rows.select("page_id", ((F.length("html") > 0) & ~bad).alias("recognised"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "url", "html")


def t1_source_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the pages by tag."""
    return tree.source_nodes(_pages(spark, sf_dir)).filter("tag <> '#document' AND tag <> '#text'").groupBy("tag").agg(F.count("*").alias("n"))


def t3_first_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.first_with_class(tree.source_nodes(_pages(spark, sf_dir)), "ad").select("doc_id", "tag", F.array_join(F.transform("path", lambda x: x.cast("string")), "/").alias("path"))


def t4_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.islands(tree.source_nodes(_pages(spark, sf_dir)), "ad").select("doc_id", F.array_join(F.transform("path", lambda x: x.cast("string")), "/").alias("path"), "error")


def a12_tree_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.totals(tree.source_nodes(_pages(spark, sf_dir)))


def _statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages with their articles as statements."""
    html = F.replace(F.col("html"), F.lit("<article"), F.lit('<article class="problem-statement"'))
    return statement.statement_nodes(_pages(spark, sf_dir).withColumn("html", html))


def t5_statement_ir(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _statements(spark, sf_dir).groupBy("kind", "error").agg(F.count("*").alias("n"))


def t11_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.violations(_statements(spark, sf_dir), F.lit("statement"))


def t13_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.rendered(_statements(spark, sf_dir), F.lit("statement")).select("doc_id", F.md5(F.col("html").cast("binary")).alias("html_md5"), "error")


_ESC = "replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#x27;')"
SQL = {
    "f1_whitespace": r"SELECT page_id, md5(regexp_replace(html, '[\t\n\f\r ]+', ' ', 'g')) AS collapsed_md5 FROM pages",
    "f3_math": r"""WITH p AS (SELECT doc_id, string_split(text, '$$$') AS p FROM documents)
        SELECT doc_id, md5(array_to_string([CASE WHEN k = 1 THEN '' WHEN k <= len(p) - (len(p) - 1) % 2 THEN '$' ELSE '$$$' END || CASE WHEN k % 2 = 0 AND k < len(p) + 1 - (len(p) - 1) % 2 AND k < len(p) THEN replace(p[k], '\lt', '<') ELSE p[k] END FOR k IN range(1, len(p) + 1)], '')) AS math_md5 FROM p""",
    "f4_escape": f"SELECT page_id, md5({_ESC}) AS escaped_md5 FROM pages",
    "f5_language": "SELECT * FROM (VALUES (-1, 'c'), (-2, 'cpp'), (-3, 'rust'), (-4, 'kotlin'), (-5, 'go'), (-6, 'csharp'), (-7, 'java'), (-8, 'python'), (-9, 'python'), (-10, 'javascript'), (-11, NULL), (-12, NULL), (-13, 'qsharp')) t(doc_id, language) UNION ALL SELECT doc_id, NULL FROM documents",
    "f7_link_sanitize": r"""SELECT page_id, CASE WHEN regexp_matches(url, '^(?i)https?://[^/?#:@]+(:[0-9]+)?([/?#]|$)') AND NOT regexp_matches(url, '[\s\\]') THEN url END AS link, NULL::VARCHAR AS rest FROM pages""",
    "f14_url_identity": "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN page_id::VARCHAR END AS contest_id, CASE WHEN page_id % 3 = 0 THEN 'A1' END AS index FROM pages",
    "f15_code_split": "SELECT p_partkey, regexp_extract(p_partkey::VARCHAR || regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g'), '^([0-9]+)([A-Za-z][A-Za-z0-9]*)$', 1) AS contest_id, regexp_extract(p_partkey::VARCHAR || regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g'), '^([0-9]+)([A-Za-z][A-Za-z0-9]*)$', 2) AS index FROM part",
    "f18_asset_names": """SELECT doc_id, CASE WHEN doc_id % 4 <> 2 THEN sha256(text) END AS digest, CASE WHEN doc_id % 4 = 0 THEN '/statement-assets/' || sha256(text) || '.png' WHEN doc_id % 4 = 3 THEN '/statement-assets/' || sha256(text) || '.jpeg' END AS image,
        CASE WHEN doc_id % 4 = 1 THEN '/statement-assets/' || sha256(text) || '.pdf' END AS attachment FROM documents""",
    "f21_magic_sniff": "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'png' WHEN 1 THEN 'jpg' WHEN 2 THEN 'gif' WHEN 3 THEN 'webp' WHEN 4 THEN 'pdf' END AS extension FROM documents",
    "f24_media_type": "SELECT o_orderkey, lower(trim(split_part(' Image/' || o_orderpriority || ' ; q=1;x', ';', 1))) AS media_type FROM orders",
    "f25_canonical_json": "SELECT event_id, replace(props, ' ', '') AS canonical, NULL::VARCHAR AS repeated FROM events",
    "f27_tag_strip": "SELECT page_id, md5(regexp_replace(html, '<[^>]+>', ' ', 'g')) AS plain_md5 FROM pages",
    "q1_valid_reference": r"""SELECT p_partkey, regexp_matches(p_partkey::VARCHAR, '^[0-9]{1,6}$') AND regexp_matches(substring(p_brand, 1, p_size % 5), '^[A-Za-z0-9]{1,3}$') AS valid,
        regexp_matches(p_name, '^[A-Za-z0-9._-]+$') AND p_name NOT IN ('.', '..') AS safe, length(p_partkey::VARCHAR) <= 8 AS code FROM part""",
    "q5_page_recognised": "SELECT page_id, true AS recognised FROM pages UNION ALL VALUES (-1, false), (-2, false), (-3, true), (-4, false)",
}
_PLAIN = ("t1_source_nodes", "t3_first_by_class", "t4_islands", "a12_tree_totals", "t5_statement_ir", "t11_violations", "t13_render")
QUERIES = {name: globals()[name] for name in (*SQL, *_PLAIN)}
