"""Registered queries of links, identities, contest states, envelopes and reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilnwork.functions import urls
from kilnwork.operators import contest, editorial
from kilnwork.plans.relational import read

_ORIGIN = "https://example.org"
_LINKS = {
    1: '<a href="/blog/entry/12?x=1" title="Round Editorial">e</a>',
    2: '<a href="https://example.org/blog/entry/7" title="News">Announcement, tutorial</a><a href="/blog/entry/8"><b>Tutorial</b></a>',
    3: "<p>editorial</p>",
    4: '<a href="/blog/entry/1" title="x">Editorial</a>\n<A HREF="/blog/entry/2" title="TUTORIAL (en)">y</A>',
    5: '<a href="https://other.org/blog/entry/5" title="Editorial">e</a>',
    6: None,
}


def f13_editorial_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The editorial that literal contest pages link to."""
    pages = spark.createDataFrame(list(_LINKS.items()), "doc_id long, html string")
    return pages.select("doc_id", contest.editorial_link(F.col("html"), _ORIGIN).alias("url"))


def s12_bootstrap_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(1, "17", ["171A", "17", "17/B", "17C"]), (2, "17", ["18A"]), (3, "17", ["17A"]), (4, "17", []), (5, "17", ["17/1"])]
    return spark.createDataFrame(rows, "n long, contest string, codes array<string>").select("n", contest.bootstrap_index(F.col("contest"), F.col("codes")).alias("index"))


def q7_f29_page_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages, those of even ids with a form's token."""
    page = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("<meta data-csrf = '"), F.md5(F.col("text").cast("binary")), F.lit("'>"))).otherwise(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", contest.form_token(page).alias("token"), contest.marked(F.col("text"), ("the ", "der ")).alias("marked"))


def j10_identified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' ids as requested codes, benchmark items as what is known."""
    code = lambda c: F.concat(F.col(c).cast("string"), F.lit("A"))
    known = read(spark, sf_dir, "benchmark").select(code("item_id").alias("problem_code"), F.col("item_id").cast("string").alias("contest_id"), F.lit("A").alias("index"))
    return contest.identified(read(spark, sf_dir, "documents").select(code("doc_id").alias("problem_code")), known)


def j11_identity_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    given = F.when(n % 2 == 0, "17A").when(n % 3 == 0, "17B")
    source = urls.source_identity(F.when(n % 5 == 0, "https://example.org/contest/17/problem/B").otherwise("https://example.org/problemset/problem/17/A"), ("example.org",))
    return read(spark, sf_dir, "documents").select("doc_id", contest.identity_mismatch(F.lit("17A"), given, source).alias("error"))


def x7_contest_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as contests: every seventh cannot be fetched, every second has a link, of the others the second look lacks, finds a link or has the first one's time."""
    n, k = F.col("doc_id"), F.col("attempt")
    linked = F.when(k == 1, n % 2 == 0).otherwise(n % 3 == 0)
    rows = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("attempt")).filter((k == 1) | (n % 5 != 0))
    pages = rows.select(
        n.alias("content_id"), "attempt", ((n % 7 != 0) | (k == 2)).alias("ok"), F.when(linked, _LINKS[1]).otherwise("<p>x</p>").alias("body"), F.lit(200).alias("status_code"),
        F.lit(False).alias("blocked"), F.lit(True).alias("recognized"), F.when((k == 2) & (n % 11 != 0), "2024-01-01T00:00:02Z").otherwise("2024-01-01T00:00:01Z").alias("fetched_at"), F.lit(None).cast("string").alias("error"),
    )
    out = contest.contest_states(pages, _ORIGIN)
    return out.select(
        "content_id", "source_url", "status", F.get_json_object("evidence", "$.errors[0]").alias("error"), F.get_json_object("evidence", "$.successfulCheckTimestamps[1]").alias("checked"),
        F.when(F.col("status") == "transient_failure", F.size(F.from_json(F.get_json_object("evidence", "$.receipts"), "array<string>"))).alias("receipts"),
    )


def v6_envelope_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An envelope for each document, in which some rules are broken."""
    n = F.col("doc_id")
    either = lambda every, bad, good: F.when(n % every == 0, bad).otherwise(good)
    text = F.concat(
        F.lit('{"schema":'), either(5, "1", "2"), F.lit(',"problemCode":"1A","contestId":"1","index":"'), either(4, "B", "A"), F.lit('","sourceKind":"'), either(7, "doc", "html"),
        F.lit('","root":{"kind":"'), either(11, "paragraph", "document"), F.lit('"},"diagnostics":'), either(17, "{}", "[]"), F.lit(',"assets":'), either(13, "[1]", '["a"]'), F.lit("}"),
    )
    kind = F.when(n % 3 == 0, "statement").when(n % 3 == 1, "editorial").otherwise("comment")
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(contest.envelope_errors(kind, F.when(n % 19 != 0, text).otherwise("[]")), ",").alias("errors"))


def p4_ready_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    html = F.concat(F.lit('<p class="x">'), n.cast("string"), F.lit("</p>"))
    payload = contest.ready_payload(F.when(n % 2 == 0, "statement").otherwise("editorial"), html, F.lit("https://example.org/b"), F.when(n % 2 == 0, "html"))
    return read(spark, sf_dir, "documents").select("doc_id", payload.alias("payload"))


def a7_recorded_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as final reports of their type."""
    e = F.col("event_id")
    reports = read(spark, sf_dir, "events").select(F.col("event_type").alias("content_kind"), e.alias("seq"), (e % 100).alias("ready_count"), (F.col("user_id") % 3).alias("failed_count"), (e % 2 == 0).alias("completed"))
    out = contest.recorded(reports)
    return out.select("content_kind", "state", F.col("cached").cast("long").alias("cached"), F.col("failed").cast("long").alias("failed"))


def x13_validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a report says of literal editorial pages: a good one, one with an open slot, one whose slot names no problem."""
    post = lambda body: f'<div class="ttypography">{body}</div>'
    pages = [(1, post("<p>a</p>")), (2, post('<div class="problemTutorial" problemcode="1A"></div>')), (3, post('<div class="problemTutorial"></div>'))]
    nodes = editorial.editorial_nodes(spark.createDataFrame([(k, _ORIGIN + "/b", v) for k, v in pages], "doc_id long, url string, html string"))
    out = contest.report(nodes)
    return out.select("doc_id", "ok", F.array_join("problem_codes", ",").alias("problem_codes"), F.array_join("unresolved", ",").alias("unresolved"), F.array_join("errors", ",").alias("errors"), F.col("sha256").isNotNull().alias("has_digest"))


SQL = {
    "f13_editorial_links": """SELECT doc_id::BIGINT AS doc_id, 'https://example.org/blog/entry/' || n AS url FROM (VALUES (1, '12'), (2, '8'), (3, NULL), (4, '2'), (5, NULL), (6, NULL)) t(doc_id, n)""",
    "s12_bootstrap_index": """SELECT n::BIGINT AS n, i AS index FROM (VALUES (1, 'B'), (2, NULL), (3, 'A'), (4, NULL), (5, '1')) t(n, i)""",
    "q7_f29_page_marks": "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN md5(text) END AS token, contains(text, 'the ') OR contains(text, 'der ') AS marked FROM documents",
    "j10_identified": """SELECT doc_id::VARCHAR || 'A' AS problem_code, item_id::VARCHAR AS contest_id, CASE WHEN item_id IS NOT NULL THEN 'A' END AS index, CASE WHEN item_id IS NULL THEN 'known_absent' END AS status,
        CASE WHEN item_id IS NULL THEN '{"problemCode":"' || doc_id::VARCHAR || 'A","recognized":false}' END AS evidence FROM documents LEFT JOIN (SELECT DISTINCT item_id FROM benchmark) ON item_id = doc_id""",
    "j11_identity_mismatch": "SELECT doc_id, CASE WHEN doc_id % 2 <> 0 THEN 'problem-identity-mismatch' WHEN doc_id % 5 = 0 THEN 'source-identity-mismatch' END AS error FROM documents",
    "x7_contest_states": """SELECT doc_id AS content_id, CASE WHEN error IS NULL AND doc_id % 2 = 0 THEN 'https://example.org/blog/entry/12' END AS source_url,
        CASE WHEN error IS NOT NULL THEN 'transient_failure' WHEN doc_id % 2 <> 0 THEN 'known_absent' END AS status, error, CASE WHEN error IS NULL AND doc_id % 2 <> 0 THEN '2024-01-01T00:00:02Z' END AS checked,
        CASE WHEN error IS NOT NULL THEN CASE WHEN doc_id % 7 = 0 OR doc_id % 5 = 0 THEN 1 ELSE 2 END END::INT AS receipts
        FROM (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'contest-page-fetch-failed' WHEN doc_id % 2 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN 'absence-recheck-failed'
            WHEN doc_id % 3 = 0 OR doc_id % 11 = 0 THEN 'absence-check-mismatch' END AS error FROM documents)""",
    "v6_envelope_errors": """SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN 'unsupported-content-kind' WHEN doc_id % 19 = 0 THEN 'invalid-document' ELSE concat_ws(',', CASE WHEN doc_id % 5 = 0 THEN 'unsupported-schema' END,
        CASE WHEN doc_id % 3 = 0 AND doc_id % 4 = 0 THEN 'invalid-problem-identity' END, CASE WHEN doc_id % 3 = 0 AND doc_id % 7 = 0 THEN 'invalid-statement-source-kind' END,
        CASE WHEN doc_id % 11 = 0 THEN 'invalid-document-root' END, CASE WHEN doc_id % 17 = 0 THEN 'invalid-diagnostics' END, CASE WHEN doc_id % 13 = 0 THEN 'invalid-assets' END) END AS errors FROM documents""",
    "p4_ready_payload": r"""SELECT doc_id, '{"contentKind":"' || CASE WHEN doc_id % 2 = 0 THEN 'statement' ELSE 'editorial' END || '","format":"html","html":"<p class=\"x\">' || doc_id::VARCHAR || '</p>","known":true,"schema":2,'
        || CASE WHEN doc_id % 2 = 0 THEN '"sourceKind":"html",' ELSE '' END || '"status":"ready","url":"https://example.org/b"}' AS payload FROM documents""",
    "a7_recorded_reports": """WITH r AS (SELECT event_type AS content_kind, CASE WHEN max(event_id) % 2 = 0 THEN 'complete' ELSE 'partial' END AS state, (max(event_id) % 100)::BIGINT AS cached, (arg_max(user_id, event_id) % 3)::BIGINT AS failed
        FROM events GROUP BY event_type) SELECT * FROM r UNION ALL SELECT NULL, NULL, coalesce(sum(cached), 0)::BIGINT, coalesce(sum(failed), 0)::BIGINT FROM r""",
    "x13_validation_report": """SELECT * REPLACE (doc_id::BIGINT AS doc_id) FROM (VALUES (1, true, '', '', '', true), (2, false, '', '1A', 'unresolved-tutorial-slot,unresolved-tutorial-slots', true),
        (3, false, '', '', 'missing-required-attribute: problemcode', false)) t(doc_id, ok, problem_codes, unresolved, errors, has_digest)""",
}
QUERIES = {name: globals()[name] for name in SQL}
