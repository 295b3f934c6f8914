"""Registered queries of receipts, states, assets and composition, over the supplied tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilnwork.functions import binary
from kilnwork.operators import assets, editorial, encode, receipts, render, statement, status
from kilnwork.plans.relational import _FOLD, read, x1_retry_selection, x2_item_status_fold


def q4_receipt_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as receipts."""
    e = read(spark, sf_dir, "events")
    kind, n = F.col("event_type"), F.col("event_id")
    r = F.struct(
        (kind != "error").alias("ok"), F.when(kind == "signup", " ").otherwise("body").alias("body"), F.when(n % 3 == 0, F.lit(None)).when(n % 3 == 1, 200).otherwise(404).cast("int").alias("status_code"),
        (n % 5 == 0).alias("blocked"), F.lit(True).alias("recognized"), F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(n % 7 == 0, "").otherwise("Z")).alias("fetched_at"),
    )
    return e.select("event_id", receipts.receipt_valid(r).alias("valid"))


def x6_fragment_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    payload = F.when(n % 5 == 0, '{"success":true,"html":"<p>x</p>"}').when(n % 5 == 1, '{"success":"false"}').when(n % 5 == 2, '{"success":"true","html":""}').when(n % 5 == 3, "not json")
    r = receipts.fragment_response(n.cast("string"), payload)
    return read(spark, sf_dir, "events").select("event_id", r["outcome"].alias("outcome"), r["error"].alias("error"))


def x9_failure_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("o_orderkey") % 2 == 0, "editorial").otherwise("statement")
    code = F.when(F.col("o_orderstatus") == "O", "asset-fetch-failed").otherwise("invalid-raster-magic")
    return read(spark, sf_dir, "orders").select("o_orderkey", receipts.asset_failure_status(kind, code).alias("status"))


def p5_p6_payload_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = receipts.payload_status(F.col("status"), F.lit('{"errors":"e"}'))
    return x2_item_status_fold(spark, sf_dir).select("content_id", p["html_allowed"].alias("html_allowed"), p["error"].alias("error"), receipts.http_code(F.col("status")).alias("code"))


def k8_asset_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' texts as pictures: accepted, and each payload stored once."""
    d = read(spark, sf_dir, "documents")
    payload = F.concat(F.lit(b"GIF89a"), F.col("text").cast("binary"))
    fetched = d.select(F.col("doc_id").cast("string").alias("url"), F.lit("image").alias("kind"), F.lit(None).cast("string").alias("declared_type"), payload.alias("payload"), F.when(F.col("doc_id") % 4 == 0, "text/html").otherwise("image/gif").alias("media_type"))
    return assets.store(assets.accepted(fetched)).select("name", F.octet_length("payload").alias("bytes"))


def q10_asset_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    payload = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(b"%PDF-"), F.col("text").cast("binary"))).when(F.col("doc_id") % 3 == 1, F.lit(b"")).otherwise(F.lit(b"GIF87a"))
    kind = F.when(F.col("doc_id") % 2 == 0, "attachment").otherwise("image")
    error = binary.acceptance_error(kind, F.lit("application/pdf"), payload, F.lit("application/pdf"))
    return d.select("doc_id", error.alias("error"))


def t8_compose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose id is that of a benchmark item, with one slot each; items of an even id are its fragments, ids that three divides are known to be missing. t8_compose_all has all documents."""
    docs = read(spark, sf_dir, "documents").select("doc_id").join(read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text"), "doc_id")
    return _composed(docs, docs.filter("doc_id % 2 = 0"))


def t8_compose_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """t8_compose over all documents: those without a fragment, an item of an even id, that are not known to be missing have an unresolved slot."""
    docs = read(spark, sf_dir, "documents").select("doc_id")
    items = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    return _composed(docs, items.filter("doc_id % 2 = 0").join(docs, "doc_id", "left_semi"))


def _composed(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, error, has_section) of docs with one slot each, of which `items` (doc_id, text) fill some."""
    code = F.concat(F.col("doc_id").cast("string"), F.lit("A"))
    said = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    base = editorial.editorial_nodes(docs.select("doc_id", F.lit("https://example.org/b").alias("url"), said('<div class="ttypography"><div class="problemTutorial" problemcode="', code, '"></div></div>').alias("html")))
    head = said('<h3><a href="/contest/', F.col("doc_id").cast("string"), '/problem/A">x</a></h3><div class="ttypography"><p>', F.col("text"), "</p></div>")
    parts = editorial.tutorial_nodes(items.select("doc_id", code.alias("code"), head.alias("html")))
    out = render.rendered(editorial.composed(base, parts, docs.filter("doc_id % 3 = 0").select("doc_id", code.alias("code"))), F.lit("editorial"))
    return out.select("doc_id", "error", F.coalesce(F.contains("html", F.lit("data-problem-code")), F.lit(False)).alias("has_section"))


def x12_rebuild_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending users in the order of a run, clicked ones first, with customers' names as labels."""
    e = read(spark, sf_dir, "events")
    ranks = status.queue_ranks(e.filter("event_type = 'click'").select(F.col("event_id").alias("seq"), F.lit(0).alias("pos"), F.col("user_id").alias("content_id")))
    names = read(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return status.preview(x1_retry_selection(spark, sf_dir), ranks, names)


def a9_pending_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = x1_retry_selection(spark, sf_dir).select(F.when(F.col("content_id") % 2 == 0, "statement").otherwise("editorial").alias("content_kind"))
    return rows.groupBy("content_kind").agg(F.count("*").alias("n"))


def p11_document_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' articles as canonical JSON."""
    pages = read(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "url", F.replace(F.col("html"), F.lit("<article"), F.lit('<article class="problem-statement"')).alias("html"))
    return encode.tree_json(statement.statement_nodes(pages)).select("doc_id", F.md5(F.col("json").cast("binary")).alias("json_md5"), F.length("json").alias("chars"))


SQL = {
    "x12_rebuild_preview": f"""WITH {_FOLD}, p AS (SELECT content_id FROM fo WHERE content_id IN (1, 2, 3) OR coalesce(marker IN ('transient_failure', 'invalid_structure'), false) OR (NOT visible AND coalesce(marker <> 'known_absent', true))),
        r AS (SELECT user_id, max(event_id) AS c FROM events WHERE event_type = 'click' GROUP BY user_id)
        SELECT content_id AS id, CASE WHEN length(c_name) > 0 THEN content_id::VARCHAR || ' — ' || c_name ELSE content_id::VARCHAR END AS label, row_number() OVER (ORDER BY c DESC NULLS LAST, content_id)::INT AS place
        FROM p LEFT JOIN r ON user_id = content_id LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) ON c_custkey = content_id""",
    "a9_pending_by_kind": f"""WITH {_FOLD} SELECT CASE WHEN content_id % 2 = 0 THEN 'statement' ELSE 'editorial' END AS content_kind, count(*) AS n FROM fo
        WHERE content_id IN (1, 2, 3) OR coalesce(marker IN ('transient_failure', 'invalid_structure'), false) OR (NOT visible AND coalesce(marker <> 'known_absent', true)) GROUP BY 1""",
    "q4_receipt_valid": "SELECT event_id, event_type NOT IN ('error', 'signup') AND event_id % 3 <> 2 AND event_id % 5 <> 0 AND event_id % 7 <> 0 AS valid FROM events",
    "x6_fragment_responses": """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'html' WHEN 1 THEN 'missing' ELSE 'transient' END AS outcome,
        CASE event_id % 5 WHEN 2 THEN event_id::VARCHAR || ':missing-tutorial-html' WHEN 3 THEN event_id::VARCHAR || ':invalid-tutorial-response' WHEN 4 THEN event_id::VARCHAR || ':tutorial-request-failed' END AS error FROM events""",
    "x9_failure_status": "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 OR o_orderstatus = 'O' THEN 'transient_failure' ELSE 'invalid_structure' END AS status FROM orders",
    "p5_p6_payload_states": f"""WITH {_FOLD} SELECT content_id, status = 'ready' AS html_allowed, CASE WHEN status IN ('transient_failure', 'invalid_structure') THEN 'e' END AS error,
        CASE status WHEN 'pending' THEN 202 WHEN 'transient_failure' THEN 503 WHEN 'invalid_structure' THEN 500 ELSE 200 END AS code FROM st""",
    "k8_asset_store": "SELECT sha256(encode('GIF89a' || text)) || '.gif' AS name, max(6 + strlen(text))::INT AS bytes FROM documents WHERE doc_id % 4 <> 0 GROUP BY 1",
    "q10_asset_errors": """SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN 'empty-asset-payload' WHEN doc_id % 2 = 0 THEN CASE WHEN doc_id % 3 = 2 THEN 'invalid-pdf-magic' END WHEN doc_id % 3 = 0 THEN 'invalid-raster-magic' ELSE 'invalid-raster-media-type' END AS error FROM documents""",
    "t8_compose": "SELECT doc_id, CASE WHEN doc_id % 2 <> 0 AND doc_id % 3 <> 0 THEN 'unresolved-tutorial-slot' END AS error, doc_id % 2 = 0 AS has_section FROM documents JOIN benchmark ON item_id = doc_id",
}
QUERIES = {name: globals()[name] for name in (*SQL, "t8_compose_all", "p11_document_json")}
