"""Building items as staged DataFrames: what a fetched page becomes, with errors as rows and the state that each leads to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilnwork.functions.text import safe_component
from kilnwork.operators import render, statement

RESULT = ["content_kind", "content_id", "status", "evidence"]


def evidence(error: Column) -> Column:
    """The evidence that goes with a state, as canonical JSON."""
    return F.to_json(F.try_parse_json(F.to_json(F.struct(error.alias("error")))))


def pdf_nodes(pdfs: DataFrame) -> DataFrame:
    """The tree of a PDF statement (doc_id, title, url): a heading and an attachment."""
    row = lambda path, kind, attrs, text: F.struct(F.array(*[F.lit(p) for p in path]).cast("array<int>").alias("path"), F.lit(kind).alias("kind"), attrs.cast("map<string,string>").alias("attrs"), text.alias("text"))
    none, blank = F.lit(None).cast("string"), F.create_map()
    tree = F.array(
        row([], "document", blank, none), row([0], "heading", F.create_map(F.lit("role"), F.lit("title"), F.lit("level"), F.lit("1")), none), row([0, 0], "text", blank, F.col("title")),
        row([1], "attachment", F.create_map(F.lit("href"), F.col("url"), F.lit("mediaType"), F.lit("application/pdf"), F.lit("label"), F.lit("Open PDF")), none),
    )
    out = pdfs.select("doc_id", F.explode(tree).alias("_n")).select("doc_id", "_n.*")
    return out.select("doc_id", "path", "kind", "attrs", "text", none.alias("error"), F.lit(None).cast("array<struct<severity:string,code:string,message:string,path:string>>").alias("diagnostics"))


def fetch_error(source_kind: Column, payload: Column, content_type: Column) -> Column:
    """Why a fetched statement page cannot be read, null if it can: HTML must be UTF-8 and not empty, a PDF begin as one and be told as one."""
    return (
        F.when(~source_kind.isin("html", "pdf"), "unsupported-statement-source-kind")
        .when((source_kind == "html") & (F.coalesce(F.octet_length(payload), F.lit(0)) == 0), "invalid-html-source").when((source_kind == "html") & F.coalesce(~F.is_valid_utf8(payload.cast("string")), F.lit(True)), "invalid-html-source")
        .when((source_kind == "pdf") & ~F.coalesce(F.substring(payload, 1, 5) == F.lit(b"%PDF-"), F.lit(False)), "invalid-pdf-body").when((source_kind == "pdf") & ~F.coalesce(F.lower(F.trim(F.substring_index(content_type, ";", 1))) == "application/pdf", F.lit(False)), "invalid-pdf-media-type")
    )


def source_kind(payload: Column, content_type: Column) -> Column:
    is_pdf = F.coalesce(F.lower(content_type).contains("application/pdf"), F.lit(False)) | F.coalesce(F.substring(payload, 1, 5) == F.lit(b"%PDF-"), F.lit(False))
    return F.when(is_pdf, "pdf").otherwise("html")


def statement_results(pages: DataFrame) -> DataFrame:
    """(content_kind, content_id, status, evidence) of (doc_id, url, html) pages: ready where a page maps and its tree is valid, else invalid_structure with the first code."""
    nodes = statement.statement_nodes(pages)
    failed = nodes.filter("path IS NULL").select("doc_id", "error")
    bad = render.violations(nodes, F.lit("statement"), ready=False).groupBy("doc_id").agg(F.min(F.struct("path", "code")).alias("_v")).select("doc_id", F.col("_v.code").alias("error"))
    errors = failed.unionByName(bad)
    rows = pages.select("doc_id").join(errors, "doc_id", "left")
    return rows.select(F.lit("statement").alias("content_kind"), F.col("doc_id").alias("content_id"), F.when(F.col("error").isNull(), "ready").otherwise("invalid_structure").alias("status"), F.when(F.col("error").isNotNull(), evidence(F.col("error"))).alias("evidence"))


def event_error(rows: DataFrame) -> Column:
    """Why a state cannot be recorded: an unsafe id, an unknown state, or a state other than ready without evidence."""
    bare = F.col("evidence").isNull() | (F.trim("evidence") == "") | (F.trim("evidence") == "{}")
    return (
        F.when(~safe_component(F.col("content_id").cast("string")), "invalid-content-id").when(~F.col("status").isin("ready", "known_absent", "transient_failure", "invalid_structure"), "invalid-status")
        .when((F.col("status") != "ready") & bare, "missing-evidence")
    )
