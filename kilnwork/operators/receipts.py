"""Fetch receipts, absence, response classes and API payloads: the rules between a fetched page and an item's state, as native columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilnwork.functions.text import valid_timestamp


def recognised(body: Column, is_html: Column, markers: tuple[str, ...], subjects: tuple[str, ...] = ("contest", "problem", "page", "blog")) -> Column:
    """Whether a page is no error page. Markers are looked for in the title and h1 of HTML, in the first 4096 characters of plain text; `does not exist` counts beside a subject word."""
    heads = F.concat_ws(" ", F.transform(F.regexp_extract_all(body, F.lit(r"(?is)<(title|h1)\b[^>]*>(.*?)</\1\s*>"), 2), lambda x: F.regexp_replace(x, "<[^>]+>", " ")))
    said = F.lower(F.when(is_html, heads).otherwise(F.substring(body, 1, 4096)))
    bad = F.contains(said, F.lit("does not exist")) & said.rlike("|".join(subjects))
    for m in markers:
        bad = bad | F.contains(said, F.lit(m))
    return F.coalesce(F.trim(body) != "", F.lit(False)) & ~F.coalesce(bad, F.lit(True))


def receipt_valid(r: Column) -> Column:
    """A receipt (ok, body, status_code, blocked, recognized, fetched_at as text) that may count as evidence: status codes may be null, else they are 2xx."""
    code = r["status_code"].isNull() | r["status_code"].between(200, 299)
    return F.coalesce(valid_timestamp(r["fetched_at"]) & r["ok"] & code & ~r["blocked"] & r["recognized"] & (F.trim(r["body"]) != ""), F.lit(False))


def absence(receipts: DataFrame, has_link: Column) -> DataFrame:
    """(id, confirmed): items with two valid receipts fetched at different times, none of which has a link."""
    r = F.struct(*[F.col(c) for c in ("ok", "body", "status_code", "blocked", "recognized", "fetched_at")])
    rows = receipts.groupBy("id").agg(F.count("*").alias("n"), F.countDistinct("fetched_at").alias("times"), F.bool_and(receipt_valid(r)).alias("valid"), F.bool_or(has_link).alias("linked"))
    return rows.select("id", ((F.col("n") == 2) & (F.col("times") == 2) & F.col("valid") & ~F.col("linked")).alias("confirmed"))


def fragment_response(code: Column, payload: Column) -> Column:
    """(outcome, html, error) of a tutorial response given as JSON text: html, missing or transient; success may be a boolean or its string."""
    v = F.try_parse_json(payload)
    success, kind = F.try_variant_get(v, "$.success", "string"), F.schema_of_variant(v)
    html = F.try_variant_get(v, "$.html", "string")
    is_text = F.coalesce(F.schema_of_variant(F.try_variant_get(v, "$.html", "variant")) == "STRING", F.lit(False))
    error = (
        F.when(payload.isNull(), F.concat(code, F.lit(":tutorial-request-failed"))).when(F.coalesce(~kind.startswith("OBJECT"), F.lit(True)), F.concat(code, F.lit(":invalid-tutorial-response")))
        .when((success == "true") & ~(is_text & F.coalesce(F.trim(html) != "", F.lit(False))), F.concat(code, F.lit(":missing-tutorial-html"))).when(~F.coalesce(success.isin("true", "false"), F.lit(False)), F.concat(code, F.lit(":invalid-tutorial-success")))
    )
    return F.struct(F.when(error.isNotNull(), "transient").when(success == "true", "html").otherwise("missing").alias("outcome"), F.when(error.isNull() & (success == "true"), html).alias("html"), error.alias("error"))


# Asset errors that may pass by themselves, for statements; for editorials every asset error may.
_PASSING = ("asset-fetch-failed", "asset-write-failed")


def asset_failure_status(content_kind: Column, code: Column) -> Column:
    return F.when((content_kind == "editorial") | code.isin(*_PASSING), "transient_failure").otherwise("invalid_structure")


def payload_status(status: Column, evidence: Column) -> Column:
    """(status, html_allowed, error) that the API gives: the error is the evidence's `error`, else its `errors`, else the state; absent and pending items have none."""
    v = F.try_parse_json(evidence)
    told = F.coalesce(F.try_variant_get(v, "$.error", "string"), F.try_variant_get(v, "$.errors", "string"), status)
    return F.struct(status.alias("status"), (status == "ready").alias("html_allowed"), F.when(~status.isin("ready", "known_absent", "pending"), told).alias("error"))


def http_code(status: Column) -> Column:
    """The HTTP code of each API state."""
    return F.when(status == "invalid_ref", 400).when(status == "pending", 202).when(status == "transient_failure", 503).when(status == "invalid_structure", 500).otherwise(200)


def preview_label(item_id: Column, name: Column, content_kind: Column) -> Column:
    by_name = F.when(F.length(name) > 0, F.concat(item_id, F.lit(" — "), name)).otherwise(item_id)
    return F.when(content_kind == "editorial", F.concat(F.lit("Contest "), item_id)).otherwise(by_name)
