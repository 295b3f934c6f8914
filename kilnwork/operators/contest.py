"""Contests and items between a fetched page and a document: links, identities, contest states with the second look for absence, envelopes and reports.

All are native columns or staged DataFrames; a failure is a value, never a failed task. Null pages and texts have no link, no token and no mark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilnwork.functions.text import canonical_json
from kilnwork.operators import encode, render
from kilnwork.operators.receipts import receipt_valid

#: Fixed value: the version that a stored document names.
SCHEMA = 2


def _matches(body: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(body, F.lit(pattern), group)


def editorial_link(body: Column, origin: str) -> Column:
    """The address of a contest page's editorial, null without one: the first entry link whose title names an editorial or tutorial, else the first whose text
    does so and names no announcement. Links are paths, or addresses of `origin` by either scheme; query and fragment are cut."""
    host = origin.split("://", 1)[-1].replace(".", r"\.")
    entry = rf'(?i)<a[^>]*href="(?:https?://{host})?(/blog/entry/[0-9]+)[^"]*"[^>]*'
    named = lambda x: F.lower(x).rlike("editorial|tutorial")

    def first(pattern: str, fits) -> Column:
        links = F.zip_with(_matches(body, pattern, 1), _matches(body, pattern, 2), lambda path, said: F.struct(path.alias("path"), said.alias("said")))
        return F.get(F.filter(links, lambda x: fits(x["said"])), F.lit(0))["path"]

    by_title = first(entry + r'title="([^"]*)"[^>]*>', named)
    by_text = first(entry + r">([\s\S]*?)</a>", lambda x: named(x) & ~F.contains(F.lower(x), F.lit("announcement")))
    return F.concat(F.lit(origin), F.coalesce(by_title, by_text))


def bootstrap_index(contest_id: Column, codes: Column) -> Column:
    """The index of the first of a contest's problem codes that can be asked for: `17A` and `17/A` name A of contest 17, `171A` is another contest's. Null if there is none."""
    own = F.filter(codes, lambda c: F.startswith(c, contest_id))
    rest = F.transform(own, lambda c: F.substring(c, F.length(contest_id) + 1, F.length(c)))
    usable = F.filter(rest, lambda r: ~r.rlike(r"^\p{Nd}"))
    return F.get(F.filter(F.transform(usable, lambda r: F.regexp_replace(r, "^/", "")), lambda r: r != ""), F.lit(0))


def form_token(page: Column) -> Column:
    """The token that a page's data attribute gives to forms, null without one."""
    return F.nullif(F.regexp_extract(page, r"""data-csrf\s*=\s*['"]([a-f0-9]+)['"]""", 1), F.lit(""))


def marked(page: Column, markers: tuple[str, ...]) -> Column:
    """Whether a page holds one of the markers as they are written."""
    out = F.lit(False)
    for m in markers:
        out = out | F.contains(page, F.lit(m))
    return F.coalesce(out, F.lit(False))


def utc_now() -> Column:
    """The query's time as UTC text with microseconds."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def _json(value: Column) -> Column:
    return canonical_json(F.to_json(value, {"ignoreNullFields": "false"}))


def identified(requests: DataFrame, identities: DataFrame) -> DataFrame:
    """(problem_code, contest_id, index, status, evidence) of requested codes: `known_absent` with evidence where no identity has the code, else both null."""
    known = identities.select("problem_code", "contest_id", "index").dropDuplicates(["problem_code"])
    rows = requests.select("problem_code").join(known, "problem_code", "left")
    lost = F.col("contest_id").isNull()
    told = _json(F.struct(F.col("problem_code").alias("problemCode"), F.lit(False).alias("recognized")))
    return rows.select("*", F.when(lost, "known_absent").alias("status"), F.when(lost, told).alias("evidence"))


def identity_mismatch(requested: Column, given: Column, source: Column) -> Column:
    """Why a page is not that of the requested code, null if it is: the given identity's code, and (contest_id, index) of the source's address."""
    named = F.concat(source["contest_id"], source["index"])
    return F.when(~given.eqNullSafe(requested), "problem-identity-mismatch").when(~named.eqNullSafe(requested), "source-identity-mismatch")


def contest_states(pages: DataFrame, origin: str) -> DataFrame:
    """(content_id, source_url, status, evidence) of the receipts of contest pages, of which an item has a first (attempt 1) and, where that has no link, a second.

    A link leaves the state to what follows (null). No link on two valid receipts of different times is `known_absent`; all else is a
    `transient_failure` that names itself. Of several receipts of an attempt the earliest counts; an item without a first one has failed to fetch.
    """
    r = F.struct(*[F.col(c) for c in ("ok", "body", "status_code", "blocked", "recognized", "fetched_at")])
    seen = F.struct(
        F.col("fetched_at").alias("fetchedAt"), receipt_valid(r).alias("valid"), editorial_link(F.col("body"), origin).alias("link"), "ok",
        F.col("status_code").alias("statusCode"), "blocked", "recognized", "error",
    )
    looks = pages.select("content_id", "attempt", seen.alias("seen")).groupBy("content_id").agg(
        F.min(F.when(F.col("attempt") == 1, F.col("seen"))).alias("one"), F.min(F.when(F.col("attempt") == 2, F.col("seen"))).alias("two")
    )
    one, two = F.col("one"), F.col("two")
    valid = lambda x: F.coalesce(x["valid"], F.lit(False))
    error = (
        F.when(~valid(one), "contest-page-fetch-failed").when(one["link"].isNotNull(), None)
        .when(~valid(two), "absence-recheck-failed").when(two["link"].isNotNull() | (two["fetchedAt"] == one["fetchedAt"]), "absence-check-mismatch")
    )
    full = lambda x: F.struct(*[x[c].alias(c) for c in ("ok", "statusCode", "blocked", "recognized", "fetchedAt", "error")])
    brief = lambda x: F.struct(x["fetchedAt"].alias("fetchedAt"), x["recognized"].alias("recognized"), F.lit(False).alias("editorialFound"), F.lit(False).alias("tutorialFound"))
    used = F.filter(F.array(one, F.when(error != "contest-page-fetch-failed", two)), lambda x: x.isNotNull())
    failed = _json(F.struct(F.array(error).alias("errors"), F.transform(used, full).alias("receipts")))
    absent = _json(F.struct(F.array(one["fetchedAt"], two["fetchedAt"]).alias("successfulCheckTimestamps"), F.array(brief(one), brief(two)).alias("contestPageReceipts")))
    linked = valid(one) & one["link"].isNotNull()
    return looks.select(
        "content_id", F.when(linked, one["link"]).alias("source_url"), F.when(error.isNotNull(), "transient_failure").when(~linked, "known_absent").alias("status"),
        F.when(error.isNotNull(), failed).when(~linked, absent).alias("evidence"),
    )


def envelope_errors(content_kind: Column, document: Column) -> Column:
    """The codes of all rules that the envelope of a document, given as JSON text, breaks; a kind that no codec reads, and a text that is no object, are each told alone."""
    v = F.try_parse_json(document)
    text = lambda key: F.try_variant_get(v, f"$.{key}", "string")
    kind_of = lambda key: F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$.{key}", "variant")), F.lit("ARRAY<VOID>"))
    statement = content_kind == "statement"
    rules = F.array(
        F.when(~text("schema").eqNullSafe(F.lit(str(SCHEMA))), "unsupported-schema"),
        F.when(statement & ~text("problemCode").eqNullSafe(F.concat(text("contestId"), text("index"))), "invalid-problem-identity"),
        F.when(statement & ~F.coalesce(text("sourceKind").isin("html", "pdf"), F.lit(False)), "invalid-statement-source-kind"),
        F.when(~text("root.kind").eqNullSafe(F.lit("document")), "invalid-document-root"),
        F.when(~F.startswith(kind_of("diagnostics"), F.lit("ARRAY")), "invalid-diagnostics"),
        F.when(~kind_of("assets").isin("ARRAY<STRING>", "ARRAY<VOID>"), "invalid-assets"),
    )
    is_object = F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.lit(False))
    return (
        F.when(~F.coalesce(content_kind.isin("statement", "editorial"), F.lit(False)), F.array(F.lit("unsupported-content-kind")))
        .when(~is_object, F.array(F.lit("invalid-document"))).otherwise(F.array_compact(rules))
    )


def ready_payload(content_kind: Column, html: Column, url: Column, source_kind: Column) -> Column:
    """What the API gives for a ready document, as canonical JSON; documents without a source kind have none in it."""
    always = [F.lit("html").alias("format"), content_kind.alias("contentKind"), F.lit(SCHEMA).alias("schema"), html.alias("html"), url.alias("url"), F.lit(True).alias("known"), F.lit("ready").alias("status")]
    return F.when(source_kind.isNull(), _json(F.struct(*always))).otherwise(_json(F.struct(*always, source_kind.alias("sourceKind"))))


def recorded(reports: DataFrame) -> DataFrame:
    """(content_kind, state, cached, failed) of final reports (content_kind, seq, ready_count, failed_count, completed): the last one of each kind, and their sums in a row without a kind."""
    last = reports.groupBy("content_kind").agg(F.max_by(F.struct("ready_count", "failed_count", "completed"), "seq").alias("r"))
    rows = last.select("content_kind", F.when(F.col("r.completed"), "complete").otherwise("partial").alias("state"), F.col("r.ready_count").alias("cached"), F.col("r.failed_count").alias("failed"))
    total = rows.agg(F.coalesce(F.sum("cached"), F.lit(0)).alias("cached"), F.coalesce(F.sum("failed"), F.lit(0)).alias("failed"))
    return rows.unionByName(total.select(F.lit(None).cast("string").alias("content_kind"), F.lit(None).cast("string").alias("state"), "cached", "failed"))


def report(nodes: DataFrame) -> DataFrame:
    """(doc_id, ok, problem_codes, unresolved, errors, sha256) of editorial trees that nothing is written of: sections and open slots in document order,
    the codes of all broken rules, and the digest of the canonical JSON. Documents without a tree have their errors alone."""
    trees = nodes.filter("path IS NOT NULL")
    named = lambda kind: F.transform(
        F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("path", F.col("attrs")["problemCode"].alias("code"))))), lambda x: x["code"]
    )
    parts = trees.groupBy("doc_id").agg(named("problem_section").alias("problem_codes"), named("tutorial_slot").alias("unresolved"))
    broken = render.violations(trees, F.lit("editorial")).groupBy("doc_id").agg(F.sort_array(F.collect_set("code")).alias("broken"))
    digest = encode.tree_json(trees).select("doc_id", F.sha2(F.col("json").cast("binary"), 256).alias("sha256"))
    lost = nodes.filter("path IS NULL").groupBy("doc_id").agg(F.sort_array(F.collect_set("error")).alias("lost"))
    rows = nodes.select("doc_id").distinct()
    for other in (parts, broken, digest, lost):
        rows = rows.join(other, "doc_id", "left")
    none = F.array().cast("array<string>")
    twice = F.when(F.size("problem_codes") != F.size(F.array_distinct("problem_codes")), F.lit("duplicate-problem-section"))
    open_slots = F.when(F.size("unresolved") > 0, F.lit("unresolved-tutorial-slots"))
    errors = F.concat(F.coalesce("lost", none), F.coalesce("broken", none), F.array_compact(F.array(twice, open_slots)))
    return rows.select("doc_id", (F.size(errors) == 0).alias("ok"), F.coalesce("problem_codes", none).alias("problem_codes"), F.coalesce("unresolved", none).alias("unresolved"), errors.alias("errors"), "sha256")
