"""Links, identities, contest states, envelopes and reports on literal rows: nulls, empty and repeated rows."""

import json

from pyspark.sql import functions as F

from kilnwork.operators import contest

RECEIPT = "content_id long, attempt int, ok boolean, body string, status_code int, blocked boolean, recognized boolean, fetched_at string, error string"


def test_contest_states_and_their_evidence(spark):
    at = lambda n: f"2024-01-01T00:00:0{n}Z"
    good = lambda i, k, body, t: (i, k, True, body, None, False, True, at(t), None)
    rows = [good(1, 1, "<p>x</p>", 1), good(1, 2, "<p>x</p>", 2), good(1, 2, "<p>x</p>", 2), (2, 1, False, None, 503, True, False, at(1), "blocked"), good(3, 2, "<p>x</p>", 2), good(4, 1, "<p>x</p>", 1)]
    out = {r["content_id"]: r for r in contest.contest_states(spark.createDataFrame(rows, RECEIPT), "https://example.org").collect()}
    assert {k: r["status"] for k, r in out.items()} == {1: "known_absent", 2: "transient_failure", 3: "transient_failure", 4: "transient_failure"}
    assert json.loads(out[1]["evidence"])["successfulCheckTimestamps"] == [at(1), at(2)]
    told = {"ok": False, "statusCode": 503, "blocked": True, "recognized": False, "fetchedAt": at(1), "error": "blocked"}
    assert json.loads(out[2]["evidence"]) == {"errors": ["contest-page-fetch-failed"], "receipts": [told]}
    assert json.loads(out[3]["evidence"]) == {"errors": ["contest-page-fetch-failed"], "receipts": []}
    assert json.loads(out[4]["evidence"])["errors"] == ["absence-recheck-failed"]
    assert json.loads(out[4]["evidence"])["receipts"][0]["statusCode"] is None
    assert contest.contest_states(spark.createDataFrame([], RECEIPT), "https://example.org").count() == 0


def test_envelopes_of_odd_texts(spark):
    rows = [(1, None, "{}"), (2, "statement", None), (3, "editorial", "no json"), (4, "editorial", '{"schema":2,"root":{"kind":"document"}}'), (5, "editorial", '{"schema":2,"root":{"kind":"document"},"assets":"a","diagnostics":[{"a":1}]}')]
    df = spark.createDataFrame(rows, "n long, kind string, doc string")
    out = {r["n"]: r["e"] for r in df.select("n", contest.envelope_errors(F.col("kind"), F.col("doc")).alias("e")).collect()}
    assert out == {1: ["unsupported-content-kind"], 2: ["invalid-document"], 3: ["invalid-document"], 4: [], 5: ["invalid-assets"]}


def test_time_and_totals(spark):
    now = spark.range(1).select(contest.utc_now().alias("t")).first()["t"]
    assert len(now) == 27 and now.endswith("Z")
    empty = spark.createDataFrame([], "content_kind string, seq long, ready_count long, failed_count long, completed boolean")
    assert [tuple(r) for r in contest.recorded(empty).collect()] == [(None, None, 0, 0)]
