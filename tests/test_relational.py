"""Catalogue, status, queue, reading and streaming operators on literal rows, and the registered queries against their SQL."""

import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from kilnwork.functions import text, urls
from kilnwork.operators import catalog, lifecycle, status
from kilnwork.sources import readers
from kilnwork.streaming import ingest

TABLES = "/root/testdata/sf0.001"
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{TABLES}/{name}.parquet')")
    return con


OWN = [n for n in __spark_entry__.oracle_sql() if not n.startswith("op")]


@pytest.mark.parametrize("name", OWN)
def test_query_against_its_sql(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, TABLES)
    found = duck.execute(__spark_entry__.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    rows = [[plain(v) for v in r] for r in df.select(*columns).collect()]
    assert sorted(map(repr, rows)) == sorted(repr([plain(v) for v in r]) for r in found.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_catalogue_keys(spark):
    problems = spark.createDataFrame([(921, "01", "a", None, None), (9210, "1", "b", 0, ["x"]), (5, "A", "c", 800, [])], "contestId int, index string, name string, rating int, tags array<string>")
    stats = spark.createDataFrame([(0, 921, "01", 3), (1, 921, "01", 7), (2, 5, "A", 1)], "pos int, contestId int, index string, solvedCount bigint")
    rows = {(r.contestId, r["index"]): r for r in catalog.catalogue(problems, stats).collect()}
    assert [rows[k].solvedCount for k in ((921, "01"), (9210, "1"), (5, "A"))] == [7, 0, 1]  # the last of two wins, no match is 0
    assert rows[(921, "01")].tags == [] and rows[(921, "01")].id == "92101"
    joined = {r.contestId: r.solvedCount for r in catalog.catalogue(problems, stats, concatenated_key=True).collect()}
    assert joined == {921: 7, 9210: 7, 5: 1}
    assert catalog.catalogue(problems, stats).agg(catalog.rated_count()).first()[0] == 1
    assert catalog.identity_error(catalog.identities(problems)).first().error == "duplicate-problem-code"
    assert catalog.identity_error(catalog.identities(problems.limit(0))).first().error == "empty-catalogue"


def test_states(spark):
    log = [("a", 1, "ready"), ("a", 2, "transient_failure"), ("b", 1, "ready"), ("b", 2, "known_absent"), ("c", 1, "invalid_structure"), ("c", 2, "ready"), ("d", 1, "known_absent")]
    folded = status.fold(spark.createDataFrame(log, "content_id string, seq long, status string"), ["content_id"]).cache()
    assert {r.content_id: (r.visible, r.marker) for r in folded.collect()} == {"a": (True, "transient_failure"), "b": (False, "known_absent"), "c": (True, None), "d": (False, "known_absent")}
    expected = spark.createDataFrame([(x,) for x in "abcde"], "content_id string")
    taken = lambda **kw: sorted(r[0] for r in status.pending(expected, folded, **kw).collect())
    assert taken() == ["a", "e"]  # a failure mark outweighs a readable document
    assert taken(requested=["b"]) == ["a", "b", "e"] and taken(force=True) == list("abcde")
    states = expected.join(folded, "content_id", "left").select(status.item_status(F.col("visible"), F.col("content_id") != "c", F.col("marker")).alias("status"))
    assert {r.status: r.n for r in status.histogram(states).collect()} == {"ready": 1, "known_absent": 2, "invalid_structure": 1, "pending": 1, "transient_failure": 0}


def test_queue(spark):
    pushes = spark.createDataFrame([(1, 0, "x"), (1, 1, "y"), (2, 0, "z"), (2, 1, "y"), (2, 2, "z")], "seq int, pos int, content_id string")
    ranks = status.queue_ranks(pushes).cache()
    left = spark.createDataFrame([("x",), ("y",), ("w",)], "content_id string")
    assert [r[0] for r in status.ordered(left, ranks, "content_id", [F.col("content_id")]).collect()] == ["y", "x", "w"]
    assert status.popped(left, ranks).first().content_id == "y"  # z is stale
    assert status.popped(left.filter("content_id = 'w'"), ranks).count() == 0


def test_batches_over_many_partitions(spark):
    rows = spark.range(0, 1003).withColumn("k", (F.col("id") * 7919 % 1003)).repartition(9).drop("id")
    out = catalog.batches(rows, ["k"], 8).collect()
    assert len(out) == 1003 and all(r.batch == r.k // 8 for r in out)


def test_text_functions(spark):
    one = lambda value, f: spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("o")).first().o
    assert one("a  \t\nb", text.collapsed) == "a  b"
    assert one("x y  x", text.class_tokens) == ["x", "y"]
    assert one("$$$a \\lt b$$$ \\lt $$$c", text.math_normal) == "$a < b$ \\lt $$$c"
    assert one("$$$$$$", text.math_normal) == "$$" and one("q", text.math_normal) == "q"
    assert one("<a&\"'>", text.escaped) == "&lt;a&amp;&quot;&#x27;&gt;"
    assert one('{"b":1,"a":[1,"é"]}', text.canonical_json) == '{"a":[1,"é"],"b":1}' and one('{"a":1,"a":2}', text.canonical_json) is None
    assert one("2024-01-01T00:00:00.000001Z", text.valid_timestamp) and not one("2024-01-01T00:00:00", text.valid_timestamp)
    good = ["http://a.b/c", "HTTPS://x:80/", "/x", "#y", "http://[::1]/"]
    bad = ["//x", "javascript:x", "http:///x", "http://a b", "/a\\b", "http://x:99999/", "", "mailto:x@y", "http:a"]
    assert [one(u, urls.link) for u in good] == good and [one(u, urls.link) for u in bad] == [None] * len(bad)
    local = "/editorial-assets/" + "a" * 64 + ".png"
    picture = lambda u: one(u, lambda c: urls.image(c, F.lit("editorial")))
    assert picture(local) == local and picture(local + "?x") is None and picture("/editorial-assets/../" + "a" * 64 + ".png") is None and picture(local.replace("png", "pdf")) is None


def test_readers(spark, tmp_path):
    feed = {"status": "OK", "result": {"problems": [{"contestId": 1, "index": "A", "name": "n", "tags": ["t"]}], "problemStatistics": [{"contestId": 1, "index": "A", "solvedCount": 4}]}}
    (tmp_path / "feed.json").write_text(json.dumps(feed))
    rows = catalog.catalogue(*readers.feed(spark, str(tmp_path / "feed.json")))
    assert rows.first().solvedCount == 4
    readers.write_catalogue(rows, str(tmp_path / "catalogue"))
    assert readers.catalogue(spark, str(tmp_path / "catalogue")).count() == 1
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "1A.json").write_text('{"a":1}')
    (docs / "1B.json").write_text('{"b": 1}')
    (docs / "bad name.json").write_text("{}")
    (docs / "x.txt").write_text("{}")
    assert {r.content_id: r.canonical for r in readers.stored_documents(spark, str(docs)).collect()} == {"1A": True, "1B": False}
    files = tmp_path / "solutions"
    files.mkdir()
    (files / "1A.CPP").write_bytes(b"int\xff")
    (files / "1A.2.py").write_text("x")
    (files / "1AB.py").write_text("y")
    (files / "1A.exe").write_text("z")
    found = readers.solutions(spark, str(files))
    assert sorted(r.name for r in readers.solutions_of(found, "1", "A").collect()) == ["1A.2.py", "1A.CPP"]
    assert found.filter("name = '1A.CPP'").first().content == "int�"


def test_stream_of_pages(spark, tmp_path):
    page = '<div class="problem-statement"><p>x</p></div>'
    spark.createDataFrame([(1, "https://example.org/1", page), (2, "https://example.org/2", "<p>none</p>")], ingest.PAGES).coalesce(1).write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # a second run finds nothing new
        ingest.ingest(ingest.pages(spark, str(tmp_path / "in")), str(tmp_path / "log"), str(tmp_path / "at")).awaitTermination(120)
    rows = ingest.events(spark, str(tmp_path / "log")).collect()
    assert {r.content_id: (r.status, r.evidence) for r in rows} == {1: ("ready", None), 2: ("invalid_structure", '{"error":"missing-problem-statement"}')}


def test_fetched_pages(spark):
    rows = [(1, bytearray(b"<p>"), "text/html"), (2, bytearray(b"%PDF-1"), "application/pdf; x"), (3, bytearray(b"\xff\xfe"), "text/html"), (4, bytearray(b"no"), "application/pdf"), (5, bytearray(b"%PDF-1"), "text/html"), (6, None, None)]
    df = spark.createDataFrame(rows, "k int, payload binary, t string").withColumn("kind", lifecycle.source_kind(F.col("payload"), F.col("t")))
    got = {r.k: r.e for r in df.select("k", lifecycle.fetch_error(F.col("kind"), F.col("payload"), F.col("t")).alias("e")).collect()}
    assert got == {1: None, 2: None, 3: "invalid-html-source", 4: "invalid-pdf-body", 5: "invalid-pdf-media-type", 6: "invalid-html-source"}
