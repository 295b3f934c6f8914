"""Assets, pictures, receipts and API rules on literal payloads."""

import hashlib
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from kilnwork.functions import binary, png
from kilnwork.operators import assets, receipts


def picture(width, height, depth, kind, rows, extra=()):
    lines = b"".join(bytes([f]) + r for f, r in rows)
    body = [(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, kind, 0, 0, 0)), *extra, (b"IDAT", zlib.compress(lines)), (b"IEND", b"")]
    return png.SIGNATURE + b"".join(struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b)) for k, b in body)


def lines_of(payload):
    return zlib.decompress(dict(png._chunks(payload))[b"IDAT"])


def test_transparent_pictures_over_white():
    grey = picture(2, 1, 8, 4, [(0, bytes([0, 255, 100, 0]))])
    assert lines_of(png.flattened_bytes(grey)) == bytes([0, 0, 0, 0, 255, 255, 255])
    half = picture(1, 1, 8, 6, [(0, bytes([10, 20, 30, 128]))])
    assert lines_of(png.flattened_bytes(half)) == bytes([0]) + bytes((c * 128 + 255 * 127 + 127) // 255 for c in (10, 20, 30))
    keyed = picture(2, 1, 8, 2, [(0, bytes([1, 2, 3, 4, 5, 6]))], [(b"tRNS", struct.pack(">HHH", 4, 5, 6))])
    assert lines_of(png.flattened_bytes(keyed)) == bytes([0, 1, 2, 3, 255, 255, 255])
    by_index = picture(4, 1, 2, 3, [(0, bytes([0b00011011]))], [(b"PLTE", bytes(range(12))), (b"tRNS", bytes([0, 255]))])
    assert lines_of(png.flattened_bytes(by_index)) == bytes([0, 255, 255, 255, 3, 4, 5, 6, 7, 8, 9, 10, 11])
    deep = picture(1, 1, 16, 4, [(0, struct.pack(">HH", 65535, 0))])
    assert lines_of(png.flattened_bytes(deep)) == bytes([0, 255, 255, 255])


def test_filters():
    plain = [bytes([9, 0, 50, 255]), bytes([7, 128, 60, 255])]
    sub = bytes([9, 0, 41, 255])
    up = bytes((b - a) & 255 for a, b in zip(plain[0], plain[1], strict=True))
    avg = bytes((plain[1][x] - (((plain[1][x - 2] if x > 1 else 0) + plain[0][x]) >> 1)) & 255 for x in range(4))
    paeth = bytes((plain[1][x] - (plain[0][x] if x < 2 else min((plain[1][x - 2], plain[0][x], plain[0][x - 2]), key=lambda v: (abs(plain[1][x - 2] + plain[0][x] - plain[0][x - 2] - v))))) & 255 for x in range(4))
    want = lines_of(png.flattened_bytes(picture(2, 2, 8, 4, [(0, plain[0]), (0, plain[1])])))
    for second in ((2, up), (3, avg), (4, paeth)):
        assert lines_of(png.flattened_bytes(picture(2, 2, 8, 4, [(1, sub), second]))) == want


@pytest.mark.parametrize("payload", [b"", b"x", picture(1, 1, 8, 2, [(0, b"abc")]), picture(1, 1, 8, 4, [(0, bytes([5, 255]))]), picture(1, 1, 8, 4, [(9, bytes([5, 0]))]), picture(1, 1, 8, 4, [(0, bytes([5, 0]))])[:-1], picture(1, 1, 8, 4, [(0, bytes([5, 0]))], [(b"QQQQ", b"")])])
def test_other_pictures_stay(payload):
    assert png.flattened_bytes(payload) == payload


def bitmap(width=1, height=1, depth=24, size=None, offset=54):
    row = (width * depth + 31) // 32 * 4 * abs(height)
    return b"BM" + struct.pack("<IHHI", size or offset + row, 0, 0, offset) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, depth, 0, 0, 0, 0, 0, 0) + bytes(row)


def test_kinds_and_bitmaps(spark):
    cases = [(png.SIGNATURE, "png"), (b"\xff\xd8\xff\xe0", "jpg"), (b"GIF89a", "gif"), (b"RIFF1234WEBP", "webp"), (b"%PDF-1.4", "pdf"), (bitmap(), "bmp"), (bitmap(height=-2), "bmp"), (bitmap(size=59), "bmp"), (bitmap(size=70), None), (bitmap(depth=8), None), (bitmap(depth=7), None), (b"BM", None), (b"", None)]
    df = spark.createDataFrame([(k, bytearray(p)) for k, (p, _) in enumerate(cases)], "k int, payload binary")
    got = {r.k: r.e for r in df.select("k", binary.extension(F.col("payload")).alias("e")).collect()}
    assert got == {k: e for k, (_, e) in enumerate(cases)}
    same = df.filter("k = 0").select(png.flattened(F.col("payload")).alias("p")).first().p
    assert bytes(same) == png.SIGNATURE


def test_localised_trees(spark):
    gif, pdf = b"GIF89a..", b"%PDF-1"
    fetched = spark.createDataFrame(
        [("https://x.org/a.gif", "image", None, bytearray(gif), "Image/GIF; q=1"), ("https://x.org/d.pdf", "attachment", "application/pdf", bytearray(pdf), "application/pdf"), ("https://x.org/bad.gif", "image", None, bytearray(b"<html>"), "text/html"), ("https://x.org/e.gif", "image", None, bytearray(b""), "image/gif"), ("https://x.org/t.gif", "image", None, bytearray(gif), "text/plain")],
        "url string, kind string, declared_type string, payload binary, media_type string",
    )
    took = assets.accepted(fetched).cache()
    assert {r.url[14:]: r.error for r in took.collect()} == {"a.gif": None, "d.pdf": None, "bad.gif": "invalid-raster-magic", "e.gif": "empty-asset-payload", "t.gif": "invalid-raster-media-type"}
    rows = [(1, [0], "image", {"src": "https://x.org/a.gif", "alt": "q"}), (1, [1], "image", {"src": "https://x.org/pic.SVG", "alt": "s"}), (1, [2], "attachment", {"href": "https://x.org/d.pdf", "mediaType": "application/pdf"}), (1, [3], "image", {"src": "https://gone.org/x.png", "alt": ""}), (2, [0], "image", {"src": "https://x.org/bad.gif"}), (3, [0], "image", {"src": "https://x.org/never.gif"})]
    nodes = spark.createDataFrame(rows, "doc_id long, path array<int>, kind string, attrs map<string,string>")
    gone = spark.createDataFrame([("https://gone.org/x.png",)], "url string")
    trees, errors = assets.localised(nodes, took, "statement", gone)
    name = hashlib.sha256(gif).hexdigest() + ".gif"
    out = {tuple(r.path): (r.kind, r.attrs) for r in trees.filter("doc_id = 1").collect()}
    assert out[(0,)] == ("image", {"src": "/statement-assets/" + name, "alt": "q"}) and out[(1,)] == ("missing_asset", {"alt": "s"}) and out[(3,)] == ("missing_asset", {"alt": ""})
    assert out[(2,)][1]["href"] == "/statement-assets/" + hashlib.sha256(pdf).hexdigest() + ".pdf"
    assert {(r.doc_id, r.error) for r in errors.collect()} == {(2, "invalid-raster-magic"), (3, "asset-fetch-failed")}
    refs = assets.references(trees, "statement")
    stored = assets.store(took.unionByName(took)).select("name", "payload")
    assert stored.count() == 2 and assets.broken(refs, stored).count() == 0 and assets.orphans(stored, refs).count() == 0
    tampered = stored.withColumn("payload", F.lit(bytearray(b"GIF89aXX")).cast("binary"))
    assert assets.broken(refs, tampered).count() == 2
    assert [r.error for r in assets.store(took.filter("kind = 'image'"), tampered).collect()] == ["existing-asset-mismatch"]
    assert tuple(assets.collected(assets.orphans(stored, refs.limit(0))).first()) == (2, len(gif) + len(pdf))


def test_receipts(spark):
    ok = (True, "body", 200, False, True, "2024-01-01T00:00:00.000001Z")
    rows = [("a", *ok, False), ("a", *ok[:5], "2024-01-01T00:00:02.000000Z", False), ("b", *ok, False), ("b", *ok, False), ("c", *ok, False), ("c", True, "body", None, False, True, "2024-01-01T00:00:03.000000Z", True), ("d", *ok, False), ("d", True, " ", 404, False, True, "2024", False)]
    df = spark.createDataFrame(rows, "id string, ok boolean, body string, status_code int, blocked boolean, recognized boolean, fetched_at string, link boolean")
    assert {r.id: r.confirmed for r in receipts.absence(df, F.col("link")).collect()} == {"a": True, "b": False, "c": False, "d": False}


def test_fragment_responses(spark):
    cases = {1: ('{"success":true,"html":"<p>"}', "html", None), 2: ('{"success":"true","html":" "}', "transient", "x:missing-tutorial-html"), 3: ('{"success":"false"}', "missing", None), 4: ('{"success":1}', "transient", "x:invalid-tutorial-success"), 5: ("[1]", "transient", "x:invalid-tutorial-response"), 6: (None, "transient", "x:tutorial-request-failed"), 7: ("{bad", "transient", "x:invalid-tutorial-response")}
    df = spark.createDataFrame([(k, v[0]) for k, v in cases.items()], "k int, payload string").select("k", receipts.fragment_response(F.lit("x"), F.col("payload")).alias("r"))
    assert {r.k: (r.r.outcome, r.r.error) for r in df.collect()} == {k: (v[1], v[2]) for k, v in cases.items()}


def test_api_states(spark):
    df = spark.createDataFrame([("ready", None), ("transient_failure", '{"error":"e1"}'), ("invalid_structure", '{"errors":"e2"}'), ("invalid_structure", "{}"), ("pending", None), ("known_absent", '{"error":"no"}')], "status string, evidence string")
    rows = df.select(receipts.payload_status(F.col("status"), F.col("evidence")).alias("p"), receipts.http_code(F.col("status")).alias("h")).collect()
    assert [(r.p.error, r.h) for r in rows] == [(None, 200), ("e1", 503), ("e2", 500), ("invalid_structure", 500), (None, 202), (None, 200)]


def test_every_known_missing_address_counts(spark):
    missing = spark.range(100_500).select(F.concat(F.lit("https://example.org/"), F.col("id").cast("string"), F.lit(".png")).alias("url"))
    nodes = missing.select(F.lit(1).cast("long").alias("doc_id"), F.array(F.monotonically_increasing_id().cast("int")).alias("path"), F.lit("image").alias("kind"), F.create_map(F.lit("src"), "url").alias("attrs"), F.lit(None).cast("string").alias("text"))
    fetched = spark.createDataFrame([], "url string, name string, error string")
    out, errors = assets.localised(nodes, fetched, "statement", missing)
    assert out.filter("kind = 'missing_asset'").count() == 100_500 and errors.count() == 0
