"""Documents as canonical JSON (sorted keys, no blanks) and back.

A tree's JSON is put together like its HTML: every node gives an opening and a closing token by its path. Empty attributes and
children, and a null text, are left out. Numbers and booleans among the attributes are written as such.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kilnwork.operators.once import once
from kilnwork.operators.render import CLOSE
from kilnwork.operators.statement import IR, IR_NAMES, IR_TYPES

SCHEMA_VERSION = 2
_NUMBERS, _BOOLEANS = ("level",), ("ordered", "header")


def quoted(value: Column) -> Column:
    """A string as JSON."""
    inside = F.to_json(F.array(value))
    return F.substr(inside, F.lit(2), F.length(inside) - 2)


def _attrs(attrs: Column) -> Column:
    """The members of an attribute object, by key."""
    plain = lambda x: x["key"].isin(*_NUMBERS, *_BOOLEANS)
    parts = F.transform(F.array_sort(F.map_entries(attrs)), lambda x: F.concat(quoted(x["key"]), F.lit(":"), F.when(plain(x), x["value"]).otherwise(quoted(x["value"]))))
    return F.array_join(parts, ",")


def tree_json(nodes: DataFrame) -> DataFrame:
    """(doc_id, json) of the trees of IR rows, which are computed once."""
    rows = once(nodes).filter("path IS NOT NULL").select("doc_id", "path", "kind", "attrs", "text")
    up = F.when(F.size("path") > 0, F.slice("path", F.lit(1), F.greatest(F.size("path") - 1, F.lit(0))))
    rows = rows.withColumn("_up", up).withColumn("_first", F.row_number().over(Window.partitionBy("doc_id", "_up").orderBy("path")) == 1)
    counts = rows.filter(F.size("path") > 0).groupBy("doc_id", F.col("_up").alias("path")).agg(F.count("*").alias("_n"))
    rows = rows.join(counts, ["doc_id", "path"], "left")
    has, spoiler = F.col("_n").isNotNull(), F.col("kind") == "spoiler"
    members = _attrs(F.coalesce("attrs", F.create_map().cast("map<string,string>")))
    opening = F.concat(
        F.when((F.size("path") == 0) | F.col("_first"), "").otherwise(","), F.lit("{"), F.when(spoiler, '"attrs":{"title":[').when(members != "", F.concat(F.lit('"attrs":{'), members, F.lit("},"))).otherwise(""), F.when(has & ~spoiler, '"children":[').otherwise("")
    )
    closing = F.concat(F.when(has & ~F.coalesce(F.col("_bare"), F.lit(False)), "],").otherwise(""), F.lit('"kind":'), quoted(F.col("kind")), F.when(F.col("text").isNotNull(), F.concat(F.lit(',"text":'), quoted(F.col("text")))).otherwise(""), F.lit("}"))
    # of a spoiler, title nodes lie below [.., -1]; its children are counted without them
    own = rows.filter(F.size("path") > 0).filter(F.element_at("path", -1) >= 0).select("doc_id", F.col("_up").alias("path")).distinct().withColumn("_kids", F.lit(True))
    rows = rows.join(own, ["doc_id", "path"], "left").withColumn("_bare", spoiler & F.col("_kids").isNull())
    end = F.array(F.lit(CLOSE))
    tokens = F.array(F.struct(F.col("path").alias("key"), opening.alias("token")), F.struct(F.concat("path", end).alias("key"), closing.alias("token")))
    middle = F.array(F.struct(F.concat("path", F.array(F.lit(-1), F.lit(CLOSE))).alias("key"), F.concat(F.lit("]},"), F.when(F.col("_kids"), '"children":[').otherwise("")).alias("token")))
    rows = rows.select("doc_id", F.explode(F.when(spoiler, F.concat(tokens, middle)).otherwise(tokens)).alias("_t"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("_t")), lambda x: x["token"]), "")
    return rows.groupBy("doc_id").agg(text.alias("json"))


def _list(values: Column) -> Column:
    return F.coalesce(F.to_json(values), F.lit("[]"))


def diagnostics_json(values: Column) -> Column:
    """Diagnostics as JSON, a null path left out."""
    one = lambda d: F.concat(F.lit('{"code":'), quoted(d["code"]), F.lit(',"message":'), quoted(d["message"]), F.when(d["path"].isNotNull(), F.concat(F.lit(',"path":'), quoted(d["path"]))).otherwise(""), F.lit(',"severity":'), quoted(d["severity"]), F.lit("}"))
    return F.concat(F.lit("["), F.array_join(F.transform(F.coalesce(values, F.array()), one), ","), F.lit("]"))


def statement_json(trees: DataFrame, envelopes: DataFrame) -> DataFrame:
    """(doc_id, json) of statements: trees from tree_json(), envelopes (doc_id, problem_code, contest_id, index, source_url, source_kind, diagnostics, assets)."""
    put = lambda k, v: F.concat(F.lit(f'"{k}":'), v)
    parts = [put("assets", _list(F.col("assets"))), put("contentKind", F.lit('"statement"')), put("contestId", quoted(F.col("contest_id"))), put("diagnostics", diagnostics_json(F.col("diagnostics"))), put("document", F.col("json")), put("index", quoted(F.col("index"))), put("problemCode", quoted(F.col("problem_code"))), put("schema", F.lit(str(SCHEMA_VERSION))), put("sourceKind", quoted(F.col("source_kind"))), put("sourceUrl", quoted(F.col("source_url")))]
    return trees.join(envelopes, "doc_id").select("doc_id", F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")).alias("json"))


def editorial_json(trees: DataFrame, envelopes: DataFrame) -> DataFrame:
    """(doc_id, json) of editorials, which are keyed by their contest and name no content kind."""
    put = lambda k, v: F.concat(F.lit(f'"{k}":'), v)
    parts = [put("assets", _list(F.col("assets"))), put("contestId", quoted(F.col("contest_id"))), put("diagnostics", diagnostics_json(F.col("diagnostics"))), put("document", F.col("json")), put("schema", F.lit(str(SCHEMA_VERSION))), put("sourceUrl", quoted(F.col("source_url")))]
    return trees.join(envelopes, "doc_id").select("doc_id", F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")).alias("json"))


def _object(pairs: list) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ValueError("duplicate-key")
    return out


def _flat(node: dict, path: tuple, out: list) -> None:
    attrs = dict(node.get("attrs") or {})
    title = attrs.pop("title", None) if node["kind"] == "spoiler" else None
    as_text = {k: v if isinstance(v, str) else json.dumps(v, ensure_ascii=False, sort_keys=True, separators=(",", ":")) for k, v in attrs.items()}
    out.append((path, node["kind"], as_text, node.get("text")))
    for k, child in enumerate(title or []):
        _flat(child, (*path, -1, k), out)
    for k, child in enumerate(node.get("children") or []):
        _flat(child, (*path, k), out)


def decoded(documents: DataFrame) -> DataFrame:
    """IR rows of (doc_id, json) trees; text that is no JSON, repeats a key or is not canonical is one row with the error `invalid-canonical-json`."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("json").to_pylist(), strict=True):
                rows: list = []
                error = None
                try:
                    value = json.loads(text, object_pairs_hook=_object)
                    if json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":")) != text:
                        raise ValueError("not canonical")
                    _flat(value, (), rows)
                except (ValueError, TypeError, KeyError, RecursionError):
                    rows, error = [(None, None, None, None)], "invalid-canonical-json"
                n = len(rows)
                columns = ([doc_id] * n, [None if r[0] is None else list(r[0]) for r in rows], [r[1] for r in rows], [None if r[2] is None else list(r[2].items()) for r in rows], [r[3] for r in rows], [error] * n, [None] * n)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, IR_TYPES, strict=True)], IR_NAMES)

    return documents.select("doc_id", "json").mapInArrow(scan, IR)
