"""Reversible line dedup: sharded cuckoo filters in front of exact reference-count tables.

A store is a set of Parquet tables:

- refs (h1, h2, doc_id, text_key): one row for each long line key that a document holds, by the key's 128-bit xxh3 hash, with a
  64-bit hash of the document's text;
- counts (h1, h2, n_docs, last_doc): the exact reference-count table over refs;
- filters (shard, filter): for each shard of h1 a cuckoo filter of the keys that min_docs documents or more hold. When the shards
  hold more than twice SHARD_KEYS keys each, all are laid out anew from the counts, in more shards.

insert() adds documents, delete() takes documents out again; both bring counts up to date from the rows that change, and put
keys into or take them out of the filters as they cross the threshold. After a deletion the store equals one that never held the
documents. apply() asks the filters first: the lines of a document reach the exact table only when their shard's filter holds
them, and the table decides. A frequent line can be in a third of all documents; its references are counted by partial
aggregates and probe the filters under a salt, so that they never meet in one task.

Defined results: a null or empty text is one empty line; keys shorter than `min_chars` code points are never dropped; a row is a
document, so equal rows count as documents of their own, and all rows with the largest doc_id keep the line; a null doc_id is
below all others; an empty table gives no rows; of further columns none are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilnwork.llm.cuckoo import Cuckoo
from kilnwork.llm.shared import table, written

MIN_CHARS, MIN_DOCS = 40, 5
#: Keys that a shard's filter is first laid out for, and the parts that the references of a shard are dealt in.
SHARD_KEYS, SALTS = 50_000, 16
_SPACE = b" \t\n\x0b\x0c\r"
_REFS = "h1 long, h2 long, doc_id long, text_key long"


def line_key(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """A stripped line in lower case (A-Z only), None if it has fewer than min_chars code points."""
    key = line.strip(_SPACE).lower()
    if len(key) < min_chars or not key.isascii() and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return key


def _refs_of(min_chars: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, owners = [], []
            for row, text in enumerate(batch.column("text")):
                data = (text.as_py() or "").encode("utf-8", "replace")
                found = {xxhash.xxh3_128_digest(key) for line in data.split(b"\n") if len(line) >= min_chars and (key := line_key(line, min_chars)) is not None}
                digests += found
                owners += [row] * len(found)
            halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(halves[:, 0]), pa.array(halves[:, 1]), *batch.select(["doc_id", "text_key"]).take(pa.array(owners, pa.int64()))], ["h1", "h2", "doc_id", "text_key"])

    return scan


def references(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(h1, h2, doc_id, text_key) for each distinct long line key of each document."""
    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_key")).mapInArrow(_refs_of(min_chars), _REFS)


def _counted(refs: DataFrame) -> DataFrame:
    return refs.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc"))


@dataclass
class LineStore:
    refs: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int
    min_docs: int = MIN_DOCS
    min_chars: int = MIN_CHARS

    @classmethod
    def create(cls, docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> LineStore:
        refs = written(references(docs, min_chars))
        counts = written(_counted(refs))
        repeated = counts.filter(F.col("n_docs") >= min_docs)
        return cls(refs, counts, None, max(1, -(-repeated.count() // SHARD_KEYS)), min_docs, min_chars)._laid_out()

    def _laid_out(self) -> LineStore:
        """With all filters made from the exact counts."""
        self.filters = self.counts.sparkSession.createDataFrame([], "shard int, filter binary")
        self.filters = self._refiltered(self.counts.filter(F.col("n_docs") >= self.min_docs).select("h1", "h2", F.lit(1).alias("sign")))
        return self

    def _shard(self) -> F.Column:
        return F.pmod("h1", F.lit(self.shards)).cast("int")

    def _refiltered(self, changes: DataFrame) -> DataFrame:
        """The filters after `changes` (h1, h2, sign): 1 to put a key in, -1 to take it out."""

        def change(key, held: pa.Table, rows: pa.Table) -> pa.Table:
            cuckoo = Cuckoo.from_bytes(held.column("filter")[0].as_py()) if held.num_rows else Cuckoo(SHARD_KEYS)
            hashes, sign = rows.column("h2").to_numpy(), rows.column("sign").to_numpy()
            order = np.argsort(hashes, kind="stable")
            hashes, sign = hashes[order], sign[order]
            cuckoo.delete(hashes[sign < 0])
            cuckoo.insert(hashes[sign > 0])
            return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "filter": pa.array([cuckoo.to_bytes()], pa.binary())})

        changed = changes.withColumn("shard", self._shard()).groupBy("shard")
        return written(self.filters.groupBy("shard").cogroup(changed).applyInArrow(change, "shard int, filter binary"))

    def _moved(self, fresh: DataFrame, touched: DataFrame) -> LineStore:
        """With the counts of the touched keys replaced by `fresh`, and the filters brought after them."""
        old = self.counts.join(touched, ["h1", "h2"], "left_semi").select("h1", "h2", F.col("n_docs").alias("was"))
        now = touched.join(fresh, ["h1", "h2"], "left").join(old, ["h1", "h2"], "left")
        is_in, was_in = F.coalesce("n_docs", F.lit(0)) >= self.min_docs, F.coalesce("was", F.lit(0)) >= self.min_docs
        changes = now.filter(is_in != was_in).select("h1", "h2", F.when(is_in, 1).otherwise(-1).alias("sign"))
        counts = written(self.counts.join(touched, ["h1", "h2"], "left_anti").unionByName(fresh))
        repeated = counts.filter(F.col("n_docs") >= self.min_docs).count()
        if repeated > 2 * SHARD_KEYS * self.shards:
            return LineStore(self.refs, counts, None, -(-repeated // SHARD_KEYS), self.min_docs, self.min_chars)._laid_out()
        return LineStore(self.refs, counts, self._refiltered(changes), self.shards, self.min_docs, self.min_chars)

    def insert(self, docs: DataFrame) -> LineStore:
        """The store with these documents added."""
        added = written(references(docs, self.min_chars))
        delta = written(_counted(added))
        touched = delta.select("h1", "h2")
        both = self.counts.join(touched, ["h1", "h2"], "left_semi").unionByName(delta)
        fresh = written(both.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc")))
        store = self._moved(fresh, touched)
        store.refs = written(self.refs.unionByName(added))
        return store

    def delete(self, ids: DataFrame) -> LineStore:
        """The store without the documents whose doc_id is in `ids`."""
        gone = ids.select(F.col("doc_id").cast("long")).distinct()
        touched = written(self.refs.join(gone, "doc_id", "left_semi").select("h1", "h2").distinct())
        refs = written(self.refs.join(gone, "doc_id", "left_anti").select("h1", "h2", "doc_id", "text_key"))
        fresh = written(_counted(refs.join(touched, ["h1", "h2"], "left_semi")))
        store = self._moved(fresh, touched)
        store.refs = refs
        return store

    def probe(self, refs: DataFrame) -> DataFrame:
        """Those of `refs` whose key the filters hold: all repeated keys, and a few others."""

        def ask(_, held: pa.Table, rows: pa.Table) -> pa.Table:
            if not held.num_rows or not rows.num_rows:
                return rows.select(["h1", "h2", "doc_id", "text_key"]).slice(0, 0)
            hit = Cuckoo.from_bytes(held.column("filter")[0].as_py()).contains(rows.column("h2").to_numpy())
            return rows.select(["h1", "h2", "doc_id", "text_key"]).filter(pa.array(hit))

        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        filters = self.filters.withColumn("salt", salts).groupBy("shard", "salt")
        salted = refs.withColumns({"shard": self._shard(), "salt": F.pmod(F.xxhash64("doc_id", "text_key", "h2"), F.lit(SALTS)).cast("int")}).groupBy("shard", "salt")
        return filters.cogroup(salted).applyInArrow(ask, _REFS)

    def drops(self, refs: DataFrame) -> DataFrame:
        """(doc_id, text_key, drop): the keys that each document loses. Documents that lose none are left out; rows of one id meet only where their texts are equal."""
        exact = self.counts.filter(F.col("n_docs") >= self.min_docs)
        lost = self.probe(refs).join(exact, ["h1", "h2"]).filter(~F.col("doc_id").eqNullSafe(F.col("last_doc")))
        return lost.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("h1", "h2")).alias("drop"))

    def apply(self, docs: DataFrame, refs: DataFrame | None = None) -> DataFrame:
        """(doc_id, text, n_lines, n_dropped) with the kept text. refs: those of docs, where they are at hand."""
        drops = self.drops(references(docs, self.min_chars) if refs is None else refs).withColumnsRenamed({"doc_id": "drop_id", "text_key": "drop_key"})
        rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_key"))
        both = rows.join(drops, F.col("doc_id").eqNullSafe(F.col("drop_id")) & (F.col("text_key") == F.col("drop_key")), "left").select("doc_id", "text", "drop")
        min_chars = self.min_chars

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts, lines, dropped = [], [], []
                for text, drop in zip(batch.column("text"), batch.column("drop"), strict=True):
                    data = (text.as_py() or "").encode("utf-8", "replace").split(b"\n")
                    gone = {np.array([x["h1"], x["h2"]], np.int64).tobytes() for x in drop.as_py() or ()}
                    kept = data if not gone else [x for x in data if (key := line_key(x, min_chars)) is None or xxhash.xxh3_128_digest(key) not in gone]
                    texts.append(b"\n".join(kept).decode("utf-8"))
                    lines.append(len(data))
                    dropped.append(len(data) - len(kept))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], ["doc_id", "text", "n_lines", "n_dropped"])

        return both.mapInArrow(keep, "doc_id long, text string, n_lines long, n_dropped long")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    store = LineStore.create(docs)
    return store.apply(docs, store.refs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
OP4_SQL = f"""
WITH raw AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (SELECT r, doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM raw),
keyed AS (SELECT *, translate(trim(line, {_WS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
counts AS (SELECT key, count(DISTINCT r) AS n, max(doc_id) AS last_doc FROM keyed WHERE length(key) >= {MIN_CHARS} GROUP BY key),
kept AS (SELECT k.*, (c.n IS NULL OR c.n < {MIN_DOCS} OR c.last_doc IS NOT DISTINCT FROM k.doc_id) AS stays
         FROM keyed k LEFT JOIN counts c ON k.key = c.key AND length(k.key) >= {MIN_CHARS})
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE NOT stays)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE stays), '')) AS kept_sha256
FROM kept GROUP BY r, doc_id
"""
