"""Benchmark decontamination by a distributed positional inverted index.

Training documents are cut into blocks of about BLOCK_BYTES; each block is one row of the index: its distinct terms (sorted
64-bit hashes of lower-cased words), their posting lists of token positions, and where each document's positions begin. The
index is split by documents, not by terms: a search reads each block by itself, the lists never move, and a term that is in
every document is no larger a list than the block.

A search turns every test item into phrases of WINDOW consecutive words (one shorter phrase where an item has fewer). In a
block a phrase is followed up only if all its terms are there; its lists are then intersected from the rarest term on, each
list moved back by its term's offset in the phrase, so that what is left are the phrase's first positions. Between documents
one position stays free, so no phrase spans two. With a `spread` the search is by proximity: it finds the places where all words of
a phrase, each as often as the phrase has it, lie in any order within `spread` times the phrase's length in one document.

How phrases reach the blocks: the words of a test set of at most LOT_WORDS words (8 bytes each) are broadcast, and a task makes the
phrases itself. A larger test set never passes through the driver: its phrases stay in a table, each finds its rarest term by
the terms' counts over all blocks, goes to the blocks that hold that term and no others, and a block's phrases are searched in lots of
about LOT_PHRASES, each a task.

Defined results: a null or empty text has no words, an item without words no phrases; equal items are each reported; equal
rows of documents are rows of the result each; null ids are kept (a null item_id is left out of the list of items); an empty
table gives no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilnwork.llm.shared import table, written
from kilnwork.llm.words import blocks, word_hashes, words_by_text

WINDOW = 10
#: By proximity a phrase's words lie within so many times its length.
SPREAD = 2
BLOCK_BYTES = 4 << 20
#: The most words of a test set that is broadcast (8 bytes a word), and the phrases in a lot of a larger one.
LOT_WORDS, LOT_PHRASES = 1_000_000, 1_000_000

_INDEX = "block long, doc_ids binary, nulls binary, begins binary, terms binary, lists binary, positions binary"
_HIT = "struct<item_id: long, start: long, words: long>"
_HITS = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("words", pa.int64())]))


def build_block(data: list[bytes]) -> dict[str, np.ndarray]:
    """The index of some texts: position p of a document d is begins[d] + p; begins has one place more than documents."""
    hashes, starts = words_by_text(data)
    counts = np.diff(starts)
    begins = np.concatenate([[0], np.cumsum(counts + 1)])
    positions = np.arange(len(hashes)) + np.repeat(np.arange(len(data)), counts)
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
    return {"begins": begins.astype(np.int64), "terms": ordered[first], "lists": np.append(first, len(ordered)).astype(np.int64), "positions": positions[order].astype(np.uint32)}


def build_index(docs: DataFrame) -> DataFrame:
    """One row a block of (doc_id, text): its number and the stored postings of all tokens of all documents."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids = batch.column("doc_id")
            for first, data in blocks((x.as_py() for x in batch.column("text")), BLOCK_BYTES):
                own = ids.slice(first, len(data))
                block = {"doc_ids": own.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), "nulls": own.is_null().to_numpy(zero_copy_only=False)} | build_block(data)
                yield pa.RecordBatch.from_arrays([pa.array([number]), *(pa.array([x.tobytes()], pa.binary()) for x in block.values())], ["block", *block])
                number += 1

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, _INDEX)


class Block:
    """One row of the index, its lists as views."""

    def __init__(self, row: dict):
        self.doc_ids, self.begins = np.frombuffer(row["doc_ids"], np.int64), np.frombuffer(row["begins"], np.int64)
        self.terms, self.lists = np.frombuffer(row["terms"], np.uint64), np.frombuffer(row["lists"], np.int64)
        self.positions, self.nulls = np.frombuffer(row["positions"], np.uint32), np.frombuffer(row["nulls"], bool)

    def of(self, term: int) -> np.ndarray:
        return self.positions[self.lists[term] : self.lists[term + 1]].astype(np.int64)

    def find(self, words: np.ndarray) -> np.ndarray:
        """The ordinals of these terms in the block, -1 for those that it lacks."""
        if not len(self.terms):
            return np.full(words.shape, -1)
        at = np.minimum(np.searchsorted(self.terms, words), len(self.terms) - 1)
        return np.where(self.terms[at] == words, at, -1)

    def phrase(self, terms: np.ndarray) -> np.ndarray:
        """First positions of all occurrences of a phrase, given by its terms' ordinals: lists intersected from the rarest term on."""
        order = np.argsort(self.lists[terms + 1] - self.lists[terms], kind="stable")
        starts = self.of(terms[order[0]]) - order[0]
        for k in order[1:]:
            if not len(starts):
                break
            held = self.of(terms[k]) - k
            at = np.searchsorted(held, starts)
            starts = starts[(at < len(held)) & (held[np.minimum(at, len(held) - 1)] == starts)]
        return starts

    def near(self, terms: np.ndarray, span: int) -> np.ndarray:
        """Positions of the rarest term around which all terms, each as often as given, lie within `span` positions of one document, in any order."""
        terms, need = np.unique(terms, return_counts=True)
        order = np.argsort(self.lists[terms + 1] - self.lists[terms], kind="stable")
        anchor = self.of(terms[order[0]])
        doc = np.searchsorted(self.begins, anchor, "right") - 1
        low, last = np.maximum(anchor - span + 1, self.begins[doc]), self.begins[doc + 1] - 1
        lists = []
        for k in order:  # most anchors lack a term in all windows that hold them
            lists.append((self.of(terms[k]), need[k] - 1))
            left = self._within(*lists[-1], low, np.minimum(anchor + span, last))
            anchor, low, last = anchor[left], low[left], last[left]
            if not len(anchor):
                return anchor
        found = np.zeros(len(anchor), bool)
        for shift in range(span):  # windows [start, start + span) that hold the anchor
            start = low + shift
            inside = start <= anchor
            for held, more in lists:
                inside &= self._within(held, more, start, np.minimum(start + span, last))
            found |= inside
        return anchor[found]

    @staticmethod
    def _within(held: np.ndarray, more: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Whether a list has more + 1 positions in [start, end)."""
        at = np.searchsorted(held, start) + more
        return (at < len(held)) & (held[np.minimum(at, len(held) - 1)] < end)


def phrases(words: np.ndarray, starts: np.ndarray, window: int = WINDOW) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By phrase length: the phrases of items, given by their words one after another and where each one's begin, and the ordinal of the item that each is of."""
    out: dict[int, list] = {}
    for n, (a, b) in enumerate(zip(starts[:-1], starts[1:], strict=True)):
        if width := int(min(window, b - a)):
            rows = np.lib.stride_tricks.sliding_window_view(words[a:b], width)
            out.setdefault(width, []).append((rows, np.full(len(rows), n)))
    return {w: (np.concatenate([x[0] for x in v]), np.concatenate([x[1] for x in v])) for w, v in out.items()}


def hits_in(block: Block, by_width: dict[int, tuple[np.ndarray, np.ndarray]], spread: int | None) -> Iterator[tuple[int, int, int, int]]:
    """(document's ordinal, item's ordinal, start, words) of all occurrences in a block; by proximity the places of near(), one word each."""
    for width, (rows, owner) in by_width.items():
        terms = block.find(rows)
        for k in np.flatnonzero((terms >= 0).all(1)):
            for start in block.near(terms[k], width * spread) if spread else block.phrase(terms[k]):
                doc = int(np.searchsorted(block.begins, start, "right")) - 1
                yield doc, int(owner[k]), int(start - block.begins[doc]), 1 if spread else width


def search(index: DataFrame, items: DataFrame, window: int = WINDOW, spread: int | None = None) -> DataFrame:
    """(doc_id, n_words, hits: array of (item_id, start, words)) for every document of a written index: where phrases of the items occur."""
    hashed = written(_hashed(items))
    total = hashed.agg(F.sum("n")).first()[0] or 0
    return _by_broadcast(index, hashed, window, spread) if total <= LOT_WORDS else _by_rarest(index, hashed, window, spread)


def _hashed(items: DataFrame) -> DataFrame:
    """(item_id, words, n): the words of every item that has any, as hashes."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [word_hashes((x.as_py() or "").encode("utf-8", "replace"))[0] for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array([x.tobytes() for x in own], pa.binary()), pa.array([len(x) for x in own], pa.int64())], ["item_id", "words", "n"])

    return items.select(F.col("item_id").cast("long"), "text").mapInArrow(scan, "item_id long, words binary, n long").filter("n > 0")


def _by_broadcast(index: DataFrame, hashed: DataFrame, window: int, spread: int | None) -> DataFrame:
    rows = hashed.select("item_id", "words").collect()  # at most LOT_WORDS words
    words = np.frombuffer(b"".join(r["words"] for r in rows), np.uint64)
    starts = np.cumsum([0] + [len(r["words"]) // 8 for r in rows])
    asked = index.sparkSession.sparkContext.broadcast((words, starts, [r["item_id"] for r in rows]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, starts, ids = asked.value
        by_width = phrases(words, starts, window)
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row)
                hits: list[list] = [[] for _ in block.doc_ids]
                for doc, item, start, n in hits_in(block, by_width, spread):
                    hits[doc].append({"item_id": ids[item], "start": start, "words": n})
                yield pa.RecordBatch.from_arrays([pa.array(block.doc_ids, mask=block.nulls), pa.array(np.diff(block.begins) - 1, pa.int64()), pa.array(hits, _HITS)], ["doc_id", "n_words", "hits"])

    return index.drop("block").mapInArrow(scan, f"doc_id long, n_words long, hits array<{_HIT}>")


def _by_rarest(index: DataFrame, hashed: DataFrame, window: int, spread: int | None) -> DataFrame:
    """The search for test sets of any size, without the driver: each phrase meets the blocks that hold its rarest term."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, data in zip(batch.column("item_id"), batch.column("words"), strict=True):
                own = np.frombuffer(data.as_py(), np.uint64)
                rows = np.lib.stride_tricks.sliding_window_view(own, min(window, len(own)))
                yield pa.RecordBatch.from_arrays([pa.array([item.as_py()] * len(rows), pa.int64()), pa.array(rows.view(np.int64).tolist(), pa.list_(pa.int64()))], ["item_id", "words"])

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                terms, lists = np.frombuffer(row["terms"], np.int64), np.frombuffer(row["lists"], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(np.full(len(terms), row["block"])), pa.array(np.diff(lists))], ["term", "block", "n"])

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                begins, nulls = np.frombuffer(row["begins"], np.int64), np.frombuffer(row["nulls"], bool)
                n = len(nulls)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, row["block"])), pa.array(np.arange(n)), pa.array(np.frombuffer(row["doc_ids"], np.int64), mask=nulls), pa.array(np.diff(begins) - 1)], ["block", "place", "doc_id", "n_words"]
                )

    asked = written(hashed.mapInArrow(cut, "item_id long, words array<long>").withColumn("phrase", F.monotonically_increasing_id()))
    lots = max(1, -(-asked.count() // LOT_PHRASES))
    wanted = asked.select("phrase", F.explode("words").alias("term")).distinct()
    held = index.select("block", "terms", "lists").mapInArrow(tell, "term long, block long, n long")
    held = written(held.join(wanted.select("term").distinct(), "term", "left_semi"))
    counts = held.groupBy("term").agg(F.sum("n").alias("n"))
    # a phrase with a term that no block holds occurs nowhere: the left join's null counts as 0 and is taken out
    rarest = wanted.join(counts, "term", "left").groupBy("phrase").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term")).alias("least")).filter("least.n > 0")
    to_ask = rarest.select("phrase", F.col("least.term").alias("term")).join(held.select("term", "block"), "term").join(asked, "phrase")
    to_ask = written(to_ask.select("block", F.pmod(F.xxhash64("phrase"), F.lit(lots)).alias("lot"), "item_id", "words"))
    rows = index.join(to_ask.select("block", F.col("lot").alias("lot")).distinct(), "block")

    def look(key, held: pa.Table, lot: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if held.num_rows and lot.num_rows:
            by_width: dict[int, list] = {}
            for n, words in enumerate(lot.column("words").to_pylist()):
                by_width.setdefault(len(words), []).append((words, n))
            sorted_out = {w: (np.array([x[0] for x in v], np.int64).view(np.uint64), np.array([x[1] for x in v])) for w, v in by_width.items()}
            ids = lot.column("item_id").to_pylist()
            out = [(key[0].as_py(), doc, ids[item], start, n) for doc, item, start, n in hits_in(Block(held.to_pylist()[0]), sorted_out, spread)]
        columns = list(zip(*out, strict=True)) or [()] * 5
        return pa.table({c: pa.array(x, pa.int64()) for c, x in zip(("block", "place", "item_id", "start", "words"), columns, strict=True)})

    hits = rows.groupBy("block", "lot").cogroup(to_ask.groupBy("block", "lot")).applyInArrow(look, "block long, place long, item_id long, start long, words long")
    hits = hits.groupBy("block", "place").agg(F.collect_list(F.struct("item_id", "start", "words")).alias("hits"))
    whole = index.select("block", "doc_ids", "nulls", "begins").mapInArrow(documents, "block long, place long, doc_id long, n_words long")
    return whole.join(hits, ["block", "place"], "left").select("doc_id", "n_words", F.coalesce("hits", F.array().cast(f"array<{_HIT}>")).alias("hits"))


def covered(hits: DataFrame) -> DataFrame:
    """Adds n_hit, the number of words that lie in any hit, and items, the distinct item_ids as sorted strings."""
    spans = F.array_sort(F.transform("hits", lambda h: F.struct(h["start"].alias("a"), (h["start"] + h["words"]).alias("b"))))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    total = F.aggregate(spans, zero, lambda s, x: F.struct((s["n"] + F.greatest(x["b"] - F.greatest(x["a"], s["end"]), F.lit(0))).alias("n"), F.greatest(s["end"], x["b"]).alias("end")))
    items = F.array_sort(F.array_distinct(F.filter(F.transform("hits", lambda h: h["item_id"].cast("string")), lambda x: x.isNotNull())))
    return hits.withColumns({"n_hit": total["n"], "items": items})


def contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, items) of every document, through a stored index."""
    return covered(search(written(build_index(docs)), items, window)).drop("hits")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def proximate(docs: DataFrame, items: DataFrame, window: int = WINDOW, spread: int = SPREAD) -> DataFrame:
    """(doc_id, n_words, n_near, items) of every document, through a stored index: n_near places of the rarest word of a phrase whose words lie near each other."""
    return covered(search(written(build_index(docs)), items, window, spread)).drop("hits").withColumnRenamed("n_hit", "n_near")


def op3_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = proximate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_near", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_near") > 0).alias("near"))


_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
OP3_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
items AS (SELECT item_id, w, least({WINDOW}, len(w)) AS n FROM b WHERE len(w) > 0),
wins AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM items, unnest(range(1, len(w) - n + 2)) AS t(i)),
places AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM d, (SELECT DISTINCT n FROM items), unnest(range(1, len(w) - n + 2)) AS t(i)),
hits AS (SELECT p.doc_id, p.i, p.n, x.item_id FROM places p JOIN wins x ON p.g = x.g AND p.n = x.n),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS sha FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
"""
