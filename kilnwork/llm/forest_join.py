"""N-gram Jaccard join by a MinHash LSH forest, with exact verification.

Texts are sets of SHINGLE-word shingles. Equal sets make one class with a representative (its smallest row, see numbered());
classes, not documents, are compared. Each of TREES trees gives a class a label of DEPTH min-hashes, 16 bits each.

The forest: a tree's labels lie sorted in range partitions, so each node of its prefix trie is a run of neighbours. A label's
matched prefix is the longest that it shares with a neighbour. Labels whose matched prefix is shorter than SHALLOWEST words of any
walk (shallowest(), 4 at 0.8) leave the walk there; nearly all do.

The walk: each class starts with the whole label in every tree and shortens its prefixes, tree by tree and level by level, trees
whose nodes are less crowded first, until a pair at the least similarity that the class's size allows is found with a
probability of RECALL. So classes stop at different depths, in different trees: crowded nodes are looked at under longer prefixes, and
classes of few shingles, whose links must be closer, stop early or (under four shingles: equal sets alone reach 0.8) never
walk. Crowds of under NODE_BLOCK classes count alike, so that a class's own links do not sway its walk. Two classes are
candidates if they share the prefix at which either of them stops.

A node with many classes is cut into blocks, and pairs of blocks are looked at by tasks of their own. Tasks give no pairs out: pairs
whose signatures agree on fewer hashes than least_agreement() says, or whose sizes alone rule the threshold out, are let go (at the
threshold the chance is below 1e-9, part of what RECALL allows), and the others' spanning forest joins candidates to groups. In a
group all pairs of classes are compared by their whole shingle sets, in blocks again; each class gets the number of documents
that it is linked to, and the verified links' spanning forests give the final classes.

Defined results: a null or empty text, or one without words, links with nothing; equal texts are links of each other; equal
doc_ids are rows of their own, each judged by its own text; a null doc_id has class null and is linked by no one; an empty table gives
no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import ceil, comb, floor, log

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilnwork.llm.components import Forest, components
from kilnwork.llm.shared import numbered, table, tidied, written
from kilnwork.llm.words import blocks, mix, shingles, words_by_text

SHINGLE, THRESHOLD = 5, 0.8
TREES, DEPTH, RECALL = 24, 6, 0.99999
#: Classes in a block of a tree's node; classes and bytes of shingles in a block of a group, at most.
NODE_BLOCK, GROUP_BLOCK, GROUP_BYTES = 1024, 1024, 16 << 20
_U = np.uint64
_TURN = mix(np.arange(1, TREES * DEPTH + 1, dtype=_U) * _U(0xA0761D6478BD642F))
_TIMES = mix(np.arange(1, TREES * DEPTH + 1, dtype=_U) * _U(0xE7037ED1A0B428DB)) | _U(1)
_SKETCH = "doc_id long, k1 long, k2 long, size int, signature binary"


def least_similarity(size: int, threshold: float = THRESHOLD) -> float:
    """The least similarity, at the threshold or above, that a set of `size` elements can have with a different set; 1 if there is none."""
    least = 1.0
    for other in range(ceil(threshold * size - 1e-9), floor(size / threshold + 1e-9) + 1):
        common = ceil(threshold * (size + other) / (1 + threshold) - 1e-9)
        if common <= min(size, other) and common < size + other - common:
            least = min(least, common / (size + other - common))
    return least


@cache
def walk(similarity: float, recall: float = RECALL, trees: int = TREES, depth: int = DEPTH) -> tuple[int, int]:
    """(level, n): how far prefixes must be shortened to find a pair of this similarity with probability `recall`: n trees stop at `level`, the others a level deeper.

    Level 0 is a node with everything in it, which is never needed: where even all trees at level 1 do not suffice the walk ends there.
    """
    if similarity >= 1:
        return depth, trees  # equal sets are one class: nothing is to be found
    allowed = log(1 - recall) if recall < 1 else float("-inf")
    miss = lambda level: log(1 - similarity**level)
    for level in range(depth, 0, -1):
        for n in range(1, trees + 1):
            if n * miss(level) + (trees - n) * miss(min(level + 1, depth)) <= allowed:
                return level, n
    return 1, trees


def shallowest(threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """The shortest prefix at which any walk stops."""
    return walk(threshold, recall)[0]


def least_agreement(threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """The most hashes, half of all at most, that a pair at the threshold fails to agree on with a probability below 1e-9 or, if less, half of 1 - recall."""
    n, total = TREES * DEPTH, 0.0
    for k in range(n // 2):
        total += comb(n, k) * threshold**k * (1 - threshold) ** (n - k)
        if total > min(1e-9, (1 - recall) / 2):
            return k
    return n // 2


def _minhash(sets: list[np.ndarray]) -> np.ndarray:
    """Rows of TREES * DEPTH min-hashes, 16 bits each; sets must not be empty."""
    firsts = np.cumsum([0] + [len(x) for x in sets[:-1]])
    values = np.concatenate(sets)
    out = np.zeros((len(sets), TREES * DEPTH), np.uint16)
    for k in range(TREES * DEPTH):
        least = np.minimum.reduceat((values ^ _TURN[k]) * _TIMES[k], firsts)
        out[:, k] = (mix(least) >> _U(48)).astype(np.uint16)
    return out


def _sets(batch: pa.RecordBatch) -> Iterator[tuple[int, list[np.ndarray]]]:
    for first, data in blocks(x.as_py() for x in batch.column("text")):
        hashes, starts = words_by_text(data)
        yield first, [shingles(hashes[a:b], SHINGLE) for a, b in zip(starts[:-1], starts[1:], strict=True)]


def sketch(docs: DataFrame) -> DataFrame:
    """(doc_id, k1, k2, size, signature): a 128-bit key of each document's shingle set, its size and its min-hashes; null for no words."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, sets in _sets(batch):
                full = [x for x in sets if len(x)]
                signs = iter(_minhash(full) if full else ())
                rows = [(int(mix(x).sum().view(np.int64)), int(mix(x ^ _TURN[0]).sum().view(np.int64)), len(x), next(signs).tobytes()) if len(x) else (None, None, 0, None) for x in sets]
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(sets)), *(pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True))], ["doc_id", "k1", "k2", "size", "signature"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, _SKETCH)


def tries(classes: DataFrame, least: int) -> DataFrame:
    """(tree, label, rep): the sorted labels of every tree, 2 * DEPTH bytes each, without those that share fewer than `least` hashes with both neighbours.

    The first and last label of a range partition always stay, as their neighbours may lie in another.
    """

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                signature = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint16)
                data = pa.py_buffer(signature.astype(">u2").tobytes())
                n = batch.num_rows * TREES
                offsets = pa.py_buffer(np.arange(0, 2 * DEPTH * (n + 1), 2 * DEPTH, dtype=np.int32).tobytes())
                label = pa.Array.from_buffers(pa.binary(), n, [None, offsets, data])
                tree = pa.array(np.tile(np.arange(TREES, dtype=np.int32), batch.num_rows))
                yield pa.RecordBatch.from_arrays([tree, label, batch.column("rep").take(pa.array(np.repeat(np.arange(batch.num_rows), TREES)))], ["tree", "label", "rep"])

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, before = None, None  # the last row, not told yet, and whether it matched the one before it
        for batch in batches:
            rows = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            if not rows.num_rows:
                continue
            prefix = np.frombuffer(b"".join(rows.column("label").to_pylist()), ">u2").reshape(-1, DEPTH)[:, :least]
            tree = rows.column("tree").to_numpy()
            same = (prefix[1:] == prefix[:-1]).all(1) & (tree[1:] == tree[:-1])
            first = True if held is None else before  # the partition's first row stays
            stays = np.concatenate([[first], same[:-1] | same[1:]]) if len(same) else np.zeros(0, bool)
            if len(same):
                stays[0] |= same[0]
                yield from rows.slice(0, rows.num_rows - 1).filter(pa.array(stays)).to_batches()
            before = bool(same[-1]) if len(same) else first
            held = rows.slice(rows.num_rows - 1).combine_chunks().to_batches()[0]
        if held is not None:
            yield held

    schema = "tree int, label binary, rep long"
    ordered = classes.select("rep", "signature").mapInArrow(labelled, schema).repartitionByRange("tree", "label", "rep").sortWithinPartitions("tree", "label", "rep")
    return ordered.mapInArrow(matched, schema)


def stops(classes: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(tree, label, rep, depth): where each class's walk stops in each tree, of the trees in which it meets anyone at the shortest prefix of all."""
    least = shallowest(threshold, recall)
    labels = written(tries(classes, least)).withColumn("node", F.col("label").substr(1, 2 * least))
    crowds = labels.groupBy("tree", "node").agg(F.count("*").alias("crowd")).filter("crowd > 1")
    met = written(labels.join(crowds, ["tree", "node"]).select("tree", "label", "rep", "crowd"))
    plan = met.groupBy("rep").agg(F.collect_list(F.struct("tree", "crowd")).alias("met")).join(classes.select("rep", "size"), "rep")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            met = batch.column("met")
            flat, starts = met.flatten(), np.concatenate([[0], np.cumsum(pa.compute.list_value_length(met).to_numpy(zero_copy_only=False))])
            owner = np.repeat(np.arange(n), np.diff(starts))
            tree, crowd = flat.field("tree").to_numpy(), flat.field("crowd").to_numpy()
            reps = batch.column("rep").to_numpy()
            # crowds by powers of two above a block; among equals an order of the class's own
            rank = np.zeros((n, TREES))
            rank[owner, tree] = np.floor(np.log2(np.maximum(crowd, NODE_BLOCK) / NODE_BLOCK))
            draw = mix(reps.astype(np.int64).view(_U)[:, None] * _U(TREES) + np.arange(TREES, dtype=_U)[None, :])
            place = np.argsort(np.lexsort((draw, rank), axis=1), axis=1)
            nearest = [_least(size, threshold) for size in batch.column("size").to_pylist()]
            level = np.array([walk(x, recall) for x in nearest])
            depth = np.minimum(level[:, :1] + (place >= level[:, 1:]), DEPTH)
            walks = (np.array(nearest) < 1)[owner]
            yield pa.RecordBatch.from_arrays([pa.array(reps[owner[walks]]), pa.array(tree[walks]), pa.array(depth[owner, tree][walks].astype(np.int32))], ["rep", "tree", "depth"])

    chosen = plan.select("rep", "met", "size").mapInArrow(choose, "rep long, tree int, depth int")
    return met.select("tree", "label", "rep").join(chosen, ["rep", "tree"])


@cache
def _least(size: int, threshold: float) -> float:
    return least_similarity(size, threshold) if size < 200 else threshold


def dealt(rows: DataFrame, parts: F.Column) -> DataFrame:
    """Deals a key's rows to pairs (i <= j) of `parts` blocks: adds i, j and mine, the row's own block."""
    rows = rows.withColumn("_n", parts.cast("int")).withColumn("mine", F.pmod(F.xxhash64("rep", F.lit(3)), F.col("_n")).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return rows.withColumns({"i": F.least("mine", "_other"), "j": F.greatest("mine", "_other")}).drop("_n", "_other")


def _edges_of(reps: np.ndarray, pairs: list[tuple[int, int]]) -> pa.Table:
    at = np.array(pairs, np.int64).reshape(-1, 2)
    return pa.table({"a": pa.array(reps[at[:, 0]], pa.int64()), "b": pa.array(reps[at[:, 1]], pa.int64())})


def candidate_edges(classes: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(a, b): spanning forests of the pairs of classes that share the prefix at which one of them stops and may reach the threshold."""
    least = least_agreement(threshold, recall)
    walked = written(stops(classes, threshold, recall))
    # a class is in the nodes of all prefixes from its own down to the shortest: it asks at its own and is asked at the others
    levels = F.explode(F.sequence(F.lit(shallowest(threshold, recall)), F.col("depth"))).alias("level")
    nodes = walked.select("rep", "tree", "label", "depth", levels).withColumn("node", F.expr("substring(label, 1, 2 * level)"))
    nodes = nodes.withColumn("asks", F.col("level") == F.col("depth"))
    shared = nodes.groupBy("tree", "level", "node").agg(F.count("*").alias("members"), F.max("asks").alias("asked")).filter("members > 1 AND asked")
    members = nodes.join(shared.drop("asked"), ["tree", "level", "node"]).join(classes.select("rep", "size", "signature"), "rep")

    def look(key, rows):
        reps, size = rows.column("rep").to_numpy(), rows.column("size").to_numpy()
        mine = rows.column("mine").to_numpy()
        signature = np.frombuffer(b"".join(rows.column("signature").to_pylist()), np.uint16).reshape(len(reps), -1)
        asks = rows.column("asks").to_numpy(zero_copy_only=False)
        i, j = key[3].as_py(), key[4].as_py()
        forest, edges = Forest(len(reps)), []
        for x in np.flatnonzero(mine == i):
            later = (mine == j) & (np.minimum(size, size[x]) >= threshold * np.maximum(size, size[x]) - 1e-9)
            if i == j:
                later[: x + 1] = False
            later = np.flatnonzero(later if asks[x] else later & asks)
            if len(later):
                near = later[(signature[later] == signature[x]).sum(1) >= least]
                edges += forest.link(np.full(len(near), x), near)
        return _edges_of(reps, edges)

    return dealt(members.drop("label", "depth"), F.ceil(F.col("members") / F.lit(float(NODE_BLOCK)))).groupBy("tree", "level", "node", "i", "j").applyInArrow(look, "a long, b long")


def _verify(threshold: float):
    def verify(key, rows):
        """Of the pairs of two blocks of a group: (kind 0) links by class, (kind 1) spanning forest of the links."""
        reps, many, mine = (rows.column(c).to_numpy() for c in ("rep", "copies", "mine"))
        i, j = key[1].as_py(), key[2].as_py()
        sets = [np.frombuffer(x.as_py(), _U) for x in rows.column("shingles")]
        sizes = np.array([len(x) for x in sets])
        every, place = np.unique(np.concatenate(sets), return_inverse=True)
        firsts = np.cumsum(sizes) - sizes
        flags = np.zeros(len(every), np.int32)
        links, forest, edges = np.zeros(len(reps), np.int64), Forest(len(reps)), []
        for x in np.flatnonzero(mine == i):
            own = place[firsts[x] : firsts[x] + sizes[x]]
            flags[own] = 1
            common = np.add.reduceat(flags[place], firsts)
            flags[own] = 0
            near = common >= threshold * (sizes + sizes[x] - common) - 1e-9
            near &= (mine == j) & ((np.arange(len(reps)) > x) if i == j else True)
            at = np.flatnonzero(near)
            links[x] += many[at].sum()
            links[at] += many[x]
            edges += forest.link(np.full(len(at), x), at)
        got = links > 0
        found = _edges_of(reps, edges)
        return pa.table({"a": pa.concat_arrays([pa.array(reps[got], pa.int64()), found.column("a").combine_chunks()]), "b": pa.concat_arrays([pa.array(links[got], pa.int64()), found.column("b").combine_chunks()]), "kind": pa.array([0] * int(got.sum()) + [1] * found.num_rows, pa.int32())})

    return verify


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(doc_id, class_id, n_links): the smallest doc_id reachable by links of similarity >= threshold, and the number of other rows linked directly."""
    rows, by_number = numbered(docs.select(F.col("doc_id").cast("long"), "text"))
    found = row_classes(rows, threshold, recall)
    if not by_number:
        return found.select(F.col("row").alias("doc_id"), F.col("class_row").alias("class_id"), "n_links")
    named = written(found.join(rows.select(F.col("_row").alias("row"), "doc_id"), "row"))
    least = named.groupBy("class_row").agg(F.min("doc_id").alias("class_id"))
    nobody = rows.filter("doc_id IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return named.join(least, "class_row").select("doc_id", "class_id", "n_links").unionByName(nobody)


def row_classes(rows: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(row, class_row, n_links) of rows as numbered() gives them, without those of a null doc_id: the smallest row of each one's class, and the number of other rows linked directly."""
    with tidied() as keep:
        docs = rows.filter("doc_id IS NOT NULL").select(F.col("_row").alias("doc_id"), "text")
        sketches = keep(written(sketch(docs)))
        classes = written(
            sketches.filter("k1 IS NOT NULL").groupBy("k1", "k2", "size").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("signature").alias("signature"))
        )
        groups = components(candidate_edges(classes, threshold, recall)).select(F.col("node").alias("rep"), F.col("component").alias("team"))
        groups = written(groups.join(classes.select("rep", "copies", "size"), "rep"))
        # blocks of a group: so many that neither their classes nor their shingles are too many
        parts = F.greatest(F.ceil(F.count("*") / F.lit(float(GROUP_BLOCK))), F.ceil(F.sum("size") * F.lit(8.0) / F.lit(float(GROUP_BYTES))))
        teams = groups.groupBy("team").agg(parts.alias("parts"))

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for first, sets in _sets(batch):
                    rest = [batch.column(c).slice(first, len(sets)) for c in ("rep", "team", "copies", "parts")]
                    yield pa.RecordBatch.from_arrays([*rest, pa.array([x.tobytes() for x in sets], pa.binary())], ["rep", "team", "copies", "parts", "shingles"])

        # texts meet the groups by a sort-merge join at every size: the groups grow with the documents
        texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").hint("merge")
        one_text = texts.join(groups.drop("size").join(teams, "team"), "rep")
        members = one_text.mapInArrow(whole, "rep long, team long, copies long, parts long, shingles binary")
        found = written(dealt(members, F.col("parts")).groupBy("team", "i", "j").applyInArrow(_verify(threshold), "a long, b long, kind int"))
        links = found.filter("kind = 0").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("links"))
        joined = components(found.filter("kind = 1").select("a", "b")).withColumnRenamed("node", "rep")
        per_class = keep(written(classes.join(links, "rep", "left").join(joined, "rep", "left").select("k1", "k2", "size", F.coalesce("component", "rep").alias("class"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))))
    rest = sketches.filter("k1 IS NULL").select(F.col("doc_id").alias("row"), F.col("doc_id").alias("class_row"), F.lit(0).cast("long").alias("n_links"))
    return sketches.filter("k1 IS NOT NULL").select("doc_id", "k1", "k2", "size").join(per_class, ["k1", "k2", "size"]).select(F.col("doc_id").alias("row"), F.col("class").alias("class_row"), F.col("links").alias("n_links")).unionByName(rest)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents")).withColumn("kept", F.col("doc_id") == F.col("class_id"))


_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
OP9_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least({SHINGLE}, len(w)) - 1], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - {SHINGLE} + 1, 1) + 1)) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE c >= {THRESHOLD} * (p.n + q.n - c) - 1e-9),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, c.class_id, coalesce(k.n_links, 0)::BIGINT AS n_links, d.doc_id = c.class_id AS kept
FROM d JOIN (SELECT a, min(b) AS class_id FROM reach GROUP BY a) c ON c.a = d.doc_id
LEFT JOIN (SELECT a, count(*) AS n_links FROM links GROUP BY a) k ON k.a = d.doc_id
"""
