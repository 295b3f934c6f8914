"""Embedding near-dedup by cover trees and dual traversal: all pairs of one label with cosine >= the threshold.

Of equal vectors with equal labels one row stands for all (with the number of copies). On the unit sphere a cosine of c is a
distance of sqrt(2 - 2c), so links are the pairs within a radius. The work is dealt by the top of a cover tree:

- Every label gets seeded centres, one for CELL vectors (in all labels together at most CENTRE_FLOATS numbers, 16 MB, are broadcast), and
  every vector belongs to the cell of its nearest centre, which has a covering radius.
- A vector visits a cell with a smaller number only where a member of it can lie within the radius: where its distance to the cell's
  centre is no more than the covering radius and the radius together, and where the plane half-way between the two centres is
  no farther than the radius. Cells that lie apart never meet.
- A cell with many members or visitors is cut into blocks, and a pair of blocks is a task. So a label or a cell with a third of all
  rows is many tasks.

A task makes one cover tree of each of its two blocks (nested levels with halving radii, each node with its covering radius) and walks
both at once: a pair of nodes is dropped when the distance of its centres less both covering radii exceeds the radius, is
taken whole when the distance and both radii together do not, and otherwise opened. Pairs of single vectors are decided by
their cosine in double precision. Tasks give numbers of links and spanning forests, not pairs. Where all vectors of a label lie
about equally far apart no bound can rule anything out, and the comparisons grow with the square of its distinct vectors.

Defined results: a vector that is null, empty, zero, or that holds null or non-finite components, and any row with a null label, links
with nothing and is its own component; vectors of different lengths are not compared; equal vec_ids are rows of their own, each judged
by its own vector; a null vec_id has component null and is linked by no one; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilnwork.llm.components import Forest, components
from kilnwork.llm.shared import numbered, table, tidied, written

THRESHOLD = 0.93
#: Vectors in a block, vectors for each centre, and the most numbers in the centres of all labels.
BLOCK, CELL, CENTRE_FLOATS = 2048, 1024, 1 << 21
#: Nodes of a cover tree with no more vectors are not divided further.
LEAF = 48
#: More than rounding makes of a distance near 0.
_SLACK = 1e-7


def radius_of(threshold: float) -> float:
    return float(np.sqrt(max(0.0, 2 - 2 * threshold))) + _SLACK


def _distance(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * cosine))


class CoverTree:
    """Nodes over unit vectors, each with a centre that is one of its vectors and a covering radius.

    The vectors of node k are order[first[k]:last[k]]; its children are nodes kids[k] (none for a leaf). The children's centres are more
    than half the node's level radius apart, every vector is within that of its child's centre, and one child keeps the node's centre.
    """

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.x, self.order = x, np.zeros(0, np.int64)
        self.centre, self.reach, self.level, self.first, self.last, self.kids = [], [], [], [], [], []
        if len(x):
            parts: list[np.ndarray] = []
            self._grow(np.arange(len(x)), 0, self._from(0, np.arange(len(x))).max(), leaf, parts, 0)
            self.order = np.concatenate(parts)

    def _from(self, centre: int, rows: np.ndarray) -> np.ndarray:
        return _distance(self.x[rows] @ self.x[centre])

    def _grow(self, rows: np.ndarray, centre: int, level: float, leaf: int, parts: list[np.ndarray], at: int) -> int:
        me = len(self.centre)
        self.centre.append(centre)
        self.reach.append(float(self._from(centre, rows).max()) + _SLACK)
        self.level.append(level)
        self.first.append(at)
        self.last.append(at + len(rows))
        self.kids.append([])
        if len(rows) <= leaf or self.reach[me] <= 2 * _SLACK:
            parts.append(rows)
            return me
        half = min(level, self.reach[me]) / 2
        for own, rest in self._parted(rows, centre, half):
            self.kids[me].append(self._grow(rest, own, half, leaf, parts, at))
            at += len(rest)
        return me

    def _parted(self, rows: np.ndarray, centre: int, half: float) -> list[tuple[int, np.ndarray]]:
        """Centres more than `half` apart, `centre` first, with the vectors nearest to each."""
        chosen, near, owner = [centre], self._from(centre, rows), np.zeros(len(rows), np.int64)
        while True:
            far = int(near.argmax())
            if near[far] <= half:
                break
            distance = self._from(int(rows[far]), rows)
            closer = distance < near
            owner[closer], near[closer] = len(chosen), distance[closer]
            owner[far], near[far] = len(chosen), 0.0
            chosen.append(int(rows[far]))
        by = np.argsort(owner, kind="stable")
        cuts = np.searchsorted(owner[by], np.arange(1, len(chosen)))
        return list(zip(chosen, np.split(rows[by], cuts), strict=True))

    def opened(self, node: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What a node opens to: centres, radii and node numbers of its children; of a leaf its vectors (radius 0, number -1)."""
        if self.kids[node]:
            kids = np.array(self.kids[node])
            return np.array(self.centre)[kids], np.array(self.reach)[kids], kids
        rows = self.order[self.first[node] : self.last[node]]
        return rows, np.zeros(len(rows)), np.full(len(rows), -1)

    def rows(self, node: int) -> np.ndarray:
        return self.order[self.first[node] : self.last[node]]


def dual_pairs(one: CoverTree, two: CoverTree, threshold: float = THRESHOLD) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Yields (rows of one, rows of two, whole): pairs with cosine >= threshold; where `whole`, every row of the one with every row of the other.

    Of a tree with itself every pair comes once, and no row with itself but in a `whole` of equal rows.
    """
    radius = radius_of(threshold)
    sure = radius - 5 * _SLACK
    open_one, open_two = {}, {}
    todo = [(0, 0)] if len(one.x) and len(two.x) else []
    while todo:
        a, b = todo.pop()
        if a not in open_one:
            open_one[a] = one.opened(a)
        if b not in open_two:
            open_two[b] = two.opened(b)
        (left, reach_l, node_l), (right, reach_r, node_r) = open_one[a], open_two[b]
        cosine = one.x[left] @ two.x[right].T
        apart = _distance(cosine)
        reach = reach_l[:, None] + reach_r[None, :]
        single = (node_l < 0)[:, None] & (node_r < 0)[None, :]
        stays = apart - reach <= radius
        if one is two and a == b:
            stays = np.triu(stays) & ~(single & np.eye(len(left), dtype=bool))
        hit = np.argwhere(single & stays & (cosine >= threshold))
        if len(hit):
            yield left[hit[:, 0]], right[hit[:, 1]], False
        if single.all():
            continue
        for i, j in np.argwhere(~single & stays):
            rows_l = one.rows(node_l[i]) if node_l[i] >= 0 else left[i : i + 1]
            rows_r = two.rows(node_r[j]) if node_r[j] >= 0 else right[j : j + 1]
            if apart[i, j] + reach[i, j] <= sure:
                yield rows_l, rows_r, True
            elif node_l[i] >= 0 and node_r[j] >= 0:
                todo.append((int(node_l[i]), int(node_r[j])))
            else:  # a single vector against a node: its vectors at once
                close = np.argwhere(one.x[rows_l] @ two.x[rows_r].T >= threshold)
                yield rows_l[close[:, 0]], rows_r[close[:, 1]], False


def _usable() -> F.Column:
    """Whether a row may link: true or false, never null."""
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
    x = flat.reshape(len(column), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x**2).sum(1, keepdims=True))


def _centres(classes: DataFrame, cell: int, floats: int) -> dict[tuple, np.ndarray]:
    """By (label's key, dims): unit vectors to deal by, chosen by hash, one for `cell` vectors or fewer, so that all hold about `floats` numbers.

    A label for which none is left, or needed, is one cell; cells of any size are right.
    """
    total, dims = classes.agg(F.count("*"), F.max("dims")).first()
    most = max(1, floats // max(dims or 1, 1))
    each = max(float(cell), total / most)
    picked = classes.filter((F.pmod(F.xxhash64("rep", F.lit(5)), F.lit(1 << 30)) < F.lit((1 << 30) / each))).select("label_key", "dims", "rep", "embedding")
    out: dict[tuple, list] = {}
    for row in picked.orderBy(F.xxhash64("rep", F.lit(5)), "rep").limit(most).toLocalIterator():
        out.setdefault((row["label_key"], row["dims"]), []).append(row["embedding"])
    return {k: _matrix(pa.array(v, pa.list_(pa.float64()))) for k, v in out.items()}


def _placed(classes: DataFrame, centres: dict[tuple, np.ndarray], threshold: float) -> DataFrame:
    """classes with the cell of each, its distance from that cell's centre, and `visits`: cells of a smaller number that the planes do not rule out, with the distance to their centres."""
    radius = radius_of(threshold)
    shared = classes.sparkSession.sparkContext.broadcast(centres)
    names = ["label_key", "dims", "rep", "copies", "embedding"]
    visit = pa.list_(pa.struct([("cell", pa.int32()), ("away", pa.float64())]))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            by_key: dict[tuple, list[int]] = {}
            for n, key in enumerate(zip(batch.column("label_key").to_pylist(), batch.column("dims").to_pylist(), strict=True)):
                by_key.setdefault(key, []).append(n)
            cell, away, visits = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows), [[] for _ in range(batch.num_rows)]
            for key, rows in by_key.items():
                c = known.get(key)
                if c is None:
                    away[rows] = 2.0
                    continue
                apart = _distance(_matrix(batch.column("embedding").take(pa.array(rows))) @ c.T)
                own = apart.argmin(1)
                least = apart[np.arange(len(rows)), own]
                cell[rows], away[rows] = own, least
                between = _distance(c @ c.T)[own]
                with np.errstate(divide="ignore", invalid="ignore"):
                    plane = np.where(between > 0, (apart**2 - least[:, None] ** 2) / (2 * between), 0.0)
                may = (plane <= radius) & (np.arange(len(c))[None, :] < own[:, None])
                for k, row in enumerate(rows):
                    visits[row] = [{"cell": int(v), "away": float(apart[k, v])} for v in np.flatnonzero(may[k])]
            arrays = [*(batch.column(n) for n in names), pa.array(cell), pa.array(away), pa.array(visits, visit)]
            yield pa.RecordBatch.from_arrays(arrays, [*names, "cell", "away", "visits"])

    schema = "label_key string, dims int, rep long, copies long, embedding array<double>, cell int, away double, visits array<struct<cell: int, away: double>>"
    return classes.select(*names).mapInArrow(place, schema)


def _dealt(placed: DataFrame, threshold: float, block: int) -> DataFrame:
    """Rows dealt to tasks (label_key, dims, cell, i, j): i is a block of the cell's members, j one of them (j >= i) or, from `own` on, one of visitors."""
    cell = ["label_key", "dims", "cell"]
    reach = placed.groupBy(*cell).agg(F.max("away").alias("reach"), F.count("*").alias("members"))
    rows = ["rep", "copies", "embedding"]
    guests = placed.select("label_key", "dims", *rows, F.explode("visits").alias("v")).select("label_key", "dims", F.col("v.cell").alias("cell"), *rows, F.col("v.away").alias("away"))
    guests = guests.join(reach.select(*cell, "reach"), cell).filter(F.col("away") <= F.col("reach") + radius_of(threshold) + _SLACK).drop("reach", "away")
    many = guests.groupBy(*cell).agg(F.count("*").alias("guests"))
    of = lambda n: F.ceil(F.col(n) / F.lit(float(block))).cast("int")
    plan = reach.join(many, cell, "left").select(*cell, of("members").alias("own"), F.coalesce(of("guests"), F.lit(0)).alias("extra"))
    lot = lambda n: F.pmod(F.xxhash64("rep", F.lit(7)), n).cast("int")
    home = placed.select(*cell, *rows).join(plan, cell).withColumn("mine", lot(F.col("own")))
    home = home.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("own") + F.col("extra") - 1)))
    home = home.withColumns({"i": F.least("mine", "other"), "j": F.greatest("mine", "other")})
    away = guests.join(plan, cell).withColumn("mine", F.col("own") + lot(F.col("extra")))
    away = away.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("own") - 1))).withColumn("j", F.col("mine"))
    columns = [*cell, "i", "j", "mine", *rows]
    return home.select(*columns).unionByName(away.select(*columns))


def _compare(threshold: float):
    def compare(key, rows):
        """Of a pair of blocks: (kind 0) links by vector, (kind 1) spanning forest of the links."""
        i, j = key[3].as_py(), key[4].as_py()
        mine, rep, many = (rows.column(c).to_numpy() for c in ("mine", "rep", "copies"))
        first, second = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
        links, forest, edges = np.zeros(len(rep), np.int64), Forest(len(rep)), []
        if len(first) and len(second):
            x = _matrix(rows.column("embedding"))
            one = CoverTree(x[first])
            two = one if i == j else CoverTree(x[second])
            for a, b, whole in dual_pairs(one, two, threshold):
                a, b = first[a], second[b]
                if not whole:
                    np.add.at(links, a, many[b])
                    np.add.at(links, b, many[a])
                    edges += forest.link(a, b)
                    continue
                edges += forest.link(np.append(np.full(len(b), a[0]), a), np.append(b, np.full(len(a), b[0])))
                if a[0] == b[0]:  # a node with itself
                    links[a] += many[a].sum() - many[a]
                else:
                    links[a] += many[b].sum()
                    links[b] += many[a].sum()
        got, at = links > 0, np.array(edges, np.int64).reshape(-1, 2)
        kind = np.repeat(np.array([0, 1], np.int32), [int(got.sum()), len(at)])
        return pa.table({"a": np.concatenate([rep[got], rep[at[:, 0]]]), "b": np.concatenate([links[got], rep[at[:, 1]]]), "kind": kind})

    return compare


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, cell: int = CELL, centres: int = CENTRE_FLOATS) -> DataFrame:
    """(vec_id, n_links, component_id) for every row of (vec_id, embedding, label)."""
    slim = vectors.select(F.col("vec_id").cast("long").alias("doc_id"), F.col("embedding").cast("array<double>").alias("embedding"), "label")
    rows, by_number = numbered(slim)
    rows = rows.filter("doc_id IS NOT NULL")
    keyed = rows.filter(_usable()).withColumns({
        "k1": F.xxhash64("embedding", "label"), "k2": F.xxhash64(F.lit(1), "label", "embedding"), "label_key": F.col("label").cast("string"), "dims": F.size("embedding"),
    })
    key = ["label_key", "dims", "k1", "k2"]
    with tidied() as keep:
        classes = written(keyed.groupBy(*key).agg(F.min("_row").alias("rep"), F.count("*").alias("copies"), F.first("embedding").alias("embedding")))
        placed = written(_placed(classes, _centres(classes, cell, centres), threshold))
        tasks = _dealt(placed, threshold, block).groupBy("label_key", "dims", "cell", "i", "j")
        found = written(tasks.applyInArrow(_compare(threshold), "a long, b long, kind int"))
        links = found.filter("kind = 0").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("links"))
        joined = components(found.filter("kind = 1").select("a", "b")).withColumnRenamed("node", "rep")
        per_class = keep(written(classes.join(links, "rep", "left").join(joined, "rep", "left").select(
            *key, F.coalesce("component", "rep").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))))
    linked = keyed.select("_row", "doc_id", *key).join(per_class, key).select("_row", "doc_id", "n_links", "component")
    alone = rows.filter(~_usable()).select("_row", "doc_id", F.lit(0).cast("long").alias("n_links"), F.col("_row").alias("component"))
    out = linked.unionByName(alone)
    if not by_number:
        return out.select(F.col("doc_id").alias("vec_id"), "n_links", F.col("component").alias("component_id"))
    out = written(out)
    least = out.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    nobody = slim.filter("doc_id IS NULL").select(F.col("doc_id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("component_id"))
    return out.join(least, "component").select(F.col("doc_id").alias("vec_id"), "n_links", "component_id").unionByName(nobody)


def op10_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings")).withColumn("kept", F.col("vec_id") == F.col("component_id"))


OP10_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id AND list_cosine_similarity(x.e, y.e) >= {THRESHOLD}),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT c.a AS vec_id, coalesce(n, 0)::BIGINT AS n_links, c.component_id, c.a = c.component_id AS kept
FROM (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) k ON k.a = c.a
"""
