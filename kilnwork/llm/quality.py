"""Quality by Bradley-Terry ranking: a document's score is w . x, learned so that of a good and a bad document the good one wins.

x are rates over the whole text (letters, capitals, digits, signs, lines, word lengths, repeated words and runs), each laid out in
bins between quantiles of the training rows, so that a rate may count for or against a text at either end. w minimises the logistic loss of
differences x(good) - x(bad) over all pairs of a good and a bad training row. The threshold is a quantile of the training scores, the one
that parts the labels best; scores are moved so that it becomes 0.7.

Training takes every labelled row outside the held-out fold. The rows' rates stay on the executors; the driver gets sums over them:
- Bin edges: order statistics of each rate, found byte by byte from counts (exact; rates are single precision).
- Loss and gradient: a row's weight against all rows of the other label depends on its score alone, so two histograms of scores on a grid
  of GRID points (a score is shared between its two neighbours) give the weights of all pairs. Errors are of the order of the
  squared grid width. Each round is a Newton step, its length chosen from those of LENGTHS by the loss over all pairs.
- Threshold and scale: counts of all scores on a grid of FINE points.
Sums are one vector a task, of at most PARTS tasks and about 1 MB; nothing on the driver grows with the rows.

Defined results: a null or empty text has all rates 0 and is scored from them; equal texts get equal scores; of rows with one doc_id one
text is a training row, the first by hash; a null doc_id is kept (its fold is that of an empty id) and is no training row; without labels
of both kinds all scores are 1; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilnwork.llm.shared import cut_of_counts, forget, remainder, table, written
from kilnwork.llm.words import blocks, word_hashes

RATES, BINS, ROUNDS = 24, 8, 300
GRID, FINE, LENGTHS, DECAY = 8192, 65_536, (4, 2, 1, 0.5, 0.25, 0.0625), 1e-4
PARTS, PART_ROWS = 64, 16_000
CUT = 0.7
_SIGNS = np.array([33 <= b < 48 or 58 <= b < 65 or 91 <= b < 97 or 123 <= b < 127 for b in range(256)])
_CONTROL = np.array([b < 32 and b not in (9, 10, 13) or b == 127 for b in range(256)])


def features(data: list[bytes]) -> np.ndarray:
    """One row of rates a text, in single precision."""
    hashes, starts, ends = word_hashes(b"\n".join(data))
    begins = np.cumsum([0] + [len(x) + 1 for x in data])
    at = np.searchsorted(starts, begins)
    out = np.zeros((len(data), RATES))
    for k, text in enumerate(data):
        n = len(text)
        if not n:
            continue
        c = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
        h = hashes[at[k] : at[k + 1]]
        lengths = (ends - starts)[at[k] : at[k + 1]]
        w = len(h)
        upper, lower = c[65:91].sum(), c[97:123].sum()
        lines = text.split(b"\n")
        row = [
            np.log1p(n), upper / n, lower / n, c[48:58].sum() / n, c[128:].sum() / n, c[32] / n, c[10] / n, c[_SIGNS].sum() / n, c[_CONTROL].sum() / n,
            (c[46] + c[44]) / n, (c[33] + c[63]) / n, c[[35, 36, 37, 38, 42]].sum() / n, c[[124, 60, 62, 123, 125, 91, 93, 92]].sum() / n, upper / (upper + lower + 1), len(set(lines)) / len(lines), n / len(lines),
        ]
        if w:
            distinct = len(np.unique(h))
            pairs = len(np.unique(h[1:] * np.uint64(3) + h[:-1])) if w > 1 else 1
            runs = (h[1:] == h[:-1]).mean() if w > 1 else 0.0
            top = np.unique(h, return_counts=True)[1].max() / w
            row += [np.log1p(w), distinct / np.sqrt(w), pairs / max(1, w - 1), runs, top, lengths.mean(), lengths.std(), c[_SIGNS].sum() / w]
        out[k, : len(row)] = row
    return out.astype(np.float32)


@dataclass
class Ranking:
    """edges: for each rate the bin edges; w: a weight a bin; cut and width: the score that becomes 0.7, and the scale."""

    edges: np.ndarray
    w: np.ndarray
    cut: float
    width: float

    def laid_out(self, x: np.ndarray) -> np.ndarray:
        """For each rate and edge, how far the rate lies above the edge on its way to the next, 0 to 1."""
        low, high = self.edges[:-1], self.edges[1:]
        return np.clip((x[:, None, :] - low[None]) / (high - low)[None], 0, 1).reshape(len(x), -1)

    def bounds(self, w: np.ndarray) -> tuple[float, float]:
        """What w . x lies between, whatever the rates: a rate fills its bins one after another."""
        sums = np.cumsum(np.vstack([np.zeros(self.edges.shape[1]), w.reshape(-1, self.edges.shape[1])]), axis=0)
        return float(sums.min(0).sum()), float(sums.max(0).sum())

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.laid_out(x) @ self.w

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (self.raw(x) - self.cut) / self.width + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


# Adds up work(x, y) over all training rows, in blocks; None if there are none
Total = Callable[[Callable[[np.ndarray, np.ndarray], np.ndarray]], np.ndarray | None]


def quantiles(total: Total, n: int, columns: int, at: np.ndarray) -> np.ndarray:
    """The quantiles `at` of each column over all n rows, as np.quantile gives them, from counts of one byte after another."""
    place = at * (n - 1)
    low = np.floor(place).astype(int)
    ranks = np.unique(np.concatenate([low, np.ceil(place).astype(int)]))
    prefix = np.zeros((columns, len(ranks)), np.uint64)
    left = np.tile(ranks, (columns, 1))
    for shift in (24, 16, 8, 0):
        known = [np.unique(c) for c in prefix]

        def counts(x, y, shift=shift, known=known):
            keys = _ordered(x)
            digit, high = (keys >> np.uint64(shift)) & np.uint64(255), keys >> np.uint64(shift + 8)
            out = np.zeros((columns, len(ranks), 256))
            for c, some in enumerate(known):
                k = np.minimum(np.searchsorted(some, high[:, c]), len(some) - 1)
                ours = some[k] == high[:, c]
                out[c, : len(some)] = np.bincount(k[ours] * 256 + digit[ours, c].astype(int), minlength=len(some) * 256).reshape(-1, 256)
            return out.ravel()

        found = np.cumsum(total(counts).reshape(columns, len(ranks), 256), axis=2)
        for c in range(columns):
            for r in range(len(ranks)):
                sums = found[c, np.searchsorted(known[c], prefix[c, r])]
                d = int(np.searchsorted(sums, left[c, r], side="right"))
                left[c, r] -= int(sums[d - 1]) if d else 0
                prefix[c, r] = (prefix[c, r] << np.uint64(8)) | np.uint64(d)
    values = _value(prefix).astype(float)
    below, above = values[:, np.searchsorted(ranks, low)], values[:, np.searchsorted(ranks, np.ceil(place).astype(int))]
    return (below + (above - below) * (place - low)).T


def _ordered(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the single-precision values."""
    bits = np.ascontiguousarray(x, np.float32).view(np.uint32)
    return np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31)).astype(np.uint64)


def _value(keys: np.ndarray) -> np.ndarray:
    keys = keys.astype(np.uint32)
    return np.where(keys >> 31, keys ^ np.uint32(1 << 31), ~keys).astype(np.uint32).view(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


@dataclass
class Scores:
    """The shares of the good and of the bad rows' scores at the points low, low + width, ..."""

    low: float
    width: float
    good: np.ndarray
    bad: np.ndarray

    def against(self, shares: np.ndarray, kernel: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """At every point p the sum of share(q) * kernel(p - q) over all points q."""
        n = len(shares)
        k = kernel(np.arange(1 - n, n) * self.width)
        size = 1 << (3 * n).bit_length()
        return np.fft.irfft(np.fft.rfft(shares, size) * np.fft.rfft(k, size), size)[n - 1 : 2 * n - 1]

    def loss(self) -> float:
        """The mean logistic loss of all pairs of a good and a bad row."""
        return float(self.good @ self.against(self.bad, lambda u: np.logaddexp(0, -u)))


def _shared_out(s: np.ndarray, low: float, width: float) -> tuple[np.ndarray, np.ndarray]:
    """The point under each score, and how far the score lies on the way to the next."""
    p = (s - low) / width
    k = np.clip(p.astype(int), 0, GRID - 2)
    return k, p - k


def learned(total: Total, columns: int = RATES) -> Ranking:
    """The ranking of the training rows that `total` adds up over."""
    sizes = total(lambda x, y: np.array([(y == 0).sum(), (y == 1).sum()], float))
    if sizes is None or not sizes.all():
        return Ranking(np.array([np.zeros(columns), np.ones(columns)]), np.zeros(columns), -1e3, 1.0)
    edges = quantiles(total, int(sizes.sum()), columns, np.linspace(0, 1, BINS + 1))
    edges = np.maximum.accumulate(edges + np.arange(BINS + 1)[:, None] * 1e-6, axis=0)
    model = Ranking(edges, np.zeros(columns * BINS), 0.0, 1.0)

    def placed(tries: list[np.ndarray]) -> list[Scores]:
        """The scores of all rows under each of some weights."""
        grids = [(low, (high - low) / (GRID - 1) or 1.0) for low, high in map(model.bounds, tries)]

        def shares(x, y):
            s = model.laid_out(x) @ np.array(tries).T
            out = np.zeros((len(tries), 2, GRID))
            for t, (low, width) in enumerate(grids):
                for label in (0, 1):
                    k, f = _shared_out(s[y == label, t], low, width)
                    out[t, label] = np.bincount(k, 1 - f, GRID) + np.bincount(k + 1, f, GRID)
            return out.ravel()

        found = total(shares).reshape(len(tries), 2, GRID) / sizes[:, None]
        return [Scores(low, width, found[t, 1], found[t, 0]) for t, (low, width) in enumerate(grids)]

    w, now = model.w, placed([model.w])[0]
    loss, d = now.loss(), len(w)
    for _ in range(ROUNDS):
        # of each point: a row's pull against all rows of the other label, and how that pull changes with its score
        pull = np.array([-now.against(now.good, _sigmoid), now.against(now.bad, lambda u: _sigmoid(-u))]) / sizes[:, None]
        bend = np.array([now.against(now.good, lambda u: _sigmoid(u) * _sigmoid(-u)), now.against(now.bad, lambda u: _sigmoid(u) * _sigmoid(-u))])
        bend = np.maximum(bend, 0) / sizes[:, None]

        def slopes(x, y, w=w, low=now.low, width=now.width, pull=pull, bend=bend):
            laid = model.laid_out(x)
            k, f = _shared_out(laid @ w, low, width)
            a, h = ((1 - f) * v[y, k] + f * v[y, k + 1] for v in (pull, bend))
            bent = laid * h[:, None]
            return np.concatenate([a @ laid, bent[y == 0].sum(0), bent[y == 1].sum(0), (laid.T @ bent).ravel(), [h[y == 0].sum()]])

        got = total(slopes)
        slope, bad, good, square, whole = got[:d] - DECAY * w, got[d : 2 * d], got[2 * d : 3 * d], got[3 * d : -1].reshape(d, d), got[-1]
        cross = np.outer(good, bad) / max(whole, 1e-300)
        step = np.linalg.solve(square - cross - cross.T + DECAY * np.eye(d), slope)
        tries = [w + length * step for length in LENGTHS]
        at = placed(tries)
        losses = [x.loss() + DECAY / 2 * t @ t for x, t in zip(at, tries, strict=True)]
        best = int(np.argmin(losses))
        if not losses[best] < loss:
            break
        fell, w, now, loss = loss - losses[best], tries[best], at[best], losses[best]
        if fell < 1e-6 * loss:
            break
    model.w = w
    low, high = model.bounds(w)
    width = (high - low) / (FINE - 1) or 1.0

    def counts(x, y):
        k = np.clip(((model.raw(x) - low) / width + 0.5).astype(int), 0, FINE - 1)
        return np.bincount(y * FINE + k, minlength=2 * FINE).astype(float)

    bad, good = total(counts).reshape(2, FINE)
    points = low + width * np.arange(FINE)
    model.cut = cut_of_counts(points, good, bad)
    spread = [np.sqrt(c @ (points - c @ points / c.sum()) ** 2 / c.sum()) for c in (good, bad)]
    model.width = max(1e-6, float(sum(spread)) / 4)
    return model


def fit(x: np.ndarray, y: np.ndarray) -> Ranking:
    """The ranking of rows at hand."""
    x, y = np.asarray(x, np.float32), np.asarray(y, int)
    return learned(lambda work: work(x, y) if len(y) else None, x.shape[1])


def mapped(docs: DataFrame, work, schema: str, names: list[str]) -> DataFrame:
    """Runs work(list of texts as bytes) -> columns over (doc_id, text, ...) and puts the columns beside doc_id (and y and text_hash, if there)."""
    keep = [c for c in ("doc_id", "y", "text_hash") if c in docs.columns]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data in blocks(x.as_py() for x in batch.column("text")):
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(first, len(data)) for c in keep), *work(data)], [*keep, *names])

    return docs.mapInArrow(scan, schema)


def rated(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, x) of every document: its whole text's rates as bytes."""
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    return mapped(rows, lambda data: [pa.array([x.tobytes() for x in features(data)], pa.binary())], "doc_id long, text_hash long, x binary", ["x"])


def total_over(rows: DataFrame) -> Total:
    """Adds up over rows (y, x) where they lie; each task sends one vector."""

    def total(work):
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = None
            for batch in batches:
                if batch.num_rows:
                    part = work(np.frombuffer(b"".join(batch.column("x").to_pylist()), np.float32).reshape(batch.num_rows, RATES), batch.column("y").to_numpy().astype(int))
                    out = part if out is None else out + part
            if out is not None:
                yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["part"])

        out = None
        for r in rows.mapInArrow(scan, "part binary").collect():
            part = np.frombuffer(r["part"])
            out = part if out is None else out + part
        return out

    return total


def trained_on(rates: DataFrame, labels: DataFrame, by: int = 4, held_out: int = 2) -> Ranking:
    """The ranking learned from all labelled rows of rates that are not in the held-out fold."""
    known = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("y")).filter(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & (remainder("doc_id", by) != held_out)).distinct()
    parts = min(PARTS, 1 + known.count() // PART_ROWS)
    rows = rates.join(known, "doc_id").groupBy("doc_id", "y").agg(F.min(F.struct("text_hash", "x")).alias("row")).select("doc_id", "y", "row.x")
    rows = written(rows.repartition(parts, "doc_id").sortWithinPartitions("doc_id", "y"))
    model = learned(total_over(rows.select("y", "x").coalesce(parts)))
    forget(rows)
    return model


def trained(docs: DataFrame, labels: DataFrame, by: int = 4, held_out: int = 2) -> Ranking:
    return trained_on(rated(docs.filter(remainder("doc_id", by) != held_out)), labels, by, held_out)


def scored(docs: DataFrame, model: Ranking) -> DataFrame:
    """(doc_id, score) of every document's whole text."""
    return scores_of(rated(docs), model)


def scores_of(rates: DataFrame, model: Ranking) -> DataFrame:
    own = rates.sparkSession.sparkContext.broadcast(model)  # a few kilobytes

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column("x").to_pylist()), np.float32).reshape(-1, RATES)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(own.value.score(x))], ["doc_id", "score"])

    return rates.select("doc_id", "x").mapInArrow(scan, "doc_id long, score double")


def kept(docs: DataFrame, model: Ranking) -> DataFrame:
    """The rows of docs whose text scores CUT or more."""
    own = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data in blocks(x.as_py() for x in batch.column("text")):
                yield batch.slice(first, len(data)).filter(pa.array(own.value.score(features(data)) >= CUT))

    return docs.mapInArrow(scan, docs.schema)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rates = written(rated(docs))
    out = scores_of(rates, trained_on(rates, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
