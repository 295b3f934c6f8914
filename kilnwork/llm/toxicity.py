"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A word's input is the sum of two embeddings, of the word (hashed) and of its character trigrams (hashed, averaged), and one
channel with the word's log-odds among the labelled training texts (of other folds, while training). Windows of WINDOW words start every STEP words over the whole
text, so that they overlap; two gated recurrent units read each window from either end, attention weighs the states, and a
logistic unit scores the pooled state. A text's score is its highest window's, moved so that the threshold that parts the
labels best becomes 0.7.

Training is by multiple instances: of a toxic text the window that the network scores highest (at first, the one with the highest log-odds) counts
as toxic; of a clean text the highest and a random one count as clean. Training takes at most PER_CLASS rows of each label, none of
more than MAX_CHARS characters and at most SUM_CHARS of a label in all, so what the driver gathers is bounded; scoring reads all
of every text. Input rows of the recurrence are computed once for each distinct word of a block of texts.

Defined results: a null or empty text, or one without words, has score 0; equal texts get equal scores; a null doc_id is kept;
without labels of both kinds all scores are 0; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kilnwork.llm.quality import mapped
from kilnwork.llm.shared import best_cut, labelled_sample, remainder, table
from kilnwork.llm.words import _FOLD, mix, word_hashes

PER_CLASS, MAX_CHARS, SUM_CHARS = 1500, 160_000, 16 << 20
#: A window starts at every half window: a passage of 17 words or fewer lies whole in one.
WINDOW, STEP = 32, 16
WORD_ROWS, CHAR_ROWS, WIDTH, HIDDEN = 1 << 14, 1 << 12, 8, 8
BATCH, EPOCHS, LEAST_STEPS = 128, 4, 150
#: The share of words whose embeddings are hidden in a training step.
DROP, FOLDS = 0.5, 5
ODDS_WORDS = 4096
CUT = 0.7
_U = np.uint64


class Words:
    """The words of some texts: distinct hashes, their character trigrams' rows, each word's ordinal, and where each text begins."""

    def __init__(self, data: list[bytes]):
        joined = b"\n".join(data)
        hashes, starts, ends = word_hashes(joined)
        self.begins = np.searchsorted(starts, np.cumsum([0] + [len(x) + 1 for x in data]))
        self.distinct, first, self.ordinal = np.unique(hashes, return_index=True, return_inverse=True)
        raw = np.frombuffer(joined, np.uint8)
        starts, lengths = starts[first], (ends - starts)[first]
        # each distinct word between two blanks: as many trigrams as letters
        padded = lengths + 2
        at = np.cumsum(padded) - padded
        letters = np.full(int(padded.sum()), 32, np.uint64)
        inner = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        letters[np.repeat(at + 1, lengths) + inner] = _FOLD[raw[np.repeat(starts, lengths) + inner]]
        grams = np.repeat(at, lengths) + inner
        self.grams = (mix(letters[grams] * _U(65536) + letters[grams + 1] * _U(256) + letters[grams + 2]) % _U(CHAR_ROWS)).astype(np.int64) if len(grams) else np.zeros(0, np.int64)
        self.gram_at, self.gram_n = np.cumsum(lengths) - lengths, lengths
        self.rows = (mix(self.distinct) % _U(WORD_ROWS)).astype(np.int64)

    def grams_of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The trigrams of some words one after another, where each word's begin, and how many it has."""
        n = self.gram_n[ids]
        at = np.cumsum(n) - n
        return self.grams[np.repeat(self.gram_at[ids] - at, n) + np.arange(int(n.sum()))], at, n

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """For each window its words' ordinals (-1 past a text's end), and its text."""
        counts = np.diff(self.begins)
        many = np.maximum(0, -(-(counts - (WINDOW - STEP)) // STEP))
        many = np.where(counts > 0, np.maximum(many, 1), 0)
        text = np.repeat(np.arange(len(counts)), many)
        start = (np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)) * STEP + self.begins[text]
        at = start[:, None] + np.arange(WINDOW)
        inside = at < self.begins[text + 1][:, None]
        out = np.full(at.shape, -1, np.int64)
        out[inside] = self.ordinal[at[inside]]
        return out, text


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _summed(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows of values by their place in 0..n-1; a place of -1 is left out."""
    out = np.zeros((n, values.shape[1]), np.float32)
    order = np.argsort(at, kind="stable")
    order = order[np.searchsorted(at[order], 0) :]
    if len(order):
        own = at[order]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        out[own[first]] = np.add.reduceat(values[order], first)
    return out


class Network:
    """Parameters by name; every array in single precision. odds: sorted word hashes and their log-odds."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        draw = lambda *s, by=1.0: (rng.normal(size=s) * by / np.sqrt(s[0])).astype(np.float32)
        self.p = {"word": (rng.normal(size=(WORD_ROWS, WIDTH)) * 0.1).astype(np.float32), "char": (rng.normal(size=(CHAR_ROWS, WIDTH)) * 0.1).astype(np.float32)}
        for side in "fb":
            self.p |= {f"W{side}": draw(WIDTH + 1, 3 * HIDDEN), f"U{side}": draw(HIDDEN, 3 * HIDDEN), f"c{side}": np.zeros(3 * HIDDEN, np.float32)}
        self.p |= {"A": draw(2 * HIDDEN, HIDDEN), "v": draw(HIDDEN), "o": draw(2 * HIDDEN), "k": np.zeros(1, np.float32)}
        self.odds = (np.zeros(0, _U), np.zeros(0, np.float32))
        self.cut, self.ready = 0.0, False

    def inputs(self, words: Words, ids: np.ndarray | None = None, odds: tuple | None = None) -> np.ndarray:
        """A row a distinct word, or one for each of the ordinals `ids`; odds: other log-odds than the network's."""
        ids = np.arange(len(words.distinct)) if ids is None else ids
        if not len(ids):
            return np.zeros((0, WIDTH + 1), np.float32)
        grams, at, n = words.grams_of(ids)
        out = np.zeros((len(ids), WIDTH + 1), np.float32)
        out[:, :WIDTH] = self.p["word"][words.rows[ids]] + np.add.reduceat(self.p["char"][grams], at) / n[:, None]
        keys, value = odds or self.odds
        if len(keys):
            own = words.distinct[ids]
            at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            out[:, WIDTH] = np.where(keys[at] == own, value[at], 0)
        return out

    def forward(self, x: np.ndarray, windows: np.ndarray, keep: bool = False):
        """Logits of windows over word inputs x; with keep, also what backward() needs."""
        n, mask = len(windows), (windows >= 0)
        states, trail = np.zeros((2, WINDOW, n, HIDDEN), np.float32), []
        h2 = 2 * HIDDEN
        for d, side in enumerate("fb"):
            table = np.concatenate([x @ self.p[f"W{side}"] + self.p[f"c{side}"], np.zeros((1, 3 * HIDDEN), np.float32)])
            u = self.p[f"U{side}"]
            h = np.zeros((n, HIDDEN), np.float32)
            for t in range(WINDOW) if side == "f" else range(WINDOW - 1, -1, -1):
                live = mask[:, t]
                if not live.any():
                    continue
                g = table[windows[:, t]]
                zr = _sigmoid(g[:, :h2] + h @ u[:, :h2])
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                c = np.tanh(g[:, h2:] + (r * h) @ u[:, h2:])
                new = np.where(live[:, None], h + z * (c - h), h)
                if keep:
                    trail.append((d, t, h, z, r, c))
                h = new
                states[d, t] = h
        both = np.concatenate([states[0], states[1]], 2)  # time, window, 2 * hidden
        turn = np.tanh(both @ self.p["A"])
        e = np.where(mask.T, turn @ self.p["v"], -1e9)
        a = np.exp(e - e.max(0))
        a /= a.sum(0)
        pooled = np.einsum("tn,tnh->nh", a, both)
        logit = pooled @ self.p["o"] + self.p["k"][0]
        return (logit, (mask, trail, both, turn, a, pooled)) if keep else logit

    def backward(self, x: np.ndarray, windows: np.ndarray, kept, d_logit: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the parameters past the embeddings, and of the word inputs x."""
        mask, trail, both, turn, a, pooled = kept
        grad = {k: np.zeros_like(v) for k, v in self.p.items() if k not in ("word", "char")}
        grad["o"] = pooled.T @ d_logit
        grad["k"][0] = d_logit.sum()
        d_pooled = d_logit[:, None] * self.p["o"]
        d_both = a[:, :, None] * d_pooled[None]
        d_a = np.einsum("tnh,nh->tn", both, d_pooled)
        d_e = a * (d_a - (a * d_a).sum(0))
        grad["v"] = np.einsum("tn,tnh->h", d_e, turn)
        d_turn = d_e[:, :, None] * self.p["v"] * (1 - turn**2)
        grad["A"] = np.einsum("tni,tnj->ij", both, d_turn)
        d_both = d_both + d_turn @ self.p["A"].T
        gates = np.zeros((2, WINDOW, len(windows), 3 * HIDDEN), np.float32)
        h2, carry = 2 * HIDDEN, np.zeros((2, len(windows), HIDDEN), np.float32)
        for d, t, h, z, r, c in reversed(trail):
            side, u, live = "fb"[d], self.p[f"U{'fb'[d]}"], mask[:, t][:, None]
            dh = carry[d] + d_both[t, :, d * HIDDEN : (d + 1) * HIDDEN]
            moved = np.where(live, dh, 0)
            d_c = moved * z * (1 - c**2)
            d_z = moved * (c - h) * z * (1 - z)
            d_rh = d_c @ u[:, h2:].T
            d_r = d_rh * h * r * (1 - r)
            d_g = np.concatenate([d_z, d_r, d_c], 1)
            carry[d] = np.where(live, moved * (1 - z) + d_rh * r + d_g[:, :h2] @ u[:, :h2].T, dh)
            grad[f"U{side}"][:, :h2] += h.T @ d_g[:, :h2]
            grad[f"U{side}"][:, h2:] += (r * h).T @ d_c
            gates[d, t] = d_g
        at = windows.T.ravel()
        xt = np.concatenate([x, np.zeros((1, WIDTH + 1), np.float32)])[at]
        flat = gates.reshape(2, -1, 3 * HIDDEN)
        d_in = np.zeros((len(at), WIDTH + 1), np.float32)
        for d, side in enumerate("fb"):
            grad[f"W{side}"], grad[f"c{side}"] = xt.T @ flat[d], flat[d].sum(0)
            d_in += flat[d] @ self.p[f"W{side}"].T
        return grad, _summed(at, d_in, len(x))

    def scores(self, data: list[bytes]) -> np.ndarray:
        """The highest logit of each text's windows; -inf for texts without words."""
        words = Words(data)
        windows, text = words.windows()
        x = self.inputs(words)
        out = np.full(len(data), -np.inf)
        for k in range(0, len(windows), 8192):
            np.maximum.at(out, text[k : k + 8192], self.forward(x, windows[k : k + 8192]))
        return out

    def score(self, data: list[bytes]) -> np.ndarray:
        if not self.ready:
            return np.zeros(len(data))
        return np.where(np.isneginf(s := self.scores(data)), 0.0, _sigmoid(s - self.cut + np.log(CUT / (1 - CUT)))).astype(float)


def _log_odds(words: Words, y: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of at least three texts, at most ODDS_WORDS of them, with the lower bound of their log-odds of toxic texts; equal texts count once."""
    seen, parts, owner = set(), [], []
    for k in among:
        own = np.unique(words.ordinal[words.begins[k] : words.begins[k + 1]])
        if len(own) and (mark := own.tobytes()) not in seen:
            seen.add(mark)
            parts.append(own)
            owner.append(np.full(len(own), y[k]))
    if not parts:
        return np.zeros(0, _U), np.zeros(0, np.float32)
    at, own = np.concatenate(parts), np.concatenate(owner)
    toxic, clean = (np.bincount(at, own == label, len(words.distinct)) for label in (1, 0))
    t, c = (sum(o[0] == label for o in owner) for label in (1, 0))
    value = np.log((toxic + 0.5) / (t + 1)) - np.log((clean + 0.5) / (c + 1))
    doubt = 1.5 * np.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))
    value = np.sign(value) * np.maximum(0, np.abs(value) - doubt)
    order = np.argsort(-np.where(toxic + clean >= 3, np.abs(value), 0), kind="stable")[:ODDS_WORDS]
    order = np.sort(order[((toxic + clean)[order] >= 3) & (value[order] != 0)])
    return words.distinct[order], value[order].astype(np.float32)


def fit(data: list[bytes], y: np.ndarray, seed: int = 3, log_odds: bool = True) -> Network:
    """log_odds=False leaves the words' log-odds out: the network alone."""
    net = Network(seed)
    words = Words(data)
    windows, text = words.windows()
    used = np.unique(text)
    good, bad = used[y[used] == 0], used[y[used] == 1]
    if not len(good) or not len(bad):
        return net
    rng = np.random.default_rng(seed)
    odds_of = lambda among: _log_odds(words, y, among if log_odds else among[:0])
    net.odds = odds_of(used)
    # a text is trained on with the log-odds of the other folds, as any other text will be read without its own label
    mark = {}
    fold = np.array([mark.setdefault(words.ordinal[words.begins[k] : words.begins[k + 1]].tobytes(), rng.integers(FOLDS)) for k in range(len(y))])
    others = [odds_of(used[fold[used] != f]) for f in range(FOLDS)]
    firsts = np.searchsorted(text, np.arange(len(y) + 1))
    first, second = {k: np.zeros_like(v) for k, v in net.p.items()}, {k: np.zeros_like(v) for k, v in net.p.items()}
    level = np.zeros(len(windows), np.float32)
    own = [np.flatnonzero(fold[text] == f) for f in range(FOLDS)]
    for f in range(FOLDS):
        odds = np.append(net.inputs(words, odds=others[f])[:, WIDTH], 0)
        level[own[f]] = np.maximum(odds[windows[own[f]]], 0).sum(1)

    def scored_windows() -> None:
        for f in range(FOLDS):
            x = net.inputs(words, odds=others[f])
            for k in range(0, len(own[f]), 8192):
                level[own[f][k : k + 8192]] = net.forward(x, windows[own[f][k : k + 8192]])

    epochs, steps = EPOCHS + max(0, min(36, LEAST_STEPS * BATCH // (3 * len(good)) - EPOCHS)), 0
    for epoch in range(epochs):
        if epoch and epoch % max(1, epochs // 3) == 0:  # from now on the network says which window is a text's highest
            scored_windows()
        top = {k: firsts[k] + int(level[firsts[k] : firsts[k + 1]].argmax()) for k in used}
        rows = [top[k] for k in bad] * max(1, len(good) // len(bad)) + [top[k] for k in good] + [int(rng.integers(firsts[k], firsts[k + 1])) for k in good]
        rows = rng.permutation(rows)
        by_fold = [rows[fold[text[rows]] == f] for f in range(FOLDS)]
        parts = [(f, x) for f, mine in enumerate(by_fold) for x in np.array_split(mine, max(1, len(mine) // BATCH)) if len(x)]
        for at in rng.permutation(len(parts)):
            f, part = parts[at]
            ids, at = np.unique(windows[part], return_inverse=True)
            at, lacks = at.reshape(len(part), WINDOW), int(ids[0] < 0)
            ids, at = ids[lacks:], at - lacks
            x = net.inputs(words, ids, others[f])
            dropped = (rng.random(len(ids)) < DROP)[:, None]  # of these words only the log-odds are seen
            x[:, :WIDTH] *= ~dropped / (1 - DROP)
            logit, kept = net.forward(x, at, keep=True)
            label = y[text[part]].astype(np.float32)
            grad, d_x = net.backward(x, at, kept, ((_sigmoid(logit) - label) / len(part)).astype(np.float32))
            d_emb = (d_x[:, :WIDTH] * ~dropped / (1 - DROP)).astype(np.float32)
            grams, _, n = words.grams_of(ids)
            grad["word"] = _summed(words.rows[ids], d_emb, WORD_ROWS)
            grad["char"] = _summed(grams, np.repeat(d_emb / n[:, None], n, axis=0), CHAR_ROWS)
            steps += 1
            for name, g in grad.items():  # Adam, with a decay of the embeddings
                first[name] += 0.1 * (g - first[name])
                second[name] += 0.01 * (g * g - second[name])
                net.p[name] -= 0.01 * (first[name] / (1 - 0.9**steps)) / (np.sqrt(second[name] / (1 - 0.99**steps)) + 1e-7)
                if name in ("word", "char"):
                    net.p[name] *= 0.995
    scored_windows()
    net.cut, net.ready = best_cut(np.array([level[firsts[k] : firsts[k + 1]].max() for k in used]), y[used]), True
    return net


def trained(docs: DataFrame, labels: DataFrame, by: int = 3, held_out: int = 1, per_class: int = PER_CLASS) -> Network:
    sample = labelled_sample(docs, labels, "toxic", by, held_out, per_class)
    short = sample.select("doc_id", "y", F.coalesce("text", F.lit("")).alias("text")).filter(F.length("text") <= MAX_CHARS)
    so_far = F.sum(F.length("text")).over(Window.partitionBy("y").orderBy(F.xxhash64("doc_id"), "doc_id"))  # of PER_CLASS rows at most
    rows = short.withColumn("so_far", so_far).filter(F.col("so_far") <= SUM_CHARS).orderBy(F.xxhash64("doc_id"), F.xxhash64("text")).collect()
    return fit([r["text"].encode("utf-8", "replace") for r in rows], np.array([r["y"] for r in rows], int))


def scored(docs: DataFrame, net: Network) -> DataFrame:
    """(doc_id, score) of every document's whole text."""
    own = docs.sparkSession.sparkContext.broadcast(net)  # under a megabyte
    return mapped(docs.select(F.col("doc_id").cast("long"), "text"), lambda data: [pa.array(own.value.score(data))], "doc_id long, score double", ["score"])


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = scored(docs, trained(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
