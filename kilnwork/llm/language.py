"""Language ID by error-correcting output codes.

Every language has a codeword of bits, drawn with a seed so that words lie far apart and every bit parts the languages. For
each bit a logistic classifier over hashed byte trigrams of the whole text predicts it. Decoding sums, for each language, the
logistic loss of its bits, each weighted by how often the bit was right for that language in training, and takes the least. The
score is the winner's share among exp(-loss); a small lead over the runner-up marks the prediction as ambiguous.

Training takes about ROWS documents in all, by hash, of the LANGS most frequent values of lang (a bound for columns with stray
values). Defined results: null text and text without a letter are `und` with score 0; languages are the values that training sees; with none of them every text is `und`; a null doc_id is
kept; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilnwork.llm.quality import mapped
from kilnwork.llm.shared import remainder, table
from kilnwork.llm.words import mix

ROWS, LANGS, DIMS, BITS, ROUNDS = 4000, 400, 2048, 15, 200
#: A lead over the runner-up's share below which a prediction is flagged.
LEAD = 0.2
_LETTER = np.full(256, 32, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)
_BUCKET: list = []


def _buckets() -> np.ndarray:
    """The place of each byte trigram, by its 24-bit code."""
    if not _BUCKET:
        _BUCKET.append((mix(np.arange(1 << 24, dtype=np.uint64)) % np.uint64(DIMS)).astype(np.uint16))
    return _BUCKET[0]


def features(data: list[bytes]) -> np.ndarray:
    """Rows of square roots of trigram shares; others than letters count as blanks."""
    out = np.zeros((len(data), DIMS), np.float32)
    table = _buckets()
    for k, text in enumerate(data):
        b = _LETTER[np.frombuffer(b" " + text + b" ", np.uint8)].astype(np.uint32)
        code = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
        code = code[code != 0x202020]
        if len(code):
            out[k] = np.sqrt(np.bincount(table[code], minlength=DIMS) / len(code))
    return out


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """n rows of +1 and -1: of seeded draws the one whose nearest two words lie farthest apart; every bit has both values (if n > 1)."""
    bits = max(BITS, int(np.ceil(6 * np.log2(max(n, 2)))))
    rng, best, apart = np.random.default_rng(seed), None, -1
    for _ in range(200 if n < 200 else 5):
        code = rng.choice([-1.0, 1.0], (n, bits))
        same = np.flatnonzero(np.abs(code.sum(0)) == n)
        code[0, same] *= -1
        gap = ((bits - code @ code.T) / 2 + np.eye(n) * bits).min()
        if gap > apart:
            best, apart = code, gap
    return best


@dataclass
class Codes:
    langs: list[str]
    code: np.ndarray
    w: np.ndarray
    b: np.ndarray
    weight: np.ndarray

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The nearest language's ordinal, its share, and whether it is ambiguous."""
        f = x @ self.w + self.b
        # loss of language l: sum over bits of weight * log(1 + exp(-code * f))
        loss = np.logaddexp(0, -f) @ (self.weight * (self.code > 0)).T + np.logaddexp(0, f) @ (self.weight * (self.code < 0)).T
        share = np.exp(-(loss - loss.min(1, keepdims=True)))
        share /= share.sum(1, keepdims=True)
        two = np.sort(share, 1)[:, -2:]
        return loss.argmin(1), share.max(1), (two[:, -1] - two[:, 0] < LEAD) if share.shape[1] > 1 else np.zeros(len(x), bool)


def fit(x: np.ndarray, lang: list[str]) -> Codes | None:
    langs = sorted(set(lang))
    if not langs:
        return None
    at = np.array([langs.index(v) for v in lang])
    code = codewords(len(langs))
    y = code[at].astype(np.float32)
    share = (1 / np.bincount(at))[at][:, None].astype(np.float32) / len(langs)  # every language counts alike
    w, b = np.zeros((x.shape[1], y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    m = np.zeros_like(w)
    v = np.zeros_like(w)
    for n in range(1, ROUNDS + 1):  # Adam over all rows
        p = -y * share / (1 + np.exp(np.clip(y * (x @ w + b), -30, 30)))
        g = x.T @ p + 1e-6 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.3 * (m / (1 - 0.9**n)) / (np.sqrt(v / (1 - 0.99**n)) + 1e-8)
        b -= p.sum(0)
    right = ((x @ w + b) * y > 0).astype(float)
    weight = np.array([right[at == k].mean(0) for k in range(len(langs))]) + 1e-3
    return Codes(langs, code, w, b, weight * code.shape[1] / weight.sum(1, keepdims=True))


def trained(docs: DataFrame, by: int = 4, held_out: int = 2, rows: int = ROWS) -> Codes | None:
    known = docs.select(F.col("doc_id").cast("long"), "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder("doc_id", by) != held_out))
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGS).collect()
    if not counts:
        return None
    each = max(1, rows // len(counts))
    rates = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, each / r["n"])) for r in counts], "lang string, rate double")
    place = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1_000_003)) / 1_000_003.0
    some = known.join(F.broadcast(rates), "lang").filter(place < F.col("rate")).select("doc_id", "text", F.col("lang").alias("y"))
    got = mapped(some, lambda data: [pa.array([x.tobytes() for x in features(data)], pa.binary())], "doc_id long, y string, x binary", ["x"]).orderBy(F.xxhash64("doc_id"), "y").collect()
    return fit(np.array([np.frombuffer(r["x"], np.float32) for r in got]).reshape(-1, DIMS), [r["y"] for r in got])


def predicted(docs: DataFrame, model: Codes | None) -> DataFrame:
    """(doc_id, lang_pred, score, ambiguous) of every document's whole text."""
    own = docs.sparkSession.sparkContext.broadcast(model)  # DIMS * bits floats

    def work(data: list[bytes]) -> list[pa.Array]:
        codes = own.value
        lettered = [codes is not None and any(map(str.isalpha, x.decode("utf-8", "replace"))) for x in data]
        if codes is None:
            return [pa.array(["und"] * len(data)), pa.array([0.0] * len(data)), pa.array([True] * len(data))]
        best, share, doubt = codes.decode(features(data))
        names = [codes.langs[k] if a else "und" for k, a in zip(best, lettered, strict=True)]
        return [pa.array(names, pa.string()), pa.array(np.where(lettered, share, 0.0).astype(float)), pa.array(doubt | ~np.array(lettered, bool))]

    return mapped(docs.select(F.col("doc_id").cast("long"), "text"), work, "doc_id long, lang_pred string, score double, ambiguous boolean", ["lang_pred", "score", "ambiguous"])


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predicted(docs, trained(docs)).select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "ambiguous")
