"""Secret scans: fixed formats, and automata inferred from labelled credentials that score every other candidate.

Fixed formats are matched over the whole text (BASE). Their values are the labelled credentials: of each kind at most
PER_KIND distinct ones, by hash. From each kind's strings a prefix tree with counts is built and its states are merged where
a Hoeffding bound lets their outgoing frequencies, and those of all that follow, be the same (red-blue order); what is left is a
probabilistic automaton of the kind's format. Strings are spelled by classes of characters, except for the letters that all of a kind's strings begin
with, which stay themselves. A background automaton comes in the same way from PLAIN distinct runs of texts without base spans (of each
text the first from its middle on).

A candidate is every maximal run of LEAST or more characters [A-Za-z0-9+/_.=-] (full stops and dashes cut from its ends; LEAST is the
shortest value that the fixed formats take), also the parts of a run beside base spans. All candidates are scored. One is reported, as kind
`format`, if its log-likelihood a character under some kind's automaton is no less than the TAIL quantile of that kind's own strings
and its whole log-likelihood exceeds the background's by at least MARGIN, as there are far more words than secrets.

Defined results: a null or empty text has no spans; equal rows are rows of the result each; a null doc_id is kept; an empty table
gives no rows, and a corpus without base spans no automata; further columns are not read. Offsets are code points.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property
from math import log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilnwork.llm.shared import forget, table, written
from kilnwork.llm.words import blocks

PER_KIND, PLAIN, ALPHA, TAIL, MARGIN = 300, 2000, 0.05, 0.05, log(1000)
#: A candidate's least length, and the longest string that is trained on.
LEAST, LONGEST = 6, 512
#: Longer runs are scored one by one, with the same result.
LONG = 256
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_RUN = re.compile(r"[A-Za-z0-9+/_.=-]{6,}")


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind's ordinal, end, value) of the fixed formats, by start and kind."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), 0, m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    # the runs of 24 or more are those of the runs of any length, as both are maximal
    out += [(m.start(), 2, m.end(), m[0]) for m in _HEX.finditer(text)]
    return sorted(out)


_IS_RUN, _IS_EDGE = np.zeros(256, bool), np.zeros(256, bool)
_IS_RUN[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")] = True
_IS_EDGE[list(b".-")] = True


def points(data: np.ndarray) -> np.ndarray:
    """The byte at which each code point of a UTF-8 buffer begins."""
    return np.flatnonzero((data & 0xC0) != 0x80)


def free_runs(data: np.ndarray, begins: np.ndarray, taken: list[list[tuple[int, int, int, str]]]) -> tuple[np.ndarray, np.ndarray]:
    """First byte and byte after the last of the candidates in a buffer of texts, which begin at `begins`, by place. What base spans hold is blanked in it."""
    for k, spans in enumerate(taken):
        if spans:
            at = np.append(points(data[begins[k] : begins[k + 1]]), begins[k + 1] - begins[k]) + begins[k]
            for start, _, end, _ in spans:
                data[at[start] : at[end]] = 32
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _IS_RUN[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= LEAST
    starts, ends = starts[long], ends[long]
    if len(starts):
        first, last = _IS_EDGE[data[starts]], _IS_EDGE[data[ends - 1]]
        if first.any() or last.any():
            core = np.flatnonzero(inside[1:-1] & ~_IS_EDGE[data])
            core = np.concatenate([[-1], core, [len(data)]])
            starts[first] = core[np.searchsorted(core, starts[first])]
            ends[last] = core[np.searchsorted(core, ends[last]) - 1] + 1
            long = ends - starts >= LEAST
            starts, ends = starts[long], ends[long]
    return starts, ends


def joined(held: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts in one buffer, parted by line feeds, and the place where each begins (one place more than texts)."""
    return np.frombuffer(b"\n".join(held) + b"\n", np.uint8).copy(), np.cumsum([0] + [len(x) + 1 for x in held])


def candidates(text: str, taken: list[tuple[int, int, int, str]]) -> Iterator[tuple[int, int, str]]:
    """(start, end, value) of a text's candidates: runs, and what base spans leave of them."""
    data, begins = joined([text.encode("utf-8", "replace")])
    at = points(data)
    for a, b in zip(*free_runs(data, begins, [taken]), strict=True):
        yield int(np.searchsorted(at, a)), int(np.searchsorted(at, b)), data[a:b].tobytes().decode()


_CLASS = {c: k for k, cs in {"d": "0123456789", "a": "abcdef", "z": "ghijklmnopqrstuvwxyz", "A": "ABCDEF", "Z": "GHIJKLMNOPQRSTUVWXYZ", "_": "+/_=.-"}.items() for c in cs}


def spelled(value: str, literal: int) -> tuple[str, ...]:
    """A string's symbols: the first `literal` characters as they are (marked), then classes."""
    return tuple("=" + c for c in value[:literal]) + tuple(_CLASS.get(c, "_") for c in value[literal:])


@dataclass
class State:
    ends: int = 0
    total: int = 0
    next: dict[str, int] = field(default_factory=dict)
    count: dict[str, int] = field(default_factory=dict)


class Automaton:
    """A deterministic probabilistic automaton over symbols, inferred from strings."""

    def __init__(self, words: list[tuple[str, ...]], alpha: float = ALPHA):
        self.states = {0: State()}
        fresh = 1
        for word in words:
            at = 0
            for symbol in word:
                s = self.states[at]
                s.total += 1
                s.count[symbol] = s.count.get(symbol, 0) + 1
                if symbol not in s.next:
                    s.next[symbol] = fresh
                    self.states[fresh] = State()
                    fresh += 1
                at = s.next[symbol]
            self.states[at].total += 1
            self.states[at].ends += 1
        self.bound = sqrt(0.5 * log(2 / alpha))
        self._merge_all()

    def _alike(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) < self.bound * (1 / sqrt(n1) + 1 / sqrt(n2))

    def _compatible(self, one: int, two: int) -> bool:
        todo = [(one, two)]
        while todo:
            a, b = (self.states[k] for k in todo.pop())
            if not self._alike(a.ends, a.total, b.ends, b.total):
                return False
            for symbol in a.count.keys() | b.count.keys():
                if not self._alike(a.count.get(symbol, 0), a.total, b.count.get(symbol, 0), b.total):
                    return False
                if symbol in a.next and symbol in b.next:
                    todo.append((a.next[symbol], b.next[symbol]))
        return True

    def _fold(self, into: int, other: int) -> None:
        todo = [(into, other)]
        while todo:
            i, o = todo.pop()
            if i == o:
                continue
            a, b = self.states[i], self.states.pop(o)
            a.ends += b.ends
            a.total += b.total
            for symbol, n in b.count.items():
                a.count[symbol] = a.count.get(symbol, 0) + n
                if symbol in a.next:
                    todo.append((a.next[symbol], b.next[symbol]))
                else:
                    a.next[symbol] = b.next[symbol]

    def _merge_all(self) -> None:
        red = [0]
        while True:
            blue = [(r, s) for r in red for s, k in sorted(self.states[r].next.items()) if k not in red]
            if not blue:
                break
            parent, symbol = max(blue, key=lambda x: (self.states[self.states[x[0]].next[x[1]]].total, x))
            own = self.states[parent].next[symbol]
            match = next((r for r in red if self._compatible(r, own)), None)
            if match is None:
                red.append(own)
            else:
                self.states[parent].next[symbol] = match
                self._fold(match, own)

    def score(self, word: tuple[str, ...]) -> float:
        """Log-likelihood a symbol, the end included; unseen steps cost as one in a hundred more than was seen."""
        at, total = 0, 0.0
        for symbol in word:
            s = self.states[at]
            total += log((s.count.get(symbol, 0) + 0.01) / (s.total + 0.1))
            at = s.next.get(symbol, at)
        s = self.states[at]
        return (total + log((s.ends + 0.01) / (s.total + 0.1))) / (len(word) + 1)


_CLASSES = "dazAZ_"
_SYMBOL = np.zeros(256, np.intp)
for _c, _k in _CLASS.items():
    _SYMBOL[ord(_c)] = _CLASSES.index(_k)


class Steps:
    """An automaton as arrays: for each state and symbol (a class, or a literal's byte) what the step costs and where it leads; for each state what the end costs."""

    def __init__(self, automaton: Automaton, literal: int):
        ordinal = {k: n for n, k in enumerate(automaton.states)}  # the first state is the first
        symbols = [*_CLASSES, *("=" + chr(k) for k in range(128))] if literal else list(_CLASSES)
        self.literal, self.width = literal, len(symbols)
        states = list(automaton.states.items())
        self.cost = np.array([log((s.count.get(x, 0) + 0.01) / (s.total + 0.1)) for _, s in states for x in symbols])
        self.next = np.array([ordinal[s.next.get(x, k)] for k, s in states for x in symbols], np.intp) * self.width
        self.ends = np.array([log((s.ends + 0.01) / (s.total + 0.1)) for _, s in states])

    def scores(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Automaton.score of runs of a buffer, longest first: all runs take a step at a time."""
        at, total = np.zeros(len(starts), np.intp), np.zeros(len(starts))
        left = np.searchsorted(-lengths, -np.arange(int(lengths[0])))  # how many runs have a step of this place
        for k, n in enumerate(left):
            letters = data[starts[:n] + k]
            step = at[:n] + (letters.astype(np.intp) + len(_CLASSES) if k < self.literal else _SYMBOL[letters])
            total[:n] += self.cost[step]
            at[:n] = self.next[step]
        return (total + self.ends[at // self.width]) / (lengths + 1)


@dataclass
class Formats:
    """For each kind its automaton, its number of literal characters and the least score that it takes; and the background."""

    kinds: dict[str, tuple[Automaton, int, float]]
    background: Automaton | None

    def likely(self, value: str) -> bool:
        scores = [s for a, n, least in self.kinds.values() if (s := a.score(spelled(value, n))) >= least]
        if not scores:
            return False
        plain = self.background.score(spelled(value, 0)) if self.background else -99.0
        return (max(scores) - plain) * (len(value) + 1) >= MARGIN

    def all_likely(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """`likely` of runs of a buffer. Runs of over LONG bytes, which would take a step each alone, are scored one by one."""
        lengths = ends - starts
        out = np.zeros(len(starts), bool)
        for k in np.flatnonzero(lengths > LONG):
            out[k] = self.likely(data[starts[k] : ends[k]].tobytes().decode())
        order = np.argsort(-lengths, kind="stable")
        order = order[np.count_nonzero(lengths > LONG) :]
        if len(order) and self.kinds:
            best = np.full(len(order), -np.inf)
            for steps, least in self._steps:
                own = steps.scores(data, starts[order], lengths[order])
                best = np.maximum(best, np.where(own >= least, own, -np.inf))
            some = np.isfinite(best)
            order, best = order[some], best[some]
            if len(order):
                plain = self._plain.scores(data, starts[order], lengths[order]) if self._plain else -99.0
                out[order] = (best - plain) * (lengths[order] + 1) >= MARGIN
        return out

    @cached_property
    def _steps(self) -> list[tuple[Steps, float]]:
        return [(Steps(a, n), least) for a, n, least in self.kinds.values()]

    @cached_property
    def _plain(self) -> Steps | None:
        return Steps(self.background, 0) if self.background else None


def fit(labelled: dict[str, list[str]], plain: list[str]) -> Formats:
    kinds = {}
    for kind, values in labelled.items():
        if len(values) >= 5:
            literal = len(_prefix(values))
            words = [spelled(v, literal) for v in values]
            automaton = Automaton(words)
            kinds[kind] = (automaton, literal, float(np.quantile([automaton.score(w) for w in words], TAIL)))
    return Formats(kinds, Automaton([spelled(v, 0) for v in plain]) if plain else None)


def _prefix(values: list[str]) -> str:
    low, high = min(values), max(values)
    n = next((k for k in range(min(len(low), len(high))) if low[k] != high[k]), min(len(low), len(high)))
    return low[: min(n, 8)]


_SPAN = pa.struct([("kind", pa.int32()), ("value", pa.string())])


def scanned(docs: DataFrame) -> DataFrame:
    """(base, plain): the labelled credentials of each whole text, and a run of a text that has none."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, plain = [], []
            for text in batch.column("text"):
                text = text.as_py() or ""
                spans = base_spans(text)
                base.append([{"kind": s[1], "value": s[3]} for s in spans])
                middle = 0 if spans else max(0, text.find(" ", len(text) // 2))
                plain.append(next((m[0].strip(".-") for m in _RUN.finditer(text, middle)), None) if not spans else None)
            yield pa.RecordBatch.from_arrays([pa.array(base, pa.list_(_SPAN)), pa.array(plain, pa.string())], ["base", "plain"])

    return docs.select("text").mapInArrow(scan, "base array<struct<kind: int, value: string>>, plain string").filter("size(base) > 0 OR plain IS NOT NULL")


def learned(docs: DataFrame) -> Formats:
    """Automata from at most PER_KIND values of each kind and PLAIN plain runs."""
    found = written(scanned(docs))

    def some(values: DataFrame, most: int) -> list[str]:
        return [r["v"] for r in values.filter(F.length("v").between(LEAST, LONGEST)).distinct().orderBy(F.xxhash64("v"), "v").limit(most).collect()]

    values = found.select(F.explode("base").alias("b"))
    labelled = {name: some(values.filter(F.col("b.kind") == k).select(F.col("b.value").alias("v")), PER_KIND) for k, name in enumerate(KINDS)}
    formats = fit(labelled, some(found.filter("plain IS NOT NULL").select(F.col("plain").alias("v")), PLAIN))
    forget(found)
    return formats


def format_spans(held: list[bytes], taken: list[list[tuple[int, int, int, str]]], formats: Formats) -> list[list[tuple[int, int]]]:
    """For each text the (start, end) of its likely candidates, in code points, by start."""
    out = [[] for _ in held]
    if not formats.kinds:
        return out
    data, begins = joined(held)
    starts, ends = free_runs(data, begins, taken)
    found = formats.all_likely(data, starts, ends)
    starts, ends = starts[found], ends[found]
    texts = np.searchsorted(begins, starts, "right") - 1
    for k in np.unique(texts):
        at, own = points(data[begins[k] : begins[k + 1]]) + begins[k], texts == k
        out[k] = list(zip(np.searchsorted(at, starts[own]).tolist(), np.searchsorted(at, ends[own]).tolist(), strict=True))
    return out


def with_formats(docs: DataFrame, formats: Formats) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_format) of every whole text."""
    own = docs.sparkSession.sparkContext.broadcast(formats)  # some hundred states

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        formats = own.value
        for batch in batches:
            out = []
            for _, held in blocks(text.as_py() for text in batch.column("text")):
                base = [base_spans(x.decode()) for x in held]
                for spans, more in zip(base, format_spans(held, base, formats), strict=True):
                    told = [(start, kind, f"{KINDS[kind]}:{start}:{end}") for start, kind, end, _ in spans]
                    more = [(a, len(KINDS), f"format:{a}:{b}") for a, b in more]
                    base_told = ",".join(x[2] for x in told)
                    out.append((*(sum(x[1] == k for x in told) for k in range(3)), hashlib.sha256(base_told.encode()).hexdigest(), ",".join(x[2] for x in sorted(told + more)), len(more)))
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_format"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_format long")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return with_formats(docs, learned(docs))
