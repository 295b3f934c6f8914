"""Words of texts as 64-bit hashes, computed in numpy over whole buffers.

A word is a maximal run of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` after A-Z are lower-cased. In UTF-8 that is a run of the
bytes 0-9, a-z and 0x80-0xFF, so the bytes can be classed by a table and no text is decoded.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

_U = np.uint64
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True
_IS_WORD[65:91] = True
_BASE = _U(0x9E3779B97F4A7C15)
PIECE = 2 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values over all 64 (splitmix64's finish)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_OF_BYTE = mix(np.arange(1, 257, dtype=_U) * _BASE)
_powers = np.ones(1, _U)


def _powers_to(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        steps = np.full(max(n, 64), _BASE)
        steps[0] = 1
        _powers = np.cumprod(steps)
    return _powers


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of a UTF-8 buffer: hash, first byte and byte after the last of each. A buffer of any length is read in pieces that end between words."""
    parts, at = [], 0
    while at < len(data):
        end = len(data)
        if end - at > 2 * PIECE:
            outside = np.flatnonzero(~_IS_WORD[np.frombuffer(data, np.uint8, PIECE, at)])
            if len(outside):
                end = at + int(outside[-1]) + 1
        parts.append(_words(_FOLD[np.frombuffer(data, np.uint8, end - at, at)], at))
        at = end
    if not parts:
        return np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if len(parts) > 1 else parts[0]


def _words(folded: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inside = np.zeros(len(folded) + 2, bool)
    inside[1:-1] = _IS_WORD[folded]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, _U), starts + shift, ends + shift
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    letters = folded[inside[1:-1]]
    place = np.arange(len(letters)) - np.repeat(first, lengths)
    sums = np.add.reduceat(_OF_BYTE[letters] * _powers_to(int(lengths.max()) + 1)[place], first)
    return mix(sums + lengths.astype(_U)), starts + shift, ends + shift


def blocks(texts: Iterable, size: int = PIECE) -> Iterator[tuple[int, list[bytes]]]:
    """Encode texts (None: empty) and hand them on in lists of about `size` bytes, each with the ordinal of its first text."""
    held, total, first, n = [], 0, 0, 0
    for text in texts:
        held.append((text or "").encode("utf-8", "replace"))
        total += len(held[-1])
        n += 1
        if total >= size:
            yield first, held
            held, total, first = [], 0, n
    if held:
        yield first, held


def words_by_text(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of several texts, one after another, and the place where each text's words begin (one place more than texts)."""
    hashes, starts, _ = word_hashes(b"\n".join(data))
    begins = np.cumsum([0] + [len(x) + 1 for x in data])
    return hashes, np.searchsorted(starts, begins)


def shingles(hashes: np.ndarray, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of runs of `width` words; of fewer words, but not none, one hash of them all."""
    n = len(hashes)
    if not n:
        return hashes
    width = min(width, n)
    total = np.zeros(n - width + 1, _U)
    for k in range(width):
        total = mix(total + hashes[k : n - width + 1 + k]) * _BASE
    return np.unique(total + _U(width))
