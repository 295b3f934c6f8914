"""A cuckoo filter over 64-bit hashes: 32-bit fingerprints, buckets of four, exact deletion, growth by doubling.

Both buckets of a key follow from its fingerprint alone. So two keys with one fingerprint are the same to the filter and taking either
one's fingerprint out is right, and a full table is laid out anew, twice as large, from the fingerprints that it holds. What finds no
place although the table is nearly empty (more than eight equal fingerprints) goes to a short list beside it.
"""

from __future__ import annotations

import io

import numpy as np

from kilnwork.llm.words import mix

_U = np.uint64
SLOTS = 4
KICKS = 200
#: The load beyond which a table is doubled.
FULL = 0.9


class Cuckoo:
    """A table of (buckets, SLOTS) fingerprints, 0 for an empty slot, and the fingerprints that found no place."""

    def __init__(self, capacity: int = 1024):
        self.table = np.zeros((_buckets(capacity), SLOTS), np.uint32)
        self.beside = np.zeros(0, np.uint32)

    @staticmethod
    def _prints(keys: np.ndarray) -> np.ndarray:
        prints = (mix(keys.astype(_U) + _U(0x51ED27)) >> _U(32)).astype(np.uint32)
        return np.maximum(prints, np.uint32(1))

    def _places(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        last = _U(len(self.table) - 1)
        spread = mix(prints.astype(_U) * _U(0x9E3779B97F4A7C15))
        one = (spread & last).astype(np.int64)
        return one, one ^ self._step(prints)

    def _step(self, prints: np.ndarray) -> np.ndarray:
        return (mix(prints.astype(_U) + _U(0xC0FFEE)) & _U(len(self.table) - 1)).astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        """True for every key inserted and not deleted; of others, for about one in 2^32 a key held."""
        prints = self._prints(keys)
        one, two = self._places(prints)
        found = (self.table[one] == prints[:, None]).any(1) | (self.table[two] == prints[:, None]).any(1)
        return found | np.isin(prints, self.beside) if len(self.beside) else found

    def insert(self, keys: np.ndarray) -> None:
        self._put(self._prints(keys))

    def _put(self, prints: np.ndarray) -> None:
        held = self.table[self.table > 0]
        if len(held) + len(prints) > FULL * self.table.size:
            self.table = np.zeros((_buckets(len(held) + len(prints)), SLOTS), np.uint32)
            prints = np.concatenate([held, prints])
        left = self._settle(prints)
        while len(left):
            held = self.table[self.table > 0]
            if 8 * len(held) < self.table.size:  # there is room, so these are too many equal ones
                self.beside = np.concatenate([self.beside, left])
                return
            self.table = np.zeros((2 * len(self.table), SLOTS), np.uint32)
            left = self._settle(np.concatenate([held, left]))

    def _settle(self, prints: np.ndarray) -> np.ndarray:
        """Places fingerprints in rounds, all at once in each; what is left after KICKS rounds."""
        rng = np.random.default_rng(len(prints))
        one, two = self._places(prints)
        prints, two = self._fill(prints, one, two)
        prints, bucket = self._fill(prints, two, two)
        for _ in range(KICKS):
            if not len(prints):
                break
            # one waiting fingerprint a bucket throws one out, which goes on to its own other bucket
            order = np.argsort(bucket, kind="stable")
            prints, bucket = prints[order], bucket[order]
            head = np.concatenate([[True], bucket[1:] != bucket[:-1]])
            slot = rng.integers(SLOTS, size=int(head.sum()))
            thrown = self.table[bucket[head], slot]
            self.table[bucket[head], slot] = prints[head]
            prints = np.concatenate([thrown, prints[~head]])
            bucket = np.concatenate([bucket[head] ^ self._step(thrown), bucket[~head]])
            prints, bucket = self._fill(prints, bucket, bucket)
        return prints

    def _fill(self, prints: np.ndarray, bucket: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Puts fingerprints in free slots of their buckets; those that are left, with their other buckets."""
        order = np.argsort(bucket, kind="stable")
        prints, bucket, other = prints[order], bucket[order], other[order]
        first = np.flatnonzero(np.diff(bucket, prepend=-1))
        rank = np.arange(len(bucket)) - np.repeat(first, np.diff(np.append(first, len(bucket))))
        free = self.table[bucket] == 0
        fits = rank < free.sum(1)
        slot = np.argsort(~free, axis=1, kind="stable")[np.flatnonzero(fits), rank[fits]]
        self.table[bucket[fits], slot] = prints[fits]
        return prints[~fits], other[~fits]

    def delete(self, keys: np.ndarray) -> None:
        """Only keys that were inserted may be deleted; each deletion takes one fingerprint out."""
        prints, many = np.unique(self._prints(keys), return_counts=True)
        one, two = self._places(prints)
        for n in range(int(many.max(initial=0))):
            now = many > n
            at = np.stack([one[now], two[now]], 1)
            hit = (self.table[at] == prints[now][:, None, None]).reshape(-1, 2 * SLOTS)
            got, place = hit.any(1), hit.argmax(1)
            self.table[at[got, place[got] // SLOTS], place[got] % SLOTS] = 0
            for x in prints[now][~got]:
                self.beside = np.delete(self.beside, np.flatnonzero(self.beside == x)[:1])

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, table=self.table, beside=self.beside)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Cuckoo:
        held, out = np.load(io.BytesIO(data)), cls(0)
        out.table, out.beside = held["table"].copy(), held["beside"].copy()
        return out


def _buckets(capacity: int) -> int:
    return 1 << max(2, int(np.ceil(np.log2(max(capacity, 1) / SLOTS / FULL))))
