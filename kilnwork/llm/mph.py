"""A minimal perfect hash over 64-bit keys: levels of bit arrays, a rank over their ones, and what does not fit goes a level on."""

from __future__ import annotations

import numpy as np

from kilnwork.llm.words import mix

_U = np.uint64
GAMMA = 2.0


class MinimalPerfectHash:
    """Distinct keys to 0..n-1 in constant time, about 3 bits a key. Foreign keys get any place; fingerprints tell them apart."""

    def __init__(self, levels: list[np.ndarray]):
        """levels: for each level its bits, packed in 64-bit words."""
        self.levels = levels
        self.before = []
        total = 0
        for bits in levels:
            ones = np.cumsum(np.bitwise_count(bits), dtype=np.int64)
            self.before.append(np.concatenate([[0], ones])[:-1] + total)
            total += int(ones[-1]) if len(ones) else 0
        self.n = total

    @staticmethod
    def _place(keys: np.ndarray, level: int, words: int) -> np.ndarray:
        return (mix(keys ^ _U((level + 1) * 0xD6E8FEB86659FD93 % 2**64)) % _U(64 * words)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> MinimalPerfectHash:
        keys = keys.astype(_U)
        if len(np.unique(keys)) != len(keys):
            raise ValueError("keys of a minimal perfect hash must be distinct")
        levels = []
        while len(keys):
            words = max(1, int(np.ceil(len(keys) * GAMMA / 64)))
            places = cls._place(keys, len(levels), words)
            alone = np.bincount(places, minlength=64 * words) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8").copy())
            keys = keys[~alone[places]]
        return cls(levels)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        keys = keys.astype(_U)
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            if not len(todo):
                break
            place = self._place(keys[todo], level, len(bits))
            word, bit = place >> 6, (place & 63).astype(_U)
            held = (bits[word] >> bit) & _U(1) == 1
            below = np.bitwise_count(bits[word] & ((_U(1) << bit) - _U(1)))
            out[todo[held]] = (self.before[level][word] + below)[held]
            todo = todo[~held]
        return out

    def to_bytes(self) -> bytes:
        sizes = np.array([len(self.levels), *map(len, self.levels)], "<u8")
        return sizes.tobytes() + b"".join(x.astype("<u8").tobytes() for x in self.levels)

    @classmethod
    def from_bytes(cls, data: bytes) -> tuple[MinimalPerfectHash, int]:
        """The hash, and the number of bytes that it took."""
        count = int(np.frombuffer(data, "<u8", 1)[0])
        sizes = np.frombuffer(data, "<u8", count, 8).astype(int)
        at, levels = 8 + 8 * count, []
        for n in sizes:
            levels.append(np.frombuffer(data, "<u8", n, at))
            at += 8 * n
        return cls(levels), at
