"""A minimal perfect hash over short tuples of numbers, with its keys.

Built level by level: the keys that are alone at their place of a level's bit array stay there, the others
go to the next level. A key's slot is the number of bits before its own. Every key is stored at its slot and
compared when it is read, so a tuple that isn't a key is told apart, whatever its hash."""

from __future__ import annotations

import numpy as np

#: Bits of a level for each key that comes to it.
_SPACE = 2
_MOST_LEVELS = 200


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each row of an (n, columns) array of unsigned 32-bit numbers."""
    h = np.full(len(keys), (seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for c in range(keys.shape[1]):
        h ^= keys[:, c]
        h *= np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(29))


class PerfectHash:
    def __init__(self, keys: np.ndarray):
        """keys: an (n, columns) array of uint32 without equal rows."""
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        left, base = keys, 0
        while len(left):
            if len(self.levels) == _MOST_LEVELS:
                raise ValueError("keys repeat")
            size = max(64, -(-_SPACE * len(left) // 64) * 64)
            at = (mixed(left, len(self.levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            words = np.packbits(alone, bitorder="little").view("<u8")
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)]) + base
            self.levels.append((size, words, before[:-1]))
            base = int(before[-1])
            left = left[~alone[at]]
        self.keys = np.zeros_like(keys)
        self.keys[self._slots(keys)] = keys

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        rows = np.arange(len(keys))
        for level, (size, words, before) in enumerate(self.levels):
            at = (mixed(keys[rows], level) % np.uint64(size)).astype(np.int64)
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            here = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[rows[here]] = before[at[here] >> 6] + below[here]
            rows = rows[~here]
            if not len(rows):
                break
        return out

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each row, or -1 where it is none of the keys."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        out = self._slots(keys)
        found = out >= 0
        out[found] = np.where((self.keys[out[found]] == keys[found]).all(1), out[found], -1)
        return out
