"""Minimal perfect hashes of distinct digests, whole arrays at a time.

Each level is a bit array: keys whose bit nobody else of the level takes are placed there, the others go on to the next.  The slot of a key is the
number of bits set before its own, so ``n`` keys fill the slots ``0..n-1``.  A key that was never put in gets some slot or none: whoever stores the
full key in the slot can tell.
"""

from __future__ import annotations

import io

import numpy as np

from hazardgrid.llm.common import mix64

#: Bytes of a digest (SHA-256) and its 64-bit words.
DIGEST = 32
#: Bits of a level for each key that is left.
SPACE = 2
#: Levels; about 0.4 of the keys go on each time, so what is left after them stays sorted beside them.
LEVELS = 24

_STEP = np.uint64(0x9E3779B97F4A7C15)


def as_words(digests: np.ndarray) -> np.ndarray:
    """``n x 32`` bytes as ``n x 4`` words."""
    return np.ascontiguousarray(digests, np.uint8).reshape(-1, DIGEST).view(np.uint64)


def _hashes(words: np.ndarray, level: int) -> np.ndarray:
    h = np.full(len(words), level + 1, np.uint64) * _STEP
    for part in words.T:
        h = mix64(h ^ part)
    return h


class PerfectHash:
    """Slots of distinct digests; :meth:`build` and :meth:`find` take ``n x 4`` words."""

    def __init__(self, sizes: list[int], bits: list[np.ndarray], rest: np.ndarray):
        self.sizes, self.bits, self.rest = sizes, bits, rest
        counts = [np.concatenate(([0], np.cumsum(np.bitwise_count(b), dtype=np.int64))) for b in bits]
        starts = np.concatenate(([0], np.cumsum([c[-1] for c in counts]))).astype(np.int64)
        self.ranks = [c + s for c, s in zip(counts, starts)]
        self.in_levels = int(starts[-1])
        self.places = {row.tobytes(): self.in_levels + i for i, row in enumerate(rest)}

    @classmethod
    def build(cls, words: np.ndarray) -> PerfectHash:
        sizes, bits = [], []
        for level in range(LEVELS):
            if not len(words):
                break
            size = max(64, -(-SPACE * len(words) // 64) * 64)
            at = (_hashes(words, level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            bits.append(np.packbits(alone, bitorder="little").view(np.uint64))
            words = words[~alone[at]]
        return cls(sizes, bits, words)

    def find(self, words: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for keys that no level has: members always get their own slot."""
        slots = np.full(len(words), -1, np.int64)
        left = np.arange(len(words))
        for level, (size, bits, ranks) in enumerate(zip(self.sizes, self.bits, self.ranks)):
            at = _hashes(words[left], level) % np.uint64(size)
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            here = (bits[word] >> bit & np.uint64(1)).astype(bool)
            below = bits[word] & ((np.uint64(1) << bit) - np.uint64(1))
            slots[left[here]] = (ranks[word] + np.bitwise_count(below))[here]
            left = left[~here]
            if not len(left):
                break
        if self.places:
            for i in left:
                slots[i] = self.places.get(words[i].tobytes(), -1)
        return slots

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, sizes=np.array(self.sizes, np.int64), bits=np.concatenate(self.bits or [np.zeros(0, np.uint64)]), rest=self.rest)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, raw: bytes) -> PerfectHash:
        parts = np.load(io.BytesIO(raw))
        sizes = parts["sizes"].tolist()
        return cls(sizes, np.split(parts["bits"], np.cumsum(np.array(sizes[:-1], np.int64) // 64)) if sizes else [], parts["rest"])
