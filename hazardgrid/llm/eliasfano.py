"""Elias-Fano sequences and trie levels in memory-mapped files, queried by whole numpy arrays."""

from __future__ import annotations

import json
from urllib.parse import urlparse

import numpy as np

from hazardgrid.llm.warc import filesystem

_U = np.uint64
# Place of the r-th set bit of a byte.
_SELECT8 = np.array([[([k for k in range(8) if b >> k & 1] + [8] * 8)[r] for r in range(8)] for b in range(256)], np.uint8).ravel()
#: Steps along a bucket before its end is looked up and the rest halved.
_WALK = 4


def _select_in_word(words: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Place of the ``rank``-th set bit of each 64-bit word: halves down to a byte, then a table."""
    words, rank = words.copy(), rank.astype(np.uint8)
    place = np.zeros(len(words), np.uint8)
    for width in (32, 16, 8):
        below = np.bitwise_count(words & _U((1 << width) - 1))
        up = rank >= below
        rank -= below * up
        step = up * np.uint8(width)
        words >>= step
        place += step
    return place.astype(np.int64) + _SELECT8[(words & _U(255)).astype(np.int64) * 8 + rank]


class Sequence:
    """A non-decreasing sequence: packed low bits, and high bits in unary."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.width, self.low, self.high, self.ones = n, width, low, high, ones
        self.zeros = np.arange(len(high) + 1, dtype=np.int64) * 64 - ones

    @classmethod
    def of(cls, values: np.ndarray) -> "Sequence":
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        width = max(0, (top // max(1, n)).bit_length() - 1)
        v = values.astype(_U)
        low = np.zeros(n * width // 64 + 2, _U)
        if width:
            at = np.arange(n, dtype=_U) * _U(width)
            word, shift = (at >> _U(6)).astype(np.int64), at & _U(63)
            bits = v & _U((1 << width) - 1)
            np.bitwise_or.at(low, word, bits << shift)
            over = np.flatnonzero(shift + _U(width) > 64)
            np.bitwise_or.at(low, word[over] + 1, bits[over] >> (_U(64) - shift[over]))
        place = (v >> _U(width)).astype(np.int64) + np.arange(n)
        bits = np.zeros((int(place[-1]) // 64 + 2 if n else 1) * 64, np.uint8)
        bits[place] = 1
        high = np.packbits(bits, bitorder="little").view(_U)
        return cls(n, width, low, high, np.concatenate(([0], np.cumsum(np.bitwise_count(high), dtype=np.int64))))

    def _low(self, i: np.ndarray) -> np.ndarray:
        """The packed low bits of some values."""
        if not self.width:
            return np.zeros(len(i), np.int64)
        at = i * self.width
        w, shift = at >> 6, (at & 63).astype(_U)
        bits = self.low[w] >> shift
        over = np.flatnonzero(shift > _U(64 - self.width))
        bits[over] |= self.low[w[over] + 1] << (_U(64) - shift[over])
        return (bits & _U((1 << self.width) - 1)).astype(np.int64)

    def _is_one(self, place: np.ndarray) -> np.ndarray:
        return (self.high[place >> 6] >> (place & 63).astype(_U) & _U(1)).astype(bool)

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """Place of the ``k``-th zero of the high bits."""
        word = np.searchsorted(self.zeros, k, side="right") - 1
        return word * 64 + _select_in_word(~self.high[word], k - self.zeros[word])

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.ones, i, side="right") - 1
        place = word * 64 + _select_in_word(self.high[word], i - self.ones[word])
        value = (place - i) << self.width
        return value | self._low(i) if self.width else value

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Index of the first value that is at least ``x``; ``n`` if there is none."""
        return self._search(x)[0]

    def find(self, x: np.ndarray) -> np.ndarray:
        """Index of the first value that is ``x``, -1 if there is none."""
        i, same = self._search(x)
        return np.where(same, i, -1)

    def _search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first value that is at least ``x``, and whether it is ``x``.

        The values of a bucket, those with the high bits of ``x``, lie together and rise by their low bits alone.
        """
        bucket, rest = x >> self.width, x & ((1 << self.width) - 1)
        same = np.zeros(len(x), bool)
        i = np.where(bucket < int(self.zeros[-1]), 0, self.n)
        some = np.flatnonzero((bucket > 0) & (i == 0))
        i[some] = self._zero(bucket[some] - 1) - bucket[some] + 1       # after the zero that ends the bucket before
        going = np.flatnonzero(i < self.n)
        for _ in range(_WALK):
            going = going[self._is_one(i[going] + bucket[going])]       # still in the bucket
            low = self._low(i[going])
            same[going] = low == rest[going]
            going = going[low < rest[going]]
            if not len(going):
                return i, same
            i[going] += 1
            going = going[i[going] < self.n]
        going = going[self._is_one(i[going] + bucket[going])]
        first, end = i[going], self._zero(bucket[going]) - bucket[going]
        stop = end.copy()
        while len(open_ := np.flatnonzero(first < end)):                # the lowest place of at least the low bits
            middle = (first[open_] + end[open_]) >> 1
            less = self._low(middle) < rest[going[open_]]
            first[open_[less]] = middle[less] + 1
            end[open_[~less]] = middle[~less]
        i[going] = first
        inside = np.flatnonzero(first < stop)
        same[going[inside]] = self._low(first[inside]) == rest[going[inside]]
        return i, same

    def arrays(self, name: str) -> dict[str, np.ndarray]:
        return {f"{name}.n": np.array([self.n, self.width], np.int64), f"{name}.low": self.low, f"{name}.high": self.high, f"{name}.ones": self.ones}

    @classmethod
    def from_arrays(cls, a: dict[str, np.ndarray], name: str) -> "Sequence":
        return cls(int(a[f"{name}.n"][0]), int(a[f"{name}.n"][1]), a[f"{name}.low"], a[f"{name}.high"], a[f"{name}.ones"])


def save(path: str, arrays: dict[str, np.ndarray]) -> None:
    """One file: a line that describes the arrays, then the arrays, 8-byte aligned."""
    fs, root = filesystem(path)
    at, index = 0, {}
    for k, a in arrays.items():
        index[k] = [str(a.dtype), len(a), at]
        at += -(-a.nbytes // 8) * 8
    head = json.dumps(index).encode()
    head += b" " * (7 - len(head) % 8) + b"\n"
    fs.create_dir(root.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(root, compression=None) as f:
        f.write(head)
        for a in arrays.values():
            f.write(a.tobytes() + b"\0" * (-a.nbytes % 8))


def load(path: str) -> dict[str, np.ndarray]:
    """The arrays of a file: mapped where the store is a mounted folder, else read."""
    fs, root = filesystem(path)
    if urlparse(path).scheme in ("", "file"):
        data = np.memmap(root, np.uint8, "r")
    else:
        with fs.open_input_file(root) as f:
            data = np.frombuffer(f.read(), np.uint8)
    end = int(np.argmax(data[:4096] == 10)) + 1
    if end == 1:
        raise ValueError("not a level file")
    index = json.loads(bytes(data[:end]))
    return {k: data[end + at:end + at + n * np.dtype(t).itemsize].view(t) for k, (t, n, at) in index.items()}


#: Quantisation of -log10: steps of 1/2048, up to 32.
STEPS = 2048


def quantise(log10: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-log10 * STEPS) + 32768, 0, 65535).astype(np.uint16)


def unquantise(q: np.ndarray) -> np.ndarray:
    return (32768.0 - q.astype(np.float64)) / STEPS


class Level:
    """Children of the contexts ``first .. first + n - 1``.

    Pointers to each context's children are one sequence.  The children's words are another: a word is raised by the
    last value of the context before, so the whole sequence increases and a search for a word of a context is one
    successor search.
    """

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.first, self.offset = int(arrays["place"][0]), int(arrays["place"][1])
        self.pointers, self.words = Sequence.from_arrays(arrays, "pointers"), Sequence.from_arrays(arrays, "words")
        self.prob, self.backoff, self.count = arrays["prob"], arrays["backoff"], arrays["count"]

    @staticmethod
    def arrays(first: int, offset: int, context: np.ndarray, word: np.ndarray, prob: np.ndarray, backoff: np.ndarray, count: np.ndarray) -> dict:
        """``context``, ``word`` sorted; ``backoff`` has one value per context of the range."""
        pointers = np.searchsorted(context, np.arange(first, first + len(backoff) + 1))
        full = pointers[1:] > pointers[:-1]
        last = word[pointers[1:][full] - 1] + 1
        base = np.zeros(len(backoff), np.int64)
        base[full] = np.concatenate(([0], np.cumsum(last)[:-1]))
        return {"place": np.array([first, offset], np.int64), **Sequence.of(pointers).arrays("pointers"),
                **Sequence.of(base[context - first] + word + 1).arrays("words"), "prob": quantise(prob), "backoff": quantise(backoff),
                "count": count.astype(np.uint32)}

    def find(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Global places of the children, -1 where there is none."""
        c = context - self.first
        out = np.full(len(c), -1)
        if not self.words.n:
            return out
        # Equal contexts that stand together are looked up once.
        new = np.concatenate(([True], c[1:] != c[:-1])) if len(c) else np.zeros(0, bool)
        back, c = np.cumsum(new) - 1, c[new]
        start, end = self.pointers[c], self.pointers[c + 1]
        base = np.where(start > 0, self.words[np.maximum(start - 1, 0)], 0)
        some = np.flatnonzero((start < end)[back])
        if len(some):
            mine = back[some]
            i = self.words.find(base[mine] + word[some] + 1)
            good = (i >= start[mine]) & (i < end[mine])
            out[some[good]] = i[good] + self.offset
        return out


class Levels:
    """All segments of one n-gram length, by ascending contexts."""

    def __init__(self, paths: list[str]):
        self.parts = sorted((Level(load(p)) for p in paths), key=lambda s: s.first)
        self.first = np.array([s.first for s in self.parts], np.int64)
        self.offset = np.array([s.offset for s in self.parts], np.int64)

    def _each(self, key: np.ndarray, edges: np.ndarray):
        part = np.searchsorted(edges, key, side="right") - 1
        order = np.argsort(part, kind="stable") if (part[1:] < part[:-1]).any() else np.arange(len(part))
        sizes = np.bincount(part + 1, minlength=len(self.parts) + 1)
        ends = np.cumsum(sizes)
        for p in np.flatnonzero(sizes[1:]):
            yield self.parts[p], order[ends[p]:ends[p + 1]]

    def find(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        out = np.full(len(context), -1)
        for s, at in self._each(np.where(context < 0, -1, context), self.first):
            at = at[context[at] - s.first < len(s.backoff)]
            out[at] = s.find(context[at], word[at])
        return out

    def _values(self, place: np.ndarray, name: str) -> np.ndarray:
        out = np.zeros(len(place), np.uint32)
        for s, at in self._each(place, self.offset):
            out[at] = getattr(s, name)[place[at] - s.offset]
        return out

    def word(self, place: np.ndarray) -> np.ndarray:
        """The word at each place: its value less that of the context before."""
        out = np.zeros(len(place), np.int64)
        for s, at in self._each(place, self.offset):
            i, back = np.unique(place[at] - s.offset, return_inverse=True)
            context = s.pointers.successor(i + 1) - 1
            start = s.pointers[context]
            out[at] = (s.words[i] - np.where(start > 0, s.words[np.maximum(start - 1, 0)], 0) - 1)[back]
        return out

    def prob(self, place: np.ndarray) -> np.ndarray:
        return unquantise(self._values(place, "prob"))

    def count(self, place: np.ndarray) -> np.ndarray:
        return self._values(place, "count")

    def backoff(self, context: np.ndarray) -> np.ndarray:
        out = np.zeros(len(context))
        for s, at in self._each(np.where(context < 0, -1, context), self.first):
            at = at[context[at] - s.first < len(s.backoff)]
            out[at] = unquantise(s.backoff[context[at] - s.first])
        return out
