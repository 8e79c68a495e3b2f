"""Encoding and decoding with merge-type (BPE) sentencepiece vocabularies.

Adjacent symbols are merged in the order of their scores, taken from an agenda; ties
go to the left.  No piece of such a vocabulary reaches over the start of a run of
spaces, nor over a character that only stands alone, so a text falls into units that
encode independently and are remembered.  Each Arrow batch checks its new units and
one whole text against the sentencepiece library.
"""

from __future__ import annotations

import heapq
import re
import struct
from array import array
from itertools import chain, repeat
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from hazardgrid.llm.common import kept, map_texts

SPACE = "▁"
#: Units remembered per Python worker in each of two generations (about 100 MB), and the longest that is.
REMEMBERED = 300_000
LONGEST_REMEMBERED = 64
#: Characters up to which a unit's agenda is a plain list, looked through for the best place at each step.
SHORT = 32
#: Units that the library checks in one call, as lines of a text.
CHECKED_AT_ONCE = 100
#: A place behind all others.
NEVER = 1 << 30

# Fixed values of the model file: kinds of pieces.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes):
    """Number, wire type and value of the fields of a protocol buffer message."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value = varint()
        elif kind == 2:
            size = varint()
            value = data[at:at + size]
            at += size
        else:
            size = 4 if kind == 5 else 8
            value = data[at:at + size]
            at += size
        yield tag >> 3, value


def read_pieces(model: bytes) -> list[tuple[str, float, int]]:
    """Piece, score and kind by id."""
    out = []
    for number, value in _fields(model):
        if number == 1:
            f = dict(_fields(value))
            out.append((f.get(1, b"").decode(), struct.unpack("<f", f[2])[0] if 2 in f else 0.0, f.get(3, NORMAL)))
    return out


class Pieces:
    """A merge-type vocabulary with byte fallback."""

    def __init__(self, model_path: str):
        import sentencepiece
        self.library = sentencepiece.SentencePieceProcessor(model_file=model_path)
        table = read_pieces(self.library.serialized_model_proto())
        if any(kind == USER for *_, kind in table):
            raise ValueError("vocabularies with user-defined pieces are not supported")
        self.id = {p: i for i, (p, _, kind) in enumerate(table) if kind == NORMAL}
        order = {score: i for i, score in enumerate(sorted({-table[i][1] for i in self.id.values()}))}
        self.place = {p: order[-table[i][1]] for p, i in self.id.items() if len(p) > 1}
        self.byte = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(table) if kind == BYTE}
        if len(self.byte) < 256:
            raise ValueError("the vocabulary has no byte pieces")
        self.end = next(i for i, (p, _, kind) in enumerate(table) if kind == CONTROL and p == "</s>")
        self.text = [b"" if kind in (CONTROL, UNUSED) else bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace(SPACE, " ").encode()
                     for p, _, kind in table]
        joined = self.place
        if any(SPACE in p.lstrip(SPACE) for p in joined):
            raise ValueError("pieces reach over spaces")
        together = re.escape("".join(sorted({c for p in joined for c in p} - {SPACE})))
        self.units = re.compile(f"{SPACE}*[{together}]+|{SPACE}+|[^{together}{SPACE}]")
        # Units seen lately, and those of the generation before, which come back when they are seen again.
        self.known: dict[str, tuple[tuple[int, ...], bytes]] = {}
        self.older: dict[str, tuple[tuple[int, ...], bytes]] = {}
        self.fresh: list[str] = []

    def merge_short(self, unit: str) -> list[str]:
        """As :meth:`merge_long`; the agenda is a list that holds the place of every adjacent pair."""
        get, symbols = self.place.get, list(unit)
        agenda = [*map(get, map(add, symbols, symbols[1:]), repeat(NEVER)), NEVER]
        while (best := min(agenda)) != NEVER:
            left = agenda.index(best)
            del agenda[left]
            symbols[left] = pair = symbols[left] + symbols.pop(left + 1)
            if left:
                agenda[left - 1] = get(symbols[left - 1] + pair, NEVER)
            if left + 1 < len(symbols):
                agenda[left] = get(pair + symbols[left + 1], NEVER)
        return symbols

    def merge_long(self, unit: str) -> list[str]:
        """Symbols of one unit: best-scored adjacent pair first, leftmost of equals.

        An agenda entry is ``place of the score * n + left``; it is stale if that pair is no longer there.
        """
        place, n = self.place, len(unit)
        symbols: list[str | None] = list(unit)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = [place[p] * n + i for i, p in enumerate(map(str.__add__, symbols, symbols[1:])) if p in place]
        heapq.heapify(agenda)
        while agenda:
            score, left = divmod(heapq.heappop(agenda), n)
            right = after[left]
            if symbols[left] is None or right == n or place.get(pair := symbols[left] + symbols[right]) != score:
                continue
            symbols[left], symbols[right] = pair, None
            after[left] = right = after[right]
            if right < n:
                before[right] = left
                if (p := pair + symbols[right]) in place:
                    heapq.heappush(agenda, place[p] * n + left)
            if (first := before[left]) >= 0 and (p := symbols[first] + pair) in place:
                heapq.heappush(agenda, place[p] * n + first)
        return [s for s in symbols if s is not None]

    def merge(self, unit: str) -> list[int]:
        """Ids of one unit."""
        symbols = self.merge_short(unit) if len(unit) <= SHORT else self.merge_long(unit)
        try:
            return [self.id[s] for s in symbols]
        except KeyError:
            return [i for s in symbols for i in ([self.id[s]] if s in self.id else [self.byte[b] for b in s.encode()])]

    def unit(self, unit: str) -> tuple[tuple[int, ...], bytes]:
        got = self.known.get(unit)
        if got is None:
            got = self.older.get(unit)
            if got is None:
                ids = self.merge(unit)
                got = tuple(ids), b"".join([self.text[i] for i in ids])
                self.fresh.append(unit)
            if len(unit) <= LONGEST_REMEMBERED:
                self.known[unit] = got
        return got

    def encode(self, text: str) -> list[int]:
        """Ids of a text with the end id."""
        return [i for u in self.split(text) for i in self.unit(u)[0]] + [self.end]

    def split(self, text: str) -> list[str]:
        return self.units.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def decode(self, ids: list[int]) -> str:
        """The text of ids; the space put before a text goes, broken bytes become U+FFFD."""
        data = b"".join([self.text[i] for i in ids])
        return (data[1:] if data[:1] == b" " else data).decode(errors="replace")

    def check(self, texts: list[str]) -> None:
        """Hold the units seen since the last call, and the first text, against the library."""
        for at in range(0, len(self.fresh), CHECKED_AT_ONCE):
            units = self.fresh[at:at + CHECKED_AT_ONCE]
            # No piece reaches over a line's end, and nothing but a line's end has its byte.
            line = self.byte[ord("\n")]
            want = self.library.encode("\n" + "\n".join(units).replace(SPACE, " "))[1:]
            if want != [i for u in units for i in (line, *self.unit(u)[0])]:
                raise ValueError(f"the library encodes some of {units!r} differently")
        if texts:
            ids = self.encode(texts[0])
            if ids != self.library.encode(texts[0], add_eos=True) or self.decode(ids) != self.library.decode(ids):
                raise ValueError(f"the library encodes a text differently: {texts[0][:80]!r}")
        self.fresh.clear()
        if len(self.known) > REMEMBERED:
            self.older, self.known = self.known, {}


def load(model_path: str) -> Pieces:
    """The vocabulary, kept by a Python worker over its tasks until another operator's come."""
    return kept(model_path, lambda: Pieces(model_path))


def encode_decode(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id_col>, ids, decoded``: piece ids with the end id, and the text decoded from them.

    Null and empty texts have the end id alone and decode to an empty text.  Rows are encoded alone; null ids are
    carried; other columns are ignored.  ``model_path`` must be readable on every executor.
    """
    def make():
        pieces = load(model_path)

        def work(ids, texts):
            known, unit = pieces.known.get, pieces.unit
            codes, sizes, decoded = array("i"), [0], []
            plain = [t.decode() for t in texts]
            for t in plain:
                got = [known(u) or unit(u) for u in pieces.split(t)]
                codes.extend(chain.from_iterable([g for g, _ in got]))
                codes.append(pieces.end)
                sizes.append(len(codes))
                data = b"".join([d for _, d in got])
                decoded.append(data[1:] if data[:1] == b" " else data)
            pieces.check(plain)
            return pa.RecordBatch.from_arrays(
                [ids, pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.frombuffer(codes, np.int32))),
                 pa.array([d.decode(errors="replace") for d in decoded], pa.string())],
                ["id", "ids", "decoded"])
        return work

    id_type = df.schema[id_col].dataType.simpleString()
    return map_texts(df, id_col, text_col, f"id {id_type}, ids array<int>, decoded string", make, keep=model_path).withColumnRenamed("id", id_col)
