"""Personal data with exact source offsets, also when disguised.

Plain identifiers are found in the text as it is.  A text with signs of disguise also
goes through a transducer that rewrites homoglyphs, invisible characters, spelled
digits and at/dot words and remembers which source characters each output character
came from; identifiers found in its output are mapped back to source spans.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hazardgrid.llm.common import map_texts, small_batches
from hazardgrid.llm.toplevels import TOP_LEVELS

KINDS = ("email", "ip", "card", "phone")

# Letters of other scripts that look like ASCII letters, and digit words of the four languages of the texts.
LOOKALIKES = dict(zip("аеорсухіјѕԁһԛԝАВЕКМНОРСТХІЈЅαοορνιΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdhqwABEKMHOPCTXIJSaoopviABEZHIKMNOPTYX"))
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
    "plus": "+",
}

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Runs of digits are tried from their start only; a start inside a run could only fail in the same way.
_IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_GAPS = str.maketrans(",.-", "   ")
_SEPARATORS = str.maketrans("", "", " ().+-")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses; looks left and right of each ``@`` so that long runs stay linear."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        left = at
        while left > done and text[left - 1] in _LOCAL:
            left -= 1
        domain = _DOMAIN.match(text, at + 1) if left < at else None
        if domain:
            out.append((left, domain.end()))
        done = domain.end() if domain else at + 1
        at = text.find("@", done)
    return out


def plain(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans per kind in the text as written."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    found["email"] = emails(text)
    if "." in text:
        found["ip"] = [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].translate(_SEPARATORS)
            if 16 <= len(digits) <= 19 and luhn(digits):
                found["card"].append(m.span())
    if "+" in text:
        found["phone"] = [m.span() for m in _PHONE.finditer(text) if 8 <= len(m[0].translate(_SEPARATORS)) <= 15]
    return found


_NOT_PLAIN = "".join(LOOKALIKES) + INVISIBLE
_DIGIT = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_OPEN, _CLOSE = r"[\[({<]\s?", r"\s?[\])}>]"
#: A bare "at" or "dot" counts only before one of these; before a dot in brackets an at needs no more than a letter label.
_TOP = "|".join(sorted(TOP_LEVELS, key=len, reverse=True)) + "|xn--[a-z0-9-]+"
_AT = rf"\s?{_OPEN}(?:at|a|@){_CLOSE}\s?|(?<=[\w%+-])\s+at\s+(?=(?:[\w-]+(?:\s+dot\s+|\s?{_OPEN}(?:dot|\.){_CLOSE}\s?|\.))*[\w-]+(?:\s+dot\s+(?:{_TOP})|\s?{_OPEN}(?:dot|\.){_CLOSE}\s?(?:{_TOP}|[a-z]{{2,}}))\b)"
_DOT = rf"\s?{_OPEN}(?:dot|\.){_CLOSE}\s?|(?<=\w)\s+dot\s+(?=(?:[\w-]+\s+dot\s+)*(?:{_TOP}|[0-9]{{1,3}})\b)"
_DIGITS = rf"\b(?:(?:{_DIGIT})\b[\s,.-]{{0,2}}){{4,}}"
_CHARS = f"[{_NOT_PLAIN}\uff01-\uff5e\u0660-\u0669\u06f0-\u06f9\u0966-\u096f]"
_STEP = re.compile(rf"(?P<at>{_AT})|(?P<dot>{_DOT})|(?P<digits>{_DIGITS})|(?P<char>{_CHARS})", re.I)
# Signs of disguise that are quick to look for; without any of them the transducer changes nothing.
_ODD_CHAR = re.compile(_CHARS)
_IN_BRACKETS = re.compile(r"[\[({<]\s?(?:at|a|@|dot|\.)\s?[\])}>]", re.I)
_DIGIT_WORD = re.compile(_DIGIT, re.I)


def _fold(char: str) -> str:
    if char in INVISIBLE:
        return ""
    if char in LOOKALIKES:
        return LOOKALIKES[char]
    if char.isdecimal():
        return str(unicodedata.decimal(char))
    return unicodedata.normalize("NFKC", char)


def disguised(text: str) -> bool:
    """Whether the transducer could change anything that matters."""
    if not text.isascii() and _ODD_CHAR.search(text) or _IN_BRACKETS.search(text):
        return True
    words = text.lower().translate(_GAPS).split()
    return "dot" in words or b"\1\1\1\1" in bytes(map(DIGIT_WORDS.__contains__, words))


def rewrite(text: str) -> tuple[str, list[int], list[int]] | None:
    """The normalised text and, for each of its characters, source start and end.

    None if nothing is disguised.
    """
    out: list[str] = []
    starts: list[int] = []
    ends: list[int] = []

    def copy(a: int, b: int) -> None:
        out.append(text[a:b])
        starts.extend(range(a, b))
        ends.extend(range(a + 1, b + 1))

    def put(new: str, a: int, b: int) -> None:
        for c in new:
            out.append(c)
            starts.append(a)
            ends.append(b)

    last = 0
    for m in _STEP.finditer(text):
        copy(last, m.start())
        last = m.end()
        if m.lastgroup == "at":
            put("@", *m.span())
        elif m.lastgroup == "dot":
            put(".", *m.span())
        elif m.lastgroup == "char":
            put(_fold(m[0]), *m.span())
        else:
            at = m.start()
            for w in _DIGIT_WORD.finditer(text, m.start(), m.end()):
                gap = text[at:w.start()]
                if gap and not gap.isspace():
                    copy(at, w.start())                 # spaces between spelled digits go, other separators stay
                put(DIGIT_WORDS[w[0].lower()], *w.span())
                at = w.end()
            copy(at, m.end())
    if not last:
        return None
    copy(last, len(text))
    return "".join(out), starts, ends


def spans(text: str) -> tuple[dict[str, list[tuple[int, int]]], dict[str, list[tuple[int, int]]]]:
    """Plain spans, and further ones that only the rewritten text shows; those never lie inside plain ones of their kind.

    They may contain them: a disguised letter or dot often leaves a part that is an identifier by itself.
    """
    found = plain(text)
    more: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    seen = rewrite(text) if disguised(text) else None
    if seen:
        new, starts, ends = seen
        for kind, got in plain(new).items():
            for a, b in got:
                s, e = starts[a], ends[b - 1]
                if text[s:e] != new[a:b] and not any(x <= s and e <= y for x, y in found[kind]):
                    more[kind].append((s, e))
    return found, more


SPANS_TYPE = "array<struct<kind:string,start:bigint,end:bigint,disguised:boolean>>"
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("disguised", pa.bool_())]))


def listed(text: str) -> list[dict]:
    """All spans ordered by kind and start."""
    found, more = spans(text)
    return [{"kind": k, "start": a, "end": b, "disguised": d} for k in KINDS
            for a, b, d in sorted([(a, b, False) for a, b in found[k]] + [(a, b, True) for a, b in more[k]])]


def personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id_col>, spans``: kind, code-point offsets (end exclusive) and whether the source was disguised.

    Null and empty texts have no spans.  Rows are judged alone; null ids are carried; other columns are ignored.
    """
    def make():
        def work(ids, texts):
            return pa.RecordBatch.from_arrays([ids, pa.array([listed(t.decode()) for t in texts], _ARROW_SPANS)], ["id", "spans"])
        return work

    id_type = df.schema[id_col].dataType.simpleString()
    return map_texts(df, id_col, text_col, f"id {id_type}, spans {SPANS_TYPE}", make).withColumnRenamed("id", id_col)


def masked(text: str) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the union is replaced once."""
    out, done = [], 0
    for s in sorted(listed(text), key=lambda s: (s["start"], -s["end"])):
        if s["start"] >= done:
            out += [text[done:s["start"]], f"[{s['kind'].upper()}]"]
        done = max(done, s["end"])
    return "".join(out) + text[done:]


def mask_column(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else masked(t) for t in texts.to_pylist()], pa.string())


def mask(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with personal data in ``text_col`` replaced by ``[EMAIL]``, ``[IP]``, ``[CARD]`` or ``[PHONE]``; null stays null."""
    small_batches(df.sparkSession)
    return df.withColumn(text_col, F.arrow_udf(mask_column, "string")(F.col(text_col)))
