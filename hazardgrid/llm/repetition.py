"""Quality rules on repetition: characters inside repeated n-grams and lines.

Windows of several lengths are compared by rolling hashes in numpy, each length built
from the one before; a length without repeats ends the search, since longer windows
cannot repeat either.  A later copy counts, the first occurrence does not.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hazardgrid.llm.common import WordHashes, map_texts, mix64

# Published limits on the share of characters inside repeated n-grams, and of repeated lines and their characters.
NGRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
LINE_LIMIT = 0.30
LINE_CHARS_LIMIT = 0.20

SYMBOLS = b"#*$%&|<>"


def cover(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Mask of the ``n`` places covered by windows of ``width`` at ``starts``."""
    edge = np.zeros(n + 1, np.int32)
    edge[starts] += 1                        # starts are distinct
    edge[starts + width] -= 1
    return np.cumsum(edge[:-1]) > 0


def repeats(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places whose value occurs more than once, and those of them that are not the first."""
    order = np.argsort(hashes, kind="stable")
    same = hashes[order][1:] == hashes[order][:-1]
    later = order[1:][same]
    return np.union1d(later, order[:-1][same]), np.sort(later)


def measure(text: bytes, hashes_of: WordHashes, sizes: tuple[int, ...]) -> tuple:
    """``n_words, word_chars, n_symbols, n_lines, n_dup_lines, dup_line_chars, n_repeat_words, shares`` of one text."""
    words = text.split()
    n = len(words)
    n_symbols = len(text) - len(text.translate(None, SYMBOLS))
    seen: set[bytes] = set()
    n_lines = n_dup = dup_chars = 0
    for line in text.split(b"\n"):
        parts = line.split()
        if parts:
            n_lines += 1
            if line in seen:
                n_dup += 1
                dup_chars += len(b"".join(parts).decode())
            seen.add(line)
    word_chars = len(b"".join(words).decode())
    shares, n_repeat = [0.0] * len(sizes), 0
    if n > min(5, *sizes):
        lengths = np.fromiter((len(w.decode()) for w in words), np.int64, n)
        base = hashes_of(words)
        rolled = base
        for size in range(2, max(5, *sizes) + 1):
            if size > n:
                break
            rolled = mix64(rolled[:-1] * np.uint64(3) + base[size - 1:])
            if size != 5 and size not in sizes:
                continue
            every, later = repeats(rolled)
            if size == 5:
                n_repeat = int(cover(every, 5, n).sum())
            if not len(later):
                break
            if size in sizes:
                shares[sizes.index(size)] = float(lengths[cover(later, size, n)].sum() / word_chars)
    return n, word_chars, n_symbols, n_lines, n_dup, dup_chars, n_repeat, shares


def repetition(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               limits: dict[int, float] | None = None) -> DataFrame:
    """Repetition figures per row and ``repetitive``: whether any published limit is exceeded.

    ``dup_shares`` holds, per n-gram length of ``limits``, the share of word characters inside later copies of an
    n-gram.  Null and empty texts have no words, zero everywhere and are not repetitive.  Rows are judged alone, so
    repeated rows give repeated results; null ids are carried; other columns are ignored.
    """
    limits = limits or NGRAM_LIMITS
    sizes = tuple(sorted(limits))
    names = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "dup_line_chars", "n_repeat_words")

    def make():
        hashes_of = WordHashes()

        def work(ids, texts):
            rows = [measure(t, hashes_of, sizes) for t in texts]
            columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(names))]
            return pa.RecordBatch.from_arrays(
                [ids, *columns, pa.array([r[-1] for r in rows], pa.list_(pa.float64()))], ["id", *names, "dup_shares"])
        return work

    id_type = df.schema[id_col].dataType.simpleString()
    out = map_texts(df, id_col, text_col,
                    f"id {id_type}, {', '.join(f'{n} bigint' for n in names)}, dup_shares array<double>", make)
    bad = (F.col("n_dup_lines") > LINE_LIMIT * F.col("n_lines")) | (F.col("dup_line_chars") > LINE_CHARS_LIMIT * F.col("word_chars"))
    for i, size in enumerate(sizes):
        bad = bad | (F.col("dup_shares")[i] > limits[size])
    return out.withColumn("repetitive", bad).withColumnRenamed("id", id_col)
