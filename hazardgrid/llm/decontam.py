"""Benchmark decontamination by latent semantic retrieval.

Passages of every text are projected into a latent space and compared by cosine with
the benchmark's items; candidates are verified by the longest common subsequence of
words and by the item's answer.  The space comes from a randomised SVD of TF-IDF rows:
the benchmark's passages and a sketch of all passages of all texts.  The sketch adds every
passage, with a random sign, to one of a fixed number of rows (CountSketch), so its
products with itself are those of all passages in expectation; its counts are whole numbers, so
any order of the texts gives the same.  Document frequencies count all texts and every
passage of every text is compared.
"""

from __future__ import annotations

import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hazardgrid.llm.common import map_texts, mix64, small_batches
from hazardgrid.session import stage

#: Items per broadcast; a larger benchmark is taken in several rounds, so the broadcast stays bounded.
ITEMS_PER_ROUND = 512
#: Rows of the sketch that all passages of the texts are added up in, and its weight (sum of squares) beside the benchmark's items.
SKETCH = 1024
SKETCH_WEIGHT = 320.0
RANK = 640
OVERSAMPLE = 16
POWER_ROUNDS = 2
#: Words of a passage and from one passage to the next.
PASSAGE, STEP = 48, 24
MIN_COSINE = 0.3
MIN_LCS = 0.6
#: Part of the answer that must occur, unless this much of the item does.
MIN_ANSWER, SURE_LCS = 0.5, 0.8

_PUNCTUATION = bytes.maketrans(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", b" " * 32)


def words(text: bytes) -> list[bytes]:
    """Lower-case words; ASCII punctuation separates them."""
    return text.lower().translate(_PUNCTUATION).split()


def lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence, one bit per word of ``a``."""
    where: dict = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        m = where.get(w)
        if m:
            u = row & m
            row = (row + u | row - u) & full
    return len(a) - row.bit_count()


class Item:
    """A benchmark item: its words and those of its answer (the last sentence where no answer is given)."""

    def __init__(self, item_id, text: str, answer: str | None):
        self.id = item_id
        self.words = words(text.encode())
        tail = answer if answer else [s for s in text.replace("\n", ". ").split(". ") if words(s.encode())][-1:]
        self.answer = words((tail if isinstance(tail, str) else "".join(tail)).encode())

    def verify(self, near: list[bytes]) -> tuple[float, float, bool]:
        ratio = lcs(self.words, near) / len(self.words)
        if ratio < MIN_LCS:
            return ratio, 0.0, False
        answer = lcs(self.answer, near) / max(1, len(self.answer))
        return ratio, answer, ratio >= SURE_LCS or answer >= MIN_ANSWER


def scan(docs: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """Document frequencies of the benchmark's words and the sketch of all passages, a part for each task.

    ``row`` -1 holds, by word number, the texts with the word and last the number of all texts; the other rows are those of the sketch,
    each the signed counts of the words of its passages.  ``counts`` are 64-bit integers as bytes; sum them by ``row``.
    """
    small_batches(docs.sparkSession)
    width = len(number)
    chosen = docs.select(F.col("doc_id").cast("string").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches):
        df = np.zeros(width + 1, np.int64)
        sketch = np.zeros(SKETCH * width, np.int64)
        get = number.get
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
            if not texts:
                continue
            found = [[get(w, -1) for w in words(t)] for t in texts]
            n = np.array([len(f) for f in found], np.int64)
            ids = np.fromiter(chain.from_iterable(found), np.int64, int(n.sum()))
            at = np.flatnonzero(ids >= 0)
            known, text = ids[at], np.repeat(np.arange(len(n)), n)[at]
            df[width] += len(n)
            np.add.at(df, np.unique(text * width + known) % width, 1)
            # Each word lies in the passage that begins in its step and in the one before.
            steps = np.maximum(1, -(-n // STEP))
            first = np.cumsum(steps) - steps
            spots, signs = passage_spots([zlib.crc32(t, zlib.crc32(repr(k).encode())) for k, t in zip(keys, texts)], steps)
            step = (at - (np.cumsum(n) - n)[text]) // STEP
            last = np.maximum(0, -(-(n - STEP) // STEP) - 1)[text]
            for ok, passage in ((step <= last, step), (step > 0, step - 1)):
                p = (first[text] + passage)[ok]
                np.add.at(sketch, spots[p] * width + known[ok], signs[p])
        parts = sketch.reshape(SKETCH, width)
        used = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([
            pa.array([-1, *used.tolist()], pa.int32()), pa.array([df.tobytes(), *(parts[i].tobytes() for i in used)], pa.binary())], ["row", "counts"])

    return chosen.mapInArrow(run, "row int, counts binary")


def passage_spots(keys: list[int], passages: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sketch row and sign of each passage of each text, by hash."""
    own = np.arange(int(passages.sum())) - np.repeat(np.cumsum(passages) - passages, passages)
    h = mix64(own.astype(np.uint64) + (np.repeat(np.array(keys, np.uint64), passages) << np.uint64(32)))
    return (h % np.uint64(SKETCH)).astype(np.int64), 1 - 2 * (h >> np.uint64(63)).astype(np.int64)


def added(parts: DataFrame) -> DataFrame:
    """``row, counts`` of :func:`scan` summed by row."""
    def total(table: pa.Table) -> pa.Table:
        out = None
        for counts in table.column("counts").to_pylist():
            one = np.frombuffer(counts, np.int64)
            out = one.copy() if out is None else out + one
        return pa.table([pa.array([table.column("row")[0].as_py()], pa.int32()), pa.array([out.tobytes()], pa.binary())], ["row", "counts"])

    return parts.groupBy("row").applyInArrow(total, "row int, counts binary")


def tfidf(at: list[int], other: int, idf: np.ndarray, unknown: float) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers and weights of a passage, by the norm that words outside the vocabulary add to."""
    f, tf = np.unique(np.asarray(at, np.int64), return_counts=True)
    v = tf * idf[f]
    return f, v / max(1e-9, np.sqrt((v * v).sum() + other * unknown ** 2))


def latent_space(items: np.ndarray, sketch: np.ndarray, rank: int) -> np.ndarray:
    """Right singular vectors (terms x rank) of the items' TF-IDF rows and the sketch's by randomised SVD.

    Both are bounded: at most ``ITEMS_PER_ROUND`` and ``SKETCH`` rows over the benchmark's words.
    """
    rows = np.concatenate([items, sketch]).astype(np.float32)

    def multiply(basis: np.ndarray) -> np.ndarray:
        return (rows.T @ (rows @ basis.astype(np.float32))).astype(np.float64)

    rng = np.random.default_rng(7)
    size = min(rank + OVERSAMPLE, rows.shape[1])
    basis = np.linalg.qr(rng.standard_normal((rows.shape[1], size)))[0]
    for _ in range(POWER_ROUNDS):
        basis = np.linalg.qr(multiply(basis))[0]
    image = multiply(basis)                                # (A'A) Q
    values, turn = np.linalg.eigh((basis.T @ image + image.T @ basis) / 2)
    return (basis @ turn[:, ::-1][:, :min(rank, size)]).astype(np.float32)


def leaks_of(docs: DataFrame, items: list[Item]) -> DataFrame:
    """One round of :func:`leaks` for a bounded list of items."""
    spark = docs.sparkSession
    number = {w: i for i, w in enumerate(sorted({w for it in items for w in it.words}))}
    df, total = np.zeros(len(number)), 0
    sketch = np.zeros((SKETCH, len(number)))
    for r in stage(added(scan(docs, number)), "decontam-scan").toLocalIterator():    # at most SKETCH + 1 rows over the benchmark's words
        counts = np.frombuffer(r["counts"], np.int64)
        if r["row"] < 0:
            df, total = counts[:-1].astype(float), int(counts[-1])
        else:
            sketch[r["row"]] = counts
    idf = np.log(1 + total / (df + 0.5))
    unknown = float(idf.mean())
    own = np.zeros((len(items), len(number)))
    for k, it in enumerate(items):
        f, v = tfidf([number[w] for w in it.words], 0, idf, unknown)
        own[k, f] = v
    sketch *= idf
    sketch *= np.sqrt(SKETCH_WEIGHT / max(1e-9, (sketch ** 2).sum()))
    # As many directions as there are items, so that each keeps its own, and some for what texts share.
    space = latent_space(own, sketch, min(RANK, len(items) + 64))
    targets = np.zeros((len(items), space.shape[1]), np.float32)
    for k in range(len(items)):
        targets[k] = own[k].astype(np.float32) @ space
    targets /= np.maximum(np.linalg.norm(targets, axis=1, keepdims=True), 1e-9)
    # Terms x items: the projection and the comparison in one table, since both are linear.
    shared = spark.sparkContext.broadcast((number, idf, unknown, (space @ targets.T).astype(np.float32), items))

    def make():
        number, idf, unknown, table, items = shared.value
        weighted = (table * idf[:, None]).astype(np.float32)
        table_of = number.get

        def work(ids, texts):
            out = []
            for key, t in zip(ids.to_pylist(), texts):
                ws = words(t)
                for k, row in search(ws, [table_of(w, -1) for w in ws], weighted, idf, unknown, items).items():
                    out.append((key, items[k].id, *row))
            columns = list(zip(*out)) or [[]] * 7
            types = [ids.type, pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)],
                                              ["doc_id", "item_id", "cosine", "lcs_ratio", "answer_ratio", "start", "end"])
        return work

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return map_texts(docs, "doc_id", "text", f"doc_id {id_type}, item_id bigint, cosine double, lcs_ratio double, answer_ratio double, start bigint, end bigint", make)


def search(ws: list[bytes], at: list[int], weighted: np.ndarray, idf: np.ndarray, unknown: float, items: list[Item]) -> dict[int, tuple]:
    """Verified items of one text: number -> (cosine, LCS ratio, answer ratio, first word, end)."""
    found: dict[int, tuple] = {}
    n = len(ws)
    if not n:
        return found
    ids = np.array(at, np.int64)
    known = np.flatnonzero(ids >= 0)
    square = np.full(n, unknown ** 2)
    square[known] = idf[ids[known]] ** 2
    starts = np.arange(0, max(1, n - STEP), STEP)
    norms = np.sqrt(np.add.reduceat(square, np.arange(0, n, STEP)))
    norms = np.sqrt(norms[:len(starts)] ** 2 + np.append(norms[1:], 0)[:len(starts)] ** 2)
    for chunk in range(0, len(starts), 1024):              # bounded memory for long texts
        s = starts[chunk:chunk + 1024]
        lo, hi = s[0], min(n, s[-1] + PASSAGE)
        k = known[np.searchsorted(known, lo):np.searchsorted(known, hi)]
        if not len(k):
            continue
        half = (k - lo) // STEP
        first = np.flatnonzero(np.concatenate(([True], half[1:] != half[:-1])))
        sums = np.zeros((len(s) + 1, weighted.shape[1]), np.float32)
        sums[half[first]] = np.add.reduceat(weighted[ids[k]], first)
        cosine = (sums[:-1] + sums[1:]) / np.maximum(norms[chunk:chunk + 1024], 1e-9)[:, None]
        for w, i in zip(*np.nonzero(cosine >= MIN_COSINE)):
            item = items[i]
            if i in found and found[i][1] >= 1.0:
                continue
            a = max(0, int(s[w]) - len(item.words))
            b = min(n, int(s[w]) + PASSAGE + len(item.words))
            ratio, answer, leaked = item.verify(ws[a:b])
            if leaked and (i not in found or ratio > found[i][1]):
                found[i] = (float(cosine[w, i]), ratio, answer, a, b)
    return found


def leaks(docs: DataFrame, benchmark: DataFrame, answer_col: str | None = None) -> DataFrame:
    """``doc_id, item_id, cosine, lcs_ratio, answer_ratio, start, end``: items that a text contains or paraphrases.

    ``start`` and ``end`` bound the words compared.  A repeated text gives repeated rows; an item of equal words is
    reported under each of its ids.  Null and empty texts match nothing; items without words or id are left out; without
    items the result is empty.
    """
    answer = F.col(answer_col) if answer_col else F.lit(None).cast("string")
    asked = benchmark.select("item_id", "text", answer.alias("answer")).filter("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    rounds = -(-asked.count() // (ITEMS_PER_ROUND // 2))
    out = None
    for k in range(rounds):
        rows = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(rounds)) == k).orderBy("item_id", "text").collect()   # about half of ITEMS_PER_ROUND
        items = [it for it in (Item(r["item_id"], r["text"], r["answer"]) for r in rows) if it.words]
        if items:
            part = leaks_of(docs, items)
            out = part if out is None else out.unionByName(part)
    if out is None:
        id_type = docs.schema["doc_id"].dataType.simpleString()
        return docs.sparkSession.createDataFrame(
            [], f"doc_id {id_type}, item_id bigint, cosine double, lcs_ratio double, answer_ratio double, start bigint, end bigint")
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without those that leak an item; of rows without an id all go if one does."""
    gone = stage(leaks(docs, benchmark).select(F.col("doc_id").alias("_gone")).distinct(), "decontam-gone")
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("_gone")), "left_anti")
