"""Exact substring deduplication by level-wise doubling.

A window of words that repeats has halves that repeat.  So windows of ``base`` words are
compared first and only those that repeat are extended to twice that length, and so on
up to ``window`` words.  At the first level a document offers, for every window of the
full length, just the part with the lowest hash (its anchor): equal windows have equal
anchors, so nothing is lost and about a sixth of the places are shuffled.

At the last level copies inside one Arrow batch are settled there, so a passage that
very many documents share sends one row per batch.  Window hashes have 96 bits.
"""

from __future__ import annotations

import gc
import time

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window, functions as F

from hazardgrid.llm.common import WordHashes, mix64, small_batches
from hazardgrid.session import stage

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Documents without an id come after all others.
_LAST = (1 << 63) - 1


def join_hashes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix64(left * _A + (right ^ _B))


def window_hashes(words: np.ndarray, size: int, known: dict[int, np.ndarray]) -> np.ndarray:
    """Hashes of all windows of ``size`` words from those of half the size."""
    if size not in known:
        half = size // 2
        a = window_hashes(words, half, known)
        out = join_hashes(a[:len(a) - half], a[half:])
        known[size] = join_hashes(out[:-1], words[size - 1:]) if size % 2 else out
    return known[size]


def anchors(hashes: np.ndarray, base: int, window: int) -> np.ndarray:
    """For each window of ``window`` words, the place of the lowest hash among its windows of ``base`` words."""
    views = sliding_window_view(mix64(hashes), window - base + 1)
    return np.arange(len(views)) + views.argmin(axis=1)


def lengths(window: int, base: int) -> list[int]:
    """``base`` and its doublings below ``window``, then ``window``."""
    out = [base]
    while 2 * out[-1] < window:
        out.append(2 * out[-1])
    return [*out, window]


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    # Tells texts of one id apart; all rows without an id share one, so theirs has all bits.
    th = F.when(F.col("doc_id").isNull(), F.xxhash64(text)).otherwise(F.pmod(F.xxhash64(text), F.lit(2147483647)))
    return docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LAST)).alias("id"), th.alias("th"), text.alias("text"))


def _batches(batches, needs: int):
    """Words' hashes of the texts that have ``needs`` words at least: (id, text hash, hashes, other columns)."""
    of = WordHashes()
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns[:2]] + [batch.column(2).cast(pa.binary()).to_pylist()] + [c.to_pylist() for c in batch.columns[3:]]
        out = []
        for i, th, text, *more in zip(*columns):
            words = text.split()
            if len(words) >= needs:
                out.append((i, th, of(words), more))
        if out:
            yield out


def first_level(docs: DataFrame, size: int, window: int) -> DataFrame:
    """``id, th, pos``: anchors whose ``size`` words occur more than once among all anchors."""
    def run(batches):
        for rows in _batches(batches, window):
            h, ids, ths, pos = [], [], [], []
            for i, th, words, _ in rows:
                part = window_hashes(words, size, {1: words})
                at = np.unique(anchors(part, size, window))
                h.append(part[at])
                pos.append(at)
                ids.append(np.full(len(at), i))
                ths.append(np.full(len(at), th, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(h).view(np.int64)), pa.array(np.concatenate(ids)), pa.array(np.concatenate(ths)),
                                              pa.array(np.concatenate(pos).astype(np.int32))], ["h", "id", "th", "pos"])

    places = _keyed(docs).mapInArrow(run, "h bigint, id bigint, th bigint, pos int")
    again = stage(places.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h"), "substring-again")
    return places.join(again, "h").select("id", "th", "pos")


def next_level(docs: DataFrame, survivors: DataFrame, base: int, size: int, window: int) -> DataFrame:
    """As :func:`first_level` one doubling further: anchors that lie in some window of ``size`` words that repeats.

    A repeated window of the full length holds such a window around its anchor, so nothing is lost.
    """
    def run(batches):
        for rows in _batches(batches, window):
            h, ids, ths, pos = [], [], [], []
            for i, th, words, (places,) in rows:
                at = np.asarray(places)
                part = window_hashes(words, size, {1: words})
                # A window that holds the anchor holds ``size`` words that start at one of these places.
                for back in range(0, size - base + 1):
                    s = at - back
                    good = (s >= 0) & (s < len(part))
                    h.append(part[s[good]])
                    pos.append(at[good])
                    ids.append(np.full(int(good.sum()), i))
                    ths.append(np.full(int(good.sum()), th, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(h).view(np.int64)), pa.array(np.concatenate(ids)), pa.array(np.concatenate(ths)),
                                              pa.array(np.concatenate(pos).astype(np.int32))], ["h", "id", "th", "pos"])

    places = _keyed(docs).join(survivors, ["id", "th"]).select("id", "th", "text", "places").mapInArrow(run, "h bigint, id bigint, th bigint, pos int")
    again = stage(places.groupBy("h").agg(F.countDistinct("id", "th", "pos").alias("n")).filter("n > 1").select("h"), "substring-again")
    return places.join(again, "h").select("id", "th", "pos").distinct()


def last_level(docs: DataFrame, survivors: DataFrame, base: int, window: int) -> DataFrame:
    """``id, th, pos, len``: runs of windows that also start earlier, given the anchors that are left."""
    def run(batches):
        for rows in _batches(batches, window):
            h, check, ids, ths, pos = [], [], [], [], []
            for i, th, words, (places,) in rows:
                known = {1: words}
                at = anchors(window_hashes(words, base, known), base, window)
                s = np.flatnonzero(np.isin(at, np.asarray(places)))
                h.append(window_hashes(words, window, known)[s])
                other = mix64(words ^ _B)
                check.append((window_hashes(other, window, {1: other})[s] >> np.uint64(33)).astype(np.int32))
                pos.append(s)
                ids.append(np.full(len(s), i))
                ths.append(np.full(len(s), th, np.int64))
            h, check, ids, ths, pos = map(np.concatenate, (h, check, ids, ths, pos))
            order = np.lexsort((ths, pos, ids, check, h))
            h, check, ids, ths, pos = (x[order] for x in (h, check, ids, ths, pos))
            same = np.concatenate(([False], (h[1:] == h[:-1]) & (check[1:] == check[:-1])))
            # Earlier means a lower id or start; rows of one id and start stand side by side.
            group = np.cumsum(~same) - 1
            first = np.flatnonzero(~same)
            later = (ids != ids[first][group]) | (pos != pos[first][group])
            yield _rows(h[~later], check[~later], ids[~later], ths[~later], pos[~later], np.ones(int((~later).sum()), np.int32), False)
            if later.any():
                i, t, p = ids[later], ths[later], pos[later]
                order = np.lexsort((p, t, i))
                i, t, p = i[order], t[order], p[order]
                start = np.flatnonzero(np.concatenate(([True], (i[1:] != i[:-1]) | (t[1:] != t[:-1]) | (p[1:] != p[:-1] + 1))))
                n = np.diff(np.append(start, len(p)))
                i, t, p = i[start], t[start], p[start]
                yield _rows(mix64(i.view(np.uint64) + p.astype(np.uint64) * _A), np.zeros(len(i), np.int32), i, t, p, n, True)

    found = _keyed(docs).join(survivors, ["id", "th"]).select("id", "th", "text", "places").mapInArrow(
        run, "h bigint, check int, id bigint, th bigint, pos int, len int, sure boolean")
    same = Window.partitionBy("h", "check", "sure").orderBy("id", "pos")
    return found.withColumn("rank", F.rank().over(same)).filter("sure OR rank > 1").select("id", "th", "pos", "len")


def _rows(h, check, ids, ths, pos, n, sure: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(h.view(np.int64)), pa.array(check), pa.array(ids), pa.array(ths), pa.array(pos.astype(np.int32)), pa.array(n.astype(np.int32)),
         pa.array(np.full(len(h), sure))], ["h", "check", "id", "th", "pos", "len", "sure"])


def _release(df: DataFrame) -> None:
    """Let the driver notice that the shuffles behind staged tables are no longer needed, so their files go."""
    for _ in range(2):
        gc.collect()
        df.sparkSession.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def remove_repeats(docs: DataFrame, window: int = 20, base: int = 10) -> DataFrame:
    """``doc_id, n_words, n_removed, kept``: each text without the words of windows that also start earlier.

    Earlier: in a smaller id, or at an earlier start in the same id; rows that share an id are one document in this.
    Words are runs of anything but space and U+0009-U+000D, unchanged; ``kept`` joins those left by one space.  Null and
    empty texts have no words; rows without an id come after all others; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    sizes = lengths(window, base)
    places = first_level(docs, base, window)
    for size in sizes[1:-1]:
        places = next_level(docs, _gathered(places), base, size, window)
    survivors = _gathered(places)
    del places
    _release(docs)
    removed = stage(last_level(docs, survivors, base, window).groupBy("id", "th").agg(
        F.collect_list(F.struct("pos", "len")).alias("runs")), "substring-removed")
    _release(docs)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            out = []
            for text, runs in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()):
                words = text.split()
                gone = 0
                if runs:
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, [r["pos"] for r in runs], 1)
                    np.add.at(edge, [r["pos"] + r["len"] - 1 + window for r in runs], -1)
                    keep = np.cumsum(edge[:-1]) == 0
                    gone = len(words) - int(keep.sum())
                    kept = [words[i] for i in np.flatnonzero(keep).tolist()]
                out.append((len(words), gone, b" ".join(kept if runs else words).decode()))
            n, gone, kept = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())],
                                             ["doc_id", "n_words", "n_removed", "kept"])

    rows = _keyed(docs.withColumn("doc_id", F.col("doc_id"))).join(removed, ["id", "th"], "left")
    return rows.select(F.when(F.col("id") != _LAST, F.col("id")).cast(id_type).alias("doc_id"), "text", "runs").mapInArrow(
        run, f"doc_id {id_type}, n_words bigint, n_removed bigint, kept string")


def _gathered(places: DataFrame) -> DataFrame:
    """The places of each document; no more than it has words."""
    return stage(places.groupBy("id", "th").agg(F.collect_set("pos").alias("places")), "substring-places")
