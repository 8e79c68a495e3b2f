"""Helpers shared by the text operators: Arrow batches of texts, word splitting, 64-bit mixing."""

from __future__ import annotations

import gc
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Rows of text per Arrow batch: a few MB of ordinary documents in a Python worker at a time.
TEXTS_PER_BATCH = 1000

#: Characters that separate words in the contracts: space and U+0009 to U+000D.  ``bytes.split()`` uses the same set.
WORD_GAP = r"[\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the texts that one Python worker holds at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXTS_PER_BATCH))


#: What tasks share in this Python worker, by name.
_KEPT: dict[str, object] = {}


def kept(name: str | None, make: Callable[[], object] | None = None) -> object:
    """What the tasks of ``name`` share in a Python worker, made by the first of them.

    Spark goes on to use a worker for other operators, beside whose tasks nothing should lie that they cannot use: what is
    kept under any other name is dropped.  Without ``make`` nothing is made, without a name nothing stays.
    """
    if others := _KEPT.keys() - {name}:
        for other in others:
            del _KEPT[other]
        gc.collect()                                   # what is kept may refer to itself
        pa.default_memory_pool().release_unused()
    if make and name not in _KEPT:
        _KEPT[name] = make()
    return _KEPT.get(name)


def map_texts(df: DataFrame, id_col: str, text_col: str, schema: str,
              make: Callable[[], Callable[[pa.Array, list[bytes]], pa.RecordBatch | None]], keep: str | None = None) -> DataFrame:
    """Run ``make()(ids, texts)`` over every Arrow batch of ``id_col, text_col``.

    ``make`` runs once per task, so caches live as long as a task, but for what it has from :func:`kept` under the name
    ``keep``.  Texts arrive as UTF-8 bytes; a null text is empty.
    """
    small_batches(df.sparkSession)
    chosen = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept(keep)
        work = make()
        for batch in batches:
            if batch.num_rows:
                out = work(batch.column(0), batch.column(1).cast(pa.binary()).to_pylist())
                if out is not None and out.num_rows:
                    yield out
        pa.default_memory_pool().release_unused()      # the worker may stay idle for long

    return chosen.mapInArrow(run, schema)


def held_out(id_col: str, remainder: int) -> Column:
    """True where crc32 of the id as text leaves ``remainder`` modulo 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == remainder, F.lit(False))


def crc_mod5(value: int | None) -> int:
    return -1 if value is None else zlib.crc32(str(value).encode()) % 5


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes:
    """64-bit hashes of words, remembered up to a bound."""

    def __init__(self, seed: int = 0, bound: int = 300_000):
        import xxhash
        self.hash, self.seed, self.bound, self.known = xxhash.xxh64_intdigest, seed, bound, {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > self.bound:
            known.clear()
        for w in {*words}.difference(known):
            known[w] = self.hash(w, self.seed)
        return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
