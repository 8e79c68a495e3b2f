"""Bloom filters from built-in bitmap functions: cut a large side down before it is shuffled.

A filter is a table of bitmaps, joined on the bucket that a key hashes to.  It never loses a member, so an exact join follows; a stranger passes now
and then.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Bits of one bitmap of ``bitmap_construct_agg``.
_BITS = 32768
#: Bitmaps of a filter at most (32 MB), so that it can always be broadcast.
MAX_BUCKETS = 8192
_BITS_PER_KEY = 16


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(1), key), F.lit(buckets)).cast("int")


def _spots(key: Column) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(seed), key), F.lit(_BITS)) for seed in (2, 3)]


def bloom_filter(keys: DataFrame, key: str) -> tuple[DataFrame, int]:
    """``(bucket, bitmap)`` rows over the non-null values of ``key``, and the number of buckets: 16 bits for each row, up to ``MAX_BUCKETS``."""
    known = keys.filter(F.col(key).isNotNull())
    buckets = min(MAX_BUCKETS, max(1, -(-known.count() * _BITS_PER_KEY // _BITS)))
    spots = known.select(_bucket(F.col(key), buckets).alias("bucket"), F.explode(F.array(*_spots(F.col(key)))).alias("spot"))
    return spots.groupBy("bucket").agg(F.bitmap_construct_agg("spot").alias("bitmap")), buckets


def keep_possible(df: DataFrame, filters: dict[str, tuple[DataFrame, int]]) -> DataFrame:
    """Rows of ``df`` of which at least one column of ``filters`` may be in its filter.  Filters are broadcast: their size is bounded."""
    kept, hits = df, F.lit(False)
    for i, (column, (bitmaps, buckets)) in enumerate(filters.items()):
        named = F.broadcast(bitmaps.withColumnsRenamed({"bucket": f"_bucket{i}", "bitmap": f"_bitmap{i}"}))
        kept = kept.withColumn(f"_bucket{i}", _bucket(F.col(column), buckets)).join(named, f"_bucket{i}", "left")
        hit = F.col(column).isNotNull()
        for spot in _spots(F.col(column)):
            byte = F.substring(f"_bitmap{i}", F.floor(spot / 8).cast("int") + 1, F.lit(1))
            set_ = F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), (spot % 8).cast("int")) == 1
            hit = hit & F.coalesce(set_, F.lit(False))
        hits = hits | hit
    return kept.filter(hits).select(df.columns)
