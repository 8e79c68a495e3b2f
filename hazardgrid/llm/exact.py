"""Exact deduplication against a history: a sharded minimal perfect hash over the distinct digests of earlier rows.

The history's distinct SHA-256 digests are dealt to shards; each shard is one row with a minimal perfect hash and arrays in slot order: the full
digest, the winner's id, row number and the count.  A new digest looks up its slot and compares all 32 bytes; what differs was never seen and is
grouped apart.  Only digests travel; texts are read once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hazardgrid.llm.perfect_hash import DIGEST, PerfectHash, as_words
from hazardgrid.session import stage

#: Digests that a shard, and the part of the new digests that meets it in one task, hold on average.
SHARD_DIGESTS = 500_000
#: Digests of more rows than this share of the table are joined by broadcast: at most this many.
HOT_SHARE = 1000

_INDEX = "shard int, hash binary, digests binary, ids array<bigint>, rows array<bigint>, counts array<bigint>"


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row_no, id, digest`` of every row, staged: a number unique in the table, the id and the text's SHA-256; null text is empty."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    found = df.select(F.col(id_col).cast("bigint").alias("id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))
    return stage(found.select(F.monotonically_increasing_id().alias("row_no"), "id", "digest"), "exact-digests")


def distinct_digests(rows: DataFrame) -> DataFrame:
    """``digest, id, row_no, n``: the row with the largest id (then the largest row number) stands for all of its digest; no id is the smallest."""
    best = F.max(F.struct(F.col("id").isNotNull().alias("has"), "id", "row_no"))
    return rows.groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("n")).select("digest", "best.id", "best.row_no", "n")


def _shard(shards: int):
    return F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int").alias("shard")


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, DIGEST)


def build_index(distinct: DataFrame, shards: int) -> DataFrame:
    """One row per shard of :func:`distinct_digests`: the perfect hash and, in slot order, digests and locators."""
    def build(table: pa.Table) -> pa.Table:
        words = as_words(_matrix(table["digest"]))
        hashed = PerfectHash.build(words)
        order = np.argsort(hashed.find(words))
        lists = [pa.array([table[c].take(pa.array(order)).to_pylist()], pa.list_(pa.int64())) for c in ("id", "row_no", "n")]
        return pa.table([pa.array([table["shard"][0].as_py()], pa.int32()), pa.array([hashed.to_bytes()], pa.binary()), pa.array([words[order].tobytes()], pa.binary()), *lists],
                        ["shard", "hash", "digests", "ids", "rows", "counts"])

    return distinct.select(_shard(shards), "digest", "id", "row_no", "n").groupBy("shard").applyInArrow(build, _INDEX)


def look_up(distinct: DataFrame, index: DataFrame, shards: int, parts: int = 1) -> DataFrame:
    """``digest, id, row_no, n, seen, old_id, old_row, old_n``: new distinct digests with what the index holds of them, byte for byte.

    A shard's new digests meet its index in ``parts`` tasks.
    """
    def probe(new: pa.Table, old: pa.Table) -> pa.Table:
        words = as_words(_matrix(new["digest"]))
        seen = np.zeros(len(words), bool)
        found = {c: pa.nulls(len(words), pa.int64()) for c in ("ids", "rows", "counts")}
        if old.num_rows and len(words):
            held = as_words(np.frombuffer(old["digests"][0].as_py(), np.uint8))
            slots = PerfectHash.from_bytes(old["hash"][0].as_py()).find(words)
            seen = slots >= 0
            seen[seen] = (held[slots[seen]] == words[seen]).all(axis=1)
            at = pa.array(slots, mask=~seen)
            found = {c: old[c].combine_chunks().flatten().take(at) for c in found}
        return pa.table([new["digest"], new["id"], new["row_no"], new["n"], pa.array(seen), *found.values()],
                        ["digest", "id", "row_no", "n", "seen", "old_id", "old_row", "old_n"])

    new = distinct.select(_shard(shards), F.pmod(F.crc32("digest"), F.lit(parts)).cast("int").alias("part"), "digest", "id", "row_no", "n")
    old = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return new.groupBy("shard", "part").cogroup(old.groupBy("shard", "part")).applyInArrow(
        probe, "digest binary, id bigint, row_no bigint, n bigint, seen boolean, old_id bigint, old_row bigint, old_n bigint")


def _better(id_a, row_a, id_b, row_b):
    """Whether locator ``a`` wins: an id before none, the larger id, the larger row number."""
    return F.struct(id_a.isNotNull(), id_a, row_a) > F.struct(id_b.isNotNull(), id_b, row_b)


def winners(history: DataFrame, incoming: DataFrame) -> DataFrame:
    """``digest, keep_id, keep_row, group_size`` of every digest of both tables of :func:`digests`.

    ``incoming`` is resolved by the index over ``history``: repeats add to their slot's count and may take over as winner, the others form groups of
    their own.
    """
    old = stage(distinct_digests(history), "exact-history")
    new = stage(distinct_digests(incoming), "exact-incoming")
    n_old, n_new = old.count(), new.count()
    shards = max(1, -(-n_old // SHARD_DIGESTS))
    parts = max(1, -(-n_new // (shards * SHARD_DIGESTS)))
    found = stage(look_up(new, stage(build_index(old, shards), "exact-index"), shards, parts), "exact-found")
    again = found.filter("seen")
    took_over = _better(F.col("id"), F.col("row_no"), F.col("old_id"), F.col("old_row"))
    grown = again.select("digest", F.when(took_over, F.col("id")).otherwise(F.col("old_id")).alias("keep_id"),
                         F.when(took_over, F.col("row_no")).otherwise(F.col("old_row")).alias("keep_row"), (F.col("n") + F.col("old_n")).alias("group_size"))

    def alone(rows):
        return rows.select("digest", F.col("id").alias("keep_id"), F.col("row_no").alias("keep_row"), F.col("n").alias("group_size"))

    untouched = old.join(again.select("digest"), "digest", "left_anti")
    return stage(alone(untouched).unionByName(grown).unionByName(alone(found.filter("NOT seen"))), "exact-winners")


def with_winners(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``rows`` of :func:`digests` joined to their group; digests of many rows by broadcast, at most ``HOT_SHARE`` of them."""
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    hot = groups.filter(F.col("group_size") * HOT_SHARE > total)
    near = rows.join(F.broadcast(hot), "digest", "left")
    single = near.filter("group_size IS NULL").select(rows.columns).join(groups.filter(F.col("group_size") * HOT_SHARE <= total), "digest")
    return near.filter("group_size IS NOT NULL").unionByName(single)


def deduplicate(df: DataFrame, history: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id_col>, keep_id, group_size, kept, digest``: one row per row of ``history`` and ``df``, equal texts in one group.

    Of equal texts the row with the largest id is kept.  A null text equals the empty one; whitespace and case count.  Rows equal in id and text are
    counted one by one and exactly one of them is kept; a row without an id is kept only if no equal text has one, then one of them, with a null
    ``keep_id``.  Other columns are ignored; an empty table gives no rows.  Without a ``history`` the table's rows up to its median id serve as one, and
    the later ones are looked up in them.
    """
    if history is None:
        rows = digests(df, id_col, text_col)
        middle = rows.agg(F.percentile_approx("id", 0.5)).first()[0]
        late = F.coalesce(F.col("id") > F.lit(middle).cast("bigint"), F.lit(False))
        old, new = rows.filter(~late), rows.filter(late)
    else:
        old, new = digests(history, id_col, text_col), digests(df, id_col, text_col)
        # Row numbers of both tables must differ.
        old, new = old.withColumn("row_no", F.col("row_no") * 2), new.withColumn("row_no", F.col("row_no") * 2 + 1)
        rows = old.unionByName(new)
    found = with_winners(rows, winners(old, new))
    return found.select(F.col("id").alias(id_col), "keep_id", "group_size", (F.col("row_no") == F.col("keep_row")).alias("kept"), "digest")
