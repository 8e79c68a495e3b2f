"""Prefix trie of conversations over range shards of padded turn-id matrices.

A turn's id is the first 128 bits of a SHA-256 of role and text.  Conversations, as arrays of turn ids, are dealt to range shards in lexicographic
order, so a trie node is one run of rows, within a shard or over neighbouring ones.  A shard sorts padded matrices of some columns at a time, marks where
a column or one before it changes, and adds up every depth with ``reduceat``.  Nodes that hold the first or last row of a shard go on in other shards:
those few are grouped by a hash of their prefix and completed in Spark.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from hazardgrid.llm.common import small_batches
from hazardgrid.session import stage

#: Turns that a shard holds on average; some 40 bytes of each in a task.
SHARD_TURNS = 500_000
#: Columns (turns) of a padded matrix.
COLUMNS = 16
#: Conversation ids in one piece of a member list that goes on in other shards.
PIECE = 2048

INNER, CHAIN, ENDS = 0, 1, 2

_ROWS = """kind int, shard int, side int, depth int, key binary, parent_key binary, conv_id bigint, parent_conv_id bigint, n_convs bigint, n_children bigint,
 n_leaves bigint, saved_tokens bigint, words bigint, ends_sha256 string, piece int, ids binary"""


def _words(text):
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def rebuilt(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, seq, words``, staged: each conversation with its first turns replaced by those of the first conversation of its block of twenty.

    ``seq`` holds two numbers for each turn, ``words`` the words of its text.  With h = crc32 of the decimal id modulo 4, the first h turns of
    conversation ``id - id % 20`` (all if it has fewer, none if it is absent) come before the own turns after the first h.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    # The length of the role keeps (role, text) apart from every other pair of the same letters.
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    conv = F.col(conv_col).cast("bigint")
    turns = df.select(conv.alias("conv_id"), (conv - conv % 20).alias("block"), F.col(turn_col).alias("turn"), digest.alias("digest"), _words(text).alias("words"))
    turns = turns.filter("conv_id IS NOT NULL").withColumns({"a": F.xxhash64("digest"), "b": F.xxhash64(F.lit("b"), "digest")})
    lists = turns.repartition("block").groupBy("block", "conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "a", "b", "words"))).alias("own"))
    head = F.max(F.when(F.col("conv_id") == F.col("block"), F.slice("own", 1, 3))).over(Window.partitionBy("block"))
    own, h = F.col("own"), F.col("h")
    lists = lists.withColumns({"head": head, "h": (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int")})
    # An absent head is null and so is its slice.
    whole = F.concat(F.coalesce(F.slice("head", F.lit(1), h), F.slice(own, 1, 0)), F.slice(own, h + 1, F.size(own)))
    return stage(lists.select("conv_id", whole.alias("turns")).select(
        "conv_id", F.flatten(F.transform("turns", lambda t: F.array(t["a"], t["b"]))).alias("seq"), F.transform("turns", lambda t: t["words"]).alias("words")), "trie-sequences")


class Level(NamedTuple):
    """Positions of the sorted rows that reach a depth, and whether a node starts at each."""

    rows: np.ndarray
    starts: np.ndarray


def sorted_levels(conv: np.ndarray, sizes: np.ndarray, seq: np.ndarray) -> tuple[np.ndarray, list[Level]]:
    """The order of the rows by (sequence, id), and a :class:`Level` for each depth from 1.

    ``seq`` holds the rows' turns one after the other, two numbers each.  ``COLUMNS`` turns are padded and sorted at a time; only rows that go on take part
    in the next columns, within the groups that the columns before left.
    """
    offsets = np.cumsum(sizes) - sizes
    order = np.lexsort([conv])
    at, group, levels, depth = np.arange(len(conv)), np.zeros(len(conv), np.int64), [], 0
    at, group = at[sizes[order] > 0], group[sizes[order] > 0]
    ended = np.flatnonzero(sizes[order] == 0)
    # Empty sequences come first.
    order = np.concatenate((order[ended], order[at]))
    at = np.arange(len(ended), len(order))
    while len(at):
        rows = order[at]
        width = int(min(COLUMNS, (sizes[rows] - depth).max()))
        column = depth + np.arange(width)
        present = column < sizes[rows][:, None]
        turn = np.where(present, offsets[rows][:, None] + column, 0)
        a, b = (np.where(present, seq[2 * turn + half], 0) for half in (0, 1))
        more = sizes[rows] > depth + width
        keys = [conv[rows], more]
        for j in range(width - 1, -1, -1):
            keys += [b[:, j], a[:, j], present[:, j]]
        turned = np.lexsort(keys + [group])
        order[at], present, a, b, more, group = rows[turned], present[turned], a[turned], b[turned], more[turned], group[turned]
        change = np.ones((len(at), width), bool)
        change[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (present[1:] != present[:-1])
        change[1:, 0] |= group[1:] != group[:-1]
        change = np.logical_or.accumulate(change, axis=1)
        levels += [Level(at[present[:, j]], change[present[:, j], j]) for j in range(width)]
        group = np.cumsum(change[:, -1])[more]
        at, depth = at[more], depth + width
    return order, levels


def _prefix_keys(seq: np.ndarray) -> list[bytes]:
    """A 128-bit key of every prefix of one sequence, the empty one first."""
    state, keys = hashlib.sha256(), []
    keys.append(state.digest()[:16])
    for turn in seq.reshape(-1, 2):
        state.update(turn.tobytes())
        keys.append(state.copy().digest()[:16])
    return keys


def _joined(ids: np.ndarray) -> bytes:
    return ",".join(map(str, ids.tolist())).encode()


NOBODY = hashlib.sha256(b"").hexdigest()


def shard_nodes(shard: int, conv: np.ndarray, sizes: np.ndarray, seq: np.ndarray, words: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows ``_ROWS`` of one shard: its inner nodes, the nodes that hold its first or last row, and the latter's members that end there.

    What counts once for a node (its leaf, its edge, the one member that saves nothing) is left out for nodes that hold the first or last row, as
    neighbouring shards may hold them too.  An inner node below such a node names its ``side``: 0 if that holds the first row, else 1.
    """
    order, levels = sorted_levels(conv, sizes, seq)
    offsets, conv, sizes = (np.cumsum(sizes) - sizes)[order], conv[order], sizes[order]
    total = len(conv)
    levels = [Level(np.arange(total), np.arange(total) == 0)] + levels
    edge, leaves, saved = (np.zeros(total, np.int64) for _ in range(3))
    nodes = []
    for depth in range(len(levels) - 1, -1, -1):
        at, starts = levels[depth]
        cut = np.flatnonzero(starts)
        first, n = at[cut], np.diff(cut, append=len(at))
        chain = np.full(len(cut), -1)
        if at[-1] == total - 1:
            chain[-1] = 1
        both = at[0] == 0 and chain[0] == 1
        if at[0] == 0:
            chain[0] = 0
        inner = chain < 0
        word = words[offsets[first] + depth - 1] if depth else np.zeros(1, np.int64)
        children = np.add.reduceat(edge[at], cut)
        leaves[first] += inner & (children == 0)
        saved[first] += (n - inner) * word
        nodes.append((depth, at, cut, first, n, chain, both, word, children, np.minimum.reduceat(conv[at], cut), np.add.reduceat(leaves[at], cut), np.add.reduceat(saved[at], cut)))
        edge[at] = 0
        edge[first] = inner
    ends_at = (seq[2 * offsets[0]:2 * (offsets[0] + sizes[0])], seq[2 * offsets[-1]:2 * (offsets[-1] + sizes[-1])])
    keys = [_prefix_keys(s) for s in ends_at]
    up_conv, up_side = np.zeros(total, np.int64), np.full(total, -1)
    for depth, at, cut, first, n, chain, both, word, children, least, n_leaves, kept in reversed(nodes):
        inner = np.flatnonzero(chain < 0)
        ended = sizes[at] == depth
        owner = (np.cumsum(levels[depth].starts) - 1)[ended]
        members = np.split(conv[at[ended]], np.flatnonzero(np.diff(owner)) + 1) if len(owner) else []
        who = dict(zip(owner[np.flatnonzero(np.diff(owner, prepend=-1))].tolist(), members))
        if len(inner):
            side = up_side[first[inner]]
            hashes = [hashlib.sha256(_joined(who[i])).hexdigest() if i in who else NOBODY for i in inner.tolist()]
            yield _rows(INNER, shard, depth, side=side, conv_id=least[inner], parent_conv_id=pa.array(up_conv[first[inner]], mask=side >= 0), n_convs=n[inner],
                        n_children=children[inner], n_leaves=n_leaves[inner], saved_tokens=kept[inner], words=word[inner], ends_sha256=hashes)
        for i, side in [(i, int(chain[i])) for i in np.flatnonzero(chain >= 0)] + ([(0, 1)] if both else []):
            one = int(not (both and side == 1))
            path = keys[side]
            yield _rows(CHAIN, shard, depth, side=[side], key=[path[depth]], parent_key=[path[depth - 1] if depth else None], conv_id=[int(least[i])], n_convs=[one * int(n[i])],
                        n_children=[one * int(children[i])], n_leaves=[one * int(n_leaves[i])], saved_tokens=[one * int(kept[i])], words=[int(word[i])])
            if one and i in who:
                parts = [who[i][k:k + PIECE] for k in range(0, len(who[i]), PIECE)]
                yield _rows(ENDS, shard, depth, side=[side] * len(parts), key=[path[depth]] * len(parts), piece=list(range(len(parts))), ids=[_joined(p) for p in parts])
        up_conv[at] = np.repeat(least, n)
        up_side[at] = np.repeat(chain, n)


_SCHEMA = pa.schema([("kind", pa.int32()), ("shard", pa.int32()), ("side", pa.int32()), ("depth", pa.int32()), ("key", pa.binary()), ("parent_key", pa.binary())] + [
    (c, pa.int64()) for c in ("conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "words")] + [
    ("ends_sha256", pa.string()), ("piece", pa.int32()), ("ids", pa.binary())])


def _rows(kind: int, shard: int, depth: int, **columns) -> pa.RecordBatch:
    size = len(columns["side"])
    columns |= {"kind": np.full(size, kind), "shard": np.full(size, shard), "depth": np.full(size, depth)}
    return pa.RecordBatch.from_arrays(
        [pa.nulls(size, f.type) if f.name not in columns else pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name] for f in _SCHEMA], schema=_SCHEMA)


def _run_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, sizes, seq, words = [], [], [], []
    for batch in batches:
        conv.append(batch.column(0).to_numpy())
        sizes.append(batch.column(2).value_lengths().to_numpy())
        seq.append(batch.column(1).flatten().to_numpy())
        words.append(batch.column(2).flatten().to_numpy())
    if sum(map(len, conv)):
        yield from _merged(shard_nodes(TaskContext.get().partitionId(), *map(np.concatenate, (conv, sizes, seq, words))))


def _merged(batches: Iterator[pa.RecordBatch], rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    """The same rows in fewer batches."""
    waiting, size = [], 0
    for batch in batches:
        waiting.append(batch)
        size += batch.num_rows
        if size >= rows:
            yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()
            waiting, size = [], 0
    if waiting:
        yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()


def _hash_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``key, ends_sha256`` of pieces that come sorted by key and place: one running hash, whatever the member list's length."""
    key, state = None, None

    def done():
        return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], ["key", "ends_sha256"])

    for batch in batches:
        for k, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if k != key:
                if state is not None:
                    yield done()
                key, state = k, hashlib.sha256(ids)
            else:
                state.update(b"," + ids)
    if state is not None:
        yield done()


def completed(chain: DataFrame, ends: DataFrame) -> DataFrame:
    """One row per node that holds the first or last row of a shard, from the parts of all shards: ``key`` and the result's columns.

    What counts once is counted in the first chain that holds a node, and added to the nodes above by a running sum up that chain.
    """
    measures = ("n_convs", "n_children", "n_leaves", "saved_tokens")
    parts = chain.groupBy("key").agg(
        F.min("parent_key").alias("parent_key"), F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.max("words").alias("words"),
        F.min(F.struct("shard", "side")).alias("owner"), *(F.sum(m).alias(m) for m in measures))
    below = parts.filter("parent_key IS NOT NULL").groupBy(F.col("parent_key").alias("key")).agg(F.count(F.lit(1)).alias("more"))
    parts = stage(parts.join(below, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0))).drop("more"), "trie-parts")
    mine = F.col("owner") == F.struct("shard", "side")
    up = Window.partitionBy("shard", "side").orderBy(F.desc("depth"))
    once = chain.select("key", "shard", "side", "depth").join(parts.select("key", "owner", "words", "n_children"), "key").select(
        "key", F.sum((mine & (F.col("n_children") == 0)).cast("bigint")).over(up).alias("leaf"), F.sum(F.when(mine, F.col("words")).otherwise(0)).over(up).alias("alone"))
    once = once.groupBy("key").agg(F.sum("leaf").alias("leaf"), F.sum("alone").alias("alone"))
    hashed = ends.select("key", "shard", "piece", "ids").repartition("key").sortWithinPartitions("key", "shard", "piece").select("key", "ids").mapInArrow(
        _hash_pieces, "key binary, ends_sha256 string")
    parents = parts.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    return stage(parts.join(once, "key").join(hashed, "key", "left").join(parents, "parent_key", "left").select(
        "key", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("n_leaves") + F.col("leaf")).alias("n_leaves"),
        (F.col("saved_tokens") - F.col("alone")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NOBODY)).alias("ends_sha256")), "trie-chains")


def trie(sequences: DataFrame) -> DataFrame:
    """Every node of the prefix trie of ``conv_id, seq, words`` (ids unique, ``seq`` two numbers for each of ``words``).

    Returns ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.
    """
    small_batches(sequences.sparkSession)
    turns = sequences.agg(F.sum(F.size("words") + 1)).first()[0] or 0
    shards = max(1, -(-turns // SHARD_TURNS))
    # The id is part of the range, so that equal sequences spread over shards.
    found = stage(sequences.repartitionByRange(shards, "seq", "conv_id").mapInArrow(_run_shard, _ROWS), "trie-nodes")
    chain = found.filter(F.col("kind") == CHAIN)
    nodes = completed(chain, found.filter(F.col("kind") == ENDS))
    result = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    inner = found.filter(F.col("kind") == INNER)
    above = chain.select("key", "shard", "side", (F.col("depth") + 1).alias("depth")).join(nodes.select("key", F.col("conv_id").alias("above")), "key").drop("key")
    below = inner.filter("side >= 0").join(above, ["shard", "side", "depth"]).withColumn("parent_conv_id", F.col("above"))
    rows = inner.filter("side < 0").select(result).unionByName(below.select(result)).unionByName(nodes.select(result))
    return rows.withColumn("depth", F.col("depth").cast("bigint"))


def conversation_trie(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The prefix trie of all :func:`rebuilt` conversations, one row per node as in :func:`trie`.

    Turns are in the order of ``turn``, null first; equal ones (repeated rows too, each counts) in that of their hashed role and text.  A null role or
    text is empty; rows without a conversation id are left out; other columns are ignored.  A conversation that lost all turns ends at the root; an empty
    table has no nodes.  One conversation's turns (some 40 bytes each, no text) and a shard's are held in one task; a member list of any length is hashed
    piece by piece, in one task as SHA-256 demands.
    """
    return trie(rebuilt(df, conv_col, turn_col, role_col, text_col))
