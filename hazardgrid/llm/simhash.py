"""SimHash near-duplicate detection by pigeonhole blocks.

Each text gets one or more 64-bit fingerprints of its word shingles.  A fingerprint
is cut into ``blocks`` blocks; two that differ in at most ``spread`` bits agree on at
least ``blocks - spread`` whole blocks, so every choice of that many blocks is a join
key and no close pair is missed.  Equal fingerprints are one class from the start, so
copies are never compared.  Keys shared by two or more classes are looked at in packs
of bounded size with numpy: every pair inside a key is verified by its Hamming
distance, but only the links of a spanning forest leave the task.  Keys with more
members than ``PACK_MEMBERS`` are cut into chunks and each pair of chunks is a task of
its own.  Components come from large-star/small-star rounds.

:func:`keep_first` takes what :func:`near_duplicates` finds over several fingerprints as candidates.  Pairs just above its
Jaccard similarity can lie too far apart in bits, so lowest values of the shingle set under permutations are keys as well;
every candidate is verified on the sets.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from hazardgrid.llm.common import map_texts, mix64, small_batches
from hazardgrid.operators.corridors import connected_components
from hazardgrid.operators.sketches import bloom_filter, keep_possible
from hazardgrid.session import scratch, stage

#: Classes of one key compared in one task; larger keys are cut into chunks of half that size.
PACK_MEMBERS = 4096
#: Rows of small keys that share a task.
PACK_ROWS = 40_000
#: Keys of a shingle set and lowest values in each: a pair of similarity s has none in common with probability
#: (1 - s ** BAND_ROWS) ** BANDS, 1.3e-7 at 0.8.
BANDS, BAND_ROWS = 40, 5
#: Shingles compared in one task; keys with more are cut into chunks of half that size.
PACK_SHINGLES = 2_000_000
#: Keys that a task counts at once.
TASK_KEYS = 200_000
#: MB of sets in a row group, which a task holds in several forms while it looks for those that it needs.
SETS_MB = 4


def fingerprint(words: list[bytes], shingle: int, count: int = 1) -> np.ndarray:
    """``count`` fingerprints of the word shingles, repeats included; zero without words.

    The first uses XXH64 (seed 42) of the space-joined words, further ones scramble it.
    A bit is set if more than half of the hashes have it.
    """
    if not words:
        return np.zeros(count, np.uint64)
    line = b" ".join(words)
    size = min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    first = np.fromiter(
        [digest(line[a:b], 42) for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1:].tolist())], np.uint64)
    totals = np.zeros(64 * count, np.int64)
    for at in range(0, len(first), 255):                # sums of up to 255 bits fit into a byte
        part = first[at:at + 255]
        hashes = np.stack([part, *(mix64(part + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) for k in range(1, count))], axis=1)
        bits = np.unpackbits(np.ascontiguousarray(hashes).view(np.uint8), axis=1, bitorder="little")
        totals += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return np.packbits(totals * 2 > len(first), bitorder="little").view(np.uint64)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, count: int = 1) -> DataFrame:
    """``id, fp``: an array of ``count`` signed 64-bit fingerprints per row; empty and null texts get zeros.

    A-Z are lower-cased; words are runs of anything but space and U+0009-U+000D.
    """
    def make():
        def work(ids, texts):
            out = np.concatenate([fingerprint(t.lower().split(), shingle, count) for t in texts]).view(np.int64)
            offsets = pa.array(np.arange(0, len(out) + 1, count), pa.int32())
            return pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(offsets, pa.array(out))], ["id", "fp"])
        return work

    id_type = df.schema[id_col].dataType.simpleString()
    return map_texts(df, id_col, text_col, f"id {id_type}, fp array<bigint>", make)


def block_masks(blocks: int, spread: int) -> list[int]:
    """Bit masks of every choice of ``blocks - spread`` blocks of a 64-bit word."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(parts, blocks - spread)]


def block_keys(classes: DataFrame, blocks: int, spread: int) -> DataFrame:
    """``key, id``: one row per class, fingerprint and choice of blocks."""
    masks = np.array(block_masks(blocks, spread), np.uint64)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            fps = batch.column(1).values.to_numpy().view(np.uint64).reshape(len(ids), -1)
            # The choice and the fingerprint's number are part of the key.
            salt = mix64(np.arange(1, fps.shape[1] * len(masks) + 1, dtype=np.uint64)).reshape(fps.shape[1], len(masks))
            keys = mix64((fps[:, :, None] & masks) ^ salt).reshape(len(ids), -1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(ids, keys.shape[1]))], ["key", "id"])

    small_batches(classes.sparkSession)
    return classes.select("id", "fp").mapInArrow(run, "key bigint, id bigint")


def _forest(near: np.ndarray) -> np.ndarray:
    """For a symmetric matrix of links, the lowest index of each row's component."""
    label = np.full(len(near), -1)
    for i in range(len(near)):
        if label[i] < 0:
            front = np.array([i])
            label[i] = i
            while len(front):
                front = np.flatnonzero(near[front].any(axis=0) & (label < 0))
                label[front] = i
    return label


def _near(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    distance = np.zeros((len(a), len(b)), np.uint16)
    for k in range(a.shape[1]):
        distance += np.bitwise_count(a[:, None, k] ^ b[None, :, k])
    return distance <= most


def links_in_packs(table: pa.Table, most: int) -> pa.Table:
    """Verified links ``u < v`` of the keys in one pack."""
    key = table["key"].to_numpy()
    ids = table["id"].to_numpy()
    fps = table["fp"].combine_chunks().values.to_numpy().view(np.uint64).reshape(len(ids), -1)
    order = np.lexsort((ids, key))
    key, ids, fps = key[order], ids[order], fps[order]
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.append(start, len(key)))
    s = start[size == 2]                                 # nearly all keys
    close = np.bitwise_count(fps[s] ^ fps[s + 1]).sum(axis=1, dtype=np.int64) <= most
    u, v = [ids[s[close]]], [ids[s[close] + 1]]
    for a, n in zip(start[size > 2].tolist(), size[size > 2].tolist()):
        label = _forest(_near(fps[a:a + n], fps[a:a + n], most))
        far = np.flatnonzero(label != np.arange(n))
        u.append(ids[a + label[far]])
        v.append(ids[a + far])
    return pa.table({"u": np.concatenate(u), "v": np.concatenate(v)})


def close_links(classes: DataFrame, most: int, blocks: int, spread: int) -> DataFrame:
    """``u, v``: links that connect exactly the classes (``id, fp``) connected by pairs that share a key and differ in
    at most ``most`` bits over all their fingerprints."""
    keys = block_keys(classes, blocks, spread)
    shared = stage(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "simhash-keys")
    members = stage(keys.join(shared, "key"), "simhash-members")
    half = PACK_MEMBERS // 2
    rows = members.count()
    packs = max(1, -(-rows // PACK_ROWS))
    chunks = F.ceil(F.col("n") / half).cast("int")
    # Chunks i <= j of a large key meet in task (i, j); a small key is one chunk in a shared pack.
    own = F.pmod(F.xxhash64("id"), chunks).cast("int")
    other = F.sequence(F.lit(0), chunks - 1)
    tasks = F.when(F.col("n") <= PACK_MEMBERS, F.array(F.pmod(F.xxhash64("key"), F.lit(packs)))).otherwise(
        F.transform(other, lambda c: F.xxhash64("key", F.least(c, own), F.greatest(c, own))))
    placed = members.join(classes.select("id", "fp"), "id").select("key", "id", "fp", F.explode(tasks).alias("task"))
    found = placed.groupBy("task").applyInArrow(
        lambda t: links_in_packs(t.select(["key", "id", "fp"]), most), "u bigint, v bigint")
    return found.distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, count: int = 1,
                    most: int = 4, blocks: int = 7, spread: int = 4) -> DataFrame:
    """``<id_col>, fp, component_id``: fingerprints and the smallest id reachable over close fingerprints.

    With one fingerprint and ``most <= spread`` every link is found.  Rows repeated or with equal texts share a
    fingerprint; empty and null texts have fingerprint zero and link like any other.  A row without an id gets the
    component of its fingerprint, null if no row with an id has that fingerprint.  Other columns are ignored.
    """
    fps = stage(fingerprints(df, id_col, text_col, shingle, count), "simhash-fps")
    classes = stage(fps.groupBy("fp").agg(F.min("id").cast("bigint").alias("id")), "simhash-classes")
    known = classes.filter("id IS NOT NULL")
    links = close_links(known, most, blocks, spread)
    roots = connected_components(links.select(F.lit(0).alias("scope"), "u", "v"))
    named = stage(classes.join(roots.select(F.col("node").alias("id"), "root"), "id", "left").select(
        "fp", F.coalesce("root", "id").alias("component_id")), "simhash-components")
    return fps.join(named, "fp", "left").select(F.col("id").alias(id_col), "fp", "component_id")


def shingle_sets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """``uid, id, digest, n, shingles, keys`` per row: the set of hashed word shingles, eight bytes each, a digest of it, and ``BANDS`` keys.

    Words as in :func:`fingerprints`; a text of fewer words is one shingle, one without words the empty shingle.  A key is
    the lowest values of the set under ``BAND_ROWS`` permutations.
    """
    rng = np.random.default_rng(17)
    times = rng.integers(0, 1 << 63, BANDS * BAND_ROWS, np.uint64) << np.uint64(1) | np.uint64(1)
    plus = rng.integers(0, 1 << 63, BANDS * BAND_ROWS, np.uint64)

    def make():
        digest = xxhash.xxh64_intdigest
        uid = TaskContext.get().partitionId() << 40

        def work(ids, texts):
            nonlocal uid
            sets, keys = [], []
            for t in texts:
                words = t.lower().split()
                size = min(shingle, len(words))
                line = [b" ".join(words[i:i + size]) for i in range(len(words) - size + 1)] if words else [b""]
                own = np.unique(np.fromiter({digest(s, 42) for s in line}, np.uint64))
                low = np.full(len(times), (1 << 64) - 1, np.uint64)
                for at in range(0, len(own), 2048):        # bounded memory for long texts
                    low = np.minimum(low, (own[at:at + 2048, None] * times + plus).min(axis=0))
                band = np.arange(1, BANDS + 1, dtype=np.uint64)
                for part in low.reshape(BANDS, BAND_ROWS).T:
                    band = mix64(band ^ part)
                sets.append(own.tobytes())
                keys.append(band.view(np.int64))
            out = pa.RecordBatch.from_arrays([
                pa.array(np.arange(uid, uid + len(sets))), ids, pa.array([xxhash.xxh3_128_digest(s) for s in sets], pa.binary()),
                pa.array([len(s) // 8 for s in sets], pa.int64()), pa.array(sets, pa.binary()),
                pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * BANDS, pa.int32()), pa.array(np.concatenate(keys)))],
                ["uid", "id", "digest", "n", "shingles", "keys"])
            uid += len(sets)
            return out
        return work

    id_type = df.schema[id_col].dataType.simpleString()
    return map_texts(df, id_col, text_col, f"uid bigint, id {id_type}, digest binary, n bigint, shingles binary, keys array<bigint>", make)


def alike(shared, total, similarity: float):
    """Whether ``shared`` of two sets with ``total`` elements together (the sum of both sizes) are enough."""
    return shared >= similarity * (total - shared) - 1e-9


def hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the sets of a column of ``shingles`` one after the other, and where each set begins and the last ends."""
    _, offsets, data = column.cast(pa.binary()).buffers()
    return np.frombuffer(data or b"", np.int64), np.frombuffer(offsets, np.int32)[column.offset:column.offset + len(column) + 1] // 8


def alike_pairs(similarity: float):
    """For ``mapInArrow``: ``u, v`` of the rows ``u, v, a, b`` whose sets ``a`` and ``b`` are alike."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                (a, start), (b, begin) = (hashes(batch.column(c)) for c in (2, 3))
                sizes = np.diff(start) + np.diff(begin)
                shared = np.array([len(np.intersect1d(a[start[i]:start[i + 1]], b[begin[i]:begin[i + 1]], assume_unique=True)) for i in range(len(sizes))])
                yield batch.select([0, 1]).filter(pa.array(alike(shared, sizes, similarity)))
    return run


def links_of_sets(table: pa.Table, similarity: float) -> pa.Table:
    """Links ``u, v`` of ids that join what pairs of one ``key`` of different ``root`` with alike sets join."""
    key, ids, root = (table[c].to_numpy() for c in ("key", "id", "root"))
    values, edges = hashes(table["shingles"].combine_chunks())
    u, v = [], []
    order = np.argsort(key, kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
        parts = [values[edges[i]:edges[i + 1]] for i in group]
        sizes = np.array([len(p) for p in parts])
        starts = np.cumsum(sizes) - sizes
        names, code = np.unique(np.concatenate(parts), return_inverse=True)
        mark = np.zeros(len(names), bool)
        label = root[group].copy()
        for i in range(len(group)):
            if (label == label[0]).all():
                break
            own = code[starts[i]:starts[i] + sizes[i]]
            mark[own] = True
            shared = np.add.reduceat(mark[code], starts, dtype=np.int64)
            mark[own] = False
            for j in np.flatnonzero(alike(shared, sizes + sizes[i], similarity) & (label != label[i])).tolist():
                if label[j] != label[i]:
                    u.append(ids[group[i]])
                    v.append(ids[group[j]])
                    label[label == label[j]] = label[i]
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def alike_links(sets: DataFrame, similarity: float, shingles: DataFrame | None = None, close: DataFrame | None = None) -> DataFrame:
    """``u, v``: links of ids that connect what pairs with a common key and a Jaccard similarity of ``similarity`` connect.

    ``sets``: one row per distinct set; ``shingles``: rows with the shingles of at least these sets by ``uid``, if a cheaper scan than
    ``sets`` has them; ``close``: ``uid, component_id`` of groups that are keys as well.  First every set is compared with one other
    of its keys and one of its groups, which settles groups of near copies in linear time; then all pairs of the keys that still
    hold several components.
    """
    small_batches(sets.sparkSession)
    # Keys of groups are odd, the others even.
    keys = sets.select(F.explode("keys").alias("key"), "uid").withColumn("key", F.col("key").bitwiseAND(-2))
    if close is not None:
        keys = keys.unionByName(close.select(F.xxhash64("component_id").bitwiseOR(1).alias("key"), "uid"))
    shared = keys.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("uid")).alias("mix"), F.min("uid").alias("low"), F.max("uid").alias("high")).filter("n > 1")
    # Keys with the same members say the same; a key of the sets stands for them, if there is one.
    shared = stage(shared.groupBy("n", "mix", "low", "high").agg(F.min_by("key", F.col("key").bitwiseAND(1)).alias("key")).select("key", "low"), "near-keys")
    members = stage(keys.join(shared, "key").join(sets.select("uid", "id", "n"), "uid"), "near-members")
    # Each join below is exact; only sets that it may need are moved to it.
    sets = keep_possible(sets if shingles is None else shingles, {"uid": bloom_filter(members.select("uid").distinct(), "uid")})
    sets = stage(sets.select("uid", "id", "shingles"), "near-shared", group_mb=SETS_MB)
    first = members.groupBy("uid", F.col("key").bitwiseAND(1).alias("of")).agg(F.min("low").alias("low")).filter("low < uid")
    first = stage(first.select("uid", "low").distinct(), "near-first")
    mine = keep_possible(sets, {"uid": bloom_filter(first.select("uid").distinct(), "uid")}).select("uid", F.col("id").alias("v"), F.col("shingles").alias("b"))
    other = keep_possible(sets, {"uid": bloom_filter(first.select(F.col("low").alias("uid")).distinct(), "uid")}).select(
        F.col("uid").alias("low"), F.col("id").alias("u"), F.col("shingles").alias("a"))
    met = first.join(mine, "uid").join(other, "low").select("u", "v", "a", "b")
    stars = stage(met.mapInArrow(alike_pairs(similarity), "u bigint, v bigint"), "near-stars")
    roots = connected_components(stars.filter("u <> v").select(F.lit(0).alias("scope"), "u", "v")).select(F.col("node").alias("id"), "root")
    rooted = members.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    unsettled = rooted.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.sum("n").alias("total")).filter("a < b").select("key", "total")
    rooted = stage(rooted.join(unsettled, "key").select("key", "uid", "root", "n", "total"), "near-unsettled")
    packs = max(1, -(-(rooted.agg(F.sum("n")).first()[0] or 0) // PACK_SHINGLES))
    chunks = F.ceil(2 * F.col("total") / PACK_SHINGLES).cast("int")
    # Chunks i <= j of a large key meet in task (i, j); a small key is one chunk in a shared pack.
    own = F.pmod(F.xxhash64("uid"), chunks).cast("int")
    tasks = F.when(F.col("total") <= PACK_SHINGLES, F.array(F.pmod(F.xxhash64("key"), F.lit(packs)))).otherwise(
        F.transform(F.sequence(F.lit(0), chunks - 1), lambda c: F.xxhash64("key", F.least(c, own), F.greatest(c, own))))
    sets = keep_possible(sets, {"uid": bloom_filter(rooted.select("uid").distinct(), "uid")})
    placed = rooted.withColumn("task", F.explode(tasks)).join(sets.select("uid", "id", "shingles"), "uid").select("task", "key", "id", "root", "shingles")
    found = placed.groupBy("task").applyInArrow(lambda t: links_of_sets(t, similarity), "u bigint, v bigint")
    return stars.unionByName(found).filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def most_bits(similarity: float, bits: int, margin: float) -> int:
    """Bits of ``bits`` in which fingerprints of equally large sets with a Jaccard similarity of ``similarity`` differ, and ``margin`` standard deviations."""
    rate = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    return int(bits * rate + margin * (bits * rate * (1 - rate)) ** 0.5)


def keep_first(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, count: int = 6, margin: float = 1.0) -> DataFrame:
    """``docs`` with one document of each group of near copies, that with the smallest id.

    A group is what pairs with a Jaccard similarity of ``similarity`` or more on sets of word shingles connect; every link
    is verified on the sets.  Candidates are the components of :func:`near_duplicates` over ``count`` fingerprints, ``margin``
    standard deviations granted, and what shares a key of the sets.  Rows equal in id and text are one; rows without an id
    stay, once per text.
    """
    with scratch(docs.sparkSession):        # of all that is staged here only the ids that go are needed afterwards
        # Texts go by a hash: ids may repeat.
        text = F.xxhash64("text").alias("mark")
        with scratch(docs.sparkSession):
            close = near_duplicates(docs.select(text, "text"), "mark", shingle=shingle, count=count, most=most_bits(similarity, 64 * count, margin))
            close = stage(close.select("mark", "component_id").distinct(), "near-close", keep=True)
        rows = docs.select(F.struct("doc_id", text).alias("doc_id"), "text")
        rows = stage(shingle_sets(rows, shingle=shingle), "near-sets", group_mb=SETS_MB).filter("id.doc_id IS NOT NULL").withColumns(
            {"mark": F.col("id.mark"), "id": F.col("id.doc_id").cast("bigint")})
        classes = stage(rows.groupBy("digest").agg(F.min(F.struct("id", "uid")).alias("of")).select("digest", "of.id", "of.uid"), "near-classes")
        # A task lists all keys of its sets.
        parts = max(docs.sparkSession.sparkContext.defaultParallelism, -(-classes.count() * BANDS // TASK_KEYS))
        sets = rows.repartition(parts, "uid").join(classes.select("uid"), "uid", "left_semi")
        close = rows.select("mark", "digest").distinct().join(close, "mark").join(classes.select("digest", "uid"), "digest").select("uid", "component_id").distinct()
        roots = connected_components(alike_links(sets, similarity, rows, close).select(F.lit(0).alias("scope"), "u", "v"))
        # Sets of one id are one node.
        named = classes.join(roots.select(F.col("node").alias("id"), "root"), "id", "left").select("digest", F.coalesce("root", "id").alias("component_id"))
        gone = rows.join(named, "digest").filter(F.col("component_id") < F.col("id")).select(F.col("id").alias("_gone")).distinct()
        gone = stage(gone, "near-gone", keep=True)
    left = docs.join(gone, F.col("doc_id") == F.col("_gone"), "left").filter("_gone IS NULL").drop("_gone")
    return left.dropDuplicates(["doc_id", "text"])
