"""N-gram language model in an Elias-Fano trie, trained and applied as Spark jobs.

All training tokens are counted.  Words that make up at least ``DICTIONARY_SHARE`` of the
tokens (so at most its inverse in number) are broadcast with their counts; the numbers and
counts of all other words are joined.  Words that occur ``MIN_WORD`` times and n-grams that
occur ``MIN_NGRAM`` times are in the trie, so it grows with the texts.  Levels are built in
tasks, one file per range of contexts, and mapped by the workers.  Texts are split into
words twice: to count the words, and to write their numbers, which the later steps read.

Probability of a kept n-gram: its count smoothed by the shorter context's probability;
of any other word: the shorter context's probability times a weight that makes the sum
one.  A single word has (c + 0.5) / (N + 0.5 (V + 1)).
"""

from __future__ import annotations

import functools
import uuid
from collections import Counter
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from hazardgrid.llm.common import crc_mod5, map_texts, mix64, small_batches
from hazardgrid.llm.eliasfano import Level, Levels, load, save
from hazardgrid.session import scratch, stage, work_folder

DICTIONARY_SHARE = 2.5e-7
#: Occurrences of a word and of an n-gram in the trie.
MIN_WORD = 2
MIN_NGRAM = 2
#: Smoothing: as many imagined tokens of the shorter context's distribution.
PRIOR = 100.0
#: Kept n-grams, and words beside the broadcast ones, per file.
SEGMENT = 2_000_000
END = b""
_WORDS_AT_ONCE = 500_000
#: Tokens that a task counts the pairs of at once, and at most about as many pairs that a task merges.
_TOKENS_AT_ONCE = 4_000_000


def tokens(text: bytes) -> list[bytes]:
    """Lower-case words and one end (the empty word)."""
    return [*text.lower().split(), END]


def _learns(key, remainder: int | None) -> bool:
    return remainder is None or crc_mod5(key) != remainder


def count_words(docs: DataFrame, remainder: int | None) -> DataFrame:
    """``word, c`` over the training texts."""
    def make_rows(count):
        out = pa.RecordBatch.from_arrays([pa.array(list(count), pa.binary()), pa.array(list(count.values()), pa.int64())], ["word", "c"])
        count.clear()
        return out

    def run(batches):
        count: Counter[bytes] = Counter()
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                if _learns(key, remainder):
                    count.update(tokens(text))
            if len(count) > _WORDS_AT_ONCE:
                yield make_rows(count)
        if count:
            yield make_rows(count)

    small_batches(docs.sparkSession)
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


@functools.lru_cache(maxsize=4)
def open_counts(paths: tuple[str, ...]) -> tuple[np.ndarray, list[np.ndarray]]:
    """First number and counts of each file, by ascending numbers; mapped once per Python worker."""
    files = sorted((load(p) for p in paths), key=lambda f: int(f["first"][0]))
    return np.array([f["first"][0] for f in files], np.int64), [f["count"] for f in files]


class Dictionary:
    """Counts of the common words, numbered from 0, the most frequent first; the counts of the other words of the trie,
    numbered on from there, are in files."""

    def __init__(self, rows: list, n: int, v: int):
        self.n, self.v = n, v
        self.total = n + 0.5 * (v + 1)
        words = sorted(rows, key=lambda r: (-r["c"], bytes(r["word"])))
        self.c = np.array([r["c"] for r in words], np.int64)
        self.number = {bytes(r["word"]): i for i, r in enumerate(words)}
        self.log10 = np.log10((self.c + 0.5) / self.total)
        self.size, self.paths = len(words), ()
        # The end stands before a text too.
        self.start = self.number.get(END, -1)

    @property
    def bits(self) -> int:
        return self.size.bit_length()

    def counts(self, numbers: np.ndarray) -> np.ndarray:
        """Counts of words of the trie, 0 for -1."""
        out = np.zeros(len(numbers), np.int64)
        common = (numbers >= 0) & (numbers < len(self.c))
        out[common] = self.c[numbers[common]]
        rare = np.flatnonzero(numbers >= len(self.c))
        if len(rare):
            first, files = open_counts(self.paths)
            part = np.searchsorted(first, numbers[rare], side="right") - 1
            for p in np.unique(part):
                at = rare[part == p]
                out[at] = files[p][numbers[at] - first[p]]
        return out

    def prob(self, numbers: np.ndarray) -> np.ndarray:
        return (self.counts(numbers) + 0.5) / self.total

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))

    def contexts(self, every: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word and word before, -1 outside the trie, over several texts that begin at ``starts``."""
        v = np.concatenate(([-1], every[:-1]))
        v[starts] = self.start
        return every, v


@functools.lru_cache(maxsize=4)
def open_levels(paths: tuple[str, ...]) -> Levels:
    """Mapped once per Python worker."""
    return Levels(list(paths))


def encode(docs: DataFrame, d, remainder: int | None) -> DataFrame:
    """One row per text: ``uid, doc_id, learns, n_tokens, n_known, base``, the words' ``numbers`` (-1 outside the
    dictionary), and hashes and places of the words outside it."""
    rare_type = pa.list_(pa.struct([("h", pa.int64()), ("at", pa.list_(pa.int32()))]))

    def make():
        digest = xxhash.xxh64_intdigest
        uid = TaskContext.get().partitionId() << 40

        def work(ids, texts):
            nonlocal uid
            words = [tokens(t) for t in texts]
            sizes = np.array([len(w) for w in words])
            edges = np.concatenate(([0], np.cumsum(sizes)))
            every = np.fromiter(map(d.value.number.get, chain.from_iterable(words), repeat(-1)), np.int64, edges[-1])
            known = every >= 0
            base = np.where(known, d.value.log10[np.maximum(every, 0)], 0.0) if len(d.value.c) else np.zeros(len(every))
            rare: list[list] = [[] for _ in words]
            place = np.flatnonzero(~known)
            text_of = np.searchsorted(edges, place, "right") - 1
            where: dict[tuple, list[int]] = {}
            for t, i in zip(text_of.tolist(), (place - edges[text_of]).tolist()):
                where.setdefault((t, words[t][i]), []).append(i)
            for (t, w), at in where.items():
                rare[t].append({"h": (h := digest(w, 42)) - (h >> 63 << 64), "at": at})
            out = pa.RecordBatch.from_arrays([
                pa.array(np.arange(uid, uid + len(words))), ids, pa.array([_learns(key, remainder) for key in ids.to_pylist()]), pa.array(sizes, pa.int64()),
                pa.array(np.add.reduceat(known.astype(np.int64), edges[:-1])), pa.array(np.add.reduceat(base, edges[:-1])),
                pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(every, pa.int32())), pa.array(rare, rare_type)],
                ["uid", "doc_id", "learns", "n_tokens", "n_known", "base", "numbers", "rare"])
            uid += len(words)
            return out
        return work

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return map_texts(docs, "doc_id", "text", f"uid bigint, doc_id {id_type}, learns boolean, n_tokens bigint, n_known bigint, base double, "
                     "numbers array<int>, rare array<struct<h:bigint,at:array<int>>>", make)


def number_rare(words: DataFrame, first: int) -> tuple[DataFrame, tuple[str, ...], int]:
    """``h, c, number`` of the words outside the dictionary, numbered from ``first`` on (null below ``MIN_WORD``), the
    files of the numbered ones' counts, and the number after the last."""
    spark = words.sparkSession
    folder = f"{work_folder(spark)}/words-{uuid.uuid4().hex}"
    words = words.groupBy("h").agg(F.max("c").alias("c"))
    parts = max(1, -(-words.count() // SEGMENT))
    words = stage(words.withColumn("part", F.pmod("h", F.lit(parts))), "lm-rare")
    start = {}
    for r in words.filter(F.col("c") >= MIN_WORD).groupBy("part").agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect():
        start[r["part"]] = first
        first += r["n"]

    def build(key, table):
        h, c = table["h"].to_numpy(), table["c"].to_numpy()
        order = np.argsort(h)
        h, c = h[order], c[order]
        often = c >= MIN_WORD
        number = np.cumsum(often) - 1 + start.get(key[0].as_py(), 0)
        path = [None] * len(h)
        if often.any():
            path[0] = f"{folder}/{uuid.uuid4().hex}.words"
            save(path[0], {"first": number[often][:1], "count": c[often]})
        return pa.table({"h": h, "c": c, "number": pa.array(number, pa.int32(), mask=~often), "path": pa.array(path, pa.string())})

    done = stage(words.groupBy("part").applyInArrow(build, "h bigint, c bigint, number int, path string"), "lm-numbered", keep=True)
    return done.select("h", "c", "number"), tuple(sorted(r["path"] for r in done.filter("path IS NOT NULL").select("path").collect())), first


def fill(coded: DataFrame, rare: DataFrame, unit: float) -> DataFrame:
    """``coded`` with the numbers of all words of the trie; ``rest``: log10 probability of the words outside the
    dictionary, ``bare``: of those also outside the trie, ``more``: how many occur in the training texts."""
    c, tf = F.coalesce("c", F.lit(0)), F.size("at")
    log = tf * F.log10((c + 0.5) / unit)
    found = coded.select("uid", F.explode("rare").alias("r")).select("uid", "r.h", "r.at").join(rare, "h", "left").groupBy("uid").agg(
        F.sum(log).alias("rest"), F.sum(F.when(F.col("number").isNull(), log).otherwise(0.0)).alias("bare"), F.sum(F.when(c > 0, tf).otherwise(0)).alias("more"),
        F.collect_list(F.when(F.col("number").isNotNull(), F.struct("number", "at"))).alias("fills"))
    columns = ["uid", "doc_id", "learns", "n_tokens", "n_known", "base"]
    rows = coded.drop("rare").join(found, "uid", "left").select(
        *columns, F.coalesce("rest", F.lit(0.0)).alias("rest"), F.coalesce("bare", F.lit(0.0)).alias("bare"), F.coalesce("more", F.lit(0)).cast("bigint").alias("more"), "numbers", "fills")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                numbers, fills = batch.column("numbers"), batch.column("fills")
                every, starts = _flat(numbers)
                text = pc.list_parent_indices(fills).to_numpy()
                new = fills.flatten()
                if len(new):
                    number, at = pc.struct_field(new, "number").to_numpy(), pc.struct_field(new, "at")
                    one = pc.list_parent_indices(at).to_numpy()
                    every[starts[text[one]] + at.flatten().to_numpy()] = number[one]
                edges = pa.array(np.append(starts, len(every)), pa.int32())
                yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.ListArray.from_arrays(edges, pa.array(every, pa.int32()))], batch.schema.names[:-1])

    small_batches(coded.sparkSession)
    id_type = coded.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"uid bigint, doc_id {id_type}, learns boolean, n_tokens bigint, n_known bigint, base double, rest double, bare double, more bigint, numbers array<int>")


def _flat(numbers: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of several texts in a row, and where each text begins."""
    sizes = pc.list_value_length(numbers).to_numpy(zero_copy_only=False)
    return numbers.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(sizes) - sizes


def _counted(coded: DataFrame, pairs_of, bits: int, n: int) -> DataFrame:
    """``context, word, c`` of the training texts' pairs that occur ``MIN_NGRAM`` times; a word has ``bits`` bits.

    A task counts some millions of its tokens at a time and sends each share of the pairs, by their hash, as one block of keys and
    one of counts; shares are as many as ``n``, the training tokens, ask for, so that one is merged in bounded memory.
    """
    shares, least = max(4 * coded.sparkSession.sparkContext.defaultParallelism, -(-n // _TOKENS_AT_ONCE)), MIN_NGRAM

    def run(batches):
        keys, sizes = [], 0

        def flush():
            packed = np.sort(np.concatenate(keys))
            first = np.flatnonzero(np.concatenate(([True], packed[1:] != packed[:-1])))
            key, c = packed[first], np.diff(np.append(first, len(packed))).astype(np.int32)
            share = (mix64(key.astype(np.uint64)) % np.uint64(shares)).astype(np.int32)
            order = np.argsort(share, kind="stable")
            ends = np.append(0, np.cumsum(np.bincount(share, minlength=shares)))
            blocks = [pa.Array.from_buffers(pa.binary(), shares, [None, pa.py_buffer((ends * x.itemsize).astype(np.int32)), pa.py_buffer(x[order])]) for x in (key, c)]
            return pa.RecordBatch.from_arrays([pa.array(np.arange(shares, dtype=np.int32)), *blocks], ["share", "keys", "counts"])

        for batch in batches:
            if batch.num_rows:
                context, word = pairs_of(*_flat(batch.column(0)))
                keys.append(context << bits | word)
                sizes += len(word)
            if sizes > _TOKENS_AT_ONCE:
                yield flush()
                keys, sizes = [], 0
        if sizes:
            yield flush()

    def merge(table: pa.Table) -> pa.Table:
        key, c = (np.frombuffer(b"".join(table[x].to_pylist()), t) for x, t in (("keys", np.int64), ("counts", np.int32)))
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        c = np.add.reduceat(c[order].astype(np.int64), first)
        often = c >= least
        key, c = key[first[often]], c[often]
        return pa.table({"context": key >> bits, "word": key & (1 << bits) - 1, "c": c})

    small_batches(coded.sparkSession)
    blocks = coded.filter("learns").select("numbers").mapInArrow(run, "share int, keys binary, counts binary").filter(F.length("keys") > 0)
    return blocks.groupBy("share").applyInArrow(merge, "context bigint, word bigint, c bigint")


def build_level(grams: DataFrame, contexts: int, lower) -> tuple[str, ...]:
    """Write the kept n-grams ``context, word, c`` as files; ``lower(context, word)`` gives the context's count and the
    shorter context's probability of the word.  Returns the files' paths."""
    spark = grams.sparkSession
    folder = f"{work_folder(spark)}/trie-{uuid.uuid4().hex}"
    n = grams.count()
    if not n:
        return ()
    parts = -(-n // SEGMENT)
    # Contexts are cut into even ranges by their n-grams, so that a context is never split.
    ranged = stage(grams.repartitionByRange(parts, "context").withColumn("part", F.spark_partition_id()), "trie-grams")
    bounds = ranged.groupBy("part").agg(F.min("context").alias("first"), F.count(F.lit(1)).alias("n")).orderBy("first").collect()
    place = {r["part"]: (0 if i == 0 else r["first"], sum(b["n"] for b in bounds[:i]), bounds[i + 1]["first"] if i + 1 < len(bounds) else contexts)
             for i, r in enumerate(bounds)}

    def build(key, table):
        first, offset, end = place[key[0].as_py()]
        table = table.sort_by([("context", "ascending"), ("word", "ascending")])
        context, word, c = (table[x].to_numpy() for x in ("context", "word", "c"))
        total, p_lower = lower(context, word)
        p = (c + PRIOR * p_lower) / (total + PRIOR)
        at = context - first
        kept, kept_lower = np.bincount(at, p, end - first), np.bincount(at, p_lower, end - first)
        backoff = np.log10(np.maximum(1 - kept, 1e-6) / np.maximum(1 - kept_lower, 1e-6))
        path = f"{folder}/{uuid.uuid4().hex}.level"           # files of lost attempts are not in the result
        save(path, Level.arrays(first, offset, context, word, np.log10(p), backoff, c))
        return pa.table({"path": [path]})

    built = stage(ranged.groupBy("part").applyInArrow(build, "path string"), "trie-files")
    return tuple(sorted(r["path"] for r in built.collect()))


class Model:
    """Scores of texts under the dictionary and the trie; without the words that the trie lacks."""

    def __init__(self, dictionary: Dictionary, pairs: tuple[str, ...], triples: tuple[str, ...]):
        self.d, self.pairs, self.triples = dictionary, open_levels(pairs) if pairs else None, open_levels(triples) if triples else None

    def log10(self, numbers: list[np.ndarray]) -> np.ndarray:
        """Per token log10 probability; of tokens outside the trie only the weights that stand before theirs."""
        sizes = np.array([len(x) for x in numbers])
        return self.log10_flat(np.concatenate(numbers), np.cumsum(sizes) - sizes)

    def log10_flat(self, every: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """As :meth:`log10`, for texts in a row that begin at ``starts``."""
        d = self.d
        out = np.where(every >= 0, np.log10(d.prob(every)), 0.0)
        if self.pairs is None:
            return out
        w, v = d.contexts(every, starts)
        two = self._find(self.pairs, v, w, d.bits)
        out = np.where(two >= 0, self.pairs.prob(two), out + self.pairs.backoff(v))
        if self.triples is not None:
            before = self.shifted(two, starts)
            three = self._find(self.triples, before, w, d.bits)
            out = np.where(three >= 0, self.triples.prob(three), out + self.triples.backoff(before))
        return out

    @staticmethod
    def shifted(pairs: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The pair that ends one token earlier in the same text."""
        before = np.concatenate(([-1], pairs[:-1]))
        before[starts] = -1
        return before

    @staticmethod
    def _find(levels: Levels, context: np.ndarray, word: np.ndarray, bits: int) -> np.ndarray:
        """Look up distinct pairs once."""
        out = np.full(len(context), -1)
        some = np.flatnonzero((context >= 0) & (word >= 0))
        if len(some):
            packed, back = np.unique(context[some] << bits | word[some], return_inverse=True)
            out[some] = levels.find(packed >> bits, packed & (1 << bits) - 1)[back]
        return out


def score_documents(docs: DataFrame, remainder: int | None = 1) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` (log10), learning from the texts whose crc32
    remainder modulo 5 is not ``remainder`` (None: all; rows without an id always count).

    A null or empty text is its end alone.  Repeated rows count and are scored each; null ids are carried; other columns
    are ignored.  With no training text every token is unseen.
    """
    spark = docs.sparkSession
    # Staged tables go as soon as the next one is written; what stays are the numbered texts and the files of counts and levels.
    with scratch(spark):
        with scratch(spark):
            words = stage(count_words(docs, remainder).withColumn("h", F.xxhash64("word")), "lm-words")
            total = words.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
            n, v = total["n"] or 0, total["v"]
            common = max(2, DICTIONARY_SHARE * n)
            end = F.col("word") == F.lit(END)
            own = Dictionary(words.filter((F.col("c") >= common) | end).select("word", "c").collect(), n, v)   # at most 1 / DICTIONARY_SHARE words
            rare, own.paths, own.size = number_rare(words.filter((F.col("c") < common) & ~end), own.size)
        d = spark.sparkContext.broadcast(own)
        coded = stage(fill(stage(encode(docs, d, remainder), "lm-coded"), rare, own.total), "lm-numbers", keep=True)

    def pairs_of(every, starts):
        w, before = d.value.contexts(every, starts)
        both = (w >= 0) & (before >= 0)
        return before[both], w[both]

    with scratch(spark):
        pairs = build_level(stage(_counted(coded, pairs_of, own.bits, n), "lm-pairs"), own.size,
                            lambda context, word: (d.value.counts(context), d.value.prob(word)))
    triples: tuple[str, ...] = ()
    if pairs:
        def triples_of(every, starts):
            w, before = d.value.contexts(every, starts)
            two = Model._find(open_levels(pairs), before, w, d.value.bits)
            context = Model.shifted(two, starts)
            both = (context >= 0) & (two >= 0)
            return context[both], w[both]

        size = 0
        for f in open_levels(pairs).parts:
            size = max(size, f.offset + f.words.n)
        if size.bit_length() + own.bits > 63:
            raise ValueError("too many pairs and words for keys of 63 bits")
        def lower(context, word):
            levels = open_levels(pairs)
            shorter = levels.find(levels.word(context), word)
            return levels.count(context).astype(float), 10.0 ** levels.prob(shorter)

        with scratch(spark):
            triples = build_level(stage(_counted(coded, triples_of, own.bits, n), "lm-triples"), size, lower)
    return _scores(coded, d, pairs, triples).select(
        "doc_id", "n_tokens", (F.col("n_known") + F.col("more")).cast("bigint").alias("n_known"), F.lit(n).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.col("rest")).alias("base_score"), (F.col("model") + F.col("bare")).alias("score"))


def _scores(coded: DataFrame, d, pairs, triples) -> DataFrame:
    """The coded texts with the sum of the model's log10 probabilities over the trie's words."""
    def run(batches):
        model = Model(d.value, pairs, triples)
        for batch in batches:
            if batch.num_rows:
                every, starts = _flat(batch.column("numbers"))
                total = np.add.reduceat(model.log10_flat(every, starts), starts)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(total)], [*batch.schema.names[:-1], "model"])

    small_batches(coded.sparkSession)
    id_type = coded.schema["doc_id"].dataType.simpleString()
    return coded.select("doc_id", "n_tokens", "n_known", "base", "rest", "bare", "more", "numbers").mapInArrow(
        run, f"doc_id {id_type}, n_tokens bigint, n_known bigint, base double, rest double, bare double, more bigint, model double")
