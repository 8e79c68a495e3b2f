"""Toxicity by the nearest labelled examples.

Texts are vectors over every word of the labelled examples, and over character n-grams
that examples tie to toxicity.  A feature weighs TF-IDF times how surely the examples
tell the classes apart by it; document frequencies come from all texts.  The examples
are a bounded sample, so their inverted index is bounded too and may be broadcast: per
feature it has postings and, per block of examples, the highest weight.  Blocks are
visited by their bound until none can reach the k-th best cosine, so the neighbours are
exact.  Neighbours vote by similarity; votes become probabilities by an isotonic map
fitted on leave-one-out votes of the examples.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hazardgrid.llm.common import held_out, kept, small_batches
from hazardgrid.session import scratch, spread, stage

#: Labelled examples per class that are indexed; which ones is decided by a hash of their id.
EXAMPLES_PER_CLASS = 2048
#: Words of the examples that the index may hold; of more, those of the fewest examples are left out.
VOCABULARY = 1 << 20
#: N-grams kept, and what makes one: examples that have it, standard errors between the classes, and how many times
#: as frequent it is among toxic examples.
NGRAM_FEATURES = 1024
MIN_EXAMPLES = 3
MIN_Z = 5.0
MIN_RATIO = 10.0
NGRAMS = (4, 5)
#: Least association of a feature, in standard errors: a word that tells nothing still finds neighbours.
LEAST_ASSOCIATION = 0.1
BLOCK = 64
NEIGHBOURS = 25
#: A feature of more than this part of the examples has its postings as a table of all places; only the layout differs.
FULL_SHARE = 0.125
_WORD = re.compile(r"[^\W\d_]+")
_WORDS_REMEMBERED = 200_000
_SCORES_REMEMBERED = 20_000


def ngrams(word: str) -> set[str]:
    """N-grams of a word with its borders marked; a blank in front tells them from words."""
    marked = f"^{word}$"
    return {" " + marked[i:i + n] for n in NGRAMS for i in range(len(marked) - n + 1)}


def starts_of_ngrams(word: str) -> list[str]:
    """The shortest n-grams; every longer one begins with one of them."""
    marked = f"^{word}$"
    n = min(NGRAMS)
    return [marked[i:i + n] for i in range(len(marked) - n + 1)]


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _example_counts(batches):
    """Per task: how many toxic and other examples have a feature."""
    counts = Counter(), Counter()

    def flush():
        names = list(counts[0].keys() | counts[1].keys())
        out = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([counts[1][n] for n in names], pa.int64()),
                                          pa.array([counts[0][n] for n in names], pa.int64())], ["feature", "toxic", "other"])
        counts[0].clear()
        counts[1].clear()
        return out

    kept(None)
    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = {*words(text)}
            counts[toxic].update(own.union(*map(ngrams, own)))
        if len(counts[0]) + len(counts[1]) > 500_000:
            yield flush()
    if counts[0] or counts[1]:
        yield flush()


def examples_of(labels: DataFrame, remainder: int | None) -> tuple[DataFrame, dict[int, float]]:
    """``doc_id, toxic`` of the sampled examples, and how many labelled rows each stands for per class.

    Several labels of an id: toxic if any says so; null ids and labels are left out.
    """
    rows = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL")
    if remainder is not None:
        rows = rows.filter(~held_out("doc_id", remainder))
    rows = rows.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    rows = stage(rows, "toxicity-labels")
    total = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    pick = [rows.filter(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(EXAMPLES_PER_CLASS) for c in (0, 1)]
    return stage(pick[0].unionByName(pick[1]), "toxicity-examples"), {
        c: total.get(c, 0) / max(1, min(total.get(c, 0), EXAMPLES_PER_CLASS)) for c in (0, 1)}


def choose_features(docs: DataFrame, examples: DataFrame) -> tuple[list[str], np.ndarray]:
    """All words of the examples and the n-grams that they tie to toxicity, and the association of each."""
    small_batches(docs.sparkSession)
    sizes = {r["toxic"]: r["n"] for r in examples.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    a, b = sizes.get(1, 0), sizes.get(0, 0)
    if not a or not b:
        return [], np.zeros(0)
    # At most 2 * EXAMPLES_PER_CLASS ids are broadcast.
    chosen = docs.select("doc_id", "text").join(F.broadcast(examples), "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), "toxic")
    counts = chosen.mapInArrow(_example_counts, "feature string, toxic bigint, other bigint").groupBy("feature").agg(
        F.sum("toxic").alias("x"), F.sum("other").alias("y"))
    # An id with several texts may count a feature more than once.
    share = F.least((F.col("x") + F.col("y")) / (a + b), F.lit(1.0))
    spread_of = F.sqrt(share * (1 - share) * (1 / a + 1 / b))
    z = F.when(share < 1, (F.col("x") / a - F.col("y") / b) / spread_of).otherwise(0.0)
    counts = stage(counts.withColumn("z", z).withColumn("ngram", F.col("feature").startswith(" ")), "toxicity-features")
    often = F.col("x") / a >= MIN_RATIO * (F.col("y") + 1) / b
    parts = counts.filter(F.col("ngram") & (F.col("x") >= MIN_EXAMPLES) & often & (F.col("z") >= MIN_Z)).orderBy(F.desc("z"), "feature").limit(NGRAM_FEATURES)
    whole = counts.filter(~F.col("ngram")).orderBy(F.desc(F.col("x") + F.col("y")), "feature").limit(VOCABULARY)
    rows = whole.unionByName(parts).select("feature", "z").toArrow()
    return rows["feature"].to_pylist(), np.maximum(np.abs(rows["z"].to_numpy()), LEAST_ASSOCIATION)


def vectors(docs: DataFrame, features: list[str], shared) -> DataFrame:
    """``id, at, tf``: which features a text has and how often its words show them; ``shared``: their numbers, as a broadcast."""
    begin = frozenset(f[1:1 + min(NGRAMS)] for f in features if f[0] == " ")
    small_batches(docs.sparkSession)

    def run(batches):
        kept(None)
        number = shared.value
        known: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            ends, at, tf = [0], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for text in batch.column(1).to_pylist():
                f: list[int] = []
                c: list[int] = []
                for w, n in Counter(words(text)).items():
                    got = known.get(w)
                    if got is None:
                        mine = [w] if begin.isdisjoint(starts_of_ngrams(w)) else [w, *ngrams(w)]
                        got = known[w] = tuple(number[x] for x in mine if x in number)
                    for x in got:
                        f.append(x)
                        c.append(n)
                if len(known) > _WORDS_REMEMBERED:
                    known.clear()
                places, back = np.unique(np.array(f, np.int64), return_inverse=True)
                at.append(places)
                tf.append(np.bincount(back, c, len(places)).astype(np.int64) if len(places) else places)
                ends.append(ends[-1] + len(places))
            offsets = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x).astype(np.int32))) for x in (at, tf)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], ["id", "at", "tf"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
        run, f"id {id_type}, at array<int>, tf array<int>")


def ranges(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges ``start .. stop - 1`` one after the other, and the ranges' sizes."""
    sizes = stop - start
    before = np.cumsum(sizes) - sizes
    return np.repeat(start - before, sizes) + np.arange(int(sizes.sum())), sizes


def rows_of(batch: pa.RecordBatch, *columns: int):
    """Per row, the lists of the given columns as numpy arrays."""
    flat = [(batch.column(c).offsets.to_numpy(), batch.column(c).values.to_numpy()) for c in columns]
    for i in range(batch.num_rows):
        yield tuple(v[o[i]:o[i + 1]] for o, v in flat)


def example_rows(table: pa.Table) -> list[tuple]:
    """The rows that :class:`Index` takes; their lists stay views of the table's arrays."""
    return [(*row, x, y, first) for batch in table.to_batches()
            for row, x, y, first in zip(rows_of(batch, 0, 1), *(batch.column(c).to_pylist() for c in (2, 3, 4)))]


class Index:
    """Block-max inverted index over distinct example vectors."""

    def __init__(self, rows: list, idf: np.ndarray, weight: dict[int, float]):
        """``rows``: (feature numbers, counts, toxic examples, other examples, smallest id); the first two may be views of one array,
        so that the driver holds no object for a posting."""
        self.idf = idf
        full = [(self.weigh(r[0], r[1]), r) for r in rows if len(r[0])]
        # Examples led by the same feature share blocks, which keeps the bounds of other blocks low.
        full.sort(key=lambda v: (v[1][0][int(np.argmax(v[0]))], v[1][4]))
        self.toxic = np.array([r[2] for _, r in full], float)
        self.other = np.array([r[3] for _, r in full], float)
        self.ids = np.array([r[4] for _, r in full], np.int64)
        self.weight = weight
        at = np.concatenate([np.asarray(r[0], np.int32) for _, r in full]) if full else np.zeros(0, np.int32)
        who = np.repeat(np.arange(len(full), dtype=np.int32), [len(r[0]) for _, r in full]) if full else np.zeros(0, np.int32)
        val = np.concatenate([v for v, _ in full]) if full else np.zeros(0)
        del full
        order = np.argsort(at, kind="stable")        # a feature's examples stay in order
        at, who, val = at[order], who[order], val[order]
        del order
        at, who, val = self._full_rows(at, who, val)
        self.val = val
        # An entry is a feature in a block: its postings start at ``edge``, its highest weight is ``top``.
        fresh = np.ones(len(at), bool)
        fresh[1:] = (at[1:] != at[:-1]) | (who[1:] // BLOCK != who[:-1] // BLOCK)
        first = np.flatnonzero(fresh)
        self.inside = (who % BLOCK).astype(np.int16)
        self.edge = np.append(first, len(at)).astype(np.int32)
        self.block = (who[first] // BLOCK).astype(np.int32)
        self.top = np.maximum.reduceat(self.val, first) if len(first) else np.zeros(0)
        self.entries = np.searchsorted(at[first], np.arange(len(idf) + 1)).astype(np.int32)
        none = [r for r in rows if not len(r[0])]
        self.none = sum(r[2] for r in none) * weight[1], sum(r[3] for r in none) * weight[0]
        every = self.none[0] + (self.toxic.sum() * weight[1]), self.none[1] + (self.other.sum() * weight[0])
        #: Toxic rate of all examples; nothing can be told without both classes.
        self.rate = every[0] / (every[0] + every[1]) if min(every) > 0 else 0.0
        self.lines: tuple = ([], [])                 # the isotonic map
        self.seen: dict = {}

    def _full_rows(self, at: np.ndarray, who: np.ndarray, val: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tables of the postings and block maxima of the features that many examples have; returns the other postings."""
        n = -(-len(self.ids) // BLOCK)
        often = np.bincount(at, minlength=len(self.idf))
        common = np.flatnonzero(often > FULL_SHARE * max(1, len(self.ids)))
        self.row = np.full(len(self.idf), -1, np.int32)
        self.row[common] = np.arange(len(common))
        self.full = np.zeros((len(common), n, BLOCK))
        mine = self.row[at] >= 0
        self.full[self.row[at[mine]], who[mine] // BLOCK, who[mine] % BLOCK] = val[mine]
        self.full_top = self.full.max(axis=2)
        return at[~mine], who[~mine], val[~mine]

    def weigh(self, at, tf) -> np.ndarray:
        v = (1 + np.log(np.asarray(tf, float))) * self.idf[np.asarray(at, int)]
        return v / np.sqrt((v * v).sum())

    def nearest(self, at, tf, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` examples of the highest cosine and their cosines, exactly; ties go to the lower place.

        Blocks are visited in growing groups, by falling bound.
        """
        q, at = self.weigh(at, tf), np.asarray(at, int)
        n = -(-len(self.ids) // BLOCK)
        row = self.row[at]
        dense, rest = np.flatnonzero(row >= 0), np.flatnonzero(row < 0)
        row, heavy = row[dense], q[dense]
        entry, sizes = ranges(self.entries[at[rest]], self.entries[at[rest] + 1])
        weight, block = np.repeat(q[rest], sizes), self.block[entry]
        bound = np.bincount(block, weight * self.top[entry], n) + np.einsum("i,ij->j", heavy, self.full_top[row])
        order = np.argsort(-bound, kind="stable")
        slot = np.full(n, -1)
        who, score, least = np.zeros(0, int), np.zeros(0), 0.0
        done, size = 0, 8
        while done < n:
            group = order[done:done + size]
            group = group[(bound[group] > 0) & ((len(score) < k) | (bound[group] >= least - 1e-12))]
            if not len(group):
                break
            slot[group] = np.arange(len(group))
            mine = np.flatnonzero(slot[block] >= 0)
            posting, sizes = ranges(self.edge[entry[mine]], self.edge[entry[mine] + 1])
            got = np.bincount(np.repeat(slot[block[mine]] * BLOCK, sizes) + self.inside[posting], np.repeat(weight[mine], sizes) * self.val[posting], len(group) * BLOCK)
            if len(row):
                got = got + np.einsum("i,ij->j", heavy, self.full[row[:, None], group].reshape(len(row), len(got)))
            got = np.round(got, 12)                  # the order of summing decides no tie
            slot[group] = -1
            hit = np.flatnonzero(got > 0)
            who, score = np.append(who, group[hit // BLOCK] * BLOCK + hit % BLOCK), np.append(score, got[hit])
            if len(score) > k:
                good = score >= np.partition(score, -k)[-k]
                who, score = who[good], score[good]
            best = np.lexsort((who, -score))[:k]
            who, score = who[best], score[best]
            least = score[-1] if len(score) else 0.0
            done, size = done + size, 4 * size
        return who, score

    def vote(self, at, tf, own: int | None = None) -> tuple[float | None, np.ndarray, np.ndarray]:
        """Share of toxic among the neighbours, by squared cosine and by what an example stands for.

        ``own``: the label of this very example, which is then left out.  None without neighbours.
        """
        who, score = self.nearest(at, tf)
        toxic, other = self.toxic[who].copy(), self.other[who].copy()
        if own is not None:
            same = np.flatnonzero(score > 1 - 1e-9)
            group = toxic if own else other
            same = same[group[same] > 0]
            if len(same):
                group[same[0]] -= 1
        t, o = (score ** 2 * toxic).sum() * self.weight[1], (score ** 2 * other).sum() * self.weight[0]
        return (float(t / (t + o)) if t + o > 0 else None), who, score

    def calibrate(self, bins: list[tuple[float, float, float]]) -> None:
        """Pool adjacent violators over (vote, toxic weight, all weight)."""
        pools: list[list[float]] = []
        for v, t, a in sorted(bins):
            pools.append([v * a, t, a])
            while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
                last = pools.pop()
                pools[-1] = [x + y for x, y in zip(pools[-1], last)]
        self.lines = [p[0] / p[2] for p in pools], [p[1] / p[2] for p in pools]

    def score(self, at, tf) -> tuple[float, list[int], list[float]]:
        """Probability, and the ids and cosines of the three nearest examples."""
        key = hashlib.blake2b(np.concatenate((at, tf)).astype(np.int64).tobytes(), digest_size=16).digest()
        if key not in self.seen:
            vote, who, cosine = self.vote(at, tf) if len(at) else (None, [], [])
            if vote is None:
                t, o = self.none
                p = (t + self.rate) / (t + o + 1.0) if self.rate else 0.0
            else:
                p = float(np.interp(vote, *self.lines)) if self.lines[0] else vote
            if len(self.seen) > _SCORES_REMEMBERED:
                self.seen.clear()
            self.seen[key] = min(1.0, max(0.0, p)), [int(i) for i in self.ids[who[:3]]] if len(who) else [], [float(c) for c in cosine[:3]]
        return self.seen[key]


def score_documents(docs: DataFrame, labels: DataFrame, remainder: int | None = 0) -> DataFrame:
    """``doc_id, score, evidence``: probability of the toxic label and the nearest examples with their cosines.

    Examples are labelled rows whose crc32 remainder modulo 5 is not ``remainder`` (None: all labelled rows).  Texts
    without any feature, empty and null ones included, get the toxic rate of such examples, smoothed by that of all;
    without labels of both classes every score is 0.  Rows are scored by their text alone, so repeated rows score alike and
    null ids are carried; other columns are ignored.
    """
    spark = docs.sparkSession
    examples, weight = examples_of(labels, remainder)
    features, association = choose_features(docs, examples)
    numbers = spark.sparkContext.broadcast({f: i for i, f in enumerate(features)})
    found = stage(vectors(docs, features, numbers), "toxicity-vectors")
    numbers.destroy()                                 # the vectors are written
    n = found.count()
    df = np.zeros(len(features))
    seen = found.select(F.explode("at").alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("n")).toArrow()      # at most the features
    df[seen["f"].to_numpy()] = seen["n"].to_numpy()
    idf = (np.log((n + 1) / (df + 1)) + 1) * association
    # Of several texts of one id the first by hash stands for it, so that there are no more vectors than examples.
    of = found.join(F.broadcast(examples.withColumnRenamed("doc_id", "id")), "id")
    of = of.groupBy("id").agg(F.min(F.struct(F.xxhash64("at", "tf").alias("hash"), "at", "tf", "toxic")).alias("v"))
    labelled = stage(of.select("id", "v.at", "v.tf", "v.toxic"), "toxicity-index")
    rows = labelled.groupBy("at", "tf").agg(F.sum("toxic").alias("x"), F.sum(1 - F.col("toxic")).alias("y"), F.min("id").alias("first"))
    index = Index(example_rows(rows.select("at", "tf", "x", "y", "first").toArrow()), idf, weight)
    shared = spark.sparkContext.broadcast(index)      # bounded: 2 * EXAMPLES_PER_CLASS vectors

    def votes(batches):
        for batch in batches:
            out = [(shared.value.vote(a, t, own)[0], own) for (a, t), own in zip(rows_of(batch, 0, 1), batch.column(2).to_pylist()) if len(a)]
            out = [(v, own) for v, own in out if v is not None]
            yield pa.RecordBatch.from_arrays([pa.array([v for v, _ in out], pa.float64()), pa.array([o for _, o in out], pa.int32())], ["vote", "toxic"])

    small_batches(spark)
    bins = spread(labelled.select("at", "tf", "toxic")).mapInArrow(votes, "vote double, toxic int").groupBy(F.floor(F.col("vote") * 100).alias("bin"), "toxic").agg(
        F.avg("vote").alias("vote"), F.count(F.lit(1)).alias("n")).collect()
    index.calibrate([(r["vote"], r["n"] * weight[1] * r["toxic"], r["n"] * weight[r["toxic"]]) for r in bins])
    lines = index.lines                               # at most 202 bins; the index itself is sent once

    def scores(batches):
        ready = shared.value
        ready.lines = lines
        for batch in batches:
            got = [ready.score(a, t) for a, t in rows_of(batch, 1, 2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([g[0] for g in got], pa.float64()),
                 pa.array([[{"doc_id": i, "cosine": c} for i, c in zip(g[1], g[2])] for g in got], pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64())])))],
                ["doc_id", "score", "evidence"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return spread(found).mapInArrow(scores, f"doc_id {id_type}, score double, evidence array<struct<doc_id:bigint,cosine:double>>")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the ids that score ``threshold`` or more; of rows without an id all go if one does."""
    with scratch(docs.sparkSession):        # of all that is staged here only the ids that go are needed afterwards
        scored = score_documents(docs, labels, None).filter(F.col("score") >= threshold)
        gone = stage(scored.select(F.col("doc_id").alias("_gone")).distinct(), "toxicity-gone", keep=True)
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("_gone")), "left_anti")
