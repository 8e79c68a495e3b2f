"""Embedding whitening: leading principal components by Chebyshev-filtered subspace iteration.

Vectors become integer vectors once and stay packed.  Every step on the covariance is one Spark pass over the distinct ones that returns
``sum (x - mean) ((x - mean) . Q)``, a matrix of ``dimension x BLOCK``; a polynomial of such passes damps the spectrum below the block, then a QR and a
Rayleigh-Ritz step follow, until the residuals of the wanted pairs are certified.  The driver holds matrices of that size only.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from hazardgrid.llm.common import small_batches
from hazardgrid.session import stage

#: Columns that the subspace has at least (or the dimension); the wanted ones are among them.
BLOCK = 32
#: Passes of one filter at most, and filters.
DEGREE = 12
ROUNDS = 40
#: Residual of a certified pair, as a share of its eigenvalue; and what rounding may leave, as a share of the largest one.
CERTIFIED = 1e-13
ROUNDING = 1e-12
#: Partial results added up in tasks, not on the driver, when there are more of them.
FAN_IN = 64

_WIDTHS = (1, 2, 4, 8)


def _packed(x: np.ndarray) -> list[tuple[np.ndarray, pa.Array]]:
    """``(rows, bytes)`` for each width: a row's integers in the narrowest width that holds them."""
    low, high = x.min(axis=1), x.max(axis=1)
    left = np.ones(len(x), bool)
    out = []
    for width in _WIDTHS:
        limit = np.iinfo(f"i{width}")
        rows = np.flatnonzero(left & (low >= limit.min) & (high <= limit.max))
        left[rows] = False
        if len(rows):
            raw = np.ascontiguousarray(x[rows].astype(f"<i{width}"))
            out.append((rows, pa.FixedSizeBinaryArray.from_buffers(pa.binary(width * x.shape[1]), len(rows), [None, pa.py_buffer(raw)]).cast(pa.binary())))
    return out


def _unpacked(column: pa.Array, dim: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(rows, n x dim integers)`` for each width in an Arrow column of packed vectors."""
    raw = column.to_pylist()
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        yield rows, np.frombuffer(b"".join([raw[i] for i in rows]), f"<i{size // dim}").reshape(-1, dim)


def integer_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, dim, x``, staged: ``floor(256 * entry)`` of each row's entries, packed; rows with a null, non-finite or too large entry, or none, are left out."""
    chosen = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            for dim in np.unique(lengths[lengths > 0]).tolist():
                rows = np.flatnonzero(lengths == dim)
                flat = lists.take(pa.array(rows)).flatten()
                with np.errstate(all="ignore"):
                    x = np.floor(256.0 * flat.to_numpy(zero_copy_only=False)).reshape(-1, dim)
                    fine = (np.abs(x) < 2.0**63).all(axis=1)      # false for nulls, which are NaN here
                x = x[fine].astype(np.int64)
                for part, raw in _packed(x) if len(x) else ():
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows[fine][part])), pa.array(np.full(len(raw), dim, np.int32)), raw], ["id", "dim", "x"])

    small_batches(df.sparkSession)
    id_type = df.schema[id_col].dataType.simpleString()
    return stage(chosen.mapInArrow(run, f"id {id_type}, dim int, x binary"), "white-rows")


def distinct_blocks(rows: DataFrame, dim: int) -> DataFrame:
    """``x``, staged: many distinct vectors to a row, one after the other."""
    def run(batches):
        for batch in batches:
            for _, x in _unpacked(batch.column(0), dim):
                for _, raw in _packed(x.reshape(1, -1)):
                    yield pa.RecordBatch.from_arrays([raw, pa.array([len(x)], pa.int64())], ["x", "n"])

    return stage(rows.select("x").distinct().mapInArrow(run, "x binary, n bigint"), "white-fit")


class Fit(NamedTuple):
    """What the fit list says: size, exact sums, components as columns, eigenvalues, their sum, and the error of the whitened covariance."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float


def _exact_sums(x: np.ndarray) -> list[int]:
    if float(np.abs(x.astype(np.float64)).max()) * len(x) < 2.0**62:
        return x.sum(axis=0, dtype=np.int64).tolist()
    return x.astype(object).sum(axis=0).tolist()


def _moments(blocks: DataFrame, dim: int) -> tuple[int, list[int]]:
    def run(batches):
        n, sums = 0, [0] * dim
        for batch in batches:
            for raw, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = np.frombuffer(raw, f"<i{len(raw) // (rows * dim)}").reshape(rows, dim)
                n, sums = n + rows, [a + b for a, b in zip(sums, _exact_sums(x))]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array([n] * dim, pa.int64()), pa.array(list(map(str, sums)))], ["at", "n", "s"])

    found = blocks.mapInArrow(run, "at int, n bigint, s string").groupBy("at").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    by_place = {r["at"]: r for r in found}
    return (by_place[0]["n"] if found else 0), [int(by_place[i]["s"]) for i in sorted(by_place)]


def summed(blocks: DataFrame, dim: int, shape: tuple[int, ...], work: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of ``work(block)`` over all blocks in one pass: added up in each task, then by ``FAN_IN`` tasks where there are more, then here."""
    def run(batches):
        total, some = np.zeros(shape), False
        for batch in batches:
            for raw, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total += work(np.frombuffer(raw, f"<i{len(raw) // (rows * dim)}").reshape(rows, dim).astype(np.float64))
                some = True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "value"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(v, np.float64) for v in table["value"].to_pylist())
        return pa.table({"part": table["part"].slice(0, 1), "value": pa.array([total.tobytes()], pa.binary())})

    partial = blocks.mapInArrow(run, "part int, value binary")
    if blocks.rdd.getNumPartitions() > FAN_IN:
        partial = partial.groupBy((F.col("part") % FAN_IN).alias("fan")).applyInArrow(add, "part int, value binary")
    found = sorted(partial.collect(), key=lambda r: r["part"])
    return sum((np.frombuffer(r["value"], np.float64) for r in found), np.zeros(math.prod(shape))).reshape(shape)


def leading_pairs(times: Callable[[np.ndarray], np.ndarray], dim: int, wanted: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """``values, vectors`` of the ``wanted`` largest eigenvalues of a positive semidefinite operator ``times(Q) = V Q``.

    A round filters the block with a Chebyshev polynomial that is small on ``[0, lowest Ritz value]``, orthogonalises it and solves the projected
    problem.  It ends when all wanted residuals are certified, or no longer fall because they have reached rounding.
    """
    size = min(dim, max(BLOCK, 2 * wanted))
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, size)))[0]
    best, stale = math.inf, 0
    for _ in range(ROUNDS):
        vq = times(q)
        projected = q.T @ vq
        values, turn = np.linalg.eigh((projected + projected.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, vq = q @ turn, vq @ turn
        residuals = np.linalg.norm(vq[:, :wanted] - q[:, :wanted] * values[:wanted], axis=0)
        residual = float((residuals / np.maximum(values[:wanted], ROUNDING * values[0])).max())
        stale = stale + 1 if residual > best / 2 else 0
        if size == dim or residual <= CERTIFIED or (stale >= 2 and residuals.max() <= ROUNDING * values[0]):
            return values[:wanted], q[:, :wanted]
        best = min(best, residual)
        # Leading pairs that are certified stay as they are; the filter works beside them and need not fear their size.
        fixed = int(np.logical_and.accumulate(residuals <= CERTIFIED * values[:wanted]).sum())
        held, free = q[:, :fixed], q[:, fixed:]

        def beside(y):
            return y - held @ (held.T @ y)

        centre = half = max(float(values[-1]), 1e-12 * float(values[0])) / 2
        top = (values[fixed] - centre) / half
        degree = int(max(2, min(DEGREE, math.acosh(1e12) / math.acosh(max(top, 1 + 1e-9)))))
        # Three-term recurrence, scaled so that the largest value stays near one.
        sigma = scale = 1 / top
        older, newer = free, beside((vq[:, fixed:] - centre * free) * (sigma / half))
        for _ in range(degree - 1):
            following = 1 / (2 / scale - sigma)
            older, newer = newer, beside(2 * (times(newer) - centre * newer) * (following / half) - sigma * following * older)
            sigma = following
        q = np.linalg.qr(np.column_stack([held, newer]))[0]
    raise RuntimeError(f"not certified after {ROUNDS} rounds: residual {best:.2g} of the eigenvalue")


def fit(blocks: DataFrame, dim: int, components: int) -> Fit | None:
    """The leading components of the covariance of all vectors in ``blocks``; ``None`` without any."""
    n, sums = _moments(blocks, dim)
    if not n:
        return None
    mean = np.array([s / n for s in sums])

    def times(q: np.ndarray) -> np.ndarray:
        def work(x):
            x -= mean
            return x.T @ (x @ q)
        return summed(blocks, dim, q.shape, work) / n

    def scatter(x):
        return np.array([((x - mean) ** 2).sum()])

    trace = float(summed(blocks, dim, (1,), scatter)[0]) / n
    wanted = min(components, dim)
    values, vectors = (np.zeros(wanted), np.eye(dim)[:, :wanted]) if trace == 0 else leading_pairs(times, dim, wanted)
    values = np.where(values > max(dim, 16) * np.finfo(float).eps * max(values[0], 0), values, 0.0)
    real = int((values > 0).sum())
    error = 0.0
    if real:
        onto = vectors[:, :real] / np.sqrt(values[:real])

        def whitened(x):
            w = np.column_stack([np.ones(len(x)), (x - mean) @ onto])
            return w.T @ w
        found = summed(blocks, dim, (real + 1, real + 1), whitened) / n
        error = float(np.abs(found[1:, 1:] - np.outer(found[0, 1:], found[0, 1:]) - np.eye(real)).max())
    return Fit(n, sums, vectors, values, trace, error)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """``sum (n x - S)^2`` of each row, exact; null beyond a long."""
    far = np.abs(x.astype(np.float64)).max() * n + max(map(abs, sums))
    if far * far * x.shape[1] < 2.0**62:
        return pa.array(((n * x.astype(np.int64) - np.array(sums, np.int64)) ** 2).sum(axis=1))
    exact = ((n * x.astype(object) - np.array(sums, object)) ** 2).sum(axis=1)
    return pa.array([int(v) if v < 1 << 63 else None for v in exact], pa.int64())


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 4) -> DataFrame:
    """``<id_col>, component, n, deviation, whitened, explained, identity_error``: each remaining row on each leading component.

    Entries count as ``floor(256 * entry)``; the covariance is that of the distinct integer vectors.  Left out are rows whose vector is null, empty,
    holds a null or non-finite entry or one whose 256-fold is no long, or has another length than most remaining rows (of equally many, the longer
    length counts).  Rows repeated, or with equal vectors, each have their rows; a null id stays.  A component without variance has a null ``whitened``
    and explains 0; fewer dimensions than ``components`` give as many components.  ``deviation`` is null where it exceeds a long.  No remaining
    row: no rows.  Other columns are ignored.
    """
    rows = integer_vectors(df, id_col, vector_col)
    lengths = rows.groupBy("dim").count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    dim = lengths[0]["dim"] if lengths else 1
    rows = rows.filter(F.col("dim") == dim)
    found = fit(distinct_blocks(rows, dim), dim, components)
    id_type = df.schema[id_col].dataType.simpleString()
    schema = f"id {id_type}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"

    def run(batches):
        n, sums, vectors, values, trace, error = found
        mean = np.array([s / n for s in sums])
        k = len(values)
        onto = vectors / np.sqrt(np.where(values > 0, values, np.nan))
        shares = values / trace if trace > 0 else values
        for batch in batches:
            for at, x in _unpacked(batch.column(1), dim):
                w = ((x - mean) @ onto).ravel()
                each = pa.array(np.repeat(np.arange(len(x)), k))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(at)).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(w), n)),
                    _deviations(x, n, sums).take(each), pa.array(w, mask=np.isnan(w)), pa.array(np.tile(shares, len(x))), pa.array(np.full(len(w), error))],
                    ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select("id", "x").mapInArrow(run if found else (lambda batches: iter(())), schema).withColumnRenamed("id", id_col)
