"""Embedding whitening: principal components by Golub-Kahan-Lanczos bidiagonalisation of the centred rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelworks.llm.common import drop, flat, save, tune

#: Entries of a dense block of rows: what a task holds at a time, whatever the rows' length.
BLOCK = 1 << 21
#: Entries of a stored block; as many as ARROW_ROWS of them are read at a time.
STORED = 1 << 15
EPS = float(np.finfo(float).eps)


def quantised(vectors: DataFrame, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v array<long>): floor(scale * c) of each entry, c as double.

    Rows whose vector is null or holds a null, NaN or infinite entry are left out; rows with a null id, rows that repeat
    an id or a vector, and empty vectors stay.
    """
    c = F.col(vector_col)
    sound = c.isNotNull() & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where(sound).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(c, lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("v"))


def _blocks(column: pa.Array, d: int, most: int = BLOCK) -> Iterator[tuple[int, np.ndarray]]:
    """The rows of an Arrow list column as dense blocks of ``d`` entries (what a row lacks is 0), each with its first row."""
    values, offsets = flat(column)
    lengths = np.diff(offsets)
    step = max(1, most // max(1, d))
    for start in range(0, len(lengths), step):
        part = lengths[start : start + step]
        lo, hi = offsets[start], offsets[start + len(part)]
        out = np.zeros((len(part), d), np.int64)
        out[np.repeat(np.arange(len(part)), part), np.arange(lo, hi) - np.repeat(offsets[start : start + len(part)], part)] = values[lo:hi]
        yield start, out


def dense(fit: DataFrame, d: int) -> DataFrame:
    """(rows int, width int, block binary): (v array<long>) rows as dense blocks of bounded size, saved. The many passes over
    the fit list read numbers as they lie, in 2, 4 or 8 bytes, whichever holds the block's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def told() -> pa.RecordBatch:
            x = np.concatenate(held)
            held.clear()
            width = next(w for w in (2, 4, 8) if w == 8 or _largest(x) < 1 << (8 * w - 1))
            return pa.RecordBatch.from_arrays([pa.array([len(x)], pa.int32()), pa.array([width], pa.int32()), pa.array([x.astype(f"<i{width}").tobytes()], pa.binary())], names=["rows", "width", "block"])

        for batch in batches:
            for _, x in _blocks(batch.column(0), d, STORED):
                held.append(x)
                count += x.size
                if count >= STORED:
                    yield told()
                    count = 0
        if held:
            yield told()

    return save(fit.select("v").mapInArrow(run, "rows int, width int, block binary"), "blocks")


def _read(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield np.frombuffer(batch.column(2)[i].as_buffer(), f"<i{batch.column(1)[i].as_py()}").reshape(-1, d)


def _exact(x: np.ndarray, bound: int) -> np.ndarray:
    """The integers as they are, or as Python's where what is made of them might pass 64 bits."""
    return x if bound < 1 << 62 else x.astype(object)


def _largest(x: np.ndarray) -> int:
    return max(-int(x.min(initial=0)), int(x.max(initial=0)))


@dataclass
class Moments:
    """What the fit list sums to, exactly: rows, entries of a row, sums of each dimension, sum of all squares."""

    n: int
    d: int
    sums: list[int]
    squares: int

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])  # of Python's integers: rounded once

    @property
    def scatter(self) -> int:
        """n times the trace of the centred sum of squares, exactly."""
        return self.n * self.squares - sum(s * s for s in self.sums)


def moments(fit: DataFrame) -> Moments:
    """Sums over (v array<long>) rows. Each task sends one row for each dimension it has seen; Spark adds them up."""
    tune(fit.sparkSession)
    n, d = fit.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    d = d or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, squares = [0] * d, 0
        for batch in batches:
            for _, x in _blocks(batch.column(0), d):
                most = _largest(x)
                wide = _exact(x, most * most * max(1, x.size))
                sums = [a + int(b) for a, b in zip(sums, wide.sum(0), strict=True)]
                squares += int((wide * wide).sum())
        told = [*sums, squares]
        # A sum may pass 64 bits: it goes as three digits to the base 2^40 (the last with the sign), which add up digit by digit.
        digits = [[s & (1 << 40) - 1 for s in told], [(s >> 40) & (1 << 40) - 1 for s in told], [s >> 80 for s in told]]
        yield pa.RecordBatch.from_arrays([pa.array(range(d + 1), pa.int32()), *[pa.array(x, pa.int64()) for x in digits]], names=["at", "a", "b", "c"])

    rows = fit.select("v").mapInArrow(run, "at int, a long, b long, c long").groupBy("at").agg(*[F.sum(x).alias(x) for x in "abc"]).collect()  # a row for each dimension
    whole = {r["at"]: r["a"] + (r["b"] << 40) + (r["c"] << 80) for r in rows}
    return Moments(n, d, [whole.get(i, 0) for i in range(d)], whole.get(d, 0))


def products(blocks: DataFrame, mean: np.ndarray) -> Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """A function of (earlier d x j, v): with u = Xv and U = X earlier over the centred rows X, it gives Xᵀu, and Uᵀu with uᵀu last.

    Each call is one job: a task makes the entries of u for its rows (Xv), adds up their part of Xᵀu, and sends d + j + 1
    numbers. u itself is never gathered; a row's entries of all u's follow from the row.
    """
    d = len(mean)

    def both(earlier: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        left = np.column_stack([earlier, v])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            back, dots = np.zeros(d), np.zeros(left.shape[1])
            for x in _read(batches, d):
                centred = x - mean
                made = centred @ left
                back += centred.T @ made[:, -1]
                dots += made.T @ made[:, -1]
            sent = np.concatenate([back, dots])
            yield pa.RecordBatch.from_arrays([pa.array(range(len(sent)), pa.int32()), pa.array(sent)], names=["at", "part"])

        rows = blocks.mapInArrow(run, "at int, part double").groupBy("at").agg(F.sum("part").alias("part")).collect()  # d + j + 1 rows
        out = np.zeros(d + left.shape[1])
        out[[r["at"] for r in rows]] = [r["part"] for r in rows]
        return out[:d], out[d:]

    return both


def _away(v: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    """``v`` without its part in the span of the orthonormal ``basis``; done twice, which is enough."""
    if basis:
        q = np.column_stack(basis)
        for _ in range(2):
            v = v - q @ (q.T @ v)
    return v


def _run(multiply, d: int, scale: float, wanted: int, locked: list[np.ndarray], seed: int, tolerance: float) -> tuple[np.ndarray, np.ndarray, bool, float]:
    """One bidiagonalisation in the complement of the ``locked`` right vectors.

    Returns the singular values, the right vectors as columns, whether they are all there are, and the bound of the
    residual of the ``wanted`` largest. X V = U B with B upper bidiagonal; both V and U are kept orthogonal in full. Where
    a vector vanishes (the Krylov space is used up), a random one orthogonal to all before goes on, so that equal
    singular values are found as often as they occur.
    """
    rng = np.random.default_rng(seed)
    right: list[np.ndarray] = []  # v: unit vectors
    maker: list[np.ndarray] = []  # p: u = X p
    back: list[np.ndarray] = []  # Xᵀ u
    alphas, betas = [], []

    def fresh() -> np.ndarray:
        v = _away(rng.standard_normal(d), [*locked, *right])
        return v / np.linalg.norm(v)

    v, beta = fresh(), 0.0
    while True:
        raw = v - (beta * maker[-1] if maker else 0.0)
        xu, dots = multiply(np.column_stack(maker) if maker else np.zeros((d, 0)), raw)
        c, square = dots[:-1], dots[-1] - dots[:-1] @ dots[:-1]
        alpha = float(np.sqrt(max(square, 0.0)))
        right.append(v)
        if alpha > 1e-13 * scale:
            maker.append((raw - (np.column_stack(maker) @ c if maker else 0.0)) / alpha)
            back.append((xu - (np.column_stack(back) @ c if back else 0.0)) / alpha)
        else:
            alpha = 0.0
            maker.append(np.zeros(d))
            back.append(np.zeros(d))
        alphas.append(alpha)
        whole = len(right) + len(locked) == d
        v = _away(back[-1] - alpha * right[-1], [*locked, *right])
        beta = float(np.linalg.norm(v))
        q, sigma, z = np.linalg.svd(np.diag(alphas) + np.diag(betas, 1))
        left = beta * np.abs(q[-1, :wanted]).max() if not whole else 0.0
        if whole or (len(right) >= wanted and left <= tolerance * max(sigma[0], EPS * scale)):
            return sigma, np.column_stack(right) @ z.T, whole, float(left)
        if beta <= 1e-13 * scale:
            v, beta = fresh(), 0.0
        else:
            v = v / beta
        betas.append(beta)


def components(blocks: DataFrame, m: Moments, k: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of the covariance (divisor n) of the rows in the blocks, and their unit
    vectors as columns. Directions without variance are left out, so there may be fewer; of no rows there are none.

    A run that ends before it has used up the space may have seen one of several equal eigenvalues only; runs in the
    complement of what was found go on until none there is larger.
    """
    if not m.n or not m.d or m.scatter == 0:
        return np.zeros(0), np.zeros((m.d, 0))
    scale = float(np.sqrt(m.scatter / m.n))  # the Frobenius norm of X
    multiply = products(blocks, m.mean)
    k = min(k, m.d)
    sigma, right, whole, _ = _run(multiply, m.d, scale, k, [], seed, 4 * EPS)
    sigma, right = sigma[:k], right[:, :k]
    while not whole and m.d > k:
        locked = list(right.T)
        more, _, whole, left = _run(multiply, m.d, scale, 1, locked, seed + 1, 1e-3)
        if more[0] + left <= sigma[-1]:
            break
        more, vectors, whole, _ = _run(multiply, m.d, scale, min(k, m.d - k), locked, seed + 1, 4 * EPS)
        order = np.argsort(-np.concatenate([sigma, more]), kind="stable")[:k]
        if order.max() < k:
            break
        sigma, right = np.concatenate([sigma, more])[order], np.column_stack([right, vectors])[:, order]
        seed += 1
    solid = sigma > m.d * EPS * scale
    return sigma[solid] ** 2 / m.n, right[:, solid]


def whiten(vectors: DataFrame, k: int = 4) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each row of (vec_id, v array<long>) and
    each of the ``k`` largest components of the distinct vectors (the fit list), numbered from 1.

    ``deviation`` is the sum of (n*x - S)^2, in exact integers, null where it passes a long. A shorter vector counts 0 for
    the entries it lacks. A direction without variance cannot be whitened: the table has no rows for it, and none at all
    where all vectors are equal or there are none. Repeated rows and rows with a null id have rows each.
    """
    tune(vectors.sparkSession)
    fit = save(vectors.select("v").distinct(), "fit")
    m = moments(fit)
    blocks = dense(fit, m.d)
    drop(fit)
    values, right = components(blocks, m, k)
    mean, sums, n, d = m.mean if m.n else np.zeros(0), np.array(m.sums, dtype=object), m.n, m.d
    onto = right / np.sqrt(values)
    explained = values / (m.scatter / m.n**2) if len(values) else values
    error = _identity_error(blocks, mean, onto) if len(values) else 0.0
    drop(blocks)
    found = len(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = max(map(abs, sums), default=0)
        for batch in batches:
            if not found:
                break
            for start, x in _blocks(batch.column(1), d):
                bound = n * _largest(x) + most
                away = n * _exact(x, bound * bound * d) - (sums if bound * bound * d >= 1 << 62 else sums.astype(np.int64))
                far = [int(s) if s < 1 << 63 else None for s in (away * away).sum(1)]
                made = (x - mean) @ onto
                count = len(x)
                ids = batch.column(0).slice(start, count).take(pa.array(np.repeat(np.arange(count), found)))
                columns = [ids, pa.array(np.tile(np.arange(1, found + 1), count), pa.int32()), pa.array(np.full(count * found, n)), pa.array(far, pa.int64()).take(pa.array(np.repeat(np.arange(count), found))), pa.array(made.ravel()), pa.array(np.tile(explained, count)), pa.array(np.full(count * found, error))]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.select("vec_id", "v").mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def _identity_error(blocks: DataFrame, mean: np.ndarray, onto: np.ndarray) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity, from the rows themselves."""
    d, k = onto.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + k + k * k)
        for x in _read(batches, d):
            y = (x - mean) @ onto
            total += np.concatenate([[len(y)], y.sum(0), (y.T @ y).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], names=["at", "part"])

    rows = blocks.mapInArrow(run, "at int, part double").groupBy("at").agg(F.sum("part").alias("part")).collect()
    total = np.array([r["part"] for r in sorted(rows, key=lambda r: r["at"])])
    first = total[1 : k + 1] / total[0]
    return float(np.abs(total[k + 1 :].reshape(k, k) / total[0] - np.outer(first, first) - np.eye(k)).max())
