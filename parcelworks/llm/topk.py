"""Exact top-k search by exhaustive term-at-a-time accumulation."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelworks.llm.common import flat, save

#: Rows of a block of candidates and of a block of queries: what one task holds, whatever the table's size.
CANDIDATES, QUERIES = 8192, 4096
#: Blocks of queries whose searches are one job.
TOGETHER = 32


def quantised(vectors: DataFrame, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v array<long>): floor(scale * x) of each component, x as double.

    Rows whose id or vector is null, or whose vector holds a null, NaN or infinite component, are left out. Rows that
    repeat an id all stay.
    """
    x = F.col(vector_col)
    sound = F.col(id_col).isNotNull() & x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return vectors.where(sound).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(F.lit(scale) * c.cast("double"))).alias("v"))


def top_k(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """The ``k`` candidates of greatest inner product for each query, ties to the smaller id, never one of the query's own id.

    Both tables are (vec_id long, v array<long>). Returns query_id, rank (from 1), vec_id, score. Rows that repeat an id
    are candidates, and queries with ranks of their own, each. A component that a shorter vector lacks counts as 0; an
    empty vector scores 0 with all; empty tables give no rows; with fewer than ``k`` candidates all are returned. Scores
    beyond a long are held at its ends.

    Queries are dealt into blocks of bounded size, and each block goes to all tasks; the candidates stay where they are
    and meet it in blocks of bounded size too. There each component (term) has a postings list of (row, weight); a query's
    terms are taken one at a time, each adding its weighted postings to the query's dense array of scores. Partition
    selection then keeps the task's best ``k``, and a window merges the tasks.
    """
    blocks = max(1, math.ceil(queries.count() / QUERIES))
    dealt = queries.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int"))
    found = None
    for start in range(0, blocks, TOGETHER):
        part = None
        for block in range(start, min(start + TOGETHER, blocks)):
            ids, rows = _dense(dealt.where(F.col("block") == block).select("vec_id", "v").toArrow())  # a block of bounded size
            made = candidates.select("vec_id", "v").mapInArrow(_search(ids, rows, k, block << 32), "query long, query_id long, vec_id long, score long")
            part = made if part is None else part.union(made)
        if blocks > TOGETHER:
            part = save(part, "found")
        found = part if found is None else found.union(part)
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _dense(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids in ascending order and their vectors as rows, padded with zeros."""
    ids = table.column("vec_id").to_numpy()
    values, offsets = flat(table.column("v"))
    lengths = np.diff(offsets)
    out = np.zeros((len(ids), int(lengths.max(initial=0))), np.int64)
    out[np.repeat(np.arange(len(ids)), lengths), np.arange(len(values)) - np.repeat(offsets[:-1], lengths)] = values
    order = np.argsort(ids, kind="stable")
    return ids[order], out[order]


def _search(q_ids: np.ndarray, q: np.ndarray, k: int, base: int):
    """The best ``k`` of a task's candidates for each query of one block (its number from ``base`` on)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64),) * 2 for _ in q_ids]
        held: list[pa.RecordBatch] = []

        def search() -> None:
            ids, rows = _dense(pa.Table.from_batches(held))
            for i, (more, scores) in enumerate(_block(q_ids, q, ids, rows, k)):
                ids_, scores_ = np.append(best[i][0], more), np.append(best[i][1], scores)
                order = np.lexsort((ids_, -scores_.astype(object) if scores_.size and scores_.min() == -(2**63) else -scores_))[:k]
                best[i] = ids_[order], scores_[order]
            held.clear()

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= CANDIDATES:
                search()
        if held:
            search()
        sizes = [len(ids) for ids, _ in best]
        if sum(sizes):
            number = np.arange(len(q_ids))
            yield pa.RecordBatch.from_arrays([pa.array(base + np.repeat(number, sizes)), pa.array(np.repeat(q_ids, sizes)), *(pa.array(np.concatenate([b[i] for b in best])) for i in (0, 1))], names=["query", "query_id", "vec_id", "score"])

    return run


def _block(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and scores of the best ``k`` rows for each query."""
    terms = min(q.shape[1], rows.shape[1])
    if not len(ids) or not len(q_ids):
        return
    bound = sum(int(abs(int(a)) * abs(int(b))) for a, b in zip(_peak(q[:, :terms]), _peak(rows[:, :terms]), strict=True))
    kind = np.int32 if bound < 2**31 else np.int64 if bound < 2**63 else object
    postings = []
    for t in range(terms):
        weights = rows[:, t].astype(kind)
        where = np.flatnonzero(weights)
        postings.append((None, weights) if 4 * len(where) >= 3 * len(ids) else (where, weights[where]))  # a nearly full list is kept without row numbers
    scores, add = np.zeros(len(ids), kind), np.empty(len(ids), kind)
    for qid, query in zip(q_ids, q[:, :terms].astype(kind), strict=True):
        scores.fill(0)
        for t in np.flatnonzero(query):
            where, weights = postings[t]
            if where is None:
                np.multiply(weights, query[t], out=add)
                scores += add
            else:
                scores[where] += weights * query[t]
        yield _best(ids, scores, qid, k)


def _peak(columns: np.ndarray) -> np.ndarray:
    """The greatest magnitude in each column, without the overflow of abs(least long)."""
    return np.maximum(columns.max(axis=0).astype(object), -columns.min(axis=0).astype(object))


def _best(ids: np.ndarray, scores: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k greatest scores of rows other than ``own``; ids ascend, so the first of equal scores has the smaller id."""
    at, end = np.searchsorted(ids, own), np.searchsorted(ids, own, side="right")
    if at < end:
        ids, scores = np.delete(ids, slice(at, end)), np.delete(scores, slice(at, end))
    if len(ids) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        above = np.flatnonzero(scores > least)
        chosen = np.concatenate([above, np.flatnonzero(scores == least)[: k - len(above)]])
    else:
        chosen = np.arange(len(ids))
    if scores.dtype == object:
        scores = np.clip(scores, -(2**63), 2**63 - 1)
    return ids[chosen], scores[chosen].astype(np.int64)
