"""Exact top-k search by inner product over an impact-ordered index, score at a time.

Components are quantised to integers.  Each block of candidate vectors is indexed by postings: for every
dimension the rows with a component other than zero there, with its value as impact, in segments of descending
quantised impact (size in steps of the block's largest).  Segments are processed for a block of queries together, all
dimensions of a segment, high impacts first; what a candidate has left in later segments is bounded by
Cauchy-Schwarz, which gives it a lower and an upper score.  A candidate leaves only by proof: its upper score
is below the k-th lower score, or below the k-th score of blocks before.  A query stops, and its later segments are not
processed, once few candidates are possible for it; these are rescored exactly.

Queries are taken in blocks of ``QUERY_BLOCK``, each broadcast to all candidate partitions in a job of its own, so what
is broadcast has a fixed bound and the plan doesn't grow with the queries.

Defined results: vectors that are null or hold null or non-finite components take no part; shorter
vectors count as padded with zeros; rows with the query's own id are not its candidates; equal scores go to
the smaller id, repeated rows of one id are ranked each; scores beyond 64 bits are held at their limits.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import arrow_schema, small_batches, staged

QUERY_BLOCK = 32_768
CANDIDATE_BLOCK = 2048
#: Queries whose scores against one candidate block are held at once.
SCORED_AT_ONCE = 256
#: Quantised impacts are sizes in so many steps; segments end at these shares of all postings.
STEPS = 256
SHARES = (0.3, 0.5, 0.65, 0.75, 0.82, 0.88, 0.93, 0.97, 1.0)
#: A query stops once no more than this share of candidates is possible for it.
ENOUGH = 0.005
LIMIT = 2**63 - 1


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256) -> DataFrame:
    """``vec_id`` and ``q array<double>`` of integers for every vector that takes part."""
    x = F.col(vec_col)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return vectors.where(x.isNotNull() & F.col(id_col).isNotNull() & ~bad).select(
        F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda v: _floor(v.cast("double") * scale)).alias("q"))


def _floor(v: Column) -> Column:
    """floor() as a double: beyond 2^53 every double is an integer already."""
    return F.when(F.abs(v) < F.lit(2.0**53), F.floor(v).cast("double")).otherwise(v)


def padded(rows: list, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        n = min(len(r), width)
        out[i, :n] = r[:n]
    return out


class Block:
    """The impact-ordered index of one block of candidates.

    ``segments``: for each, its posting lists as (dimension, rows, impacts), and what norm the rows have left after it.
    """

    def __init__(self, x: np.ndarray):
        self.x = x
        #: Scores up to which single precision is exact.
        self.largest = np.abs(x).max(initial=0.0)
        rows, dims = np.nonzero(x)
        value = x[rows, dims]
        impact = np.minimum(np.floor(np.abs(value) * (STEPS / max(self.largest, 1.0))), STEPS - 1).astype(np.int64)
        order = np.lexsort((rows, dims, -impact))
        rows, dims, value, impact = rows[order], dims[order], value[order], impact[order]
        ends = np.searchsorted(-impact, -np.arange(STEPS - 1, -1, -1), side="right")  # after each impact
        self.segments, start = [], 0
        left = (x**2).sum(axis=1)
        for share in SHARES:
            end = int(ends[np.searchsorted(ends, share * len(rows))]) if len(rows) else 0
            if end <= start:
                continue
            r, d, v = rows[start:end], dims[start:end], value[start:end]
            by = np.argsort(d, kind="stable")
            r, d, v = r[by], d[by], v[by]
            cuts = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1], [True]]))
            left = np.maximum(left - np.bincount(r, v**2, len(x)), 0.0)
            rest = np.sqrt(left) * (1 + 1e-9) if end < len(rows) else np.zeros(len(x))
            self.segments.append(([(int(d[i]), r[i:j], v[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)], rest))
            start = end


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of row pairs as 64-bit integers."""
    if len(q) == 0:
        return np.zeros(0, dtype=np.int64)
    if np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * q.shape[1] < 2**53:
        return (q * x).sum(axis=1).astype(np.int64)
    return np.array([max(-LIMIT - 1, min(LIMIT, sum(int(a) * int(b) for a, b in zip(u, v, strict=True)))) for u, v in zip(q, x, strict=True)], dtype=np.int64)


def search_block(block: Block, ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Possible members as (query, row, exact score), and the postings processed times queries; ``floor``: scores that members must reach."""
    n = len(ids)
    norm = np.sqrt((q**2).sum(axis=1)) * (1 + 1e-9)
    kind = np.float32 if block.largest * np.abs(q).max(initial=0.0) * q.shape[1] < 2**24 else np.float64
    eps = 0.0 if kind is np.float32 else 1e-12 * block.largest * np.abs(q).max(initial=0.0) * q.shape[1]
    live, acc, by_dim = np.arange(len(q)), np.zeros((n, len(q)), dtype=kind), q.T.astype(kind)
    done, found = 0, []
    for lists, rest in block.segments or [([], np.zeros(n))]:
        for d, rows, impacts in lists:
            acc[rows] += impacts.astype(kind)[:, None] * by_dim[d][None, :]
            done += len(rows) * len(live)
        slack = rest[:, None] * norm[live][None, :] + (1 + eps if rest.any() or eps else 0)
        own = ids[:, None] == q_ids[live][None, :]
        need = floor[live]
        if n - 1 >= k and not np.isfinite(need).all():
            low = np.where(own, -np.inf, acc - slack)
            need = np.maximum(need, np.partition(low, n - k, axis=0)[n - k])
        possible = (acc + slack >= need[None, :]) & ~own
        over = possible.mean(axis=0) <= ENOUGH if rest.any() else np.ones(len(live), dtype=bool)
        if over.any():
            ri, qi = np.nonzero(possible[:, over])
            found.append((live[over][qi], ri))
            live, acc, by_dim = live[~over], acc[:, ~over], by_dim[:, ~over]
        if len(live) == 0:
            break
    qi, ri = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, dtype=np.int64),) * 2
    scores = np.concatenate([exact(q[qi[i : i + 65536]], block.x[ri[i : i + 65536]]) for i in range(0, len(qi), 65536)] or [np.zeros(0, dtype=np.int64)])
    return qi, ri, scores, done


def search(candidates: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` best candidates of each query; inputs as ``usable`` gives them."""
    spark = candidates.sparkSession
    small_batches(spark)
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    queries = staged(queries, "queries") if blocks > 1 else queries
    ddl = "query_id long, vec_id long, score long"
    schema = arrow_schema(ddl)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    parts = []
    for b in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).toPandas()
        if not len(rows):
            continue
        held = spark.sparkContext.broadcast((rows["vec_id"].to_numpy(dtype=np.int64), [np.asarray(r) for r in rows["q"]]))

        def run(batches, held=held):
            q_ids, raw = held.value
            best: list[list[tuple[int, int]]] = [[] for _ in raw]
            ids: list[int] = []
            vectors: list = []

            def flush() -> None:
                width = max([len(r) for r in raw] + [len(v) for v in vectors])
                q, x, own = padded(raw, width), padded(vectors, width), np.array(ids, dtype=np.int64)
                block = Block(x)
                for i in range(0, len(q), SCORED_AT_ONCE):
                    floor = np.array([float(-b[-1][0]) if len(b) == k else -np.inf for b in best[i : i + SCORED_AT_ONCE]])
                    qi, ri, s, _ = search_block(block, own, q[i : i + SCORED_AT_ONCE], q_ids[i : i + SCORED_AT_ONCE], k, floor)
                    order = np.lexsort((own[ri], -s, qi))
                    qi, ri, s = qi[order], ri[order], s[order]
                    starts = np.searchsorted(qi, np.arange(min(SCORED_AT_ONCE, len(q) - i) + 1))
                    for j in np.flatnonzero(np.diff(starts)):
                        a, z = starts[j], min(starts[j + 1], starts[j] + k)
                        best[i + j] = sorted(best[i + j] + [(-int(s[m]), int(own[ri[m]])) for m in range(a, z)])[:k]
                ids.clear()
                vectors.clear()

            for b in batches:
                ids += b.column(0).to_pylist()
                vectors += [np.asarray(v.values) for v in b.column(1)]
                if len(ids) >= CANDIDATE_BLOCK:
                    flush()
            if ids:
                flush()
            rows = [(int(q_ids[i]), v, -s) for i, b in enumerate(best) for s, v in b]
            for i in range(0, len(rows), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[i : i + 50_000], strict=True)], schema=schema)

        best = candidates.select("vec_id", "q").mapInArrow(run, ddl).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        best = best.select("query_id", "rank", "vec_id", "score")
        parts.append(staged(best, "top") if blocks > 1 else best)
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
