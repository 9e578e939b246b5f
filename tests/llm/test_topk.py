"""Exact top-k: DuckDB oracle, brute force on odd vectors."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import topk
from tessera.llm.queries import TOPK_SQL, op5_topk


@pytest.mark.parametrize("d", ["sf0.001", "sf0.1"])
def test_against_duckdb(spark, d):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/{d}/embeddings.parquet'")
    got = op5_topk(spark, f"/root/testdata/{d}")
    assert dict(got.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"}
    assert sorted(tuple(r) for r in got.collect()) == sorted(con.execute(TOPK_SQL).fetchall())


def brute(rows, k):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in ok:
        if q % 50:
            continue
        s = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ok if i != q)[:k]
        out += [(q, n + 1, i, -x) for n, (x, i) in enumerate(s)]
    return sorted(out)


def search(spark, rows, k=5):
    v = topk.usable(spark.createDataFrame([(i, e, 1) for i, e in rows], "vec_id long, embedding array<float>, score int").repartition(4))
    return sorted(tuple(r) for r in topk.search(v, v.where(F.col("vec_id") % 50 == 0), k).collect())


def test_ties_nulls_and_repeated_rows(spark):
    r = random.Random(3)
    rows = [(i, [r.randrange(-3, 4) / 2 for _ in range(6)]) for i in range(300)]
    rows += [(300, [math.nan] + [1.0] * 5), (350, None), (400, [None] + [1.0] * 5), (301, [math.inf] * 6), (None, [1.0] * 6), (450, [0.0] * 6), (302, rows[0][1]), (303, rows[0][1]), (304, [])]
    assert search(spark, rows) == brute(rows, 5)
    few = [(0, [1.0]), (1, [2.0]), (2, [2.0])]
    assert search(spark, few) == [(0, 1, 1, 131072), (0, 2, 2, 131072)]
    assert search(spark, []) == []
    twice = [(0, [1.0]), (7, [1.0]), (7, [1.0])]
    assert search(spark, twice) == [(0, 1, 7, 65536), (0, 2, 7, 65536)]


def test_blocks_and_segments_stop_on_proof(spark, monkeypatch):
    """Small blocks give the same answer."""
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    r = random.Random(5)
    rows = [(i, [r.gauss(0, 1) for _ in range(16)]) for i in range(800)]
    rows = [(i, spark_float(v)) for i, v in rows]
    assert search(spark, rows) == brute(rows, 5)


def test_segments_are_skipped_and_few_pairs_are_rescored(spark):
    """Counters over the largest table, as one task with blocks in turn: proof stops queries early."""
    rows = topk.usable(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")).orderBy("vec_id").toPandas()
    x, ids = np.stack(rows["q"]), rows["vec_id"].to_numpy()
    q, q_ids = x[ids % 50 == 0], ids[ids % 50 == 0]
    block = topk.Block(x)
    assert len(block.segments) > 5 and all(len(set(v)) >= 1 for lists, _ in block.segments for _, _, v in lists)
    impacts = [np.abs(np.concatenate([v for _, _, v in lists])) for lists, _ in block.segments]
    assert all(a.min() >= b.max() for a, b in zip(impacts, impacts[1:], strict=False))
    qi, ri, scores, done = topk.search_block(block, ids, q, q_ids, 5, np.full(len(q), -np.inf))
    assert len(qi) < 0.01 * len(q) * len(x) and done < 0.97 * np.count_nonzero(x) * len(q)
    full = q @ x.T
    full[q_ids[:, None] == ids[None, :]] = -np.inf
    for i in range(len(q)):
        assert set(np.argsort(-full[i], kind="stable")[:5]) <= set(ri[qi == i])
    assert (scores == full[qi, ri]).all()
    # with the floor that earlier blocks give, queries stop sooner
    floor = np.sort(full, axis=1)[:, -5]
    again = topk.search_block(block, ids, q, q_ids, 5, floor)
    assert again[3] < done and len(again[0]) < 0.01 * len(q) * len(x)


def test_large_and_sparse_vectors(spark):
    r = random.Random(8)
    rows = [(i, [0.0 if r.random() < 0.8 else r.randrange(-(10**7), 10**7) / 4 for _ in range(20)]) for i in range(400)]
    rows = [(i, spark_float(v)) for i, v in rows]
    assert search(spark, rows) == brute(rows, 5)


def test_clashing_columns(spark):
    v = spark.createDataFrame([(i, [float(i)], 1, 2, "q", 3) for i in range(4)], "vec_id long, embedding array<float>, query_id int, rank int, q string, score int")
    u = topk.usable(v)
    assert sorted(tuple(r) for r in topk.search(u, u.where("vec_id = 0"), 2).collect()) == [(0, 1, 1, 0), (0, 2, 2, 0)]


def spark_float(v):
    return [float(x) for x in np.array(v, dtype=np.float32)]
