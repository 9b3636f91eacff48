import numpy as np
import pytest
from pyspark.sql import functions as F

from formweave.llm import topk

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, k):
    usable = [(i, np.floor(256 * np.array(v, np.float32).astype(np.float64)).astype(np.int64)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for at, (q, a) in enumerate(usable):
        if q % 5 == 0:
            scores = sorted((-int(a @ b), i) for j, (i, b) in enumerate(usable) if j != at)[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scores, 1)]
    return sorted(out)


def rows(n, size, seed, scale=1.0):
    rng = np.random.default_rng(seed)
    out = [(i, (rng.normal(size=size) * rng.choice([0.2, 1, 3]) * scale).astype(np.float32).tolist()) for i in range(n)]
    for i in range(0, n, 7):
        out[i] = (i, out[0][1])
    return out


@pytest.mark.parametrize(("n", "size", "k"), [(400, 24, 5), (60, 8, 3), (4, 20, 5), (1, 3, 5)])
def test_against_brute_force(spark, n, size, k):
    data = rows(n, size, n)
    found = topk.top_k(spark.createDataFrame(data, SCHEMA).repartition(4), F.col("vec_id") % 5 == 0, k).collect()
    assert sorted(map(tuple, found)) == brute(data, k)


def test_blocks_and_tiles(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 17)
    monkeypatch.setattr(topk, "TILE", 13)
    monkeypatch.setattr(topk, "HEAD", 6)
    data = rows(300, 20, 8)
    found = topk.top_k(spark.createDataFrame(data, SCHEMA).repartition(3), F.col("vec_id") % 5 == 0).collect()
    assert sorted(map(tuple, found)) == brute(data, 5)


def test_large_numbers_stay_exact(spark):
    data = rows(40, 6, 2, 1e5)
    found = topk.top_k(spark.createDataFrame(data, SCHEMA), F.col("vec_id") % 5 == 0).collect()
    assert sorted(map(tuple, found)) == brute(data, 5)


def test_odd_tables(spark):
    assert topk.top_k(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 5 == 0).collect() == []
    data = [(0, [1.0, 2.0]), (5, None), (10, [None, 1.0]), (15, [float("nan"), 1.0]), (20, [float("inf"), 1.0]), (3, [1.0, 2.0]), (4, [0.0, 0.0]), (None, [1.0, 1.0])]
    found = topk.top_k(spark.createDataFrame([(*r, 1) for r in data], SCHEMA + ", score long"), F.col("vec_id") % 5 == 0).collect()
    assert sorted(map(tuple, found)) == brute(data, 5)
    twice = [(0, [1.0]), (0, [1.0]), (0, [3.0, 1.0]), (2, [2.0, 5.0])]
    found = topk.top_k(spark.createDataFrame(twice, SCHEMA), F.col("vec_id") % 5 == 0).collect()
    pad = [(i, [*v, 0.0][:2]) for i, v in twice]
    assert sorted(map(tuple, found)) == brute(pad, 5) and len(found) == 9
