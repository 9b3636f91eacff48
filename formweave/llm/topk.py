"""Exact top-k inner products over norm-sorted vectors, with SVD-rotated partial sums.

Vectors are integers, floor(256 * x). Candidates are range-partitioned and sorted by descending length. Queries are
worked on in blocks of ``BLOCK`` (a block is broadcast, and so bounded); every block passes over all candidates:

* the ``HEAD`` longest candidates give each query a first threshold, its k-th best score among them;
* a tile of candidates is skipped for the queries whose length times the tile's greatest length is below their
  threshold, and a task ends once that holds for all queries (lengths only fall from there);
* in the basis of the singular vectors of a bounded sample (``SAMPLE`` rows; any orthogonal basis is right, this one
  prunes well), the first ``PART`` coordinates give a partial sum, and the lengths of the rest bound what is missing
  (Cauchy-Schwarz); pairs whose bound is below the threshold go;
* the others are scored in whole numbers, and thresholds rise.

Each task gives a query's best k, and a window takes the best k of those. Nothing is approximate.

Defined results: vectors that are null or hold null or non-finite components, and rows without ``vec_id``, take no
part; shorter vectors count as padded with zeros; rows that repeat a ``vec_id`` are rows of their own: a query's own row
alone is no partner of it, and a repeated query is asked for each of its rows; an empty table gives an empty table;
further columns are not read. Scores must fit 63 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formweave.llm.shared import checkpointed

SCALE = 256
BLOCK, HEAD, SAMPLE, PART, TILE = 8192, 2048, 2048, 16, 2048


def whole_vectors(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``row, vec_id, v, norm``: usable rows as whole numbers, with a number of their own and their squared length."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = rows.where(F.col(vector).isNotNull() & F.col(vec_id).isNotNull() & ~odd)
    v = F.transform(vector, lambda x: F.floor(SCALE * x.cast("double")).cast("long"))
    out = usable.select(F.monotonically_increasing_id().alias("row"), F.col(vec_id).cast("long").alias("vec_id"), v.alias("v"))
    return out.withColumn("norm", F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def _matrix(vectors: list, size: int) -> np.ndarray:
    out = np.zeros((len(vectors), size), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def rotation(sample: np.ndarray) -> np.ndarray:
    """An orthogonal basis whose first vectors carry most of the sample's length."""
    values, vectors = np.linalg.eigh(sample.T.astype(np.float64) @ sample.astype(np.float64))
    return vectors[:, np.argsort(-values)]


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products; by floating point where every partial sum is exact there."""
    largest = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64) if largest < 2**53 else a @ b.T


class Block:
    """A block of queries, their thresholds and their best partners so far."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, q: np.ndarray, basis: np.ndarray, k: int):
        self.rows, self.ids, self.q, self.basis, self.k = rows, ids, q, basis, k
        turned = q @ basis
        self.length = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
        self.first = turned[:, :PART]
        self.rest = np.sqrt((turned[:, PART:] ** 2).sum(axis=1))
        self.least = np.full(len(ids), -np.inf)
        self.best: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _slack(self, other: float) -> np.ndarray:
        return 1e-9 * self.length * other + 1e-6

    def wanted(self, longest: float) -> np.ndarray:
        return np.flatnonzero(self.length * longest + self._slack(longest) >= self.least)

    def meet(self, rows: np.ndarray, ids: np.ndarray, v: np.ndarray) -> None:
        length = np.sqrt((v.astype(np.float64) ** 2).sum(axis=1))
        active = self.wanted(float(length.max(initial=0)))
        if not len(active):
            return
        turned = v @ self.basis
        bound = self.first[active] @ turned[:, :PART].T
        bound += np.outer(self.rest[active], np.sqrt((turned[:, PART:] ** 2).sum(axis=1)))
        may = (bound + self._slack(float(length.max()))[active, None] >= self.least[active, None]) & (self.rows[active, None] != rows[None, :])
        if may.mean() > 0.05:
            full = _products(self.q[active], v)
            score_of = lambda i, at: full[i, at]
        else:
            score_of = lambda i, at: _products(self.q[active[i]][None, :], v[at])[0]
        for i in np.flatnonzero(may.any(axis=1)).tolist():
            at, own = np.flatnonzero(may[i]), int(active[i])
            score, who = score_of(i, at), ids[at]
            if len(score) > 4 * self.k:
                near = score >= np.partition(score, -self.k)[-self.k]
                score, who = score[near], who[near]
            if own in self.best:
                score, who = np.concatenate([self.best[own][0], score]), np.concatenate([self.best[own][1], who])
            order = np.lexsort((who, -score))[: self.k]
            self.best[own] = score[order], who[order]
            if len(order) == self.k:
                self.least[own] = max(self.least[own], float(score[order[-1]]))

    def found(self) -> pa.RecordBatch:
        n = [len(s) for s, _ in self.best.values()]
        joined = [np.concatenate(x) if n else np.zeros(0, np.int64) for x in ([s for s, _ in self.best.values()], [w for _, w in self.best.values()])]
        own = list(self.best)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.rows[own], n)), pa.array(np.repeat(self.ids[own], n)), pa.array(joined[1]), pa.array(joined[0])], names=["query_row", "query_id", "vec_id", "score"])


def _pass(candidates: DataFrame, block: Block, size: int) -> DataFrame:
    shared = candidates.sparkSession.sparkContext.broadcast((block.rows, block.ids, block.q, block.basis, block.k, block.least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, ids, q, basis, k, least = shared.value
        own = Block(rows, ids, q, basis, k)
        own.least = least.copy()
        for batch in batches:  # sorted by descending length
            for at in range(0, batch.num_rows, TILE):
                tile = batch.slice(at, TILE)
                own.meet(tile.column(0).to_numpy(), tile.column(1).to_numpy(), _matrix(tile.column(2).to_pylist(), size))
        yield own.found()

    return candidates.select("row", "vec_id", "v").mapInArrow(run, "query_row long, query_id long, vec_id long, score long")


def top_k(rows: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` best partners by inner product, ties to smaller ids.

    ``is_query`` is a condition on ``vec_id``.
    """
    whole = whole_vectors(rows, vec_id, vector)
    candidates = checkpointed(whole.repartitionByRange(F.desc("norm"), "vec_id").sortWithinPartitions(F.desc("norm"), "vec_id"))
    size = max(candidates.agg(F.max(F.size("v"))).first()[0] or 0, 1)
    head = candidates.orderBy(F.desc("norm"), "vec_id").limit(HEAD).collect()
    sample = candidates.orderBy(F.xxhash64("vec_id", "v")).limit(SAMPLE).select("v").collect()
    basis = rotation(_matrix([r.v for r in sample], size))
    queries = checkpointed(candidates.where(is_query).select("row", "vec_id", "v"))
    n_blocks = max(1, -(-queries.count() // BLOCK))
    found = None
    for b in range(n_blocks):
        own = queries.where(F.pmod(F.xxhash64("row"), F.lit(n_blocks)) == b).collect()
        block = Block(*(np.array([r[c] for r in own], np.int64) for c in ("row", "vec_id")), _matrix([r.v for r in own], size), basis, k)
        if own and head:
            block.meet(*(np.array([r[c] for r in head], np.int64) for c in ("row", "vec_id")), _matrix([r.v for r in head], size))
        part = _pass(candidates, block, size)
        found = part if found is None else checkpointed(_best(found.unionByName(part), k).drop("rank"))
    return _best(found, k).select("query_id", "rank", "vec_id", "score")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.select("query_row", "query_id", "vec_id", "score").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
