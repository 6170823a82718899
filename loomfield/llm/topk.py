"""Exact top-k inner products: norm-sorted candidates, SVD-rotated partial sums.

Vectors become integers floor(scale * x). A rotation to the leading singular vectors
of all rows moves most of the length into the first coordinates. Each task
walks its candidates by descending length and stops for a query once
|q| * |c| cannot reach the query's k-th score; before the full product it adds
the first rotated coordinates and bounds the rest by Cauchy-Schwarz with the
residual lengths. The k-th score starts from the longest vectors of the table,
so every task prunes from its first row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomfield.llm.vectors import best, dense, dimension, exact_products, floors, query_blocks, ranked, search_blocks, valid_vectors

#: Longest vectors that give each query its first k-th score.
SEEDS = 1024
#: Rotated coordinates summed before the residual bound.
LEADING = 16
#: Candidates bounded at a time.
STEP = 512
#: Up to so many dimensions the singular vectors come from the whole Gram matrix, beyond from its product with random columns.
GRAM_MOST, RANDOM_COLUMNS = 512, 64
#: Share of |q| * |c| by which bounds in floating point are raised.
SLACK = 1e-6

SCHEMA = "query_id long, vec_id long, score long"


#: Products of vectors whose squares add up to less fit a long; those of longer ones are made one by one.
NARROW = 2.0**62


def _integers(x: np.ndarray, scale: float, narrow: bool = False) -> np.ndarray:
    """floor(scale * x), as longs if all are known to be ``narrow``."""
    return floors(x, scale).astype(np.int64) if narrow else floors(x, scale)


def _rotation(vectors: DataFrame, dim: int, scale: float) -> np.ndarray:
    """(dim, LEADING or fewer) leading right singular vectors of the whole table, from products summed over all tasks."""
    if dim <= GRAM_MOST:
        sketch = np.eye(dim)
    else:
        sketch = np.linalg.qr(np.random.default_rng(3).standard_normal((dim, RANDOM_COLUMNS)))[0]

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(sketch.shape)
        for b in batches:
            x = _integers(dense(b.column(0), b.column(1), dim)[1], scale).astype(np.float64)
            total += x.T @ (x @ sketch)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["cell", "value"])

    cells = vectors.mapInArrow(product, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
    got = np.zeros(sketch.size)
    got[cells["cell"].to_numpy()] = cells["value"].to_numpy()
    return np.linalg.svd(got.reshape(sketch.shape), full_matrices=False)[0][:, :LEADING]


def _split(x: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Leading rotated coordinates, length, and length of the rest, of integer rows."""
    wide = x.astype(np.float64)
    lead = wide @ v
    squares = (wide**2).sum(1)
    return lead, np.sqrt(squares), np.sqrt(np.maximum(0, squares - (lead**2).sum(1)))


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row-wise exact integer inner products."""
    return np.einsum("ij,ij->i", q, x) if q.dtype == np.int64 else exact_products(q, x)


def _searcher(block, dim: int, k: int, scale: float, narrow: bool):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, q, q_lead, q_len, q_rest, start, v = block.value
        kth = start.copy()
        held = [np.zeros(0, np.int64)] * 3
        for b in batches:
            ids, rows = dense(b.column(0), b.column(1), dim)
            x = _integers(rows, scale, narrow)
            lead, length, rest = _split(x, v)
            order = np.argsort(-length, kind="stable")
            for at in range(0, len(order), STEP):
                c = order[at : at + STEP]
                slack = SLACK * (1 + q_len * length[c[0]])
                on = np.flatnonzero(q_len * length[c[0]] + slack >= kth)
                if not len(on):
                    break  # the following candidates are no longer
                bound = q_lead[on] @ lead[c].T + np.outer(q_rest[on], rest[c])
                qi, ci = np.nonzero(bound + slack[on, None] >= kth[on, None])
                qi, ci = on[qi], c[ci]
                for part in range(0, len(qi), 1 << 18):
                    a, z = qi[part : part + (1 << 18)], ci[part : part + (1 << 18)]
                    score = _products(q[a], x[z])
                    use = (score >= kth[a]) & (qid[a] != ids[z])
                    held = [np.r_[h, n[use]] for h, n in zip(held, (a, ids[z], score), strict=True)]
                    keep = best(held[0], held[1], -held[2], k)
                    held = [h[keep] for h in held]
                    who, n = np.unique(held[0], return_counts=True)
                    ends = np.cumsum(n)[n >= k] - 1
                    kth[who[n >= k]] = np.maximum(kth[who[n >= k]], held[2][ends])
        yield pa.RecordBatch.from_arrays([pa.array(qid[held[0]], pa.int64()), pa.array(held[1], pa.int64()), pa.array(held[2], pa.int64())], ["query_id", "vec_id", "score"])

    return search


def exact_top_k(embeddings: DataFrame, k: int = 10, every: int = 100, scale: float = 1024) -> DataFrame:
    """query_id, rank, vec_id, score of the k largest integer inner products of each query.

    Queries are the rows whose vec_id is divisible by ``every``; candidates all
    rows with another vec_id. Defined cases: rows with a null id, a null vector
    or a null, NaN or infinite component take no part; shorter vectors count as
    padded with zeros; ties go to the smaller vec_id; of rows that repeat an id,
    the best counts, and as a query the smallest vector; with fewer candidates
    than k all are returned; an empty table gives no rows; other columns are
    ignored. Components of any size take part; a score that is returned and does not
    fit a long (2**63 - 1 in size counts as such) is an error.
    """
    vectors = valid_vectors(embeddings, zero_ok=True)
    spark, dim = vectors.sparkSession, dimension(vectors)
    empty = "query_id long, rank int, vec_id long, score long"
    if not dim:
        return spark.createDataFrame([], empty)
    largest = vectors.agg(F.max(F.expr(f"aggregate(embedding, 0D, (s, x) -> s + pow(floor({scale}D * x), 2))"))).first()[0]
    narrow = largest < NARROW
    v = _rotation(vectors, dim, scale)
    longest = vectors.withColumn("squares", F.expr("aggregate(embedding, 0D, (s, x) -> s + x * x)"))
    seeds = longest.orderBy(F.desc("squares"), "vec_id").limit(SEEDS).drop("squares").toArrow().combine_chunks()
    s_id, s = dense(seeds["vec_id"].combine_chunks(), seeds["embedding"], dim)
    s_id, first = np.unique(s_id, return_index=True)
    s = _integers(s[first], scale).astype(np.float64)
    ordered = longest.sortWithinPartitions(F.desc("squares")).drop("squares")

    def prepared() -> Iterator[tuple]:
        for qid, rows in query_blocks(vectors, every, dim):
            q = _integers(rows, scale, narrow)
            lead, length, rest = _split(q, v)
            start = np.full(len(q), -(1 << 63), np.int64)
            for at in range(0, len(q), 4096):
                scores = np.where(qid[at : at + 4096, None] == s_id, -np.inf, q[at : at + 4096].astype(np.float64) @ s.T)
                if scores.shape[1] > k:
                    sure = -np.partition(-scores, k - 1, axis=1)[:, k - 1] - SLACK * length[at : at + 4096] * np.sqrt(largest)
                    start[at : at + 4096] = np.floor(np.clip(sure, -(2.0**63), 2.0**63 - 2048))
            yield qid, q, lead, length, rest, start, v

    found = search_blocks(spark, prepared(), lambda block: ordered.mapInArrow(_searcher(block, dim, k, scale, narrow), SCHEMA), "products")
    if found is None:
        return spark.createDataFrame([], empty)
    fits = F.when(F.abs(F.col("score").cast("decimal(20,0)")) < 2**63 - 1, F.col("score")).otherwise(F.raise_error(F.lit("a score is beyond a long")))
    return ranked(found, k, largest_first=True).withColumn("score", fits)
