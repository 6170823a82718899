"""What the vector searches share: valid rows, query blocks, dense batches, final ranks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomfield.llm.tables import bound_batches, materialise


#: Bytes of the queries that one job searches for and that are broadcast.
BLOCK_BYTES = 16 << 20


def valid_vectors(df: DataFrame, zero_ok: bool, also: tuple[str, ...] = ()) -> DataFrame:
    """vec_id, embedding and ``also`` of the rows that take part: an id, and finite components only."""
    fine = "vec_id IS NOT NULL AND embedding IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))"
    if not zero_ok:
        fine += " AND exists(embedding, x -> x <> 0)"
    bound_batches(df.sparkSession)
    return df.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), *also)


def dimension(vectors: DataFrame) -> int:
    """The largest number of components; shorter vectors count as padded with zeros."""
    return int(vectors.agg(F.max(F.size("embedding"))).first()[0] or 0)


def dense(ids: pa.Array, lists: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and an (n, dim) matrix of a batch."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), dim))
    if len(flat) == out.size:
        out[:] = flat.reshape(out.shape)
    else:
        rows = np.repeat(np.arange(len(sizes)), sizes)
        out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return ids.to_numpy(zero_copy_only=False), out


def floors(x: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x), which a double holds exactly."""
    return np.floor(scale * x)


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two matrices of whole numbers, exact; those beyond a long become the nearest long."""
    safe = np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)) < 2.0**62  # no sum of some of the terms is longer
    out = np.zeros(len(a), np.int64)
    small = safe & (np.abs(a).max(1, initial=0) < 2.0**62) & (np.abs(b).max(1, initial=0) < 2.0**62)
    out[small] = np.einsum("ij,ij->i", a[small].astype(np.int64), b[small].astype(np.int64))
    for n in np.flatnonzero(~small):
        out[n] = min(max(sum(int(x) * int(y) for x, y in zip(a[n], b[n], strict=True)), -(1 << 63)), (1 << 63) - 1)
    return out


def query_blocks(vectors: DataFrame, every: int, dim: int, size: int = BLOCK_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The rows whose id is divisible by ``every``, in blocks of about ``size`` bytes of doubles by hash; an id counts once, with its smallest vector."""
    wanted, block = vectors.where(F.col("vec_id") % every == 0), max(1, size // (8 * dim))
    blocks = -(-wanted.count() // block)
    for b in range(blocks):
        mine = wanted.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b)
        got = mine.groupBy("vec_id").agg(F.min("embedding").alias("embedding")).orderBy("vec_id").toArrow().combine_chunks()
        if got.num_rows:
            yield dense(got["vec_id"].combine_chunks(), got["embedding"], dim)


def search_blocks(spark: SparkSession, blocks: Iterator[tuple], search: Callable[[object], DataFrame], label: str) -> DataFrame | None:
    """What ``search`` finds for each block, one after the other, so that the driver and the executors hold one block of queries at a time."""
    found = None
    for block in blocks:
        shared = spark.sparkContext.broadcast(block)
        part = materialise(search(shared), label, True)
        shared.unpersist()
        found = part if found is None else found.unionByName(part)
    return found


def best(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k smallest scores (ties to smaller ids), each id once, sorted by query."""
    order = np.lexsort((vec, score, query))
    q, v = query[order], vec[order]
    pairs = np.lexsort((np.arange(len(order)), v, q))  # the first of each (query, id) is its best
    first = np.ones(len(order), bool)
    first[pairs[1:]] = (np.diff(q[pairs]) != 0) | (np.diff(v[pairs]) != 0)
    order, q = order[first], q[first]
    starts = np.searchsorted(q, q, "left")
    return order[np.arange(len(q)) - starts < k]


def ranked(found: DataFrame, k: int, largest_first: bool) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of what all tasks found, ties to the smaller id."""
    once = found.groupBy("query_id", "vec_id").agg((F.max if largest_first else F.min)("score").alias("score"))
    order = F.col("score").desc() if largest_first else F.col("score").asc()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(order, "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
