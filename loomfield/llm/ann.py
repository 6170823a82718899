"""Approximate nearest neighbours: score-aware anisotropic 4-bit quantisation.

Nearness |q - x|^2 = |q|^2 - 2 (q.x - |x|^2 / 2), so the search is for large
q.x - |x|^2 / 2. The index keeps |x|^2 / 2 exactly and x as one of 16 codewords
per subspace. Codewords and codes minimise |r|^2 + (eta - 1) (r.u)^2, where r is
the residual and u the direction of x: error parallel to x changes large inner
products most and is penalised. Equal vectors are one row of the index with the smallest
of their ids. A query makes a table of 16 entries per subspace; tasks add table
entries over all rows. The exact distances, on the original vectors, of a query's
leaders by code give the farthest that a row may lie to count. The code of a row tells
its distance but for |r| at most, so it excludes the rows that are farther for certain;
all others are compared exactly too. So no row is missed, however badly the codebooks
fit (narrow clusters, far outliers), and the result does not depend on how rows are
dealt to tasks. Poor codes cost time: they exclude fewer rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomfield.llm.tables import materialise
from loomfield.llm.vectors import dense, dimension, query_blocks, ranked, search_blocks, valid_vectors

#: Rows, at most about, that the codebooks are fitted on (chosen by a hash of the id); every row is indexed.
TRAIN_ROWS = 16_384
#: Dimensions of a subspace.
WIDTH = 1
#: Weight of parallel error follows from this threshold on the cosine.
COSINE = 0.2
#: Leaders of a batch by code whose exact distances bound a query's search; rows that a task gives for a query, and all that tie with the last one.
RERANK, MOST = 200, 11
#: Bytes of the queries that one job searches for; queries scored at a time, and bytes of the pairs whose exact distance is taken at a time.
QUERY_BYTES, STEP, PAIR_BYTES = 2 << 20, 128, 16 << 20
#: Relative error of a sum in single precision, for each of its terms, and of one in double precision; both amply.
SINGLE, DOUBLE = 2.0**-22, 1e-12
#: Error of a product too small for single precision, amply.
TINY = 1e-37

SCHEMA = "query_id long, key long, score double"


def _padded(x: np.ndarray, width: int) -> np.ndarray:
    extra = -x.shape[1] % width
    return np.pad(x, ((0, 0), (0, extra))).reshape(len(x), -1, width)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum((1, 2), keepdims=True)), 1e-300)


def encode(x: np.ndarray, books: np.ndarray, eta: float, sweeps: int = 2) -> np.ndarray:
    """(n, subspaces) codes by coordinate descent on the anisotropic loss. x: (n, subspaces, width)."""
    u = _unit(x)
    codes = np.empty(x.shape[:2], np.uint8)
    parallel = np.empty(x.shape[:2])
    for m, book in enumerate(books):
        r = x[:, m, None] - book
        codes[:, m] = (r**2).sum(2).argmin(1)
        parallel[:, m] = ((x[:, m] - book[codes[:, m]]) * u[:, m]).sum(1)
    total = parallel.sum(1)
    for _ in range(sweeps):
        for m, book in enumerate(books):
            r = x[:, m, None] - book
            along = np.einsum("nkw,nw->nk", r, u[:, m])
            others = total - parallel[:, m]
            codes[:, m] = ((r**2).sum(2) + (eta - 1) * (others[:, None] + along) ** 2).argmin(1)
            parallel[:, m] = along[np.arange(len(x)), codes[:, m]]
            total = others + parallel[:, m]
    return codes


def fit_codebooks(rows: np.ndarray, eta: float, rounds: int = 6, seed: int = 7) -> np.ndarray:
    """(subspaces, 16, width) codewords for rows (n, dim): k-means starts, then weighted least squares."""
    x = _padded(rows, WIDTH)
    rng = np.random.default_rng(seed)
    books = np.stack([x[rng.choice(len(x), 16, replace=len(x) < 16), m] for m in range(x.shape[1])])
    u = _unit(x)
    for turn in range(rounds):
        weight = 1.0 if turn < rounds // 2 else eta
        codes = encode(x, books, weight, sweeps=0 if weight == 1.0 else 1)
        parallel = np.einsum("nmw,nmw->nm", x - books[np.arange(x.shape[1]), codes], u)
        for m in range(x.shape[1]):
            others = parallel.sum(1) - parallel[:, m]
            um, xm = u[:, m], x[:, m]
            right = xm + (weight - 1) * um * (others + (xm * um).sum(1))[:, None]
            for c in range(16):
                own = codes[:, m] == c
                if own.any():
                    left = own.sum() * np.eye(WIDTH) + (weight - 1) * um[own].T @ um[own]
                    books[m, c] = np.linalg.solve(left, right[own].sum(0))
    return books


def distinct_vectors(vectors: DataFrame, dim: int, most: int) -> DataFrame:
    """key, vec_id, embedding, vec_ids: each vector once, padded with zeros, with a number, its smallest id and its ``most`` smallest ids in order."""
    padded = F.concat("embedding", F.array_repeat(F.lit(0.0), F.lit(dim) - F.size("embedding")))
    rows = vectors.select("vec_id", padded.alias("embedding")).distinct()
    # the limit on the rank holds before the shuffle too, so a common vector sends few rows to one task
    place = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    few = rows.withColumn("place", place).where(F.col("place") <= most)
    grouped = few.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("vec_ids"))
    return materialise(grouped.select(F.monotonically_increasing_id().alias("key"), F.col("vec_ids")[0].alias("vec_id"), "embedding", "vec_ids"), "vectors", True)


def build_index(vectors: DataFrame, dim: int) -> tuple[DataFrame, np.ndarray]:
    """All rows of distinct vectors with packed 4-bit codes, as a table in the shared folder, and the codebooks."""
    n = vectors.count()
    slim = vectors.select("vec_id", "embedding")
    train = slim.where(F.pmod(F.xxhash64("vec_id"), F.lit(n // TRAIN_ROWS + 1)) == 0).orderBy("vec_id", "embedding").toArrow().combine_chunks()
    if not train.num_rows:
        train = slim.orderBy("vec_id", "embedding").limit(TRAIN_ROWS).toArrow().combine_chunks()
    eta = max(1.0, (dim - 1) * COSINE**2 / (1 - COSINE**2))
    books = fit_codebooks(dense(train["vec_id"].combine_chunks(), train["embedding"], dim)[1], eta)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = dense(b.column(0), b.column(1), dim)[1]
                codes = encode(_padded(x, WIDTH), books, eta)
                codes = np.pad(codes, ((0, 0), (0, codes.shape[1] % 2)))
                packed = codes[:, ::2] | codes[:, 1::2] << 4
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array([r.tobytes() for r in packed], pa.binary()), pa.array((x * x).sum(1) / 2)],
                    ["key", "embedding", "codes", "half"],
                )

    coded = vectors.select("key", "embedding").mapInArrow(index, "key long, embedding array<double>, codes binary, half double")
    return materialise(coded, "ann"), books


def leading(query: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
    """Places of each query's ``most`` largest values, and of all that equal the last of them, sorted by query."""
    order = np.lexsort((-near, query))
    q, v = query[order], near[order]
    starts = np.searchsorted(q, q, "left")
    last = np.minimum(starts + most, np.searchsorted(q, q, "right")) - 1
    return order[v >= v[last]]


def _searcher(block, books, dim: int, rerank: int, most: int = MOST):
    """A task that emits each query's ``most`` nearest of its rows, with the exact distance, and all that tie with the last one."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, q = block.value
        centre = books.mean(1)  # distances stay as they are when all vectors move, and sums are the more precise
        moved, centred = _padded(q, WIDTH) - centre, books - centre[:, None]
        tables = np.einsum("qmw,mcw->mqc", moved, centred).astype(np.float32)
        tables = np.pad(tables, ((0, len(tables) % 2), (0, 0), (0, 0)))
        long = (moved * moved).sum((1, 2))
        pairs = max(1, PAIR_BYTES // (8 * dim))
        starts = range(0, len(q), STEP)
        held = {at: [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)] for at in starts}
        cut = np.full(len(q), np.inf)

        def compare(at: int, chosen: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
            """Take the exact distances of chosen pairs, keep each query's nearest, and lower its cut."""
            every, place = np.nonzero(chosen)
            for some in range(0, len(every), pairs):
                qi, ci = every[some : some + pairs] + at, place[some : some + pairs]
                exact = np.sqrt(((q[qi] - x[ci]) ** 2).sum(1))
                near = np.flatnonzero(~(exact > cut[qi]))
                found = [np.r_[h, n] for h, n in zip(held[at], (qi[near], ids[ci[near]], exact[near]), strict=True)]
                keep = leading(found[0], -found[2], most)
                held[at] = [f[keep] for f in found]
                who, n = np.unique(held[at][0], return_counts=True)
                cut[who[n >= most]] = held[at][2][(np.cumsum(n) - 1)[n >= most]]

        for b in batches:
            if not b.num_rows:
                continue
            ids, x = dense(b.column(0), b.column(1), dim)
            packed = np.ascontiguousarray(np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(len(x), -1).T)
            codes = np.stack([packed & 15, packed >> 4], 1).reshape(-1, len(x))[: len(books)]
            decoded = centred[np.arange(len(books))[:, None], codes]
            own = (_padded(x, WIDTH) - centre).transpose(1, 0, 2)
            off, length, half = np.sqrt(((own - decoded) ** 2).sum((0, 2))), (decoded**2).sum((0, 2)), (own * own).sum((0, 2)) / 2
            for at in starts:
                dot = np.zeros((len(q[at : at + STEP]), len(x)), np.float32)
                for m, pair in enumerate(packed):  # two codes in a byte, and a table of both
                    two = tables[2 * m : 2 * m + 2, at : at + STEP]
                    dot += (two[1][:, :, None] + two[0][:, None, :]).reshape(len(dot), 256)[:, pair]
                size = long[at : at + STEP, None]
                # the least that the square of the distance from the query to the decoded row can be
                least = size + length - 2.0 * dot - (len(packed) + 4) * (SINGLE * np.sqrt(size) * np.sqrt(length) + TINY) - DOUBLE * (size + length)
                least[~np.isfinite(dot)] = -np.inf

                def possible(at: int = at, least: np.ndarray = least) -> np.ndarray:
                    return ~(least > ((cut[at : at + STEP, None] + off) * (1 + DOUBLE)) ** 2)

                near = dot - half
                last = len(x) - min(rerank, len(x))
                leaders = possible() & (near >= np.partition(near, last, axis=1)[:, last, None])
                compare(at, leaders, ids, x)
                compare(at, possible() & ~leaders, ids, x)
        found = [np.concatenate(c) for c in zip(*held.values(), strict=True)] if len(q) else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]
        yield pa.RecordBatch.from_arrays([pa.array(qid[found[0]], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2])], ["query_id", "key", "score"])

    return search


def nearest_neighbours(embeddings: DataFrame, k: int = 10, every: int = 100, rerank: int = RERANK) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of each query, by Euclidean distance.

    Queries are the rows whose vec_id is divisible by ``every``; candidates all
    rows with another vec_id. The distance is exact (double) on the original
    vectors. ``rerank`` changes the cost only. Defined cases: rows with a null id, a null or zero vector or a null,
    NaN or infinite component take no part; shorter vectors count as padded with
    zeros; ties go to the smaller vec_id; of rows that repeat an id the nearest
    counts, and as a query the smallest vector; with fewer candidates than k all
    are returned; an empty table gives no rows; other columns are ignored.
    """
    vectors = valid_vectors(embeddings, zero_ok=False)
    spark, dim = vectors.sparkSession, dimension(vectors)
    if not dim:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    distinct = distinct_vectors(vectors, dim, k + 1)
    indexed, books = build_index(distinct, dim)
    of_query = Window.partitionBy("query_id")

    def search(block) -> DataFrame:
        # a vector stands for up to k + 1 ids, of which one can be the query's own
        found = indexed.mapInArrow(_searcher(block, books, dim, rerank, k + 1), SCHEMA)
        return found.withColumn("place", F.rank().over(of_query.orderBy("score"))).where(F.col("place") <= k + 1).select("query_id", "key", "score")

    found = search_blocks(spark, query_blocks(vectors, every, dim, QUERY_BYTES), search, "leaders")
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    each = found.join(distinct.select("key", "vec_ids"), "key").select("query_id", F.explode("vec_ids").alias("vec_id"), "score")
    return ranked(each.where("vec_id <> query_id"), k, largest_first=False)
