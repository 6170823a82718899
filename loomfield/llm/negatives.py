"""Hard negatives by threshold joins over an inverted index of the anchors.

An anchor wants windows filled: first its best rows of the same label, then, for
each of these positives, the best rows of other labels whose score lies between
two shares of the positive's. Each window has a threshold; a round of the join
finds every row that reaches it. Windows that are then full are final, the others
come again with a lower threshold, at last the least that counts.

The join streams all rows past an index of the anchors. Dimensions are ordered by
their part of the squares of the table. An anchor stands in the lists of its
first dimensions only: those after which the length of its rest, times the
longest row at hand, stays under its threshold. Scores are added up list by list; a pair
goes as soon as its part and the product of the lengths that remain cannot
reach the threshold. Pairs that are left are multiplied exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomfield.llm.tables import materialise
from loomfield.llm.vectors import dense, dimension, exact_products, floors, valid_vectors

#: Bytes of the anchors that are searched for at a time.
BLOCK_BYTES = 16 << 20
#: Rows, by hash, that first thresholds come from; they change no result.
SAMPLE = 2048
#: Dimensions of a list, and lists whose scores are added up for all pairs before pairs are told apart.
LIST, FIRST_LISTS = 8, 2
#: Anchors and rows of a step, and pairs multiplied at a time.
ANCHORS, ROWS, PAIRS = 2048, 512, 1 << 17
#: Share of the lengths' product by which bounds in floating point are raised.
SLACK = 1e-6
NEVER = 2**63 - 1

FOUND = "window long, vec_id long, score long"


class Windows(NamedTuple):
    """What anchors want: arrays with a row for each window."""

    anchor: np.ndarray  # place of the anchor in its block
    low: np.ndarray  # scores that count
    high: np.ndarray
    at: np.ndarray  # threshold of the round


class Block(NamedTuple):
    """Anchors, and their lengths from each list on."""

    ids: np.ndarray
    labels: np.ndarray
    rows: np.ndarray
    rest: np.ndarray


def _rest(rows: np.ndarray) -> np.ndarray:
    """(n, lists + 1) lengths of what follows the first 0, 1, .. lists of dimensions."""
    squares = np.add.reduceat(rows**2, np.arange(0, rows.shape[1], LIST), axis=1)
    return np.sqrt(np.c_[np.cumsum(squares[:, ::-1], axis=1)[:, ::-1], np.zeros(len(rows))])


def _keep(held: list[np.ndarray], want: int) -> list[np.ndarray]:
    """Of (window, vec_id, score) each window's ``want`` largest scores, ties to smaller ids, each id once."""
    order = np.lexsort((held[1], -held[2], held[0]))
    window, vec = held[0][order], held[1][order]
    by_id = np.lexsort((np.arange(len(order)), vec, window))
    first = np.ones(len(order), bool)
    first[by_id[1:]] = (np.diff(window[by_id]) != 0) | (np.diff(vec[by_id]) != 0)
    order, window = order[first], window[first]
    order = order[np.arange(len(window)) - np.searchsorted(window, window, "left") < want]
    return [h[order] for h in held]


def _candidates(block: Block, mine: np.ndarray, least: np.ndarray, rows: np.ndarray, rest: np.ndarray, fits: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (anchor of ``mine``, row) that may reach the anchors' thresholds, of those that ``fits``."""
    lists = block.rest.shape[1] - 1
    longest = rest[:, 0].max()
    slack = SLACK * (1 + block.rest[mine, 0] * longest)
    reach = (block.rest[mine] * longest + slack[:, None] >= least[:, None]).sum(1)  # lists that an anchor stands in; lengths only fall
    order = np.argsort(-reach, kind="stable")
    order = order[: np.count_nonzero(reach)]
    if not len(order):
        return
    a, reach, least, slack = mine[order], np.minimum(reach[order], lists), least[order], slack[order]
    score = np.zeros((len(a), len(rows)))
    first = min(FIRST_LISTS, lists)
    for n in range(first):
        on = np.searchsorted(-reach, -n, "left")  # the anchors that reach beyond list n
        part = slice(n * LIST, (n + 1) * LIST)
        score[:on] += block.rows[a[:on], part] @ rows[:, part].T
    after = np.minimum(reach, first)
    bound = score + block.rest[a, after][:, None] * rest[:, after].T + slack[:, None]
    qi, ci = np.nonzero((bound >= least[:, None]) & fits[order])
    for at in range(0, len(qi), PAIRS):
        q, c = qi[at : at + PAIRS], ci[at : at + PAIRS]
        s = score[q, c]
        for n in range(first, lists):
            on = reach[q] > n
            if on.any():
                part = slice(n * LIST, (n + 1) * LIST)
                s[on] += np.einsum("ij,ij->i", block.rows[a[q[on]], part], rows[c[on], part])
            after = np.minimum(reach[q], n + 1)
            alive = s + block.rest[a[q], after] * rest[c, after] + slack[q] >= least[q]
            q, c, s = q[alive], c[alive], s[alive]
        yield a[q], c


def _join(shared, dim: int, order: np.ndarray, scale: float, same: bool, want: int):
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, windows = shared.value
        anchors, slots = np.unique(windows.anchor, return_inverse=True)
        place = np.arange(len(slots)) - np.searchsorted(slots, slots, "left")  # windows stand by anchor
        low = np.full((len(anchors), int(place.max()) + 1), np.inf)
        high, window = np.full(low.shape, -np.inf), np.zeros(low.shape, np.int64)
        low[slots, place], high[slots, place], window[slots, place] = np.maximum(windows.at, windows.low), windows.high, np.arange(len(slots))
        held = [np.zeros(0, np.int64)] * 3
        for b in batches:
            ids, vectors = dense(b.column(0), b.column(1), dim)
            labels, rows = b.column(2).to_numpy(zero_copy_only=False), floors(vectors, scale)[:, order]
            rest = _rest(rows)
            by_length = np.argsort(-rest[:, 0], kind="stable")
            for at in range(0, len(by_length), ROWS):
                c = by_length[at : at + ROWS]
                for first in range(0, len(anchors), ANCHORS):
                    mine = np.arange(first, min(first + ANCHORS, len(anchors)))
                    own = anchors[mine]
                    fits = ((block.labels[own][:, None] == labels[c]) == same) & (block.ids[own][:, None] != ids[c])
                    local = Block(block.ids[own], block.labels[own], block.rows[own], block.rest[own])
                    for q, z in _candidates(local, np.arange(len(own)), low[mine].min(1), rows[c], rest[c], fits):
                        score = exact_products(local.rows[q], rows[c[z]])
                        q = mine[q]
                        n, slot = np.nonzero((score[:, None] >= low[q]) & (score[:, None] <= high[q]))
                        held = [np.r_[h, x] for h, x in zip(held, (window[q[n], slot], ids[c[z[n]]], score[n]), strict=True)]
                        if len(held[0]) > PAIRS:
                            held = _keep(held, want)
                            who, many = np.unique(held[0], return_counts=True)
                            full = who[many >= want]
                            last = held[2][np.cumsum(many)[many >= want] - 1]
                            low[slots[full], place[full]] = np.maximum(low[slots[full], place[full]], last)
        held = _keep(held, want)
        yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()) for h in held], ["window", "vec_id", "score"])

    return join


def _starts(block: Block, windows: Windows, sample: tuple, same: bool, want: int) -> list[np.ndarray]:
    """Thresholds of each round: the best sampled score of a window, its ``want``-th, and the least that counts."""
    ids, labels, rows = sample
    out = [windows.low.astype(np.float64) for _ in range(3)]
    for at in range(0, len(windows.anchor), 1024):
        part = slice(at, at + 1024)
        own = windows.anchor[part]
        score = block.rows[own] @ rows.T
        fits = ((block.labels[own][:, None] == labels) == same) & (block.ids[own][:, None] != ids)
        score[~(fits & (score <= windows.high[part][:, None]))] = -np.inf
        score.sort(axis=1)
        for n, k in ((0, 1), (1, want)):
            if score.shape[1] >= k:
                out[n][part] = np.maximum(out[n][part], score[:, -k])
    return out


def _fill(vectors: DataFrame, block: Block, windows: Windows, sample: tuple, setting: tuple, same: bool, want: int) -> list[np.ndarray]:
    """window, vec_id, score of the ``want`` best rows of each window, by window and rank; at most as many numbers as windows times ``want``."""
    spark, open_ = vectors.sparkSession, np.arange(len(windows.anchor))
    done = [np.zeros(0, np.int64)] * 3
    rounds = _starts(block, windows, sample, same, want)
    for n, at in enumerate(rounds):
        if not len(open_):
            break
        asked = Windows(windows.anchor[open_], windows.low[open_], windows.high[open_], at[open_])
        shared = spark.sparkContext.broadcast((block, asked))
        found = vectors.mapInArrow(_join(shared, *setting, same, want), FOUND).groupBy("window", "vec_id").agg(F.max("score").alias("score"))
        rank = F.row_number().over(Window.partitionBy("window").orderBy(F.desc("score"), "vec_id"))
        got = found.withColumn("rank", rank).where(F.col("rank") <= want).orderBy("window", "rank").select("window", "vec_id", "score").toArrow()
        shared.unpersist()
        held = [got[c].to_numpy() for c in ("window", "vec_id", "score")]
        final = (np.bincount(held[0], minlength=len(open_)) >= want) | (at[open_] <= windows.low[open_]) if n + 1 < len(rounds) else np.ones(len(open_), bool)
        use = final[held[0]]
        done = [np.r_[d, h] for d, h in zip(done, (open_[held[0][use]], held[1][use], held[2][use]), strict=True)]
        open_ = open_[~final]
    by = np.argsort(done[0], kind="stable")
    return [d[by] for d in done]


def _anchors(vectors: DataFrame, every: int, dim: int, order: np.ndarray, scale: float) -> Iterator[Block]:
    """The anchors, in blocks by hash of their ids."""
    wanted = vectors.where(F.col("vec_id") % every == 0)
    blocks = -(-wanted.count() * dim * 8 // BLOCK_BYTES)
    for b in range(blocks):
        mine = wanted.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b)
        got = mine.groupBy("vec_id").agg(F.min(F.struct("embedding", "label")).alias("v")).select("vec_id", "v.*").orderBy("vec_id").toArrow().combine_chunks()
        if got.num_rows:
            ids, rows = dense(got["vec_id"].combine_chunks(), got["embedding"], dim)
            rows = floors(rows, scale)[:, order]
            yield Block(ids, got["label"].to_numpy(), rows, _rest(rows))


def hard_negatives(embeddings: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, every: int = 50, scale: float = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of rows (vec_id, embedding, label).

    Anchors are the rows whose vec_id is divisible by ``every``; an anchor's
    positives its best other rows of the same label; for each positive, the best
    rows of other labels whose scores lie between ``low`` and ``high`` hundredths of
    the positive's. Scores are inner products of floor(scale * x). All rows are
    searched, for a block of anchors at a time. Defined cases: rows with a null id,
    label or vector, or a null, NaN or infinite component take no part; shorter
    vectors count as padded with zeros; ties go to the smaller vec_id; of rows that
    repeat an id, the best that qualifies counts once, and as an anchor the
    smallest vector with its smallest label; a negative positive_score has no
    negatives; a score beyond a long that would be returned is an error; an empty
    table gives no rows; other columns are ignored.
    """
    spark = embeddings.sparkSession
    vectors = valid_vectors(embeddings.where("label IS NOT NULL").withColumn("label", F.col("label").cast("long")), zero_ok=True, also=("label",))
    dim, out = dimension(vectors), None
    if dim:
        weights = {r[0]: r[1] for r in vectors.select(F.posexplode("embedding").alias("d", "x")).groupBy("d").agg(F.sum(F.col("x") * F.col("x")).alias("s")).collect()}
        order = np.array(sorted(range(dim), key=lambda d: (-weights.get(d, 0.0), d)))
        setting = dim, order, scale
        drawn = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow().combine_chunks()
        ids, rows = dense(drawn["vec_id"].combine_chunks(), drawn["embedding"], dim)
        sample = ids, drawn["label"].to_numpy(), floors(rows, scale)[:, order]
        for block in _anchors(vectors, every, dim, order, scale):
            every_score = Windows(np.arange(len(block.ids)), *(np.full(len(block.ids), v) for v in (-NEVER - 1, NEVER, -NEVER - 1)))
            anchor, positive, score = _fill(vectors, block, every_score, sample, setting, True, positives)
            if (np.abs(score.astype(np.float64)) >= 2.0**63).any():
                raise OverflowError("a positive's score is beyond a long")
            bounds = np.array([(-(-low * s // 100), high * s // 100) for s in map(int, score)], np.int64).reshape(-1, 2)
            some = np.flatnonzero(bounds[:, 0] <= bounds[:, 1])
            windows = Windows(anchor[some], bounds[some, 0], bounds[some, 1], bounds[some, 0])
            window, negative, found = _fill(vectors, block, windows, sample, setting, False, negatives)
            pair = some[window]
            rank = np.arange(len(window)) - np.searchsorted(window, window, "left") + 1
            columns = [block.ids[anchor[pair]], positive[pair], rank.astype(np.int32), negative, score[pair], found]
            names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
            part = materialise(spark.createDataFrame(pa.table(dict(zip(names, columns, strict=True)))), "negatives")
            out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long") if out is None else out
