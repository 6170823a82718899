"""Toxicity by a chain of linear classifiers.

The categories are predicted one after the other. Each is a logistic regression
over the words, and beginnings of words, that a document has and the
probabilities of the categories before it. In training those are out-of-fold predictions, so that a later model
sees probabilities as uncertain as they will be on new documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomfield.llm.tables import bound_batches, materialise, slices, tidy
from loomfield.llm.words import mix, word_hashes

#: The chain: each category with the condition on a row of labels that defines it.
CATEGORIES = (
    ("low_quality", "coalesce(quality, 1) = 0"),
    ("toxic", "coalesce(toxic, 0) = 1"),
)
DECIDES = "toxic"
#: Labelled documents, at most about, that the chain is fitted on (chosen by a hash of the id over all labels).
TRAIN_DOCS = 6000
#: Buckets of word hashes; words that few training documents have, or that tell little, are left out.
BUCKETS = 1 << 22
LEAST_DOCS, FEATURES = 6, 2048
#: Bytes of the beginnings of words, beside whole words, that are features.
BEGINNINGS = (4, 5, 6)
FOLDS, ROUNDS, RIDGE = 3, 120, 1e-4
THRESHOLD = 0.5


def word_buckets(texts: pa.Array) -> list[np.ndarray]:
    """The distinct buckets of the words of each text and of their beginnings."""
    hashes, begins = word_hashes(texts, BEGINNINGS)
    salts = np.arange(len(hashes), dtype=np.uint64)[:, None]
    buckets = (mix(hashes + salts) >> np.uint64(42)).astype(np.int64)
    return [np.unique(buckets[:, a:b]) for a, b in zip(begins[:-1], begins[1:], strict=True)]


def _bare(texts: pa.Array) -> pa.Array:
    """Texts with ASCII punctuation and digits as spaces, so that a word counts alike before a comma."""
    return pc.replace_substring_regex(texts, r"[!-@\[-`{-~]+", " ")


class _Rows:
    """Sparse 0/1 rows with added dense columns."""

    def __init__(self, columns: list[np.ndarray], dense: np.ndarray):
        self.size = np.array([len(c) for c in columns], np.int64)
        self.column = np.concatenate(columns) if columns else np.zeros(0, np.int64)
        self.row = np.repeat(np.arange(len(columns)), self.size)
        self.dense = dense

    def times(self, w: np.ndarray, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.column], len(self.size)) + self.dense @ v

    def back(self, e: np.ndarray, features: int) -> tuple[np.ndarray, np.ndarray]:
        return np.bincount(self.column, e[self.row], features), self.dense.T @ e


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_logistic(x: _Rows, y: np.ndarray, features: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights of sparse and dense columns by accelerated gradient descent with scaled steps; all 0, a probability of a half, from no rows."""
    n = len(y)
    if not n:
        return np.zeros(features), np.zeros(x.dense.shape[1])
    scale = 1 / (np.bincount(x.column, minlength=features) / n * 0.25 + RIDGE + 0.002)
    spread = 1 / (0.25 * (x.dense**2).mean(0) + RIDGE + 1e-3)
    step = 1 / (x.size.mean() ** 0.5 + x.dense.shape[1] + 1)
    w, v = np.zeros(features), np.zeros(x.dense.shape[1])
    w_old, v_old = w, v
    for k in range(ROUNDS):
        m = k / (k + 3)
        wa, va = w + m * (w - w_old), v + m * (v - v_old)
        error = _sigmoid(x.times(wa, va)) - y
        gw, gv = x.back(error, features)
        w_old, v_old = w, v
        w, v = wa - step * scale * (gw / n + RIDGE * wa), va - step * spread * (gv / n)
    return w, v


class Chain:
    """The fitted chain; ``predict`` gives a probability for each document and category."""

    def __init__(self, known: np.ndarray, buckets: list[np.ndarray], labels: np.ndarray):
        """known: the sorted buckets that are features; labels: (documents, categories) of 0 and 1."""
        self.known = known
        columns = [self._columns(b) for b in buckets]
        fold = np.arange(len(buckets)) % FOLDS
        dense = np.ones((len(buckets), 1))
        self.models = []
        for y in labels.T.astype(float):
            ahead = np.zeros(len(y))
            for f in range(FOLDS):
                inside, outside = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
                model = fit_logistic(_Rows([columns[i] for i in inside], dense[inside]), y[inside], len(self.known))
                ahead[outside] = _sigmoid(_Rows([columns[i] for i in outside], dense[outside]).times(*model))
            self.models.append(fit_logistic(_Rows(columns, dense), y, len(self.known)))
            dense = np.c_[dense, ahead]

    def _columns(self, buckets: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.known, buckets)
        at = np.minimum(at, max(0, len(self.known) - 1))
        return at[self.known[at] == buckets] if len(self.known) else np.zeros(0, np.int64)

    def predict(self, buckets: list[np.ndarray]) -> np.ndarray:
        columns, dense = [self._columns(b) for b in buckets], np.ones((len(buckets), 1))
        for model in self.models:
            dense = np.c_[dense, _sigmoid(_Rows(columns, dense).times(*model))]
        return dense[:, 1:]


def fit_chain(documents: DataFrame, labels: DataFrame) -> Chain | None:
    """A chain from a bounded sample of labelled documents; None if there are none."""
    n = labels.count()
    sampled = (
        labels.where(F.col("doc_id").isNotNull() & (F.pmod(F.xxhash64("doc_id"), F.lit(n // TRAIN_DOCS + 1)) == 0))
        .groupBy("doc_id").agg(*[F.max(F.expr(c).cast("int")).alias(name) for name, c in CATEGORIES])
    )

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, 1, 256):
                found = word_buckets(_bare(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.int64())), *part.columns[2:]], ["doc_id", "buckets", *part.schema.names[2:]])

    names = [name for name, _ in CATEGORIES]
    # an id counts once, with its smallest text, so the sample is bounded whatever ids repeat
    joined = documents.select("doc_id", "text").join(F.broadcast(sampled), "doc_id").groupBy("doc_id", *names).agg(F.min("text").alias("text")).select("doc_id", "text", *names)
    bucketed = materialise(joined.mapInArrow(tidy(buckets), "doc_id long, buckets array<long>, " + ", ".join(f"{x} int" for x in names)), "labelled")
    known = telling_buckets(bucketed, names)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.intersect1d(np.array(x.values, np.int64), known, assume_unique=True) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int64())), *b.columns[2:]], b.schema.names)

    got = bucketed.mapInArrow(features, bucketed.schema).toArrow().sort_by("doc_id")
    if not got.num_rows:
        return None
    return Chain(known, [np.array(x.values, np.int64) for x in got["buckets"].combine_chunks()], np.stack([got[x].to_numpy() for x in names], 1))


def telling_buckets(bucketed: DataFrame, names: list[str]) -> np.ndarray:
    """The buckets, sorted, whose share of documents differs most from chance in some category."""
    n, *positive = bucketed.agg(F.count(F.lit(1)), *[F.sum(x) for x in names]).first()
    if not n:
        return np.zeros(0, np.int64)
    counts = bucketed.select(F.explode("buckets").alias("bucket"), *names).groupBy("bucket").agg(F.count(F.lit(1)).alias("docs"), *[F.sum(x).alias(x) for x in names])
    share = F.col("docs") / n
    gains = [F.abs(F.col(x) / n - share * (p / n)) / F.sqrt(share * (1 - share) * (p / n) * (1 - p / n) / n + 1e-12) for x, p in zip(names, positive, strict=True)]
    best = counts.where(F.col("docs") >= LEAST_DOCS).orderBy(F.desc(F.greatest(*gains)), "bucket").limit(FEATURES)
    return np.sort(np.array([r["bucket"] for r in best.select("bucket").collect()], np.int64))


def with_toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """All columns of documents with p_<category> for each category and the verdict is_toxic (p_toxic of 0.5 or more).

    Defined cases: a null or wordless text is judged by the models' constants;
    without labelled documents all probabilities are 0; from a single one, or from
    those of one class, the constants alone tell; labels may be null
    (quality as good, toxic as not) or repeated (the worse counts); of labelled
    rows that repeat an id the smallest text is learned from; repeated documents
    are judged each; texts of any length are judged whole; a probability of just
    0.5 is toxic; an empty table gives no rows; clashing columns are replaced.
    """
    bound_batches(documents.sparkSession)
    chain = documents.sparkSession.sparkContext.broadcast(fit_chain(documents, labels))
    names = [f"p_{name}" for name, _ in CATEGORIES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index("text")
            for part in slices(b, at, 256):
                text = part.column(at)
                p = chain.value.predict(word_buckets(_bare(text))) if chain.value else np.zeros((part.num_rows, len(names)))
                verdict = p[:, [c for c, _ in CATEGORIES].index(DECIDES)] >= THRESHOLD
                yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(x) for x in p.T], pa.array(verdict)], [*part.schema.names, *names, "is_toxic"])

    plain = documents.drop(*names, "is_toxic")
    fields = [*plain.schema.fields, *[T.StructField(x, T.DoubleType()) for x in names], T.StructField("is_toxic", T.BooleanType())]
    return plain.mapInArrow(tidy(run), T.StructType(fields))
