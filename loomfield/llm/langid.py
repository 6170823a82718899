"""Language identification by rank-order profiles of character n-grams.

A language's profile lists its most frequent n-grams (one to three characters of
words padded with a space) of all training texts, in order. A document's own
list is compared with each profile: every n-gram adds the distance between its
two places, or the greatest distance if the profile lacks it. The language with
the smallest sum is predicted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomfield.llm.tables import bound_batches, materialise, tidy

#: Length of a profile.
PROFILE = 300
#: Profiles of so many languages are broadcast at a time (at most 20 MB); more are compared one group after the other.
GROUP = 4096
#: Characters counted at a time.
WINDOW = 1 << 17
#: N-grams that a task holds before it adds up equal ones.
HELD = 1 << 20
UNKNOWN = "und"
BITS, FILL = 21, (1 << 21) - 1

_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _letters[0]


def ngram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the distinct n-grams of a text, ascending, and their counts. Letters are lower-cased, all else separates words."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _is_letter()[points]
    line = np.where(letter, points, 0).astype(np.int64)
    line = line[letter | np.r_[True, letter[:-1]]] if len(line) else line
    line = np.r_[0, line, 0, 0]
    codes, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in range(0, len(line) - 2, WINDOW):
        a = line[at : at + WINDOW + 2]
        x, y, z = a[:-2], a[1:-1], a[2:]
        one = y[y > 0] << 2 * BITS | FILL << BITS | FILL
        pair = ((x << 2 * BITS) | (y << BITS) | FILL)[(x > 0) | (y > 0)]
        three = ((x << 2 * BITS) | (y << BITS) | z)[y > 0]
        got = np.unique(np.concatenate([one, pair, three]), return_counts=True)
        codes.append(got[0])
        counts.append(got[1])
    return _added(codes, counts) if len(codes) > 2 else (codes[-1], counts[-1])


def _added(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, place = np.unique(np.concatenate(codes), return_inverse=True)
    return found, np.bincount(place, np.concatenate(counts), len(found)).astype(np.int64)


def _held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def language_profiles(documents: DataFrame, size: int = PROFILE) -> DataFrame:
    """lang, gram, place (from 0): the profile of each language over all training texts (lang not null, not held out)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[list, list]] = {}
        size = 0  # n-grams held, of all languages

        def partial() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                codes, counts = _added(*parts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes, pa.int64()), pa.array(counts, pa.int64())], ["lang", "gram", "n"])

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                codes, counts = held.setdefault(lang, ([], []))
                got = ngram_counts(text.as_py())
                codes.append(got[0])
                counts.append(got[1])
                size += len(got[0])
                if size > HELD:
                    held.update({own: tuple([x] for x in _added(*parts)) for own, parts in held.items()})
                    size = sum(len(parts[0][0]) for parts in held.values())
                    if size > HELD // 2:  # many languages: counts so far go on, and Spark adds them up
                        yield from partial()
                        held.clear()
                        size = 0
        yield from partial()

    train = documents.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~_held_out()).select("lang", "text")
    grams = train.mapInArrow(tidy(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = [F.desc("n"), F.asc("gram")]
    salted = grams.withColumn("salt", F.pmod(F.xxhash64("gram"), F.lit(16)))
    for keys in (["lang", "salt"], ["lang"]):
        salted = salted.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).where(F.col("place") < size)
    return salted.select("lang", "gram", "place")


def predict_languages(documents: DataFrame, size: int = PROFILE) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; see ``with_languages`` for the cases."""
    return with_languages(documents, size).select("doc_id", "held_out", "lang_pred", "score")


def with_languages(documents: DataFrame, size: int = PROFILE) -> DataFrame:
    """All columns of documents with held_out, lang_pred and score (0 to 1: one less the mean relative distance).

    Profiles are learned from text and lang of documents whose crc32(doc_id as
    text) mod 5 is not 0. Defined cases: a text that is null or has no letters is
    ``und`` with score 0, as is any text when nothing can be learned; equal
    distances go to the language first in order; equal counts to the smaller
    code; a null doc_id is not trained on and not held out; repeated rows are
    judged each; texts of any length are counted whole; any number of languages is
    compared; an empty table gives no rows; clashing columns are replaced.
    """
    spark = documents.sparkSession
    bound_batches(spark)
    profiles = materialise(language_profiles(documents, size), "profiles")
    langs = sorted(r["lang"] for r in profiles.select("lang").distinct().collect())
    judged = documents.drop("lang_pred", "score", "held_out").withColumn("held_out", _held_out())
    judged = judged.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    fields = T.StructType([T.StructField(f.name, f.dataType) for f in judged.schema])
    for at in range(0, len(langs), GROUP):
        own = langs[at : at + GROUP]
        rows = profiles.where(F.col("lang").between(own[0], own[-1])).toArrow()
        shared = spark.sparkContext.broadcast(Profiles(own, rows, size))
        judged = judged.mapInArrow(tidy(_judge(shared)), fields)
    return judged


class Profiles:
    """The profiles of some languages as lists of (language, place) by n-gram."""

    def __init__(self, langs: list[str], rows: pa.Table, size: int):
        self.langs, self.size = langs, size
        gram, place = rows["gram"].to_numpy(), rows["place"].to_numpy().astype(np.int64)
        lang = np.searchsorted(np.array(langs, object), rows["lang"].to_numpy(zero_copy_only=False))
        order = np.argsort(gram, kind="stable")
        self.lang, self.place = lang[order].astype(np.int32), place[order].astype(np.int32)
        self.gram, self.start = np.unique(gram[order], return_index=True)
        self.count = np.diff(np.append(self.start, len(order)))

    def nearest(self, codes: np.ndarray, counts: np.ndarray) -> tuple[str, float]:
        """The language with the smallest out-of-place distance, the first in order of several, and its score."""
        own = codes[np.lexsort((codes, -counts))[: self.size]]
        at = np.minimum(np.searchsorted(self.gram, own), len(self.gram) - 1)
        there = np.flatnonzero(self.gram[at] == own)
        count = self.count[at[there]]
        # every n-gram counts the greatest distance, less what languages that have it are nearer
        entry = np.repeat(self.start[at[there]] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        nearer = self.size - np.abs(self.place[entry] - np.repeat(there, count))
        distance = self.size * len(own) - np.bincount(self.lang[entry], nearer, len(self.langs))
        low = int(distance.argmin())
        return self.langs[low], 1 - float(distance[low]) / (self.size * len(own))


def _judge(shared):
    """A task that compares texts with a group of languages; a later group wins only with a larger score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = shared.value
        for b in batches:
            names = b.schema.names
            before = [b.column(names.index(c)).to_pylist() for c in ("lang_pred", "score")]
            found = []
            for text, lang, score in zip(b.column(names.index("text")), *before, strict=True):
                codes, counts = ngram_counts(text.as_py())
                if len(codes):
                    best = profiles.nearest(codes, counts)
                    if best[1] > score or (lang, score) == (UNKNOWN, 0):
                        lang, score = best
                found.append((lang, score))
            columns = dict(zip(names, b.columns, strict=True))
            columns |= {"lang_pred": pa.array([f[0] for f in found], pa.string()), "score": pa.array([f[1] for f in found], pa.float64())}
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names)

    return run
