"""N-gram Jaccard join by parity sketches.

A document is its set of distinct five-word shingles; documents link when their
Jaccard similarity is at least 0.8. Sets of sizes a <= c that link differ in at
most D = (a + c) / 9 shingles.

* Sketch: shingles fall into segments by hash, and within a segment each flips a
  place, so equal parts cancel and the Hamming distance of two sketches is at
  most the sets' symmetric difference. A segment is stored as the XOR of the
  64-bit names of its flipped places.
* Pigeonhole: D differing shingles spoil at most D of a set's filled segments.
  So of the segments in any fixed order, linked sets share one among the first
  D + 1 of each; only those are joined. Sizes fall into bands with their own
  segments; a set also joins the band below if a smaller partner may be there.
  The order puts segments with many uncommon shingles first, so passages that
  many documents share do not gather large buckets. The order changes the cost
  only, never the result.
* Verify: candidates are tested by dense parity sketches, then exactly.

Sets that are equal are one vertex, so exact copies never meet as pairs. A
bucket of many vertices is not expanded: its members are compared with one
pivot, the member that is in most large buckets. Members of different components
are then joined only where their distances to the pivot and the distance of
their folded sketches allow a link.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomfield.llm.components import components
from loomfield.llm.tables import bound_batches, materialise, slices, tidy
from loomfield.llm.words import U, mix, shingle_sets, word_hashes

#: Sizes of a band reach from its least to this many times that.
RATIO = 1.75
#: Below this size each shingle is a segment of its own.
SINGLES = 64
#: Buckets of at most so many vertices are expanded into pairs.
EXPANDED = 12
#: A shingle is common if in some stretch of a few thousand documents at least this share, and so many, have it.
COMMON_SHARE, COMMON_DOCS = 0.0007, 2
#: Common shingles that the order of segments heeds at most (2 MB to broadcast); the rest only cost time.
COMMON_MOST = 1 << 18
#: Bits for each id, and at most in all, of the filter that tells which texts to hash again; more ids are joined instead.
FILTER_SHARE, FILTER_MOST = 16, 1 << 29
#: Documents hashed at a time.
STEP = 512
WIDE = 1 << 32
#: 64-bit words of the folded sketch that members of large buckets are compared by, and members in a block.
FOLD = 32
BLOCK = 1024


@lru_cache
def _band(n: int) -> tuple[int, int, int]:
    """Number, least and greatest size of the band of size n."""
    number, low = 0, 1
    while True:
        high = max(low, int(low * RATIO) - 1)
        if n <= high:
            return number, low, high
        number, low = number + 1, high + 1


def _roles(n: int) -> list[tuple[int, int, int]]:
    """(band, greatest base size of the band, segments to join) of a set of n shingles in each band that it joins."""
    number, low, high = _band(n)
    most = n + n * 5 // 4
    out = [(number, high, most // 9 + 1)] if most >= 9 else []
    if low > 1 and n <= (low - 1) * 5 // 4 and (low - 1 + n) >= 9:
        out.append((number - 1, low - 1, (low - 1 + n) // 9 + 1))
    return out


def _segments(band: int, high: int, wide: frozenset[int]) -> int:
    return WIDE if high < SINGLES or band in wide else high * 2 // 5 + 4


def _places(shingles: np.ndarray, segments: int) -> np.ndarray:
    """Where each filled segment begins in the sorted shingles."""
    if segments == WIDE:
        return np.arange(len(shingles))
    own = (shingles >> U(32)) * U(segments) >> U(32)
    return np.flatnonzero(np.r_[True, own[1:] != own[:-1]])


class Common:
    """The common shingles; most others are told apart by their leading bits alone."""

    def __init__(self, shingles: np.ndarray):
        self.shingles = shingles
        self.leading = np.zeros(1 << 22, bool)
        self.leading[(shingles >> U(42)).astype(np.int64)] = True

    def rare(self, shingles: np.ndarray) -> np.ndarray:
        """1 for each shingle that is not common, else 0."""
        out = np.ones(len(shingles), U)
        maybe = np.flatnonzero(self.leading[(shingles >> U(42)).astype(np.int64)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.shingles, shingles[maybe]), len(self.shingles) - 1)
            out[maybe[self.shingles[at] == shingles[maybe]]] = 0
        return out


def band_keys(shingles: np.ndarray, common: Common, wide: frozenset[int] = frozenset()) -> list[np.ndarray]:
    """For each band that a set joins, the 64-bit keys of the segments that it joins by."""
    out, named = [], None
    for band, high, most in _roles(len(shingles)):
        if named is None:
            named, rare = mix(shingles ^ U(0xA5A5A5A5A5A5A5A5)), common.rare(shingles)
        segments = _segments(band, high, wide)
        begin = _places(shingles, segments)
        value = np.bitwise_xor.reduceat(named, begin)
        place = shingles[begin] if segments == WIDE else (shingles[begin] >> U(32)) * U(segments) >> U(32)
        key = mix(value ^ mix(place * U(0x9E3779B97F4A7C15) + U(band)))
        if len(key) > most:
            order = np.minimum(np.add.reduceat(rare, begin), U(255)) << U(56) | key >> U(8)
            key = key[np.argpartition(order, len(key) - most)[len(key) - most :]]
        out.append(key)
    return out


def dense_sketch(shingles: np.ndarray) -> bytes:
    """A parity sketch of a power of two of bits, at least twice the number of shingles."""
    bits = max(64, 1 << (2 * len(shingles) - 1).bit_length())
    return np.packbits((np.bincount((shingles & U(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def folded_sketch(shingles: np.ndarray) -> bytes:
    """A parity sketch of FOLD words, whatever the size of the set."""
    odd = np.bincount((shingles >> U(20) & U(64 * FOLD - 1)).astype(np.int64), minlength=64 * FOLD) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def sketch_distance(a: bytes, b: bytes) -> int:
    """Hamming distance; the longer sketch is folded to the shorter one's length, which parity allows."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def identity(shingles: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit sums that name a set."""
    with np.errstate(over="ignore"):
        a = mix(mix(shingles).sum(dtype=U, keepdims=True) + U(len(shingles)))[0]
        b = mix(mix(shingles ^ U(0x5DEECE66D)).sum(dtype=U, keepdims=True) ^ U(len(shingles)))[0]
    return int(a.view(np.int64)), int(b.view(np.int64))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of batches whose last column is text, with their shingle sets."""
    for b in batches:
        for part in slices(b, b.num_columns - 1, STEP):
            yield part, shingle_sets(*word_hashes(part.column(part.num_columns - 1)))


def _long(x) -> pa.Array:
    return pa.array(x.view(np.int64) if isinstance(x, np.ndarray) and x.dtype == U else x, pa.int64())


def _survey(documents: DataFrame) -> DataFrame:
    """kind 0: a document (a id, b size, c and d its set's names, t its text's hash); 1: a common shingle a and b documents that have it; 2: a band a that needs single shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        names = ["kind", "a", "b", "c", "d", "t"]

        def common() -> pa.RecordBatch:
            every, docs = np.unique(np.concatenate(list(held.values())), return_counts=True)
            often = docs >= max(COMMON_DOCS, COMMON_SHARE * len(held))
            held.clear()
            n = int(often.sum())
            return pa.RecordBatch.from_arrays([pa.array([1] * n, pa.int32()), _long(every[often]), _long(docs[often]), *[_long([0] * n)] * 3], names)

        thin: set[int] = set()
        size = 0
        for part, sets in _sets(batches):
            ids = [identity(s) for s in sets]
            n = part.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([0] * n, pa.int32()), part.column(0), _long([len(s) for s in sets]), _long([i[0] for i in ids]), _long([i[1] for i in ids]), part.column(1)], names)
            for s, (v, _) in zip(sets, ids, strict=True):
                if len(s) and v not in held:
                    held[v] = s
                    size += len(s)
                    for band, high, most in _roles(len(s)):
                        if len(_places(s, _segments(band, high, frozenset()))) < most:
                            thin.add(band)
                if size > 1 << 21:
                    yield common()
                    size = 0
        if held:
            yield common()
        bands = sorted(thin)
        yield pa.RecordBatch.from_arrays([pa.array([2] * len(bands), pa.int32()), *[_long(bands)] * 5], names)

    return documents.select("doc_id", F.xxhash64("text").alias("t"), "text").mapInArrow(tidy(run), "kind int, a long, b long, c long, d long, t long")


def _members(documents: DataFrame, common, wide: frozenset[int]) -> DataFrame:
    """key, v, n: the segments that each set joins by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Common(common.value)
        for _, sets in _sets(batches):
            keys, vertex, size, seen = [np.zeros(0, U)], [], [], set()
            for s in sets:
                v = identity(s)[0] if len(s) > 3 else None
                if v is None or v in seen:
                    continue
                seen.add(v)
                for own in band_keys(s, known, wide):
                    keys.append(own)
                    vertex.append(np.full(len(own), v, np.int64))
                    size.append(np.full(len(own), len(s), np.int32))
            if vertex:
                yield pa.RecordBatch.from_arrays([_long(np.concatenate(keys)), _long(np.concatenate(vertex)), pa.array(np.concatenate(size))], ["key", "v", "n"])

    return documents.select("text").mapInArrow(tidy(run), "key long, v long, n int")


def _similar_size(n1: np.ndarray, n2: np.ndarray) -> np.ndarray:
    return 100 * np.minimum(n1, n2) >= 80 * np.maximum(n1, n2)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key: pairs a < b of small buckets (kind 0), members b of large ones with key a (kind 1)."""
    names = ["kind", "a", "b", "na", "nb"]
    key, v, n = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    large: int | None = None

    def row(kind: int, a, b, na, nb) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), *map(_long, (a, b, na.astype(np.int64), nb.astype(np.int64)))], names)

    def done(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal key, v, n, large
        fresh = np.r_[True, (key[1:] != key[:-1]) | (v[1:] != v[:-1])][: len(key)]
        key, v, n = key[fresh], v[fresh], n[fresh]
        if not len(key):
            return
        begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[begin, len(key)])
        many = np.repeat((size > EXPANDED) | (key[begin] == large if large is not None else False), size)
        keep = 0 if last or many[-1] else size[-1]
        large = int(key[-1]) if many[-1] else large
        stop = len(key) - keep
        yield row(1, key[:stop][many[:stop]], v[:stop][many[:stop]], n[:stop][many[:stop]], n[:stop][many[:stop]])
        few = ~many[:stop]
        k, w, m = key[:stop][few], v[:stop][few], n[:stop][few]
        for gap in range(1, EXPANDED):
            hit = np.flatnonzero(k[gap:] == k[:-gap])
            if not len(hit):
                break
            hit = hit[_similar_size(m[hit], m[hit + gap])]
            x, y, p, q = w[hit], w[hit + gap], m[hit], m[hit + gap]
            turn = x > y
            yield row(0, np.where(turn, y, x), np.where(turn, x, y), np.where(turn, q, p), np.where(turn, p, q))
        key, v, n = key[stop:], v[stop:], n[stop:]

    for b in batches:
        key, v, n = (np.r_[old, b.column(i).to_numpy().astype(np.int64)] for i, old in enumerate((key, v, n)))
        yield from done(False)
    yield from done(True)


def _filter_of(ids: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter of so many bits over a column id, as 64-bit words."""
    places = [F.pmod(F.xxhash64("id", F.lit(i)), F.lit(bits)) for i in range(2)]
    set_bits = ids.select(F.explode(F.array(*places)).alias("p")).select(
        F.shiftright("p", 6).alias("word"), F.expr("shiftleft(1L, CAST(p & 63 AS INT))").alias("bit")
    )
    got = set_bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    words = np.zeros(bits // 64, np.int64)
    words[got["word"].to_numpy()] = got["bits"].to_numpy()
    return words


def _texts_of(documents: DataFrame, ids: DataFrame) -> tuple[DataFrame, Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]]:
    """Rows, and what a task does first to have text of the documents with the given ids and of a few others: a filter, or nothing after a join if there are too many ids."""
    documents = documents.where("doc_id IS NOT NULL")
    n = ids.count()
    bits = max(1 << 16, 1 << (FILTER_SHARE * n).bit_length())
    if bits > FILTER_MOST:
        return documents.join(ids.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").select("text"), iter
    words = documents.sparkSession.sparkContext.broadcast(_filter_of(ids, bits))

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            there = np.ones(b.num_rows, bool)
            for column in (0, 1):
                p = b.column(column).to_numpy()
                there &= (words.value[p >> 6] >> (p & 63) & 1).astype(bool)
            yield b.filter(pa.array(there)).select(["text"])

    places = [F.pmod(F.xxhash64("doc_id", F.lit(i)), F.lit(bits)).alias(f"p{i}") for i in range(2)]
    return documents.select(*places, "text"), chosen


def _sets_of(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """v, fold, sketch, shingles of the documents with the given ids (and of a few others), once for each vertex."""
    rows, chosen = _texts_of(documents, ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _sets(chosen(batches)):  # in one function, as each task has a Python worker for each of a chain
            columns = [
                _long([identity(s)[0] for s in sets]), pa.array([folded_sketch(s) for s in sets], pa.binary()),
                pa.array([dense_sketch(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["v", "fold", "sketch", "shingles"])

    found = rows.mapInArrow(tidy(run), "v long, fold binary, sketch binary, shingles binary")
    return materialise(found.dropDuplicates(["v"]), "sets", True)


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, na, nb, linked, low, high (bounds of the Jaccard distance) of each pair."""

    def attach(rows: DataFrame, column: str) -> DataFrame:
        for side in ("a", "b"):
            rows = rows.join(sets.select(F.col("v").alias(side), F.col(column).alias(f"{column}_{side}")), side)
        return rows.select("a", "b", "na", "nb", f"{column}_a", f"{column}_b")

    def result(b: pa.RecordBatch, common: np.ndarray, exact: bool) -> pa.RecordBatch:
        both = b.column(2).to_numpy() + b.column(3).to_numpy()
        union = both - common
        low = 1 - common / np.maximum(1, union)
        linked = 100 * common >= 80 * union
        return pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(linked), pa.array(low), pa.array(low if exact else np.ones(len(low)))], ["a", "b", "na", "nb", "linked", "low", "high"])

    def by_sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            far = np.array([sketch_distance(x.as_buffer(), y.as_buffer()) for x, y in zip(b.column(4), b.column(5), strict=True)], np.int64)
            both = b.column(2).to_numpy() + b.column(3).to_numpy()
            yield result(b, (both - far) // 2, False)

    def by_set(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            common = np.array([np.intersect1d(np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U), assume_unique=True).size for x, y in zip(b.column(4), b.column(5), strict=True)], np.int64)
            yield result(b, common, True)

    schema = "a long, b long, na long, nb long, linked boolean, low double, high double"
    possible = materialise(attach(pairs, "sketch").mapInArrow(tidy(by_sketch), schema), "sketched", True)
    exact = attach(possible.where("linked").select("a", "b", "na", "nb"), "shingles").mapInArrow(tidy(by_set), schema)
    return materialise(exact.union(possible.where("NOT linked")), "verified", True)


def _ordered(a: str, b: str, na: str, nb: str) -> list:
    return [
        F.least(a, b).alias("a"), F.greatest(a, b).alias("b"),
        F.when(F.col(a) < F.col(b), F.col(na)).otherwise(F.col(nb)).alias("na"), F.when(F.col(a) < F.col(b), F.col(nb)).otherwise(F.col(na)).alias("nb"),
    ]


def _near(left: pa.Table, right: pa.Table) -> pa.Table:
    """Pairs of a block of open members and a block of members, of different components, whose bounds allow a link."""
    v1, n1, r1, l1, h1 = (left[c].to_numpy() for c in ("v", "n", "root", "low", "high"))
    v2, n2, r2, l2, h2 = (right[c].to_numpy() for c in ("v", "n", "root", "low", "high"))
    f1, f2 = (np.frombuffer(b"".join(t["fold"].to_pylist()), U).reshape(-1, FOLD) for t in (left, right))
    settled = r2 == right["main"].to_numpy()
    out: list[list[np.ndarray]] = [[], [], [], []]
    for i in range(len(v1)):
        may = (r2 != r1[i]) & (settled | (v2 > v1[i])) & _similar_size(n1[i], n2) & (l1[i] - h2 <= 0.2000001) & (l2 - h1[i] <= 0.2000001)
        at = np.flatnonzero(may)
        at = at[9 * np.bitwise_count(f1[i] ^ f2[at]).sum(1, dtype=np.int64) <= n1[i] + n2[at]]
        if len(at):
            turn = v1[i] > v2[at]
            same = np.full(len(at), v1[i]), np.full(len(at), n1[i])
            for part, column in zip(out, (np.where(turn, v2[at], same[0]), np.where(turn, same[0], v2[at]), np.where(turn, n2[at], same[1]), np.where(turn, same[1], n2[at])), strict=True):
                part.append(column)
    return pa.table([pa.array(np.concatenate([np.zeros(0, np.int64), *part]).astype(np.int64)) for part in out], names=["a", "b", "na", "nb"])


def _links(documents: DataFrame, reps: DataFrame, found: DataFrame) -> DataFrame:
    """a, b of linked vertices, enough of them to connect all that are linked. reps: v, id."""
    pairs = found.where("kind = 0").select("a", "b", "na", "nb")
    large = found.where("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("v"), F.col("nb").alias("n"))
    degree = large.groupBy("v").agg(F.count(F.lit(1)).alias("degree"))
    pivots = large.join(degree, "v").groupBy("key").agg(F.max(F.struct("degree", "v", "n")).alias("p"))
    pivots = materialise(pivots.select("key", F.col("p.v").alias("pivot"), F.col("p.n").alias("pn")), "pivots", True)
    stars = large.join(pivots, "key").where("v <> pivot").select("v", "pivot", "n", "pn").distinct()
    first = pairs.union(stars.select(*_ordered("v", "pivot", "n", "pn"))).distinct()
    first = materialise(first, "pairs", True)
    vertices = first.select(F.col("a").alias("v")).union(first.select("b")).distinct()
    sets = _sets_of(documents, vertices.join(reps, "v").select("id"))
    verified = _verify(first, sets)
    links = verified.where("linked").select("a", "b")
    if large.isEmpty():
        return links
    roots = materialise(components(links), "roots", True)
    ends = verified.select(F.col("a").alias("v"), F.col("b").alias("pivot"), "low", "high").union(verified.select("b", "a", "low", "high"))
    placed = large.join(pivots, "key").select("pivot", "v", "n").distinct()
    placed = placed.join(ends, ["v", "pivot"], "left").join(roots, "v", "left")
    placed = placed.join(roots.select(F.col("v").alias("pivot"), F.col("root").alias("main")), "pivot", "left").select(
        "pivot", "v", "n", F.coalesce("root", "v").alias("root"), F.coalesce("main", "pivot").alias("main"),
        F.coalesce("low", F.lit(0.0)).alias("low"), F.coalesce("high", F.lit(0.0)).alias("high"),
    )
    groups = placed.groupBy("pivot").agg(F.count(F.lit(1)).alias("m"), F.count_if(F.col("root") != F.col("main")).alias("open")).where("open > 0")
    placed = placed.join(groups.select("pivot", F.ceil(F.col("m") / BLOCK).alias("blocks")), "pivot").join(sets.select("v", "fold"), "v")
    placed = materialise(placed.withColumn("own", F.pmod(F.xxhash64("v"), F.col("blocks"))), "placed", True)
    columns = ["v", "n", "root", "main", "low", "high", "fold"]
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    x = placed.where("root <> main").select("pivot", F.col("own").alias("i"), every.alias("j"), *columns)
    y = placed.select("pivot", every.alias("i"), F.col("own").alias("j"), *columns)
    keys = ["pivot", "i", "j"]
    second = x.groupBy(*keys).cogroup(y.groupBy(*keys)).applyInArrow(_near, "a long, b long, na long, nb long").distinct()
    second = second.join(verified.select("a", "b"), ["a", "b"], "left_anti")
    second = materialise(second, "pairs", True)
    return links.union(_verify(second, sets).where("linked").select("a", "b"))


def _classes(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, t (hash of the text), root (of the class; null without one), component_id of every document."""
    spark = documents.sparkSession
    bound_batches(spark)
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    survey = materialise(_survey(documents), "survey")
    docs = survey.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("n_shingles"), "t", F.col("c").alias("v"), F.col("d").alias("check"))
    reps = docs.where("doc_id IS NOT NULL AND n_shingles > 0").groupBy("v").agg(
        F.min("doc_id").alias("id"), F.min("check").alias("c1"), F.max("check").alias("c2")
    )
    reps = materialise(reps, "vertices", True)
    if not reps.where("c1 <> c2").isEmpty():
        raise RuntimeError("two different sets have one 64-bit name; change the multiplier in words.py")
    common = survey.where("kind = 1").groupBy("a").agg(F.sum("b").alias("n")).orderBy(F.desc("n"), "a").limit(COMMON_MOST).select("a").toArrow()
    common = np.sort(common["a"].to_numpy().view(U)) if common.num_rows else np.zeros(0, U)
    wide = frozenset(r["a"] for r in survey.where("kind = 2").select("a").distinct().collect())
    members = _members(documents, spark.sparkContext.broadcast(common), wide)
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = members.repartition(partitions, "key").sortWithinPartitions("key", "n", "v")
    found = materialise(dealt.mapInArrow(tidy(_scan), "kind int, a long, b long, na long, nb long").distinct(), "found", True)
    roots = components(_links(documents, reps, found))
    placed = reps.join(roots, "v", "left").select("v", "id", F.coalesce("root", "v").alias("root"))
    placed = materialise(placed, "placed", True)
    least = placed.groupBy("root").agg(F.min("id").alias("component_id"))
    of_vertex = placed.join(least, "root").select("v", "root", "component_id")
    own = F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component_id"))).otherwise(F.col("doc_id"))
    return docs.join(of_vertex, "v", "left").select("doc_id", "n_shingles", "t", "root", own.alias("component_id"))


def similar_documents(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links) of every document.

    Words are runs of bytes other than space and \\t to \\r, A-Z as a-z. Defined
    cases: fewer than five words make one shingle; a text that is null or has no
    words is empty and linked with nothing; a row without doc_id is returned with
    a null component_id and links nothing; repeated rows are returned each;
    an empty table gives no rows; other columns are ignored.
    """
    return _classes(documents).select("doc_id", "n_shingles", "component_id")


def without_near_duplicates(documents: DataFrame) -> DataFrame:
    """Of each class of linked documents the one with the smallest doc_id, with all its columns.

    Defined cases: where the smallest doc_id stands on several texts of the class,
    the text with the smallest hash stays; a doc_id on texts of different classes
    stays once in each; rows that repeat both doc_id and text are one row; rows
    without doc_id, and without words (but for repeated ones), all stay; an empty
    table gives no rows.
    """
    classes = _classes(documents).where("doc_id IS NOT NULL")
    chosen = classes.where("n_shingles > 0").groupBy("root").agg(F.min(F.struct("doc_id", "t")).alias("kept")).select("kept.doc_id", "kept.t")
    kept = chosen.union(classes.where("n_shingles = 0").select("doc_id", "t")).distinct()
    name = "t_"
    while name in documents.columns:
        name += "_"
    marked = documents.withColumn(name, F.xxhash64("text"))
    same = (marked["doc_id"].cast("long") == kept["doc_id"]) & (marked[name] == kept["t"])
    named = marked.join(kept, same, "left_semi").dropDuplicates(["doc_id", name]).select(*documents.columns)
    return named.unionByName(documents.where("doc_id IS NULL"))
