"""Word BPE with chunk reuse: passages that stand in several places are encoded once.

Texts are cut by content (``chunks``). Chunks that occur more than once are
encoded as rows of their own, each distinct one once; everything else is encoded
where it stands. A chunk ends anywhere, also within a word, so its ids hold only
between its first and its last white space: there a text can be parted without
changing the ids on either side. A join of chunks is repaired by encoding again
what lies around it; the window grows to the nearest such place on both sides,
over whole chunks that have none, so that its ids agree with those of the whole
text at both ends. The ids of a text are then put together, in order, as they
stream through a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfield.llm.chunks import breaks, bytes_of, chunk_ends, chunk_keys
from loomfield.llm.packing import WordTokenizer
from loomfield.llm.tables import bound_batches, materialise, slices, tidy

#: Bits of the filter of repeated chunks: about so many for each, and at most (32 MB); what passes it wrongly is encoded as a chunk, too.
BITS_EACH, MOST_BITS = 16, 1 << 28
#: Chunks whose text a task sends on once only, as it remembers them.
REMEMBERED = 200_000

PARTS = "row long, doc_id long, part long, k1 long, k2 long, text string, ids binary, sizes array<int>, n_tokens long, ids_sha256 string, decoded_sha256 string"
NAMES = [f.split()[0] for f in PARTS.split(", ")]
TYPES = [pa.int64()] * 5 + [pa.string(), pa.binary(), pa.list_(pa.int32()), pa.int64(), pa.string(), pa.string()]
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class Codec(WordTokenizer):
    """Ids of texts, and the text that the library decodes from ids: the tokens with spaces between them."""

    def __init__(self, path: str):
        super().__init__(path)
        self.tokens = [(self.library.id_to_token(i) or "").encode() for i in range(max(self.library.get_vocab().values()) + 1)]
        self.narrow = "<u2" if len(self.tokens) <= 1 << 16 else "<u4"

    def digest(self, ids: np.ndarray, so_far: tuple | None = None) -> tuple:
        """Number of ids, and hashes of ids and of decoded bytes, with what came before."""
        n, ids_hash, decoded = so_far or (0, hashlib.sha256(), hashlib.sha256())
        if len(ids):
            ids_hash.update(ids.astype("<u4").tobytes())
            decoded.update((b" " if n else b"") + b" ".join(map(self.tokens.__getitem__, ids.tolist())))
        return n + len(ids), ids_hash, decoded


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec for each vocabulary file in a worker."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def chunk_counts(documents: DataFrame) -> DataFrame:
    """k1, k2 (the chunk's name), count of all chunks of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, 0):
                data, offsets = bytes_of(part.column(0))
                cuts = chunk_ends(data, offsets)
                ends = [e for own in cuts for e in own]
                begins = [e for start, own in zip(offsets[:-1].tolist(), cuts, strict=True) for e in [start, *own[:-1]][: len(own)]]
                keys = chunk_keys(data, begins, ends)
                yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1])], ["k1", "k2"])

    return documents.select("text").mapInArrow(tidy(run), "k1 long, k2 long").groupBy("k1", "k2").count()


def repeated_filter(counts: DataFrame) -> np.ndarray:
    """A bit array, of bounded size, in which the places of all chunks that occur twice or more are set."""
    held = materialise(counts.where("count > 1").select("k1"), "repeated", True)
    bits = 1 << 10
    while bits < MOST_BITS and bits < BITS_EACH * held.count():
        bits *= 2
    place = F.col("k1").bitwiseAND(F.lit(bits - 1))
    words = held.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(k1 & 63 AS INT))")).alias("set")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[words["word"].to_numpy()] = words["set"].to_numpy()
    return out.view(np.uint64)


def _passes(filter_: np.ndarray, keys: np.ndarray) -> np.ndarray:
    place = keys[:, 0] & (len(filter_) * 64 - 1)
    return (filter_[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) > 0


def _inner(data: np.ndarray, offsets: np.ndarray, filter_: np.ndarray) -> list[list[tuple[int, int, int, int]]]:
    """Of each text the inner parts (begin, end, and the two halves of the name) of its repeated chunks, in order."""
    cuts = chunk_ends(data, offsets)
    begins = [e for start, own in zip(offsets[:-1].tolist(), cuts, strict=True) for e in [start, *own[:-1]][: len(own)]]
    ends = [e for own in cuts for e in own]
    keys, places = chunk_keys(data, begins, ends), breaks(data)
    first, last = np.searchsorted(places, np.array(begins, np.int64), "right"), np.searchsorted(places, np.array(ends, np.int64), "right") - 1
    use = np.flatnonzero(_passes(filter_, keys) & (first < last))
    found = np.c_[places[first[use]], places[last[use]], keys[use]].tolist() if len(use) else []
    borders = np.searchsorted(use, np.cumsum([0, *map(len, cuts)]))
    return [[tuple(f) for f in found[a:b]] for a, b in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True)]


def _parted(shared, path: str, whole_ids: bool):
    """Of each document its digests, if it has no repeated chunk; else a row for each one (part, from 0), and one (part -1) with the ids of what lies before, between and after them.

    Beside them stands the text of each repeated chunk. With ``whole_ids`` all documents come as ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sent = codec(path), set()
        for b in batches:
            for part in slices(b, 2, 512):
                data, offsets = bytes_of(part.column(2))
                held, inner = data.tobytes(), _inner(data, offsets, shared.value)
                gaps = []  # of each document the texts that are encoded here
                for found, start, stop in zip(inner, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    gaps.append([held[a:z].decode() for a, z in zip([start, *[f[1] for f in found]], [*[f[0] for f in found], stop], strict=True)])
                ids = iter(own.encode([t for texts in gaps for t in texts]))
                rows = []
                for row, doc_id, found, texts in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), inner, gaps, strict=True):
                    mine = [np.frombuffer(next(ids), "<u4") for _ in texts]
                    if not found and not whole_ids:
                        n, a, z = own.digest(mine[0])
                        rows.append((row, doc_id, None, None, None, None, None, None, n, a.hexdigest(), z.hexdigest()))
                        continue
                    rows.append((row, doc_id, -1, None, None, None, np.concatenate(mine).astype(own.narrow).tobytes(), list(map(len, mine)), None, None, None))
                    for n, (a, z, *key) in enumerate(found):
                        rows.append((row, None, n, *key, *[None] * 6))
                        if tuple(key) not in sent:
                            if len(sent) >= REMEMBERED:
                                sent.clear()
                            sent.add(tuple(key))
                            rows.append((None, None, None, *key, held[a:z].decode(), *[None] * 5))
                columns = zip(*rows, strict=True) if rows else [()] * len(NAMES)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, TYPES, strict=True)], NAMES)

    return run


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for b in batches:
            for part in slices(b, 2, 4096):
                ids = [np.frombuffer(i, "<u4").astype(own.narrow).tobytes() for i in own.encode(part.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(ids, pa.binary())], ["k1", "k2", "ids"])

    return run


def _pieced(documents: DataFrame, path: str, whole_ids: bool = False) -> tuple[DataFrame, DataFrame]:
    """What ``_parted`` gives, written; and row, doc_id, part, ids, sizes of its documents in parts, those of each row together in order."""
    spark: SparkSession = documents.sparkSession
    bound_batches(spark)
    named = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shared = spark.sparkContext.broadcast(repeated_filter(chunk_counts(named)))
    rows = named.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    parted = materialise(rows.mapInArrow(tidy(_parted(shared, path, whole_ids)), PARTS), "parts", codec="zstd")
    texts = parted.where("row IS NULL").groupBy("k1", "k2").agg(F.first("text").alias("text"))
    chunks = texts.mapInArrow(tidy(_encoded(path)), "k1 long, k2 long, ids binary")
    again = parted.where("row IS NOT NULL AND k1 IS NOT NULL").select("row", "part", "k1", "k2").join(chunks, ["k1", "k2"])
    between = parted.where("part = -1").select("row", "doc_id", "part", "ids", "sizes")
    both = between.unionByName(again.select("row", "part", "ids"), allowMissingColumns=True)
    return parted, both.repartition("row").sortWithinPartitions("row", "part")


def _in_order(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[tuple[int | None, list[np.ndarray], bool]]:
    """doc_id, the ids of the next stretches of a document, and whether they are its last."""
    doc, gaps, n = None, None, 0
    for b in batches:
        for doc_id, part, ids, sizes in zip(*[b.column(c).to_pylist() for c in (1, 2, 3, 4)], strict=True):
            own = np.frombuffer(ids, kind)
            if part < 0:
                doc, gaps, n = doc_id, np.split(own, np.cumsum(sizes)[:-1]), 1
                yield doc, [gaps[0]], n == len(gaps)
            else:
                n += 1
                yield doc, [own, gaps[n - 1]], n == len(gaps)


def encode_words(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, ids array<int> and decoded string of every text; cases as for ``word_token_digests``."""
    _, pieces = _pieced(documents, path, True)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = codec(path), []
        for doc, ids, last in _in_order(batches, own.narrow):
            held += ids
            if last:
                whole = np.concatenate(held)
                held.clear()
                text = b" ".join(map(own.tokens.__getitem__, whole.tolist())).decode()
                yield pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), pa.array([whole.astype(np.int32)], pa.list_(pa.int32())), pa.array([text])], ["doc_id", "ids", "decoded"])

    return pieces.mapInArrow(tidy(join), "doc_id long, ids array<int>, decoded string")


def word_token_digests(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text, by the vocabulary file at ``path``.

    Defined cases: a null or empty text has no ids; repeated rows give repeated
    rows; texts of any length are encoded whole, cut anywhere but put together
    without a difference; a text without white space is one window; special tokens'
    strings in a text count as the library takes them; an empty table gives no
    rows; other columns are ignored.
    """
    parted, pieces = _pieced(documents, path)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, state, done = codec(path), None, []
        for doc, stretches, last in _in_order(batches, own.narrow):
            for ids in stretches:
                state = own.digest(ids, state)
            if last:
                done.append((doc, state[0], state[1].hexdigest(), state[2].hexdigest()))
                state = None
                if len(done) >= 4096:
                    yield _digests(done)
                    done = []
        yield _digests(done)

    whole = parted.where("n_tokens IS NOT NULL").select(*[f.split()[0] for f in DIGESTS.split(", ")])
    return whole.union(pieces.mapInArrow(tidy(join), DIGESTS))


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * 4
    names = [f.split()[0] for f in DIGESTS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int64(), pa.string(), pa.string()], strict=True)], names)
