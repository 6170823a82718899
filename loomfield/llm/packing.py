"""Order-preserving packing by dynamic programming over cut places.

The documents of a task, in their order, form one line of token ids. Cuts may
fall at document ends, at sentence ends and, dearer, on a grid of places. The
cost of a sequence is its padding plus the penalty of the cut that ends it; the
padding of a sequence of b - a ids is size - (b - a), or none at a power of two.
The best start of a sequence that ends at b is the smallest cost(a) + a within
the window, kept in a monotone queue, or one of the few places a power of two
before b. Each place enters and leaves the queue once.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from loomfield.llm.tables import bound_batches, slices, tidy

#: Ids that end each document.
END_ID = 1
#: Penalties, in ids of padding, of cuts at a sentence end and within a sentence.
SENTENCE_CUT, TRUNCATION = 4.0, 12.0
#: Distance of the grid places.
GRID = 128
#: Ids, at least, that are packed together; a task closes its sequences after each such block.
BLOCK_IDS = 1 << 20
#: Words that a worker remembers twice over, and bytes of the longest of them (at most about 20 MB).
REMEMBERED, LONGEST = 40_000, 40
#: Characters encoded at a time, and documents of a slice.
WINDOW, STEP = 1 << 20, 512

#: Kinds of characters and word endings in the split pattern, the special tokens of the
#: vocabulary file, and the characters on which its normalisation is lower-casing alone.
LETTERS, NUMBERS = "a-zªµºß-öø-ÿ", "0-9²³¹¼-¾"
ENDINGS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")
WORD_END, SENTENCE_ENDS = "</w>", ".!?"
SPECIAL = ("<|startoftext|>", "<|endoftext|>")
UNUSUAL = re.compile(r"[^\t\n\r\x20-\x7e¡-ÿ]")
BLANK = re.compile(r"[\t\n\r\x20]")
LETTER, NUMBER, OTHER = 1, 2, 3
KINDS = np.array(
    [0 if chr(c).isspace() else LETTER if re.match(f"[{LETTERS}]", chr(c)) else NUMBER if re.match(f"[{NUMBERS}]", chr(c)) else OTHER for c in range(256)], np.uint8
)

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _windows(text: str) -> list[str]:
    """The text in parts of about WINDOW characters that end after white space, across which no word reaches."""
    out, at = [], 0
    while len(text) - at > WINDOW:
        space = BLANK.search(text, at + WINDOW)
        if not space:
            break
        out.append(text[at : space.end()])
        at = space.end()
    return [*out, text[at:]]


class WordTokenizer:
    """Ids of a vocabulary file by its library, each distinct word of a slice of texts looked up or merged once.

    Texts are split into words by array operations on their Latin-1 bytes; texts
    with other characters go to the library whole.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.library = Tokenizer.from_file(path)
        vocabulary = self.library.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.marks = self.ends_word.copy()
        for token, i in vocabulary.items():
            self.ends_word[i] = token.endswith(WORD_END)
            self.marks[i] = any(c in SENTENCE_ENDS for c in token)
        spelled = ByteLevel(add_prefix_space=False, use_regex=False)
        self.spelling = {c: spelled.pre_tokenize_str(chr(c))[0][0] for c in range(0xA1, 0x100)}
        # two generations: when the newer one is full it becomes the older one, and words met again come back from there
        self.remembered, self.newer, self.older = remembered, {}, {}

    def _ids_of(self, words: list[bytes]) -> list[bytes]:
        """The ids of each of some distinct words."""
        found = list(map(self.newer.get, words))
        for n, ids in enumerate(found):
            if ids is None:
                word = words[n]
                found[n] = ids = self.older.get(word) or self._merged(word)
                if len(word) <= LONGEST:
                    self.newer[word] = ids
        if len(self.newer) > self.remembered:
            self.older, self.newer = self.newer, {}
        return found

    def _merged(self, word: bytes) -> bytes:
        text = word.decode("latin-1")
        return array("I", [t.id for t in self.library.model.tokenize(text if text.isascii() else text.translate(self.spelling))]).tobytes()

    def _usual(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of texts of usual characters."""
        data = np.frombuffer("\n".join([*texts, ""]).lower().encode("latin-1"), np.uint8)
        kind = KINDS[data]
        begins = kind > 0
        begins[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
        mark = np.flatnonzero(begins & (data == ord("'")))
        after = data[np.minimum(mark[:, None] + [1, 2, 3], len(data) - 1)]
        for ending in ENDINGS:
            n = len(ending)
            at = mark[(after[:, :n] == np.frombuffer(ending, np.uint8)).all(1)]
            begins[at + 1] = False
            begins[at + 1 + n] = kind[at + 1 + n] > 0
        filled = kind > 0
        starts = np.flatnonzero(begins)
        offsets = np.append(np.cumsum(filled, dtype=np.int32)[starts] - 1, np.count_nonzero(filled)).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[filled])]).dictionary_encode()
        ids = self._ids_of(words.dictionary.to_pylist())
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        place = np.cumsum(sizes) - sizes
        code = words.indices.to_numpy()
        each = sizes[code]
        ends = np.cumsum(each)
        out = np.frombuffer(b"".join(ids), "<u4")[np.repeat(place[code] - (ends - each), each) + np.arange(ends[-1] if len(ends) else 0)]
        lines = np.cumsum([len(t) + 1 for t in texts])
        return np.split(out, np.append(0, ends)[np.searchsorted(starts, lines[:-1])])

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        parts = [_windows(t) for t in texts]
        flat = [p for own in parts for p in own]
        usual = [not (UNUSUAL.search(t) or any(s in t for s in SPECIAL)) for t in flat]
        found: list[np.ndarray] = []
        some = [t for t, u in zip(flat, usual, strict=True) if u]
        held, at = 0, 0
        for n, t in enumerate(some):
            held += len(t)
            if held >= WINDOW or n + 1 == len(some):
                found += self._usual(some[at : n + 1])
                at, held = n + 1, 0
        easy = iter(found)
        ids = iter([(next(easy) if u else np.array(self.library.encode(t, add_special_tokens=False).ids, "<u4")).tobytes() for t, u in zip(flat, usual, strict=True)])
        return [b"".join([next(ids) for _ in own]) for own in parts]

    def sentence_places(self, ids: bytes) -> np.ndarray:
        """The places after all words of punctuation that ends sentences; ids of one text, or of many, one after the other."""
        found = np.frombuffer(ids, "<u4")
        marks = np.flatnonzero(self.marks[found])
        if not len(marks):
            return marks
        ends = np.append(np.flatnonzero(self.ends_word[found]), len(found) - 1)
        places = ends[np.searchsorted(ends, marks)] + 1
        return places[np.r_[True, places[1:] != places[:-1]]]


def cut_places(sizes: list[int], sentences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted places of a line of documents where a cut may fall, and their penalties; sentence ends count within each document."""
    ends = np.cumsum(sizes)
    return line_places(ends, np.concatenate([s + (e - n) for s, e, n in zip(sentences, ends, sizes, strict=True)]) if sentences else ends[:0])


def line_places(ends: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``cut_places`` for sentence ends counted in the whole line."""
    total = int(ends[-1])
    grid = np.arange(GRID, total, GRID)
    tail = np.array([total - total % (1 << n) for n in range(12)])  # powers of two that use up the rest
    places = np.concatenate([[0], ends, inner, grid, tail[tail > 0]]).astype(np.int64)
    penalty = np.concatenate([[0.0], np.zeros(len(ends)), np.full(len(inner), SENTENCE_CUT), np.full(len(grid) + int((tail > 0).sum()), TRUNCATION)])
    order = np.lexsort((penalty, places))
    places, penalty = places[order], penalty[order]
    first = np.r_[True, np.diff(places) > 0]
    return places[first], penalty[first]


def best_cuts(places: np.ndarray, penalty: np.ndarray, size: int) -> list[int]:
    """The places, from first to last, that minimise padding plus penalties. Places lie at most ``size`` apart."""
    at, fee = places.tolist(), penalty.tolist()
    ends, starts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for power in [1 << n for n in range(size.bit_length()) if 1 << n <= size]:
        found = np.minimum(np.searchsorted(places, places - power), len(at) - 1)
        ends.append(np.flatnonzero(places[found] == places - power))
        starts.append(found[ends[-1]])
    order = np.argsort(np.concatenate(ends), kind="stable")
    exact = np.concatenate(starts)[order].tolist()
    first = np.searchsorted(np.concatenate(ends)[order], np.arange(len(at) + 1)).tolist()
    # cost[i] is that of the best cuts up to place i; reach[i] adds the place
    cost, reach, back, queue, head, value = [0.0], [0.0], [0], [], 0, 0.0
    for i in range(1, len(at)):
        while len(queue) > head and reach[queue[-1]] >= value:
            queue.pop()
        queue.append(i - 1)
        b = at[i]
        while at[queue[head]] < b - size:
            head += 1
        start = queue[head]
        least = reach[start] + size - b
        for j in exact[first[i] : first[i + 1]]:
            if cost[j] < least:
                least, start = cost[j], j
        least += fee[i]
        value = least + b
        cost.append(least)
        reach.append(value)
        back.append(start)
    cuts = [len(at) - 1]
    while cuts[-1]:
        cuts.append(back[cuts[-1]])
    return [at[i] for i in reversed(cuts)]


def _pieces(ids: list[int], line: bytes, ends: np.ndarray, sentences: np.ndarray, size: int, first_sequence: int) -> tuple[list[np.ndarray], int]:
    """Columns of the pieces of a block of documents whose ids end, in the line, at ``ends``, and the number of sequences."""
    cuts = np.array(best_cuts(*line_places(ends, sentences), size), np.int64)
    starts = ends - np.diff(np.append(0, ends))
    begin = np.union1d(cuts[:-1], starts)
    length = np.diff(np.append(begin, ends[-1]))
    doc, sequence = np.searchsorted(ends, begin, "right"), np.searchsorted(cuts, begin, "right") - 1
    held = memoryview(line)
    crc = np.array([zlib.crc32(held[4 * a : 4 * (a + n)]) for a, n in zip(begin.tolist(), length.tolist(), strict=True)], np.int64)
    own = (ends - starts)[doc]
    return [pa.array(ids).take(pa.array(doc)), begin - starts[doc], length, crc, own, first_sequence + sequence, begin - cuts[sequence]], len(cuts) - 1


_tokenizers: dict[str, WordTokenizer] = {}


def pack_documents(documents: DataFrame, path: str, size: int = 2048) -> DataFrame:
    """Pack all documents, in the order in which tasks read them, into sequences of at most ``size`` ids.

    Returns a row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset. Each task packs what it reads, in blocks of about a
    million ids, so nothing is shuffled; the padding a block can leave at its end
    is used up by sequences of powers of two. Defined cases: a null text is
    empty and gives the one id 1; repeated rows are packed each; texts of any
    length are cut; an empty table gives no rows; other columns are ignored.
    """

    bound_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _tokenizers.setdefault(path, None) or WordTokenizer(path)
        _tokenizers[path] = own
        sequence, end = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40, np.array([END_ID], "<u4").tobytes()
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        doc_ids: list[int | None] = []
        ids: list[bytes] = []
        held = 0

        def close() -> pa.RecordBatch:
            nonlocal sequence
            line, ends = b"".join(ids), np.cumsum([len(i) // 4 for i in ids])
            columns, n = _pieces(doc_ids, line, ends, own.sentence_places(line), size, sequence)
            sequence += n
            doc_ids.clear()
            ids.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

        for b in batches:
            for part in slices(b, 1, STEP):
                for doc_id, found in zip(part.column(0).to_pylist(), own.encode([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    doc_ids.append(doc_id)
                    ids.append(found + end)
                    held += len(found) // 4 + 1
                    if held >= BLOCK_IDS:
                        yield close()
                        held = 0
        if ids:
            yield close()

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), SCHEMA)
