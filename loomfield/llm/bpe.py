"""Byte-level BPE by longest matches and backtracking.

Bytes map to Latin-1 characters, so that an Aho-Corasick automaton over strings
finds, in one pass, the longest token that begins at each byte. Encoding takes
longest tokens and steps back to the next shorter one where two neighbours
cannot stand side by side in the exact merge order. Whether they can is decided
on the two tokens alone, and remembered; places that lead nowhere are marked, so
the work is linear in the piece.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import islice

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from loomfield.llm.tables import bound_batches, slices

#: Pieces, and pairs, that a worker remembers twice over, and characters of the longest piece remembered (some 180 MB in all).
REMEMBERED, LONGEST = 200_000, 32
#: Matches handled at a time, whatever the length of a text.
STEP = 1 << 16
NEVER = 1 << 62


class BytePairCodec:
    """Encodes and decodes by a rank file; ``pattern`` splits texts into pieces."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.token = {i: t for t, i in self.rank.items()}
        self.pattern = regex.compile(pattern)
        self.automaton = ahocorasick.Automaton()
        for t, i in self.rank.items():
            self.automaton.add_word(t.decode("latin-1"), (i, len(t)))
        self.automaton.make_automaton()
        self.shorter: dict[int, int | None] = {}
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.edges: tuple[dict[int, list], dict[int, list]] = ({}, {})
        # two generations of each: when the newer one is full it becomes the older one, and what is met again comes back from there
        self.pairs: list[dict[int, bool]] = [{}, {}]
        self.pieces: list[dict[str, tuple[str, int, bytes]]] = [{}, {}]

    def _next_shorter(self, i: int) -> int | None:
        """The longest token that the bytes of token i begin with, other than itself."""
        if i not in self.shorter:
            t = self.token[i]
            self.shorter[i] = next((self.rank[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.rank), None)
        return self.shorter[i]

    def _split(self, i: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes token i; None for a byte, and for a token that merges never make."""
        if i not in self.parts:
            t, self.parts[i] = self.token[i], None
            parts = [t[n : n + 1] for n in range(len(t))]
            while len(parts) > 2:
                low, at = min((self.rank.get(parts[n] + parts[n + 1], NEVER), n) for n in range(len(parts) - 1))
                if low >= i:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            if len(parts) == 2:
                self.parts[i] = (self.rank[parts[0]], self.rank[parts[1]])
        return self.parts[i]

    def _edge(self, i: int, side: int) -> list[tuple[bytes, int]]:
        """From the outermost byte of token i on its right (side 1) or left (side 0) up to i: bytes, and rank of the next merge."""
        found = self.edges[side]
        if i not in found:
            chain = [i]
            while (parts := self._split(chain[-1])) is not None:
                chain.append(parts[side])
            chain.reverse()
            found[i] = [(self.token[c], up) for c, up in zip(chain, [*chain[1:], NEVER], strict=True)]
        return found[i]

    def stand_together(self, left: int, right: int) -> bool:
        """Whether exact merging of the bytes of both leaves just these two tokens.

        Walks the merges next to the seam in the order of ranks. The seam goes if
        the pieces that touch it can merge before either merges away from it; at
        equal ranks the merge further left comes first.
        """
        key = left << 32 | right
        known = self.pairs[0].get(key)
        if known is None:
            known = self.pairs[1].get(key)
            if known is not None:
                self.pairs[0][key] = known
        if known is None:
            a, b, x, y = self._edge(left, 1), self._edge(right, 0), 0, 0
            known = True
            while True:
                (p, up_p), (q, up_q) = a[x], b[y]
                seam = self.rank.get(p + q, NEVER)
                if seam < up_p and seam <= up_q and seam < NEVER:
                    known = False
                    break
                if up_p == up_q == NEVER:
                    break
                if up_p <= up_q:
                    x += 1
                else:
                    y += 1
            if len(self.pairs[0]) >= REMEMBERED:
                self.pairs = [{}, self.pairs[0]]
            self.pairs[0][key] = known
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        if piece in self.rank and len(piece) == 1:
            return [self.rank[piece]]
        longest: list[int] = [0] * len(piece)
        for end, (i, n) in self.automaton.iter(piece.decode("latin-1")):
            longest[end - n + 1] = i  # later ends are longer
        dead, out, ends, pos, take = bytearray(len(piece) + 1), [], [], 0, longest[0]
        while pos < len(piece):
            while take is not None:
                end = pos + len(self.token[take])
                if not dead[end] and (not out or self.stand_together(out[-1], take)):
                    break
                take = self._next_shorter(take)
            if take is None:
                dead[pos] = 1
                take = self._next_shorter(out.pop())
                ends.pop()
                pos = ends[-1] if ends else 0
            else:
                out.append(take)
                ends.append(end)
                pos = end
                take = longest[pos] if pos < len(piece) else None
        return out

    def encode(self, text: str) -> list[int]:
        return [i for p in self.pattern.findall(text) for i in self.encode_piece(p.encode())]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.token[i] for i in ids])

    def _digested(self, piece: str) -> tuple[str, int, bytes]:
        found = self.pieces[0].get(piece) or self.pieces[1].get(piece)
        if found is None:
            ids = self.encode_piece(piece.encode())
            found = (",".join(map(str, ids)), len(ids), self.decode(ids))
        if len(piece) <= LONGEST:
            if len(self.pieces[0]) >= REMEMBERED:
                self.pieces = [{}, self.pieces[0]]
            self.pieces[0][piece] = found
        return found

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids joined by commas, SHA-256 of the bytes decoded from them."""
        ids_hash, bytes_hash, n = hashlib.sha256(), hashlib.sha256(), 0
        matches = self.pattern.finditer(text) if len(text) > STEP else None
        pieces = [m.group() for m in islice(matches, STEP)] if matches else self.pattern.findall(text)
        while pieces:
            got = list(map(self.pieces[0].get, pieces))
            if None in got:
                got = [g or self._digested(p) for p, g in zip(pieces, got, strict=True)]
            ids, sizes, decoded = zip(*got, strict=True)
            ids_hash.update((("," if n else "") + ",".join(ids)).encode())
            bytes_hash.update(b"".join(decoded))
            n += sum(sizes)
            pieces = [m.group() for m in islice(matches, STEP)] if matches else None
        return n, ids_hash.hexdigest(), bytes_hash.hexdigest()


_codecs: dict[tuple[str, str], BytePairCodec] = {}


def codec(path: str, pattern: str) -> BytePairCodec:
    """One codec for each rank file in a worker."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = BytePairCodec(path, pattern)
    return _codecs[path, pattern]


def encode_documents(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids array<int> and decoded binary of every text.

    Defined cases: a null text is empty; repeated rows give repeated rows; a text
    of any length is encoded whole; an empty table gives no rows; other columns
    are ignored.
    """
    bound_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for b in batches:
            for part in slices(b, 1, 256):
                ids = [own.encode(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([own.decode(i) for i in ids], pa.binary())], ["doc_id", "ids", "decoded"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def token_digests(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text.

    Defined cases: a null text is empty (no ids); repeated rows give repeated
    rows; an empty table gives no rows; other columns are ignored.
    """

    bound_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for b in batches:
            found = [own.digest(t.as_py() or "") for t in b.column(1)]
            n, ids, decoded = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
