"""Words and shingles of whole texts as 64-bit hashes, by array operations on the bytes of a batch.

A word is a run of bytes other than space and \\t to \\r; A-Z count as a-z. Its
hash is a polynomial in a fixed multiplier over random values of its bytes,
modulo 2**64, from differences of one running sum, and then mixed. Equal words
have equal hashes wherever they stand; different words have different ones but
for a chance of about 2**-60 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes hashed at a time; a longer word extends its window.
WINDOW = 1 << 18
U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, np.uint64) * U(2) + U(1)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_MULTIPLIER = 0x9E3779B97F4A7C15 | 5
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64."""
    known = _powers.get(base)
    if known is None or len(known) <= n:
        size = max(n, WINDOW) + 1
        known = np.full(size, base & ((1 << 64) - 1), U)
        known[0] = 1
        _powers[base] = known = np.multiply.accumulate(known)
    return known


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _windows(space: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about WINDOW bytes that end after white space or at the end."""
    at = 0
    while at < len(space):
        end = at + WINDOW
        if end < len(space):
            back = np.flatnonzero(space[at:end][::-1][:65536])
            if len(back):
                end -= int(back[0])
            else:
                after = np.flatnonzero(space[end:])
                end = end + int(after[0]) + 1 if len(after) else len(space)
        yield at, min(end, len(space))
        at = end


def word_hashes(texts: pa.Array, first: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a batch of texts (null: no words), and where each text's words begin; one more at the end.

    With ``first``, hashes has a row of whole words and one of the words' first n bytes for each n.
    """
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]] if buffers[2] is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    space = _SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True  # a text's first byte begins a word
    hashes, places = [np.zeros((1 + len(first), 0), U)], [np.zeros(0, np.int64)]
    for a, b in _windows(space | edge[1:]):
        gap = space[a:b]
        starts = np.flatnonzero(~gap & (np.r_[True, gap[:-1]] | edge[a:b]))
        ends = np.flatnonzero(~gap & (np.r_[gap[1:], True] | edge[a + 1 : b + 1])) + 1
        total = np.empty(b - a + 1, U)
        total[0] = 0
        np.cumsum(_BYTE[data[a:b]] * _power(_MULTIPLIER, b - a)[: b - a], out=total[1:])
        back = _power(_INVERSE, b - a)[starts]
        stops = [ends, *[np.minimum(starts + n, ends) for n in first]]
        hashes.append(np.stack([mix((total[e] - total[starts]) * back) for e in stops]))
        places.append(starts + a)
    found = np.concatenate(hashes, axis=1)
    return (found if first else found[0]), np.searchsorted(np.concatenate(places), offsets)


_WEIGHTS = [U(mix(np.array([i + 1], U))[0] | U(1)) for i in range(64)]


def shingle_sets(words: np.ndarray, begins: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles of ``width`` words; of fewer words, the one of all of them."""
    n = np.diff(begins)
    rolled = np.zeros(max(0, len(words) - width + 1), U)
    for i in range(width):
        rolled += words[i : len(words) - width + 1 + i] * _WEIGHTS[i] if len(rolled) else rolled
    rolled = mix(rolled)
    out = []
    for at, size in zip(begins[:-1].tolist(), n.tolist(), strict=True):
        if size >= width:
            out.append(np.unique(rolled[at : at + size - width + 1]))
        elif size:
            own = words[at : at + size]
            out.append(mix(np.array([sum(int(w) * int(_WEIGHTS[i]) for i, w in enumerate(own)) + size * int(_WEIGHTS[63]) & (1 << 64) - 1], U)))
        else:
            out.append(np.zeros(0, U))
    return out
