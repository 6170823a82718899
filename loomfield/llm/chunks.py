"""Content-defined chunks of texts: cuts where a rolling hash of the last bytes is small, so equal passages are cut alike wherever they stand."""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that the rolling hash covers, hashed at a time, and of a chunk at least and at most; a cut falls on one of so many places.
ROLLED, WINDOW = 32, 1 << 18
LEAST, MOST, ONE_IN = 128, 4096, 512
U = np.uint64
_BYTE = np.random.default_rng(20240513).integers(1, 1 << 63, 256, np.uint64) * U(2) + U(1)
_FACTOR = 0x9E3779B97F4A7C15
_POWERS = np.multiply.accumulate(np.full(WINDOW, _FACTOR, U))
_BACK = np.multiply.accumulate(np.full(WINDOW, pow(_FACTOR, -1, 1 << 64), U))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 13, 32]] = True


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a batch of texts (null: none), and where each text begins; one more at the end."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]] if buffers[2] is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def _places(data: np.ndarray) -> np.ndarray:
    """Places after which the hash of the last ROLLED bytes is small, and no character is cut."""
    found = []
    for at in range(0, max(0, len(data) - ROLLED), WINDOW - ROLLED):
        part = data[at : at + WINDOW]
        total = np.cumsum(_BYTE[part] * _POWERS[: len(part)])
        rolled = (total[ROLLED:] - total[:-ROLLED]) * _BACK[ROLLED : len(part)]
        found.append(np.flatnonzero(rolled >> U(40) < U((1 << 24) // ONE_IN)) + at + ROLLED + 1)
    places = np.concatenate(found) if found else np.zeros(0, np.int64)
    places = places[places < len(data)]
    return places[data[places] & 0xC0 != 0x80]


def chunk_ends(data: np.ndarray, offsets: np.ndarray) -> list[list[int]]:
    """The ends of each text's chunks. They depend on the bytes since a chunk's begin alone, so a repeated passage is cut alike after its first cut."""
    places, out = _places(data).tolist(), []
    n = 0
    for begin, end in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        ends, at = [], begin
        while end - at > LEAST:
            n = bisect_left(places, at + LEAST, n)
            cut = places[n] if n < len(places) else end
            if cut > at + MOST:
                cut = at + MOST
                while cut < end and data[cut] & 0xC0 == 0x80:
                    cut += 1
            if cut >= end:
                break
            ends.append(cut)
            at = cut
        if end > begin:
            ends.append(end)
        out.append(ends)
    return out


def chunk_keys(data: np.ndarray, begins: list[int], ends: list[int]) -> np.ndarray:
    """(n, 2) names of chunks, of 128 bits."""
    held = memoryview(np.ascontiguousarray(data))
    digests = b"".join([hashlib.blake2b(held[a:b], digest_size=16).digest() for a, b in zip(begins, ends, strict=True)])
    return np.frombuffer(digests, np.int64).reshape(-1, 2)


def breaks(data: np.ndarray) -> np.ndarray:
    """Places after white space, in order."""
    return np.flatnonzero(_SPACE[data]) + 1
