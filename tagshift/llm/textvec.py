"""Array forms of many texts at once: hashed words, word prefixes and byte trigrams.

``PIECE`` bytes of text are worked on at a time, so memory does not grow with the batch; a single
longer text is a piece by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

PIECE = 2_000_000
_POWERS = (np.uint64(0x9E3779B97F4A7C15) ** np.arange(1, 65, dtype=np.uint64)).astype(np.uint64)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def pieces(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """(first place, encoded texts) of consecutive texts with about PIECE bytes."""
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        body = (text or "").encode()
        if held and size + len(body) > PIECE:
            yield first, held
            first, held, size = i, [], 0
        held.append(body)
        size += len(body)
    if held:
        yield first, held


def joined(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, with a line end behind each text; place of each text's first byte)."""
    starts = np.cumsum([0] + [len(b) + 1 for b in bodies[:-1]])
    return np.frombuffer(b"\n".join(bodies) + b"\n", np.uint8), starts


def word_spans(data: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes for which the table ``is_word`` holds; the last byte is no such byte."""
    inside = is_word[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate([[0], edge])
    return edge[::2], edge[1::2]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    place = np.arange(len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))[: len(data)] if starts[0] == 0 else None
    if place is None:
        place = np.arange(len(data))
        place[starts[0]:] -= np.repeat(starts, np.diff(np.append(starts, len(data))))
    weighed = (data.astype(np.uint64) + np.uint64(1)) * _POWERS[place & 63]
    if lengths.max() > 64:
        # the power follows the whole place: a stretch of 64 bytes takes the 64th power of the base
        stretch = _POWERS[63] ** np.arange(place.max() // 64 + 1, dtype=np.uint64)
        weighed *= stretch[place >> 6]
    sums = np.concatenate([[np.uint64(0)], np.cumsum(weighed, dtype=np.uint64)])
    return mixed(sums[ends] - sums[starts] + lengths.astype(np.uint64))


def prefix_hashes(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """64-bit hash of the first ``length`` bytes of each span; all spans must be that long."""
    out = np.full(len(starts), np.uint64(length << 8), np.uint64)
    for j in range(length):
        out += (data[starts + j].astype(np.uint64) + np.uint64(1)) * _POWERS[j]
    return mixed(out + np.uint64(0x5851F42D4C957F2D))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    return x ^ (x >> np.uint64(27))
