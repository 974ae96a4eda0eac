"""Texts of a batch as arrays: code points, words, shingles and their hashes.

Hashes are the same in every process and do not depend on the other texts of a batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = 32
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def code_points(texts: list[str], before: int = 1, after: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts, each between spaces, and the place where each text's part starts (n + 1)."""
    lowered = [t.lower() for t in texts]
    pad, end = " " * before, " " * after
    sizes = np.fromiter((len(t) + before + after for t in lowered), np.int64, len(lowered))
    joined = "".join(f"{pad}{t}{end}" for t in lowered)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return points, np.concatenate([[0], np.cumsum(sizes)])


def is_kind(points: np.ndarray, kind) -> np.ndarray:
    """For each code point whether `kind`, a test of one character, holds."""
    small = np.array([kind(chr(c)) for c in range(0x250)])
    out = np.zeros(len(points), dtype=bool)
    low = points < 0x250
    out[low] = small[points[low]]
    if not low.all():
        values, inverse = np.unique(points[~low], return_inverse=True)
        out[~low] = np.array([kind(chr(c)) for c in values.tolist()], dtype=bool)[inverse]
    return out


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (letters, digits, underscores; lower-cased) in order, and each text's first word (n + 1)."""
    points, starts = code_points(texts, 1, 1)
    inside = is_kind(points, lambda c: c.isalnum() or c == "_")
    first = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    chars = np.flatnonzero(inside)
    word = np.searchsorted(first, chars, side="right") - 1
    place = chars - first[word]
    values = mixed(points[chars].astype(np.uint64) + GOLDEN * (place + 1).astype(np.uint64))
    heads = np.flatnonzero(place == 0)
    return mixed(np.add.reduceat(values, heads)), np.searchsorted(first, starts)


def run_hashes(values: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of `size` values, by the place where it starts."""
    n = len(values) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i in range(size):
        total = total * np.uint64(0x100000001B3) + values[i:i + n]
    return mixed(total)


#: Bytes with A-Z as a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_set(values: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(values)] = True
    return out


def split_words(column: pa.Array, blank: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Words between `blank` bytes of a column of strings, A-Z as a-z.

    Returns each word's code, the distinct words in the order of their codes, each word's row and first byte, and all
    bytes of the column one after the other. A null string is empty.
    """
    column = pc.fill_null(column, "").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    inside = ~blank[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    rows = offsets[:-1][np.diff(offsets) > 0]
    first[rows] = inside[rows]
    starts = np.flatnonzero(first)
    letters = LOWER[data[inside]]
    begins = np.append(np.cumsum(inside, dtype=np.int64)[starts] - 1, len(letters))
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(begins), pa.py_buffer(letters)])
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary, np.searchsorted(offsets, starts, side="right") - 1, starts, data


def byte_hashes(words: pa.Array, seeds: np.ndarray | int = 0) -> np.ndarray:
    """Hashes of a large_binary array of words that are not empty."""
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset:words.offset + len(words) + 1]
    if not len(words):
        return np.zeros(0, np.uint64)
    data = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    offsets = offsets - offsets[0]
    place = np.arange(1, len(data) + 1) - np.repeat(offsets[:-1], np.diff(offsets))
    values = mixed(data + GOLDEN * place.astype(np.uint64))
    return mixed(mixed(np.add.reduceat(values, offsets[:-1])) + np.asarray(seeds, np.uint64))


def planes(numbers: np.ndarray) -> bytes:
    """32-bit numbers with all their lowest bytes first, then the next ones: small numbers compress well so."""
    return numbers.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<i4").reshape(-1)
