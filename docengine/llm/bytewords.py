"""Vectorised words and word n-grams over blocks of UTF-8 text.

The word classes used in this package are either sets of ASCII characters or "anything but these ASCII
characters", so a word can be found byte by byte: every byte of a multi-byte character is a word byte.
Words are hashed with a polynomial over a table of random 64-bit values, from prefix sums modulo 2**64, and
finished with a mixing step; equal words have equal hashes in every process.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once. A longer text is a block of its own.
BLOCK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.default_rng(20240607).integers(1, 1 << 63, 1 << 8, dtype=np.uint64) | np.uint64(1)

#: [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ once A-Z are lower-cased: digits, a-z and everything beyond ASCII.
ALNUM = np.array([b >= 128 or chr(b) in "0123456789abcdefghijklmnopqrstuvwxyz" for b in range(256)])
#: [^\\x20\\x09-\\x0D]+
SOLID = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)

#: Of glibc; other systems have none.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def handing_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` over a task's batches; then the worker hands what is free back to the system. Workers are kept for later
    tasks and stages, and what one has taken would else stand beside what the JVM and the other workers take then."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            hand_back()

    return whole


def hand_back() -> None:
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse, kept for the process."""
    if len(_powers[0]) < n:
        size = max(n, BLOCK_BYTES + 1)
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def blocks(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with their texts' bytes and offsets; a null text is empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = pc.fill_null(batch.column(batch.schema.get_field_index(column)).cast(pa.large_string()), "")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        held = texts.buffers()[2]
        data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
        i = 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
            yield batch.slice(i, j - i), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            i = j


def spans(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True that do not cross a text's end: starts, ends, and the text of each."""
    first, last = member.copy(), member.copy()
    first[1:] &= ~member[:-1]
    last[:-1] &= ~member[1:]
    edges = offsets[(offsets > 0) & (offsets < len(member))]
    first[edges] = member[edges]
    last[edges - 1] = member[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; the spans are in order. About BLOCK_BYTES are looked at at once, however long
    a text or a word is."""
    out = np.zeros(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = int(np.searchsorted(ends, starts[i] + BLOCK_BYTES, "right"))
        if j <= i:
            out[i] = _long_hash(data[starts[i] : ends[i]])
            i += 1
            continue
        part = data[starts[i] : ends[j - 1]]
        up, down = powers(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_TABLE[part] * up[: len(part)], out=sums[1:])
        first = starts[i:j] - starts[i]
        out[i:j] = (sums[ends[i:j] - starts[i]] - sums[first]) * down[first]
        i = j
    return mixed(out)


def _long_hash(data: np.ndarray) -> int:
    total = 0
    for low in range(0, len(data), BLOCK_BYTES):
        part = data[low : low + BLOCK_BYTES]
        own = int((_TABLE[part] * powers(len(part))[0]).sum(dtype=np.uint64))
        total += own * pow(_BASE, low, 1 << 64)
    return total % (1 << 64)


def grams(words: np.ndarray, text_of: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``k`` consecutive words within one text, and the index of each one's first word."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * np.uint64(_BASE) + words[j : j + n]
    inside = np.flatnonzero(text_of[:n] == text_of[k - 1 :])
    return mixed(h[inside]), inside


def grams_at(words: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """The hashes that ``grams`` gives, of the ``k`` words from each start."""
    h = np.zeros(len(starts), np.uint64)
    for j in range(k):
        h = h * np.uint64(_BASE) + words[starts + j]
    return mixed(h)
