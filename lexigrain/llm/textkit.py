"""Vectorised word and shingle hashing shared by the text operators.

Texts of a batch are laid end to end in one byte array; words, word hashes and
shingle hashes are then found with whole-array numpy steps, so no Python loop
runs per word.  All hashes are 64 bits and the same on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

SHINGLE_WORDS = 5
#: Bytes of text hashed at once; bounds the working memory of a task.
CHUNK_BYTES = 1 << 19

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the whole word (in place)."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _seeded(n: int, seed: int) -> np.ndarray:
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_BASE) + np.uint64(seed))


_BYTE_VALUE = _seeded(256, 17)
_PLACE = _seeded(SHINGLE_WORDS, 99) | np.uint64(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _powers:
        _powers.clear()
        up, down = np.full(size, _BASE, dtype=np.uint64), np.full(size, _BASE_INVERSE, dtype=np.uint64)
        up[0] = down[0] = 1
        _powers[size] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return _powers[size]


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges [start, end) of ``data``."""
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    up, down = _power_tables(len(data))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_VALUE[data] * up[: len(data)], out=sums[1:])
    out = (sums[ends] - sums[starts]) * down[starts]
    return mix64(out + (ends - starts).astype(np.uint64) * np.uint64(_BASE))


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes other than blank and 09-0D (hex)."""
    solid = np.zeros(len(data) + 2, dtype=np.int8)
    solid[1:-1] = ~_IS_SPACE[data]
    step = np.diff(solid)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def text_chunks(texts: Sequence[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``limit`` bytes together, one text at least."""
    begin = total = 0
    for i, t in enumerate(texts):
        if i > begin and total + len(t) > limit:
            yield begin, i
            begin, total = i, 0
        total += len(t) + 1
    if begin < len(texts):
        yield begin, len(texts)


def batch_words(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in order, and the number of words of each text."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    starts, ends = word_bounds(data)
    limits = np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)))
    counts = np.diff(np.searchsorted(starts, limits), prepend=0)
    return hash_words(data, starts, ends), counts


def windows(words: np.ndarray, n: int = SHINGLE_WORDS) -> np.ndarray:
    """Hashes of the n-word windows of one text in order; a shorter text is one window; none without words."""
    if not len(words):
        return words
    width = min(n, len(words))
    m = len(words) - width + 1
    out = np.full(m, width, dtype=np.uint64)
    for k in range(width):
        out += words[k : k + m] * _PLACE[k]
    return mix64(out)


def slices(batch, rows: int = 256):
    """A record batch in parts of so many rows, so that only one part is held as Python objects."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def tidied(run):
    """A batch function that gives unused Arrow memory back when its task ends; workers live on between tasks."""

    def inner(batches):
        import pyarrow as pa

        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return inner


def lowered(text: str | None) -> bytes:
    """UTF-8 of a text with A-Z in lower case and nothing else changed; b"" for null."""
    return text.encode("utf-8", "replace").lower() if text else b""


def shingle_sets(texts: Sequence[str | None], n: int = SHINGLE_WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, in the texts' order."""
    data = [lowered(t) for t in texts]
    for begin, end in text_chunks(data):
        words, counts = batch_words(data[begin:end])
        at = 0
        for c in counts:
            yield np.unique(windows(words[at : at + c], n))
            at += c
