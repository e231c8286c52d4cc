"""Words and 64-bit hashes of whole Arrow batches of text, in numpy.

Texts are handled as UTF-8 bytes.  Only A-Z is lower-cased, and the separators
below are ASCII, so a byte table decides every character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
# Words are runs without ASCII white space.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
# Words are runs of digits, a-z and non-ASCII characters (after lower-casing).
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[:128] = True
NOT_ALNUM[48:58] = NOT_ALNUM[97:123] = False

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int, base: np.uint64 = MULTIPLIER) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


# One random 64-bit value for each byte value.
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * MULTIPLIER)
_POWERS = powers(4096)


def slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in slices of about ``limit`` bytes of text, one row at least."""
    if not batch.num_rows:
        return
    data, off = utf8(batch.column(column))
    del data
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each begins (one more entry at the end). NULL is empty."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    arr = column.cast(pa.binary())
    if arr.null_count:
        arr = arr.fill_null(b"")
    _, offsets, data = arr.buffers()
    off = np.frombuffer(offsets, np.int32, len(arr) + 1, arr.offset * 4).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def words(data: np.ndarray, off: np.ndarray, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all words; no word goes over the end of a text."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~separators[data]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    first, last = off[:-1], off[1:] - 1
    first, last = first[first < last + 1], last[first < last + 1]
    begin[first] = inside[first]
    end[last] = inside[last]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each of the disjoint, ascending, non-empty byte spans."""
    global _POWERS
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    if lens.max() > len(_POWERS):
        _POWERS = powers(int(lens.max()) * 2)
    begins = np.concatenate([[0], np.cumsum(lens)[:-1]])
    within = np.arange(int(lens.sum())) - np.repeat(begins, lens)
    values = BYTE_VALUES[data[within + np.repeat(starts, lens)]]
    values *= _POWERS[within]
    return mix(np.add.reduceat(values, begins) + lens.astype(np.uint64))


def counts_by_text(starts: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where the words of each text begin in the list of all words (one more entry at the end)."""
    return np.searchsorted(starts, off)


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of the k words from each position on; the last k - 1 positions have none."""
    n = max(0, len(hashes) - k + 1)
    out = np.zeros(n, np.uint64)
    for j, p in enumerate(powers(k + 1)[1:]):
        out += hashes[j:j + n] * p
    return mix(out)


def shingles(word_hashes: np.ndarray, k: int) -> np.ndarray:
    """The sorted set of a text's k-word shingles; a shorter text is one shingle."""
    if 0 < len(word_hashes) < k:
        return mix(gram_hashes(word_hashes, len(word_hashes)) + np.uint64(len(word_hashes)))
    return np.unique(gram_hashes(word_hashes, k))
