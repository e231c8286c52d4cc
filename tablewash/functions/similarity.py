"""String similarity: bounds as native expressions, the LCS length as an Arrow UDF.

``ratio(a, b) = 100 * (1 - indel(a, b) / (len(a) + len(b)))`` where ``indel`` is
the number of insertions and deletions, ``len(a) + len(b) - 2 * lcs(a, b)``.
The weighted score takes, with r = longer / shorter length,

* r < 1.5: the larger of ``ratio`` and 0.95 times the best token form,
* 1.5 <= r <= 8: the larger of ``ratio``, 0.9 times the best window of the longer
  string (``partial_ratio``) and 0.855 times its token forms,
* r > 8: the same with 0.6 for 0.9.

At the two fixed cutoffs of the library this reduces to integer comparisons.
At 90, with r < 1.5: ``10 * indel <= total`` on the texts, ``19 * indel <= total``
on their sorted words or, shared words aside, on the words that differ, or
shared words that all but make up the shorter list; with r >= 1.5 only a
contained text reaches 90.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewash.functions import patterns as P

# Workers get the two scorers by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TOKEN_BREAK = rf"[{P.SPACE}]+"


def _char_masks(text: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, ch in enumerate(text):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    return masks


def _lcs(masks: dict[str, int], n: int, other: str) -> int:
    """Bit-parallel LCS length (Crochemore et al. 2001, Hyyrö 2004) on one big integer."""
    row = full = (1 << n) - 1
    for ch in other:
        hit = row & masks.get(ch, 0)
        if hit:
            row = ((row + hit) | (row - hit)) & full
    return n - row.bit_count()


def lcs_of(a: str, b: str) -> int:
    return _lcs(_char_masks(a), len(a), b)


def partial_of(short: str, long: str) -> float:
    """Best ratio (0..100) of ``short`` against the windows of ``long``.

    Windows have the length of ``short``, or are shorter prefixes and suffixes.
    A window that starts or ends outside the letters of ``short`` never wins.
    """
    n, m = len(short), len(long)
    masks = _char_masks(short)
    best = 0.0
    for start in range(1 - n, m):
        lo, hi = max(0, start), min(m, start + n)
        if long[hi - 1 if start <= m - n else lo] not in masks:
            continue
        total = n + hi - lo
        if 1 - (total - 2 * min(n, hi - lo)) / total <= best:
            continue
        best = max(best, 1 - (total - 2 * _lcs(masks, n, long[lo:hi])) / total)
        if best == 1.0:
            break
    return best * 100


# Pairs whose shorter text has at most this many letters are scored together, one 64-bit word each.
WORD_BITS = 64
# Letters of one block of pairs, and windows scored at once.
BLOCK, WINDOWS = 1 << 20, 1 << 17


def _letters(texts: list[str], width: int) -> np.ndarray:
    """The code points of each text in a row of ``width``, zeros after its end."""
    packed = "".join(t.ljust(width, "\0") for t in texts).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(packed, np.uint32).reshape(len(texts), width)


def _lcs_words(short: list[str], long: list[str]) -> np.ndarray:
    """LCS lengths of pairs whose first text fits into one word: the bit-parallel step for all pairs at once."""
    n, m = np.array([len(t) for t in short]), np.array([len(t) for t in long])
    width = -(-max(1, int(n.max())) // 8) * 8
    a, b = _letters(short, width), _letters(long, max(1, int(m.max())))
    full = np.where(n == 64, ~np.uint64(0), (np.uint64(1) << (n % 64).astype(np.uint64)) - np.uint64(1))
    row, bits = full.copy(), np.zeros((len(short), 8), np.uint8)
    for j in range(b.shape[1]):
        bits[:, :width // 8] = np.packbits(a == b[:, j:j + 1], axis=1, bitorder="little")
        hit = np.where(j < m, row & bits.view(np.uint64).ravel(), np.uint64(0))
        row = ((row + hit) | (row - hit)) & full
    return n - np.bitwise_count(row)


def lcs_lengths(a: list[str], b: list[str]) -> np.ndarray:
    """LCS lengths of many pairs; pairs of like length are worked on together."""
    pairs = [(x, y) if len(x) <= len(y) else (y, x) for x, y in zip(a, b, strict=True)]
    out = np.zeros(len(pairs), np.int64)
    fits = [i for i, (x, _) in enumerate(pairs) if len(x) <= WORD_BITS]
    for i, (x, y) in enumerate(pairs):
        if len(x) > WORD_BITS:
            out[i] = lcs_of(x, y)
    fits.sort(key=lambda i: len(pairs[i][1]))
    at = 0
    while at < len(fits):
        # The last pair of a block has the longest text.
        end = at + 1
        while end < len(fits) and (end + 1 - at) * max(WORD_BITS, len(pairs[fits[end]][1])) <= BLOCK:
            end += 1
        block = fits[at:end]
        out[block] = _lcs_words([pairs[i][0] for i in block], [pairs[i][1] for i in block])
        at = end
    return out


def ratios(a: list[str], b: list[str]) -> np.ndarray:
    """0..100 for each pair; two empty texts are 100."""
    total = np.array([len(x) + len(y) for x, y in zip(a, b, strict=True)])
    safe = np.maximum(total, 1)
    return np.where(total == 0, 100.0, (1 - (total - 2 * lcs_lengths(a, b)) / safe) * 100)


def partial_ratios(a: list[str], b: list[str]) -> np.ndarray:
    """The best ratio of the shorter text of each pair against the windows of the longer; see :func:`partial_of`."""
    out = np.zeros(len(a))
    held: list[tuple[int, str, str]] = []

    def score() -> None:
        if held:
            owners, shorts, windows = zip(*held, strict=True)
            np.maximum.at(out, list(owners), ratios(list(shorts), list(windows)))
            held.clear()

    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        short, long = (x, y) if len(x) <= len(y) else (y, x)
        n, m = len(short), len(long)
        if n > WORD_BITS or not n:
            out[i] = partial_of(short, long) if n else (0.0 if m else 100.0)
            continue
        if short in long:
            out[i] = 100.0
            continue
        known = set(short)
        for start in range(1 - n, m):
            lo, hi = max(0, start), min(m, start + n)
            if long[hi - 1 if start <= m - n else lo] in known:
                held.append((i, short, long[lo:hi]))
        if len(held) > WINDOWS:
            score()
    score()
    return out


def weighted_scores(a: list[str], b: list[str]) -> np.ndarray:
    """The weighted score of each pair, 0 where a text is empty; the definition stands at the top."""
    out = ratios(a, b)
    words = [(x.split(), y.split()) for x, y in zip(a, b, strict=True)]
    sizes = [(min(len(x), len(y)), max(len(x), len(y))) for x, y in zip(a, b, strict=True)]
    out[[i for i, (s, _) in enumerate(sizes) if not s]] = 0.0
    near = [i for i, (s, l) in enumerate(sizes) if s and 2 * l < 3 * s]
    far = [i for i, (s, l) in enumerate(sizes) if s and 2 * l >= 3 * s]
    joined = [(" ".join(sorted(x)), " ".join(sorted(y))) for x, y in words]
    sets = [(set(x), set(y)) for x, y in words]
    rest = [(" ".join(sorted(x - y)), " ".join(sorted(y - x))) for x, y in sets]

    def raise_to(rows: list[int], scores: np.ndarray, scale: float) -> None:
        if rows:
            out[rows] = np.maximum(out[rows], scores * scale)

    raise_to(near, ratios([joined[i][0] for i in near], [joined[i][1] for i in near]), 0.95)
    common = lcs_lengths([rest[i][0] for i in near], [rest[i][1] for i in near])
    raise_to(near, np.array([_set_ratio(*sets[i], *rest[i], int(n)) for i, n in zip(near, common, strict=True)]), 0.95)
    scale = np.array([0.9 if sizes[i][1] <= 8 * sizes[i][0] else 0.6 for i in far])
    raise_to(far, partial_ratios([a[i] for i in far], [b[i] for i in far]) * scale, 1.0)
    whole = partial_ratios([joined[i][0] for i in far], [joined[i][1] for i in far])
    apart = partial_ratios([rest[i][0] for i in far], [rest[i][1] for i in far])
    both = np.array([100.0 if sets[i][0] & sets[i][1] else 0.0 for i in far])
    worded = np.array([bool(sets[i][0] and sets[i][1]) for i in far], bool)
    tokens_best = np.where(both > 0, both, np.maximum(whole, apart))
    raise_to(far, np.where(worded, tokens_best, 0.0) * 0.95 * scale, 1.0)
    return out


def _set_ratio(x: set[str], y: set[str], dx: str, dy: str, common: int) -> float:
    """The best of: differing words beside the shared ones, and the shared ones against either side."""
    if not x or not y:
        return 0.0
    both = x & y
    if both and (not dx or not dy):
        return 100.0
    shared = len(" ".join(both))
    gap = 1 if both else 0
    lx, ly = shared + gap + len(dx), shared + gap + len(dy)
    best = (1 - (len(dx) + len(dy) - 2 * common) / (lx + ly)) * 100
    if both:
        best = max(best, (1 - (1 + len(dx)) / (shared + lx)) * 100, (1 - (1 + len(dy)) / (shared + ly)) * 100)
    return best


def _scored(fn, left: pd.Series, right: pd.Series, dtype: str) -> pd.Series:
    """Scores of the pairs without a NULL; NULL for the others."""
    known = (left.notna() & right.notna()).to_numpy()
    out = pd.Series([None] * len(left), dtype=dtype)
    if known.any():
        out[known] = fn(left[known].tolist(), right[known].tolist())
    return out


@F.pandas_udf(T.IntegerType())
def _lcs_length(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for left, right in batches:
        yield _scored(lcs_lengths, left, right, "Int32")


@F.pandas_udf(T.DoubleType())
def _partial_ratio(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for short, long in batches:
        yield _scored(partial_ratios, short, long, "Float64")


@F.pandas_udf(T.DoubleType())
def _weighted(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for left, right in batches:
        yield _scored(weighted_scores, left, right, "Float64")


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence; NULL if either side is NULL."""
    return _lcs_length(a, b)


def partial_ratio(short: Column, long: Column) -> Column:
    return _partial_ratio(short, long)


def indel_ratio(a: Column, b: Column) -> Column:
    """0..100; two empty texts are 100."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(100.0)).otherwise(
        (1 - (total - 2 * lcs_length(a, b)) / total) * 100
    )


PREPROCESS = ("none", "default")


def preprocessed(c: Column, preprocess: str) -> Column:
    """``none``: the text as it is; ``default``: lower case, a space for all but letters and digits, stripped."""
    if preprocess not in PREPROCESS:
        raise ValueError(f"unknown preprocessing {preprocess!r}: use one of {PREPROCESS}")
    return c if preprocess == "none" else F.trim(F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]", " ")))


def wratio(a: Column, b: Column, preprocess: str = "none") -> Column:
    """The weighted score, 0..100; NULL if either side is NULL, 0 if either is empty."""
    return _weighted(preprocessed(a, preprocess), preprocessed(b, preprocess))


def tokens(c: Column) -> Column:
    """White-space separated words."""
    return F.filter(F.split(c, TOKEN_BREAK), lambda t: t != "")


def joined(words: Column) -> Column:
    return F.array_join(words, " ")


def letters(c: Column) -> Column:
    """The characters of a text in sorted order, without white space.

    The distance of two such texts bounds the indel distance from below, in
    whatever order the words stand.
    """
    bare = F.regexp_replace(c, TOKEN_BREAK, "")
    return F.array_join(F.array_sort(F.split(bare, "")), "")


def no_farther(a: Column, b: Column, allowed: Column) -> Column:
    """Native necessary bound for ``indel(a, b) <= allowed``: Levenshtein is never larger."""
    allowed = allowed.cast("int")
    near = F.abs(F.length(a) - F.length(b)) <= allowed
    # With a threshold the function stops early and returns -1 beyond it.
    return near & (F.call_function("levenshtein", a, b, F.greatest(allowed, F.lit(0))) >= 0)
