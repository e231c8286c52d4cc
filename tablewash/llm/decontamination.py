"""Benchmark passages in texts: CGK embedding, bit sampling and exact edit verification.

Words (lower-cased runs of letters and digits) are the symbols.  A text holds an item if one
of its windows of the item's size has an edit distance of at most ``share`` of the item's
words.  Three steps lead to the windows:

1. *Seeds.*  Such a window shares at least ``n - g + 1 - g * e`` word g-grams with the item
   (n words, e edits; at least 1 by the choice of g), on diagonals within ``e`` of its start.
   Windows without that many are left out; this loses nothing.
2. *CGK random walks.*  Each repetition reads window and item along a random walk whose steps
   are hashed from the repetition, the position and the word, which maps edit distance to
   Hamming distance, and samples ``SAMPLES`` positions of the walk.  The window is a candidate
   if it agrees with the item in any repetition.  ``REPEATS`` repetitions reach a recall of
   0.99 for a window whose walk agrees with the item's in 0.35 of the positions.
3. *Verification* by the exact edit distance.

Item grams are pushed into the scan while there are at most ``PUSHED_GRAMS`` of them; above
that all grams of the texts are shuffled to the items, with equal results.

Defined cases: NULL and wordless texts and items match nothing; a text shorter than an item
is one window; of equal distances the earliest window is reported; repeated items are one
item; repeated rows and rows without an id are reported each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .licenses import text_words
from .store import forget, written

SAMPLES, REPEATS = 2, 40
PUSHED_GRAMS = 4_000_000
WINDOWS = 16_384  # windows that walk together


def edits_allowed(n: int, share: float) -> int:
    return int(n * share)


def gram_size(n: int, share: float) -> int:
    """The largest size up to 3 of which any window within the allowed edits shares a gram."""
    e = edits_allowed(n, share)
    return max(1, min(3, n // (e + 1)))


def least_seeds(n: int, share: float) -> int:
    g = gram_size(n, share)
    return max(1, n - g + 1 - g * edits_allowed(n, share))


def item_grams(share: float):
    """Words and g-grams of each item; the gram's size is part of its hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, at = text_words(*tokens.utf8(batch.column("text")))
            rows = []
            for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
                if b == a:
                    continue
                n = int(b - a)
                g = gram_size(n, share)
                hashes = (tokens.gram_hashes(words[a:b], g) + np.uint64(g)).astype(np.int64)
                rows.append({"item": batch.column("item")[i].as_py(), "item_id": batch.column("item_id")[i].as_py(), "n": n,
                             "g": g, "least": least_seeds(n, share), "words": words[a:b].tobytes(), "grams": hashes.tolist()})
            schema = pa.schema([("item", pa.int64()), ("item_id", batch.schema.field("item_id").type), ("n", pa.int32()), ("g", pa.int32()),
                                ("least", pa.int32()), ("words", pa.binary()), ("grams", pa.list_(pa.int64()))])
            yield pa.RecordBatch.from_pylist(rows, schema)
    return run


def seeder(sizes: list[int], pushed: np.ndarray | None, least: int):
    """Grams of each text that are in an item, and the hashed words of texts with enough of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 32
        for batch in batches:
            for piece in tokens.slices(batch, "text"):
                words, at = text_words(*tokens.utf8(piece.column("text")))
                text_end = np.repeat(at[1:], np.diff(at))
                text = np.repeat(np.arange(piece.num_rows), np.diff(at))
                found = []
                for g in sizes:
                    hashes = tokens.gram_hashes(words, g) + np.uint64(g)
                    ok = np.arange(len(hashes)) + g <= text_end[:len(hashes)]
                    if pushed is not None:
                        ok &= pushed[np.minimum(np.searchsorted(pushed, hashes), len(pushed) - 1)] == hashes
                    start = np.flatnonzero(ok)
                    found.append((text[start], start - at[text[start]], hashes[start].astype(np.int64)))
                owner, start, hashes = (np.concatenate(x) for x in zip(*found, strict=True))
                order = np.argsort(owner, kind="stable")
                owner, start, hashes = owner[order], start[order], hashes[order]
                offsets = np.searchsorted(owner, np.arange(piece.num_rows + 1)).astype(np.int32)
                enough = np.diff(offsets) >= least
                seeds = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(
                    [pa.array(start.astype(np.int64)), pa.array(hashes)], ["start", "hash"]))
                own = [words[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + piece.num_rows)), piece.column("id"), seeds, pa.array(own, pa.binary())],
                    ["row", "id", "seeds", "words"]).filter(pa.array(enough, pa.bool_()))
                row += piece.num_rows
    return run


def step(words: np.ndarray, at: np.ndarray, ends: np.ndarray, repeat: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """What the CGK walks read at step j (0 beyond their end), and where they stand after it."""
    read = np.where(at < ends, words[np.minimum(at, len(words) - 1)], np.uint64(0))
    return read, at + (tokens.mix(read ^ np.uint64((repeat * 65_537 + j) * 2 + 1)) >> np.uint64(63)).astype(np.int64)


def item_walks(items: list[np.ndarray], repeat: int) -> tuple[np.ndarray, np.ndarray]:
    """The walk of each item (three steps a word, then 0), and how many of its steps read a word."""
    sizes = np.array([len(i) for i in items])
    words, at = np.concatenate(items), np.concatenate([[0], np.cumsum(sizes)[:-1]])
    ends = at + sizes
    out = np.zeros((len(items), 3 * int(sizes.max())), np.uint64)
    for j in range(out.shape[1]):
        read, at = step(words, at, ends, repeat, j)
        out[:, j] = np.where(j < 3 * sizes, read, np.uint64(0))
    return out, np.maximum(1, (out != 0).sum(axis=1))


def colliding(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray, items: list[np.ndarray]) -> np.ndarray:
    """Which windows of ``words`` agree with their item in the sampled positions of any repetition."""
    hit = np.zeros(len(starts), bool)
    for repeat in range(REPEATS):
        left = np.flatnonzero(~hit)
        if not len(left):
            break
        walked, alive = item_walks(items, repeat)
        # Positions after the item's own walk has ended hold nothing.
        drawn = tokens.mix(np.arange(1, SAMPLES + 1, dtype=np.uint64) + np.uint64(repeat * 1_000))[None] % alive[:, None].astype(np.uint64)
        drawn = np.sort(drawn.astype(np.int64), axis=1)
        at, done = starts[left], np.zeros(len(left), np.int64)
        # All windows walk to the next sampled position; those that differ there go no further.
        for k in range(SAMPLES):
            target = drawn[owner[left], k]
            for j in range(int(done.min(initial=0)), int(target.max(initial=0))):
                moving = np.flatnonzero((done <= j) & (j < target))
                at[moving] = step(words, at[moving], ends[left[moving]], repeat, j)[1]
            same = step(words, at, ends[left], repeat, 0)[0] == walked[owner[left], target]
            left, at, done = left[same], at[same], target[same]
        hit[left] = True
    return hit


def edit_distances(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, items: list[np.ndarray]) -> np.ndarray:
    """Levenshtein distance of each window of ``words`` to its item, all tables row by row together."""
    sizes, lens = np.array([len(i) for i in items], np.int64), ends - starts
    columns = np.arange(sizes.max(initial=0) + 1)
    padded = np.zeros((len(items), len(columns) - 1), np.uint64)
    for line, item in zip(padded, items, strict=True):
        line[:len(item)] = item
    row = np.repeat(columns[None], len(items), axis=0)
    out = np.where(lens == 0, sizes, 0)
    for i in range(1, int(lens.max(initial=0)) + 1):
        word = words[np.minimum(starts + i - 1, len(words) - 1)]
        nxt = np.minimum(row + 1, i + columns)
        nxt[:, 1:] = np.minimum(nxt[:, 1:], row[:, :-1] + (padded != word[:, None]))
        row = np.minimum.accumulate(nxt - columns, axis=1) + columns
        out = np.where(lens == i, row[np.arange(len(items)), sizes], out)
    return out


def window_starts(start: np.ndarray, position: np.ndarray, n_words: int, n: int, e: int, least: int) -> np.ndarray:
    """Starts of the windows with enough seeds near their diagonal."""
    diagonal = np.sort(start - position)
    last = max(0, n_words - n)
    near = np.unique(np.clip(np.unique(diagonal)[:, None] + np.arange(-e, e + 1), 0, last))
    # At the edges of the text windows cannot move on: seeds beyond count for the first and last one.
    lo = np.where(near == 0, np.iinfo(np.int64).min, near - e)
    hi = np.where(near == last, np.iinfo(np.int64).max, near + e)
    return near[np.searchsorted(diagonal, hi, "right") - np.searchsorted(diagonal, lo) >= least]


def window_groups(batch: pa.RecordBatch, share: float) -> Iterator[list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]]:
    """(pair, item words, text words, window starts) in groups of about ``WINDOWS`` windows."""
    group, size = [], 0
    for i in range(batch.num_rows):
        r = {c: batch.column(c)[i].as_py() for c in ("item_words", "words", "pairs", "least")}
        item, words = np.frombuffer(r["item_words"], np.uint64), np.frombuffer(r["words"], np.uint64)
        n = len(item)
        pairs = np.array([(p["start"], p["position"]) for p in r["pairs"]], np.int64)
        starts = window_starts(pairs[:, 0], pairs[:, 1], len(words), n, edits_allowed(n, share), r["least"])
        for a in range(0, len(starts), WINDOWS):
            part = starts[a:a + WINDOWS]
            group.append((i, item, words, part))
            size += len(part)
            if size >= WINDOWS:
                yield group
                group, size = [], 0
    if group:
        yield group


def best_windows(group: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]], share: float) -> Iterator[tuple[int, int, int]]:
    """(pair, distance, start) of the windows of a group within the allowed edits."""
    spans = [words[starts[0]:starts[-1] + len(item)] for _, item, words, starts in group]
    shift = np.concatenate([[0], np.cumsum([len(x) for x in spans])])
    counts = [len(starts) for *_, starts in group]
    owner = np.repeat(np.arange(len(group)), counts)
    starts = np.concatenate([shift[k] + g[3] - g[3][0] for k, g in enumerate(group)])
    items = [g[1] for g in group]
    sizes = np.array([len(i) for i in items])
    ends = np.minimum(starts + sizes[owner], shift[1:][owner])
    words = np.concatenate(spans)
    hits = np.flatnonzero(colliding(words, starts, ends, owner, items))
    hits = hits[np.argsort(sizes[owner[hits]], kind="stable")]
    for a in range(0, len(hits), 1024):
        some = hits[a:a + 1024]
        own = owner[some]
        distances = edit_distances(words, starts[some], ends[some], [items[k] for k in own])
        for k, s, d in zip(own.tolist(), starts[some].tolist(), distances.tolist(), strict=True):
            if d <= edits_allowed(len(items[k]), share):
                yield group[k][0], d, int(s - shift[k] + group[k][3][0])


def verifier(share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row", "id", "item_id"]
        for batch in batches:
            best: dict[int, tuple[int, int]] = {}
            for group in window_groups(batch, share):
                for i, *found in best_windows(group, share):
                    best[i] = min(best.get(i, tuple(found)), tuple(found))
            found = [best.get(i) for i in range(batch.num_rows)]
            columns = [batch.column(c) for c in names]
            columns += [pa.array([b and b[i] for b in found], pa.int64()) for i in (1, 0)]
            keep = pa.array([b is not None for b in found], pa.bool_())
            yield pa.RecordBatch.from_arrays([*columns, batch.column("n").cast(pa.int64())], [*names, "first_word", "distance", "item_words"]).filter(keep)
    return run


def find_contamination(
    docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    item_id_column: str = "item_id", item_text_column: str = "text", share: float = 0.25,
) -> DataFrame:
    """One row per text and item found in it: id, item id, first_word, distance, item_words, and the text's ``row``."""
    named = items.select(F.col(item_id_column).alias("item_id"), F.col(item_text_column).cast("string").alias("text"))
    named = named.where("text IS NOT NULL").distinct().select(F.xxhash64("item_id", "text").alias("item"), "item_id", "text")
    kind = named.schema["item_id"].dataType.simpleString()
    shape = f"item bigint, item_id {kind}, n int, g int, least int, words binary, grams array<bigint>"
    parts = written(named.mapInArrow(item_grams(share), shape), "items")
    grams = parts.select("item", "n", "least", F.posexplode("grams").alias("position", "hash"))
    n_grams, least = parts.agg(F.sum(F.size("grams")), F.min("least")).first()
    sizes = sorted(r.g for r in parts.select("g").distinct().collect())
    pushed = None
    if n_grams and n_grams <= PUSHED_GRAMS:
        pushed = np.sort(grams.select("hash").distinct().toArrow().column("hash").to_numpy().view(np.uint64))
    texts = docs.select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).cast("string").alias("text"))
    if not n_grams:
        texts, sizes, least = texts.limit(0), [1], 1
    seeded = written(texts.mapInArrow(
        seeder(sizes, pushed, least), "row bigint, id bigint, seeds array<struct<start:bigint,hash:bigint>>, words binary"), "seeds")
    seeds = seeded.select("row", F.explode("seeds").alias("s")).select("row", F.col("s.start").alias("start"), F.col("s.hash").alias("hash"))
    pairs = seeds.join(grams, "hash").groupBy("row", "item", "n", "least").agg(
        F.count("*").alias("hits"), F.collect_list(F.struct("start", F.col("position").cast("bigint").alias("position"))).alias("pairs"))
    pairs = pairs.where("hits >= least").drop("hits")
    full = pairs.join(seeded.select("row", "id", "words"), "row").join(
        parts.select("item", "item_id", F.col("words").alias("item_words")), "item")
    full = full.select("row", "id", "item_id", "n", "least", "words", "item_words", "pairs")
    out = full.mapInArrow(verifier(share), f"row bigint, id bigint, item_id {kind}, first_word bigint, distance bigint, item_words bigint")
    out = written(out, "contamination")
    forget(seeded)
    forget(parts)
    return out.withColumnsRenamed({"id": id_column})
