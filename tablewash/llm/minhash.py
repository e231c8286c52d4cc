"""Near-duplicate texts: fast similarity sketches, banding and exact verification.

The sketch follows "fast similarity sketching": in round ``i`` every element falls
into one hashed bin with the value ``i`` plus a hashed fraction, each bin keeps its
smallest value, and rounds go on until every bin is filled; from round ``t`` on,
round ``i`` fills bin ``i - t`` for certain.  So each coordinate is filled and two
sketches agree in a coordinate with a probability equal to the Jaccard similarity.

At the default 128 coordinates in 32 bands of 4, two sets at similarity 0.75 share
no band with a probability of 5 in a million; every link is confirmed on full sets.

Defined cases: a NULL or blank text has no shingles and no link.  A row without an id
is never linked, is kept and has no component.  Rows that repeat an id share a result
per text.  Ties do not occur: components and their names do not depend on row order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .components import components
from .store import forget, written

# Up to so many ids of texts with a possible partner are sent to the scan; more are shuffled to it.
BROADCAST_IDS = 1_000_000
FEATURES = "id bigint, n_shingles bigint, cls binary, bands array<bigint>"


def sketch(elements: np.ndarray, text: np.ndarray, n_texts: int, t: int, seed: int) -> np.ndarray:
    """Sketches of ``t`` coordinates (a power of two) for sets given as (element, text number) pairs."""
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full(n_texts * t, empty, np.uint64)
    base = text * t
    places = 64 - (2 * t - 1).bit_length()  # the round stands above the fraction
    low = np.uint64((1 << places) - 1)
    shift = np.uint64(64 - int(t).bit_length() + 1)
    for i in range(2 * t):
        z = tokens.mix(elements ^ tokens.mix(np.array([seed * 4096 + i + 1], np.uint64)))
        bins = (z >> shift).astype(np.int64) if i < t else i - t
        np.minimum.at(out, base + bins, (tokens.mix(z) & low) | np.uint64(i << places))
        open_texts = (out.reshape(n_texts, t) == empty).any(axis=1)
        going_on = open_texts[base // t]
        if not going_on.any():
            break
        elements, base = elements[going_on], base[going_on]
    return out.reshape(n_texts, t)


def text_sets(data: np.ndarray, off: np.ndarray, k: int) -> list[np.ndarray]:
    starts, ends = tokens.words(data, off)
    hashes = tokens.span_hashes(tokens.LOWER[data], starts, ends)
    at = tokens.counts_by_text(starts, off)
    return [tokens.shingles(hashes[a:b], k) for a, b in zip(at[:-1], at[1:], strict=True)]


def _digest(elements: np.ndarray) -> bytes | None:
    return hashlib.blake2b(elements.tobytes(), digest_size=16).digest() if len(elements) else None


def features(k: int, t: int, rows: int, seed: int):
    """Set size, class (digest of the whole set) and band keys of every text."""
    n_bands = t // rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in tokens.slices(batch, "text"):
                sets = text_sets(*tokens.utf8(piece.column("text")), k)
                sizes = np.array([len(s) for s in sets])
                drawn = sketch(np.concatenate([*sets, np.zeros(0, np.uint64)]), np.repeat(np.arange(len(sets)), sizes), len(sets), t, seed)
                keys = np.zeros((len(sets), n_bands), np.uint64)
                for j, p in enumerate(tokens.powers(rows + 1)[1:]):
                    keys += drawn[:, j::rows] * p
                keys = tokens.mix(keys + np.arange(n_bands, dtype=np.uint64)).view(np.int64)
                bands = pa.ListArray.from_arrays(np.arange(len(sets) + 1, dtype=np.int32) * n_bands, pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [piece.column("id"), pa.array(sizes, pa.int64()), pa.array([_digest(s) for s in sets], pa.binary()), bands],
                    ["id", "n_shingles", "cls", "bands"])
    return run


def packed_sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in tokens.slices(batch, "text"):
                sets = text_sets(*tokens.utf8(piece.column("text")), k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([_digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())],
                    ["cls", "members"])
    return run


def confirmed(percent: int):
    """Pairs whose full sets have 100 * intersection >= percent * union."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for a, b in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                x, y = np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64)
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))
    return run


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [np.frombuffer(m.as_py(), np.int64) for m in batch.column("members")]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
        values = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*sets, np.zeros(0, np.int64)])))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("cls", "label", "tail", "n")), values], ["cls", "label", "tail", "n", "elements"])


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    full = pairs.join(sets.select(F.col("cls").alias("a"), F.col("members").alias("set_a")), "a") \
        .join(sets.select(F.col("cls").alias("b"), F.col("members").alias("set_b")), "b")
    return full.mapInArrow(confirmed(percent), "a binary, b binary")


def similar_size(percent: int, a: str, b: str) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def tail_pairs(members: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components within a bucket that may still be similar, by prefix filtering.

    In each bucket the members outside its largest component are the tail.  With the
    elements of each set ordered from rare to frequent, two sets with an overlap of ``o`` or
    more share one of the first ``size - o + 1`` elements of both.
    """
    placed = members.select("key", "cls", "n").join(labels.withColumnRenamed("node", "cls"), "cls")
    parts = placed.groupBy("key", "label").agg(F.count("*").alias("size"))
    main = parts.groupBy("key").agg(F.count("*").alias("parts"), F.max_by("label", F.struct("size", "label")).alias("main")).where("parts > 1")
    open_ = placed.join(main.select("key", "main"), "key")
    open_ = open_.groupBy("cls", "label", "n").agg(F.max(F.col("label") != F.col("main")).alias("tail"))
    rows = open_.join(sets, "cls").select("cls", "label", "tail", "n", "members")
    rows = rows.mapInArrow(unpacked, "cls binary, label bigint, tail boolean, n bigint, elements array<bigint>")
    rows = written(rows, "elements").select("cls", "label", "tail", "n", F.explode("elements").alias("element"))
    frequency = rows.groupBy("element").agg(F.count("*").alias("df"))
    order = F.row_number().over(Window.partitionBy("cls").orderBy("df", "element"))
    # The shortest possible partner asks for the longest prefix.
    prefix = rows.join(frequency, "element").withColumn("rank", order).where(
        F.expr(f"rank <= n - (n * {percent} + 99) div 100 + 1"))
    prefix = written(prefix.where("df > 1"), "prefix")
    b = prefix.select("element", F.col("cls").alias("b"), F.col("label").alias("label_b"), F.col("n").alias("n_b"), F.col("rank").alias("rank_b"))
    overlap = F.expr(f"((n + n_b) * {percent} + {99 + percent}) div {100 + percent}")
    met = prefix.where("tail").withColumnRenamed("cls", "a").join(b, "element").where(
        (F.col("label") != F.col("label_b")) & similar_size(percent, "n", "n_b")
        & (F.col("rank") <= F.col("n") - overlap + 1) & (F.col("rank_b") <= F.col("n_b") - overlap + 1))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", k: int = 5, percent: int = 75,
    coordinates: int = 128, band_rows: int = 4, seed: int = 1,
) -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept.

    Texts with equal sets form one class.  Each bucket (classes that share a band) has a
    pivot, the member that shares the most with crowded buckets, and all members are
    compared with it: in a group of copies of one text that is the least changed copy, the
    same in all bands.  What then lies in different components of one bucket is compared as
    far as :func:`tail_pairs` cannot rule it out, so no bucket is capped, no pair of
    different components is left out, and a bucket is never spread into all its pairs.
    """
    texts = docs.select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).cast("string").alias("text"))
    feats = written(texts.mapInArrow(features(k, coordinates, band_rows, seed), FEATURES), "features")
    linked = feats.where("id IS NOT NULL AND n_shingles > 0")
    classes = written(linked.groupBy("cls").agg(F.min("id").alias("label"), F.max("n_shingles").alias("n")), "classes")

    named = classes.join(linked.select("cls", "bands", F.col("id").alias("label")), ["cls", "label"])
    entries = named.dropDuplicates(["cls"]).select("cls", "n", F.explode(F.array_distinct("bands")).alias("key"))
    sizes = entries.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = written(entries.join(sizes, "key"), "members")
    crowds = written(members.groupBy("cls").agg(F.sum("size").alias("crowd")).join(classes, "cls"), "crowds")

    wanted = crowds.select(F.col("label").alias("id")).distinct()
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    sets = texts.join(wanted, "id", "left_semi").mapInArrow(packed_sets(k), "cls binary, members binary")
    sets = written(sets.dropDuplicates(["cls"]), "sets")

    placed = members.join(crowds.select("cls", "crowd"), "cls")
    pivots = placed.groupBy("key").agg(F.max(F.struct("crowd", "cls", "n")).alias("p"))
    pivots = pivots.select("key", F.col("p.cls").alias("a"), F.col("p.n").alias("n_a"))
    pairs = placed.withColumnRenamed("cls", "b").join(pivots, "key").where((F.col("a") != F.col("b")) & similar_size(percent, "n", "n_a"))
    links = verified(written(pairs.select("a", "b").distinct(), "pairs"), sets, percent)
    labels = components(written(links, "links"), classes.select(F.col("cls").alias("node"), "label"))
    rest = written(tail_pairs(members, labels, sets, percent), "pairs")
    if rest.limit(1).count():
        labels = components(written(verified(rest, sets, percent), "links"), labels)
    for done in (sets, members, crowds):
        forget(done)
    names = labels.select(F.col("node").alias("cls"), F.col("label").alias("component_id"))
    out = feats.select("id", "n_shingles", "cls").join(names, "cls", "left")
    own = F.coalesce(F.when(F.col("id").isNotNull(), F.col("component_id")), "id")
    out = out.select(F.col("id").alias(id_column), "n_shingles", own.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_column) == F.col("component_id"), F.lit(True)))
