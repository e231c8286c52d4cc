"""Removal of repeated chunks with content-defined boundaries.

A gear hash rolls over the bytes: each step shifts it by one bit and adds a random value of
the byte, so its upper bits depend on the last ``WINDOW`` bytes only.  A chunk ends where the
upper ``bits`` bits are 0 (but not before ``least`` bytes) or at ``most`` bytes, so boundaries move along with inserted bytes
and chunks after an insertion are found again.  Of all chunks with one digest the first
stays, by id and position; the others are removed.

Chunks are compared by 128-bit digests; each task sends one row per digest it holds, and
counting combines before the shuffle.  Defined cases: a NULL text is empty and has no chunk;
a repeated row loses all chunks in the second place; rows without an id come last.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .store import forget, written

WINDOW = 32
GEAR = (tokens.BYTE_VALUES >> np.uint64(32)).astype(np.uint32)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The rolling hash at each byte, by doubling the window: 1, 2, 4, ... bytes."""
    h = GEAR[data]
    for shift in (1, 2, 4, 8, 16):
        h = h.copy()
        h[shift:] += h[:-shift] << np.uint32(shift)
    return h


def chunk_ends(data: np.ndarray, bits: int, least: int, most: int) -> list[int]:
    """Ends of the chunks of one text."""
    if not len(data):
        return []
    marks = np.flatnonzero(gear_hashes(data) >> np.uint32(32 - bits) == 0) + 1
    ends, at = [], 0
    for mark in [*marks.tolist(), len(data)]:
        while mark - at > most:
            at += most
            ends.append(at)
        if mark - at >= least or mark == len(data):
            if mark > at:
                ends.append(mark)
            at = mark
    return ends


def chunker(bits: int, least: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 32
        for batch in batches:
            for piece in tokens.slices(batch, "text"):
                data, off = tokens.utf8(piece.column("text"))
                ends, digests = [], []
                for a, b in zip(off[:-1], off[1:], strict=True):
                    own = chunk_ends(data[a:b], bits, least, most)
                    raw = data[a:b].tobytes()
                    ends.append(own)
                    digests.append([hashlib.blake2b(raw[s:e], digest_size=16).digest() for s, e in zip([0, *own], own)])
                n = piece.num_rows
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + n)), piece.column("id"), pa.array(np.diff(off)),
                     pa.array(ends, pa.list_(pa.int32())), pa.array(digests, pa.list_(pa.binary()))],
                    ["row", "id", "n_bytes", "ends", "digests"])
                row += n
    return run


def mark_repeated_chunks(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", bits: int = 6, least: int = 32, most: int = 1024,
) -> DataFrame:
    """Per row: id, n_bytes, n_chunks, n_repeated, n_removed bytes, the byte ``spans`` to remove and a digest of what is kept."""
    texts = docs.select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).cast("string").alias("text"))
    cut = written(texts.mapInArrow(chunker(bits, least, most), "row bigint, id bigint, n_bytes bigint, ends array<int>, digests array<binary>"), "chunks")
    chunks = cut.select("row", "id", F.posexplode("digests").alias("i", "digest"))
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "row", "i")
    # Most chunks occur once: those repeated within the whole table are few, and only they are joined back.
    first = chunks.groupBy("digest").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1")
    first = written(first, "repeated")
    again = chunks.join(first, "digest").where((F.col("row") != F.col("first.row")) | (F.col("i") != F.col("first.i")))
    gone = again.groupBy("row").agg(F.sort_array(F.collect_list("i")).alias("gone"))
    out = cut.join(gone, "row", "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<int>")))
    out = out.withColumn("spans", F.transform("gone", lambda i: F.struct(
        F.when(i == 0, F.lit(0)).otherwise(F.element_at("ends", F.greatest(i, F.lit(1)))).alias("lo"),
        F.element_at("ends", i + 1).alias("hi"))))
    all_chunks = F.when(F.size("ends") > 0, F.sequence(F.lit(0), F.size("ends") - 1)).otherwise(F.array().cast("array<int>"))
    kept = F.transform(F.array_except(all_chunks, F.col("gone")), lambda i: F.hex(F.get("digests", i)))
    out = out.select(
        F.col("id").alias(id_column), "n_bytes", F.size("ends").cast("bigint").alias("n_chunks"), F.size("gone").cast("bigint").alias("n_repeated"),
        F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + (s["hi"] - s["lo"])).alias("n_removed"),
        F.sha2(F.array_join(kept, ""), 256).alias("kept_digest"), "spans")
    out = written(out, "marked")
    forget(first)
    forget(cut)
    return out


def without_spans(text: str | None, spans: list) -> str:
    """The text without the byte spans (lo, hi); bytes of a cut character go with it."""
    raw, at, parts = (text or "").encode(), 0, []
    for lo, hi in spans:
        parts.append(raw[at:lo])
        at = hi
    return b"".join([*parts, raw[at:]]).decode("utf-8", "ignore")
