"""Removal of long repeated byte strings by merging Burrows-Wheeler transforms.

1. *Shards.*  Texts are packed into shards of about 2 MB.  A shard is parsed into
   phrases at content-defined boundaries (the rightmost smallest 8-byte gram of each
   64 windows), its phrase suffixes are sorted once, and its Burrows-Wheeler transform
   over the phrase alphabet is stored with the step from each suffix to the one before.
2. *Merge.*  All suffixes start in one block of the merged order.  A round refines the
   interleave by one phrase: a suffix gets the block of the suffix after it, extended by
   its own first phrase, read off the transform.  Shards name a block alike (a chained
   hash), so they exchange block names and never suffixes; a block that holds one suffix
   in all shards together leaves.  The round in which a block leaves is its common
   prefix in phrases; blocks still there after ``ROUNDS`` are the repeated intervals.
   Nothing is sorted again, and a block met by a third of all texts sends one name per shard.
3. *Bytes.*  Two equal strings of ``length`` bytes hold the same inner boundaries, and at
   least ``ROUNDS`` whole phrases from the first one (the anchor) on.  So each string is
   looked at from its anchor: anchors of the repeated intervals are compared by the bytes
   that all their strings share and by the bytes that any of them has; only where these
   disagree are single strings compared.  Shorter strings hold fewer whole phrases: with
   ``rounds`` = 1 the intervals after the first round serve strings of 272 bytes or more.
   Two lengths can be looked for at once, on the same transforms and in the same jobs.

Strings are compared by 64-bit hashes.  Defined cases: a NULL text is empty; each row is
a text of its own, so a repeated row of ``length`` bytes or more is removed as a whole in
both places; texts shorter than ``length`` stay.  Ties do not occur.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .store import forget, written

WINDOW, GRAM = 64, 8
ROUNDS = 3
SHARD_BYTES = 2 << 20
TABLE_BYTES = 32 << 20
IDS_PER_BUCKET = 1 << 20
# Lengths of the strings that are looked for, and the rounds of refinement for each.
Lengths = list[tuple[int, int]]
STATE = "shard bigint, ids array<bigint>, ends binary, text binary, bwt binary, lf binary, at binary"


def boundaries(data: np.ndarray) -> np.ndarray:
    """Ascending positions of the selected grams: one at least in any 64 in a row."""
    found, step = [], 1 << 19
    for begin in range(0, max(0, len(data) - WINDOW - GRAM + 2), step):
        x = data[begin:begin + step + WINDOW + GRAM - 2].astype(np.uint64)
        for shift in (1, 2, 4):
            x = x[:-shift] | (x[shift:] << np.uint64(8 * shift))
        last = np.uint64(0xFFFFFFFF)
        key = (tokens.mix(x) & ~last) | (last - np.arange(len(x), dtype=np.uint64))
        for shift in (1, 2, 4, 8, 16, 32):
            key = np.minimum(key[:-shift], key[shift:])
        at = (last - (key & last)).astype(np.int64) + begin
        found.append(at[np.concatenate([[True], at[1:] != at[:-1]])])
    return np.unique(np.concatenate([*found, np.zeros(0, np.int64)]))


def suffix_order(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order and rank of all suffixes of an integer string whose terminators are unique."""
    rank, n, k = symbols.astype(np.int64), len(symbols), 1
    rank = np.unique(rank, return_inverse=True)[1].astype(np.int64)
    while True:
        after = np.zeros(n, np.int64)
        after[:max(0, n - k)] = rank[k:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.zeros(n, np.int64)
        new[order] = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
        rank, k = new, 2 * k
        if rank[order[-1]] == n - 1:
            return order, rank


def transform(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each suffix in sorted order: the phrase before it (0: none), the rank of the suffix that
    begins there, and the byte at which the suffix begins (-1: at the end of a text)."""
    full = np.flatnonzero(off[1:] > off[:-1])
    starts = np.union1d(boundaries(data), off[full])
    ends = np.append(starts[1:], len(data))
    phrase = tokens.span_hashes(data, starts, ends) | np.uint64(1)
    last = np.searchsorted(starts, off[full + 1]) if len(full) else np.zeros(0, np.int64)
    # A terminator follows the phrases of each text; terminators differ and come first.
    value = np.insert(phrase, last, 0)
    at = np.insert(starts, last, -1)
    ranks = np.unique(phrase, return_inverse=True)[1] if len(phrase) else np.zeros(0, np.int64)
    symbols = np.insert(ranks + len(full), last, np.arange(len(full)))
    if not len(symbols):
        return np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32)
    order, rank = suffix_order(symbols)
    before = order - 1
    return value[before], rank[before].astype(np.int32), at[order].astype(np.int32)


def shard_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0

    def row() -> pa.RecordBatch:
        data = np.frombuffer(b"".join(texts), np.uint8)
        ends = np.cumsum([len(t) for t in texts])
        bwt, lf, at = transform(data, np.concatenate([[0], ends]))
        values = {"shard": [number], "ids": [ids], "ends": [ends.tobytes()], "text": [data.tobytes()],
                  "bwt": [bwt.tobytes()], "lf": [lf.tobytes()], "at": [at.tobytes()]}
        kinds = [pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 5]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values.values(), kinds, strict=True)], list(values))

    for batch in batches:
        for own, text in zip(batch.column("id").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
            text = text.as_py() or b""
            if texts and size + len(text) > SHARD_BYTES:
                yield row()
                number, ids, texts, size = number + 1, [], [], 0
            ids.append(own)
            texts.append(text)
            size += len(text)
    if texts:
        yield row()


class Shard:
    """One row of the state and what the merge has said about it."""

    def __init__(self, row: dict):
        self.number, self.ids = row["shard"], row["ids"]
        self.data = np.frombuffer(row["text"], np.uint8) if "text" in row else None
        self.ends = np.frombuffer(row["ends"], np.int64)
        self.bwt = np.frombuffer(row["bwt"], np.uint64)
        self.lf = np.frombuffer(row["lf"], np.int32)
        self.at = np.frombuffer(row["at"], np.int32)
        self.said: dict[int, list] = {}
        for a in sorted(row["answers"] or [], key=lambda a: (a["round"], a["bucket"])):
            self.said.setdefault(a["round"], []).append(np.frombuffer(a["said"], np.uint8))

    def answer(self, round_: int) -> np.ndarray:
        return np.concatenate([*self.said.get(round_, []), np.zeros(0, np.uint8)])

    def blocks(self, rounds: int) -> np.ndarray:
        """The block of each suffix after so many rounds of refinement; 0: it has left."""
        return list(self.refined(rounds))[-1]

    def refined(self, rounds: int) -> Iterator[np.ndarray]:
        """The blocks after each round."""
        ids = np.ones(len(self.lf), np.uint64)
        for k in range(1, rounds + 1):
            go = (ids != 0) & (self.bwt != 0)
            new = np.zeros(len(ids), np.uint64)
            new[self.lf[go]] = tokens.mix(ids[go] * tokens.MULTIPLIER + self.bwt[go]) | np.uint64(2)
            ids = new & ~np.uint64(1)
            if k < rounds or k in self.said:
                names, which = np.unique(ids[ids != 0], return_inverse=True)
                if len(names):
                    ids[ids != 0] *= self.answer(k)[which].astype(np.uint64)
            yield ids

    def anchors(self, lengths: Lengths) -> dict[str, np.ndarray]:
        """Anchors for all lengths, one length after the other."""
        prefix = Substrings(self.data)
        most = max(rounds for _, rounds in lengths)
        after = dict(enumerate(self.refined(most), 1))
        each = [self._anchors(length, self.at[after[rounds] != 0], prefix) for length, rounds in lengths]
        return {**{c: np.concatenate([a[c] for a in each]) for c in each[0]}, "prefix": prefix}

    def _anchors(self, length: int, at: np.ndarray, prefix: Substrings) -> dict[str, np.ndarray]:
        """Anchors in the repeated intervals with the range [lo, hi] of the strings that have them first."""
        inner = WINDOW - 1
        starts = np.sort(self.at[self.at >= 0]).astype(np.int64)
        p = np.sort(at).astype(np.int64)
        begin = np.concatenate([[0], self.ends[:-1]])
        text = np.searchsorted(self.ends, p, "right")
        before = np.concatenate([[0], starts])[np.searchsorted(starts, p)]
        lo = np.maximum(np.maximum(before - inner + 1, begin[text]), p - inner - WINDOW + 1)
        hi = np.minimum(p - inner, self.ends[text] - length)
        ok = lo <= hi
        p, lo, hi = p[ok], lo[ok], hi[ok]
        core = prefix.hash(p - inner, p - inner - WINDOW + 1 + length)
        whole = tokens.mix(prefix.hash(lo, hi + length) + (p - lo).astype(np.uint64) * tokens.MULTIPLIER)
        return {"lo": lo, "hi": hi, "core": core, "whole": whole & ~np.uint64(1), "length": np.full(len(p), length)}


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base of substring hashes, and of its inverse."""
    base = np.uint64(0xD1342543DE82EF95)
    return tokens.powers(n, base), tokens.powers(n, np.uint64(pow(int(base), -1, 1 << 64)))


class Substrings:
    """Hashes of any substrings of one byte string, by prefix sums."""

    def __init__(self, data: np.ndarray):
        ahead, self.back = _powers(1 << (len(data) + 1).bit_length())
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(tokens.BYTE_VALUES[data] * ahead[:len(data)], out=self.sums[1:])

    def hash(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return tokens.mix((self.sums[end] - self.sums[begin]) * self.back[begin] + (end - begin).astype(np.uint64))


def _named(values: np.ndarray) -> np.ndarray:
    """Sorted distinct even names; odd where a name occurs here more than once."""
    names, counts = np.unique(values, return_counts=True)
    return names | (counts > 1).astype(np.uint64)


def block_names(shard: Shard, round_: int, lengths: Lengths) -> np.ndarray:
    ids = shard.blocks(round_)
    return _named(ids[ids != 0])


def _pair_kinds(core: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each distinct pair stands first, in the order of the pairs; which pair each entry is; how often each occurs."""
    order = np.lexsort((whole, core))
    c, w = core[order], whole[order]
    new = np.ones(len(order), bool)
    new[1:] = (c[1:] != c[:-1]) | (w[1:] != w[:-1])
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    return order[first], which, np.diff(np.append(first, len(order)))


def anchor_names(shard: Shard, round_: int, lengths: Lengths) -> np.ndarray:
    a = shard.anchors(lengths)
    first, _, counts = _pair_kinds(a["core"], a["whole"])
    return np.stack([a["core"][first], a["whole"][first] | (counts > 1).astype(np.uint64)], axis=1)


def _anchor_answers(shard: Shard, a: dict) -> np.ndarray:
    return shard.answer(ROUNDS + 1)[_pair_kinds(a["core"], a["whole"])[1]]


def _strings(a: dict, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begins, names and lengths of all strings of the chosen anchors."""
    n = a["hi"][chosen] - a["lo"][chosen] + 1
    begin = np.repeat(a["lo"][chosen] - np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else n, n) + np.arange(int(n.sum()))
    length = np.repeat(a["length"][chosen], n)
    return begin, a["prefix"].hash(begin, begin + length) & ~np.uint64(1), length


def string_names(shard: Shard, round_: int, lengths: Lengths) -> np.ndarray:
    a = shard.anchors(lengths)
    return _named(_strings(a, _anchor_answers(shard, a) >= 2)[1])


def repeated_names(table: pa.Table) -> pa.Table:
    """For the names of a bucket from all shards: 1 where a name occurs twice or more in all."""
    packs = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("names")]
    names = np.concatenate(packs)
    plain, which, counts = np.unique(names & ~np.uint64(1), return_inverse=True, return_counts=True)
    many = (counts > 1) | (np.bincount(which, weights=names & np.uint64(1), minlength=len(counts)) > 0)
    return _answers(table, [len(x) for x in packs], many[which].astype(np.uint8))


def compared_anchors(table: pa.Table) -> pa.Table:
    """For anchors: 0: none has the same core; 1: all their strings repeat; 2: each string is to be
    compared; 3: all repeat, and this shard sends them to those at 2."""
    packs = [np.frombuffer(x.as_py(), np.uint64).reshape(-1, 2) for x in table.column("names")]
    pairs = np.concatenate(packs)
    core = np.unique(pairs[:, 0], return_inverse=True)[1]
    first, whole, counts = _pair_kinds(pairs[:, 0], pairs[:, 1] & ~np.uint64(1))
    many = (counts > 1) | (np.bincount(whole, weights=pairs[:, 1] & np.uint64(1), minlength=len(first)) > 0)
    mixed = np.bincount(core[first])[core] > 1
    said = np.where(many[whole], 1, np.where(mixed, 2, 0)).astype(np.uint8)
    leader = np.zeros(len(pairs), bool)
    leader[first] = True
    said[leader & mixed & many[whole]] = 3
    return _answers(table, [len(x) for x in packs], said)


def _answers(table: pa.Table, lens: list[int], said: np.ndarray) -> pa.Table:
    parts = np.split(said, np.cumsum(lens)[:-1])
    return pa.table({"shard": table.column("shard"), "round": table.column("round"), "bucket": table.column("bucket"),
                     "said": pa.array([x.tobytes() for x in parts], pa.binary())})


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield Shard({c: batch.column(c)[i].as_py() for c in batch.schema.names})


def sender(names: Callable, round_: int, lengths: Lengths, n_buckets: int):
    """Sorted names of each shard, cut at equal ranges of the hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _rows(batches):
            values = names(shard, round_, lengths)
            lead = values if values.ndim == 1 else values[:, 0]
            bucket = ((lead >> np.uint64(32)) * np.uint64(n_buckets)) >> np.uint64(32)
            kinds, at = np.unique(bucket, return_index=True)
            packs = np.split(values, at[1:]) if len(at) else []
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard.number] * len(packs), pa.int64()), pa.array([round_] * len(packs), pa.int32()),
                 pa.array(kinds.astype(np.int64), pa.int64()), pa.array([x.tobytes() for x in packs], pa.binary())],
                ["shard", "round", "bucket", "names"])
    return run


def _covered(shard: Shard, lengths: Lengths) -> list[np.ndarray]:
    """For each length, which bytes of the shard lie in a repeated string."""
    a = shard.anchors(lengths)
    said = _anchor_answers(shard, a)
    begin, names, sizes = _strings(a, said >= 2)
    kinds, which = np.unique(names, return_inverse=True)
    repeated = shard.answer(ROUNDS + 2)[which] > 0 if len(kinds) else np.zeros(len(begin), bool)
    sure = (said == 1) | (said == 3)
    out = []
    for length, _ in lengths:
        all_of, single = sure & (a["length"] == length), begin[repeated & (sizes == length)]
        begins = np.concatenate([a["lo"][all_of], single])
        ends = np.concatenate([a["hi"][all_of], single]) + length
        n = len(shard.data) + 1
        out.append(np.cumsum(np.bincount(begins, minlength=n) - np.bincount(ends, minlength=n))[:-1] > 0)
    return out


def remover(lengths: Lengths):
    """Per text: the id, its spans to remove, what is left, and how many bytes lie in repeats of the last length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _rows(batches):
            covered = _covered(shard, lengths)
            gone, repeated = covered[0], np.concatenate([[0], np.cumsum(covered[-1])])
            out: dict[str, list] = {"n_bytes": [], "n_repeated": [], "starts": [], "ends": [], "kept_text": [], "kept_sha256": []}
            for b, e in zip(np.concatenate([[0], shard.ends[:-1]]), shard.ends, strict=True):
                own = np.diff(np.concatenate([[0], gone[b:e].astype(np.int8), [0]]))
                out["n_bytes"].append(int(e - b))
                out["n_repeated"].append(int(repeated[e] - repeated[b]))
                out["starts"].append(np.flatnonzero(own == 1))
                out["ends"].append(np.flatnonzero(own == -1))
                kept = shard.data[b:e][~gone[b:e]].tobytes()
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                out["kept_text"].append(kept.decode("utf-8", "ignore"))
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard.ids, pa.int64()), *[pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)]], ["id", *out])
    return run


def least_length(rounds: int) -> int:
    """The shortest strings that hold ``rounds`` whole phrases after their anchor, for certain."""
    return 3 * WINDOW + 2 * GRAM + rounds * WINDOW


def remove_repeats(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = 400, rounds: int = ROUNDS,
    passage: int | None = None, passage_rounds: int = 1,
) -> DataFrame:
    """Per row: the id, ``n_bytes``, ``starts`` and ``ends`` of the removed byte runs, the SHA-256 of the bytes that
    are left, and these as ``kept_text`` (without the bytes of a character that was cut).

    ``n_repeated`` counts the bytes in repeated strings of ``passage`` bytes, removed or not (of ``length``, if
    ``passage`` is not given).  Strings of either length must hold as many phrases as the rounds that are asked for:
    400 bytes for three rounds, 336 for two, 272 for one.
    """
    lengths: Lengths = [(length, rounds)] + ([(passage, passage_rounds)] if passage else [])
    for size, n in lengths:
        if size < least_length(n):
            raise ValueError(f"strings shorter than {least_length(n)} bytes need not hold enough phrases")
    spark = docs.sparkSession
    texts = docs.select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).cast("string").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_tables = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // TABLE_BYTES)
    name = f"suffix_{uuid.uuid4().hex}"
    steps: list[DataFrame] = []
    try:
        # Bucketed by shard: each round reads only the columns it needs and joins the answers without moving a shard.
        texts.mapInArrow(shard_rows, STATE).write.bucketBy(n_tables, "shard").option("compression", "zstd").saveAsTable(name)
        out = _merged(spark.table(name), lengths, steps)
        return written(out.withColumnRenamed("id", id_column), "repeats")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        for step in steps:
            forget(step)


def _merged(state: DataFrame, lengths: Lengths, steps: list[DataFrame]) -> DataFrame:
    """The rounds of the merge, then the texts without their repeats; the answers of each round are written to ``steps``."""
    n_suffixes = state.agg(F.sum(F.length("lf") / 4)).first()[0] or 0
    n_buckets = max(8, int(n_suffixes) // IDS_PER_BUCKET)
    answers = None

    def with_answers(*columns: str) -> DataFrame:
        own = state.select("shard", "ids", "ends", "bwt", "lf", "at", *columns)
        if answers is None:
            return own.withColumn("answers", F.expr("CAST(NULL AS array<struct<round:int,bucket:bigint,said:binary>>)"))
        mine = answers.groupBy("shard").agg(F.collect_list(F.struct("round", "bucket", "said")).alias("answers"))
        return own.join(mine.hint("shuffle_hash"), "shard", "left")

    steps_of = [(block_names, k, repeated_names, ()) for k in range(1, max(n for _, n in lengths) + 1)]
    steps_of += [(anchor_names, ROUNDS + 1, compared_anchors, ("text",)), (string_names, ROUNDS + 2, repeated_names, ("text",))]
    for names, k, judge, columns in steps_of:
        sent = with_answers(*columns).mapInArrow(sender(names, k, lengths, n_buckets), "shard bigint, round int, bucket bigint, names binary")
        said = sent.groupBy("bucket").applyInArrow(judge, "shard bigint, round int, bucket bigint, said binary")
        steps.append(written(said, "answers"))
        answers = steps[-1] if answers is None else answers.unionByName(steps[-1])
    return with_answers("text").mapInArrow(
        remover(lengths), "id bigint, n_bytes bigint, n_repeated bigint, starts array<bigint>, ends array<bigint>, kept_text string, kept_sha256 string")
